"""Sequence packing along a Hilbert curve.

Token ids of a document are hashed into signed buckets and projected to three
dimensions; the cell of the projection gets a Hilbert key.  Documents are
range-sorted by (key, id) and laid end to end; cutting that line every
``length`` tokens gives sequences of neighbouring documents, of which only the
last is padded.

Null and empty texts have the end token alone.  Repeated rows are packed as
documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from revisit.llm.common import staged

DIMS, ORDER = 3, 10
TOKENIZER = "word_bpe_49k.json"


def projection(vocabulary: int = 65536, buckets: int = 256) -> np.ndarray:
    """Row of each token id: the signed projection row of its hash bucket."""
    rows = np.random.default_rng(1).standard_normal((buckets, DIMS))
    h = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 3) for i in range(vocabulary)], dtype=np.uint64)
    return rows[(h % np.uint64(buckets)).astype(int)] * np.where(h >> np.uint64(63), 1.0, -1.0)[:, None]


def hilbert_keys(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert index of each row of cells: Gray-decode the transposed
    coordinates (J. Skilling, Programming the Hilbert curve, 2004)."""
    x, n = [c.astype(np.int64) for c in cells.T], cells.shape[1]
    for b in range(order - 1, 0, -1):
        p = (1 << b) - 1
        for i in range(n):
            on = x[i] >> b & 1 == 1
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(on, p, t)
            x[i] = x[i] ^ t
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(order - 1, 0, -1):
        t = np.where(x[n - 1] >> b & 1 == 1, t ^ ((1 << b) - 1), t)
    return sum(((x[i] ^ t) >> b & 1) << (b * n + n - 1 - i) for b in range(order) for i in range(n))


def hilbert(cell: list[int], order: int = ORDER) -> int:
    return int(hilbert_keys(np.array([cell]), order)[0])


class Words(dict):
    """Ids, as little-endian 16-bit bytes, of pre-tokens; emptied at ``limit``
    entries."""

    def __init__(self, model, spelled: dict[int, str], limit: int):
        self.model, self.spelled, self.limit = model, spelled, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(word.translate(self.spelled))])
        self[word] = ids
        return ids


class Cutter:
    """Ids of whole texts, pre-token by pre-token.

    Where a text has only printable ASCII, usual white space and the accented
    letters of Latin-1, the tokenizer's normalising is lower-casing and its cut
    is ``CUT``.  It never joins pieces over an ASCII space or line break, so a
    space-free part with any other character goes through the tokenizer's own
    normaliser and cut, and so does a text with a special token's string."""

    LETTERS = "a-z\xdf-\xf6\xf8-\xff"
    OTHER = re.compile("[^\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]")
    CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t\n\r ]+")

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer
        self.tok = tok = Tokenizer.from_file(path)
        spelled = {c: tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.words, self.cut_words = Words(tok.model, spelled, limit), Words(tok.model, {}, limit)
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.CUT.findall(text.lower())])

    def part(self, part: str) -> bytes:
        words = self.cut_words
        return b"".join([words[w] for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))])

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        if not self.OTHER.search(text):
            return self.plain(text)
        text, at, out = text.replace("\n", " "), 0, []
        while m := self.OTHER.search(text, at):
            start, end = text.rfind(" ", at, m.start()) + 1 or at, text.find(" ", m.end())
            end = len(text) if end < 0 else end
            out += [self.plain(text[at:start]), self.part(text[start:end])]
            at = end
        return b"".join([*out, self.plain(text[at:])])


#: One per tokenizer file and Python worker, shared by the worker's tasks.
_CUTTERS: dict[str, Cutter] = {}


def tokenized(text: Column, path: str, end_id: int, cache_words: int) -> Column:
    """Struct (ids: little-endian 16-bit ids with the end id, key: Hilbert key)."""
    @F.pandas_udf("ids binary, key long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from revisit.llm import curve_packing
        if path not in curve_packing._CUTTERS:
            curve_packing._CUTTERS[path] = Cutter(path)
        cutter = curve_packing._CUTTERS[path]
        cutter.words.limit = cutter.cut_words.limit = cache_words
        table, end = projection(), end_id.to_bytes(2, "little")
        for texts in batches:
            ids = [cutter.ids(text or "") + end for text in texts]
            spots = [np.frombuffer(x, dtype="<u2") for x in ids]
            points = np.array([table[a].sum(0) / np.sqrt(len(a)) for a in spots]).reshape(-1, DIMS)
            cells = np.clip((np.arctan(points) / np.pi + 0.5) * (1 << ORDER), 0, (1 << ORDER) - 1).astype(np.int64)
            yield pd.DataFrame({"ids": ids, "key": hilbert_keys(cells)})
    return udf(text)


PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "hilbert_key long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
         end_id: int = 1, cache_words: int = 500_000) -> DataFrame:
    """Pieces of the packed sequences, one row per piece (see ``PIECE``).  A
    Python worker remembers the ids of ``cache_words`` pre-tokens (about 200
    bytes each)."""
    tok = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                             tokenized(F.col(text_col), path, end_id, cache_words).alias("t"))
                 .select("doc_id", "row", "t.ids", "t.key", (F.octet_length("t.ids") / 2).cast("long").alias("n")), "tokens")

    def place(batches):
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            where = np.cumsum([at, *b.column("n").to_pylist()])
            at = int(where[-1])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([part] * len(b), pa.int32()),
                                              pa.array(where[:-1], pa.int64()), pa.array(where[1:], pa.int64())],
                                             ["row", "part", "at", "next"])

    # only (key, id, length) are sorted; the ids stay in the written table
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    curve = staged(tok.select("key", "doc_id", "row", "n").repartitionByRange(parts, "key", "doc_id", "row")
                   .sortWithinPartitions("key", "doc_id", "row").mapInArrow(
                       place, "row long, part int, at long, next long"), "curve")
    sums = curve.groupBy("part").agg(F.max("next").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sums):  # one row per partition of the plan
        base[r["part"]], total = total, total + r["n"]

    def cut(batches):
        for b in batches:
            out = []
            for doc, raw, key, part, at in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                at += base[part]
                start = 0
                while start < len(ids):
                    seq, off = divmod(at + start, length)
                    n = min(length - off, len(ids) - start)
                    out.append((doc, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), seq, off, key))
                    start += n
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                              "offset", "hilbert_key"])

    return (tok.select("row", "doc_id", "ids", "key").join(curve.select("row", "part", "at"), "row")
            .select("doc_id", "ids", "key", "part", "at").mapInArrow(cut, PIECE))
