"""Line dedup by a segment-partition edit join.

Lines of at least ``min_chars`` characters are cut into ``edits`` + 1 segments.
Two lines within ``edits`` edit operations share a segment at nearly the same
place, so length-aware substring probes of one line meet the segment index of
the other.  Lines that share a key are verified by a banded bit-parallel edit
distance.  Two lines are also linked when few enough whole words are inserted,
dropped or replaced; that number grows with the words of the shorter line
(``word_edits``), and the same index, probes and band run over words.  Exact
copies form one class first; classes linked by verified distances form a group,
and its first line (least document id, then text hash and line number) is kept.

The keys of a batch of lines are substring hashes from one prefix sum, cut for
all lines at once.  They are shuffled without texts, packed by bucket of the
key: a row is one batch's keys of a bucket, own segments before probes.  Buckets
are met one after another, probes that no own segment of the bucket has are
dropped as they come, and the keys that two different lines share are kept.  The
texts of those lines alone are fetched to verify them.

Null texts have no lines; blank lines and lines of fewer than ``copy_chars``
characters (``min_chars`` if null) are never removed; between the two sizes
only exact copies are.  A row is known by its id and a hash of its text: rows
that repeat both count as one document, different texts under one id, or under
null ids, as different ones.  Extra columns pass through.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm.common import drop_staged, staged
from revisit.llm.linking import bounded_broadcast, components, link_blocks

#: One word edit for so many words of a line.
WORDS_PER_EDIT = 20
#: Characters whose keys are cut at once, keys packed at once, and keys of a bucket held before the shared ones are passed on.
CHARS, PACKED, HELD = 2_000_000, 4_000_000, 4_000_000
LOW = np.uint64(0x7FFF_FFFF_FFFF_FFFF)
#: A key's remainder beside its bucket, and the line hash.
ENTRY = np.dtype([("key", "<u4"), ("node", "<u8")])


def word_edits(n: np.ndarray) -> np.ndarray:
    """Word edits allowed for lines of ``n`` words: one in 20, from 90 words on
    the cube root of n, as the keys of a line grow with the cube of its edits
    and thus with its words."""
    n = np.maximum(n, 0)
    return np.minimum(n // WORDS_PER_EDIT, np.floor(np.cbrt(n) + 1e-9).astype(np.int64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slices:
    """Hashes, modulo 2^64, of any slices of one sequence of integers."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, values: np.ndarray):
        self.up, self.down = self.powers(1 << max(len(values), 1).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:len(values)], dtype=np.uint64)])

    @staticmethod
    @cache
    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        run = lambda b: np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64)))
        return run(Slices.BASE), run(pow(Slices.BASE, -1, 1 << 64))

    def at(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def segment_keys(seq: Slices, first: np.ndarray, n: np.ndarray, allowed, kind: int):
    """(row, key, probe) arrays: each row's own segments, and its substrings
    against every indexed length from n - edits to n.  Row r is the slice of
    ``seq`` from ``first[r]`` with ``n[r]`` items; ``allowed`` gives the edits of
    an indexed length.  The start positions are the multi-match-aware ones;
    the key covers the substring, the indexed length and the segment number."""
    gap, last = 0, int(allowed(n).max(initial=0))
    while gap <= last:
        length = n - gap
        edits = allowed(length)
        for e in np.unique(edits[(edits >= max(gap, 1)) & (length > edits)]).tolist():
            rows = np.flatnonzero((edits == e) & (length > e))
            spots = [(i, shift) for i in range(e + 1) for shift in range(max(-i, gap - (e - i)), min(i, gap + e - i) + 1)]
            i, shift = np.array(spots).T
            whole = length[rows, None]
            short, plain = whole // (e + 1), e + 1 - whole % (e + 1)  # the last segments have one item more
            size = short + (i >= plain)
            at = short * i + np.maximum(i - plain, 0) + shift
            r, c = np.nonzero((at >= 0) & (at + size <= n[rows, None]))
            salt = mixed((whole[r, 0].astype(np.uint64) << np.uint64(20)) + (2 * i[c] + kind).astype(np.uint64))
            yield rows[r], mixed(seq.at(first[rows[r]] + at[r, c], size[r, c]) ^ salt), (gap != 0) | (shift[c] != 0)
        gap += 1


def line_keys(lines: list[str], edits: int):
    """(row, key, probe) arrays of lines, by characters and by words.  A line
    with so many word edits that they cover all character edits has no keys of
    its characters."""
    codes = np.frombuffer((" ".join(lines) + " ").encode("utf-32-le", "replace"), dtype="<u4")
    n = np.array([len(x) for x in lines], dtype=np.int64)
    first = np.append(0, np.cumsum(n + 1)[:-1])
    chars = Slices(codes.astype(np.uint64) + np.uint64(1))
    ends = np.flatnonzero(codes == 32)
    starts = np.append(0, ends[:-1] + 1)
    first_word = np.searchsorted(starts, first)
    n_words = np.append(first_word[1:], len(starts)) - first_word
    words = Slices(mixed(chars.at(starts, ends - starts) + (ends - starts).astype(np.uint64)))
    short = np.flatnonzero(word_edits(n_words - 2 * edits) < 2 * edits)
    found = [(short[r], k, p) for r, k, p in segment_keys(chars, first[short], n[short], lambda x: np.full(len(x), edits), 0)]
    found += list(segment_keys(words, first_word, n_words, word_edits, 1))
    join = lambda at, kind: np.concatenate([np.zeros(0, kind), *[x[at] for x in found]])
    return join(0, np.int64), join(1, np.uint64), join(2, bool)


def _packed(edits: int, buckets: int):
    """Batches (h, line) to rows (bucket, probe, packed entries); ``buckets`` is
    a power of two, the top bits of a key give its bucket."""
    shift = np.uint64(64 - max(1, buckets.bit_length() - 1))

    def flush(held):
        key, node, probe = (np.concatenate(x) for x in zip(*held))
        place = (key >> shift).astype(np.int64) * 2 + probe
        order = np.argsort(place, kind="stable")
        entries = np.empty(len(key), dtype=ENTRY)
        entries["key"], entries["node"] = (key[order] & np.uint64(0xFFFF_FFFF)).astype(np.uint32), node[order]
        place = place[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        raw, ends = entries.tobytes(), np.append(first[1:], len(place)) * ENTRY.itemsize
        blobs = [raw[a:b] for a, b in zip((first * ENTRY.itemsize).tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(place[first] >> 1), pa.array((place[first] & 1).astype(np.int8)), pa.array(blobs, pa.binary())],
                                          ["bucket", "probe", "entries"])

    def batches(rows):
        held, n = [], 0
        for b in rows:
            h, first = np.unique(b.column("h").to_numpy(), return_index=True)
            lines = b.column("line").take(pa.array(first)).to_pylist()
            size = np.cumsum([len(x) for x in lines])
            cuts = np.searchsorted(size, np.arange(CHARS, (size[-1] if len(size) else 0) + CHARS, CHARS)) + 1
            for at, to in zip(np.append(0, cuts), cuts):
                if part := lines[at:to]:
                    row, key, probe = line_keys(part, edits)
                    if len(key):
                        held.append((key, h[at:to][row].view(np.uint64) & LOW, probe))
                        n += len(key)
                if n >= PACKED:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)
    return batches


class Bucket:
    """The keys of one bucket: own segments first, then the probes."""

    def __init__(self, number: int):
        self.number, self.passed = number, np.zeros(0, dtype=np.uint32)
        self.key, self.node, self.indexed = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint64), None

    def take(self, entries: bytes, probe: bool):
        """Add entries; the rows to pass on at once, if any."""
        e = np.frombuffer(entries, dtype=ENTRY)
        key, node = e["key"], e["node"]
        if probe:
            if self.indexed is None:
                self.indexed = np.unique(np.concatenate([self.key, self.passed]))
            at = np.minimum(np.searchsorted(self.indexed, key), len(self.indexed) - 1)
            known = self.indexed[at] == key if len(self.indexed) else np.zeros(len(key), dtype=bool)
            key, node = key[known], node[known]
        if len(self.passed):
            late = np.isin(key, self.passed)
            yield self.out(key[late].astype(np.uint64), node[late])
            key, node = key[~late], node[~late]
        self.key, self.node = np.concatenate([self.key, key]), np.concatenate([self.node, node])
        if len(self.key) > HELD:
            shared, key, node = self.groups()
            yield self.out(key[shared].astype(np.uint64), node[shared])
            self.passed = np.union1d(self.passed, key[shared])
            self.key, self.node = key[~shared], node[~shared]

    def out(self, key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((key + (np.uint64(self.number) << np.uint64(32))).view(np.int64)), pa.array(node.view(np.int64))],
                                          ["key", "node"])

    def groups(self):
        """Sorted keys and nodes without repeats, and which keys have several."""
        order = np.lexsort((self.node, self.key))
        key, node = self.key[order], self.node[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[:len(key)]
        key, node = key[fresh], node[fresh]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[at] > 1, key, node

    def close(self) -> pa.RecordBatch:
        """The shared keys left.  A group is renamed to the sum of its mixed
        nodes, so that groups of the same lines become equal."""
        shared, key, node = self.groups()
        key, node = key[shared], node[shared]
        if not len(key):
            return self.out(key.astype(np.uint64), node)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        name = np.add.reduceat(mixed(node + np.uint64(Slices.BASE)), starts)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, np.diff(np.append(starts, len(key)))).view(np.int64)),
                                           pa.array(node.view(np.int64))], ["key", "node"])


def shared_keys(batches):
    """From packed rows sorted by (bucket, probe) the (key, node) rows of keys
    that an indexed line shares with another line."""
    bucket = None
    for b in batches:
        for number, probe, entries in zip(*[c.to_pylist() for c in b.columns]):
            if bucket is None or bucket.number != number:
                if bucket is not None:
                    yield bucket.close()
                bucket = Bucket(number)
            yield from bucket.take(entries, bool(probe))
    if bucket is not None:
        yield bucket.close()


def _common(x, y) -> int:
    """Length of the common beginning of two strings or lists."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
    return low


def pair_within(x, y, edits: int) -> bool:
    """Whether two strings or lists are within ``edits`` of each other: the common ends
    are cut off, which keeps the distance, and a band of 2 * edits + 1
    diagonals, one integer per error count, moves along the rest."""
    if abs(len(x) - len(y)) > edits:
        return False
    a = _common(x, y)
    x, y = x[a:], y[a:]
    b = _common(x[::-1], y[::-1])
    x, y = x[:len(x) - b], y[:len(y) - b]
    full = (1 << (2 * edits + 1)) - 1
    spots: dict = {}
    for i, c in enumerate(x):
        spots[c] = spots.get(c, 0) | 1 << (i + edits)
    # state[e] bit k: prefix of y matched to the prefix of x at diagonal k - edits with <= e errors
    state = [sum(1 << k for k in range(edits, edits + e + 1)) for e in range(edits + 1)]
    for j, c in enumerate(y):
        same, low, last = spots.get(c, 0) >> j, 0, 0
        for e, s in enumerate(state):
            # both advance; substitute or y advances alone; x advances alone
            low = ((s & same) | last | last >> 1 | low << 1) & full if e else s & same & full
            last, state[e] = s, low
        if not low:
            return False
    return bool(state[edits] >> (len(x) - len(y) + edits) & 1)


def within(x: np.ndarray, ys: np.ndarray, edits: int) -> np.ndarray:
    """Whether each row of ``ys`` (padded with -1) is within ``edits`` of ``x``
    by a band of 2 * edits + 1 diagonals, held in the bits of one integer per
    row and error count and moved along all rows at once."""
    lens = (ys >= 0).sum(1)
    n, width = len(x), 2 * edits + 1
    full = (1 << width) - 1
    pad = np.full(edits, -2, dtype=x.dtype)
    wide = np.concatenate([pad, x, np.full(max(ys.shape[1] - n, 0) + edits + 1, -2, dtype=x.dtype)])
    # state[e] bit k: prefix of y matched to the prefix of x at diagonal k - edits with <= e errors
    state = [np.full(len(ys), sum(1 << k for k in range(edits, min(edits + e, 2 * edits) + 1)), dtype=np.int64)
             for e in range(edits + 1)]
    ok = np.zeros(len(ys), dtype=bool)

    def finish(j):
        d = n - j + edits
        if 0 <= d < width:
            ok[lens == j] |= ((state[edits][lens == j] >> d) & 1).astype(bool)

    finish(0)
    for j in range(ys.shape[1]):
        col = ys[:, j]
        same = np.zeros(len(ys), dtype=np.int64)
        for k in range(width):
            at = j + k  # x position j + (k - edits), shifted by the padding
            if edits <= at < n + edits:
                same |= (wide[at] == col).astype(np.int64) << k
        fresh = []
        for e in range(edits + 1):
            s = state[e] & same  # both advance: the diagonal stays
            if e:
                s |= state[e - 1]  # substitute
                s |= state[e - 1] >> 1  # y advances alone: one diagonal down
                s |= (fresh[e - 1] << 1) & full  # x advances alone: one diagonal up
            fresh.append(s)
        state = fresh
        finish(j + 1)
    return ok


def near_by_edits(lines: list[str], edits: int, few: int = 16):
    """``near`` of a block: pair by pair where there are few lines to compare,
    else along all of them at once after a filter on letter counts."""
    if len(lines) <= few:
        return lambda u, rest: np.fromiter((pair_within(lines[u], lines[i], edits) for i in rest), bool, len(rest))
    order = [np.frombuffer(s.encode("utf-32-le", "replace"), dtype="<i4") for s in lines]
    lens = np.array([len(s) for s in lines])
    # letter counts by bucket, cut at 60: an edit moves their sum of differences by at most 2
    bags = np.zeros((32, len(lines)), dtype=np.int8)
    for i, c in enumerate(order):
        bags[:, i] = np.minimum(np.bincount(c & 31, minlength=32), 60)

    def near(u: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), dtype=bool)
        close = (np.abs(bags - bags[:, u:u + 1]).sum(0, dtype=np.int16) <= 2 * edits) & (np.abs(lens - lens[u]) <= edits)
        left = np.flatnonzero(close[rest])
        if len(left) <= few:
            hit[left] = [pair_within(lines[u], lines[i], edits) for i in rest[left]]
            return hit
        for part in np.array_split(left, max(1, len(left) // 1024)):
            if len(part):
                ys = np.full((len(part), lens[rest[part]].max()), -1, dtype=np.int32)
                for r, i in enumerate(rest[part]):
                    ys[r, :lens[i]] = order[i]
                hit[part] = within(order[u], ys, edits)
        return hit

    return near


def near_by_words(lines: list[str], few: int = 16):
    """``near`` of a block by word edits, as ``near_by_edits`` does it by
    characters; words are numbered."""
    ids: dict[str, int] = {}
    order = [[ids.setdefault(w, len(ids)) for w in s.split(" ")] for s in lines]
    lens = np.array([len(s) for s in order])
    allowed = word_edits(lens)
    arrays = [np.array(s, dtype=np.int32) for s in order] if len(lines) > few else []
    bags = np.array([np.bincount(a & 63, minlength=64) for a in arrays])

    def near(u: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), dtype=bool)
        edits = np.minimum(allowed[rest], allowed[u])
        left = np.flatnonzero((edits > 0) & (np.abs(lens[rest] - lens[u]) <= edits))
        if len(arrays) and len(left):
            left = left[np.abs(bags[rest[left]] - bags[u]).sum(1) <= 2 * edits[left]]
        for e in np.unique(edits[left]):
            same = left[edits[left] == e]
            if len(same) <= few or e > 30:  # 2 * e + 1 diagonals have to fit in 63 bits
                hit[same] = [pair_within(order[u], order[i], int(e)) for i in rest[same]]
                continue
            for part in np.array_split(same, max(1, len(same) // 1024)):
                ys = np.full((len(part), lens[rest[part]].max()), -1, dtype=np.int32)
                for r, i in enumerate(rest[part]):
                    ys[r, :lens[i]] = order[i]
                hit[part] = within(arrays[u], ys, int(e))
        return hit

    return near


def near_lines(lines: list[str], edits: int):
    """``near`` of a block: by characters or by words."""
    chars, by_words = near_by_edits(lines, edits), near_by_words(lines)

    def near(u: int, rest: np.ndarray) -> np.ndarray:
        hit = by_words(u, rest)
        hit[~hit] = chars(u, rest[~hit])
        return hit

    return near


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
            .where((F.length("line") >= min_chars) & F.col("line").rlike(r"\S"))
            .withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")))


def near_classes(lines: DataFrame, edits: int) -> DataFrame:
    """(h, h2, component) of the lines that are linked to a different one.
    Should two lines have the same 64-bit hash ``h``, the one of the least ``h2``
    is compared and the other keeps its exact copies alone."""
    spark, low = lines.sparkSession, (1 << 63) - 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = lines.select("h", "line").mapInArrow(_packed(edits, 1 << (4 * parts - 1).bit_length()), "bucket long, probe tinyint, entries binary")
    met = staged(keys.repartition(parts, "bucket").sortWithinPartitions("bucket", "probe").mapInArrow(shared_keys, "key long, node long")
                 .distinct(), "met-lines")
    nodes = met.select("node").distinct()
    texts = staged(lines.withColumn("node", F.col("h").bitwiseAND(F.lit(low))).join(bounded_broadcast(nodes), "node", "left_semi")
                   .groupBy("node").agg(F.min(F.struct("h2", "h", "line")).alias("t")).select("node", "t.*"), "line-texts")
    rows = staged(met.join(texts.select("node", "line"), "node"), "line-blocks")
    drop_staged(met)
    comp = components(link_blocks(rows, "line", lambda v: near_lines(v, edits)))
    out = staged(comp.join(texts.select("node", "h", "h2"), "node").select("h", "h2", "component"), "near-classes")
    drop_staged(rows)
    drop_staged(texts)
    return out


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2,
                min_chars: int = 30, copy_chars: int | None = None) -> DataFrame:
    """(id, text_hash, pos, group, first_id, first_pos, kept) for every line that has a copy or a line within
    ``edits`` or its word edits of it; ``kept`` marks the first line of its group."""
    lines = _lines(docs, id_col, text_col, min_chars if copy_chars is None else min(copy_chars, min_chars))
    classes = lines.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "pos")).alias("first"))
    near = near_classes(lines.where(F.length("line") >= min_chars), edits)
    group = classes.join(near, ["h", "h2"], "left").where("n > 1 or component is not null")
    group = staged(group.select("h", "h2", "first", F.coalesce("component", "h").alias("group"),
                                F.when(F.col("component").isNull(), F.col("h2")).alias("own")), "line-groups")
    first = group.groupBy(F.col("group").alias("g"), F.col("own").alias("o")).agg(F.min("first").alias("least"))
    group = (group.join(first, (F.col("group") == F.col("g")) & F.col("own").eqNullSafe(F.col("o")))
             .select("h", "h2", "group", F.col("least").alias("first")))
    return (lines.drop("line").join(group, ["h", "h2"])
            .select("id", "text_hash", "pos", "group", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"),
                    F.col("first").eqNullSafe(F.struct("id", "text_hash", "pos")).alias("kept")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2,
                min_chars: int = 30, copy_chars: int | None = None) -> DataFrame:
    """``docs`` with later copies and near copies of lines removed from the
    text; every row stays."""
    gone = (line_groups(docs, id_col, text_col, edits, min_chars, copy_chars).where("not kept")
            .groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("pos").alias("__gone")))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left")
    kept = F.array_join(F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(
        x.alias("x"), F.array_contains(F.col("__gone"), i).alias("out"))), lambda s: ~s["out"])["x"], "\n")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)) \
        .drop("__id", "__hash", "__gone")
