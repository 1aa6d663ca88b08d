"""Benchmark decontamination by a generalised suffix automaton of test items.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters.  The automaton of all items streams over a document's
words and tracks the longest matching length.  A word is hit if it lies in an
occurrence of an item window: ``window`` consecutive item words, or a whole
item that is shorter.

Null and empty texts have no words and no hits; items without words have no
window; an empty benchmark hits nothing.  Repeated rows get equal results and
extra columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: A-Z to a-z, word characters kept, everything else to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SPAN = re.compile(rb"[^ ]+")

RESULT = ("n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>")


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(FOLD)


class Automaton:
    """Suffix automaton over the words of several items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        texts = [(i, [self.word.setdefault(w, len(self.word)) for w in fold(t).split()]) for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        pairs = set()
        for _, w in texts:
            last = 0
            for c in w:
                last = self._extend(last, c)
            pairs.update(zip(w, w[1:]))
        self.shortest = min([window] + [len(w) for _, w in texts])
        #: items that hold each state's strings
        self.items: list[set[int]] = [set() for _ in self.next]
        for i, w in texts:
            s = 0
            for c in w:
                s = v = self.next[s][c]
                while v > 0 and i not in self.items[v]:
                    self.items[v].add(i)
                    v = self.link[v]
            if len(w) < window:
                self.short[s].append((len(w), i))
        self.pairs = np.array(sorted(a * len(self.word) + b for a, b in pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _state(self, nxt, length, link) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans in word positions, and the items found."""
        get, n = self.word.get, len(self.word)
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        spans: list[list[int]] = []
        found: set[int] = set()
        for a, b in self._regions(ids, n):
            s = length = 0
            for i in range(a, b):
                c = int(ids[i])
                while s and c not in self.next[s]:
                    s = self.link[s]
                    length = self.length[s]
                if c not in self.next[s]:
                    continue
                s, length = self.next[s][c], length + 1
                v, reach = s, 0
                while v > 0:
                    top = min(length, self.length[v])
                    for k, item in self.short.get(v, ()):
                        if k <= top:
                            reach = max(reach, k)
                            found.add(item)
                    if self.length[self.link[v]] < self.window <= top:
                        found |= self.items[v]
                        reach = self.window
                    v = self.link[v]
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found

    def _regions(self, ids: np.ndarray, n: int):
        """Runs of known words and known word pairs that are long enough to
        hold a window; every match of that length lies inside one."""
        if not n or not len(ids):
            return
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        code = ids[:-1] * n + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        joined &= (self.pairs[at] == code) if len(self.pairs) else False
        cut = np.flatnonzero(~joined) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(ids)]):
            if b - a >= self.shortest and ids[a] >= 0:
                yield int(a), int(b)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, shard_bytes: int = 32 << 20, out: str = "leak") -> DataFrame:
    """``docs`` plus a struct column ``out``: n_words, n_hit, items (ids with
    occurring windows) and spans (hit character ranges of the text, end
    exclusive, merged).  Every row is judged on its whole text.

    One automaton holds at most about ``shard_bytes`` of item text, and is the
    only thing broadcast.  A larger benchmark takes one pass per shard, each
    over the documents and the spans found so far.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    judged = docs
    for shard in range(shards):
        part = benchmark.where(F.coalesce(F.pmod(F.xxhash64(item_id, item_text), F.lit(shards)), F.lit(0)) == shard)
        items = [(r[0], r[1]) for r in part.select(item_id, item_text).collect()]
        shared = spark.sparkContext.broadcast(Automaton(items, window))
        # marked so that a filter on the result does not repeat the call
        leak = _judge(shared).asNondeterministic()(F.col(text_col))
        judged = judged.withColumn(out, leak if shard == 0 else _merge(F.col(out), leak, F.col(text_col)))
    return judged


def _judge(shared):
    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            flat = fold(text)
            words = flat.split()
            spans, found = shared.value.match(words)
            rows.append((len(words), sum(b - a for a, b in spans), sorted(x for x in found if x is not None),
                         _characters(text, flat, spans)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])
    return judge


def _characters(text, flat: bytes, spans) -> list[dict]:
    """Word spans as character spans of the text."""
    if not spans:
        return []
    at = [m.span() for m in SPAN.finditer(flat)]
    raw = text.encode("utf-8", "replace")
    out, pos, chars = [], 0, 0
    for a, b in spans:
        ends = []
        for byte in (at[a][0], at[b - 1][1]):
            chars += len(raw[pos:byte].decode("utf-8"))
            pos = byte
            ends.append(chars)
        out.append({"start": ends[0], "end": ends[1]})
    return out


def _merge(old, new, text):
    """Union of two shards' spans, items and hit words."""
    @F.pandas_udf(RESULT)
    def union(a: pd.DataFrame, b: pd.DataFrame, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, t in zip(a.itertuples(index=False), b.itertuples(index=False), texts):
            spans = []
            for s, e in sorted((s["start"], s["end"]) for s in [*x.spans, *y.spans]):
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = max(e, spans[-1]["end"])
                else:
                    spans.append({"start": s, "end": e})
            hit = sum(len(fold(t[s["start"]:s["end"]]).split()) for s in spans)
            rows.append((x.n_words, hit, sorted({*x.items, *y.items}), spans))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])
    return union(old, new, text)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the character ranges of ``spans`` (sorted, disjoint);
    null and empty spans leave it as it is."""
    n = F.size(spans)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.get(spans, i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(text, start(i) + 1, end(i) - start(i)))
    return F.when(n > 0, F.array_join(pieces, "")).otherwise(text)
