"""Vector search, ranked lexical search and integer k-means against brute
force, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revisit.llm.queries import QUERIES, SQL

from ..conftest import MEDIUM, SMALL

VECTORS = "vec_id long, embedding array<float>, row string, shard string, v string, score string, near string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], VECTORS)


def cloud(n, dim=8, seed=0, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim))
    return (centres[r.integers(0, 5, n)] + spread * r.standard_normal((n, dim))).astype("f4")


def odd_rows(dim):
    """Rows that take no part."""
    return [(1000, None), (1100, []), (1200, [0.0] * dim), (1300, [None] * dim), (1400, [1.0] * (dim + 1)),
            (1500, [float("nan")] + [1.0] * (dim - 1)), (1600, [float("inf")] + [1.0] * (dim - 1))]


# ---------------------------------------------------------------- multi-index hashing


def test_probe_retrieves_every_code_within_the_radius():
    """The pigeonhole promise, at all radii, against plain Hamming distances."""
    from revisit.llm.multi_index import Shard, hamming
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 16, (40, 4)).astype("<u2")
    codes = np.concatenate([base, base ^ (1 << r.integers(0, 16, base.shape)).astype("<u2"), base[:5], r.integers(0, 1 << 16, (3000, 4)).astype("<u2")])
    shard = Shard(codes)
    for q in base[:10]:
        for radius in (0, 1, 3, 4, 9, 17, 30, 64):
            for opening in (0, 2):
                found = []
                shard.search(q, radius, lambda rows: (found.extend(rows.tolist()), radius)[1], opening)
                assert sorted(found) == np.flatnonzero(hamming(codes, q) <= radius).tolist()
                assert len(found) == len(set(found))


def nearest_by_hand(rows, is_query, k):
    """{query position: [(score, id)]} over rows that take part."""
    dims = Counter(len(v) for _, v in rows if ok(v))
    dim = min(dims, key=lambda d: (-dims[d], d)) if dims else 0
    use = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if ok(v) and len(v) == dim]
    out = []
    for at, (i, q) in enumerate(use):
        if is_query(i):
            near = sorted((math.sqrt(np.square(v - q).sum()), j is None, j if j is not None else 0) for b, (j, v) in enumerate(use) if b != at)
            out.append((i, near[:k]))
    return out


def ok(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_neighbours_recall_and_contract(spark):
    from revisit.llm.multi_index import search
    points = [(int(i), v.tolist()) for i, v in enumerate(cloud(900))]
    rows = points + [points[0], points[0], (None, points[3][1])] + odd_rows(8)
    got = {}
    for r in search(vectors(spark, rows), F.col("vec_id") % 100 == 0, sample_rows=200, shard_rows=(100, 300), block_queries=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = nearest_by_hand(rows, lambda i: i is not None and i % 100 == 0, 10)
    assert set(got) == {i for i, _ in want} and len(got[0]) == 30  # row 0 stands there three times
    assert [x[0] for x in sorted(got[100])] == list(range(1, 11))
    hits = total = 0
    for i, near in want:
        if i:  # one row of its own
            mine = sorted(got[i])
            hits += len({x[2] for x in mine} & {n[2] if not n[1] else None for n in near})
            total += len(near)
            assert all(a <= b for a, b in zip([x[1] for x in mine], [x[1] for x in mine][1:]))
            exact = {j: s for s, null, j in nearest_by_hand(rows, lambda x: x == i, 10 ** 6)[0][1] if not null}
            assert all(abs(exact[x[2]] - x[1]) < 1e-12 for x in mine if x[2] is not None)
    assert hits >= 0.9 * total
    zero = sorted(got[0])
    assert [x[2] for x in zero if x[1] == 0][:2] == [0, 0]  # its own copies are candidates


def test_neighbours_of_few_or_no_rows(spark):
    from revisit.llm.multi_index import search
    few = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = [tuple(r) for r in search(vectors(spark, few), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    root = math.sqrt(2)
    assert got == [(0, 1, 5, 0.0), (0, 2, 7, 0.0), (0, 3, 100, root), (100, 1, 0, root), (100, 2, 5, root), (100, 3, 7, root)]
    assert search(vectors(spark, few[:1]), F.col("vec_id") % 100 == 0).count() == 0
    assert search(vectors(spark, odd_rows(4)[:4]), F.lit(True)).count() == 0
    assert search(vectors(spark, []), F.lit(True)).count() == 0
    assert search(vectors(spark, few), F.lit(False)).count() == 0


def test_neighbours_query_recall(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{MEDIUM}/embeddings.parquet'").fetchall()
    want = {i: {n[2] for n in near} for i, near in nearest_by_hand(table, lambda i: i % 100 == 0, 10)}
    got = {}
    for r in QUERIES["op11_multi_index"](spark, MEDIUM).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys()
    assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * sum(map(len, want.values()))


# ---------------------------------------------------------------- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, rank string, term string, part string, length string"


def term_list(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def ranked_by_hand(docs, items, k):
    counts = [(i, Counter(term_list(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term_list(t))
    out = {}
    for i, own in asked.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, d is not None, d))
        out[i] = [(r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return {i: x for i, x in out.items() if x}


def corpus(n=300):
    r = np.random.default_rng(5)
    word = lambda: f"w{int(r.zipf(1.4)) % 500}"
    docs = [(i, " ".join(word() for _ in range(int(r.integers(1, 60))))) for i in range(n)]
    docs += [(900, docs[3][1]), (901, docs[3][1]), (3, docs[3][1]), (902, None), (903, ""), (904, "..."), (None, "w1 w2 w7"),
             (905, "W1-w2_É é \x7f w3[w4]"), (906, "w9 " * 30000), (907, " ".join(f"w{i}" for i in range(500)))]
    items = [(i, " ".join(word() for _ in range(int(r.integers(1, 25))))) for i in range(20)]
    return docs, items + [(20, None), (21, ""), (22, "w1"), (23, "é É w3"), (24, "absent"), (22, "w5 w1"), (None, "w2 w6")]


@pytest.mark.parametrize("max_terms, k", [(500_000, 50), (40, 5)])
def test_ranking_equals_brute_force(spark, max_terms, k):
    from revisit.llm.lemp_rank import search
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, *["x"] * 5) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, rank string")
    got = {}
    for r in search(df, asked, k, max_terms=max_terms).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == ranked_by_hand(docs, items, k)
    assert search(df.limit(0), asked, k).count() == 0 and search(df, asked.limit(0), k).count() == 0
    assert search(df, asked.where("item_id in (20, 21)"), k).count() == 0


def test_bounds_prune_and_lose_nothing():
    """Buckets are skipped, vectors bounded away, and the best are those of a
    ranker that bounds nothing."""
    from revisit.llm.lemp_rank import Ranker
    r = np.random.default_rng(8)
    weight = r.integers(1, 5000, 60)
    items = [np.sort(r.choice(60, int(r.integers(1, 12)), replace=False)) for _ in range(15)]
    docs = []
    for d in range(2000):
        t = np.sort(r.choice(60, int(r.integers(1, 20)), replace=False))
        docs.append((d, t, weight[t] * r.integers(1, 100_000 // (1 + d % 50), len(t))))
    docs.sort(key=lambda x: -float(np.square(x[2].astype(float)).sum()))
    rank = Ranker(items, weight, 10, np.zeros(15, dtype=np.int64), 2)
    for at in range(0, 2000, 100):
        part = docs[at:at + 100]
        rank.bucket(np.array([x[0] for x in part]), np.array([np.square(x[2].astype(float)).sum() for x in part]),
                    np.repeat(np.arange(len(part)), [len(x[1]) for x in part]), np.concatenate([x[1] for x in part]),
                    np.concatenate([x[2] for x in part]))
    skipped, bounded, scored = rank.counts
    assert skipped > 15 and bounded > 1000 and scored < 15 * 2000 - bounded + 1
    for i, own in enumerate(items):
        want = sorted((-int(v[np.isin(t, own)].sum()), d) for d, t, v in docs if np.isin(t, own).any())[:10]
        assert list(zip((-rank.score[i]).tolist(), rank.doc[i].tolist())) == want


# ---------------------------------------------------------------- integer k-means


def means_by_hand(rows, dim, k, rounds, scale=64):
    use = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim
           and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(use, key=key)[:k]]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((sq(v, c), n) for n, c in enumerate(centres)) for _, v in use]
    for _ in range(rounds):
        got = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(use, got) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, d) for (i, _), (d, c) in zip(use, assign())], centres


@pytest.mark.parametrize("n, k, rounds", [(400, 16, 3), (400, 16, 8), (60, 5, 4), (9, 16, 3), (1, 16, 2)])
def test_means_equal_brute_force(spark, n, k, rounds):
    from revisit.llm.shallot import shallot_means, with_inertia
    points = [(int(i), v.tolist()) for i, v in enumerate(cloud(n, 6, 2, 0.6))]
    rows = points + points[:3] * 2 + [(None, points[0][1]), (77, [0.0] * 6)] + [r for r in odd_rows(6) if r[0] != 1200]
    out, centres = shallot_means(vectors(spark, rows), dim=6, k=k, rounds=rounds)
    want, want_centres = means_by_hand(rows, 6, k, rounds)
    order = lambda x: sorted(x, key=repr)
    assert centres == want_centres
    assert order([tuple(r) for r in out.collect()]) == order(want)
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in with_inertia(out, centres).collect():
        assert (r["cluster_inertia"], r["inertia"]) == (per[r["cluster"]], sum(per.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_means_of_nothing_and_bounds(spark):
    from revisit.llm.shallot import nearest, shallot_means, with_inertia
    for rows in ([], odd_rows(6)[:2]):
        assert with_inertia(*shallot_means(vectors(spark, rows), dim=6)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        shallot_means(vectors(spark, [(1, [1e30] * 6)]), dim=6)
    r = np.random.default_rng(1)
    c = r.integers(-50, 50, (16, 6))
    c[5] = c[2]  # a tie between centroids
    x = np.concatenate([r.integers(-60, 60, (500, 6)), c])
    want = np.square(x[:, None] - c[None]).sum(2)
    for start in ((0, 1), (5, 2), (3, 15)):
        near, second, d1, d2 = nearest(x, c, np.full(len(x), start[0]), np.full(len(x), start[1]))
        assert (near == want.argmin(1)).all() and (d1 == want.min(1)).all()
        assert (d2 == np.sort(want, axis=1)[:, 1]).all() and (np.take_along_axis(want, second[:, None], 1)[:, 0] == d2).all()


@pytest.mark.parametrize("key", ["op12_lemp_rank", "op13_shallot_means"])
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[key](spark, SMALL), con.sql(SQL[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())
