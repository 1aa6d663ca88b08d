"""Quality rules: base text statistics, and a log-likelihood ratio of hashed
word n-grams between trusted-target and raw-corpus multinomials.

Every text is counted, so what is gathered grows with the corpus up to one row
a bucket.  A bucket resolves n-grams above a share of 1 / ``BUCKETS`` of the
corpus; at sf 0.1 (2.46 M different n-grams) the verdicts agree with those of
unhashed n-grams on 99.99 % of the documents.

Only DataFrame functions run here.  Null and empty texts have no words, score
0 and fail the base rule.  Rows are judged one by one, so repeated rows get
equal results; extra columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from revisit.llm.common import let

#: Word and punctuation runs, the units of the hashed n-grams.
#: (ASCII is named as well: it is looked up in a table, before the classes.)
TOKEN = r"[a-zA-Z0-9\p{L}\p{N}]+|[^a-zA-Z0-9\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Size of the hash space.
BUCKETS = 1 << 16
#: Least mean log ratio, in nats per n-gram, of a document that is kept.
THRESHOLD = -0.5
#: Bits of the map of trusted ids, and buckets of weights that come to the driver as one row.
MAP_BITS, ROW_BUCKETS = 1 << 20, 1 << 11
#: Upper half of a 64-bit hash; the lower half holds a position.
HALF = -1 << 32


def _unigrams(text: Column) -> Column:
    """64-bit hashes of a text's tokens; a token's characters are hashed once."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def _bigrams(h: Column) -> Column:
    """Hashes of the bigrams, from the hashes of their tokens."""
    rest = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, rest), F.slice(h, 2, rest), lambda a, b: F.xxhash64(a, b))


def _grams(text: Column) -> Column:
    """Hashes of a text's token unigrams, then of its bigrams."""
    return let(_unigrams(text), lambda h: F.concat(h, _bigrams(h)))


def _maybe_trusted(ids: DataFrame) -> Column:
    """Whether ``__doc`` can be among the ids ``__id``: a map of ``MAP_BITS``
    hash bits, a size that no input changes, sent along as a literal."""
    spot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(MAP_BITS))
    words = (ids.select(F.shiftright(spot("__id"), 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__id), {MAP_BITS}) & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    bits = ["0"] * (MAP_BITS >> 6)
    for r in words:
        bits[r["w"]] = str(r["b"])
    table = F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")
    return F.element_at(table, F.shiftright(spot("__doc"), 6).cast("int") + 1).bitwiseAND(
        F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__doc), {MAP_BITS}) & 63 as int))")) != 0


def count_grams(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(g, raw, good): occurrences of each bucket in all texts, and in those
    whose id is in ``trusted``.  Only rows whose id may be trusted are joined,
    by a merge at every size, so no other text is shuffled; each text is
    tokenized once."""
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    maybe = F.coalesce(_maybe_trusted(ids), F.lit(False))
    asked = (rows.where(maybe).join(ids.withColumn("__good", F.lit(1)).hint("merge"), F.col("__doc") == F.col("__id"), "left")
             .select("__text", F.coalesce("__good", F.lit(0)).alias("good")))
    both = rows.where(~maybe).select("__text", F.lit(0).alias("good")).union(asked)
    return (both.select(F.explode(_grams(F.col("__text"))).alias("g"), "good")
            .groupBy(F.col("g").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("g")).agg(F.count("*").alias("raw"), F.sum("good").alias("good")))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              buckets: int = BUCKETS, smoothing: float = 1.0) -> list[float]:
    """log p_target(bucket) - log p_raw(bucket) for each bucket, to 6 decimals;
    ``buckets`` is a power of two.

    The counts are combined map-side; ``buckets`` numbers (a parameter, not the
    data) come to the driver."""
    counts = count_grams(docs, trusted, id_col, text_col, buckets)
    packed = (counts.groupBy(F.floor(F.col("g") / ROW_BUCKETS).alias("at"))
              .agg(F.collect_list(F.concat_ws(" ", "g", "raw", "good")).alias("c"))
              .select(F.array_join("c", ",").alias("c")).collect())
    n = [[smoothing] * buckets, [smoothing] * buckets]
    for r in packed:
        for x in r["c"].split(","):
            g, raw, good = map(int, x.split(" "))
            n[0][g] += raw
            n[1][g] += good
    total = [sum(x) for x in n]
    return [round(math.log(n[1][i] / total[1]) - math.log(n[0][i] / total[0]), 6) for i in range(buckets)]


def llr_score(text: Column, weights: list[float]) -> Column:
    """Mean log ratio per n-gram; 0 for a text without tokens.  Unigrams are
    summed first, then bigrams, without one array of both."""
    table, mask = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>"), F.lit(len(weights) - 1).cast("long")

    def mean(h: Column, w: Column) -> Column:
        plus = lambda acc, g: acc + w[g.bitwiseAND(mask)]
        total = F.aggregate(_bigrams(h), F.aggregate(h, F.lit(0.0), plus), plus)
        return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(F.lit(0.0))

    return let(_unigrams(F.coalesce(text, F.lit(""))), lambda h: let(table, lambda w: mean(h, w)))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))

    def repeats(w: Column) -> Column:
        """Windows meet by a 64-bit hash; most texts have no equal pair.  The
        others sort numbers of half the hash and the position; only windows
        whose half meets an unequal one sort their (hash, position) pairs."""
        n = F.greatest(F.size(w) - 2, F.lit(0))
        wins = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
            F.slice(h, 1, n), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2))))

        def spread(h: Column) -> Column:
            packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(HALF)).bitwiseOR(i.cast("long"))))
            meet = let(packed, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(
                a.bitwiseXOR(b).bitwiseAND(F.lit(HALF)) == 0, F.array(a.bitwiseAND(F.lit(~HALF)), b.bitwiseAND(F.lit(~HALF))))))
            return let(F.filter(meet, lambda x: x.isNotNull()), lambda m: let(F.array_distinct(F.flatten(m)), lambda at: F.when(
                F.forall(m, lambda x: h[x[0]] == h[x[1]]), covered(F.sort_array(at))).otherwise(let(again(h, at), covered))))

        def again(h: Column, at: Column) -> Column:
            """Those of the positions whose whole hash comes twice, ascending."""
            pairs = F.sort_array(F.transform(at, lambda i: F.struct(h[i].alias("g"), i.alias("i"))))
            equal = let(pairs, lambda s: F.filter(s, lambda x, i: (
                F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) |
                F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))))
            return F.sort_array(F.transform(equal, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            """Words in the windows of three at these ascending positions."""
            steps = let(at, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

        return let(wins, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(spread(h)))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))
    return let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeats(w).cast("long").alias("n_repeat_words")))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 50, max_repeat_percent: int = 50, threshold: float = THRESHOLD,
                  buckets: int = BUCKETS, weights: list[float] | None = None, out: str = "rules") -> DataFrame:
    """``docs`` plus a struct column ``out`` with the base counts,
    base_failed, llr (nats per n-gram) and kept (llr >= threshold and not
    base_failed).  Every row is judged."""
    if weights is None:
        weights = fit_ratio(docs, trusted, id_col, text_col, buckets)
    base = base_counts(F.col(text_col))
    both = let(base, lambda b: let(llr_score(F.col(text_col), weights), lambda s: F.struct(
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((b["n_words"] < min_words) | (100 * b["n_repeat_words"] > max_repeat_percent * b["n_words"])).alias("base_failed"),
        s.alias("llr"))))
    return docs.withColumn(out, let(both, lambda r: r.withField(
        "kept", ~r["base_failed"] & (r["llr"] >= threshold))))
