"""Skew-safe ordered scans: row numbers, next-row values and running sums.

``Window.partitionBy(entity)`` sends every row of an entity to one task.  If a
single entity (or a label with two values, or a global order) holds a third of
the data, that task holds a third of the data.  ``ordered_scan`` computes the
same results in one way at every size, as a prefix scan over range chunks:

1. ``repartitionByRange(keys, order)`` cuts the data into contiguous, roughly
   equal chunks of the total order; a hot key spans several chunks.
2. Window functions run inside each (key, chunk).
3. Only the first and the last key of a chunk can go on in another one.  Their
   counts, first values and totals, at most two rows a chunk, give each of them
   its offset and the first row that follows; those rows are broadcast and
   added to the local results.

No row count is taken first, no task holds a group, and what is broadcast is
bounded by twice the number of chunks.

The ends of the chunks and the windows are two plan branches over the chunked
data.  Each branch would run its own range exchange, and Spark samples range
bounds with a seed taken from the RDD id, so the two could cut different chunks.
The chunked data is therefore persisted once (memory, spilling to disk) and both
branches read that copy; after an executor loss the lost blocks are recomputed
from the same shuffle dependency, i.e. with the same bounds.
The order passed in must be total within a key (end it with a unique id) for
the result to be deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.session import keep

_CHUNK = "_chunk"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence,
                 rn: str | None = None,
                 leads: Sequence[tuple[str, str]] = (),
                 has_next: str | None = None,
                 running: Sequence[tuple[str, str]] = (),
                 chunks: int | None = None) -> DataFrame:
    """Add window results computed over ``keys`` ordered by ``order``.

    rn        name for the 1-based position within the key (long)
    leads     (column, output) pairs: value of ``column`` on the next row
    has_next  name for a boolean: a next row exists within the key
    running   (column, output) pairs: inclusive running sum of ``column``
    chunks    number of range chunks, and of the tasks of the windows, else the
              session's shuffle partitions
    """
    keys = list(keys)
    order = [_as_col(c) for c in order]
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = keep(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(
        _CHUNK, F.spark_partition_id()))

    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = ranged.repartition(chunks, *keys, _CHUNK) if chunks else ranged
    local = windowed.withColumn("_lrn", F.row_number().over(w))
    for c, _ in leads:
        local = local.withColumn(f"_lead_{c}", F.lead(c).over(w))
    for c, _ in running:
        local = local.withColumn(f"_run_{c}", F.sum(c).over(upto))
    if leads or has_next:
        local = local.withColumn("_at_end", F.lead(F.lit(1)).over(w).isNull())

    # the keys at the two ends of each chunk, and what they hold there
    same = lambda a, b: [a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys] + [a[_CHUNK] == b["_k_chunk"]]
    named = [F.col(f"_key.{k}").alias(f"_k_{k}") for k in keys]
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    ends = ranged.groupBy(F.col(_CHUNK).alias("_k_chunk")).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    ends = ends.select("_k_chunk", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_key")).select("_k_chunk", *named)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    aggs += [F.min_by(c, "_lrn").alias(f"_first_{c}") for c, _ in leads]
    aggs += [F.sum(c).alias(f"_tot_{c}") for c, _ in running]
    held = local.join(F.broadcast(ends), same(local, ends), "left_semi").groupBy(*keys, _CHUNK).agg(*aggs)
    sw = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    stats = held.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(_CHUNK).alias("_k_chunk"),
        F.sum("_cnt").over(before).alias("_off"),
        F.lead(_CHUNK).over(sw).alias("_next_chunk"),
        *[F.lead(f"_first_{c}").over(sw).alias(f"_nfirst_{c}") for c, _ in leads],
        *[F.sum(f"_tot_{c}").over(before).alias(f"_roff_{c}") for c, _ in running],
    )
    j = local.join(F.broadcast(stats), same(local, stats), "left")

    out = [F.col(c) for c in df.columns]
    if rn:
        out.append((F.col("_lrn") + F.coalesce("_off", F.lit(0))).cast("long").alias(rn))
    for c, name in leads:
        out.append(F.when(F.col("_at_end"), F.col(f"_nfirst_{c}")).otherwise(F.col(f"_lead_{c}")).alias(name))
    if has_next:
        out.append((~F.col("_at_end") | F.col("_next_chunk").isNotNull()).alias(has_next))
    for c, name in running:
        out.append((F.col(f"_run_{c}") + F.coalesce(f"_roff_{c}", F.lit(0))).alias(name))
    return j.select(*out)
