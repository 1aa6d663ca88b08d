"""Per-entity event journeys: ordering, next event, repeat entities, roll-ups.

Column names are parameters; the defaults are the hospital names used by the
cohort plan.  Every per-entity step is written so that one huge entity is split
over many tasks: ordered steps go through ``ordered_scan`` and counts are
partial (map-side) aggregates joined back on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.scalar import days_between
from revisit.operators.ordered import ordered_scan


def _order(order: Sequence[str]):
    # pandas sort_values puts missing values last
    return [F.col(c).asc_nulls_last() for c in order]


def sequence_events(df: DataFrame, entity: str, order: Sequence[str],
                    out: str = "SEQUENCE", chunks: int | None = None) -> DataFrame:
    """1-based position of each event within its entity by ``order`` (end the
    order with a unique id so ties are broken the same way every run)."""
    return ordered_scan(df, [entity], _order(order), rn=out, chunks=chunks)


def next_event_gap(df: DataFrame, entity: str = "SUBJECT_ID", event_id: str = "HADM_ID",
                   start: str = "ADMITTIME", end: str = "DISCHTIME",
                   order: Sequence[str] | None = None,
                   keep: Sequence[str] = (),
                   chunks: int | None = None) -> DataFrame:
    """Pair each event with the next one of the same entity and measure the
    days from this event's end to the next event's start.

    The last event of every entity is dropped (it has no next event); gaps may
    be negative.  Output: entity, event_id, CURR_<end>, NXT_<start>,
    DAYS_TO_READMISSION plus ``keep`` columns of the current event."""
    order = list(order or [start, event_id])
    needed = list(dict.fromkeys([entity, event_id, start, end, *order, *keep]))
    scanned = ordered_scan(df.select(*needed), [entity], _order(order), leads=[(start, "_next_start")],
                           has_next="_has_next", chunks=chunks)
    return scanned.where("_has_next").select(
        entity, event_id, *keep,
        F.col(end).alias(f"CURR_{end}"),
        F.col("_next_start").alias(f"NXT_{start}"),
        days_between(F.col(end), F.col("_next_start")).alias("DAYS_TO_READMISSION"),
    )


def next_event_selfjoin(df: DataFrame, entity: str = "SUBJECT_ID", event_id: str = "HADM_ID",
                        start: str = "ADMITTIME", end: str = "DISCHTIME",
                        seq: str = "SEQUENCE") -> DataFrame:
    """The same pairs as ``next_event_gap`` written as the equi self-join
    ``a.entity = b.entity AND a.seq = b.seq - 1`` on a sequenced table.  The
    composite key spreads a hot entity over many partitions."""
    a = df.select(entity, event_id, end, seq).alias("a")
    b = df.select(F.col(entity).alias("_e"), F.col(start).alias("_s"),
                  (F.col(seq) - 1).alias("_prev")).alias("b")
    j = a.join(b, (F.col(f"a.{entity}") == F.col("b._e")) & (F.col(f"a.{seq}") == F.col("b._prev")))
    return j.select(
        F.col(f"a.{entity}").alias(entity), F.col(f"a.{event_id}").alias(event_id),
        F.col(f"a.{end}").alias(f"CURR_{end}"), F.col("b._s").alias(f"NXT_{start}"),
        days_between(F.col(f"a.{end}"), F.col("b._s")).alias("DAYS_TO_READMISSION"),
    )


def entity_counts(df: DataFrame, entity: str, out: str = "READMISSION_COUNT") -> DataFrame:
    """Events per entity; null entities are left out (pandas groupby drops them)."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias(out))


def repeat_entities(df: DataFrame, entity: str, min_events: int = 2,
                    count_col: str | None = None) -> DataFrame:
    """Rows of entities with at least ``min_events`` events.

    The count is a partial aggregate (a hot entity is pre-counted on every map
    task); the join back is skew-split by AQE."""
    counts = entity_counts(df, entity, count_col or "_n").where(
        F.col(count_col or "_n") >= min_events)
    if count_col:
        return df.join(counts, entity, "inner")
    return df.join(counts.select(entity), entity, "left_semi")


def exact_sum(c, scale: int = 10):
    """Sum of doubles that does not depend on the order rows arrive in: each
    value is taken at ``scale`` decimals and added exactly, then turned back
    into a double.  (A plain double sum can end in different last bits on a
    different partitioning, which flips values sitting on a bin edge.)"""
    return F.sum(F.col(c).cast(f"decimal(38,{scale})")).cast("double")


def latest_with_total(df: DataFrame, key: str = "HADM_ID", record_id: str = "ICUSTAY_ID",
                      total: str = "LOS", keep: Sequence[str] | None = None) -> DataFrame:
    """Keep, per key, the row with the largest ``record_id`` and replace its
    ``total`` column with the group sum (all-missing sums are 0, like pandas).

    One partial aggregate: ``max_by`` picks the latest row's columns,
    ``exact_sum`` the total - no join back, and a hot key is reduced on every
    map task."""
    cols = [c for c in (keep or df.columns) if c not in (key, record_id, total)]
    agg = df.groupBy(key).agg(
        F.max(record_id).alias(record_id),
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(record_id)).alias("_latest"),
        F.coalesce(exact_sum(total), F.lit(0.0)).alias(total))
    return agg.select(key, *[F.col(f"_latest.{c}").alias(c) for c in cols], record_id, total)


def group_max_sum(df: DataFrame, key: str, max_col: str, sum_col: str) -> DataFrame:
    """Different aggregate per column: max of one, sum of another."""
    return df.groupBy(key).agg(F.max(max_col).alias(max_col), F.sum(sum_col).alias(sum_col))


def group_mean_fill(df: DataFrame, key: str, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Mean per key, missing values skipped, all-missing groups → ``fill``."""
    return df.groupBy(key).agg(*[F.coalesce(F.avg(c), F.lit(fill)).alias(c) for c in cols])


def filtered_group_count(df: DataFrame, where_col: str, values: Sequence, keys: Sequence[str],
                         out: str) -> DataFrame:
    """``SELECT count(1) AS out, keys FROM df WHERE where_col IN values GROUP BY keys``."""
    return (df.where(F.col(where_col).isin(list(values)))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias(out)))
