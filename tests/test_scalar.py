import datetime as dt
import math

import pytest

from revisit.functions import scalar as S


def one_col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_los_bin_edges(spark):
    vals = [0.59, 0.6, 0.61, 1.3, 1.31, 2.3, 2.31, None]
    got = [r[0] for r in one_col(spark, vals, "double").select(S.los_bin("x")).collect()]
    # exactly 0.6 falls through to the last bin, as in the source
    assert got == [0, 3, 1, 1, 2, 2, 3, 3]


def test_hour_band_edges(spark):
    got = [r[0] for r in one_col(spark, [0, 10, 11, 12, 13, 18, 19, 23, None], "int")
           .select(S.hour_band("x")).collect()]
    assert got == ["EarlyMorning", "EarlyMorning", "Morning", "Morning", "Noon", "Noon",
                   "Evening", "Evening", "Evening"]


def test_label_within(spark):
    got = [r[0] for r in one_col(spark, [-1.0, 30.0, 30.01, None], "double")
           .select(S.label_within("x", 30)).collect()]
    assert got == [1, 1, 0, 0]


def test_threshold_label(spark):
    got = [r[0] for r in one_col(spark, [0.49, 0.5, 0.9, None], "double")
           .select(S.threshold_label("x", 0.5)).collect()]
    assert got == [0, 1, 1, None]


def test_age_half_even_and_sign(spark):
    admit = dt.datetime(2000, 1, 1)
    rows = [(admit, admit - dt.timedelta(days=365 * 2 + 182.5)),   # 2.5 years → 2 (half to even)
            (admit, admit - dt.timedelta(days=365 * 3 + 182.5)),   # 3.5 → 4
            (admit, admit),                                        # 0
            (admit, admit + dt.timedelta(days=365 * 5))]           # negative → 5
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(S.age_years("a", "b")).collect()]
    assert got == [2, 4, 0, 5]


def test_ln0(spark):
    got = [r[0] for r in one_col(spark, [0, 1, 10], "int").select(S.ln0("x")).collect()]
    assert got[0] == -math.inf and got[1] == 0.0 and abs(got[2] - math.log(10)) < 1e-12


def test_julian_day_and_days_between(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1, 12), dt.datetime(2000, 1, 3, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(S.julian_day("a"), S.days_between("a", "b")).first()
    assert r[0] == pytest.approx(2451545.0)  # J2000.0
    assert r[1] == pytest.approx(1.5)


def test_parse_ts_falls_back_to_iso(spark):
    df = one_col(spark, ["2101/10/20", "2101-10-20 19:08:00", "junk"], "string")
    got = [r[0] for r in df.select(S.parse_ts("x", "yyyy/MM/dd")).collect()]
    assert got == [dt.datetime(2101, 10, 20), dt.datetime(2101, 10, 20, 19, 8), None]


def test_recode_and_levels(spark):
    df = one_col(spark, ["a", "b", "zzz", None], "string")
    got = [r[0] for r in df.select(S.recode("x", {"a": "A", "b": "B"})).collect()]
    assert got == ["A", "B", None, None]
    lv = [r[0] for r in one_col(spark, [2.0, 4.0, 7.0], "double")
          .select(S.ordinal_levels("x", [1.0, 2.0, 3.0, 4.0])).collect()]
    assert lv == [1, 3, None]


def test_ordinal_encode_alphabetical_and_unseen_fails(spark):
    labels = ["Noon", "Morning", "Evening", "EarlyMorning"]
    df = one_col(spark, ["EarlyMorning", "Evening", "Morning", "Noon"], "string")
    assert [r[0] for r in df.select(S.ordinal_encode("x", labels)).collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception):
        one_col(spark, ["Night"], "string").select(S.ordinal_encode("x", labels)).collect()


def test_cast_int_is_lenient(spark):
    got = [r[0] for r in one_col(spark, ["3", "x", None], "string").select(S.cast_int("x")).collect()]
    assert got == [3, None, None]


def test_days_between_ignores_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 2, 30))],
                                   "a timestamp_ntz, b timestamp_ntz")
        # wall-clock hour inside the spring-forward gap: still one hour apart
        assert df.select(S.days_between("a", "b")).first()[0] == pytest.approx(1 / 24)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
