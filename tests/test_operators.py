"""Operators on hand-made series with known results."""

import pytest
from pyspark.sql import functions as F

from seriesforge.operators import entropy, ledger, pairs, quality
from seriesforge.operators import series as S
from seriesforge.sources.catalog import Catalog, read_csv


def frame(spark, values, entity=1, start=24000):
    rows = [(entity, (start + k) // 12, (start + k) % 12 + 1, start + k, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity long, year int, month int, month_ordinal int, value double")


def test_ramp_thresholds(spark):
    rows = [(1, 2000 + y, m, (2000 + y) * 12 + m - 1, 100.0 + m + o) for y, o in enumerate((-20, -10, 0, 10, 20)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "entity long, year int, month int, month_ordinal int, value double")
    r = S.thresholds(S.climatology_anomaly(df)).select("threshold_low", "threshold_high").distinct().collect()
    assert [tuple(x) for x in r] == [(-20.0, 20.0)]


def test_anomalies_do_not_depend_on_the_order_of_rows(spark):
    values = [float(x) for x in (1e9, 0.1, -1e9, 0.3, 7e8, 0.7, -7e8, 1.1)]
    rows = [(e, 2000 + y, 1, (2000 + y) * 12, v) for e in range(8) for y, v in enumerate(values[e:] + values[:e])]
    df = spark.createDataFrame(rows, "entity long, year int, month int, month_ordinal int, value double").coalesce(1)
    assert len({r.climatology for r in S.climatology_anomaly(df).collect()}) == 1


def test_frozen_runs(spark):
    frozen = spark.createDataFrame([(1, m) for m in (5, 6, 7, 9)] + [(2, 1)], "entity long, month_ordinal int")
    assert sorted(tuple(r) for r in S.frozen_runs(frozen).collect()) == [(1, 5, 7, 3), (1, 9, 9, 1), (2, 1, 1, 1)]


def test_defrozen_keeps_anchors(spark):
    df = frame(spark, [1.0, 2.0, 2.0, 2.0, 5.0])
    frozen = df.where("month_ordinal between 24001 and 24003").select("entity", "month_ordinal")
    assert [r.month_ordinal for r in S.without_frozen_but_anchors(df, frozen).orderBy("month_ordinal").collect()] == [24000, 24001, 24004]


def test_empty_series(spark):
    empty = frame(spark, [1.0]).where("false")
    assert S.segments(S.decay_index(S.phi(S.strengths(S.label(S.thresholds(S.climatology_anomaly(empty))))))).count() == 0
    assert S.interpolation_summary(empty).count() == 0
    assert entropy.overall_entropy(empty).count() == 0


def test_interpolation_linear_and_flat(spark):
    out = S.interpolation_summary(frame(spark, [1.0, 2.0, 3.0, 4.0, 4.0, 4.0, 4.0, 9.0])).first()
    assert (out.n_linear, out.n_flat, out.max_linear, out.max_flat, out.collinear_ratio) == (1, 1, 4, 4, 7 / 8)


def test_decay_equals_recurrence(spark):
    import math

    phis = [0.0, 2.0, 0.0, 1.0, 0.5]
    got = [r.decay_index for r in S.decay_index(frame(spark, phis).withColumn("phi", F.col("value"))).orderBy("month_ordinal").collect()]
    s, want = 0.0, []
    for p in phis:
        s = s * math.exp(-0.8) + p
        want.append(s)
    assert got == pytest.approx(want)


def test_flat_series_has_all_its_flags(spark):
    df = frame(spark, [0.0] * 10)
    info = spark.createDataFrame([(1, 5.0)], "entity long, area double")
    assert quality.classify(df, info).first().flags == 1 + 2 + 4 + 8  # no volatility: the mean isn't positive


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.7)], "entity long, score double")
    new = spark.createDataFrame([(1, 0.99)], "entity long, score double")
    assert sorted(tuple(r) for r in ledger.upsert(old, new, ["entity"]).collect()) == [(1, 0.99), (2, 0.7)]
    assert [r.entity for r in ledger.delete(old, spark.createDataFrame([(2,)], "entity long")).collect()] == [1]


def test_even_entropy_of_one_month(spark):
    rows = entropy.overall_entropy(frame(spark, [float(k == 3) for k in range(12)])).first()
    assert rows.ae == 0.0


def test_event_share_uses_the_sample_deviation(spark):
    """One outlier of 11 values is at 3.16 population deviations, and at 3.02 of the sample; of 10 at 3.0 and 2.85."""
    rows = frame(spark, [0.0] * 10 + [1.0]).unionByName(frame(spark, [0.0] * 9 + [1.0], 2)).unionByName(frame(spark, [-1.0, 1.0] * 5 + [4.0], 3))
    assert {r.entity: r.n_events for r in pairs.event_share(rows, 3.1).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.entity: r.n_events for r in pairs.event_share(rows).collect()} == {1: 1, 2: 0, 3: 0}


def test_catalog(spark, tmp_path):
    frame(spark, [1.0, 2.0]).write.parquet(f"{tmp_path}/areas")
    catalog = Catalog(spark, str(tmp_path), {"series_view": "areas"})
    assert catalog.register("series_view") and not catalog.register("nothing_there")
    assert catalog.query("select count(*) as n from series_view where value > :least", least=1.5).first().n == 1
    catalog.append("areas", frame(spark, [3.0]))
    assert spark.read.parquet(f"{tmp_path}/areas").count() == 3
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_csv(spark, f"{tmp_path}/x.csv", ["c"])


def test_stream(spark, sf_dir, tmp_path):
    from seriesforge.streaming.monthly import to_table, windowed_totals

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    totals = windowed_totals(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    to_table(totals, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] <= rows.count()
