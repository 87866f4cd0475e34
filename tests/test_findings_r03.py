"""What the findings of round 3 asked for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.functions import kernels as k
from traceforge.functions import stencils as st
from traceforge.operators import peaks as pk
from traceforge.operators import signal as sg


def test_many_traces_are_searched_as_one_by_one():
    rng = np.random.default_rng(3)
    traces = [rng.integers(0, 7, n).astype(float) for n in (0, 1, 2, 40, 41, 300)]
    least = np.arange(len(traces)) % 3
    p = k.find_many(traces, least, 4, 1, 1)
    for i, y in enumerate(traces):
        assert p.place[p.trace == i].tolist() == k.find_peaks(y, least[i], 4, 1, 1).tolist()


def test_channels_become_rows_without_another_exchange(spark):
    trace = spark.range(40).select((F.col("id") % 2).alias("plate"), (F.col("id") % 4).alias("well"), F.col("id").alias("scan"), *[F.col("id").cast("double").alias(c) for c in ("c1", "c2", "c3", "c4")])
    long = sg.to_long(trace.withColumn("n", F.count(F.lit(1)).over(st.whole())))
    plan = long.withColumn("b", F.lag("y").over(st.scans("channel")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_detection_streams_whole_traces_over_small_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(p, w, c, s, float(y)) for p in (1, 2) for w in (1, 2) for c in ("c1", "c2") for s, y in enumerate(rng.integers(0, 500, 30))]
    d = spark.createDataFrame(rows, "plate long, well long, channel string, scan long, y double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in pk.found_peaks(d, lambda y: {"height": float(np.median(y)), "distance": 3}).select(*pk.BY_CHANNEL, "scan").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key in {r[:3] for r in rows}:
        y = np.array([r[4] for r in sorted(rows) if r[:3] == key])
        want |= {(*key, int(i)) for i in k.find_peaks(y, float(np.median(y)), 3)}
    assert got == want


def test_quality_limits_rest_on_every_labelled_document(spark):
    from traceforge.llm import quality as q

    rows = [(b, float(r), int(r * q.CELLS)) for b, n in ((10, 30_000), (11, 77), (12, 49)) for r in np.random.default_rng(b).uniform(0.3, 0.9, n).round(4)]
    got = {r["band"]: r["least"] for r in q._quantiles(spark.createDataFrame(rows, "band long, ratio double, cell long")).collect()}
    want = {b: float(np.quantile([r[1] for r in rows if r[0] == b], q.QUANTILE)) for b in (10, 11)}
    assert got == pytest.approx(want, abs=1e-12)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(120))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    limits = q.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    import zstandard

    ratio = np.array([len(zstandard.ZstdCompressor(level=q.LEVEL).compress(t.encode())) / len(t) for _, t in texts])
    (band,) = limits
    assert limits[band] == pytest.approx(np.quantile(ratio, q.QUANTILE) - q.MARGIN, abs=1e-6)


def test_every_query_that_holds_a_frequent_value_finds_every_image_that_does(spark, monkeypatch):
    from traceforge.llm import media

    monkeypatch.setattr(media, "HOT", 3)
    r = np.random.default_rng(12)
    logo, rows = media.render(r.normal(size=64)), []
    for i in range(8):
        p = np.concatenate([media.render(r.normal(size=64)), np.full((60, 80), 128, np.uint8), logo])
        rows.append((100 * i + i % 2, p.shape[1], p.shape[0], bytearray(p.tobytes())))
    got = {(x["query_id"], x["copy_id"]) for x in media.find_copies(spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary")).collect()}
    assert got == {(q[0], m[0]) for q in rows if q[0] % 100 == 0 for m in rows}


def test_peaks_at_one_place_of_a_cell_count_in_any_order_of_rows(spark):
    from traceforge.operators import chromatogram as ch

    for areas in ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]):
        d = spark.createDataFrame([(1, 0.5, a) for a in areas], "id long, loc double, area double").coalesce(1)
        assert [r["area"] for r in ch.encode(d).collect()] == [3.0] == [r["area"] for r in ch.one_per_cell(d).collect()]
