"""Queries of base calls, sequences, learning, chromatogram grids and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import basecall as bc
from ..operators import chromatogram as ch
from ..operators import learning as ln
from ..operators import sequences as sq
from ..operators import signal as sg
from ..schema import CHANNELS, DISPLAY_MATRIX, M13_REFERENCE, MOBILITY_SEARCH, SPECTRAL_MATRIX, WELL
from ..sources import sinks
from ..streaming import ingest
from . import views as v
from .peak_queries import ALL
from .signal_queries import UN, _unmix_exprs
from .views import PK, SM, TR, lg, sql


def _dyed(spark: SparkSession, sf: str) -> DataFrame:
    return sg.unmix(v.trace(spark, sf), SPECTRAL_MATRIX)


def chemistry_basecall(spark: SparkSession, sf: str) -> DataFrame:
    """BC-1."""
    return bc.chemistry_calls(v.peaks(spark, sf, ("c1", "c2")), v.trace(spark, sf), "TSII-v2").withColumn("quality", F.col("quality").cast("long"))


def cimarron_quality(spark: SparkSession, sf: str) -> DataFrame:
    """BC-2: calls from unmixed dyes."""
    bc.check_matrix(SPECTRAL_MATRIX)
    d = _dyed(spark, sf)
    noise = d.groupBy(*WELL).agg(*[(F.stddev_pop(F.when(F.col("scan") < 200, F.col(x))) + 1e-8).alias(f"noise_{x}") for x in bc.DYES])
    return bc.dye_calls(d, v.peaks(spark, sf), noise).withColumns({"quality": F.col("quality").cast("long"), "dye": F.col("dye").cast("long")})


def mobility_search(spark: SparkSession, sf: str) -> DataFrame:
    """BC-4 and BC-5."""
    d = bc.mobility_search(_dyed(spark, sf), v.peaks(spark, sf))
    return d.select(*WELL, "scan", F.col("dye").cast("long").alias("dye"), F.col("offset").cast("long").alias("offset"), F.round("share", 4).alias("share"))


def gap_check(spark: SparkSession, sf: str) -> DataFrame:
    """BC-6."""
    d = bc.gap_check(bc.chemistry_calls(v.peaks(spark, sf), v.trace(spark, sf), "Cimarron"))
    return d.select(*WELL, "scan", "gap", "median_gap", "wide_gap", F.col("quality").cast("long").alias("quality"), "base")


def even_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """BC-8: a fold over each well's calls."""
    d = bc.even_spacing(bc.chemistry_calls(v.peaks(spark, sf), v.trace(spark, sf), "Cimarron"))
    return d.withColumn("quality", F.col("quality").cast("long"))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    total = F.expr("+".join(CHANNELS))
    from ..functions.stencils import argmax

    return v.trace(spark, sf).select(*WELL, "scan", argmax(CHANNELS).cast("long").alias("cls"), F.round(F.greatest(*CHANNELS) / total, 4).alias("conf"))


def run_length_islands(spark: SparkSession, sf: str) -> DataFrame:
    """BC-11, its runs."""
    return bc.run_islands(_classified(spark, sf), 0.6)


def scan_calls(spark: SparkSession, sf: str) -> DataFrame:
    """BC-11, its sequential calls."""
    return bc.scan_calls(_classified(spark, sf), 0.6)


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    """BC-10 with a linear scorer: softmax of the window's middle z-scores."""
    places = v.peaks(spark, sf).select(*WELL, F.col("scan").alias("position"))

    def scorer(x: np.ndarray) -> np.ndarray:
        e = np.exp(x[:, x.shape[1] // 2, :])
        return e / e.sum(axis=1, keepdims=True)

    return bc.scored_calls(sg.windows(v.trace(spark, sf), places, 15), scorer)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """A call at every scan: base by quantity, quality by tax and discount."""
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGTN"]), (F.col("current").cast("int") % 5 + 1))
    return v.trace(spark, sf).select(*WELL, "scan", base.alias("base"), F.floor(F.col("c1") / 1000).cast("long").alias("quality"))


def sequence_format(spark: SparkSession, sf: str) -> DataFrame:
    """BC-13."""
    return bc.sequence_lines(_calls(spark, sf))


def fasta_wrap(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2."""
    return sinks.fasta_rows(_calls(spark, sf).withColumnRenamed("scan", "position"), "Cimarron")


def base_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1."""
    d = _calls(spark, sf).withColumnRenamed("scan", "position").withColumn("probability", F.when(F.col("base") != "N", F.col("quality") / 127))
    return sinks.base_rows(d)


def call_summary(spark: SparkSession, sf: str) -> DataFrame:
    """BC-14 and SNK-3."""
    return bc.summary(_calls(spark, sf))


def quality_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """BC-16: glyphs by well."""
    return _calls(spark, sf).groupBy("plate", bc.quality_glyph(F.col("quality")).alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


def caller_names(spark: SparkSession, sf: str) -> DataFrame:
    """BC-15: roles of conversations as callers, named by part."""
    d = v.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("_", "role", F.lit("v2")).alias("caller"))
    named = d.withColumn("caller_name", bc.caller_name(F.col("caller"), {"user": "Person", "user_v2": "Person 2", "assist": "Helper"}))
    return named.groupBy("caller", "caller_name").agg(F.count(F.lit(1)).alias("n"))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGTN"]), (F.col("l_quantity").cast("int") % 5 + 1))
    return v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("caller"), base.alias("base"))


def consensus_vote(spark: SparkSession, sf: str) -> DataFrame:
    """AL-5."""
    return sq.consensus(_votes(spark, sf), ["place"], "caller")


def consensus_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """AL-6."""
    return sq.agreement(_votes(spark, sf), ["place"], 2)


def sequence_clean(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-4 and FLT-9: cleaned texts of at least 50 letters."""
    d = v.table(spark, sf, "documents").select("doc_id", sq.cleaned(F.col("text")).alias("sequence"))
    return d.where(F.length("sequence") >= 50).select("doc_id", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


def sw_align(spark: SparkSession, sf: str) -> DataFrame:
    """AL-1: benchmark texts as sequences against one reference."""
    d = v.table(spark, sf, "benchmark").select("item_id", sq.cleaned(F.col("text")).alias("sequence"))
    return sq.align(d, M13_REFERENCE)


def align_lines(spark: SparkSession, sf: str) -> DataFrame:
    """AL-2: the alignment's match line."""
    return sw_align(spark, sf).select("item_id", "query_line", sq.match_line(F.col("query_line"), F.col("ref_line")).alias("match_line"), "ref_line")


def label_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """AL-8: reference bases at query positions."""
    return sq.transferred_labels(sw_align(spark, sf).withColumn("variant", F.col("item_id").cast("string")))


def method_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """AL-3, AL-4 and AL-7: callers by mean identity."""
    d = v.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("variant"), (F.col("l_discount") * 10).alias("identity"))
    s = sq.ranked(sq.identity_stats(d, "variant"), "variant")
    return s.select("variant", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "greatest", "deviation")], F.col("rank").cast("long").alias("rank"))


def emission_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """MX-2."""
    d = v.samples(spark, sf).withColumns({c: F.abs(c) for c in CHANNELS})
    return ln.emission(d).select("base", *[F.round(f"e_{c}", 6).alias(f"e_{c}") for c in CHANNELS])


def base_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """MX-3."""
    d = ln.base_stats(v.samples(spark, sf).withColumns({c: F.abs(c) for c in CHANNELS}))
    return d.select("base", "n", *[F.round(f"{p}_{c}", 5).alias(f"{p}_{c}") for p in "msr" for c in CHANNELS])


def channel_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """MX-1: at tall peaks, the scan of the greatest total within 7 and its channels."""
    from ..operators.joins import range_join

    d = v.trace(spark, sf).withColumn("total", F.col("c1") + F.col("c2")).select(*WELL, F.col("scan").alias("s"), "total", "c1", "c2")
    p = v.peaks(spark, sf, ("c3",)).select(*WELL, "scan")
    j = range_join(p, d, WELL, "s", F.col("scan") - 7, F.col("scan") + 7, 15)
    top = j.groupBy(*WELL, "scan").agg(F.max(F.struct("total", (-F.col("s")).alias("b"), "c1", "c2")).alias("t"))
    return top.select(*WELL, "scan", (-F.col("t.b")).alias("peak_scan"), "t.c1", "t.c2")


def max_channel_classify(spark: SparkSession, sf: str) -> DataFrame:
    """MX-4."""
    d = v.samples(spark, sf).withColumn("called", ln.greatest_channel_base())
    return ln.confusion(d, "base", "called").withColumn("share", F.round("share", 6))


def rule_classify(spark: SparkSession, sf: str) -> DataFrame:
    """MX-5."""
    d = v.samples(spark, sf).withColumn("called", ln.rule_base())
    return ln.confusion(d, "base", "called").withColumn("share", F.round("share", 6))


def matrix_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """MX-8."""
    return ln.confusion(ln.matrix_calls(v.samples(spark, sf), DISPLAY_MATRIX), "base", "called").withColumn("share", F.round("share", 6))


def fitted_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """MX-7: accuracy of a fitted matrix, statistical."""
    d = v.samples(spark, sf).withColumn("y", (F.col("label") % 4).cast("double"))
    model = ln.fitted_matrix(d, "y", rounds=20)
    from pyspark.ml.feature import VectorAssembler

    p = model.transform(VectorAssembler(inputCols=CHANNELS, outputCol="features").transform(d))
    return p.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("n_ok"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """DP-5."""
    return ln.ranked_split(v.samples(spark, sf), "base", ["vec_id"]).select("vec_id", "base", "part")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """DP-6, with a class that is empty."""
    d = v.samples(spark, sf).withColumn("y", F.col("label") % 4)
    return ln.class_weights(d, "y", [0, 1, 2, 3, 4]).withColumn("weight", F.round("weight", 6))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    total = F.abs("c1") + F.abs("c2") + F.abs("c3") + F.abs("c4")
    d = v.samples(spark, sf).withColumn("called", ln.greatest_channel_base())
    return d.select(F.round(F.abs("c1") / total, 4).alias("conf"), (F.col("called") == F.col("base")).alias("correct"))


def confidence_curve(spark: SparkSession, sf: str) -> DataFrame:
    """DP-7."""
    return ln.confidence_curve(_scored(spark, sf)).select("threshold", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"), "n_calls")


def optimal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """BC-12."""
    return bc.optimal_threshold(confidence_curve(spark, sf), 0.25)


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """DP-7, the best of the curve."""
    return ln.best_threshold(confidence_curve(spark, sf))


def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-5: windows by quality, background or not."""
    d = v.samples(spark, sf).select("vec_id", (F.col("label") % 5).alias("label"), (F.col("vec_id") % 50).alias("quality"))
    tag = lambda x, n: x.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(n))
    return tag(ln.quality_filter(d, 20), "with").unionByName(tag(ln.quality_filter(d, 20, False), "without"))


def _cell_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select(F.col("user_id").alias("id"), ((F.col("event_id") * 37 % 10007) / 10007).alias("loc"), F.col("value").alias("area"))


def grid_encode(spark: SparkSession, sf: str) -> DataFrame:
    """CN-1."""
    return ch.encode(_cell_peaks(spark, sf)).select("id", "cell", "p", F.round("rel", 6).alias("rel"), F.round("area", 4).alias("area"))


def grid_decode(spark: SparkSession, sf: str) -> DataFrame:
    """CN-2 and CN-3."""
    d = ch.one_per_cell(_cell_peaks(spark, sf))
    return ch.decode(ch.encode(d)).select("id", F.round("loc", 6).alias("loc"), F.round("area", 4).alias("area"))


def grid_examples(spark: SparkSession, sf: str) -> DataFrame:
    """CN-8: signals by their greatest value, and their cells' areas by the same; sums of both by signal."""
    signals = v.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("point"), F.col("value").alias("y"))
    x, cells = ch.scaled_examples(signals, ch.encode(_cell_peaks(spark, sf)))
    a = x.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x"))
    return a.join(cells.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("area"), 3).alias("area")), "id")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events")
    return e.select(
        (F.col("event_type").isin("click", "view")).cast("int").alias("truth"), (F.col("event_id") * 31 % 1000 / 1000).alias("p"), (F.col("event_id") % 97 / 97).alias("rel"),
        ((F.col("event_id") % 89 + 1) / 90).alias("rel_true"), (F.col("event_id") % 11 + 1).cast("double").alias("area"), (F.col("event_id") % 13 + 1).cast("double").alias("area_true"),
    )


def grid_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """CN-5."""
    d = ch.metrics(_cells(spark, sf))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


def grid_auc(spark: SparkSession, sf: str) -> DataFrame:
    """CN-5, area under the curve."""
    return ch.auc(_cells(spark, sf)).withColumn("auc", F.round("auc", 6))


def grid_loss(spark: SparkSession, sf: str) -> DataFrame:
    """CN-6."""
    d = ch.loss(_cells(spark, sf))
    return d.select(*[F.round(c, 5).alias(c) for c in d.columns])


def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """2.13: gap groups of events in time, as the stream makes them."""
    return ingest.gap_groups(v.table(spark, sf, "events"), "user_id", "ts", "2 hours", "1 day")


def window_totals(spark: SparkSession, sf: str) -> DataFrame:
    """2.13: tumbling windows of events."""
    return ingest.rolling_totals(v.table(spark, sf, "events"), "ts", "1 day", "event_type", "1 day").withColumn("total", F.round("total", 2))


CALL = lambda ch_, bases: f"ca AS (SELECT p.plate, p.well, p.scan, p.channel, CASE WHEN q < 10 THEN 0 ELSE q END AS quality, CASE WHEN (CASE WHEN q < 10 THEN 0 ELSE q END) < 10 THEN 'N' ELSE b END AS base FROM (SELECT tp.plate, tp.well, tp.scan, channel, CAST(round_even(least(CASE WHEN c1 + c2 + c3 + c4 > 0 THEN 100 * (CASE channel {' '.join(f'''WHEN '{c}' THEN {c}''' for c in CHANNELS)} END / (c1 + c2 + c3 + c4)) ELSE 0 END, 100), 0) AS BIGINT) AS q, CASE channel {' '.join(f'''WHEN '{c}' THEN '{b}' ''' for c, b in zip(CHANNELS, bases))} END AS b FROM tp JOIN tr USING (plate, well, scan)) p)"
DY = "dy AS (SELECT plate, well, scan, " + ", ".join(f"{e} AS d{i + 1}" for i, e in enumerate(UN)) + " FROM tr)"
AM4 = lambda cs: f"list_position([{', '.join(cs)}], greatest({', '.join(cs)})) - 1"
CL = f"cl AS (SELECT plate, well, scan, CAST({AM4(CHANNELS)} AS BIGINT) AS cls, round(greatest(c1, c2, c3, c4) / (c1 + c2 + c3 + c4), 4) AS conf FROM tr)"
CA = "cs AS (SELECT plate, well, scan, substr('ACGTN', CAST(current AS INTEGER) % 5 + 1, 1) AS base, CAST(floor(c1 / 1000) AS BIGINT) AS quality FROM tr)"
VO = "vo AS (SELECT l_orderkey AS place, l_linenumber AS caller, substr('ACGTN', CAST(l_quantity AS INTEGER) % 5 + 1, 1) AS base FROM lineitem)"
SA = "sa AS (SELECT base, abs(c1) AS c1, abs(c2) AS c2, abs(c3) AS c3, abs(c4) AS c4 FROM sm)"
MAXB = f"substr('TGCA', CAST({AM4(CHANNELS)} + 1 AS INTEGER), 1)"
CONF = lambda e: sql("SELECT truth, called, n, round(n / sum(n) OVER (PARTITION BY truth), 6)::DOUBLE AS share FROM (SELECT base AS truth, called, count(*) AS n FROM (SELECT base, " + e + " AS called FROM sm) GROUP BY ALL)", SM)
DD = [f"{e}" for e in _unmix_exprs(DISPLAY_MATRIX)]
SC = f"sc AS (SELECT round(abs(c1) / (abs(c1) + abs(c2) + abs(c3) + abs(c4)), 4) AS conf, {MAXB} = base AS correct FROM sm)"
CU = "cu AS (SELECT CAST(i / 20.0 AS DOUBLE) AS threshold, round(coalesce(count(*) FILTER (WHERE correct AND conf >= i / 20.0 - 1e-10) / nullif(count(*) FILTER (WHERE conf >= i / 20.0 - 1e-10), 0), 0), 6)::DOUBLE AS accuracy, round(count(*) FILTER (WHERE conf >= i / 20.0 - 1e-10) / count(*), 6)::DOUBLE AS coverage, count(*) FILTER (WHERE conf >= i / 20.0 - 1e-10) AS n_calls FROM sc, range(0, 20) t(i) GROUP BY i)"
CP = "cp AS (SELECT user_id AS id, (event_id * 37 % 10007) / 10007 AS loc, value AS area FROM events)"
CE = "ce AS (SELECT CAST(event_type IN ('click', 'view') AS INTEGER) AS truth, event_id * 31 % 1000 / 1000 AS p, event_id % 97 / 97 AS rel, (event_id % 89 + 1) / 90 AS rel_true, (event_id % 11 + 1)::DOUBLE AS area, (event_id % 13 + 1)::DOUBLE AS area_true FROM events)"
TRIES = ", ".join(f"({c}, {o}, {i})" for i, (c, o) in enumerate((c, o) for c, os in MOBILITY_SEARCH.items() for o in os))
CLIP = lambda c: f"least(greatest({c}, 1e-7), 1 - 1e-7)"
BCE = lambda t, p: f"-({t} * ln({CLIP(p)}) + (1 - {t}) * ln(1 - {CLIP(p)}))"

QUERIES: v.Queries = {
    "chemistry_basecall": (chemistry_basecall, sql("SELECT plate, well, scan, channel, base, quality FROM ca", TR, lg("c1", "c2"), PK, ALL, CALL(CHANNELS, "AGCT"))),
    "cimarron_quality": (cimarron_quality, sql("SELECT plate, well, scan, dye, CASE WHEN quality < 10 THEN 'N' ELSE substr('TGCA', CAST(dye + 1 AS INTEGER), 1) END AS base, quality FROM (SELECT plate, well, scan, CAST(dye AS BIGINT) AS dye, CAST(least(round_even(50 * CASE WHEN t > 0 THEN own / t ELSE 0 END + 0.3 * least(5 * own / nz[dye + 1], 100) + 0.2 * least(10 * own / nz[dye + 1], 100), 0), 100) AS BIGINT) AS quality FROM (SELECT tp.plate, tp.well, tp.scan, " + AM4(bc.DYES) + " AS dye, greatest(d1, d2, d3, d4) AS own, d1 + d2 + d3 + d4 AS t, nz FROM tp JOIN dy USING (plate, well, scan) JOIN nz USING (plate, well)))", TR, lg("c1"), PK, ALL, DY, "nz AS (SELECT plate, well, [" + ", ".join(f"stddev_pop({x}) FILTER (WHERE scan < 200) + 1e-8" for x in bc.DYES) + "] AS nz FROM dy GROUP BY ALL)")),
    "mobility_search": (mobility_search, sql('SELECT plate, well, peak AS scan, CAST(dye AS BIGINT) AS dye, CAST("offset" AS BIGINT) AS "offset", round(share, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY plate, well, peak ORDER BY share DESC, nth) AS k FROM (SELECT t.plate, t.well, t.peak, t.dye, t.off AS "offset", t.nth, CASE WHEN s[1] + s[2] + s[3] + s[4] > 0 THEN s[t.dye + 1] / (s[1] + s[2] + s[3] + s[4]) ELSE 0 END AS share FROM (SELECT tp.plate, tp.well, tp.scan AS peak, m.*, greatest(2, least(tp.scan + off, n - 3)) AS spot FROM tp JOIN (SELECT plate, well, count(*) AS n FROM tr GROUP BY ALL) USING (plate, well), (VALUES ' + TRIES + ') m(dye, off, nth)) t JOIN su ON su.plate = t.plate AND su.well = t.well AND su.scan = t.spot)) WHERE k = 1', TR, lg("c1"), PK, ALL, DY, "su AS (SELECT plate, well, scan, [" + ", ".join(f"sum({x}) OVER f" for x in bc.DYES) + "] AS s FROM dy WINDOW f AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))")),
    "gap_check": (gap_check, sql("SELECT plate, well, scan, gap, median_gap, wide_gap, quality, CASE WHEN quality < 10 THEN 'N' ELSE base END AS base FROM (SELECT plate, well, scan, gap, median_gap, w AS wide_gap, CASE WHEN w THEN quality // 2 ELSE quality END AS quality, base FROM (SELECT *, coalesce(n >= 3 AND median_gap >= 1 AND gap > 3 * median_gap AND gap > 2, false) AS w FROM (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY plate, well) AS median_gap, count(*) OVER (PARTITION BY plate, well) AS n FROM (SELECT *, lead(scan) OVER (PARTITION BY plate, well ORDER BY scan) - scan AS gap FROM ca))))", TR, lg("c1"), PK, ALL, CALL(CHANNELS, "TGCA"))),
    "even_spacing": (even_spacing, sql("SELECT plate, well, scan, base, quality FROM r WHERE keep", TR, lg("c1"), PK, ALL, CALL(CHANNELS, "TGCA"), "gn AS (SELECT plate, well, greatest(2, floor(floor(quantile_cont(g, 0.5)) / 2)) AS need FROM (SELECT plate, well, scan - lag(scan) OVER (PARTITION BY plate, well ORDER BY scan) AS g FROM ca) GROUP BY ALL)", "o AS (SELECT ca.*, coalesce(need, 2) AS need, row_number() OVER (PARTITION BY plate, well ORDER BY scan) AS rn FROM ca JOIN gn USING (plate, well))", "r AS (SELECT plate, well, scan, base, quality, rn, true AS keep, scan AS last FROM o WHERE rn = 1 UNION ALL SELECT o.plate, o.well, o.scan, o.base, o.quality, o.rn, o.scan - r.last >= need, CASE WHEN o.scan - r.last >= need THEN o.scan ELSE r.last END FROM r JOIN o ON o.plate = r.plate AND o.well = r.well AND o.rn = r.rn + 1)", recursive=True)),
    "run_length_islands": (run_length_islands, sql("SELECT plate, well, cls, min(scan) AS first_scan, max(scan) AS last_scan, arg_min(scan, (-conf, scan)) AS scan, max(conf) AS conf FROM (SELECT *, sum(fresh) OVER (PARTITION BY plate, well ORDER BY scan) AS run FROM (SELECT *, CASE WHEN cls <> lag(cls) OVER w OR scan <> lag(scan) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM cl WHERE cls < 4 AND conf >= 0.6 WINDOW w AS (PARTITION BY plate, well ORDER BY scan))) GROUP BY plate, well, run, cls", TR, CL)),
    "scan_calls": (scan_calls, None),
    "model_calls": (model_calls, None),
    "sequence_format": (sequence_format, sql("SELECT plate, well, line, format('{:6d}  {}', line * 60 + 1, string_agg(base, '' ORDER BY i)) AS text, string_agg(CAST(least(quality // 10, 9) AS VARCHAR), '' ORDER BY i) AS digits FROM (SELECT *, i // 60 AS line FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY scan) - 1 AS i FROM cs)) GROUP BY plate, well, line", TR, CA)),
    "fasta_wrap": (fasta_wrap, sql("SELECT plate, well, '>' || well || ' chemistry=Cimarron avg_qual=' || CAST(floor(q) AS INTEGER) || chr(10) || regexp_replace(regexp_replace(s, '(.{80})', '\\1' || chr(10), 'g'), '\\n$', '') AS value FROM (SELECT plate, well, avg(quality) AS q, string_agg(base, '' ORDER BY scan) AS s FROM cs GROUP BY ALL)", TR, CA)),
    "base_rows": (base_rows, sql("SELECT well AS \"Well\", CAST(scan AS INTEGER) AS \"Position\", base AS \"Base\", quality AS \"Quality\", CASE WHEN base = 'N' THEN '' ELSE format('{:.4f}', quality / 127) END AS \"Probability\" FROM cs", TR, CA)),
    "call_summary": (call_summary, sql("SELECT plate, well, count(*) AS total_calls, count(*) FILTER (WHERE base = 'N') AS n_count, CAST(floor(avg(quality)) AS BIGINT) AS avg_quality, round(100.0::DOUBLE * count(*) FILTER (WHERE base = 'N') / count(*), 1) AS n_rate FROM cs GROUP BY ALL", TR, CA)),
    "quality_glyphs": (quality_glyphs, sql("SELECT plate, CASE WHEN quality >= 60 THEN '*' WHEN quality >= 20 THEN ':' ELSE '.' END AS glyph, count(*) AS n FROM cs GROUP BY ALL", TR, CA)),
    "caller_names": (caller_names, sql("SELECT caller, CASE caller WHEN 'user_v2' THEN 'Person 2' WHEN 'assistant_v2' THEN 'Helper' ELSE caller END AS caller_name, count(*) AS n FROM (SELECT role || '_v2' AS caller FROM conversations) GROUP BY ALL", "one AS (SELECT 1)")),
    "consensus_vote": (consensus_vote, sql("SELECT c.place, n_votes, CASE WHEN coalesce(n, 0) >= 2 THEN base ELSE 'N' END AS base, coalesce(n, 0) AS n_agree FROM (SELECT place, count(*) AS n_votes FROM vo GROUP BY place HAVING count(*) >= 2) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, f, base) AS k FROM (SELECT place, base, count(*) AS n, min(caller) AS f FROM vo WHERE base <> 'N' GROUP BY ALL)) b ON b.place = c.place AND k = 1", VO)),
    "consensus_agreement": (consensus_agreement, sql("SELECT place, base, agree FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY agree DESC, base) AS k FROM (SELECT place, base, count(*) AS agree FROM vo GROUP BY ALL)) WHERE k = 1 AND agree >= 2", VO)),
    "sequence_clean": (sequence_clean, sql("SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS s FROM documents) WHERE length(s) >= 50", "one AS (SELECT 1)")),
    "sw_align": (sw_align, None),
    "align_lines": (align_lines, None),
    "label_transfer": (label_transfer, None),
    "method_ranking": (method_ranking, sql("SELECT *, row_number() OVER (ORDER BY mean DESC, variant) AS rank FROM (SELECT CAST(l_linenumber AS BIGINT) AS variant, count(*) AS n, round(avg(l_discount * 10), 6) AS mean, round(quantile_cont(l_discount * 10, 0.5), 6) AS median, round(min(l_discount * 10), 6) AS least, round(max(l_discount * 10), 6) AS greatest, round(stddev_pop(l_discount * 10), 6) AS deviation FROM lineitem WHERE l_discount > 0 GROUP BY ALL)", "one AS (SELECT 1)")),
    "emission_matrix": (emission_matrix, sql("SELECT base, " + ", ".join(f"round(avg({c}) / (avg(c1) + avg(c2) + avg(c3) + avg(c4)), 6) AS e_{c}" for c in CHANNELS) + " FROM sa GROUP BY base", SM, SA)),
    "base_channel_stats": (base_channel_stats, sql("SELECT base, count(*) AS n, " + ", ".join(f"round(avg({c}), 5) AS m_{c}, round(stddev_samp({c}), 5) AS s_{c}, round(avg({c}) / greatest(avg(c1), avg(c2), avg(c3), avg(c4)), 5) AS r_{c}" for c in CHANNELS) + " FROM sa GROUP BY base", SM, SA)),
    "channel_profiles": (channel_profiles, sql("SELECT tp.plate, tp.well, tp.scan, arg_min(tr.scan, (-(c1 + c2), tr.scan)) AS peak_scan, arg_min(c1, (-(c1 + c2), tr.scan)) AS c1, arg_min(c2, (-(c1 + c2), tr.scan)) AS c2 FROM tp JOIN tr ON tp.plate = tr.plate AND tp.well = tr.well AND abs(tp.scan - tr.scan) <= 7 GROUP BY tp.plate, tp.well, tp.scan", TR, lg("c3"), PK, ALL)),
    "max_channel_classify": (max_channel_classify, CONF(MAXB)),
    "rule_classify": (rule_classify, CONF(f"CASE WHEN c1 = greatest(c1, c2, c3, c4) AND c1 > 1.2 * c2 THEN 'T' WHEN c3 = greatest(c1, c2, c3, c4) AND c3 > 1.2 * c4 THEN 'C' WHEN c2 >= 0.9 * c1 THEN 'G' WHEN c4 / nullif(c3, 0) BETWEEN 0.8 AND 3.0 THEN 'A' ELSE {MAXB} END")),
    "matrix_confusion": (matrix_confusion, CONF("substr('TGCA', CAST(" + AM4(DD) + " + 1 AS INTEGER), 1)")),
    "fitted_matrix": (fitted_matrix, None),
    "stratified_split": (stratified_split, sql("SELECT vec_id, base, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'validate' ELSE 'test' END AS part FROM (SELECT vec_id, base, row_number() OVER (PARTITION BY base ORDER BY vec_id) AS r, CAST(count(*) OVER (PARTITION BY base) AS DOUBLE) AS n FROM sm)", SM)),
    "class_weights": (class_weights, sql("SELECT CAST(i AS BIGINT) AS label, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN (SELECT count(*) FROM sm) / (5.0 * n) ELSE 0 END, 6)::DOUBLE AS weight FROM range(0, 5) t(i) LEFT JOIN (SELECT label % 4 AS i, count(*) AS n FROM sm GROUP BY ALL) USING (i)", SM)),
    "confidence_curve": (confidence_curve, sql("SELECT * FROM cu", SM, SC, CU)),
    "optimal_threshold": (optimal_threshold, sql("SELECT coalesce(min(threshold) FILTER (WHERE accuracy >= 0.25 AND coverage > 0), 0.95)::DOUBLE AS threshold FROM cu", SM, SC, CU)),
    "best_threshold": (best_threshold, sql("SELECT *, round(accuracy * sqrt(coverage), 9) AS value FROM cu ORDER BY value DESC, threshold LIMIT 1", SM, SC, CU)),
    "quality_filter": (quality_filter, sql("SELECT label, count(*) AS n, 'with' AS mode FROM q WHERE label = 4 OR quality > 20 GROUP BY label UNION ALL SELECT label, count(*), 'without' FROM q WHERE label <> 4 AND quality > 20 GROUP BY label", SM, "q AS (SELECT vec_id, label % 5 AS label, vec_id % 50 AS quality FROM sm)")),
    "grid_examples": (grid_examples, sql("SELECT id, n, x, n_cells, area FROM (SELECT id, count(*) AS n, round(sum(y / t), 4) AS x FROM si JOIN tp USING (id) GROUP BY id) JOIN (SELECT id, count(*) AS n_cells, round(sum(area / t) * 600, 3) AS area FROM (SELECT *, row_number() OVER (PARTITION BY id, least(floor(loc * 256), 255) ORDER BY loc DESC) AS k FROM cp) JOIN tp USING (id) WHERE k = 1 GROUP BY id) USING (id)", CP, "si AS (SELECT user_id AS id, value AS y FROM events)", "tp AS (SELECT id, max(y) AS t FROM si GROUP BY id)")),
    "grid_encode": (grid_encode, sql("SELECT id, cell, 1.0::DOUBLE AS p, round(loc * 256 - cell, 6) AS rel, round(area, 4) AS area FROM (SELECT *, row_number() OVER (PARTITION BY id, cell ORDER BY loc DESC) AS k FROM (SELECT *, CAST(least(floor(loc * 256), 255) AS BIGINT) AS cell FROM cp)) WHERE k = 1", CP)),
    "grid_decode": (grid_decode, sql("SELECT id, round(loc, 6) AS loc, round(area, 4) AS area FROM (SELECT *, row_number() OVER (PARTITION BY id, floor(loc * 256) ORDER BY loc) AS k FROM cp) WHERE k = 1", CP)),
    "grid_metrics": (grid_metrics, sql("SELECT round(count(*) FILTER (WHERE p > 0.5 AND truth = 1) / count(*) FILTER (WHERE truth = 1), 6) AS tpr, round(count(*) FILTER (WHERE p > 0.5 AND truth = 0) / count(*) FILTER (WHERE truth = 0), 6) AS fpr, round(avg(CAST((p > 0.5) = (truth = 1) AS INTEGER)), 6) AS accuracy, round(avg(abs(rel - rel_true)) FILTER (WHERE truth = 1 AND p > 0.5), 6) AS mae_loc, round(avg(abs(area - area_true) / area_true) FILTER (WHERE truth = 1 AND p > 0.5), 6) AS mre_area, round(avg(abs(rel - rel_true) / rel_true) FILTER (WHERE truth = 1 AND p > 0.5), 6) AS mre_loc FROM ce", CE)),
    "grid_auc": (grid_auc, sql("SELECT round(sum(pos * (coalesce(u, 0) + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM (SELECT floor(p * 1000) AS b, CAST(count(*) FILTER (WHERE truth = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE) AS neg FROM ce GROUP BY ALL))", CE)),
    "grid_loss": (grid_loss, sql(f"SELECT round(avg({BCE('truth', 'p')}), 5) AS prob, round(avg({BCE('rel_true', 'rel')}) FILTER (WHERE truth = 1), 5) AS loc, round(avg(abs(area - area_true) / area_true) FILTER (WHERE truth = 1), 5) AS area FROM ce", CE)),
    "gap_sessions": (gap_sessions, sql("SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY user_id, g", "one AS (SELECT 1)")),
    "window_totals": (window_totals, sql("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL", "one AS (SELECT 1)")),
}
