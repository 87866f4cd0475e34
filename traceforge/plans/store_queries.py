"""Queries of what is kept between runs (models, archives, references, labels), of fits over all samples, and of edit logs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as ed
from ..operators import experiments as ex
from ..operators import genotype as gt
from ..operators import gradients as gr
from ..operators import training as tn
from ..schema import CHANNELS, WELL
from ..sources import models, npz
from ..sources.folders import work_folder
from ..sources.versions import VersionedTable
from . import views as v
from .planted import planted_features
from .training_queries import BASES, CL, INSIDE, LABEL, MC, RADIUS, WN, _labelled
from .views import PK, RF, SM, TR, lg, sql

GENE = "gene string, ref_idx long, ref_scan long"
LABELS = "plate long, well long, scan long, height double, source string"


def _planted_model(spark: SparkSession, sf: str) -> tuple[models.SavedModel, DataFrame]:
    rows, features = planted_features(spark, sf)
    rows = rows.fillna(0, subset=features).persist()  # one row per well, read once per pass of the fit
    held = F.pmod(F.xxhash64("well", F.lit(7)), F.lit(4)) == 0
    forest = gt.train_forest(rows.where(~held), features, "label", 60, 8, 2)
    meta = {"trees": 60, "depth": 8, "classes": [0, 1, 2], "n_train": rows.where(~held).count()}
    return models.SavedModel(models.assembled(forest, features), features, meta), rows.withColumn("held_out", held)


def _calls(d: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return d.select(*WELL, "label", "held_out", F.col("prediction").alias("called"), F.round(F.array_max(p), 3).alias("confidence"))


def saved_forest_calls(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-11 and SRC-15, GT-8 and GT-10: a forest of balanced planted classes, saved with its features, loaded again and used; statistical, tested against the unsaved model."""
    saved, rows = _planted_model(spark, sf)
    path = work_folder(spark, "forest")
    models.save_model(spark, path, saved)
    return _calls(models.load_model(spark, path).predict(rows))


def npz_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-10 and SRC-14: windows of three variants as archives and back, by their middle and sum."""
    trace, calls = v.trace(spark, sf), _labelled(spark, sf)
    near = tn.moved_calls(calls, v.peaks(spark, sf, ("c3",)), 2)
    variants = {"called": calls, "matched": near, "good": tn.good_calls(calls, 10)}
    # One cut of the traces serves all variants.
    windows = tn.training_windows(trace, tn.named_variants(variants), RADIUS)
    path = work_folder(spark, "windows")
    npz.write_npz(windows, path)
    total = F.round(F.aggregate("x_c1", F.lit(0.0), lambda s, x: s + x), 2)
    back = npz.read_npz(spark, path).withColumn("merged", F.lit(False)).unionByName(npz.read_npz(spark, path, [npz.MERGED]).withColumn("merged", F.lit(True)))
    return back.select("merged", "variant", F.col("well").cast("long").alias("well"), "position", "label", "quality", F.get("x_c1", F.lit(RADIUS)).alias("mid"), total.alias("total"))


def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    """DP-9: twelve configurations on the planted wells, folds fixed by hash; statistical, tested for its rows and that reruns agree."""
    rows, features = planted_features(spark, sf)
    levels = [f for f in features if f.startswith(("c1_", "c2_")) and f.endswith(("mean", "std", "max"))]
    return ex.run_grid(rows, "label", WELL, ex.base_grid(levels, features)).select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in (x.split() for x in ex.RESULT.split(", "))])


STEPS, RATE = 6, 0.05


def gradient_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """MX-7: a separation matrix after six of Adam's steps from the identity, and the loss before each."""
    fit = gr.gradient_matrix(v.samples(spark, sf).withColumn("y", F.col("label") % 4), "y", steps=STEPS, rate=RATE)
    rows = [("matrix", i, j, float(fit.standard[i, j])) for i in range(4) for j in range(4)] + [("loss", i, 0, x) for i, x in enumerate(fit.losses)]
    return spark.createDataFrame(rows, "what string, i long, j long, value double").withColumn("value", F.round("value", 6))


def _descent_sql() -> str:
    """The same steps by recursion: each joins the state to all samples and aggregates."""
    k = range(4)
    s, m, w, g = (lambda x: [[f"{x}{i}{j}" for j in k] for i in k])("s"), (lambda x: [[f"{x}{i}{j}" for j in k] for i in k])("m"), (lambda x: [[f"{x}{i}{j}" for j in k] for i in k])("w"), (lambda x: [[f"{x}{i}{j}" for j in k] for i in k])("g")
    every = [(i, j) for i in k for j in k]
    stats = "sc AS (SELECT " + ", ".join(f"avg(c{i + 1}) AS a{i}, stddev_pop(c{i + 1}) + 1e-8 AS d{i}" for i in k) + " FROM sm)"
    xs = "xs AS (SELECT " + ", ".join(f"(c{i + 1} - a{i}) / d{i} AS x{i}" for i in k) + ", label % 4 AS y FROM sm, sc)"
    state = ", ".join(f"{a[i][j]}" for a in (s, m, w) for i, j in every)
    start = "SELECT 0 AS step, " + ", ".join(f"{1.0 if a is s and i == j else 0.0}::DOUBLE AS {a[i][j]}" for a in (s, m, w) for i, j in every) + ", 0::DOUBLE AS loss"
    z = "SELECT step, x0, x1, x2, x3, y, " + state + ", " + ", ".join("(" + " + ".join(f"x{i} * {s[i][j]}" for i in k) + f") AS z{j}" for j in k) + " FROM st, xs WHERE step < " + str(STEPS)
    e = "SELECT *, " + ", ".join(f"exp(greatest(z{j}, 0)) AS e{j}" for j in k) + f" FROM ({z})"
    p = "SELECT *, " + ", ".join(f"(e{j} / (e0 + e1 + e2 + e3) - CASE WHEN y = {j} THEN 1 ELSE 0 END) * CASE WHEN z{j} >= 0 THEN 1 ELSE 0 END AS p{j}" for j in k) + ", -ln(CASE y " + " ".join(f"WHEN {j} THEN e{j}" for j in k) + f" END / (e0 + e1 + e2 + e3)) AS l FROM ({e})"
    off = " + ".join(f"any_value({s[i][j]}) ** 2" for i, j in every if i != j)
    sums = "SELECT step, " + ", ".join(f"any_value({c}) AS {c}" for a in (s, m, w) for c in sum(a, [])) + ", " + ", ".join(f"avg(x{i} * p{j}) + {0.02 if i != j else 0.0} * any_value({s[i][j]}) AS {g[i][j]}" for i, j in every) + f", avg(l) + 0.01 * ({off}) AS loss FROM ({p}) GROUP BY step"
    mom = "SELECT step + 1 AS step, " + ", ".join(c for a in (s, g) for c in sum(a, [])) + ", " + ", ".join(f"0.9 * {m[i][j]} + 0.1 * {g[i][j]} AS {m[i][j]}, 0.999 * {w[i][j]} + 0.001 * {g[i][j]} ** 2 AS {w[i][j]}" for i, j in every) + f", loss FROM ({sums})"
    move = lambda i, j: f"{s[i][j]} - {RATE} * sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * {m[i][j]} / (sqrt({w[i][j]}) + 1e-7)"
    step = "SELECT step, " + ", ".join(f"{move(i, j)} AS {s[i][j]}" for i, j in every) + ", " + ", ".join(f"{a[i][j]}" for a in (m, w) for i, j in every) + f", loss FROM ({mom})"
    out = " UNION ALL ".join([f"SELECT 'matrix' AS what, {i}::BIGINT AS i, {j}::BIGINT AS j, round({s[i][j]}, 6) AS value FROM st WHERE step = {STEPS}" for i, j in every])
    return sql(f"{out} UNION ALL SELECT 'loss', (step - 1)::BIGINT, 0::BIGINT, round(loss, 6) FROM st WHERE step > 0", SM, stats, xs, f"st AS ({start} UNION ALL {step})", recursive=True)


def saved_references(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-13: references of all nations, those of one region put in their place a version later, read from the table they are kept in."""
    n = v.table(spark, sf, "nation")
    places = F.posexplode(F.array(*[F.lit(p) for p in v.REFERENCE_SCANS])).alias("i", "p")
    old = n.select(F.col("n_name").alias("gene"), places).select("gene", (F.col("i") + 1).alias("ref_idx"), (F.col("p") + 0).alias("ref_scan"))
    new = n.where("n_regionkey = 1").select(F.col("n_name").alias("gene"), places).where("i < 3").select("gene", (F.col("i") + 1).alias("ref_idx"), (F.col("p") + 7).alias("ref_scan"))
    kept = VersionedTable(spark, work_folder(spark, "references"), GENE)
    kept.upsert(old, ["gene"])
    kept.upsert(new, ["gene"])
    return kept.read()


def labelled_log(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-14: labelled peaks of two channels appended as two batches, the first of them delivered twice; counted by source and plate."""
    kept = VersionedTable(spark, work_folder(spark, "labels"), LABELS)
    for batch, channel in enumerate(("c1", "c3", "c1")):
        rows = v.peaks(spark, sf, (channel,)).select(*WELL, "scan", "height", F.col("channel").alias("source"))
        kept.append(rows, "viewer", batch % 2)
    return kept.read().groupBy("source", "plate").agg(F.count(F.lit(1)).alias("n"), F.sum("scan").alias("scans"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", ed.UNDO).when(F.col("event_type") == "signup", ed.REDO).otherwise("edit")
    return v.table(spark, sf, "events").select("user_id", "ts", op.alias("op"), F.col("event_id").cast("string").alias("edit"))


def edit_log_fold(spark: SparkSession, sf: str) -> DataFrame:
    """PK-21: undo (error) and redo (signup) over each user's events: how many edits stand, and the last."""
    return ed.folded_edits(_log(spark, sf), ["user_id"], "ts")


def standing_edits(spark: SparkSession, sf: str) -> DataFrame:
    """PK-21: every edit that stands at a log's end, by its level."""
    return ed.standing_edits(_log(spark, sf), ["user_id"], "ts")


WALK = [
    "ev AS (SELECT user_id, op, edit, row_number() OVER (PARTITION BY user_id ORDER BY ts, op, edit) AS n FROM (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS op, CAST(event_id AS VARCHAR) AS edit FROM events))",
    "wk AS (SELECT DISTINCT user_id, 0::BIGINT AS n, '' AS op, '' AS edit, 0::BIGINT AS depth, 0::BIGINT AS reach FROM ev UNION ALL SELECT e.user_id, e.n, e.op, e.edit, CASE e.op WHEN 'undo' THEN greatest(depth - 1, 0) WHEN 'redo' THEN least(depth + 1, reach) ELSE depth + 1 END, CASE e.op WHEN 'edit' THEN depth + 1 ELSE reach END FROM wk JOIN ev e ON e.user_id = wk.user_id AND e.n = wk.n + 1)",
    "fin AS (SELECT user_id, arg_max(depth, n) AS last FROM wk GROUP BY user_id)",
    "lv AS (SELECT user_id, depth AS level, arg_max(edit, n) AS edit, last FROM wk JOIN fin USING (user_id) WHERE op = 'edit' AND depth <= last GROUP BY ALL)",
]
MERGED = " UNION ALL ".join(f"SELECT {m} AS merged, * FROM ex" for m in ("false", "true"))
COLUMNS = f"well, wn.position, CAST({LABEL} AS BIGINT) AS label, quality, mid, total"

QUERIES: v.Queries = {
    "saved_forest_calls": (saved_forest_calls, None),
    "npz_round_trip": (npz_round_trip, sql(MERGED, *BASES, MC, WN, f"ex AS (SELECT 'called' AS variant, {COLUMNS} FROM cl JOIN wn USING (plate, well, position) WHERE {INSIDE} UNION ALL SELECT 'matched', {COLUMNS} FROM mc JOIN wn USING (plate, well, position) WHERE {INSIDE} UNION ALL SELECT 'good', {COLUMNS} FROM cl JOIN wn USING (plate, well, position) WHERE {INSIDE} AND quality >= 10 AND base <> 'N')")),
    "experiment_grid": (experiment_grid, None),
    "gradient_matrix": (gradient_matrix, _descent_sql()),
    "saved_references": (saved_references, f"SELECT n_name AS gene, CAST(i AS BIGINT) AS ref_idx, CAST(p + CASE WHEN n_regionkey = 1 THEN 7 ELSE 0 END AS BIGINT) AS ref_scan FROM nation, (VALUES {', '.join(f'({i + 1}, {p})' for i, p in enumerate(v.REFERENCE_SCANS))}) t(i, p) WHERE n_regionkey <> 1 OR i <= 3"),
    "labelled_log": (labelled_log, sql("SELECT channel AS source, plate, count(*) AS n, CAST(sum(scan) AS BIGINT) AS scans FROM pk GROUP BY ALL", TR, lg("c1", "c3"), PK)),
    "edit_log_fold": (edit_log_fold, sql("SELECT fin.user_id, fin.last AS n_standing, lv.edit AS last_standing FROM fin LEFT JOIN lv ON lv.user_id = fin.user_id AND level = fin.last", *WALK, recursive=True)),
    "standing_edits": (standing_edits, sql("SELECT user_id, level, edit FROM lv", *WALK, recursive=True)),
}
