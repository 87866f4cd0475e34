"""Saved models, window archives, versioned tables, exact ranks, gradient fits, edit logs and half widths."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from traceforge.operators import edits as ed
from traceforge.operators import gradients as gr
from traceforge.operators import learning as ln
from traceforge.operators import peaks as pk
from traceforge.operators import ranking as rk
from traceforge.plans import store_queries as sq
from traceforge.plans import views as v
from traceforge.sources import folders, models, npz
from traceforge.sources.versions import VersionedTable

# ---- models


@pytest.fixture(scope="module")
def trained(spark):
    return sq._planted_model(spark, "/root/testdata/sf0.01")


def test_a_loaded_model_predicts_as_the_unsaved_one(spark, trained):
    saved, rows = trained
    path = folders.work_folder(spark, "model")
    models.save_model(spark, path, saved)
    back = models.load_model(spark, path)
    assert back.features == saved.features and back.meta == saved.meta and back.curve is None and back.threshold() == models.NO_CURVE
    key = lambda m: sorted((r["well"], r["prediction"], tuple(r["p"])) for r in m.predict(rows).select("well", "prediction", vector_to_array("probability").alias("p")).collect())
    assert key(back) == key(saved)


def test_held_out_wells_beat_the_majority(spark, trained):
    saved, rows = trained
    got = saved.predict(rows).where("held_out").toPandas()
    most = got["label"].value_counts(normalize=True).max()
    assert len(got) >= 15 and most < 0.6 and (got["prediction"] == got["label"]).mean() > most + 0.2


def test_features_that_do_not_fit_raise(spark, trained):
    saved, rows = trained
    with pytest.raises(models.FeatureError, match=saved.features[3]):
        saved.predict(rows.drop(saved.features[3]))
    with pytest.raises(models.FeatureError, match="no numbers"):
        saved.predict(rows.withColumn(saved.features[0], F.lit("text")))
    with pytest.raises(models.FeatureError):
        models.save_model(spark, folders.work_folder(spark, "model"), models.SavedModel(saved.pipeline, saved.features[::-1]))
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, folders.work_folder(spark, "none"))
    assert models.combined_features(saved, {"compact": rows.select("well"), "all": rows}) == "all"
    with pytest.raises(models.FeatureError):
        models.combined_features(saved, {"compact": rows.select("well")})


def test_the_newest_model_is_current_and_its_curve_comes_back(spark, trained):
    saved, _ = trained
    path = folders.work_folder(spark, "model")
    first = models.save_model(spark, path, saved)
    curve = spark.createDataFrame([(0.0, 0.8, 1.0, 50), (0.5, 0.99, 0.6, 30), (0.9, 1.0, 0.1, 5), (0.95, 1.0, 0.0, 0)], models.CURVE)
    models.save_model(spark, path, models.SavedModel(saved.pipeline, saved.features, {"ref_spacing": [50.0], "note": "é"}, curve))
    now = models.load_model(spark, path)
    assert now.meta == {"ref_spacing": [50.0], "note": "é"} and [tuple(r) for r in now.curve.orderBy("threshold").collect()] == [tuple(r) for r in curve.collect()]
    assert (now.threshold(), now.threshold(0.5), now.threshold(1.1)) == (0.5, 0.0, models.NOT_REACHED)
    assert models.load_model(spark, path, first.removeprefix(path + "/")).meta == saved.meta


# ---- archives

WINDOWS = "variant string, well string, position long, label int, quality double, x_c1 array<double>, x_c2 array<double>, x_c3 array<double>, x_c4 array<double>"


def some_windows(n=40, size=5, variants=("Cp312", "Phat", "ü v")):
    r = random.Random(n)
    return [(vn, f"A{w:02d}", i, i % 5, float(i % 37), *[[r.random() for _ in range(size)] for _ in range(4)]) for vn in variants for w in range(2) for i in range(n // 2)]


def test_archives_round_trip(spark):
    rows = some_windows()
    path = folders.work_folder(spark, "npz")
    npz.write_npz(spark.createDataFrame(rows, WINDOWS).repartition(3), path, rows_per_file=15)
    names = ["variant", "well", "position", "label", "quality", "x_c1", "x_c2", "x_c3", "x_c4"]
    back = npz.read_npz(spark, path)
    assert sorted(tuple(r) for r in back.select(names).collect()) == sorted(rows)
    assert sorted(tuple(r) for r in npz.read_npz(spark, path, [npz.MERGED]).select(names).collect()) == sorted(rows)
    assert {r["variant"] for r in npz.read_npz(spark, path, ["Phat"]).collect()} == {"Phat"}
    files = folders.names(spark, path)
    assert len([f for f in files if f.startswith("Phat.part-")]) >= 3 and not [f for f in files if f.startswith("_")]
    local = path.removeprefix("file://")
    one = np.load(f"{local}/{[f for f in files if f.startswith('Phat')][0]}")
    assert one["X"].shape[1:] == (5, 4) and len(one["y"]) == len(one["wells"]) == len(one["positions"]) == len(one["quality"]) <= 15


def test_archives_of_other_tools_and_broken_ones(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.random((7, 3, 4)).astype(np.float32)
    np.savez_compressed(tmp_path / "old.npz", X=x, y=np.arange(7) % 5, wells=np.array(["A01"] * 7, dtype=object))
    got = npz.read_npz(spark, f"file://{tmp_path}").orderBy("position").collect()
    assert [r["quality"] for r in got] == [npz.DEFAULT_QUALITY] * 7 and {r["variant"] for r in got} == {"old"} and {r["well"] for r in got} == {None}
    assert np.allclose([r["x_c3"] for r in got], x[:, :, 2])
    body = (tmp_path / "old.npz").read_bytes()
    for n, bad in enumerate((body[: len(body) // 2], body[:-10], b"", b"no archive", npz.packed({"X": x, "y": np.arange(6)}), npz.packed({"y": np.arange(6)}), npz.packed({"X": x[:, 0], "y": np.arange(7)}))):
        folder = tmp_path / f"bad{n}"
        folder.mkdir()
        (folder / "clipped.npz").write_bytes(bad)
        with pytest.raises(Exception, match="clipped.npz is no whole archive"):
            npz.read_npz(spark, f"file://{folder}").count()


def test_windows_without_a_common_length_leave_no_file(spark):
    rows = some_windows(8, 5, ("a",)) + some_windows(4, 6, ("a",))
    path = folders.work_folder(spark, "npz")
    with pytest.raises(Exception, match="common length"):
        npz.write_npz(spark.createDataFrame(rows, WINDOWS).coalesce(1), path)
    assert folders.names(spark, path) == []


def test_combined_windows(spark):
    path = folders.work_folder(spark, "npz")
    npz.write_npz(spark.createDataFrame(some_windows(40, 5, ("a",)) + some_windows(20, 6, ("b",)), WINDOWS), path, merged=False)
    got = npz.combined(npz.read_npz(spark, path), 20).toPandas()
    assert set(got["variant"]) == {"a"} and ((got["label"] == 4) | (got["quality"] > 20)).all() and (got["quality"] <= 20).any()
    assert (npz.combined(npz.read_npz(spark, path), 10, False).toPandas()["label"] != 4).all()


# ---- versioned tables

KV = "k string, v long"


def content(t, number=None):
    return sorted((r["k"], r["v"]) for r in t.read(number).collect())


def test_versions(spark):
    t = VersionedTable(spark, folders.work_folder(spark, "table"), KV)
    rows = lambda *x: spark.createDataFrame(list(x), KV)
    assert content(t) == [] and t.version().number == 0
    assert t.upsert(rows(("a", 1), ("b", 2), ("b", 3)), ["k"]) == 1
    assert t.upsert(rows(("b", 9), (None, 5)), ["k"]) == 2
    assert t.upsert(rows((None, 6)), ["k"]) == 3
    assert t.append(rows(("c", 4))) == 4
    key = lambda x: sorted(x, key=str)
    got = [(r["k"], r["v"]) for r in t.read().collect()]
    assert key(got) == key([("a", 1), ("b", 9), (None, 6), ("c", 4)]) and content(t, 1) == [("a", 1), ("b", 2), ("b", 3)]
    t.compact()
    t.vacuum()
    assert len(folders.names(spark, f"{t.root}/data")) == 1 and key([(r["k"], r["v"]) for r in t.read().collect()]) == key(got)


def test_a_failed_writer_changes_nothing(spark):
    t = VersionedTable(spark, folders.work_folder(spark, "table"), KV)
    t.replace(spark.createDataFrame([("a", 1)], KV))
    broken = spark.range(10).select(F.lit("x").alias("k"), F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("v"))
    for change in (lambda: t.upsert(broken, ["k"]), lambda: t.append(broken, "s", 0), lambda: t.replace(broken)):
        with pytest.raises(Exception, match="lost"):
            change()
        assert content(t) == [("a", 1)] and t.version().number == 1
    assert t.append(spark.createDataFrame([("b", 2)], KV), "s", 0) == 2


def test_two_writers_both_get_in(spark):
    t = VersionedTable(spark, folders.work_folder(spark, "table"), KV)
    work = [threading.Thread(target=lambda i=i: t.upsert(spark.createDataFrame([(f"k{i}", i)], KV), ["k"])) for i in range(4)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert content(t) == [(f"k{i}", i) for i in range(4)] and t.version().number == 4


def test_replayed_batches_are_written_once(spark, tmp_path):
    t = VersionedTable(spark, folders.work_folder(spark, "table"), KV)
    write = t.batch_writer("stream")
    for i in range(3):
        spark.createDataFrame([(f"k{i}", i)], KV).coalesce(1).write.json(f"file://{tmp_path}/in/{i}")

    def run(checkpoint):
        d = spark.readStream.schema(KV).option("maxFilesPerTrigger", "1").json(f"file://{tmp_path}/in/*")
        d.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run("one")
    assert content(t) == [("k0", 0), ("k1", 1), ("k2", 2)]
    run("lost")  # a new checkpoint: every batch comes again
    assert content(t) == [("k0", 0), ("k1", 1), ("k2", 2)]


# ---- ranks


@pytest.mark.parametrize("order", [["n"], ["t", "n"], ["d", "n"], ["n", "t", "x"]])
def test_exact_ranks(spark, order):
    r = random.Random(1)
    import datetime as dt

    rows = [(r.choice(["a", "b", None]), r.choice([None, 7, 7, 7, 7, r.randint(-50, 50)]), r.choice(["é", "same prefix 1", "same prefix 2", "", None, "z"]), dt.date(2020, 1, 1 + r.randint(0, 20)), i + 0.5) for i in range(3000)]
    d = spark.createDataFrame(rows, "c string, n long, t string, d date, x double").repartition(5)
    got = rk.exact_rank(d, ["c"], order, cuts=16).toPandas()
    assert len(got) == 3000
    for c, part in d.toPandas().groupby("c", dropna=False):
        mine = got[got["c"].isna()] if c is None or c != c else got[got["c"] == c]
        assert sorted(mine["rank"]) == list(range(1, len(part) + 1)) and set(mine["total"]) == {len(part)}
        key = lambda q: tuple((0, "") if x is None or x != x else (1, x.encode() if isinstance(x, str) else x) for x in q)
        keys = [key(q) for q in mine.sort_values("rank")[order].itertuples(index=False)]
        assert keys == sorted(keys)


def test_no_window_holds_a_class(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("c"), "id")
    plan = ln.ranked_split(d, "c", ["id"])._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.splitlines() if "Window" in x and "row_number" in x]
    assert rows and all("_range0" in x.split("windowspecdefinition")[1].split(" ASC")[0] for x in rows)
    assert {r["part"]: r["count"] for r in ln.ranked_split(d, "c", ["id"]).groupBy("part").count().collect()} == {"train": 800, "validate": 100, "test": 100}


# ---- gradients


def test_gradient_fit_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 600)
    mixing = np.eye(4) + 0.3 * rng.random((4, 4))
    x = (np.eye(4)[y] * 5 + rng.normal(0, 1, (600, 4))) @ mixing * 100
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 2), (1.0, 1.0, 1.0, 1.0, 9), (1.0, 1.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(rows, "c1 double, c2 double, c3 double, c4 double, y long").repartition(4)
    fit = gr.gradient_matrix(d, "y", steps=25, rate=0.02, noise=0.1, seed=1)
    z, s = (x - x.mean(0)) / (x.std(0) + 1e-8), np.eye(4) + 0.1 * np.random.default_rng(1).standard_normal((4, 4))
    m, w, losses = np.zeros((4, 4)), np.zeros((4, 4)), []

    def loss(s):
        a = np.maximum(z @ s, 0)
        e = np.exp(a - a.max(1, keepdims=True))
        return -np.log((e / e.sum(1, keepdims=True))[np.arange(600), y]).mean() + 0.01 * ((s * (1 - np.eye(4))) ** 2).sum()

    for t in range(1, 26):
        losses.append(loss(s))
        g = np.zeros((4, 4))
        for i in range(4):
            for j in range(4):  # the slope itself, from values on both sides
                h = np.zeros((4, 4))
                h[i, j] = 1e-6
                g[i, j] = (loss(s + h) - loss(s - h)) / 2e-6
        m, w = 0.9 * m + 0.1 * g, 0.999 * w + 0.001 * g * g
        s = s - 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(w) + 1e-7)
    assert np.allclose(fit.standard, s, atol=1e-5) and np.allclose(fit.losses, losses, atol=1e-6)
    assert fit.losses[-1] < fit.losses[0] and (np.diff(fit.losses) < 0).mean() > 0.9
    assert np.allclose(x @ fit.matrix + fit.offset, z @ fit.standard, atol=1e-6)
    assert ((x @ fit.matrix + fit.offset).argmax(1) == y).mean() > 0.9
    with pytest.raises(ValueError):
        gr.gradient_matrix(d.limit(0), "y", steps=1)


# ---- edits


def plain_edits(events, most=None):
    done, undone, gone = [], [], []
    for op, edit in events:
        if op == "undo":
            if done:
                undone.append(done.pop())
        elif op == "redo":
            if undone:
                done.append(undone.pop())
        else:
            done.append(edit)
            undone = []
            if most is not None and len(done) > most:
                gone.append(done.pop(0))
    return done, gone


@pytest.mark.parametrize("most", [None, 3])
def test_edit_logs(spark, most):
    r = random.Random(4)
    logs = {k: [(r.choices(["undo", "redo", "edit"], [4, 3, 3 + k % 3])[0], f"e{i}") for i in range(r.randint(1, 60))] for k in range(40)}
    d = spark.createDataFrame([(k, i, op, e) for k, log in logs.items() for i, (op, e) in enumerate(log)], "k long, seq long, op string, edit string").repartition(4)
    got = {x["k"]: (x["n_standing"], x["last_standing"]) for x in ed.folded_edits(d, ["k"], "seq", most).collect()}
    stand = {}
    for x in ed.standing_edits(d, ["k"], "seq", most).collect():
        stand.setdefault(x["k"], {})[x["level"]] = x["edit"]
    for k, log in logs.items():
        done, gone = plain_edits(log, most)
        assert got[k] == (len(done), done[-1] if done else None)
        assert [e for _, e in sorted(stand.get(k, {}).items())] == gone + done


def test_a_million_events_of_one_user():
    r = random.Random(0)
    ops = r.choices(["undo", "redo", "edit"], [2, 1, 3], k=1_000_000)
    depth, reach, floor = ed.walk(ops)
    done, _ = plain_edits([(op, None) for op in ops[:5000]])
    assert depth[4999] == len(done) and (depth <= reach).all() and not floor.any()


def test_edit_streams(spark, tmp_path):
    """The state after each batch equals that of the whole log so far."""
    r = random.Random(9)
    log = [(i % 3, i, r.choices(["undo", "redo", "edit"], [4, 3, 4])[0], f"e{i}") for i in range(90)]
    kind = "k long, seq long, op string, edit string"
    for n in range(3):
        spark.createDataFrame(log[30 * n : 30 * n + 30], kind).coalesce(1).write.json(f"file://{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        d = spark.readStream.schema(kind).option("maxFilesPerTrigger", "1").json(f"file://{tmp_path}/in/*")
        seen = []
        q = ed.folded_edit_stream(d, ["k"], "seq").writeStream.outputMode("update").foreachBatch(lambda b, i: seen.append([tuple(x) for x in b.collect()]))
        q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    state = {k: (n, last) for batch in seen for k, n, last in batch}
    for k in range(3):
        done, _ = plain_edits([(op, e) for j, _, op, e in log if j == k])
        assert state[k] == (len(done), done[-1] if done else None)


# ---- half widths


def test_half_width_against_a_plain_walk(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for w, n in enumerate((1, 2, 17, 300, 9000)):
        y = np.round(rng.random(n) * 10, 2) if n < 1000 else np.where(np.arange(n) % 4500 == 10, 1.0, 50 + np.arange(n) % 7)
        first = 5 * w
        rows += [("p", w, "c1", first + i, float(a)) for i, a in enumerate(y)]
        for i in rng.integers(0, n, min(n, 60)).tolist():
            h = float(y[i])
            left = next((j for j in range(i - 1, -1, -1) if y[j] <= h / 2), 0)
            right = next((j for j in range(i + 1, n) if y[j] <= h / 2), n - 1)
            want[(w, first + i)] = (first + left, first + right)
    d = spark.createDataFrame(rows, "plate string, well long, channel string, scan long, y double").repartition(4)
    at = d.join(spark.createDataFrame(list(want), "well long, scan long"), ["well", "scan"]).withColumnRenamed("y", "height")
    got = {(r["well"], r["scan"]): (r["left"], r["right"]) for r in pk.half_width(d, at).collect()}
    assert got == want
    assert "FlatMapCoGroups" not in pk.half_width(d, at)._jdf.queryExecution().executedPlan().toString()
    assert pk.half_width(d, at.limit(0)).count() == 0


def test_queries_of_stores_have_rows(spark):
    for name in ("saved_references", "labelled_log", "standing_edits"):
        assert sq.QUERIES[name][0](spark, "/root/testdata/sf0.001").count() > 10
    assert v.REFERENCE_SCANS


# ---- references and forests


def test_references_are_saved_by_gene(spark, tmp_path):
    from traceforge.sources import references as rf
    from traceforge.sources import tables as tb

    t = VersionedTable(spark, folders.work_folder(spark, "references"), rf.REFERENCES)
    t.upsert(tb.reference_positions(spark), ["gene"])
    own = spark.createDataFrame([("OY_IL10_N2_080910Run1", 1, 1800), ("OY_IL10_N2_080910Run1", 2, 2000), ("OY_IL10_Z", 1, 5), ("OY_IL10_Z", 2, 6), ("plain", 1, 1), ("plain", 2, 2)], "folder string, ref_idx int, ref_scan long")
    shown = spark.createDataFrame([("OY_NEW_1", s) for s in (900, 100, 500, 700, 300, 300)] + [("OY_IL10_Z", 1)], "folder string, scan long")
    assert rf.save_references(t, own, shown) == 2
    path = f"file://{tmp_path}/refs.json"
    for _ in range(2):
        rf.export_json(spark, t, path)
    back = {}
    for r in tb.reference_positions(spark, path).orderBy("gene", "ref_idx").collect():
        back.setdefault(r["gene"], []).append(r["ref_scan"])
    assert sorted(back) == ["ABCC2", "CYBA", "GSTA1", "IL10", "NEW", "plain", "rs1695"]
    assert back["IL10"] == [1800, 2000] and back["NEW"] == [100, 300, 500, 700, 900] and back["CYBA"] == [2145, 2170, 2189, 2215] and back["plain"] == [1, 2]
    assert [f.name for f in tmp_path.iterdir() if f.name.endswith(".tmp")] == []


def test_forests_beat_the_majority(spark):
    from traceforge.plans import registry

    sf = "/root/testdata/sf0.01"
    d = registry.queries()["forest_calls"](spark, sf).where("part <> 'train'").toPandas()
    assert len(d) >= 10 and (d["prediction_code"] == d["label"]).mean() > d["label"].value_counts(normalize=True).max() + 0.15
    assert d["prediction_code"].nunique() == 3 and set(d["prediction_name"]) == {"hom1", "hom2", "het"}
    d = registry.queries()["standard_only_calls"](spark, sf).where("NOT known").toPandas()
    assert len(d) >= 30 and (d["prediction_code"] == d["label"]).mean() > d["label"].value_counts(normalize=True).max() + 0.15
