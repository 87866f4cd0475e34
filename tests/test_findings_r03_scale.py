"""What the findings of round 3 on larger tables asked for."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceforge.functions import kernels as k
from traceforge.operators import experiments as ex
from traceforge.operators import genotype as gt
from traceforge.plans import registry
from traceforge.plans import views as v
from traceforge.schema import WELL
from traceforge.sources import folders, npz


def test_fits_solve_small_systems_and_find_the_bells(monkeypatch):
    x = np.arange(1200.0)
    want = np.array([(50.0 + i % 7, 10.0 + 12 * i, 1.5 + i % 3) for i in range(98)])
    y = (want[:, 0] * np.exp(-0.5 * ((x[:, None] - want[:, 1]) / want[:, 2]) ** 2)).sum(axis=1)
    sizes, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    got = k.fit_gaussians(x, y, want * [0.9, 1.0, 1.1])
    assert max(sizes) < 3 * len(want) / 2 and np.allclose(got, want, rtol=1e-4)


def test_rows_of_a_forest_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x)

    d = spark.range(120).repartition(40).select(F.lit(1).alias("plate"), F.col("id").alias("well"), F.lit("c1").alias("channel"), F.col("id").alias("scan"), watched("id").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    gt.train_forest(d, ["a"], "label", 3, 3, 1)
    assert seen.value == 120
    gt.peak_forest(d, "label", ("a",), 3, 2)
    assert seen.value == 240


def test_windows_are_written_without_being_dealt_again(spark):
    rows = [(f"v{i % 5}", "w", i, i % 5, 1.0, *[[float(i)] * 3] * 4) for i in range(60)]
    schema = "variant string, well string, position long, label long, quality double, x_c1 array<double>, x_c2 array<double>, x_c3 array<double>, x_c4 array<double>"
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(x):
        seen.add(1)
        return x

    path = folders.work_folder(spark, "npz")
    npz.write_npz(spark.createDataFrame(rows, schema).withColumn("variant", watched("variant")), path, rows_per_file=7)
    assert seen.value == 60
    for variants in (None, [npz.MERGED]):
        back = npz.read_npz(spark, path, variants)
        assert sorted(r["position"] for r in back.collect()) == list(range(60)) and all(r["n"] <= 7 for r in back.groupBy("file").agg(F.count("*").alias("n")).collect())
        assert back.where("variant <> concat('v', position % 5)").count() == 0


def test_no_frame_is_gone_through_again_for_every_scan(spark, sf):
    plan = registry.queries()["is_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower()


def test_walks_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"plate": 1, "well": np.repeat([1, 2], 60), "scan": np.concatenate([np.sort(rng.choice(500, 60, False)) for _ in range(2)]).astype(float), "score": rng.integers(1, 9, 120).astype(float)})
    got = gt.walk_spacing(spark.createDataFrame(d), [100.0, 120.0, 100.0]).toPandas()
    for well, p in d.groupby("well"):
        p, best, best_total = p.reset_index(drop=True), [], -np.inf
        for a in p.sort_values(["score", "scan"], ascending=[False, True]).head(20).sort_values("scan").index:
            path, total = [a], p.at[a, "score"]
            for gap in (100, 120, 100):
                near = p[(p["scan"] - p.at[path[-1], "scan"] - gap).abs() <= 30]
                if not len(near):
                    break
                j = near["score"].idxmax()
                total += p.at[j, "score"] - 0.01 * abs(p.at[j, "scan"] - p.at[path[-1], "scan"] - gap)
                path.append(j)
            if len(path) >= 2.8 and total > best_total:
                best, best_total = path, total
        assert got[got["well"] == well].sort_values("idx")["scan"].tolist() == p.loc[best, "scan"].tolist()


@pytest.mark.parametrize("name, most", [("matched_windows", 6), ("mobility_search", 4), ("peak_edits_overlay", 6)])
def test_joins_by_well_and_scan_deal_no_samples_again(spark, sf, name, most):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(plate") <= most and "scan#" not in "".join(x.split("), ")[0] for x in plan.split("Exchange hashpartitioning(")[1:])


def test_parts_of_the_traces_follow_their_table(spark, sf):
    assert v.trace(spark, sf).rdd.getNumPartitions() == v.PARTS_PER_SPLIT * v.table(spark, sf, "lineitem").rdd.getNumPartitions()


def test_the_sample_of_repeats_chooses_a_path_and_no_result(spark, monkeypatch):
    from traceforge.llm import repeats as rp

    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([f"a{i}", *words[i % 3 : 40 + i % 3], *[f"u{i}x{j}" for j in range(25)]])) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = []
    for share in (0.0, 2.0):  # every anchor hot, none hot
        monkeypatch.setattr(rp, "HOT_SHARE", share)
        out.append(sorted((r["doc_id"], r["text"]) for r in rp.without_repeats(docs, window=20).collect()))
    assert out[0] == out[1] and any(a != b for a, b in zip(out[0], sorted(texts)))


def test_grid_works_rows_out_once_and_in_any_order_alike(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(x):
        seen.add(1)
        return x

    watched = F.udf(watch, "long").asNondeterministic()
    noise = lambda i: F.pmod(F.xxhash64("well", F.lit(i)), F.lit(1000)) / 1000
    rows = spark.range(240).repartition(6).select(F.lit(1).alias("plate"), F.col("id").alias("well"), watched(F.pmod("id", F.lit(3))).alias("label"))
    rows = rows.select("*", (F.pmod("well", F.lit(3)) + noise(1)).alias("a"), noise(2).alias("b"), F.when(F.col("well") % 9 > 0, noise(3)).alias("c"))
    forests = [ex.Config(f"forest_{d}", "forest", ("a", "b", "c"), {"numTrees": 5, "maxDepth": d}) for d in (2, 5)]
    configs = [*forests, ex.Config("logistic", "logistic", ("b", "c"), {"maxIter": 3})]
    one = ex.run_grid(rows, "label", WELL, configs).collect()
    assert seen.value == 240 and [r["config"] for r in one] == [c.name for c in configs] and {r["test_rows"] for r in one} < set(range(30, 90))
    assert ex.run_grid(rows.orderBy(F.desc("well")).repartition(5), "label", WELL, configs[::-1]).collect()[::-1] == one
    with pytest.raises(ValueError, match="no rows in folds"):
        ex.run_grid(rows.limit(2), "label", WELL, configs)


def test_moments_are_compiled_and_percentiles_are_sparks(spark):
    rows = [("p" if w else None, w if w < 3 else None, s, None if w == 1 and s % 4 == 0 else float((s * 37 + w) % 101) - 50, None if w == 2 else float(s % 7)) for w in range(4) for s in range(60 + w)]
    d = spark.createDataFrame([*rows, ("q", 9, 0, 4.0, -1.5)], "plate string, well long, scan long, c1 double, c2 double")
    got = gt.trace_stats(d, ["c1", "c2"], [F.min("scan").alias("low")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "kurtosis" in plan and all("kurtosis" not in line for line in plan.splitlines() if "ObjectHashAggregate" in line)
    want = d.groupBy("plate", "well").agg(F.count("*").alias("n"), *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in ("c1", "c2")])
    want = {(r["plate"], r["well"]): (r["n"], *[tuple(r[c] or [None] * 3) for c in ("c1", "c2")]) for r in want.collect()}
    found = got.collect()
    assert {(r["plate"], r["well"]): (r["n_scans"], *[tuple(r[f"{c}_{q}"] for q in ("p25", "median", "p75")) for c in ("c1", "c2")]) for r in found} == want
    assert len(found) == 5 and {r["low"] for r in found} == {0}
