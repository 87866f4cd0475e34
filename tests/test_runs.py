"""Whole runs on made traces whose results are known."""

import numpy as np
import pytest

from traceforge.operators import runs

TRACE = "plate string, well string, scan long, c1 double, c2 double, c3 double, c4 double, current double"


def bell(x, at, height, width=3.0):
    return height * np.exp(-0.5 * ((x - at) / width) ** 2)


def frame(spark, wells):
    return spark.createDataFrame([("p", w, int(i), *map(float, r), 1.0) for w, y in wells.items() for i, r in enumerate(y)], TRACE)


def test_duplex_wells(spark):
    x, z = np.arange(600), np.zeros(600)
    two = np.stack([z, bell(x, 200, 300) + bell(x, 250, 200), bell(x, 300, 500), z], axis=1)
    got = runs.duplex_wells(frame(spark, {"A01": two, "A02": np.zeros((600, 4))}), 100, 500).toPandas().set_index("well")
    a = got.loc["A01"]
    assert a["n_peaks"] == 2 and a["mf"] == pytest.approx(0.4, abs=0.01) and a["status"] == "partial"
    assert list(a["scans"]) == pytest.approx([200, 250], abs=0.5)
    assert a["standard_area"] == pytest.approx(500 * 3 * np.sqrt(2 * np.pi), rel=0.05)
    assert a["norm_areas"][0] == pytest.approx(0.6, rel=0.1)
    b = got.loc["A02"]
    assert (b["n_peaks"], b["mf"], b["status"], b["standard_area"], list(b["norm_areas"])) == (0, 0.0, "no peaks", 0.0, [])


def test_compact_features(spark):
    x = np.arange(120)
    y = np.stack([bell(x, 40, 1000), np.where(x < 30, 5.0, 20.0), x.astype(float), np.zeros(120)], axis=1)
    trace = frame(spark, {"A01": y, "A02": y})
    at = spark.createDataFrame([("p", "A01", 20), ("p", "A01", 50), ("p", "A02", 50)], "plate string, well string, scan long")
    got = runs.compact_features(trace, at).toPandas().set_index("well")
    a = got.loc["A01"]
    assert len(got.columns) - 1 == 32
    assert (a["c1_n_peaks"], a["c1_max_peak_scan"], a["c1_max_peak_height"], a["c2_n_peaks"]) == (1, 40, 1000, 0)
    assert (a["is_n"], a["is_spread"], a["is_mean_height"], a["is_1_scan"], a["is_2_height"], a["is_3_scan"]) == (2, 30, 35, 20, 50, 0)
    assert (a["is_ratio_mean"], a["is_ratio_min"], a["c2_min"], a["c3_mean"]) == (2.5, 2.5, 5, 59.5)
    assert got.loc["A02"]["is_n"] == 0 and got.loc["A02"]["is_ratio_mean"] == 0
