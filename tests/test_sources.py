"""Binary and text sources round trip; damaged files say so; sinks write what was asked for."""

import json

import numpy as np
import pytest

from traceforge.sources import rsd, sinks
from traceforge.sources import tables as tb
from traceforge.streaming import ingest


@pytest.fixture
def plate(tmp_path):
    folder = tmp_path / "OY_GENE_Run1"
    folder.mkdir()
    rec = np.arange(60).reshape(12, 5)
    (folder / "A01.rsd").write_bytes(rsd.write_trace(rec, {"SAMPLE NAME": "x1"}))
    (folder / "A02.rsd").write_bytes(b"\x01")
    (folder / "B01.txt").write_text("Instrument: z9\nfree line\nScan Channel1 Channel2 Channel3 Channel4 Current\n0 1 2 3 4 5\n1 a 2 3 4 5\n\n")
    return tmp_path


def test_binary_traces(spark, plate):
    d = rsd.read_traces(spark, str(plate)).toPandas()
    good = d[d["_corrupt"].isna()].sort_values("scan")
    assert len(good) == 12 and good["current"].tolist() == [5 * i for i in range(12)] and set(good["well"]) == {"A01"} and set(good["plate"]) == {"OY_GENE_Run1"}
    assert d[d["_corrupt"].notna()]["well"].tolist() == ["A02"]
    assert rsd.read_headers(spark, str(plate)).where("well = 'A01'").first()["header"]["SAMPLE NAME"] == "x1"


def test_header_keys_channels_and_binary_values():
    tag = lambda s: b"\x05" + bytes([len(s) + 1]) + s.encode() + b"\0"
    parts = ["BAR CODE", "77", "PLATE ID", "NAME", "n", "CHANNEL1", "BASE", "T", "DYE", "ROX", "FILTER", "610", "CHANNEL2", "DYE", "FAM", "COMMENT", "", "other", "WELL ID"]
    raw = b"\0" * 40 + b"".join(tag(p) for p in parts[:2]) + b"\x01\x02\x03" + b"".join(tag(p) for p in parts[2:])
    want = {"BAR CODE": "77", "PLATE ID": "", "NAME": "n", "CHANNEL1_DYE": "ROX", "CHANNEL1_FILTER": "610", "CHANNEL2_DYE": "FAM", "COMMENT": "", "WELL ID": ""}
    assert rsd.trace_header(raw) == want
    assert rsd.trace_header(b"\0" * 40) == {}


def test_base_file_sequences_of_both_types():
    seq = "acgtn" * 24
    short, one = b"SEQUENCE\0\x06\x05\x00ACGTA", b"SEQUENCE\0\x05" + bytes([len(seq)]) + seq.encode()
    numbers = b"BASES POSITIONS\0\x09\x08\x00" + np.array([150, 160], "<u4").tobytes()
    got = rsd.base_file(short + one + numbers + b"DYE SET\0\x05\x03ET\0")
    assert got["sequence"] == seq.upper() and got["BASES POSITIONS"] == [150, 160] and got["meta"] == {"DYE SET": "ET"}
    assert rsd.base_file(short)["sequence"] is None


def test_both_boundaries():
    rec = np.full((4, 5), 7)
    raw = rsd.write_trace(rec, {})
    assert len(rsd.trace_records(raw, "anchor")) == 4 and len(rsd.trace_records(raw)) == 4
    rec[2, 1] = 200001
    assert len(rsd.trace_records(rsd.write_trace(rec, {}))) == 2
    assert len(rsd.trace_records(b"")) == 0


def test_text_traces(spark, plate):
    d = rsd.read_text_traces(spark, str(plate)).orderBy("scan").toPandas()
    assert d["scan"].tolist() == [0, 1] and np.isnan(d["channel1"][1])
    assert rsd.read_text_traces(spark, str(plate), legacy=True).orderBy("scan").toPandas()["channel1"].tolist() == [1, 0]
    h = rsd.read_text_headers(spark, str(plate)).first()
    assert h["header"] == {"Instrument": "z9"} and h["info"] == ["free line"]
    both = rsd.preferred(rsd.read_traces(spark, str(plate)), rsd.read_text_traces(spark, str(plate)))
    assert sorted(r["well"] for r in both.select("well").distinct().collect()) == ["A01", "B01"]


def test_base_files(spark, tmp_path):
    seq = "ACGTN" * 30
    folder = tmp_path / "plate1" / "callerA"
    folder.mkdir(parents=True)
    (folder / "A01.esd").write_bytes(rsd.write_base_file(seq, {"PEAK POSITIONS": list(range(200, 350)), "QUALITY SCORES": [20.0] * 150}, {"CHEMISTRY": "ET"}))
    r = rsd.read_base_files(spark, str(tmp_path)).first()
    assert (r["plate"], r["caller"], r["well"], r["sequence"]) == ("plate1", "callerA", "A01", seq)
    assert r["positions"][:2] == [200, 201] and r["quality"][0] == 20.0 and r["meta"] == {"CHEMISTRY": "ET"} and r["_corrupt"] is None


def test_standard_tables_of_both_layouts(spark, tmp_path):
    (tmp_path / "sparse.csv").write_text("folder,well,is_peak_1_scan,is_peak_2_scan\nf,A01,,30.0\nf,A01,20.0,\n")
    (tmp_path / "dense.csv").write_text("folder,well,is_peak_1_scan,is_peak_2_scan,is_peak_1_height\nf,A01,20,30,0.0\n")
    rows = [[tuple(r) for r in tb.read_standard_peaks(spark, str(tmp_path / n)).orderBy("is_idx").collect()] for n in ("sparse.csv", "dense.csv")]
    assert rows[0] == rows[1] == [("f", "A01", 1, 20), ("f", "A01", 2, 30)]


def test_references_and_truth(spark, tmp_path):
    plates = spark.createDataFrame([("OY_IL10_N2",), ("OY_NONE",)], "plate string")
    got = tb.references_for(plates, tb.reference_positions(spark)).orderBy("ref_idx").collect()
    assert [r["ref_scan"] for r in got] == [1848, 2039, 2617, 2988]
    (tmp_path / "r.json").write_text(json.dumps({"G": [1, 2]}))
    new = tb.reference_positions(spark, str(tmp_path / "r.json"))
    assert sinks.upserted_references(tb.reference_positions(spark), new).where("gene = 'G'").count() == 2
    (tmp_path / "t.csv").write_text("OY_P1\nA01,1,A02,x\n" + "\n" * 11 + "OY_P2\nB01,4.0\n")
    assert sorted(tuple(r) for r in tb.read_truth(spark, str(tmp_path / "t.csv")).collect()) == [("OY_P1", "A01", 1), ("OY_P2", "B01", 4)]


def test_result_file_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("A01", 2, 0.25, "partial", [10.0, 20.0], [1.5, 2.25])], "well string, n_peaks int, mf double, status string, scans array<double>, areas array<double>")
    lines = [r["value"] for r in sinks.plate_lines(d, "T1", "r", "GOOD", 10, 7.0, 7.0, 3.7).collect()]
    assert lines[3].startswith("A01,2,0.2500,partial,10") and lines[0].startswith("# Plate")
    (tmp_path / "T1.csv").write_text("\n".join(lines))
    r = tb.read_plate_results(spark, str(tmp_path / "T1.csv")).first()
    assert (r["plate"], r["n_peaks"], r["areas"]) == ("T1", 2, [1.5, 2.25])


def test_streamed_traces_land_once(spark, plate, tmp_path):
    for _ in range(2):
        ingest.land(ingest.dropped_traces(spark, str(plate)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12


def test_stream_sessions(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 04:00:00"), (9, "2024-01-09 00:00:00")], "user_id long, t string").selectExpr("user_id", "timestamp(t) AS ts")
    ev.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    q = ingest.gap_groups(s, "user_id", "ts", "2 hours", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["n_events"]) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2)]
