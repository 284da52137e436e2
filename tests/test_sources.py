"""Round trips of readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spotfield.sources import files, sinks


@pytest.fixture
def mex(tmp_path):
    def make(transposed=False, packed=False, prefix="", name="one"):
        folder = tmp_path / name
        (folder / "spatial").mkdir(parents=True)
        entries = [(1, 1, 5), (3, 1, 2), (2, 2, 7)]  # gene, barcode, value
        lines = ["%%MatrixMarket matrix coordinate integer general", "% made", "2 3 3" if transposed else "3 2 3", *(f"{b} {g} {v}" if transposed else f"{g} {b} {v}" for g, b, v in entries)]
        write = lambda n, text: (gzip.open(folder / f"{n}.gz", "wt") if packed else open(folder / n, "w")).write(text)
        for n, text in ((f"{prefix}matrix.mtx", "\n".join(lines) + "\n"), (f"{prefix}features.tsv", "E1\tGa\tx\nE2\tGb\tx\nE3\tGa\tx\n"), (f"{prefix}barcodes.tsv", "AA-1\nBB-1\n")):
            f = gzip.open(folder / f"{n}.gz", "wt") if packed else open(folder / n, "w")
            f.write(text)
            f.close()
        return folder

    return make


@pytest.mark.parametrize("transposed,packed,prefix", [(False, False, ""), (True, False, ""), (False, True, ""), (False, False, "GSM1_")])
def test_matrix_folder(spark, mex, transposed, packed, prefix):
    folder = mex(transposed, packed, prefix)
    (folder / "spatial" / "tissue_positions_list.csv").write_text("AA-1,1,0,2,10.5,20\nBB-1,0,1,1,11,21\n")
    spots, genes, expr, found = files.read_mex(spark, f"file://{folder}", "s")
    assert {(r["spot"], r["gene_idx"], r["gene"], r["value"]) for r in expr.collect()} == {(0, 0, "Ga", 5.0), (0, 2, "Ga", 2.0), (1, 1, "Gb", 7.0)}
    assert {(r["spot"], r["barcode"], r["x"], r["y"], r["in_tissue"]) for r in spots.collect()} == {(0, "AA-1", 20.0, 10.5, 1), (1, "BB-1", 21.0, 11.0, 0)}
    assert genes.count() == 3 and not found.warnings
    head = files.preflight(spark, f"file://{folder}", warn_gb=1e-9)
    assert sorted(head["shape"]) == [2, 3] and head["stored_values"] == 3 and head["dense64_bytes"] == 48 and head["exceeds"]


def test_matrix_folder_faults(spark, mex, tmp_path):
    folder = mex()
    assert files.mex_files(spark, f"file://{folder}").warnings == ["no table of positions: scores only, without space"]
    assert [f.rpartition("/")[2] for f in files.mex_folders(spark, f"file://{tmp_path}")] == ["one"]
    (folder / "matrix.mtx.gz").write_bytes(gzip.compress((folder / "matrix.mtx").read_bytes()))
    assert any("equal files" in w for w in files.mex_files(spark, f"file://{folder}").warnings)
    (folder / "barcodes.tsv").write_text("AA-1\nBB-1\nCC-1\nDD-1\n")
    with pytest.raises(ValueError, match="fits neither"):
        files.read_mex(spark, f"file://{folder}", "s")
    (folder / "barcodes.tsv").unlink()
    with pytest.raises(ValueError, match="needs"):
        files.mex_files(spark, f"file://{folder}")
    for n in ("a_barcodes.tsv", "b_barcodes.tsv"):
        (folder / n).write_text("x\n")
    with pytest.raises(ValueError, match="several"):
        files.mex_files(spark, f"file://{folder}")


def test_positions_and_candidates(spark, tmp_path):
    good = tmp_path / "tissue_positions.csv"
    good.write_text("barcode,in_tissue,array_row,array_col\n AA ,1,0,2\nBB,0,1,1\n")
    assert {(r["barcode"], r["x"], r["y"]) for r in files.read_positions(spark, f"file://{good}").collect()} == {("AA", 2.0, 0.0), ("BB", 1.0, 1.0)}
    for text in ("barcode,in_tissue,array_row,array_col\nAA,1,0,2\nAA,1,0,3\n", "barcode,in_tissue,array_row,array_col\n ,1,0,2\n", "barcode,in_tissue,array_row,array_col\nAA,1,z,2\n", "barcode,in_tissue\nAA,1\n"):
        good.write_text(text)
        with pytest.raises(ValueError):
            files.read_positions(spark, f"file://{good}")
    table = tmp_path / "c.csv"
    table.write_text("gene,candidate_score\nEGFR,2.5\nMET,high\n")
    assert [r["candidate_score"] for r in files.read_candidates(spark, f"file://{table}").orderBy("gene").collect()] == [2.5, None]
    with pytest.raises(ValueError, match="ligand"):
        files.read_candidates(spark, f"file://{table}", ("ligand", "receptor"))


def test_manifest_config_and_names(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("﻿sample,path,c_q\na,/x.h5ad,0.7\nb,/y.h5ad,\n", encoding="utf-8")
    assert files.read_manifest(spark, f"file://{m}") == [{"sample": "a", "path": "/x.h5ad", "c_q": "0.7"}, {"sample": "b", "path": "/y.h5ad", "c_q": None}]
    m.write_text("sample\na\n")
    with pytest.raises(ValueError, match="path"):
        files.read_manifest(spark, f"file://{m}")
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert files.merged(base, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4} and base["a"]["b"] == 1
    (tmp_path / "c.json").write_text('{"a": {"c": 5}}')
    assert files.read_config(spark, f"file://{tmp_path}/c.json", base)["a"] == {"b": 1, "c": 5}
    assert files.sample_name("/x/y/ab:c.h5ad") == "ab_c" and files.sample_name("z.csv.gz") == "z"
    (tmp_path / "sub").mkdir()
    for n in ("B.h5ad", "a.H5AD", "sub/c.h5ad", "d.txt"):
        (tmp_path / n).write_text("")
    assert [f.rpartition("/")[2] for f in files.discover(spark, f"file://{tmp_path}")] == ["a.H5AD", "B.h5ad", "c.h5ad"]
    (tmp_path / "scalefactors_json.json").write_text('{"spot_diameter_fullres": 89.5}')
    assert files.read_scalefactors(spark, f"file://{tmp_path}/scalefactors_json.json") == {"spot_diameter_fullres": 89.5}


def test_hdf5_needs_its_module_and_name(spark, tmp_path):
    with pytest.raises(ValueError, match="h5ad"):
        files.read_h5(spark, "x.csv", "s")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError, match="h5py"):
            files.read_h5(spark, "x.h5ad", "s")
    import numpy as np

    major, minor, value = files.compressed_entries(np.array([2, 4, 4, 5]), np.array([0, 3, 1]), np.array([7, 8, 9]), 10)
    assert major.tolist() == [10, 10, 12] and minor.tolist() == [0, 3, 1] and value.tolist() == [7, 8, 9]


def test_bundle_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 0.5, ["a", "b"]), ("s", 2, None, [])], "sample string, spot long, c double, genes array<string>")
    folder = f"file://{tmp_path}/bundle"
    with pytest.raises(ValueError, match="bundle"):
        files.read_bundle(spark, folder)
    sinks.write_bundle({"spots": rows, "other": rows.limit(1)}, folder, {"x": float("nan")})
    back = files.read_bundle(spark, folder)
    assert sorted(back) == ["other", "spots"] and sorted(back["spots"].collect(), key=str) == sorted(rows.collect(), key=str)
    assert json.loads((tmp_path / "bundle" / "_BUNDLE").read_text())["metadata"] == {"x": None}
    sinks.write_table(rows, f"file://{tmp_path}/t")
    read = spark.read.csv(f"file://{tmp_path}/t", header=True).orderBy("spot").collect()
    assert read[0]["genes"] == "a;b" and len(list((tmp_path / "t").glob("*.csv"))) == 1
    records = spark.createDataFrame([(">a", "MK"), (">b", "ML")], "header string, residues string")
    sinks.write_fasta(records, f"file://{tmp_path}/fasta")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/fasta").collect()) == [">a", ">b", "MK", "ML"]


def test_json_report_and_export(spark, tmp_path):
    import datetime
    import zipfile

    import numpy as np

    assert sinks.json_safe({1: np.float64("inf"), "a": {2, 1}, "b": np.arange(2), "c": datetime.date(2020, 1, 2), "d": (True, None)}) == {"1": None, "a": [1, 2], "b": [0, 1], "c": "2020-01-02", "d": [True, None]}
    said = sinks.report({"sample": "s", "n_spots": 4, "spatial_qc_status": "FAIL", "qc_flag": "FAIL", "qc_notes": "spatial_fail"})
    assert "Spatial results: not available" in said and "Regime" not in said and "FAIL spatial_fail" in said
    assert "Regime: Type A" in sinks.report({"sample": "s", "n_spots": 4, "regime_label": "Type A"})
    at = datetime.datetime(2020, 1, 2, 3, 4, 5)
    one, two = (sinks.new_run(spark, f"file://{tmp_path}/runs", now=at) for _ in range(2))
    assert one.endswith("run_20200102_030405") and two.endswith("run_20200102_030405_2")
    sinks.write_json(spark, f"{one}/meta.json", {"a": 1})
    sinks.write_json(spark, f"{one}/meta.json", {"a": 2})
    copy = sinks.export_run(spark, one, f"file://{tmp_path}/out")
    assert json.loads((tmp_path / "out" / "meta.json").read_text()) == {"a": 2} and copy.endswith("/out")
    with pytest.raises(ValueError, match="itself"):
        sinks.export_run(spark, one, f"{one}/inside")
    (tmp_path / "taken").write_text("")
    with pytest.raises(FileExistsError):
        sinks.export_run(spark, one, f"file://{tmp_path}/taken")
    packed = sinks.zip_run(spark, one, f"file://{tmp_path}/packed")
    assert zipfile.ZipFile(packed.removeprefix("file://")).namelist() == ["run_20200102_030405/meta.json"]
    with pytest.raises(ValueError, match="outside"):
        sinks.zip_run(spark, one, f"{one}/x.zip")


def test_a_samples_fault_stays_its_own(spark):
    def work(given):
        return {"rows": spark.range(10 // given["n"]).count()}

    samples = [{"sample": "a", "n": 1}, {"sample": "b", "n": 0}, {"sample": "c", "n": 5}]
    got = sinks.run_samples(spark, samples, work)
    assert [r["status"][:5] for r in got] == ["ok", "error", "ok"] and got[2]["rows"] == 2
    assert len(sinks.run_samples(spark, samples, work, go_on=False)) == 2
    assert [r["status"] for r in sinks.run_samples(spark, samples, work, stop=lambda: True)] == ["cancelled"] * 3
