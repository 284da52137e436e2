"""Writers: tables, metadata, bundles, reports and runs (K1-K4, K6-K9, K12), and samples kept apart from each other's faults (B1, B2)."""

from __future__ import annotations

import json
import math
import traceback
from collections.abc import Callable
from datetime import date, datetime
from pathlib import PurePath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _fs


def json_safe(value):
    """K2: a value that JSON takes: numbers that aren't finite become null, arrays lists, keys text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return json_safe(value.tolist())
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.generic):
        return json_safe(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, PurePath):
        return str(value)
    return json_safe(vars(value)) if hasattr(value, "__dict__") else str(value)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, written whole and then renamed, on any file system that Spark writes."""
    fs, target = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't write {path}")
    return path


def write_json(spark: SparkSession, path: str, value) -> str:
    """K2: metadata or provenance."""
    return write_text(spark, path, json.dumps(json_safe(value), indent=2, ensure_ascii=False) + "\n")


def write_config(spark: SparkSession, path: str, config: dict) -> str:
    """K9: a run's configuration, as JSON, which YAML readers take, too."""
    return write_json(spark, path, config)


def write_table(rows: DataFrame, path: str, single: bool = True) -> str:
    """A CSV folder with a header; ``single`` puts a report's rows in one file. Arrays are joined by semicolons."""
    flat = rows.select(*(F.concat_ws(";", c).alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in rows.dtypes))
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return path


def write_bundle(tables: dict[str, DataFrame], folder: str, metadata: dict | None = None) -> str:
    """K3: tables as Parquet in one folder, the mark of success last, so a broken write is never read. An old bundle is replaced."""
    spark = next(iter(tables.values())).sparkSession
    fs, mark = _fs(spark, f"{folder}/_BUNDLE")
    fs.delete(mark, False)
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    write_json(spark, f"{folder}/_BUNDLE", {"tables": sorted(tables), "metadata": metadata or {}})
    return folder


def write_fasta(records: DataFrame, path: str) -> str:
    """K7: ``header`` and ``residues`` as two lines a record."""
    records.select(F.concat_ws("\n", "header", "residues").alias("value")).write.mode("overwrite").text(path)
    return path


def report(metrics: dict) -> str:
    """K6: what a sample's results say, and which of them there are."""
    spatial = metrics.get("spatial_qc_status", "PASS") == "PASS"
    lines = [f"Sample: {metrics.get('sample')}", f"Spots: {metrics.get('n_spots')}", "Expression results: available", f"Spatial results: {'available' if spatial else 'not available, coordinates are missing or not finite'}"]
    if spatial:
        lines += [f"Regime: {metrics.get('regime_label')} ({metrics.get('public_transition_pattern')})", f"Interface: {100 * (metrics.get('interface_fraction') or 0):.1f} % of the spots", f"Diffuse transition: {100 * (metrics.get('diffuse_fraction') or 0):.1f} % of the spots"]
    return "\n".join([*lines, f"Quality: {metrics.get('qc_flag', 'PASS')} {metrics.get('qc_notes', '')}".rstrip()]) + "\n"


def new_run(spark: SparkSession, root: str, label: str = "run", now: datetime | None = None) -> str:
    """A folder named by the time; one that exists gets a number."""
    base = f"{root.rstrip('/')}/{label}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    fs, _ = _fs(spark, root)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    path, n = base, 1
    while fs.exists(at(path)):
        n += 1
        path = f"{base}_{n}"
    fs.mkdirs(at(path))
    return path


def export_run(spark: SparkSession, run: str, target: str) -> str:
    """K8: a copy of a run's folder. A target that exists or lies in the run is an error; an existing folder takes the copy inside."""
    fs, source = _fs(spark, run)
    to_fs, to = _fs(spark, target)
    if not fs.exists(source) or not fs.getFileStatus(source).isDirectory():
        raise ValueError(f"no run in {run}")
    plain = lambda fs, p: fs.makeQualified(p).toString().rstrip("/")
    if to_fs.exists(to) and to_fs.getFileStatus(to).isDirectory():
        to = spark._jvm.org.apache.hadoop.fs.Path(to, source.getName())
    if (plain(to_fs, to) + "/").startswith(plain(fs, source) + "/"):
        raise ValueError("a run isn't exported into itself")
    if to_fs.exists(to):
        raise FileExistsError(plain(to_fs, to))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, spark._jsc.hadoopConfiguration())
    return plain(to_fs, to)


def zip_run(spark: SparkSession, run: str, target: str) -> str:
    """K8: a run's files in one ZIP outside of it; files pass through the driver one after another, in parts of 4 MiB."""
    import tempfile
    import zipfile

    fs, source = _fs(spark, run)
    root = fs.makeQualified(source).toString().rstrip("/")
    target = target if target.lower().endswith(".zip") else target + ".zip"
    to_fs, to = _fs(spark, target)
    if to_fs.makeQualified(to).toString().startswith(root + "/"):
        raise ValueError("the ZIP of a run lies outside of it")
    if not fs.exists(source):
        raise ValueError(f"no run in {run}")
    with tempfile.NamedTemporaryFile(suffix=".zip") as local:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            files = fs.listFiles(source, True)
            while files.hasNext():
                p = files.next().getPath()
                stream = fs.open(p)
                with z.open(f"{source.getName()}/{p.toString()[len(root) + 1 :]}", "w") as out:
                    while part := bytes(stream.readNBytes(1 << 22)):
                        out.write(part)
                stream.close()
        local.flush()
        to_fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local.name}"), to)
    return target


def run_samples(spark: SparkSession, samples: list[dict], work: Callable[[dict], dict], go_on: bool = True, stop: Callable[[], bool] = lambda: False) -> list[dict]:
    """The outcome of each sample in turn, its own error in its row. Without ``go_on`` the first error ends the batch;
    ``stop`` is asked between samples. A sample's jobs share a group, so they can be cancelled together."""
    out = []
    for given in samples:
        if stop():
            out.append(given | {"status": "cancelled"})
            continue
        spark.sparkContext.setJobGroup(f"sample-{given.get('sample')}", str(given.get("sample")), True)
        try:
            out.append(given | {"status": "ok"} | (work(given) or {}))
        except Exception as e:  # the batch's contract: a sample's fault is a row
            out.append(given | {"status": f"error: {e}", "trace": traceback.format_exc(limit=3)})
            if not go_on:
                break
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out
