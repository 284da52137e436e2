"""Readers of the file formats that samples come in (S1-S12). Data goes through Spark's readers; only names and headers through the
driver. Paths are those of any file system that Spark reads; HDF5 files need a mounted one and the optional module ``h5py``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File names and columns of the formats.
MATRIX, FEATURES, BARCODES = ("matrix.mtx", "matrix.mtx.gz"), ("features.tsv", "features.tsv.gz", "genes.tsv", "genes.tsv.gz"), ("barcodes.tsv", "barcodes.tsv.gz")
POSITIONS = ("tissue_positions.csv", "tissue_positions.csv.gz", "tissue_positions_list.csv", "tissue_positions_list.csv.gz")
POSITION_COLUMNS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name -> path of the files right in a folder; empty where there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p) if s.isFile()}


def discover(spark: SparkSession, folder: str, suffix: str = ".h5ad") -> list[str]:
    """All files under a folder with a suffix, letter case aside, ordered by path without case. Only names are read."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        raise ValueError(f"no folder {folder}")
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.lower().endswith(suffix.lower()):
            found.append(name)
    return sorted(found, key=str.lower)


@dataclass
class Found:
    """What a resolver found: a path by role, with warnings."""

    paths: dict[str, str | None] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def resolve(spark: SparkSession, folder: str, role: str, names: tuple[str, ...], into: Found) -> str | None:
    """The file of a role: by its exact name, else the only one that ends in ``_name``, here or in ``spatial``. A packed twin
    gives way to the plain file with a warning; several different files are an error."""
    places = [listed(spark, folder), listed(spark, f"{folder}/spatial")]
    plain = lambda n: n.lower().removesuffix(".gz")
    exact = [(x, p[x]) for n in names for p in places for x in p if x == n]
    loose = [(x, path) for p in places for x, path in p.items() if any(x.lower().endswith("_" + n.lower()) for n in names)]
    chosen = [c for c in exact if plain(c[0]) == plain(exact[0][0])] if exact else loose
    if len({plain(x) for x, _ in chosen}) > 1:
        raise ValueError(f"several files for {role}: {', '.join(sorted(x for x, _ in chosen))}")
    chosen.sort(key=lambda c: (c[0].lower().endswith(".gz"), c[1].lower()))
    if len(chosen) > 1:
        into.warnings.append(f"{role}: several equal files, {chosen[0][0]} is read")
    into.paths[role] = chosen[0][1] if chosen else None
    return into.paths[role]


def mex_files(spark: SparkSession, folder: str) -> Found:
    """Matrix, features and barcodes of a folder, and positions if there are any."""
    found = Found()
    for role, names in (("matrix", MATRIX), ("features", FEATURES), ("barcodes", BARCODES)):
        if not resolve(spark, folder, role, names, found):
            raise ValueError(f"{folder}: a matrix folder needs matrix.mtx, barcodes.tsv and features.tsv or genes.tsv, each plain or packed")
    if not resolve(spark, folder, "positions", POSITIONS, found):
        found.warnings.append("no table of positions: scores only, without space")
    return found


def mex_folders(spark: SparkSession, root: str) -> list[str]:
    """All folders under ``root`` that hold a whole matrix, ordered by path without case."""
    by: dict[str, set[str]] = {}
    for path in discover(spark, root, ""):
        folder, _, name = path.rpartition("/")
        by.setdefault(folder, set()).add(name)
    return sorted((f for f, n in by.items() if all(n & set(names) for names in (MATRIX, FEATURES, BARCODES))), key=str.lower)


def _lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(idx, column): the lines of a small table by their order, which is that of one unsplit file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", column))
    return rows.select(F.col("idx").cast("long"), column)


def mex_header(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and entries of a coordinate matrix, from its first lines."""
    first = [r["value"] for r in spark.read.text(path).where("not value like '\\%%' and trim(value) <> ''").limit(1).collect()]
    if not first or len(first[0].split()) != 3:
        raise ValueError(f"{path}: no line with the matrix's size")
    return tuple(int(x) for x in first[0].split())


def read_mex(spark: SparkSession, folder: str, sample: str) -> tuple[DataFrame, DataFrame, DataFrame, Found]:
    """(spots (sample, spot, barcode, coordinates), genes (sample, gene_idx, gene_id, gene), expr (sample, spot, gene_idx, gene,
    value), what was found). Rows are genes or barcodes, whichever fits the tables' lengths; neither is an error."""
    found = mex_files(spark, folder)
    features = _lines(spark, found.paths["features"], "line")
    parts = F.split("line", "\t")
    genes = features.select(F.lit(sample).alias("sample"), F.col("idx").alias("gene_idx"), F.trim(F.get(parts, F.lit(0))).alias("gene_id"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).alias("gene"))
    barcodes = _lines(spark, found.paths["barcodes"], "line").select(F.lit(sample).alias("sample"), F.col("idx").alias("spot"), F.trim(F.split("line", "\t")[0]).alias("barcode"))
    rows, columns, _ = mex_header(spark, found.paths["matrix"])
    n_genes, n_spots = genes.count(), barcodes.count()
    if (rows, columns) == (n_genes, n_spots):
        gene_at, spot_at = 0, 1
    elif (rows, columns) == (n_spots, n_genes):
        gene_at, spot_at = 1, 0
    else:
        raise ValueError(f"{folder}: a matrix of {rows} x {columns} fits neither {n_genes} genes nor {n_spots} barcodes")
    x = F.split(F.trim("value"), r"\s+")
    entries = spark.read.text(found.paths["matrix"]).where("not value like '\\%%' and trim(value) <> ''").select(x.alias("x")).where((F.size("x") == 3) & ~((F.col("x")[0] == str(rows)) & (F.col("x")[1] == str(columns)) & (F.col("x")[2] == str(mex_header(spark, found.paths["matrix"])[2]))))
    expr = entries.select((F.col("x")[gene_at].cast("long") - 1).alias("gene_idx"), (F.col("x")[spot_at].cast("long") - 1).alias("spot"), F.col("x")[2].cast("double").alias("value")).groupBy("spot", "gene_idx").agg(F.sum("value").alias("value")).where("value <> 0")
    expr = expr.join(genes.select("gene_idx", "gene"), "gene_idx").select(F.lit(sample).alias("sample"), "spot", "gene_idx", "gene", "value")
    spots = barcodes
    if found.paths["positions"]:
        spots = barcodes.join(read_positions(spark, found.paths["positions"]), "barcode", "left")
    return spots, genes, expr, found


def read_positions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(barcode, in_tissue, array_row, array_col, x, y): with a header or, in a ``tissue_positions_list``, without. x and y are the
    pixel column and row, else the array's. Blank or repeated barcodes and numbers that can't be read are errors if ``strict``."""
    header = "tissue_positions_list" not in path.rpartition("/")[2]
    raw = spark.read.csv(path, header=header, schema=None if header else ", ".join(f"{c} string" for c in POSITION_COLUMNS))
    lost = [c for c in POSITION_COLUMNS[:4] if c not in raw.columns]
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(F.trim("barcode").alias("barcode"), *(number(c).alias(c) for c in POSITION_COLUMNS[1:]))
    if strict:
        bad = rows.agg(F.count_if(F.coalesce(F.col("barcode"), F.lit("")) == "").alias("blank"), (F.count("barcode") - F.countDistinct("barcode")).alias("repeated"), F.count_if(F.col("in_tissue").isNull() | F.col("array_row").isNull() | F.col("array_col").isNull()).alias("unreadable")).first()
        if any(bad):
            raise ValueError(f"{path}: {bad['blank']} blank and {bad['repeated']} repeated barcodes, {bad['unreadable']} rows without numbers")
    x, y = F.coalesce("pxl_col_in_fullres", "array_col"), F.coalesce("pxl_row_in_fullres", "array_row")
    return rows.select("barcode", F.col("in_tissue").cast("int").alias("in_tissue"), F.col("array_row").cast("int").alias("array_row"), F.col("array_col").cast("int").alias("array_col"), x.alias("x"), y.alias("y"))


def read_scalefactors(spark: SparkSession, path: str) -> dict:
    """The numbers of a small JSON file, plain or packed."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and bytes of a folder's tissue images."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,png.gz}").load(folder).select("path", "length", "content")


def read_candidates(spark: SparkSession, path: str, needs: tuple[str, ...] = ("gene",)) -> DataFrame:
    """A table of candidate genes; without the needed columns it is an error. Scores that can't be read are missing."""
    rows = spark.read.csv(path, header=True)
    lost = [c for c in needs if c not in rows.columns]
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    return rows.withColumn("candidate_score", F.col("candidate_score").try_cast("double")) if "candidate_score" in rows.columns else rows


def read_manifest(spark: SparkSession, path: str, needs: tuple[str, ...] = ("sample", "path")) -> list[dict]:
    """The rows of a batch's manifest, a few hundred, as given; blank cells are None. A mark of the byte order is skipped."""
    text = spark.read.text(path, wholetext=True).first()["value"].removeprefix("\ufeff")
    rows = spark.read.csv(spark.sparkContext.parallelize(text.splitlines(), 1), header=True)
    lost = [c for c in needs if c not in rows.columns]
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    return [{k: (v or "").strip() or None for k, v in r.asDict().items()} for r in rows.collect()]


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, dictionaries within dictionaries, neither changed."""
    return {k: merged(base[k], over[k]) if k in over and isinstance(base.get(k), dict) and isinstance(over[k], dict) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def read_config(spark: SparkSession, path: str, base: dict | None = None) -> dict:
    """A JSON or YAML file laid over ``base``. YAML needs the optional module ``yaml``."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        own = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("configurations in YAML need the module yaml; JSON does without") from e
        own = yaml.safe_load(text) or {}
    if not isinstance(own, dict):
        raise ValueError(f"{path}: a configuration is a table of names and values")
    return merged(base or {}, own)


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ValueError("HDF5 files need the module h5py; matrix folders and bundles do without") from e
    return h5py


def compressed_entries(indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(major, minor, value) of a slice of a compressed matrix whose first major place is ``first``."""
    return np.repeat(np.arange(first, first + len(indptr) - 1), np.diff(indptr)), indices, data


def read_h5(spark: SparkSession, path: str, sample: str, rows_a_task: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spots, genes, expr) of an annotated matrix (.h5ad) or a feature-barcode matrix (.h5). The driver reads names and the
    header; tasks read ranges of the major axis each."""
    if not path.lower().endswith((".h5ad", ".h5")):
        raise ValueError(f"{path}: a name that ends in .h5ad or .h5 is needed")
    h5 = _h5py()
    text = lambda a: [x.decode() if isinstance(x, bytes) else str(x) for x in a]
    with h5.File(path.removeprefix("file://"), "r") as f:
        if "matrix" in f:
            m, names, cells = "matrix", text(f["matrix/features/name"][:]), text(f["matrix/barcodes"][:])
            major_is_spot, coords = True, None
            if tuple(f["matrix/shape"][:]) != (len(names), len(cells)) or not all(n.strip() for n in names):
                raise ValueError(f"{path}: names don't fit the matrix")
        else:
            index = lambda g: text(f[g][f[g].attrs["_index"]][:])
            m, names, cells = "X", index("var"), index("obs")
            major_is_spot = "csc" not in str(f["X"].attrs.get("encoding-type", "csr"))
            coords = f["obsm/spatial"][:] if "obsm/spatial" in f else None
        dense = isinstance(f[m], h5.Dataset)
        majors = len(cells) if dense or major_is_spot else len(names)
    spots = spark.createDataFrame([(sample, i, c, *((float(coords[i][0]), float(coords[i][1])) if coords is not None else (None, None))) for i, c in enumerate(cells)], "sample string, spot long, barcode string, x double, y double")
    genes = spark.createDataFrame([(sample, i, n) for i, n in enumerate(names)], "sample string, gene_idx long, gene string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                with _h5py().File(path.removeprefix("file://"), "r") as f:
                    end = min(start + rows_a_task, majors)
                    if dense:
                        block = f[m][start:end]
                        a, c = np.nonzero(block)
                        a, v = a + start, block[a, c]
                    else:
                        ptr = f[m]["indptr"][start : end + 1]
                        a, c, v = compressed_entries(ptr, f[m]["indices"][ptr[0] : ptr[-1]], f[m]["data"][ptr[0] : ptr[-1]], start)
                s, g = (a, c) if dense or major_is_spot else (c, a)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(s, np.int64)), pa.array(np.asarray(g, np.int64)), pa.array(np.asarray(v, float))], ["spot", "gene_idx", "value"])

    starts = spark.range(0, majors, rows_a_task).repartition(max(1, -(-majors // rows_a_task)))
    expr = starts.mapInArrow(run, "spot long, gene_idx long, value double").where("value <> 0").join(genes.select("gene_idx", "gene"), "gene_idx")
    return spots, genes, expr.select(F.lit(sample).alias("sample"), "spot", "gene_idx", "gene", "value")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle that ``sinks.write_bundle`` made; a folder without its mark of success is an error."""
    fs, _ = _fs(spark, folder)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_BUNDLE")):
        raise ValueError(f"{folder}: no finished bundle")
    names = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)) if s.isDirectory()]
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def preflight(spark: SparkSession, folder: str, warn_gb: float = 4.0) -> dict:
    """S3: shape, stored values and dense size of a matrix folder from its header alone."""
    found = mex_files(spark, folder)
    rows, columns, entries = mex_header(spark, found.paths["matrix"])
    size = rows * columns * 8
    return {"shape": (rows, columns), "stored_values": entries, "dense64_bytes": size, "dense32_bytes": size // 2, "exceeds": size > warn_gb * 1024**3, "warnings": found.warnings}


def sample_name(path: str) -> str:
    """A sample's name from its file: without folder, suffix and what file systems don't take."""
    stem = re.sub(r"(\.(h5ad|h5|csv|parquet))?(\.gz)?$", "", path.rstrip("/").rpartition("/")[2], flags=re.I)
    return re.sub(r'[<>:"/\\|?*]+', "_", stem).strip(". ") or "sample"
