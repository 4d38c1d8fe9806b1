"""File manifests: scan, identity resolution, column choice, quality statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelseq import GROUP, RECORDING
from panelseq.functions import expr as X
from panelseq.session import ship

# Fixed values.
SUFFIXES = (".parquet", ".mat", ".npy", ".npz", ".csv", ".pkl", ".pickle")
SKIPPED_FOLDERS = ("__pycache__", ".git", ".pytest_cache", ".mypy_cache", ".ruff_cache", "results", "cache", "caches")
TEMPORARY_PREFIXES = ("~$", ".~", ".#", ".")
FEATURE_PRIORITY = ("de_lds", "de_movingave", "psd_lds", "psd_movingave", "features", "feature", "eeg", "x")
LABEL_TOKEN = "perclos"
SESSION_PATTERN = r"(?i)(?:session|sess|s)[_-]?(\d{1,2})"
#: Bytes that a task reads at a time to hash a file.
HASH_BLOCK = 8 << 20
#: Recording ids that name a recording unless the caller says otherwise.
KNOWN_IDS = (0, 22)

#: Columns of a saved manifest: what the scan, the resolution, the array statistics and the column choice make.
MANIFEST_SCHEMA = ", ".join([
    "file_path string, relative_path string, file_name string, file_suffix string, condition string",
    "file_size_bytes long, modified_time timestamp, sha256 string, scan_status string, error_message string",
    f"{RECORDING} long, resolution_source string, {GROUP} long, group_conflict boolean",
    "data_role string, feature_key string, label_key string, sample_count long, missing_rate double",
])


def _plain(c: Column | str) -> Column:
    """A local path without its scheme."""
    return F.regexp_replace(c, "^file:/+", "/")


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the session's file systems name it, so that scanned paths begin with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def path_parts(df: DataFrame, root: str | None = None, path: str = "file_path") -> DataFrame:
    """Relative path, file name, lower-case suffix and condition (first folder).

    With ``root``, a path that does not lie below it raises in the task.
    """
    rel = p = _plain(path)
    if root is not None:
        base = F.concat(F.regexp_replace(_plain(F.lit(root)), "/+$", ""), F.lit("/"))
        out = F.raise_error(F.concat(F.lit("not below the scanned root: "), F.col(path)))
        rel = F.when(F.startswith(p, base), F.substr(p, F.char_length(base) + 1)).otherwise(out.cast("string"))
    out = df.withColumn("relative_path", rel)
    parts = F.split("relative_path", "/")
    name = F.element_at(parts, -1)
    return out.withColumns({
        "file_name": name, "file_suffix": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)),
        "condition": F.when(F.size(parts) > 1, parts[0]).otherwise("root")})


def supported(df: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Drop other suffixes, cache folders, hidden and temporary files."""
    folders = F.transform(F.slice(F.split("relative_path", "/"), 1, F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(0))), lambda x: F.lower(x))
    keep = F.col("file_suffix").isin(*suffixes) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))
    for p in TEMPORARY_PREFIXES:
        keep = keep & ~F.col("file_name").startswith(p)
    return df.where(keep)


def _hash_files(batches):
    """Digest of each file, read block by block; a file that cannot be read gives the error instead."""
    for b in batches:
        digests, errors = [], []
        for path in b.column("file_path").to_pylist():
            try:
                system, name = fs.FileSystem.from_uri(path)
                total = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(HASH_BLOCK):
                        total.update(block)
                digests.append(total.hexdigest())
                errors.append("")
            except (OSError, pa.ArrowException) as e:
                digests.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield b.append_column("sha256", pa.array(digests, pa.string())).append_column("error_message", pa.array(errors, pa.string()))


def scan_manifest(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, recursive: bool = True, hashed: bool = True) -> DataFrame:
    """One row per supported file; content is read only for the hash, in blocks, so files may have any size.

    A file that cannot be read becomes an error row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_time"))
    out = supported(path_parts(base, qualified(spark, root)), suffixes)
    if not hashed:
        return out.withColumns({"sha256": F.lit(None).cast("string"), "scan_status": F.lit("dry_run"), "error_message": F.lit("")})
    schema = T.StructType([*out.schema.fields, T.StructField("sha256", T.StringType()), T.StructField("error_message", T.StringType())])
    ship(spark)
    done = out.mapInArrow(_hash_files, schema)
    return done.withColumn("scan_status", F.when(F.col("error_message") != "", "error").otherwise("ok"))


def resolve_recording(df: DataFrame, known: Callable[[Column], Column] | None = None, internal: str | None = None, expected: int = 23, physical_order: bool = False) -> DataFrame:
    """First matching rule gives the recording id: internal, folder, stem, pattern, order.

    ``known`` tells if an id, given as a column, is valid; by default those from 0 to 22 are.
    """
    known = known or (lambda c: c.between(*KNOWN_IDS))
    valid = lambda c: F.when(known(c), c)
    parts = F.split("relative_path", "/")
    folder_ids = F.filter(
        F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                    lambda x: F.regexp_extract(x, f"^{SESSION_PATTERN}$", 1)), lambda x: x != "")
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    number = lambda c: F.when(c != "", c.cast("long"))
    rules = [
        (F.col(internal).cast("long") if internal else F.lit(None).cast("long"), "internal_metadata"),
        (F.get(F.filter(F.transform(folder_ids, lambda x: x.cast("long")), known), F.lit(0)), "directory_name"),
        (F.when(stem.rlike(r"^\d{1,9}$"), stem.cast("long")), "file_name_exact_integer"),
        (number(F.regexp_extract(stem, SESSION_PATTERN, 1)), "file_name_pattern"),
    ]
    out = df
    if physical_order:
        # A (condition, suffix) set is used only if it has exactly ``expected`` files,
        # none named by an integer, so each ordered set is that small.
        size = df.groupBy("condition", "file_suffix").agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(stem.rlike(r"^\d+$")).alias("_named")).where((F.col("_n") == expected) & (F.col("_named") == 0))
        small = df.join(size.select("condition", "file_suffix"), ["condition", "file_suffix"], "left_semi")
        order = small.select("relative_path", (F.row_number().over(Window.partitionBy("condition", "file_suffix").orderBy("relative_path")) - 1).cast("long").alias("_order"))
        out = df.join(order, "relative_path", "left")
        rules.append((F.col("_order"), "verified_physical_order"))
    ids = [valid(c) for c, _ in rules]
    source = F.lit("unresolved")
    for c, name in reversed(list(zip(ids, [n for _, n in rules]))):
        source = F.when(c.isNotNull(), name).otherwise(source)
    out = out.withColumn(RECORDING, F.coalesce(*ids)).withColumn("resolution_source", source)
    return out.drop("_order") if physical_order else out


def attach_group(df: DataFrame, mapping: DataFrame, internal: str | None = None) -> DataFrame:
    """Owner group of each recording; ``group_conflict`` flags a different internal id."""
    m = mapping.select(F.col(RECORDING).cast("long").alias(RECORDING), F.col(GROUP))
    out = df.join(m, RECORDING, "left")
    conflict = F.coalesce(F.col(internal) != F.col(GROUP), F.lit(False)) if internal else F.lit(False)
    return out.withColumn("group_conflict", conflict)


def choose_columns(meta: DataFrame, priority: Sequence[str] = FEATURE_PRIORITY, label_token: str = LABEL_TOKEN, file: str = "file_path") -> DataFrame:
    """Feature and label column per file from (file, name, numeric).

    The feature is the first of the priority list, else the first name; the rest
    are recorded as runners-up. A file's column list is small.
    """
    low = F.lower("name")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), low), F.lit(0)), F.lit(len(priority) + 1))
    tagged = meta.withColumn("_label", low.contains(label_token)).withColumn("_rank", F.struct(place.alias("p"), low.alias("n"), F.col("name").alias("name")))
    feature = F.array_sort(F.collect_list(F.when(~F.col("_label") & F.col("numeric"), F.col("_rank"))))
    label = F.min(F.when(F.col("_label"), F.struct(low.alias("n"), F.col("name").alias("name"))))
    out = tagged.groupBy(file).agg(feature.alias("_f"), label.alias("_l"))
    key = F.get("_f", F.lit(0))["name"]
    role = F.when(key.isNotNull() & F.col("_l").isNotNull(), "feature+label").when(key.isNotNull(), "feature").when(
        F.col("_l").isNotNull(), "label").otherwise("unknown")
    return out.select(
        file, key.alias("feature_key"), F.col("_l.name").alias("label_key"), role.alias("data_role"),
        F.transform(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0))), lambda x: x["name"]).alias("runners_up"))


def array_stats(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Extremes, mean and population sd of finite values; non-finite rate and size."""
    fine = F.when(~X.nonfinite(value), F.col(value))
    return long.groupBy(*keys).agg(
        F.min(fine).alias("min"), F.max(fine).alias("max"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"),
        F.count_if(X.nonfinite(value)).alias("bad"), F.count(F.lit(1)).alias("size")
    ).withColumn("missing_rate", F.col("bad") / F.col("size"))


def combined_missing_rate(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return stats.groupBy(*by).agg((F.sum("bad") / F.sum("size")).alias("missing_rate"))


def save_manifest(df: DataFrame, out: str, overwrite: bool = False) -> None:
    """CSV, JSON lines, abnormal rows and the summary; refuses to overwrite by default."""
    from panelseq.operators.contracts import manifest_summary

    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).option("header", True).csv(f"{out}/manifest_csv")
    df.write.mode(mode).json(f"{out}/manifest_jsonl")
    df.where(~F.col("scan_status").isin("ok", "success")).write.mode(mode).option("header", True).csv(f"{out}/abnormal_csv")
    manifest_summary(df, [c for c in ("condition", "data_role", "scan_status") if c in df.columns]).write.mode(mode).json(f"{out}/summary_json")


def load_manifest(spark: SparkSession, path: str, fmt: str = "json", schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Read a saved manifest with its declared schema; NaN becomes null."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


REQUIRED = (GROUP, RECORDING, "relative_path", "data_role", "sample_count", "scan_status")


def load_ok(df: DataFrame) -> DataFrame:
    """Rows scanned without error, ids as integers."""
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    return df.where(F.col("scan_status").isin("ok", "success")).withColumn(GROUP, F.col(GROUP).cast("int")).withColumn(
        RECORDING, F.col(RECORDING).cast("int"))
