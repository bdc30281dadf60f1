"""File sources and sinks of the pipeline: code-safe CSV, trigger logs, whole
source files with keys in their paths, archive listings, tolerant scans,
pending-task sets, resumable runs and partitioned Parquet sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.triggers import block_text, complete_blocks, parse_blocks
from ..session import cut_lineage

# Cell texts that the reference's CSV reader treats as missing.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Trigger-log path layout <project>/<system>/<bug>(b|f).<bug>.trigger.log
LOG_PATH_RE = r"([^/]+)/([^/]+)/([0-9]+)([bf])\.[0-9]+\.trigger\.log$"


def read_code_csv(spark: SparkSession, path: str, schema: StructType | str, fill_missing: bool = True) -> DataFrame:
    """CSV with quoted multi-line code cells; NA words and empty cells -> '' (S1, S10, S11).

    Multi-line files cannot be split, so convert them to Parquet once and read that.
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))
    if fill_missing:
        strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        df = df.select(*[F.when(F.col(c).isin(NA_WORDS), F.lit("")).otherwise(F.coalesce(F.col(c), F.lit("")))
                         .alias(c) if c in strings else F.col(c) for c in df.columns])
    return df


def read_string_csv(spark: SparkSession, path: str, header: bool = True,
                    names: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings (S2); header-less files take ``names`` (S3)."""
    r = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    if names is not None:
        r = r.schema(", ".join(f"`{n}` string" for n in names))
    return r.csv(path)


# Columns of the two prediction files, in file order (all read by position).
EXCEPTION_PREDICTIONS = "true_lbl int, pred_lbl int, logit_0 double, logit_1 double"
ASSERTION_PREDICTIONS = ("idxs long, true_lbl int, pred_lbl int, logit_0 double, logit_1 double, test_name string, "
                         "pred_assertion string, truncation int, test string, fms string")
# Columns of a model-input file.
MODEL_INPUTS = "label int, test string, fm string, docstring string, idx long"


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A prediction file (S10): header row, columns by position, blank lines skipped."""
    raw = read_code_csv(spark, path, schema, fill_missing=False)
    return raw.filter(~F.forall(F.array(*[F.col(c).isNull() for c in raw.columns]), lambda x: x))


def read_model_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(label, test, fm, docstring, idx) by column name, whatever their order in the file."""
    wanted = [c.strip().split(" ") for c in MODEL_INPUTS.split(",")]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c).cast(t).alias(c) for c, t in wanted])


def read_keyed(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The named columns of a CSV, one row per key (S4); the last row of a key wins, as a dictionary would keep it."""
    raw = read_string_csv(spark, path).withColumn("_row", F.monotonically_increasing_id())
    last = raw.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_row").alias("_r"))
    return last.select(*keys, "_r.*")


def join_sweep_inputs(scores: DataFrame, assertion_labels: DataFrame, exception_labels: DataFrame, idx_list: DataFrame,
                      row: str = "row_idx") -> DataFrame:
    """Scores with the two label columns looked up through a list of row numbers (S13): ``idx_list`` (row, idx) gives, for
    each score row, the row of the label files (row, label)."""
    j = scores.join(idx_list, row)
    for side, name in ((assertion_labels, "as_lbl"), (exception_labels, "ex_lbl")):
        j = j.join(side.select(F.col(row).alias("idx"), F.col("label").alias(name)), "idx")
    return j.drop("idx")


def parse_projects(projects: str | Sequence[str] | None, default: Sequence[str]) -> list[str]:
    """Project subset given as a list, a comma-separated string, or None (default list)."""
    if projects is None:
        return list(default)
    if isinstance(projects, str):
        return [p for p in projects.split(",") if p]
    return list(projects)


def read_bug_lists(spark: SparkSession, pattern: str, projects: Sequence[str] | None = None) -> DataFrame:
    """One CSV per project (S5): all files in one scan, the project taken from the
    file name, optional project subset pushed as a filter. Column names with dots
    are renamed with underscores."""
    df = spark.read.option("header", True).csv(pattern)
    df = df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("project"), "*")
    df = df.toDF(*[c.replace(".", "_") for c in df.columns])
    return df.filter(F.col("project").isin(*projects)) if projects else df


def read_trigger_logs(spark: SparkSession, root: str, glob: str = "*.trigger.log", path_re: str = LOG_PATH_RE) -> DataFrame:
    """Trigger logs under ``root`` -> one row per block with path keys.

    (project, system, bug_num, tag, block_pos, test_name, block, category, n_lines).
    A block of fewer than two lines is an error of the log: the read fails on it.

    The block separator is the record separator of the scan, so a long log is read by many tasks. A block's
    place in its log is its place in its split plus the blocks of the log's earlier splits: both come from the
    split's offset and the row's number in the scan, and only (log, split) counts are brought together.
    """
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n---").text(root)
           .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), "value")
           .withColumn("_row", F.monotonically_increasing_id()))
    splits = raw.groupBy("path", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_split")) - F.col("_n")  # the splits of one log
    placed = raw.join(splits.select("path", "_split", "_first", before.alias("_before")), ["path", "_split"])
    pos = F.col("_before") + F.col("_row") - F.col("_first")
    keyed = placed.select(
        F.regexp_extract("path", path_re, 1).alias("project"),
        F.regexp_extract("path", path_re, 2).alias("system"),
        F.regexp_extract("path", path_re, 3).cast("long").alias("bug_num"),
        F.regexp_extract("path", path_re, 4).alias("tag"),
        pos.alias("block_pos"), F.when(pos == 0, block_text("value")).otherwise(F.col("value")).alias("block"))
    return complete_blocks(parse_blocks(keyed.filter(F.col("block") != "")))


def read_source_files(spark: SparkSession, root: str, path_re: str, keys: Sequence[str],
                      glob: str = "*.java", exclude: str = "scaffolding") -> DataFrame:
    """Whole source files with keys from path groups; paths that do not match are left out."""
    raw = _source_paths(spark, root, glob, exclude)
    raw = raw.filter(F.col("path").rlike(path_re))
    return raw.select("path", *[F.regexp_extract("path", path_re, i + 1).alias(k) for i, k in enumerate(keys)],
                      F.col("value").alias("content"))


def count_unmatched(spark: SparkSession, root: str, path_re: str, glob: str = "*.java", exclude: str = "scaffolding") -> DataFrame:
    """One row (reason, n): source files whose path does not match."""
    raw = _source_paths(spark, root, glob, exclude).select("path")
    return raw.agg(F.lit("file_name_not_matched").alias("reason"), F.count_if(~F.col("path").rlike(path_re)).alias("n"))


def _source_paths(spark: SparkSession, root: str, glob: str, exclude: str) -> DataFrame:
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
           .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    return raw.filter(~F.contains(F.col("path"), F.lit(exclude)))


# Archive layout <project>/<method>/<test id>/<project>-<bug><b|f>-....tar.bz2
ARCHIVE_PATH_RE = r"([^/]+)/([^/]+)/([^/]+)/[^/-]+-([0-9]+)[bf][^/]*$"


def list_archives(spark: SparkSession, root: str, glob: str = "*.tar.bz2") -> DataFrame:
    """(path, project, method, test_id, bug_num) of archives without opening them."""
    paths = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path"))
    key = lambda i: F.regexp_extract("path", ARCHIVE_PATH_RE, i)
    return paths.select("path", key(1).alias("project"), key(2).alias("method"), key(3).alias("test_id"),
                        key(4).cast("long").alias("bug_num"))


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """A missing input is an empty relation of the right schema."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(hpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def pending_tasks(tasks: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose output does not exist yet (S15): a left anti join."""
    return tasks.join(finished.select(*keys).distinct(), list(keys), "left_anti")


MANIFEST = "status string, run string, at timestamp"


def run_pending(tasks: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], out: str, manifest: str,
                run: str, waves: int = 1, strict: bool = True) -> DataFrame:
    """Run what is not done yet and commit it by partition (S14, S15); (keys, status) of every task: skip, done or failed.

    ``compute`` gets the pending tasks and returns their rows with the key columns. Each of ``waves`` deals (by key hash) is
    written as partitions of ``out`` by dynamic overwrite, so a wave that ran before and was cut off is replaced, not doubled, and
    no other partition is touched. Only after its write does a wave enter the manifest as done; one that fails enters it as
    failed. A rerun, also after a killed driver, takes exactly the tasks without a done entry. ``strict`` raises the first
    failure after all waves have run.
    """
    spark, keys = tasks.sparkSession, list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.select(*keys).schema) + ", " + MANIFEST
    tasks = cut_lineage(tasks.select(*keys).distinct())
    finished = read_or_empty(spark, manifest, schema).filter("status = 'done'")
    todo = cut_lineage(pending_tasks(tasks, finished, keys).withColumn("_wave", F.pmod(F.xxhash64(*keys), F.lit(waves))))

    def note(some: DataFrame, status: str) -> None:
        (some.select(*keys, F.lit(status).alias("status"), F.lit(run).alias("run"), F.current_timestamp().alias("at"))
         .write.mode("append").parquet(manifest))

    failure = None
    for wave in sorted(r[0] for r in todo.select("_wave").distinct().collect()):  # at most ``waves`` numbers
        mine = todo.filter(F.col("_wave") == wave).drop("_wave")
        try:
            (compute(mine).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(out))
        except Exception as e:  # noqa: BLE001 - the wave is noted and the next one runs
            note(mine, "failed")
            failure = failure or e
        else:
            note(mine, "done")
    if failure is not None and strict:
        raise failure
    mine = read_or_empty(spark, manifest, schema).filter(F.col("run") == run).select(*keys, "status")
    return tasks.join(mine, keys, "left").withColumn("status", F.coalesce("status", F.lit("skip")))


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Partitioned Parquet sink (S14); run keys become directories for pruning."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV sink (S14): a folder of part files with a header, quotes doubled, so ``read_code_csv`` gets the rows back."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
