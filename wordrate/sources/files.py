"""File scans.

Every reader takes an explicit schema where the format is schemaless, adds the
``line_no`` ordering column the last-wins rules need, and never pulls data to the
driver.  ``line_no`` orders lines by (file, byte offset of the split, position).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.batches import MANIFEST
from . import schemas as SC


def line_order() -> Column:
    """Input order of text-based files: file name, split start, position in split."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"))


def _csv(spark: SparkSession, encoding: str, multi_line: bool):
    """Comma-separated with a header; a quote inside a quoted cell is doubled.  A line break
    ends a record unless ``multi_line`` is set, which reads each file as one split."""
    return (spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
                 .option("multiLine", multi_line))


def read_word_table(spark: SparkSession, path: str, column: str | None = None, multi_line: bool = False) -> DataFrame:
    """Word list by extension -- CSV in ISO-8859-1 with header, or XLSX (first
    sheet); any other extension is an error.  ``column`` projects P1's word column."""
    if path.endswith(".csv"):
        df = _csv(spark, "ISO-8859-1", multi_line).csv(path)
    elif path.endswith(".xlsx"):
        from . import xlsx
        xlsx.register(spark)
        df = spark.read.format("xlsx").option("header", True).load(path)
    else:
        raise ValueError(f"Unsupported file extension: {path}")
    return df.select(column) if column else df


def read_csv_utf8(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header in UTF-8."""
    return _csv(spark, "UTF-8", multi_line).csv(path)


def read_jsonl_strict(spark: SparkSession, paths, ddl: str) -> DataFrame:
    """S5 (+ S7 / U2 for several paths or globs, read as one): one bad line fails the job."""
    df = spark.read.schema(ddl).option("mode", "FAILFAST").json(paths)
    return df.withColumn("line_no", line_order())


def parse_json_lines(lines: DataFrame, ddl: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text lines -> one record per line with the explicit schema, plus ``_bad``
    holding the text of a malformed line (NULL otherwise).

    The parse sits in a one-element generator: a later filter on the parsed fields
    cannot be pushed below it, so every line is parsed exactly once (a plain
    projection would be inlined into the filter and parse the line again)."""
    parsed = F.from_json("value", ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.explode(F.array(parsed)).alias("_r"), *keep).select("_r.*", *keep)


def read_jsonl_tolerant(spark: SparkSession, paths, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Blank lines are skipped, bad lines are set aside as rejects (K6).

    Lines are scanned as text and parsed once; good rows and rejects come from the
    same scan without caching."""
    lines = (spark.read.text(paths)
                  .select("value", F.col("_metadata.file_path").alias("_file"), line_order().alias("line_no"))
                  .where(F.trim("value") != ""))
    parsed = parse_json_lines(lines, ddl, keep=("_file", "line_no"))
    good = parsed.where(F.col("_bad").isNull()).drop("_bad", "_file")
    rejects = parsed.where(F.col("_bad").isNotNull()).select(F.col("_file").alias("file"), F.col("_bad").alias("line"))
    return good, rejects


def committed_files(spark: SparkSession, folder: str, run: str | None = None) -> list[str] | None:
    """Paths of the batch files (of one run) that the newest manifest of a K1 folder names; None
    if the folder has no manifest.  Read through Spark, so any storage that Spark reads will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{MANIFEST}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(st.getPath().getName() for st in fs.listStatus(at) if st.getPath().getName().isdigit()) if fs.exists(at) else []
    if not versions:
        return None
    lines = spark.read.text(f"{folder.rstrip('/')}/{MANIFEST}/{versions[-1]}").collect()  # a line per file
    found = [json.loads(r["value"]) for r in lines]
    return [f"{folder.rstrip('/')}/{f['file']}" for f in found if run is None or f["run"] == run]


def _records(spark: SparkSession, paths, ddl: str, strict: bool) -> DataFrame:
    """Records with the ``run`` that their file's name or folder tells ('' if neither does)."""
    df = read_jsonl_strict(spark, paths, ddl) if strict else read_jsonl_tolerant(spark, paths, ddl)[0]
    return df.withColumn("run", run_of_file(F.col("line_no.file")))


def read_results(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """Result files of any dialect (S5/S6 + S12 happens per row downstream)."""
    return _records(spark, paths, SC.RESULT_UNION, strict)


def read_requests(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """Request files of any dialect; of a folder that K1 wrote, those that its manifest names."""
    known = committed_files(spark, paths) if isinstance(paths, str) and not re.search(r"[*?\[{]", paths) else None
    return _records(spark, known or paths, SC.REQUEST_UNION, strict)


def run_of_file(path: Column) -> Column:
    """Run name of a batch, result or error file: what stands before ``_batch_{i}_`` in the
    file's name, else the folder ``run=...`` it is in, else ''."""
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # file paths are URI-encoded
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    from_name = F.regexp_extract(name, r"^(.+)_batch_\d+_", 1)
    # characters that no file name holds are percent-encoded in it
    plain = F.coalesce(F.try_url_decode(F.replace(from_name, F.lit("+"), F.lit("%2B"))), from_name)
    return F.when(from_name != "", plain).otherwise(F.regexp_extract(path, r"/run=([^/]+)/", 1))


def batch_of_file(path: Column) -> Column:
    """Index of a batch file ``{run}_batch_{i}_{stamp}.jsonl``."""
    return F.regexp_extract(path, r"_batch_(\d+)_[^/]*$", 1).cast("long")


def read_batches_of_run(spark: SparkSession, folder: str, run: str, ddl: str = SC.REQUEST_UNION,
                        glob: str | None = None) -> DataFrame:
    """Files of one run.  In a folder that K1 wrote they are the manifest's files of the
    run, whatever else lies there.  Without a manifest, only files whose name starts like
    the run's are listed; the prefix also matches longer run names (``original`` and
    ``original_batch_2_x``), so the exact run is checked on the file's path, before any line is parsed.
    F6: ``glob="*predictions.jsonl"`` keeps only prediction files (of any name)."""
    known = None if glob else committed_files(spark, folder, run)
    if known is not None:
        df = spark.read.schema(ddl).json(known) if known else spark.createDataFrame([], ddl).select("*", F.lit(None).alias("_metadata"))
        order = line_order() if known else F.lit(None).cast("struct<file:string,block:long,pos:long>")
        return df.withColumn("line_no", order).drop(*([] if known else ["_metadata"])).withColumn("run", F.lit(run))
    pattern = glob or re.sub(r"([\[\]{}*?\\])", r"\\\1", run) + "_batch_*"
    df = (spark.read.schema(ddl).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
               .where(run_of_file(F.col("_metadata.file_path")) == run))
    return df.withColumn("line_no", line_order()).withColumn("run", F.lit(run))


def newest_file(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The most recently modified file directly in ``folder`` (sub-folders
    ignored), as a one-row DataFrame (path, modificationTime).  File contents are not
    read: ``binaryFile`` skips the content column when it is not selected."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                    .option("recursiveFileLookup", True).load(folder)
                    .select("path", "modificationTime"))
    base = folder.rstrip("/")
    direct = listing.where(F.regexp_replace("path", r"/[^/]+$", "").endswith(base))
    return direct.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                      F.max("modificationTime").alias("modificationTime"))


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """A whole text file as one row (column ``prompt``)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "prompt")


def read_chat_records(spark: SparkSession, paths) -> DataFrame:
    """Chat JSONL for training."""
    return spark.read.schema(SC.CHAT_RECORD).option("mode", "FAILFAST").json(paths)
