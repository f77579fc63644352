"""A corpus pipeline: STAGES are applied one after the other to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from wordrate.llm.lpf_dedup import without_later_copies
from wordrate.llm.ngram_jaccard import one_of_each
from wordrate.llm.pii_bootstrap import redacted
from wordrate.llm.queries import table
from wordrate.llm.toxicity import without_toxic
from wordrate.llm.vector_packing import pack_documents
from wordrate.session import ensure_checkpoint_dir


def _released(spark: SparkSession) -> None:
    """Lets go of what the stages before have left on the driver.  A stage's models and tables are
    written or broadcast once; Spark drops them, and the files of finished shuffles, when the
    driver's collector finds that nothing refers to them, which a roomy heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id stays."""
    _released(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 50-byte passages are cut out of the texts."""
    _released(spark)
    return without_later_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets."""
    _released(spark)
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids are packed into sequences of at most 2048 tokens; one row per piece."""
    _released(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages' Parquet lies in the shared checkpoint folder."""
    home = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages' models and hashes are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
