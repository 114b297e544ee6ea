"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows of a few numbers.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir; where that is unset, one in the warehouse, or on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.startswith("local")
        found = f"file://{tempfile.mkdtemp(prefix='cut-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        return


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, and it survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*written: DataFrame) -> None:
    """Deletes tables that cut() wrote; nothing that is still to run may read them."""
    for df in written:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows, so that long ones don't add up in a worker.

    The setting stays: a query's plan is made when its caller runs it. A smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: together the first two tell rows apart, save those that repeat both id and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def is_row(docs: DataFrame, other: DataFrame) -> Column:
    """Whether a row of docs is the one that other (doc_id, text_hash) names; null ids are equal."""
    return docs["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == other["text_hash"])


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs that gone (doc_id, text_hash) doesn't name. They are counted: few are broadcast, many are joined by shuffle."""
    gone = cut(gone.select("doc_id", "text_hash").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, is_row(docs, gone), "left_anti")


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number within group, from 0, in the given order; group columns may be null.

    Rows are dealt by ranges of group and order and written in that order, so a group with most rows is
    many tasks'; what comes before a task's rows of a group is the sum of the earlier tasks' counts.
    """
    keys = [*(F.col(f"`{g}`").asc_nulls_first() for g in group), *order, F.asc("_tie")]  # rows that are alike are spread too
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = dealt.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    counts = cut(counts.select(*(F.col(f"`{g}`").alias(f"_g{k}") for k, g in enumerate(group)), "_part", (before - F.col("_low")).alias("_shift")), "counts")
    same = F.shiftright("_at", 33) == F.col("_part")
    for k, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{k}"))
    few = counts.count() <= BROADCAST_ROWS
    joined = dealt.join(F.broadcast(counts) if few else counts, same)
    return joined.select(*(f"`{c}`" for c in rows.columns), (F.col("_at") + F.col("_shift")).alias(name))


def digests(pieces: DataFrame, key: str, order: str, text: str, sep: str) -> DataFrame:
    """key and digest, the SHA-256 in hex of a key's texts joined by sep in the given order; keys aren't null.

    A hash goes from front to back, so a key's texts are one task's; they pass through it as a stream.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                if state is None or k != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(sep.encode())
                state.update(t.encode())
            yield pd.DataFrame(out, columns=["key", "digest"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "digest"])

    dealt = pieces.select(F.col(key).alias("key"), F.col(order).alias("_order"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key", "_order")
    kind = next(f.dataType for f in dealt.schema if f.name == "key").simpleString()
    return dealt.select("key", "text").mapInPandas(run, f"key {kind}, digest string").withColumnRenamed("key", key)
