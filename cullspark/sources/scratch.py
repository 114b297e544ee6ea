"""Tables written on the way: in the folder that all machines see, deleted when the driver ends or sooner."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a single machine, else one in a warehouse that machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        made = getattr(shared_dir, "made", None)
        if made is None:
            made = shared_dir.made = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        return made
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise RuntimeError(f"spark.checkpoint.dir is unset and the warehouse {warehouse} is a folder of one machine: set spark.checkpoint.dir to a folder that all machines see")
    return f"{warehouse.rstrip('/')}/.scratch"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        return


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read back: computed once, and it survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written(); nothing that is still to run may read them."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
