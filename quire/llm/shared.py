"""Tables written to the shared folder, to cut lineage and to fix what later passes rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: the one the session names, or, in a local session without
    one, a temporary folder. A session on a cluster that names none raises."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {KEY} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="quire-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """`df` as a Parquet table in a new folder of the shared folder, in `files` files if given. This
    runs `df`, once; the caller of the job may delete the folder when the result has been used."""
    path = f"{shared_folder(df.sparkSession)}/quire-{name}-{uuid.uuid4().hex}"
    (df if files is None else df.repartition(files)).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(rows: int, each: int) -> int:
    """Files for so many rows at `each` rows a file: small tables need not have one per shuffle partition."""
    return max(1, -(-rows // each))


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to BATCH_BYTES, so that long texts do not fill the Python
    workers of an executor; a session that has set less keeps it. Sizes are read as Spark reads them."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
