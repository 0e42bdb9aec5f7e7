"""Session defaults and lineage cutting."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "leadquarry") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small data, eight cores
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", f"/tmp/leadquarry-{uuid.uuid4().hex}")  # one machine: any folder is shared
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it.  Where a session leaves that unset, a folder inside the
    warehouse serves, which is shared by definition; no folder is ever picked by the kind of master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder, once per session."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a ``with`` block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: While a table is written: shuffle files go when the write ends, and Arrow batches stay small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: no lineage, pruned reads.

    The files outlive lost executors.  ``discard`` removes them once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled_at = path
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*spooled: DataFrame) -> None:
    """Remove what ``spool`` wrote for these frames."""
    for df in spooled:
        _remove(df.sparkSession, df._spooled_at)


def bare(model, spark: SparkSession):
    """A fitted MLlib model without its training summary, by way of the shared folder.

    The summary holds the session, and a session that has observed a frame once cannot be sent to tasks:
    scoring with the model would fail there.  Models that keep no summary are returned as they are.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    out = type(model).load(path)
    _remove(spark, path)
    return out
