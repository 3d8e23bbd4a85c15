"""Session settings shared by the command-line jobs, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Actions that run at the same time.
SIDE_BY_SIDE = 6


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; cluster sizing is left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Keep generated methods below the size the JVM refuses to compile.

    Wide projections (thirty rules, fifty features) otherwise end up in one
    method above 8000 bytes of bytecode, which then runs interpreted.  Beyond
    this limit Spark evaluates the projection in split methods instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables and checkpoints that all executors reach, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dropped(context: SparkContext, path: str | None) -> None:
    """Remove a table or checkpoint of this library that nothing reads any more."""
    if path:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Unlike a checkpoint it leaves no conditions of the old plan behind, which the optimizer would go on
    combining: with some forty null checks and casts that takes minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/voltlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side[R](spark: SparkSession, jobs: Sequence[Callable[[], R]]) -> list[R]:
    """Results of actions that do not depend on each other, run from threads.

    Many of them end in a few small tasks; the tasks of the others then use the cores left idle.
    """
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [run.result() for run in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
