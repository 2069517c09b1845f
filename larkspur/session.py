"""SparkSession factory and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution.

    On a cluster the master, memory and partition counts come from spark-submit; ``master`` and
    ``conf`` are for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


# Folders made and not yet removed, in order.
_MADE: dict[str, None] = {}


def remove(spark: SparkSession, path: str) -> None:
    if path not in _MADE:
        return
    del _MADE[path]
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has gone; the cluster's own clean-up takes over
        pass


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    atexit.register(remove, spark, path)
    return path


def made() -> list[str]:
    """The folders made and not yet removed."""
    return list(_MADE)


def _read_back(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return _read_back(spark, df, path)


def discard(df: DataFrame) -> None:
    """Removes what ``written`` made, once nothing reads it any more."""
    remove(df.sparkSession, df._written_to)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` gives and remove all that it wrote on the way."""
    path, before = fresh_dir(spark, name), set(_MADE)
    df = make()
    df.write.parquet(path)
    for made in [x for x in _MADE if x not in before]:
        remove(spark, made)
    return _read_back(spark, df, path)
