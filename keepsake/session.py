"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keepsake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; values in ``conf`` (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Folder deletes have side effects: two attempts of one task must not race.
        "spark.speculation": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in a test, it is a folder
    of the warehouse. Raises where that is a folder of one machine, but the executors run on others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    shared = "://" in warehouse and not warehouse.startswith("file:")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{warehouse} may be a folder of one machine; name a shared one in spark.checkpoint.dir")
    return f"{warehouse}/_keepsake"


# Paths given out, so that release can remove what lies there.
_given: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove every intermediate table written so far. For callers that have taken their results."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _given:
        path = jvm.org.apache.hadoop.fs.Path(_given.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the workspace."""
    path = f"{workspace(spark)}/keepsake/{label}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back.

    Cuts the lineage so that a lost executor never re-runs the steps before it, and gives the
    optimizer the true size: joins against the result are broadcast only while the written files
    stay below ``spark.sql.autoBroadcastJoinThreshold``, and shuffled beyond it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
