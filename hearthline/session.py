"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hearthline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # the JVM does not compile methods beyond 8000 bytes of code: wide feature
        # projections are faster as split methods than as one interpreted method
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_local(master: str) -> None:
    """Raise unless all tasks run on the driver's machine and see its folders."""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster, where executors would
    each write to their own disk, the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    require_local(spark.sparkContext.master)
    own = tempfile.mkdtemp(prefix="hearthline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/hearthline/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a result that several later passes read: they scan only the columns
    they need, and a lost executor costs a file read instead of the whole chain.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``staged`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    scratch = hadoop.Path(f"{shared_dir(spark)}/hearthline")
    fs = scratch.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        if not fs.makeQualified(path).getParent().equals(fs.makeQualified(scratch)):
            raise ValueError(f"{folder} is not a staged table")
        fs.delete(path, True)
