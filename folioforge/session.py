"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "folioforge", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the session names none (tests, local runs) a temporary one is set once.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if found:
            d = found
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="folioforge-")
            spark.sparkContext.setCheckpointDir(d)
    return d


def local_path(path: str) -> str | None:
    """The plain path of a shared folder on a mounted file system, None for object stores."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, removed on any file system when the driver's JVM ends; results are read lazily until then."""
    out = f"{shared_dir(spark).rstrip('/')}/{label}_{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cuts the lineage through a compressed table in the shared folder.

    Unlike a local checkpoint the files survive lost executors, and columnar files
    keep later column pruning.
    """
    spark = df.sparkSession
    out = shared_folder(spark, label) + "/data"
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def cut_by(df: DataFrame, key: str, label: str = "stage") -> DataFrame:
    """As `cut`, as a table in buckets by a key, so that later joins and aggregations on it shuffle only the other side.

    The table's name lives in the session's catalogue; with one that outlasts the session, drop it as its files go.
    """
    spark = df.sparkSession
    out = shared_folder(spark, label)
    name, out = out.rpartition("/")[2], out + "/data"
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, key).write.option("compression", "zstd").option("path", out).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def shared_file(spark: SparkSession, label: str, suffix: str = "") -> str | None:
    """A new file name on the shared folder if it is mounted on every host, else None."""
    base = local_path(shared_dir(spark))
    return None if base is None else os.path.join(local_path(shared_folder(spark, label)), label + suffix)
