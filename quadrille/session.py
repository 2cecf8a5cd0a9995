"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC dates, adaptive plans and the package on the executors; all else is left to the cluster's settings."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def local(cpus: int = 8, memory: str = "8g") -> SparkSession:
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quadrille")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python can import it anywhere.

    The driver serves the archive over the network for as long as it runs; the folder goes when it ends.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    _shipped[app] = tempfile.TemporaryDirectory()
    path = Path(_shipped[app].name) / "quadrille.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set on the context.

    Only a local master, as in tests, may have neither: a folder in the warehouse is taken then. A cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and current.isDefined():
        path = current.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with the application."""
    path = f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    The table goes with the application, or before that with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made, once nothing reads them any more."""
    for df in tables:
        where, files = _files(df.sparkSession, df._stored_at)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())
