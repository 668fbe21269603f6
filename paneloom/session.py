"""Session helpers: local test session, shared scratch folder and materialisation."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Session settings that every operator assumes; all are Spark defaults or safe on any cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("paneloom")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: it is added to the application once, as an archive that Spark
    itself hands to every executor, also to those that join later."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="paneloom-ship-")  # on the driver only
    atexit.register(shutil.rmtree, folder, True)  # local files are served to executors from where they are, until the end
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, str(source.relative_to(package.parent)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``; only a session
    without that setting (tests, a single machine) gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.gettempdir()}/paneloom-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with all others of the application when the process ends."""
    folder = f"{scratch_root(spark)}/paneloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors and lets
    several later passes read the same rows; ``by`` gives each value of that column a folder of its own. :func:`discard` drops it
    early; all are dropped when the process ends, and not when a query function returns, as the frame it returns may still
    read them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def materialize_bucketed(df: DataFrame, key: str, name: str = "stage", buckets: int | None = None) -> DataFrame:
    """Like :func:`materialize`, with the rows lying by a hash of ``key``, in as many parts as the session's shuffles have: a join by
    ``key`` moves the other side only. The table is known to the catalog no longer than it takes to read it."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = scratch_path(spark, name), f"paneloom_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._materialized_at = path
    spark.sql(f"DROP TABLE {table}")  # the files stay: they are the application's
    return out


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`materialize` that nothing will read any more."""
    _remove(df.sparkSession, df._materialized_at)


_folders: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  (the session has ended: the cluster's own clean-up remains)
        pass
