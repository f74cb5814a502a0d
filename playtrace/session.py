"""Spark session and lineage helpers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "playtrace", cpus: int | str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLAYTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    every task runs on this machine, falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="playtrace-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()
_shipped: set[str] = set()
_part: list[str] = []  # the folder inside the run's folder that tables go to, the innermost last


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/playtrace-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended before; its folder stays for whoever ended it
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that tasks can import it wherever the driver runs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    place = f"{run_dir(spark)}/playtrace.zip"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(place)
    _shipped.add(app)


@contextmanager
def tables_in(name: str):
    """Tables that ``durable`` writes meanwhile go to a folder of their own."""
    _part.append(name)
    try:
        yield
    finally:
        _part.pop()


def drop_tables(spark: SparkSession, name: str) -> None:
    """Delete the folder of tables_in(name). Nothing that reads them may be used afterwards."""
    _drop(spark, f"{run_dir(spark)}/{name}")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives losing executors. Unlike a checkpoint it also
    gives the optimizer the real size: size estimates multiply in every join, and in an
    iterative job they would otherwise grow without end. The shuffle files of the write are freed at once.
    """
    spark = df.sparkSession
    path = "/".join([run_dir(spark), *_part, uuid.uuid4().hex])
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
