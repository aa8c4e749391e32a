"""Session settings, the shared checkpoint folder, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def build_session(app: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for. The package goes to the executors,
    and to Python processes that Spark starts on its own, so the caller's folder doesn't matter."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else a local one for tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="emberlog-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder; later plans read it back with the same partitions."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.gettempdir(), f"emberlog-{sc.applicationId}.zip")
    if any(os.path.basename(archive) in name for name in sc.listFiles):
        return
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
