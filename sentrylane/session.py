"""Session settings and the shared folder that long jobs write to."""

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings the operators rely on. Most are Spark 4 defaults, named here because
#: the plans depend on them: AQE turns small join sides into broadcasts by their
#: measured size and splits skewed shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    # Keyed state of streams lives on disk, not in executor memory.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Rule arrays are built from thousands of column calls; noting the Python line of
    # each costs more than running a small query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    folder = os.environ.get("SENTRYLANE_WORK")
    if not folder:
        folder = tempfile.mkdtemp(prefix="sentrylane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    builder = builder.config("spark.checkpoint.dir", f"file://{folder}")
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SENTRYLANE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints, below ``spark.checkpoint.dir``.

    The cluster names a folder there that the driver and all executors share;
    ``local_session`` sets its own where none is given.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{shared.rstrip('/')}/sentrylane/{name}-{os.urandom(8).hex()}"
