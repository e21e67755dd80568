"""SparkSession helpers: UTC clock, ANSI, AQE, checkpoint folder.

On a cluster the session is created by the platform; these helpers only
fill in settings that are missing, so a cluster's own values win.
"""
from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: settings every job in this library relies on
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: JVM flag for driver and executors: wide projections over the feature
#: windows generate methods above HotSpot's 8 000-bytecode JIT limit, which
#: otherwise run interpreted (measured 2-3x slower on the feature stage).
#: On a cluster pass the same value at submit time.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tideline", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (Spark UI off)."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
         .config("spark.executor.extraJavaOptions", JVM_OPTIONS))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Pin the session time zone to UTC (all timestamps are UTC instants), and
    keep generated methods below HotSpot's JIT limit: wider projections (the
    rounding of the 44 features) are then split into small methods instead of
    running interpreted, whatever flags the JVMs were started with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) == 65535:  # a lower one is the platform's choice
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Pandas functions are pickled by reference, so a worker that was not
    started from the repository's folder must be given the package.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tideline-ship-")
    stage = os.path.join(out, "src")
    shutil.copytree(pkg, os.path.join(stage, os.path.basename(pkg)), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(out, "tideline_pkg"), "zip", stage))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is local (tests) a scratch
    folder is made and registered; on a cluster a machine's own folder would
    not be seen by the executors, so a missing setting is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tideline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
