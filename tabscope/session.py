"""Session helpers.

The library never creates configuration on a cluster session: it reads
``spark.checkpoint.dir`` from the session and only provides a scratch
directory when the session runs in local mode with no directory set
(tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tabscope", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on.  Master and shuffle partitions are set only where given (by argument
    or TABSCOPE_MASTER, TABSCOPE_SHUFFLE_PARTITIONS); otherwise spark-submit's settings hold."""
    master = master or os.environ.get("TABSCOPE_MASTER")
    parts = shuffle_partitions or os.environ.get("TABSCOPE_SHUFFLE_PARTITIONS")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABSCOPE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabscope`` importable in the Python workers (its pandas UDFs reference package modules).

    The package is zipped once per application and registered with ``addPyFile``, which distributes it to
    every executor; deployments that already pass it with ``--py-files`` lose nothing.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="tabscope-pyfiles-"), "tabscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, creating a scratch one only in local mode.

    Also ships the package to the Python workers (see ``ship_package``)."""
    ship_package(spark)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage (e.g. an HDFS/S3 path) "
            "so iterative operators can cut lineage safely"
        )
    path = tempfile.mkdtemp(prefix="tabscope-ckpt-")
    sc.setCheckpointDir(path)
    return path
