"""Session helpers.

The library never creates its own cluster settings on a real deployment: it
reads what the session carries. Only when a setting is absent (unit tests,
local runs) does it fill in a local default.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "feedlens") -> SparkSession:
    """A local session for tests and the bench; UI off, UTC, AQE on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FEEDLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Local inputs are single files of one row group: see operators.parallel.
        .config("spark.feedlens.spread.partitions", os.environ.get("FEEDLENS_SPREAD", "16"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and state tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared filesystem the
    cluster names). A local master (tests, bench) may leave it unset and gets a
    temporary folder; any other master without it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext._jsc.sc().getCheckpointDir()  # type: ignore[attr-defined]
        conf = conf.get() if conf.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="feedlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf)
    spark.sparkContext.setCheckpointDir(conf)
    return conf


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``feedlens`` importable in the executors' Python workers (like ``--py-files``).

    Arrow/pandas functions refer to package code, which the workers import.
    The package is zipped once per SparkContext on the driver and handed to
    ``addPyFile``; Spark distributes it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="feedlens-pyfiles-"), "feedlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
