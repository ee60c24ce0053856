"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; all are plain Spark options.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A speculative copy of a completion task would call the model twice.
    "spark.speculation": "false",
}


def local_session(cores: int = 8, app: str = "gleanframe", **settings: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh subfolder of the folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must see it, so a temporary folder of one machine is accepted
    only where the whole session runs on that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="gleanframe-")
    return f"{base.rstrip('/')}/gleanframe-{uuid.uuid4().hex}"


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    Scans of many files already keep every core busy and are left alone, so this
    never shuffles a large input; it only helps a few small files use all cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    # A split of a file may hold no row group, so a split per core is enough only with as many files.
    if splits >= 2 * cores or splits >= cores and len(scan.inputFiles()) >= cores:
        return scan
    return scan.repartition(2 * cores, *keys)
