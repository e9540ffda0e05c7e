"""Session helpers.

On a cluster the session comes from ``spark-submit`` and its settings win;
``local_session`` is for tests and the benchmark only.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app_name: str = "shelfcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        # Release shuffle files of finished queries during long local runs.
        .config("spark.cleaner.periodicGC.interval", "2min")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    use_checkpoint_dir(spark)
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str | None:
    """Tell Spark the checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Returns the folder, or None when the session names none; then MLlib's
    learners skip their checkpoints and nothing is written.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def work_dir(spark: SparkSession) -> str:
    """A folder that all executors share: the one ``spark.checkpoint.dir`` names, and only for a local master without it a private one."""
    named = use_checkpoint_dir(spark)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shelfcast-")
    return named.rstrip("/")
