"""Session helpers: a local session for tests and the shared scratch folder.

On a cluster the session is given; ``shared_dir`` then reads the folder the
cluster names in ``spark.checkpoint.dir`` and never invents a machine-local one.
Only in a session with a local master (tests, the bench) that leaves it unset is
a fresh folder under the system temp dir created and registered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "multimatch") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    If a session with a local master has none (tests), a fresh temp folder is
    created and registered, so later ``checkpoint()`` calls and written tables
    land there. On any other master a missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="multimatch-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, root)
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder (not created yet)."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder, and read from there.

    Cuts the lineage with files that every executor can read again, computes
    ``df`` once (a checkpoint computes it twice), and later reads fetch only the
    columns they need.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
