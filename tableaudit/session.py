"""Session helpers: checkpoint directory and a local session for tests/bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` from the session. Only a local-mode session
    without that setting gets a fresh temporary folder (tests, bench); a
    cluster session without it is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tableaudit-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3) before running")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return the re-read frame."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tableaudit") -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_EXPENSIVE = ("Join", "Aggregate", "Generate", "Window", "Union", "Expand", "Sort", "MapInPandas")


def is_derived(df: DataFrame) -> bool:
    """True when ``df`` is more than a scan + projection + filter (a join, an
    aggregate, a generator ...), i.e. worth materialising once before several jobs."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except Exception:  # noqa: BLE001 - no JVM handle (remote session): do not cache
        return False
    return any(f"{op} " in plan or f"{op}[" in plan or f"\n{op}" in plan for op in _EXPENSIVE)


class reused:
    """Context manager: persist a derived input (memory, spilling to disk) for the
    several jobs an operator runs over it, and release it afterwards. Plain
    file scans are not cached: re-reading pruned columns is cheaper. A lost
    cached block is recomputed from its lineage."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.cached = False

    def __enter__(self) -> DataFrame:
        from pyspark import StorageLevel
        if self.df.isStreaming or self.df.storageLevel.useMemory or self.df.storageLevel.useDisk:
            return self.df
        if is_derived(self.df):
            self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached = True
        return self.df

    def __exit__(self, *exc):
        if self.cached:
            self.df.unpersist(blocking=False)
        return False
