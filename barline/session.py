"""Session settings the jobs rely on."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "barline", cores: str = "8", **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session without one takes a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="barline-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a cached or local copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def even_partitions(df: DataFrame) -> int:
    """About as many partitions as `df` has, in whole rounds of all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, round(df.rdd.getNumPartitions() / cores)) * cores


def spread(df: DataFrame) -> DataFrame:
    """Rows in reliable storage, dealt evenly over all cores: a small table comes in few partitions, which hold up what reads it often."""
    stored = cut_lineage(df)
    parts = even_partitions(stored)
    return stored if parts == stored.rdd.getNumPartitions() else cut_lineage(stored.repartition(parts))


def run_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder, for tables a job writes and reads back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: lineage is cut and sizes are known."""
    folder = folder or run_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
