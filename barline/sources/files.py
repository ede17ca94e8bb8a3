"""Table scans by suffix and sinks that refuse to write nothing."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV for `.csv`, Parquet for everything else; CSV columns stay text without a schema."""
    if path.lower().endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _publish(df: DataFrame, path: str, what: str, kind: str, write) -> None:
    """Writes beside the table and moves there only rows that exist; the plan runs once.

    Every writer stages in a folder of its own. The old table steps aside by a rename and goes only
    when the new one stands; if that fails, it steps back. So there is a whole table at any time,
    at its path or, between two renames, right beside it.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.staged-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write(df, staged)
    written = spark.read.schema(df.schema).format(kind).option("header", True).load(staged)
    source, target, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, old))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if written.isEmpty():
        fs.delete(source, True)
        raise ValueError(f"No {what} to write")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"{staged} could not be moved to {path}")
    if had:
        fs.delete(aside, True)


def write_parquet(df: DataFrame, path: str, what: str = "rows", partition_by=()) -> None:
    _publish(df, path, what, "parquet", lambda rows, to: rows.write.mode("overwrite").partitionBy(*partition_by).parquet(to))


def write_csv(df: DataFrame, path: str, what: str = "rows") -> None:
    _publish(df, path, what, "csv", lambda rows, to: rows.write.mode("overwrite").option("header", True).csv(to))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by year, so reads of a period and upserts touch few folders."""
    rows = bars.withColumn("year", F.year("date"))
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year").parquet(path)
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")


def concat_bars(parts: list[DataFrame]) -> DataFrame:
    """Union of per-provider or per-instrument tables; no global sort."""
    if not parts:
        raise ValueError("No price data was collected for the requested ticker universe")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def artifact_status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, exists and size_bytes (with all files below a folder), by listing alone."""
    rows = []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        there = fs.exists(hadoop)
        rows.append((path, there, fs.getContentSummary(hadoop).getLength() if there else None))
    return spark.createDataFrame(rows, "path string, exists boolean, size_bytes bigint")


def footer_stats(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row with a Parquet table's rows and each column's least and greatest value, read from its footers.

    A session of its own reads the table with the newer source, which takes counts and the extremes
    of numbers and dates from the footers' statistics instead of scanning data. Extremes of texts and
    timestamps are not exact there; with them it is a scan of those columns alone.
    """
    session = spark.newSession()
    listed = [s for s in session.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(listed))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max))]
    return session.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *ends)


def table_status(spark: SparkSession, folder: str, dates: dict[str, str | None]) -> DataFrame:
    """Presence, size, rows and latest date of the Parquet tables of a folder; `dates` names their date columns."""
    base, rows = folder.rstrip("/"), []
    for name, column in dates.items():
        path = f"{base}/{name}.parquet"
        status = artifact_status(spark, [path]).first()
        found = footer_stats(spark, path, *([column] if column else [])).first() if status.exists else None
        latest = str(found[f"greatest_{column}"])[:10] if found is not None and column and found[f"greatest_{column}"] is not None else None
        rows.append((name, status.exists, status.size_bytes, found.rows if found is not None else 0, latest))
    return spark.createDataFrame(rows, "table_name string, exists boolean, size_bytes bigint, rows bigint, latest string").select(
        "table_name", "exists", "size_bytes", "rows", F.to_date("latest").alias("latest_date")
    )
