"""Merges of landed rows into key-unique tables, and table health checks."""

from pyspark.sql import DataFrame, functions as F

from ..sources.files import exists, write_bars

BAR_KEY = ["ticker", "date", "source", "interval"]


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the highest `order`; a partial aggregate, so repeats fold before travelling."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def merge_bars(existing: DataFrame, incoming: DataFrame, stocks: DataFrame, order=()) -> DataFrame:
    """Existing bars with those of known stocks replaced or added; the newest landed row wins."""
    known = incoming.join(stocks.select("ticker").distinct(), "ticker", "left_semi").select(*incoming.columns)
    fresh = newest(known, BAR_KEY, list(order)).select(*existing.columns)
    return existing.join(fresh.select(*BAR_KEY), BAR_KEY, "left_anti").select(*existing.columns).unionByName(fresh)


def bar_counts(incoming: DataFrame, stocks: DataFrame) -> DataFrame:
    """Rows read and rows written of a bar merge, one row."""
    known = stocks.select("ticker", F.lit(1).alias("_known")).distinct()
    return incoming.join(known, "ticker", "left").agg(
        F.count("*").alias("rows_read"), F.count("_known").alias("rows_processed")
    )


def upsert_bar_table(spark, path: str, incoming: DataFrame, stocks: DataFrame, order=()) -> None:
    """Merge into a table partitioned by year, rewriting only the years that got rows.

    The list of years is bounded by the calendar. Rewritten folders are staged and swapped at
    commit, so a failed job leaves the table as it was and a repeat gives the same result.
    """
    years = [r.y for r in incoming.select(F.year("date").alias("y")).distinct().collect() if r.y is not None]
    if not years:
        return
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("year").isin(years)).drop("year")
    else:
        old = incoming.limit(0)
    columns = [c for c in incoming.columns if c in old.columns and c not in set(order)]
    write_bars(merge_bars(old.select(*columns), incoming, stocks, order), path)


def merge_universe(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stocks by ticker; incoming rows replace stored ones."""
    fresh = newest(incoming, ["ticker"], []).select(*existing.columns)
    return existing.join(fresh.select("ticker"), "ticker", "left_anti").select(*existing.columns).unionByName(fresh)


def universe_counts(incoming: DataFrame) -> DataFrame:
    return incoming.agg(
        F.count("*").alias("rows_read"), F.count("*").alias("rows_processed"),
        F.count_distinct("sector").alias("sectors_processed"),
    )


def validate_tables(tables: dict[str, DataFrame | None], required: dict[str, list[str]] | None = None, spark=None) -> DataFrame:
    """One row per expected table: present, rows, latest date, missing columns, verdict."""
    out = None
    for name, df in tables.items():
        needed = (required or {}).get(name, [])
        absent = sorted(set(needed) - set(df.columns)) if df is not None else sorted(needed)
        if df is None:
            row = spark.range(1).select(F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("date").alias("latest_date"))
        else:
            latest = F.max(F.col("date").cast("date")) if "date" in df.columns else F.lit(None).cast("date")
            row = df.agg(F.count("*").alias("rows"), latest.alias("latest_date"))
        verdict = (
            F.lit("missing") if df is None
            else F.when(F.lit(bool(absent)), "missing columns").when(F.col("rows") == 0, "empty").otherwise("ok")
        )
        row = row.select(
            F.lit(name).alias("table_name"), F.lit(df is not None).alias("exists"), "rows", "latest_date",
            F.lit(", ".join(absent)).alias("missing_columns"), verdict.alias("verdict"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def require_valid(report: DataFrame) -> None:
    bad = report.where("verdict <> 'ok'").collect()
    if bad:
        raise ValueError("; ".join(f"{r.table_name}: {r.verdict} {r.missing_columns}".strip() for r in bad))
