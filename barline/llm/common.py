"""Reading tables and running chunked Arrow functions over texts."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytes_of_text import chunks, column_bytes

BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as by rows, so a run of long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_texts(
    df: DataFrame,
    compute: Callable[[np.ndarray, np.ndarray], list],
    fields: str,
    keep: tuple[str, ...] = ("doc_id",),
    column: str = "text",
    explode: bool = False,
) -> DataFrame:
    """Columns `keep` of each row beside what `compute(data, offsets)` makes of chunks of its texts.

    `compute` gets the bytes of some whole texts and returns one array per field of `fields`, each
    with a value per text. With `explode` its first array holds the row number of each result row
    and the others any number of values per text. A null text has no bytes.
    """
    bound_batches(df.sparkSession)
    kept = ", ".join(f"`{name}` {kind}" for name, kind in df.select(*keep).dtypes)
    names = list(keep) + [part.strip().split(" ")[0] for part in fields.split(",")]

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
            carried = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            for a, b in chunks(offsets):
                made = compute(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = [c.slice(a, b - a) for c in carried]
                if explode:
                    number, made = pa.array(made[0]), made[1:]
                    rows = [c.take(number) for c in rows]
                yield pa.RecordBatch.from_arrays(rows + [m if isinstance(m, pa.Array) else pa.array(m) for m in made], names)

    needed = df.select(*dict.fromkeys([*keep, column]))
    return needed.mapInArrow(run, f"{kept}, {fields}" if kept else fields)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by row number."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
