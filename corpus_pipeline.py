"""A training corpus from raw documents: clean, de-duplicate, mask, mix, encode.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of
its input; the last one returns the encoded corpus. `run` writes each stage's rows as Parquet to
the shared folder and reads them back for the next. Columns besides doc_id, text, source and
n_chars ride along, whatever their names. An empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm import bpe, mixing, near_dedup, personal_data, quality_rules
from barline.llm.common import documents
from barline.llm.storage import stored


#: Similarity, in per cent, from which the pipeline takes documents for near copies.
NEAR_PERCENT = 80


def _packed(docs: DataFrame) -> DataFrame:
    """A row's columns in one, so that an operator's own names can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: str, chars) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.col(chars) if isinstance(chars, str) else chars}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the rules or lose too much text go as a whole."""
    cleaned = quality_rules.clean(_packed(docs), keep=("row",)).where("kept")
    return _unpacked(cleaned, docs, "clean_text", F.length("clean_text").cast("bigint"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays, once.

    Rows that share a doc_id count as repeats only if they share the text too; of repeats that
    differ in other columns the one of the smallest hash stays, whatever is run again. Rows without
    doc_id can't be told apart by it; they all stay.
    """
    kept = near_dedup.near_duplicates(docs, NEAR_PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    packed = _packed(docs).withColumn("doc_id", F.col("row.doc_id")).where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    others = [F.col(f"row.`{c}`").cast("string") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map" not in kind]
    once = packed.groupBy("doc_id", F.xxhash64("text"), F.md5("text")).agg(F.min_by("row", F.xxhash64(*others)).alias("row"))
    return once.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    masked = personal_data.mask(_packed(docs), keep=("row",))
    return _unpacked(masked, docs, "masked_text", "masked_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in random order."""
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"column_{k}" for k, c in enumerate(docs.columns)])
    return mixing.mix(plain).drop("_mix_copy", "_mix_key").toDF(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the text's token ids and the digests of ids and decoded text."""
    encoded = bpe.encode(docs, keep=("doc_id", "source"))
    decoded = bpe.decode(encoded, keep=("doc_id", "source", "n_tokens", "ids"))
    return decoded.select(
        "doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules_stage),
    ("near duplicates", near_dedup_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "*")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Token merging can't be expressed in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
