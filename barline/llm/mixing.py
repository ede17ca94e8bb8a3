"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k drawn from a Poisson distribution whose mean is the
source's target repetition rate: weight * target rows / rows of the source. The draw inverts the
distribution at a number in [0, 1) hashed from the seed and the document's id, so a rerun, a lost
executor or another partitioning gives the same copies. Every copy gets a hashed key; rows are
dealt to partitions by it and sorted by it, which is a uniformly random order of all copies.

Without given weights a source's share follows the power ALPHA of its rows, which lifts small
sources. A source without a given weight gets no copies. A source's inverse table has
rate + 12 sqrt(rate) + 40 entries.

A null source is a source of its own. Rows without doc_id are hashed by their text. Repeated rows
draw the same count. Other columns ride along; names starting with `_mix_` are used in between.
"""

from pyspark.sql import DataFrame, functions as F

from .common import documents
from .storage import stored

SEED, ALPHA = 17, 0.5
#: Sources up to which their rates are broadcast; each has some hundred numbers.
SOURCES = 20_000
_HEX, _WIDTH = 13, float(2**52)


def _draw(text):
    """A number in [0, 1) with 52 bits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("double") / _WIDTH


def rates(docs: DataFrame, weights: dict | None = None, target_rows: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, its rows, its repetition rate, and the rate's cumulative distribution from 0 copies on."""
    counts = docs.groupBy("source").agg(F.count("*").alias("_mix_rows"))
    if weights is None:
        weight = F.pow("_mix_rows", F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("_mix_weight", weight)
    total = weighted.agg(F.sum("_mix_weight")).scalar()
    target = F.lit(float(target_rows)) if target_rows is not None else docs.agg(F.count("*").cast("double")).scalar()
    rate = F.col("_mix_weight") / total * target / F.col("_mix_rows")
    steps = F.ceil(F.col("_mix_rate") + 12 * F.sqrt("_mix_rate") + 40).cast("int")
    start = F.struct((-F.col("_mix_rate")).alias("log"), F.array(F.exp(-F.col("_mix_rate"))).alias("below"))

    def following(acc, k):
        log = acc["log"] + F.ln("_mix_rate") - F.ln(k)
        return F.struct(log.alias("log"), F.concat(acc["below"], F.array(F.element_at(acc["below"], -1) + F.exp(log))).alias("below"))

    table = F.aggregate(F.sequence(F.lit(1), steps), start, following)["below"]
    return weighted.withColumn("_mix_rate", F.coalesce(rate, F.lit(0.0))).select(
        "source", "_mix_rows", "_mix_rate", F.when(F.col("_mix_rate") > 0, table).otherwise(F.array(F.lit(1.0))).alias("_mix_below")
    )


def mix(docs: DataFrame, weights: dict | None = None, target_rows: float | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Every copy of every document, with its number `_mix_copy` (from 1) and its `_mix_key`, in random order."""
    table = stored(rates(docs, weights, target_rows, alpha).select(F.col("source").alias("_mix_source"), "_mix_below"))
    if table.count() <= SOURCES:
        table = F.broadcast(table)  # so documents of one source never meet in one place
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_name", name)
    u = _draw(F.concat(F.lit(f"{seed}:"), "_mix_name"))
    copies = F.size(F.filter("_mix_below", lambda c: c <= F.col("_mix_u")))
    placed = drawn.withColumn("_mix_u", u).withColumn("_mix_copies", copies).where("_mix_copies > 0").withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    )
    key = F.md5(F.concat(F.lit(f"{seed}:"), "_mix_name", F.lit(":"), F.col("_mix_copy").cast("string")).cast("binary"))
    ready = placed.withColumn("_mix_key", key).select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_copy", "_mix_key")
    return ready.repartition("_mix_key").sortWithinPartitions("_mix_key")


def op6_mix_sources(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    return mix(docs).withColumnsRenamed({"_mix_copy": "copy", "_mix_key": "shuffle_key"})


SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (
  SELECT source, pow(n, {ALPHA}) / (SELECT sum(pow(n, {ALPHA})) FROM counts) * (SELECT count(*) FROM documents)::DOUBLE / n AS rate FROM counts
), terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rated)
), tables AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, {_HEX}))::BIGINT / {_WIDTH} AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (t.below <= d.u) AS copies
  FROM drawn d JOIN tables t ON t.source IS NOT DISTINCT FROM d.source GROUP BY ALL
), copied AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted)
SELECT *, md5('{SEED}:' || doc_id::VARCHAR || ':' || copy::VARCHAR) AS shuffle_key FROM copied
"""
