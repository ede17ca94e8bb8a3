"""Sentiment, hashed text vectors and daily news features."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, HashingTF, Normalizer, PCAModel, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..constants import (
    EMBEDDING_DIMENSIONS, HASHED_TERMS, NEWS_FEATURES, SENTIMENT_BAND, embedding_columns,
    news_feature_columns,
)
from ..functions.numeric import safe_div
from ..functions.text import (
    article_text, lexicon_sentiment, non_empty, normalize_ticker, resolve_provider, strip_markup,
    text_or_empty,
)
from ..schema import require_columns
from ..session import written
from ..sources.files import exists
from .news_dedup import dedup_keys, deduplicate_news, kept_nodes, surviving

#: Aliases up to which their first words are held as a set in the plan.
FEW_ALIASES = 2_000

def with_sentiment(news: DataFrame, positive=None, negative=None) -> DataFrame:
    """Rows without a score get the lexicon score of their cleaned title and summary."""
    score = lexicon_sentiment(article_text(F.col("title"), F.col("summary")), positive, negative)
    return news.withColumn("sentiment_score", F.coalesce(F.col("sentiment_score"), score))


def score_text(df: DataFrame, text: str = "text", scorer=None, backend: str = "auto",
               positive=None, negative=None) -> DataFrame:
    """Add `sentiment_score` by a pluggable scorer.

    `scorer` is a zero-argument factory whose result maps a list of texts to a list of floats.
    It is built once per Python worker and fed Arrow batches. Without one (or with
    backend="lexicon") the word lists score inside the JVM.
    """
    if backend not in ("auto", "model", "lexicon"):
        raise ValueError("sentiment backend must be one of: auto, model, lexicon")
    if backend == "model" and scorer is None:
        raise ValueError("sentiment backend 'model' needs a scorer")
    lexicon = lexicon_sentiment(F.col(text), positive, negative)
    if scorer is None or backend == "lexicon":
        return df.withColumn("sentiment_score", lexicon)

    from typing import Iterator

    import pandas as pd

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), dtype="float64")

    scored = run(F.col(text))
    # a scorer may return nothing for a text; automatic mode then falls back to the word lists
    return df.withColumn(
        "sentiment_score", scored if backend == "model" else F.coalesce(scored, lexicon)
    )


def prepare_articles(news: DataFrame, positive=None, negative=None) -> DataFrame:
    """De-duplicated articles with text, source, provider, score and its bucket flags."""
    require_columns(news, ["ticker", "date", "title", "summary", "url", "source"], "news data")
    provider = F.col("provider") if "provider" in news.columns else F.lit(None).cast("string")
    text = article_text(F.col("title"), F.col("summary"))
    base = (
        news.withColumn("date", F.col("date").cast("date"))
        .na.drop(subset=["ticker", "date"])
        .select(
            "ticker", "date",
            *(["ingest_order"] if "ingest_order" in news.columns else []),
            # a generator drops empty texts while cleaning each text only once; a plain filter
            # would be pushed below and clean it a second time
            F.explode(F.filter(F.array(text), lambda t: F.length(t) > 0)).alias("text"),
            F.coalesce(non_empty(F.col("source")), F.lit("Unknown")).alias("source"),
            provider.alias("provider"),
        )
        .withColumn("provider", resolve_provider(F.col("provider"), F.col("source")))
    )
    return base.withColumn("sentiment_score", lexicon_sentiment(F.col("text"), positive, negative))


def _entropy(n, source_n, sources):
    """Normalised entropy from row counts and the count of each row's source; one source gives 0."""
    # -sum p ln p = ln N - (sum n ln n_source) / N, so the shares need no second pass
    total = F.sum(n)
    entropy = F.ln(total) - F.sum(n * F.ln(source_n)) / total
    kinds = sources.cast("double")
    return F.when(kinds > 1, safe_div(entropy, F.ln(kinds))).otherwise(F.lit(0.0))


def source_diversity(articles: DataFrame) -> DataFrame:
    """Normalised entropy of the sources of each (ticker, date); one source or none gives 0."""
    counts = (
        articles.select("ticker", "date", non_empty(F.col("source")).alias("source"))
        .where("source is not null")
        .groupBy("ticker", "date", "source").agg(F.count("*").cast("double").alias("n"))
    )
    n = F.col("n")
    return counts.groupBy("ticker", "date").agg(
        _entropy(n, n, F.count("*")).alias("source_diversity")
    )


def daily_news(articles: DataFrame, vectors: bool = False) -> DataFrame:
    """Daily features per ticker, in one pass over the texts.

    Articles fold to (ticker, date, source, provider) by a partial aggregate. What is left is
    small; one exchange by (ticker, date) then serves the distinct counts, the entropy and the
    merge of the moments. Means are merged around the day's lowest one, so equal scores give a
    deviation of exactly zero.
    """
    s = F.col("sentiment_score")
    folded = (
        articles.groupBy("ticker", "date", "source", "provider").agg(
            F.count("*").cast("double").alias("n"), F.avg(s).alias("m"),
            (F.var_pop(s) * F.count(s)).alias("m2"), F.min(s).alias("lo"), F.max(s).alias("hi"),
            F.sum(F.abs(s)).alias("size"),
            F.sum((s > SENTIMENT_BAND).cast("bigint")).alias("pos"),
            F.sum((s < -SENTIMENT_BAND).cast("bigint")).alias("neg"),
            F.sum(s.between(-SENTIMENT_BAND, SENTIMENT_BAND).cast("bigint")).alias("mid"),
        )
        .repartition("ticker", "date")
    )
    day = ["ticker", "date"]

    def first_of(c):
        order = "provider" if c == "source" else "source"
        return (F.row_number().over(W.partitionBy(*day, c).orderBy(order)) == 1).cast("bigint")

    n = F.col("n")
    known = folded.select(
        "*", F.min("m").over(W.partitionBy(*day)).alias("base"),
        F.sum("n").over(W.partitionBy(*day, "source")).alias("source_n"),
        first_of("source").alias("new_source"), first_of("provider").alias("new_provider"),
    )
    off = F.col("m") - F.col("base")
    total, shift = F.sum(n), F.sum(n * off)
    spread = F.sum("m2") + F.sum(n * off * off) - shift * shift / total
    sources = F.sum("new_source")
    daily = known.groupBy(*day).agg(
        (F.first("base") + shift / total).alias("sentiment_mean"),
        F.when(
            total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(total - 1, F.lit(0.0)))
        ).otherwise(F.lit(0.0)).alias("sentiment_std"),
        total.cast("bigint").alias("news_count"),
        F.min("lo").alias("sentiment_min"), F.max("hi").alias("sentiment_max"),
        (F.sum("size") / total).alias("sentiment_abs_mean"),
        F.sum("pos").alias("positive_news_count"), F.sum("mid").alias("neutral_news_count"),
        F.sum("neg").alias("negative_news_count"), sources.alias("source_count"),
        F.sum("new_provider").alias("provider_count"),
        _entropy(n, F.col("source_n"), sources).alias("source_diversity"),
    )
    out = with_momentum(daily)
    if vectors:
        out = out.join(daily_vectors(articles), day, "left")
        return out.select(*day, *news_feature_columns())
    return out.select(*day, *NEWS_FEATURES)


def unique_daily_news(news: DataFrame, positive=None, negative=None, vectors: bool = False, order: str = "ingest_order") -> DataFrame:
    """`daily_news` of the articles that survive de-duplication.

    Every text is read where it lies and what it gives is stored; the surviving articles are
    picked from that, so no text travels.
    """
    articles = prepare_articles(news, positive, negative)
    scored = written((hashed_vectors(articles) if vectors else articles).drop("text"))
    return daily_news(surviving(scored, kept_nodes(dedup_keys(news, order)), order), vectors)


def with_momentum(daily: DataFrame) -> DataFrame:
    """Difference to the ticker's previous news day; the first day gets 0."""
    w = W.partitionBy("ticker").orderBy("date")
    step = F.col("sentiment_mean") - F.lag("sentiment_mean", 1).over(w)
    return daily.withColumn("sentiment_momentum", F.coalesce(step, F.lit(0.0)))


def hashed_vectors(articles: DataFrame, text: str = "text", size: int = HASHED_TERMS) -> DataFrame:
    """Term counts hashed to `size` buckets, scaled to unit length (column `hashed`)."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        Normalizer(inputCol="_tf", outputCol="hashed", p=2.0),
    ]
    return Pipeline(stages=stages).fit(articles).transform(articles).drop("_words", "_tf")


def fit_projection(df: DataFrame, column: str = "hashed", dimensions: int = EMBEDDING_DIMENSIONS):
    """The leading components of sparse vectors and where their mean falls; None below two rows.

    The covariance comes from the sparse vectors' products with the mean taken off as a rank-one
    term, so no vector is made dense. Components are as many as rows, width and `dimensions` allow.
    """
    if dimensions < 1:
        raise ValueError("output_dimensions must be at least 1")
    head = df.select(column).limit(dimensions + 1).collect()
    if len(head) < 2:
        return None
    k = min(dimensions, len(head), head[0][0].size)
    model = PCA(k=k, inputCol=column, outputCol="_reduced").fit(df)
    mean = df.select(Summarizer.mean(F.col(column)).alias("mean")).first().mean.toArray()
    return model, (mean @ model.pc.toArray()).tolist()


def project(df: DataFrame, projection, column: str = "hashed", dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Array column `embedding`: centred components of a fitted projection, padded with zeros."""
    if projection is None:
        body = F.slice(vector_to_array(F.col(column)), 1, dimensions)
        return df.withColumn("embedding", F.concat(body, F.array_repeat(F.lit(0.0), F.lit(dimensions) - F.size(body))))
    model, offset = projection
    centred = F.zip_with(vector_to_array(F.col("_reduced")), F.array(*map(F.lit, offset)), lambda x, m: x - m)
    padded = F.concat(centred, F.array_repeat(F.lit(0.0), dimensions - len(offset)))
    return model.setInputCol(column).transform(df).withColumn("embedding", padded).drop("_reduced")


def store_projection(projection, path: str) -> None:
    """A projection's model and offset below `path`, replacing none: versions are the caller's."""
    model, offset = projection
    model.write().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(offset,)], "offset array<double>").coalesce(1).write.json(f"{path}/offset")


def load_projection(spark: SparkSession, path: str):
    offset = spark.read.schema("offset array<double>").json(f"{path}/offset").first().offset
    return PCAModel.load(f"{path}/model"), offset


def reduce_vectors(df: DataFrame, column: str = "hashed", dimensions: int = EMBEDDING_DIMENSIONS, path: str | None = None) -> DataFrame:
    """Centre, project on the leading components, pad with zeros (array column `embedding`).

    With `path` a projection stored there is used again, so an article keeps its vector on later
    days; the first call stores it. The vectors are written once, as fitting reads them several times.
    """
    df = written(df)
    if path is not None and exists(df.sparkSession, f"{path}/offset/_SUCCESS"):
        return project(df, load_projection(df.sparkSession, path), column, dimensions)
    projection = fit_projection(df, column, dimensions)
    if path is not None and projection is not None:
        store_projection(projection, path)
    return project(df, projection, column, dimensions)


def daily_vectors(articles: DataFrame, dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Mean of each embedding dimension per ticker and date, as scalar columns."""
    hashed = (articles if "hashed" in articles.columns else hashed_vectors(articles)).select("ticker", "date", "hashed")
    reduced = reduce_vectors(hashed, dimensions=dimensions)
    return reduced.groupBy("ticker", "date").agg(
        *[F.avg(F.col("embedding")[i]).alias(c) for i, c in enumerate(embedding_columns(dimensions))]
    )


def _alias_index(aliases: DataFrame) -> tuple[DataFrame, list[str] | None, int, int]:
    """Aliases by their first word, those words if they are few, and the most words and leading signs of an alias."""
    names = aliases.select(normalize_ticker(F.col("ticker")).alias("ticker"), F.upper("alias").alias("_alias"))
    indexed = written(names.select(
        "ticker", "_alias", F.regexp_extract("_alias", "[A-Z0-9]+", 0).alias("_head"),
        F.size(F.regexp_extract_all("_alias", F.lit("[A-Z0-9]+"), F.lit(0))).alias("_words"),
        F.length(F.regexp_extract("_alias", "^[^A-Z0-9]*", 0)).alias("_front"),
    ).where("_head <> ''").distinct())
    most = indexed.agg(F.count("*"), F.max("_words"), F.max("_front")).first()
    heads = [r._head for r in indexed.select("_head").distinct().collect()] if most[0] <= FEW_ALIASES else None
    return indexed, heads, most[1] or 1, most[2] or 0


def tag_tickers(articles: DataFrame, aliases: DataFrame, text: str = "text", key: str = "ingest_order") -> DataFrame:
    """One row per article and ticker whose alias occurs as a whole word.

    A text is an array of words, each with the signs in front of it. Words that begin no alias drop
    out of the array (a set of at most FEW_ALIASES first words; beyond that the join does it); only
    the others leave it, each with a window of as many words as the longest alias has. An alias
    that is one plain word is found by that; others are looked for in their window.
    """
    names, heads, longest, front = _alias_index(aliases)
    plain = longest == 1 and front == 0

    def begins(word):
        return F.lit(True) if heads is None else word.isin(heads)

    if plain:
        words = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]+"), F.lit(0)))
        found = articles.select(key, F.explode(F.filter(words, begins)).alias("_head")).withColumn("_window", F.col("_head"))
    else:
        pieces = F.regexp_extract_all(F.upper(text), F.lit("[^A-Z0-9]*[A-Z0-9]+[^A-Z0-9]*$|[^A-Z0-9]*[A-Z0-9]+"), F.lit(0))
        parted = articles.select(key, pieces.alias("_pieces"))
        placed = F.transform("_pieces", lambda piece, i: F.struct(F.regexp_extract(piece, "[A-Z0-9]+", 0).alias("head"), i.alias("i")))

        def window(at):
            before = F.concat(
                F.coalesce(F.get("_pieces", at["i"] - 1), F.lit("")), F.regexp_extract(F.get("_pieces", at["i"]), "^[^A-Z0-9]*", 0)
            )
            own = F.regexp_replace(F.get("_pieces", at["i"]), "^[^A-Z0-9]*", "")
            return F.struct(at["head"].alias("head"), F.concat(
                F.right(before, F.lit(front + 1)), own, F.array_join(F.slice("_pieces", at["i"] + 2, F.lit(longest)), "")
            ).alias("window"))

        windows = F.array_distinct(F.transform(F.filter(placed, lambda at: begins(at["head"])), window))
        found = parted.select(key, F.explode(windows).alias("_at")).select(
            key, F.col("_at.head").alias("_head"), F.col("_at.window").alias("_window"))
    whole = F.concat(F.lit(r"(?<![A-Z0-9])\Q"), F.col("_alias"), F.lit(r"\E(?![A-Z0-9])"))
    return found.join(names, "_head").where((F.col("_alias") == F.col("_head")) | F.regexp_like("_window", whole)).select(key, "ticker").distinct()


def ticker_aliases(universe: DataFrame) -> DataFrame:
    """Ticker, suffixed ticker and provider symbol of every stock."""
    ticker = normalize_ticker(F.col("ticker"))
    return universe.select(
        ticker.alias("ticker"),
        F.explode(
            F.array_distinct(
                F.array_compact(F.array(ticker, F.concat(ticker, F.lit(".JK")), F.upper("yfinance_symbol")))
            )
        ).alias("alias"),
    )


def ingest_feed(entries: DataFrame, aliases: DataFrame, limit=None, key: str = "ingest_order") -> DataFrame:
    """Feed entries to tagged, de-duplicated articles in arrival order.

    `entries` holds key, date, title, summary, url, source, image_url. An entry that names
    several tickers gives one article each; ticker order inside an entry is alphabetical.
    """
    clean = entries.withColumns(
        {c: strip_markup(text_or_empty(F.col(c))) for c in ("title", "summary")}
    )
    tags = tag_tickers(clean.withColumn("text", F.concat_ws(" ", "title", "summary")), aliases, key=key)
    articles = clean.join(tags, key).withColumn("provider", F.lit("rss"))
    # tickers of one entry never compete, so the entry order alone decides within a ticker
    unique = deduplicate_news(articles, key)
    return unique if limit is None else unique.orderBy(key, "ticker").limit(limit)
