"""Registered queries over articles, payloads, pages and their fusion with bars."""

from pyspark.sql import Window as W, functions as F

from ..constants import NEWS_FEATURES, news_feature_columns
from ..functions import labels as L, text as T, urls as U
from ..operators import fusion, news_dedup, news_features, serving
from ..sources import pages as P, payloads, universe as UL, views
from ..session import run_folder, written
from . import derived
from .derived import rounded
from .sqlkit import CTES, NEGATIVE, POSITIVE, clean, lexicon, rnd, sql, squeeze, tokens

QUERIES, ORACLES = {}, {}
AS_OF = "2024-01-01"


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# --- text functions over whole documents and pages ---------------------------------------------

@query("clean_text", sql(f"SELECT page_id, md5({clean('html')}) AS cleaned FROM pages"))
def clean_text(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.md5(T.clean_text(F.col("html"))).alias("cleaned"))


@query("lexicon_sentiment", sql(f"SELECT doc_id, {rnd(lexicon('text'))} AS score FROM documents"))
def lexicon_sentiment(spark, sf):
    docs = views.table(spark, sf, "documents")
    return rounded(docs.select("doc_id", T.lexicon_sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("score")))


@query("score_text", sql(f"SELECT conv_id, turn, {rnd(lexicon('text'))} AS sentiment_score FROM conversations"))
def score_text(spark, sf):
    rows = views.table(spark, sf, "conversations")
    scored = news_features.score_text(rows, "text", None, "auto", POSITIVE, NEGATIVE)
    return rounded(scored.select("conv_id", "turn", "sentiment_score"))


@query("fill_article_sentiment", sql(
    f"SELECT ingest_order, {rnd('CASE WHEN ticker LIKE ' + repr('%1') + ' THEN 0.25 ELSE ' + lexicon('text') + ' END')} AS sentiment_score FROM t",
    t=f"SELECT ingest_order, ticker, {clean('title || chr(32) || summary')} AS text FROM news"))
def fill_article_sentiment(spark, sf):
    news = views.news(spark, sf).withColumn("sentiment_score", F.when(F.col("ticker").endswith("1"), 0.25))
    out = news_features.with_sentiment(news, POSITIVE, NEGATIVE)
    return rounded(out.select("ingest_order", "sentiment_score"))


@query("title_tokens", sql(f"SELECT doc_id, len({tokens('text')}) AS n, md5(array_to_string({tokens('text')}, ' ')) AS words FROM documents"))
def title_tokens(spark, sf):
    words = T.title_tokens(F.col("text"))
    docs = views.table(spark, sf, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


CANONICAL = """
  SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical
  FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))
               || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') AS base,
               coalesce(array_to_string(list_transform(list_sort(list_filter(list_transform(
                 list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> ''),
                 lambda p: {'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(p, len(split_part(p, '=', 1)) + 2), '+', ' '))}),
                 lambda p: NOT starts_with(lower(p.k), 'utm_') AND lower(p.k) NOT IN ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))),
                 lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&'), '') AS q
        FROM pages)"""


@query("canonical_url", sql(CANONICAL))
def canonical_url(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


SOURCE_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'GDELT - ' || source WHEN 1 THEN ' NewsAPI - ' || source WHEN 2 THEN 'Mediastack' ELSE source END"


@query("provider_infer", f"""SELECT doc_id, coalesce(nullif(lower(trim(p)), ''), CASE WHEN lower(trim(s)) LIKE 'gdelt%' THEN 'gdelt'
    WHEN lower(trim(s)) LIKE 'newsapi%' THEN 'newsapi' WHEN lower(trim(s)) LIKE 'mediastack%' THEN 'mediastack' ELSE 'rss' END) AS provider
    FROM (SELECT doc_id, {SOURCE_TEXT} AS s, CASE WHEN lang = 'de' THEN ' Wire ' WHEN lang = 'fr' THEN ' ' END AS p FROM documents)""")
def provider_infer(spark, sf):
    docs = views.table(spark, sf, "documents")
    kind = F.col("doc_id") % 4
    source = (
        F.when(kind == 0, F.concat(F.lit("GDELT - "), "source")).when(kind == 1, F.concat(F.lit(" NewsAPI - "), "source"))
        .when(kind == 2, "Mediastack").otherwise(F.col("source"))
    )
    provider = F.when(F.col("lang") == "de", " Wire ").when(F.col("lang") == "fr", " ")
    return docs.select("doc_id", T.resolve_provider(provider, source).alias("provider"))


@query("company_query", """SELECT s_suppkey, trim(regexp_replace(translate(n, '.,', '  '), ' +', ' ', 'g')) AS company,
    '(S' || s_suppkey || ' OR "' || trim(regexp_replace(translate(n, '.,', '  '), ' +', ' ', 'g')) || '")' AS search
    FROM (SELECT s_suppkey, s_name AS n FROM supplier)""")
def company_query(spark, sf):
    rows = views.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.concat(F.lit("PT "), "s_name", F.lit(" (Persero) Tbk.")).alias("name"),
    )
    return rows.select(
        "s_suppkey", T.clean_company_name(F.col("name")).alias("company"),
        T.news_query(F.col("ticker"), F.col("name"), "gdelt").alias("search"),
    )


@query("date_parse_mixed", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN DATE '{AS_OF}' ELSE CAST(o_orderdate AS DATE) END AS api_date,
    CASE WHEN o_orderkey % 3 = 2 THEN DATE '{AS_OF}' ELSE CAST(o_orderdate AS DATE) END AS feed_date FROM orders""")
def date_parse_mixed(spark, sf):
    d = F.col("o_orderdate").cast("date")
    kind, feed = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    api = F.when(kind == 0, F.date_format(d, "yyyyMMdd'120000'")).when(kind == 1, F.date_format(d, "yyyy-MM-dd'T'10:00:00'Z'")).when(
        kind == 2, F.date_format(d, "yyyy-MM-dd"))
    published = F.when(feed == 0, F.date_format(d, "EEE, dd MMM yyyy '23:30:00 +0700'")).otherwise(F.lit("short"))
    updated = F.when(feed == 1, F.date_format(d, "yyyy-MM-dd'T'10:00:00'Z'"))
    return views.table(spark, sf, "orders").select(
        "o_orderkey", T.api_date(api, AS_OF).alias("api_date"),
        T.feed_date(published, updated, F.lit(None).cast("string"), AS_OF).alias("feed_date"),
    )


@query("dedup_date_key", sql("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events"))
def dedup_date_key(spark, sf):
    return views.table(spark, sf, "events").select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"))


@query("ticker_normalise", sql("""SELECT s_suppkey, upper(trim(s_name)) || '.JK' AS one_suffix, upper(trim(s_name)) AS no_suffix FROM supplier"""))
def ticker_normalise(spark, sf):
    raw = F.concat(F.lit(" "), F.lower("s_name"), F.lit(".jk.jk "))
    return views.table(spark, sf, "supplier").select(
        "s_suppkey", T.normalize_ticker(raw).alias("one_suffix"), T.strip_every_suffix(raw).alias("no_suffix")
    )


# --- tagging and de-duplication ----------------------------------------------------------------

ALIAS_SQL = {
    "alias": """SELECT n_name AS ticker, upper(w) AS alias FROM (SELECT n_name, regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]+')[1] AS w
                FROM nation JOIN documents ON doc_id = n_nationkey) WHERE w <> ''""",
    "tagged": """SELECT DISTINCT doc_id AS ingest_order, ticker FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]+'))) AS alias FROM documents)
                 JOIN alias USING (alias)""",
}


def first_words(spark, sf):
    """Alias table: the first word of the document whose id is the nation's key."""
    docs = views.table(spark, sf, "documents")
    word = F.get(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z0-9]+)"), 1), F.lit(0))
    nation = views.table(spark, sf, "nation")
    return nation.join(docs, F.col("doc_id") == F.col("n_nationkey")).select(
        F.col("n_name").alias("ticker"), word.alias("alias")
    ).where("alias is not null")


@query("ticker_tagging", sql("SELECT * FROM tagged", **ALIAS_SQL))
def ticker_tagging(spark, sf):
    docs = views.table(spark, sf, "documents").withColumnRenamed("doc_id", "ingest_order")
    return news_features.tag_tickers(docs, first_words(spark, sf))


MENTIONS = """CASE doc_id % 5 WHEN 0 THEN ' saham ' || lower(n_name) || '.jk naik' WHEN 1 THEN ' (' || n_name || ') turun' WHEN 2 THEN ' indeks ^jkse,'
    WHEN 3 THEN ' kode X' || n_name || '9 dan A^JKSE' ELSE ' JKSE ' || replace(n_name, ' ', '-') END"""


def mentioned(spark, sf):
    """Whole documents, each behind which some spelling of a stock or of the index is put."""
    docs, nation = views.table(spark, sf, "documents"), views.table(spark, sf, "nation")
    named = docs.join(nation, F.col("n_nationkey") == F.col("doc_id") % 25)
    return named.select(F.col("doc_id").alias("ingest_order"), F.concat("text", F.expr(MENTIONS)).alias("text"))


@query("ticker_alias_tagging", sql(
    """SELECT DISTINCT ingest_order, ticker FROM mentioned JOIN alias ON contains(body, head)
         AND regexp_matches(body, '(^|[^A-Z0-9])' || replace(replace(alias, '.', '[.]'), '^', '\\^') || '($|[^A-Z0-9])')""",
    mentioned=f"SELECT doc_id AS ingest_order, upper(replace(text || {MENTIONS}, 'ß', 'ss')) AS body FROM documents JOIN nation ON n_nationkey = doc_id % 25",
    alias="""SELECT ticker, alias, regexp_extract(alias, '[A-Z0-9]+') AS head FROM (
        SELECT n_name AS ticker, unnest([n_name, n_name || '.JK']) AS alias FROM nation UNION ALL SELECT 'IHSG', unnest(['IHSG', 'IHSG.JK', '^JKSE']))"""))
def ticker_alias_tagging(spark, sf):
    """Tickers, suffixed tickers and symbols of the universe and its index, found in whole texts."""
    index = spark.range(1).select(F.lit("IHSG").alias("ticker"), F.lit("^jkse").alias("yfinance_symbol"))
    stocks = views.universe(spark, sf).select("ticker", "yfinance_symbol").unionByName(index)
    return news_features.tag_tickers(mentioned(spark, sf), news_features.ticker_aliases(stocks))


GREEDY = {
    "keyed": f"""SELECT ingest_order AS node, ticker, date, coalesce(canonical, '') AS url, {tokens('title')} AS words,
                 row_number() OVER (PARTITION BY ticker ORDER BY ingest_order) AS k
                 FROM news LEFT JOIN (SELECT DISTINCT url, canonical FROM pages JOIN canon USING (page_id)) USING (url)""",
    "canon": CANONICAL,
    "walk": """
      SELECT ticker, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS node, false AS kept, CAST([] AS VARCHAR[]) AS urls,
             CAST([] AS STRUCT(d DATE, w VARCHAR[])[]) AS titles FROM (SELECT DISTINCT ticker FROM keyed)
      UNION ALL
      SELECT ticker, k, node, ok, CASE WHEN ok AND url <> '' THEN list_append(urls, url) ELSE urls END,
             CASE WHEN ok AND len(words) > 0 THEN list_append(titles, {'d': date, 'w': words}) ELSE titles END
      FROM (SELECT n.*, urls, titles, NOT (n.url <> '' AND list_contains(urls, n.url)) AND NOT (len(n.words) > 0 AND len(list_filter(list_filter(titles, lambda t: t.d = n.date), lambda t:
              (t.w = n.words OR (least(len(t.w), len(n.words)) >= 4 AND
                (len(list_intersect(t.w, n.words)) >= 0.9 * (len(t.w) + len(n.words) - len(list_intersect(t.w, n.words))) OR
                 (len(list_intersect(t.w, n.words)) >= 0.9 * least(len(t.w), len(n.words)) AND
                  len(list_intersect(t.w, n.words)) >= 0.75 * (len(t.w) + len(n.words) - len(list_intersect(t.w, n.words)))))))
              )) > 0) AS ok
            FROM walk JOIN keyed n ON n.ticker = walk.ticker AND n.k = walk.k + 1)""",
}
GREEDY = {k: GREEDY[k] for k in ("canon", "keyed", "walk")}


@query("news_dedup", sql("SELECT ticker, node AS ingest_order FROM walk WHERE kept", True, **GREEDY))
def dedup(spark, sf):
    return news_dedup.deduplicate_news(views.news(spark, sf)).select("ticker", "ingest_order")


def _greedy(keyed, final):
    """The same walk over other articles: `keyed` gives node, ticker, date, url, words and k."""
    return sql(final, True, **{**GREEDY, "keyed": keyed})


CANONICAL_URL = "LEFT JOIN (SELECT DISTINCT url, canonical FROM pages JOIN canon USING (page_id)) USING (url)"
APPENDED = f"""SELECT node, ticker, date, coalesce(canonical, '') AS url, {tokens('title')} AS words, row_number() OVER (PARTITION BY ticker ORDER BY node) AS k
    FROM (SELECT *, CASE WHEN date < DATE '1997-01-01' THEN ingest_order ELSE ingest_order - (SELECT min(ingest_order) FROM news WHERE date >= DATE '1997-01-01')
            + (SELECT max(ingest_order) + 1 FROM news WHERE date < DATE '1997-01-01') END AS node FROM news) {CANONICAL_URL}"""
FED = f"""SELECT ingest_order AS node, t.ticker, date, coalesce(canonical, '') AS url, {tokens(squeeze("regexp_replace(title, '<[^>]+>', ' ', 'g')"))} AS words,
    row_number() OVER (PARTITION BY t.ticker ORDER BY ingest_order) AS k
    FROM (SELECT DISTINCT ingest_order, ticker FROM (SELECT ingest_order, unnest(list_distinct(regexp_extract_all(upper(replace({squeeze("regexp_replace(title || ' ' || summary, '<[^>]+>', ' ', 'g')")}, 'ß', 'ss')), '[A-Z0-9]+'))) AS alias FROM news)
          JOIN alias USING (alias)) t JOIN news USING (ingest_order) {CANONICAL_URL}"""


@query("append_existing_dedup", _greedy(APPENDED, "SELECT keyed.ticker, keyed.node AS ingest_order, date FROM walk JOIN keyed ON keyed.ticker = walk.ticker AND keyed.node = walk.node WHERE kept"))
def append_existing_dedup(spark, sf):
    news = views.news(spark, sf)
    old, new = news.where("date < '1997-01-01'"), news.where("date >= '1997-01-01'")
    return news_dedup.append_and_deduplicate(old, new).select("ticker", "ingest_order", "date")


@query("feed_ingest", sql("SELECT node AS ingest_order, ticker, 'rss' AS provider FROM walk WHERE kept", True, alias=ALIAS_SQL["alias"], **{**GREEDY, "keyed": FED}))
def feed_ingest(spark, sf):
    entries = views.news(spark, sf).select("ingest_order", "date", "title", "summary", "url", "source", "image_url")
    return news_features.ingest_feed(entries, first_words(spark, sf)).select("ingest_order", "ticker", "provider")


# --- daily news features -----------------------------------------------------------------------

DAILY_COLUMNS = ", ".join(
    c if c.endswith("_count") else f"{rnd(c)} AS {c}" for c in NEWS_FEATURES
)


@query("news_daily", sql(f"SELECT ticker, date, {DAILY_COLUMNS} FROM daily"))
def news_daily(spark, sf):
    return rounded(derived.daily(spark, sf))


#: The daily chain over the articles that the greedy walk keeps.
UNIQUE_DAILY = {
    **GREEDY, "kept": "SELECT ticker, node AS ingest_order FROM walk WHERE kept",
    "articles": CTES["articles"].replace("FROM news)", "FROM news WHERE (ticker, ingest_order) IN (SELECT (ticker, ingest_order) FROM kept))"),
    **{name: CTES[name] for name in ("per_source", "diversity", "daily0", "daily")},
}


@query("news_daily_deduplicated", sql(f"SELECT ticker, date, {DAILY_COLUMNS} FROM daily", True, **UNIQUE_DAILY))
def news_daily_deduplicated(spark, sf):
    return rounded(derived.unique_daily(spark, sf, vectors=False))


@query("news_daily_unique")
def news_daily_unique(spark, sf):
    """De-duplicated articles to daily features with the 50 text dimensions."""
    return derived.unique_daily(spark, sf)


@query("source_diversity", sql(f"SELECT ticker, date, {rnd('source_diversity')} AS source_diversity FROM diversity"))
def source_diversity(spark, sf):
    return rounded(news_features.source_diversity(derived.articles(spark, sf)))


@query("sentiment_momentum", sql(f"SELECT ticker, date, {rnd('sentiment_momentum')} AS sentiment_momentum FROM daily"))
def sentiment_momentum(spark, sf):
    means = derived.articles(spark, sf).groupBy("ticker", "date").agg(F.avg("sentiment_score").alias("sentiment_mean"))
    return rounded(news_features.with_momentum(means).select("ticker", "date", "sentiment_momentum"))


@query("news_sentiment_merge", sql(f"SELECT ingest_order, {rnd('score')} AS score FROM scored_news"))
def news_sentiment_merge(spark, sf):
    return rounded(derived.scored_news(spark, sf).select("ingest_order", "score"))


# --- fusion ------------------------------------------------------------------------------------

LAGGED = {
    "cal": "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars",
    "lagged": """SELECT daily.* EXCLUDE (date), t.date FROM daily
                 JOIN (SELECT d.ticker, d.date AS news_date, min(cal.i) AS i FROM daily d JOIN cal ON cal.ticker = d.ticker AND cal.date >= d.date GROUP BY 1, 2) f
                   ON f.ticker = daily.ticker AND f.news_date = daily.date JOIN cal t ON t.ticker = daily.ticker AND t.i = f.i + 1""",
}
_fold = {c: "sum" for c in ("news_count", "positive_news_count", "neutral_news_count", "negative_news_count", "source_count")}
_fold |= {"sentiment_max": "max", "provider_count": "max", "sentiment_min": "min"}
LAGGED["folded"] = "SELECT ticker, date, " + ", ".join(
    f"CAST({_fold.get(c, 'avg')}({c}) AS DOUBLE) AS {c}" for c in NEWS_FEATURES
) + " FROM lagged GROUP BY ticker, date"
ALIGNED = ", ".join(f"{rnd(c)} AS {c}" for c in NEWS_FEATURES)


def _arrived(spark, sf):
    calendar = views.bars(spark, sf).select("ticker", "date")
    news = fusion.align_news_features(derived.daily(spark, sf), spark)
    return fusion.lag_news(news, calendar, 1)


@query("news_feature_align", sql(f"SELECT ticker, date, {ALIGNED}, CAST(0 AS DOUBLE) AS embedding_dim_0, CAST(0 AS DOUBLE) AS embedding_dim_49 FROM daily"))
def news_feature_align(spark, sf):
    out = fusion.align_news_features(derived.daily(spark, sf), spark)
    return rounded(out.select("ticker", "date", *NEWS_FEATURES, "embedding_dim_0", "embedding_dim_49"))


@query("news_calendar_lag", sql(f"SELECT ticker, date, {ALIGNED} FROM lagged", cal=LAGGED["cal"], lagged=LAGGED["lagged"]))
def news_calendar_lag(spark, sf):
    return rounded(_arrived(spark, sf).select("ticker", "date", *NEWS_FEATURES))


@query("news_collapse", sql(f"SELECT ticker, date, {ALIGNED} FROM folded", **LAGGED))
def news_collapse(spark, sf):
    return rounded(fusion.collapse_news(_arrived(spark, sf)).select("ticker", "date", *NEWS_FEATURES))


@query("fuse_price_news", sql(
    "SELECT b.ticker, b.date, " + ", ".join(f"{rnd(f'coalesce({c}, 0.0)')} AS {c}" for c in NEWS_FEATURES)
    + " FROM bars b LEFT JOIN folded f ON f.ticker = b.ticker AND f.date = b.date", **LAGGED))
def fuse_price_news(spark, sf):
    prices = views.bars(spark, sf).select("ticker", "date")
    fused = fusion.join_news(prices, fusion.collapse_news(_arrived(spark, sf)))
    return rounded(fused.select("ticker", "date", *NEWS_FEATURES))


PARTIAL = "SELECT * FROM universe WHERE sector <> 'AFRICA'"


@query("fuse_metadata", sql(
    """SELECT b.ticker, date, coalesce(name, b.ticker) AS name, coalesce(sector, 'UNKNOWN') AS sector, CAST(market_cap_rank AS DOUBLE) AS market_cap_rank,
       CAST(1 AS DOUBLE) AS beta, CAST(1 AS INTEGER) AS beta_missing FROM bars b LEFT JOIN part_universe USING (ticker)""", part_universe=PARTIAL))
def fuse_metadata(spark, sf):
    u = views.universe(spark, sf).where("sector <> 'AFRICA'")
    return fusion.join_metadata(views.bars(spark, sf).select("ticker", "date"), u)


ENCODED = """
  SELECT b.ticker, date, t.code AS ticker_encoded, s.code AS sector_encoded, 1 - (market_cap_rank - 1) / (top - 1.0) AS market_cap_encoded
  FROM bars b JOIN universe USING (ticker) JOIN (SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT ticker FROM bars)) t USING (ticker)
  JOIN (SELECT sector, CAST(row_number() OVER (ORDER BY sector) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT sector FROM bars JOIN universe USING (ticker))) s USING (sector)
  JOIN (SELECT max(market_cap_rank) AS top FROM bars JOIN universe USING (ticker)) ON true"""


@query("dense_codes", sql(f"SELECT ticker, date, ticker_encoded, sector_encoded, {rnd('market_cap_encoded')} AS market_cap_encoded FROM enc", enc=ENCODED))
def dense_codes(spark, sf):
    base = fusion.join_metadata(views.bars(spark, sf).select("ticker", "date"), views.universe(spark, sf))
    out = fusion.add_encodings(base).select("ticker", "date", "ticker_encoded", "sector_encoded", "market_cap_encoded")
    return rounded(out)


@query("market_cap_score", sql(
    f"SELECT ticker, {rnd('1 - (market_cap_rank - 1) / ((SELECT max(market_cap_rank) FROM wide_universe) - 1.0)')} AS market_cap_encoded FROM wide_universe"))
def market_cap_score(spark, sf):
    return rounded(fusion.add_encodings(views.universe_wide(spark, sf)).select("ticker", "market_cap_encoded"))


@query("final_dataset", sql(
    f"""SELECT l.ticker, l.date, {rnd('l.close', 4)} AS close, u.sector, {rnd('coalesce(sentiment_mean, 0.0)')} AS sentiment_mean, {rnd('coalesce(news_count, 0.0)')} AS news_count,
        e.ticker_encoded, e.sector_encoded, {rnd('l.target_return')} AS target_return, CAST(l.target_return > 0 AS BIGINT) AS direction,
        {rnd('x.m')} AS market_next_return, {rnd('x.s')} AS sector_next_return
        FROM labelled l JOIN universe u USING (ticker) JOIN enc e ON e.ticker = l.ticker AND e.date = l.date
        JOIN x ON x.ticker = l.ticker AND x.date = l.date LEFT JOIN folded f ON f.ticker = l.ticker AND f.date = l.date""",
    **LAGGED, enc=ENCODED,
    x="""SELECT ticker, date, avg(target_return) OVER (PARTITION BY date) AS m, avg(target_return) OVER (PARTITION BY date, sector) AS s FROM labelled JOIN universe USING (ticker)"""))
@views.shared
def final_dataset(spark, sf):
    out = fusion.final_dataset(views.bars(spark, sf), derived.daily(spark, sf), views.universe(spark, sf))
    picked = out.select(
        "ticker", "date", "close", "sector", "sentiment_mean", "news_count", "ticker_encoded", "sector_encoded",
        "target_return", "direction", "market_next_return", "sector_next_return",
    )
    return rounded(picked, 6, close=4)


# --- landed payloads ---------------------------------------------------------------------------

def _docs_with_url(spark, sf):
    docs, pages = views.table(spark, sf, "documents"), views.table(spark, sf, "pages").select("page_id", F.col("url").alias("page_url"))
    n = pages.agg(F.count("*")).scalar()
    return docs.withColumn("page_key", F.col("doc_id") % n).join(pages, F.col("page_key") == F.col("page_id"))


DOC_URL = "documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)"


@query("news_payload_gdelt", f"""SELECT doc_id, 'T' || (doc_id % 7) AS ticker, CASE WHEN lang = 'en' THEN DATE '{AS_OF}' ELSE DATE '2023-05-17' END AS date,
    {squeeze('text')} AS title, '' AS summary, url, 'GDELT - ' || CASE WHEN lang = 'fr' THEN 'GDELT' ELSE source END AS source, 'gdelt' AS provider,
    CASE WHEN lang = 'de' THEN 'http://img/' || doc_id END AS image_url FROM {DOC_URL} WHERE {squeeze('text')} <> '' AND lang <> 'es'""")
def news_payload_gdelt(spark, sf):
    rows = _docs_with_url(spark, sf)
    lang = F.col("lang")
    article = F.struct(
        F.col("text").alias("title"), F.when(lang == "es", "  ").otherwise(F.col("page_url")).alias("url"),
        F.when(lang == "en", "").otherwise("20230517093000").alias("seendate"),
        F.when(lang == "fr", " ").otherwise(F.col("source")).alias("domain"),
        F.when(lang == "de", F.concat(F.lit(" http://img/"), F.col("doc_id").cast("string"))).otherwise("ftp://x").alias("image"),
    )
    landed = rows.select(
        "doc_id", F.to_json(F.struct(F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("ticker"), F.array(article).alias("articles"))).alias("payload")
    )
    parsed = landed.select("doc_id", payloads.parse_gdelt(F.col("payload")).alias("p")).select("doc_id", "p.*")
    return payloads.gdelt_articles(parsed, AS_OF, keep=["doc_id"])


@query("news_payload_newsapi", f"""SELECT doc_id, 'T' || (doc_id % 7) AS ticker, DATE '2023-05-17' AS date, {squeeze('text')} AS title,
    CASE WHEN lang = 'fr' THEN 'body' ELSE 'short ' || lang END AS summary, url, 'NewsAPI - ' || CASE WHEN lang = 'de' THEN 'Unknown' ELSE source END AS source,
    'newsapi' AS provider, 'https://img/' || doc_id AS image_url FROM {DOC_URL} WHERE {squeeze('text')} <> '' AND lang <> 'es'""")
def news_payload_newsapi(spark, sf):
    rows = _docs_with_url(spark, sf)
    lang = F.col("lang")
    article = F.struct(
        F.col("text").alias("title"), F.when(lang == "fr", "").otherwise(F.concat(F.lit(" short  "), lang)).alias("description"),
        F.lit("body").alias("content"), F.col("page_url").alias("url"), F.lit("2023-05-17T08:00:00Z").alias("publishedAt"),
        F.struct(F.when(lang != "de", F.col("source")).alias("name")).alias("source"),
        F.concat(F.lit("https://img/"), F.col("doc_id").cast("string")).alias("urlToImage"),
    )
    landed = rows.select("doc_id", F.to_json(F.struct(
        F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("ticker"),
        F.when(lang == "es", "error").otherwise("ok").alias("status"), F.array(article).alias("articles"),
    )).alias("payload"))
    parsed = landed.select("doc_id", payloads.parse_newsapi(F.col("payload")).alias("p")).select("doc_id", "p.*")
    return payloads.newsapi_articles(parsed, AS_OF, keep=["doc_id"])


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("feed_payload_rss", """SELECT page_id, 'Page ' || page_id AS title, 'Body of ' || page_id AS summary, url, DATE '2024-02-13' AS date,
    CASE page_id % 3 WHEN 0 THEN 'https://img/' || page_id WHEN 1 THEN 'http://thumb/' || page_id END AS image_url FROM pages""")
def feed_payload_rss(spark, sf):
    pages = views.table(spark, sf, "pages")
    pid = F.col("page_id").cast("string")
    picture = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<enclosure url="https://img/'), pid, F.lit('" type="image/png"/>'))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('<enclosure url="https://audio" type="audio/mp3"/><media:thumbnail url="http://thumb/'), pid, F.lit('"/>'))
    ).otherwise("")
    xml = F.concat(
        F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><title>Page '), pid, F.lit("</title><description>Body of "), pid,
        F.lit("</description><link>"), _escaped(F.col("url")), F.lit("</link><pubDate>Tue, 13 Feb 2024 23:30:00 +0700</pubDate>"), picture,
        F.lit("</item></channel></rss>"),
    )
    return payloads.rss_entries(pages.select("page_id", xml.alias("xml")), AS_OF, keep=["page_id"])


@query("feed_payload_atom", """SELECT page_id, 'Page ' || page_id AS title, 'Body of ' || page_id AS summary, url, DATE '2024-02-13' AS date,
    CASE WHEN page_id % 2 = 0 THEN 'https://img/' || page_id END AS image_url FROM pages""")
def feed_payload_atom(spark, sf):
    pages = views.table(spark, sf, "pages")
    pid = F.col("page_id").cast("string")
    picture = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="enclosure" href="https://img/'), pid, F.lit('"/>'))).otherwise("")
    xml = F.concat(
        F.lit("<feed><entry><title>Page "), pid, F.lit("</title><summary>Body of "), pid, F.lit('</summary><link href="'), _escaped(F.col("url")),
        F.lit('"/>'), picture, F.lit("<updated>2024-02-13T01:00:00Z</updated></entry></feed>"),
    )
    return payloads.atom_entries(pages.select("page_id", xml.alias("xml")), AS_OF, keep=["page_id"])


@query("entry_image", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a/' || page_id WHEN 1 THEN 'http://b/' || page_id WHEN 2 THEN 'https://c/' || page_id ELSE 'https://d/' || page_id END AS image_url FROM pages""")
def entry_image(spark, sf):
    kind, pid = F.col("page_id") % 4, F.col("page_id").cast("string")

    def at(k, prefix):
        return F.when(kind == k, F.concat(F.lit(prefix), pid))

    entries = views.table(spark, sf, "pages").select(
        "page_id", F.lit("data:none").alias("image_url"), at(0, " https://a/").alias("urlToImage"),
        F.array(F.struct(at(1, "http://b/").alias("url"))).alias("media_content"),
        F.array(
            F.struct(F.lit("https://mp3").alias("href"), F.lit(None).cast("string").alias("url"), F.lit("audio/mp3").alias("type")),
            F.struct(F.lit("").alias("href"), at(2, "https://c/").alias("url"), F.lit("image/png").alias("type")),
        ).alias("enclosures"),
        F.array(
            F.struct(F.lit("self").alias("rel"), F.lit("https://no").alias("href"), F.lit("").alias("type")),
            F.struct(F.lit("enclosure").alias("rel"), F.concat(F.lit("https://d/"), pid).alias("href"), F.lit("").alias("type")),
        ).alias("links"),
    )
    return entries.select("page_id", payloads.entry_image(entries).alias("image_url"))


# --- pages -------------------------------------------------------------------------------------

@query("html_meta_extract", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/img/' || page_id || '.png' WHEN 1 THEN 'https://cdn/' || page_id END AS image_url,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN '/i.png' ELSE '/favicon.ico' END AS icon_url FROM pages""")
def html_meta_extract(spark, sf):
    """Whole pages with preview and icon tags put in front, since the raw ones have none."""
    pid = F.col("page_id").cast("string")
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta content="/img/'), pid, F.lit('.png" property="og:image">'))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('<meta property="og:image" content="data:x"><meta name="twitter:image" content="https://cdn/'), pid, F.lit('">'))
    ).otherwise("")
    icon = F.when(F.col("page_id") % 2 == 0, F.lit('<link rel="Shortcut Icon" href="/i.png">')).otherwise("")
    pages = views.table(spark, sf, "pages").withColumn("html", F.concat(meta, icon, "html"))
    return P.page_media(pages).select("page_id", "image_url", "icon_url")


@query("html_meta_raw", """SELECT page_id, CAST(NULL AS VARCHAR) AS image_url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/favicon.ico' AS icon_url FROM pages""")
def html_meta_raw(spark, sf):
    return P.page_media(views.table(spark, sf, "pages")).select("page_id", "image_url", "icon_url")


def listing_pages(spark, sf):
    """One listing page per supplier: a good row, a bad ticker and a short row."""
    key = F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit('<html><head><link rel="prev next" href="?page='), (F.col("s_suppkey") + 1).cast("string"),
        F.lit('"></head><table><tr><td>0</td><td>OTHER</td><td>x</td></tr></table><table id="main-table"><tr><th>h</th></tr><tr><td> '), key,
        F.lit(" </td><td>n"), F.col("s_nationkey").cast("string"), F.lit(".jk</td><td> <b>PT</b>  "), F.col("s_name"),
        F.lit(" &amp; Co</td></tr><tr><td>1</td><td>BAD ONE</td><td>y</td></tr><tr><td>2</td></tr></table></html>"),
    )
    return views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://list.example/stocks?page="), key).alias("url"), html.alias("html")
    )


@query("html_listing_extract", """SELECT s_suppkey AS page_id, CAST(s_suppkey AS INTEGER) AS universe_rank, 'N' || s_nationkey AS ticker, 'PT ' || s_name || ' & Co' AS name,
    'https://list.example/stocks?page=' || (s_suppkey + 1) AS next_url FROM supplier""")
def html_listing_extract(spark, sf):
    return P.listing(listing_pages(spark, sf)).select("page_id", "universe_rank", "ticker", "name", "next_url")


@query("first_by_key", """SELECT 'N' || s_nationkey AS ticker, min_by('PT ' || s_name || ' & Co', s_suppkey) AS name, 'UNKNOWN' AS sector, 'IDX' AS exchange,
    'N' || s_nationkey || '.JK' AS yfinance_symbol, CAST(min(s_suppkey) AS INTEGER) AS universe_rank FROM supplier GROUP BY s_nationkey""")
def first_by_key(spark, sf):
    return P.listed_universe(listing_pages(spark, sf))


# --- universe rows -----------------------------------------------------------------------------

@query("universe_load", """SELECT n_name AS ticker, n_name || '.JK' AS yfinance_symbol, 'PT ' || n_name || ' (Persero) Tbk.' AS name,
    CASE WHEN r_name = 'ASIA' THEN 'UNKNOWN' ELSE r_name END AS sector, nullif(n_nationkey, 0) AS market_cap_rank,
    CAST('1.' || n_regionkey AS DOUBLE) AS beta FROM nation JOIN region ON n_regionkey = r_regionkey""")
def universe_load(spark, sf):
    return UL.load_universe(views.raw_universe(spark, sf))


@query("stock_records_load", """SELECT upper(n_name) AS ticker, 'PT ' || n_name || ' (Persero) Tbk.' AS name, CASE WHEN r_name <> 'ASIA' THEN r_name END AS sector, 'IDX' AS exchange,
    n_name || '.JK' AS yfinance_symbol, CASE WHEN r_name <> 'EUROPE' THEN n_nationkey END AS universe_rank,
    CASE WHEN r_name = 'ASIA' THEN 'Missing required value for ''sector''' WHEN r_name = 'EUROPE' THEN 'Invalid integer value for ''universe_rank'': x' || n_nationkey END AS reason
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def stock_records_load(spark, sf):
    raw = views.raw_universe(spark, sf)
    rank = F.when(F.col("sector") == "EUROPE", F.concat(F.lit("x"), "market_cap_rank")).otherwise(F.col("market_cap_rank"))
    return UL.check_stock_records(raw.withColumn("universe_rank", rank))


# --- text vectors ------------------------------------------------------------------------------

@query("hash_embed", sql(f"""SELECT doc_id, CASE WHEN regexp_matches({clean('text')}, '[\\pL\\pN_][\\pL\\pN_]') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS squared_length FROM documents"""))
def hash_embed(spark, sf):
    from pyspark.ml.functions import vector_to_array

    docs = views.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    v = news_features.hashed_vectors(docs).select("doc_id", vector_to_array("hashed").alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))


@query("pca_reduce")
def pca_reduce(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    out = news_features.reduce_vectors(news_features.hashed_vectors(docs).select("doc_id", "hashed"))
    return out.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.abs(F.col("embedding")[0]), 4).alias("first"))


@query("pca_properties", "SELECT CAST(i AS INTEGER) AS dimension, true AS centred, true AS uncorrelated, true AS ordered, true AS repeatable FROM range(50) t(i)")
def pca_properties(spark, sf):
    """What a projection must be, over all documents: and the same again from its stored form."""
    docs = views.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    hashed, path = written(news_features.hashed_vectors(docs).select("doc_id", "hashed")), run_folder(spark)
    once, again = (news_features.reduce_vectors(hashed, path=path).select("doc_id", F.col("embedding").alias(c)) for c in "ef")
    values = once.join(again, "doc_id").select(F.posexplode("e").alias("dimension", "x"), "e", "f").select(
        "dimension", "x", F.get("e", F.col("dimension") + 1).alias("beside"), F.get("f", F.col("dimension")).alias("same"))
    by = values.groupBy("dimension").agg(
        F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("var"), F.avg(F.col("x") * F.col("beside")).alias("cross"),
        F.avg(F.col("beside") * F.col("beside")).alias("var_beside"), F.max(F.abs(F.col("x") - F.col("same"))).alias("apart"))
    return by.select(
        "dimension", (F.abs("mean") < 1e-9).alias("centred"),
        F.coalesce(F.abs("cross") <= 1e-6 * F.sqrt(F.col("var") * F.col("var_beside")), F.lit(True)).alias("uncorrelated"),
        F.coalesce(F.col("var_beside") <= F.col("var") * (1 + 1e-9), F.lit(True)).alias("ordered"), (F.col("apart") < 1e-12).alias("repeatable"))
