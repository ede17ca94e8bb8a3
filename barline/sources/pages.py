"""Facts from landed HTML pages: listing rows, next link, preview image, icon.

Pages are read as arrays of tokens by column expressions (`functions.markup`), once each; only those
that mention a wanted tag are cut into tokens at all.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.markup import attribute, tag_name, text_behind, tokens
from ..functions.text import default_symbol, given, normalize_ticker, squeeze
from ..functions.urls import SITE_ROOT, joined_url
from ..operators.news_dedup import first_by_key

# fixed values: preview image properties
IMAGE_KEYS = ("og:image", "og:image:secure_url", "twitter:image")
TICKER_SHAPE = "^[A-Z0-9]{1,12}$"
#: Elements that the listing is told from, besides the text between them.
TABLE_TAGS = ("table", "/table", "tr", "/tr", "td", "/td")


def _named(found: Column, name: str) -> Column:
    return F.filter(found, lambda t: tag_name(t) == name)


def _first_http(base: Column, links: Column) -> Column:
    """The first link that leads to a web address."""
    absolute = F.transform(F.transform(links, lambda link: F.trim(link)), lambda link: joined_url(F.coalesce(base, F.lit("")), link))
    return F.get(F.filter(absolute, lambda u: u.rlike("^https?://")), F.lit(0))


def _tokenised(pages: DataFrame, mention: str) -> DataFrame:
    """Page id, url and tokens; none for pages that don't mention what is wanted."""
    wanted = F.coalesce(F.col("html").rlike(mention), F.lit(False))
    return pages.select("page_id", "url", F.when(wanted, tokens(F.col("html"))).otherwise(F.array().cast("array<string>")).alias("tokens"))


def page_media(pages: DataFrame) -> DataFrame:
    """Preview image and icon of every page; the icon falls back to /favicon.ico."""
    named = F.transform(
        _named(F.col("tokens"), "meta"),
        lambda t: F.struct(F.coalesce(F.nullif(attribute(t, "property"), F.lit("")), attribute(t, "name")).alias("key"), attribute(t, "content").alias("link")),
    )
    images = F.transform(F.filter(named, lambda m: m["key"].isin(*IMAGE_KEYS)), lambda m: m["link"])
    icons = F.transform(
        F.filter(_named(F.col("tokens"), "link"), lambda t: F.contains(F.lower(attribute(t, "rel")), F.lit("icon"))),
        lambda t: attribute(t, "href"),
    )
    root = F.nullif(F.regexp_extract("url", SITE_ROOT, 1), F.lit(""))
    return _tokenised(pages, "(?i)(og:image|twitter:image|icon)").select(
        "page_id", "url", _first_http(F.col("url"), images).alias("image_url"),
        F.coalesce(_first_http(F.col("url"), icons), F.concat(root, F.lit("/favicon.ico"))).alias("icon_url"),
    )


def _next_url() -> Column:
    """Where the last link that is marked as next leads to."""
    links = F.filter(
        _named(F.col("tokens"), "link"),
        lambda t: F.array_contains(F.split(F.lower(F.trim(attribute(t, "rel"))), r"\s+"), "next") & (attribute(t, "href") != ""),
    )
    hrefs = F.transform(links, lambda t: attribute(t, "href"))
    return given(F.try_element_at(hrefs, F.lit(-1)), lambda last: joined_url(F.coalesce(F.col("url"), F.lit("")), last))


def listing(pages: DataFrame) -> DataFrame:
    """Rows of the listing table (and of tables in it) with page, position and the page's next link.

    A page's tokens lie in order in one window. The table is open while the tables begun since its
    opening tag outnumber those ended; rows and cells are told apart by running counts of their
    opening tags, and a cell's text is what lies between it and its end. A row counts if it ends.
    """
    at = F.posexplode("tokens").alias("pos", "token")
    read = _tokenised(pages, "(?i)main-table").select("page_id", "url", _next_url().alias("next_url"), "tokens").select("page_id", "url", "next_url", at)
    name = tag_name(F.col("token"))
    tags = read.select(
        "page_id", "url", "next_url", "pos", name.alias("tag"),
        ((name == "table") & (attribute(F.col("token"), "id") == "main-table")).alias("main"), text_behind(F.col("token")).alias("text"),
    )

    def running(condition, by=()):
        w = W.partitionBy("page_id", "url", *by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        return F.sum(F.when(condition, 1).otherwise(0)).over(w)

    # every opening of the main table begins a section; it lasts until its tables are closed
    sections = tags.withColumn("section", running(F.col("main"))).where("section > 0")
    depth = running(F.col("tag") == "table", ("section",)) - running(F.col("tag") == "/table", ("section",))
    lowest = F.min("depth").over(W.partitionBy("page_id", "url", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    inside = sections.withColumn("depth", depth).withColumn("lowest", lowest).where("lowest > 0")
    rows = inside.withColumn("row", running(F.col("tag") == "tr")).where("row > 0")
    ended = running(F.col("tag") == "/tr", ("row",)) - F.when(F.col("tag") == "/tr", 1).otherwise(0)
    cells = rows.withColumn("ended", ended).where("ended = 0").withColumn("cell", running(F.col("tag") == "td", ("row",)))
    closed = running(F.col("tag") == "/td", ("row", "cell"))
    texts = cells.withColumn("closed", closed).groupBy("page_id", "url", "next_url", "row", "cell").agg(
        F.max(F.when(F.col("tag") == "/tr", 1).otherwise(0)).alias("row_ends"), F.max("closed").alias("cell_ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("closed") == 0, F.struct("pos", "text")))), lambda t: t["text"]), "").alias("text"),
    )
    whole = texts.groupBy("page_id", "url", "next_url", "row").agg(
        F.max("row_ends").alias("ends"),
        F.array_sort(F.collect_list(F.when(F.expr("cell > 0 AND cell_ends > 0"), F.struct("cell", "text")))).alias("found"),
    ).where("ends = 1 AND size(found) >= 3")
    ticker = normalize_ticker(F.col("found")[1]["text"])
    return whole.select(
        "page_id", F.col("row").cast("int").alias("position"), squeeze(F.col("found")[0]["text"]).try_cast("int").alias("universe_rank"),
        ticker.alias("ticker"), squeeze(F.col("found")[2]["text"]).alias("name"), "next_url",
    ).where(F.col("ticker").rlike(TICKER_SHAPE) & (F.col("name") != ""))


def listing_rows(pages: DataFrame) -> DataFrame:
    """Instrument rows of the listing tables, with page and position."""
    return listing(pages).drop("next_url")


def next_links(pages: DataFrame) -> DataFrame:
    """Absolute next link of each page that has one."""
    return _tokenised(pages, "(?i)next").select("page_id", _next_url().alias("next_url")).where("next_url IS NOT NULL")


def listed_universe(pages: DataFrame) -> DataFrame:
    """Universe from listing pages; the first page and row of a ticker wins."""
    first = first_by_key(listing_rows(pages), ["ticker"], ["page_id", "position"])
    return first.select(
        "ticker", "name", F.lit("UNKNOWN").alias("sector"), F.lit("IDX").alias("exchange"),
        default_symbol(F.col("ticker")).alias("yfinance_symbol"), "universe_rank",
    )
