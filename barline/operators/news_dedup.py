"""Greedy article de-duplication per ticker, exact and without a task per ticker.

An article is kept unless an earlier *kept* article of its ticker has the same canonical URL, or
an earlier kept article of the same ticker and date has a matching title. That is the
first-come independent set of a conflict graph, settled on the graph itself:

1. Articles equal in (ticker, URL, day, title words) fold into their first one by a partial
   aggregate, so copies never travel (those with neither URL nor title words stay apart).
2. Articles of one day with the same words are a title class, named by its first article; of a
   class, as of a URL, one article at most is kept, so both act as hubs and need no pairs.
   Edges between unlike classes come from one set-similarity join per day: words ordered by
   their document frequency, rarest first, with prefix, size and position filters.
3. A round keeps every article that is the first open one of its URL, its class and all
   neighbouring classes, and strikes all other open articles of these. So every article whose
   earlier neighbours are all decided is decided; rounds follow the longest chain of conflicts.
4. Crowded days enter in prefixes of growing size: what the kept articles match is struck before
   the rest is compared with itself, so a crowd of like titles never meets all its pairs.

Every round adds its kept articles to one stored table, which is the result.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..constants import TITLE_MIN_JACCARD, TITLE_MIN_TOKENS, TITLE_SIMILARITY
from ..functions.numeric import safe_div
from ..functions.text import canonical_url, normalize_ticker, text_or_empty, title_tokens
from ..session import run_folder, written

#: Articles of a day that enter first, and how much larger each further prefix is.
PREFIX, GROWTH = 4096, 4
#: Words of 64 bits, a power of two, in the sketch of a title's words.
SKETCH = 4
#: Shares of a day at which a prefix may end.
CUTS = [1 / GROWTH**k for k in range(12, 0, -1)]
KEPT = StructType([StructField("ticker", StringType()), StructField("node", LongType())])


def dedup_keys(news: DataFrame, order: str = "ingest_order") -> DataFrame:
    """One row per article with its ticker, day, URL and title keys; blank tickers drop out."""
    return news.select(
        F.col(order).alias("node"),
        normalize_ticker(text_or_empty(F.col("ticker"))).alias("ticker"),
        F.coalesce(F.substring(F.col("date").cast("string"), 1, 10), F.lit("")).alias("day"),
        canonical_url(F.col("url")).alias("url"),
        title_tokens(F.col("title")).alias("words"),
    ).where(F.col("ticker") != "")


def titles_match(a: Column, b: Column, threshold: float = TITLE_SIMILARITY) -> Column:
    """Same word set; or both long enough and close by Jaccard, or by containment."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    smaller = F.least(F.size(a), F.size(b))
    jaccard = safe_div(common, F.size(a) + F.size(b) - common)
    contained = safe_div(common, smaller.cast("double"))
    near = (smaller >= TITLE_MIN_TOKENS) & (
        (jaccard >= threshold) | ((contained >= threshold) & (jaccard >= TITLE_MIN_JACCARD))
    )
    return (F.size(a) > 0) & ((a == b) | near)


def similar_titles(left: DataFrame, right: DataFrame | None = None, threshold: float = TITLE_SIMILARITY) -> DataFrame:
    """(ticker, a, b): classes of `left` and `right` (ticker, day, cls, words) with matching titles.

    Without `right` the classes of `left` among themselves, a before b. Titles that match without
    being equal have at least TITLE_MIN_TOKENS words and a Jaccard similarity of at least
    `floor`: of the words in one fixed order, each has a common one among its first
    n - ceil(floor * n) + 1. The order is by the classes of the day that hold a word. Words travel
    as marks, hashes of ticker, day and word: equal ones never part, unlike ones that share a mark
    only add candidates. Only ids, places and sketches of the marks meet; a sketch bounds the
    common words from above, so the words come back by id, for the exact test, for few pairs.
    """
    floor = min(threshold, TITLE_MIN_JACCARD)

    def marks_of(rows):
        marks = F.transform("words", lambda word: F.xxhash64("ticker", "day", word))
        return rows.where(F.size("words") >= TITLE_MIN_TOKENS).select("ticker", "cls", F.size("words").alias("n"), F.explode(marks).alias("mark"))

    posted = marks_of(left).withColumn("side", F.lit(1))
    if right is not None:
        posted = posted.unionByName(marks_of(right).withColumn("side", F.lit(2)))
    ranked = (
        posted.withColumn("held", F.count("*").over(W.partitionBy("mark"))).groupBy("side", "ticker", "cls", "n")
        .agg(F.sort_array(F.collect_list(F.struct("held", "mark"))).alias("ranked"))
    )
    first = (F.col("n") - F.ceil(F.col("n") * F.lit(floor) - F.lit(1e-9)) + 1).cast("int")
    bits = [
        F.expr(f"aggregate(ranked, 0L, (s, x) -> s | if((shiftright(x.mark, 6) & {SKETCH - 1}) = {k}, shiftleft(1L, cast(x.mark & 63 as int)), 0L))")
        for k in range(SKETCH)
    ]
    prefixes = ranked.select(
        "side", "ticker", "cls", "n", F.array(*bits).alias("bits"),
        F.posexplode(F.slice("ranked", F.lit(1), F.greatest(first, F.lit(1)))).alias("place", "at"),
    ).where("at.held > 1").withColumn("mark", F.col("at.mark")).drop("at")

    def side(k, name):
        return prefixes.where(F.col("side") == (1 if right is None else k)).select(
            "ticker", "mark", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "place", "bits")], F.col("cls").alias(name)
        )

    def most(name, other):
        # a bit that only one title has stands for at least one word that the other lacks
        lacked = sum((F.bit_count(F.expr(f"bits_{name}[{k}] & ~bits_{other}[{k}]")) for k in range(SKETCH)), F.lit(0))
        return F.col(f"n_{name}") - lacked

    least = (F.col("n_a") + F.col("n_b")) * F.lit(floor / (1 + floor)) - F.lit(1e-9)
    room = 1 + F.least(F.expr("n_a - 1 - place_a"), F.expr("n_b - 1 - place_b"))
    candidates = (
        side(1, "a").join(side(2, "b"), ["ticker", "mark"])
        .where(F.col("a") < F.col("b") if right is None else F.col("a") != F.col("b"))
        .where((F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(floor) - F.lit(1e-9)))
        .where(room >= least).where(F.least(most("a", "b"), most("b", "a")) >= least)
        .select("ticker", "a", "b").distinct()
    )
    of_a = left.select("ticker", F.col("cls").alias("a"), F.col("words").alias("words_a"))
    of_b = (left if right is None else right).select("ticker", F.col("cls").alias("b"), F.col("words").alias("words_b"))
    return (
        candidates.join(of_a, ["ticker", "a"]).join(of_b, ["ticker", "b"])
        .where(titles_match(F.col("words_a"), F.col("words_b"), threshold)).select("ticker", "a", "b")
    )


def _with_classes(folded: DataFrame, prefix: int) -> DataFrame:
    """Articles with their title class and the phase in which they enter.

    Days of up to `prefix` articles enter at once; of others, the prefix that ends at the first
    cut with that many, and so on by growing cuts.
    """
    words = folded.where(F.size("words") > 0)
    classes = words.groupBy("ticker", "day", "words").agg(F.min("node").alias("cls"))
    named = words.join(classes, ["ticker", "day", "words"]).unionByName(
        folded.where(F.size("words") == 0).withColumn("cls", F.lit(None).cast("bigint"))
    )
    crowded = (
        folded.groupBy("ticker", "day").agg(F.count("*").alias("n"), F.percentile_approx("node", CUTS, 100_000).alias("cuts"))
        .where(F.col("n") > prefix)
    )
    used = F.filter("cuts", lambda c, i: F.col("n") * F.element_at(F.array(*map(F.lit, CUTS)), i + 1) >= F.lit(prefix))
    placed = named.join(crowded.select("ticker", "day", used.alias("cuts")), ["ticker", "day"], "left")
    behind = F.size(F.filter("cuts", lambda c: c < F.col("node")))
    crowd = F.col("cuts").isNotNull()
    return placed.withColumn("crowd", crowd).withColumn("phase", F.when(crowd, behind).otherwise(0)).drop("cuts")


def _unstruck(rows: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
    """Rows that don't have one of the struck (ticker, `key`); rows without such a key don't travel."""
    has = F.col(key) != "" if key == "url" else F.col(key).isNotNull()
    return rows.where(has).join(hubs, ["ticker", key], "left_anti").unionByName(rows.where(~has))


def _round(open_rows: DataFrame, edges: DataFrame, phase: int) -> DataFrame:
    """(ticker, node, url, cls) of the open articles that come before all they conflict with."""
    active = open_rows.where(F.col("phase") <= phase)
    first = active.where("cls IS NOT NULL").groupBy("ticker", "cls").agg(F.min("node").alias("first"))
    beside = (
        edges.join(first, ["ticker", "cls"]).groupBy("ticker", F.col("near").alias("cls")).agg(F.min("first").alias("beside"))
    )
    leaders = (
        first.join(beside, ["ticker", "cls"], "left").where("beside IS NULL OR first < beside")
        .select("ticker", F.col("first").alias("node"))
    )
    # an article that waits for its class waits whether or not it leads its URL, and the reverse
    holders = open_rows.where("url <> ''").groupBy("ticker", "url").agg(F.min("node").alias("holder"))
    ready = active.where("cls IS NULL").unionByName(active.where("cls IS NOT NULL").join(leaders, ["ticker", "node"], "left_semi"))
    named = ready.where("url <> ''").join(holders, ["ticker", "url"]).where("holder = node").drop("holder")
    return named.unionByName(ready.where("url = ''")).select("ticker", "node", "url", "cls", "crowd")


def kept_nodes(keys: DataFrame, threshold: float = TITLE_SIMILARITY, prefix: int = PREFIX) -> DataFrame:
    """Surviving (ticker, node) pairs, stored; a node may appear under several tickers."""
    spark = keys.sparkSession
    folder, parts = run_folder(spark), 0

    def keep(rows):
        nonlocal parts
        parts += 1
        return written(rows, f"{folder}/part={parts}")

    # without URL and title words nothing can match, so such articles don't fold
    alone = F.when((F.col("url") == "") & (F.size("words") == 0), F.col("node")).alias("alone")
    folded = written(keys.groupBy("ticker", "day", "url", "words", alone).agg(F.min("node").alias("node")).drop("alone"))
    placed = written(_with_classes(folded, prefix))
    # a class is named by its first article, which has its words; they don't travel in the rounds
    titles = placed.where("cls = node").select("ticker", "day", "cls", "words")
    open_rows = placed.drop("day", "words")
    last = open_rows.agg(F.max("phase")).first()[0]
    kept = None  # of crowded days, for what enters later
    for phase in range(0 if last is None else last + 1):
        classes = titles
        if last:
            classes = titles.join(open_rows.where(F.col("phase") <= phase), ["ticker", "cls"], "left_semi").select(titles.columns)
        if phase and kept is not None:
            struck = written(similar_titles(kept, classes, threshold).select("ticker", F.col("b").alias("cls")).distinct())
            open_rows = written(_unstruck(open_rows, struck, "cls"))
            classes = classes.join(struck, ["ticker", "cls"], "left_anti")
        pairs = written(similar_titles(classes, threshold=threshold))
        edges = pairs.toDF("ticker", "cls", "near").unionByName(pairs.toDF("ticker", "near", "cls"))
        while not open_rows.where(F.col("phase") <= phase).isEmpty():
            chosen = keep(_round(open_rows, edges, phase))
            if chosen.isEmpty():  # all wait for URL holders that enter later
                break
            leading = chosen.where("cls IS NOT NULL").select("ticker", "cls")
            beside = edges.join(leading, ["ticker", "cls"], "left_semi").select("ticker", F.col("near").alias("cls"))
            urls = chosen.where("url <> ''").select("ticker", "url")
            rest = _unstruck(open_rows, leading.unionByName(beside), "cls")
            rest = _unstruck(rest, urls, "url").join(chosen.select("ticker", "node"), ["ticker", "node"], "left_anti")
            open_rows = written(rest)
            if phase < last:
                led = titles.join(chosen.where("crowd"), ["ticker", "cls"], "left_semi").select(titles.columns)
                kept = led if kept is None else kept.unionByName(led)
    if not parts:
        return spark.createDataFrame([], KEPT)
    return spark.read.schema(KEPT).parquet(*[f"{folder}/part={k + 1}" for k in range(parts)])


def deduplicate_news(
    news: DataFrame,
    order: str = "ingest_order",
    threshold: float = TITLE_SIMILARITY,
    prefix: int = PREFIX,
) -> DataFrame:
    """Articles that survive the greedy rule; `order` must be unique within a ticker."""
    return surviving(news, kept_nodes(dedup_keys(news, order), threshold, prefix), order)


def surviving(rows: DataFrame, kept: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Rows of articles, or of what was read from them, that are among the `kept_nodes`."""
    kept = kept.select(F.col("ticker").alias("_ticker"), F.col("node").alias(order))
    keyed = rows.withColumn("_ticker", normalize_ticker(text_or_empty(F.col("ticker"))))
    return keyed.join(kept, ["_ticker", order], "left_semi").drop("_ticker")


def first_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row of each key; the rank limit works before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def append_and_deduplicate(existing: DataFrame, incoming: DataFrame, limit=None, **kw) -> DataFrame:
    """Old articles come first, then the new ones; both carry `ingest_order` of their own."""
    tagged = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    # shifting the new batch behind the old one keeps one total order without a global sort
    high = existing.agg(F.coalesce(F.max("ingest_order"), F.lit(-1)) + 1).scalar()
    low = incoming.agg(F.coalesce(F.min("ingest_order"), F.lit(0))).scalar()
    shifted = F.when(F.col("_batch") == 1, F.col("ingest_order") - low + high).otherwise(
        F.col("ingest_order")
    )
    ordered = tagged.withColumn("ingest_order", shifted).drop("_batch")
    unique = deduplicate_news(ordered, **kw)
    return unique if limit is None else unique.orderBy("ingest_order").limit(limit)
