import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.functions import text as T, urls as U
from barline.functions import markup as MK
from barline.operators import fusion as FU, news_dedup as D, news_features as N
from barline.schema import FEED_ENTRY, GDELT_PAYLOAD, NEWSAPI_PAYLOAD
from barline.sources import pages as P, payloads as PL

NEWS = "ingest_order bigint, ticker string, date date, title string, summary string, url string, source string"
DAY = dt.date(2026, 1, 2)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    ("HTTPS://Example.com//a//b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"),
    ("https://e.com/?q=a%20b&q=*~", "https://e.com?q=%2A~&q=a+b"),
    ("https://e.com/x/?ref=1&UTM_Thing=2", "https://e.com/x"),
    ("https://e.com/p?flag&x=1=2", "https://e.com/p?flag=&x=1%3D2"),
    ("  ", ""), ("just text/", "just text"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, T.canonical_url(F.col("u")), u=raw) == want


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.col("t")), t="<b>Naik</b> https://x.y/z  kuat") == "Naik kuat"
    assert one(spark, T.title_tokens(F.col("t")), t="The BBCA dan BBCA a naik-2x") == ["2x", "bbca", "naik"]
    assert one(spark, T.lexicon_sentiment(F.col("t")), t="Laba naik") > 0
    assert one(spark, T.lexicon_sentiment(F.col("t")), t="Saham turun anjlok rugi") == -1.0
    assert one(spark, T.lexicon_sentiment(F.col("t")), t="12 34") == 0.0
    assert one(spark, T.clean_company_name(F.col("t")), t="PT Bank Rakyat Indonesia (Persero) Tbk.") == "Bank Rakyat Indonesia"
    assert one(spark, T.news_query(F.lit("bbca"), F.col("t"), "newsapi"), t="Bank Central") == 'BBCA OR "Bank Central"'
    assert one(spark, T.news_query(F.lit("BBCA"), F.col("t"), "gdelt"), t="PT BBCA Tbk") == "BBCA"


def test_dates_fall_back_to_the_argument(spark):
    assert one(spark, T.api_date(F.col("d"), "2026-03-04"), d="20260523120000") == dt.date(2026, 5, 23)
    assert one(spark, T.api_date(F.col("d"), "2026-03-04"), d=" ") == dt.date(2026, 3, 4)
    nothing = F.lit(None).cast("string")
    assert one(spark, T.feed_date(F.col("d"), nothing, nothing, "2026-03-04"), d="Sat, 23 May 2026 23:30:00 -0700") == dt.date(2026, 5, 23)
    assert one(spark, T.feed_date(F.col("d"), nothing, nothing, "2026-03-04"), d="short") == dt.date(2026, 3, 4)


def test_tagging(rows):
    text = rows([(1, "Saham BBCA dan TLKM.JK kompak menguat"), (2, "XBBCA TLKMX"), (3, "index ^jkse, b-one!")], "ingest_order bigint, text string")
    aliases = rows([("BBCA", "BBCA"), ("BBCA", "BBCA.JK"), ("TLKM", "TLKM"), ("IHSG", "^JKSE"), ("BONE", "B-ONE")], "ticker string, alias string")
    got = sorted((r.ingest_order, r.ticker) for r in N.tag_tickers(text, aliases).collect())
    assert got == [(1, "BBCA"), (1, "TLKM"), (3, "BONE"), (3, "IHSG")]


@pytest.mark.parametrize("few", [0, 2_000])
def test_tagging_by_windows_is_the_pattern_search(spark, monkeypatch, few):
    import re

    monkeypatch.setattr(N, "FEW_ALIASES", few)
    rng = random.Random(5)
    names = ["AB", "AB.JK", "AB CD", "^AB", "C-D E", "CD", "..X", "X"]
    signs = [" ", "-", ".", "^", ", ", " ^", "..", "\n", ""]
    texts = ["".join(rng.choice(["ab", "CD", "x", "Jk", "e", "1"]) + rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    texts += ["..x", "^ab", "a^ab", "ab.jk", "c-d e", "c-d e1", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "ingest_order bigint, text string")
    aliases = spark.createDataFrame([(f"T{k}", a) for k, a in enumerate(names)], "ticker string, alias string")
    want = {(i, f"T{k}") for i, t in enumerate(texts) for k, a in enumerate(names)
            if t and re.search(rf"(?<![A-Z0-9]){re.escape(a)}(?![A-Z0-9])", t.upper())}
    assert {tuple(r) for r in N.tag_tickers(frame, aliases).collect()} == want


# --- de-duplication ----------------------------------------------------------------------------

def greedy(items, threshold=0.9):
    """The rule, one article after another."""
    seen, buckets, kept = set(), {}, set()
    for node, ticker, day, url, words in sorted(items):
        mine = set(words)
        if url and (ticker, url) in seen:
            continue
        dup = False
        for other in buckets.get((ticker, day), []) if mine else []:
            common, small = len(mine & other), min(len(mine), len(other))
            jaccard = common / len(mine | other)
            dup = dup or mine == other or (small >= 4 and (jaccard >= threshold or (common / small >= threshold and jaccard >= 0.75)))
        if dup:
            continue
        kept.add((ticker, node))
        if url:
            seen.add((ticker, url))
        if mine:
            buckets.setdefault((ticker, day), []).append(mine)
    return kept


@pytest.mark.parametrize("seed,prefix", [(1, 7), (2, 25), (3, 512)])
def test_dedup_is_the_greedy_rule(spark, seed, prefix):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = []
    for i in range(400):
        base = random.Random(rng.randrange(25))
        words = [base.choice(vocabulary) for _ in range(rng.choice([0, 3, 10, 12]))]
        if words and rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if words and rng.random() < 0.3:
            words.append(f"serial{i}")
        # one ticker and day hold most rows
        items.append((i, rng.choice("TTTTAB"), rng.choice(["d1"] * 5 + ["d2"]), rng.choice(["", "", f"u{rng.randrange(120)}"]), sorted(set(words))))
    keys = spark.createDataFrame(items, "node bigint, ticker string, day string, url string, words array<string>")
    got = {(r.ticker, r.node) for r in D.kept_nodes(keys, prefix=prefix).collect()}
    assert got == greedy(items)


@pytest.mark.parametrize("kind, kept", [("distinct", 1500), ("templates", 6)])
def test_a_crowded_day_takes_few_rounds(spark, monkeypatch, kind, kept):
    rng, rounds, settle = random.Random(4), [], D._round
    monkeypatch.setattr(D, "_round", lambda *a: rounds.append(1) or settle(*a))
    if kind == "distinct":
        titles = [sorted(rng.sample([f"w{k}" for k in range(900)], 8)) for _ in range(1500)]
    else:
        titles = [sorted([f"c{k}x{i % 6}" for k in range(11)] + [f"n{i}"]) for i in range(1500)]
    keys = spark.createDataFrame([(i, "T", "d", "", t) for i, t in enumerate(titles)], "node bigint, ticker string, day string, url string, words array<string>")
    assert D.kept_nodes(keys, prefix=200).count() == kept and len(rounds) <= 5


def test_candidates_carry_marks_instead_of_words(spark):
    titles = [(i, sorted({f"word{i // 2}x{k}" for k in range(9)} | {f"own{i}"})) for i in range(40)]
    left = spark.createDataFrame([("T", "d", i, t) for i, t in titles], "ticker string, day string, cls bigint, words array<string>")
    found = D.similar_titles(left)
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, i + 1) for i in range(0, 40, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "explode(words" not in plan


def test_no_text_travels_to_the_daily_features(rows, monkeypatch):
    stored, store = [], N.written
    monkeypatch.setattr(N, "written", lambda df, *a: stored.append(df.columns) or store(df, *a))
    data = [(i, "A", DAY, f"title {'same' if i < 2 else f'no{i}'} of the day", "rise and fall", f"http://x/{max(i, 1)}", f"s{i}", None) for i in range(5)]
    news = rows(data, "ingest_order bigint, ticker string, date date, title string, summary string, url string, source string, sentiment_score double")
    got = N.unique_daily_news(news, ["rise"], ["fall"]).collect()
    assert got == N.daily_news(N.prepare_articles(D.deduplicate_news(news), ["rise"], ["fall"])).collect()
    assert got[0].news_count == 4 and stored and all("text" not in c for c in stored)


def test_title_dropped_row_does_not_claim_its_url(rows):
    news = rows([
        (1, "A", DAY, "laba bank besar naik tajam", "", "http://x/1", "s"),
        (2, "A", DAY, "laba bank besar naik tajam", "", "http://x/2", "s"),
        (3, "A", dt.date(2026, 1, 5), "lain sama sekali berita", "", "http://x/2", "s"),
        (4, " ", DAY, "tanpa kode saham", "", "http://x/9", "s"),
    ], NEWS)
    assert sorted(r.ingest_order for r in D.deduplicate_news(news).collect()) == [1, 3]


def test_url_with_tracking_is_one_article(rows):
    news = rows([(1, "BBCA", DAY, "Laba naik", "", "https://e.com/a?utm_source=rss", "s"), (2, "BBCA.JK", dt.date(2026, 1, 9), "Judul lain", "", "https://e.com/a", "s")], NEWS)
    assert D.deduplicate_news(news).count() == 1


def test_append_keeps_old_articles_first(rows):
    old = rows([(7, "A", DAY, "laba bank besar naik tajam", "", "http://x/1", "s")], NEWS)
    new = rows([(0, "A", DAY, "laba bank besar naik tajam", "", "http://x/2", "s"), (1, "A", DAY, "hal lain", "", "", "s")], NEWS)
    out = D.append_and_deduplicate(old, new).orderBy("ingest_order").collect()
    assert [r.url for r in out] == ["http://x/1", ""]
    assert D.append_and_deduplicate(old, new, limit=1).count() == 1


def test_first_by_key(rows):
    frame = rows([("A", 2), ("A", 1), ("B", 3)], "k string, n int")
    assert sorted(tuple(r) for r in D.first_by_key(frame, ["k"], ["n"]).collect()) == [("A", 1), ("B", 3)]


# --- daily features ----------------------------------------------------------------------------

def daily_of(rows):
    news = rows([
        (1, "BBCA", DAY, "BBCA laba naik kuartal ini", "", "http://a/1", "CNBC"),
        (2, "BBCA", DAY, "BBCA laba naik kuartal ini", "", "http://b/1", "CNBC"),
        (3, "BBCA", DAY, "Saham turun", "", "http://c/1", "GDELT - x"),
        (4, "BBCA", dt.date(2026, 1, 5), "Tanpa kata penting", "", "http://d/1", " "),
        (5, "BBCA", dt.date(2026, 1, 6), "<p></p>", "", "http://e/1", "s"),
    ], NEWS)
    return N.daily_news(N.prepare_articles(D.deduplicate_news(news))).orderBy("date").collect()


def test_daily_news(rows):
    first, second = daily_of(rows)
    assert (first.news_count, first.source_count, first.provider_count) == (2, 2, 2)
    assert 0 <= first.source_diversity <= 1 and first.source_diversity == pytest.approx(1.0)
    assert first.sentiment_momentum == 0.0 and second.sentiment_std == 0.0
    assert second.sentiment_momentum == pytest.approx(second.sentiment_mean - first.sentiment_mean)
    assert first.positive_news_count == 1 and first.negative_news_count == 1 and second.neutral_news_count == 1


def test_required_news_columns(rows):
    with pytest.raises(ValueError, match="summary"):
        N.prepare_articles(rows([(1, "A", DAY, "t", "", "u", "s")], NEWS).drop("summary"))


def test_scorer_is_pluggable(rows):
    frame = rows([("aa",), ("naik",)], "text string")

    def factory():
        return lambda texts: [0.5 if t == "aa" else None for t in texts]

    auto = {r.text: r.sentiment_score for r in N.score_text(frame, scorer=factory).collect()}
    assert auto == {"aa": 0.5, "naik": 1.0}
    with pytest.raises(ValueError):
        N.score_text(frame, backend="model")
    with pytest.raises(ValueError):
        N.score_text(frame, backend="other")


def test_a_stored_projection_gives_the_same_vectors(rows, tmp_path):
    import numpy as np

    words = "laba bank naik saham turun kredit emas batu bara nikel".split()
    rng = random.Random(2)
    frame = rows([(i, " ".join(rng.choices(words, k=rng.randint(2, 9)))) for i in range(40)], "id bigint, text string")
    hashed = N.hashed_vectors(frame)
    path = str(tmp_path / "projection")
    first = {r.id: r.embedding for r in N.reduce_vectors(hashed, dimensions=5, path=path).collect()}
    later = {r.id: r.embedding for r in N.reduce_vectors(hashed.where("id < 7"), dimensions=5, path=path).collect()}
    assert all(later[k] == pytest.approx(first[k], abs=1e-12) for k in later) and len(later) == 7
    x = np.array([r.hashed.toArray() for r in hashed.orderBy("id").collect()])
    left, size, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([first[k] for k in range(40)])
    assert np.abs(np.abs(got) - np.abs((left * size)[:, :5])).max() < 1e-9


def test_vectors(rows):
    frame = rows([(i, f"kata{i} bank naik saham {'laba ' * i}") for i in range(6)], "id bigint, text string")
    hashed = N.hashed_vectors(frame)
    assert all(abs(sum(x * x for x in r.hashed.toArray()) - 1) < 1e-9 for r in hashed.collect())
    reduced = [r.embedding for r in N.reduce_vectors(hashed, dimensions=8).collect()]
    assert all(len(e) == 8 and e[6:] == [0.0, 0.0] for e in reduced)
    assert abs(sum(e[0] for e in reduced)) < 1e-9  # centred
    assert len(N.reduce_vectors(hashed.limit(1), dimensions=8).first().embedding) == 8
    with pytest.raises(ValueError):
        N.reduce_vectors(hashed, dimensions=0)


# --- fusion ------------------------------------------------------------------------------------

def fused(rows, lag, **kw):
    prices = rows([("BBCA", dt.date(2026, 1, d), c, r) for d, c, r in ((1, 100.0, None), (2, 110.0, 0.1), (3, 105.0, -0.045))], "ticker string, date date, close double, return_1d double")
    news = rows([("BBCA", dt.date(2026, 1, 2), 0.4, 0.0, 2, 0.0)], "ticker string, date date, sentiment_mean double, sentiment_std double, news_count bigint, sentiment_momentum double")
    meta = rows([("BBCA", "BBCA.JK", "Bank", "Financials", 1, None)], "ticker string, yfinance_symbol string, name string, sector string, market_cap_rank int, beta double")
    return FU.final_dataset(prices, news, meta, lag=lag, **kw).orderBy("date").collect()


def test_news_moves_one_trading_day(rows):
    out = fused(rows, 1)
    assert [r.news_count for r in out] == [0.0, 0.0, 2.0]
    assert out[0].target_return == pytest.approx(0.1) and out[1].direction == 0 and out[2].direction is None
    assert (out[0].beta_missing, out[0].beta, out[0].market_cap_encoded, out[0].sector) == (1, 1.0, 1.0, "Financials")
    assert out[0].day_of_week == 3 and out[0].outperform_market == 0


def test_lag_zero_keeps_dates_and_negative_fails(rows):
    assert [r.news_count for r in fused(rows, 0)] == [0.0, 2.0, 0.0]
    assert len(fused(rows, 1, drop_unlabeled=True)) == 2
    with pytest.raises(ValueError):
        fused(rows, -1)


def test_lag_rolls_forward_and_drops_past_the_end(rows):
    calendar = rows([("A", dt.date(2026, 1, d)) for d in (5, 6, 9)], "ticker string, date date")
    news = rows([("A", dt.date(2026, 1, 3), 1.0), ("A", dt.date(2026, 1, 6), 2.0), ("A", dt.date(2026, 1, 7), 3.0), ("B", dt.date(2026, 1, 5), 4.0)], "ticker string, date date, v double")
    got = sorted((r.v, r.date.day) for r in FU.lag_news(news, calendar, 1).collect())
    assert got == [(1.0, 6), (2.0, 9)]


def test_no_news_table(spark):
    empty = FU.align_news_features(None, spark)
    assert empty.count() == 0 and len(empty.columns) == 65


def test_encoder_is_alphabetical(rows):
    frame = rows([("B", "y"), ("A", "x"), ("C", "x")], "ticker string, sector string")
    assert [list(x) for x in FU.fit_encoders(frame).labelsArray] == [["A", "B", "C"], ["x", "y"]]


# --- payloads and pages ------------------------------------------------------------------------

def test_gdelt_and_newsapi_payloads(spark):
    g = spark.sql("select 'BBCA' ticker, array(named_struct('title','Laba','url','http://x','seendate','20260523120000','datetime',null,'sourceCommonName',null,'domain','example.com','snippet',null,'socialimage','http://i','image',null)) articles")
    row = PL.gdelt_articles(spark.createDataFrame(g.collect(), GDELT_PAYLOAD), "2026-01-01").first()
    assert (row.date, row.source, row.provider, row.image_url) == (dt.date(2026, 5, 23), "GDELT - example.com", "gdelt", "http://i")
    n = [("BBCA", "ok", None, [("t", None, "c", "http://x", "2026-05-23T01:00:00Z", ("Example News",), None)]), ("TLKM", "error", "limit", [])]
    frame = spark.createDataFrame(n, NEWSAPI_PAYLOAD)
    row = PL.newsapi_articles(frame, "2026-01-01").first()
    assert (row.source, row.summary) == ("NewsAPI - Example News", "c")
    assert [tuple(r) for r in PL.payload_errors(frame).collect()] == [("TLKM", "limit")]


def test_entry_image_order(spark):
    entry = {"image": "ftp://no", "enclosures": [("", "https://e/2.png", "")], "links": [("enclosure", "https://l/3.png", "image/png")]}
    names = [c.split()[0] for c in FEED_ENTRY.split(", ")]
    frame = spark.createDataFrame([tuple(entry.get(n) for n in names)], FEED_ENTRY)
    assert frame.select(PL.entry_image(frame).alias("x")).first().x == "https://e/2.png"


def test_feed_sources_and_providers(spark):
    assert PL.feed_sources(spark).count() == 3
    assert [tuple(r) for r in PL.feed_sources(spark, "A | https://a/rss, ").collect()] == [("A", "https://a/rss")]
    with pytest.raises(ValueError):
        PL.feed_sources(spark, "no separator")
    assert PL.resolve_providers("all") == ["rss", "gdelt"]
    assert PL.resolve_providers(providers="gdelt, rss,gdelt") == ["gdelt", "rss"]
    for bad in (dict(provider="x"), dict(provider="newsapi"), dict(providers="newsapi")):
        with pytest.raises(ValueError):
            PL.resolve_providers(**bad)


def test_page_media(rows):
    html = '<head><meta property="og:image" content="/a.png"><link rel="apple-touch-icon" href="//cdn.x/i.png"></head>'
    out = {r.page_id: r for r in P.page_media(rows([(1, "https://e.com/x/y", html), (2, "https://e.com/z", "<p>none</p>")], "page_id bigint, url string, html string")).collect()}
    assert (out[1].image_url, out[1].icon_url) == ("https://e.com/a.png", "https://cdn.x/i.png")
    assert (out[2].image_url, out[2].icon_url) == (None, "https://e.com/favicon.ico")


def test_listing(rows):
    html = ('<link rel="next" href="/list?p=2"><table id="main-table"><tr><td>1</td><td>bbca</td><td>Bank <b>Central</b></td></tr>'
            "<tr><td>2</td><td>TLKM</td><td>Telkom</td></tr></table><table><tr><td>3</td><td>NOPE</td><td>x</td></tr></table>")
    frame = rows([(1, "https://s.com/list", html), (2, "https://s.com/list?p=2", html.replace("Telkom", "Other"))], "page_id bigint, url string, html string")
    got = {r.ticker: r for r in P.listed_universe(frame).collect()}
    assert set(got) == {"BBCA", "TLKM"} and got["TLKM"].name == "Telkom" and got["BBCA"].universe_rank == 1
    assert P.next_links(frame).first().next_url == "https://s.com/list?p=2"


def test_listing_of_untidy_tables(rows):
    html = ("<!-- <table id='main-table'><tr><td>9</td><td>HID</td><td>hidden</td></tr></table> --><link rel='prev NEXT' href=list?p=2#x>"
            "<TABLE class=a id='main-table'><tr><th>h</th></tr><tr data-x='</tr>'><td title='a>b'>1</td><td>aaa</td><td>A &amp; B &#233; <script>if (a<b) x</script>Tbk</td></tr>"
            "<tr><td>2</td><td>BBB</td><td>inner <table><tr><td>3</td><td>CCC</td><td>Nested</td></tr></table></td></tr>"
            "<tr><td>4</td><td>DDD</td><td>never ended<tr><td>5</td><td>EEE</td><td>1 < 2</td><td>more</td></tr><tr><td>x</td><td>FFF</td><td>no rank</td></tr></table>"
            "<table><tr><td>7</td><td>GGG</td><td>outside</td></tr></table>")
    frame = rows([(1, "https://s.com/a/b?q=1", html), (1, "https://t.com/", html.replace("aaa", "zzz")), (2, None, None)], "page_id bigint, url string, html string")
    got = {(r.universe_rank, r.ticker, r.name, r.next_url) for r in P.listing(frame).collect()}
    assert got == {(k, t, n, f"{base}list?p=2#x") for base, first in (("https://s.com/a/", "AAA"), ("https://t.com/", "ZZZ")) for k, t, n in [
        (1, first, "A & B é Tbk"), (3, "CCC", "Nested"), (5, "EEE", "1 < 2"), (None, "FFF", "no rank")]}


def test_page_media_of_untidy_tags(rows):
    html = ("<!--<meta property=og:image content=/no.png>--><div title='<meta property=og:image content=/no2.png>'></div><script>'<meta property=og:image content=/no3.png>'</script>"
            "<meta property='og:image' content='data:x'><META name=twitter:image content= /a.png?x=1&amp;y=2 ><meta content=/later.png property=og:image>"
            "<link href='i&#46;png' REL=\"Shortcut ICON\">")
    out = P.page_media(rows([(1, "https://e.com/x/y", html), (2, None, html), (3, "nonsense", "icon")], "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert (out[0].image_url, out[0].icon_url) == ("https://e.com/a.png?x=1&y=2", "https://e.com/x/i.png")
    assert [(r.image_url, r.icon_url) for r in out[1:]] == [(None, None)] * 2


def test_joined_urls_are_those_of_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://e.com/x/y?q=1#f", "http://e.com", "https://e.com/", "HTTPS://e.com/a/b/", "http://u@h:8/a/b/c"]
    links = ["", "z", "/z", "//c.d/i.png", "?n=2", "#top", "../up", "../../../far", "./here", "a/../b/./c", "..", ".", "http://o.org/../x", "data:x", "z/?a=/../b", "mailto:a@b"]
    frame = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in frame.select("b", "x", U.joined_url(F.col("b"), F.col("x")).alias("u")).collect():
        assert r.u.lower() == urljoin(r.b, r.x).lower(), (r.b, r.x)


def test_references_and_attributes(spark):
    import html

    texts = ["a &amp; b", "&lt;&gt;&quot;&apos;&nbsp;x", "&#233;&#xe9;&#XE9 &eacute; &copy", "AT&T &unknown; &", "&#128; &#0; &#55296; &#x110000; &#x1F600;", "&amp;lt;", ""]
    for t in texts:
        assert one(spark, MK.unescaped(F.col("t")), t=t) == html.unescape(t)
    tag = "<p Class = 'a \"b\"' id=x\tdata-y checked class=\"last &lt; one\">text"
    assert [one(spark, MK.attribute(F.col("t"), n), t=tag) for n in ("class", "id", "data-y", "none")] == ["last < one", "x", "", ""]
    long = one(spark, F.size(MK.tokens(F.col("t"))), t="<p " + "a='b' " * 20000 + ">" + "<i>x" * 20000 + "<!--" + "-" * 50000)
    assert long == 20002


def test_logo_candidates(spark):
    got = one(spark, U.logo_candidates(F.col("logo"), F.col("d"), F.col("w")), logo="", d="", w="https://www.bca.co.id/id")
    assert got == [
        "https://img.logo.dev/bca.co.id?size=128&format=png&fallback=404", "https://www.bca.co.id/favicon.ico",
        "https://icons.duckduckgo.com/ip3/www.bca.co.id.ico",
        "https://www.google.com/s2/favicons?domain_url=https%3A%2F%2Fwww.bca.co.id%2Fid&sz=128",
    ]


def test_sentiment_and_blanks_of_odd_texts(spark):
    import math
    import re

    texts = [None, "", " ", "naik  turun", "NAIK2naik_naik", "İnaik Knaik", "naik  rugi\t\n naik", "a b  c \u0085 d", "​naik　", "laba-rugi rugi rugi"]
    data = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plus, minus = ["naik", "laba"], ["rugi", "turun", "naik", "a1"]
    got = {r.k: (r.s, r.q) for r in data.select("k", T.lexicon_sentiment(F.col("t"), plus, minus).alias("s"), T.squeeze(F.col("t")).alias("q")).collect()}
    blank = "[ \\t-\\r\\x1C-\\x1F\\x85   -     　]+"
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] == (None, None)
            continue
        words = [w.lower() for w in re.findall("[a-zA-Z]+", t)]
        votes = sum(w in plus or -(w in minus) for w in words)
        assert got[k][0] == (max(-1.0, min(1.0, votes / math.sqrt(len(words)))) if votes else 0.0)
        assert got[k][1] == re.sub(blank, " ", t).strip(" ")


def test_sentiment_does_no_work_word_by_word():
    text = str(T.lexicon_sentiment(F.col("t")))
    assert "reduce" not in text and "aggregate" not in text
