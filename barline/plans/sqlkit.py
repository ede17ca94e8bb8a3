"""The derived tables once more as plain SQL, for checking results in another engine."""

import re

POSITIVE = ["the", "la", "die", "of", "und"]
NEGATIVE = ["to", "le", "der", "and", "que"]
BLANK = r"[\s\x0B\x1C-\x1F\x85\pZ]"


def sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


def clean(c: str) -> str:
    no_tags = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    links = r"https?://[^\s\x0B\x1C-\x1F\x85\pZ]+"
    return squeeze(f"regexp_replace({no_tags}, '{links}', ' ', 'g')")


def words(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[a-zA-Z]+'), lambda w: lower(w))"


def lexicon(c: str, plus=POSITIVE, minus=NEGATIVE) -> str:
    """Score of text column `c`; `_w` is its word list."""
    w = words(c)
    s = (
        f"(len(list_filter({w}, lambda w: w IN {sql_list(plus)})) - "
        f"len(list_filter({w}, lambda w: w IN {sql_list(minus)})))"
    )
    return (
        f"CASE WHEN {s} = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, {s} / sqrt(CAST(len({w}) AS DOUBLE)))) END"
    )


def tokens(c: str) -> str:
    stop = sql_list(["a", "an", "and", "atau", "dan", "dari", "di", "for", "ini", "itu", "ke", "of", "on", "pada", "saat", "the", "untuk", "yang"])
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), "
        f"lambda w: len(w) > 1 AND w NOT IN {stop})))"
    )


def rnd(c: str, digits: int = 6, first: int = 9) -> str:
    # through a decimal: summation noise goes first, then exact halves round away from zero
    return f"(CAST(round(CAST({c} AS DECIMAL(38, {first})), {digits}) AS DOUBLE) + 0.0)"


def roll(fn: str, c: str, n: int, part: str = "ticker") -> str:
    f = f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {f} = {n} THEN {fn}({c}) {f} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _bars(owner: str, where: str = "") -> str:
    return f"""
      SELECT ticker, ticker || '.JK' AS yfinance_symbol, date,
             first(price ORDER BY {ORDER}) AS open, max(price) AS high, min(price) AS low,
             last(price ORDER BY {ORDER}) AS close, last(price ORDER BY {ORDER}) AS adj_close,
             CAST(sum(l_quantity) AS BIGINT) AS volume, 'yfinance' AS source, '1d' AS interval
      FROM (SELECT lineitem.*, {owner} AS ticker, CAST(l_shipdate AS DATE) AS date,
                   l_extendedprice / l_quantity AS price
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey {where})
      GROUP BY ticker, date"""


CTES = {
    "bars": _bars("n_name"),
    "bars_f": _bars("n_name", "WHERE l_linestatus = 'F'"),
    "bars_o": _bars("n_name", "WHERE l_linestatus <> 'F'"),
    "bars_wide": _bars("s_name"),
    "universe": """
      SELECT n_name AS ticker, n_name || '.JK' AS yfinance_symbol, n_name AS name, r_name AS sector,
             n_nationkey + 1 AS market_cap_rank, CAST(NULL AS DOUBLE) AS beta
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "news": """
      SELECT doc_id AS ingest_order, n_name AS ticker,
             DATE '1995-01-02' + CAST(CAST(substr(d.source, 4, 10) AS INTEGER) * 113 + 7 * (n_chars % 3) AS INTEGER) AS date,
             title, substr(text, length(title) + 2) AS summary, url, source
      FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents) d
      JOIN nation ON n_nationkey = length(title) % 25
      LEFT JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)""",
    "articles": f"""
      SELECT ticker, date, ingest_order, text,
             CASE WHEN coalesce(trim(source), '') = '' THEN 'Unknown' ELSE trim(source) END AS source, 'rss' AS provider,
             {lexicon('text')} AS sentiment_score
      FROM (SELECT *, {clean("coalesce(title, '') || ' ' || coalesce(summary, '')")} AS text FROM news)
      WHERE length(text) > 0""",
    "per_source": "SELECT ticker, date, source, CAST(count(*) AS DOUBLE) AS n FROM articles GROUP BY ALL",
    "diversity": """
      SELECT ticker, date, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0 END AS source_diversity
      FROM per_source GROUP BY ticker, date""",
    "daily0": """
      SELECT ticker, date, avg(sentiment_score) AS sentiment_mean, coalesce(stddev_samp(sentiment_score), 0.0) AS sentiment_std,
             count(*) AS news_count, min(sentiment_score) AS sentiment_min, max(sentiment_score) AS sentiment_max,
             avg(abs(sentiment_score)) AS sentiment_abs_mean,
             count(*) FILTER (sentiment_score > 0.05) AS positive_news_count,
             count(*) FILTER (sentiment_score BETWEEN -0.05 AND 0.05) AS neutral_news_count,
             count(*) FILTER (sentiment_score < -0.05) AS negative_news_count,
             count(DISTINCT source) AS source_count, count(DISTINCT provider) AS provider_count
      FROM articles GROUP BY ticker, date""",
    "daily": """
      SELECT daily0.*, source_diversity,
             coalesce(sentiment_mean - lag(sentiment_mean) OVER (PARTITION BY ticker ORDER BY date), 0.0) AS sentiment_momentum
      FROM daily0 JOIN diversity USING (ticker, date)""",
    "scored_news": """
      SELECT news.*, lower(trim(coalesce(nullif(url, ''), nullif(title, ''), CAST(date AS VARCHAR), ''))) AS identity,
             sentiment_mean AS score
      FROM news LEFT JOIN daily USING (ticker, date)""",
    "labelled": f"""
      SELECT *, lead(close) OVER w AS next_day_price, lead(close) OVER w / nullif(close, 0) - 1 AS target_return,
             close / nullif({lag('close', 1)}, 0) - 1 AS r1, close / nullif({lag('close', 5)}, 0) - 1 AS r5
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "scored": """
      SELECT ticker, date, close, next_day_price, target_return, CAST(target_return > 0 AS BIGINT) AS direction,
             round(-0.5 * r1 + 0.1 * r5, 6) AS predicted_return, round(0.2 * r5 - 0.3 * r1, 6) AS other_return,
             round(0.5 + greatest(-0.45, least(0.45, -0.2 * r1 + 0.1 * r5)), 4) AS probability_up,
             CAST(-0.2 * r1 + 0.1 * r5 > 0 AS BIGINT) AS predicted_direction
      FROM labelled WHERE r5 IS NOT NULL AND target_return IS NOT NULL""",
    "latest_bar": """
      SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
    "predictions": """
      SELECT ticker, CAST(date AS VARCHAR) AS date, sector, close,
             CASE WHEN market_cap_rank % 5 <> 0 THEN round(-0.5 * r1 + 0.1 * r5, 6) END AS predicted_return,
             CASE WHEN market_cap_rank % 11 <> 0 THEN CAST(-0.5 * r1 + 0.1 * r5 > 0 AS BIGINT) END AS predicted_direction,
             CASE WHEN market_cap_rank % 7 <> 0 THEN round(0.5 + greatest(-0.45, least(0.45, -0.2 * r1 + 0.1 * r5)), 4) END AS probability_up,
             round(least(abs(-0.5 * r1 + 0.1 * r5), 1.0), 6) AS confidence
      FROM latest_bar JOIN universe USING (ticker)""",
    "two": """
      SELECT ticker, max(date) FILTER (k = 1) AS date, max(close) FILTER (k = 1) AS close, max(close) FILTER (k = 2) AS previous_close,
             max(volume) FILTER (k = 1) AS volume
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 2 GROUP BY ticker""",
    "moves": """
      SELECT ticker, ticker || '.JK' AS symbol, ticker AS name, date, close, previous_close, close - previous_close AS change,
             close / previous_close - 1 AS change_pct
      FROM two WHERE previous_close > 0""",
    "returns_1d": f"""
      SELECT ticker, date, close / prev - 1 AS r FROM (SELECT ticker, date, close, {lag('close', 1)} AS prev FROM bars) WHERE prev > 0""",
    "edges": """
      SELECT a.ticker AS source_ticker, b.ticker AS target_ticker, round(corr(a.r, b.r), 6) + 0.0 AS coefficient,
             count(*) AS observations, min(a.date) AS first_date, max(a.date) AS last_date
      FROM returns_1d a JOIN returns_1d b ON a.date = b.date AND a.ticker < b.ticker
      GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(a.r, b.r)) >= 0.02""",
    "sides": """
      SELECT source_ticker AS ticker, target_ticker AS peer_ticker, coefficient, observations, first_date, last_date FROM edges
      UNION ALL SELECT target_ticker, source_ticker, coefficient, observations, first_date, last_date FROM edges""",
    "graph_rows": """
      SELECT b.ticker, b.date, sector, close, volume, coalesce(n, 0) AS correlated_peer_count, coalesce(m, 0.0) AS correlation_avg_abs
      FROM bars b JOIN universe USING (ticker)
      LEFT JOIN (SELECT ticker, count(DISTINCT peer_ticker) AS n, avg(abs(coefficient)) AS m FROM sides GROUP BY ticker) USING (ticker)""",
    "wide_universe": """
      SELECT s_name AS ticker, s_name || '.JK' AS yfinance_symbol, s_name AS name, r_name AS sector, CAST(s_suppkey AS INTEGER) AS market_cap_rank
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def _needed(text: str, seen: list) -> list:
    for name, body in CTES.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)
    return seen


def sql(final: str, recursive: bool = False, **extra: str) -> str:
    """Prefix the shared tables a statement uses; `extra` adds its own, in order."""
    own = ", ".join(f"{n} AS ({b})" for n, b in extra.items())
    used = _needed(final + " " + " ".join(extra.values()), list(extra))
    shared = ", ".join(f"{n} AS ({CTES[n]})" for n in used if n not in extra)
    parts = ", ".join(p for p in (shared, own) if p)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{parts} " if parts else ""
    return re.sub(r"\s+", " ", head + final).strip()
