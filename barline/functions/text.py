"""Text, ticker, URL and date-text normalisation as column expressions."""

from pyspark.sql import Column, functions as F

from ..constants import (
    LEGAL_FORMS, NEGATIVE_TERMS, POSITIVE_TERMS, SYMBOL_SUFFIX, TITLE_STOPWORDS, TRACKING_PARAMS,
)

# every Unicode white-space character, not only the ASCII ones behind Java's \s
BLANK = r"\s\x0B\x1C-\x1F\x85\p{Z}"
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def given(value: Column, use) -> Column:
    """`use(value)`, where the expression `value` stands and is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    # a blank that stands alone stays as it is, which is most of them
    return F.trim(F.regexp_replace(c, f"[{BLANK}]{{2,}}+|[{BLANK}&&[^ ]]", " "))


def non_empty(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", ""), F.lit(""))


def normalize_ticker(c: Column) -> Column:
    """Squeeze, upper-case, drop one trailing exchange suffix."""
    return F.regexp_replace(F.upper(squeeze(c)), r"\.JK$", "")


def strip_every_suffix(c: Column) -> Column:
    """The request variant: every occurrence of the suffix goes."""
    return F.trim(F.replace(F.upper(c), F.lit(SYMBOL_SUFFIX), F.lit("")))


def default_symbol(ticker: Column) -> Column:
    return F.concat(ticker, F.lit(SYMBOL_SUFFIX))


def strip_markup(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def clean_text(c: Column) -> Column:
    """Drop tags and links, squeeze blanks."""
    no_tags = F.regexp_replace(c, "<[^>]+>", " ")
    return squeeze(F.regexp_replace(no_tags, f"https?://[^{BLANK}]+", " "))


def article_text(title: Column, summary: Column) -> Column:
    return clean_text(F.concat_ws(" ", text_or_empty(title), text_or_empty(summary)))


def lexicon_sentiment(c: Column, positive=None, negative=None) -> Column:
    """(positive - negative) / sqrt(words), clamped to one; a term in both lists is positive.

    Listed words are filtered from the others first, so next to nothing is evaluated word by word.
    """
    plus = list(positive or POSITIVE_TERMS)
    terms = list(dict.fromkeys([*plus, *(negative or NEGATIVE_TERMS)]))
    longest = max(map(len, terms))

    def score(words, hits):
        votes = 2 * F.size(F.filter(hits, lambda w: F.lower(w).isin(plus))) - F.size(hits)
        ratio = votes / F.sqrt(F.size(words).cast("double"))
        return F.when(votes == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))

    def listed(words):
        return F.filter(words, lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(terms))

    words = F.regexp_extract_all(c, F.lit("[a-zA-Z]++"), F.lit(0))
    return given(words, lambda words: F.when(words.isNotNull(), given(listed(words), lambda hits: score(words, hits))))


def title_tokens(title: Column) -> Column:
    """Sorted distinct words of two letters or more that are not stop words."""
    words = F.regexp_extract_all(F.lower(text_or_empty(title)), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def _plus_decoded(part: Column) -> Column:
    plain = F.replace(part, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(part), plain)


def _plus_encoded(part: Column) -> Column:
    # the JVM form encoder keeps * and escapes ~; the canonical form does the opposite
    encoded = F.url_encode(part)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, tidy path, sorted query without tracking parameters."""
    url = squeeze(text_or_empty(c))
    scheme = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    host = F.lower(F.regexp_extract(url, URL_PARTS, 2))
    path = F.regexp_replace(
        F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), "/+", "/"), "/+$", ""
    )
    pieces = F.filter(
        F.split(F.regexp_extract(url, URL_PARTS, 4), "&"), lambda p: F.length(p) > 0
    )
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _plus_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _plus_decoded(F.regexp_extract(p, "^[^=]*=?([\\s\\S]*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS) & ~F.startswith(F.lower(p["k"]), F.lit("utm_")),
    )
    query = F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(_plus_encoded(p["k"]), F.lit("="), _plus_encoded(p["v"])),
        ),
        "&",
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def infer_provider(source: Column) -> Column:
    low = F.lower(squeeze(text_or_empty(source)))
    return (
        F.when(F.startswith(low, F.lit("gdelt")), "gdelt")
        .when(F.startswith(low, F.lit("newsapi")), "newsapi")
        .when(F.startswith(low, F.lit("mediastack")), "mediastack")
        .otherwise("rss")
    )


def resolve_provider(provider: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(squeeze(provider)), F.lit("")), infer_provider(source))


def clean_company_name(name: Column) -> Column:
    forms = "|".join(LEGAL_FORMS)
    bare = F.regexp_replace(name, rf"(?i)\b({forms})\b|\([^)]*\)", " ")
    return squeeze(F.translate(bare, ".,", "  "))


def news_query(ticker: Column, name: Column, provider: str) -> Column:
    symbol = F.upper(ticker)
    company = clean_company_name(text_or_empty(name))
    both = F.concat(symbol, F.lit(' OR "'), company, F.lit('"'))
    if provider == "gdelt":
        both = F.concat(F.lit("("), both, F.lit(")"))
    return F.when((company == "") | (F.upper(company) == symbol), symbol).otherwise(both)


def api_date(c: Column, as_of) -> Column:
    """yyyyMMdd… or ISO prefix; missing text takes the caller's date, never the clock."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    packed = F.substring(text, 1, 8)
    parsed = F.when(
        packed.rlike("^[0-9]{8}$"), F.try_to_date(packed, "yyyyMMdd")
    ).otherwise(F.substring(text, 1, 10).try_cast("date"))
    return F.when(text.isNull(), F.lit(as_of).cast("date")).otherwise(parsed)


def feed_date(published: Column, updated: Column, created: Column, as_of) -> Column:
    """First field of ten characters or more: RFC-822 date as written, else its ISO prefix."""

    def usable(c):
        return F.when(F.length(c) >= 10, c)

    text = F.coalesce(usable(published), usable(updated), usable(created))
    day_month_year = F.regexp_extract(text, r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})", 0)
    rfc = F.try_to_date(
        F.regexp_replace(day_month_year, r"^(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})$", "$1 $2 $3"),
        "d MMM yyyy",
    )
    return F.when(text.isNull(), F.lit(as_of).cast("date")).otherwise(
        F.coalesce(rfc, F.substring(text, 1, 10).try_cast("date"))
    )


def is_http(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^https?://"), F.lit(False))


def http_or_null(c: Column) -> Column:
    return F.when(is_http(c), F.trim(c))
