"""Fixed table schemas and plan-time column checks."""

from pyspark.sql import DataFrame

PRICE_BAR = (
    "ticker string, yfinance_symbol string, date date, open double, high double, low double, "
    "close double, adj_close double, volume bigint, source string, interval string"
)
UNIVERSE = (
    "ticker string, yfinance_symbol string, name string, sector string, "
    "market_cap_rank int, beta double"
)
STOCK_RECORD = (
    "ticker string, name string, sector string, exchange string, yfinance_symbol string, "
    "universe_rank int"
)
NEWS_RAW = (
    "ticker string, date date, title string, summary string, url string, source string, "
    "provider string, sentiment_score double, image_url string"
)
CORRELATION_EDGE = (
    "source_ticker string, target_ticker string, coefficient double, abs_coefficient double, "
    "observations bigint, first_date date, last_date date, method string, price_source string, "
    "interval string"
)
GDELT_PAYLOAD = (
    "ticker string, articles array<struct<title:string,url:string,seendate:string,"
    "datetime:string,sourceCommonName:string,domain:string,snippet:string,"
    "socialimage:string,image:string>>"
)
NEWSAPI_PAYLOAD = (
    "ticker string, status string, message string, articles array<struct<title:string,"
    "description:string,content:string,url:string,publishedAt:string,"
    "source:struct<name:string>,urlToImage:string>>"
)
FEED_ENTRY = (
    "title string, summary string, description string, subtitle string, link string, "
    "published string, updated string, created string, image_url string, image string, "
    "urlToImage string, socialimage string, media_content array<struct<url:string>>, "
    "media_thumbnail array<struct<url:string>>, "
    "enclosures array<struct<href:string,url:string,type:string>>, "
    "links array<struct<rel:string,href:string,type:string>>"
)


def require_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    """Fail while planning, without a job, when a required column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df
