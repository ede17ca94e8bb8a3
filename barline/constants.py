"""Names, word lists, thresholds and labels that results depend on."""

# --- fixed values: price features, in output order -------------------------------------------
PRICE_FEATURES = [
    "return_1d", "return_5d", "return_10d", "return_20d", "log_return_1d",
    "volatility_5d", "volatility_10d", "volatility_20d", "volatility_60d",
    "SMA_20", "SMA_50", "SMA_200",
    "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist", "RSI",
    "BB_middle", "BB_upper", "BB_lower", "BB_width", "BB_percent_b",
    "ATR", "atr_pct",
    "volume_sma_20", "volume_sma_50", "volume_ratio_20", "volume_ratio_50", "volume_change_1d", "volume_zscore_20",
    "close_to_sma_20", "close_to_sma_50", "close_to_sma_200", "sma20_to_sma50", "sma50_to_sma200",
    "momentum_5d", "momentum_10d", "momentum_20d", "momentum_60d",
    "drawdown_20d", "drawdown_60d", "price_position_20d", "price_position_60d",
    "high_low_range", "close_open_return", "gap_return", "true_range_pct",
    "rolling_max_20d_ratio", "rolling_min_20d_ratio", "rolling_max_60d_ratio", "rolling_min_60d_ratio",
    "obv", "obv_20d_change", "dollar_volume", "dollar_volume_sma_20",
]

# --- fixed values: daily news features, in output order --------------------------------------
NEWS_FEATURES = [
    "sentiment_mean", "sentiment_std", "news_count", "sentiment_momentum",
    "sentiment_min", "sentiment_max", "sentiment_abs_mean",
    "positive_news_count", "neutral_news_count", "negative_news_count",
    "source_count", "provider_count", "source_diversity",
]
EMBEDDING_DIMENSIONS = 50
HASHED_TERMS = 384

LABEL_COLUMNS = [
    "next_day_price", "target_return", "direction",
    "market_next_return", "target_excess_return", "outperform_market",
    "sector_next_return", "target_sector_excess_return", "outperform_sector",
]

# --- fixed values: word lists ------------------------------------------------------------------
TITLE_STOPWORDS = [
    "a", "an", "and", "atau", "dan", "dari", "di", "for", "ini", "itu", "ke", "of", "on", "pada",
    "saat", "the", "untuk", "yang",
]
POSITIVE_TERMS = [
    "akumulasi", "bullish", "cuan", "laba", "melaju", "menguat", "naik", "optimis", "positif",
    "rebound", "rekor", "tumbuh", "untung",
]
NEGATIVE_TERMS = [
    "anjlok", "bearish", "koreksi", "melemah", "merosot", "negatif", "rugi", "tekanan",
    "terkoreksi", "turun",
]
TRACKING_PARAMS = [
    "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src",
    "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
]
LEGAL_FORMS = ["PT", "Tbk", "Perseroan", "Persero", "Terbuka"]
DEFAULT_FEEDS = [
    ("CNBC Indonesia Market", "https://www.cnbcindonesia.com/market/rss"),
    ("Bisnis Finansial", "https://finansial.bisnis.com/rss"),
    ("Kontan Investasi", "https://investasi.kontan.co.id/rss"),
]
NEWS_PROVIDERS = ["rss", "gdelt", "newsapi"]

# --- fixed values: thresholds and defaults -----------------------------------------------------
SENTIMENT_BAND = 0.05
TITLE_SIMILARITY = 0.9
TITLE_MIN_JACCARD = 0.75
TITLE_MIN_TOKENS = 4
UNRANKED = 1_000_000
MIN_NEWS_CARDS = 6
PRICE_SOURCE = "yfinance"
PRICE_INTERVAL = "1d"
CORRELATION_METHOD = "pearson_close_return"
SYMBOL_SUFFIX = ".JK"
INDEX_TICKER = "IHSG"
INDEX_SYMBOL = "^JKSE"
INDEX_NAME = "IDX Composite"
CHART_INTERVALS = ["1d", "5d", "1wk", "1mo"]
RANGE_TO_PERIOD = {
    "1d": "1d", "5d": "5d", "1m": "1mo", "1mo": "1mo", "3m": "3mo", "3mo": "3mo",
    "6m": "6mo", "6mo": "6mo", "ytd": "ytd", "1y": "1y", "5y": "5y", "all": "max", "max": "max",
}
HISTORY_COLUMNS = [
    "date", "open", "high", "low", "close", "volume", "return_5d", "volatility_20d",
    "SMA_20", "SMA_50", "SMA_200", "RSI", "MACD", "BB_upper", "BB_lower",
    "volume_sma_20", "volume_ratio_20", "close_to_sma_20", "close_to_sma_50",
]
AUTO_WINDOWS = (3, 5, 10, 20)
DRIVER_LABELS = [
    ("trend", "Technical trend"), ("momentum", "Market momentum"), ("volume", "Volume pressure"),
    ("sentiment", "News sentiment"), ("volatility", "Volatility"), ("model", "Model confidence"),
]

# --- fixed values: user-facing texts -----------------------------------------------------------
NO_NEWS_TEXT = (
    "Prediction is based on technical market features. "
    "News sentiment is not available for this ticker yet."
)
NO_NEWS_THEME = "News sentiment unavailable"
FULL_SIGNAL_TEXT = "Prediction uses the latest available technical and NLP market features."
LIMITED_NEWS_NOTE = "Limited confidence because recent NLP/news signal is unavailable."
LIMITED_MODEL_NOTE = (
    "Limited confidence because the trained model signal is unavailable for this ticker."
)
NOT_IN_UNIVERSE_TEXT = (
    "Model prediction is not available for this ticker in the current training universe. "
    "Technical signals are shown from latest price features."
)
LATEST_NEWS_TEXT = "Using latest available market news"
LIMITED_NEWS_TEXT = "Showing recent market news when ticker-specific news is limited"


def embedding_columns(dimensions: int = EMBEDDING_DIMENSIONS) -> list[str]:
    return [f"embedding_dim_{i}" for i in range(dimensions)]


def news_feature_columns(dimensions: int = EMBEDDING_DIMENSIONS) -> list[str]:
    return NEWS_FEATURES + embedding_columns(dimensions)
