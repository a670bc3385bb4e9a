"""Fixed values of the screening rules.

They must stay as they are for results to agree with the rules this library
re-expresses; everything else is a parameter.
"""

# Screen defaults.
DEFAULT_VOLUME_MULTIPLIER = 2.0
DEFAULT_MA_SHORT = 90
DEFAULT_MA_INTERMEDIATE = 180
DEFAULT_MA_MEDIUM = 360
DEFAULT_MA_LONG = 700
DEFAULT_AVG_VOLUME_WEEKS = 52
DEFAULT_PRICE_AVG_WEEKS = 1
DEFAULT_LOOKBACK_WEEKS = 1
DEFAULT_HISTORY_YEARS = 15

# Time arithmetic.
DAYS_PER_YEAR = 365.25
WEEKS_PER_YEAR = 52
HISTORY_BUFFER_YEARS = 2
MIN_PERIOD_FRACTION = 0.8
RECENCY_DAYS = 7
WEEK_END_DAY = "Mon"

# Symbol list formats.
SUFFIX_ASX = ".AX"
LIST_HEADER = "Symbol|Security Name"
LIST_HEADER_WORDS = ("Symbol", "Security Name")
HEADER_SYMBOL = "SYMBOL"
US_LIST_NAME = "nasdaq_screener_list.txt"

# Chart and quote addresses.
QUOTE_URL = "https://finance.yahoo.com/quote/"
CHART_URL = "https://www.tradingview.com/chart/?symbol="
CHART_EXCHANGE_ASX = "ASX:"

# Field names of a saved snapshot document.
HISTORY_FIELDS = ("Open", "High", "Low", "Close", "Volume")
INFO_MARKET_CAP = "marketCap"
INFO_MARKET_PRICE = "regularMarketPrice"

# Labels of the moving-average states.
MA_LABELS = {"pass": "Yes", "fail": "No", "omitted": "Omit"}
MA_LABEL_ABSENT = "N/A"

# Column names of the canonical bar tables.
OHLCV = ("open", "high", "low", "close", "volume")
