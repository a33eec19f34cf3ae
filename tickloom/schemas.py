"""Fixed schemas of the data model."""
from pyspark.sql import types as T

PRICE = T.DecimalType(24, 8)
BIG_VOLUME = T.DecimalType(32, 8)

# One normalized tick as it travels on the topic: numbers as strings, time as epoch millis.
TICK_EVENT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("volume", T.StringType()),
    T.StructField("tradeId", T.StringType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("receivedAt", T.LongType()),
    T.StructField("marketType", T.StringType()),
])

TICK_KEY = ["symbol", "source", "trade_id", "ts"]
CANDLE_KEY = ["symbol", "source", "bucket"]
DAILY_KEY = ["symbol", "trade_date", "source"]
OHLCV = ["open", "high", "low", "close", "volume"]

# Archive CSV: 12 columns without a header, 9 of them used.
ARCHIVE_CSV = T.StructType([
    T.StructField(name, T.StringType())
    for name in ["open_time", "open", "high", "low", "close", "volume", "close_time",
                 "quote_volume", "trade_count", "taker_base", "taker_quote", "ignore"]
])

# Exchange messages; every value is read as text so one odd field never nulls the record.
_AGG = T.StructType([T.StructField(c, T.StringType()) for c in ["e", "s", "p", "q", "T", "a"]])
CRYPTO_MESSAGE = T.StructType(list(_AGG.fields) + [T.StructField("data", _AGG)])
