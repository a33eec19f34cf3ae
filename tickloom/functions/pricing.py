"""Price arithmetic and validity rules."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .timeparse import c


def once(value: Column) -> Column:
    """Evaluate a costly expression once per row.

    The optimizer copies a projected expression into every later use of its fields, so a parsed JSON
    document would be parsed again for each field; a generator is not copied.
    """
    return F.explode(F.array(value))


def change(price, prev) -> Column:
    """Absolute change, 0 without a usable previous close."""
    p, q = c(price), c(prev)
    return F.when(q > 0, p - q).otherwise(F.lit(0).cast("decimal(24,8)")).cast("decimal(24,8)")


def change_percent(price, prev) -> Column:
    """Change in percent, rounded half up twice: the ratio to 4 digits, then the percentage to 2."""
    p, q = c(price), c(prev)
    ratio = F.round(((p - q) / q).cast("decimal(30,12)"), 4)
    return F.when(q > 0, F.round(ratio * 100, 2)).otherwise(F.lit(0)).cast("decimal(18,2)")


def half_up(value, scale: int) -> Column:
    """Round a double half up through a decimal, the same in every engine."""
    return F.round(c(value).cast("decimal(30,10)"), scale)


def valid_price(price) -> Column:
    p = c(price)
    return F.coalesce(p > 0, F.lit(False))


def sane_candle(o="open", h="high", l="low", cl="close") -> Column:
    """High covers open and close from above, low from below."""
    return (c(h) >= F.greatest(c(o), c(cl))) & (c(l) <= F.least(c(o), c(cl)))


def valid_kline(volume="volume", count="trade_count") -> Column:
    """Finite positive prices, non-negative volume and count, consistent high and low."""
    prices = [c(x).cast("double") for x in ("open", "high", "low", "close")]
    finite = F.lit(True)
    for p in prices + [c(volume).cast("double")]:
        finite = finite & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    positive = (prices[0] > 0) & (prices[1] > 0) & (prices[2] > 0) & (prices[3] > 0)
    ok = finite & positive & (c(volume).cast("double") >= 0) & (c(count) >= 0) & sane_candle() & (c("high") >= c("low"))
    return F.coalesce(ok, F.lit(False))


TICK_FIELDS = ["source", "symbol", "price", "volume", "trade_id", "exchange", "timestamp", "received_at", "market_type"]


def missing_fields(fields=TICK_FIELDS) -> Column:
    """Names of required fields that are absent or blank."""
    marks = [F.when(c(f).isNull() | (F.trim(c(f).cast("string")) == ""), F.lit(f)) for f in fields]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


# Error classes and the ones worth a retry.
RETRYABLE = ["STORAGE_CONNECTION_ERROR", "STORAGE_ERROR", "TIMEOUT_ERROR"]
_CLASS_OF_CODE = {
    "TIMEOUT": "TIMEOUT_ERROR",
    "CONNECT": "STORAGE_CONNECTION_ERROR",
    "SQL_CONNECTION": "STORAGE_CONNECTION_ERROR",
    "SQL": "STORAGE_ERROR",
    "ILLEGAL_ARGUMENT": "VALIDATION_ERROR",
    "NULL_VALUE": "VALIDATION_ERROR",
    "CLASS_CAST": "VALIDATION_ERROR",
}


def error_class(code, message) -> Column:
    """Error class of a failed record from its error code and message."""
    known = F.create_map(*[F.lit(x) for kv in _CLASS_OF_CODE.items() for x in kv])
    text = c(message)
    refused = text.contains("Connection refused") | text.contains("Unable to connect")
    return (F.when(c(code).isNull() & text.isNull(), "UNKNOWN_ERROR")
            .when(known[c(code)].isNotNull(), known[c(code)])
            .when(refused, "STORAGE_CONNECTION_ERROR")
            .when(c(code).isin("DATA_ACCESS", "TRANSACTION"), "STORAGE_ERROR")
            .otherwise("PROCESSING_ERROR"))


def is_retryable(error_type) -> Column:
    return c(error_type).isin(RETRYABLE)


def clean_symbol(symbol) -> Column:
    """Trimmed upper-case symbol, NULL when blank."""
    return F.nullif(F.upper(F.trim(c(symbol))), F.lit(""))


def or_default(text, default) -> Column:
    """Trimmed text, or the default where it is blank."""
    return F.coalesce(F.nullif(F.trim(c(text)), F.lit("")), c(default) if isinstance(default, Column) else F.lit(default))


# Quote suffix, pairs that are not coins, leveraged-token pattern.
QUOTE = "USDT"
NON_COIN = [
    "USDCUSDT", "FDUSDUSDT", "TUSDUSDT", "USDPUSDT", "DAIUSDT", "BUSDUSDT", "PAXUSDT",
    "USDSUSDT", "USDSBUSDT", "SUSDUSDT", "USTUSDT", "USDEUSDT", "USD1USDT", "XUSDUSDT",
    "RLUSDUSDT", "BFUSDUSDT", "AEURUSDT", "EURIUSDT", "EURUSDT", "GBPUSDT", "AUDUSDT",
    "BRLUSDT", "TRYUSDT", "RUBUSDT", "UAHUSDT", "BIDRUSDT", "IDRTUSDT", "NGNUSDT",
    "ZARUSDT", "ARSUSDT", "BKRWUSDT", "PAXGUSDT", "XAUTUSDT", "WBTCUSDT", "WBETHUSDT",
    "BETHUSDT", "BNSOLUSDT",
]
LEVERAGED = (
    r"^(BTC|ETH|BNB|ADA|XRP|LINK|DOT|TRX|EOS|XTZ|LTC|SXP|FIL|YFI|SUSHI|UNI|XLM|BCH|AAVE|1INCH)"
    r"(UP|DOWN)USDT$|^(ETH|BNB|EOS|XRP)?(BULL|BEAR)USDT$")
# Pegged pairs left out of turnover rankings.
PEGGED = [
    "USDCUSDT", "FDUSDUSDT", "TUSDUSDT", "USDPUSDT", "DAIUSDT", "BUSDUSDT", "EURUSDT",
    "AEURUSDT", "USD1USDT", "XUSDUSDT", "RLUSDUSDT", "USDEUSDT", "BFUSDUSDT", "EURIUSDT",
    "PAXGUSDT", "XAUTUSDT", "WBTCUSDT", "WBETHUSDT", "BNSOLUSDT", "USDSUSDT",
]


def is_coin_pair(symbol) -> Column:
    """Quoted in the stable quote, not a stable, fiat or wrapped asset, not a leveraged token."""
    s = c(symbol)
    return s.endswith(QUOTE) & (s != QUOTE) & ~s.isin(NON_COIN) & ~s.rlike(LEVERAGED)
