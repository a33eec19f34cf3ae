"""Exchange messages to the tick schema."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import pricing as P, timeparse as TP
from tickloom.schemas import CRYPTO_MESSAGE, TICK_EVENT

NUM = "decimal(24,8)"


def _num(col) -> Column:
    return TP.c(col).try_cast(NUM)


def _tick(source, symbol, price, volume, trade_id, exchange, timestamp, received_at, market_type, *extra) -> list[Column]:
    return [F.lit(source).alias("source"), symbol.alias("symbol"), price.alias("price"), volume.alias("volume"),
            trade_id.alias("trade_id"), exchange.alias("exchange"), timestamp.alias("timestamp"),
            received_at.alias("received_at"), F.lit(market_type).alias("market_type"), *extra]


def _now_ms(received_at) -> Column:
    return F.unix_millis(F.current_timestamp()) if received_at is None else received_at


def crypto_trades(messages: DataFrame, value: str = "value", received_at: Column | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """aggTrade messages, bare or inside a ``data`` envelope, to ticks; incomplete ones are dropped."""
    v = P.once(F.from_json(value, CRYPTO_MESSAGE))
    m = messages.select(*keep, v.alias("v")).select(*keep, F.when(F.col("v.data").isNotNull(), F.col("v.data")).otherwise(
        F.struct(*[F.col(f"v.{f}").alias(f) for f in ("e", "s", "p", "q", "T", "a")])).alias("m"))
    present = F.lit(True)
    for f in ("s", "p", "q", "T", "a"):
        present = present & F.col(f"m.{f}").isNotNull()
    price, qty = _num("m.p"), _num("m.q")
    ts = F.col("m.T").try_cast("long")
    return (m.filter(present & (price > 0) & (qty > 0) & ts.isNotNull())
            .select(*keep, *_tick("BINANCE", F.col("m.s"), price, qty, F.col("m.a"), F.lit("BINANCE"), ts,
                                  _now_ms(received_at), "CRYPTO")))


def equity_items(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per item; a payload may be one object or an array of objects.

    Items become maps, because their field names differ by case only (``T``/``t``, ``S``/``s``).
    """
    text = F.trim(value)
    as_array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    items = F.from_json(as_array, "array<string>")
    return (messages.select(*keep, F.explode(items).alias("_item"))
            .select(*keep, P.once(F.from_json("_item", "map<string,string>")).alias("m")).filter(F.col("m").isNotNull()))


def _m(field: str) -> Column:
    return F.col("m")[field]


def equity_trades(items: DataFrame, received_at: Column | None = None, processing_time: Column | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Trade items (type ``t``) to ticks; quotes, control and error items are left out."""
    price, size = _num(_m("p")), _num(_m("s"))
    exchange = F.coalesce(_m("x"), F.lit("UNKNOWN"))
    millis, fell_back = TP.rfc3339_millis(_m("t"), processing_time)
    trade_id = F.coalesce(_m("i"), F.concat_ws("_", exchange, millis.cast("string"), _m("S"), _m("s")))
    ok = (_m("T") == "t") & _m("S").isNotNull() & _m("t").isNotNull() & (price > 0) & (size > 0)
    return items.filter(ok).select(*keep, *_tick("ALPACA", _m("S"), price, size, trade_id, exchange, millis,
                                                 _now_ms(received_at), "STOCK", fell_back.alias("ts_fallback")))


def equity_quotes(items: DataFrame, received_at: Column | None = None, processing_time: Column | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Quote items (type ``q``) to synthetic ticks at the mid price with volume 0."""
    bid, ask = _num(_m("bp")), _num(_m("ap"))
    exchange = F.coalesce(_m("bx"), _m("ax"), F.lit("UNKNOWN"))
    millis, fell_back = TP.rfc3339_millis(_m("t"), processing_time)
    trade_id = F.concat_ws("_", exchange, F.lit("QUOTE"), millis.cast("string"), _m("S"))
    ok = (_m("T") == "q") & _m("S").isNotNull() & _m("t").isNotNull() & (bid > 0) & (ask > 0)
    mid = ((bid + ask) / 2).cast(NUM)
    return items.filter(ok).select(*keep, *_tick("ALPACA", _m("S"), mid, F.lit(0).cast(NUM), trade_id, exchange,
                                                 millis, _now_ms(received_at), "STOCK", fell_back.alias("ts_fallback")))


def event_json() -> Column:
    """Tick row to the JSON text of the topic: numbers as plain strings."""
    plain = lambda c: F.col(c).cast("string")
    return F.to_json(F.struct(
        "source", "symbol", plain("price").alias("price"), plain("volume").alias("volume"),
        F.col("trade_id").alias("tradeId"), "exchange", "timestamp", F.col("received_at").alias("receivedAt"),
        F.col("market_type").alias("marketType")))


def parse_events(raw: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Topic JSON to typed ticks with the list of violated rules; unreadable rows violate all."""
    v = raw.select(*keep, F.col(value).alias("raw"), P.once(F.from_json(value, TICK_EVENT)).alias("v"))
    typed = v.select(
        *keep, "raw", F.col("v.source").alias("source"), F.col("v.symbol").alias("symbol"), _num("v.price").alias("price"),
        _num("v.volume").alias("volume"), F.col("v.tradeId").alias("trade_id"), F.col("v.exchange").alias("exchange"),
        F.col("v.timestamp").alias("timestamp"), F.col("v.receivedAt").alias("received_at"),
        F.col("v.marketType").alias("market_type"))
    rules = P.missing_fields()
    bad_price = F.when(F.col("price").isNotNull() & ~P.valid_price("price"), F.array(F.lit("price<=0"))).otherwise(
        F.array().cast("array<string>"))
    return (typed.withColumn("violations", F.concat(rules, bad_price))
            .withColumn("is_valid", F.size("violations") == 0)
            .withColumn("ts", F.timestamp_millis(TP.epoch_to_millis("timestamp"))))


def clean_symbols(df: DataFrame, col: str = "symbol") -> DataFrame:
    """Distinct trimmed upper-case symbols without blanks, with the position of the first mention."""
    named = df.select(P.clean_symbol(col).alias("symbol"), "pos").filter(F.col("symbol").isNotNull())
    return named.groupBy("symbol").agg(F.min("pos").alias("first_pos"))


def instruments_of(ticks: DataFrame) -> DataFrame:
    """One instrument row per symbol of a tick set; the first mention by time gives the attributes."""
    sym = P.clean_symbol("symbol")
    rows = ticks.filter(sym.isNotNull() & F.col("market_type").isNotNull() & F.col("exchange").isNotNull())
    attrs = F.struct(F.trim("market_type").alias("market_type"),
                     P.or_default(F.upper("exchange"), "UNKNOWN").alias("exchange"))
    agg = rows.groupBy(sym.alias("symbol")).agg(
        F.min_by(attrs, F.struct("ts", "trade_id")).alias("a"), F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"))
    return agg.select("symbol", "a.market_type", "a.exchange", F.col("symbol").alias("name"),
                      F.lit(True).alias("is_active"), "first_seen_at", "last_seen_at")


def upsert_instruments(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Merge seen instruments into the dimension: keep first_seen, bump last_seen, refresh attributes."""
    o, n = stored.alias("o"), seen.alias("n")
    j = o.join(n, F.col("o.symbol") == F.col("n.symbol"), "full_outer")
    is_new, is_seen = F.col("o.symbol").isNull(), F.col("n.symbol").isNotNull()
    pick = lambda c: F.when(is_seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(
        F.coalesce("o.symbol", "n.symbol").alias("symbol"), pick("market_type"), pick("exchange"),
        F.when(is_seen, F.coalesce(F.nullif("n.name", F.lit("")), "o.name")).otherwise(F.col("o.name")).alias("name"),
        F.when(is_new, F.lit(True)).otherwise(F.col("o.is_active")).alias("is_active"),
        F.when(is_new, F.col("n.first_seen_at")).otherwise(F.col("o.first_seen_at")).alias("first_seen_at"),
        F.when(is_seen, F.greatest("o.last_seen_at", "n.last_seen_at")).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"))


def list_instruments(instruments: DataFrame, market_type: str | None = None) -> DataFrame:
    """Active instruments, newest seen first."""
    active = instruments.filter("is_active")
    if market_type:
        active = active.filter(F.col("market_type") == market_type)
    return active.orderBy(F.desc("last_seen_at"), "symbol")


def edit_instrument(instruments: DataFrame, symbol: str, name: str | None = None, exchange: str | None = None,
                    active: bool | None = None) -> DataFrame:
    """Change name or exchange of one instrument, or (de)activate it."""
    hit = F.col("symbol") == symbol.strip().upper()
    edits = {"name": name, "exchange": exchange, "is_active": active}
    return instruments.withColumns({
        col: F.when(hit, F.lit(value)).otherwise(F.col(col)) for col, value in edits.items() if value is not None})
