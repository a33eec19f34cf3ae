"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs once to warm up
and is then timed; the result goes to Spark's no-op sink, so every row is computed and none collected.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.queries import QUERIES  # noqa: E402
from tickloom.session import get_spark  # noqa: E402

HEADLINE = [
    "NRM1_crypto_trade", "NRM2_equity_trade", "NRM9_field_contract", "DUP2_lowest_id_per_symbol",
    "AGG1_minute_ohlcv", "AGG2_daily_ohlcv", "AGG3_rebucket_15m", "AGG5_top_up_5m", "AGG7_coverage_1m", "AGG20_latency",
    "MERGE1_live", "MERGE2_exchange", "SNK3_stage_and_merge", "JON2_extreme_moves", "JON4_market_overview",
    "WIN1_sma", "WIN10_macd_signal", "WIN14_ma_crossover", "WIN15_rsi_strategy", "WIN18_interpolated", "WIN28_run_summary",
    "FCT1_walk_forward_closed_form", "FCT2_intraday_closed_form", "FCT1_walk_forward_arima", "RPT1_performance_grid",
    "STR1_minute_candles", "STR4_dedupe_counts", "STR7_stored_ticks", "VAL8_missing_minutes", "VAL11_lag_alerts",
    "MNT1_retention", "MNT2_compaction", "MNT3_purge_source", "VAL9_filled_minutes", "RPT5_daily_job", "DUP1_lowest_id",
    "STR5_expiring_prices", "STR8_dead_letters", "VAL9_repair_run", "WIN26_minute_drawdown", "AGG24_run_medians", "RPT5_target_date_checks",
]
HEAVY = {"FCT1_walk_forward_arima"}  # timed on the first run


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        if name not in HEAVY:
            run(name)
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
