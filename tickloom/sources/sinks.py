"""Table writes: append-if-new, partition-wise merge, dead letters, retries, result tables.

Plain Parquet has no MERGE. A merge stages its batch, reads the day partitions the batch touches, writes the
merged rows to a staging table, and overwrites the partitions with changes from it, so no plan reads the
files it replaces and a failed attempt can run again.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.operators.dedup import keep_extreme
from tickloom.operators.merge import insert_missing
from tickloom.session import drop_path, work_path


def by_day(df: DataFrame, day: str) -> DataFrame:
    """Rows of a day together, in files of an even size.

    A rebalance (unlike a repartition) lets the adaptive run split a day that holds most of the rows.
    """
    return df.hint("rebalance", F.col(day))


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, day: str | None = None, order: list[str] | None = None) -> None:
    """Create or replace a table; a day column becomes the directory layout."""
    if day:
        df = by_day(df, day)
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(day) if day else writer).parquet(path)


def staged(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a batch once, so that nothing later evaluates it again; the caller drops the folder."""
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def days_of(df: DataFrame, day: str) -> list:
    """The distinct days, at most one value for each day of the table."""
    return [row[0] for row in df.select(day).distinct().collect()]


def touched(stored: DataFrame, days: list, day: str) -> DataFrame:
    """Stored rows of exactly these days; the list prunes directories."""
    return stored.filter(F.col(day).isin(days)) if days else stored.limit(0)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, key: list[str], day: str) -> None:
    """Append the rows whose key the table does not hold yet (insert, do nothing on conflict).

    The check reads the table itself, so a batch that runs again after a restart inserts nothing twice. Of several rows with one
    key the first by their JSON text stays, the same one in every run.
    """
    rest = [c for c in incoming.columns if c not in key]
    one = keep_extreme(incoming, key, F.to_json(F.struct(*rest)), largest=False) if rest else incoming.distinct()
    fresh, stage = staged(spark, one, "append")
    try:
        new = fresh
        if table_exists(spark, path):
            new = insert_missing(touched(spark.read.parquet(path), days_of(fresh, day), day), fresh, key)
        by_day(new, day).write.mode("append").partitionBy(day).parquet(path)
    finally:
        drop_path(spark, stage)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replace the day partitions that ``df`` holds."""
    (by_day(df, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, day: str,
               merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Merge ``incoming`` into the table at ``path``; returns the staged rows with their ``changed`` flag.

    Only the days of ``incoming`` are read, and only those with a changed row are written.
    """
    new, batch = staged(spark, incoming, "incoming")
    merged = merge(touched(spark.read.parquet(path), days_of(new, day), day), new)
    stage = work_path(spark, "stage")
    by_day(merged, day).write.partitionBy(day).parquet(stage)
    rows = spark.read.schema(merged.schema).parquet(stage)  # also readable when nothing was merged
    days = days_of(rows.filter("changed"), day)
    if days:
        overwrite_days(rows.filter(F.col(day).isin(days)).drop("changed"), path, day)
    drop_path(spark, batch)
    return rows


def changed_count(staged: DataFrame) -> DataFrame:
    return staged.agg(F.count_if("changed").alias("changed_rows"))


def dead_letters(failed: DataFrame, topic: str, group: str, failed_at: Column, batch_size: int = 500) -> DataFrame:
    """One record per failed message; the batch is the poll of ``batch_size`` offsets it came in."""
    batch = Window.partitionBy("partition", F.floor(F.col("offset") / batch_size))
    return failed.select(
        F.lit(topic).alias("original_topic"), F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"), F.col("value").alias("original_message"), "error_type", "error_message",
        F.col("retry_count").cast("int").alias("retry_count"), failed_at.alias("failed_at"),
        F.lit(group).alias("consumer_group"),
        F.create_map(
            F.lit("batchIndex"), (F.row_number().over(batch.orderBy("offset")) - 1).cast("string"),
            F.lit("batchSize"), F.count("*").over(batch).cast("string")).alias("metadata"))


def retries(failed: DataFrame, topic: str, at: Column) -> DataFrame:
    """Retry records: key, value and the headers of the next attempt."""
    return failed.select(
        F.col("symbol").alias("key"), "value",
        F.create_map(
            F.lit("retry-count"), (F.col("retry_count") + 1).cast("string"), F.lit("original-topic"), F.lit(topic),
            F.lit("retry-timestamp"), F.unix_millis(at.cast("timestamp")).cast("string"),
            F.lit("error-message"), F.coalesce("error_message", F.lit(""))).alias("headers"))


def validation_row(check: str, target: Column, result: Column) -> list[Column]:
    """Job-run row of a validation: name, status, JSON meta."""
    meta = F.to_json(F.struct(F.lit(check).alias("checkName"), target.cast("string").alias("targetDate"), result.alias("result")))
    return [F.lit(f"validation_{check}").alias("job_name"), F.lit("SUCCESS").alias("status"), meta.alias("meta")]
