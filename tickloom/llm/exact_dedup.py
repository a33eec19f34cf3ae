"""Operator 10: exact de-duplication as a stateful stream.

A Structured Streaming aggregation keyed by the SHA-256 digest of the text keeps, in RocksDB state without
expiry, the largest document id, the locator of that row's content (file and row number) and the group's size.
The aggregation combines copies inside each map task, so a group of copies that holds a third of all rows
reaches the state as one row per task. A stream may stop and go on with its checkpoint at any time.

``resolve`` reads the state back and gives every document its group. Every row that hits a digest already
held by another row is compared with the kept row's bytes, which are fetched by the locator; rows whose bytes
differ (a digest collision) are grouped again by their whole text, so the answer never rests on a digest.

Defined cases: null text counts as the empty text; empty texts are equal to each other; rows that repeat one
doc_id all count, and all of them are kept if that doc_id is the group's keep_id; an empty table gives no rows;
null doc_ids rank below every other. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import ready, stored, text_or_empty
from tickloom.session import with_conf, work_path

#: Groups of copies whose digests are broadcast: about 100 bytes each in a hash table, 20 MB in all.
BROADCAST_GROUPS = 200_000
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # many small stores: no reserved files


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(df: DataFrame, digest, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
                     text.alias("text"))


def feed(spark: SparkSession, path: str, checkpoint: str, *, digest=sha256, id_col="doc_id", text_col="text",
         files_per_trigger: int | None = None) -> None:
    """Take every file of ``path`` that the checkpoint has not seen into the state, then stop."""
    ready(spark)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern of this one name: the stream source takes single files only by pattern
    rows = _located(source.parquet(path), digest, id_col, text_col).drop("text")
    state = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
    with with_conf(spark, ROCKSDB):
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep_id, file and row of the kept content, group size."""
    state = spark.read.format("statestore").load(checkpoint)
    kept, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"{kept}.doc_id").alias("keep_id"),
                        F.col(f"{kept}.file").alias("keep_file"), F.col(f"{kept}.row").alias("keep_row"),
                        F.col(n).alias("group_size"))


def collisions(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The digests whose rows differ in their bytes: every hit is compared with the kept row, fetched by its locator.

    Only rows of groups are shuffled with their text. The groups' digests reach the rows by broadcast while there are
    few of them (40 bytes each), else by a join like any other.
    """
    groups = state.filter("group_size > 1").select("digest", "keep_file", "keep_row")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    hits = stored(rows.join(groups, "digest").select(
        "digest", "text", (F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))).alias("fetched")), "exact-hits")
    fetched = hits.filter("fetched").select("digest", F.col("text").alias("keep_text"))
    return stored(hits.filter("not fetched").join(fetched, "digest").filter("text <> keep_text").select("digest").distinct(), "exact-collisions")


def resolve(spark: SparkSession, path: str, checkpoint: str, *, digest=sha256, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``path``."""
    with with_conf(spark, ROCKSDB):
        state = stored(held(spark, checkpoint), "exact-held")
    rows = _located(ready(spark).read.parquet(path), digest, id_col, text_col).withColumn("sha", sha256(F.col("text")))
    collided = collisions(rows, state)
    out = rows.select("doc_id", "digest", "sha").join(state.select("digest", "keep_id", "group_size"), "digest")
    if not collided.isEmpty():  # these rows are grouped by their whole texts
        out = out.join(collided, "digest", "left_anti")
        again = rows.join(collided, "digest", "left_semi").select("doc_id", "sha", "text")
        groups = again.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.drop("digest").unionByName(again.join(groups, "text").drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, path: str, *, checkpoint: str | None = None, **options) -> DataFrame:
    """Feed all new files of ``path`` to the state, then give every row its group."""
    checkpoint = checkpoint or work_path(spark, "llm-exact-state")
    files = options.pop("files_per_trigger", None)
    feed(spark, path, checkpoint, files_per_trigger=files, **options)
    return resolve(spark, path, checkpoint, **options)


SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.text) as text_sha256
from t join g using (text)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")
