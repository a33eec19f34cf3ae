import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup as X


def write(path, rows, name="a"):
    path.mkdir(exist_ok=True)
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "digest": ["x"] * len(rows),
                             "file": [1] * len(rows), "row": [None] * len(rows)}, schema=pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("digest", pa.string()), ("file", pa.int64()), ("row", pa.int64())])), path / f"{name}.parquet")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows)


def got(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def sample(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([None, "", "a", "A", "a ", f"own {i}", "long " * 5000, "é"])) for i in range(n)] + [(3, "a"), (3, "a")]


def test_groups_and_new_files(spark, tmp_path):
    rows, more = sample(200, 1), [(1000 + i, t) for i, t in sample(150, 2)]
    data, state = tmp_path / "docs", f"file://{tmp_path}/state"
    write(data, rows)
    out = X.exact_dedup(spark, str(data), checkpoint=state)
    assert got(out) == expected(rows)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    write(data, more, "b")  # the same state goes on with the new file only
    assert got(X.exact_dedup(spark, str(data), checkpoint=state, files_per_trigger=1)) == expected(rows + more)


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    rows = sample(120, 3)
    write(tmp_path / "docs", rows)
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")
    assert got(X.exact_dedup(spark, str(tmp_path / "docs"), digest=weak)) == expected(rows)


def test_empty_table(spark, tmp_path):
    write(tmp_path / "docs", [])
    assert X.exact_dedup(spark, str(tmp_path / "docs")).count() == 0


def test_session_keeps_its_state_store(spark, tmp_path):
    keys = [f"spark.sql.streaming.stateStore.{k}" for k in ("providerClass", "rocksdb.allowFAllocate")]
    before = [spark.conf.get(k, None) for k in keys]
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    from tickloom.llm import exact_dedup
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/docs").filter("kept").count() == 2
    assert [spark.conf.get(k, None) for k in keys] == before
