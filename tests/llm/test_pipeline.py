"""Each stage on the rows the stage before it kept, against the operators' plain versions."""
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as P  # noqa: E402
from test_lines_and_benchmark import plain_lines, plain_marks  # noqa: E402
from test_repeats import plain_classes  # noqa: E402
from tickloom.llm import viterbi  # noqa: E402
from tickloom.llm.common import stored, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "12 !!", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    before, columns = docs.collect(), docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows if k >= 1)
        pairs = [(r["doc_id"], r["text"]) for r in before]
        if k == 0:
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if r["doc_id"] < 9000)
        elif k == 1:
            assert sorted((r["doc_id"], r["text"]) for r in rows) == [(i, t) for i, _, _, t in plain_lines(pairs)]
        elif k == 2:
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, n, c in plain_classes(pairs, 5, 80) if n})
        elif k == 3:
            items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
            assert sorted(r["doc_id"] for r in rows) == sorted(m[0] for m in plain_marks(pairs, items) if not m[5])
        else:
            with open(viterbi.VOCABULARY, "rb") as f:
                e = viterbi.Encoder(viterbi.Vocabulary.load(f.read()))
            assert sorted((r["doc_id"], r["ids"], r["lossless"]) for r in rows) == sorted((i, e.encode(t).tolist(), True) for i, t in pairs)
        before = rows


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.count() == 0


def plain_kept(rows, words=5, percent=80):
    """Smallest doc_id of each component of the plain sets of word 5-grams, links at a Jaccard index of 0.8."""
    sets = []
    for _, t in rows:
        x = t.lower().split()
        sets.append({tuple(x[i:i + words]) for i in range(max(1, len(x) - words + 1))})
    label, changed = [i for i, _ in rows], True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(set(label))


def test_near_duplicates_by_five_words(spark):
    r = random.Random(3)
    rows = []
    for base in ([f"w{r.randrange(400)}" for _ in range(r.choice([4, 40, 90, 200]))] for _ in range(25)):
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            x = list(base)
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = f"w{r.randrange(400)}"
            rows.append((len(rows), " ".join(x)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    got = sorted(x["doc_id"] for x in P.near_duplicates(spark, docs, SF).collect())
    assert got == plain_kept(rows) != plain_kept(rows, 4, 85)
