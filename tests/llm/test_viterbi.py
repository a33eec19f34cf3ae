import random

import numpy as np
import pytest

from tickloom.llm import viterbi as V
from tickloom.llm.common import ready


def toy(pieces):
    table = {p: (256 + i, s) for i, (p, s) in enumerate(pieces.items())}
    return V.Vocabulary.of(table, list(range(256)), [bytes([b]) for b in range(256)] + [p.replace(V.MARK, " ").encode() for p in pieces])


def whole(v, text):
    """Viterbi over the whole text with the same rule for ties."""
    score, back = [0.0], [None]
    for i in range(1, len(text) + 1):
        best = None
        for n in range(min(i, v.longest), 0, -1):
            known = v.pieces.get(text[i - n:i])
            if known is None:
                if n > 1 or text[i - 1] in v.pieces:
                    continue
                raw = text[i - 1].encode()
                known = (tuple(v.byte_ids[b] for b in raw), v.byte_score * len(raw))
            s = score[i - n] + known[1]
            if best is None or s > best[0]:
                best = (s, i - n, known[0] if isinstance(known[0], tuple) else (known[0],))
        score.append(best[0])
        back.append(best)
    out, i = [], len(text)
    while i:
        out = [*back[i][2], *out]
        i = back[i][1]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_streaming_equals_whole_viterbi(seed):
    r = random.Random(seed)
    pieces = {c: -8.0 - i for i, c in enumerate("ab▁")}
    for _ in range(25):
        pieces["".join(r.choice("abc▁") for _ in range(r.randint(2, 6)))] = -float(r.randint(1, 9))
    v = toy(pieces)
    text = "".join(r.choice("abcd▁é") for _ in range(400))
    s, out, most = V.StreamingViterbi(v), [], 0
    for c in text:
        out += s.feed(c)
        most = max(most, len(s.nodes))
    assert out + s.finish() == whole(v, text)


@pytest.mark.parametrize("seed", range(30))
def test_window_equals_whole_viterbi(seed):
    r = random.Random(100 + seed)
    pieces = {c: -8.0 - i for i, c in enumerate("ab▁")}
    for _ in range(25):
        pieces["".join(r.choice("abc▁") for _ in range(r.randint(2, 6)))] = -float(r.randint(1, 9))
    v = toy(pieces)
    for n in range(40):
        text = "".join(r.choice("abcd▁é") for _ in range(n))
        assert V.window(v, text).tolist() == whole(v, text)


def test_long_stretches_are_streamed_with_the_same_ids(real):
    text = "".join(random.Random(1).choices("abcdefgh", k=3000))
    assert real.encode(text).tolist() == whole(real.v, V.MARK + text)


def test_nodes_stay_within_the_longest_piece_when_paths_converge():
    v = toy({"a": -1.0, "ab": -1.5, "b": -1.0, "abab": -4.5})
    s, n, most = V.StreamingViterbi(v), 0, 0
    for c in "ab" * 50_000:
        n += len(s.feed(c))
        most = max(most, len(s.nodes))
    assert most <= 4 * v.longest and n + len(s.finish()) == 50_000


@pytest.fixture(scope="module")
def real():
    with open(V.VOCABULARY, "rb") as f:
        return V.Encoder(V.Vocabulary.load(f.read()))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "Hello wörld\n\tx", "a▁b ▁ ▁▁", "\0\1 \0▁\0", "日本語 🎉 é", "x" * 5000, " " * 300, "a b\r\n" * 900])
def test_round_trip(real, text):
    assert real.decode(real.encode(text)) == text


def test_words_are_independent(real):
    text = "The quick brown  fox jumps\nover the lazy dog and  representative classification"
    assert real.v.by_words
    assert real.encode(text).tolist() == whole(real.v, V.MARK + text.replace(" ", V.MARK))


def test_table(spark):
    ready(spark)
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (4, "long " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = V.decode(V.encode(df)).collect()
    assert len(out) == 5 and all((r["text"] or "") == r["_llm_decoded"] for r in out)
    assert [r["ids"] for r in sorted(out, key=lambda r: r["doc_id"])] == ["x", "x", "y", None, "z"]
    assert V.encode(df.limit(0)).count() == 0
    assert {tuple(r["_llm_ids"]) for r in out if r["doc_id"] == 1} and np.array_equal(out[1]["_llm_ids"], [])
