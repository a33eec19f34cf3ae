"""Operator 7: SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text maximizes the sum of its pieces' scores in the vocabulary file. The search reads the
text character by character and keeps nodes only for boundaries within the longest piece's length and for boundaries on
a surviving backpointer path. Whenever all surviving paths converge on one boundary, the ids before it are committed
and their nodes go; so memory depends on the longest piece, not on the text. Stretches between sure boundaries (below) that are no longer than a
few pieces are searched in one window of that size; in ordinary text these are nearly all, longer ones are streamed.

No piece of such a vocabulary has a word mark behind another character (checked when it is loaded), so every path goes through the
boundary before a word. What lies between two such boundaries has one result wherever it stands, and each worker
remembers the results of short stretches in a bounded memory. A vocabulary with pieces across words takes texts whole.

Encoding: a word mark before the text, spaces become word marks; a character in no piece (and a literal word mark) becomes its
UTF-8 bytes as byte pieces. Decoding reverses it exactly. Of equal sums the path with the longest last piece wins, at
every boundary. With a vocabulary of ranked merges the scores are ranks and the result is the segmentation of best total
rank, not the one that merging in order gives.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length; repeated rows get
equal results; an empty table gives no rows; all other columns pass.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.llm.common import map_batches, table, with_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Largest vocabulary file that is sent to the executors.
MAX_BYTES = 64 << 20
MEMO, MEMO_CHARS = 150_000, 48
#: Stretches of up to so many times the longest piece are one window: nothing before their end would be committed much earlier.
WINDOWS = 4
INFINITY = float("inf")


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]  # piece: id, score
    byte_ids: list[int]
    texts: list[bytes]  # by id, as decoded
    byte_score: float
    longest: int
    by_words: bool
    suffixes: dict  # pieces by their characters from the last to the first; "" holds (ids, score)
    prefixes: dict  # pieces by their characters: character -> [characters that follow, id or None, score]
    stretch: re.Pattern  # what lies between two boundaries that no piece crosses

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        pieces, byte_ids, texts = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                pieces[piece] = (i, sp.get_score(i))
                texts.append(piece.replace(MARK, " ").encode())
        return cls.of(pieces, byte_ids, texts)

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes]) -> Vocabulary:
        lowest = min((s for _, s in pieces.values() if s > -1e8), default=0.0)
        suffixes: dict = {}
        for piece, (i, score) in pieces.items():
            node = suffixes
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = ((i,), score)
        prefixes: dict = {}
        for piece, (i, score) in pieces.items():
            following = prefixes
            for c in piece:
                entry = following.setdefault(c, [{}, None, 0.0])
                following = entry[0]
            entry[1:] = i, score
        by_words = not any(MARK in p.lstrip(MARK) for p in pieces)
        joined = set("".join(p for p in pieces if len(p) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(2, 128) if chr(c) not in joined)  # characters that no longer piece holds
        pattern = f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
        return cls(pieces, byte_ids, texts, lowest - 10.0, max(map(len, pieces), default=1), by_words, suffixes, prefixes, re.compile(pattern if by_words else "(?s:.+)"))


class StreamingViterbi:
    """Feed characters, take committed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.at = 0
        self.tail: list[str | None] = []  # the last characters, at least as many as the longest piece has
        # boundary: [score, boundary before, ids of the last piece, number of nodes behind it, exclusive or of these]
        self.nodes: dict[int, list] = {0: [0.0, -1, (), 0, 0]}
        self.root = 0

    def feed(self, text: str, literal: bool = False) -> list[int]:
        """Ids that are certain after these characters. ``literal`` characters stand for themselves, in no piece."""
        v, nodes, tail, at, longest = self.v, self.nodes, self.tail, self.at, self.v.longest
        out: list[int] = []
        for char in text:
            tail.append(None if literal else char)
            at += 1
            best, score, ids = -1, -INFINITY, ()
            node, n = v.suffixes, 0
            if literal or char not in v.pieces:
                raw = char.encode("utf-8", "surrogatepass")
                best, score, ids = at - 1, nodes[at - 1][0] + v.byte_score * len(raw), tuple(v.byte_ids[b] for b in raw)
            for k in range(len(tail) - 1, -1, -1):  # pieces that end here, the shortest first
                node = node.get(tail[k])
                if node is None:
                    break
                n += 1
                known = node.get("")
                if known is not None:
                    before = nodes.get(at - n)
                    if before is not None and before[0] + known[1] >= score:
                        best, score, ids = at - n, before[0] + known[1], known[0]
            nodes[at] = [score, best, ids, 0, 0]
            before = nodes[best]
            before[3] += 1
            before[4] ^= at
            if at - longest >= self.root:
                self.at = at
                self._commit(at - longest, out)
            if len(tail) > 8 * longest:
                del tail[:-longest]
        self.at = at
        return out

    def _commit(self, gone: int, out: list[int]) -> None:
        """Boundaries up to ``gone`` can get no more successors: drop dead ends, then commit where one path is left."""
        nodes, node = self.nodes, gone
        while node > self.root and node in nodes and nodes[node][3] == 0:
            before = nodes.pop(node)[1]
            nodes[before][3] -= 1
            nodes[before][4] ^= node
            node = before
        while self.root <= gone and nodes[self.root][3] == 1:
            follower = nodes[self.root][4]
            del nodes[self.root]
            out.extend(nodes[follower][2])
            self.root = follower

    def finish(self) -> list[int]:
        out, node = [], self.at
        while node != self.root:
            out.append(self.nodes[node][2])
            node = self.nodes[node][1]
        self.nodes, self.root = {self.at: [0.0, -1, (), 0, 0]}, self.at
        return [i for ids in reversed(out) for i in ids]


def window(v: Vocabulary, part: str) -> array:
    """Ids of a short stretch: the same search over one window, from each boundary along the pieces that begin there.

    Boundaries are taken in order, so of equal sums the one set first, by the longest last piece, stays.
    """
    n = len(part)
    score, back, ids = [0.0] + [-INFINITY] * n, [0] * (n + 1), [None] * (n + 1)
    prefixes, pieces = v.prefixes, v.pieces
    for i in range(n):
        here, following, j = score[i], prefixes, i
        while j < n:
            entry = following.get(part[j])
            if entry is None:
                break
            following, known, gain = entry
            j += 1
            if known is not None and here + gain > score[j]:
                score[j], back[j], ids[j] = here + gain, i, known
        if part[i] not in pieces:
            raw = part[i].encode("utf-8", "surrogatepass")
            if here + v.byte_score * len(raw) > score[i + 1]:
                score[i + 1], back[i + 1], ids[i + 1] = here + v.byte_score * len(raw), i, raw
    path, i = array("i"), n
    while i:
        known = ids[i]
        if type(known) is bytes:
            path.extend([v.byte_ids[b] for b in reversed(known)])
        else:
            path.append(known)
        i = back[i]
    path.reverse()
    return path


def stretches(text: str, pattern: re.Pattern) -> Iterator[tuple[str, bool]]:
    """(characters with spaces as word marks, whether literal word marks are escaped in them) between sure boundaries."""
    literal = MARK in text
    if literal:
        text = text.replace("\0", "\0\0").replace(MARK, "\0\1")  # NUL escapes: NUL NUL is a NUL, NUL SOH a literal mark
    for part in pattern.findall(MARK + text.replace(" ", MARK)):
        yield part, literal and "\0" in part


class Encoder:
    """Encodes texts; remembers the ids of short stretches in two generations, so that frequent ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo, self.older = vocabulary, {}, {}

    def _encode(self, part: str, escaped: bool) -> bytes:
        if not escaped and len(part) <= WINDOWS * self.v.longest:
            return window(self.v, part).tobytes()
        stream, out = StreamingViterbi(self.v), []
        if not escaped:
            out += stream.feed(part)
        else:
            chars = iter(part)
            for c in chars:
                if c == "\0":
                    out += stream.feed(MARK, True) if next(chars) == "\1" else stream.feed("\0")
                else:
                    out += stream.feed(c)
        return np.array(out + stream.finish(), np.int32).tobytes()

    def _remembered(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self._encode(part, False)
        if len(part) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[part] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out = []
        for part, escaped in stretches(text, self.v.stretch):
            out.append(self._encode(part, True) if escaped else self.memo.get(part) or self._remembered(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        return b"".join(map(self.v.texts.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


_encoders: dict[bytes, Encoder] = {}  # one per Python worker


def encoder(model: bytes) -> Encoder:
    key = model[:64] + len(model).to_bytes(8, "big")
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary.load(model))
    return _encoders[key]


def _model(spark: SparkSession, vocabulary: str):
    """The vocabulary file's bytes for the executors. Its size is checked."""
    with open(vocabulary, "rb") as file:
        model = file.read(MAX_BYTES + 1)
    if len(model) > MAX_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(model)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "_llm_ids") -> DataFrame:
    """All columns of ``docs`` and the ids of the text; a column of that name is replaced."""
    docs = docs.drop(*{ids_col} - {text_col})
    model = _model(docs.sparkSession, vocabulary)

    def run(batch):
        e = encoder(model.value)
        return with_columns(batch, **{ids_col: _lists([e.encode(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])})
    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "_llm_ids", text_col: str = "_llm_decoded") -> DataFrame:
    """All columns of ``docs`` and the text of the ids."""
    model = _model(docs.sparkSession, vocabulary)

    def run(batch):
        e, ids = encoder(model.value), batch.column(batch.schema.get_field_index(ids_col))
        texts = [e.decode(np.asarray(x.values) if x.is_valid else ()) for x in ids]
        return with_columns(batch, **{text_col: pa.array(texts, pa.string())})
    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "_llm_ids", decoded_col: str = "_llm_decoded") -> DataFrame:
    """All columns of ``docs``, the ids of the text and the text decoded from them, in one pass; columns of these two names are replaced."""
    docs = docs.drop(*{ids_col, decoded_col} - {text_col})
    model = _model(docs.sparkSession, vocabulary)

    def run(batch):
        e = encoder(model.value)
        ids = [e.encode(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return with_columns(batch, **{ids_col: _lists(ids), decoded_col: pa.array([e.decode(x) for x in ids], pa.string())})
    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, the hash of the decoded text, and whether it is the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = round_trip(docs, ids_col="ids", decoded_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.col("decoded") == F.col("text")).alias("lossless"))
