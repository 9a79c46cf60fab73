"""Encoding with the best path over pieces with log scores (unigram Viterbi), and decoding.

Pieces stand in a double-array trie over bytes. All places of many equally long stretches walk it
together, one byte at a step, and the best path of each is then found from left to right with one
step for each end and piece length. A character that no piece covers is spelled in byte pieces and
scores ten below the worst piece. A space is the marker U+2581, one more stands before the text;
since no piece goes on from another character into a marker, the stretches from one run of markers to
the next are independent, and each distinct one is solved once in a task.

Of equally good paths the one whose last piece is longer wins, at every place. Decoding joins the
pieces, turns markers into spaces and drops the first.

Defined cases: a null text is an empty one and has no pieces; a marker character in a text is a space;
texts of any length are encoded whole; repeated rows are encoded alike; ids outside the vocabulary
and control pieces decode to nothing; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import binary_parts, each_slice, utf8

MARK = "▁".encode()
NORMAL, BYTE = 1, 6
PENALTY = 10.0
_STRETCH = re.compile(rb" +[^ ]*")


@dataclass
class Vocabulary:
    """Pieces as bytes, their scores and kinds, and the trie: node n has child base[n] + byte + 1."""

    pieces: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray  # id of the piece of each byte, -1 where there is none
    silent: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece_of: np.ndarray
    longest: int
    unknown: float


def load(model_path: str) -> Vocabulary:
    """Read pieces and scores of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    return vocabulary([(p.piece, p.score, p.type) for p in model.pieces])


def vocabulary(pieces: list[tuple[str, float, int]]) -> Vocabulary:
    raw, bytes_at, silent = [], np.full(256, -1), np.zeros(len(pieces), bool)
    normal: dict[bytes, int] = {}
    for k, (text, _, kind) in enumerate(pieces):
        data = text.encode()
        if kind == BYTE:
            data = bytes([int(text[3:5], 16)])
            bytes_at[data[0]] = k
        elif kind == NORMAL:
            if MARK in data.lstrip(MARK):
                raise ValueError("a piece with a marker after another character is not supported")
            normal[data] = k
        else:
            silent[k] = True
        raw.append(data)
    scores = np.array([p[1] for p in pieces], np.float64)
    base, check, piece_of = double_array(normal)
    worst = scores[list(normal.values())].min() if normal else 0.0
    return Vocabulary(raw, scores, bytes_at, silent, base, check, piece_of, max(map(len, normal), default=1), worst - PENALTY)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays; node 0 is the root, and node 1 leads nowhere."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for word in sorted(words):
        at = 0
        for byte in word:
            if byte not in children[at]:
                children[at][byte] = len(children)
                children.append({})
                value.append(-1)
            at = children[at][byte]
        value[at] = words[word]
    size = 4 * len(children) + 16384
    base, check, piece_of = np.full(size, 1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[:2] = True
    place, piece_of[0] = {0: 0}, value[0]
    # Nodes with several children are placed one after another, most children first; the rest fill gaps.
    free, far, waiting = 2, 1, [0]
    while waiting:
        following: list[int] = []
        for node in sorted(waiting, key=lambda n: (-len(children[n]), n)):
            if not children[node]:
                continue
            labels = np.array(sorted(children[node]), np.int64) + 1
            while used[free]:
                free += 1
            start, window = max(1, free - int(labels[0]), far if len(labels) > 1 else 1), 64
            while len(labels) > 1 or used[start + labels[0]]:
                fits = np.flatnonzero(~used[np.arange(start, start + window)[:, None] + labels].any(axis=1))
                if len(fits):
                    start += int(fits[0])
                    break
                start += window
                window = min(4096, 2 * window)
            if len(labels) > 1:
                far = start
            slots = start + labels
            used[slots] = True
            base[place[node]], check[slots] = start, place[node]
            for slot, label in zip(slots.tolist(), labels.tolist()):
                child = children[node][label - 1]
                place[child], piece_of[slot] = slot, value[child]
                following.append(child)
        waiting = following
    # The last node's children may be looked up beyond what is used: 257 free places follow.
    end = int(np.flatnonzero(used)[-1]) + 258
    return base[:end], check[:end], piece_of[:end]


def best_paths(matrix: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids by start (-1 elsewhere) and scores of the best path of every row of equally long stretches."""
    rows, length = matrix.shape
    wide = matrix.astype(np.int32)
    deep = min(length, vocab.longest)
    node = np.zeros((rows, length), np.int32)
    alive = np.ones((rows, length), bool)
    ids = np.full((deep, rows, length), -1, np.int32)
    for d in range(deep):
        room = length - d
        node, alive = node[:, :room], alive[:, :room]
        step = vocab.base[node] + wide[:, d:] + 1
        alive = alive & (vocab.check[step] == node)
        if not alive.any():
            break
        node = np.where(alive, step, 1)
        ids[d, :, :room] = np.where(alive, vocab.piece_of[node], -1)
    width = np.select([matrix < 0x80, matrix < 0xC0, matrix < 0xE0, matrix < 0xF0], [1, 0, 2, 3], 4)
    best = np.full((length + 1, rows), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, rows), np.int64)
    lone = np.zeros((length + 1, rows), bool)  # reached by a character without a piece
    for end in range(1, length + 1):
        for d in range(min(end, max(deep, 4)), 0, -1):
            start = end - d
            piece = ids[d - 1, :, start] if d <= deep else np.full(rows, -1)
            single = (width[:, start] == d) & (piece < 0)
            if not single.any() and (piece < 0).all():
                continue
            total = best[start] + np.where(single, vocab.unknown, vocab.scores[piece])
            better = ((piece >= 0) | single) & (total > best[end])
            best[end][better], back[end][better], lone[end][better] = total[better], d, single[better]
    out = np.full((rows, length), -1, np.int64)
    at = np.full(rows, length)
    number = np.arange(rows)
    while (at > 0).any():
        d, alone = back[at, number], lone[at, number]
        start = at - d
        pieces = (at > 0) & ~alone
        out[number[pieces], start[pieces]] = ids[d[pieces] - 1, number[pieces], start[pieces]]
        for k in range(4):
            spelled = (at > 0) & alone & (k < d)
            cell = matrix[number[spelled], start[spelled] + k]
            out[number[spelled], start[spelled] + k] = vocab.bytes_at[cell]
        at = start
    return out, best[length]


class Encoder:
    """Ids and scores of texts; each distinct stretch is solved once."""

    def __init__(self, vocab: Vocabulary, most: int = 600_000):
        self.vocab, self.most = vocab, most
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.sizes, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)

    def _learn(self, stretches: list[bytes]) -> None:
        texts = [s.replace(b" ", MARK) for s in stretches]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        ids, counts, scores, names = [], [], [], []
        low = 0
        while low < len(order):
            length = int(sizes[order[low]])
            high = min(int(np.searchsorted(sizes[order], length, side="right")), low + max(1, 400_000 // length // max(1, min(length, 16))))
            some = order[low:high]
            matrix = np.frombuffer(b"".join(texts[k] for k in some), np.uint8).reshape(len(some), length)
            found, score = best_paths(matrix, self.vocab)
            used = found >= 0
            ids.append(found[used].astype(np.int32))
            counts.append(used.sum(axis=1))
            scores.append(score)
            names += [stretches[k] for k in some]
            low = high
        first = len(self.sizes)
        self.known.update(zip(names, range(first, first + len(names))))
        self.ids = np.concatenate([self.ids, *ids])
        self.sizes = np.concatenate([self.sizes, *counts])
        self.scores = np.concatenate([self.scores, *scores])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        if len(self.known) > self.most:
            self.reset()
        split = [_STRETCH.findall(b" " + t.replace(MARK, b" ")) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        new = list(set(flat) - self.known.keys())
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[number] - ends + sizes, sizes) if len(flat) else np.zeros(0, np.int64)
        ids = self.ids[at]
        words = np.cumsum([0] + [len(s) for s in split])
        cuts = np.concatenate([[0], ends])[words]
        totals = np.array([self.scores[number[a:b]].sum() for a, b in zip(words[:-1], words[1:])])
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])], totals


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """Text of a list of ids as bytes."""
    good = ids[(ids >= 0) & (ids < len(vocab.pieces))]
    good = good[~vocab.silent[good]]
    return b"".join(map(vocab.pieces.__getitem__, good.tolist())).replace(MARK, b" ")[1:]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and score of every input row."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in each_slice(batches, "body", 1_000_000):
            ends, raw = binary_parts(batch.column("body"))
            ids, scores = encoder([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
            cuts = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(scores)], names=["doc_id", "ids", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The input's columns ``doc_id``, ``ids`` and ``score`` and the decoded ``text``; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(np.array(x, np.int64), shared.value).decode("utf-8", "replace") for x in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    slim = encoded.select("doc_id", "ids", "score")
    return slim.mapInArrow(run, "doc_id long, ids array<int>, score double, text string")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for k, gone in enumerate(column.is_null().to_pylist()):
        yield None if gone else flat[ends[k] : ends[k + 1]]


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_crc32, score, decoded_crc32 and same of every row.

    ``n_bytes`` counts byte pieces; ``same`` says whether decoding gives the text back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    names = ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "score", "decoded_crc32", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        encoder, is_byte = Encoder(vocab), np.zeros(len(vocab.pieces), bool)
        is_byte[vocab.bytes_at[vocab.bytes_at >= 0]] = True
        for batch in each_slice(batches, "body", 1_000_000):
            ends, raw = binary_parts(batch.column("body"))
            texts = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            ids, scores = encoder(texts)
            back = [decode_ids(x, vocab) for x in ids]
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array(scores),
                pa.array([zlib.crc32(b) for b in back], pa.int64()),
                pa.array([a == b for a, b in zip(texts, back)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    out = slim.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, score double, decoded_crc32 long, same boolean")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
