"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Two strings are alike when they share many subsequences of three letters; each counts less the more
letters lie between its first and last. A word with letters inserted or left out stays close to
the original, and single letters set apart are read together. What punctuation joins is read as one word
and as its parts. Landmarks are words of the labelled
texts that mark the class; a sentence is described by its largest kernel value with each of them,
mapped by the Nyström root so that inner products approximate the kernel. A linear machine with
squared hinge loss is fitted to labelled sentences: of a toxic text those that respond most, chosen
again by the machine itself, and of a clean text likewise. The score of a text is a logistic function,
fitted on the labelled texts, of its worst sentence's margin, the number of its words that the machine
holds toxic by themselves, and its length.

The fit uses at most ``most_rows`` labelled rows of each class, those with the smallest hashed
identifiers. Scoring reads whole texts.

Defined cases: a null text counts as empty; a text without letters has the score of no evidence;
without labels of both classes every score is the share of toxic labels (0 if there are none);
labels that contradict each other count as toxic; repeated rows get equal scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import Scratch, binary_parts, crc_of_id, each_slice, utf8

DECAY = 0.6
MARK = "^"  # where a word begins
_EDGES = b".,!?;:*#$%&()'\""
SYMBOLS = 64
PIECE, STEP = 24, 12  # letters of a longer word are read in overlapping pieces
SENTENCES = 3  # of one labelled text that the fit may look at


def _symbols(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all units as small numbers, and the units' lengths."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    plain = (points >= 97) & (points <= 122)
    return np.where(plain, points - 97, 26 + (points * 7919 >> 3) % (SYMBOLS - 26)), np.fromiter(map(len, units), np.int64, len(units))


def letters_of(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


def readings(token: str) -> str:
    """All letters of a token as one word, then the words that punctuation divides it into, if any."""
    parts = "".join(c if c.isalpha() else " " for c in token.lower()).split()
    return " ".join(["".join(parts), *(p for p in parts if len(p) >= 3 and len(parts) > 1)])


def pieces_of(unit: str) -> list[str]:
    """A word with a mark before it, in overlapping pieces if it is long."""
    unit = MARK + unit
    if len(unit) <= PIECE:
        return [unit]
    return [unit[i : i + PIECE] for i in range(0, len(unit) - STEP, STEP)]


class Landmarks:
    """Kernel values of units with a fixed set of words."""

    def __init__(self, words: list[str]):
        self.words = words
        units = [MARK + w for w in words]
        self.row_of = np.full(SYMBOLS**3, -1, np.int32)
        found = [self._triples([u]) for u in units]
        codes = np.unique(np.concatenate([c[0] for c, _ in found])) if words else np.zeros(0, np.int64)
        self.row_of[codes] = np.arange(len(codes))
        self.table = np.zeros((len(codes), len(words)), np.float32)
        for j, (code, weight) in enumerate(found):
            np.add.at(self.table[:, j], self.row_of[code[0]], weight)
        self.norms = np.sqrt((self.table**2).sum(axis=0)) if words else np.zeros(0, np.float32)
        # The few landmarks of each subsequence, one after another.
        code, self.mark = np.nonzero(self.table)
        self.weight = self.table[code, self.mark]
        self.first = np.searchsorted(code, np.arange(len(codes) + 1))
        symbols, sizes = _symbols(units)
        self.sizes = sizes
        self.masks = self._masks(symbols, sizes)
        kinds = np.bitwise_count(self.masks).astype(np.int64)
        self.missing = np.where(kinds > 5, 1, 0)  # distinct letters of a landmark that may be absent

    @staticmethod
    def _masks(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros(0, np.uint64)
        bits = np.uint64(1) << symbols.astype(np.uint64)
        return np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes)

    @staticmethod
    def _triples(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (units x subsequences) and decay weights of units of one length."""
        symbols, sizes = _symbols(units)
        picks = np.array(list(itertools.combinations(range(int(sizes[0])), 3)), np.int64).reshape(-1, 3)
        letters = symbols.reshape(len(units), -1)[:, picks]
        return (letters * np.array([SYMBOLS**2, SYMBOLS, 1])).sum(axis=2), (DECAY ** (picks[:, 2] - picks[:, 0] - 2)).astype(np.float32)

    def kernel(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units near some landmark, and their normalised kernel rows.

        A value is zero where more letters of the landmark are absent than may be.
        """
        if not units or not self.words:
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        symbols, sizes = _symbols(units)
        masks = self._masks(symbols, sizes)
        numbers, rows = [], []
        for size in np.unique(sizes[sizes >= 3]).tolist():
            of_size = np.flatnonzero(sizes == size)
            fits = np.abs(self.sizes - size) <= np.maximum(3, 1.5 * self.sizes)
            for i in range(0, len(of_size), 20_000):
                some = of_size[i : i + 20_000]
                near = (np.bitwise_count(self.masks[None, :] & ~masks[some][:, None]) <= self.missing) & fits
                some, near = some[near.any(axis=1)], near[near.any(axis=1)]
                for j in range(0, len(some), 1024):
                    own = some[j : j + 1024]
                    codes, weight = self._triples([units[k] for k in own])
                    order = np.argsort(codes, axis=1)
                    sums = np.take_along_axis(codes, order, axis=1)
                    spread = np.broadcast_to(weight, codes.shape)
                    ordered = np.take_along_axis(spread, order, axis=1)
                    new = np.ones(codes.shape, bool)
                    new[:, 1:] = sums[:, 1:] != sums[:, :-1]
                    value = np.add.reduceat(ordered.ravel(), np.flatnonzero(new.ravel()))
                    at = np.repeat(np.arange(len(own)), new.sum(axis=1))
                    norm = np.sqrt(np.bincount(at, value**2, len(own)))
                    row = self.row_of[sums[new]]
                    known = row >= 0  # subsequences of some landmark
                    at, row, value = at[known], row[known], value[known]
                    size_of = self.first[row + 1] - self.first[row]
                    stop = np.cumsum(size_of)
                    each = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.first[row] - stop + size_of, size_of)
                    cell = np.repeat(at, size_of) * len(self.words) + self.mark[each]
                    out = np.bincount(cell, np.repeat(value, size_of) * self.weight[each], len(own) * len(self.words))
                    out = out.reshape(len(own), -1) / (norm[:, None] * self.norms[None, :])
                    numbers.append(own)
                    rows.append(np.where(near[j : j + 1024], out, 0).astype(np.float32))
        if not numbers:
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        return np.concatenate(numbers), np.concatenate(rows)


class Reader:
    """Kernel rows of the words of texts; each distinct word is looked at once."""

    def __init__(self, landmarks: Landmarks, most: int = 250_000):
        self.landmarks, self.most = landmarks, most
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.units: dict[str, int] = {}  # number of each word's kernel row, 0 for none
        self.rows = [np.zeros((1, len(self.landmarks.words)), np.float32)]
        self.count = 1

    def _learn_units(self, units: list[str]) -> None:
        """Kernel rows of new words: the largest values over the readings and pieces of each."""
        pieces = [list(itertools.chain.from_iterable(map(pieces_of, u.split(" ")))) for u in units]
        owner = np.repeat(np.arange(len(units)), [len(p) for p in pieces])
        numbers, rows = self.landmarks.kernel(list(itertools.chain.from_iterable(pieces)))
        place = np.zeros(len(units), np.int64)
        if len(numbers):
            owners = owner[numbers]
            order = np.argsort(owners, kind="stable")
            owners, rows = owners[order], rows[order]
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            place[owners[first]] = self.count + np.arange(len(first))
            self.rows.append(np.maximum.reduceat(rows, first, axis=0))
            self.count += len(first)
        self.units.update(zip(units, place.tolist()))

    def _learn(self, tokens: list[bytes]) -> None:
        units = []
        for token in tokens:
            core = token.strip(_EDGES)
            if core.isalpha():
                units.append(core.lower().decode("ascii"))
            else:
                text = core.decode("utf-8").lower()
                units.append(text if text.isalpha() else readings(text))
        self._learn_units(list(set(units) - self.units.keys()))
        # Number of the kernel row (0: none), whether it is a single letter, whether it ends a sentence.
        ends = [(len(u) == 1) | (2 * (t[-1] in b".!?")) for u, t in zip(units, tokens)]
        self.known.update(zip(tokens, (4 * self.units[u] + e for u, e in zip(units, ends))))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, sentence numbers and kernel rows of the words that respond; words of each text."""
        if len(self.known) > self.most:
            self.reset()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(itertools.chain.from_iterable(split))
        new = list(set(flat) - self.known.keys())
        if new:
            self._learn(new)
        found = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        rows, single, ends = found >> 2, (found & 1).astype(bool), (found & 2).astype(bool)
        text = np.repeat(np.arange(len(texts)), counts)
        breaks = np.zeros(len(flat), bool)
        breaks[1:] = ends[:-1] | (text[1:] != text[:-1])
        sentence = np.cumsum(breaks)
        at = np.flatnonzero(rows)
        self.rows = [np.concatenate(self.rows)]
        values = self.rows[0][rows[at]]
        # Letters standing alone in a row are one word.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        joined, places = [], []
        for low, high in zip(edge[0::2], edge[1::2]):
            if high - low >= 3:
                for piece in pieces_of(letters_of(b"".join(flat[low:high]).decode("utf-8"))):
                    joined.append(piece)
                    places.append(low)
        numbers, extra = self.landmarks.kernel(joined)
        if len(numbers):
            at = np.append(at, np.array(places)[numbers])
            values = np.concatenate([values, extra])
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        return text[at], sentence[at], values, counts


def sentences(text: np.ndarray, sentence: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and largest kernel values of each sentence that responds."""
    if not len(sentence):
        return text, values
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    return text[first], np.maximum.reduceat(values, first, axis=0)


@dataclass
class Model:
    """Landmarks, weights on kernel values (Nyström root included), and the logistic function."""

    words: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def evidence(self, reader: Reader, texts: list[bytes]) -> np.ndarray:
        """Of each text: margin of the worst sentence, toxic words and length (logarithms), density."""
        text, sentence, values, counts = reader.words(texts)
        worst = np.full(len(texts), self.bias)
        hits = np.bincount(text[values @ self.weights + self.bias > 0], minlength=len(texts))
        of, pooled = sentences(text, sentence, values)
        np.maximum.at(worst, of, pooled @ self.weights + self.bias)
        return np.column_stack([worst, np.log1p(hits), np.log1p(counts), np.sqrt(hits / np.maximum(counts, 1))])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slopes + self.offset, -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by Newton steps on its support vectors."""
    sign = np.where(y, 1.0, -1.0)
    cost = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    z = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        support = sign * (z @ w) < 1
        zs = z[support] * cost[support][:, None]
        following = np.linalg.solve(zs.T @ z[support] + np.diag(penalty), zs.T @ sign[support])
        if np.allclose(following, w, atol=1e-9):
            break
        w = following
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Slopes and offset of the probability; targets drawn in a little, as is usual."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    scale = x.std(axis=0) + 1e-9
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(penalty), z.T @ (p - target) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``key``, ``toxic`` and ``body`` of at most ``most_rows`` labelled rows of each class."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.pmod(crc_of_id(id_col), F.lit(5)) != 0))
    chosen = chosen.groupBy(F.col(id_col).alias("key")).agg((F.max(label_col) > 0).alias("toxic"))
    order = [F.xxhash64("key"), F.col("key")]
    some = chosen.filter("toxic").orderBy(*order).limit(most_rows)
    some = some.unionByName(chosen.filter("not toxic").orderBy(*order).limit(most_rows))
    # At most 2 * most_rows rows of nine bytes.
    return docs.select(F.col(id_col).alias("key"), utf8(text_col).alias("body")).join(F.broadcast(some), "key")


def choose_landmarks(sample: DataFrame, up: int, down: int, most: int) -> list[str]:
    """Words that occur in many more toxic than clean texts, no two of them alike."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            rows = []
            for a, b, toxic in zip(ends[:-1], ends[1:], batch.column("toxic").to_pylist()):
                units = {letters_of(t.decode("utf-8")) for t in set(raw[a:b].tobytes().split())}
                rows += [(u, int(toxic), int(not toxic)) for u in units if 4 <= len(u) < PIECE]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "up", "down"])

    counts = sample.mapInArrow(words, "word string, up long, down long").groupBy("word").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    p, q = F.col("up") / up, F.col("down") / down
    both = (F.col("up") + F.col("down")) / (up + down)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / up + 1 / down) + 1e-12)
    ranked = counts.filter("up >= 3").withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "word").limit(8 * most)
    chosen: list[str] = []
    for row in ranked.collect():
        if chosen:
            numbers, rows = Landmarks(chosen).kernel([MARK + row["word"]])
            if len(numbers) and rows.max() > 0.75:
                continue
        chosen.append(row["word"])
        if len(chosen) == most:
            break
    return chosen


def _best_sentences(sample: DataFrame, landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels and kernel values of the sentences of each labelled text that respond most."""
    width = len(landmarks.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(landmarks)
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            found = reader.words([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
            text, values = sentences(*found[:3])
            order = np.lexsort((-values.sum(axis=1), text))
            text, values = text[order], values[order]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            text, values = text[rank < SENTENCES], values[rank < SENTENCES]
            silent = np.setdiff1d(np.arange(len(batch)), text)
            text = np.append(text, silent).astype(np.int64)
            values = np.concatenate([values, np.zeros((len(silent), width), np.float32)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(text)), batch.column("toxic").take(pa.array(text)), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["key", "toxic", "values"],
            )

    found = sample.mapInArrow(run, "key long, toxic boolean, values binary").toPandas()
    values = np.frombuffer(b"".join(found["values"]), np.float32).reshape(-1, width)
    return found["key"].to_numpy(), found["toxic"].to_numpy().astype(bool), values


def gapped(word: str) -> list[str]:
    """The word with a letter put in, at two places."""
    return [word[:k] + "x" + word[k:] for k in (2, len(word) - 1)]


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6_000, landmarks: int = 96, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on rows whose crc32 of the identifier modulo 5 is not 0."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, most_rows, id_col, text_col, label_col))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    up, down = sizes.get(True, 0), sizes.get(False, 0)
    words = choose_landmarks(sample, up, down, landmarks) if up and down else []
    if not words:
        share = min(max(up / max(1, up + down), 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), 0.0, np.zeros(4), float(np.log(share / (1 - share))))
    marks = Landmarks(words)
    keys, toxic, values = _best_sentences(sample, marks)
    numbers, own = marks.kernel([MARK + w for w in words])
    gram = np.zeros((len(words), len(words)))
    gram[numbers] = own
    gram = (gram + gram.T) / 2
    eigen, vectors = np.linalg.eigh(gram)
    keep = eigen > 1e-3
    root = vectors[:, keep] / np.sqrt(eigen[keep])
    x = values @ root
    _, text = np.unique(keys, return_inverse=True)
    # First the whole toxic text's sentences, then only the worst one by the machine so far.
    chosen = np.ones(len(x), bool)
    for _ in range(3):
        used = chosen | ~toxic
        w, bias = fit_machine(x[used], toxic[used])
        margin = x @ w + bias
        worst = np.full(text.max() + 1, -np.inf)
        np.maximum.at(worst, text, margin)
        chosen = margin >= worst[text]
    # Words the machine holds toxic stay so with a letter inserted.
    bad = [word for word, m in zip(words, gram @ root @ w + bias) if m > 0]
    variants = [v for word in bad for v in gapped(word)]
    numbers, rows = marks.kernel([MARK + v for v in variants])
    used = chosen | ~toxic
    x_all = np.concatenate([x[used], rows @ root])
    y_all = np.append(toxic[used], np.ones(len(rows), bool))
    w, bias = fit_machine(x_all, y_all)
    model = Model(words, root @ w, bias, np.zeros(4), 0.0)
    evidence, label = _evidence(sample, model)
    model.slopes, model.offset = fit_logistic(evidence, label)
    scratch.drop(sample)
    return model


def _evidence(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and label of every labelled text of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Landmarks(model.words))
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            found = model.evidence(reader, [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), batch.column("toxic")], names=["a", "b", "c", "d", "toxic"])

    found = sample.mapInArrow(run, "a double, b double, c double, d double, toxic boolean").toPandas()
    return found[["a", "b", "c", "d"]].to_numpy(), found["toxic"].to_numpy().astype(bool)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all input columns), ``id`` and ``score`` of every input row."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Landmarks(model.words))
        for batch in batches:
            # The text is read out of the row, so that it travels once.
            body = batch.column("row").field(at).cast(pa.string()).cast(pa.binary()).fill_null(b"")
            whole = pa.RecordBatch.from_arrays([*batch.columns, body], names=[*batch.schema.names, "body"])
            for part in each_slice([whole], "body", 1_000_000):
                ends, raw = binary_parts(part.column("body"))
                texts = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                evidence = model.evidence(reader, texts) if model.words else np.zeros((len(texts), 4))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.probability(evidence))], names=[*batch.schema.names, "score"])

    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields, T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = scores(docs.select(id_col, text_col), fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.select(
        F.col("id").alias(id_col),
        (F.pmod(crc_of_id("id"), F.lit(5)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    found = scores(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.filter(F.col("score") < threshold).select("row.*")
