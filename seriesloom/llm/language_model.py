"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every training word is a symbol of its own, named by its 64-bit hash; words that the training texts do
not hold are one further outcome together. Each word, and the start of a text, opens a context
restaurant for the words that follow it; all context restaurants share one parent, the restaurant of
words without context, whose parent is uniform.

Seating is sampled by Gibbs sweeps: the customers of a dish leave together and are seated again one
after another given everything else, joining a table in proportion to its customers less a discount
or opening one in proportion to what the parent expects; beyond ``PARTY`` guests of a dish the next
ones come in parties of 1 / ``PARTY`` of those present, which share a probability. Tables are the
customers of the parent. A dish with one customer has one table whatever is drawn, so the sweeps move
pairs seen twice or more and the others count as they are. Seating needs of a context only its number
of tables, so its dishes are dealt over tasks like any other rows. After the first sweeps the
predictive probabilities are averaged over the following ones.

Texts come in blocks of some megabytes. A block names its distinct pairs once, to the part that a pair's
hash gives; there equal pairs of all blocks meet, are counted and stay. Words have parts of their own, where
tables and guests are summed. The rows of a part that a job hands on to another part travel as one row of
packed columns (``MESSAGE``): a sweep exchanges two numbers for each word of each part of pairs, and the
pairs themselves are not moved between parts. When all is seated, a block is told the values of its
pairs that were seen twice or more; a pair it has learned from and hears nothing of was seen once. Words, counts,
pairs, tables and probabilities stay in tables; the driver holds totals.

Defined cases: a null text is the empty one and consists of the end token; without training texts all
words are unknown and the model is uniform over its two symbols; repeated rows are separate texts;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, binary_parts, crc_of_id, each_slice, mix, release, slices, utf8

START, END, RARE, FIRST = 0, 1, 2, 3  # symbols of a numbered view; START is only a context, RARE all unknown words
PARTY = 32
BLOCK_BYTES = 6 << 20
BLOCKS_A_PART = 2, 8  # blocks for one part of pairs and for one of words
ROUNDS = 2  # in which pairs are counted: only a share of them is on its way at a time
SEND_BYTES = 4 << 20
END_HASH = 0x5851F42D4C957F2D
START_HASH = 0x14057B7EF767814F
PAIR_TAG = np.uint64(0xA0761D6478BD642F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
INSIDE = np.ones(256, bool)  # bytes that are no white space
INSIDE[[9, 10, 11, 12, 13, 32]] = False

# Packed columns on their way from part to part; ``source`` is the part or block that sent them.
MESSAGE = "part int, kind int, source int, rows int, body binary"
PAIRS, WANTED, VOCABULARY, SEATS, PLACES, WORDS, SAMPLE, SUMS, ROUTE, ASKED, GIVEN, MOVED, TOTALS, PAIR_WORDS, SEAT_VALUES, PAIR_VALUES, WORD_VALUES, PAIR_ROWS, WORD_ROWS = range(19)
COLUMNS = {
    PAIR_WORDS: (np.int64,),  # the words of a block's pairs, ascending
    PAIRS: (np.int32, np.int32, np.int32),  # before and after in these words, ascending; times in texts learned from
    WANTED: (np.int64,),  # words of a block
    VOCABULARY: (np.int64,),  # words of a part's pairs
    SEATS: (np.int32, np.int32, np.int64, np.int64, np.int64),  # before and after in the vocabulary, c, t, sum_t
    PLACES: (np.int32, np.int32),  # row of a block's PAIRS to tell it about, row of SEATS or -1 if seen once
    WORDS: (np.int64,) * 7,  # key, count, once_after, once_before, guests, tables, root
    SAMPLE: (np.int64,) * 3,  # guests, tables, root after a sweep that counts
    SUMS: (np.int64,) * 6,  # key, count, once_after, once_before, after and before of pairs seen more often
    ROUTE: (np.int32,),  # rows of WORDS that a part of pairs sees
    ASKED: (np.int32,),  # rows of WORDS that a block wants, -1 where there is none
    GIVEN: (np.float64, np.int64),  # guests less the discount of their tables, tables of the context
    MOVED: (np.int64, np.int64),  # tables of a part's pairs by after and by before
    TOTALS: (np.int64,) * 2,
    SEAT_VALUES: (np.int32, np.int64, np.int64),  # row of a block's PAIRS, c, sum_t
    PAIR_VALUES: (np.int32, np.float64),  # row of a block's PAIRS, value
    PAIR_ROWS: (np.int64, np.int64, np.float64),  # before, after, value
}  # WORD_VALUES: count, and guests, tables and root of each sample; WORD_ROWS: key, count and marks, as bits


def words_of(body: bytes) -> list[bytes]:
    return body.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words)).view(np.int64)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def stretch_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of stretches of bytes, all at once; eight bytes must follow the last. Those of 32 bytes or more go one by one."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    eight = np.ndarray(max(len(raw) - 7, 0), "<u8", raw, strides=(1,))
    out = p5 + size.astype(np.uint64)
    at, left = start.copy(), np.where(size < 32, size, 0)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        lane = _turned(eight[at[on]] * p2, 31) * p1
        out[on] = _turned(out[on] ^ lane, 27) * p1 + p4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    lane = (eight[at[on]] & np.uint64(0xFFFFFFFF)) * p1
    out[on] = _turned(out[on] ^ lane, 23) * p2 + p3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left >= 1)
        out[on] = _turned(out[on] ^ (raw[at[on]].astype(np.uint64) * p5), 11) * p1
        at[on] += 1
        left[on] -= 1
    out ^= out >> np.uint64(33)
    out *= p2
    out ^= out >> np.uint64(29)
    out *= p3
    out ^= out >> np.uint64(32)
    out = out.view(np.int64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        out[long] = word_hashes([raw[s : s + n].tobytes() for s, n in zip(start[long], size[long])])
    return out


def encode(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, end tokens included, and the first place of each text."""
    ends, raw = binary_parts(bodies)
    low = np.concatenate([LOWER[raw[ends[0] : ends[-1]]], np.zeros(8, np.uint8)])
    ends = ends - ends[0]
    inside = INSIDE[low[: ends[-1]]]
    fresh = np.zeros(len(inside) + 1, bool)  # a text begins here, so no word goes on
    fresh[ends] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | fresh[:-1])) if len(inside) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (np.append(~inside[1:], True) | fresh[1:])) if len(inside) else np.zeros(0, np.int64)
    sizes = np.diff(np.searchsorted(start, ends)) + 1
    last = np.cumsum(sizes) - 1
    tokens = np.full(int(sizes.sum()), END_HASH)
    word = np.ones(len(tokens), bool)
    word[last] = False
    tokens[word] = stretch_hashes(low, start, stop - start + 1)
    return tokens, last - sizes + 1


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def numbers_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the place of each value among them."""
    if not len(values):
        return values, np.zeros(0, np.int32)
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return found[order], place[coded.indices.to_numpy()]


class Numbered:
    """Tokens of a block as numbers of its distinct words (ascending hashes); before a text's first comes the number after the last."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray):
        self.words, self.number = numbers_of(tokens)
        self.first = first

    def pairs(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Of the tokens from ``a`` to ``b``, where texts begin, each with the one before as one number."""
        number = self.number[a:b]
        before = np.empty(len(number), np.int64)
        before[1:] = number[:-1]
        before[self.first[np.searchsorted(self.first, a) : np.searchsorted(self.first, a + len(number))] - a] = len(self.words)
        before *= len(self.words) + 1
        before += number
        return before

    def halves(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(pair, len(self.words) + 1)

    def dealt(self, pair: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        """Both words of ascending distinct pairs, and the part of each pair."""
        before, after = self.halves(pair)
        return before, after, _by_part(part_of(pair_key(np.append(self.words, START_HASH)[before], self.words[after]), parts), parts)


def _places_of(batch: pa.RecordBatch, name: str) -> list[tuple[int, int, int]]:
    """Stretches of equal values of a column: value, from, to."""
    values = batch.column(name).to_numpy()
    cuts = np.append(np.flatnonzero(np.diff(values, prepend=values[0] - 1)), len(values)) if len(values) else []
    return [(int(values[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their ``block``, those of a block one after another, and the number of blocks."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = int(total // BLOCK_BYTES) + 1
    # Equal texts spread like others: the block follows from the identifier.
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # Fewer partitions than blocks even out how many blocks a hash puts into each.
    return blocked.repartition(-(-blocks // 3), "block").sortWithinPartitions("block"), blocks


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before.view(np.uint64) ^ PAIR_TAG) + after.view(np.uint64)).view(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _message(part: int, kind: int, source: int, *columns: np.ndarray) -> tuple:
    """Bytes of equal weight stand together: high ones are mostly equal and compress."""
    kinds = COLUMNS.get(kind, (np.int64,) * len(columns))
    rows, at = len(columns[0]), 0
    body = np.empty(rows * sum(np.dtype(k).itemsize for k in kinds), np.uint8)
    for c, k in zip(columns, kinds, strict=True):
        weights = np.ascontiguousarray(c, k).view(np.uint8).reshape(rows, np.dtype(k).itemsize)
        for i in range(weights.shape[1]):
            body[at : at + rows] = weights[:, i]
            at += rows
    return part, kind, source, rows, body.tobytes()


def _columns(kind: int, rows: int, body: bytes) -> list[np.ndarray]:
    kinds = COLUMNS.get(kind, (np.int64,) * (len(body) // (8 * max(rows, 1))))
    out, at = [], 0
    for k in kinds:
        weights = np.empty((rows, np.dtype(k).itemsize), np.uint8)
        for i in range(weights.shape[1]):
            weights[:, i] = np.frombuffer(body, np.uint8, rows, at)
            at += rows
        out.append(weights.view(k).ravel())
    return out


def _sent(messages: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        *numbers, bodies = zip(*held)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in numbers), pa.array(bodies, pa.binary())], names=["part", "kind", "source", "rows", "body"])

    held, size = [], 0
    for message in messages:
        held.append(message)
        size += len(message[-1])
        if size > SEND_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


Received = dict[int, list[tuple[int, list[np.ndarray]]]]  # by kind: source and columns, ascending sources


def meet(messages: DataFrame, parts: int, work: Callable[[int, Received], Iterator[tuple]]) -> DataFrame:
    """Messages after ``work`` has seen all that came for a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for part, *message in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held[part].append(tuple(message))

        def results() -> Iterator[tuple]:
            for part in sorted(held):
                received: Received = defaultdict(list)
                for kind, source, rows, body in sorted(held.pop(part), key=lambda m: m[:2]):
                    received[kind].append((source, _columns(kind, rows, body)))
                yield from work(part, received)

        yield from _sent(results())
        release()

    return messages.repartitionById(parts, F.col("part")).mapInArrow(run, MESSAGE)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts that occur and the places of each, ascending."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # short numbers sort faster
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def seat(customers: np.ndarray, expected: np.ndarray, others: np.ndarray, strength: float, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers are seated again.

    ``expected`` is the parent's probability of the dish, ``others`` the tables of other dishes in the
    restaurant. Chance comes from hashes of ``keys`` and ``sweep``: a repeated task draws the same.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    at, round_ = np.flatnonzero(customers > 1), 0
    c, e, o, seed = customers[at], expected[at], others[at], mix(keys.view(np.uint64)[at] + mix(np.array([sweep + 1])))
    t, n = np.ones(len(at)), np.ones(len(at))
    while len(at):
        round_ += 1
        size = np.minimum(np.maximum(1, np.floor(n / PARTY)), c - n)
        opening = (strength + discount * (o + t)) * e
        chance = opening / (opening + n - discount * t)
        draw = (mix(seed + np.uint64(round_)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        t += np.minimum(size, np.floor(size * chance + draw))
        n += size
        on = n < c
        tables[at[~on]] = t[~on]
        at, c, e, o, seed, t, n = (x[on] for x in (at, c, e, o, seed, t, n))
    return tables.astype(np.int64)


def discount_of(ones: int, twos: int) -> float:
    """Discount from the numbers of things seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class Symbols:
    """Hashes (ascending) of the training words and their counts, for a model small enough to number."""

    hashes: np.ndarray
    counts: np.ndarray
    size: int

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), RARE)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + FIRST, RARE)


@dataclass
class Model:
    """Totals of the training texts and the restaurants; words and pairs have tables of their own."""

    tokens: int
    types: int
    strength: float
    discount: float
    unknown: np.ndarray  # of each sample: probability of all unknown words without context
    starts: int  # training texts
    start_open: np.ndarray  # of each sample: share of the start of a text left to its parent
    guests: np.ndarray  # of each sample: customers of the parent
    symbols: Symbols | None = None  # these only in a numbered view
    alone: np.ndarray | None = None  # samples x symbols: probabilities without context
    open: np.ndarray | None = None  # samples x symbols: share of a context left to its parent

    def unseen(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.open[:, u] * self.alone[:, w]).mean(axis=0)

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """Share of a word in the symbol of unknown words, which are one outcome."""
        return np.ones(len(counts))


def _contents(pair_parts: int, word_parts: int, round_: int = 0, rounds: int = 1) -> Callable:
    """Of each block its distinct pairs, for their parts, and its distinct words, for theirs (numbered after those of pairs)."""

    def told(block: int, held: list[tuple]) -> Iterator[tuple]:
        sizes = np.cumsum([0, *(len(h[0]) for h in held)])
        numbered = Numbered(np.concatenate([h[0] for h in held]), np.concatenate([h[1] + s for h, s in zip(held, sizes)]))
        skipped = np.concatenate([h[2] for h in held])
        held.clear()
        # The lowest bit tells rows that are not learned from.
        code = numbered.pairs()
        code *= 2
        code += skipped
        code.sort()
        at = np.flatnonzero(np.append(True, code[1:] >> 1 != code[:-1] >> 1))
        n = np.add.reduceat((code & 1) == 0, at, dtype=np.int32)
        words = np.append(numbered.words, START_HASH)
        code = code[at] >> 1
        before, after, rows_of = numbered.dealt(code, pair_parts)
        for p, rows in rows_of:
            if p % rounds != round_:
                continue
            u, w = before[rows], after[rows]
            own = distinct(np.concatenate([u, w]))
            yield _message(p, PAIR_WORDS, block, words[own])
            yield _message(p, PAIRS, block, np.searchsorted(own, u), np.searchsorted(own, w), n[rows])
        for q, rows in _by_part(part_of(numbered.words, word_parts), word_parts) if round_ == 0 else ():
            yield _message(pair_parts + q, WANTED, block, numbered.words[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            held, now = [], None
            for batch in each_slice(batches, "body"):
                for block, a, b in _places_of(batch, "block"):
                    if held and block != now:
                        yield from told(now, held)
                    now, rows = block, batch.slice(a, b - a)
                    tokens, first = encode(rows.column("body"))
                    skipped = ~rows.column("learned").to_numpy(zero_copy_only=False)
                    held.append((tokens, first, np.repeat(skipped, np.diff(np.append(first, len(tokens))))))
            if held:
                yield from told(now, held)

        yield from _sent(messages())

    return run


def _named(received: Received) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, before, after and n of the pairs that blocks have named."""
    for (block, (words,)), (_, (u, w, n)) in zip(received[PAIR_WORDS], received[PAIRS], strict=True):
        yield block, words[u], words[w], n


@dataclass
class Grouped:
    """Pairs that blocks have named: of each its ``group`` of equal ones; of each group both words, numbered in ``words``, and its customers ``c``."""

    words: np.ndarray
    n: np.ndarray
    block: np.ndarray
    row: np.ndarray  # in the block's message
    group: np.ndarray
    before: np.ndarray
    after: np.ndarray
    c: np.ndarray


def _grouped(received: Received) -> Grouped:
    words = distinct(np.concatenate([c[0] for _, c in received[PAIR_WORDS]]))
    pair, n, block, row = [], [], [], []
    for (_, (own,)), (b, (u, w, times)) in zip(received[PAIR_WORDS], received[PAIRS], strict=True):
        place = np.searchsorted(words, own)
        pair.append(place[u] * len(words) + place[w])
        n.append(times)
        block.append(np.full(len(u), b, np.int32))
        row.append(np.arange(len(u), dtype=np.int32))
    pair, n, block, row = (np.concatenate(x) for x in (pair, n, block, row))
    order = np.argsort(pair)
    pair = pair[order]
    fresh = np.append(True, pair[1:] != pair[:-1])
    group = np.empty(len(pair), np.int32)
    group[order] = np.cumsum(fresh, dtype=np.int32) - 1
    pair = pair[fresh]
    c = np.bincount(group, n, len(pair)).astype(np.int64)
    return Grouped(words, n, block, row, group, *np.divmod(pair, len(words)), c)


def _count(blocks: int, pair_parts: int, word_parts: int) -> Callable:
    """At a part of pairs: customers of each pair, what it adds to its words, and who wants to know of it. At a part of words nothing yet."""

    def work(part: int, received: Received) -> Iterator[tuple]:
        if part >= pair_parts:
            yield from (_message(part, WANTED, source, *c) for source, c in received[WANTED])
            return
        g = _grouped(received)
        received.clear()
        c, words, u, w = g.c, g.words, g.before, g.after
        several, once = c > 1, c == 1
        yield _message(part, TOTALS, part, *np.array([[once.sum()], [(c == 2).sum()]]))
        row = np.where(several, np.cumsum(several) - 1, -1).astype(np.int32)
        asked = np.flatnonzero(several[g.group] | (once[g.group] & (g.n == 0)))
        for b, rows in _by_part(g.block[asked], blocks):
            yield _message(part, PLACES, b, g.row[asked[rows]], row[g.group[asked[rows]]])

        def sums(of: np.ndarray, value: np.ndarray) -> np.ndarray:
            return np.bincount(of, value, len(words)).astype(np.int64)

        count = np.where(words == START_HASH, sums(u, c), sums(w, c))
        columns = [words, count, sums(w, once), sums(u, once), sums(w, several), sums(u, several)]
        some = (count > 0) | (columns[3] + columns[5] > 0)
        for q, rows in _by_part(np.where(some, part_of(words, word_parts), word_parts), word_parts):
            yield _message(pair_parts + q, SUMS, part, *(x[rows] for x in columns))
        live = columns[4] + columns[5] > 0
        place = np.cumsum(live) - 1
        yield _message(part, VOCABULARY, part, words[live])
        ones = np.ones(int(several.sum()), np.int64)
        yield _message(part, SEATS, part, place[u[several]], place[w[several]], c[several], ones, 0 * ones)

    return work


def _open_words(discount: float) -> Callable:
    """At a part of words: their sums, and which of them each part of pairs and each block will hear of."""

    def work(part: int, received: Received) -> Iterator[tuple]:
        found = received[SUMS]
        key = distinct(np.concatenate([np.zeros(0, np.int64), *(c[0] for _, c in found)]))
        numbers = [np.searchsorted(key, c[0]) for _, c in found]
        sums = np.zeros((5, len(key)), np.int64)
        for (_, c), rows in zip(found, numbers):
            for i in range(5):
                sums[i][rows] += c[i + 1]  # a part tells of a word once
        count, once_after, once_before, more_after, more_before = sums
        guests, tables = once_after + more_after, once_before + more_before
        root = np.minimum(guests, 1)
        yield _message(part, WORDS, part, key, count, once_after, once_before, guests, tables, root)
        yield _message(part, TOTALS, part, guests.sum()[None], root.sum()[None])
        for (p, c), number in zip(found, numbers):
            rows = number[c[4] + c[5] > 0]
            if len(rows):
                yield _message(part, ROUTE, p, rows)
                yield _message(p, GIVEN, part, (guests - discount * root)[rows], tables[rows])
        for b, (wanted,) in received[WANTED]:
            yield _message(part, ASKED, b, _found(key, wanted))

    return work


def _sweep(strength: float, discount: float, sweep: int, kept: bool, guests: int, nobody: float, parts: int) -> Callable:
    """At a part of pairs: all seated again; tables are added up in ``sum_t`` where the sweep counts."""

    def work(part: int, received: Received) -> Iterator[tuple]:
        ((_, (words,)),), ((_, (u, w, c, t, total)),) = received[VOCABULARY], received[SEATS]
        own, tables = np.zeros(len(words)), np.zeros(len(words), np.int64)
        to = list(_by_part(part_of(words, parts), parts))
        for (_, rows), (_, given) in zip(to, received[GIVEN], strict=True):
            own[rows], tables[rows] = given
        expected = own / (strength + guests) + nobody
        t = seat(c, expected[w], tables[u] - t, strength, discount, pair_key(words[u], words[w]), sweep)
        yield _message(part, VOCABULARY, part, words)
        yield _message(part, SEATS, part, u, w, c, t, total + kept * t)
        after, before = np.bincount(w, t, len(words)), np.bincount(u, t, len(words))
        for q, rows in to:
            yield _message(q, MOVED, part, after[rows], before[rows])

    return work


def _sweep_root(base: float, root_total: int, strength: float, discount: float, sweep: int, kept: bool) -> Callable:
    """At a part of words: what the pairs have moved is summed and the parent is seated again."""

    def work(part: int, received: Received) -> Iterator[tuple]:
        ((_, (key, count, once_after, once_before, _, _, root)),) = received[WORDS]
        guests, tables = once_after.copy(), once_before.copy()
        for (_, (rows,)), (_, (after, before)) in zip(received[ROUTE], received[MOVED], strict=True):
            guests[rows] += after
            tables[rows] += before
        root = seat(guests, np.full(len(guests), base), root_total - root, strength, discount, key, sweep)
        yield _message(part, WORDS, part, key, count, once_after, once_before, guests, tables, root)
        yield from (_message(part, SAMPLE, s, *c) for s, c in received[SAMPLE])
        if kept:
            yield _message(part, SAMPLE, sweep, guests, tables, root)
        yield _message(part, TOTALS, part, guests.sum()[None], root.sum()[None])
        for p, (rows,) in received[ROUTE]:
            yield _message(p, GIVEN, part, (guests - discount * root)[rows], tables[rows])

    return work


def _of(messages: DataFrame, *kinds: int) -> DataFrame:
    return messages.filter(F.col("kind").isin(*kinds))


def _totals(messages: DataFrame) -> tuple[int, int]:
    found = [_columns(TOTALS, r.rows, bytes(r.body)) for r in _of(messages, TOTALS).select("rows", "body").collect()]
    return sum(int(x[0]) for x, _ in found), sum(int(x[0]) for _, x in found)


@dataclass
class Seated:
    """What training leaves in tables: messages that wait at the parts of pairs and of words."""

    blocked: DataFrame
    pair_parts: int
    word_parts: int
    places: DataFrame
    opened: DataFrame
    seats: DataFrame
    words: DataFrame


def _start_tables(words: DataFrame, parts: int) -> np.ndarray:
    """Tables of the start of a text in each sample."""
    part = int(part_of(np.array([START_HASH]), parts)[0])
    held = {(r.kind, r.source): _columns(r.kind, r.rows, bytes(r.body)) for r in _of(words, WORDS, SAMPLE).filter(F.col("part") == part).collect()}
    at = [np.flatnonzero(c[0] == START_HASH) for (kind, _), c in held.items() if kind == WORDS]
    return np.array([c[1][at[0]][0] for (kind, _), c in sorted(held.items(), key=lambda x: x[0]) if kind == SAMPLE]) if at and len(at[0]) else np.zeros(0)


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[None]:
    """Written tables are well compressed and what a job has shuffled goes when it ends, not when the driver collects its garbage."""
    wanted = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def seat_all(docs: DataFrame, scratch: Scratch, strength: float, burn_in: int, samples: int) -> tuple[Model, Seated]:
    """The model of the rows (doc_id, body) that are ``learned`` from; the others only name the pairs they will ask for."""
    blocked, blocks = in_blocks(docs)
    pair_parts, parts = (-(-blocks // n) for n in BLOCKS_A_PART)
    with little_disk(docs.sparkSession):
        held = []
        for round_ in range(ROUNDS):
            told = blocked.select("block", "body", "learned").mapInArrow(_contents(pair_parts, parts, round_, ROUNDS), MESSAGE)
            held.append(scratch.write(meet(told, pair_parts + parts, _count(blocks, pair_parts, parts))))
        counted = reduce(DataFrame.unionByName, held)
        discount = discount_of(*_totals(counted))
        opened = scratch.write(meet(_of(counted, SUMS, WANTED).withColumn("part", F.col("part") - pair_parts), parts, _open_words(discount)))

        def summed(rows: DataFrame) -> tuple[int, int, int]:
            return tuple(rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "starts"))).first())

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (key, count, *_) in _unpacked(batches):
                word = key != START_HASH
                numbers = count[word].sum(), word.sum(), count[~word].sum()
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in numbers], names=["tokens", "types", "starts"])

        tokens, types, starts = summed(_of(opened, WORDS).mapInArrow(counts, "tokens long, types long, starts long"))
        base = 1 / (max(types, 1) + 1)
        guests, root = _totals(opened)
        places = scratch.write(_of(counted, PLACES))
        seats, words = counted, opened
        unknown, of_sample = [], []
        for sweep in range(burn_in + samples):
            kept = sweep >= burn_in
            nobody = (strength + discount * root) * base / (strength + guests)
            came = _of(seats, VOCABULARY, SEATS).unionByName(_of(words, GIVEN))
            moved = scratch.write(meet(came, pair_parts, _sweep(strength, discount, sweep, kept, guests, nobody, parts)))
            came = _of(words, WORDS, SAMPLE).unionByName(_of(opened, ROUTE)).unionByName(_of(moved, MOVED))
            after = scratch.write(meet(came, parts, _sweep_root(base, root, strength, discount, sweep, kept)))
            scratch.drop(*held)
            seats, words = held = moved, after
            guests, root = _totals(words)
            if kept:
                of_sample.append(guests)
                unknown.append((strength + discount * root) * base / (strength + guests))
    model = Model(int(tokens), int(types), strength, discount, np.array(unknown), int(starts), np.ones(samples), np.array(of_sample))
    start = _start_tables(words, parts)
    if starts:
        model.start_open = (strength + discount * start) / (strength + starts)
    return model, Seated(blocked, pair_parts, parts, places, opened, seats, words)


def train(training: DataFrame, scratch: Scratch, strength: float = 1.0, burn_in: int = 2, samples: int = 3) -> tuple[Model, DataFrame, DataFrame]:
    """The model, its words and its pairs.

    Words have ``key``, ``count`` and ``marks`` (of each sample the probability without context and the
    share left to the parent as a context); pairs have ``before``, ``after`` and ``value`` (customers less
    the discount of their tables, averaged over samples).
    """
    model, seated = seat_all(training.select("body", F.col("doc_id"), F.lit(True).alias("learned")), scratch, strength, burn_in, samples)
    pair_parts, parts, discount = seated.pair_parts, seated.word_parts, model.discount

    def word_rows(part: int, received: Received) -> Iterator[tuple]:
        ((_, (key, count, *_)),) = received[WORDS]
        marks = _marks(model, count, [c for _, c in received[SAMPLE]])
        yield _message(part, WORD_ROWS, part, key, count, *marks.T.view(np.int64))

    def several(part: int, received: Received) -> Iterator[tuple]:
        ((_, (words,)),), ((_, (u, w, c, _, total)),) = received[VOCABULARY], received[SEATS]
        yield _message(part, PAIR_ROWS, part, words[u], words[w], c - discount * total / samples)

    def singles(part: int, received: Received) -> Iterator[tuple]:
        if received[PAIRS]:
            g = _grouped(received)
            before, after = (g.words[x[g.c == 1]] for x in (g.before, g.after))
            yield _message(part, PAIR_ROWS, part, before, after, np.full(len(before), 1 - discount))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, count, *marks) in _unpacked(batches):
            marks = np.stack(marks, axis=1).view(np.float64)
            ends = np.arange(len(marks) + 1, dtype=np.int32) * marks.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count), pa.ListArray.from_arrays(pa.array(ends), pa.array(marks.ravel()))], names=["key", "count", "marks"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "after", "value"])

    told = seated.blocked.select("block", "body", "learned").mapInArrow(_contents(pair_parts, parts), MESSAGE)
    pairs = meet(_of(told, PAIR_WORDS, PAIRS), pair_parts, singles).unionByName(meet(_of(seated.seats, VOCABULARY, SEATS), pair_parts, several))
    found = meet(_of(seated.words, WORDS, SAMPLE), parts, word_rows).mapInArrow(words, "key long, count long, marks array<double>")
    return model, found.filter(F.col("key") != START_HASH), pairs.mapInArrow(rows, "before long, after long, value double")


def _marks(model: Model, count: np.ndarray, samples: list[list[np.ndarray]]) -> np.ndarray:
    """One row a word: of each sample its probability without context and the share it leaves as a context."""
    out = np.empty((len(count), 2 * len(samples)))
    for i, (guests, tables, root) in enumerate(samples):
        out[:, 2 * i] = (guests - model.discount * root) / (model.strength + model.guests[i]) + model.unknown[i]
        out[:, 2 * i + 1] = (model.strength + model.discount * tables) / (model.strength + count)
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[np.ndarray]]]:
    for batch in batches:
        for part, kind, source, rows, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if rows:
                yield (part, kind, source), _columns(kind, rows, body)


def fit(training: DataFrame, scratch: Scratch, strength: float = 1.0, burn_in: int = 2, samples: int = 3) -> tuple[Model, DataFrame, DataFrame]:
    """As ``train``, with a numbered view to look into: symbols in the model, and pairs with ``u``, ``w`` and ``p``.

    The view collects all words; ``digest`` goes without it.
    """
    model, words, pairs = train(training, scratch, strength, burn_in, samples)
    found = words.toPandas().sort_values("key")
    of_word = found[found["key"] != END_HASH]
    model.symbols = Symbols(of_word["key"].to_numpy(np.int64), of_word["count"].to_numpy(np.int64), FIRST + len(of_word))
    model.alone = np.repeat(model.unknown[:, None], model.symbols.size, axis=1)
    model.alone[:, START] = 0
    model.open = np.ones_like(model.alone)
    model.open[:, START] = model.start_open
    for place, rows in ((slice(FIRST, None), of_word), (slice(END, END + 1), found[found["key"] == END_HASH])):
        if len(rows):
            marks = np.stack(rows["marks"].to_list()).T
            model.alone[:, place], model.open[:, place] = marks[0::2], marks[1::2]
    customers = np.concatenate([[model.starts, 0, 0], model.symbols.counts])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, value = (batch.column(c).to_numpy() for c in ("before", "after", "value"))
            u = np.where(before == START_HASH, START, model.symbols.of(before))
            w = np.where(after == END_HASH, END, model.symbols.of(after))
            p = value / (strength + customers[u]) + model.unseen(u, w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u), pa.array(w), pa.array(p)], names=[*batch.schema.names, "u", "w", "p"])

    return model, words, pairs.mapInArrow(numbered, "before long, after long, value double, u long, w long, p double")


def _block_values(samples: int) -> tuple[Callable, Callable]:
    """What a part of pairs and a part of words answer to blocks."""

    def of_pairs(part: int, received: Received) -> Iterator[tuple]:
        ((_, (_, _, c, _, total)),) = received[SEATS]
        c, total = np.append(c, 1), np.append(total, samples)
        for b, (row, seat_) in received[PLACES]:
            yield _message(b, SEAT_VALUES, part, row, c[seat_], total[seat_])

    def of_words(part: int, received: Received) -> Iterator[tuple]:
        ((_, (_, count, *_)),) = received[WORDS]
        columns = [np.append(x, 0) for x in (count, *(x for _, c in received[SAMPLE] for x in c))]
        for b, (row,) in received[ASKED]:
            yield _message(b, WORD_VALUES, part, *(x[row] for x in columns))

    return of_pairs, of_words


def _known(kind: int, parts: int, names: list[str]) -> Callable:
    """Rows of a table of words or pairs as messages to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(n).to_numpy() for n in names]
                if kind == WORD_ROWS:
                    marks = batch.column("marks").flatten().to_numpy().reshape(len(batch), -1)
                    columns += list(marks.T.view(np.int64)) if len(batch) else []
                key = columns[0] if kind == WORD_ROWS else pair_key(*columns[:2])
                for p, rows in _by_part(part_of(key, parts), parts):
                    yield _message(p, kind, 0, *(c[rows] for c in columns))

        yield from _sent(messages())

    return run


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted among the ascending keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _looked_up(nothing: np.ndarray) -> tuple[Callable, Callable]:
    """What tables of pairs and of words say to blocks."""

    def of_pairs(part: int, received: Received) -> Iterator[tuple]:
        if received[PAIR_ROWS]:
            before, after, value = (np.concatenate(x) for x in zip(*(c for _, c in received[PAIR_ROWS])))
            key = pair_key(before, after)
            order = np.argsort(key)
            for b, before, after, _ in _named(received):
                at = _found(key[order], pair_key(before, after))
                yield _message(b, PAIR_VALUES, part, np.flatnonzero(at >= 0), value[order][at[at >= 0]])

    def of_words(part: int, received: Received) -> Iterator[tuple]:
        key, *columns = (np.concatenate(x) for x in zip(*(c for _, c in received[WORD_ROWS]))) if received[WORD_ROWS] else [np.zeros(0, np.int64)] * (2 + len(nothing))
        order = np.argsort(key)
        columns = [np.append(c[order], x) for c, x in zip(columns, (0, *nothing.view(np.int64)), strict=True)]
        for b, (wanted,) in received[WANTED]:
            at = _found(key[order], wanted)
            yield _message(b, WORD_ROWS, part, wanted, *(c[at] for c in columns))

    return of_pairs, of_words


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _judge(model: Model, pair_parts: int, parts: int) -> Callable:
    """Scores of a block's texts from what its pairs and words were answered."""
    samples = len(model.unknown)

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, tokens, firsts, learned, ends = [], [], [], [], [0]
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "body"):
                found, first = encode(part.column("body"))
                ids.append(part.column("doc_id"))
                tokens.append(found)
                firsts.append(first + ends[-1])
                learned.append(part.column("learned").to_numpy(zero_copy_only=False))
                ends.append(ends[-1] + len(found))
        if not ids:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * 2, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        numbered = Numbered(np.concatenate(tokens), np.concatenate(firsts))
        tokens.clear()
        words = numbered.words

        columns, marks = np.zeros(len(words), np.int64), np.empty((len(words), 2 * samples))
        heard: Received = defaultdict(list)
        for (_, kind, source), found in _unpacked(answers.select(["part", "kind", "source", "rows", "body"]).to_batches()):
            heard[kind].append((source, found))
        rows_of = dict(_by_part(part_of(words, parts), parts))
        for source, (count, *found) in heard[WORD_VALUES]:
            rows = rows_of[source]
            columns[rows] = count
            marks[rows] = _marks(model, count, [found[i : i + 3] for i in range(0, len(found), 3)])
        for source, (_, count, *found) in heard[WORD_ROWS]:
            rows = rows_of[source]
            columns[rows], marks[rows] = count, np.stack(found, axis=1).view(np.float64)
        columns, marks = np.append(columns, model.starts), np.append(marks, np.stack([np.zeros(samples), model.start_open], axis=1).reshape(1, -1), axis=0)

        pair = distinct(numbered.pairs())
        before, after, rows_of_pairs = numbered.dealt(pair, pair_parts)
        rows_of_pairs = dict(rows_of_pairs)
        # A pair learned from here and not answered was seen once in all.
        here = np.zeros(len(pair), bool)
        backs = [np.searchsorted(pair, numbered.pairs(a, b)).astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]
        sizes = [np.diff(np.append(f, b)) for f, b in zip(firsts, ends[1:])]
        for back, size, own in zip(backs, sizes, learned):
            here[back[np.repeat(own, size)]] = True
        value = np.where(here, 1 - model.discount, 0.0)
        for source, (row, c, total) in heard[SEAT_VALUES]:
            value[rows_of_pairs[source][row]] = np.where(c > 1, c - model.discount * total / samples, 1 - model.discount)
        for source, (row, given) in heard[PAIR_VALUES]:
            value[rows_of_pairs[source][row]] = given
        unseen = np.zeros(len(pair))
        for i in range(samples):
            unseen += marks[before, 2 * i + 1] * marks[after, 2 * i]
        log = np.log10(value / (model.strength + columns[before]) + unseen / samples)
        count = columns[after]
        base = np.log10((count + 1) / (model.tokens + model.types + 1))
        sums = []
        for back, first, a in zip(backs, firsts, ends[:-1]):
            sums.append([np.add.reduceat(x[back], first - a) for x in ((count > 0).astype(np.int64), base, log)])
        out = pa.table(
            [pa.chunked_array(ids, pa.int64()), np.concatenate(sizes), *(np.concatenate(x) for x in zip(*sums))],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )
        return out

    return judge


def _scored(blocked: DataFrame, pair_parts: int, answers: DataFrame, model: Model, parts: int) -> DataFrame:
    small = replace(model, symbols=None, alone=None, open=None)
    answers = answers.withColumn("block", F.col("part"))
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_judge(small, pair_parts, parts), RESULT)


def score(docs: DataFrame, model: Model, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of rows with ``doc_id`` and ``body``."""
    blocked, blocks = in_blocks(docs.select("doc_id", "body", F.lit(False).alias("learned")))
    pair_parts, parts = (-(-blocks // n) for n in BLOCKS_A_PART)
    asked = blocked.select("block", "body", "learned").mapInArrow(_contents(pair_parts, parts), MESSAGE)
    nothing = np.stack([model.unknown, np.ones(len(model.unknown))], axis=1).ravel()
    of_pairs, of_words = _looked_up(nothing)
    seen = pairs.select("before", "after", "value").mapInArrow(_known(PAIR_ROWS, pair_parts, ["before", "after", "value"]), MESSAGE)
    known = words.select("key", "count", "marks").mapInArrow(_known(WORD_ROWS, parts, ["key", "count"]), MESSAGE)
    answers = meet(_of(asked, PAIR_WORDS, PAIRS).unionByName(seen), pair_parts, of_pairs)
    answers = answers.unionByName(meet(_of(asked, WANTED).withColumn("part", F.col("part") - pair_parts).unionByName(known), parts, of_words))
    return _scored(blocked, pair_parts, answers, model, parts)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows under the model of those whose crc32 of the identifier modulo 7 is not 2."""
    scratch = Scratch(docs.sparkSession, "language-model")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(7)) == 2
    model, seated = seat_all(slim.withColumn("learned", ~held_out), scratch, strength=1.0, burn_in=2, samples=3)
    of_pairs, of_words = _block_values(len(model.unknown))
    answers = meet(_of(seated.seats, SEATS).unionByName(seated.places), seated.pair_parts, of_pairs)
    answers = answers.unionByName(meet(_of(seated.words, WORDS, SAMPLE).unionByName(_of(seated.opened, ASKED)), seated.word_parts, of_words))
    out = _scored(seated.blocked, seated.pair_parts, answers, model, seated.word_parts)
    return out.select(
        F.col("doc_id").alias(id_col),
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
