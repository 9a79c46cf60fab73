"""Repeated passages of a corpus, found by bucket-pointer refinement of suffixes.

A suffix's bucket is named from the buckets of later offsets: the name of 2k bytes at p is made of
the names of k bytes at p and at p + k, so each level reuses the one before, up to q = 32 and then to
a whole window (100 bytes by default). Names are 64-bit hashes, equal for equal bytes everywhere, so
no task has to agree with another on them, and two of them decide an equality.

* Initial buckets: of the q-grams of every window the one with the smallest name is its anchor. Equal
  windows have equal anchors, and about one position in 32 is an anchor. The windows that share an
  anchor are one run of starts; the run's bytes are its context.
* First refinement: anchors are dealt by bucket. Runs with an equal context repeat whole, all but the
  first. A bucket with one context is done. Each task first keeps one row per context, so a passage
  found in a third of all documents sends one row a task; a bucket with very many contexts inside
  one task is dealt by context instead and leaves a witness in its bucket.
* Last refinement: contexts that share a bucket and differ are fetched from their documents, and
  their windows are sorted by full name. Buckets beyond ``LIMIT`` contexts are refined by a grouped
  minimum per window, which no single task has to hold.

Defined cases: null counts as empty; texts under a window lose nothing; identifiers order documents,
a null one first; of texts that share an identifier the one with the smaller hash comes first; rows
that repeat identifier and text are one document, treated alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import Scratch, binary_parts, each_slice, mix, utf8

GRAM = 32
FLUSH = 500_000  # anchors a task holds before it passes them on
SPREAD = 64  # contexts of one bucket in one flush from which the bucket is dealt by context
LIMIT = 20_000  # contexts of one bucket that one task refines
REPEAT, PLAIN, SPREAD_OUT, WITNESS = 0, 1, 2, 3
NO_ID = -(1 << 63)

_ONE, _TWO, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(29)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a bucket from the names of its two halves."""
    x = a * _ONE
    x ^= x >> _SHIFT
    x += b
    x *= _TWO
    x ^= x >> _SHIFT
    return x


def gram_names(raw: np.ndarray) -> np.ndarray:
    names = mix(np.arange(1, 257, dtype=np.uint64))[raw]
    k = 1
    while k < GRAM:
        names = _pair(names[:-k], names[k:])
        k *= 2
    return names


def _smallest(names: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest (leftmost among equals) of each ``span`` consecutive names."""
    at, k = np.arange(len(names), dtype=np.int32), 1
    while k < span:
        step = min(k, span - k)
        first = names[:-step] <= names[step:]
        at = np.where(first, at[:-step], at[step:])
        names = np.where(first, names[:-step], names[step:])
        k += step
    return at


def anchors(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document number, start, windows, anchor offset, bucket, context."""
    sizes = np.diff(ends)
    base = int(ends[0])
    raw = raw[base : int(ends[-1])]
    if len(raw) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    grams = gram_names(raw)
    twice = _pair(grams[:-GRAM], grams[GRAM:])  # 64 bytes
    at = _smallest(grams, window - GRAM + 1)
    begins, stops = ends[:-1] - base, ends[1:] - base
    long = sizes >= window
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, begins[long], 1)
    np.add.at(change, stops[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]))
    anchor = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low, n, anchor = starts[first], np.diff(np.append(first, len(starts))), anchor[first].astype(np.int64)
    length = n - 1 + window
    # Overlapping 64-byte names cover a context: it is at most window + (window - 32) bytes long.
    context = np.zeros(len(low), np.uint64)
    for step in range(0, 2 * window - GRAM, 64):
        context = _pair(context, twice[low + np.minimum(step, length - 64)])
    context = _pair(context, mix((length * 256 + (anchor - low)).astype(np.uint64)))
    doc = np.searchsorted(stops, low, side="right")
    return doc, low - begins[doc], n, anchor - low, grams[anchor], context


def window_names(raw: np.ndarray, window: int) -> np.ndarray:
    """Names of all windows of a text from the names of 64 bytes inside them."""
    grams = gram_names(raw)
    twice = _pair(grams[:-GRAM], grams[GRAM:])
    out = np.zeros(len(raw) - window + 1, np.uint64)
    for step in range(0, window, 64):
        at = min(step, window - 64)
        out = _pair(out, twice[at : at + len(out)])
    return out


def _packed(low: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (low << 16) | (n << 8) | offset


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    return packed >> 16, (packed >> 8) & 255, packed & 255


RUNS = "place long, kind byte, bucket long, context long, doc long, sub long, packed long"


def _runs_of_task(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchored runs of a task's documents, one row per context and flush, and the repeats among them."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, sub, packed, bucket, context = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((packed, sub, doc, context, bucket))
        doc, sub, packed, bucket, context = doc[order], sub[order], packed[order], bucket[order], context[order]
        new_bucket = np.ones(len(doc), bool)
        new_bucket[1:] = bucket[1:] != bucket[:-1]
        new = new_bucket.copy()
        new[1:] |= context[1:] != context[:-1]
        kind = np.where(new, PLAIN, REPEAT).astype(np.int8)
        number = np.cumsum(new_bucket) - 1
        crowded = np.bincount(number, weights=new) >= SPREAD
        kind[new & crowded[number]] = SPREAD_OUT
        place = np.where(kind == PLAIN, bucket, _pair(bucket, context))
        place = np.where(kind == REPEAT, mix(packed.view(np.uint64) + doc.view(np.uint64) + sub.view(np.uint64)), place)
        witness = np.flatnonzero(new_bucket)[crowded]
        columns = [
            np.append(place, bucket[witness]).view(np.int64),
            np.append(kind, np.full(len(witness), WITNESS, np.int8)),
            np.append(bucket, bucket[witness]).view(np.int64),
            np.append(context, context[witness]).view(np.int64),
            np.append(doc, np.full(len(witness), np.iinfo(np.int64).max)),  # after every row of its context
            np.append(sub, sub[witness]),
            np.append(packed, packed[witness]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "kind", "bucket", "context", "doc", "sub", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in each_slice(batches, "body", 1_000_000):
            ends, raw = binary_parts(batch.column("body"))
            number, low, n, offset, bucket, context = anchors(raw, ends, window)
            ids = batch.column("doc").to_numpy()[number]
            parts.append((ids, batch.column("sub").to_numpy()[number], _packed(low, n, offset), bucket, context))
            held += len(ids)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _first_refinement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of bucket, context and place: repeats, and contexts that share a bucket."""
    last_bucket = last_context = None
    pending: tuple | None = None  # the only context so far of the last bucket
    for batch in batches:
        kind, bucket, context, doc, sub, packed = (batch.column(c).to_numpy() for c in ("kind", "bucket", "context", "doc", "sub", "packed"))
        again = kind == REPEAT
        rows = np.flatnonzero(~again)
        if len(rows):
            b, c = bucket[rows], context[rows]
            new_bucket, new = np.ones(len(rows), bool), np.ones(len(rows), bool)
            new_bucket[1:] = b[1:] != b[:-1]
            new_bucket[0] = b[0] != last_bucket
            new[1:] = new_bucket[1:] | (c[1:] != c[:-1])
            new[0] = new_bucket[0] or c[0] != last_context
            is_witness = kind[rows] == WITNESS
            again[rows[~new & ~is_witness]] = True
            heads = np.flatnonzero(new | is_witness)
            shared = np.zeros(len(rows), bool)
            if len(heads):
                shared[heads] = ~new_bucket[heads]
                followed = np.append(b[heads][1:] == b[heads][:-1], False)
                shared[heads[followed]] = True
                shared &= new
                if pending is not None and b[heads[0]] == last_bucket:
                    yield _found([False], *([v] for v in pending))
                tail = heads[-1]
                alone = new_bucket[tail] and not shared[tail]
                if alone or b[tail] != last_bucket or len(heads):
                    pending = (bucket[rows[tail]], doc[rows[tail]], sub[rows[tail]], packed[rows[tail]]) if alone and kind[rows[tail]] == PLAIN else None
            shared |= new & (kind[rows] == SPREAD_OUT)
            shared &= ~is_witness
            last_bucket, last_context = b[-1], c[-1]
            out = np.concatenate([np.flatnonzero(again), rows[shared]])
        else:
            out = np.flatnonzero(again)
        yield _found(again[out], bucket[out], doc[out], sub[out], packed[out])


def _found(repeat, bucket, doc, sub, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(repeat, pa.bool_()), *(pa.array(x, pa.int64()) for x in (bucket, doc, sub, packed))],
        names=["repeat", "bucket", "doc", "sub", "packed"],
    )


def _fetch(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of wanted contexts, cut out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            wanted = batch.column("wanted")
            cuts = wanted.offsets.to_numpy().astype(np.int64)
            fields = wanted.values.flatten()
            bucket, packed = (f.to_numpy()[cuts[0] : cuts[-1]] for f in fields)
            number = np.repeat(np.arange(len(batch)), np.diff(cuts))
            low, n, _ = _unpacked(packed)
            start = ends[:-1][number] + low
            bytes_ = [raw[a : a + m].tobytes() for a, m in zip(start.tolist(), (n - 1 + window).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), *(pa.array(batch.column(c).to_numpy()[number]) for c in ("doc", "sub")), pa.array(packed), pa.array(bytes_, pa.binary())],
                names=["bucket", "doc", "sub", "packed", "context"],
            )

    return run


def _windows(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Row number, place inside the row and name of every window of a batch of contexts."""
    ends, raw = binary_parts(batch.column("context"))
    raw = raw[int(ends[0]) : int(ends[-1])]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    n = sizes - window + 1
    names = window_names(raw, window)
    row = np.repeat(np.arange(len(batch)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, inside, names[starts[row] + inside]


SPANS = "doc long, sub long, low long, high long"


def _span_batch(doc, sub, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, sub, low, high)], names=["doc", "sub", "low", "high"])


def _last_refinement(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of repeated windows; contexts come in order of bucket, and whole buckets are refined."""

    def refine(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, inside, name = _windows(batch, window)
        bucket, doc, sub, packed = (batch.column(c).to_numpy() for c in ("bucket", "doc", "sub", "packed"))
        low, _, _ = _unpacked(packed)
        order = np.lexsort((low[row] + inside, sub[row], doc[row], name, bucket[row]))
        b, m = bucket[row][order], name[order]
        repeated = np.zeros(len(row), bool)
        repeated[order[1:]] = (b[1:] == b[:-1]) & (m[1:] == m[:-1])
        hit = np.flatnonzero(repeated)
        if not len(hit):
            return _span_batch([], [], [], [])
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
        first = hit[new]
        last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        at = row[first]
        return _span_batch(doc[at], sub[at], low[at] + inside[first], low[at] + inside[last] + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            bucket = rows.column("bucket").to_numpy()
            if len(bucket) < LIMIT // 2:
                held = rows
                continue
            cut = int(np.flatnonzero(bucket == bucket[-1])[0])
            if cut:
                yield from (refine(b) for b in rows.slice(0, cut).combine_chunks().to_batches())
            held = rows.slice(cut)
        if held is not None:
            yield from (refine(b) for b in held.combine_chunks().to_batches())

    return run


def _each_window(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "context"):
            row, inside, name = _windows(batch, window)
            doc, sub = (batch.column(c).to_numpy()[row] for c in ("doc", "sub"))
            low, _, _ = _unpacked(batch.column("packed").to_numpy()[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (batch.column("bucket").to_numpy()[row], name.view(np.int64), doc, sub, low + inside)],
                names=["bucket", "name", "doc", "sub", "low"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Spans (doc, sub, low, high) whose every window also starts earlier; they may overlap.

    ``docs`` has ``doc``, ``sub`` and ``body``.
    """
    if not 64 <= window <= 128:
        raise ValueError("windows of 64 to 128 bytes are supported")
    runs = docs.select("doc", "sub", "body").mapInArrow(_runs_of_task(window), RUNS)
    # The number is given: rows are small, and a later merge of partitions would undo the spreading.
    dealt = runs.repartition(F.col("place")).sortWithinPartitions("bucket", "context", "doc", "sub", "packed")
    found = scratch.write(dealt.mapInArrow(_first_refinement, "repeat boolean, bucket long, doc long, sub long, packed long"))
    low = F.shiftrightunsigned("packed", 16)
    n = F.shiftrightunsigned("packed", 8).bitwiseAND(255)
    whole = found.filter("repeat").select("doc", "sub", low.alias("low"), (low + n - 1 + window).alias("high"))

    shared = found.filter("not repeat")
    wanted = shared.groupBy("doc", "sub").agg(F.collect_list(F.struct("bucket", "packed")).alias("wanted"))
    texts = docs.select("doc", "sub", "body").join(wanted, ["doc", "sub"])
    contexts = scratch.write(texts.mapInArrow(_fetch(window), "bucket long, doc long, sub long, packed long, context binary"))
    crowded = contexts.groupBy("bucket").count().filter(F.col("count") > LIMIT).select("bucket")
    few = contexts.join(crowded, "bucket", "left_anti")
    few = few.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    few = few.mapInArrow(_last_refinement(window), SPANS)
    many = contexts.join(crowded, "bucket", "left_semi").mapInArrow(_each_window(window), "bucket long, name long, doc long, sub long, low long")
    many = scratch.write(many)
    earliest = many.groupBy("bucket", "name").agg(F.min(F.struct("doc", "sub", "low")).alias("first"))
    many = many.join(earliest, ["bucket", "name"]).filter(F.struct("doc", "sub", "low") != F.col("first"))
    many = many.select("doc", "sub", "low", (F.col("low") + window).alias("high"))
    return whole.unionByName(few).unionByName(many)


def _merged(spans: list, size: int) -> np.ndarray:
    """Maximal runs (k, 2) of a list of spans."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    both = np.array([(s["low"], s["high"]) for s in spans], np.int64)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.ones(len(both), bool)
    new[1:] = both[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([both[first, 0], reach[np.append(first[1:] - 1, len(both) - 1)]], axis=1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Input rows packed into ``row``, with their order key and bytes."""
    body = utf8(text_col)
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(body).alias("sub"),
        body.alias("body"),
    )


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window, Scratch(docs.sparkSession, "suffix-dedup"))
    spans = spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return keyed.join(spans, ["doc", "sub"], "left")


def _kept(body: bytes, runs: np.ndarray) -> bytes:
    at, parts = 0, []
    for low, high in runs.tolist():
        parts.append(body[at:low])
        at = high
    parts.append(body[at:])
    return b"".join(parts)


def removals(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans, kept_sha256.

    ``spans`` lists the maximal removed runs as byte offsets.
    """
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<low:long,high:long>>, kept_sha256 string"
    span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body", 8_000_000):
            rows = []
            for doc_id, body, spans in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("spans").to_pylist()):
                body = body.as_py()
                runs = _merged(spans or [], len(body))
                sha = hashlib.sha256(_kept(body, runs)).hexdigest()
                removed = int((runs[:, 1] - runs[:, 0]).sum())
                rows.append((doc_id, len(body), removed, len(runs), [{"low": a, "high": b} for a, b in runs.tolist()], sha))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
            )

    rows = _with_spans(docs, window, id_col, text_col)
    out = rows.select(F.col("row")[id_col].cast("long").alias("doc_id"), "body", "spans").mapInArrow(run, kind)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def without_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input rows and columns, the text without its repeated passages.

    A removed run is narrowed to whole characters. A null text stays null.
    """
    @F.pandas_udf(T.StringType())
    def shortened(body, spans):
        def one(data, found):
            runs = _merged(list(found) if found is not None else [], len(data))
            for run in runs:
                while run[0] < run[1] and run[0] < len(data) and data[run[0]] & 0xC0 == 0x80:
                    run[0] += 1
                while run[1] > run[0] and run[1] < len(data) and data[run[1]] & 0xC0 == 0x80:
                    run[1] -= 1
            return _kept(data, runs).decode("utf-8")

        import pandas as pd

        return pd.Series([one(b, s) for b, s in zip(body, spans)], dtype=object)

    rows = _with_spans(docs, window, id_col, text_col)
    text = F.when(F.col("spans").isNotNull(), shortened("body", "spans")).otherwise(F.col("row")[text_col])
    return rows.select("row", text.alias("text")).select(
        *[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    )
