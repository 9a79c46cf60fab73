"""Best-fit packing of documents into fixed token budgets by the sum-of-squares rule.

Every document becomes its token ids plus a closing id 0; one longer than a sequence is cut into
pieces. Full pieces are sequences by themselves. The others are dealt over groups by a hash of their
place in the corpus, and each group is packed on its own, longest first: a piece goes where the sum,
over the residual gaps, of the squared numbers of open bins with that gap becomes smallest. Bins that
are still open are then dealt again over 1/64 of the groups and packed with each other in the same
way, so what grouping leaves open does not add up. No group or task grows with the table.

Defined cases: a null text counts as empty and is the single id 0; equal lengths are ordered by
identifier and start; repeated rows are separate documents; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, binary_parts, each_slice, release, utf8

GROUP = 65_536  # pieces packed by one task, on average
REGROUP = 64
_CLOSING = ".,!?;:*#$%&"


def _values(column: pa.Array) -> list[bytes]:
    ends, raw = binary_parts(column)
    first = int(ends[0])
    own = raw[first : int(ends[-1])].tobytes()
    cuts = (ends - first).tolist()
    return [own[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class WordIds:
    """Token ids of texts, encoding each distinct stretch between ASCII spaces once.

    This vocabulary's rules never join characters across white space, so ids of a text are the ids of
    its stretches in order. A stretch of letters alone is one word to the rules, and its last id is
    the only one that ends a word: many are encoded in one call and told apart by that mark. Trailing
    punctuation is a word of its own. What is learnt is dropped when it passes ``most`` stretches.
    """

    def __init__(self, tokenizer_path: str, most: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer_path)
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.stretches: dict[bytes, int] = {}
        self.parts: dict[bytes, int] = {b"": 0}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Append runs of ids to the store and return their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.count + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.append(a, np.zeros_like(a)) for a in (self.starts, self.sizes))
        new = slice(self.count, self.count + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[new], self.sizes[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(ids), self.count + len(sizes)
        return range(new.start, new.stop)

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)
        return self.ids[at]

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _encode_each(self, texts: list[bytes]) -> None:
        for i in range(0, len(texts), 20_000):
            some = texts[i : i + 20_000]
            found = self._encode(some)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.parts.update(zip(some, self._keep(np.fromiter(chain.from_iterable(found), np.uint32), sizes)))

    def _encode_words(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self._encode([b" ".join(some)])[0], dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self.parts.update(zip(some, self._keep(ids, np.diff(cuts, prepend=0))))
            else:
                self._encode_each(some)

    def _learn(self, new: list[bytes]) -> None:
        stretches = pa.array(new, pa.binary()).cast(pa.string())
        core = pc.utf8_rtrim(stretches, _CLOSING)
        ascii_word = pc.and_(pc.string_is_ascii(core), pc.ascii_is_alpha(core))
        # Letters beyond ASCII are left to the encoder, whose lower case is its own; one of them becomes two.
        other_word = pc.and_not(pc.and_(pc.utf8_is_alpha(core), pc.utf8_is_alpha(pc.utf8_lower(core))), pc.match_substring(core, "\u0130"))
        core = pc.if_else(ascii_word, pc.ascii_lower(core), pc.if_else(other_word, core, ""))
        cut = pc.binary_length(core).to_numpy()
        whole = pc.binary_length(stretches).to_numpy()
        tails = [b""] * len(new)
        for i in np.flatnonzero(cut < whole).tolist():
            tails[i] = new[i][cut[i] :]
        found = pc.dictionary_encode(core.cast(pa.binary()))
        cores = _values(found.dictionary)
        self._encode_words(list(set(cores) - self.parts.keys()))
        self._encode_each(list(set(tails) - self.parts.keys()))
        both = np.empty(2 * len(new), np.int64)
        both[0::2] = np.fromiter(map(self.parts.__getitem__, cores), np.int64, len(cores))[found.indices.to_numpy()]
        both[1::2] = np.fromiter(map(self.parts.__getitem__, tails), np.int64, len(new))
        sizes = self.sizes[both]
        self.stretches.update(zip(new, self._keep(self._joined(both), sizes[0::2] + sizes[1::2])))

    def of(self, texts: pa.Array | list[bytes]) -> list[np.ndarray]:
        """Token ids of each UTF-8 text."""
        if len(self.stretches) > self.most:
            self.reset()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        # Each distinct stretch is looked up once; empty ones at the ends of a text have no ids.
        found = pc.dictionary_encode(split.flatten().cast(pa.binary()))
        distinct = _values(found.dictionary)
        numbers = np.fromiter(map(self.stretches.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(new)
            numbers[unknown] = np.fromiter(map(self.stretches.__getitem__, new), np.int64, len(new))
        numbers = numbers[found.indices.to_numpy()]
        ids = self._joined(numbers)
        token_ends = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        word_ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        cuts = token_ends[word_ends]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for batch in each_slice(batches, "body", 2_000_000):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.of(batch.column("body"))):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), budget)):
                    piece = ids[start : start + budget]
                    rows.append((doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)
        words.reset()
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, in the order given."""
    open_bins = np.zeros(budget + 1, dtype=np.int64)  # by residual gap
    holders: list[list[int]] = [[] for _ in range(budget + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        before, after = open_bins[size:], open_bins[: budget + 1 - size]
        # From gap g to g - size: (N[g]-1)^2 - N[g]^2 + (N[g-size]+1)^2 - N[g-size]^2.
        change = 2 * (after - before) + 2
        change[0] = 1 - 2 * before[0]  # a full bin is no longer open
        change[before == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * after[-1] + 1 if size < budget else 0  # a new bin
        gap = size + int(change.argmin())
        if gap == budget:
            at, made = made, made + 1
        else:
            at = holders[gap].pop()
            open_bins[gap] -= 1
        if gap > size:
            holders[gap - size].append(at)
            open_bins[gap - size] += 1
        bins[i], offsets[i] = at, budget - gap
    return bins, offsets


def pack(pieces_df: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """Append sequence_id and offset to a table of pieces with doc_id, piece, start and length."""
    count = pieces_df.filter(F.col("length") < budget).count()
    groups = max(1, -(-count // GROUP))
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), budget)
        base = int(pdf["group"].iloc[0]) << 32
        return pdf.drop(columns="group").assign(doc_id=pdf["doc_id"].astype("Int64"), bin=base + bins, within=offsets)

    kept = "doc_id long, piece int, start long, length long, ids_crc32 long"
    first = pieces_df.filter(F.col("length") < budget).withColumn("group", spread)
    first = scratch.write(first.groupBy("group").applyInPandas(place, f"{kept}, bin long, within long"))
    fills = first.groupBy("bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < budget)
    again = max(1, groups // REGROUP)

    def join_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["fill"].to_numpy(), budget)
        # The merged sequence takes the number of the first bin put into it, which is unique.
        lead = pdf["bin"].to_numpy()[pd.Series(np.arange(len(pdf))).groupby(bins).transform("first")]
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "into": lead, "shift": offsets})

    moved = fills.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(again)))
    moved = moved.groupBy("group").applyInPandas(join_bins, "bin long, into long, shift long")
    placed = first.join(moved, "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("within") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    full = pieces_df.filter(F.col("length") >= budget).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents with their place: sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, tokenizer_path, budget, id_col, text_col))
    out = pack(cut, budget, scratch)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
