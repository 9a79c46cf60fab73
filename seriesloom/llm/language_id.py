"""Language identification with bit-sliced Bloom filters of character n-grams.

Cell i of the filter is a bit mask over languages: bit l is set if some n-gram of language l hashes to
i. The conjunction of an n-gram's cells therefore names, at once, all languages whose filter holds
it. Over a text, each language's share of held n-grams is counted and corrected for false positives,
whose rate follows from how full that language's filter is; the largest share decides.

A language's n-grams are those found in at least ``least_texts`` of its learning texts. Learning uses
at most ``most_rows`` texts of each language, those with the smallest hashed identifiers; prediction
reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal shares go to the language first in order; without learning texts everything is ``und``; more
than 64 languages are an error; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import binary_parts, crc_of_id, each_slice, mix, utf8

UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lower_points(body: np.ndarray) -> np.ndarray:
    return np.frombuffer(body.tobytes().decode("utf-8").lower().encode("utf-32-le"), dtype=np.uint32)


_LETTER = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters, found once in each process."""
    if not _LETTER[97]:
        for start in range(0, 0x110000, 0x1000):
            if start >= 0x32000 and start < 0xE0000:
                continue
            for c in range(start, start + 0x1000):
                if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                    _LETTER[c] = True
    return _LETTER


def gram_hashes(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams (word borders included) of all texts, and their text numbers."""
    letter = _letters()
    streams, counts = [], np.zeros(len(ends) - 1, np.int64)
    gap = np.array([32], np.uint32)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        points = _lower_points(raw[a:b])
        own = letter[points]
        if not own.any():
            continue
        points = np.where(own, points, 32).astype(np.uint32)
        keep = own | np.concatenate([[True], own[:-1]])  # one space after a run of letters
        points = np.concatenate([gap, points[keep], gap])
        if len(points) < size:
            points = np.append(points, np.repeat(gap, size - len(points)))
        streams.append(points)
        counts[k] = len(points)
    if not streams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.concatenate(streams).astype(np.uint64)
    if len(flat) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(len(flat) - size + 1, np.uint64)
    for k in range(size):
        code = code * np.uint64(0x110001) + flat[k : k + len(code)]
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[: len(code)] == owner[size - 1 :]
    return mix(code[whole]), owner[: len(code)][whole]


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray  # masks over languages
    false_rate: np.ndarray
    size: int
    probes: int

    def predict(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text (-1: unknown) and its share of all shares."""
        n = len(ends) - 1
        hashes, owner = gram_hashes(raw, ends, self.size)
        if not len(hashes) or not self.languages:
            return np.full(n, -1), np.zeros(n)
        mask = self.cells[_cells(hashes, 0, len(self.cells))]
        for probe in range(1, self.probes):
            mask &= self.cells[_cells(hashes, probe, len(self.cells))]
        grams = np.bincount(owner, minlength=n)
        shares = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            held = np.bincount(owner, (mask >> np.uint64(k)) & np.uint64(1), n)
            raw_share = held / np.maximum(grams, 1)
            shares[:, k] = np.clip((raw_share - self.false_rate[k]) / (1 - self.false_rate[k] + 1e-12), 0, 1)
        best = shares.argmax(axis=1)
        top = shares[np.arange(n), best]
        sure = np.where(top > 0, top / np.maximum(shares.sum(axis=1), 1e-12), 0)
        return np.where(grams > 0, best, -1), np.where(grams > 0, sure, 0.0)


def _cells(hashes: np.ndarray, probe: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64(probe) * _STEP) % np.uint64(cells)).astype(np.int64)


def fit(docs: DataFrame, most_rows: int = 1_500, size: int = 4, cells: int = 1 << 21, probes: int = 2, least_texts: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows whose crc32 of the identifier modulo 3 is not 1 and whose language is known.

    Every language's learning texts are folded where they lie into counted n-gram hashes; what reaches
    the driver is one mask array of ``cells`` numbers.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & (F.pmod(crc_of_id(id_col), F.lit(3)) != 1))
    known = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("key"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(65).collect())
    if len(languages) > 64:
        raise ValueError("a mask holds at most 64 languages")
    empty = Model(languages, np.zeros(cells, np.uint64), np.zeros(len(languages)), size, probes)
    if not languages:
        return empty
    order = F.xxhash64("key")
    chosen = None
    for number, lang in enumerate(languages):
        some = known.filter(F.col("lang") == lang).orderBy(order, "key").limit(most_rows)
        some = some.select("key", "lang", F.lit(number).alias("number"))
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 64 * most_rows short rows.
    chosen = F.broadcast(chosen.distinct())
    sample = docs.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), utf8(text_col).alias("body"))
    sample = sample.join(chosen, (sample["key"].eqNullSafe(chosen["key"])) & (sample["lang"] == chosen["lang"])).select("number", "body")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            hashes, owner = gram_hashes(raw, ends, size)
            if not len(hashes):
                continue
            number = batch.column("number").to_numpy()[owner]
            # Once for each text, then counted over the texts of a language.
            order = np.lexsort((owner, hashes, number))
            h, o, m = hashes[order], owner[order], number[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1]) | (m[1:] != m[:-1])
            h, m = h[new], m[new]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
            at = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[at].astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["number", "gram", "texts"]
            )

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            bits = np.uint64(1) << batch.column("number").to_numpy().astype(np.uint64)
            at = np.concatenate([_cells(hashes, p, cells) for p in range(probes)])
            cell, back = np.unique(at, return_inverse=True)
            mask = np.zeros(len(cell), np.uint64)
            np.bitwise_or.at(mask, back, np.tile(bits, probes))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], names=["cell", "mask"])

    counted = sample.mapInArrow(grams, "number int, gram long, texts long").groupBy("number", "gram").agg(F.sum("texts").alias("texts"))
    common = counted.filter(F.col("texts") >= least_texts)
    filled = common.mapInArrow(masks, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    got = filled.toPandas()  # at most ``cells`` rows
    empty.cells[got["cell"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    for k in range(len(languages)):
        full = ((empty.cells >> np.uint64(k)) & np.uint64(1)).mean()
        empty.false_rate[k] = full**probes
    return empty


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every input row."""
    # One copy of the masks for each executor, of the fixed size of the filter.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in each_slice(batches, "body"):
            best, sure = own.predict(*reversed(binary_parts(batch.column("body"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([names[k] for k in best]), pa.array(sure)], names=["doc_id", "lang_pred", "score"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    found = predictions(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
    held = (F.pmod(crc_of_id("doc_id"), F.lit(3)) == 1).alias("held_out")
    return found.select(F.col("doc_id").alias(id_col), held, "lang_pred", "score")
