"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Four fixed patterns give the base spans of a text. Wider rules propose candidates that these miss: numbers
written together, national numbers, spelled-out addresses. Labelers of three sorts vote yes, no or nothing on
every candidate, base spans included: patterns of usual layouts and check rules, gazetteers of issuers,
country codes and top-level domains, and the context (cue words, neighbouring characters, other personal
data near by). Expectation-maximisation over the counts of all vote patterns of a kind estimates how
often each labeler votes how on true and on false candidates, and so the probability that a candidate is
true. A logistic classifier of votes, layout and surrounding words is trained on these probabilities; what
it holds likelier true than not is added where it overlaps neither a base span nor a longer accepted one.

The text is read once; what is written are spans, votes and features. Votes are counted over all rows
and reach the driver as at most 3 ** 7 patterns of each kind. The classifier is fitted on at most
``most_rows`` candidates of each kind, those with the smallest hashed features.

Defined cases: a null text counts as empty and has no span; repeated rows get equal results; without
candidates nothing is added; a text of any length is read whole, and time grows with its length also
where a pattern nearly matches everywhere; equal candidates go to the longer, then to the earlier kind; an
empty table gives an empty table; columns besides identifier and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, each_slice, utf8

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
BUCKETS = 1024  # features of each kind
Span = tuple[int, int, int]  # kind, start, end


# Base spans: equal to leftmost non-overlapping matches of the patterns, in time linear in the text.

_EMAIL_AT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_RUN.findall(text))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_AT.match(text, start)):
            out.append((EMAIL, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        runs = [r.span() for r in _RUN.finditer(text, m.start(), m.end())]
        for i in range(0, len(runs) - 3, 4):
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in runs[i : i + 4]):
                out.append((IP, runs[i][0], runs[i + 3][1]))
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((PHONE, *m.span()))
    return out


# Candidates beyond the base.

_AT = re.compile(r" ?@ ?| ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) ")
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )"
_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]++(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z0-9._%+-]++)*+$")
_SPELLED = re.compile(r"@|[dD][oO][tT]|[aA][tT] ?[\])}>]")
_LAST = re.compile(r"[A-Za-z]{2,24}$")
REACH = 80  # characters before an at sign in which a local part (64 at most by its standard) is looked for
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:[\[(] ?(?:\.|dot) ?[\])]|\.| dot) ?[0-9]{1,3}){3}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_AREA = re.compile(r"[0-9](?:[ ().\-/ ]{0,3}+[0-9])*+")
_CARD_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([ .\-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ .\-])[0-9]{6}\2[0-9]{5}")
_WITH_PLUS = re.compile(r"\+[0-9]{1,3}(?:[ .\-/]?\(?[0-9]{1,4}\)?){2,5}")
_WITH_ZERO = re.compile(r"\(?0[1-9][0-9]{0,4}\)?[ /.\-][0-9]{2,4}(?:[ .\-]?[0-9]{2,5}){1,4}|00[1-9][0-9]{0,2}(?:[ .\-]?[0-9]{2,4}){2,5}")
_TEN_DIGITS = re.compile(r"(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}")


def phone_layout(text: str, start: int, end: int) -> bool:
    first = text[start : start + 2].lstrip("(")[:1]
    usual = _WITH_PLUS if first == "+" else _WITH_ZERO if first == "0" else _TEN_DIGITS
    return usual.fullmatch(text, start, end) is not None


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data and satisfy what their kind demands (check digit, octets, number of digits)."""
    found: list[Span] = []
    if _SPELLED.search(text):
        for m in _AT.finditer(text):
            after = _DOMAIN.match(text, m.end())
            if not after or not _LAST.search(after.group()):
                continue
            if m.group().isspace() or m.group().strip() in ("at", "AT"):
                if " dot " not in after.group().lower():  # "at" alone is a word
                    continue
            before = _BEFORE_AT.search(text[max(0, m.start() - REACH) : m.start()])
            if before:
                found.append((EMAIL, m.start() - len(before.group()), after.end()))
    if not _DIGIT.search(text):
        return found
    for m in _DEFANGED.finditer(text):
        if all(int(x) <= 255 for x in _RUN.findall(m.group())):
            found.append((IP, *m.span()))
    if text.count(":") > 6:
        found += [(IP, *m.span()) for m in _IPV6.finditer(text)]
    for area in _AREA.finditer(text):
        if area.end() - area.start() < 9:
            continue
        runs = [r.span() for r in _RUN.finditer(text, area.start(), area.end())]
        for i, (a, _) in enumerate(runs):
            count = 0
            start = a
            if i == 0 or not text[a - 1].isdigit():
                start -= text[a - 1 : a] == "("
                start -= start > 0 and text[start - 1] == "+"
            for j in range(i, min(i + 7, len(runs))):
                count += runs[j][1] - runs[j][0]
                if count > 19:
                    break
                end = runs[j][1]
                if 13 <= count and _CARD_GROUPS.fullmatch(text, a, end) and luhn(digits_of(text[a:end])):
                    found.append((CARD, a, end))
                if 9 <= count <= 15 and phone_layout(text, start, end):
                    found.append((PHONE, start, end))
    return found


# Labelers. Word lists are fixed values, in lower case.

CUES = {
    EMAIL: ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel", "schreib", "escrib"),
    IP: ("ip", "host", "server", "login", "client", "ping", "adresse", "address", "dirección", "connect"),
    CARD: ("card", "visa", "master", "credit", "amex", "karte", "carte", "tarjeta", "pay", "charge"),
    PHONE: ("call", "phone", "tel", "mobile", "fax", "whatsapp", "sms", "anruf", "appel", "llama", "handy", "number"),
}
NOT_CUES = ("version", "isbn", "issn", "order", "invoice", "sku", "serial", "token", "key", "hash", "section", "chapter", "figure", "table", "page", "release", "build", "rfc", "id")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "example")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-689]|6(?:011|5|4[4-9]|2)")
_WORDS = re.compile(r"[^\W\d_]+")
LABELERS = ("base", "layout", "gazetteer", "cue", "neighbours", "company", "separators")


def votes(text: str, span: Span, known: bool, near: bool) -> tuple[int, ...]:
    """1 (yes), -1 (no) or 0 (abstain) of each labeler."""
    kind, start, end = span
    own = text[start:end]
    digits = digits_of(own) if kind in (CARD, PHONE) else ""
    inner = set(re.sub(r"[A-Za-z0-9]", "", own))
    if kind == EMAIL:
        layout = 1 if "@" in own or re.search(r"[\[({<] ?at", own, re.I) else 0
        ending = _LAST.search(own)
        listed = -1 if not ending else int(ending.group().lower() in DOMAINS)
        separators = -1 if "  " in own else int(own.count("@") == 1 and " " not in own)
    elif kind == IP:
        parts = _RUN.findall(own) if "." in own else []
        layout = 1 if all(p == str(int(p)) for p in parts) else -1
        listed = -1 if parts[:1] in (["0"], ["127"], ["255"]) else 0
        separators = 1 if len(inner) == 1 else 0
    elif kind == CARD:
        layout = 1 if len(digits) in (15, 16) else 0
        listed = 1 if ISSUERS.match(digits) else -1
        separators = 1 if len(inner) <= 1 else -1
    else:
        layout = 1 if own[0] == "+" or re.search(r"\([0-9]{3}\)", own) else 0
        listed = int(own[0] == "+" and any(digits.startswith(c) for c in COUNTRIES))
        separators = 1 if len(inner - set("+()")) <= 2 else -1
    left = [w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start])[-4:]]
    cue = 1 if any(w.startswith(CUES[kind]) for w in left) else -1 if left and left[-1] in NOT_CUES else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    neighbours = -1 if any(c.isalnum() or c in "_=#/" for c in around) else 1
    return int(known), layout, listed, cue, neighbours, int(near), separators


def _bucket(kind: int, what: str) -> int:
    return kind * BUCKETS + int.from_bytes(hashlib.blake2b(what.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS


def features(text: str, span: Span, vote: tuple[int, ...]) -> list[int]:
    """Active features: every vote, the layout of the span and what stands around it."""
    kind, start, end = span
    own = text[start:end]
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", re.sub(r"[A-Za-z]+", "a", own))[:60]
    left = _WORDS.findall(text[max(0, start - 40) : start])[-1:]
    right = _WORDS.findall(text[end : end + 40])[:1]
    names = [f"vote {name} {v}" for name, v in zip(LABELERS[1:], vote[1:])]  # not whether it is a base span
    names += [f"shape {shape}", f"before {text[max(0, start - 1) : start]!r}", f"after {text[end : end + 1]!r}"]
    names += [f"left {w.lower()}" for w in left] + [f"right {w.lower()}" for w in right] + ["any"]
    return sorted({_bucket(kind, n) for n in names})


FOUND = "doc_id long, kind array<int>, start array<int>, end array<int>, known array<boolean>, votes array<string>, features array<array<int>>"
_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("kind", pa.list_(pa.int32())),
        ("start", pa.list_(pa.int32())),
        ("end", pa.list_(pa.int32())),
        ("known", pa.list_(pa.bool_())),
        ("votes", pa.list_(pa.string())),
        ("features", pa.list_(pa.list_(pa.int32()))),
    ]
)


def _across(base: list[Span], span: Span) -> bool:
    """Does a base span of the same kind overlap? ``base`` is in order, and spans of a kind are disjoint."""
    i = bisect.bisect_left(base, (span[0], span[2], 0))  # the first that starts at or after the end
    return i > 0 and base[i - 1][0] == span[0] and base[i - 1][2] > span[1]


def look(text: str) -> list[tuple]:
    """kind, start, end, known, votes and features of base spans and candidates, in order."""
    base = base_spans(text)
    known = set(base)
    # What lies across a base span of its own kind is a part or a longer reading of it.
    more = [s for s in set(candidates(text)) - known if not _across(base, s)]
    spans = sorted([*base, *more], key=lambda s: (s[1], s[2], s[0]))
    out = []
    for i, span in enumerate(spans):
        beside = [s for s in spans[max(0, i - 3) : i + 4] if s[2] <= span[1] or s[1] >= span[2]]
        near = any(min(abs(s[1] - span[2]), abs(span[1] - s[2])) <= 200 for s in beside)
        vote = votes(text, span, span in known, near)
        out.append((*span, span in known, "".join("-0+"[v + 1] for v in vote), features(text, span, vote)))
    return sorted(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its base spans and candidates with votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            rows = [look(body.decode("utf-8", "replace")) for body in batch.column("body").to_pylist()]
            columns = [[[s[k] for s in row] for row in rows] for k in range(6)]
            arrays = [pa.array(c, t) for c, t in zip(columns, _FOUND.types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=_FOUND)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return slim.mapInArrow(run, FOUND)


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern's candidates are true, and the labelers' habits [truth, labeler, vote].

    Expectation-maximisation of labelers that err independently given the truth. It starts from the
    majority; each labeler counts as having been right ten times and wrong twice before, so that yes stays yes.
    """
    vote = np.array([["-0+".index(c) for c in p] for p in patterns])
    true = np.clip(0.5 + (vote - 1).sum(axis=1) / (2 * vote.shape[1]), 0.05, 0.95)
    prior = np.array([[10.0, 4.0, 2.0], [2.0, 4.0, 10.0]])
    habit = np.zeros((2, vote.shape[1], 3))
    for _ in range(rounds):
        share = 0.0
        for y, p in enumerate((1 - true, true)):
            for labeler in range(vote.shape[1]):
                habit[y, labeler] = np.bincount(vote[:, labeler], p * counts, 3) + prior[y]
                habit[y, labeler] /= habit[y, labeler].sum()
        share = ((true * counts).sum() + 5) / (counts.sum() + 10)
        odds = np.log(share / (1 - share)) + sum(np.log(habit[1, i, vote[:, i]] / habit[0, i, vote[:, i]]) for i in range(vote.shape[1]))
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(after - true).max() < 1e-9:
            break
        true = after
    return true, habit


def train(rows: list[list[int]], target: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier of active features for probabilities as targets."""
    weight = np.zeros(size)
    if not rows:
        return weight
    at = np.concatenate([np.array(r, np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pace = 4.0 / np.bincount(owner).max()
    speed = np.zeros(size)
    usual = np.maximum(np.bincount(at, minlength=size) / len(rows), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weight[at], len(rows)), -30, 30)))
        slope = np.bincount(at, (p - target)[owner], size) / len(rows) / usual + ridge * weight
        speed = 0.8 * speed - 0.2 * pace * slope
        weight += speed
    return weight


@dataclass
class Model:
    weight: np.ndarray

    def probability(self, active: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[active].sum(), -30, 30))))


def fit(found: DataFrame, most_rows: int = 20_000) -> Model:
    """Reliabilities from the votes on all candidates, then the classifier from a bounded sample of them."""
    each = found.select(F.explode(F.arrays_zip("kind", "votes", "features")).alias("c")).select("c.*")
    counted = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3 ** 7 rows
    weight = np.zeros(len(KINDS) * BUCKETS)
    for kind in range(len(KINDS)):
        own = [r for r in counted if r["kind"] == kind]
        if not own:
            continue
        true, _ = estimate([r["votes"] for r in own], np.array([r["n"] for r in own], float))
        label = {r["votes"]: t for r, t in zip(own, true)}
        some = each.filter(F.col("kind") == kind).orderBy(F.xxhash64("features"), "features", "votes").limit(most_rows).collect()
        weight += train([r["features"] for r in some], np.array([label[r["votes"]] for r in some]), len(weight))
    return Model(weight)


SPANS = "doc_id long, kind array<int>, start array<int>, end array<int>, known array<boolean>, probability array<double>"


def spans(docs: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its spans by kind and start, whether each is a base span, and how likely it is true."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(find(docs, id_col, text_col))
    # Fixed size: one weight for each feature.
    shared = docs.sparkSession.sparkContext.broadcast(fit(found, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for row in batch.select(["kind", "start", "end", "known", "features"]).to_pylist():
                if not row["kind"]:
                    rows.append([])
                    continue
                each = list(zip(row["kind"], row["start"], row["end"], row["known"], map(model.probability, row["features"])))
                rows.append(chosen(each))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
            arrays = [pa.array([[s[k] for s in row] for row in rows], pa.list_(t)) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "kind", "start", "end", "known", "probability"])

    return found.mapInArrow(run, SPANS)


def chosen(each: list[tuple]) -> list[tuple]:
    """Base spans, and of the others the likely ones that overlap nothing accepted before, longest first."""
    base = [s for s in each if s[3]]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((s[1], s[2]) for s in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    out = list(base)
    for s in sorted((s for s in each if not s[3] and s[4] >= 0.5), key=lambda s: (s[1] - s[2], s[0], s[1])):
        i = bisect.bisect_right(taken, (s[1], s[1]))
        before_free = i == 0 or taken[i - 1][1] <= s[1]
        if before_free and (i == len(taken) or taken[i][0] >= s[2]):
            taken.insert(i, (s[1], s[2]))
            out.append(s)
    return sorted(out)


def digest(docs: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans written out."""
    found = spans(docs, most_rows)
    names = F.array(*map(F.lit, KINDS))
    each = F.arrays_zip("kind", "start", "end", "known")

    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    base = F.filter(each, lambda s: s["known"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(each).alias("spans"))
