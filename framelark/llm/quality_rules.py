"""Quality rules: counts over a whole text, then line sequence labelling.

Base counts (words, symbols, duplicate lines, repeated three-word windows) are
exact.  The verdict comes from a linear-chain conditional random field: every
line with a word gets binary features of its shape, Viterbi decoding finds the
most likely sequence of the labels boilerplate and content, and the share of
word characters in content lines decides whether the document stays.

The field is trained in numpy by gradient steps on the exact log-likelihood
(forward-backward).  At most ``PER_CLASS`` labelled documents of each class are
used, those with the least hash of their id, with all their lines, cut into
sequences of ``TRAIN_LINES`` lines.  Labels are those of lines, not of documents.
Boilerplate are lines that recur in ``RECURS`` or more of these documents (copies of
a document count once), runs of short lines without a stop, lines of items between
bars, shouted lines and those rich in symbols.  Other lines of good documents are
content.  Other lines of bad ones are hidden: a first field, fitted with all of
them as boilerplate, decodes them with just the bias that makes half of the
document boilerplate, and the field is fitted again to what it found, so that its
transitions come from changes within documents.

Defined results: null and empty text have zero counts and fail the base rules;
without labelled rows every line is content; ties in Viterbi go to content;
equal texts give equal rows and repeated rows stay rows; texts of any length are
taken whole; an empty table gives an empty result; other columns are ignored by
``apply`` and kept by ``accept``.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, slices
from .shingles import SPACE, mix64, word_bounds, word_hashes

PER_CLASS = 400
TRAIN_LINES = 48
STEPS = 150
LEAST_SHARE = 0.5
#: Sampled documents in which a line is boilerplate, and short lines in a row that are.
RECURS = 3
RUN, SHORT_LINE = 3, 3
MIN_WORDS = 50

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOLS = SYMBOLS.decode()
_BARS = frozenset("|»›·•/>-")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_U = np.uint64
_IS = {name: np.zeros(256, dtype=bool) for name in ("symbol", "digit", "upper", "lower", "wide", "stop", "mark", "start")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["digit"][48:58] = True
_IS["upper"][65:91] = True
_IS["lower"][97:123] = True
_IS["wide"][128:] = True
_IS["stop"][list(b".!?;:")] = True
_IS["mark"][list(b"!\"'(),-./:;?[]{}_~^`@=+\\")] = True
_IS["start"][:128] = True
_IS["start"][192:] = True

#: Edges that cut each measure of a line into bins.
EDGES = {
    "words": (2, 4, 8, 16, 32, 64, 128),
    "word_length": (2.5, 3.5, 4.5, 6, 8, 12),
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.2),
    "digits": (0.001, 0.05, 0.15, 0.4),
    "upper": (0.02, 0.06, 0.2, 0.5),
    "marks": (0.005, 0.02, 0.05, 0.1, 0.2),
    "same_word": (0.01, 0.05, 0.2, 0.5),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "repeated": (0.01, 0.1, 0.3, 0.6),
}
_BASE = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
#: One-hot bins, then: equals an earlier line, ends in a stop, first, last, constant.
N_FEATURES = int(_BASE[-1]) + 5
ACTIVE = len(EDGES) + 5


class Field(NamedTuple):
    emit: np.ndarray  # (N_FEATURES + 1, 2); the last row is for features that are off
    step: np.ndarray  # (2, 2)


NO_FIELD = Field(np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2)))


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def _covered(words: np.ndarray) -> np.ndarray:
    """Which words lie in a three-word window that the text has twice or more."""
    covered = np.zeros(len(words), dtype=bool)
    if len(words) < 4:
        return covered
    three = mix64(mix64(mix64(words[:-2] + _U(1)) ^ words[1:-1]) * _U(0x9FB21C651E98DF25) ^ words[2:])
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    again = np.zeros(len(three), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    for j in range(3):
        covered[j : j + len(three)] |= again
    return covered


def measure(text: str | None) -> tuple[Counts, np.ndarray, np.ndarray]:
    """-> counts, (lines, ACTIVE) feature numbers, word characters of each line.
    Only lines with a word take part."""
    raw_text = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(raw_text, dtype=np.uint8)
    words = word_hashes(raw_text, fold=False)
    if not len(words):
        return Counts(0, 0, 0, 0, 0), np.empty((0, ACTIVE), dtype=np.int64), np.empty(0)
    starts, ends = word_bounds(raw)
    covered = _covered(words)
    letter = _IS["start"][raw] & ~SPACE[raw]
    line_ends = np.r_[np.flatnonzero(raw == 10), len(raw)]
    line_of = np.searchsorted(line_ends, starts)  # words never hold a line feed
    with_word, first = np.unique(line_of, return_index=True)
    begin = np.r_[0, line_ends[:-1] + 1][with_word]
    stop = line_ends[with_word]
    seen: set[bytes] = set()
    dup = np.zeros(len(with_word), dtype=bool)
    for i, (a, b) in enumerate(zip(begin.tolist(), stop.tolist())):
        line = raw_text[a:b]
        dup[i] = line in seen
        seen.add(line)
    sums = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][np.stack([begin, stop])], axis=0)[0].astype(np.float64)
    chars = sums(letter)
    symbols = sums(_IS["symbol"][raw])
    counts = Counts(len(words), int(letter.sum()), int(_IS["symbol"][raw].sum()), int(dup.sum()), int(covered.sum()))
    n = np.diff(np.r_[first, len(words)]).astype(np.float64)
    upper, lower = sums(_IS["upper"][raw]), sums(_IS["lower"][raw])
    same_word = np.add.reduceat(np.r_[False, words[1:] == words[:-1]], first).astype(np.float64)
    keyed = mix64(words ^ (line_of.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    _, at = np.unique(keyed, return_index=True)
    distinct = np.bincount(np.searchsorted(with_word, line_of[at]), minlength=len(with_word)).astype(np.float64)
    values = {
        "words": n, "word_length": chars / n, "symbols": symbols / chars, "digits": sums(_IS["digit"][raw]) / chars, "upper": upper / np.maximum(upper + lower, 1),
        "marks": sums(_IS["mark"][raw]) / chars, "same_word": same_word / n, "distinct": distinct / n, "repeated": np.add.reduceat(covered, first).astype(np.float64) / n,
    }
    off = N_FEATURES
    made = np.full((len(with_word), ACTIVE), off, dtype=np.int64)
    for i, (name, edges) in enumerate(EDGES.items()):
        made[:, i] = _BASE[i] + np.searchsorted(edges, values[name], side="right")
    flags = int(_BASE[-1])
    last_byte = raw[ends[np.r_[first[1:], len(words)] - 1] - 1]
    made[:, -5] = np.where(dup, flags, off)
    made[:, -4] = np.where(_IS["stop"][last_byte], flags + 1, off)
    made[0, -3], made[-1, -2] = flags + 2, flags + 3
    made[:, -1] = flags + 4
    return counts, made, chars


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best sequence of two labels; scores: (lines, 2).  Ties go to label 1."""
    back = np.zeros((len(scores), 2), dtype=np.int8)
    (s00, s01), (s10, s11) = step.tolist()
    zero, one = scores[0].tolist()
    for i, (e0, e1) in enumerate(scores[1:].tolist(), 1):
        a, b, c, d = zero + s00, one + s10, zero + s01, one + s11
        back[i] = b >= a, d >= c
        zero, one = max(a, b) + e0, max(c, d) + e1
    best = np.empty(len(scores), dtype=np.int8)
    best[-1] = one >= zero
    for i in range(len(scores) - 1, 0, -1):
        best[i - 1] = back[i, best[i]]
    return best


def content_share(lines: np.ndarray, chars: np.ndarray, field: Field) -> float:
    """Share of word characters in lines that are decoded as content; 0 without lines."""
    if not len(lines):
        return 0.0
    best = viterbi(field.emit[lines].sum(axis=1), field.step)
    return float(chars[best == 1].sum() / chars.sum())


def train(sequences: list[np.ndarray], labels: list[np.ndarray]) -> Field:
    """Maximum likelihood with a small ridge; sequences: (lines, ACTIVE) feature numbers."""
    if not sequences:
        return NO_FIELD
    n, most = len(sequences), max(map(len, sequences))
    x = np.full((n, most, ACTIVE), N_FEATURES, dtype=np.int64)
    y = np.zeros((n, most), dtype=np.int64)
    live = np.zeros((n, most), dtype=bool)
    for i, (s, t) in enumerate(zip(sequences, labels)):
        x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = s, t, True
    weight = np.zeros(n)
    most_of = np.array([t.mean() >= 0.5 for t in labels])
    for k in (0, 1):  # sequences of both kinds count alike
        own = most_of == bool(k)
        weight[own] = 0.5 / max(1, live[own].sum())
    emit, step = np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2))
    first, second = [np.zeros_like(emit), np.zeros_like(step)], [np.zeros_like(emit), np.zeros_like(step)]
    truth = np.eye(2)[y] * live[..., None]
    pairs = np.einsum("nli,nlj,nl,n->ij", np.eye(2)[y[:, :-1]], np.eye(2)[y[:, 1:]], live[:, 1:].astype(float), weight)
    for it in range(1, STEPS + 1):
        score = emit[x].sum(axis=2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, most):
            into = ahead[:, t - 1, :, None] + step[None]
            ahead[:, t] = np.where(live[:, t, None], np.logaddexp(into[:, 0], into[:, 1]) + score[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            out = step[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp(out[..., 0], out[..., 1]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        margin = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        both = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        wrong = (margin - truth) * weight[:, None, None]
        g_emit = np.zeros_like(emit)
        for k in (0, 1):
            g_emit[:, k] = sum(np.bincount(x[:, :, a].ravel(), wrong[:, :, k].ravel(), N_FEATURES + 1) for a in range(ACTIVE))
        g_emit[-1] = 0
        g_step = np.einsum("nlij,n->ij", both, weight) - pairs
        for k, (w, g) in enumerate(((emit, g_emit + 1e-4 * emit), (step, g_step + 1e-2 * step))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w -= 0.1 * (first[k] / (1 - 0.9**it)) / (np.sqrt(second[k] / (1 - 0.99**it)) + 1e-8)
    return Field(emit, step)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, quality of the training documents.  Ids are ranked, not texts."""
    rows = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    chosen = {r.doc_id: r.quality for r in least_by_hash(rows, "quality", per_class).collect()}
    found = docs.where(F.col("doc_id").isin(list(chosen)) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))  # one text of a repeated id
    good = [i for i, q in chosen.items() if q == 1]
    return found.withColumn("quality", F.col("doc_id").isin(good).cast("int"))


def line_marks(text: str | None) -> tuple[list[int], list[bool]]:
    """Of every line with a word: a hash of its words, and whether its own shape or that of its run is boilerplate's."""
    held = [w for line in (text or "").split("\n") if (w := [x for x in _GAP.split(line) if x])]
    keys = [zlib.crc32(" ".join(w).encode("utf-8", "surrogatepass")) << 20 | min(len(" ".join(w)), (1 << 20) - 1) for w in held]
    plain = []
    short = [len(w) <= SHORT_LINE and w[-1][-1] not in ".!?;:" for w in held]
    for w in held:
        line = "".join(w)
        letters = [c for c in line if c.isalpha()]
        bars = sum(x in _BARS for x in w)
        plain.append(10 * sum(c in _SYMBOLS for c in line) > len(line) or bars >= 2 and 2 * bars + 1 >= len(w) / 2 or len(letters) >= 10 and not any(c.islower() for c in letters) and any(c.isupper() for c in letters))
    at = 0
    while at < len(held):
        end = at
        while end < len(held) and short[end]:
            end += 1
        if end - at >= RUN:
            plain[at:end] = [True] * (end - at)
        at = end + 1
    return keys, plain


def recurring(documents: list[list[int]]) -> set[int]:
    """Line keys that ``RECURS`` or more documents hold.  A document most of whose
    lines were seen before is taken for a copy and not counted."""
    held: dict[int, int] = {}
    for keys in documents:
        own = set(keys)
        if 2 * sum(k in held for k in own) > len(own) and len(own) > 2:
            continue
        for k in own:
            held[k] = held.get(k, 0) + 1
    return {k for k, n in held.items() if n >= RECURS}


def bad_labels(lines: np.ndarray, chars: np.ndarray, sure: np.ndarray, field: Field) -> np.ndarray:
    """Labels of the lines of a bad document: boilerplate where ``sure``, elsewhere decoded
    with the least of some biases that makes half of its characters boilerplate."""
    scores = field.emit[lines].sum(axis=1)
    scores[sure, 0] += 1e6
    for bias in (0, 1, 2, 4, 8, 16, 32):
        moved = scores.copy()
        moved[:, 0] += bias
        best = viterbi(moved, field.step).astype(np.int64)
        if 2 * chars[best == 0].sum() >= chars.sum():
            return best
    return np.zeros(len(lines), dtype=np.int64)


class Sampled(NamedTuple):
    quality: int
    lines: np.ndarray
    chars: np.ndarray
    keys: list[int]
    plain: np.ndarray


def learn(documents: list[Sampled]) -> Field:
    """The field of labelled documents."""
    often = recurring([d.keys for d in documents])
    sure = [d.plain | np.array([k in often for k in d.keys], dtype=bool) for d in documents]
    labels = [(~s).astype(np.int64) if d.quality == 1 else np.zeros(len(s), dtype=np.int64) for d, s in zip(documents, sure)]
    cut = lambda rows: [r[a : a + TRAIN_LINES] for r in rows for a in range(0, len(r), TRAIN_LINES)]
    sequences = cut([d.lines for d in documents])
    field = train(sequences, cut(labels))
    again = [t if d.quality == 1 or not len(t) else bad_labels(d.lines, d.chars, s, field) for d, s, t in zip(documents, sure, labels)]
    if all((a == t).all() for a, t in zip(again, labels)):
        return field
    return train(sequences, cut(again))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    def run(batches):
        for part in slices(batches, text="text"):
            rows = []
            for i, q, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "quality", "text"))):
                _, lines, chars = measure(text)
                rows.append((i, q, lines.ravel().tolist(), chars.tolist(), *line_marks(text)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "quality", "lines", "chars", "keys", "plain"])

    rows = labelled_sample(docs, labels).mapInArrow(run, "doc_id long, quality int, lines array<short>, chars array<double>, keys array<long>, plain array<boolean>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lines))
    return learn([Sampled(r.quality, np.array(r.lines, dtype=np.int64).reshape(-1, ACTIVE), np.array(r.chars), r.keys, np.array(r.plain, dtype=bool)) for r in rows])


def judge(text: str | None, field: Field) -> tuple[Counts, float, bool]:
    """counts, content share, kept."""
    counts, lines, chars = measure(text)
    if counts.base_failed:
        return counts, content_share(lines, chars, field), False
    share = content_share(lines, chars, field)
    return counts, share, share >= LEAST_SHARE


def apply(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""

    def run(batches):
        for part in slices(batches, text="text"):
            rows = [judge(t, field) for t in part.column("text").to_pylist()]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(5)]
            rest = [pa.array([r[0].base_failed for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, *rest], ["doc_id", *Counts._fields, "base_failed", "kept", "content_share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + "".join(f"{c} long, " for c in Counts._fields) + "base_failed boolean, kept boolean, content_share double")


def accept(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` that stay; all columns kept."""
    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches, text="text"):
            yield part.filter(pa.array([judge(t, field)[2] for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
