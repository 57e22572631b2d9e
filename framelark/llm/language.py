"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes (A-Z as a-z) are cut into windows of ``WINDOW`` bytes, the
last one filled up with zeros.  The network embeds bytes, convolves them with
filters of several widths, takes the maximum of each filter over the window and
ends in a softmax over the learned languages.  It is trained in numpy on
windows of labelled texts.  A text's probabilities are the mean of those of its
windows, weighted by the letters in them; every window of every text counts.

For prediction, embedding and filters are multiplied out to one table per
filter offset, and the tables of neighbouring offsets to one over byte pairs, so
that a filter costs a look-up for two bytes.

Training uses at most ``PER_LANGUAGE`` texts of each language, those with the
least hash of their id, and ``WINDOWS_PER_TEXT`` seeded windows of each.

Defined results: null text, empty text and text without a letter are ``und``
with score 0, as is every text if no labelled row exists; equal texts give
equal rows and repeated rows stay rows; languages that tie go to the first by name; an
empty table gives an empty result; other columns are ignored by ``identify`` and kept by
``accept``, which keeps every row where no label exists; labels other than the text's own
language are never read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Bounds of the training sample.
PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 6
STEPS = 700
BATCH = 96
CHUNK = 256
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Network(NamedTuple):
    languages: tuple[str, ...]
    #: Per width, an array (width, 256, FILTERS): what a byte at an offset adds to a filter.
    offsets: tuple[np.ndarray, ...]
    bias: np.ndarray
    weight: np.ndarray
    out: np.ndarray


def windows(text: bytes) -> np.ndarray:
    raw = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    count = max(1, -(-len(raw) // WINDOW))
    made = np.zeros(count * WINDOW, dtype=np.uint8)
    made[: len(raw)] = raw
    return made.reshape(count, WINDOW)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(inputs: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Network:
    """Adam on the cross-entropy of class-balanced batches.  inputs: (n, WINDOW) bytes."""
    rng = np.random.default_rng(seed)
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    total = FILTERS * len(WIDTHS)
    weights = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
        **{f"conv{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS},
        "bias": np.zeros(total), "weight": rng.normal(0, 1 / np.sqrt(total), (total, len(languages))), "out": np.zeros(len(languages)),
    }
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        truth = rng.integers(0, len(languages), BATCH)
        x = inputs[[members[k][rng.integers(len(members[k]))] for k in truth]]
        embedded = weights["embed"][x]
        pooled, seen = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            columns = np.concatenate([embedded[:, j : j + n] for j in range(w)], axis=2)
            conv = columns @ weights[f"conv{w}"]
            at = conv.argmax(axis=1)
            pooled.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
            seen.append((at, columns))
        raw = np.concatenate(pooled, axis=1) + weights["bias"]
        hidden = np.maximum(raw, 0)
        wrong = _softmax(hidden @ weights["weight"] + weights["out"])
        wrong[np.arange(BATCH), truth] -= 1
        wrong /= BATCH
        grads = {"weight": hidden.T @ wrong, "out": wrong.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
        back = (wrong @ weights["weight"].T) * (raw > 0)
        grads["bias"] = back.sum(axis=0)
        rows = np.arange(BATCH)[:, None]
        for i, w in enumerate(WIDTHS):
            at, columns = seen[i]
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            picked = columns[rows, at]  # (BATCH, FILTERS, w * EMBEDDING)
            grads[f"conv{w}"] = np.einsum("bf,bfk->kf", own, picked)
            to_embed = own[:, :, None] * weights[f"conv{w}"].T[None]
            for j in range(w):
                np.add.at(grads["embed"], x[rows, at + j], to_embed[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        rate = 0.01 * min(1.0, 3 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    offsets = tuple(np.stack([weights["embed"] @ weights[f"conv{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]) for w in WIDTHS)
    return Network(languages, offsets, weights["bias"], weights["weight"], weights["out"])


class Predictor:
    """A network with its tables over byte pairs."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.tables = []
        for offsets in net.offsets:
            w, parts = len(offsets), []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (offsets[j][:, None] + offsets[j + 1][None]).reshape(65536, FILTERS).astype(np.float32)))
            if w % 2:
                parts.append((w - 1, False, offsets[w - 1].astype(np.float32)))
            self.tables.append((w, parts))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, languages)."""
        made = []
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w, parts in self.tables:
                n = WINDOW - w + 1
                conv = None
                for j, paired, values in parts:
                    added = values.take((pairs if paired else part)[:, j : j + n], axis=0)
                    conv = added if conv is None else np.add(conv, added, out=conv)
                pooled.append(conv.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            made.append(_softmax(hidden @ self.net.weight + self.net.out))
        return np.concatenate(made)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of whole texts."""
        found: list[tuple[str, float]] = [(NO_LANGUAGE, 0.0)] * len(texts)
        cut = [(i, windows(t.encode("utf-8", "surrogatepass"))) for i, t in enumerate(texts) if t and has_letter(t)]
        if not cut or not self.net.languages:
            return found
        stack = np.concatenate([w for _, w in cut])
        each = self.probabilities(stack).astype(np.float64)
        letters = _LETTER[stack].sum(axis=1).astype(np.float64) + 1e-3
        starts = np.cumsum([0, *(len(w) for _, w in cut)])[:-1]
        mean = np.add.reduceat(each * letters[:, None], starts, axis=0) / np.add.reduceat(letters, starts)[:, None]
        for (i, _), p in zip(cut, mean):
            best = int(p.argmax())
            found[i] = self.net.languages[best], float(min(1.0, max(0.0, p[best])))
        return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """(lang, pieces of the text) of the training texts.  Only ids are ranked; the texts
    are then read by id and only the pieces leave the executors."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    ids = [r.doc_id for r in least_by_hash(rows, "lang", per_language).collect()]
    if not ids:
        return []
    length = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    pieces = F.array(*[F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id", F.lit(k)), length).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS_PER_TEXT)])
    found = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isin(ids) & F.col("text").isNotNull())
    each = found.select("doc_id", "lang", pieces.alias("pieces")).groupBy("doc_id", "lang").agg(F.min("pieces").alias("pieces"))  # one text of a repeated id
    return [(r.lang, r.pieces) for r in each.orderBy("doc_id", "lang").collect()]


def fit(docs: DataFrame, learn: Column | None = None) -> Network:
    """Train on the labelled rows of ``docs`` for which ``learn`` holds."""
    rows = sample(docs, F.lit(True) if learn is None else learn)
    inputs, labels = [], []
    languages = tuple(sorted({lang for lang, pieces in rows if any(map(has_letter, pieces))}))
    for lang, pieces in rows:
        for piece in pieces:
            if has_letter(piece):
                inputs.append(windows(piece.encode("utf-8"))[0])
                labels.append(languages.index(lang))
    if not inputs:
        return Network((), (), np.zeros(0), np.zeros(0), np.zeros(0))
    return train(np.stack(inputs), np.array(labels), languages)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def run(batches):
        model = Predictor(net)
        for part in slices(batches, text="text"):
            found = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accept(docs: DataFrame, net: Network, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose text has a language that scores ``least`` or more; all columns kept.
    Without a learned language nothing can be told and every row stays, null and letterless texts too."""
    names = docs.columns
    if not net.languages:
        return docs

    def run(batches):
        model = Predictor(net)
        for part in slices(batches, text="text"):
            good = [lang != NO_LANGUAGE and score >= least for lang, score in model.predict(part.column(names.index("text")).to_pylist())]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
