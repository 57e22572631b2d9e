"""Quality classifier: random Fourier features, ridge, isotonic calibration.

A document becomes ``STATISTICS`` numbers about its whole text.  Scaled by the
mean and deviation of the learning rows, they are mapped to ``FEATURES``
random cosines, whose inner products approximate a Gaussian kernel.  Each of
``FIT_PARTITIONS`` tasks streams its labelled rows into one pair of normal
equations; the driver adds that fixed number of small matrices and solves
the ridge system, classes weighted alike.  Labelled rows that the ridge has not
seen fill a histogram of raw scores, on which pool-adjacent-violators gives the
monotone map from raw score to the probability of label 1.

Defined results: null and empty texts have statistics of their own (zeros)
and get a score like any other; every pair of a text and a label of its id counts
once, so an id with k texts and m labels counts k * m times; labels other than 0 and 1
don't count; without labelled rows every score is 0.5; equal texts get
equal scores and repeated rows stay rows; texts of any length are measured whole; an
empty table gives an empty result; other columns are ignored; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, slices
from .quality_rules import _IS
from .shingles import SPACE, mix64, word_hashes

FEATURES = 128
FIT_PARTITIONS = 32
RIDGE = 1e-3
BINS = 512
LOW, HIGH = -0.5, 1.5
THRESHOLD = 0.7
#: Share of the raw score in the result: it orders rows that the calibration maps alike.
RAW_SHARE = 0.01

STATISTICS = (
    "log_words", "word_length", "log_lines", "line_words", "symbols", "digits", "upper", "marks", "stops", "wide",
    "same_word", "distinct", "repeated_pairs", "lines_with_stop", "spaces",
)
_U = np.uint64


def statistics(text: str | None) -> np.ndarray:
    raw_text = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(raw_text, dtype=np.uint8)
    words = word_hashes(raw_text)
    if not len(words):
        return np.zeros(len(STATISTICS))
    n = len(words)
    tally = np.bincount(raw, minlength=256)
    count = lambda name: float(tally[_IS[name]].sum())
    chars = float((tally * (_IS["start"] & ~SPACE)).sum())
    letters = max(1.0, count("upper") + count("lower") + count("wide"))
    lines = float(tally[10]) + 1
    ends = np.r_[np.flatnonzero(raw == 10), len(raw)] - 1
    pairs = mix64(words[:-1] * _U(3) ^ words[1:])
    return np.array([
        np.log1p(n), chars / n, np.log1p(lines), np.log1p(n / lines), count("symbol") / chars, count("digit") / chars, count("upper") / letters,
        count("mark") / chars, count("stop") / n, count("wide") / len(raw), float((words[1:] == words[:-1]).sum()) / n,
        len(np.unique(words)) / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)), float(_IS["stop"][raw[ends[ends >= 0]]].sum()) / lines, float(tally[SPACE].sum()) / len(raw),
    ])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every whole text, materialised."""

    def run(batches):
        for part in slices(batches, text="text"):
            rows = [statistics(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>"))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    #: Knots of the calibration: raw scores, probabilities.
    raw: np.ndarray
    probability: np.ndarray


def _directions(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    return rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


_WAVES, _SHIFT = _directions()


def lift(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(n, STATISTICS) -> (n, FEATURES + 1): cosines and a constant."""
    scaled = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(scaled @ _WAVES + _SHIFT), np.ones((len(stats), 1))])


def pool(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates closest to positives / counts."""
    blocks: list[list[float]] = []
    for c, p in zip(counts.tolist(), positives.tolist()):
        blocks.append([c, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c1, p1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c1, blocks[-1][1] + p1, blocks[-1][2] + n1]
    return np.concatenate([np.full(int(n), p / c if c else 0.5) for c, p, n in blocks]) if blocks else np.empty(0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    """Train on the labelled rows for which ``learn`` (over doc_id) holds; None without any."""
    own = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("of"), "quality")
    rows = stats.where(F.lit(True) if learn is None else learn).join(own, F.col("doc_id") == F.col("of"))
    rows = cut(rows.select("stats", F.col("quality").cast("double").alias("quality"), (F.crc32(F.concat(F.lit("calibrate:"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0).alias("held")))
    parts = range(len(STATISTICS))
    said = rows.agg(F.count("*").alias("n"), F.sum("quality").alias("p"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in parts], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in parts]).first()
    if not said.n:
        return None
    mean = np.array([said[f"m{i}"] for i in parts])
    scale = np.array([said[f"s{i}"] for i in parts])
    scale[scale < 1e-9] = 1.0
    balance = {1.0: said.n / (2 * max(1.0, said.p)), 0.0: said.n / (2 * max(1.0, said.n - said.p))}
    size = FEATURES + 1

    def add(batches):
        left, right = np.zeros((size, size)), np.zeros(size)
        for part in slices(batches, rows=4096):
            x = lift(_matrix(part), mean, scale)
            y = part.column("quality").to_numpy()
            w = np.where(y > 0.5, balance[1.0], balance[0.0])
            left += (x * w[:, None]).T @ x
            right += x.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([left.ravel().tolist()]), pa.array([right.tolist()])], ["left", "right"])

    train = rows.where("not held")
    sums = train.repartition(FIT_PARTITIONS).mapInArrow(add, "left array<double>, right array<double>").collect()
    left = sum((np.array(s.left) for s in sums), np.zeros(size * size)).reshape(size, size)
    right = sum((np.array(s.right) for s in sums), np.zeros(size))
    total = max(1.0, left[-1, -1])
    weight = np.linalg.solve(left / total + RIDGE * np.eye(size), right / total)

    def score(batches):
        for part in slices(batches, rows=4096):
            raw = lift(_matrix(part), mean, scale) @ weight
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), part.column("quality")], ["bin", "quality"])

    bins = rows.where("held").mapInArrow(score, "bin long, quality double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("p")).orderBy("bin").collect()
    if not bins:
        return Model(mean, scale, weight, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    n, p = (np.array([b[k] for b in bins], dtype=np.float64) for k in ("n", "p"))
    knots = LOW + (np.array([b.bin for b in bins]) + 0.5) / BINS * (HIGH - LOW)
    return Model(mean, scale, weight, knots, pool(n, p))


def score(stats: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of ``measured``."""

    def run(batches):
        for part in slices(batches, rows=4096):
            if model is None:
                made = np.full(part.num_rows, 0.5)
            else:
                raw = lift(_matrix(part), model.mean, model.scale) @ model.weight
                made = (1 - RAW_SHARE) * np.clip(np.interp(raw, model.raw, model.probability), 0, 1) + RAW_SHARE * np.clip((raw - LOW) / (HIGH - LOW), 0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made), pa.array((made >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from all labelled rows but those whose id's remainder by 4 is 2, score all."""
    stats = measured(docs)
    held = remainder(F.col("doc_id"), 4) == 2
    model = fit(stats, labels, ~held)
    return score(stats, model).select("doc_id", held.alias("held_out"), "score", "predicted")
