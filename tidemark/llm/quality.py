"""Quality rules: base statistics of the words and a calibrated hashed n-gram classifier.

The classifier is a logistic regression over hashed words, word pairs and character n-grams
(runs of code points; each kind as relative frequencies), trained with numpy on a bounded sample of labelled
rows and calibrated with Platt scaling on rows that training did not see.  Scoring runs
in Arrow batches over whole texts against the fixed threshold ``KEEP``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import beside
from tidemark.llm.textblock import SPACE, TextBlock, _is, blocks, fmix, windows

#: Rows of training and calibration together.
SAMPLE = 2400
#: A document whose calibrated probability of good quality is below this is rejected.
KEEP = 0.5
SLOTS = 1 << 18
_GRAMS = (2, 4)
#: Mean relative frequency under which a feature counts as rare and is not scaled up further.
FLOOR = 1e-2
#: Cells of the sparse matrix that are multiplied at once.
STEP = 1 << 18
#: Bytes of texts whose features are made at once for the fit.
PIECE = 1 << 18
SYMBOL = _is(b"#*$%&|<>")


def word_index(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its text, and the index of each text's first word."""
    starts, ends = block.words()
    first = np.searchsorted(starts, block.offsets)
    return block.hashes(starts, ends), block.text_of(starts), first


def base_statistics(block: TextBlock) -> dict[str, np.ndarray]:
    hashed, owner, first = word_index(block)
    n_words = np.diff(first)
    solid = ~SPACE[block.data] & ((block.data & 0xC0) != 0x80)

    runs, at = windows(hashed, first)
    key = fmix(runs ^ (owner[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    equal = key[order][1:] == key[order][:-1]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    cover = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + 5, -1)
    repeated = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=block.n)

    breaks = block.data == 10
    begin = np.union1d(block.offsets[:-1][block.lengths > 0], np.flatnonzero(breaks) + 1)
    begin = begin[begin < len(block.data)]
    line_text = block.text_of(begin)
    stop = np.minimum(np.append(begin[1:], len(block.data)), block.offsets[line_text + 1])
    stop = np.where((stop > begin) & breaks[stop - 1], stop - 1, stop)
    used = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(~SPACE[block.data], out=used[1:])
    has = used[stop] > used[begin]
    begin, stop, line_text = begin[has], stop[has], line_text[has]
    line = fmix(block.hashes(begin, stop) ^ (line_text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    order = np.argsort(line, kind="stable")
    again = order[1:][line[order][1:] == line[order][:-1]]
    return {
        "n_words": n_words,
        "word_chars": block.count(solid),
        "n_symbols": block.count(SYMBOL[block.data]),
        "n_dup_lines": np.bincount(line_text[again], minlength=block.n),
        "n_repeat_words": repeated,
    }


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def feature_groups(block: TextBlock) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, text) of every feature, one kind after the other; slots of different kinds lie apart."""
    hashed, owner, _ = word_index(block)
    part = SLOTS // 4
    yield (hashed % np.uint64(part)).astype(np.int64), owner
    same = owner[1:] == owner[:-1]
    pair = fmix(hashed[:-1] * np.uint64(0x9FB21C651E98DF25) + hashed[1:])[same]
    yield part + (pair % np.uint64(part)).astype(np.int64), owner[1:][same]
    points, first = block.points()
    n = np.diff(first)
    text = np.repeat(np.arange(block.n), n)
    left = np.repeat(first[1:], n) - np.arange(len(points))  # characters from here to the end of the text
    for k, width in enumerate(_GRAMS):
        code = np.zeros(max(len(points) - width + 1, 0), np.uint32)
        for j in range(width):
            code = (code ^ points[j : j + len(code)]) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
        inside = left[: len(code)] >= width
        yield (2 + k) * part + ((code[inside] ^ (code[inside] >> np.uint32(15))) % np.uint32(part)).astype(np.int64), text[: len(code)][inside]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logits(self, block: TextBlock) -> np.ndarray:
        out = np.full(block.n, self.bias)
        for slot, text in feature_groups(block):
            n = np.bincount(text, minlength=block.n)
            out += np.bincount(text, self.weights[slot], minlength=block.n) / np.maximum(n, 1)
        return out

    def probability(self, block: TextBlock) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(block) + self.shift, -40, 40)))


def _rows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse matrix of relative frequencies as parts of (row, column, value), cells merged.

    Features are made of ``PIECE`` bytes at a time; parts come as from whole blocks, one kind of feature after the other.
    """
    every = pa.array(texts, pa.large_string())
    number = np.min_scalar_type(len(texts))
    for begin, end, _ in blocks(every):
        kinds: dict[int, list] = {}
        for first, _, block in blocks(every.slice(begin, end - begin), PIECE):
            for kind, (slot, text) in enumerate(feature_groups(block)):
                cell, count = np.unique(text * SLOTS + slot, return_counts=True)
                owner = cell // SLOTS
                share = (count / np.bincount(text, minlength=block.n)[owner]).astype(np.float32)
                kinds.setdefault(kind, []).append(((begin + first + owner).astype(number), (cell % SLOTS).astype(np.int32), share))
        for parts in kinds.values():
            yield from parts


def _add(total: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], to: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Adds the values of all cells to their row (``to`` 0) or column (1), in order and a few at a time: no more memory than ``STEP`` cells take."""
    for part in parts:
        for begin in range(0, len(part[0]), STEP):
            some = tuple(x[begin : begin + STEP] for x in part)
            np.add.at(total, some[to].astype(np.intp), value(*some))
    return total


def fit(texts: list[str], good: np.ndarray, epochs: int = 80) -> QualityModel:
    """Fits on four of five rows and calibrates on the fifth; both classes weigh the same."""
    y = np.asarray(good, float)
    if len(y) < 10 or y.min() == y.max():
        return QualityModel(np.zeros(SLOTS, np.float32), 0.0, 0.0, 10.0 if not len(y) or y.mean() >= 0.5 else -10.0)
    held = np.arange(len(y)) % 5 == 4
    share = max(y[~held].mean(), 1e-3)
    weight = np.where(held, 0, np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3)))
    w, b, m, v = np.zeros(SLOTS), 0.0, np.zeros(SLOTS), np.zeros(SLOTS)
    used, kept = [], []  # what is fitted, and what is calibrated on
    for part in _rows(texts):
        out = held[part[0]]
        used.append(tuple(a[~out] for a in part))
        kept.append(tuple(a[out] for a in part))
    # Common features have small relative spread; scaling by the root of their mean evens that out.
    scale = 1 / np.sqrt(_add(np.zeros(SLOTS), used, 1, lambda r, c, x: x.astype(float)) / max((~held).sum(), 1) + FLOOR)
    for step in range(1, epochs + 1):
        z = _add(np.zeros(len(y)), used, 0, lambda r, c, x: x * scale[c] * w[c]) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / (~held).sum()
        g = _add(np.zeros(SLOTS), used, 1, lambda r, c, x: x * scale[c] * error[r]) + 1e-6 * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        b -= 0.5 * error.sum()
    w *= scale
    z = _add(np.zeros(len(y)), kept, 0, lambda r, c, x: x * w[c]) + b
    slope, shift = _platt(z[held], y[held])
    return QualityModel(w.astype(np.float32), float(b), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt scaling with his smoothed targets, by Newton steps that are halved until the loss falls."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(z.std()), 1e-9)
    x = np.stack([z / spread, np.ones(len(z))])

    def loss(at: np.ndarray) -> float:
        u = at @ x
        return float((np.logaddexp(0, u) - target * u).sum() + 1e-3 * at[0] ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        grad = x @ (p - target) + [2e-3 * at[0], 0]
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
        if abs(size * move).max() < 1e-9:
            break
    return float(max(at[0], 0.0) / spread), float(at[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Trains on at most ``sample`` labelled rows, drawn by a hash of doc_id.

    Rows whose quality, id or text is null are left out; of several texts of one id, one is chosen by its hash.  Without rows of both classes the
    model keeps (or rejects) everything, as the only class seen says.
    """
    drawn = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("quality").alias("good"))
        .withColumn("draw", F.xxhash64("label_id", F.lit(7)))
        .orderBy("draw", "label_id")
        .limit(sample)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))  # at most `sample` rows
        .filter("text IS NOT NULL")
        .groupBy("draw", "doc_id")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("good").alias("good"))
        .orderBy("draw", "doc_id")
        .toArrow()
    )
    return fit(rows["text"].to_pylist(), np.asarray(rows["good"].to_pylist(), float))


ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "quality_score": "double", "kept": "boolean"}


def score(docs: DataFrame, model: QualityModel, carry: list[str], threshold: float = KEEP, column: str = "text") -> DataFrame:
    """Adds the statistics, the probability and the verdict to the ``carry`` columns of ``docs``.

    A null text counts as empty (no words: base_failed).  Rows are never merged: equal rows
    get equal verdicts, and an empty table gives an empty result.  A carried column with the
    name of an added one is replaced by it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for begin, end, block in blocks(texts):
            stats = base_statistics(block)
            failed = base_failed(stats)
            p = sent.value.probability(block)
            counts = [pa.array(stats[c], pa.int64()) for c in list(ADDED)[:5]]
            yield begin, end, [*counts, pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= threshold))]

    return beside(docs, carry, column, ADDED, judge)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), ["doc_id"])
