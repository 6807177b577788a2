"""Language identification with a convolutional network over bytes.

The text is read as UTF-8 bytes with A-Z lowered, cut into windows of ``WINDOW`` bytes (the
last one padded; texts are never shortened).  Filters of widths 2, 3 and 4 over a byte
embedding, a rectifier, the maximum over the window and a softmax layer give each window's
language; a text has the mean of its windows.  Training is plain numpy with Adam.  For use,
embedding and filters are folded into tables indexed by byte pairs, so that a filter
response is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.shared import beside
from tidemark.llm.textblock import LOWER, TextBlock, blocks, plain

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Rows drawn for training, per language; steps of training, each on 64 windows.
SAMPLE = 400
STEPS = 1200
UNKNOWN = "und"
#: The pipeline rejects texts below this score, and those without a letter.
KEEP = 0.5

_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    languages: list[str]
    pair: np.ndarray  # [65536, filters of all widths]: response of the first two bytes of a filter
    third: np.ndarray  # [256, FILTERS]: third byte of the filters of width 3
    rest: np.ndarray  # [65536, FILTERS]: third and fourth byte of those of width 4
    out: np.ndarray
    bias: np.ndarray

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Class probabilities of windows [n, WINDOW] of lowered bytes."""
        f = FILTERS
        code = data[:, :-1].astype(np.int32) * 256 + data[:, 1:]
        pooled = np.empty((len(data), 3 * f), np.float32)
        for begin in range(0, len(data), 256):
            c, d = code[begin : begin + 256], data[begin : begin + 256]
            r = self.pair[c]
            p = pooled[begin : begin + 256]
            p[:, :f] = r[:, :, :f].max(1)
            p[:, f : 2 * f] = (r[:, :-1, f : 2 * f] + self.third[d[:, 2:]]).max(1)
            p[:, 2 * f :] = (r[:, :-2, 2 * f :] + self.rest[c[:, 2:]]).max(1)
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def texts(self, block: TextBlock) -> np.ndarray:
        """Mean window probabilities of each text; zeros for an empty one."""
        data, owner, weight = cut(block)
        if not len(data):
            return np.zeros((block.n, len(self.languages)))
        p = self.windows(data) * weight[:, None]
        total = np.stack([np.bincount(owner, p[:, k], minlength=block.n) for k in range(p.shape[1])], 1)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def cut(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts [n, WINDOW], the text of each and its bytes of text."""
    count = -(-block.lengths // WINDOW)
    owner = np.repeat(np.arange(block.n), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = block.offsets[owner] + inner * WINDOW
    used = np.minimum(WINDOW, block.offsets[owner + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    data = LOWER[block.data[np.minimum(at, max(len(block.data) - 1, 0))]] if len(block.data) else np.zeros((0, WINDOW), np.uint8)
    return np.where(inside, data, np.uint8(0)), owner, used.astype(float)


def fit(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, label: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 5) -> ByteNet:
    """Trains on texts: ``data`` has the lowered bytes, text i those from ``starts[i]``.

    Each step draws texts, every language as often as any other, and a window of each, so all
    bytes of a text can be learned from.
    """
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS
    w = {"e": rng.normal(0, 0.5, (256, EMBED)), "o": rng.normal(0, 0.3, (3 * f, k)), "b": np.zeros(k)}
    w |= {f"c{n}": rng.normal(0, 0.5 / np.sqrt(n), (n * EMBED, f)) for n in WIDTHS}
    w |= {f"d{n}": np.zeros(f) for n in WIDTHS}
    w = {name: x.astype(np.float32) for name, x in w.items()}
    first = {name: np.zeros_like(x) for name, x in w.items()}
    second = {name: np.zeros_like(x) for name, x in w.items()}
    count = np.bincount(label, minlength=k)
    by_language, edge = np.argsort(label, kind="stable"), np.cumsum(count) - count
    for step in range(1, steps + 1):
        language = rng.integers(0, k, 64)
        pick = by_language[edge[language] + (rng.random(64) * count[language]).astype(np.int64)]
        inner = (rng.random(64) * -(-lengths[pick] // WINDOW)).astype(np.int64) * WINDOW
        used = np.minimum(lengths[pick] - inner, WINDOW)
        at = (starts[pick] + inner)[:, None] + np.arange(WINDOW)
        x = np.where(np.arange(WINDOW) < used[:, None], data[np.minimum(at, len(data) - 1)], np.uint8(0))
        y, n = label[pick], 64
        embedded = w["e"][x]
        pools, places, views = [], [], []
        for width in WIDTHS:
            view = np.concatenate([embedded[:, j : WINDOW - width + 1 + j] for j in range(width)], 2)
            z = view @ w[f"c{width}"] + w[f"d{width}"]
            places.append(z.argmax(1))
            pools.append(z.max(1))
            views.append(view)
        pooled = np.concatenate(pools, 1)
        hidden = np.maximum(pooled, 0)
        z = hidden @ w["o"] + w["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        error = z / z.sum(1, keepdims=True)
        error[np.arange(n), y] -= 1
        error = (error / n).astype(np.float32)
        grad = {name: np.zeros_like(v) for name, v in w.items()}
        grad["o"], grad["b"] = hidden.T @ error, error.sum(0)
        back = (error @ w["o"].T) * (pooled > 0)
        for i, width in enumerate(WIDTHS):
            g, best = back[:, i * f : (i + 1) * f], places[i]
            chosen = views[i][np.arange(n)[:, None], best]  # [n, filters, width * EMBED]
            grad[f"c{width}"] = np.einsum("nfe,nf->ef", chosen, g)
            grad[f"d{width}"] = g.sum(0)
            down = (g[:, :, None] * w[f"c{width}"].T[None]).reshape(n, f, width, EMBED)
            for j in range(width):
                np.add.at(grad["e"], x[np.arange(n)[:, None], best + j], down[:, :, j])
        for name in w:
            first[name] = 0.9 * first[name] + 0.1 * grad[name]
            second[name] = 0.99 * second[name] + 0.01 * grad[name] ** 2
            w[name] = w[name] - np.float32(0.01) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
    return _folded(w, languages)


def _folded(w: dict[str, np.ndarray], languages: list[str]) -> ByteNet:
    single = {(n, j): (w["e"] @ w[f"c{n}"][j * EMBED : (j + 1) * EMBED]) for n in WIDTHS for j in range(n)}
    two = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
    pair = np.concatenate([two(single[n, 0] + w[f"d{n}"], single[n, 1]) for n in WIDTHS], 1)
    to = np.float32
    return ByteNet(languages, pair.astype(to), single[3, 2].astype(to), two(single[4, 2], single[4, 3]).astype(to), w["o"].astype(to), w["b"].astype(to))


def held_out() -> F.Column:
    return F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")


def train(docs: DataFrame, sample: int = SAMPLE) -> ByteNet | None:
    """Learns every value of lang from at most ``sample`` rows of each, drawn by a hash of id and text.

    Only rows with a text, a lang and an id outside the held-out quarter are read.  Rows alike in
    id, lang and text count once.  None if there is no such row.
    """
    usable = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0 AND doc_id IS NOT NULL").filter(~held_out())
    key = usable.withColumn("draw", F.xxhash64("doc_id", "text", F.lit(11)))
    # The least draws of each language are found where the rows lie, before any shuffle, so a large language is no large group.
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    small = key.select("lang", "draw", "doc_id").groupBy("lang", "draw", "doc_id").agg(F.lit(1).alias("one"))
    drawn = small.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "draw", "doc_id")
    # At most `sample` rows a language are sent.
    rows = key.join(F.broadcast(drawn), ["lang", "draw", "doc_id"]).groupBy("lang", "draw", "doc_id").agg(F.first("text").alias("text"))
    table = rows.orderBy("lang", "draw", "doc_id").select("text", "lang").toArrow()
    if not table.num_rows:
        return None
    langs = table["lang"].to_pylist()
    languages = sorted(set(langs))
    index = {x: i for i, x in enumerate(languages)}
    texts = plain(table["text"])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)]
    return fit(data, offsets[:-1], np.diff(offsets), np.array([index[x] for x in langs], int), languages)


ADDED = {"lang_pred": "string", "score": "double"}


def predict(docs: DataFrame, model: ByteNet | None, carry: list[str], column: str = "text") -> DataFrame:
    """Adds lang_pred and score (the mean probability of that language) to the ``carry`` columns.

    ``und`` with score 0 where the text is null, empty, or holds no letter, or where nothing
    was learned.  Ties go to the language first in order of its name.  Equal rows get equal
    results, an empty table gives none, and a carried column with the name of an added one is
    replaced by it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        net = sent.value
        for begin, end, block in blocks(texts):
            letters = np.array([_LETTER.search(t) is not None for t in texts.slice(begin, end - begin).to_pylist()], bool)
            if net is None:
                names, score = [UNKNOWN] * (end - begin), np.zeros(end - begin)
            else:
                p = net.texts(block)
                best = p.argmax(1)
                names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield begin, end, [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    return beside(docs, carry, column, ADDED, judge)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs), ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
