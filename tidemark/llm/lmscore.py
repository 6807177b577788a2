"""Cross-entropy difference between two n-gram models.

Both models are bigram models over all words of all documents, in lower case, and the end of a text.
The background model counts all documents, the target model those labelled as good; background
counts are scaled to the target's total, so that the smoothing of the two is matched.  A document's
score is its loss per token under the target less that under the background: the lower, the
more like the target it is.  Each row is scored with the counts of all other rows: its own are
taken off.  (A copy of its text is another row, and does count.)

With n, w and c the counts of a pair, its word and its context in the other rows, N the total, V the
number of words, u = (w + 1/2) / (N + V/2) and s the smoothing, a token's loss is

    -log((n + s * u) / (c + s)) = -log(s * u) - log(1 + n / (s * u)) + log(c + s).

All occurrences of a word go to one place, with their contexts and documents: there w, n and, for
the word as a context, c are counted and the losses follow, in one shuffle whose size follows the
texts.  The commonest words are counted beforehand, and their pairs are dealt by pair; the losses
of the commonest pairs are worked out where the text is read.  Which words and pairs these are
is found in a sample; that sets the way of a count, never its value.  Occurrences travel in blocks, as
columns of bytes, which are a third of the size of rows.  Losses are added in units of 2 ** -30, so
their sums do not depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Tables, join_hot
from tidemark.llm.textblock import TextBlock, blocks, fmix, plain

#: Weight of the unigram model in a bigram's context, in counts.
SMOOTH = 8.0
#: Labels are sent to the executors only up to this number of rows.
MOST_LABELS = 2_000_000
#: Words and pairs that are counted beforehand, at most, and one row in how many is looked at to find them.
HOT_WORDS, HOT_PAIRS, SAMPLE = 1 << 16, 1 << 18, 16
#: Times that such a word or pair is in the sample, at least.
HOT_LEAST = 4
#: Occurrences in a bucket, as expected at most, and in a block of a task before it is passed on.
BUCKET, KEEP = 1 << 20, 1 << 20
#: Occurrences that a task sends at once, in blocks.
SENT = 1 << 17
#: Words of a task whose hashes are sorted out together before they are passed on to be counted.
DISTINCT = 1 << 20
UNIT = float(1 << 30)
#: The context of a text's first word, and the word that ends a text.
START, END = np.uint64(0), np.uint64(0x9E3779B97F4A7C15)


def _tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and of each text's end, that of what stands before it, and its text; texts without a word have nothing."""
    low = block.lowered()
    starts, ends = low.words()
    word, owner = low.hashes(starts, ends), low.text_of(starts)
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    at = np.cumsum(np.append(0, 1 + last.astype(np.int64)))
    full = np.full(at[-1], END, np.uint64)
    full[at[:-1]] = word
    text = np.repeat(owner, np.diff(at))
    before = np.append(START, full[:-1])[: len(full)]
    before[np.append(True, text[1:] != text[:-1])[: len(text)]] = START
    return full, before, text


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return fmix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns]))
    return np.flatnonzero(new)


def _numbered(edge: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n sorted values, given where groups begin."""
    return np.repeat(np.arange(len(edge)), np.diff(np.append(edge, n)))


def _sent(edge: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """The spans between edges, as many at once as have about SENT values, and 256 at most: what is sent at once is there several times."""
    begin = 0
    while begin < len(edge) - 1:
        end = int(np.searchsorted(edge, edge[begin] + SENT, "right")) - 1
        end = min(max(end, begin + 1), begin + 256, len(edge) - 1)
        yield list(zip(edge[begin:end], edge[begin + 1 : end + 1], strict=True))
        begin = end


def _places(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in an ascending array, and -1 where it is not there."""
    if not len(ordered):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return np.where(ordered[at] == keys, at, -1)


def _marked(docs: DataFrame, good: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The ``columns`` of all rows, by new name, and ``_good``; a map task that is run again gives the same rows in the same order.

    Few ids are sent to all tasks. Many are joined by a shuffle, where rows without an id stay out and an id with very many
    rows is dealt to several tasks; as that join's order of rows may change, its result is read back from a table.
    """
    ids = good.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    rows = docs.select(F.col("doc_id").alias("_id"), *(F.col(c).alias(name) for name, c in columns.items()))
    flag = F.coalesce("_hit", F.lit(False)).alias("_good")
    if good.count() <= MOST_LABELS:
        return rows.join(F.broadcast(ids), "_id", "left").select(flag, *columns)
    text = next(name for name, c in columns.items() if c == "text")
    joined = join_hot(rows.filter("_id IS NOT NULL"), ids, ["_id"], [text], "left")
    both = joined.unionByName(rows.filter("_id IS NULL").withColumn("_hit", F.lit(False)))
    return Tables(docs.sparkSession).write("marked", both.select(flag, *columns))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words (kind 0) and pairs (1) of one row in SAMPLE."""
    row = TaskContext.get().partitionId()
    for batch in batches:
        texts = plain(batch.column(0))
        pick = pa.array(np.arange(-row % SAMPLE, len(texts), SAMPLE))
        row += len(texts)
        for _, _, block in blocks(texts.take(pick)):
            word, before, _ = _tokens(block)
            for kind, keys in enumerate((word, _pair(before, word))):
                key, n = np.unique(keys, return_counts=True)
                for begin in range(0, len(key), 1 << 16):
                    part = slice(begin, begin + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["kind", "key", "n"])


def _hot(flagged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words and pairs of the sample, ascending; the text's end is always among the words."""
    found = flagged.select("text").mapInArrow(_sampled, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    out = []
    for kind, most in enumerate((HOT_WORDS, HOT_PAIRS)):
        top = found.filter(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
        out.append(np.asarray(top["key"].combine_chunks() if top.num_rows else [], np.int64).view(np.uint64))
    return np.union1d(out[0], END), np.unique(out[1])


@dataclass
class NgramModels:
    """Counts of the commonest words and pairs ([2, size]: target, background), totals, and the number of words."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    mass: np.ndarray
    texts: np.ndarray
    size: float

    def scale(self) -> np.ndarray:
        """What counts are multiplied by, so that both models have the target's total."""
        return np.array([1.0, self.mass[0] / max(self.mass[1], 1)])

    def losses(self, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Parts of word and pair, [2, tokens], from counts of the other rows."""
        k = self.scale()[:, None]
        u = (w * k + 0.5) / (self.mass[0] + 0.5 * self.size)
        return -np.log(SMOOTH * u) - np.log1p(n * k / (SMOOTH * u))

    def contexts(self, c: np.ndarray) -> np.ndarray:
        return np.log(c * self.scale()[:, None] + SMOOTH)


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _buckets(docs: DataFrame) -> int:
    """Of so many that an expected BUCKET occurrences at most fall into each; a token has two bytes at least, with the space after it."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return int(max(1, size // (2 * BUCKET)))


def train(docs: DataFrame, good: DataFrame) -> NgramModels:
    """Counts all documents; ``good`` has the doc_id of the target's documents.

    What comes to the driver are the counts of at most HOT_WORDS words and HOT_PAIRS pairs, and the number of words in each bucket; all other
    counts are made where ``score`` needs them.
    """
    flagged = _marked(docs, good, {"text": "text"}).select("text", "_good")
    words, pairs = _hot(flagged)
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))
    names = ["kind", "key", "t", "b", "hashes"]
    buckets = _buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        held = np.zeros((2, len(words)), np.int64), np.zeros((2, len(pairs)), np.int64)
        total = np.zeros((2, 2), np.int64)  # tokens and texts
        seen: list[np.ndarray] = []
        kept = 0

        def rows(kind: int, key: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for begin in range(0, len(key), 1 << 16):
                part = slice(begin, begin + (1 << 16))
                many = len(key[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, kind, np.int32)), pa.array(key[part]), pa.array(counts[0][part]), pa.array(counts[1][part]), pa.nulls(many, pa.binary())], names)

        def distinct() -> Iterator[pa.RecordBatch]:
            """Each word that was seen, once, in one block for each bucket."""
            key = np.unique(np.concatenate(seen))
            bucket = (fmix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, bucket = key[order], bucket[order]
            edge = np.append(_groups(bucket), len(bucket))
            for spans in _sent(edge):
                data = [packed({"word": key[a:b]}, _WORDS) for a, b in spans]
                zero = pa.array(np.zeros(len(spans), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spans), 3, np.int32)), pa.array(bucket[[a for a, _ in spans]]), zero, zero, pa.array(data, pa.binary())], names)

        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for begin, end, block in blocks(batch.column(0)):
                word, before, text = _tokens(block)
                mine = good[begin:end][text]
                for kind, at in enumerate((_places(words, word), _places(pairs, _pair(before, word)))):
                    for k, use in enumerate((mine, slice(None))):
                        hit = at[use]
                        held[kind][k] += np.bincount(hit[hit >= 0], minlength=held[kind].shape[1])
                total[0] += mine.sum(), len(word)
                there = np.unique(text)
                total[1] += good[begin:end][there].sum(), len(there)
                seen.append(np.unique(word))
                kept += len(seen[-1])
                if kept > DISTINCT:
                    seen = [np.unique(np.concatenate(seen))]
                    kept = len(seen[0])
                    if kept > DISTINCT // 2:
                        yield from distinct()
                        seen, kept = [], 0
        for kind in (0, 1):
            some = np.flatnonzero(held[kind][1])
            yield from rows(kind, some, held[kind][:, some])
        yield from rows(2, np.arange(2), total.T.copy())
        if seen:
            yield from distinct()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the counts of one key after the other; of hashes, how many different ones there are."""
        now, total, held = None, np.zeros(2, np.int64), []
        done: list[tuple[int, int, int, int]] = []

        def close() -> None:
            if now is not None:
                t, b = (len(np.unique(np.concatenate(held))), 0) if held else total.tolist()
                done.append((*now, t, b))

        for batch in batches:
            kind, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            counts = np.stack([np.asarray(batch.column(k)) for k in (2, 3)])
            edge = np.append(_groups(kind, key), len(key))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if (kind[a], key[a]) != now:
                    close()
                    now, total, held = (kind[a], key[a]), np.zeros(2, np.int64), []
                total += counts[:, a:b].sum(1)
                held += [unpacked(x, _WORDS)["word"] for x in batch.column(4).slice(a, b - a).drop_null().to_pylist()]
                if len(held) > 64:
                    held = [np.unique(np.concatenate(held))]
            if len(done) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names[:4])
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names[:4])

    parts = flagged.mapInArrow(run, "kind int, key long, t long, b long, hashes binary").repartition("kind", "key").sortWithinPartitions("kind", "key")
    # A row for each common word and pair, and one for each bucket of words.
    table = parts.mapInArrow(add, "kind int, key long, t long, b long").toArrow()
    kind, key, t, b = (np.asarray(table[c].combine_chunks() if table.num_rows else [], np.int64) for c in names[:4])
    size = int(t[kind == 3].sum())
    out = []
    for k, n in ((0, len(words)), (1, len(pairs)), (2, 2)):
        counts = np.zeros((2, n), np.int64)
        use = kind == k
        counts[:, key[use]] = t[use], b[use]
        out.append(counts)
    return NgramModels(words, out[0], pairs, out[1], out[2][:, 0].astype(float), out[2][:, 1].astype(float), float(max(size, 1)))


#: Of each occurrence: hash of the word, of what stands before it, the row's number in its task, how often the pair is in the row, the word (0: to be counted), and whether the row is good.
_FIELDS = (("word", np.uint64), ("before", np.uint64), ("row", np.uint32), ("m", np.uint32), ("mw", np.uint32), ("good", np.uint8))
#: Of each word of a block.
_WORDS = (("word", np.uint64),)
#: Of each row of a part of a task: its number in the part, and what is added to its losses.
_SUMS = (("row", np.uint16), ("t", np.int64), ("b", np.int64))
#: Rows in a part.
PART = 1 << 16


def packed(columns: dict[str, np.ndarray], fields: tuple = _FIELDS) -> bytes:
    """Columns one after the other, each with its bytes of one significance together: equal high bytes then compress to nothing."""
    return b"".join(np.ascontiguousarray(columns[name].astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for name, kind in fields)


def unpacked(data: bytes, fields: tuple = _FIELDS) -> dict[str, np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for _, t in fields), 0, {}
    for name, kind in fields:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        at += n * width
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Each column of all parts; the parts are emptied as they are taken, so that one column at most is there twice."""
    out = {name: np.concatenate([p.pop(name) for p in parts]) for name, _ in _FIELDS}
    parts.clear()
    return out


def _bucket(x: dict[str, np.ndarray], some: slice, buckets: int) -> np.ndarray:
    word, before = x["word"][some], x["before"][some]
    key = np.where(x["mw"][some] > 0, _pair(before, word), fmix(word))
    return (key % np.uint64(buckets)).astype(np.int32)


def _at_home(models: NgramModels, block: TextBlock, good: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Number of words of each text, the losses [2, texts] that can be told here, and the other occurrences."""
    word, before, text = _tokens(block)
    sums = np.zeros((2, block.n), np.int64)
    order = np.lexsort((before, word, text))
    word, before, text = word[order], before[order], text[order]
    pair_edge, word_edge = _groups(text, word, before), _groups(text, word)
    n = len(word)
    m = np.diff(np.append(pair_edge, n))
    word_of = np.searchsorted(word_edge, pair_edge, "right") - 1
    mw = np.diff(np.append(word_edge, n))[word_of]
    word, before, text = word[pair_edge], before[pair_edge], text[pair_edge]
    own = np.stack([good[text].astype(np.int64), np.ones(len(text), np.int64)])
    common = _places(models.words, word)
    # Common words as contexts, once each; the text's end is no context.
    once = np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)] & (common >= 0) & (word != END)
    c = models.word_counts[:, common[once]] - own[:, once] * mw[once]
    part = _units(models.contexts(c)) * mw[once]
    start = _units(models.contexts(models.texts[:, None] - np.stack([good.astype(np.int64), np.ones(block.n, np.int64)])))
    there = np.bincount(text, m, minlength=block.n).astype(np.int64)
    known = _places(models.pairs, _pair(before, word))
    hot = (known >= 0) & (common >= 0)
    losses = _units(models.losses(models.pair_counts[:, known[hot]] - own[:, hot] * m[hot], models.word_counts[:, common[hot]] - own[:, hot] * mw[hot])) * m[hot]
    for k in (0, 1):
        np.add.at(sums[k], text[once], part[k])
        np.add.at(sums[k], text[hot], losses[k])
        sums[k] += np.where(there > 0, start[k], 0)
    rest = ~hot
    columns = {"word": word[rest], "before": before[rest], "row": first + text[rest], "m": m[rest], "mw": np.where(common[rest] >= 0, mw[rest], 0), "good": good[text[rest]]}
    return np.maximum(there - 1, 0), sums, columns


def _away(models: NgramModels, task: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, row, losses [2, rows]) of one bucket's occurrences."""
    order = np.lexsort((x["row"], task, x["before"], x["word"]))
    task, x = task[order], {k: v[order] for k, v in x.items()}
    n = len(task)
    m, good = x["m"].astype(np.int64), x["good"].astype(np.int64)
    both = np.stack([m * good, m])
    edge = _groups(x["word"], x["before"])
    pairs = np.add.reduceat(both, edge, 1)[:, _numbered(edge, n)] - both
    common = _places(models.words, x["word"])
    w = np.where(common >= 0, models.word_counts[:, common] - np.stack([x["mw"] * good, x["mw"]]).astype(np.int64), 0)

    cold = np.flatnonzero(common < 0)
    parts_task, parts_row, parts = [], [], []
    if len(cold):
        # All occurrences of such a word are here: those of one row together give its own count.
        word, row, t = x["word"][cold], x["row"][cold], task[cold]
        again = np.lexsort((row, t, word))
        edge = _groups(word[again], t[again], row[again])
        mine = np.add.reduceat(both[:, cold][:, again], edge, 1)
        of = _numbered(edge, len(cold))
        total_edge = _groups(word[again][edge])
        total = np.add.reduceat(mine, total_edge, 1)[:, _numbered(total_edge, len(edge))]
        others = total - mine
        w[:, cold[again]] = others[:, of]
        parts_task.append(t[again][edge])
        parts_row.append(row[again][edge])
        parts.append(_units(models.contexts(others)) * mine[1])
    parts_task.append(task)
    parts_row.append(x["row"])
    parts.append(_units(models.losses(pairs, w)) * m)
    return _added([(np.concatenate(parts_task), np.concatenate(parts_row), np.concatenate(parts, 1))])


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, row, losses), those of one row added, in order."""
    t, row, part = (np.concatenate([p[k] for p in parts], -1) for k in range(3))
    order = np.lexsort((row, t))
    t, row, part = t[order], row[order], part[:, order]
    edge = _groups(t, row)
    return t[edge], row[edge], np.add.reduceat(part, edge, 1) if len(edge) else part


def score(docs: DataFrame, models: NgramModels, good: DataFrame, carry: list[str]) -> DataFrame:
    """Adds n_tokens, target_loss, background_loss and score to the ``carry`` columns.

    ``models`` are those of the same ``docs`` and ``good``, as each row's own counts are taken off.
    A text that is null or has no word has no tokens and null losses and score.  Every row gives
    one row, equal rows equal ones, and an empty table none.  A carried column with the name of an
    added one is replaced by it.
    """
    added = ("n_tokens", "target_loss", "background_loss", "score")
    carry = [c for c in dict.fromkeys(carry) if c not in added]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models)
    buckets = _buckets(docs)
    named = {"_text": "text"} | {f"c{k}": c for k, c in enumerate(carry)}
    placed = _marked(docs, good, named).select("_text", "_good", *(f"c{k}" for k in range(len(carry))))
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join(["bucket int", "task int", "occurrences binary", "row long", "n_tokens long", "t long", "b long", *(f"c{k} {kind}" for k, kind in enumerate(kinds))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, task, first = sent.value, TaskContext.get().partitionId(), 0
        held: list[dict[str, np.ndarray]] = []
        kept = 0
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x = _joined(held)
            # A common word's pairs are dealt by pair, another word's by word.
            bucket = np.concatenate([_bucket(x, slice(a, a + (1 << 16)), buckets) for a in range(0, len(x["word"]), 1 << 16)])
            order = np.lexsort((x["word"], bucket))
            bucket = bucket[order]
            for name in x:
                x[name] = x[name][order]  # one at a time, so that only one is there twice
            del order
            edge = np.append(_groups(bucket), len(bucket))
            for spans in _sent(edge):
                data = [packed({name: v[a:b] for name, v in x.items()}) for a, b in spans]
                none = pa.nulls(len(spans), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([task] * len(spans), pa.int32()), pa.array(data, pa.binary()), none, none, none, none, *(pa.nulls(len(spans), t) for t in types)], names)

        names = ["bucket", "task", "occurrences", "row", "n_tokens", "t", "b", *(f"c{k}" for k in range(len(carry)))]
        for batch in batches:
            types = [batch.column(k).type for k in range(2, batch.num_columns)]
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for begin, end, block in blocks(batch.column(0)):
                n, sums, rest = _at_home(models, block, good[begin:end], first)
                row = first + np.arange(block.n)
                bucket = pa.array((fmix(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.array(np.full(block.n, task, np.int32)), pa.nulls(block.n, pa.binary()), pa.array(row), pa.array(n), *map(pa.array, sums), *(batch.column(k).slice(begin, end - begin) for k in range(2, batch.num_columns))], names)
                first += block.n
                if len(rest["word"]):
                    held.append({name: rest[name].astype(kind) for name, kind in _FIELDS})
                    kept += len(rest["word"])
                if kept > KEEP:
                    yield from flush()
                    kept = 0
        if held:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes rows on and turns the occurrences of a bucket into losses of rows; buckets come one after the other."""
        models = sent.value
        held: list[tuple[int, bytes]] = []
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None
        types: list[pa.DataType] = []

        def bucket_done() -> None:
            x = [unpacked(data) for _, data in held]
            task = np.repeat([t for t, _ in held], [len(p["word"]) for p in x])
            held.clear()
            done.append(_away(models, task, _joined(x)))
            if sum(len(d[0]) for d in done) > KEEP:
                done[:] = [_added(done)]

        def flush() -> Iterator[pa.RecordBatch]:
            """Sums go back in blocks too, one for each part of a task."""
            task, row, loss = _added(done)
            done.clear()
            part = row // PART
            edge = np.append(_groups(task, part), len(task))
            for spans in _sent(edge):
                data = [packed({"row": row[a:b] % PART, "t": loss[0][a:b], "b": loss[1][a:b]}, _SUMS) for a, b in spans]
                none = pa.nulls(len(spans), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([int(task[a]) for a, _ in spans], pa.int32()), pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array(data, pa.binary()), none, none, none, none, *(pa.nulls(len(spans), kind) for kind in types)], names)

        names = ["task", "part", "sums", "row", "n_tokens", "t", "b", *(f"c{k}" for k in range(len(carry)))]
        for batch in batches:
            types = [batch.column(k).type for k in range(7, batch.num_columns)]
            header = batch.filter(batch.column(2).is_null())
            if header.num_rows:
                part = pa.array((np.asarray(header.column(3)) // PART).astype(np.int32))
                yield pa.RecordBatch.from_arrays([header.column(1), part, pa.nulls(header.num_rows, pa.binary()), *header.columns[3:]], names)
            some = batch.filter(batch.column(2).is_valid())
            for bucket, task, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                if bucket != now and held:
                    bucket_done()
                    if sum(len(d[0]) for d in done) > KEEP:
                        yield from flush()
                now = bucket
                held.append((task, data))
        if held:
            bucket_done()
        if done:
            yield from flush()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the sums of the rows of one part of a task after the other."""
        heads: list[pa.RecordBatch] = []
        sums = np.zeros((2, PART), np.int64)
        now = None

        def part_done() -> Iterator[pa.RecordBatch]:
            for head in heads:
                row = np.asarray(head.column(3)) % PART
                t, b = (np.asarray(head.column(5 + k)) + sums[k][row] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([head.column(4), pa.array(t), pa.array(b), *head.columns[7:]], out)
            heads.clear()
            sums[:] = 0

        out = ["n_tokens", "t", "b", *(f"c{k}" for k in range(len(carry)))]
        for batch in batches:
            key = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
            edge = np.append(_groups(key), len(key))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if now is not None and key[a] != now:
                    yield from part_done()
                now = key[a]
                rows = batch.slice(a, b - a)
                heads.append(rows.filter(rows.column(2).is_null()))
                for data in rows.column(2).drop_null().to_pylist():
                    x = unpacked(data, _SUMS)
                    sums[0][x["row"]] += x["t"]
                    sums[1][x["row"]] += x["b"]
        if now is not None:
            yield from part_done()

    carried = "".join(f", c{k} {kind}" for k, kind in enumerate(kinds))
    dealt = placed.mapInArrow(emit, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(resolve, f"task int, part int, sums binary, row long, n_tokens long, t long, b long{carried}")
    sums = dealt.repartition("task", "part").sortWithinPartitions("task", "part").mapInArrow(finish, f"n_tokens long, t long, b long{carried}")
    loss = lambda x: F.when(F.col("n_tokens") > 0, F.col(x) / UNIT / (F.col("n_tokens") + 1))
    return sums.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), "n_tokens", loss("t").alias("target_loss"), loss("b").alias("background_loss"), (loss("t") - loss("b")).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0")
    return score(docs, train(docs, good), good, ["doc_id"])
