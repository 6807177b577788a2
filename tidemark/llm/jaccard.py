"""Similarity join of documents by the Jaccard coefficient of their word five-gram sets.

The join is a blocked sparse product of the document by n-gram incidence matrix A with its
transpose.  An entry of A A' is the overlap of two sets, and the sizes say which overlap makes a
link, so entries that stay below that are discarded before they are complete:

1. Documents with the same set are one row of A, a class.
2. The columns of a row are ordered from the rarest n-gram to the commonest (passages that many
   documents share come last), and the first part, its prefix, is multiplied first: at the
   threshold, sets can only be linked if their prefixes meet.
3. A column's list of rows is multiplied with itself where it is short, and at first only with its
   hub, the row that has the n-gram earliest, where it is long.  Products are added up over all
   columns, and pairs whose sizes or parity bitmaps leave no room for a link are discarded; the
   best partner of each row gets its whole overlap.  The links of that give components.
4. Then the long lists are multiplied with themselves, in pairs of blocks of rows in size order, but
   only between rows of different components, since a link inside one changes nothing.  These
   products are added to those of the short lists.  As two sets have no more in common than their
   prefixes have and the longer rest of the two holds, most sums are too small and are discarded.
   A list too long for blocks (see ``often``) is first cut by a second n-gram: linked sets share
   two n-grams of their prefixes and the next one, so those that share a single one need not meet.
5. What remains is multiplied in all columns, blockwise, which gives exact overlaps.

No pair, list or text is cut off.  N-grams and sets are told apart by hashes of 64 and 128 bits;
two unlike words fall together with probability 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.components import components
from tidemark.llm.shared import Tables, join_hot
from tidemark.llm.textblock import WINDOW_KEYS, TextBlock, blocks, fmix, windows

WIDTH = 5
#: Links need 7 * overlap >= 3 * (size + size), which is overlap / union >= 0.75.
_TIMES, _OVER = 7, 3
#: Texts of a block, so that their numbers fit into 16 bits.
_TEXTS = 1 << 13


def _prefix(n: Column) -> Column:
    """How many n-grams of a set's order make its prefix; a signature holds one more, where there is one."""
    return n - F.ceil(n * 3 / 4).cast("int") + 1


#: A set's parity bitmap has a power of two of bits, at least this many and at least twice its n-grams.
_BITMAP = 128
#: The commonest n-grams that are put last, as many at most; those seen less often are left in place.
HOT_MOST, HOT_LEAST, HOT_LOCAL = 1 << 17, 64, 4
#: Document ids are sent to all executors up to this number.
MOST_IDS = 2_000_000
#: Lists up to SHORT are multiplied with themselves at once.  Longer ones are dealt in blocks of about BLOCK classes, and SLAB pairs are looked at together.
SHORT, BLOCK, SLAB = 6, 1024, 1 << 16
#: Rows of lists that a task multiplies together.
GATHERED = 1 << 20
#: N-grams that so many classes of one in SAMPLE have are not gathered by n-gram; this only sets the way, never a result.
SAMPLE, SEEN = 64, 8


def sets(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, as signed 64-bit numbers, by text and number; and the text of each.

    A text with fewer than five words has its whole sequence as its one n-gram.
    """
    low = block.lowered()
    starts, ends = low.words()
    first = np.searchsorted(starts, low.offsets)
    word = low.hashes(starts, ends)
    gram, at = windows(word, first, WIDTH)
    owner = low.text_of(starts[at])
    count = np.diff(first)
    for n in range(1, WIDTH):
        few = np.flatnonzero(count == n)
        if len(few):
            total = np.full(len(few), n, np.uint64)
            for k in range(n):
                total += word[first[few] + k] * WINDOW_KEYS[k]
            gram, owner = np.concatenate([gram, fmix(total)]), np.concatenate([owner, few])
    gram, owner = _ordered(gram.view(np.int64), owner)
    if len(gram):
        new = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))
        gram, owner = gram[new], owner[new]
    return gram, owner.astype(np.int64)


def _ordered(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By owner, a number below 2 ** 15, and token."""
    order = np.argsort(token)
    order = order[np.argsort(owner[order].astype(np.int16), kind="stable")]
    return token[order], owner[order]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, TextBlock]]:
    """Blocks of no more texts than the numbering of a block has room for."""
    for begin in range(0, len(column), _TEXTS):
        for a, b, block in blocks(column.slice(begin, _TEXTS)):
            yield begin + a, begin + b, block


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams that several texts of about fifteen megabytes hold, with their number of texts."""

    def count() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= HOT_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

    held: list[np.ndarray] = []
    for batch in batches:
        for _, _, block in _blocks(batch.column(0)):
            held.append(sets(block)[0])
            if sum(map(len, held)) > 1 << 21:
                yield count()
                held.clear()
    if held:
        yield count()


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest n-grams, ascending, and the rank of each by how common it is; over all documents."""
    found = docs.select("text").mapInArrow(_common, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    top = found.orderBy(F.desc("n"), "token").limit(HOT_MOST).toArrow()
    if not top.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = np.asarray(top["token"].combine_chunks())
    order = np.argsort(token)
    return token[order], top.num_rows - order


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, prefix, bitmap) of every document with an id; prefix goes on for one n-gram, where there is one."""
    sent = docs.sparkSession.sparkContext.broadcast(common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_rank = sent.value
        for batch in batches:
            for begin, end, block in _blocks(batch.column(1)):
                token, owner = sets(block)
                n = np.bincount(owner, minlength=block.n)
                start = np.cumsum(n) - n
                mixed = fmix(token.astype(np.uint64))
                f1, f2 = (_sums(x, start, n) for x in (mixed, fmix(mixed * np.uint64(0xA24BAED4963EE407))))
                bits, edges = bitmaps(token, owner, n)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    rank = np.where(hot[at] == token, hot_rank[at], 0)
                    token = token[np.argsort(owner * (HOT_MOST + 1) + rank, kind="stable")]
                size = np.minimum(n, n - -(-3 * n // 4) + 2)
                edge = np.append(0, np.cumsum(size))
                pick = np.repeat(start - edge[:-1], size) + np.arange(edge[-1])
                prefix = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(token[pick]))
                words = pa.ListArray.from_arrays(pa.array(edges), pa.array(bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(n.astype(np.int32)), pa.array(f1), pa.array(f2), prefix, words], ["doc_id", "n", "f1", "f2", "prefix", "bitmap"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, f1 long, f2 long, prefix array<long>, bitmap array<long>")


def bitmaps(token: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all sets, in 64-bit words one after the other, and where each begins.

    Bit j says whether an odd number of the set's n-grams fall on j.  Two sets differ by at
    least as many n-grams as their bitmaps differ by bits.  A bitmap is folded to half its size
    by adding its halves, so sets of different bitmap sizes compare as well.
    """
    size = np.maximum(_BITMAP, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    edge = np.append(0, np.cumsum(size))
    bits = np.bincount(edge[owner] + (token & (size[owner] - 1)), minlength=edge[-1]) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64), (edge // 64).astype(np.int32)


def _sums(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(x))
    return (total[start + n] - total[start]).view(np.int64)


def _fits(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sizes alone leave room for a link."""
    return _TIMES * np.minimum(n, other) >= _OVER * (n + other)


#: Of a row: a product of a short list (0) or with a long list's hub (1), as a pair a < b, or a class b of the long list of n-gram a (2),
#: with its hub in c, and in nb which of the hub's runs of RUN n-grams the list is in.
SHORT_PAIR, HUB_PAIR, MEMBER = 0, 1, 2
RUN = 16
_LISTED = "kind int, a long, b long, na int, nb int, c long"


def _listed(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(a), 1 << 16):
        p = slice(begin, begin + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[p]), kind, np.int32)), pa.array(a[p]), pa.array(b[p]), pa.array(na[p].astype(np.int32)), pa.array(nb[p].astype(np.int32)), pa.array(c[p])], ["kind", "a", "b", "na", "nb", "c"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of short lists and with the hubs of long ones, and the long lists; rows come by n-gram, and about a million are held."""
    held: list[pa.Table] = []
    rows = 0
    for table in _keyed(batches, 1):
        held.append(table)
        rows += table.num_rows
        if rows >= GATHERED:
            yield from _multiplied(pa.concat_tables(held))
            held, rows = [], 0
    if held:
        yield from _multiplied(pa.concat_tables(held))


def _multiplied(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole lists: the products, each added up over all of them, and the long lists."""
    token, node, n, pos = (table.column(k).to_numpy() for k in range(4))
    order = np.lexsort((node, pos, token))
    token, node, n, pos = token[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.append(edge, len(token)))
    edge, length = edge[length > 1], length[length > 1]
    short = length <= SHORT
    parts = []
    for i in range(SHORT):
        for j in range(i + 1, SHORT):
            at = edge[short & (length > j)]
            parts.append((at + i, at + j))
    at, size = edge[~short], length[~short]
    member = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    # The hub has the n-gram first: it is nearest to what the members have in common.
    hub = np.repeat(at, size)
    hubs = [(hub, member)]
    for kind, some in ((SHORT_PAIR, parts), (HUB_PAIR, hubs)):
        i, j = (np.concatenate([p[k] for p in some]) for k in (0, 1))
        ok = (node[i] != node[j]) & _fits(n[i], n[j])
        i, j = i[ok], j[ok]
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        yield from _listed(kind, *_added([(node[i], node[j], n[i], n[j], np.ones(len(i), np.int64))]))
    yield from _listed(MEMBER, token[member], node[member], n[member], pos[hub] // RUN, node[hub])


def _apart(values: np.ndarray, start: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of rows i and j differ, pair by pair, the larger of two sizes folded."""
    out = np.zeros(len(i), np.int64)
    kind = np.log2(width).astype(np.int64)
    both = kind[i] * 64 + kind[j]
    for k in np.unique(both):
        at = np.flatnonzero(both == k)
        one, two = (values[start[x[at]][:, None] + np.arange(1 << w)] for x, w in ((i, k // 64), (j, k % 64)))
        while one.shape[1] > two.shape[1]:
            one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
        while two.shape[1] > one.shape[1]:
            two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
        out[at] = np.bitwise_count(one ^ two).sum(1)
    return out


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_IDS else table


def _met(listed: DataFrame, tables: Tables) -> DataFrame:
    """First products and long lists of all prefixes (token, node, n, pos); the longest lists stay where their rows are."""
    seen = listed.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("token").count().filter(F.col("count") >= SEEN).select("token")
    wide = _sent(tables.write("wide", seen))
    rest = listed.join(wide, "token", "left_anti").repartition("token").sortWithinPartitions("token").mapInArrow(_lists, _LISTED)
    members = listed.join(wide, "token")
    hubs = _sent(tables.write("hubs", members.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))))
    room = _TIMES * F.least("n", "hub.n") >= _OVER * (F.col("n") + F.col("hub.n"))
    near = members.join(hubs, "token").filter(room & (F.col("node") != F.col("hub.node")))
    first = F.col("node") < F.col("hub.node")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    near = near.select(F.lit(HUB_PAIR).alias("kind"), either("node", "hub.node").alias("a"), either("hub.node", "node").alias("b"), either("n", "hub.n").alias("na"), either("hub.n", "n").alias("nb"), F.lit(1).cast("long").alias("c"))
    run = F.floor(F.col("hub.pos") / RUN).cast("int")
    listed = members.join(hubs, "token").select(F.lit(MEMBER).alias("kind"), F.col("token").alias("a"), F.col("node").alias("b"), F.col("n").alias("na"), run.alias("nb"), F.col("hub.node").alias("c"))
    return rest.unionByName(near).unionByName(listed)


def _mixed(lists: DataFrame, *more: Column) -> DataFrame:
    """The n-grams, and more about their lists, whose classes are of several components."""
    return lists.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), *more).filter("_low < _high").drop("_low", "_high")


def often() -> Column:
    """Whether blocks would send a list's rows more often than second n-grams do."""
    return F.count("*") * F.count("*") > BLOCK * F.sum(F.least(_prefix(F.col("n")) + 1, "n"))


def _seconds(lists: DataFrame, prefixes: DataFrame, tables: Tables) -> DataFrame:
    """Lists (token, node, n, label, ...) cut by a second n-gram of (node, prefix), as far as several components meet in one.

    In the order that all sets share, the k-th n-gram that two linked sets have in common is among
    the first n - ceil(0.75 n) + k of each.  So if they meet in an n-gram of their prefixes, another
    one that both have is in the prefix or next after it, and they meet again in the list of both.
    What two linked sets have in common is never counted too low: every n-gram of both prefixes gives
    one product or more.  The work is a row per member and n-gram of its prefix, not the list's square.
    """

    def both() -> DataFrame:
        met = lists.join(prefixes, "node").select("token", "node", "n", "label", F.explode("prefix").alias("_second")).filter("_second <> token")
        return met.select(F.xxhash64("token", "_second").alias("token"), "node", "n", "label")

    met = both().join(_sent(tables.write("both", _mixed(both()))), "token", "left_semi")
    # Each list is a key of its own: lists of one hub would all meet in one task.
    return tables.write("seconds", met.select("token", "node", "n", F.lit(0).alias("run"), F.col("token").alias("hub"), "label"))


def _dealt(lists: DataFrame, tables: Tables) -> DataFrame:
    """Adds i, j and own to the lists' rows (token, node, n, ...): pairs of blocks of a list in size order, and the row's own block.

    A row goes to its block's pairs with those blocks whose sizes leave room for a link, its own
    block among them.  A block has about ``BLOCK`` rows.
    """
    sizes = lists.groupBy("token", "n").agg(F.count("*").alias("_many"))
    by = W.partitionBy("token")  # a row per size
    sizes = sizes.withColumns({"_all": F.sum("_many").over(by), "_less": F.sum("_many").over(by.orderBy("n")) - F.col("_many")}).filter(F.col("_all") > BLOCK).drop("_all")
    placed = lists.join(_sent(tables.write("sizes", sizes)), ["token", "n"], "left")
    # Rows of one size are put in the order of a hash.
    placed = placed.withColumn("own", F.coalesce(F.floor((F.col("_less") + F.pmod(F.xxhash64("node"), "_many")) / BLOCK), F.lit(0)).cast("int"))
    ranges = tables.write("ranges", placed.filter("_many IS NOT NULL").groupBy("token", "own").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    few = ranges.count() <= MOST_IDS  # blocks, not lists: a list's row grows with its blocks
    ranges = ranges.groupBy("token").agg(F.collect_list(F.struct("own", "low", "high")).alias("_blocks"))
    placed = placed.drop("_many", "_less").join(F.broadcast(ranges) if few else ranges, "token", "left")
    fits = lambda x: (4 * x["high"] >= 3 * F.col("n")) & (3 * x["low"] <= 4 * F.col("n"))
    other = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.filter("_blocks", fits), lambda x: x["own"]))
    placed = placed.withColumn("_other", F.explode(other))
    return placed.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_blocks", "_other")


def _keyed(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables of whole keys, which are the first columns, of rows in the order of the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(columns)]
        last = np.logical_or.reduce([k != k[-1] for k in keys])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        before = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(columns))
        if cut or before:
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_PAIR = "a long, b long, na int, nb int, c long"


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of pairs of blocks between classes of different components, a bounded number of rows at a time, added up over the columns that meet here."""

    def flush() -> Iterator[pa.RecordBatch]:
        a, b, na, nb, c = _added(held)
        held.clear()
        for begin in range(0, len(a), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(na[part].astype(np.int32)), pa.array(nb[part].astype(np.int32)), pa.array(c[part])], ["a", "b", "na", "nb", "c"])

    held: list[tuple[np.ndarray, ...]] = []
    kept = 0
    for table in _keyed(batches, 3):
        for pairs in _across(table.combine_chunks()):
            held.append(pairs)
            kept += len(pairs[0])
            if kept > 1 << 20:
                held = [_added(held)]
                kept = len(held[0][0])
                if kept > 1 << 19:
                    yield from flush()
                    kept = 0
    if held:
        yield from flush()


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Partial products (a, b, na, nb, c), those of one pair added."""
    a, b, na, nb, c = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((b, a))
    a, b, na, nb, c = (x[order] for x in (a, b, na, nb, c))
    edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[edge], b[edge], na[edge], nb[edge], np.add.reduceat(c, edge) if len(edge) else c


def _across(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    token, one, two, own, node, n, label = (np.asarray(table.column(k).chunk(0)).astype(np.int64) for k in range(7))
    lists = table.column(7).chunk(0)
    values = np.asarray(lists.flatten()).view(np.uint64)
    width = np.asarray(lists.value_lengths()).astype(np.int64)
    start = np.cumsum(width) - width
    # Rows are only multiplied across components and, where two blocks meet, across those.
    part = np.where(one == two, label, own)
    order = np.lexsort((node, part, two, one, token))
    token, one, two, own, node, n, label, part, width, start = (x[order] for x in (token, one, two, own, node, n, label, part, width, start))
    key = (token[1:] != token[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    ends = [np.append(np.flatnonzero(new) + 1, len(token)) for new in (key, key | (part[1:] != part[:-1]))]
    rows = np.arange(len(token))
    end, after = (x[np.searchsorted(x, rows, "right")] for x in ends)
    total = np.append(0, np.cumsum(end - after))
    begin = 0
    while begin < len(rows):
        # Rows whose pairs are about SLAB; a single row has a block's length at most.
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + SLAB, "right")) - 1)
        many = (end - after)[begin:stop]
        i = np.repeat(rows[begin:stop], many)
        j = after[i] + np.arange(len(i)) - np.repeat(total[begin:stop] - total[begin], many)
        begin = stop
        ok = (label[i] != label[j]) & _fits(n[i], n[j])
        i, j = i[ok], j[ok]
        if len(i):
            most = np.minimum((n[i] + n[j] - _apart(values, start, width, i, j)) // 2, np.minimum(n[i], n[j]))
            ok = _TIMES * most >= _OVER * (n[i] + n[j])
            i, j = i[ok], j[ok]
        if len(i):
            a, b = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            yield node[a], node[b], n[a], n[b], np.ones(len(a), np.int64)


def _folded(bits: str, other: str) -> Column:
    """A bitmap in the size of the other one, where that is half its own."""
    half = F.size(other)
    folded = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > half, folded).otherwise(F.col(bits))


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the most overlap that the parity bitmaps allow to (a, b, na, nb, ...), and leaves out what cannot be linked."""
    one = classes.select(F.col("rep").alias("a"), F.col("bitmap").alias("bits_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("bitmap").alias("bits_b"))
    a, b = _folded("bits_a", "bits_b"), _folded("bits_b", "bits_a")
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.floor((F.col("na") + F.col("nb") - apart) / 2)
    # Sets whose sizes alone allow a link differ by one folding at most.
    met = join_hot(pairs, two, ["b"], ["a"]).join(one, "a").withColumn("most", F.least(most, "na", "nb"))
    return met.filter(_TIMES * F.col("most") >= _OVER * (F.col("na") + F.col("nb"))).drop("bits_a", "bits_b")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, tokens) of the classes in ``wanted`` (rep, f1), from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, block in _blocks(batch.column(1)):
                token, owner = sets(block)
                n = np.bincount(owner, minlength=block.n)
                edge = np.append(0, np.cumsum(n))
                f1 = _sums(fmix(token.astype(np.uint64)), edge[:-1], n)
                # A row with the id of a class but another text is not that class.
                right = pa.array(f1 == np.asarray(batch.column(2))[begin:end])
                tokens = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(token))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), tokens], ["rep", "tokens"]).filter(right)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(_sent(wanted), "rep")
    found = texts.select("rep", "text", "f1").mapInArrow(run, "rep long, tokens array<long>")
    # Rows alike in id and text give one set each.
    return found.groupBy("rep").agg(F.first("tokens").alias("tokens"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, na, nb, tokens_a, tokens_b): the pairs whose whole overlap makes a link, as (u, v)."""
    for batch in batches:
        sizes = [np.asarray(batch.column(k).value_lengths()).astype(np.int64) for k in (4, 5)]
        work = np.append(0, np.cumsum(sizes[0] + sizes[1]))
        begin = 0
        while begin < batch.num_rows:
            stop = min(max(begin + 1, int(np.searchsorted(work, work[begin] + (1 << 20), "right")) - 1), begin + (1 << 14), batch.num_rows)
            part = batch.slice(begin, stop - begin)
            begin = stop
            row = np.concatenate([np.repeat(np.arange(part.num_rows), np.asarray(part.column(k).value_lengths())) for k in (4, 5)])
            token = np.concatenate([np.asarray(part.column(k).flatten()) for k in (4, 5)])
            token, row = _ordered(token, row)
            both = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
            overlap = np.bincount(row[1:][both], minlength=part.num_rows)
            na, nb = (np.asarray(part.column(k)).astype(np.int64) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(_TIMES * overlap >= _OVER * (na + nb)))


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, name: str, tables: Tables) -> DataFrame:
    """Links (u, v) among the pairs (a, b, na, nb), which are a table, by the product of all their columns."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = tables.write(f"{name}_ids", ids.join(classes.select("rep", "f1"), "rep"))
    held = tables.write(f"{name}_sets", _sets_of(docs, wanted))
    one, two = (held.select(F.col("rep").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in ("a", "b"))
    met = join_hot(pairs.select("a", "b", "na", "nb"), two, ["b"], ["a"]).join(one, "a").select("a", "b", "na", "nb", "tokens_a", "tokens_b")
    links = tables.write(f"{name}_links", met.mapInArrow(_overlaps, "u long, v long"))
    tables.drop(f"{name}_ids")
    tables.drop(f"{name}_sets")
    return links


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document row.

    component_id is the smallest doc_id that links lead to, the document's own included.  A null,
    empty or blank text has no n-grams and no links.  Rows of one doc_id count as one document,
    so they share a component; a row without an id is linked to nothing and has a null
    component.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    signed = tables.write("signed", signatures(docs))
    members = tables.write("members", signed.select("doc_id", "n", "f1", "f2"))
    picked = signed.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("prefix", "bitmap"), "doc_id").alias("it"))
    classes = tables.write("classes", picked.select("n", "f1", "f2", "rep", "it.prefix", "it.bitmap"))
    tables.drop("signed")

    listed = classes.select(F.col("rep").alias("node"), "n", F.posexplode(F.slice("prefix", F.lit(1), _prefix(F.col("n")))).alias("pos", "token")).select("token", "node", "n", "pos")
    met = tables.write("met", _met(listed, tables))
    small = tables.write("small", classes.select("rep", "n", "f1", "f2", "bitmap"))
    prefixes = tables.write("prefixes", classes.select(F.col("rep").alias("node"), "prefix"))
    tables.drop("classes")

    # Short lists with themselves, long ones with their hubs.
    first = met.filter(F.col("kind") < MEMBER).groupBy("a", "b", "na", "nb").agg(F.sum(F.when(F.col("kind") == SHORT_PAIR, F.col("c")).otherwise(0)).alias("c"), F.sum("c").alias("all_c"))
    pairs = tables.write("pairs", _bounded(first, small))
    ends = pairs.select("a", "b", "na", "nb", "most", "all_c").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "most", "all_c"))
    nearness = F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))
    best = ends.groupBy("a").agg(F.max(F.struct(nearness, "all_c", -F.col("b"), "b", "na", "nb")).alias("best")).select("a", "best.b", "best.na", "best.nb")
    links = _linked(docs, tables.write("best", best), small, "one", tables)
    label = tables.write("label", components(links, tables, "some"))

    # Long lists with themselves, across components; a list whose members are all of one has nothing left to say.
    own = F.coalesce("label", "node").alias("label")
    lists = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("na").alias("n"), F.col("nb").alias("run"), F.col("c").alias("hub")).join(label, "node", "left").select("token", "node", "n", "run", "hub", own)
    mixed = tables.write("mixed", _mixed(lists, often().alias("often")))
    lists = tables.write("lists", lists.join(_sent(mixed), "token"))
    if mixed.filter("often").limit(1).count():
        short, long = (lists.filter(x).drop("often") for x in ("NOT often", "often"))
        lists = short.unionByName(_seconds(long, prefixes, tables))
    tables.drop("prefixes")
    dealt = _dealt(lists, tables).join(small.select(F.col("rep").alias("node"), "bitmap"), "node").select("token", "i", "j", "own", "node", "n", "label", "bitmap", "run", "hub")
    # Lists of one hub have much the same classes, so a few of them meet in a task, and their products are added there.
    parts = dealt.repartition("hub", "run", "i", "j").sortWithinPartitions("token", "i", "j").drop("run", "hub").mapInArrow(_cross_products, _PAIR)
    a, b = (label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
    apart = pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "na", "nb", "c")
    added = parts.unionByName(apart).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    rest = lambda x: F.ceil(F.col(x) * 3 / 4) - 1  # noqa: E731  what is not in a prefix
    enough = _TIMES * (F.col("c") + F.greatest(rest("na"), rest("nb"))) >= _OVER * (F.col("na") + F.col("nb"))
    more = _linked(docs, tables.write("added", added.filter(enough)), small, "two", tables)

    final = tables.write("final", components(links.unionByName(more), tables, "all"))
    classed = small.select("n", "f1", "f2", "rep").join(final, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("class_id"))
    out = join_hot(members, classed, ["n", "f1", "f2"], ["doc_id"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"))
    idless = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = tables.write("result", out.unionByName(_unlinked(idless)))
    tables.drop_all("result")
    return result


def _unlinked(docs: DataFrame) -> DataFrame:
    """The result's rows for documents without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in _blocks(batch.column(0)):
                n = np.bincount(sets(block)[1], minlength=block.n)
                none = pa.nulls(block.n, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none], ["doc_id", "n_shingles", "component_id"])

    return docs.select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
