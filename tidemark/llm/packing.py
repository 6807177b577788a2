"""Packing token sequences by first-fit decreasing.

Documents are tokenised once, where they are read, and cut into full pieces of the sequence
length and a remainder.  Only piece headers (a few numbers) are shuffled, into randomised
groups of documents of bounded expected size; each group is packed on its own by first-fit
decreasing, with a tournament tree of bin capacities that finds the first bin with room.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.textblock import plain

LENGTH = 1024
#: Pieces in a group, as expected at most.
GROUP = 4096
END = b"\0\0\0\0"  # id 0 after each document
#: The byte-level split into letters, numbers, marks and white space, each with the blank before it.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def by_rank(definition: str) -> tiktoken.Encoding | None:
    """A faster encoder with the same ids, or None where the definition is not known to allow it.

    It merges by the rank of the joint token, not by that of the pair.  Both give the same if ids
    rise with the merges and every token comes out whole when it is encoded alone: a token's
    part of a text is merged as it is alone, as no merge has crossed its ends.
    """
    d = json.loads(definition)
    model, split = d["model"], d.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    if model.get("type") != "BPE" or d.get("normalizer") or not isinstance(vocab, dict) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    if any(t.get(k) for t in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    places = [vocab[m] for m in merged]
    if places != sorted(places) or len(places) != len(set(places)) or set(vocab) != set(ByteLevel.alphabet()) | set(merged):
        return None
    bpe = Tokenizer.from_str(definition).model
    if any(len(bpe.tokenize(t)) != 1 for t in vocab):
        return None
    # The alphabet stands for the bytes: printable ones for themselves, the others numbered from 256 on.
    byte_of, extra = {}, 256
    for byte in range(256):
        if chr(byte) in ByteLevel.alphabet():
            byte_of[chr(byte)] = byte
        else:
            byte_of[chr(extra)] = byte
            extra += 1
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Speller:
    """Token ids as little-endian 32-bit bytes, equal to those of ``tokenizers`` without special ids added."""

    def __init__(self, definition: str, ranked: bool):
        self.fast = by_rank(definition) if ranked else None
        self.slow = None if self.fast else Tokenizer.from_str(definition)
        self.special = tuple(self.fast.special_tokens_set) if self.fast else ()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.slow:
            return [array("I", e.ids).tobytes() for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]
        # A special token's string in a text gets that token's id, as `tokenizers` does by default.
        return [array("I", self.fast.encode(t, allowed_special="all") if any(s in t for s in self.special) else self.fast.encode_ordinary(t)).tobytes() for t in texts]


_spellers: dict[int, Speller] = {}


def speller(definition: str, ranked: bool) -> Speller:
    """One for each definition and worker process; its size is that of the definition."""
    key = hash((definition, ranked))
    if key not in _spellers:
        _spellers.clear()
        _spellers[key] = Speller(definition, ranked)
    return _spellers[key]


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; ``sizes`` must not rise.

    ``tree`` is a tournament over the bins' free room: each inner node has the larger of its
    two children, so the first bin with room is found by going down on the left where that
    side's winner is large enough.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - tree[node])
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, definition: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens, and a number of the document."""
    sent = docs.sparkSession.sparkContext.broadcast((definition, by_rank(definition) is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(*sent.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = plain(batch.column(1))
            for begin in range(0, len(texts), 128):
                row, start, size, crc, total = [], [], [], [], []
                for k, ids in enumerate(spell(texts.slice(begin, 128).to_pylist())):
                    view = memoryview(ids + END)
                    n = len(view) // 4
                    for s in range(0, n, length):
                        piece = view[4 * s : 4 * (s + length)]
                        row.append(k)
                        start.append(s)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                long = lambda x: pa.array(x, pa.int64())
                numbers = long([number + k for k in row])
                number += min(128, len(texts) - begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 128).take(long(row)), long(start), long(size), long(crc), long(total), numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}, number long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is one token (the end).  Equal rows, and rows without an id, are
    separate documents: groups are drawn by a running number of the document within its task,
    so no id, text or source makes a group large.  Ties in length go by that number and start.
    Only doc_id and text are read, whatever other columns there are.  An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    pieces = cut_documents(docs, definition, length)
    # A token has a byte at least, so this bounds the pieces; it reads no more than lengths of texts.
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size["n"] + size["bytes"] // (2 * length)) // group))
    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64("number", F.lit(groups)), F.lit(groups)))

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("number", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), length)
        first = key[0].as_py() << 32
        rows = rows.drop_columns(["pack_group", "number"])
        return rows.append_column("sequence_id", pa.array([first | b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.groupBy("pack_group").applyInArrow(fill, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
