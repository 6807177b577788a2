"""Byte-pair encoding and decoding, exact, by backtracking over longest matches.

A sequence of tokens is what merging makes of a word exactly when every two neighbours are
compatible: merging their joint symbols leaves the seam between them closed.  So the encoder
takes the longest token that an Aho-Corasick automaton finds at each place, asks the table of
compatible pairs, falls back to shorter tokens and then to earlier places, and keeps a bitfield of
places from which nothing goes on.  Each place is tried once with each of its tokens, so the time
is linear in the word.

Decoding gathers texts through a table of offsets into the joined texts of all tokens.

Words come from the definition's own normaliser and splitter (its tables of Unicode are not those
of Python); both look at nothing beyond a blank or a line end, so a text is cut there and the ids
of a cut are kept in a bounded table.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.shared import beside

#: Bytes of the tables of cuts and words, with what an entry takes besides its text and ids, and entries of that of pairs; each is emptied when full.
MOST_BYTES, ENTRY = 200_000_000, 160
MOST_PAIRS = 1_000_000
#: Tokens of the texts that are decoded at once; a longer text is decoded alone.
MOST_TOKENS = 1 << 18
#: Normalisers and splitters that look at nothing beyond a blank or a line end.
_LOCAL = {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"}


class Merges:
    """A vocabulary and its merges: which token two tokens make, and which pairs may be neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab = vocab
        self.suffix = suffix
        #: (left, right) -> place of the merge, and token -> the two that make it.
        self.place: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in self.halves or (left, right) in self.place:
                raise ValueError(f"{a + b!r} is made in two ways, which this encoder does not know")
            for half in (left, right):
                if half in self.halves and self.halves[half][2] > k:
                    raise ValueError(f"{a + b!r} is made before its part")
            self.place[left, right] = k
            self.halves[whole] = (left, right, k)
        self.size = max(vocab.values(), default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            # Merging a token's own symbols gives it only if its halves never merge across their seam before it is made.
            if self.whole(i):
                # Symbols are single characters; the last of a word has the suffix, written here as one mark.
                shown = text.removesuffix(suffix) + "\0" if suffix and text.endswith(suffix) else text
                self.automaton.add_word(shown, (i, len(shown)))
        self.automaton.make_automaton()

    def whole(self, token: int) -> bool:
        if token not in self.halves:
            return True
        left, right, place = self.halves[token]
        return self.whole(left) and self.whole(right) and self.closed(left, right, place)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge (0 left, 1 right) while a token is made, from its symbol up, each with the place at which it is used up."""
        known = self.edges.get((token, side))
        if known is None:
            known = [(token, float("inf"))]
            while known[-1][0] in self.halves:
                made = self.halves[known[-1][0]]
                known.append((made[side], made[2]))
            known.reverse()
            self.edges[token, side] = known
        return known

    def closed(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge earlier than ``before`` crosses the seam between two tokens.

        Both edges grow in the order of the merges.  Of equal merges the leftmost comes first: so
        one that uses up the left edge at the same place goes before one across the seam, and the
        latter goes before one that uses up the right edge.
        """
        x, y = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = x[i], y[j]
            place = self.place.get((a, b), before)
            if place < before and place < a_until and place <= b_until:
                return False
            if a_until >= before and b_until >= before:
                return True
            if a_until <= b_until:
                i += 1
            if b_until <= a_until:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.closed(left, right)
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word of symbols that are all in the vocabulary."""
        if self.suffix:
            word += "\0"  # stands after the last symbol and is part of it
        size = len(word)
        at: list[list[tuple[int, int]] | tuple[()]] = [()] * size
        cut = size - 2 if self.suffix else size  # a last symbol without its mark is no symbol
        for end, match in self.automaton.iter(word):
            if end != cut:
                begin = end + 1 - match[1]
                if at[begin]:
                    at[begin].append(match)  # the shortest first
                else:
                    at[begin] = [match]
        if at[0] and at[0][-1][1] == size:  # a token for the whole word, which has no neighbours
            return [at[0][-1][0]]
        pairs, many = self.pairs, self.size
        out: list[int] = []
        back: list[tuple[int, int]] = []  # of each token taken: its length, and which shorter ones remain
        failed = bytearray((size >> 3) + 1)
        pos, here = 0, at[0]
        left = len(here)
        while pos < size:
            while left:
                left -= 1
                token, length = here[left]
                end = pos + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if out:
                    known = pairs.get(out[-1] * many + token)
                    if known is None:
                        known = self.compatible(out[-1], token)
                    if not known:
                        continue
                out.append(token)
                back.append((length, left))
                pos = end
                if pos < size:
                    here = at[pos]
                    left = len(here)
                break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                out.pop()
                length, left = back.pop()
                pos -= length
                here = at[pos]
        return out


#: A fixed value: the split for which ``Simple`` is written.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin, its additions, and Cyrillic. None of them joins with the next character when a text is composed.
_PLAIN = [*range(0x21, 0x250), *range(0x400, 0x460)]


class Simple:
    """Words of texts of common characters, whose small letter and kind are asked of the tokenizer one by one.

    Its normaliser and splitter treat such characters one at a time, so a text of them needs no more calls.
    """

    def __init__(self, tokenizer: Tokenizer):
        split = lambda x: [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        lower, kinds = {}, {"letter": [], "number": [], "other": []}
        for c in map(chr, _PLAIN):
            low = tokenizer.normalizer.normalize_str(c) if tokenizer.normalizer else c
            if len(low) == 1 and split(low):  # no white space
                lower[c] = low
                kinds["letter" if len(split("a" + low)) == 1 else "number" if len(split(low + low)) == 2 else "other"].append(low)
        shown = {k: "".join(map(re.escape, dict.fromkeys(v))) for k, v in kinds.items()}
        self.all = re.compile(f"[{re.escape(''.join(lower))}]*").fullmatch
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{shown['letter']}]+|[{shown['number']}]|[{shown['other']}]+").findall
        self.lower = str.maketrans({c: low for c, low in lower.items() if c != low})
        self.bytes = str.maketrans({c: "".join(split(c)) for v in kinds.values() for c in v})

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        return [w if w.isascii() else w.translate(self.bytes) for w in self.find(text.translate(self.lower))]


class Encoder(dict):
    """Ids of a text; as a dict, the little-endian 32-bit ids of each cut seen so far."""

    def __init__(self, definition: str):
        super().__init__()
        d = json.loads(definition)
        model = d["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("this encoder is for plain byte-pair encoding")
        steps = [*_flat(d.get("normalizer"), "normalizers"), *_flat(d.get("pre_tokenizer"), "pretokenizers")]
        split = [s for s in steps if s["type"] == "Split"]
        level = [s for s in steps if s["type"] == "ByteLevel"]
        if {s["type"] for s in steps} - _LOCAL or len(split) != 1 or not (split[0]["behavior"] == "Removed" and split[0]["invert"]) or len(level) != 1 or level[0]["use_regex"] or level[0]["add_prefix_space"]:
            raise ValueError("this encoder needs words that end at white space")
        self.tokenizer = Tokenizer.from_str(definition)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        added = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        if any(t.get(k) for t in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t) for t in added):
            raise ValueError("this encoder takes added tokens as they stand, without white space")
        self.added = added
        self.find_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.held = 0
        self.words: dict[str, bytes] = {}
        self.simple = Simple(self.tokenizer) if split[0]["pattern"].get("Regex") == KNOWN_SPLIT else None

    def _keep(self, table: dict[str, bytes], text: str, ids: bytes) -> bytes:
        size = len(text) + len(ids) + ENTRY
        if size <= MOST_BYTES // 100:  # a longer one will hardly come again
            if self.held + size > MOST_BYTES:
                self.clear()
                self.words.clear()
                self.held = 0
            table[text] = ids
            self.held += size
        return ids

    def part(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        t, simple = self.tokenizer, self.simple
        if simple and simple.all(text):
            words = simple.words(text)
        else:
            words = [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]
        known = self.words
        return b"".join([known[w] if w in known else self._keep(known, w, array("i", self.merges.encode(w)).tobytes()) for w in words])

    def cut(self, text: str) -> bytes:
        if not self.find_added or not self.find_added.search(text):
            return self.part(text)
        ids, begin = [], 0
        for m in self.find_added.finditer(text):
            ids += self.part(text[begin : m.start()]), array("i", [self.added[m[0]]]).tobytes()
            begin = m.end()
        return b"".join([*ids, self.part(text[begin:])])

    def __missing__(self, text: str) -> bytes:
        return self._keep(self, text, self.cut(text))

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _flat(step: dict | None, name: str) -> list[dict]:
    return [] if step is None else [s for x in step[name] for s in _flat(x, name)] if step["type"] == "Sequence" else [step]


class Decoder:
    """Texts of ids, joined by a blank, as a definition without a decoder of its own has them."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        if d.get("decoder"):
            raise ValueError("this decoder is for definitions that join their tokens by a blank")
        texts = {i: t for t, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d.get("added_tokens", [])}
        # The texts of all ids one after the other, and the offset at which each begins.
        self.texts = pa.array([texts.get(i) for i in range(max(texts, default=-1) + 1)], pa.large_string())
        self.known = np.array(self.texts.is_valid())

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """One text for each of the runs ``[bounds[k], bounds[k + 1])`` of ids; an unknown id gives nothing."""
        known = (ids >= 0) & (ids < len(self.known))
        known[known] = self.known[ids[known]]
        if not known.all():
            before = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(known, out=before[1:])
            ids, bounds = ids[known], before[bounds]
        parts = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.texts.take(pa.array(ids)))
        return pc.binary_join(parts, pa.scalar(" ", pa.large_string()))


_made: dict[tuple[type, int], Encoder | Decoder] = {}


def _one(kind: type, definition: str) -> Encoder | Decoder:
    """One of each kind for each definition and worker process; its size is bounded by that of the definition and the limits above."""
    key = (kind, hash(definition))
    if key not in _made:
        _made[key] = kind(definition)
    return _made[key]


def _sent(table: DataFrame, tokenizer_path: str):
    """The definition, read on the driver and sent to the executors; its size does not depend on the data."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return table.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str, carry: list[str], column: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), those of the whole text in ``column``, to the ``carry`` columns.

    A null text counts as empty, and an empty text has no ids.  Strings of added tokens in a text
    get these tokens' ids; nothing is added, cut off or padded.  Every row gives one row, equal
    rows equal ones, and an empty table none.  A very long text is held by one task alone, in
    memory in proportion to that text.  Columns go by their places, so any extra columns may be
    there; a carried column named ``ids`` is replaced.
    """
    sent = _sent(docs, tokenizer_path)

    def spell(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        one = _one(Encoder, sent.value)
        for begin in range(0, len(texts), 256):
            rows = [one(t) for t in texts.slice(begin, 256).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
            yield begin, begin + len(rows), [pa.ListArray.from_arrays(pa.array(offsets), ids)]

    return beside(docs, carry, column, {"ids": "array<int>"}, spell)


def decode(coded: DataFrame, tokenizer_path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids in ``column``, special tokens included; it replaces a column of that name.

    Null or no ids give an empty text; null entries and ids that the vocabulary does not have give nothing.
    """
    sent = _sent(coded, tokenizer_path)
    names = [c for c in coded.columns if c != "decoded"]
    fields = [f"`{c.replace('`', '``')}` {coded.schema[c].dataType.simpleString()}" for c in names]
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _one(Decoder, sent.value)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                before = int(ends[begin] - sizes[begin])
                end = max(begin + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
                ids = np.asarray(lists.slice(begin, end - begin).flatten().fill_null(-1), np.int64)
                text = one(ids, np.concatenate([[0], ends[begin:end] - before]))
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns), text.cast(pa.string())], [*names, "decoded"])
                begin = end

    placed = coded.select(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(names)))
    return placed.mapInArrow(run, ", ".join([*fields, "decoded string"]))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, ["doc_id"]), path)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
