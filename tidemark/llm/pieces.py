"""SentencePiece encoding (merge type) and decoding, exact, by backtracking.

A sequence of pieces is the encoding of a text exactly when every two neighbours are
compatible, that is when merging their joint text from its characters gives these two
again.  So the encoder walks the text from the left, takes the longest piece that an
Aho-Corasick automaton finds at each position, checks it against the piece before, falls
back to shorter pieces and then to earlier positions, and keeps a bitfield of positions from
which no valid continuation exists.

White space other than U+0020 and characters outside the vocabulary become byte pieces,
which never merge, and no piece holds the space mark after another character; so the text
can be cut before each run of space marks and at line ends, and the encodings of the cuts
are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import beside

MARK = "\u2581"
#: Characters of keys and values in the table of cuts, and entries of that of neighbours; each is emptied when full.
MOST_CHARS = 30_000_000
MOST_PAIRS = 1_000_000
_CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PieceEncoder:
    """Encodes and decodes with one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = sp.unk_id()
        self.byte_id: dict[int, int] = {}
        self.texts: list[str | int] = []  # a piece's text, or the value of a byte piece
        self.rank: dict[str, tuple[float, int]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.texts.append(value)
            else:
                self.texts.append("" if sp.is_control(i) else piece)
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                    self.rank[piece] = (-sp.get_score(i), i)
        self.single = {p for p in self.rank if len(p) == 1}
        for piece in self.rank:
            if set(piece) - self.single or MARK in piece.lstrip(MARK) or (len(piece) > 1 and "\n" in piece):
                raise ValueError(f"piece {piece!r} does not suit this encoder")
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            if self.merged(piece) == [piece]:  # a piece that merging cannot make never occurs
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cuts: dict[str, tuple[int, str, str]] = {}
        self.chars = 0

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-ranked adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            x, y = self.texts[a], self.texts[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def known(self, text: str) -> list[int]:
        """Encodes characters that all have a piece of their own."""
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (piece, length) in self.automaton.iter(text):
            at[end - length + 1].append((piece, length))  # the shortest first
        out: list[int] = []
        back: list[tuple[int, int]] = []  # of each piece taken: its length, and which shorter ones remain
        failed = bytearray((len(text) >> 3) + 1)  # a bit for each position
        pos = 0
        left = len(at[0])
        while pos < len(text):
            while left:
                left -= 1
                piece, length = at[pos][left]
                if not failed[(pos + length) >> 3] >> ((pos + length) & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    out.append(piece)
                    back.append((length, left))
                    pos += length
                    left = len(at[pos]) if pos < len(text) else 0
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                out.pop()
                length, left = back.pop()
                pos -= length
        return out

    def encode_cut(self, text: str) -> list[int]:
        """Encodes a text in which spaces are marks already."""
        out: list[int] = []
        run: list[str] = []
        for c in [*text, ""]:
            if c in self.single:
                run.append(c)
                continue
            if run:
                out += self.known("".join(run))
                run.clear()
            if c and self.byte_id:
                out += [self.byte_id[b] for b in c.encode()]
            elif c:
                out.append(self.unknown)
        return out

    def decode_cut(self, ids: list[int]) -> str:
        """The text of the ids; the space put before a text is still there."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            piece = self.texts[i]
            if isinstance(piece, int):
                raw.append(piece)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(piece.replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def _add(self, key: str, cut: str) -> tuple[int, str, str]:
        ids = self.encode_cut(cut)
        value = (len(ids), ",".join(map(str, ids)), self.decode_cut(ids))
        size = len(key) + len(value[1]) + len(value[2])
        if size <= MOST_CHARS // 100:  # a longer one will hardly come again
            if self.chars + size > MOST_CHARS:
                self.cuts.clear()
                self.chars = 0
            self.cuts[key] = value
            self.chars += size
        return value

    def __call__(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        cuts, found = self.cuts, []
        simple = MARK not in text and "  " not in text and text[0] != " " and text[-1] != " " and " \n" not in text
        if simple:
            # A word stands for the mark and the word; at the start of a later line it stands for the line end and the word.
            for number, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if number:
                    words[0] = "\n" + words[0]
                for w in words:
                    got = cuts.get(w)
                    found.append(got if got is not None else self._add(w, w if w[:1] == "\n" else MARK + w))
        else:
            for cut in _CUT.findall(MARK + text.replace(" ", MARK)):
                key = MARK + cut
                got = cuts.get(key)
                found.append(got if got is not None else self._add(key, cut))
        sizes, ids, texts = zip(*found, strict=True)
        return sum(sizes), ",".join(ids), "".join(texts)[1:]


_encoders: dict[str, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    """One encoder of each model for each worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = PieceEncoder(model)
    return _encoders[key]


ADDED = {"n_tokens": "long", "ids": "string", "decoded": "string"}


def encode(docs: DataFrame, model_path: str, carry: list[str], column: str = "text") -> DataFrame:
    """Adds n_tokens, ids (decimal, joined by commas) and decoded to the ``carry`` columns.

    A null text counts as empty: no ids, an empty decoded text.  Every row gives one row, equal
    rows equal ones, and an empty table none.  A carried column with the name of an added one is
    replaced by it.  The model is read on the driver and sent to the executors (its size does not
    depend on the data).
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def spell(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        one = encoder(sent.value)
        for begin in range(0, len(texts), 256):
            rows = [one(t) for t in texts.slice(begin, 256).to_pylist()]
            yield begin, begin + len(rows), [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

    return beside(docs, carry, column, ADDED, spell)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
