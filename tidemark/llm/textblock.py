"""Vectorised views of a block of texts.

A ``TextBlock`` holds the UTF-8 bytes of several whole texts in one array and finds
their words, lines and rolling hashes with numpy.  ``blocks`` cuts an Arrow column into
blocks of bounded size (a text is never cut), so a task's memory follows the longest
single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20

_U = np.uint64


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = _is(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keys of the bytes eight at a time, and of a range's length.
_LANE, _LENGTH = _U(0xD1342543DE82EF95), _U(0xA24BAED4963EE407)
#: Lanes that are hashed for all ranges at once; longer ranges are hashed one by one.
_LANES = 16
#: Keeps the first k bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class TextBlock:
    """Bytes ``data`` of texts ``[offsets[i], offsets[i + 1])``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets.astype(np.int64)
        self.n = len(offsets) - 1
        self.lengths = np.diff(self.offsets)
        self._lanes: np.ndarray | None = None

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each of the ascending byte positions."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are marked."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offsets])

    def edges(self) -> np.ndarray:
        """Marks the first byte of every text that is not empty."""
        at = np.zeros(len(self.data) + 1, bool)
        at[self.offsets[:-1]] = True
        return at[:-1]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words, that is of maximal runs without white space."""
        solid = ~SPACE[self.data]
        if not len(solid):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self.edges()
        before = np.empty_like(solid)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | first))
        after = np.ones_like(solid)
        after[:-1] = ~solid[1:] | first[1:]
        return starts, np.flatnonzero(solid & after) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal ranges of any texts have equal hashes.

        Every lane of eight bytes goes through the mixer with what came before it, so there is no
        algebra that makes unlike ranges meet; two of them do so with probability 2 ** -64.
        """
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = ends - starts
        out = size.astype(np.uint64) * _LENGTH
        at = np.flatnonzero(size <= 8 * _LANES)
        for k in range(_LANES):
            if k:
                at = at[size[at] > 8 * k]
            if not len(at):
                break
            lane = self._lanes[starts[at] + 8 * k] & _KEEP[np.minimum(size[at] - 8 * k, 8)]
            out[at] = fmix(out[at] + (lane + _LANE) * _LANE)
        long = np.flatnonzero(size > 8 * _LANES)
        if len(long):
            view = memoryview(np.ascontiguousarray(self.data))
            out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(starts[long], ends[long], strict=True)), np.uint64, len(long))
        return out

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, and for each text and one more where its first one is."""
        leads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=leads[1:])
        return np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32), leads[self.offsets]

    def lowered(self) -> TextBlock:
        return TextBlock(LOWER[self.data], self.offsets)


WINDOW_KEYS = [_U(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def windows(word_hash: np.ndarray, word_first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and the first word of each run.

    ``word_first`` has, for each text and one more, the index of its first word.
    """
    n = len(word_hash)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = word_hash[: n - width + 1] * WINDOW_KEYS[0]
    for k in range(1, width):
        total += word_hash[k : n - width + 1 + k] * WINDOW_KEYS[k]
    ok = np.ones(n, bool)
    counts = np.diff(word_first)
    for k in range(1, width):
        last = word_first[1:] - k
        ok[last[counts >= k]] = False
    at = np.flatnonzero(ok[: n - width + 1])
    return fmix(total[at]), at


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null becomes an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return column.fill_null("") if column.null_count else column


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, last row + 1, block) of consecutive rows with about ``most`` bytes at most."""
    column = plain(column)
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, rows + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, TextBlock(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end
