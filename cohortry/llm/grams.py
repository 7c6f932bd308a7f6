"""Hashes of words and word runs, for whole Arrow batches of texts in numpy.

Texts are handled in blocks of a bounded number of bytes (one text at least),
so memory does not follow the batch size. The hash of a word adds up one random 64-bit number
per byte and place in the word, so that no regular pattern of letters makes two
words meet. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 17

# Places in a word whose numbers are read from a table; beyond it they are made anew.
_TABLE_PLACES = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _numbers(spots: np.ndarray, seed: int) -> np.ndarray:
    """The random number of each spot, which is 256 times the place plus the byte."""
    return mixed((spots.astype(np.uint64) + np.uint64(seed << 40) + np.uint64(1)) * _STEP)


def byte_classes(word: set[int], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the byte each is read as."""
    member = np.zeros(256, bool)
    member[list(word)] = True
    read = np.arange(256)
    if fold:
        read[65:91] += 32
    return member, read


# Runs without the ASCII white space \x20 and \x09-\x0D.
SPACED = byte_classes(set(range(256)) - {32, *range(9, 14)}, fold=False)
# Letters, digits and everything beyond ASCII, A-Z in lower case.
LETTERS = byte_classes(
    {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}, fold=True
)


@dataclass
class Block:
    """Words of consecutive texts: ``starts[i]:starts[i + 1]`` are those of text i."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def words(self, i: int) -> slice:
        return slice(int(self.starts[i]), int(self.starts[i + 1]))


def blocks(
    texts: pa.Array, classes: tuple[np.ndarray, np.ndarray], most: int = BLOCK_BYTES, seed: int = 0
) -> Iterator[Block]:
    """The words of every text; a null text has none. Another seed gives other hashes."""
    member, read = classes
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = whole.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    numbers = _numbers(np.arange(_TABLE_PLACES << 8), seed)
    row = 0
    while row < len(whole):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        yield _block(row, part, offsets[row : end + 1] - offsets[row], member, read, numbers, seed)
        row = end


def _block(
    first: int,
    data: np.ndarray,
    offsets: np.ndarray,
    member: np.ndarray,
    read: np.ndarray,
    numbers: np.ndarray,
    seed: int,
) -> Block:
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    # The place of each byte in its word; bytes between words belong to none.
    origin = np.zeros(len(data), np.int64)
    origin[begins] = begins
    spots = np.arange(len(data)) - np.maximum.accumulate(origin)
    far = np.flatnonzero(inside & (spots >= _TABLE_PLACES))
    spots = (spots << 8) | read[data]
    each = numbers[np.minimum(spots, len(numbers) - 1)]
    each[far] = _numbers(spots[far], seed)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    hashes = mixed(total[ends] - total[begins] + (ends - begins).astype(np.uint64) * _STEP)
    return Block(first, data, hashes, begins, ends, np.searchsorted(begins, offsets))


def runs(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` consecutive words."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(_GRAM_BASE + 2 * seed)
    total = np.zeros(count, np.uint64)
    for j in range(length):
        total *= base
        total += hashes[j : j + count]
    return mixed(total + np.uint64(length))
