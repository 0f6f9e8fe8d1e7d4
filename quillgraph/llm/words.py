"""Word hashing shared by the text operators: tokens to 64-bit hashes, tokens to rolling k-grams.

Texts stay UTF-8 bytes from Arrow to numpy. ``bytes.lower`` and ``bytes.split`` touch ASCII letters
and ASCII white space only, which is the word rule of the contracts: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries the per-worker word cache may hold before it starts afresh.
CACHE_WORDS = 100_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words of this worker's current documents."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of word hashes spread over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; the whole sequence when it has fewer words."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * MIX + h[i : n - k + 1 + i]
    return scramble(out)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that a worker holds few texts, and results of few, at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(table, starts, ends): rows sorted by their first ``keys`` integer columns, cut so that no run of equal keys is
    torn; a run is held whole, so callers bound their number of rows."""
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        changes = np.zeros(table.num_rows, bool)
        changes[:1] = True
        for c in range(keys):
            changes[1:] |= np.diff(table.column(c).to_numpy()) != 0
        starts = np.flatnonzero(changes)
        return table, starts, np.append(starts[1:], table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        before = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in range(keys)] if held else None
        new = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            new[1:] |= np.diff(columns[c]) != 0
            new[0] |= before is not None and columns[c][0] != before[c]
        at = np.flatnonzero(new)
        last = int(at[-1]) if len(at) else 0  # where the last run of this batch begins
        if len(at):
            done = [*held, batch.slice(0, last)] if last else held
            yield cut(done)
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(held)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct k-word shingles of a text as 64-bit hashes."""
    return np.unique(rolling(hashes.of(text.lower().split()), k))

#: ASCII bytes that are not digits or letters become blanks, A-Z become a-z, other bytes stay: a word is
#: then a run of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()
