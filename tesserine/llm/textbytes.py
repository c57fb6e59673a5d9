"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and all of non-ASCII characters (after LOWER).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes that are not white space.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False

#: Odd base of the polynomial hashes, and places that one table of its powers covers.
_BASE, _SPAN = 0x9E3779B97F4A7C15, 1 << 14


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of runs of texts of up to `most` bytes; a longer text is a run of its own. None counts as empty."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > most:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each, and where each begins (one entry more: the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


def spans(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in an array whose last entry is False."""
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        turn = np.concatenate(([0], turn))
    return turn[::2], turn[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    return np.cumprod(np.concatenate(([U(1)], np.full(n - 1, U(base)))), dtype=U)


_POWERS, _INVERSE = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal wherever the bytes are equal."""
    turns = -(-len(data) // _SPAN) + 1
    powers = (_powers(pow(_BASE, _SPAN, 1 << 64), turns)[:, None] * _POWERS).ravel()[: len(data)]
    before = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers, out=before[1:])
    inverse = _powers(pow(_BASE, -_SPAN, 1 << 64), turns)[starts // _SPAN] * _INVERSE[starts % _SPAN]
    return mixed((before[ends] - before[starts]) * inverse + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes], kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and for each text the index of its first word (one entry more: the number of words)."""
    data, at = joined(texts)
    data = LOWER[data]
    starts, ends = spans(kind[data])
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)
