"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial over a random table of its bytes, taken modulo
2**64 and mixed. Prefix sums over a buffer of texts give all of its words in a
few passes, without a Python object for each word. Two different words have
the same hash with a probability of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from millrace.llm.runtime import claim

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that separate words: ASCII white space, and all but ASCII digits, letters and non-ASCII bytes.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
MARKS = np.array([not (48 <= b < 58 or 97 <= b < 123 or 65 <= b < 91 or b > 127) for b in range(256)])
BUFFER = 1 << 18

_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BUFFER + 4096)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@dataclass
class Words:
    """``hashes`` of all words; text ``i`` has those from ``edges[i]`` to ``edges[i + 1]``."""

    hashes: np.ndarray
    edges: np.ndarray
    last_byte: np.ndarray | None = None
    ends_line: np.ndarray | None = None  # whether a line end follows the word
    starts: np.ndarray | None = None  # bytes of each word in the texts, with a line end before each text
    ends: np.ndarray | None = None


def _hash_buffer(texts: list[bytes], separators: np.ndarray) -> Words:
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    gap = separators[buffer]
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    powers, inverses = _powers_to(len(buffer))
    table = np.where(separators, U(0), _BYTES)
    sums = np.cumsum(table[buffer] * powers[: len(buffer)])
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverses[starts])
    lengths = np.fromiter(map(len, texts), "i8", len(texts))
    edges = np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths + 1))])
    lines = np.cumsum(buffer == 10)
    after = np.append(starts[1:], len(buffer) - 1)
    return Words(hashes, edges, buffer[ends - 1], lines[after] > lines[ends - 1], starts, ends)


def places(text: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of a text, and the bytes after them."""
    gap = separators[np.frombuffer(b"\n" + text + b"\n", np.uint8)]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    return turns[::2], turns[1::2]


def buffers(texts: list[str | None]):
    """(first, last, UTF-8 texts) of runs of texts of bounded size; a longer text is a run by itself."""
    claim("words")
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if run and size + len(data) > BUFFER:
            yield first, i, run
            run, size, first = [], 0, i
        run.append(data)
        size += len(data)
    if run:
        yield first, len(texts), run


def words(texts: list[bytes], separators: np.ndarray) -> Words:
    return _hash_buffer(texts, separators)


def shingles(found: Words, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: hashes of ``width`` words, or of all of them where there are fewer."""
    w = np.concatenate([found.hashes, np.zeros(width, U)])
    n = len(found.hashes)
    total = np.zeros(n, U)
    for k in range(width):
        total += w[k : k + n] * _PLACES[k]
    total = mix(total)
    out = []
    edges = found.edges.tolist()
    for a, b in zip(edges, edges[1:]):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            few = (w[a:b] * _PLACES[: b - a]).sum(dtype=U, keepdims=True)
            out.append(mix(few + _PLACES[width + b - a : width + b - a + 1]))
        else:
            out.append(np.empty(0, U))
    return out
