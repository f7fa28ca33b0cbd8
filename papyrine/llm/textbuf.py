"""Texts of an Arrow batch as flat numpy arrays of code points, and rolling hashes over them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
TOP = 0x110000


def code_points(text: str) -> np.ndarray:
    """One uint32 per character; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the ``len(texts) + 1`` places where they begin."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return code_points("".join(texts)), starts


def slices(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with at most ``most`` characters together (a longer text comes alone); null is ''."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def random_values(seed: int) -> np.ndarray:
    """One fixed odd random 64-bit value per code point."""
    return mix(np.arange(TOP, dtype=U64) + U64((1 + seed * 0x9E3779B97F4A7C15) % (1 << 64))) | U64(1)


@lru_cache(maxsize=1)
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower, kind) per code point. ``lower`` is the one-character lower case. ``kind`` is 0 for
    white space, punctuation and invisible format characters, 1 for the rest."""
    lower = np.arange(TOP, dtype=np.uint32)
    kind = np.ones(TOP, np.uint8)
    for cp in range(0x20000):  # the planes with letters or punctuation
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        low = c.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
        cat = unicodedata.category(c)
        if c.isspace() or cat[0] in "PZ" or cat in ("Cc", "Cf"):
            kind[cp] = 0
    return lower, kind


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """(base, kind) per code point: ``base`` is lower case without accents; ``kind`` is 1 for letters
    and digits, 2 for combining marks (they neither count nor break a word), 0 for all else."""
    base = np.arange(TOP, dtype=np.uint32)
    kind = np.zeros(TOP, np.uint8)
    for cp in range(0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if unicodedata.combining(c):
            kind[cp] = 2
        elif c.isalnum():
            kind[cp] = 1
            plain = unicodedata.normalize("NFD", c.lower())
            base[cp] = ord(plain[0])
    return base, kind


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; ``base`` is odd."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64), dtype=U64)]) for b in (base, inverse))


BASES = (0x9E6C63D0876A9A47, 0xD1342543DE82EF95)


def sized_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    return powers(base, size)


class Rolling:
    """Hashes of all windows of a flat code point array, for any window length, in one pass."""

    def __init__(self, cps: np.ndarray, which: int = 0) -> None:
        n = len(cps)
        up, self.down = sized_powers(BASES[which], n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(random_values(which)[cps] * up[:n], out=self.prefix[1:])

    def at(self, begin: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``[begin, begin + length)``; the caller keeps windows inside the array."""
        return mix((self.prefix[begin + length] - self.prefix[begin]) * self.down[begin])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours; entry i covers ``values[i : i + width]``."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
