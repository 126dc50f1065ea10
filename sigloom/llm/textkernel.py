"""Vectorised text kernel shared by the operators.

Texts are laid end to end as code points and every step is one numpy pass over
the whole block, so the cost is a few nanoseconds a character whatever the mix
of document lengths.  A word is a maximal run of letters and digits (Unicode
``str.isalnum``), compared in lower case with the one-to-one case mapping, which
is what ``regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')`` gives in SQL.

A block has ``BLOCK_CHARS`` characters at most.  A longer text is read in parts of
that size and only its word hashes are kept (``Hashed``); a word that lies across
two parts has the same hash as in one.

Null texts count as empty here; operators decide what null means to them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that one numpy block holds.
BLOCK_CHARS = 1 << 18

_R = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-cased code point of every letter or digit of the first plane, else 0."""
    out = np.zeros(65536, np.uint32)
    for cp in range(65536):
        out[cp] = _fold_one(cp)
    return out


def _fold_one(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalnum():
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else cp


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(cps: np.ndarray) -> np.ndarray:
    """Lower-cased code points with 0 for everything that is not in a word."""
    high = cps > 0xFFFF
    if not high.any():
        return _fold_table()[cps]
    out = _fold_table()[np.where(high, 0, cps)]
    for cp in np.unique(cps[high]):
        out[cps == cp] = _fold_one(int(cp))
    return out


_POWERS: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        for at, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            step = np.full(size, base, _U64)
            step[0] = 1
            _POWERS[at] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true elements."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else np.zeros(0, np.int64)
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(inside) and inside[-1]:
        edge = np.concatenate([edge, [len(inside)]])
    return edge[0::2], edge[1::2]


def _polynomials(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of code point times base to the power of its place, of each run."""
    power, inverse = _powers(len(folded) + 1)
    run = folded.astype(_U64)
    run *= power[: len(run)]
    run = np.concatenate([np.zeros(1, _U64), np.cumsum(run, dtype=_U64)])
    return (run[end] - run[start]) * inverse[start]


class Words:
    """Words of a block of documents.

    ``start``/``end`` are character positions in the block, ``doc`` the document
    of each word, ``first`` (one longer than the documents) each document's first
    word, ``origin`` each document's first character, ``hash`` 64-bit word hashes.
    ``folding`` says what a word is: the code points that it makes 0 are outside.
    """

    def __init__(self, texts: list[str], folding: Callable[[np.ndarray], np.ndarray] = fold):
        self.n = len(texts)
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.lens = lens
        self.origin = np.concatenate([[0], np.cumsum(lens + 1)])[: self.n] if self.n else np.zeros(0, np.int64)
        self.cps = codepoints("\n".join(texts))
        self.folded = folding(self.cps)
        self.start, self.end = _edges(self.folded != 0)
        self.first = np.concatenate([np.searchsorted(self.start, self.origin), [len(self.start)]]).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.hash = mix(_polynomials(self.folded, self.start, self.end))

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.folded[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le")


def is_long(texts: list[str]) -> bool:
    """Whether this is one text that has to be read in parts."""
    return len(texts) == 1 and len(texts[0]) > BLOCK_CHARS


def parts(text: str) -> Iterator[np.ndarray]:
    """Code points of a long text, a block at a time."""
    for at in range(0, len(text), BLOCK_CHARS):
        yield codepoints(text[at : at + BLOCK_CHARS])


def _long_hashes(text: str, folding: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    done, carried, size = [], 0, 0  # the word that the last part left open: its polynomial and length
    whole = (1 << 64) - 1
    for cps in parts(text):
        folded = folding(cps)
        start, end = _edges(folded != 0)
        h = _polynomials(folded, start, end)
        width = int(end[0] - start[0]) if len(start) else 0
        if size and len(start) and start[0] == 0:
            h[0] = _U64((carried + pow(_R, size, 1 << 64) * int(h[0])) & whole)
            width += size
        elif size:
            done.append(np.array([carried], _U64))
        carried = size = 0
        if len(end) and end[-1] == len(folded):
            carried, size = int(h[-1]), width if len(end) == 1 else int(end[-1] - start[-1])
            h = h[:-1]
        done.append(h)
    if size:
        done.append(np.array([carried], _U64))
    return mix(np.concatenate(done)) if done else np.zeros(0, _U64)


class Hashed:
    """The word hashes of texts, however long, and nothing else: ``hash``, ``doc``, ``first`` and ``count`` are those of ``Words``."""

    def __init__(self, texts: list[str], folding: Callable[[np.ndarray], np.ndarray] = fold):
        self.n = len(texts)
        hashes, counts = [], []
        for _, run in blocks(texts):
            if is_long(run):
                hashes.append(_long_hashes(run[0], folding))
                counts.append(np.array([len(hashes[-1])], np.int64))
            else:
                words = Words(run, folding)
                hashes.append(words.hash)
                counts.append(words.count)
        self.hash = hashes[0] if len(hashes) == 1 else np.concatenate([np.zeros(0, _U64), *hashes])
        self.count = np.concatenate([np.zeros(0, np.int64), *counts])
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.doc = np.broadcast_to(np.int64(0), len(self.hash)) if self.n == 1 else np.repeat(np.arange(self.n), self.count)

    def __len__(self) -> int:
        return len(self.hash)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and the first word of each."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    h = hashes[:size].copy()
    for j in range(1, n):
        h *= _U64(0x9FB21C651E98DF25)
        h += hashes[j : j + size]
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return mix(h[at]), at


def blocks(texts: Iterable[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about limit characters, with the index of the first; a longer text is a run of its own."""
    at, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield at, run


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's return of free memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, each after the memory of the one before has gone back to the system: allocators keep it otherwise, also while a worker waits."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _trim()(0)


def by_block(batches: Iterable[pa.RecordBatch], column: str, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Apply work to slices of the batches whose texts fill one block each; a text of more bytes than a block has characters is a slice of its own."""
    for batch in tidied(batches):
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, out = 0, None
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
            out = work(batch.slice(at, stop - at), [t or "" for t in texts.slice(at, stop - at).to_pylist()])
            if out is not None and out.num_rows:
                yield out
            at = stop
        del batch, texts, out
