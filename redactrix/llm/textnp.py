"""Texts of an Arrow batch as one byte array: words, their hashes and shingles, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once. Arrays of numbers take up to a hundred times as much, so that a longer single
#: text is worked on in pieces of about this size (``word_pieces``).
BLOCK = 256 << 10
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20260101))
#: A random number for each byte, the base of the rolling hash and its inverse modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
MULTIPLIERS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(1 << max(16, int(n - 1).bit_length()), base, U)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of the texts; null is an empty text."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int | None = None):
    """Ranges [i, j) of texts of about ``size`` bytes together."""
    i, n, size = 0, len(offsets) - 1, size or BLOCK
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text number) of the words, the runs of bytes that are no white space."""
    w = ~IS_SPACE[data]
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    begin, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def word_pieces(data: np.ndarray, size: int | None = None):
    """Ranges [begin, end) of a text of about ``size`` bytes that part no word; a word longer than that has a range to itself."""
    size, at, n = size or BLOCK, 0, len(data)
    while at < n:
        aim = at + size
        if aim >= n:
            yield at, n
            return
        # the last white space before the aim; else the first one after it, searched piece by piece
        back = np.flatnonzero(IS_SPACE[data[at:aim]])
        if len(back):
            end = at + int(back[-1]) + 1
        else:
            end = aim
            while end < n and not len(ahead := np.flatnonzero(IS_SPACE[data[end : end + size]])):
                end += size
            end = n if end >= n else end + int(ahead[0])
        yield at, end
        at = end


def long_word_hash(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """word_hashes of one word of any length, a block at a time."""
    values, total = FOLDED if fold else BYTE, 0
    for s in range(0, len(data), BLOCK):
        part = data[s : s + BLOCK]
        total += int((values[part] * powers(BASE, len(part))).sum(dtype=U)) * pow(BASE, s, 1 << 64)
    total = (total + len(data) * int(MULTIPLIERS[15])) % (1 << 64)
    return mixed(np.array([total], U))


def hashes_by_piece(data: np.ndarray, fold: bool = True):
    """The word hashes of one text, an array for each of its word_pieces."""
    for b, e in word_pieces(data):
        part = data[b:e]
        if e - b > 2 * BLOCK:  # one word, with white space before it at most
            begin = int(np.argmin(IS_SPACE[part]))
            if not IS_SPACE[part[begin]]:
                yield long_word_hash(part[begin:], fold)
        else:
            begin, end, _ = word_table(part, np.array([0, e - b]))
            yield word_hashes(part, begin, end, fold)


def sorted_set(*parts: np.ndarray) -> np.ndarray:
    """The distinct numbers of the parts in order (np.unique goes by a hash table, which is slower by far)."""
    x = np.concatenate(parts)
    x.sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def long_shingles(data: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of one text's n-word shingles in order, as ``shingles`` and ``distinct`` give them, a piece at a time."""
    held, found, count = np.zeros(0, U), [], 0
    for h in hashes_by_piece(data):
        count, h = count + len(h), np.concatenate([held, h])
        if len(h) >= n:
            found.append(sorted_set(shingles(h, np.zeros(len(h), np.int64), 1, n)[0]))
        held = h[max(0, len(h) - n + 1) :]
    if count < n:
        return shingles(held, np.zeros(len(held), np.int64), 1, n)[0]
    while len(found) > 1:  # pairwise, so that pieces that share shingles shrink early
        found = [sorted_set(*found[k : k + 2]) for k in range(0, len(found), 2)]
    return found[0]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the weighted sum of bytes i to j; times a power of the inverse base it is their hash."""
    c = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers(BASE, len(data)), out=c[1:])
    return c


def range_hash(c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((c[end] - c[begin]) * powers(INVERSE, len(c))[begin] + (end - begin).astype(U) * MULTIPLIERS[15])


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words; ``fold`` makes A-Z equal to a-z."""
    return range_hash(prefix_hash(data, FOLDED if fold else BYTE), begin, end)


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the n-word shingles; a text of fewer words has its whole sequence as the only one."""
    count = np.bincount(text, minlength=n_texts)
    if len(hashes) >= n:
        ok = text[: len(text) - n + 1] == text[n - 1 :]
        h = np.zeros(len(ok), U)
        for k in range(n):
            h += hashes[k : len(hashes) - n + 1 + k] * MULTIPLIERS[k]
        h, t = mixed(h[ok]), text[: len(ok)][ok]
    else:
        h, t = np.zeros(0, U), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        s = np.zeros(len(short), U)
        for k in range(n - 1):
            has = count[short] > k
            s[has] += hashes[first[short][has] + k] * MULTIPLIERS[k]
        h, t = np.concatenate([h, mixed(s + count[short].astype(U) * MULTIPLIERS[14])]), np.concatenate([t, short])
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
    return h, t


def distinct(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs, by text and then hash."""
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def list_array(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(values, kind))
