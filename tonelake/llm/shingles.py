"""Words, sets of 5-word shingles and their MinHash signatures, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Hash functions there are, and so bands times rows at most.
HASHES = 128
_MULTIPLIERS = np.random.default_rng(20_250_101).integers(0, 2**32, (2, HASHES), dtype=np.uint64).astype(np.uint32)
_A, _B = _MULTIPLIERS[0] | np.uint32(1), _MULTIPLIERS[1]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Hashes(dict):
    """Word hashes, kept for the most part; emptied when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, parted at space and the controls 09 to 0D."""
    return (text or b"").lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


#: Bytes of a word up to which ``hashes_at`` takes it eight bytes at a time with all others.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes_at(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between places of a text, as they stand there; other ones than ``word_hashes`` gives."""
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    left = ends - starts
    h = mixed((eight[starts] & _MASKS[np.minimum(left, 8)]) ^ left.astype(np.uint64) * _ODD[3])
    some = np.flatnonzero((left > 8) & (left <= LONG_WORD))
    at, left_some = starts[some], left[some]
    while len(some):
        at, left_some = at + 8, left_some - 8
        h[some] = mixed(h[some] * _ODD[1] ^ eight[at] & _MASKS[np.minimum(left_some, 8)])
        more = left_some > 8
        some, at, left_some = some[more], at[more], left_some[more]
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return h


def equal_at(text: bytes, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether words of the same ``hashes_at``, and so those of up to eight bytes and one size, equal the ones that begin at other places."""
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    left = ends - starts
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        if text[starts[i] : ends[i]] != text[others[i] : others[i] + left[i]]:
            return False
    some = (left > 8) & (left <= LONG_WORD)
    at, to, left = starts[some], others[some], left[some]
    while len(at):
        if ((eight[at] ^ eight[to]) & _MASKS[np.minimum(left, 8)]).any():
            return False
        more = left > 8
        at, to, left = at[more] + 8, to[more] + 8, left[more] - 8
    return True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of ``size`` words; one for all of them if there are fewer."""
    n = len(h) - size + 1
    if n < 1:
        return mixed(np.array([(h * _ODD[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))])) if len(h) else h
    return mixed(sum(h[i : i + n] * _ODD[i] for i in range(1, size)) + h[:n] * _ODD[0])


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingles(word_hashes(words(text))))


def minima(s: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The least value of each of ``n`` universal hash functions over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i : i + 2048, None] * _A[:n] + _B[:n]).min(axis=0))
    return least


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """For each row of minima a hash of each band of ``rows`` of them, its number included."""
    part = least.reshape(len(least), -1, rows).astype(np.uint64)
    return mixed((part * _ODD[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, part.shape[1] + 1, dtype=np.uint64) * _ODD[4]).view(np.int64)


def bits(least: np.ndarray) -> np.ndarray:
    """For each row of minima 128 mixed bits, as many of each, in two longs: bits that two sets share estimate their likeness."""
    each = 128 // least.shape[1]
    own = (mixed(least.astype(np.uint64))[:, :, None] >> (np.arange(17, 17 + each, dtype=np.uint64))) & np.uint64(1)
    out = np.zeros((len(least), 128), np.uint8)
    out[:, : each * least.shape[1]] = own.reshape(len(least), -1)
    return np.packbits(out, axis=1).view(np.int64)


#: Shingles hashed at a time, and the size from which a set is hashed by itself.
PART, LONG = 8192, 250


def sets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of several texts in a row, each sorted, and how many shingles each has."""
    found = [word_hashes(words(t)) for t in texts]
    h = np.concatenate([*found, np.empty(0, np.uint64)])
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    n = max(0, len(h) - SHINGLE + 1)
    whole = of[:n] == of[len(of) - n :]
    values, of = (shingles(h)[whole], of[:n][whole]) if n else (h[:0], of[:0])
    ends = np.searchsorted(of, np.arange(len(found)), side="right").tolist()
    sets, at = [], 0
    for f, end in zip(found, ends):
        part = np.sort(values[at:end] if end > at else shingles(f))
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        sets.append(part)
        at = end
    return np.concatenate([*sets, values[:0]]), np.array([len(x) for x in sets])


def distinct_parts(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of values between places, each sorted, in a row, and the size of each."""
    sizes = np.maximum(stops - starts, 0)
    ends = np.cumsum(sizes)
    out, new = np.empty(int(sizes.sum()), values.dtype), np.ones(int(sizes.sum()), bool)
    for i, n, to in zip(starts.tolist(), sizes.tolist(), ends.tolist()):
        part = out[to - n : to]
        part[:] = values[i : i + n]
        part.sort()
    new[1:] = out[1:] != out[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return out[new], before[ends] - before[ends - sizes]


def minima_of(values: np.ndarray, sizes: np.ndarray, n: int = HASHES) -> np.ndarray:
    """Minima of several non-empty sets that lie in a row; PART values or one set are hashed at a time."""
    ends = np.cumsum(sizes)
    starts, out, i = ends - sizes, np.empty((len(sizes), n), np.uint32), 0
    while i < len(sizes):
        j = i + 1
        if n < 64 and sizes[i] < LONG:
            far = int(np.searchsorted(ends, starts[i] + PART, side="right"))
            long = np.flatnonzero(sizes[i:far] >= LONG)
            j = max(j, i + int(long[0]) if len(long) else far)
        part = values[starts[i] : ends[j - 1]]
        if j == i + 1:
            out[i] = minima(part, n)
        else:
            x = (part >> np.uint64(32)).astype(np.uint32)
            out[i:j] = np.minimum.reduceat(x[:, None] * _A[:n] + _B[:n], starts[i:j] - starts[i], axis=0)
        i = j
    return out


def signature(values: np.ndarray, sizes: np.ndarray, n_bands: int, rows: int) -> list[pa.Array]:
    """Of several sets in a row: size, 128-bit hash of the set, signature bits (two longs each) and band hashes."""
    some = sizes > 0
    keys, marks = np.zeros((2, len(sizes)), np.uint64), np.zeros((len(sizes), 2), np.int64)
    found = np.empty((0, n_bands), np.int64)
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        keys[0, some] = np.add.reduceat(mixed(values), starts)
        keys[1, some] = np.bitwise_xor.reduceat(mixed(values + np.uint64(1)), starts)
        least = minima_of(values, sizes[some], n_bands * rows)
        marks[some], found = bits(least), bands(least, rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * n_bands]), pa.int32()), pa.array(found.ravel(), pa.int64()))
    return [*(pa.array(x, pa.int64()) for x in (sizes, keys[0].view(np.int64), keys[1].view(np.int64), marks[:, 0].copy(), marks[:, 1].copy())), lists]


#: What ``signature`` gives, as columns.
SIGNATURE = "n long, k1 long, k2 long, s1 long, s2 long, bands array<long>"


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
