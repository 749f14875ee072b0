"""Word-shingle sets of whole texts and their SuperMinHash signatures, in numpy, for Arrow batches."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(4096, dtype=np.uint64) * _ODD
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: the next block is this one times base**done
                p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def words(text: str | None) -> list[bytes]:
    """Runs of other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word of ``joined`` (bytes of words, each followed by a space at ``ends``)."""
    starts = np.concatenate(([0], ends[:-1] + 1))
    up, down = _powers(len(joined) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)))
    return mix((running[ends] - running[starts]) * down[starts])


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all k-word shingles; a shorter text is one shingle, an empty one none.

    The hash is a polynomial over the bytes of the words joined by single
    spaces, so that all shingles come from one running sum.
    """
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(w) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    up, down = _powers(len(joined) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)))
    k = min(k, len(w))
    first, last = starts[: len(w) - k + 1], ends[k - 1 :]
    return np.unique(mix((running[last] - running[first]) * down[first]))


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that equal sets share."""
    signed = lambda x: int(np.int64(np.uint64(int(x) & (2**64 - 1)).view(np.int64)))
    a, b = mix(elements ^ _ODD), mix(elements + np.uint64(0x632BE59BD9B4E019))
    return signed(np.add.reduce(a, dtype=np.uint64)), signed(np.add.reduce(b, dtype=np.uint64))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values per set (all infinite for an empty set).

    Step j gives every element the value r + j, r in [0, 1), at the j-th place
    of its own random permutation of the registers; a register keeps its least
    value. Values of step j + 1 are at least j + 1, so a set stops as soon as
    all its registers are below that.
    """
    out = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    flat, perm = out.reshape(-1), None
    rows = np.arange(len(x))
    for j in range(m):
        if not len(x):
            break
        r = mix(x + _STEPS[2 * j + 1])
        k = j + (mix(x + _STEPS[2 * j + 2]) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            place = k
            first_k = k
        else:
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, owner * m + place, (r >> np.uint64(11)) * 2.0**-53 + j)
        open_ = (out.max(1) >= j + 1)[owner]
        if not open_.all() or perm is None:
            x, owner = x[open_], owner[open_]
            rows = np.arange(len(x))
            if perm is None:
                perm = np.repeat(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16)[None], len(x), 0)
                perm[rows, first_k[open_]] = 0
            else:
                perm = perm[open_]
    return out


def registers(signatures: np.ndarray) -> np.ndarray:
    """The registers at two bytes each: equal ones stay equal, unlike ones become equal once in 65,536."""
    return mix(signatures.view(np.uint64)).astype(np.uint16)


def blocks(texts, k: int = 5, size: int = 100_000):
    """Consecutive texts' shingle sets in lists of about ``size`` elements in all."""
    block, total = [], 0
    for text in texts:
        s = shingle_set(text, k)
        if block and total + len(s) > size:
            yield block
            block, total = [], 0
        block.append(s)
        total += len(s)
    if block:
        yield block
