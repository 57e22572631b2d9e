"""Distinct five-word shingles of a text as 64-bit values, in numpy.

A text is lower-cased on A-Z only and cut at runs of space, tab, line feed,
vertical tab, form feed and carriage return.  Every word is hashed in blocks
of eight bytes, all words of a text at once: a block is mixed into the state
that the blocks before left, so that words of up to eight bytes never collide
with words of the same length.  Words of more than ``LONG`` bytes get a keyed
BLAKE2 hash.  A shingle is the mix of the hashes of its words in order.  No
Python object is made for a short word.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5

#: Bytes up to which a word is hashed with all others of its text.
LONG = 64

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z hash as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: By number of bytes left in a word, the bits of a block that belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


#: Bytes hashed at once; longer texts go through in pieces that end between words.
PIECE = 1 << 22


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    edges = np.flatnonzero(np.diff(np.r_[False, ~SPACE[raw], False]))
    return edges[::2], edges[1::2]


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    held = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    blocks = np.ndarray(len(raw) + 1, dtype="<u8", buffer=held, strides=(1,))  # eight bytes from every place on
    sizes = ends - starts
    value = mix64(sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(0xA24BAED4963EE407))
    value = mix64((value ^ (blocks[starts] & _MASK[np.minimum(sizes, 8)])) * _U(0x9FB21C651E98DF25))
    at, done = np.flatnonzero(sizes > 8), 8
    while len(at) and done < LONG:
        left = sizes[at] - done
        value[at] = mix64((value[at] ^ (blocks[starts[at] + done] & _MASK[np.minimum(left, 8)])) * _U(0x9FB21C651E98DF25) + _U(done))
        done += 8
        at = at[left > 8]
    for i in at.tolist():
        value[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"framelark word").digest(), "little")
    return value


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """One uint64 per word of ``text``, in order; with ``fold``, A-Z counts as a-z."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if fold:
        raw = _FOLD[raw]
    if len(raw) <= PIECE:
        return _word_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not SPACE[raw[end]]:
            step = np.flatnonzero(SPACE[raw[end : end + PIECE]])
            end = end + int(step[0]) if len(step) else min(end + PIECE, len(raw))
        parts.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle values.  Fewer words than ``width``: the whole
    sequence is one shingle.  Null or no word: empty."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
    if not len(words):
        return words
    span = min(width, len(words))
    count = len(words) - span + 1
    value = np.full(count, 0x632BE59BD9B4E019 + span, dtype=np.uint64)
    for j in range(span):
        value = mix64((value ^ words[j : j + count]) * _U(0x9FB21C651E98DF25) + _U(j + 1))
    return np.unique(value)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed 64-bit numbers."""
    one = int(np.bitwise_xor.reduce(mix64(values + _U(0xA0761D6478BD642F)))) if len(values) else 0
    two = int(np.add.reduce(mix64(values ^ _U(0xE7037ED1A0B428DB)))) if len(values) else 0
    signed = np.array([one, two], dtype=np.uint64).view(np.int64)
    return int(signed[0]), int(signed[1])
