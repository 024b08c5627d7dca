"""Words of many texts at once, as 64-bit fingerprints, in numpy."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .chunks import runs

#: Space, tab, newline, vertical tab, form feed, carriage return part words; all else belongs to them.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and every byte of other characters belong to words.
LETTERED = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Strings of more bytes are hashed by blake2b, shorter ones eight bytes a round.
_LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each byte string ``data[start:end]``.

    Each round mixes eight bytes into what the rounds before have made, so that no sums or powers can
    cancel; strings of up to eight bytes and one length never clash.
    """
    n = ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    eight = np.ndarray((len(data),), np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at = 0
    while len(live):
        x = eight[starts[live] + at]
        x &= _MASKS[np.minimum(n[live] - at, 8)]
        out[live] = mix(out[live] ^ x)
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal byte strings: group of each, first member of each. ``hashes`` only guides; bytes decide."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    n = ends - starts
    like = first[group]
    other = n != n[like]
    check = np.flatnonzero(~other & (n > 8) & (like != np.arange(len(n))))
    if len(check):
        differ = data[runs(starts[check], n[check])] != data[runs(starts[like[check]], n[check])]
        owner = np.repeat(check, n[check])
        other[owner[differ]] = True
    if other.any():
        known: dict[bytes, int] = {}
        extra: list[int] = []
        for i in np.flatnonzero(other).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in known:
                known[word] = len(first) + len(extra)
                extra.append(i)
            group[i] = known[word]
        first = np.append(first, extra)
    return group, first


@dataclass
class Words:
    hashes: np.ndarray  # a fingerprint for each word
    starts: np.ndarray  # byte places in ``data``
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    data: np.ndarray  # all texts, each followed by a space

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128-bit blake2b digests of the words at these places, as two numbers each. Equal words, told by their bytes, are hashed once."""
        starts, ends = self.starts[at], self.ends[at]
        group, first = groups(self.data, starts, ends, self.hashes[at])
        raw = self.data.tobytes()
        made = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(starts[first].tolist(), ends[first].tolist()))
        return np.frombuffer(made, np.uint64).reshape(-1, 2)[group]

    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words alone."""
        return groups(self.data, self.starts, self.ends, self.hashes)[0]


def lowered(text: bytes | None) -> bytes:
    if not text:
        return b""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def words_of(texts: list[bytes | None], member: np.ndarray = SPACED) -> Words:
    """Maximal runs of ``member`` bytes in each text; a null text has none."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    own = member[data]
    if len(texts):
        own[np.cumsum(lengths) - 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
    return Words(hashed(data, starts, ends), starts, ends, counts, data)


def grams(hashes: np.ndarray, n: int, multiplier: int = 0x9DDFEA08EB382D69) -> np.ndarray:
    """Fingerprints of n consecutive words at each place that has n to come (over text bounds too)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= np.uint64(multiplier)
        out += hashes[k : k + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for n consecutive words at each place, equal for equal runs of ``ids`` alone."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    out = ids[:m].astype(np.int64)
    for k in range(1, n):
        _, out = np.unique(out * (int(ids.max()) + 1) + ids[k : k + m], return_inverse=True)
    return out


def whole(counts: np.ndarray, n: int) -> np.ndarray:
    """For each place of ``grams``: do its n words belong to one text?"""
    total = int(counts.sum())
    if total < n:
        return np.empty(0, bool)
    last = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + n <= last)[: total - n + 1]
