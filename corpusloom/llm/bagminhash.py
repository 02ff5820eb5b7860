"""Numeric kernels of near-duplicate detection: word shingles of many texts at once, and BagMinHash signatures of their multisets."""

from __future__ import annotations

import numpy as np

U = np.uint64
_C1, _C2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C55
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TURNS = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5, 0xAEF17502108EF2D9], dtype=U)
_PAD = U(0x5851F42D4C957F2D)
#: Bytes that are part of words: ASCII letters and digits, and every byte of longer characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
CHUNK = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def _pieces(texts: list[str]):
    """(text number, bytes) in pieces of about CHUNK bytes; long texts are cut between words."""
    for k, text in enumerate(texts):
        data = text.lower().encode()
        at = 0
        while len(data) - at > CHUNK:
            cut = data.rfind(b" ", at, at + CHUNK)
            cut = cut if cut > at else data.find(b" ", at + CHUNK)
            if cut < 0:
                break
            yield k, data[at:cut]
            at = cut
        yield k, data[at:] if at else data


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, in order, and the number of each word's text."""
    hashes, owners, held, size = [], [], [], 0

    def flush():
        if not held:
            return
        data = np.frombuffer(b"\n".join(d for _, d in held) + b"\n", np.uint8)
        power, inverse = _power_tables(len(data) + 1)
        inside = _WORD[data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], dtype=U, out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inverse[start]))
        bounds = np.cumsum([len(d) + 1 for _, d in held])
        owners.append(np.array([k for k, _ in held], np.int64)[np.searchsorted(bounds, start, "right")])
        held.clear()

    for k, data in _pieces(texts):
        if size + len(data) > CHUNK:
            flush()
            size = 0
        held.append((k, data))
        size += len(data)
    flush()
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the number of each run's text. A text of fewer words has one run of all its words; one without words has none."""
    h, owner = words(texts)
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.searchsorted(owner, short)
        pads_at = np.repeat(at + count[short], k - count[short])
        h = np.insert(h, pads_at, _PAD)
        owner = np.insert(owner, pads_at, np.repeat(short, k - count[short]))
    if len(h) < k:
        return np.empty(0, U), np.empty(0, np.int64)
    n = len(h) - k + 1
    same = owner[:n] == owner[k - 1 :]
    out = np.zeros(n, U)
    for j in range(k):
        out = mix(out + h[j : n + j] * _TURNS[j % 5])
    return out[same], owner[:n][same]


def multisets(texts: list[str], k: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and their counts."""
    sh, owner = shingles(texts, k)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return [np.unique(sh[a:b], return_counts=True) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(texts: list[str], m: int = 128, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash signatures (len(texts), m) and the number of shingles of each text.

    A shingle of weight w is the strip [0, w) of a Poisson process over weight and time. The weights are cut at the powers of two,
    and each part has its own process, seeded by shingle and part alone: rate m times its width, a random component for each
    point. Parts below w count in full, points of the part that w cuts are thinned by their weight. Points come in ascending
    time, so a part is left once it has passed the largest entry of its text's signature. Two texts agree in a component with
    a probability of just their weighted Jaccard similarity.
    """
    sh, owner = shingles(texts, k)
    total = np.bincount(owner, minlength=len(texts))
    sig = np.full((len(texts), m), np.inf)
    if not len(sh):
        return sig, total
    keys = np.sort((owner.astype(U) << U(44)) | (sh >> U(20)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    weight = np.diff(np.append(first, len(keys)))
    doc, seed = (keys[first] >> U(44)).astype(np.int64), keys[first] & U((1 << 44) - 1)
    parts = [(doc, mix(seed + _GOLD), np.ones(len(doc)), np.zeros(len(doc)), weight.astype(float))]
    low = 1
    while len(more := np.flatnonzero(weight > low)):
        parts.append((doc[more], mix(seed[more] + U(0x9E3779B97F4A7C15 * (low + 1) % (1 << 64))), np.full(len(more), float(low)), np.full(len(more), float(low)), weight[more].astype(float)))
        low *= 2
    doc, seed, width, base, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    cut = base + width > weight
    rate, x, flat, t = width * m, np.zeros(len(doc)), sig.reshape(-1), 0
    while len(doc):
        block = 1 if len(doc) > 4096 else 32
        r = mix(seed[:, None] + _GOLD * np.arange(t + 1, t + 1 + block, dtype=U))
        step = -np.log(((r >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        step[:, 0] += x
        times = np.cumsum(step, axis=1)
        where = doc[:, None] * m + (r & U(m - 1)).astype(np.int64)
        if cut.any():
            level = base[:, None] + width[:, None] * ((mix(r) >> U(11)).astype(float) * 2.0**-53)
            ok = ~cut[:, None] | (level < weight[:, None])
            np.minimum.at(flat, where[ok], times[ok])
        else:
            np.minimum.at(flat, where.reshape(-1), times.reshape(-1))
        x = times[:, -1].copy()
        t += block
        on = x < sig.max(axis=1)[doc]
        doc, seed, width, base, weight, cut, rate, x = (v[on] for v in (doc, seed, width, base, weight, cut, rate, x))
    return sig, total


def bands(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    """(len(sig), n) bucket numbers from the first n * rows components. Times are rounded to single precision, so that a last bit that differs between machines does no harm."""
    bits = sig.astype(np.float32).view(np.uint32).astype(U)
    out = np.zeros((len(sig), n), U)
    for j in range(rows):
        out = mix(out * _TURNS[1] + bits[:, j : n * rows : rows] + _GOLD)
    return mix(out + np.arange(n, dtype=U) * _TURNS[2]).view(np.int64)
