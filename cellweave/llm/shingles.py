"""Word and shingle hashes of a batch of texts, as numpy arrays; runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256)
FOLD[ord("A") : ord("Z") + 1] += 32
VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)[FOLD]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without 0x20, 0x09-0x0D; A-Z folded) of all texts, and each text's first word."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap = SPACE[buf]
    before = np.append(True, gap[:-1])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUE[buf] * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, at)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; a text of fewer words, but not none, is one shingle."""
    h, at = word_hashes(texts)
    step = np.uint64(0xD6E8FEB86659FD93)
    grown = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        grown = mix(grown * step + h[k : k + len(grown)])
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= n:
            out.append(np.unique(grown[s : e - n + 1]))
        elif e > s:
            one = h[s : s + 1].copy()
            for k in range(s + 1, e):
                one = mix(one * step + h[k : k + 1])
            out.append(one)
        else:
            out.append(h[:0])
    return out


def chunks(texts: list[bytes], size: int = 1 << 20):
    """(first, texts) of about size bytes."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > size or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, total = i + 1, 0


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs(batches, *keys: str):
    """(table, bounds): whole runs of rows with equal keys, from batches sorted by keys; a run may span batches."""
    left = None
    for b in chain(batches, [None]):
        t = left if b is None else pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        left = None
        if t is None or not t.num_rows:
            continue
        differs = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            differs |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(differs) + 1).tolist(), t.num_rows]
        if b is not None:
            left, t, bounds = t.slice(bounds[-2]), t.slice(0, bounds[-2]), bounds[:-1]
        if t.num_rows:
            yield t, bounds
