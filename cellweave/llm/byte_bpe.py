"""Byte-level BPE encoding and decoding by a two-tier lookup.

A batch of texts is cut into pre-tokens by classes of characters, all at once. Tier one: a minimal perfect hash of the
vocabulary (as many slots as tokens) gives each pre-token the one token that it can be, and comparing their bytes tells whether it
is. Tier two: a pre-token that is no token is merged from its bytes, which are linked to their neighbours, by a heap of pairs in order of
rank and place; what comes out is remembered a task, so each distinct pre-token is merged once. Ids are ranks, as in
the tiktoken library, whose own pattern engine tells the classes of characters.

The vocabulary is a file of public ranks whose path is a parameter; it is read on the driver and broadcast (its size is fixed).

Defined results: null and empty texts give an empty array; null ids and an empty array decode to no bytes, and so does an id
that is null or that the vocabulary lacks. Repeated rows are encoded each; a text is encoded whole, whatever its length, and one of a
single long word takes n log n steps. Empty tables give empty ones. Only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of pre-tokens whose meaning `cuts` has.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 1_000_000  # pre-tokens a task remembers
BATCH = 1_000_000  # characters cut at once
OTHER, LETTER, NUMBER, SPACE, END = range(5)
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[bytes]  # by id; empty where an id is free
    kinds: np.ndarray  # the class of each code point
    shift: np.ndarray  # of each bucket: a displacement, or -1 - slot
    slot_id: np.ndarray  # the id in each slot


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of flat[start:end] for each pair: sums of bytes times powers of BASE, modulo 2^64, from one running sum."""
    run = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def placed(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slots of hashes; shift is the hash's bucket's."""
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(0xFFFFF)).astype(np.int64) | 1
    return np.where(shift < 0, -1 - shift, (low + shift * high) % n)


def perfect(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift, key of each slot) of a minimal perfect hash of distinct hashes: buckets, largest first, each try displacements until all
    their keys fall on free slots; a bucket of one key names its slot."""
    n = len(h)
    if len(np.unique(h)) < n:
        raise ValueError("two tokens have the same hash")
    buckets = max(1, n // 2)
    shift, key, free = np.zeros(buckets, np.int64), np.full(n, -1), np.ones(n, bool)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = sorted(np.split(order, cut), key=lambda g: -len(g))
    for g in (g for g in groups if len(g) > 1):
        tries = np.arange(256)
        while True:
            slots = placed(h[g][:, None], tries[None, :], n)
            ordered = np.sort(slots, axis=0)
            good = np.flatnonzero(free[slots].all(0) & (ordered[1:] != ordered[:-1]).all(0))
            if len(good):
                break
            tries = tries + 256
        shift[bucket[g[0]]] = tries[good[0]]
        key[slots[:, good[0]]], free[slots[:, good[0]]] = g, False
    for g, slot in zip((g for g in groups if len(g) == 1), np.flatnonzero(free).tolist(), strict=False):
        shift[bucket[g[0]]], key[slot] = -1 - slot, g[0]
    return shift, key


def kinds_of() -> np.ndarray:
    """The class of each code point, as the library's pattern engine tells it."""
    import tiktoken

    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(chars)
        out[np.frombuffer(bytes(found).decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    return out


def load(path: str) -> Vocabulary:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    ids = np.array([i for i, t in enumerate(tokens) if t])
    size = np.array([len(tokens[i]) for i in ids])
    flat, end = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size)
    shift, key = perfect(hashes(flat, end - size, end, powers(len(flat) + 1, BASE), powers(len(flat) + 1, pow(BASE, -1, 1 << 64))))
    return Vocabulary(tokens, kinds_of(), shift, ids[key])


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that word's bytes merge to: the pair of least rank first, the leftmost among equals. A part is known by its first byte's
    place and linked to the parts beside it; the heap has rank * n + place of each pair of neighbours that is a token."""
    n, get, push = len(word), ranks.get, heapq.heappush
    after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [get(word[i : i + 2], -1) for i in range(n - 1)]
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    pair.append(-1)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        if pair[i] != rank:
            continue  # one of its parts has been merged since
        j = after[i]
        pair[j], after[i] = -1, after[j]
        k = after[i]  # where the part after the merged one starts
        pair[i] = -1
        if k < n:
            before[k] = i
            r = pair[i] = get(word[i : after[k]], -1)
            if r >= 0:
                push(heap, r * n + i)
        if i:
            j = before[i]
            r = pair[j] = get(word[j:k], -1)
            if r >= 0:
                push(heap, r * n + j)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def cuts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; kinds has END for what stands between texts."""
    n = len(chars)
    new = np.ones(n + 4, bool)
    new[1:n] = kinds[1:] != kinds[:-1]
    edge = np.flatnonzero(kinds == END)
    new[edge], new[edge + 1] = True, True
    after_space = np.flatnonzero(new[1:n] & (kinds[1:] < SPACE) & (kinds[:-1] == SPACE)) + 1
    new[after_space - 1] = True  # of white space before anything else the last character stands alone
    new[after_space[chars[after_space - 1] == 32]] = False  # or, a blank, in front of what follows
    c = np.append(chars, np.zeros(4, chars.dtype))
    k = np.append(kinds, np.full(4, END, kinds.dtype))
    at = np.flatnonzero(new[:n] & (chars == ord("'")))
    at = at[k[at + 1] == LETTER]
    one, two = c[at + 1], c[at + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
    new[at[short | long] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    return new[:n]


class Encoder:
    """Encodes batches of texts; made once a task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.ranks = {t: i for i, t in enumerate(v.tokens) if t}
        self.size = np.array([len(t) for t in v.tokens])
        self.flat = np.frombuffer(b"".join(v.tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.up = self.down = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        """What a task remembers of merged pre-tokens: their hashes in order, and by number their bytes and ids."""
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.byte_at, self.byte_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def same(self, left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether left[a:a + size] is right[b:b + size], for each triple; sizes aren't 0."""
        if not len(size):
            return np.zeros(0, bool)
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        return np.logical_and.reduceat(left[np.repeat(a, size) + step] == right[np.repeat(b, size) + step], begin)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Numbers given to pre-tokens merged now."""
        number = len(self.many) + np.arange(len(words))
        if words:
            found = [merged(w, self.ranks) for w in words]
            many, size = np.array([len(x) for x in found]), np.array([len(w) for w in words])
            self.first = np.append(self.first, len(self.ids) + np.cumsum(many) - many)
            self.many, self.ids = np.append(self.many, many), np.append(self.ids, np.concatenate(found).astype(np.int32))
            self.byte_at = np.append(self.byte_at, len(self.bytes) + np.cumsum(size) - size)
            self.byte_n, self.bytes = np.append(self.byte_n, size), np.append(self.bytes, np.frombuffer(b"".join(words), np.uint8))
        return number

    def missed(self, h: np.ndarray, raw: bytes, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of pre-tokens that are no tokens, of distinct hashes h in order; they are merged where they aren't known."""
        if not len(h):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.hash, h)
        met = at < len(self.hash)
        met[met] = self.hash[at[met]] == h[met]
        number = np.full(len(h), -1)
        number[met] = self.number[at[met]]
        held = np.flatnonzero(met)
        held = held[self.byte_n[number[held]] == size[held]]
        right = np.zeros(len(h), bool)
        right[held[self.same(flat, start[held], self.bytes, self.byte_at[number[held]], size[held])]] = True
        new = np.flatnonzero(~right)
        number[new] = self.merge([raw[a : a + n] for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
        add = np.flatnonzero(~met)  # a new one whose hash is taken isn't remembered
        self.hash, self.number = np.insert(self.hash, at[add], h[add]), np.insert(self.number, at[add], number[add])
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if len(self.many) > CACHE:
            self.forget()
        joined = "\0".join([*texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self.v.kinds[chars]
        kinds[stops] = END
        start = np.flatnonzero(cuts(chars, kinds))
        end = np.append(start[1:], len(chars))
        real = kinds[start] != END
        start, end = start[real], end[real]
        owner = np.searchsorted(stops, start)
        raw = joined.encode("utf-8")
        flat = np.frombuffer(raw, np.uint8)
        if len(flat) > len(chars):
            at = np.zeros(len(chars) + 1, np.int64)
            np.cumsum(1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000), out=at[1:])
            start, end = at[start], at[end]
        if len(self.up) <= len(flat):
            self.up, self.down = powers(len(flat) + 1, BASE), powers(len(flat) + 1, pow(BASE, -1, 1 << 64))
        size = end - start
        h = hashes(flat, start, end, self.up, self.down)

        ids = self.v.slot_id[placed(h, self.v.shift[(h % np.uint64(len(self.v.shift))).astype(np.int64)], len(self.v.slot_id))]
        hit = np.flatnonzero(self.size[ids] == size)
        hit = hit[self.same(flat, start[hit], self.flat, self.at[ids[hit]], size[hit])]
        whole = np.zeros(len(start), bool)
        whole[hit] = True

        miss = np.flatnonzero(~whole)
        each, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
        shown = miss[one]  # one of each distinct hash
        number = np.zeros(len(start), np.int64)
        number[miss] = self.missed(each, raw, flat, start[shown], size[shown])[back]
        like = size[miss] == size[shown[back]]
        like[like] = self.same(flat, start[miss[like]], flat, start[shown[back[like]]], size[miss[like]])
        odd = miss[~like]  # the same hash as other bytes
        number[odd] = self.merge([raw[a : a + n] for a, n in zip(start[odd].tolist(), size[odd].tolist(), strict=True)])

        many = np.ones(len(start), np.int64)
        many[miss] = self.many[number[miss]]
        out = np.repeat(ids, many).astype(np.int32)
        begin = np.cumsum(many) - many
        n = many[miss]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin[miss], n) + step] = self.ids[np.repeat(self.first[number[miss]], n) + step]
        return out, np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)


def _encode(shared):
    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < BATCH and i < len(texts) - 1:
                    continue
                ids, many = e.encode(texts[lo : i + 1])
                at = np.append(0, np.cumsum(many)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(many)), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], ["id", "ids"])
                lo, size = i + 1, 0

    return run


def encode(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, ids array<int>), one for each row of docs; path: a file of ranks, a token in base 64 and its rank a line."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(shared), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _decode(shared):
    def run(batches):
        tokens = [*shared.value.tokens, b""]
        for b in batches:
            column = b.column(1)
            ids = column.flatten().fill_null(-1).to_numpy()
            ids = np.where((ids < 0) | (ids >= len(tokens)), len(tokens) - 1, ids)
            many = column.value_lengths().fill_null(0).to_pylist()
            out, at = [], 0
            for n in many:
                out.append(b"".join([tokens[i] for i in ids[at : at + n].tolist()]))
                at += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return run


def decode(rows: DataFrame, path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """Rows (id_col, bytes), one for each row."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(shared), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
