"""SentencePiece encoding and decoding by suffix-array matching.

A text is a row of units, a unit being a run of the space mark and the characters up to the next one (or to a control
character that no piece has); no piece has the mark after another character, so units are encoded on their own. For each batch the distinct units not met
before in the task are concatenated and indexed by a suffix array, ordered to the length of the longest piece by prefix doubling;
every piece is binary-searched for its range of occurrences; the edges so found are sorted by position and relaxed in that
order. The vocabulary is of the pair-merging kind, whose encoding is the one row of pieces in which each neighbouring pair
is what merging the pair's own text gives; so an edge from a reached position relaxes the position at its end if its piece
agrees with the piece that reached its start. The ids equal those of the sentencepiece library. A character that is no
piece is written as byte pieces, and so is a literal space mark in the input (which the library would turn into a space),
which makes decoding exact for every text.

The vocabulary is a file of public scores whose path is a parameter; it is read on the driver and broadcast (its size is fixed).

Defined results: null texts give null ids and decode to null, empty texts give an empty array and decode to an empty
text. Repeated rows are encoded each, null ids included; an empty table gives an empty one. A text is encoded whole, whatever its
length. Only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 400_000  # units a task remembers
BATCH = 2_000_000  # characters indexed at once
PAIRS = 1 << 21  # slots for pairs of pieces that a task remembers


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray  # ids of ordinary pieces
    byte_ids: np.ndarray  # the id of each byte's piece


def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    usable = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
    bad = [p for p in (pieces[i] for i in usable) if MARK in p.lstrip(MARK)]
    if bad or any(not sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError(f"the vocabulary needs byte pieces, and marks only in front: {bad[:3]}")
    return Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)], np.float32), usable, np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32))


class Matcher:
    """Encodes distinct units; made once a task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for i in v.usable for c in v.pieces[i]}))}
        ends = "".join(c for c in "\t\n\r\v\f" if c not in self.alphabet)
        self.unit = re.compile(f"[{ends}]|{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+" if ends else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.depth = 4
        longest = max(len(v.pieces[i]) for i in v.usable)
        while self.depth < longest:
            self.depth *= 2
        self.lut = np.zeros(0x110000, np.uint16)
        for c, i in self.alphabet.items():
            self.lut[ord(c)] = i
        self.lengths = np.array([len(v.pieces[i]) for i in v.usable])
        text = np.zeros((len(v.usable), self.depth), np.uint64)
        for row, i in enumerate(v.usable):
            text[row, : self.lengths[row]] = [self.alphabet[c] for c in v.pieces[i]]
        high = np.where(np.arange(self.depth) < self.lengths[:, None], text, np.uint64(0xFFFF))
        self.low_keys, self.high_keys = self._packed_rows(text), self._packed_rows(high)
        self.rank = {v.pieces[i]: -float(v.scores[i]) for i in v.usable}
        self.pair, self.agrees = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.forget()
        self.made: dict[int, bool] = {}

    def whole(self, left: str, right: str) -> bool:
        """Whether merging left + right from characters, best score first and leftmost among equals, ends as these two pieces."""
        parts, cut = [*left, *right], len(left)
        while len(parts) > 2:
            r, k = min((self.rank.get(parts[k] + parts[k + 1], np.inf), k) for k in range(len(parts) - 1))
            if r == np.inf:
                return False
            if sum(map(len, parts[: k + 1])) == cut:
                return False  # a merge across the border
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts == [left, right] and left + right not in self.rank

    def agreed(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the token before it; -1 stands for a character that is no piece, -2 for the start."""
        code = (before + 2) * np.int64(len(self.v.pieces) + 2) + token
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        free = (token < 0) | (before == -1)
        for i in np.flatnonzero((self.pair[slot] != code) & ~free).tolist():
            if self.pair[slot[i]] != code[i]:
                left = "" if before[i] < 0 else self.v.pieces[before[i]]
                self.pair[slot[i]], self.agrees[slot[i]] = code[i], self.alone(int(token[i])) if not left else self.whole(left, self.v.pieces[token[i]])
        ok = self.agrees[slot]
        late = np.flatnonzero((self.pair[slot] != code) & ~free)  # slots that pairs of this call share
        for i in late.tolist():
            ok[i] = self.alone(int(token[i])) if before[i] < 0 else self.whole(self.v.pieces[before[i]], self.v.pieces[token[i]])
        ok[free] = [token[i] < 0 or self.alone(int(token[i])) for i in np.flatnonzero(free).tolist()]
        return ok

    def alone(self, token: int) -> bool:
        """Whether merging a piece's own characters ends as that piece."""
        if token not in self.made:
            parts = [*self.v.pieces[token]]
            while len(parts) > 1:
                r, k = min((self.rank.get(parts[k] + parts[k + 1], np.inf), k) for k in range(len(parts) - 1))
                if r == np.inf:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.made[token] = len(parts) == 1
        return self.made[token]

    @staticmethod
    def _packed_rows(rows: np.ndarray) -> list[np.ndarray]:
        return [(rows[:, k] << np.uint64(48)) | (rows[:, k + 1] << np.uint64(32)) | (rows[:, k + 2] << np.uint64(16)) | rows[:, k + 3] for k in range(0, rows.shape[1], 4)]

    def suffix_array(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of their first `depth` characters, and the four characters from each position as one number."""
        n = len(code)
        wide = np.zeros(n + 4, np.uint64)
        wide[:n] = code
        packed = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
        order = np.argsort(packed)
        rank = np.empty(n, np.int64)
        new = np.append(False, packed[order][1:] != packed[order][:-1])
        rank[order] = np.cumsum(new)
        size = 4
        while size < self.depth and rank[order[-1]] < n - 1:
            later = np.zeros(n, np.int64)
            later[: max(0, n - size)] = rank[size:] + 1
            key = rank * (n + 1) + later
            order = np.argsort(key)
            rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
            size *= 2
        return order, packed

    def bounds(self, order: np.ndarray, packed: np.ndarray, keys: list[np.ndarray], above: bool) -> np.ndarray:
        """For each piece the first place in the suffix array that isn't below (or is above) its key: a binary search."""
        n = len(order)
        lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), n)
        padded = np.append(packed, np.zeros(self.depth, np.uint64))
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, n - 1)]
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, key in enumerate(keys):
                have = padded[at + 4 * k]
                less |= same & (have < key)
                same &= have == key
            go = (less | same if above else less) & open_
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        text = "\0".join([*units, ""])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.lut[chars]
        order, packed = self.suffix_array(code)
        first, last = self.bounds(order, packed, self.low_keys, False), self.bounds(order, packed, self.high_keys, True)
        many = last - first
        piece = np.repeat(np.arange(len(many)), many)
        position = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        length, token = self.lengths[piece], self.v.usable[piece]
        single = np.zeros(len(code), bool)
        single[position[length == 1]] = True
        lone = np.flatnonzero(~single & (chars != 0))
        position, length = np.append(position, lone), np.append(length, np.ones(len(lone), np.int64))
        token = np.append(token, np.full(len(lone), -1))

        ends = np.flatnonzero(chars == 0)
        begins = np.append(0, ends[:-1] + 1)
        offset = position - np.repeat(begins, ends - begins + 1)[position]
        by = np.argsort(offset, kind="stable")
        position, length, token, offset = position[by], length[by], token[by], offset[by]
        last, step = np.full(len(code), -3), np.zeros(len(code), np.int64)  # the piece that reached each position; -3: none yet
        last[begins] = -2
        cuts = [0, *(np.flatnonzero(np.diff(offset)) + 1).tolist(), len(offset)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):  # edges that start at the same offset of their units end apart
            good = self.agreed(last[position[s:e]], token[s:e])
            to = (position[s:e] + length[s:e])[good]
            last[to], step[to] = token[s:e][good], length[s:e][good]

        at, unit, found, owner = ends.copy(), np.arange(len(units)), [], []
        while len(at):
            found.append((last[at], at))
            owner.append(unit)
            at = at - step[at]
            open_ = at > begins[unit]
            at, unit = at[open_], unit[open_]
        ids, where, owner = np.concatenate([f[0] for f in found])[::-1], np.concatenate([f[1] for f in found])[::-1], np.concatenate(owner)[::-1]
        by = np.argsort(owner, kind="stable")
        ids, where, counts = ids[by], where[by], np.bincount(owner, minlength=len(units))
        if len(lone := np.flatnonzero(ids < 0)):  # a character that is no piece becomes its bytes' pieces
            raw = [self.v.byte_ids[list(text[w - 1].encode("utf-8", "surrogatepass"))] for w in where[lone].tolist()]
            width = np.ones(len(ids), np.int64)
            width[lone] = [len(x) for x in raw]
            counts = np.bincount(np.sort(owner), weights=width, minlength=len(units)).astype(np.int64)
            at, ids = np.cumsum(width) - width, np.repeat(ids, width)
            for k, x in zip(at[lone].tolist(), raw, strict=True):
                ids[k : k + len(x)] = x
        return ids.astype(np.int32), counts

    def forget(self) -> None:
        self.index: dict[str, int] = {}  # unit -> its place in size and start
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE:
            self.forget()
        index, known, rows = self.index, len(self.index), []
        for t in texts:
            if MARK in t or "\0" in t:
                rows.append(None)
            else:
                rows.append([index.setdefault(u, len(index)) for u in self.unit.findall(MARK + t.replace(" ", MARK))] if t else [])
        if fresh := list(islice(index, known, None)):
            ids, counts = self.encode_units(fresh)
            self.start = np.append(self.start, len(self.flat) + np.cumsum(counts) - counts)
            self.size, self.flat = np.append(self.size, counts), np.append(self.flat, ids)
        out = []
        for t, row in zip(texts, rows, strict=True):
            if row is None:
                out.append(self.rare(t))
                continue
            u = np.array(row, np.int64)
            n = self.size[u]
            out.append(self.flat[np.arange(n.sum()) + np.repeat(self.start[u] - np.cumsum(n) + n, n)])
        return out

    def rare(self, text: str) -> np.ndarray:
        """A text with a literal mark or NUL: these go as bytes, what lies between is encoded as ever."""
        out = [self.encode_units([MARK])[0]] if text[0] in f"{MARK}\0" else []
        for k, part in enumerate(re.split(f"([{MARK}\0])", text)):
            if k % 2:
                out.append(self.v.byte_ids[list(part.encode("utf-8"))])
            elif part:
                out.append(self.encode_units(self.unit.findall(("" if k else MARK) + part.replace(" ", MARK)))[0])
        return np.concatenate(out)


def decoded(ids: np.ndarray, v: Vocabulary, byte_of: dict[int, int]) -> str:
    if not len(ids):
        return ""
    if not byte_of.keys() & set(ids.tolist()):
        text = "".join([v.pieces[i] for i in ids])
        return text.replace(MARK, " ")[1:]
    out, raw = [], bytearray()
    for i in ids.tolist():
        if i in byte_of:
            raw.append(byte_of[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
            raw = bytearray()
        out.append(v.pieces[i].replace(MARK, " "))
    if raw:
        out.append(raw.decode("utf-8", "surrogatepass"))
    return "".join(out)[1:]


def _encode(shared):
    def run(batches):
        m = Matcher(shared.value)
        byte_of = {int(b): k for k, b in enumerate(m.v.byte_ids)}
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < BATCH and i < len(texts) - 1:
                    continue
                part = texts[lo : i + 1]
                ids = m.encode([t or "" for t in part])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                null = np.array([t is None for t in part])
                rows = pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                right = [t is None or decoded(x, m.v, byte_of) == t for t, x in zip(part, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), rows, pa.array(right, pa.bool_())], ["id", "ids", "round_trip"])
                lo, size = i + 1, 0

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, ids array<int>, round_trip): round_trip says that decoding the ids gave the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(shared), f"id {kind}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def _decode(shared):
    def run(batches):
        v = shared.value
        byte_of = {int(b): k for k, b in enumerate(v.byte_ids)}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decoded(np.array(x, np.int64), v, byte_of) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return run


def decode(rows: DataFrame, path: str = VOCABULARY, id_col="doc_id", ids_col="ids") -> DataFrame:
    """Rows (id_col, text); null ids decode to null."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(shared), f"id {kind}, text string").withColumnRenamed("id", id_col)
