"""Suffix-array dedup: every repeat of at least ``least`` bytes, by the interval tree of common prefixes.

1. Anchors. Of every window of ``least`` bytes the first GRAM-byte string with the least hash is an anchor, so all occurrences
   of a repeated window have equal anchors at equal places, and a text gives about one anchor in 60 bytes. An anchor's
   context are the bytes that a window around it can reach.
2. Spark counts anchors and drops those met once. Occurrences whose whole context is met twice are repeats over
   all of it and need no text; they are counted with partial aggregation, so a group of copies of any size is a few rows.
3. Of the other shared anchors each distinct context is fetched once and dealt by anchor. A task concatenates contexts and builds an
   enhanced suffix array (suffixes in order, with the common-prefix length of neighbours) over the starts at which a
   repeat can begin: those whose window is met again and whose occurrences differ in what stands to the left. The array is sparse, as
   other suffixes can't open a group, and as starts of one window agree on ``least`` bytes only what lies beyond is compared.
   A scan with a stack walks the array's common-prefix intervals; an interval of at least ``least`` bytes whose occurrences have
   diverse left extensions is a maximal repeat group and is put out with all its occurrences. A group ends at the context's
   end: a longer repeat is put out as groups that overlap, one an anchor, and their union is the repeat.
4. An anchor of over HOT distinct contexts isn't dealt. The windows whose anchor it is are exploded as hashes, those met in two
   places are found by partial aggregation, and a context's spans from its first to its last such window, all of which hold
   the anchor. Windows whose longer half around the anchor is met once are left out before.
5. Spans of all kinds are merged a text at a time, and the covered bytes are removed.

Bytes are those of UTF-8. Defined results: null and empty texts have no bytes and no spans; texts under ``least`` bytes are kept
whole; equal rows are occurrences of each other, and rows with a null id are texts like others. Very long texts are cut into contexts,
which leave a task in pieces of bounded size. Rows are told apart by a 64-bit hash of id and text. Only these two columns are read,
so others may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import BITMAP, bitmap, stored, texts_of
from cellweave.llm.shingles import as_bytes, chunks, mix, powers, runs

GRAM = 64  # bytes of an anchor, a power of two
HOT = 4096
BATCH = 1 << 19  # bytes of contexts in one suffix array, but for a longer run of one anchor
PIECE = 1 << 20  # bytes of contexts in one piece of output
ROWS = 1 << 16  # occurrences in one piece of output, about
VALUE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)


def window_anchors(texts: list[bytes], least: int) -> list[np.ndarray]:
    """The anchor position of each of a text's windows."""
    reach = least - GRAM + 1
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < least:
        return [np.zeros(0, np.int64) for _ in texts]
    h, width = (buf.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761), 1
    while width < GRAM:
        h = h[:-width] * np.uint32(pow(2246822519, width, 2**32)) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    m, width = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1
    while width < reach:
        step = min(width, reach - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    first = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        out.append(first[s : s + n - least + 1] - s if n >= least else first[:0])
    return out


def anchors(texts: list[bytes], least: int) -> list[np.ndarray]:
    """Each text's anchor positions."""
    return [at[np.append(True, at[1:] != at[:-1])] if len(at) else at for at in window_anchors(texts, least)]


def _anchors(least: int):
    reach = least - GRAM

    def run(batches):
        for b in batches:
            keys, texts = b.column(0).to_numpy(), as_bytes(b.column(1))
            for lo, part in chunks(texts, 1 << 19):
                key, pos, gram, context = [], [], [], []
                for k, (t, at) in enumerate(zip(part, anchors(part, least), strict=True), lo):
                    for p in at.tolist():
                        left = min(p, reach)
                        gram.append(xxhash.xxh3_64_intdigest(t[p : p + GRAM]))
                        context.append(xxhash.xxh3_64_intdigest(t[p - left : p + GRAM + reach], left))
                        pos.append(p)
                    key.append(np.full(len(at), keys[k]))
                key, n = np.concatenate(key), np.repeat([len(t) for t in part], [len(k) for k in key])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int32)), pa.array(np.array(pos, np.int32)), pa.array(np.array(gram, np.uint64).view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64))], ["key", "n", "pos", "gram", "context"])

    return run


def _contexts(least: int):
    """Rows (deal, id, at, bytes): the context of each wanted position, in pieces of about PIECE bytes."""
    reach = least - GRAM

    def run(batches):
        deal, key, at, cut = [], [], [], []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(cut, pa.binary())], ["deal", "id", "at", "bytes"])

        for b in batches:
            ids, texts, wants = b.column("id").to_numpy(), b.column("text"), b.column("wants")
            for k in range(b.num_rows):
                t = texts[k].as_py().encode()
                for w in wants[k].as_py():
                    s = max(0, w["pos"] - reach)
                    deal.append(w["gram"])
                    key.append(ids[k])
                    at.append(s)
                    cut.append(t[s : w["pos"] + GRAM + reach])
                    if len(cut) * (2 * reach + GRAM) > PIECE:
                        yield rows()
                        deal, key, at, cut = [], [], [], []
        yield rows()

    return run


def _halves(least: int):
    """Rows (id, pos, at, bytes, l, r): the context of each wanted position, and hashes of its two longer strings, one of which each
    window around the anchor must hold; null where the text ends before. They leave in pieces of about PIECE bytes."""
    reach = least - GRAM
    half = reach // 2

    def run(batches):
        key, pos, at, cut, left, right = [], [], [], [], [], []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(pos, pa.int32()), pa.array(at, pa.int32()), pa.array(cut, pa.binary()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["id", "pos", "at", "bytes", "l", "r"])

        for b in batches:
            ids, texts, wants = b.column("id").to_numpy(), b.column("text"), b.column("wants")
            for k in range(b.num_rows):
                t, i = texts[k].as_py().encode(), ids[k]
                for w in wants[k].as_py():
                    p = w["pos"]
                    s = max(0, p - reach)
                    key.append(i)
                    pos.append(p)
                    at.append(s)
                    cut.append(t[s : p + GRAM + reach])
                    left.append(xxhash.xxh3_64_intdigest(t[p - half : p + GRAM], 1) - 2**63 if p >= half else None)
                    right.append(xxhash.xxh3_64_intdigest(t[p : p + GRAM + half], 2) - 2**63 if p + GRAM + half <= len(t) else None)
                    if len(cut) * (2 * reach + GRAM) > PIECE:
                        yield rows()
                        key, pos, at, cut, left, right = [], [], [], [], [], []
        yield rows()

    return run


def _windows(least: int, bits: np.ndarray):
    """Rows (window, id, pos, start): the hashes of the windows whose anchor is at pos, without those that no other place can hold."""
    half = (least - GRAM) // 2

    def run(batches):
        set_ = np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            ids, cuts = b.column("id").to_numpy(), as_bytes(b.column("bytes"))
            pos, at = b.column("pos").to_numpy(), b.column("at").to_numpy()
            left, right = (set_[b.column(c).to_numpy()] for c in ("l_at", "r_at"))
            for lo, part in chunks(cuts, 1 << 19):
                sizes = np.array([len(c) for c in part])
                begin = np.cumsum(sizes) - sizes
                buf = np.frombuffer(b"".join(part), np.uint8)
                up, down = powers(len(buf) + 1)
                total = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum(VALUE[buf] * up[:-1], out=total[1:])
                row, start = [], []
                for k, first in enumerate(window_anchors(part, least)):
                    anchor = int(pos[lo + k] - at[lo + k])
                    j = np.flatnonzero(first == anchor)
                    if not left[lo + k]:
                        j = j[anchor - j < half]
                    if not right[lo + k]:
                        j = j[j + least - anchor - GRAM < half]
                    row.append(np.full(len(j), k))
                    start.append(j)
                row, start = np.concatenate(row), np.concatenate(start)
                p = begin[row] + start
                window = mix((total[p + least] - total[p]) * down[p]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(ids[lo + row]), pa.array(pos[lo + row]), pa.array((at[lo + row] + start).astype(np.int32))], ["window", "id", "pos", "start"])

    return run


def maximal_repeats(ids: list[int], at: list[int], cuts: list[bytes], least: int):
    """Groups (length, cuts, offsets) of the maximal repeats of at least `least` bytes among cuts, as arrays of indexes and offsets.

    ids and at say which text a cut comes from and where it begins, so that one place in two cuts counts once."""
    sizes = np.array([len(c) for c in cuts])
    begin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(cuts), np.uint8)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUE[buf] * up[:-1], out=total[1:])
    fits = np.maximum(sizes - least + 1, 0)
    cut = np.repeat(np.arange(len(cuts)), fits)
    off = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    text, place = np.array(ids, np.int64)[cut], np.array(at, np.int64)[cut] + off
    by = np.lexsort((-(sizes[cut] - off), place, text))  # of one place in several cuts the one that reaches farthest
    by = by[np.append(True, (text[by][1:] != text[by][:-1]) | (place[by][1:] != place[by][:-1]))] if len(by) else by
    cut, off = cut[by], off[by]
    p = begin[cut] + off
    window = (total[p + least] - total[p]) * down[p]
    before = np.where(off > 0, buf[p - 1].astype(np.int64), -1 - np.arange(len(p)))  # where a cut begins the left is unlike any other

    by = np.argsort(window, kind="stable")
    first = np.flatnonzero(np.append(True, window[by][1:] != window[by][:-1])) if len(by) else by
    many = np.diff(np.append(first, len(by)))
    diverse = np.zeros(0, bool) if not len(by) else np.minimum.reduceat(before[by], first) != np.maximum.reduceat(before[by], first)
    keep = by[np.repeat((many > 1) & diverse, many)]
    if not len(keep):
        return
    cut, off, p, before = cut[keep], off[keep], p[keep], before[keep]
    # Starts of one window agree on `least` bytes: what orders their suffixes is the window's rank, then the bytes beyond.
    rank = np.repeat(np.arange(len(many)), many)[np.repeat((many > 1) & diverse, many)]
    left = sizes[cut] - off - least
    reach = int(left.max())
    beyond = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(least + reach, np.uint8)), max(reach, 1))[p + least]
    suffix = beyond.astype(">u2")
    suffix += 1
    suffix[np.arange(suffix.shape[1]) >= left[:, None]] = 0  # beyond a cut's end
    del beyond
    order = np.lexsort((suffix.view(f"S{2 * suffix.shape[1]}").ravel(), rank))
    common = np.zeros(len(order), np.int64)  # with the suffix before
    for lo in range(1, len(order), 4096):
        x, y = order[lo - 1 : lo + 4095], order[lo : lo + 4096]
        x = x[: len(y)]
        differs = suffix[x] != suffix[y]
        same = np.minimum(np.where(differs.any(1), differs.argmax(1), reach), np.minimum(left[x], left[y]))
        common[lo : lo + len(y)] = np.where(rank[x] == rank[y], least + same, 0)
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of the open intervals
    for i, c in enumerate([*common[1:].tolist(), 0]):
        start = i
        while stack and stack[-1][0] > c:
            length, start = stack.pop()
            inside = order[start : i + 1]
            b = before[inside]
            if (b != b[0]).any():
                yield length, cut[inside], off[inside]
        if c and (not stack or stack[-1][0] < c):
            stack.append((c, start))


def _repeats(least: int):
    def out(ids, at, cuts):
        key, place, parts, total = np.array(ids, np.int64), np.array(at, np.int64), [], 0
        for length, k, o in maximal_repeats(ids, at, cuts, least):
            name = xxhash.xxh3_64_intdigest(cuts[k[0]][o[0] : o[0] + length]) - 2**63
            parts.append((np.full(len(k), name), key[k], place[k] + o, place[k] + o + length))
            total += len(k)
            if total > ROWS:
                yield batch(parts)
                parts, total = [], 0
        if parts:
            yield batch(parts)

    def batch(parts):
        group, key, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["group", "key", "start", "end"])

    def run(batches):
        ids, at, cuts, size = [], [], [], 0
        for t, bounds in runs(batches, "deal"):
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    part = t.slice(s, e - s)
                    more = part.column("bytes").to_pylist()
                    ids += part.column("id").to_pylist()
                    at += part.column("at").to_pylist()
                    cuts += more
                    size += sum(map(len, more))
                if size > BATCH:
                    yield from out(ids, at, cuts)
                    ids, at, cuts, size = [], [], [], 0
        if cuts:
            yield from out(ids, at, cuts)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("id"), F.col(id_col).alias("doc"), text.alias("text"))


def _wants(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    wants = wanted.groupBy("id").agg(F.collect_list(F.struct("pos", "gram")).alias("wants"))  # a text's anchors at most
    return texts_of(rows, wanted.select("id")).join(wants, "id")


def repeated_windows(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """rows: id, text; wanted: id, pos, gram of distinct contexts. Rows (key, start, end): what a context's windows that are met in
    two places cover, of the windows whose anchor is at pos."""
    near = stored(_wants(rows, wanted).mapInArrow(_halves(least), "id long, pos int, at int, bytes binary, l long, r long"))
    halves = near.select(F.explode(F.array("l", "r")).alias("id")).where("id IS NOT NULL")
    bits = bitmap(halves.groupBy("id").agg(F.count("*").alias("m")).where("m > 1"), BITMAP)
    at = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(0))), F.lit(BITMAP)).cast("int")  # noqa: E731  no window needs a half that isn't there
    windows = near.select("id", "pos", "at", "bytes", at("l").alias("l_at"), at("r").alias("r_at")).mapInArrow(_windows(least, bits), "window long, id long, pos int, start int")
    windows = stored(windows)
    met = stored(windows.groupBy("window").agg(F.count("*").alias("m")).where("m > 1").select("window"))
    return windows.join(met, "window").groupBy(F.col("id").alias("key"), "pos").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end")).select("key", "start", "end")


def spans(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """rows: id, text. (covered, groups): contexts (key, start, end) met as a whole at least twice, and the maximal
    repeats (group, key, start, end) around contexts that aren't; of hot anchors what their repeated windows cover is in covered."""
    reach = least - GRAM
    found = stored(rows.select("id", "text").mapInArrow(_anchors(least), "key long, n int, pos int, gram long, context long"))
    shared = stored(found.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"))
    met = stored(found.join(shared, "gram"))
    classes = stored(met.groupBy("gram", "context").agg(F.count("*").alias("m"), F.min(F.struct("key", "pos")).alias("one")))
    whole = met.join(stored(classes.where("m > 1").select("gram", "context")), ["gram", "context"])
    covered = whole.select("key", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), F.least(F.col("pos") + GRAM + reach, F.col("n")).alias("end"))
    mixed = stored(classes.groupBy("gram").agg(F.min("m").alias("lo"), F.count("*").alias("d")).where("lo = 1 AND d > 1").select("gram", (F.col("d") > HOT).alias("hot")))
    wanted = stored(classes.join(mixed, "gram").select(F.col("one.key").alias("id"), F.col("one.pos").alias("pos"), "gram", "hot"))
    cuts = _wants(rows, wanted.where("NOT hot")).mapInArrow(_contexts(least), "deal long, id long, at int, bytes binary")
    groups = cuts.repartition("deal").sortWithinPartitions("deal", "id", "at").mapInArrow(_repeats(least), "group long, key long, start int, end int")
    hot = wanted.where("hot")
    return (covered if hot.isEmpty() else covered.union(repeated_windows(rows, hot, least))), groups


def _remove(batches):
    for b in batches:
        texts, rows = as_bytes(b.column("text")), b.column("spans").to_pylist()
        gone, many, digest, kept_text = [], [], [], []
        for t, row in zip(texts, rows, strict=True):
            kept, last, n = [], 0, 0
            end = -1
            for s in sorted((s["start"], s["end"]) for s in row or []):
                if s[0] > end:
                    n += 1
                    kept.append(t[last : s[0]])
                end = max(end, s[1])
                last = end
            kept.append(t[last:])
            left = b"".join(kept)
            gone.append(len(t) - len(left))
            many.append(n)
            digest.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, least: int = 200, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary), one for each row of docs."""
    if least < 2 * GRAM:
        raise ValueError(f"repeats need at least {2 * GRAM} bytes")
    rows = keyed(docs, id_col, text_col)
    covered, groups = spans(rows, least)
    both = covered.union(groups.select("key", "start", "end")).groupBy("key", "start").agg(F.max("end").alias("end"))
    by_text = both.groupBy(F.col("key").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a text's length at most
    kind = rows.schema["doc"].dataType.simpleString()
    out = rows.join(stored(by_text), "id", "left").select("doc", "text", "spans")
    return out.mapInArrow(_remove, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("doc", id_col)
