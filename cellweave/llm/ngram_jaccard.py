"""n-gram Jaccard join over a count-vector R-tree.

A document's set holds the distinct hashes of its n-word shingles (64 bits); two documents link when
100 * |intersection| >= percent * |union|. The steps:

1. ``signatures`` gives one row a document: the set's size, its 128-bit fingerprint, the count vector (shingle hashes dealt
   into a power-of-two number of groups, the groups' counts being the point's coordinates) and the set's prefix, its
   least hashes, of which linked sets must share one.
2. Rows with equal sets become one class, kept by one row. Prefix hashes met in at least two classes are found by
   a partially aggregated count; the rows of these come back by a join whose hot keys Spark's skew join splits.
3. A prefix hash of at most ``SMALL`` classes is a single leaf: its pairs go out without vectors, and a pair's shared hashes are
   counted. All that two sets share below the end of the shorter prefix is counted so, and beyond it lies a known number of hashes,
   which bounds the overlap; pairs that stay get their count vectors, once a pair, and are bounded by the summed minima.
4. Within each other shared prefix hash the classes' points are packed, in order of size, into an R-tree. A search bounds the
   overlap with a node by the summed minima of the query's and the node's upper coordinates (an upper bound needs no lower
   ones; the node's least size bounds the union), descends where the bound can reach the threshold, and bounds each point in
   the same way. Prefix hashes of over ``HOT`` classes are cut by size band, and a band of over ``HOT`` is dealt into blocks whose
   pairs run as tasks of their own. Vectors are attached to rows of these hashes only, and only where a set of like size shares the hash.
5. Of a tree's surviving pairs a task keeps a spanning forest, so groups of any size give a row a point at most. Links
   can only stand inside the clusters that all these connect. A cluster's texts meet once (clusters that are large, by rows or by
   shingles, by pairs of buckets), where surviving pairs are verified on the whole sets; links are counted for each row, and a
   spanning forest of the links is put out.

A pair that shares a hash of step 4 is met there, so step 3 need be exact only for pairs that share none.

Texts are fetched for candidates only: a bitmap of the candidates' ids, of a fixed size, spares other texts the
shuffle (when it is full it lets all pass, and the join still decides).

Defined results: null and empty texts and texts without words have an empty set (n_shingles 0) and link with nothing.
Ids are whole numbers, unique in general. Rows that share an id are one document with several texts: it links if any of them does,
and all get its component; n_shingles and n_links are each row's own. Rows with a null id keep a null component and link with
nothing. Only the id and text columns are read, so other columns may have any name. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import components, stored, texts_of
from cellweave.llm.shingles import as_bytes, chunks, runs, shingle_sets

PACK = 16  # entries of an R-tree node
HOT = 2048  # points of a tree, about
SMALL = 8  # points of a run that is a single leaf, less than PACK
CLUSTER = 512  # candidates of a cluster's bucket; two buckets meet in a group
SHINGLES = 1 << 20  # shingles of a bucket, about


def _signatures(n_words: int, percent: int):
    def run(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            for lo, part in chunks(texts):
                n, mark, vec, keys = [], [], [], []
                for u in shingle_sets(part, n_words):
                    k = len(u)
                    n.append(k)
                    mark.append(xxhash.xxh3_128_digest(u.tobytes()) if k else None)
                    groups = max(16, 1 << max(0, (k // 8)).bit_length())
                    counts = np.bincount((u & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
                    vec.append(counts.astype("<u2" if k > 255 and counts.max() > 255 else "u1").tobytes())
                    keys.append(u[: k - -(-percent * k // 100) + 1].view(np.int64) if k else u.view(np.int64))
                at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, len(part)) for c in ("id", "doc_id")] + [pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(vec, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "doc_id", "n", "mark", "vec", "keys"])

    return run


def signatures(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """docs: doc_id, text. Rows (id, doc_id, n, mark, vec, keys), id being a 64-bit hash of id and text: repeated rows share it."""
    return keyed(docs).mapInArrow(_signatures(n_words, percent), "id long, doc_id long, n long, mark binary, vec binary, keys array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("id"), "doc_id", "text")


def folded(vec: bytes, n: int, groups: int) -> np.ndarray:
    """The count vector at fewer groups: halves are added, as a group's number is the low bits of the hash."""
    full = max(16, 1 << (n // 8).bit_length())
    v = np.frombuffer(vec, "u1" if len(vec) == full else "<u2").astype(np.int32)
    return v.reshape(-1, groups).sum(0)


class RTree:
    """Points (count vectors of sets, in order of size) packed PACK to a node, level by level, up to at most PACK nodes. A node
    keeps its points' greatest coordinates. A search goes from a point to those after it, which are no smaller, so it needs
    the vectors at the query's number of groups, and only of points that are near enough in size."""

    def __init__(self, sizes: np.ndarray, vecs: list[bytes], percent: int):
        self.n, self.vecs, self.percent, self.built = sizes, vecs, percent, {}
        self.groups = np.array([max(16, 1 << (k // 8).bit_length()) for k in sizes.tolist()])
        self.last = np.searchsorted(sizes, 100 * sizes // percent, "right")  # beyond the largest that can link with each

    def at(self, groups: int) -> tuple[int, list[np.ndarray]]:
        """(first, levels): the points from `first` on, then each level's upper coordinates."""
        if groups not in self.built:
            first, end = np.searchsorted(self.groups, groups), np.searchsorted(self.groups, groups, "right")
            stop = int(self.last[end - 1])
            levels = [np.stack([folded(self.vecs[i], int(self.n[i]), groups) for i in range(first, stop)])]
            while len(levels[-1]) > PACK:
                levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), PACK)))
            self.built[groups] = int(first), levels
        return self.built[groups]

    def search(self, i: int) -> np.ndarray:
        """Points after i, in order, whose overlap bound with point i reaches the threshold."""
        stop = int(self.last[i])
        if stop <= i + 1:
            return np.zeros(0, np.int64)
        first, levels = self.at(int(self.groups[i]))
        query, lo, hi, n = levels[0][i - first], i + 1 - first, stop - first, int(self.n[i])
        depth = 0
        while (hi - lo) // PACK**depth > 4 * PACK and depth + 1 < len(levels):
            depth += 1
        found = np.arange(lo // PACK**depth, (hi - 1) // PACK**depth + 1)
        for level in range(depth, -1, -1):
            bound = np.minimum(levels[level][found], query).sum(1)
            if level:
                least = self.n[first + found * PACK**level]
                found = found[(100 + self.percent) * bound >= self.percent * (n + least)]
                found = (found[:, None] * PACK + np.arange(PACK)).ravel()
                step = PACK ** (level - 1)
                found = found[(found >= lo // step) & (found <= (hi - 1) // step)]
            else:
                found = found[(100 + self.percent) * bound >= self.percent * (n + self.n[first + found])]
        return found + first


def close(n: tuple[int, int], vecs: tuple[bytes, bytes], percent: int) -> bool:
    """Whether the overlap bound of two points reaches the threshold."""
    groups = min(max(16, 1 << (k // 8).bit_length()) for k in n)
    a, b = (folded(v, k, groups) for v, k in zip(vecs, n, strict=True))
    return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * sum(n)


def _close(percent: int):
    def run(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("lo", "hi", "lo_vec", "hi_vec"))
            keep = [close((lo, hi), (u, v), percent) for lo, hi, u, v in zip(*cols, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Forest:
    """Connected groups of a few ids; join() says whether two groups became one."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _propose(percent: int):
    """Pairs (a, b) from sorted runs of (key, part): a spanning forest of the pairs whose bound reaches the threshold."""

    def run(batches):
        for t, bounds in runs(batches, "key", "part"):
            size, ids, home = (t.column(c).to_numpy() for c in ("n", "id", "home"))
            vecs, pairs = t.column("vec").to_pylist(), set()
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s < 2:
                    continue
                forest = Forest()
                tree = RTree(size[s:e].astype(np.int64), vecs[s:e], percent)
                for i, j in ((i, j) for i in range(e - s - 1) for j in tree.search(i).tolist()):
                    x, y = int(ids[s + i]), int(ids[s + j])
                    if (home[s + i] or home[s + j]) and forest.join(x, y):
                        pairs.add((min(x, y), max(x, y)))
            p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return run


def size_band(percent: int):
    """Sets that can link are of one band or of neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")


def leaf_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, id, n of prefix hashes that few classes share. Rows (a, b, lo, hi), sizes lo <= hi, of the pairs that share
    enough of these hashes: beyond the end of the shorter prefix a set has at most ceil(percent * hi / 100) - 1 hashes."""
    at = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("n", "id"))).alias("at"))  # at most SMALL
    near = lambda x, i: F.filter(F.slice("at", i + 2, F.lit(SMALL)), lambda y: percent * y["n"] <= 100 * x["n"])
    pair = F.flatten(F.transform("at", lambda x, i: F.transform(near(x, i), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), x["n"].alias("lo"), y["n"].alias("hi")))))
    counted = at.select(F.explode(pair).alias("p")).select("p.*").groupBy("a", "b", "lo", "hi").agg(F.count("*").alias("c"))
    overlap = F.col("c") + F.floor((percent * F.col("hi") + 99) / 100) - 1
    return counted.where((100 + percent) * overlap >= percent * (F.col("lo") + F.col("hi"))).select("a", "b", "lo", "hi")


def alike(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, id, n. Those that share their key with a set of like size, each once."""
    cells = rows.select("key", "id", "n", F.explode(F.array(size_band(percent), size_band(percent) + 1)).alias("band"))
    near = stored(cells.groupBy("key", "band").agg(F.count("*").alias("m")).where("m > 1").select("key", "band"))
    return cells.join(near, ["key", "band"]).select("key", "id", "n").distinct()


def proposals(rows: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """rows: key, id, n; vecs: id, vec. Distinct pairs (a, b), a < b, that connect what the bound can't tell from a link."""
    band, vast = size_band(percent), F.col("m") > HOT
    cell = lambda at, home: F.struct(at.cast("int").alias("band"), F.lit(home).alias("home"))
    cells = F.when(vast, F.array(cell(band, True), cell(band + 1, False))).otherwise(F.array(cell(F.lit(-1), True)))
    slim = rows.join(stored(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")), "key")
    slim = stored(slim.select("key", "id", "n", F.explode(cells).alias("c")).select("key", "id", "n", "c.band", "c.home"))
    sizes = slim.where("band >= 0").groupBy("key", "band").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.xxhash64("band", F.least(i, own), F.greatest(i, own)))
    placed = slim.join(sizes, ["key", "band"], "left").na.fill(1, ["blocks"]).select("key", "id", "n", "home", F.explode(parts).alias("part"))
    placed = placed.join(vecs, "id").select("key", "part", "id", "n", "vec", "home")  # the vectors move once more, to their parts
    return placed.repartition("key", "part").sortWithinPartitions("key", "part", "n", "id").mapInArrow(_propose(percent), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]):
    """For each set the sizes of its intersections with all sets, by the sets that hold each of its members."""
    who = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    name = np.cumsum(np.append(False, flat[by][1:] != flat[by][:-1]))
    place = np.empty(len(flat), np.int64)
    place[by] = name
    holders, first = who[by], np.searchsorted(name, np.arange(name[-1] + 2))
    at = 0
    for u in sets:
        mine = place[at : at + len(u)]
        at += len(u)
        start, many = first[mine], first[mine + 1] - first[mine]
        yield np.bincount(holders[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)], minlength=len(sets))


def _verify(n_words: int, percent: int):
    """Rows (a, b, links) of each run of group, on whole sets: a spanning forest of the links (links 0), and for each text that has
    any (a, a, links), the rows it links with. Of two buckets that meet only pairs across them are counted."""

    def run(batches):
        for t, bounds in runs(batches, "group"):
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                part = t.slice(s, e - s)
                ids, same, weight = (part.column(c).to_numpy() for c in ("id", "same", "w"))
                bucket, texts = part.column("bucket").to_numpy(), as_bytes(part.column("text").combine_chunks())
                sets, out, forest = [u for _, some in chunks(texts) for u in shingle_sets(some, n_words)], [], Forest()
                size = np.array([len(u) for u in sets])
                for i, both in enumerate(overlaps(sets)):
                    linked = np.flatnonzero((both > 0) & (100 * both >= percent * (size + size[i] - both)))
                    linked = linked[linked != i]
                    out += [(ids[i], ids[j], 0) for j in linked.tolist() if j > i and forest.join(ids[i], ids[j])]
                    counts = linked if same[i] else linked[bucket[linked] != bucket[i]]
                    if len(counts):
                        out.append((ids[i], ids[i], weight[counts].sum()))
                rows = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["a", "b", "links"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Rows as of _verify. classes: id, n, w (rows of the class); docs: id, text. Links can only join texts of one cluster of proposals,
    so each cluster's texts meet in one group, once; a large cluster is dealt into buckets whose pairs are the groups."""
    cluster = components(pairs).join(classes, "id")
    sums = cluster.groupBy("component_id").agg(F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("k"))
    cluster = stored(cluster.join(sums, "component_id").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")))
    own = F.col("bucket")
    places = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.xxhash64("component_id", F.least(i, own), F.greatest(i, own)).alias("group"), (i == own).alias("same")))
    texts = texts_of(docs, cluster.select("id")).dropDuplicates(["id"])  # rows that share an id are equal
    got = cluster.join(texts, "id").select(F.explode(places).alias("p"), "id", "w", "bucket", "text").select("p.group", "p.same", "id", "w", "bucket", "text")
    got = got.repartition("group").sortWithinPartitions("group", "id")
    return got.mapInArrow(_verify(n_words, percent), "a long, b long, links long")


def link(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (doc_id long, n_shingles long, component_id long, n_links long), one for each row of docs. n_links counts the other rows
    that a row's text links with, copies included."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(signatures(docs, n_words, percent))
    known = marks.where("n > 0 AND doc_id IS NOT NULL")
    same = stored(known.groupBy("mark").agg(F.min("id").alias("node"), F.count("*").alias("w")).where("w > 1"))
    member = stored(known.select("id", "mark").join(same, "mark").select("id", "node").distinct())
    kept = known.join(member.where("id <> node").select("id").hint("merge"), "id", "left_anti")  # both grow with the corpus

    keys = kept.select(F.explode("keys").alias("key"), "id", "n")
    shared = stored(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m"))
    rows = stored(keys.join(shared.hint("merge"), "key"))  # both grow with the corpus
    vecs = kept.select("id", "vec").dropDuplicates(["id"])
    few = stored(leaf_pairs(rows.where(F.col("m") <= SMALL), percent))
    few = few.join(vecs.select(F.col("id").alias("a"), F.col("vec").alias("lo_vec")), "a").join(vecs.select(F.col("id").alias("b"), F.col("vec").alias("hi_vec")), "b")
    few = few.mapInArrow(_close(percent), "a long, b long")
    many = stored(alike(rows.where(F.col("m") > SMALL), percent))

    pairs = stored(few.union(proposals(many, vecs, percent)).distinct())
    classes = kept.select("id", "n").distinct().join(same.select(F.col("node").alias("id"), "w"), "id", "left").na.fill(1, ["w"])
    found = stored(verified(pairs, classes, keyed(docs).where("doc_id IS NOT NULL").select("id", "text"), n_words, percent))

    ids = known.select("id", "doc_id").distinct()
    alias = ids.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").join(ids, "doc_id").select(F.col("id").alias("a"), F.col("lo").alias("b"))
    edges = found.where("a <> b").select("a", "b").union(member.select(F.col("id").alias("a"), F.col("node").alias("b"))).union(alias)
    group = components(edges).withColumnRenamed("component_id", "root").join(ids, "id")
    least = group.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    info = group.join(least, "root").select("id", "component_id").join(member, "id", "left").withColumn("node", F.coalesce("node", "id"))
    info = info.join(same.select("node", "w"), "node", "left").join(links, "node", "left")
    info = info.select("id", "component_id", (F.coalesce("w", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    out = marks.select("id", "doc_id", F.col("n").alias("n_shingles")).join(stored(info), "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
