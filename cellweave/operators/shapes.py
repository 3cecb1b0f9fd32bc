"""Outlines of pixel segments and comparisons of segmentations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.operators import spatial
from cellweave.sources.scratch import stored


BLOCK = 192  # side of a block of pixels whose outlines are followed in one task
ROWS_A_TASK = 1 << 17  # pixels or edges dealt to a task, whose blocks are done one after the other


def _dealt(rows: DataFrame, x: str, y: str, block: int):
    """rows grouped by the blocks that they lie in or next to. Tasks are as many as the rows ask for: packed, rows are small for what they take."""
    rows = stored(rows)
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / block), F.floor((F.col(c) + 1) / block)))
    tasks = -(-rows.count() // ROWS_A_TASK) or 1
    return rows.withColumn("_bx", blocks(x)).withColumn("_by", blocks(y)).repartition(tasks, "_bx", "_by").groupBy("_bx", "_by")


def _placed(key, t, x: str, y: str, block: int):
    """Of the rows of a block: names of segments, numbers of segments, coordinates, which rows lie in the block, and a number for each segment and
    place, as a function of shifts; places next to the block have one too."""
    x0, y0 = (v.as_py() * block for v in key)
    named = t.column("segment_id").combine_chunks().dictionary_encode()
    seg, px, py = named.indices.to_numpy().astype(np.int64), *(t.column(c).to_numpy().astype(np.int64) for c in (x, y))
    own = (px >= x0) & (px < x0 + block) & (py >= y0) & (py < y0 + block)
    side = block + 4
    return named.dictionary, seg, px, py, own, lambda i, j: (seg * side + px + i - x0 + 2) * side + py + j - y0 + 2


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where wanted keys stand among sorted ones; -1: nowhere."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


_SIDES = [((0, -1), (0, 0, 1, 0)), ((1, 0), (1, 0, 1, 1)), ((0, 1), (1, 1, 0, 1)), ((-1, 0), (0, 1, 0, 0))]  # the pixel beyond a side, and the side's ends


def _outlined(block: int):
    def run(key, t):
        names, seg, x, y, own, place = _placed(key, t, "x", "y", block)
        held = np.sort(place(0, 0))
        parts = []
        for (i, j), ends in _SIDES:
            k = np.flatnonzero(own & (_found(held, place(i, j)) < 0))
            parts.append(np.column_stack([seg[k], *[(x, y)[n % 2][k] + d for n, d in enumerate(ends)]]))
        all_ = np.concatenate(parts)
        return pa.table([names.take(pa.array(all_[:, 0])), *[pa.array(all_[:, n]) for n in range(1, 5)]], ["segment_id", "x1", "y1", "x2", "y2"])

    return run


def boundary_edges(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Directed unit edges (segment_id, x1, y1, x2, y2) of each segment's outline, counter-clockwise: a pixel's sides beyond which the segment
    doesn't go on. A block's pixels and those next to it meet in one task, of a size that the block's area bounds."""
    kind = segments.schema["segment_id"].dataType.simpleString()
    return _dealt(segments.select("segment_id", "x", "y"), "x", "y", block).applyInArrow(_outlined(block), f"segment_id {kind}, x1 long, y1 long, x2 long, y2 long")


def pixel_areas(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_id").agg(F.count("*").alias("area"))


def _followed(jump: np.ndarray, ends: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By doubling, of each edge: the least value among those that follow it, the end it comes to (some edge of a ring without end) and how far that is."""
    jump, far, least = np.where(ends, np.arange(len(jump)), jump), (~ends).astype(np.int64), least.copy()
    for _ in range(len(jump).bit_length()):
        least, far, jump = np.minimum(least, least[jump]), far + far[jump], jump[jump]
    return least, jump, far


def _strung(block: int):
    """Paths of the edges that start in one block: rows (segment_id, e, to, es) with the numbers es of a path's edges in their order, its first one, e,
    and that of the edge after its last, in another block; null where the path is a ring, which begins with its least edge."""

    def run(key, t):
        names, seg, x, y, own, place = _placed(key, t, "x1", "y1", block)
        right, up = t.column("x2").to_numpy() - x, t.column("y2").to_numpy() - y
        d = np.where(right == 1, 0, np.where(up == 1, 1, np.where(right == -1, 2, 3)))
        start, end = place(0, 0) * 4 + d, place(right, up) * 4
        by = np.argsort(start)
        ways = np.stack([_found(start[by], end + k) for k in range(4)])
        open_ = ways >= 0  # two where pixels touch at a corner; there a left turn stays on the pixel
        way = np.where(open_.sum(0) == 1, open_.argmax(0), (d + 1) % 4)
        after = by[ways[way, np.arange(len(d))]]
        e = ((x << 31) + y) * 4 + d
        mine = np.flatnonzero(own)
        at = np.full(len(d), -1)
        at[mine] = np.arange(len(mine))
        seg, e, to = seg[mine], e[mine], e[after[mine]]
        jump, leaves = at[after[mine]], at[after[mine]] < 0
        least, last, _ = _followed(jump, leaves, e)
        ring = ~leaves[last]
        least, last, far = _followed(jump, leaves | ring & (to == least), e)
        by = np.lexsort((-far, last))
        first = np.flatnonzero(np.diff(last[by], prepend=-1))
        es = pa.ListArray.from_arrays(pa.array(np.append(first, len(by)).astype(np.int32)), pa.array(e[by]))
        end = last[by][first]
        return pa.table([names.take(pa.array(seg[end])), pa.array(e[by][first]), pa.array(to[end], mask=ring[end]), es], ["segment_id", "e", "to", "es"])

    return run


def chained(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (segment_id, ring, points array of struct x, y): outline edges of whole coordinates from 0 on, chained into rings, which are
    numbered by their first points.

    The edges that start in a square block are strung in one task, of a size that the block's area bounds; most rings lie in one block. The
    paths of the others are ranked by doubling: each knows the least path among the 2^k that follow it and how far that is, and meets
    the path 2^k on for the next round. Once no round changes, the least path is the ring's first and the distance tells a path's place, after as
    many rounds as the number of the longest ring's paths has binary digits. Only paths of a segment and place meet, whatever the ring's size."""
    kind = edges.schema["segment_id"].dataType.simpleString()
    paths = stored(_dealt(edges, "x1", "y1", block).applyInArrow(_strung(block), f"segment_id {kind}, e long, to long, es array<long>"))
    cut, rings = paths.where("to IS NOT NULL"), paths.where("to IS NULL").select("segment_id", "es")
    now, k = stored(cut.select("segment_id", "e", "to", F.col("e").alias("least"), F.lit(0).cast("long").alias("far"))), 0
    while True:
        ahead = now.select("segment_id", F.col("e").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("far").alias("far2"))
        less = F.col("least2") < F.col("least")
        after = now.hint("merge").join(ahead, ["segment_id", "to"]).select("segment_id", "e", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), F.when(less, F.col("far2") + (1 << k)).otherwise(F.col("far")).alias("far"), less.alias("moved"))
        now, k = stored(after), k + 1
        if now.where("moved").isEmpty():
            break
    # far is the way ahead to the first path: 0 for it, then one less than the number of paths and so on down
    whole = now.hint("merge").join(cut.select("segment_id", "e", "es"), ["segment_id", "e"]).groupBy("segment_id", "least").agg(F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("place"), "es"))).alias("c"))  # an outline's own paths
    rings = rings.unionByName(whole.select("segment_id", F.flatten(F.col("c.es")).alias("es")))
    low = F.array_min("es")
    turned = rings.withColumn("_at", F.array_position("es", low).cast("int")).select("segment_id", low.alias("least"), F.concat(F.slice("es", F.col("_at"), F.size("es")), F.slice("es", F.lit(1), F.col("_at") - 1)).alias("es"))
    points = F.transform("es", lambda e: F.struct(F.shiftright(e, 33).cast("double").alias("x"), F.shiftright(e, 2).bitwiseAND((1 << 31) - 1).cast("double").alias("y")))
    ring = F.row_number().over(W.partitionBy("segment_id").orderBy("least")) - 1
    return turned.select("segment_id", ring.alias("ring"), points.alias("points"))


def jaccard_of_members(a: DataFrame, b: DataFrame, pairs: DataFrame, a_col: str, b_col: str, member: str) -> DataFrame:
    """pairs (a_col, b_col) with |A and B|, |A or B| and their ratio over long membership tables (id, member)."""
    both = a.join(b, member).groupBy(a_col, b_col).agg(F.count("*").alias("shared"))
    na, nb = (t.groupBy(c).agg(F.count("*").alias(n)) for t, c, n in ((a, a_col, "na"), (b, b_col, "nb")))
    met = pairs.join(both, [a_col, b_col], "left").join(na, a_col, "left").join(nb, b_col, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    union = zero("na") + zero("nb") - zero("shared")
    return met.select(a_col, b_col, zero("shared").alias("shared"), union.alias("either"), F.when(union > 0, zero("shared") / union).otherwise(F.lit(0.0)).alias("jaccard"))


def pixel_iou(a: DataFrame, b: DataFrame, a_col: str, b_col: str, threshold: float) -> DataFrame:
    """Best-overlap pairs of two pixel segmentations with their intersection over union."""
    best = spatial.max_overlap(spatial.pixel_overlaps(a, b, a_col, b_col), a_col, b_col, threshold)
    na, nb = (t.groupBy(c).agg(F.count("*").alias(n)) for t, c, n in ((a, a_col, "na"), (b, b_col, "nb")))
    met = best.join(na, a_col).join(nb, b_col)
    return met.select(a_col, b_col, "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("iou"))


def confusion(truth: DataFrame, method: DataFrame, best: DataFrame, member: str) -> DataFrame:
    """A row a method segment: members, members of another truth cell than its best one (n_confused), members of none (n_background).

    truth: truth_id, member; method: segment_id, member; best: truth_id, segment_id of best overlap."""
    met = method.join(truth, member, "left").join(best.select("segment_id", F.col("truth_id").alias("own")), "segment_id")
    other = F.col("truth_id").isNotNull() & (F.col("truth_id") != F.col("own"))
    return met.groupBy("segment_id", "own").agg(F.count("*").alias("n_transcripts"), F.sum(other.cast("long")).alias("n_confused"), F.sum(F.col("truth_id").isNull().cast("long")).alias("n_background"))
