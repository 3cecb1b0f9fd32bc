"""Growing and trimming of segments on a pixel grid. Growth runs to its end in blocks with margins, in one shuffle; components and
trimming are loops whose every step is a plan that is written.

Pixel tables are dense: pixels (x, y, label) with -1 unlabelled, 0 background, > 0 a segment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions import scalars as S
from cellweave.operators.celltypes import confidence_trace
from cellweave.operators.grid import dictionary, shared_around
from cellweave.sources.scratch import stored

STEPS = 15  # the most steps of growth
DIAGONALS = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
REACH = 3  # pixels from which a step takes what it looks at: a flow target is 2 away at most, and an island's neighbour 1 more
BLOCK = 192  # side of a block that is grown in one task
BLOCKS_A_TASK = 8  # blocks that one task grows, one after the other; what it sorts before is as large as they are
NO_PIXEL, NEVER = -(1 << 40), 1 << 40


def with_targets(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """pixels (x, y, label, angle, foreground) with flow targets at sqrt 2 (fx, fy) and sqrt 3 (gx, gy)."""
    fx, fy = S.flow_destination(F.col("x"), F.col("y"), F.col("angle"), math.sqrt(2), width, height)
    gx, gy = S.flow_destination(F.col("x"), F.col("y"), F.col("angle"), math.sqrt(3), width, height)
    return pixels.select("x", "y", "label", "foreground", fx.alias("fx"), fy.alias("fy"), gx.alias("gx"), gy.alias("gy"))


def gathered(rows: DataFrame, labels: DataFrame, at: tuple[str, str], name: str) -> DataFrame:
    """rows with the label at (at); an equi-join on pixels."""
    return rows.join(labels.select(F.col("x").alias(at[0]), F.col("y").alias(at[1]), F.col("label").alias(name)), list(at), "left")


def filled(labels: DataFrame) -> DataFrame:
    """Unlabelled pixels whose four neighbours share a label other than -1, background included, take it."""
    shared = shared_around(labels, labels.where("label = -1")).where("shared <> -1")
    return labels.join(shared, ["x", "y"], "left").select("x", "y", F.coalesce("shared", "label").alias("label"))


def _grow(steps: int, threshold: float, width: int, height: int, block: int):
    """All steps of growth for the pixels of one block, from its pixels and those around it."""
    halo = REACH * steps
    side = block + 2 * halo

    def run(key, t):
        x0, y0 = (k.as_py() * block - halo for k in key)
        c = {n: t.column(n).to_numpy() for n in ("x", "y", "label", "foreground", "fx", "fy", "gx", "gy", "stop")}
        nowhere = side * side  # holds no label

        def at(x, y):
            i, j = x - x0, y - y0
            return np.where((i >= 0) & (i < side) & (j >= 0) & (j < side), i * side + j, nowhere)

        here = at(c["x"], c["y"])
        label, taken = np.full(nowhere + 1, NO_PIXEL), np.zeros(nowhere + 1, np.int64)
        label[here] = c["label"]
        stops, first = np.unique(c["label"], return_index=True)
        stop = c["stop"][first]
        opens = np.flatnonzero((c["label"] == -1) & (c["foreground"] >= threshold))
        one, two = at(c["fx"], c["fy"])[opens], at(c["gx"], c["gy"])[opens]
        corners = [at(np.clip(c["x"][opens] + i, 0, width - 1), np.clip(c["y"][opens] + j, 0, height - 1)) for i, j in DIAGONALS]
        bare = np.flatnonzero(c["label"] == -1)
        around = [at(c["x"][bare] + i, c["y"][bare] + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        mine, blank = here[opens], here[bare]
        for step in range(steps):
            flow = label[one] if step == 0 else np.maximum(label[one], label[two])
            ok = (label[mine] == -1) & (flow != -1) & (flow != NO_PIXEL)
            ok &= np.any([label[k] == flow for k in corners], 0)
            place = np.minimum(np.searchsorted(stops, flow), len(stops) - 1)
            ok &= ~((stops[place] == flow) & (stop[place] <= step))
            label[mine[ok]], taken[mine[ok]] = flow[ok], step + 1
            near = [label[k] for k in around]
            ring = near[0]
            fill = (label[blank] == -1) & (ring != -1) & (ring != NO_PIXEL) & (near[1] == ring) & (near[2] == ring) & (near[3] == ring)
            label[blank[fill]], taken[blank[fill]] = ring[fill], step + 1
            if step and not ok.any() and not fill.any():
                break  # the first step looks less far than the others, so it never is the last
        core = (c["x"] >= x0 + halo) & (c["x"] < x0 + halo + block) & (c["y"] >= y0 + halo) & (c["y"] < y0 + halo + block)
        return pa.table([pa.array(c["x"][core]), pa.array(c["y"][core]), pa.array(label[here[core]]), pa.array(taken[here[core]])], ["x", "y", "label", "step"])

    return run


def grown(pixels: DataFrame, width: int, height: int, steps: int, threshold: float = 0.5, stops: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rows (x, y, label, step) after `steps` steps of growth; step: at which a pixel took its label, 0 if it has that of the start.

    In a step an unlabelled foreground pixel takes the label at its flow target if a diagonal neighbour has it; then unlabelled pixels
    whose four neighbours share a label take that. stops (label, step): ids that nothing flows into from that step (from 0) on; islands still
    take them. A step reaches REACH pixels, so a square block with a margin of REACH * steps pixels holds all that its own pixels depend
    on: each block is grown to the end in one task, of a size that the block's area bounds, and pixels are shuffled once. Blocks lie in the raster
    of width x height; the number of tasks follows from it, since shuffled pixels are small for what they take unpacked."""
    halo = REACH * steps
    rows = with_targets(pixels, width, height)
    stop = F.lit(NEVER).cast("long") if stops is None else F.coalesce("_stop", F.lit(NEVER)).cast("long")
    if stops is not None:
        rows = rows.join(stops.select("label", F.col("step").alias("_stop")), "label", "left")
    last = {"x": (width - 1) // block, "y": (height - 1) // block}
    blocks = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / block), F.lit(0)), F.least(F.floor((F.col(c) + halo) / block), F.lit(last[c]))))
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y", "label", "fx", "fy", "gx", "gy")]
    dealt = rows.select(*whole, F.col("foreground").cast("double").alias("foreground"), stop.alias("stop")).withColumn("bx", blocks("x")).withColumn("by", blocks("y"))
    tasks = -(-(last["x"] + 1) * (last["y"] + 1) // BLOCKS_A_TASK)
    return dealt.repartition(tasks, "bx", "by").groupBy("bx", "by").applyInArrow(_grow(steps, threshold, width, height, block), "x long, y long, label long, step long")


def greedy_expansion(pixels: DataFrame, width: int, height: int, steps: int, threshold: float = 0.5, stops: DataFrame | None = None, when: bool = False) -> DataFrame:
    """Rows (x, y, label) after growth; with `when` also the step that took each pixel."""
    return grown(pixels, width, height, steps, threshold, stops).select("x", "y", "label", *["step"] * when)


TARGET = 2  # pixels from which a flow target at sqrt 2 lies at most


def _joined(block: int, height: int):
    """Components of the links that start in one block: rows (v, c, own, shared) of each pixel v that they touch, with the least pixel number c of
    its component; own: v is foreground and lies in the block; shared: links of other blocks may touch it."""

    def run(key, t):
        bx, by = (k.as_py() for k in key)
        start, to = t.column("id").to_numpy(), t.column("to").to_numpy()
        v, at = np.unique(np.concatenate([start, to]), return_inverse=True)
        a, b = at[: len(start)], at[len(start) :]
        c = np.arange(len(v))
        while True:
            least = np.minimum(c[a], c[b])
            was = c.copy()
            for ends in (c[a], c[b]):
                np.minimum.at(c, ends, least)
            while (c[c] != c).any():
                c = c[c]
            if (was == c).all():
                break
        i, j = v // height - bx * block, v % height - by * block
        inner = (i >= TARGET) & (i < block - TARGET) & (j >= TARGET) & (j < block - TARGET)
        own = np.zeros(len(v), bool)
        own[a] = True
        return pa.table([pa.array(v), pa.array(v[c]), pa.array(own), pa.array(~inner)], ["v", "c", "own", "shared"])

    return run


def flow_components(pixels: DataFrame, width: int, height: int, least: int = 20, threshold: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Undirected components of foreground pixels linked to their flow targets, which need not be foreground themselves, of at least
    `least` foreground pixels, numbered 1 .. n by their first pixel; other pixels are 0, but for those whose four neighbours
    share a component, which join it.

    The links that start in a square block are joined in one task, whose size the block's area bounds. Components of blocks that share a
    pixel at an edge are linked, and only these links, a small part of the pixels, take part in propagation with jumps."""
    number = F.col("x").cast("long") * height + F.col("y")
    fx, fy = S.flow_destination(F.col("x"), F.col("y"), F.col("angle"), math.sqrt(2), width, height)
    on = pixels.where(F.col("foreground") >= threshold).select(number.alias("id"), (fx * height + fy).cast("long").alias("to"), *[F.floor(F.col(c) / block).alias(f"b{c}") for c in ("x", "y")])
    local = stored(on.groupBy("bx", "by").applyInArrow(_joined(block, height), "v long, c long, own boolean, shared boolean"))
    links = local.where("shared").select("c", F.min("c").over(W.partitionBy("v")).alias("m")).where("c <> m").distinct()
    edges = stored(links.select(F.col("c").alias("a"), F.col("m").alias("b")).union(links.select("m", "c")))
    labels = stored(edges.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).withColumnRenamed("a", "id")
        step = labels.join(near, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("n"), "c")
        jump = labels.select(F.col("id").alias("n"), F.col("c").alias("far"))
        after = stored(step.join(jump, "n", "left").select("id", F.least("n", "far").alias("c"), (F.least("n", "far") < F.col("c")).alias("moved")))
        if after.where("moved").isEmpty():
            break
        labels = after.select("id", "c")
    whole = labels.select(F.col("id").alias("c"), F.col("c").alias("root"))
    found = stored(local.where("own").join(whole, "c", "left").select(F.col("v").alias("id"), F.coalesce("root", "c").alias("c")))
    sizes = found.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    named = found.hint("merge").join(dictionary(sizes, "c", "label", 1), "c").select("id", "label")
    out = stored(pixels.select("x", "y", number.alias("id")).hint("merge").join(named, "id", "left").select("x", "y", F.coalesce("label", F.lit(0)).cast("long").alias("label")))
    islands = shared_around(out, out.where("label = 0")).where("shared <> 0")
    return out.hint("merge").join(islands, ["x", "y"], "left").select("x", "y", F.coalesce("shared", "label").alias("label"))


MARGIN = 16  # pixels around a block that are peeled with it, so that most segments at its edge are whole


def _peeled(block: int, margin: int):
    """The pixels of one block with what is left of them after peeling to the end in and around it. A pixel at the edge of what the task holds is never
    peeled, and a neighbour that is held too long only keeps others, so nothing is peeled too much. Rows of rim pixels, those at the block's edge and next
    to it, tell whether its blocks agree."""
    side = block + 2 * margin
    here = np.zeros((side, side), bool)
    here[margin:-margin, margin:-margin] = True
    rim = np.zeros((side, side), bool)
    rim[margin - 1 : side - margin + 1, margin - 1 : side - margin + 1] = True
    rim[margin + 1 : side - margin - 1, margin + 1 : side - margin - 1] = False
    inner = np.zeros((side, side), bool)
    inner[1:-1, 1:-1] = True

    def run(key, pixels, marks):
        x0, y0 = (k.as_py() * block - margin for k in key)
        at = (pixels.column("x").to_numpy() - x0) * side + pixels.column("y").to_numpy() - y0
        given = pixels.column("label").to_numpy()
        label, times, fixed = np.zeros(side * side, np.int64), np.bincount(at, minlength=side * side), np.zeros(side * side, bool)
        label[at] = given
        fixed[(marks.column("x").to_numpy() - x0) * side + marks.column("y").to_numpy() - y0] = True
        open_ = np.flatnonzero((label > 0) & ~fixed & inner.ravel())
        while len(open_):
            same = sum(np.where(label[open_ + d] == label[open_], times[open_ + d], 0) for d in (-side, side, -1, 1))
            gone = same < 4
            if not gone.any():
                break
            label[open_[gone]] = 0
            open_ = open_[~gone]
        own, edge = here.ravel()[at], rim.ravel()[at]
        told = own | edge
        cols = [pixels.column("x").to_numpy(), pixels.column("y").to_numpy(), given, times[at], label[at] > 0, own, edge]
        return pa.table([pa.array(c[told]) for c in cols], ["x", "y", "label", "n", "kept", "own", "rim"])

    return run


def cull_empty_pixels(labels: DataFrame, tx: DataFrame, prior: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """Peel border pixels of segments that hold no transcript and no prior label, until none is left.

    labels: x, y, label of the grid; tx: x, y; prior: x, y. Removal only grows the set of borders, so the end doesn't depend on the order: a
    block and a margin around it are peeled to the end in one task, of a size that the area bounds, and only where blocks that share pixels disagree
    all are peeled once more from what was left. Pixels of a place that comes several times are kept as often as a join of them gives."""
    labels = stored(labels.select("x", "y", "label"))
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / block), F.floor((F.col(c) + margin) / block)))
    dealt = lambda df: df.where("x IS NOT NULL AND y IS NOT NULL").withColumn("bx", blocks("x")).withColumn("by", blocks("y")).groupBy("bx", "by")
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y")]
    marks, soft = tx.select(*whole).unionByName(prior.select(*whole)), labels.where("label > 0").select(*whole, F.col("label").cast("long").alias("label"))
    gone = []
    while True:
        each = stored(dealt(soft).cogroup(dealt(marks)).applyInArrow(_peeled(block, margin), "x long, y long, label long, n long, kept boolean, own boolean, rim boolean"))
        own = each.where("own")
        gone.append(own.where("NOT kept").select("x", "y", F.lit(0).cast("long").alias("label")))
        kept = own.where("kept").select("x", "y", "label", "n")
        if each.where("rim").groupBy("x", "y").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).where("a <> b").isEmpty():
            break
        soft = kept.drop("n")
    out = kept.select("x", "y", "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")
    for more in gone:
        out = out.unionByName(more)
    return out.unionByName(labels.where("label IS NULL OR label <= 0"))


def best_step(trace: DataFrame) -> DataFrame:
    """trace: segment_id, step, gain. The step of greatest gain, the latest on ties."""
    return trace.groupBy("segment_id").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), "step")).alias("_b")).select("segment_id", F.col("_b.step").alias("step"), F.col("_b.gain").alias("gain"))


def early_stopped(pixels: DataFrame, px: DataFrame, profiles: DataFrame, priors: DataFrame, width: int, height: int, steps: int, threshold: float = 0.5) -> DataFrame:
    """Rows (x, y, label): growth in which a segment stops at the step that gained most confidence in its type.

    The first run tells the step at which each pixel was taken; the second stops a segment once the step reaches its best one."""
    first = grown(pixels, width, height, steps, threshold).where("label > 0").join(px, ["x", "y"])
    gained = first.groupBy(F.col("label").alias("segment_id"), "gene_id", F.col("step").cast("int").alias("step")).agg(F.count("*").alias("n"))
    best = stored(best_step(confidence_trace(gained, profiles, priors, steps)))
    return greedy_expansion(pixels, width, height, steps, threshold, best.select(F.col("segment_id").alias("label"), "step"))


def ray_segmentation(pixels: DataFrame, hits: DataFrame, best: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (x, y, label): labels are kept; an unlabelled foreground pixel takes the segment its ray hits within that segment's best length.

    hits: x, y, segment_id, distance; best: segment_id, step (a length)."""
    near = hits.hint("merge").join(best.select("segment_id", "step"), "segment_id").where(F.col("distance") <= F.col("step")).select("x", "y", "segment_id")
    open_ = (F.col("label") == -1) & (F.col("foreground") >= threshold) & F.col("segment_id").isNotNull()
    return pixels.join(near, ["x", "y"], "left").select("x", "y", F.when(open_, F.col("segment_id")).when(F.col("label") > 0, F.col("label")).otherwise(F.lit(0)).alias("label"))
