"""Column expressions: coordinate spaces, angles, logits, and geometry of rings (arrays of structs x, y)."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lower-case prefixes of control features.
CONTROLS = ["negcontrolprobe_", "antisense_", "negcontrolcodeword_", "blank_", "deprecatedcodeword_", "unassignedcodeword_"]


def is_control(feature: Column) -> Column:
    return F.lower(feature).rlike("^(" + "|".join(CONTROLS) + ")")


def decoded(name: Column) -> Column:
    """UTF-8 bytes as text; text as it is."""
    return F.decode(name.cast("binary"), "UTF-8")


def to_raster(v: Column, low: float, resolution: float) -> Column:
    return (v - low) / F.lit(float(resolution))


def to_slide(v: Column, low: float, resolution: float) -> Column:
    return v * F.lit(float(resolution)) + low


def clip(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def cart2pol(x: Column, y: Column) -> tuple[Column, Column]:
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def pol2cart(rho: Column, phi: Column) -> tuple[Column, Column]:
    return rho * F.cos(phi), rho * F.sin(phi)


def normalize_angle(phi: Column) -> Column:
    """Radians in [-pi, pi] to [0, 1]."""
    return (phi + math.pi) / (2 * math.pi)


def denormalize_angle(share: Column) -> Column:
    return share * (2 * math.pi) - math.pi


def angle_difference_sq(a: Column, b: Column) -> Column:
    """Least squared difference of two angles in [0, 1], around the circle."""
    d = a - b
    return F.least(d * d, (d - 1) * (d - 1), (d + 1) * (d + 1))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def softmax(values: Column) -> Column:
    """Of an array, shifted by its greatest value."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def decode_logits(logits: Column, classes: int) -> tuple[Column, Column, Column]:
    """(foreground, angle in radians, class probabilities) of an array foreground, angle, classes..."""
    phi = sigmoid(logits[1]) * (2 * math.pi) - math.pi
    return sigmoid(logits[0]), F.atan2(F.sin(phi), F.cos(phi)), softmax(F.slice(logits, 3, classes))


def flow_destination(x: Column, y: Column, angle: Column, magnitude: float, width, height) -> tuple[Column, Column]:
    """The pixel that the angle points to, rounded half to even and kept in the grid."""
    fx = F.rint(x + magnitude * F.cos(angle)).cast("long")
    fy = F.rint(y + magnitude * F.sin(angle)).cast("long")
    return clip(fx, 0, width - 1), clip(fy, 0, height - 1)


def ring_edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2), the last edge closing the ring."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _summed(ring: Column, term) -> Column:
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + term(e, e["x1"] * e["y2"] - e["x2"] * e["y1"]))


def ring_area_signed(ring: Column) -> Column:
    """Positive for a ring that runs counter-clockwise, so that a ring's holes, which run the other way, are taken off in a sum."""
    return _summed(ring, lambda e, c: c) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(_summed(ring, lambda e, c: c)) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    whole = _summed(ring, lambda e, c: c) * 3
    return _summed(ring, lambda e, c: (e["x1"] + e["x2"]) * c) / whole, _summed(ring, lambda e, c: (e["y1"] + e["y2"]) * c) / whole


def ring_bounds(ring: Column) -> dict[str, Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Inside by crossing number, or on an edge."""
    edges = ring_edges(ring)
    crossed = F.size(F.filter(edges, lambda e: edge_crossed(e, x, y)))
    return (crossed % 2 == 1) | F.exists(edges, lambda e: on_edge(e, x, y))


def edge_crossed(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge; its lower end counts, its upper doesn't."""
    across = x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(across, F.lit(False))


def on_edge(e: Column, x: Column, y: Column) -> Column:
    return ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def edge_distance_sq(e: Column, x: Column, y: Column) -> Column:
    """Squared distance of a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    px, py = e["x1"] + t * dx - x, e["y1"] + t * dy - y
    return px * px + py * py


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon, 0 inside."""
    return F.when(in_ring(ring, x, y), F.lit(0.0)).otherwise(F.sqrt(F.array_min(F.transform(ring_edges(ring), lambda e: edge_distance_sq(e, x, y)))))


def affine(ring: Column, m: list[list[float]]) -> Column:
    """A 3 x 3 affine matrix applied to every vertex."""
    return F.transform(ring, lambda p: F.struct((p["x"] * m[0][0] + p["y"] * m[0][1] + m[0][2]).alias("x"), (p["x"] * m[1][0] + p["y"] * m[1][1] + m[1][2]).alias("y")))


def crossing_edges(ring: Column) -> Column:
    """Whether two edges that aren't neighbours meet properly."""
    edges = ring_edges(ring)
    at = F.zip_with(edges, F.sequence(F.lit(0), F.size(ring) - 1), lambda e, k: F.struct(e.alias("e"), k.alias("k")))

    def side(ax, ay, bx, by, cx, cy):
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def meets(p: Column, q: Column) -> Column:
        a, b = p["e"], q["e"]
        apart = (q["k"] - p["k"] > 1) & ~((p["k"] == 0) & (q["k"] == F.size(ring) - 1))
        s = [side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"]), side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])]
        return apart & (s[0] * s[1] < 0) & (s[2] * s[3] < 0)

    return F.exists(at, lambda p: F.exists(at, lambda q: meets(p, q)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def whole_box(ring: Column, space, low_x: float, low_y: float) -> list[Column]:
    """Whole numbers x1, y1, x2, y2 around a ring moved by space(value, low)."""
    b = ring_bounds(ring)
    down = [F.floor(space(b[c], low)).alias(n) for c, low, n in (("xmin", low_x, "x1"), ("ymin", low_y, "y1"))]
    return down + [F.ceil(space(b[c], low)).alias(n) for c, low, n in (("xmax", low_x, "x2"), ("ymax", low_y, "y2"))]


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function; null where z is."""
    return z.map(lambda v: (1 + math.erf(v / math.sqrt(2))) / 2, na_action="ignore")
