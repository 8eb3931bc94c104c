"""Box algebra as columns. A box is four columns (x1, y1, x2, y2) or an array of four.
Rounding is half to even throughout (rint), as coordinates are compared as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names=("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def of_array(a: Column) -> Box:
    return tuple(F.get(a, F.lit(i)) for i in range(4))


def css_to_device(c: Column, scroll: Column, dpr: Column) -> Column:
    return F.rint((c - scroll) * dpr)


def device_to_css(d: Column, scroll: Column, dpr: Column) -> Column:
    return F.rint(d / dpr + scroll)


def scaled(b: Box, k) -> Box:
    return tuple(F.rint(c * k) for c in b)


def clipped(b: Box, w, h) -> Box:
    """Rounded, then held inside: low edges from below, high edges from above only."""
    x1, y1, x2, y2 = (F.rint(c) for c in b)
    return F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0)), F.least(x2, w), F.least(y2, h)


def area(b: Box) -> Column:
    side = lambda a, z: F.greatest(z - a, F.lit(0))
    return side(b[0], b[2]) * side(b[1], b[3])


def meets(a: Box, b: Box) -> Column:
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def intersection(a: Box, b: Box) -> Box:
    """Rounded to whole numbers; only where `meets`."""
    return F.rint(F.greatest(a[0], b[0])), F.rint(F.greatest(a[1], b[1])), F.rint(F.least(a[2], b[2])), F.rint(F.least(a[3], b[3]))


def intersection_area(a: Box, b: Box) -> Column:
    return F.when(meets(a, b), area(intersection(a, b))).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Rounded intersection over unrounded areas; 0 if the union is empty."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def contains(b: Box, x: Column, y: Column) -> Column:
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def aligned(a: Box, b: Box, min_iou: float = 0.5) -> Column:
    """IoU of at least min_iou, or the smaller box's centre inside the larger."""
    (ax, ay), (bx, by) = center(a), center(b)
    inside = F.when(area(a) <= area(b), contains(b, ax, ay)).otherwise(contains(a, bx, by))
    return (iou(a, b) >= min_iou) | inside


def notation(b: Box) -> Column:
    return F.format_string("[bbox: %d, %d, %d, %d]", *[F.rint(c).cast("long") for c in b])


def offset(b: Box, dx, dy) -> Box:
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def zoom_back(b: Box, ox, oy, factor=2) -> Box:
    return b[0] / factor + ox, b[1] / factor + oy, b[2] / factor + ox, b[3] / factor + oy


def logical_scale(physical: Column, logical: Column) -> Column:
    return F.when(logical > 0, physical / logical).otherwise(F.lit(1.0))


def from_pos_size(pos: Column, size: Column) -> Column:
    return F.array(pos[0], pos[1], pos[0] + size[0], pos[1] + size[1])


def region(text: Column) -> Column:
    """"x1,y1,x2,y2" in any order of corners as a sorted box; null on bad arity."""
    p = F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))
    ok = (F.size(p) == 4) & ~F.exists(p, lambda v: v.isNull())
    return F.when(ok, F.array(F.least(p[0], p[2]), F.least(p[1], p[3]), F.greatest(p[0], p[2]), F.greatest(p[1], p[3])))


def half_away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def cxcywh(cx: Column, cy: Column, w: Column, h: Column, k) -> Box:
    return (cx - w / 2) * k, (cy - h / 2) * k, (cx + w / 2) * k, (cy + h / 2) * k


def aabb_distance(a: list[Column], b: list[Column]) -> Column:
    """Of boxes (x1, y1, z1, x2, y2, z2): the widest gap between axes, or minus the least overlap."""
    gaps = [F.greatest(b[i] - a[i + 3], a[i] - b[i + 3]) for i in range(3)]
    return F.greatest(*gaps)


def transform_point(m: Column, p: Column) -> Column:
    """Row-major 4 x 4 matrix (16 doubles) times a point."""
    return F.array(*[m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)])


def fov(sensor: Column, lens: Column) -> Column:
    return 2 * F.atan(sensor / (2 * lens))


def triangles(loops: Column) -> Column:
    """Of polygons with these corner counts, as a fan."""
    return F.aggregate(loops, F.lit(0).cast("long"), lambda a, n: a + F.greatest(n.cast("long") - 2, F.lit(0).cast("long")))


def every(verts: Column, most: int = 4000) -> Column:
    """At most `most` items at an even stride: the places are made first, so that the array is looked at as often as items are taken."""
    n = F.size(verts)
    step = F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.get(verts, i))).otherwise(verts)
