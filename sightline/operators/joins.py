"""Spatial joins. Rows carry report_id, ord and a box x1, y1, x2, y2.

Boxes that may meet are found by an equi-join on grid cells inside a report, so the work
follows the pairs that are near each other; a pair is kept only in the cell that holds
the low corner of its intersection, which needs no distinct."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B


def _cells(df: DataFrame, cell: float, prefix: str) -> DataFrame:
    at = lambda c: F.floor(F.col(prefix + c) / cell)
    return df.withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 256.0, on: Column | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose boxes overlap with area, found in grid cells; columns a_* and b_*."""
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns]).where("a_x2 > a_x1 AND a_y2 > a_y1")
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns]).where("b_x2 > b_x1 AND b_y2 > b_y1")
    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    a, b = _cells(a, cell, "a_"), _cells(b, cell, "b_")
    home = (F.floor(F.greatest("a_x1", "b_x1") / cell) == a["cx"]) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == a["cy"])
    cond = home & B.meets(B.box("a_"), B.box("b_")) & (a["cx"] == b["cx"]) & (a["cy"] == b["cy"])
    for s in [*same, *([on] if on is not None else [])]:
        cond = cond & s
    return a.join(b, cond).drop("cx", "cy")


def overlap_pairs(elements: DataFrame, min_iou: float = 0.01, min_area: float = 200.0, cell: float = 256.0, few: int = 500) -> DataFrame:
    """report_id, a_ord < b_ord, area, iou of pairs with at least min_area in common and IoU above
    min_iou. Reports of at most `few` elements are joined by report_id alone, on the partitioning
    that the elements have by report or get once; larger ones meet in grid cells."""
    e = elements.select("report_id", "ord", "x1", "y1", "x2", "y2").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("report_id")))
    a, b = B.box("a_"), B.box("b_")
    some = e.where(F.col("_n").between(2, few) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).drop("_n")
    one, two = (some.select([F.col(c).alias(f"{p}_{c}") for c in some.columns]) for p in "ab")
    near = one.join(two, (F.col("a_report_id") == F.col("b_report_id")) & (F.col("a_ord") < F.col("b_ord")) & B.meets(a, b))
    many = e.where(F.col("_n") > few).drop("_n")
    pairs = near.unionByName(box_join(many, many, ["report_id"], cell, F.col("a_ord") < F.col("b_ord")))
    return (
        pairs.withColumn("area", B.intersection_area(a, b))
        .where(F.col("area") >= min_area)
        .withColumn("iou", B.iou(a, b))
        .where(F.col("iou") > min_iou)
        .select(F.col("a_report_id").alias("report_id"), "a_ord", "b_ord", "area", "iou", *[c.alias(n) for c, n in zip(B.intersection(a, b), ("x1", "y1", "x2", "y2"), strict=True)])
    )


def hit_test(points: DataFrame, elements: DataFrame) -> DataFrame:
    """points (report_id, point_id, px, py): the containing element (edges count) with
    the nearest centre, the later one on ties; no row if none contains the point."""
    e = elements.select("report_id", "ord", "x1", "y1", "x2", "y2")
    cx, cy = B.center(B.box())
    hits = points.join(e, "report_id").where(B.contains(B.box(), F.col("px"), F.col("py")))
    d2 = (cx - F.col("px")) * (cx - F.col("px")) + (cy - F.col("py")) * (cy - F.col("py"))
    best = F.min(F.struct(d2.alias("d2"), (-F.col("ord")).alias("later"))).alias("m")
    return hits.groupBy("report_id", "point_id").agg(best).select("report_id", "point_id", (-F.col("m.later")).alias("ord"), F.sqrt("m.d2").alias("distance"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def by_ids(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (report_id, group, side, ids): their elements; of equal ids the last counts."""
    last = elements.groupBy("report_id", "id").agg(F.max_by(F.struct(*[c for c in elements.columns if c not in ("report_id", "id")]), "ord").alias("e"))
    return groups.withColumn("id", F.explode("ids")).drop("ids").join(last.select("report_id", "id", "e.*"), ["report_id", "id"])


def source_groups(elements: DataFrame) -> DataFrame:
    """report_id, a_key, b_key: unordered pairs of joined source lists, first seen first."""
    keys = elements.withColumn("key", F.array_join("source", ",")).groupBy("report_id", "key").agg(F.min("ord").alias("first"))
    b = keys.select("report_id", F.col("key").alias("b_key"), F.col("first").alias("b_first"))
    a = keys.select("report_id", F.col("key").alias("a_key"), F.col("first").alias("a_first"))
    return a.join(b, "report_id").where("a_first < b_first").drop("a_first", "b_first")


def cosine_pairs(vectors: DataFrame, min_sim: float, block: int = 1024) -> DataFrame:
    """a < b, sim of all pairs of unit vectors (vec_id, embedding) above min_sim. Vectors
    are dealt into blocks and blocks meet in pairs, one matrix product a pair: memory is
    two blocks however many rows there are; work is all pairs, as the operator says."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // block))
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("side"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("vec_id", "embedding", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows.side == key[0]].sort_values("vec_id")
        right = rows[rows.side == key[1]].sort_values("vec_id")
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        sims = np.stack(left.embedding.to_list()).astype(float) @ np.stack(right.embedding.to_list()).astype(float).T
        x, y = np.nonzero(sims > min_sim)
        ids_a, ids_b = left.vec_id.to_numpy()[x], right.vec_id.to_numpy()[y]
        keep = ids_a < ids_b if key[0] == key[1] else ids_a != ids_b
        a, b = np.minimum(ids_a, ids_b)[keep], np.maximum(ids_a, ids_b)[keep]
        return pd.DataFrame({"a": a, "b": b, "sim": sims[x, y][keep]})

    return both.groupBy("i", "j").applyInPandas(one, "a long, b long, sim double")


def nearest(vectors: DataFrame, k: int = 2, block: int = 1024) -> DataFrame:
    """vec_id, rank, other, sim: the k most similar others, the smaller id on ties. Each
    block pair keeps k a row, and the merge is one aggregation of k rows a block."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // block))
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("side"))
    rows = dealt.withColumn("i", F.col("side")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("role", F.lit(0))
    cols = dealt.withColumn("j", F.col("side")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("role", F.lit(1))

    def one(key, got: pd.DataFrame) -> pd.DataFrame:
        q, t = got[got.role == 0], got[got.role == 1].sort_values("vec_id")
        if not len(q) or not len(t):
            return pd.DataFrame({"vec_id": [], "other": [], "sim": []})
        ids, others = q.vec_id.to_numpy(), t.vec_id.to_numpy()
        sims = np.stack(q.embedding.to_list()).astype(float) @ np.stack(t.embedding.to_list()).astype(float).T
        sims[ids[:, None] == others] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"vec_id": np.repeat(ids, top.shape[1]), "other": others[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()})
        return out[np.isfinite(out.sim)]

    part = rows.unionByName(cols).groupBy("i", "j").applyInPandas(one, "vec_id long, other long, sim double")
    w = W.partitionBy("vec_id").orderBy(F.desc("sim"), "other")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "rank", "other", "sim")


def proximity(objects: DataFrame, keys: list[str], gap: float, cell: float) -> DataFrame:
    """Pairs a_ord < b_ord of 3-D boxes (lo, hi: arrays of 3) at most gap apart, with
    aabb: the widest gap between axes, or minus the least overlap. Grid cells on x and
    y, of a box grown by the gap, keep it from being all pairs of a scene."""
    o = objects.select(*keys, "ord", "lo", "hi")
    at = lambda c, i: F.floor((F.col(c)[i] + (gap if c.endswith("hi") else 0)) / cell)

    def side(p):
        d = o.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], F.col("ord").alias(f"{p}_ord"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
        return d.withColumn("cx", F.explode(F.sequence(at(f"{p}_lo", 0), at(f"{p}_hi", 0)))).withColumn("cy", F.explode(F.sequence(at(f"{p}_lo", 1), at(f"{p}_hi", 1))))

    a, b = side("a"), side("b")
    cond = (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & (F.col("a_ord") < F.col("b_ord"))
    for k in keys:
        cond = cond & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    for axis, c in ((0, "cx"), (1, "cy")):
        cond = cond & (F.floor(F.greatest(F.col("a_lo")[axis], F.col("b_lo")[axis]) / cell) == a[c])
    six = lambda p: [F.col(f"{p}_{c}")[i] for c in ("lo", "hi") for i in range(3)]
    out = a.join(b, cond).drop("cx", "cy").withColumn("aabb", B.aabb_distance(six("a"), six("b"))).where(F.col("aabb") <= gap)
    return out.select(*[F.col(f"a_{k}").alias(k) for k in keys], "a_ord", "b_ord", "a_lo", "a_hi", "b_lo", "b_hi", "aabb")


def _edge(c: str, i: int, more: float = 0.0) -> Column:
    """A box's side for its cells, grown a little beyond rounding; cells end at 1e15."""
    x = F.col(c)[i].cast("double")
    return F.greatest(F.least(x + more + F.abs(x) * 1e-12 if more else x, F.lit(1e15)), F.lit(-1e15))


def size_class(gap: float) -> Column:
    """The least k for which 4 ** k holds a box (lo, hi) grown by the gap on x and y, -5 or more."""
    wide = F.greatest(*[_edge("hi", i, gap) - _edge("lo", i) for i in (0, 1)])
    return F.ceil(F.log(F.greatest(wide, F.lit(1e-3))) / math.log(4.0)).cast("int")


def dealt3d(boxes: DataFrame, plain: DataFrame, key: str, gap: float, classes: list[int], carry: list[str], most: int = 4096) -> DataFrame:
    """3-D boxes (key, ord, lo, hi, size: their size class; those of which lo or hi lacks x or y are left out) dealt
    to the grid cells on x and y in which they may come near another: in cells of their own size, where
    they are at home, and of every larger one in `classes`. So however sizes differ a box is in a few cells of each, and boxes at
    home meet all others of a cell. A cell of more than `most` rows is split into blocks that meet in pairs (i, j);
    rows of a block of homes meet others by `dealt_pairs`. Nothing here is joined with the boxes but the split cells,
    which are counted in `plain`, the boxes before anything was made to carry."""
    cell = F.pow(F.lit(4.0), F.col("at"))
    at = lambda c, i, more=0.0: F.floor(_edge(c, i, more) / cell)

    def cells(d, *more):
        d = d.where(F.col(key).isNotNull() & F.col("ord").isNotNull()).select(key, "ord", "lo", "hi", "size", *more)
        d = d.withColumn("at", F.explode(F.filter(F.array(*[F.lit(k) for k in classes]), lambda k: k >= F.col("size"))))
        for i, c in enumerate(("cx", "cy")):
            d = d.withColumn(c, F.explode(F.sequence(at("lo", i), F.greatest(at("lo", i), at("hi", i, gap or 1e-12)))))
        first = (F.col("cx") == at("lo", 0)).cast("int") * 2 + (F.col("cy") == at("lo", 1)).cast("int")
        return d.select(key, "ord", "at", "cx", "cy", (F.col("size") == F.col("at")).alias("home"), first.alias("first"), *more)

    place = [key, "at", "cx", "cy"]
    full = cells(plain).groupBy(*place).agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_p")).where(F.col("_h") + F.col("_p") > most)
    blocks = lambda c: F.ceil(F.col(c) / (most / 2)).cast("int")
    full = full.select(*place, blocks("_h").alias("_h"), blocks("_p").alias("_p"))
    hashed = lambda n: F.pmod(F.xxhash64("ord"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    one = F.col("_h").isNull()
    side = F.when(one, 0).when(F.col("home"), hashed(F.col("_h"))).otherwise(F.col("_h") + hashed(F.col("_p")))
    others = F.when(one, F.array(F.lit(0))).when(F.col("home"), upto(F.col("_h") + F.col("_p"))).otherwise(upto(F.col("_h")))
    d = cells(boxes, *carry).join(full, place, "left").withColumn("side", side).withColumn("k", F.explode(others))
    d = d.select(*place, F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "home", "first", "ord", *carry)
    group = [*place, "i", "j"]
    return d.repartition(*group).sortWithinPartitions(*group, "side", F.desc("home"))


def dealt_pairs(batch, bounds: list[int], lo, hi, gap: float, tile: int = 1 << 16):
    """(a, b, aabb) of rows of groups of `dealt3d` (lo, hi: [3, n]) whose boxes are at most gap apart, each pair of a
    scene in the one group of the cell that holds the low corner of its intersection; aabb as in `proximity`."""
    import numpy as np

    col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    first, ords, same = col("first").astype(np.uint8), col("ord"), col("i") == col("j")
    left = col("home") & (col("side") == col("i"))
    for start, end in zip(bounds, bounds[1:], strict=False):
        last, a = start + int(left[start:end].sum()), start
        while a < last and (r := a + 1 if same[start] else last) < end:
            till = min(last, a + max(1, tile // (end - r)))
            apart = lo[0, None, r:end] - hi[0, a:till, None]
            for x in range(3):
                if x:
                    np.maximum(apart, lo[x, None, r:end] - hi[x, a:till, None], out=apart)
                np.maximum(apart, lo[x, a:till, None] - hi[x, None, r:end], out=apart)
            ok = apart <= gap
            ok &= (first[a:till, None] | first[None, r:end]) == 3
            p, q = np.nonzero(ok)
            aabb, p, q = apart[p, q], p + a, q + r
            keep = (ords[p] != ords[q]) & ((q > p) if same[start] else True)
            p, q, aabb = p[keep], q[keep], aabb[keep]
            turn = ords[p] > ords[q]
            yield np.where(turn, q, p), np.where(turn, p, q), aabb
            a = till


def window_output(windows: DataFrame, workspaces: DataFrame, outputs: DataFrame) -> DataFrame:
    """Where each window is shown: equi-joins along its workspace and output."""
    return windows.join(workspaces, "workspace_id").join(outputs, "output")


def pixel_diff(a: DataFrame, b: DataFrame, keys: list[str], threshold: int = 30) -> DataFrame:
    """changed of each pixel (keys, x, y, r, g, b) by luma difference."""
    from ..functions.color import luma_changed

    y = b.select(*keys, "x", "y", F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("b").alias("b2"))
    both = a.join(y, [*keys, "x", "y"])
    c = [F.col(n).cast("long") for n in ("r", "g", "b", "r2", "g2", "b2")]
    return both.withColumn("changed", luma_changed(tuple(c[:3]), tuple(c[3:]), threshold)).withColumn("differs", (c[0] != c[3]) | (c[1] != c[4]) | (c[2] != c[5])).withColumn("bytes", (c[0] != c[3]).cast("int") + (c[1] != c[4]).cast("int") + (c[2] != c[5]).cast("int"))


def change_ratio(diff: DataFrame, keys: list[str], th: float = 0.001, by: str = "pixels") -> DataFrame:
    """changed share of pixels (or of channel bytes) and whether it passes."""
    share = F.sum("bytes") / (3 * F.count(F.lit(1))) if by == "bytes" else F.count_if(F.col("differs")) / F.count(F.lit(1))
    return diff.groupBy(*keys).agg(share.alias("ratio")).withColumn("passed", F.col("ratio") > th)


def layout_size(screens: DataFrame, keys: list[str], fallback: tuple[int, int] = (4608, 1440)) -> DataFrame:
    """keys, w, h: the size that holds all screens (x, y, w, h) of a layout; the fallback where none has a size."""
    far = lambda at, size: F.max(F.col(at) + F.col(size))
    d = screens.groupBy(*keys).agg(far("x", "w").alias("w"), far("y", "h").alias("h"))
    none = F.coalesce((F.col("w") <= 0) | (F.col("h") <= 0), F.lit(True))
    return d.select(*keys, *[F.when(none, float(v)).otherwise(F.col(c)).alias(c) for c, v in zip("wh", fallback, strict=True)])
