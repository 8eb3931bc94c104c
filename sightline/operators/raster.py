"""Raster statistics. Exploded rasters are rows (image_id, x, y, r, g, b) and are reduced
by built-in aggregates; what is sequential inside an image (labelling, edges, palettes,
superpixels, resampling) runs on whole images, one a row: image_id, w, h, data
(interleaved RGB bytes), through mapInPandas."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C

RGB = ("r", "g", "b")


def pixels(images: DataFrame) -> DataFrame:
    """Rows of pixels (image_id, x, y, r, g, b, w, h) from image_id, w, h, data; JVM expressions only."""
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, 3 * i + {k + 1}, 1)")), 16, 10).cast("int")
    d = images.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") * F.col("h") - 1)))
    return d.select("image_id", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).alias("y"), *[byte(k).alias(c) for k, c in enumerate(RGB)], "w", "h")


def histogram(px: DataFrame, key: str = "image_id") -> DataFrame:
    return px.groupBy(key, *RGB).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """min, max, mean and the values at rank round((n - 1) share), half up. Ranks come from
    counts per distinct value, so a group's rows are never gathered."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    c = c.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    at = lambda s: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * s + 0.5), F.col(value)))
    return c.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), *[at(s).alias(f"q{int(100 * s)}") for s in shares])


def equal_bins(value: Column, bins: int, lo=0.0, hi=1.0, closed_last: bool = False) -> Column:
    """Bin number of [lo, hi) in equal parts; hi itself has none unless closed_last."""
    k = F.floor((value - lo) * bins / (hi - lo)).cast("int")
    k = F.when((value >= lo) & (value < hi), F.least(k, F.lit(bins - 1)))
    return k.when(value == hi, bins - 1) if closed_last else k


def otsu(df: DataFrame, keys: list[str], gray: str, n: str | None = None) -> DataFrame:
    """keys, threshold: the first value of greatest between-class variance, by running
    sums over counts (n, if the rows are counts already); a uniform group gives its value."""
    c = df.groupBy(*keys, gray).agg(F.sum(n).alias("n") if n else F.count(F.lit(1)).alias("n"))
    low = W.partitionBy(*keys).orderBy(gray).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*keys)
    n, s = F.sum("n"), F.sum(F.col("n") * F.col(gray))
    c = c.withColumns({"n0": n.over(low), "s0": s.over(low), "nt": n.over(all_), "st": s.over(all_)})
    n1 = F.col("nt") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - F.when(n1 > 0, (F.col("st") - F.col("s0")) / F.when(n1 > 0, n1))
    c = c.withColumn("between", F.coalesce(F.col("n0").cast("double") * n1 * gap * gap, F.lit(0.0)))
    return c.groupBy(*keys).agg(F.max_by(gray, F.struct("between", -F.col(gray))).alias("threshold"))


def foreground(df: DataFrame, keys: list[str], gray: str, thresholds: DataFrame) -> DataFrame:
    return df.join(thresholds, keys).groupBy(*keys).agg(F.avg((F.col(gray) < F.col("threshold")).cast("int")).alias("foreground"))


def grays(px: DataFrame) -> DataFrame:
    """px with gray, the fixed-point luma."""
    return px.withColumn("gray", C.gray(*[F.col(c).cast("long") for c in RGB]).cast("long"))


def tonal(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Of the fixed-point luma: mean, population deviation, least, most and their contrast."""
    g = F.col("gray")
    light = lambda c: C.linear8(c)
    return grays(px).groupBy(key).agg(F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"), C.contrast(light(F.max(g)), light(F.min(g))).alias("contrast"))


def layout(df: DataFrame, keys: list[str], x: str, y: str, weight: str, w: Column, h: Column, floor: float = 10) -> DataFrame:
    """Weighted centroid (the middle if nothing weighs), box and share of what weighs over floor."""
    lit = F.col(weight) > floor
    total = F.sum(weight)
    mid = lambda c, full: F.when(total > 0, F.sum(F.col(c) * F.col(weight)) / total).otherwise(F.max(full) / 2)
    return df.groupBy(*keys).agg(
        mid(x, w).alias("cx"), mid(y, h).alias("cy"),
        F.min(F.when(lit, F.col(x))).alias("x1"), F.min(F.when(lit, F.col(y))).alias("y1"), F.max(F.when(lit, F.col(x))).alias("x2"), F.max(F.when(lit, F.col(y))).alias("y2"),
        (F.count_if(lit) / F.count(F.lit(1))).alias("coverage"),
    )


def grid(c: Column, size: Column, n: int) -> Column:
    """Cell of a coordinate when cell k begins at int(k size / n)."""
    return F.least(F.floor(((c + 1) * n - 1) / size), F.lit(n - 1)).cast("int")


def regions(px: DataFrame, w: Column, h: Column, key: str = "image_id") -> DataFrame:
    """key, layout: where a picture is bright, by mean luma of a 3 x 3 grid (an empty cell is 0). A
    side column is a sidebar if it is over 1.3 times the mean of all nine and brighter than the other
    side, the top row a toolbar and the bottom row a status bar over 1.3 times, the middle cell main
    content over 1.1 times; else uniform."""
    cells = grays(px).groupBy(key, grid(F.col("x"), w, 3).alias("gx"), grid(F.col("y"), h, 3).alias("gy")).agg(F.avg("gray").alias("v"))
    of = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col("v"))), F.lit(0.0)) / n
    gx, gy = F.col("gx"), F.col("gy")
    d = cells.groupBy(key).agg(of(F.lit(True), 9).alias("all"), of(gx == 0, 3).alias("left"), of(gx == 2, 3).alias("right"), of(gy == 0, 3).alias("top"), of(gy == 2, 3).alias("bottom"), of((gx == 1) & (gy == 1), 1).alias("mid"))
    over = lambda c, k: (F.col("all") > 0) & (F.col(c) > F.col("all") * k)
    found = F.array_compact(F.array(
        F.when(over("left", 1.3) & (F.col("left") > F.col("right")), "left_sidebar"), F.when(over("right", 1.3) & (F.col("right") > F.col("left")), "right_sidebar"),
        F.when(over("top", 1.3), "top_toolbar"), F.when(over("bottom", 1.3), "bottom_statusbar"), F.when(over("mid", 1.1), "main_content"),
    ))
    return d.select(key, F.when(F.size(found) == 0, F.array(F.lit("uniform"))).otherwise(found).alias("layout"))


def _bound(k: Column, size: Column, n: int) -> Column:
    return F.floor(k * size / n)


def ascii_art(px: DataFrame, cols: int, rows: int, w: Column, h: Column, key: str = "image_id", color: bool = False, elements: DataFrame | None = None) -> DataFrame:
    """key, row, line: the mean luminance of each block as a ramp character, or, with color, the
    letter of its mean colour where it has one. With elements (key, x1..y2) a block that one of
    them overlaps is drawn as four characters, its quarters row by row, and blocks or quarters
    without a pixel are blank; without elements such blocks are left out."""
    c, r = grid(F.col("x"), w, cols), grid(F.col("y"), h, rows)
    lum = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    middle = lambda k, size, n: F.floor((_bound(k, size, n) + _bound(k + 1, size, n)) / 2)
    quarter = F.when(F.col("y") >= middle(r, h, rows), 2).otherwise(0) + F.when(F.col("x") >= middle(c, w, cols), 1).otherwise(0)
    d = px.select(key, c.alias("c"), r.alias("row"), quarter.alias("q"), lum.alias("lum"), *RGB)
    # sums by quarter serve both resolutions: what stands above is a few numbers a block
    q = d.groupBy(key, "row", "c", "q").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(k).cast("double")).alias(k) for k in ("lum", *RGB)])
    if elements is None:
        q = q.withColumn("fine", F.lit(False))
    else:
        every = px.select(key, w.alias("_w"), h.alias("_h")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        size = every.select(key, "_w", "_h").distinct()
        side = lambda lo, hi, of, n: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (_bound(k, F.col(of), n) < F.col(hi).cast("long")) & (_bound(k + 1, F.col(of), n) > F.col(lo).cast("long")))
        on = elements.join(size, key).withColumn("c", F.explode(side("x1", "x2", "_w", cols))).withColumn("row", F.explode(side("y1", "y2", "_h", rows))).select(key, "row", "c").distinct()
        every = every.drop("_w", "_h").join(on.withColumn("fine", F.lit(True)), [key, "row", "c"], "left").withColumn("fine", F.coalesce("fine", F.lit(False)))
        q = every.join(q, [key, "row", "c"], "left")
    q = q.withColumn("q", F.when(F.col("fine"), F.col("q")).otherwise(F.lit(0)))
    q = q.groupBy(key, "row", "c", "fine", "q").agg(*[F.sum(k).alias(k) for k in ("n", "lum", *RGB)])
    mean = [F.col(k) / F.col("n") for k in RGB]
    ch = C.ramp_char(F.col("lum") / F.col("n"))
    ch = F.when(C.letter(*mean) != "K", C.letter(*mean)).otherwise(ch) if color else ch
    q = q.withColumn("ch", F.when(F.col("n").isNull(), " ").otherwise(ch))
    part = lambda k: F.coalesce(F.max(F.when(F.col("q") == k, F.col("ch"))), F.lit(" "))
    block = q.groupBy(key, "row", "c", "fine").agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("d"), part(3).alias("e"))
    block = block.select(key, "row", "c", F.when(F.col("fine"), F.concat("a", "b", "d", "e")).otherwise(F.col("a")).alias("ch"))
    return block.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "ch"))), lambda s: s["ch"]), "").alias("line"))


def heat_map(points: DataFrame, keys: list[str], w, h, n: int = 16) -> DataFrame:
    cell = lambda c, size: F.least(F.lit(n - 1), F.floor(F.col(c) / size * n)).cast("int")
    return points.groupBy(*keys, cell("x", w).alias("gx"), cell("y", h).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def hough(points: DataFrame, keys: list[str], angles: int = 180) -> DataFrame:
    """keys, theta (degrees from -90), rho (half to even), votes."""
    t = F.radians(F.col("theta").cast("double"))
    d = points.withColumn("theta", F.explode(F.sequence(F.lit(-(angles // 2)), F.lit(angles - angles // 2 - 1))))
    return d.groupBy(*keys, F.rint(F.col("x") * F.cos(t) + F.col("y") * F.sin(t)).cast("long").alias("rho"), "theta").agg(F.count(F.lit(1)).alias("votes"))


def peaks(votes: DataFrame, keys: list[str], threshold: int = 30, most: int = 50, near: int = 5) -> DataFrame:
    """Lines by falling votes, none within `near` of a stronger one on both axes."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.votes >= threshold].sort_values(["votes", "rho", "theta"], ascending=[False, True, True], kind="stable")
        kept: list[int] = []
        at = rows[["rho", "theta"]].to_numpy()
        for i, p in enumerate(at):
            if len(kept) >= most:
                break
            if not any((abs(at[k] - p) <= near).all() for k in kept):
                kept.append(i)
        return rows.iloc[kept]

    return votes.where(F.col("votes") >= threshold).groupBy(*keys).applyInPandas(one, votes.schema)


def dominant(px: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k commonest colours with their shares."""
    c = px.groupBy(*keys, *RGB).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    c = c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), *RGB))).withColumn("share", F.col("n") / F.sum("n").over(w))
    return c.where(F.col("rank") <= k).withColumn("hex", C.hex_of_rgb(*[F.col(x) for x in RGB]))


def brightness_saturation(px: DataFrame, key: str = "image_id") -> DataFrame:
    """key, brightness, saturation: means of value and saturation, halves to even."""
    s, v = C.saturation_value(*[F.col(c).cast("long") for c in RGB])
    return px.groupBy(key).agg(F.rint(F.avg(v)).cast("long").alias("brightness"), F.rint(F.avg(s)).cast("long").alias("saturation"))


def wall_facts(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image (of at most 512 pixels a side, see `downsampled`): mean saturation and value,
    halves to even, the commonest hue in bytes of what has saturation 25 or more (the smaller
    on ties) in degrees, and the classes drawn from them."""
    h, s, v = C.hsv8(*[F.col(c) for c in RGB])
    d = px.select(key, s.alias("s"), v.alias("v"), F.when(s >= 25, h).alias("h"))
    mean = d.groupBy(key).agg(F.rint(F.avg("s")).cast("long").alias("s"), F.rint(F.avg("v")).cast("long").alias("v"))
    top = d.where("h IS NOT NULL").groupBy(key, "h").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("h"))
    out = mean.join(top.select(key, F.rint(F.col("h") * 360 / 255).cast("long").alias("hue")), key, "left")
    out = out.withColumns({"family": C.family(F.col("hue"), F.col("s")), "warmth": C.warmth(F.col("hue"), F.col("s")), "tone": C.tone(F.col("v")), "saturation": C.saturation_tier(F.col("s"))})
    return out.withColumn("category", F.concat_ws("·", "warmth", "tone", "saturation"))


def wall_groups(facts: DataFrame) -> DataFrame:
    """Counts by category, by tone and by family in one pass."""
    sets = [["category"], ["tone"], ["family"]]
    return facts.groupingSets(sets, "category", "tone", "family").agg(F.count(F.lit(1)).alias("n"))


# whole images ---------------------------------------------------------------------


def array_of(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def np_gray(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., k].astype(np.int64) for k in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of radius 4 sigma, edges reflected."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="symmetric")
        a = sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def edge_points(gray: np.ndarray, sigma: float = 1.0, least: float = 10.0) -> list[tuple[float, int]]:
    """(x, y) of local maxima of the gradient along its direction, one a run of touching
    ones in a row, x refined to half the step between both sides."""
    s = smooth(gray.astype(float), sigma)
    gy, gx = np.gradient(s)
    mag = np.hypot(gx, gy)
    turn = (np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int)) % 4
    step = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    p = np.pad(mag, 1)
    keep = np.zeros(mag.shape, bool)
    h, w = mag.shape
    for d, (dy, dx) in step.items():
        ahead, back = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        keep |= (turn == d) & (mag >= ahead) & (mag >= back)
    keep &= mag > least
    keep[[0, -1]] = keep[:, [0, -1]] = False
    keep[:, 1:] &= ~(keep[:, :-1] & (mag[:, 1:] <= mag[:, :-1]))
    out = []
    for y, x in zip(*np.nonzero(keep), strict=True):
        lo, hi = max(x - 3, 0), min(x + 3, w - 1)
        row = s[y, lo : hi + 1]
        half = (row[0] + row[-1]) / 2
        cross = np.flatnonzero(np.diff(np.sign(row - half)))
        if len(cross):
            k = cross[np.argmin(abs(cross + lo - x))]
            a, b = row[k], row[k + 1]
            out.append((float(lo + k + ((half - a) / (b - a) if b != a else 0)), int(y)))
        else:
            out.append((float(x), int(y)))
    return out


def labels(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected parts of a mask, numbered from 1 in raster order: runs of each row are joined
    with those they touch in the row above."""
    out = np.zeros(mask.shape, np.int64)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    stops = np.nonzero(edge == -1)[1]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    reach = 1 if diagonal else 0
    for y in range(1, mask.shape[0]):
        j, end = int(first[y - 1]), int(first[y])
        for i in range(int(first[y]), int(first[y + 1])):
            while j < end and stops[j] + reach <= starts[i]:
                j += 1
            k = j
            while k < end and starts[k] < stops[i] + reach:
                a, b = root(i), root(k)
                up[max(a, b)] = min(a, b)
                k += 1
    number: dict[int, int] = {}
    for i in range(len(rows)):
        out[rows[i], starts[i] : stops[i]] = number.setdefault(root(i), len(number) + 1)
    return out, len(number)


def parts(mask: np.ndarray, least: int, most: int | None = None, diagonal: bool = False, score: np.ndarray | None = None) -> list[dict]:
    """Box (edges are its own pixels), size and mean score of each part of at least `least`
    pixels: by falling score to three digits if one is given, else in raster order; the first `most`."""
    lab, n = labels(mask, diagonal)
    y, x = np.nonzero(lab)
    of = lab[y, x] - 1
    size = np.bincount(of, minlength=n)
    box = [np.full(n, v) for v in (mask.shape[1], mask.shape[0], -1, -1)]
    for to, by, v in zip(box, (np.minimum, np.minimum, np.maximum, np.maximum), (x, y, x, y), strict=True):
        by.at(to, of, v)
    mean = np.floor(np.bincount(of, score[y, x], n) / np.maximum(size, 1) * 1000 + 0.5) / 1000 if score is not None else size
    out = [{"x1": int(box[0][k]), "y1": int(box[1][k]), "x2": int(box[2][k]), "y2": int(box[3][k]), "size": int(size[k]), "score": float(mean[k])} for k in range(n) if size[k] >= least]
    if score is not None:
        out.sort(key=lambda r: -r["score"])
    return out[:most]


def palette(colors: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[tuple, int]]:
    """Median cut over a colour histogram: the largest box by pixels is split on the axis
    of widest weighted range where the lower half holds half its pixels; each colour
    then goes to the nearest box mean, its own on ties; palette by falling count."""
    weight = np.array([77, 150, 29])
    boxes = [np.arange(len(colors))]
    while len(boxes) < k:
        boxes.sort(key=lambda b: -counts[b].sum())
        for n, b in enumerate(boxes):
            if len(b) > 1:
                break
        else:
            break
        axis = int(np.argmax((colors[b].max(0) - colors[b].min(0)) * weight))
        order = b[np.argsort(colors[b, axis], kind="stable")]
        run = np.cumsum(counts[order])
        cut = int(np.searchsorted(2 * run, run[-1], "right")) + 1
        values = colors[order, axis]
        cut = min(max(1, cut), len(order) - 1)
        while cut < len(order) and values[cut] == values[cut - 1]:
            cut += 1
        if cut == len(order):
            cut = int(np.argmax(values == values[-1])) or 1
        boxes[n : n + 1] = [order[:cut], order[cut:]]
    means = np.array([np.rint(np.average(colors[b], axis=0, weights=counts[b])) for b in boxes])
    far = ((colors[:, None] - means[None]) ** 2).sum(2)
    own = np.zeros(len(colors), int)
    for i, b in enumerate(boxes):
        own[b] = i
    near = np.where(far[np.arange(len(colors)), own] <= far.min(1), own, far.argmin(1))
    total = np.bincount(near, counts, len(means)).astype(int)
    order = np.argsort(-total, kind="stable")
    return [(tuple(int(v) for v in means[i]), int(total[i])) for i in order if total[i]]


def palettes(hist: DataFrame, k: int = 8, key: str = "image_id") -> DataFrame:
    """image_id, rank, hex, n, share from a histogram; an image's distinct colours are one task's."""
    kind = dict(hist.dtypes)[key]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(RGB))
        found = palette(rows[list(RGB)].to_numpy(np.int64), rows.n.to_numpy(np.int64), k)
        n = rows.n.sum()
        return pd.DataFrame([(rows[key].iloc[0], i, "#%02X%02X%02X" % c, m, m / n) for i, (c, m) in enumerate(found)], columns=[key, "rank", "hex", "n", "share"])

    return hist.groupBy(key).applyInPandas(one, f"{key} {kind}, rank int, hex string, n long, share double")


def superpixels(img: np.ndarray, n: int, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """SLIC: k-means in Lab and place from a grid of seeds, each within twice the grid step,
    then parts cut off join a neighbour."""
    h, w, _ = img.shape
    u = img / 255.0
    u = np.where(u > 0.04045, ((u + 0.055) / 1.055) ** 2.4, u / 12.92)
    xyz = u @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lab = np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)
    step = max(1, int(round(np.sqrt(h * w / max(1, n)))))
    ys, xs = np.meshgrid(np.arange(step // 2, h, step), np.arange(step // 2, w, step), indexing="ij")
    place = np.stack([ys.ravel(), xs.ravel()], 1).astype(float)
    shade = lab[ys.ravel(), xs.ravel()]
    yy, xx = np.mgrid[:h, :w]
    label = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        new = np.zeros((h, w), int)
        for k, ((cy, cx), c) in enumerate(zip(place, shade, strict=True)):
            t, b, lft, r = max(0, int(cy) - 2 * step), min(h, int(cy) + 2 * step + 1), max(0, int(cx) - 2 * step), min(w, int(cx) + 2 * step + 1)
            d = ((lab[t:b, lft:r] - c) ** 2).sum(-1) + ((yy[t:b, lft:r] - cy) ** 2 + (xx[t:b, lft:r] - cx) ** 2) * (compactness / step) ** 2
            near = d < best[t:b, lft:r]
            best[t:b, lft:r][near] = d[near]
            new[t:b, lft:r][near] = k
        if (new == label).all():
            break
        label = new
        size = np.maximum(np.bincount(label.ravel(), minlength=len(place)), 1)
        place = np.stack([np.bincount(label.ravel(), v.ravel(), len(place)) / size for v in (yy, xx)], 1)
        shade = np.stack([np.bincount(label.ravel(), lab[..., k].ravel(), len(place)) / size for k in range(3)], 1)
    return label


def mean_colors(img: np.ndarray, label: np.ndarray, k: int) -> list[tuple[str, float]]:
    """Superpixels' mean colours (cut to whole numbers), equal ones together, the k largest with their shares."""
    size = np.bincount(label.ravel())
    used = np.flatnonzero(size)
    mean = np.stack([(np.bincount(label.ravel(), img[..., c].ravel())[used] / size[used]).astype(int) for c in range(3)], 1)
    colors, back = np.unique(mean, axis=0, return_inverse=True)
    total = np.bincount(back.ravel(), size[used])
    return [("#%02X%02X%02X" % tuple(colors[i]), float(total[i] / label.size)) for i in np.argsort(-total, kind="stable")[:k]]


def resize(a: np.ndarray, w: int, h: int, kind: str = "bilinear") -> np.ndarray:
    """Two-pass resampling with antialiasing: nearest, bilinear, bicubic or lanczos,
    weights in 22-bit fixed point for bytes."""
    if kind == "nearest":
        return a[np.minimum((np.arange(h) * a.shape[0] // h), a.shape[0] - 1)][:, np.minimum((np.arange(w) * a.shape[1] // w), a.shape[1] - 1)]
    reach = {"bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}[kind]

    def kernel(x):
        x = abs(x)
        if kind == "bilinear":
            return np.maximum(1 - x, 0)
        if kind == "bicubic":
            return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)

    def one(v, n, axis):
        size = v.shape[axis]
        scale = size / n
        wide = max(scale, 1.0)
        out = []
        for i in range(n):
            c = (i + 0.5) * scale
            lo, hi = max(0, int(c - reach * wide + 0.5)), min(size, int(c + reach * wide + 0.5))
            k = kernel((np.arange(lo, hi) - c + 0.5) / wide)
            k = k / k.sum()
            part = np.take(v, np.arange(lo, hi), axis)
            if v.dtype == np.uint8:
                fixed = np.where(k < 0, -np.floor(-k * (1 << 22) + 0.5), np.floor(k * (1 << 22) + 0.5)).astype(np.int64)
                total = np.tensordot(part.astype(np.int64), fixed, ([axis], [0])) + (1 << 21)
                out.append(np.clip(total >> 22, 0, 255).astype(np.uint8))
            else:
                out.append(np.tensordot(part, k, ([axis], [0])))
        return np.stack(out, axis)

    return one(one(a, w, 1), h, 0)


def crop(img: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return img[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


def upscale(img: np.ndarray, k: int = 2) -> np.ndarray:
    return img.repeat(k, 0).repeat(k, 1)


def kernel_resize(a: np.ndarray, w: int, h: int, kind: str) -> np.ndarray:
    """Resampling without antialiasing: linear or cubic about pixel middles (cubic with -0.75, edges
    repeated), or zoom, linear from the first pixel's middle to the last one's."""

    def one(v, n, axis):
        size = v.shape[axis]
        at = np.arange(n) * (size - 1) / max(n - 1, 1) if kind == "zoom" else (np.arange(n) + 0.5) * size / n - 0.5
        low = np.floor(at).astype(int)
        f = at - low
        if kind == "cubic":
            t = np.stack([f + 1, f, 1 - f, 2 - f])
            k = np.where(t <= 1, (1.25 * t - 2.25) * t * t + 1, -0.75 * (((t - 5) * t + 8) * t - 4))
            taps = range(-1, 3)
        else:
            k, taps = np.stack([1 - f, f]), range(2)
        shape = [-1 if i == axis else 1 for i in range(v.ndim)]
        return sum(np.take(v, np.clip(low + d, 0, size - 1), axis) * k[i].reshape(shape) for i, d in enumerate(taps))

    return one(one(a.astype(float), w, 1), h, 0)


def model_input(img: np.ndarray, side: int, mean: tuple, std: tuple) -> np.ndarray:
    """A picture as a normalised tensor [3, side, side]: the shorter side resized (bicubic), the middle cut out."""
    h, w = img.shape[:2]
    k = side / min(w, h)
    big = resize(img, max(side, int(w * k + 0.5)), max(side, int(h * k + 0.5)), "bicubic")
    y, x = (big.shape[0] - side) // 2, (big.shape[1] - side) // 2
    cut = big[y : y + side, x : x + side] / 255.0
    return ((cut - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def downsampled(images: DataFrame, most: int = 512) -> DataFrame:
    """images with the longer side brought down to `most` (lanczos); smaller ones as they are."""

    def work(r, a):
        k = most / max(r.w, r.h)
        w, h = (max(1, int(r.w * k)), max(1, int(r.h * k))) if k < 1 else (r.w, r.h)
        return [(r.image_id, w, h, (resize(a, w, h, "lanczos") if k < 1 else a).tobytes())]

    return per_image(images, work, "image_id long, w int, h int, data binary")


def per_image(images: DataFrame, work, schema: str) -> DataFrame:
    """work(row, array) -> rows, over images one by one; images never meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in schema.split(",")]
        for frame in frames:
            out = [x for r in frame.itertuples() for x in work(r, array_of(r.data, r.w, r.h))]
            yield pd.DataFrame(out, columns=names)

    return images.mapInPandas(run, schema)


def edges(images: DataFrame, sigma: float = 1.0) -> DataFrame:
    return per_image(images, lambda r, a: [(r.image_id, x, y) for x, y in edge_points(np_gray(a), sigma)], "image_id long, x double, y long")


def superpixel_colors(images: DataFrame, k: int = 8) -> DataFrame:
    def work(r, a):
        n = min(200, max(10, a.shape[0] * a.shape[1] // 2000))
        return [(r.image_id, i, h, s) for i, (h, s) in enumerate(mean_colors(a, superpixels(a, n), k))]

    return per_image(images, work, "image_id long, rank int, hex string, share double")


def sample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every (n div most)-th row of a group, from the first."""
    w = W.partitionBy(*keys)
    d = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1)
    return d.where(F.col("_k") % F.greatest(F.floor(F.col("_n") / most), F.lit(1)) == 0).drop("_n", "_k")


def top(df: DataFrame, keys: list[str], by: str, k: int) -> DataFrame:
    """The k largest of a group in order of `by`, ord on ties, with `truncated` where k were reached."""
    w = W.partitionBy(*keys)
    d = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(by), "ord"))).withColumn("truncated", F.count(F.lit(1)).over(w) >= k)
    return d.where(F.col("rank") <= k)
