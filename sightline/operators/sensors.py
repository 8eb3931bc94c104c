"""What each sensor reports, as compositions of the raster, shape and matching operators.

Pixels are rows (image_id, x, y, r, g, b, w, h), as `raster.pixels` makes them of pictures
(image_id, w, h, data); statistics are aggregates over them, reduced to counts per value or
cell before anything meets. What is sequential inside a picture streams over pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import color as C
from . import matching as M
from . import raster as R
from . import shapes as S

KEY = "image_id"


def _sizes(px: DataFrame) -> DataFrame:
    return px.groupBy(KEY).agg(F.max("w").alias("w"), F.max("h").alias("h"))


def scene_stats(px: DataFrame, colors: int = 8) -> DataFrame:
    """A row a picture: palette, Otsu's foreground, tone, place of what is bright, layout."""
    g = R.grays(px)
    counts = g.groupBy(KEY, "gray").agg(F.count(F.lit(1)).alias("n"))
    n, v = F.col("n"), F.col("gray")
    total = F.sum("n")
    spread = F.sqrt((total * F.sum(n * v * v) - F.sum(n * v) * F.sum(n * v)).cast("double")) / total  # whole numbers up to here
    tone = counts.join(R.otsu(counts, [KEY], "gray", "n"), KEY).groupBy(KEY).agg(
        total.alias("pixels"), (F.sum(F.when(v < F.col("threshold"), n).otherwise(0)) / total).alias("fore"), F.max("threshold").alias("threshold"),
        (F.sum(n * v) / total).alias("mean"), spread.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), C.contrast(C.linear8(F.max(v)), C.linear8(F.min(v))).alias("contrast"),
    )
    place = R.layout(g, [KEY], "x", "y", "gray", F.col("w"), F.col("h"), 10)
    share = lambda c, d=4: F.round(c, d)
    palette = R.palettes(R.histogram(px), colors).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "n", "share"))).alias("p"))
    palette = palette.select(KEY, F.transform("p", lambda c: F.struct(c["hex"].alias("hex"), c["n"].alias("count"), F.round(c["share"] * 100, 2).alias("percent"))).alias("color_histogram"))
    d = _sizes(px).join(tone, KEY).join(place, KEY).join(R.regions(px, F.col("w"), F.col("h")), KEY).join(palette, KEY)
    return d.select(
        KEY, "w", "h", "pixels", "color_histogram",
        share(F.col("fore")).alias("foreground_ratio"), share(1 - F.col("fore")).alias("background_ratio"), "threshold",
        share(F.col("mean"), 2).alias("luminance_mean"), share(F.col("std"), 2).alias("luminance_std"), F.col("min").alias("luminance_min"), F.col("max").alias("luminance_max"), share(F.col("contrast"), 2).alias("contrast"),
        share(F.col("cx") / F.col("w")).alias("center_x"), share(F.col("cy") / F.col("h")).alias("center_y"),
        share(F.coalesce((F.col("x2") - F.col("x1")) / F.col("w"), F.lit(0.0))).alias("spread_x"), share(F.coalesce((F.col("y2") - F.col("y1")) / F.col("h"), F.lit(0.0))).alias("spread_y"),
        share(F.col("coverage")).alias("coverage"), share(F.col("w") / F.col("h")).alias("aspect"), "layout",
    )


def region_colors(px: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (image_id, x1..y2 whole) with the colour of the middle pixel (halves down); error
    where that lies outside."""
    d = regions.withColumns({"_x": F.floor((F.col("x1") + F.col("x2")) / 2).cast("long"), "_y": F.floor((F.col("y1") + F.col("y2")) / 2).cast("long")})
    at = px.select(F.col(KEY).alias("_i"), F.col("x").cast("long").alias("_px"), F.col("y").cast("long").alias("_py"), C.hex_of_rgb(*[F.col(c) for c in R.RGB]).alias("hex"))
    out = d.join(at, (F.col(KEY) == F.col("_i")) & (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")), "left")
    return out.select(*regions.columns, "hex", F.when(F.col("hex").isNull(), "region sample out of bounds").alias("error"))


def wcag(pairs: DataFrame) -> DataFrame:
    """pairs (fg, bg: #RRGGBB) with their contrast (2 digits) and whether it passes AA and AAA."""
    lum = lambda c: C.luminance8(*C.rgb_of_hex(F.col(c)))
    d = pairs.withColumn("_r", C.contrast(lum("fg"), lum("bg")))
    return d.select(*pairs.columns, F.round("_r", 2).alias("ratio"), (F.col("_r") >= 4.5).alias("passes_aa"), (F.col("_r") >= 7.0).alias("passes_aaa"))


def pix(images: DataFrame, colors: int = 8) -> DataFrame:
    """A row a picture: the largest superpixel colours with their shares (1 digit of a percent),
    the number of superpixels asked for, brightness and saturation."""
    found = R.superpixel_colors(images, colors).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "share"))).alias("c"))
    found = found.select(KEY, F.transform("c", lambda c: F.struct(c["hex"].alias("hex"), F.round(c["share"] * 100, 1).alias("pct"))).alias("dominant_colors"))
    n = F.greatest(F.lit(10), F.least(F.lit(200), F.floor(F.col("w") * F.col("h") / 2000)))
    return images.select(KEY, "w", "h", n.cast("int").alias("superpixels")).join(R.brightness_saturation(R.pixels(images)), KEY).join(found, KEY)


def differences(one: DataFrame, two: DataFrame, threshold: int = 30, least: int = 25, most: int = 20) -> DataFrame:
    """image_id, ord, box, count: connected parts (also by corners) of the pixels of two pictures of one
    id that differ in luma by more than threshold, of at least `least` pixels, the first `most` in raster
    order. The second picture is brought to the first one's size."""
    both = one.join(two.select(KEY, F.col("w").alias("w2"), F.col("h").alias("h2"), F.col("data").alias("data2")), KEY)

    def work(r, a):
        b = R.array_of(r.data2, r.w2, r.h2)
        b = b if (r.w2, r.h2) == (r.w, r.h) else R.resize(b, r.w, r.h, "lanczos")
        d = np.abs(a.astype(int) - b.astype(int))
        mask = (299 * d[..., 0] + 587 * d[..., 1] + 114 * d[..., 2]) // 1000 > threshold
        return [(r.image_id, i, p["x1"], p["y1"], p["x2"], p["y2"], p["size"]) for i, p in enumerate(R.parts(mask, least, most, True))]

    return R.per_image(both, work, "image_id long, ord int, x1 int, y1 int, x2 int, y2 int, count long")


def edge_points(images: DataFrame, sigma: float = 1.0, max_points: int = 2000) -> DataFrame:
    """image_id, ord, x, y, w, h: sub-pixel edge points in raster order, every n-th if there are more
    than max_points (n whole, so that up to twice as many may stay: a limit that is the feature)."""

    def work(r, a):
        found = R.edge_points(R.np_gray(a), sigma)
        step = len(found) // max_points if len(found) > max_points else 1
        return [(r.image_id, i, x, y, r.w, r.h) for i, (x, y) in enumerate(found[::step])]

    return R.per_image(images, work, "image_id long, ord int, x double, y long, w int, h int")


def edge_lines(points: DataFrame, threshold: int = 40, most: int = 50) -> DataFrame:
    """image_id, theta, rho, votes, rank: the lines that most points vote for."""
    lines = R.peaks(R.hough(points.select(KEY, "x", "y"), [KEY]), [KEY], threshold, most)
    return lines.withColumn("rank", F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("votes"), "rho", "theta")) - 1)


def edge_density(images: DataFrame, sigma: float = 1.0, threshold: int = 40, most: int = 50, max_points: int = 2000, n: int = 16) -> DataFrame:
    """A row a picture: its edge points and lines counted, points by cell of an n x n grid (rows of
    columns), and the five strongest lines as [rho, theta, votes]."""
    points = edge_points(images, sigma, max_points)
    cell = lambda c, size: F.least(F.lit(n - 1), F.floor(F.col(c) / F.col(size) * n)).cast("int")
    cells = points.groupBy(KEY, (cell("y", "h") * n + cell("x", "w")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    dense = cells.groupBy(KEY).agg(F.sum("n").alias("edge_points"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    row = lambda y: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.coalesce(F.try_element_at("m", y * n + x), F.lit(0).cast("long")))
    dense = dense.select(KEY, "edge_points", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row).alias("density_map"))
    lines = edge_lines(points, threshold, most)
    top = F.array_sort(F.collect_list(F.when(F.col("rank") < 5, F.struct("rank", F.array(*[F.col(c).cast("double") for c in ("rho", "theta", "votes")]).alias("l")))))
    lines = lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("lines"), F.transform(top, lambda s: s["l"]).alias("density_lines"))
    out = images.select(KEY).join(dense, KEY, "left").join(lines, KEY, "left")
    none = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.array_repeat(F.lit(0).cast("long"), n))
    return out.select(KEY, F.coalesce("edge_points", F.lit(0)).alias("edge_points"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("density_map", none).alias("density_map"), F.coalesce("density_lines", F.array().cast("array<array<double>>")).alias("density_lines"))


def edge_elements(images: DataFrame, sigma: float = 1.0, threshold: int = 40, most: int = 50, max_points: int = 2000, first: int = 200) -> DataFrame:
    """image_id, id, type, box, conf, rho, theta, votes: the first `first` points (a limit that is the
    feature), each a pixel, then the lines, surer with votes."""
    points = edge_points(images, sigma, max_points)
    x, y = F.rint("x").cast("long"), F.rint("y").cast("long")
    none = [F.lit(None).cast("double").alias(c) for c in ("rho", "theta", "votes")]
    spots = points.where(F.col("ord") < first).select(KEY, F.col("ord").cast("long").alias("id"), F.lit("edge_point").alias("type"), x.alias("x1"), y.alias("y1"), (x + 1).alias("x2"), (y + 1).alias("y2"), F.lit(1.0).alias("conf"), *none)
    lines = edge_lines(points, threshold, most)
    zero = [F.lit(0).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]
    lines = lines.select(KEY, (F.col("rank") + first).cast("long").alias("id"), F.lit("line_segment").alias("type"), *zero, F.least(F.col("votes") / 100, F.lit(1.0)).alias("conf"), *[F.col(c).cast("double").alias(c) for c in ("rho", "theta", "votes")])
    return spots.unionByName(lines)


def ascii(px: DataFrame, cols: int = 64, rows: int = 36, color: bool = False, elements: DataFrame | None = None) -> DataFrame:
    """image_id, lines, chars: the picture in characters, from top to bottom."""
    if cols < 1 or rows < 1:
        raise ValueError("cols and rows are at least 1")
    d = R.ascii_art(px, cols, rows, F.col("w"), F.col("h"), KEY, color, elements).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    lines = F.transform("l", lambda s: s["line"])
    return d.select(KEY, lines.alias("lines"), F.aggregate(lines, F.lit(0), lambda a, s: a + F.length(s)).alias("chars"))


def wall(images: DataFrame, colors: int = 5) -> DataFrame:
    """Facts and classes of each picture with its palette (shares to 1 digit of a percent); pictures that
    couldn't be read (error, no data) keep their error and nothing else."""
    fine = images.where("data IS NOT NULL")
    facts = R.wall_facts(R.pixels(R.downsampled(fine)))
    palette = R.palettes(R.histogram(R.pixels(fine)), colors).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "share"))).alias("p"))
    palette = palette.select(KEY, F.transform("p", lambda c: F.struct(c["hex"].alias("hex"), F.round(c["share"] * 100, 1).alias("pct"))).alias("dominant_colors"))
    d = images.drop("data").join(facts, KEY, "left").join(palette, KEY, "left")
    return d.withColumn("aspect", F.when(F.col("family").isNotNull(), C.aspect(F.col("w"), F.col("h"))))


def cluster(vectors: DataFrame, keys: list[str], threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(clusters with their members, metrics a set): sets of at least two vectors are grouped, others left out."""
    n = vectors.groupBy(*keys).count().where("count >= 2").drop("count")
    some = vectors.join(n, keys, "left_semi")
    found = M.cluster_summary(M.greedy_clusters(some, keys, threshold), keys, some)
    return found, M.cluster_metrics(found, keys)


def saliency(maps: DataFrame, top_n: int = 5, min_score: float = 0.3, least: int = 50) -> DataFrame:
    """maps (image_id, w, h, data: a score a pixel in the first channel, 0 to 255) -> image_id, id, box,
    score (3 digits), pixels: 4-connected parts above min_score, `least` pixels or more, the top_n by score."""

    def work(r, a):
        v = a[..., 0] / 255.0
        return [(r.image_id, i, p["x1"], p["y1"], p["x2"], p["y2"], p["score"], p["size"]) for i, p in enumerate(R.parts(v > min_score, least, top_n, False, v))]

    return R.per_image(maps, work, "image_id long, id int, x1 int, y1 int, x2 int, y2 int, score double, pixels long")


def depth(maps: DataFrame, bins: int = 3, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """maps (image_id, x, y, depth): a row a picture of the depths brought to 0 to 1 in 255 steps: least,
    most, mean and quartiles at nearest rank, the share of each of `bins` equal bins (1 itself is in
    none), and the same statistics of a region (x1, y1, x2, y2; high ends out), null if it is empty."""
    all_ = W.partitionBy(KEY)
    low, high = F.min("depth").over(all_), F.max("depth").over(all_)
    d = maps.withColumn("v", F.floor((F.col("depth") - low) / (high - low + 1e-9) * 255) / 255)
    stats = ("min", "max", "mean", "q25", "q50", "q75")
    whole = R.nearest_rank(d, [KEY], "v")
    bin_ = R.equal_bins(F.col("v"), bins)
    shares = d.groupBy(KEY).agg(*[F.round(F.count_if(bin_ == k) / F.count(F.lit(1)), 4).alias(f"bin{k}") for k in range(bins)])
    shares = shares.select(KEY, F.array(*[f"bin{k}" for k in range(bins)]).alias("bins"))
    out = whole.join(shares, KEY)
    if region is None:
        return out
    x1, y1, x2, y2 = region
    part = R.nearest_rank(d.where((F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)), [KEY], "v")
    return out.join(part.select(KEY, *[F.col(c).alias(f"region_{c}") for c in stats]), KEY, "left")


def grid_points(images: DataFrame, n: int = 3) -> DataFrame:
    """image_id, ord, px, py: the middles of an n x n grid, the prompts where none are given."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("ord")
    middle = lambda i, size: F.floor((i + 0.5) * F.col(size) / n).cast("long")
    return images.select(KEY, "w", "h", k).select(KEY, "ord", middle(F.col("ord") % n, "w").alias("px"), middle(F.floor(F.col("ord") / n), "h").alias("py"))


def mask_boxes(mask_px: DataFrame, min_area: float = 0.0, least: int = 50) -> DataFrame:
    """mask_px (image_id, ord, x, y, w, h: the pixels of masks) -> image_id, ord, box of their own pixels,
    pixels, area_ratio (4 digits), conf; masks under `least` pixels or min_area of the picture are left out."""
    g = mask_px.groupBy(KEY, "ord").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) / (F.max("w") * F.max("h"))).alias("_a"))
    area = F.floor(F.col("_a") * 10000 + 0.5) / 10000
    return g.where((F.col("pixels") >= least) & (F.col("_a") >= min_area)).withColumn("area_ratio", area).withColumn("conf", F.least(F.col("area_ratio") * 2, F.lit(1.0))).drop("_a")


def segment(mask_px: DataFrame, min_area: float = 0.0, most: int = 10) -> DataFrame:
    """The masks' boxes, largest first, without those that overlap a larger one by an IoU over 0.5; at most `most`."""
    found = mask_boxes(mask_px, min_area).select(KEY, F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in M.BOX], "pixels", "area_ratio", "conf", F.col("pixels").cast("double").alias("score"))
    return M.suppress(found, [KEY], 0.5, most).drop("score")


def icons(raw: DataFrame, min_conf: float = 0.05, most: int = 20) -> DataFrame:
    """Boxes from anchor distances (see `shapes.anchors`), the surest first, none that overlaps a surer one by over 0.7."""
    return R.top(M.suppress(S.anchors(raw, min_conf), [KEY], 0.7), [KEY], "score", most)


#: The classes of a page layout, by number.
LAYOUT = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer", "footer_image", "footnote", "formula_number", "header",
    "header_image", "image", "inline_formula", "number", "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote", "unknown",
)


def layout_boxes(raw: DataFrame, min_conf: float = 0.5, most: int = 100) -> DataFrame:
    """raw (image_id, ord, cls, score, x1..y2, w, h of the page, mask: bytes of a square of side `side` laid over the
    page) -> image_id, ord, label, score, box: detections over 0.5 and min_conf of a known class whose mask has a
    pixel in the box; the box is that of the mask's normal form (upright, turned, or its outline), held inside the page."""
    fine = raw.where((F.col("score") > 0.5) & (F.col("score") > min_conf) & F.col("cls").between(0, len(LAYOUT) - 1))

    def one(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples():
                x1, y1, x2, y2 = (int(v) for v in (r.x1, r.y1, r.x2, r.y2))
                if x2 <= x1 or y2 <= y1:
                    continue
                mask = np.frombuffer(r.mask, np.uint8).reshape(r.side, r.side)
                at = lambda v, size, s=r.side: min(max(int(v * s / size), 0), s)
                cut = mask[at(y1, r.h) : at(y2, r.h), at(x1, r.w) : at(x2, r.w)]
                if not cut.any():
                    continue
                shape = S.outline(R.resize(cut[..., None], x2 - x1, y2 - y1, "nearest")[..., 0] > 0)
                shape = S.corners_only(shape)
                if len(shape) < 3:
                    continue
                _, points = S.normal_form(shape + [x1, y1])
                low, high = np.clip(points.min(0), 0, [r.w, r.h]).astype(int), np.clip(points.max(0), 0, [r.w, r.h]).astype(int)
                if (high > low).all():
                    out.append((r.image_id, r.ord, LAYOUT[r.cls], float(r.score), *low.tolist(), *high.tolist()))
            yield pd.DataFrame(out, columns=["image_id", "ord", "label", "score", "x1", "y1", "x2", "y2"])

    found = fine.mapInPandas(one, "image_id long, ord long, label string, score double, x1 long, y1 long, x2 long, y2 long")
    return R.top(found, [KEY], "score", most)


def zoom(images: DataFrame, regions: DataFrame, factor: int = 2) -> DataFrame:
    """The pictures' regions (image_id, x1, y1, x2, y2, corners in any order), cut out and enlarged (lanczos), with ox and oy, where they began."""
    side = lambda f, a, b: f(F.col(a), F.col(b)).cast("int")
    r = regions.select(KEY, side(F.least, "x1", "x2").alias("ox"), side(F.least, "y1", "y2").alias("oy"), side(F.greatest, "x1", "x2").alias("ex"), side(F.greatest, "y1", "y2").alias("ey"))

    def work(row, a):
        cut = R.crop(a, row.ox, row.oy, row.ex, row.ey)
        if not cut.size:
            return []
        h, w = cut.shape[0] * factor, cut.shape[1] * factor
        return [(row.image_id, w, h, R.resize(np.ascontiguousarray(cut), w, h, "lanczos").tobytes(), max(0, row.ox), max(0, row.oy))]

    return R.per_image(images.join(r, KEY), work, "image_id long, w int, h int, data binary, ox int, oy int")


def zoomed_entities(observations: DataFrame, regions: DataFrame, factor: int = 2, min_iou: float = 0.5) -> DataFrame:
    """Observations made in enlarged regions (report_id; x1..y2 of the regions in the picture), fused there
    and brought back to the picture's coordinates; numbered by report."""
    r = regions.select("report_id", F.least("x1", "x2").alias("_ox"), F.least("y1", "y2").alias("_oy"))
    d = M.entities(observations, min_iou).join(r, "report_id")
    back = B.zoom_back(B.box(), F.col("_ox"), F.col("_oy"), factor)
    center = F.array(*[F.col("center")[i].cast("double") / factor + F.col(o) for i, o in ((0, "_ox"), (1, "_oy"))])
    return d.withColumns({**dict(zip(M.BOX, back, strict=True)), "center": center}).drop("_ox", "_oy")


#: What a probe of one sensor gives, by its name: (pictures, region) -> rows.
def probe(images: DataFrame, regions: DataFrame, sensor: str, **found: DataFrame) -> DataFrame:
    """Evidence of one sensor at regions (image_id, x1..y2): pix gives the colour of their middle, edge the points
    and lines of the region alone, depth its statistics (found: depth, one region), segment the masks
    (found: masks) that meet it, ocr the lines (found: lines, in the region's own coordinates) moved to the picture."""
    if sensor == "pix":
        return region_colors(R.pixels(images), regions)
    if sensor == "edge":
        return edge_elements(zoom(images, regions, 1).drop("ox", "oy"))
    if sensor == "depth":
        r = regions.first()
        return depth(found["depth"], region=(r["x1"], r["y1"], r["x2"], r["y2"]))
    if sensor == "segment":
        r = regions.select(F.col(KEY).alias("_i"), *[F.col(c).cast("double").alias(f"_{c}") for c in M.BOX])
        return segment(found["masks"]).join(r, (F.col(KEY) == F.col("_i")) & B.meets(B.box(), B.box("_"))).drop("_i", *[f"_{c}" for c in M.BOX])
    if sensor == "ocr":
        r = regions.select(KEY, F.least("x1", "x2").alias("_ox"), F.least("y1", "y2").alias("_oy"))
        moved = B.offset(B.box(), F.col("_ox"), F.col("_oy"))
        return found["lines"].join(r, KEY).withColumns(dict(zip(M.BOX, moved, strict=True))).drop("_ox", "_oy")
    raise ValueError(f"unknown sensor {sensor}")


def confirmed(images_entities: DataFrame) -> DataFrame:
    """report_id, confirmed, new_conf, local_elements: a probe confirms if it found anything and the first entity has 0.5 or more."""
    g = images_entities.groupBy("report_id").agg(F.count(F.lit(1)).alias("local_elements"), F.min_by("conf", "id").alias("new_conf"))
    return g.select("report_id", (F.col("new_conf") >= 0.5).alias("confirmed"), "new_conf", "local_elements")


def shape_histogram(shapes: DataFrame, keys: list[str]) -> DataFrame:
    return shapes.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def z_statistics(z: DataFrame, w: int, h: int) -> DataFrame:
    """z (camera_id, x, y, z: depths seen, as `shapes.z_buffer` gives them) -> a row a camera: near, far, median, deviation,
    depth in the middle (the median if nothing is there), share of pixels seen and a histogram of ten bins (6 digits, the share 4)."""
    key = "camera_id"
    all_ = W.partitionBy(key)
    d = z.withColumns({"_lo": F.min("z").over(all_), "_hi": F.max("z").over(all_)})
    bin_ = F.least(F.floor((F.col("z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12) * 10), F.lit(9))
    six = lambda c: F.round(c, 6)
    middle = F.max(F.when((F.col("x") == w // 2) & (F.col("y") == h // 2), F.col("z")))
    return d.groupBy(key).agg(
        six(F.min("z")).alias("near"), six(F.max("z")).alias("far"), six(F.median("z")).alias("median"), six(F.stddev_pop("z")).alias("std"),
        six(F.coalesce(middle, F.median("z"))).alias("center"), F.round(F.count(F.lit(1)) / (w * h), 4).alias("seen"), F.array(*[F.count_if(bin_ == k) for k in range(10)]).alias("histogram"),
    )


def projected(tris: DataFrame, camera: Column, w: int, h: int) -> DataFrame:
    """tris (camera_id, a, b, c: world points of three numbers, and whatever camera is made of) -> those wholly before
    the camera, as `shapes.z_buffer` takes them: whole pixels and the distance along the view. camera is a
    column of 16 numbers, row by row: world to clip space, its last row the distance."""
    def point(c):
        p = F.array(*[camera[4 * i] * F.col(c)[0] + camera[4 * i + 1] * F.col(c)[1] + camera[4 * i + 2] * F.col(c)[2] + camera[4 * i + 3] for i in range(4)])
        return F.struct(p[3].alias("w"), F.array(((p[0] / p[3] * 0.5 + 0.5) * w).cast("long").cast("double"), ((1 - (p[1] / p[3] * 0.5 + 0.5)) * h).cast("long").cast("double"), p[3]).alias("p"))

    d = tris.select("camera_id", *[point(c).alias(c) for c in "abc"])
    return d.where(" AND ".join(f"{c}.w > 1e-9" for c in "abc")).select("camera_id", *[F.col(f"{c}.p").alias(c) for c in "abc"])
