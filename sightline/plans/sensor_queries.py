"""Queries over whole sensors, on pictures drawn by rule; those that SQL can say have it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import raster as R
from ..operators import sensors as N
from . import proxies as P
from .registry import query, rounded

_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_TONE = f"""tn AS (SELECT image_id, avg(gray) AS mean, stddev_pop(gray) AS std, min(gray) AS lo, max(gray) AS hi FROM gr GROUP BY image_id),
tc AS (SELECT *, ({_LIN.format(c="hi")} + 0.05) / ({_LIN.format(c="lo")} + 0.05) AS contrast FROM tn)"""
_LAYOUT = """ce AS (SELECT image_id, least(2, ((x + 1) * 3 - 1) // 32) AS gx, least(2, ((y + 1) * 3 - 1) // 24) AS gy, avg(gray) AS v FROM gr GROUP BY 1, 2, 3),
la AS (SELECT image_id, sum(v) / 9 AS al, sum(v) FILTER (WHERE gx = 0) / 3 AS le, sum(v) FILTER (WHERE gx = 2) / 3 AS ri, sum(v) FILTER (WHERE gy = 0) / 3 AS tp, sum(v) FILTER (WHERE gy = 2) / 3 AS bo, sum(v) FILTER (WHERE gx = 1 AND gy = 1) AS mi FROM ce GROUP BY 1),
lo AS (SELECT image_id, list_filter([CASE WHEN le > al * 1.3 AND le > ri THEN 'left_sidebar' END, CASE WHEN ri > al * 1.3 AND ri > le THEN 'right_sidebar' END, CASE WHEN tp > al * 1.3 THEN 'top_toolbar' END, CASE WHEN bo > al * 1.3 THEN 'bottom_statusbar' END, CASE WHEN mi > al * 1.1 THEN 'main_content' END], lambda t: t IS NOT NULL) AS ls FROM la),
ly AS (SELECT image_id, CASE WHEN len(ls) = 0 THEN 'uniform' ELSE array_to_string(ls, ',') END AS layout FROM lo)"""


@query(f"""WITH {P.PICTURES_SQL}, {_TONE} SELECT image_id, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min, hi AS max, round(contrast, 6) AS contrast FROM tc""")
def tonal_stats(spark, sf):
    d = R.tonal(P.picture_px(spark, sf))
    return d.select("image_id", *[rounded(F.col(c)).alias(c) for c in ("mean", "std")], "min", "max", rounded(F.col("contrast")).alias("contrast"))


@query(f"WITH {P.PICTURES_SQL}, {_LAYOUT} SELECT image_id, layout FROM ly")
def region_labels(spark, sf):
    return R.regions(P.picture_px(spark, sf), F.lit(P.WIDTH), F.lit(P.HEIGHT)).withColumn("layout", F.array_join("layout", ","))


@query(f"""WITH {P.PICTURES_SQL}, {_TONE}, {_LAYOUT}, c AS (SELECT image_id, gray AS g, count(*) AS n FROM gr GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER lw AS n0, sum(n * g) OVER lw AS s0, sum(n) OVER al AS nt, sum(n * g) OVER al AS st FROM c WINDOW lw AS (PARTITION BY image_id ORDER BY g ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY image_id)),
b AS (SELECT image_id, g, CASE WHEN nt > n0 THEN CAST(n0 AS DOUBLE) * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2) ELSE 0.0 END AS v FROM r), th AS (SELECT image_id, arg_max(g, (v, -g)) AS threshold FROM b GROUP BY 1),
fo AS (SELECT c.image_id, any_value(threshold) AS threshold, sum(CASE WHEN g < threshold THEN n ELSE 0 END) / sum(n) AS fore FROM c JOIN th USING (image_id) GROUP BY 1),
pl AS (SELECT image_id, sum(x * gray) / sum(gray) / 32 AS cx, sum(y * gray) / sum(gray) / 24 AS cy, (max(x) FILTER (WHERE gray > 10) - min(x) FILTER (WHERE gray > 10)) / 32.0 AS sx, (max(y) FILTER (WHERE gray > 10) - min(y) FILTER (WHERE gray > 10)) / 24.0 AS sy, avg(CASE WHEN gray > 10 THEN 1.0 ELSE 0 END) AS coverage FROM gr GROUP BY 1)
SELECT image_id, round(fore, 4) AS foreground_ratio, threshold, round(mean, 2) AS luminance_mean, round(std, 2) AS luminance_std, lo AS luminance_min, hi AS luminance_max, round(contrast, 2) AS contrast,
  round(cx, 4) AS center_x, round(cy, 4) AS center_y, round(coalesce(sx, 0), 4) AS spread_x, round(coalesce(sy, 0), 4) AS spread_y, round(coverage, 4) AS coverage, round(32 / 24, 4) AS aspect, layout
FROM fo JOIN tc USING (image_id) JOIN pl USING (image_id) JOIN ly USING (image_id)""")
def scene_stats(spark, sf):
    """All of the scene's statistics but the palette, which scene_palettes has."""
    d = N.scene_stats(P.picture_px(spark, sf))
    return d.select("image_id", "foreground_ratio", "threshold", "luminance_mean", "luminance_std", "luminance_min", "luminance_max", "contrast", "center_x", "center_y", "spread_x", "spread_y", "coverage", "aspect", F.array_join("layout", ",").alias("layout"))


@query()
def scene_palettes(spark, sf):
    return N.scene_stats(P.picture_px(spark, sf)).select("image_id", F.posexplode("color_histogram").alias("rank", "c")).select("image_id", "rank", "c.*")


def _ramp(lum: str) -> str:
    return f"substr('@%#*+=-:. ', CAST(least(greatest(floor((255 - {lum}) / 255 * 9), 0), 9) AS INT) + 1, 1)"


_LETTER = "CASE WHEN r > 200 AND g < 100 AND b < 100 THEN 'R' WHEN g > 200 AND r < 100 AND b < 100 THEN 'G' WHEN b > 200 AND r < 100 AND g < 100 THEN 'B' WHEN r > 150 AND g > 150 AND b < 100 THEN 'Y' WHEN r > 150 AND g < 100 AND b > 150 THEN 'M' WHEN r < 100 AND g > 150 AND b > 150 THEN 'C' WHEN r > 200 AND g > 200 AND b > 200 THEN 'W' ELSE 'K' END"


@query(f"""WITH {P.PICTURES_SQL}, c AS (SELECT image_id, least(9, ((x + 1) * 10 - 1) // 32) AS c, least(5, ((y + 1) * 6 - 1) // 24) AS row, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS lum, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY 1, 2, 3),
k AS (SELECT image_id, row, c, CASE WHEN {_LETTER} <> 'K' THEN {_LETTER} ELSE {_ramp("lum")} END AS ch FROM c)
SELECT image_id, CAST(row AS INT) AS row, string_agg(ch, '' ORDER BY c) AS line FROM k GROUP BY 1, 2""")
def ascii_colors(spark, sf):
    return R.ascii_art(P.picture_px(spark, sf), 10, 6, F.col("w"), F.col("h"), color=True)


@query(f"""WITH {P.PICTURES_SQL}, ce AS (SELECT s_suppkey AS image_id, c, row, CAST(floor(c * 32 / 5) AS INT) AS x0, CAST(floor((c + 1) * 32 / 5) AS INT) AS x1, CAST(floor(row * 24 / 4) AS INT) AS y0, CAST(floor((row + 1) * 24 / 4) AS INT) AS y1 FROM supplier, unnest(range(5)) AS t(c), unnest(range(4)) AS u(row)),
fi AS (SELECT *, x0 < image_id % 20 + 6 AND x1 > image_id % 20 AND y0 < 14 AND y1 > 7 AS fine FROM ce), q AS (SELECT *, unnest(CASE WHEN fine THEN [0, 1, 2, 3] ELSE [0] END) AS q FROM fi),
b AS (SELECT image_id, c, row, q, CASE WHEN fine AND q % 2 = 1 THEN (x0 + x1) // 2 ELSE x0 END AS a0, CASE WHEN fine AND q % 2 = 0 THEN (x0 + x1) // 2 ELSE x1 END AS a1, CASE WHEN fine AND q // 2 = 1 THEN (y0 + y1) // 2 ELSE y0 END AS b0, CASE WHEN fine AND q // 2 = 0 THEN (y0 + y1) // 2 ELSE y1 END AS b1 FROM q),
m AS (SELECT b.image_id, b.c, b.row, b.q, avg(0.2126 * r + 0.7152 * g + 0.0722 * b.b) AS lum FROM (SELECT b.*, r, g, px.b FROM b JOIN px ON px.image_id = b.image_id AND x >= a0 AND x < a1 AND y >= b0 AND y < b1) b GROUP BY 1, 2, 3, 4)
SELECT image_id, CAST(row AS INT) AS row, string_agg({_ramp("lum")}, '' ORDER BY c, q) AS line FROM m GROUP BY 1, 2""")
def ascii_elements(spark, sf):
    """Finer where an element lies: a box in each picture whose place follows the number."""
    px = P.picture_px(spark, sf)
    i = F.col("image_id") % 20
    e = px.select("image_id").distinct().select("image_id", i.cast("double").alias("x1"), F.lit(7.9).alias("y1"), (i + 6).cast("double").alias("x2"), F.lit(14.2).alias("y2"))
    return R.ascii_art(px, 5, 4, F.col("w"), F.col("h"), elements=e)


_F32 = lambda c: f"CAST({c} AS FLOAT)"
_AWAY = lambda c: f"({_F32('hi - ' + c)} / {_F32('hi - lo')})"
_HSV = f"""mm AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
h0 AS (SELECT *, CASE WHEN hi = lo THEN NULL WHEN r = hi THEN {_AWAY("b")} - {_AWAY("g")} WHEN g = hi THEN {_F32("2")} + {_AWAY("r")} - {_AWAY("b")} ELSE {_F32("4")} + {_AWAY("g")} - {_AWAY("r")} END AS h FROM mm),
h1 AS (SELECT *, h / {_F32("6")} + {_F32("1")} AS t, CASE WHEN hi = lo THEN 0 ELSE CAST(floor({_F32("hi - lo")} / {_F32("hi")} * {_F32("255")}) AS INT) END AS s FROM h0),
hs AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE CAST(floor((t - floor(t)) * {_F32("255")}) AS INT) END AS hue8 FROM h1),
me AS (SELECT image_id, CAST(round_even(avg(s), 0) AS BIGINT) AS s, CAST(round_even(avg(hi), 0) AS BIGINT) AS v FROM hs GROUP BY 1),
tp AS (SELECT image_id, hue8, count(*) AS n FROM hs WHERE s >= 25 GROUP BY 1, 2), du AS (SELECT image_id, CAST(round_even(arg_max(hue8, (n, -hue8)) * 360 / 255, 0) AS BIGINT) AS hue FROM tp GROUP BY 1),
fc AS (SELECT me.image_id, s, v, hue, CASE WHEN hue IS NULL OR s < 25 THEN 'neutral' WHEN hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 65 THEN 'yellow' WHEN hue < 160 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 250 THEN 'blue' WHEN hue < 285 THEN 'purple' WHEN hue < 330 THEN 'magenta' ELSE 'red' END AS family,
  CASE WHEN hue IS NULL OR s < 25 THEN 'neutral' WHEN hue < 70 OR hue >= 330 THEN 'warm' ELSE 'cool' END AS warmth, CASE WHEN v < 85 THEN 'dark' WHEN v < 170 THEN 'mid' ELSE 'light' END AS tone, CASE WHEN s < 25 THEN 'gray' WHEN s < 60 THEN 'muted' ELSE 'vivid' END AS saturation FROM me LEFT JOIN du USING (image_id))"""


@query(f"WITH {P.PICTURES_SQL}, {_HSV} SELECT image_id, s, v, hue, family, warmth, tone, saturation, warmth || '·' || tone || '·' || saturation AS category FROM fc")
def wall_facts(spark, sf):
    return R.wall_facts(P.picture_px(spark, sf))


@query(f"WITH {P.PICTURES_SQL}, {_HSV}, g AS (SELECT warmth || '·' || tone || '·' || saturation AS category, tone, family FROM fc) SELECT category, tone, family, count(*) AS n FROM g GROUP BY GROUPING SETS ((category), (tone), (family))")
def wall_categories(spark, sf):
    return R.wall_groups(R.wall_facts(P.picture_px(spark, sf)))


@query()
def wall_pictures(spark, sf):
    """Facts, aspect and palette, from pictures of bytes; every ninth can't be read."""
    i = P.pictures(spark, sf).withColumn("error", F.when(F.col("image_id") % 9 == 0, "unreadable"))
    d = N.wall(i.withColumn("data", F.when(F.col("error").isNull(), F.col("data"))))
    return d.select("image_id", "error", "aspect", "category", "hue", F.to_json("dominant_colors").alias("dominant_colors"))


@query()
def pix_report(spark, sf):
    d = N.pix(P.pictures(spark, sf))
    return d.select("image_id", "superpixels", "brightness", "saturation", F.to_json("dominant_colors").alias("dominant_colors"))


@query(f"""WITH {P.PICTURES_SQL}, r AS (SELECT s_suppkey AS image_id, s_suppkey % 40 - 4 AS x1, 3 AS y1, s_suppkey % 40 - 1 AS x2, 8 AS y2 FROM supplier)
SELECT r.image_id, r.x1, r.x2, CASE WHEN px.x IS NOT NULL THEN printf('#%02X%02X%02X', px.r, px.g, px.b) END AS hex, px.x IS NULL AS failed FROM r LEFT JOIN px ON px.image_id = r.image_id AND px.x = floor((x1 + x2) / 2) AND px.y = 5""")
def region_colors(spark, sf):
    px, i = P.picture_px(spark, sf), F.col("image_id")
    r = px.select("image_id").distinct().select("image_id", (i % 40 - 4).alias("x1"), F.lit(3).alias("y1"), (i % 40 - 1).alias("x2"), F.lit(8).alias("y2"))
    return N.region_colors(px, r).select("image_id", "x1", "x2", "hex", F.col("error").isNotNull().alias("failed"))


_LUM = lambda p: f"(0.2126 * ({_LIN.format(c=p + 'r')}) + 0.7152 * ({_LIN.format(c=p + 'g')}) + 0.0722 * ({_LIN.format(c=p + 'b')}))"


@query(f"""WITH c AS (SELECT p_partkey, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b, 255 - p_size AS zr, 255 - p_size AS zg, 255 AS zb FROM part),
l AS (SELECT p_partkey, {_LUM("")} AS a, {_LUM("z")} AS z FROM c), q AS (SELECT p_partkey, (greatest(a, z) + 0.05) / (least(a, z) + 0.05) AS ratio FROM l) SELECT p_partkey, round(ratio, 2) AS ratio, ratio >= 4.5 AS passes_aa, ratio >= 7 AS passes_aaa FROM q""")
def wcag_pairs(spark, sf):
    s = F.lit(255) - F.col("p_size")
    d = P.read(spark, sf, "part").select("p_partkey", C.hex_of_rgb(*P.colors(F.col("p_partkey"))).alias("fg"), C.hex_of_rgb(s, s, F.lit(255)).alias("bg"))
    return N.wcag(d).drop("fg", "bg")


@query("SELECT s_suppkey AS image_id, 0 AS ord, 8 AS x1, 6 AS y1, 19 AS x2, 15 AS y2, CAST(120 AS BIGINT) AS count FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0")
def picture_differences(spark, sf):
    """Pictures and how they are later: the block that every fourth changes stands out where no bar runs through it."""
    d = N.differences(P.pictures(spark, sf), P.pictures(spark, sf, late=True))
    return d.where("image_id % 5 = 0 AND image_id % 3 <> 0")


@query()
def edge_density(spark, sf):
    d = N.edge_density(P.pictures(spark, sf), threshold=20)
    return d.select("image_id", "edge_points", "lines", F.to_json("density_map").alias("density_map"), F.to_json("density_lines").alias("density_lines"))


@query()
def edge_elements(spark, sf):
    return N.edge_elements(P.pictures(spark, sf), threshold=20, first=20)


_DEPTH = """d0 AS (SELECT p_brand AS image_id, p_partkey % 32 AS x, p_partkey % 24 AS y, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 3 AS depth FROM part),
dm AS (SELECT *, min(depth) OVER (PARTITION BY image_id) AS lo, max(depth) OVER (PARTITION BY image_id) AS hi FROM d0), dv AS (SELECT image_id, x, y, floor((depth - lo) / (hi - lo + 1e-9) * 255) / 255 AS v FROM dm)"""
_QUARTILES = lambda t, p: f"SELECT image_id, min(v) AS {p}min, max(v) AS {p}max, round(avg(v), 6) AS {p}mean, " + ", ".join(f"list_sort(list(v))[CAST(floor((count(v) - 1) * {s} + 0.5) AS BIGINT) + 1] AS {p}q{int(100 * s)}" for s in (0.25, 0.5, 0.75)) + f" FROM {t} GROUP BY 1"


@query(f"""WITH {_DEPTH}, w AS ({_QUARTILES("dv", "")}), rg AS (SELECT * FROM dv WHERE x >= 4 AND x < 20 AND y >= 2 AND y < 18), r AS ({_QUARTILES("rg", "region_")}),
b AS (SELECT image_id, round(avg(CASE WHEN v < 1 AND floor(v * 3) = 0 THEN 1.0 ELSE 0 END), 4) AS bin0, round(avg(CASE WHEN v < 1 AND floor(v * 3) = 1 THEN 1.0 ELSE 0 END), 4) AS bin1, round(avg(CASE WHEN v < 1 AND floor(v * 3) = 2 THEN 1.0 ELSE 0 END), 4) AS bin2 FROM dv GROUP BY 1)
SELECT * FROM w JOIN b USING (image_id) LEFT JOIN r USING (image_id)""")
def depth_stats(spark, sf):
    k = F.col("p_partkey")
    maps = P.read(spark, sf, "part").select(F.col("p_brand").alias("image_id"), (k % 32).alias("x"), (k % 24).alias("y"), ((k * 7919 % 1000).cast("double") / 3).alias("depth"))
    d = N.depth(maps, 3, (4, 2, 20, 18)).withColumns({c: rounded(F.col(c)) for c in ("mean", "region_mean")})
    return d.withColumns({f"bin{k}": F.col("bins")[k] for k in range(3)}).drop("bins")


_MASKS = """mk AS (SELECT image_id, k AS ord, x, y FROM bars, unnest(range(4)) AS t(k) WHERE x >= (image_id + k * 3) % 12 AND x < (image_id + k * 3) % 12 + 9 + k AND y >= k AND y < k + 7 AND (x + y) % 5 <> k)"""


@query(f"WITH {P.PICTURES_SQL}, {_MASKS}, m AS (SELECT image_id, ord, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS pixels FROM mk GROUP BY 1, 2) SELECT image_id, CAST(ord AS INTEGER) AS ord, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, pixels, floor(pixels / 768 * 10000 + 0.5) / 10000 AS area_ratio, least(1, floor(pixels / 768 * 10000 + 0.5) / 10000 * 2) AS conf FROM m WHERE pixels >= 50 AND pixels / 768 >= 0.07")
def mask_boxes(spark, sf):
    return N.mask_boxes(_masks(spark, sf), 0.07)


def _masks(spark, sf):
    i, k, x, y = (F.col(c) for c in ("image_id", "ord", "x", "y"))
    px = P.picture_px(spark, sf).select("image_id", "x", "y", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    left = (i + k * 3) % 12
    return px.where((x >= left) & (x < left + 9 + k) & (y >= k) & (y < k + 7) & ((x + y) % 5 != k))


@query()
def segments(spark, sf):
    return N.segment(_masks(spark, sf))


@query()
def saliency_parts(spark, sf):
    return N.saliency(P.pictures(spark, sf), 3, 0.6, 20)


@query("SELECT s_suppkey AS image_id, k AS ord, CAST(floor((k % 3 + 0.5) * 32 / 3) AS BIGINT) AS px, CAST(floor((k // 3 + 0.5) * 24 / 3) AS BIGINT) AS py FROM (SELECT s_suppkey, CAST(unnest(range(9)) AS INTEGER) AS k FROM supplier)")
def prompt_points(spark, sf):
    return N.grid_points(P.pictures(spark, sf))


@query()
def zoomed_entities(spark, sf):
    """Observations taken to be made in a region enlarged twice, back in the picture."""
    e = P.elements(spark, sf)
    o = e.select("report_id", "ord", F.col("kind").alias("source"), "x1", "y1", "x2", "y2", F.lit("t").alias("text"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("class"), "conf", F.lit(True).alias("interactive"))
    r = e.groupBy("report_id").agg(F.max("x1").alias("x1"), F.lit(30.0).alias("y1"), F.min("x1").alias("x2"), F.lit(10.0).alias("y2"))
    return N.zoomed_entities(o, r).select("report_id", "id", "x1", "y1", "x2", "y2", "conf", "status")


@query(f"""WITH {P.PICTURES_SQL}, r AS (SELECT s_suppkey AS image_id, s_suppkey % 20 AS ox, s_suppkey % 10 AS oy FROM supplier)
SELECT r.image_id, any_value(ox) AS ox, any_value(oy) AS oy, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM r JOIN px ON px.image_id = r.image_id AND x >= ox AND x < ox + 12 AND y >= oy AND y < oy + 8 GROUP BY 1""")
def zoomed_pixels(spark, sf):
    """What a zoom by one cuts out, summed by channel."""
    i = P.pictures(spark, sf)
    k = F.col("image_id")
    r = i.select("image_id", (k % 20 + 12).alias("x1"), (k % 10).alias("y1"), (k % 20).alias("x2"), (k % 10 + 8).alias("y2"))
    z = N.zoom(i, r, 1)
    px = R.pixels(z).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(F.col(c)).alias(c) for c in "rgb"])
    return z.select("image_id", "ox", "oy").join(px, "image_id")
