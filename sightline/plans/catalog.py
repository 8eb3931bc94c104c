"""Registered queries and their SQL. Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import color as C
from ..functions import evidence as E
from ..functions import text as X
from ..operators import joins as J
from ..operators import matching as M
from ..operators import raster as R
from ..operators import rules as U
from ..operators import shapes as S
from ..sources import files, reports
from ..streaming import events as V
from . import proxies as P
from . import tasks
from .registry import QUERIES, SQL, query, rounded

FLAGSHIP = "overlap_score"


_BOTH = """ix AS (SELECT a.report_id, a.ord AS a_ord, b.ord AS b_ord,
    (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab
  FROM el a JOIN el b ON a.report_id = b.report_id AND a.ord < b.ord
  WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)),
ov AS (SELECT report_id, a_ord, b_ord, area, area / (aa + ab - area) AS iou FROM ix WHERE area >= 200 AND area / (aa + ab - area) > 0.01)"""


@query(f"WITH {P.ELEMENTS_SQL}, {_BOTH} SELECT report_id, a_ord, b_ord, area, round(iou, 6) AS iou FROM ov")
def box_overlap_pairs(spark, sf):
    d = J.overlap_pairs(P.elements(spark, sf))
    return d.select("report_id", "a_ord", "b_ord", "area", rounded(F.col("iou")).alias("iou"))


@query(f"""WITH {P.ELEMENTS_SQL}, {_BOTH}, n AS (SELECT report_id, count(*) AS n_elements FROM el GROUP BY report_id),
w AS (SELECT report_id, count(*) AS warn FROM ov GROUP BY report_id)
SELECT n.report_id, n_elements, coalesce(warn, 0) AS warn, round(100.0 * (1 - 0.5 * coalesce(warn, 0) / n_elements), 6) AS design_score
FROM n LEFT JOIN w ON n.report_id = w.report_id""")
def overlap_score(spark, sf):
    e = P.elements(spark, sf)
    d = U.design_score(e, U.overlap(e))
    return d.select("report_id", "n_elements", "warn", rounded(F.col("design_score")).alias("design_score"))


_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_LUM = lambda p: f"(0.2126 * ({_LIN.format(c=p + 'r')}) + 0.7152 * ({_LIN.format(c=p + 'g')}) + 0.0722 * ({_LIN.format(c=p + 'b')}))"


@query(f"""WITH {P.ELEMENTS_SQL}, c AS (SELECT report_id, ord, (seed * 73) % 256 AS r, (seed * 151) % 256 AS g, (seed * 211) % 256 AS b,
  (ord * 97 + seed * 5) % 256 AS k, CASE WHEN seed % 3 = 0 THEN 18.0 ELSE 11.0 END AS pt FROM el),
t AS (SELECT report_id, ord, pt, r, g, b, k AS kr, (k * 3) % 256 AS kg, (k * 7) % 256 AS kb FROM c),
l AS (SELECT report_id, ord, pt, {_LUM('')} AS a, {_LUM('k')} AS z FROM t),
q AS (SELECT report_id, ord, pt, (greatest(a, z) + 0.05) / (least(a, z) + 0.05) AS ratio FROM l)
SELECT report_id, ord, CASE WHEN ratio < 2 THEN 'critical' ELSE 'warn' END AS severity, round(ratio, 6) AS ratio FROM q
WHERE ratio < CASE WHEN pt >= 18 THEN 3.0 ELSE 4.5 END""")
def contrast_findings(spark, sf):
    e = P.elements(spark, sf)
    d = U.contrast(U.prepared(e.withColumns(_inked())))
    return d.select("report_id", F.col("element_ids")[0].alias("ord"), "severity", rounded(F.col("value")).alias("ratio"))


def _inked() -> dict:
    """A fill and a run of coloured text for every element."""
    k = (F.col("ord") * 97 + F.col("seed") * 5) % 256
    run = F.struct(F.lit("x").alias("text"), C.hex_of_rgb(k, (k * 3) % 256, (k * 7) % 256).alias("color"), F.when(F.col("seed") % 3 == 0, 18.0).otherwise(11.0).alias("size_pt"))
    return {"fill": C.hex_of_rgb(*P.colors(F.col("seed"))), "texts": F.array(run)}


_SAFE = """sf AS (SELECT report_id, ord, CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 960 OR y2 > 640 THEN 'critical'
  WHEN NOT ((x1 <= 0 AND x2 >= 960) OR (y1 <= 0 AND y2 >= 640)) AND least(x1, y1, 960 - x2, 640 - y2) <= 1 THEN 'warn' END AS severity,
  least(x1, y1, 960 - x2, 640 - y2) AS edge FROM el)"""


def _safe(spark, sf):
    e = P.elements(spark, sf).withColumns({"canvas_w": F.lit(960.0), "canvas_h": F.lit(640.0), "text": F.lit("x")})
    return U.safe_area(U.prepared(e))


@query(f"WITH {P.ELEMENTS_SQL}, {_SAFE} SELECT report_id, ord, severity, edge FROM sf WHERE severity IS NOT NULL")
def safe_area_findings(spark, sf):
    return _safe(spark, sf).select("report_id", F.col("element_ids")[0].alias("ord"), "severity", F.col("value").alias("edge"))


@query(f"""WITH {P.ELEMENTS_SQL}, {_SAFE} SELECT report_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info FROM sf WHERE severity IS NOT NULL GROUP BY report_id""")
def severity_histogram(spark, sf):
    return U.severities(_safe(spark, sf))


_INK = f"""c AS (SELECT report_id, ord, (seed * 73) % 256 AS r, (seed * 151) % 256 AS g, (seed * 211) % 256 AS b, (ord * 97 + seed * 5) % 256 AS k FROM el),
ink AS (SELECT report_id, ord, {_LUM('')} AS a, {_LUM('k')} AS z FROM (SELECT *, k AS kr, (k * 3) % 256 AS kg, (k * 7) % 256 AS kb FROM c))"""


@query(f"""WITH {P.ELEMENTS_SQL}, {_BOTH}, {_INK}, au AS (
  SELECT report_id, 'overlap' AS type, least(0.99, area / (aa + ab - area) + 0.5) AS confidence FROM ix WHERE area >= 400 AND area / (aa + ab - area) > 0.05
  UNION ALL SELECT report_id, 'off_canvas', 0.95 FROM el WHERE x1 < -1 OR y1 < -1 OR x2 > 961 OR y2 > 641
  UNION ALL SELECT report_id, 'contrast', 1.0 FROM ink WHERE (greatest(a, z) + 0.05) / (least(a, z) + 0.05) < 4.5)
SELECT report_id, type, count(*) AS n, round(max(confidence), 6) AS top FROM au GROUP BY report_id, type""")
def audit_findings(spark, sf):
    e = P.elements(spark, sf).withColumns({"canvas_w": F.lit(960.0), "canvas_h": F.lit(640.0), **_inked()})
    return U.audit(e).groupBy("report_id", "type").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("confidence")).alias("top"))


_DS = """m AS (SELECT report_id, ord, conf * 0.8 AS p1, greatest(0, least(1, (ord + 1) / 8.0)) AS d, conf AS p3 FROM el),
s1 AS (SELECT *, 0.8 * 0 AS z, p1 AS c1, 0.0 AS f1, 1 - p1 AS u1, exp(-d * 10 / 5.0) AS c2, 1 - exp(-d * 10 / 5.0) AS f2, p3 AS c3, 0.0 AS f3, 1 - p3 AS u3 FROM m),
s2 AS (SELECT *, 1 - (c1 * f2 + f1 * c2) AS l FROM s1),
s3 AS (SELECT *, CASE WHEN l <= 1e-12 THEN 0 ELSE (c1 * c2 + u1 * c2) / l END AS c, CASE WHEN l <= 1e-12 THEN 0 ELSE (f1 * f2 + u1 * f2) / l END AS f, CASE WHEN l <= 1e-12 THEN 1 ELSE 0.0 END AS u FROM s2),
s4 AS (SELECT *, 1 - (c * f3 + f * c3) AS l2 FROM s3),
s5 AS (SELECT *, CASE WHEN l2 <= 1e-12 THEN 0 ELSE (c * c3 + c * u3 + u * c3) / l2 END AS bel, CASE WHEN l2 <= 1e-12 THEN 0 ELSE (f * f3 + f * u3 + u * f3) / l2 END AS fin,
  CASE WHEN l2 <= 1e-12 THEN 1 ELSE u * u3 / l2 END AS unc, greatest(c1 * f2 + f1 * c2, c1 * f3 + f1 * c3, c2 * f3 + f2 * c3) AS k FROM s4)"""
_VERDICT = "CASE WHEN k > 0.70 THEN 'needs_review' WHEN bel > 0.60 THEN 'confirmed' WHEN bel + unc < 0.40 THEN 'conflict' ELSE 'needs_review' END"


@query(f"WITH {P.ELEMENTS_SQL}, {_DS} SELECT report_id, ord, round(bel, 6) AS belief, round(bel + unc, 6) AS plausibility, round(k, 6) AS conflict, {_VERDICT} AS verdict FROM s5")
def evidence_verdict(spark, sf):
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ord") + 1) / 8.0)) * 10
    ms = F.array(E.FACTORIES["ocr"](F.col("conf")), E.FACTORIES["color"](gap), E.FACTORIES["detect"](F.col("conf")))
    d = P.elements(spark, sf).withColumn("ms", ms).withColumn("m", E.fold(F.col("ms"))).withColumn("k", E.most_conflict(F.col("ms")))
    return d.select("report_id", "ord", rounded(F.col("m.c")).alias("belief"), rounded(F.col("m.c") + F.col("m.u")).alias("plausibility"), rounded(F.col("k")).alias("conflict"), E.verdict(F.col("k"), F.col("m")).alias("verdict"))


@query(f"WITH {P.ELEMENTS_SQL}, {_DS}, v AS (SELECT report_id, {_VERDICT} AS verdict FROM s5) SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def verdict_counts(spark, sf):
    return evidence_verdict(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P.ELEMENTS_SQL} SELECT report_id, ord, kind FROM el a WHERE kind = 'ocr' AND NOT EXISTS (SELECT 1 FROM el b WHERE b.kind = 'dom' AND b.report_id = a.report_id)")
def unmatched_sources(spark, sf):
    e = P.elements(spark, sf)
    return J.unmatched(e.where("kind = 'ocr'").select("report_id", "ord", "kind"), e.where("kind = 'dom'").select("report_id"), ["report_id"])


@query(f"WITH {P.ELEMENTS_SQL}, k AS (SELECT report_id, kind, min(ord) AS first FROM el GROUP BY report_id, kind) SELECT a.report_id, a.kind AS a_key, b.kind AS b_key FROM k a JOIN k b ON a.report_id = b.report_id AND a.first < b.first")
def source_group_pairs(spark, sf):
    return J.source_groups(P.elements(spark, sf).withColumn("source", F.array("kind")))


_PTS = "pt AS (SELECT DISTINCT l_orderkey AS report_id, l_linenumber AS point_id, CAST((l_orderkey * 29 + l_linenumber * 101) % 900 AS DOUBLE) AS px, CAST((l_orderkey * 17 + l_linenumber * 67) % 650 AS DOUBLE) AS py FROM lineitem)"


@query(f"""WITH {P.ELEMENTS_SQL}, {_PTS}, h AS (SELECT pt.report_id, point_id, ord, ((x1 + x2) / 2 - px) * ((x1 + x2) / 2 - px) + ((y1 + y2) / 2 - py) * ((y1 + y2) / 2 - py) AS d2
  FROM pt JOIN el ON pt.report_id = el.report_id WHERE px >= x1 AND px <= x2 AND py >= y1 AND py <= y2),
r AS (SELECT *, row_number() OVER (PARTITION BY report_id, point_id ORDER BY d2, ord DESC) AS k FROM h)
SELECT report_id, point_id, ord, round(sqrt(d2), 6) AS distance FROM r WHERE k = 1""")
def hit_test_nearest(spark, sf):
    li = P.read(spark, sf, "lineitem")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    pts = li.select(o.alias("report_id"), n.alias("point_id"), ((o * 29 + n * 101) % 900).cast("double").alias("px"), ((o * 17 + n * 67) % 650).cast("double").alias("py")).distinct()
    d = J.hit_test(pts, P.elements(spark, sf))
    return d.select("report_id", "point_id", "ord", rounded(F.col("distance")).alias("distance"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {_VEC}, s AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s) SELECT vec_id, rank, other, round(sim, 5) AS sim FROM r WHERE rank <= 2")
def embedding_top2(spark, sf):
    return J.nearest(P.read(spark, sf, "embeddings"), 2).select("vec_id", "rank", "other", rounded(F.col("sim"), 5).alias("sim"))


@query(f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 5) AS sim FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) > 0.3")
def embedding_pairs(spark, sf):
    return J.cosine_pairs(P.read(spark, sf, "embeddings"), 0.3).select("a", "b", rounded(F.col("sim"), 5).alias("sim"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, min(value) AS lo, max(value) AS hi, avg(value) AS mean, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, lo AS min, hi AS max, round(mean, 6) AS mean, v[CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) + 1] AS q25, v[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS q50, v[CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS q75 FROM s""")
def nearest_rank_quantiles(spark, sf):
    return R.nearest_rank(P.read(spark, sf, "events"), ["event_type"], "value").withColumn("mean", rounded(F.col("mean")))


@query("WITH p AS (SELECT p_brand, p_size / 50.0 AS v FROM part) SELECT p_brand, CAST(least(floor(v * 10), 9) AS INT) AS bin, count(*) AS n FROM p WHERE v >= 0 AND v < 1 GROUP BY 1, 2")
def equal_width_bins(spark, sf):
    p = P.read(spark, sf, "part").select("p_brand", R.equal_bins(F.col("p_size") / 50.0, 10).alias("bin"))
    return p.where("bin IS NOT NULL").groupBy("p_brand", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER lo AS n0, sum(n * g) OVER lo AS s0, sum(n) OVER al AS nt, sum(n * g) OVER al AS st FROM c
  WINDOW lo AS (PARTITION BY l_returnflag ORDER BY g ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY l_returnflag)),
b AS (SELECT l_returnflag, g, CASE WHEN nt > n0 THEN CAST(n0 AS DOUBLE) * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2) ELSE 0.0 END AS v FROM r)
SELECT l_returnflag, arg_max(g, v) AS threshold FROM b GROUP BY l_returnflag""")
def otsu_by_group(spark, sf):
    d = P.read(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("g"))
    return R.otsu(d, ["l_returnflag"], "g")


@query(f"WITH {P.ELEMENTS_SQL} SELECT kind, CAST(least(15, floor(x1 / 800 * 16)) AS INT) AS gx, CAST(least(15, floor(y1 / 600 * 16)) AS INT) AS gy, count(*) AS n FROM el GROUP BY 1, 2, 3")
def density_16x16(spark, sf):
    d = P.elements(spark, sf).select("kind", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return R.heat_map(d, ["kind"], 800, 600)


@query(f"""WITH {P.ELEMENTS_SQL}, w AS (SELECT report_id, x1, y1, CAST(x2 - x1 AS BIGINT) AS m FROM el)
SELECT report_id, round(sum(x1 * m) / sum(m), 6) AS cx, round(sum(y1 * m) / sum(m), 6) AS cy, min(x1) FILTER (WHERE m > 100) AS x1, min(y1) FILTER (WHERE m > 100) AS y1, max(x1) FILTER (WHERE m > 100) AS x2, max(y1) FILTER (WHERE m > 100) AS y2,
  round(count(*) FILTER (WHERE m > 100) / count(*), 6) AS coverage FROM w GROUP BY report_id""")
def centroid_layout(spark, sf):
    e = P.elements(spark, sf).select("report_id", "x1", "y1", (F.col("x2") - F.col("x1")).cast("long").alias("m"))
    d = R.layout(e, ["report_id"], "x1", "y1", "m", F.lit(800.0), F.lit(600.0), 100)
    return d.select("report_id", *[rounded(F.col(c)).alias(c) for c in ("cx", "cy")], "x1", "y1", "x2", "y2", rounded(F.col("coverage")).alias("coverage"))


@query(f"""WITH {P.ELEMENTS_SQL}, p AS (SELECT DISTINCT kind, x1 AS x, y1 AS y FROM el), t AS (SELECT kind, x, y, unnest(range(-90, 90)) AS theta FROM p),
v AS (SELECT kind, theta, CAST(round_even(x * cos(radians(theta)) + y * sin(radians(theta)), 0) AS BIGINT) AS rho, count(*) AS votes FROM t GROUP BY 1, 2, 3)
SELECT kind, CAST(theta AS INTEGER) AS theta, rho, votes FROM v WHERE votes >= 30""")
def hough_votes(spark, sf):
    p = P.elements(spark, sf).select("kind", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    return R.hough(p, ["kind"]).where("votes >= 30").select("kind", "theta", "rho", "votes")


@query()
def hough_lines(spark, sf):
    p = P.elements(spark, sf).select("kind", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    return R.peaks(R.hough(p, ["kind"]), ["kind"], 30, 10)


@query("""WITH px AS (SELECT p_brand AS image_id, p_partkey % 32 AS x, (p_partkey // 32) % 24 AS y, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part),
c AS (SELECT image_id, least(7, ((x + 1) * 8 - 1) // 32) AS c, least(5, ((y + 1) * 6 - 1) // 24) AS row, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) AS lum FROM px GROUP BY 1, 2, 3),
k AS (SELECT image_id, row, c, substr('@%#*+=-:. ', CAST(least(greatest(floor((255 - lum) / 255 * 9), 0), 9) AS INT) + 1, 1) AS ch FROM c)
SELECT image_id, CAST(row AS INT) AS row, string_agg(ch, '' ORDER BY c) AS line FROM k GROUP BY 1, 2""")
def ascii_grid(spark, sf):
    return R.ascii_art(_px(spark, sf), 8, 6, F.lit(32), F.lit(24))


def _px(spark, sf):
    p, k = P.read(spark, sf, "part").select("p_brand", "p_partkey"), F.col("p_partkey")
    r, g, b = P.colors(k)
    return p.select(F.col("p_brand").alias("image_id"), (k % 32).alias("x"), (F.floor(k / 32) % 24).alias("y"), r.alias("r"), g.alias("g"), b.alias("b"))


_HSV = """px AS (SELECT p_partkey, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part),
mm AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
hs AS (SELECT *, CASE WHEN hi > 0 THEN (hi - lo) * 255 // hi ELSE 0 END AS s, CASE WHEN hi = lo THEN NULL WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END * 60 AS h0 FROM mm),
hv AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM hs),
fa AS (SELECT CASE WHEN h IS NULL OR s < 25 THEN 'neutral' WHEN h < 15 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 65 THEN 'yellow' WHEN h < 160 THEN 'green' WHEN h < 200 THEN 'cyan' WHEN h < 250 THEN 'blue' WHEN h < 285 THEN 'purple' WHEN h < 330 THEN 'magenta' ELSE 'red' END AS family,
  CASE WHEN hi < 85 THEN 'dark' WHEN hi < 170 THEN 'mid' ELSE 'light' END AS tone FROM hv)"""


@query(f"WITH {_HSV} SELECT family, tone, count(*) AS n FROM fa GROUP BY GROUPING SETS ((family), (tone), (family, tone))")
def color_family_groups(spark, sf):
    r, g, b = (c.cast("double") for c in P.colors(F.col("p_partkey")))
    s, v = C.saturation_value(r, g, b)
    d = P.read(spark, sf, "part").select(C.family(C.hue(r, g, b), s).alias("family"), C.tone(v).alias("tone"))
    return d.groupingSets([["family"], ["tone"], ["family", "tone"]], "family", "tone").agg(F.count(F.lit(1)).alias("n"))


@query("WITH px AS (SELECT p_brand, (p_partkey * 73) % 256 // 64 AS r, (p_partkey * 151) % 256 // 64 AS g, (p_partkey * 211) % 256 // 64 AS b FROM part), c AS (SELECT p_brand AS image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rank, n / sum(n) OVER (PARTITION BY image_id) AS share FROM c) SELECT image_id, rank, printf('#%02X%02X%02X', r, g, b) AS hex, n, round(share, 6) AS share FROM k WHERE rank <= 5")
def dominant_colors(spark, sf):
    q = _px(spark, sf).select("image_id", *[F.floor(F.col(c) / 64).alias(c) for c in "rgb"])
    return R.dominant(q, ["image_id"], 5).select("image_id", "rank", "hex", "n", rounded(F.col("share")).alias("share"))


@query()
def median_cut_palettes(spark, sf):
    return R.palettes(R.histogram(_px(spark, sf)), 8)


@query("WITH a AS (SELECT p_partkey, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part) SELECT p_partkey, printf('#%02X%02X%02X', r, g, b) AS hex, CAST((19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS BIGINT) AS gray, CASE WHEN r > 200 AND g < 100 AND b < 100 THEN 'R' WHEN g > 200 AND r < 100 AND b < 100 THEN 'G' WHEN b > 200 AND r < 100 AND g < 100 THEN 'B' WHEN r > 150 AND g > 150 AND b < 100 THEN 'Y' WHEN r > 150 AND g < 100 AND b > 150 THEN 'M' WHEN r < 100 AND g > 150 AND b > 150 THEN 'C' WHEN r > 200 AND g > 200 AND b > 200 THEN 'W' ELSE 'K' END AS letter, round(" + _LUM("") + ", 6) AS luminance FROM a")
def color_scalars(spark, sf):
    r, g, b = P.colors(F.col("p_partkey"))
    d = P.read(spark, sf, "part").select("p_partkey", C.hex_of_rgb(r, g, b).alias("hex"))
    r, g, b = (c.cast("long") for c in C.rgb_of_hex(F.col("hex")))
    return d.select("p_partkey", "hex", C.gray(r, g, b).cast("long").alias("gray"), C.letter(r, g, b).alias("letter"), rounded(C.luminance(r, g, b)).alias("luminance"))


@query(f"WITH {P.ELEMENTS_SQL} SELECT report_id, ord, round_even((x1 - 3) * 1.5, 0) AS dx, round_even(x1 / 1.5 + 3, 0) AS cx, round_even(y1 * 0.5, 0) AS sy, greatest(round_even(x1 - 100, 0), 0) AS qx1, least(round_even(x2, 0), 640) AS qx2, (x2 - x1) * (y2 - y1) AS area, printf('[bbox: %d, %d, %d, %d]', CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(x2 AS BIGINT), CAST(y2 AS BIGINT)) AS note FROM el")
def bbox_scalars(spark, sf):
    b = B.box()
    k = B.clipped((b[0] - 100, b[1], b[2], b[3]), F.lit(640.0), F.lit(480.0))
    return P.elements(spark, sf).select("report_id", "ord", B.css_to_device(b[0], F.lit(3), F.lit(1.5)).alias("dx"), B.device_to_css(b[0], F.lit(3), F.lit(1.5)).alias("cx"), B.scaled(b, 0.5)[1].alias("sy"), k[0].alias("qx1"), k[2].alias("qx2"), B.area(b).alias("area"), B.notation(b).alias("note"))


_COMMON = ", ".join(f"'{w}'" for w in X.COMMON)


@query(f"""WITH t AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), a AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]+') AS ws FROM t),
s AS (SELECT conv_id, turn, unnest(range(len(ws))) AS place, unnest(ws) AS w FROM a), d AS (SELECT unnest([{_COMMON}]) AS word, unnest(range({len(X.COMMON)})) AS i),
k AS (SELECT w, arg_min(word, (levenshtein(w, word), i)) AS best, min(levenshtein(w, word)) AS dist FROM (SELECT DISTINCT w FROM s) CROSS JOIN d GROUP BY w)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, w, CASE WHEN length(w) >= 2 AND dist <= 1 THEN best ELSE w END AS corrected, CASE WHEN length(w) >= 2 AND dist <= 1 THEN 0.9 ELSE 1.0 END AS corrected_conf FROM s JOIN k USING (w)""")
def dict_correct(spark, sf):
    """Every word of every turn, by its place in the text."""
    t = P.read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text").distinct()
    t = t.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("place", "w")).withColumn("conf", F.lit(1.0))
    return X.corrected(t, "w", "conf").select("conv_id", "turn", "place", "w", "corrected", rounded(F.col("corrected_conf"), 3).alias("corrected_conf"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), a AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM t),
s AS (SELECT conv_id, turn, unnest(range(len(ws))) AS place, lower(unnest(ws)) AS w FROM a)
SELECT x.conv_id, x.turn, CAST(x.place AS INTEGER) AS place, x.w AS a, y.w AS b, round(CASE WHEN x.w = y.w THEN 1.0 WHEN contains(x.w, y.w) OR contains(y.w, x.w) THEN 0.7 ELSE greatest(0.0, 1 - levenshtein(x.w, y.w) / greatest(length(x.w), length(y.w))) END, 6) AS sim
FROM s x JOIN s y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND y.place = x.place""")
def text_similarity(spark, sf):
    """Turns that follow each other, word by word at equal places; text_similarity_texts compares them whole."""
    t = P.read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text").distinct()
    w = t.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("place", "a"))
    d = w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), "place", F.col("a").alias("b")), ["conv_id", "turn", "place"])
    return d.select("conv_id", "turn", "place", F.lower("a").alias("a"), F.lower("b").alias("b"), rounded(X.similarity(F.col("a"), F.col("b"))).alias("sim"))


@query()
def text_similarity_texts(spark, sf):
    """Whole texts of turns that follow each other."""
    w = P.read(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("a")).distinct()
    y = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return w.join(y, ["conv_id", "turn"]).select("conv_id", "turn", F.length("a").alias("a_chars"), F.length("b").alias("b_chars"), rounded(X.similarity(F.col("a"), F.col("b"))).alias("sim"))


_LINES = """ln AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'focus_changed' WHEN 'purchase' THEN 'windows_changed' WHEN 'view' THEN 'workspaces_changed' WHEN 'error' THEN 'overview_toggled' ELSE 'other' END AS kind FROM events)"""


@query(f"WITH {_LINES} SELECT kind, kind IN ('windows_changed', 'window_opened_or_changed', 'window_closed', 'focus_changed') AS is_trigger, count(*) AS n FROM ln GROUP BY 1, 2")
def event_classify(spark, sf):
    d = P.log_lines(spark, sf).withColumn("kind", V.classify(F.col("line")))
    return d.groupBy("kind", V.triggers(F.col("kind")).alias("is_trigger")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_LINES}, o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ln),
f AS (SELECT user_id, k, us AS start FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN o.us - f.start >= 86400000000 THEN o.us ELSE f.start END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
g AS (SELECT o.user_id, f.start, o.event_id, o.kind, o.k, o.kind IN ('windows_changed', 'focus_changed') AS hit FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k)
SELECT user_id, coalesce(arg_max(event_id, k) FILTER (WHERE hit), arg_min(event_id, k)) AS event_id, coalesce(arg_max(kind, k) FILTER (WHERE hit), arg_min(kind, k)) AS kind FROM g GROUP BY user_id, start""")
def throttle_merge(spark, sf):
    d = P.log_lines(spark, sf).withColumn("kind", V.classify(F.col("line")))
    d = d.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "kind", V.triggers(F.col("kind")).alias("is_trigger"), F.col("event_id").alias("tie"))
    return V.throttle(d, "user_id", 86400.0).select("user_id", F.col("tie").alias("event_id"), "kind")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> 'error' GROUP BY user_id")
def latest_per_key(spark, sf):
    e = P.read(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    return V.latest(e, "user_id", ["ts", "event_id"], "ok").select("user_id", "event_id", "event_type")


@query("WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY 1, 2")
def html_primitives(spark, sf):
    return files.html_tags(P.read(spark, sf, "pages"))


@query("SELECT o_custkey AS report_id, o_orderpriority AS key, arg_min(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def report_merge_first_wins(spark, sf):
    o = P.read(spark, sf, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("step"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value"))
    return reports.merge_steps(o)


_P3 = "q AS (SELECT p_brand AS scene, p_partkey AS ord, p_size AS s, (p_partkey * 31) % 400 AS x, (p_partkey * 57) % 300 AS y, (p_partkey * 17) % 200 AS z FROM part)"


@query(f"""WITH {_P3}, d AS (SELECT a.scene, a.ord AS a_ord, b.ord AS b_ord, CAST(greatest(b.x - a.x - a.s, a.x - b.x - b.s, b.y - a.y - a.s, a.y - b.y - b.s, b.z - a.z - a.s, a.z - b.z - b.s) AS DOUBLE) AS aabb FROM q a JOIN q b ON a.scene = b.scene AND a.ord < b.ord)
SELECT scene, a_ord, b_ord, aabb FROM d WHERE aabb <= 5""")
def box3d_proximity(spark, sf):
    return J.proximity(P.parts3d(spark, sf), ["scene"], 5.0, 100.0).select("scene", "a_ord", "b_ord", "aabb")


_CORNERS = " + ".join(f"pow(least(abs(a.{k} - b.{k}), abs(a.{k} + a.s - b.{k}), abs(a.{k} - b.{k} - b.s), abs(a.{k} + a.s - b.{k} - b.s)), 2)" for k in "xyz")
#: Upright boxes, whose points are their corners: the gap over all axes is the widest one, and the nearest corners are nearest on each axis.
_NEAR3 = f"""nr AS (SELECT a.scene, a.ord AS a_ord, b.ord AS b_ord, CAST(greatest(b.x - a.x - a.s, a.x - b.x - b.s, b.y - a.y - a.s, a.y - b.y - b.s, b.z - a.z - a.s, a.z - b.z - b.s) AS DOUBLE) AS aabb,
  sqrt({_CORNERS}) AS cloud FROM q a JOIN q b ON a.scene = b.scene AND a.ord < b.ord),
fi AS (SELECT scene AS scene_id, a_ord, b_ord, aabb, CASE WHEN cloud <= 1e-6 THEN 'interference' WHEN cloud < 5 THEN 'tight_gap' ELSE 'clearance' END AS rule, round(floor(CASE WHEN cloud <= 1e-6 THEN 0 ELSE cloud END * 1000 * 10000 + 0.5) / 10000, 3) AS distance_mm FROM nr WHERE aabb <= 5)"""


def _solids(spark, sf):
    p = P.parts3d(spark, sf)
    cs = F.array(*[F.array(*[F.col("hi" if k >> i & 1 else "lo")[i] for i in range(3)]) for k in range(8)])
    return p.select(F.col("scene").alias("scene_id"), "ord", F.lit("MESH").alias("type"), cs.alias("bbox3d"), cs.alias("verts"))


@query(f"WITH {_P3}, {_NEAR3} SELECT *, 'mesh-kdtree' AS method FROM fi")
def audit_3d(spark, sf):
    d = S.audit3d(_solids(spark, sf), gap_mm=5000.0)
    return d.select("scene_id", "a_ord", "b_ord", "aabb", "rule", rounded(F.col("distance_mm"), 3).alias("distance_mm"), "method")


@query(f"WITH {_P3}, {_NEAR3} SELECT scene_id, count(*) FILTER (WHERE rule = 'interference') AS interference, count(*) FILTER (WHERE rule = 'tight_gap') AS tight_gap, count(*) FILTER (WHERE rule = 'clearance') AS clearance, 'mesh-kdtree' AS methods FROM fi GROUP BY scene_id")
def audit_3d_metrics(spark, sf):
    return S.audit3d_metrics(S.audit3d(_solids(spark, sf), gap_mm=5000.0)).withColumn("methods", F.array_join("methods", ","))


@query(f"""WITH {_P3}, d AS (SELECT a.scene, a.ord AS a_ord, b.ord AS b_ord, CAST(greatest(b.x - a.x - a.s, a.x - b.x - b.s, b.y - a.y - a.s, a.y - b.y - b.s, b.z - a.z - a.s, a.z - b.z - b.s) AS DOUBLE) AS aabb FROM q a JOIN q b ON a.scene = b.scene AND a.ord < b.ord)
SELECT scene AS scene_id, a_ord, b_ord, -1000 * aabb AS penetration_mm FROM d WHERE aabb <= 2""")
def audit_3d_boxes(spark, sf):
    """By upright boxes alone."""
    return S.audit3d(_solids(spark, sf), 2000.0, "aabb").select("scene_id", "a_ord", "b_ord", "penetration_mm")


def _sides(spark, sf):
    e = P.elements(spark, sf).withColumn("text", F.concat(F.lit("p"), F.col("seed").cast("string")))
    return e.where("kind = 'ocr'"), e.where("kind = 'dom'")


@query()
def optimal_match(spark, sf):
    a, b = _sides(spark, sf)
    return M.match(a, b, ["report_id"])


@query()
def fusion_findings(spark, sf):
    a, b = (d.withColumn("lab", F.array(*C.lab(*[c.cast("double") for c in P.colors(F.col("seed"))]))) for d in _sides(spark, sf))
    return M.fuse(a, b, ["report_id"])


@query()
def greedy_entities(spark, sf):
    e = P.elements(spark, sf)
    o = e.select("report_id", "ord", F.col("kind").alias("source"), "x1", "y1", "x2", "y2", F.concat(F.lit("p"), F.col("seed").cast("string")).alias("text"), F.lit(None).cast("string").alias("caption"), F.when(F.col("kind") == "detect", "icon").alias("class"), "conf", (F.col("seed") % 2 == 0).alias("interactive"))
    return M.entities(o)


@query()
def greedy_clusters(spark, sf):
    v = P.read(spark, sf, "embeddings").select("label", F.col("vec_id").alias("ord"), "embedding")
    return M.greedy_clusters(v, ["label"], 0.3)


@query()
def suppressed_boxes(spark, sf):
    e = P.elements(spark, sf).select("report_id", "ord", "x1", "y1", "x2", "y2", F.col("conf").alias("score"))
    return M.suppress(e, ["report_id"], 0.3)


@query()
def alignment_drift(spark, sf):
    e = P.elements(spark, sf).withColumns({"source": F.array("kind"), "y1": F.col("y1"), "text": F.lit("x")})
    return U.alignment(U.prepared(e)).withColumn("value", rounded(F.col("value")))


@query(f"""WITH {P.DENSE_SQL}, g AS (SELECT *, lead(x1) OVER w - x2 AS gap, lead(ord) OVER w AS next FROM de WINDOW w AS (PARTITION BY report_id, line ORDER BY x1, ord)),
m AS (SELECT *, list_sort(list(gap) OVER (PARTITION BY report_id, line)) AS gaps, count(*) OVER (PARTITION BY report_id, line) AS n FROM g WHERE gap > 0)
SELECT report_id, ord, next, gap FROM m WHERE n >= 2 AND gap >= 8 AND gap > 1.8 * gaps[n // 2 + 1]""")
def spacing_anomaly(spark, sf):
    d = U.spacing(U.prepared(P.dense(spark, sf).withColumn("source", F.array(F.lit("dom")))))
    return d.select("report_id", F.col("element_ids")[0].alias("ord"), F.col("element_ids")[1].alias("next"), F.col("value").alias("gap"))


@query()
def rule_findings(spark, sf):
    e = P.elements(spark, sf).withColumns({"source": F.array("kind"), "canvas_w": F.lit(960.0), "canvas_h": F.lit(640.0), "text": F.lit("x")})
    return U.run(e)


@query(f"WITH {P.ELEMENTS_SQL}, r AS (SELECT report_id, ord, conf, row_number() OVER (PARTITION BY report_id ORDER BY conf DESC, ord) AS rank, count(*) OVER (PARTITION BY report_id) >= 3 AS truncated FROM el) SELECT report_id, ord, rank, truncated FROM r WHERE rank <= 3")
def top_elements(spark, sf):
    return R.top(P.elements(spark, sf), ["report_id"], "conf", 3).select("report_id", "ord", "rank", "truncated")


@query(f"WITH {P.ELEMENTS_SQL}, r AS (SELECT report_id, ord, row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY report_id) AS n FROM el) SELECT report_id, ord FROM r WHERE k % greatest(n // 3, 1) = 0")
def stride_sample(spark, sf):
    return R.sample(P.elements(spark, sf), ["report_id"], ["ord"], 3).select("report_id", "ord")


@query(f"WITH {P.ELEMENTS_SQL}, c AS (SELECT report_id, kind, count(*) AS n FROM el GROUP BY 1, 2) SELECT report_id, string_agg(kind, ',' ORDER BY kind) AS sources, round((sum(n) - count(*)) / sum(n), 6) AS dedup FROM c GROUP BY report_id")
def sources_and_dedup(spark, sf):
    c = P.elements(spark, sf).groupBy("report_id").agg(F.array_sort(F.collect_set("kind")).alias("sources"), F.count(F.lit(1)).alias("n"))
    return c.select("report_id", F.array_join("sources", ",").alias("sources"), rounded(M.dedup_ratio(F.col("n"), F.size("sources"))).alias("dedup"))


@query("""WITH a AS (SELECT p_brand, p_partkey AS x, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b, (p_partkey * 73 + p_size) % 256 AS r2, (p_partkey * 151) % 256 AS g2, (p_partkey * 211 + p_size * 3) % 256 AS b2 FROM part)
SELECT p_brand, round(count(*) FILTER (WHERE r <> r2 OR g <> g2 OR b <> b2) / count(*), 6) AS ratio, count(*) FILTER (WHERE (299 * abs(r - r2) + 587 * abs(g - g2) + 114 * abs(b - b2)) // 1000 > 30) AS changed FROM a GROUP BY p_brand""")
def pixel_change(spark, sf):
    p, k, s = P.read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    r, g, b = P.colors(k)
    one = p.select("p_brand", k.alias("x"), F.lit(0).alias("y"), r.alias("r"), g.alias("g"), b.alias("b"))
    two = p.select("p_brand", k.alias("x"), F.lit(0).alias("y"), ((k * 73 + s) % 256).alias("r"), g.alias("g"), ((k * 211 + s * 3) % 256).alias("b"))
    d = J.pixel_diff(one, two, ["p_brand"])
    share = J.change_ratio(d, ["p_brand"]).select("p_brand", rounded(F.col("ratio")).alias("ratio"))
    return d.groupBy("p_brand").agg(F.count_if("changed").alias("changed")).join(share, "p_brand")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def window_outputs(spark, sf):
    c = P.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("workspace_id"))
    n = P.read(spark, sf, "nation").select(F.col("n_nationkey").alias("workspace_id"), "n_name", F.col("n_regionkey").alias("output"))
    r = P.read(spark, sf, "region").select(F.col("r_regionkey").alias("output"), "r_name")
    return J.window_output(c, n, r).select("c_custkey", "n_name", "r_name")


@query(f"WITH {P.ELEMENTS_SQL} SELECT report_id, max(x2) AS w, max(y2) AS h FROM el GROUP BY report_id")
def layout_union(spark, sf):
    e = P.elements(spark, sf).select("report_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return J.layout_size(e, ["report_id"])


@query("WITH p AS (SELECT p_brand AS image_id, p_partkey AS ord, [sin(p_partkey), cos(p_partkey * 3), sin(p_partkey * 7)] AS l, (p_partkey % 100) / 100.0 AS cx, p_size / 100.0 AS w FROM part), s AS (SELECT image_id, ord, list_position(l, list_max(l)) AS k, 1 / (1 + exp(-list_max(l))) AS score, (cx - w / 2) * 640 AS x1 FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0.5) SELECT image_id, ord, rank, ['a', 'b', 'c'][k] AS class, round(score, 6) AS score, round(x1, 6) AS x1 FROM r WHERE rank <= 50")
def detect_decode(spark, sf):
    k = F.col("p_partkey")
    p = P.read(spark, sf, "part").select(F.col("p_brand").alias("image_id"), k.alias("ord"), F.array(F.sin(k), F.cos(k * 3), F.sin(k * 7)).alias("logits"), ((k % 100) / 100.0).alias("cx"), F.lit(0.5).alias("cy"), (F.col("p_size") / 100.0).alias("w"), F.lit(0.1).alias("h"))
    d = S.detections(p, ["a", "b", "c"], F.lit(640), 0.5)
    return d.select("image_id", "ord", "rank", "class", rounded(F.col("score")).alias("score"), rounded(F.col("x1")).alias("x1"))


@query(f"""WITH {P.ELEMENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS id FROM el WHERE kind = 'dom'), v AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY conf DESC, ord) AS k FROM el WHERE report_id NOT IN (SELECT report_id FROM n))
SELECT report_id, id, x1, 1.0 AS conf, 'a11y' AS sources, 'a11y' AS channel, NULL AS caption FROM n WHERE id < 2
UNION ALL SELECT report_id, ord, x1, conf, kind, 'vision', substr('element ' || seed || ' of a caption that is longer than forty', 1, 40) FROM v WHERE k <= 3""")
def analyze_protocol(spark, sf):
    e = P.elements(spark, sf).withColumns({"type": F.lit("button"), "text": F.concat(F.lit("p"), F.col("seed").cast("string"))})
    v = e.withColumns({"id": F.col("ord").cast("long"), "sources": F.array("kind"), "caption": F.concat(F.lit("element "), F.col("seed"), F.lit(" of a caption that is longer than forty")), "center": F.array("x1", "y1")})
    d = tasks.analyze(e.where("kind = 'dom'"), v.where("kind <> 'dom'"), 3, 2)
    return d.select("report_id", "id", "x1", "conf", F.array_join("sources", ",").alias("sources"), "channel", "caption")


@query(f"WITH {P.ELEMENTS_SQL}, g AS (SELECT report_id, ord, x2, lead(x1) OVER (PARTITION BY report_id ORDER BY x1, ord) - x2 AS gap FROM el) SELECT report_id, ord, gap FROM g WHERE gap > 0")
def neighbour_gaps(spark, sf):
    return U.gaps(P.elements(spark, sf), ["report_id"]).select("report_id", "ord", "gap")


@query("""WITH c AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER lo AS n0, sum(n * g) OVER lo AS s0, sum(n) OVER al AS nt, sum(n * g) OVER al AS st FROM c
  WINDOW lo AS (PARTITION BY l_returnflag ORDER BY g ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY l_returnflag)),
b AS (SELECT l_returnflag, g, CASE WHEN nt > n0 THEN CAST(n0 AS DOUBLE) * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2) ELSE 0.0 END AS v FROM r),
t AS (SELECT l_returnflag, arg_max(g, v) AS threshold FROM b GROUP BY l_returnflag)
SELECT l_returnflag, round(sum(CASE WHEN g < threshold THEN n ELSE 0 END) / sum(n), 6) AS foreground FROM c JOIN t USING (l_returnflag) GROUP BY l_returnflag""")
def foreground_share(spark, sf):
    """Thresholds are one row a flag; the join sends those, not the rows."""
    d = P.read(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("g"))
    return R.foreground(d, ["l_returnflag"], "g", R.otsu(d, ["l_returnflag"], "g")).withColumn("foreground", rounded(F.col("foreground")))


from . import scalar_queries, sensor_queries  # noqa: E402, F401  they register too
