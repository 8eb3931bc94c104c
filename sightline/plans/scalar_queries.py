"""Queries over the scalar functions and the small table operators, each with its SQL."""

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
from ..operators import sensors as N
from ..operators import shapes as S
from ..sources import files, reports
from ..streaming import events as V
from . import proxies as P
from . import tasks
from .registry import query, rounded


def _even(c: str) -> str:
    return f"round_even({c}, 0)"


def _iou(a: tuple, b: tuple) -> str:
    """SQL of the rounded intersection over the unrounded areas of two boxes."""
    lo = [f"greatest({a[i]}, {b[i]})" for i in (0, 1)]
    hi = [f"least({a[i]}, {b[i]})" for i in (2, 3)]
    both = f"CASE WHEN {hi[0]} > {lo[0]} AND {hi[1]} > {lo[1]} THEN ({_even(hi[0])} - {_even(lo[0])}) * ({_even(hi[1])} - {_even(lo[1])}) ELSE 0 END"
    size = lambda z: f"({z[2]} - {z[0]}) * ({z[3]} - {z[1]})"
    return f"({both}) / ({size(a)} + {size(b)} - ({both}))"


_A, _B = ("x1", "y1", "x2", "y2"), ("(x1 + 10.5)", "(y1 + 7.25)", "(x2 + 30.5)", "(y2 + 2.5)")


@query(f"""WITH {P.ELEMENTS_SQL}, i AS (SELECT *, {_iou(_A, _B)} AS iou FROM el)
SELECT report_id, ord, round(iou, 6) AS iou, iou >= 0.5 OR ((x1 + x2) / 2 >= x1 + 10.5 AND (x1 + x2) / 2 <= x2 + 30.5 AND (y1 + y2) / 2 >= y1 + 7.25 AND (y1 + y2) / 2 <= y2 + 2.5) AS aligned,
  (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1 <= 400 AND x2 >= 400 AND y1 <= 300 AND y2 >= 300 AS holds,
  x1 + 3 AS ox, y2 - 4 AS oy, x2 / 2 + 5 AS zx, y1 / 2 + 7 AS zy, CASE WHEN y1 > 0 THEN x2 / y1 ELSE 1.0 END AS scale,
  CASE WHEN x1 < 404 THEN -floor((404 - x1) / 8 + 0.5) ELSE floor((x1 - 404) / 8 + 0.5) END AS away, (x1 + (x2 - x1) / 2) * 2 AS corner, (x1 + x2 - x1) AS far,
  least(x1, 400) AS rx1, greatest(x1, 400) AS rx2, round(2 * atan(36 / (2 * (x2 - x1))), 6) AS fov FROM i""")
def box_geometry(spark, sf):
    e, b = P.elements(spark, sf), B.box()
    c = (b[0] + 10.5, b[1] + 7.25, b[2] + 30.5, b[3] + 2.5)
    (cx, cy), moved, back = B.center(b), B.offset(b, 3, -4), B.zoom_back(b, 5, 7)
    w, h = b[2] - b[0], b[3] - b[1]
    region = B.region(F.concat_ws(",", F.lit("400"), b[1].cast("long"), b[0].cast("long"), b[3].cast("long")))
    return e.select(
        "report_id", "ord", rounded(B.iou(b, c)).alias("iou"), B.aligned(b, c).alias("aligned"), cx.alias("cx"), cy.alias("cy"), B.contains(b, F.lit(400), F.lit(300)).alias("holds"),
        moved[0].alias("ox"), moved[3].alias("oy"), back[2].alias("zx"), back[1].alias("zy"), B.logical_scale(b[2], b[1]).alias("scale"), B.half_away((b[0] - 404) / 8).alias("away"),
        B.cxcywh(b[0], b[1], w, h, 2)[2].alias("corner"), F.get(B.from_pos_size(F.array(b[0], b[1]), F.array(w, h)), F.lit(2)).alias("far"),
        F.get(region, F.lit(0)).alias("rx1"), F.get(region, F.lit(2)).alias("rx2"), rounded(B.fov(F.lit(36.0), w)).alias("fov"),
    )


@query(f"""WITH {P.ELEMENTS_SQL} SELECT report_id, ord, array_to_string(list_filter(range(0, CAST(x2 AS BIGINT)), lambda g: g % greatest(CAST(ceil(x2 / 64) AS BIGINT), 1) = 0), ',') AS picked,
  CAST(greatest(ord - 2, 0) + greatest(CAST(x2 AS BIGINT) % 9 - 2, 0) AS BIGINT) AS tris FROM el WHERE ord < 4""")
def strides_and_fans(spark, sf):
    """Items at an even stride, at most 64, and the triangles of two polygons."""
    n = F.col("x2").cast("long")
    e = P.elements(spark, sf).where("ord < 4").withColumn("items", F.sequence(F.lit(0).cast("long"), n - 1))
    return e.select("report_id", "ord", F.array_join(B.every(F.col("items"), 64).cast("array<string>"), ",").alias("picked"), B.triangles(F.array(F.col("ord").cast("long"), n % 9)).alias("tris"))


_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_F = "CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / 3) ELSE 7.787 * ({t}) + 16.0 / 116 END"


def _lab_sql(r: str, g: str, b: str, p: str) -> str:
    x, y, z = (" + ".join(f"{k} * {p}{c}" for k, c in zip(ks, "rgb", strict=True)) for ks in ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505)))
    fx, fy, fz = (_F.format(t=f"(({t}) / {n})") for t, n in ((x, 0.95047), (y, 1.0), (z, 1.08883)))
    return f"116 * ({fy}) - 16 AS {p}l, 500 * (({fx}) - ({fy})) AS {p}a, 200 * (({fy}) - ({fz})) AS {p}b2"


@query(f"""WITH c AS (SELECT p_partkey, p_size, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b, (p_partkey * 73 + p_size) % 256 AS r2, (p_partkey * 151 + 9) % 256 AS g2, (p_partkey * 211 + p_size * 3) % 256 AS b2 FROM part),
n AS (SELECT *, {", ".join(f"{_LIN.format(c=c)} AS p{c}" for c in "rgb")}, {", ".join(f"{_LIN.format(c=c + '2')} AS q{c}" for c in "rgb")} FROM c),
l AS (SELECT p_partkey, p_size, r, g, b, {_lab_sql("r", "g", "b", "p")}, {_lab_sql("r", "g", "b", "q")} FROM n)
SELECT p_partkey, round(pl, 4) AS l, round(pa, 4) AS a, round(pb2, 4) AS b, round(sqrt(pow(pl - ql, 2) + pow(pa - qa, 2) + pow(pb2 - qb2, 2)), 4) AS delta_e,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE printf('#%02X%02X%02X', r, g, b) END AS hex, CASE WHEN p_size < 25 THEN 'gray' WHEN p_size < 60 THEN 'muted' ELSE 'vivid' END AS tier,
  CASE WHEN g < 25 THEN 'neutral' WHEN r < 70 THEN 'warm' ELSE 'cool' END AS warmth, CASE WHEN (p_size / (b + 1)) > 1.2 THEN 'landscape' WHEN (p_size / (b + 1)) < 0.83 THEN 'portrait' ELSE 'square' END AS aspect FROM l""")
def color_measures(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    r, g, b = (c.cast("double") for c in P.colors(k))
    one, two = C.lab(r, g, b), C.lab(*(c.cast("double") for c in ((k * 73 + s) % 256, (k * 151 + 9) % 256, (k * 211 + s * 3) % 256)))
    css = F.when(s % 7 == 0, F.format_string("rgba(%d, %d,%d, 0.0)", *P.colors(k))).when(s % 2 == 0, F.format_string("rgb(%d, %d, %d)", *P.colors(k))).otherwise(F.format_string("rgba(%d,%d, %d, .5)", *P.colors(k)))
    d = P.read(spark, sf, "part")
    return d.select("p_partkey", *[rounded(c, 4).alias(n) for c, n in zip(one, "lab", strict=True)], rounded(C.delta_e(one, two), 4).alias("delta_e"), C.css_to_hex(css).alias("hex"), C.saturation_tier(s).alias("tier"), C.warmth(r, g).alias("warmth"), C.aspect(s, b + 1).alias("aspect"))


@query("""SELECT p_partkey, 'click ' || p_size || ' 7' AS first, p_type ILIKE '%steel%' AS steel, regexp_full_match(p_name, '[A-Za-z0-9_-]{1,64}') AS safe,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS number, substr(p_name, 1, 5) AS short, substr(coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), p_type), 1, 60) AS label,
  CAST(p_size AS DOUBLE) + 0.5 AS dx, 'fill' AS attr, '#' || p_size AS value FROM part""")
def text_measures(spark, sf):
    p, s = P.read(spark, sf, "part"), F.col("p_size")
    steps = X.chain(F.concat(F.lit(" click "), s, F.lit("  7 ; ;type hi")))
    tag = F.format_string('<rect fill="#%d" transform="translate(%d.5, -3)"/>', s, s)
    dx, _ = X.translation(F.element_at(X.attributes(tag), "transform"))
    label = U.label(F.when(s % 3 == 0, "").otherwise(F.col("p_name")), F.lit(None).cast("string"), F.col("p_type"), s)
    return p.select("p_partkey", F.array_join(steps[0], " ").alias("first"), X.title_matches(F.col("p_type"), F.lit("STEEL")).alias("steel"), X.safe_name(F.col("p_name")).alias("safe"), X.python_number(s / 2, s % 2 == 0).alias("number"), X.cut(F.col("p_name"), 5).alias("short"), label.alias("label"), dx.alias("dx"), F.lit("fill").alias("attr"), F.element_at(X.attributes(tag), "fill").alias("value"))


@query(f"""WITH {P.ELEMENTS_SQL} SELECT report_id, ord, kind = 'dom' OR ord % 5 = 0 OR ord % 4 = 1 AS designed, CASE WHEN ord % 3 = 0 THEN 'name' || ord WHEN ord % 3 = 1 THEN 'text' ELSE 'el' || ord END AS label,
  CASE WHEN ord % 2 = 0 THEN CAST(x2 AS BIGINT) ELSE 720 END AS w, CASE WHEN ord % 2 = 0 THEN CAST(y2 AS BIGINT) ELSE 405 END AS h FROM el""")
def labels_and_canvases(spark, sf):
    o = F.col("ord")
    font, z = F.when(o % 5 == 0, "Arial"), F.when(o % 4 == 1, o)
    label = U.label(F.when(o % 3 == 0, F.concat(F.lit("name"), o)), F.when(o % 3 == 1, "text").otherwise(""), F.lit(None).cast("string"), o)
    size = U.canvas(None, F.when(o % 2 == 0, F.array(F.col("x2") + 0.5, F.col("y2"))), F.array(F.lit(720.9), F.lit(405.0)))
    return P.elements(spark, sf).select("report_id", "ord", U.designed(F.array("kind"), font, z).alias("designed"), label.alias("label"), size[0].alias("w"), size[1].alias("h"))


@query(f"""WITH {P.ELEMENTS_SQL}, g AS (SELECT report_id, ord, CASE ord % 7 WHEN 0 THEN conf * 0.8 WHEN 1 THEN exp(-(x1 / 100) / 5) WHEN 2 THEN conf WHEN 3 THEN least(1, greatest(0, least(1, (x1 - 100) / 500)) * 2) WHEN 4 THEN greatest(0, least(1, (x1 - 100) / 500)) WHEN 5 THEN 1 - least(abs(x1 - 400) / 1000 / 0.1, 1) ELSE greatest(0, least(1, (x1 - 100) / 500)) END AS c, ord % 7 IN (1, 5) AS two FROM el)
SELECT report_id, ord, round(c, 6) AS c, round(CASE WHEN two THEN 1 - c ELSE 0 END, 6) AS f, round(CASE WHEN two THEN 0 ELSE 1 - c END, 6) AS u FROM g""")
def evidence_masses(spark, sf):
    """One mass of every kind, shares that leave 0 to 1 too."""
    o, share = F.col("ord") % 7, (F.col("x1") - 100) / 500
    of = {"ocr": F.col("conf"), "color": F.col("x1") / 100, "detect": F.col("conf"), "segment": share, "saliency": share, "depth": (F.col("x1") - 400) / 1000, "rule": share}
    m = None
    for i, (k, v) in enumerate(of.items()):
        m = F.when(o == i, E.FACTORIES[k](v)) if m is None else m.when(o == i, E.FACTORIES[k](v))
    return P.elements(spark, sf).withColumn("m", m).select("report_id", "ord", *[rounded(F.col(f"m.{c}")).alias(c) for c in "cfu"])


@query(f"""WITH {P.ELEMENTS_SQL}, r AS (SELECT report_id, ord, conf, count(*) OVER (PARTITION BY report_id) AS n FROM el)
SELECT report_id, arg_min(conf - 0.3, ord) >= 0.5 AS confirmed, arg_min(conf - 0.3, ord) AS new_conf, max(n) AS local_elements FROM r GROUP BY report_id""")
def probe_confirmed(spark, sf):
    return N.confirmed(P.elements(spark, sf).select("report_id", F.col("ord").alias("id"), (F.col("conf") - 0.3).alias("conf")))


@query(f"""WITH {P.ELEMENTS_SQL} SELECT report_id, ord, x1, (x1 + x2) / 2 AS cx, 1.0 AS conf, 'a11y' AS sources FROM el WHERE x2 > x1 + 60 AND (ord % 2 = 0 OR kind = 'dom')""")
def interactive_nodes(spark, sf):
    """Accessible nodes that show (those narrower than 60 are made not to) and have a text or a role that is used."""
    e = P.elements(spark, sf)
    n = e.withColumns({"x2": F.when(F.col("x2") > F.col("x1") + 60, F.col("x2")).otherwise(F.col("x1")), "text": F.when(F.col("ord") % 2 == 0, "t").otherwise(""), "type": F.when(F.col("kind") == "dom", "button").otherwise("panel")})
    d = files.interactive(n)
    return d.select("report_id", "ord", "x1", F.col("center")[0].alias("cx"), "conf", F.array_join("sources", ",").alias("sources"))


@query("""SELECT r_name AS app, 'r' || r_regionkey AS node_id, 0 AS depth, CAST(r_regionkey AS VARCHAR) AS path FROM region
UNION ALL SELECT r_name, 'n' || n_nationkey, 1, r_regionkey || '/' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 's' || s_suppkey, 2, r_regionkey || '/' || n_nationkey || '/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def node_tree(spark, sf):
    r, n, s = (P.read(spark, sf, t) for t in ("region", "nation", "supplier"))
    of = r.select("r_name", F.col("r_regionkey").alias("n_regionkey"))
    nodes = r.select(F.col("r_name").alias("app"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"))
    n = n.join(of, "n_regionkey")
    nodes = nodes.unionByName(n.select(F.col("r_name").alias("app"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord")))
    s = s.join(n.select("r_name", F.col("n_nationkey").alias("s_nationkey")), "s_nationkey")
    nodes = nodes.unionByName(s.select(F.col("r_name").alias("app"), F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_suppkey").cast("long").alias("ord")))
    return files.tree(nodes, 3).select("app", "node_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"""WITH {P.ELEMENTS_SQL}, v AS (SELECT report_id, ord, (x2 - x1) * (y2 - y1) AS area FROM el WHERE x1 < 700 AND y1 < 500), r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY area DESC, ord) AS rank, count(*) OVER (PARTITION BY report_id) >= 3 AS truncated FROM v)
SELECT report_id, ord, area, rank, truncated FROM r WHERE rank <= 3""")
def visible_nodes(spark, sf):
    e = P.elements(spark, sf).select(F.col("report_id").alias("page_id"), "ord", F.lit("x").alias("text"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.lit(700).alias("view_w"), F.lit(500).alias("view_h"))
    return files.dom(e, 3).select(F.col("page_id").alias("report_id"), "ord", "area", "rank", "truncated")


@query(f"""WITH {P.ELEMENTS_SQL}, s AS (SELECT report_id, ord, 1 / (1 + exp(-(conf * 4 - 3.6))) AS score, ((x1 % 20 + 0.5) * 8 - y1 / 100 * 8 - 3) / 0.5 AS ax1, ((x1 % 20 + 0.5) * 8 + x2 / 100 * 8 - 3) / 0.5 AS ax2 FROM el)
SELECT report_id, ord, round(score, 6) AS score, round(ax1, 6) AS x1, round(ax2, 6) AS x2 FROM s WHERE score > 0.4""")
def anchor_boxes(spark, sf):
    e = P.elements(spark, sf)
    raw = e.select(F.col("report_id").alias("image_id"), "ord", F.lit(8).alias("stride"), (F.col("x1") % 20).alias("gx"), F.lit(1).alias("gy"), (F.col("y1") / 100).alias("left"), F.lit(1.0).alias("top"), (F.col("x2") / 100).alias("right"), F.lit(1.0).alias("bottom"), (F.col("conf") * 4 - 3.6).alias("logit"), F.lit(0.5).alias("scale"), F.lit(3).alias("pad_x"), F.lit(0).alias("pad_y"))
    d = S.anchors(raw, 0.4)
    return d.select(F.col("image_id").alias("report_id"), "ord", *[rounded(F.col(c)).alias(c) for c in ("score", "x1", "x2")])


@query(f"""WITH {P.ELEMENTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY report_id) >= 2 AS truncated FROM el WHERE conf >= 0.8)
SELECT report_id, ord, x1 - 3 AS x1, x2, (x1 - 3 + x2) / 2 AS cx, truncated FROM k WHERE k <= 2""")
def text_lines(spark, sf):
    """Recognised quads, a little turned, as boxes; two a picture."""
    p = lambda x, y: F.array(x, y)
    x1, y1, x2, y2 = B.box()
    quad = F.array(p(x1 - 3, y1), p(x2, y1 + 1), p(x2 - 2, y2), p(x1, y2 - 1))
    raw = P.elements(spark, sf).select(F.col("report_id").alias("image_id"), "ord", quad.alias("quad"), F.lit("t").alias("text"), F.col("conf").alias("score"))
    d = S.ocr_lines(raw, 0.8, 2)
    return d.select(F.col("image_id").alias("report_id"), "ord", "x1", "x2", F.col("center")[0].alias("cx"), "truncated")


@query("""WITH s AS (SELECT p_partkey AS doc_id, 0 AS ord, 'rect' AS kind, p_size + 10 AS x1, p_size + 20 AS y1, p_size * 3 + 10 AS x2, p_size + 27 AS y2 FROM part
UNION ALL SELECT p_partkey, 1, 'circle', p_size - 4, 5 - 4, p_size + 4, 5 + 4 FROM part
UNION ALL SELECT p_partkey, 2, 'polygon', 1, 2, p_size + 2, p_size + 3 FROM part)
SELECT doc_id, ord, kind, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM s""")
def svg_boxes(spark, sf):
    return _svgs(spark, sf).select("doc_id", "ord", "kind", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def _svgs(spark, sf):
    s = F.col("p_size")
    text = F.format_string('<svg><rect x="%d" y="%d" width="%d" height="7" transform="translate(10, 20)"/><g/><circle cx="%d" cy="5" r="4"/><polygon points="1,2 %d,4 3,%d"/></svg>', s, s, s * 2, s, s + 2, s + 3)
    return S.svg_shapes(P.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("svg")))


@query("SELECT p_brand, kind, count(*) AS n FROM part, unnest(['rect', 'circle', 'polygon']) AS t(kind) GROUP BY 1, 2")
def shape_kinds(spark, sf):
    d = _svgs(spark, sf).join(P.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand"), "doc_id")
    return N.shape_histogram(d, ["p_brand"])


@query("""WITH m AS (SELECT p_partkey, p_size, p_partkey % 7 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c, CAST(unnest(range(8)) AS INTEGER) AS k FROM part),
p AS (SELECT *, CASE WHEN k % 2 = 1 THEN p_size ELSE -1 END AS x, CASE WHEN (k // 2) % 2 = 1 THEN 10 + a ELSE 4 END AS y, CASE WHEN k // 4 = 1 THEN 9 ELSE b END AS z FROM m)
SELECT p_partkey, k, CAST(2 * x + a AS DOUBLE) AS wx, CAST(y - z + b AS DOUBLE) AS wy, CAST(c * x + z AS DOUBLE) AS wz FROM p""")
def world_corners(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b, c = k % 7, k % 5, k % 3
    row = lambda *vs: F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("double") for v in vs])
    box = S.world_box(F.array(row(s, 4, 9), row(0, 10 + a, b), row(-1, 5, 9)), row(2, 0, 0, a, 0, 1, -1, b, c, 0, 1, 0, 0, 0, 0, 1))
    d = P.read(spark, sf, "part").select("p_partkey", F.posexplode(box).alias("k", "p"))
    return d.select("p_partkey", "k", *[F.col("p")[i].alias(n) for i, n in enumerate(("wx", "wy", "wz"))])


@query("""WITH v AS (SELECT vec_id, vec_id % 7 AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS m FROM v),
p AS (SELECT a.cluster, avg(list_dot_product(a.e, b.e) / (a.m * b.m)) AS mean_sim FROM n a JOIN n b ON a.cluster = b.cluster AND a.vec_id <> b.vec_id GROUP BY a.cluster)
SELECT n.cluster, count(*) AS size, min(vec_id) AS representative, round(coalesce(any_value(mean_sim), 1.0), 5) AS mean_sim, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id % 10 DESC, vec_id) AS members FROM n LEFT JOIN p USING (cluster) GROUP BY n.cluster""")
def cluster_summaries(spark, sf):
    """Seven sets by number; the similarity to a representative that members are ordered by is made of their last digit."""
    v = P.read(spark, sf, "embeddings").select(F.lit(0).alias("s"), F.col("vec_id").alias("ord"), "embedding")
    c = v.select("s", "ord", (F.col("ord") % 7).alias("cluster"), (F.col("ord") % 10 / 10).alias("sim_to_rep"))
    d = M.cluster_summary(c, ["s"], v)
    return d.select("cluster", "size", "representative", rounded(F.col("mean_sim"), 5).alias("mean_sim"), F.array_join(F.transform("members", lambda m: m["ord"].cast("string")), ",").alias("members"))


@query("""WITH c AS (SELECT label, vec_id % 3 AS cluster, count(*) AS size FROM embeddings GROUP BY 1, 2) SELECT label, count(*) AS n_clusters, count(*) FILTER (WHERE size = 1) AS n_single, max(size) AS largest FROM c GROUP BY label""")
def cluster_counts(spark, sf):
    v = P.read(spark, sf, "embeddings").select("label", F.col("vec_id").alias("ord"), (F.col("vec_id") % 3).alias("cluster"), F.lit(1.0).alias("sim_to_rep"))
    return M.cluster_metrics(M.cluster_summary(v, ["label"]), ["label"])


@query(f"""WITH {P.ELEMENTS_SQL}, g AS (SELECT report_id, ord // 2 AS grp, 'a' AS side, ord % 3 AS id FROM el), l AS (SELECT report_id, ord % 3 AS id, arg_max(ord, ord) AS ord, arg_max(conf, ord) AS conf FROM el GROUP BY 1, 2)
SELECT g.report_id, grp, g.id, l.ord, l.conf FROM g JOIN l ON g.report_id = l.report_id AND g.id = l.id""")
def elements_by_ids(spark, sf):
    e = P.elements(spark, sf).withColumn("id", F.col("ord") % 3)
    groups = e.groupBy("report_id", F.floor(F.col("ord") / 2).alias("grp")).agg(F.collect_list("id").alias("ids")).withColumn("side", F.lit("a"))
    return J.by_ids(e.select("report_id", "id", "ord", "conf"), groups).select("report_id", "grp", "id", "ord", "conf")


@query(f"""WITH {P.ELEMENTS_SQL}, v AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS id, ord FROM el WHERE kind <> 'dom'), a AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS id, ord FROM el WHERE kind = 'dom'), t AS (SELECT report_id, max(id) + 1 AS off FROM v GROUP BY report_id)
SELECT report_id, ord, id, 'vision' AS source_kind FROM v UNION ALL SELECT a.report_id, a.ord, a.id + coalesce(off, 0), 'a11y' FROM a LEFT JOIN t ON a.report_id = t.report_id""")
def one_numbering(spark, sf):
    from pyspark.sql import Window as W

    e = P.elements(spark, sf).select("report_id", "ord", "kind")
    of = lambda cond: e.where(cond).withColumn("id", F.row_number().over(W.partitionBy("report_id").orderBy("ord")) - 1).drop("kind")
    return reports.with_offset_ids(of("kind <> 'dom'"), of("kind = 'dom'")).select("report_id", "ord", "id", "source_kind")


@query("""WITH s AS (SELECT o_custkey AS task_id, o_orderkey AS step, o_orderpriority AS sensor, o_orderstatus = 'P' AS failed, o_totalprice > 200000 AS truncated FROM orders),
f AS (SELECT * FROM s WHERE NOT failed), u AS (SELECT task_id, sensor, min(step) AS first FROM f GROUP BY 1, 2), n AS (SELECT task_id, string_agg(sensor, ',' ORDER BY first) AS sensors FROM u GROUP BY 1)
SELECT f.task_id, any_value(n.sensors) AS sensors, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS elements, bool_or(truncated) AS truncated FROM f JOIN n ON n.task_id = f.task_id GROUP BY f.task_id""")
def merged_reports(spark, sf):
    o = P.read(spark, sf, "orders")
    steps = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("step"), (F.col("o_orderstatus") == "P").alias("failed"), F.array("o_orderpriority").alias("sensors"), F.array(F.col("o_orderkey").cast("string")).alias("elements"), F.lit(None).cast("array<string>").alias("anomalies"), (F.col("o_totalprice") > 200000).alias("truncated"))
    d = reports.merge_reports(steps)
    return d.select("task_id", F.array_join("sensors", ",").alias("sensors"), F.array_join("elements", ",").alias("elements"), "truncated")


@query("""WITH s AS (SELECT o_orderkey AS report_id, o_orderpriority AS sensor FROM orders), f AS (SELECT sensor, min(report_id) AS first FROM s GROUP BY 1) SELECT sensor, row_number() OVER (ORDER BY first) AS k FROM f""")
def sensors_seen(spark, sf):
    from pyspark.sql import Window as W

    o = P.read(spark, sf, "orders").select(F.format_string("%012d", "o_orderkey").alias("report_id"), F.array("o_orderpriority").alias("sensors"))
    seen = reports.sensors(o).withColumn("at", F.monotonically_increasing_id())
    return seen.select("sensor", F.row_number().over(W.orderBy("at")).alias("k"))


@query("""WITH a AS (SELECT p_brand, (p_partkey * 73) % 256 AS r, (p_partkey * 211) % 256 AS b, (p_partkey * 73 + p_size) % 256 AS r2, (p_partkey * 211 + p_size % 2) % 256 AS b2 FROM part)
SELECT p_brand, round(avg(CASE WHEN r <> r2 OR b <> b2 THEN 1.0 ELSE 0 END), 6) AS pixels, round(sum(CAST(r <> r2 AS INT) + CAST(b <> b2 AS INT)) / (3.0 * count(*)), 6) AS bytes, avg(CASE WHEN r <> r2 OR b <> b2 THEN 1.0 ELSE 0 END) > 0.99 AS passed FROM a GROUP BY p_brand""")
def change_shares(spark, sf):
    p, k, s = P.read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    r, g, b = P.colors(k)
    of = lambda r, b: p.select("p_brand", k.alias("x"), F.lit(0).alias("y"), r.alias("r"), g.alias("g"), b.alias("b"))
    d = J.pixel_diff(of(r, b), of((k * 73 + s) % 256, (k * 211 + s % 2) % 256), ["p_brand"])
    one, two = J.change_ratio(d, ["p_brand"], 0.99), J.change_ratio(d, ["p_brand"], by="bytes")
    return one.select("p_brand", rounded(F.col("ratio")).alias("pixels"), "passed").join(two.select("p_brand", rounded(F.col("ratio")).alias("bytes")), "p_brand")


@query("""SELECT o_orderkey AS task_id, (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) AND (o_orderkey % 2 = 0 OR lower(o_orderpriority) LIKE '%high%') AND o_custkey % 4 <> 0 AS verified FROM orders""")
def tasks_verified(spark, sf):
    k = F.col("o_orderkey")
    checks = P.read(spark, sf, "orders").select(k.alias("task_id"), F.when(k % 3 != 0, k % 5 != 0).alias("screen_ok"), F.col("o_orderpriority").alias("title"), F.when(k % 2 != 0, "HIGH").alias("expected"), (F.col("o_custkey") % 4 != 0).alias("viewport_ok"))
    return tasks.verified(checks).select("task_id", "verified")


@query("""WITH c AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id % 3 = 0) SELECT event_id, CASE WHEN c.k IS NULL THEN user_id * 10 ELSE -user_id END AS value FROM events LEFT JOIN c ON c.k = user_id""")
def cached_perception(spark, sf):
    """Users whose number divides by 3 are in the cache; the others are computed."""
    e = P.read(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))
    cache = e.where("k % 3 = 0").select("k", (-F.col("k")).alias("value")).distinct()
    return V.cached(e, cache, "k", lambda d: d.withColumn("value", F.col("k") * 10))[0].select("event_id", "value")


@query("""WITH c AS (SELECT user_id AS k, min(event_id) AS value FROM events GROUP BY 1), n AS (SELECT user_id AS k, CASE WHEN max(event_id) % 2 = 0 THEN max(event_id) END AS value FROM events WHERE user_id % 5 < 3 GROUP BY 1) SELECT c.k, coalesce(n.value, c.value) AS value FROM c LEFT JOIN n USING (k)""")
def cache_refreshed(spark, sf):
    e = P.read(spark, sf, "events")
    cache = e.groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("value"))
    last = F.max("event_id")
    news = e.where("user_id % 5 < 3").groupBy(F.col("user_id").alias("k")).agg(F.when(last % 2 == 0, last).alias("value"))
    return V.refresh(cache, news, "k")[0]


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events")
def events_so_far(spark, sf):
    return V.running_latest(P.read(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH p AS (SELECT p_brand, p_partkey AS x, (p_partkey * 73) % 256 AS r, (p_partkey * 151) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part)
SELECT p_brand, CAST(round_even(avg(greatest(r, g, b)), 0) AS BIGINT) AS brightness, CAST(round_even(avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255 // greatest(r, g, b) ELSE 0 END), 0) AS BIGINT) AS saturation FROM p GROUP BY p_brand""")
def brightness_saturation(spark, sf):
    r, g, b = P.colors(F.col("p_partkey"))
    return R.brightness_saturation(P.read(spark, sf, "part").select("p_brand", r.alias("r"), g.alias("g"), b.alias("b")), "p_brand")
