"""Operators of the engine against hand-computed values and DuckDB."""

import json
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import boxes as B
from sightline.functions import color as C
from sightline.functions import evidence as E
from sightline.functions import text as X
from sightline.operators import joins as J
from sightline.operators import matching as M
from sightline.operators import raster as R
from sightline.operators import rules as U
from sightline.operators import sensors as N
from sightline.operators import shapes as S
from sightline.plans import catalog, proxies, tasks
from sightline.sources import files, reports
from sightline.streaming import events as V

SF = "/root/testdata/sf0.001"
TABLES = "customer events embeddings lineitem nation orders part region supplier documents pages benchmark labels conversations".split()


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_boxes(spark):
    a, b = lits(100, 80, 400, 260), lits(300, 200, 620, 380)
    r = one(spark, B.iou(a, b), B.intersection_area(a, b), B.notation(a), B.region(F.lit("5,6,1,2")), B.region(F.lit("1,2")), B.css_to_device(F.lit(2.5), F.lit(0), F.lit(1)))
    assert math.isclose(r.c0, 6000 / (54000 + 57600 - 6000)) and r.c1 == 6000 and r.c2 == "[bbox: 100, 80, 400, 260]" and r.c3 == [1.0, 2.0, 5.0, 6.0] and r.c4 is None and r.c5 == 2.0
    r = one(spark, B.aabb_distance(list(lits(0, 0, 0, 1, 1, 1)), list(lits(2, 0, 0, 3, 1, 1))), B.half_away(F.lit(-2.5)), B.logical_scale(F.lit(2.0), F.lit(0.0)), F.size(B.every(F.sequence(F.lit(1), F.lit(9000)))))
    assert (r.c0, r.c1, r.c2) == (1.0, -3.0, 1.0) and r.c3 <= 4000


def test_colors(spark):
    w, k = C.luminance(*lits(255, 255, 255)), C.luminance(*lits(0, 0, 0))
    r = one(spark, C.contrast(w, k), *C.rgb_of_hex(F.lit("##0A0b0C")), C.rgb_of_hex(F.lit("#12"))[0], C.css_to_hex(F.lit("rgb(1, 2, 255)")), C.css_to_hex(F.lit("rgba(1,2,3,0)")), C.ramp_char(F.lit(255.0)), C.letter(*lits(250, 20, 20)), C.family(F.lit(20.0), F.lit(99)))
    assert math.isclose(r.c0, 21.0) and (r.c1, r.c2, r.c3) == (10, 11, 12) and r.c4 is None and r.c5 == "#0102FF" and r.c6 is None and r.c7 == "@" and r.c8 == "R" and r.c9 == "orange"


def test_text(spark):
    sim = lambda a, b: X.similarity(F.lit(a), F.lit(b))
    r = one(spark, sim("提父", "提交"), sim(" OK", "ok "), sim("ok", "book"), sim("", "a"), X.chain(F.lit("click 1 2; ;type hi")), X.exact_round(F.lit(2.675), F.lit(2)))
    assert (r.c0, r.c1, r.c2, r.c3) == (0.5, 1.0, 0.7, 0.0) and r.c4 == [["click", "1", "2"], ["type", "hi"]] and r.c5 == 2.67
    d = spark.createDataFrame([("提父", 1.0), ("submti", 1.0), ("ok", 1.0)], "t string, c double")
    got = [(x.corrected, round(x.corrected_conf, 3)) for x in X.corrected(d, "t", "c", ["提交", "submit", "ok"]).collect()]
    assert got == [("提交", 0.9), ("submti", 1.0), ("ok", 0.9)]


def test_evidence(spark):
    r = one(spark, E.combine(E.mass(0.6, 0.1, 0.3), E.mass(0.7, 0.0, 0.3)), E.combine(E.mass(1.0, 0.0, 0.0), E.mass(0.0, 1.0, 0.0)), E.most_conflict(F.array(E.mass(1.0, 0.0, 0.0), E.mass(0.0, 1.0, 0.0))))
    assert [round(v, 4) for v in r.c0] == [0.871, 0.0323, 0.0968] and list(r.c1) == [0.0, 0.0, 1.0] and r.c2 == 1.0


def test_masses_by_kind(spark):
    said = {"ocr": (0.9, (0.72, 0, 0.28)), "detect": (1.4, (1, 0, 0)), "segment": (0.3, (0.6, 0, 0.4)), "saliency": (-1.0, (0, 0, 1)), "rule": (0.7, (0.7, 0, 0.3)), "color": (5.0, (math.exp(-1), 1 - math.exp(-1), 0)), "depth": (0.05, (0.5, 0.5, 0))}
    got = one(spark, *[E.FACTORIES[k](F.lit(v)) for k, (v, _) in said.items()])
    for m, (_, want) in zip(got, said.values(), strict=True):
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(m, want, strict=True))
    assert one(spark, E.FACTORIES["ocr"](F.lit(None).cast("double"))).c0["c"] is None


def test_hsv_in_bytes(spark):
    import colorsys

    rng = np.random.default_rng(1)
    px = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9), (0, 0, 0), *map(tuple, rng.integers(0, 256, (400, 3)).tolist())]
    d = spark.createDataFrame(px, "r int, g int, b int").select("r", "g", "b", F.array(*C.hsv8(F.col("r"), F.col("g"), F.col("b"))).alias("hsv"))
    for x in d.collect():
        h, s, v = colorsys.rgb_to_hsv(x["r"] / 255, x["g"] / 255, x["b"] / 255)
        assert abs(x["hsv"][0] - h * 255) <= 1.001 and abs(x["hsv"][1] - s * 255) <= 1.001 and x["hsv"][2] == round(v * 255)
    assert [x["hsv"][0] for x in d.limit(4).collect()] == [0, 85, 170, 0]


def test_leaders_go_by_document_order():
    assert U.leaders(np.array([10.0, 14.0, 6.0, 2.0, 18.0]), 4) == [[0, 1, 2], [3], [4]]
    assert U.leaders(np.array([2.0, 6.0, 10.0, 14.0, 18.0]), 4) == [[0, 1], [2, 3], [4]]


def test_glyphs_in_the_order_they_come(spark):
    rows = [(0, 0.0, 50.0, "b"), (1, 9.0, 50.0, "c"), (2, 0.0, 52.5, "x"), (3, 5.0, 51.9, " "), (4, 0.0, 30.0, " "), (5, 3.0, 30.0, "\n"), (6, 2.0, 48.1, "y"), (7, -3.0, 50.5, " ")]
    g = spark.createDataFrame([("f", 1, 100.0, o, x, y, 5.0, 8.0, c) for o, x, y, c in rows], "file string, page int, page_h double, ord long, x double, y double, w double, h double, char string")
    got = files.glyph_lines(g).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in got] == [(0, "by c"), (1, "x")] and got[1]["y2"] == 100 - 52.5


def sample(spark, boxes, **extra):
    rows = [(f"r", i, *map(float, b), 800.0, 600.0, ["dom"], extra.get("text")) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "report_id string, ord long, x1 double, y1 double, x2 double, y2 double, canvas_w double, canvas_h double, source array<string>, text string")


@pytest.mark.parametrize(
    "boxes, text, expected",
    [
        ([(100, 80, 400, 260), (300, 200, 620, 380)], None, {("overlap", "warn")}),
        ([(100, 80, 300, 130), (100, 160, 300, 210), (100, 240, 300, 290), (107, 320, 307, 370)], None, {("alignment_drift", "info")}),
        ([(40, 80, 180, 200), (220, 80, 360, 200), (400, 80, 540, 200), (660, 80, 780, 200)], None, {("spacing_anomaly", "info")}),
        ([(-40, 100, 240, 260), (300, 100, 500, 200)], None, {("safe_area", "critical")}),
        ([(100, 0, 400, 8)], "t", {("safe_area", "warn")}),
        ([(60 + 240 * c, 60 + 180 * r, 220 + 240 * c, 160 + 180 * r) for r in range(3) for c in range(3)], None, set()),
        ([(340, 40 + 70 * i, 460, 80 + 70 * i) for i in range(6)], None, set()),
        ([(0, 0, 800, 120)], "t", set()),
    ],
)
def test_rules_on_labelled_samples(spark, boxes, text, expected):
    found = {(r["rule"], r["severity"]) for r in U.run(sample(spark, boxes, text=text)).collect()}
    assert found == expected


def test_contrast_and_score(spark):
    e = sample(spark, [(80, 60, 720, 110)]).withColumn("fill", F.lit("#CCCCCC")).withColumn("texts", F.array(F.struct(F.lit("x").alias("text"), F.lit("#777777").alias("color"), F.lit(18.0).alias("size_pt"))))
    f = U.run(e)
    assert [(r["rule"], r["severity"]) for r in f.collect()] == [("text_contrast", "warn")]
    assert U.design_score(e, f).first()["design_score"] == 50.0


def test_thresholds_are_tuned():
    best, score = U.tune(lambda p: 1 - abs(p["tol"] - 4) / 10 - abs(p["k"] - 1.8), {"tol": [2, 3, 4, 5], "k": [1.5, 1.8, 2.0]})
    assert best == {"tol": 4, "k": 1.8} and score == 1.0


def test_envelopes(spark, tmp_path):
    e = spark.createDataFrame([("r", 1, "b"), ("r", 0, "a"), ("s", 0, "c")], "report_id string, ord int, text string")
    f = spark.createDataFrame([("r", "overlap")], "report_id string, rule string")
    m = spark.createDataFrame([("r", 2), ("t", 0)], "report_id string, n int")
    d = reports.envelope("rules", e, f, m)
    reports.write_json(d, str(tmp_path / "out"))
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    one = next(x for x in got if x.get("findings"))
    assert len(got) == 3 and one["schema"] == "vision-report/v3" and [x["text"] for x in one["elements"]] == ["a", "b"] and one["metrics"] == {"n": 2}


def test_boxes_of_arrays(spark):
    r = one(spark, *B.of_array(F.array(*lits(1, 2, 3, 4))), B.area(B.of_array(F.array(*lits(1, 2, 3, 5)))))
    assert tuple(r) == (1.0, 2.0, 3.0, 4.0, 6.0)


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 2), (2, 5), (5, 5)):
        c = rng.random((n, m))
        got = M.assign(c)
        total = sum(c[i, j] for i, j in enumerate(got) if j >= 0)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(r, s, strict=True)) for r in itertools.combinations(range(n), k) for s in itertools.permutations(range(m), k))
        assert math.isclose(total, best) and len({j for j in got if j >= 0}) == k


def test_match_and_fuse(spark):
    row = lambda k, dx: [(1, i, 100.0 * i + dx, 0.0, 100.0 * i + 60 + dx, 40.0, "t", 0.9, None) for i in range(k)]
    kind = "report_id long, ord long, x1 double, y1 double, x2 double, y2 double, text string, conf double, lab array<double>"
    a, b = spark.createDataFrame(row(10, 0), kind), spark.createDataFrame(row(11, 2), kind)
    got = M.match(a, b, ["report_id"]).collect()
    assert sorted((r["a_ord"], r["b_ord"]) for r in got) == [(i, i) for i in range(10)] and min(r["iou"] for r in got) > 0.8
    f = M.in_order(M.fuse(a, b, ["report_id"]), ["report_id"]).collect()
    assert [r["a_ord"] for r in f] == [*range(10), None]
    assert sum(r["type"] == "match" and r["verdict"] == "confirmed" for r in f) == 10 and sum(r["type"] == "only_b" for r in f) == 1


OBSERVED = "report_id long, ord long, source string, x1 double, y1 double, x2 double, y2 double, text string, caption string, class string, conf double, interactive boolean"


def test_entities(spark):
    rows = [(1, 0, "ocr", 100.0, 100.0, 200.0, 150.0, "btn1", None, None, 0.99, False), (1, 1, "omniparser", 90.0, 95.0, 210.0, 155.0, "a button", None, None, None, True), (2, 0, "ocr", 0.0, 0.0, 9.0, 9.0, "x", None, "btn", 0.9, False), (3, 0, "owlv2", 0.0, 0.0, 9.0, 9.0, "icon", None, None, 0.5, None), (4, 0, "omniparser", 1.0, 2.0, 4.0, 9.0, None, "an icon", None, None, False), (4, 1, "ocr", 50.0, 2.0, 54.0, 9.0, "a", None, None, 0.1, False)]
    d = spark.createDataFrame(rows, OBSERVED)
    got = {(r["report_id"], r["id"]): r for r in M.entities(d).collect()}
    assert got[1, 0]["n_observations"] == 2 and got[1, 0]["text"] == "btn1" and got[1, 0]["sources"] == ["ocr", "omniparser"] and got[1, 0]["type"] == "interactive"
    assert got[1, 0]["x1"] == 100.0 and math.isclose(got[1, 0]["conf"], round(1 - (1 - 0.792) * 0.5, 3))
    assert got[2, 0]["conf"] == 0.72 and got[2, 0]["status"] == "confirmed" and got[2, 0]["class"] == "btn" and got[3, 0]["class"] == "icon"
    assert got[2, 0]["assertion"] == "此元素由 ocr 检测，conf 0.72（已确认）" and got[4, 1]["conf"] == 0.5 and got[4, 1]["caption"] == "an icon" and got[4, 1]["status"] == "uncertain"
    assert got[4, 1]["center"] == [3, 6]  # halves go up
    high = M.entities(d, min_conf=0.3).where("report_id = 4").collect()
    assert [(r["id"], r["caption"]) for r in high] == [(0, "an icon")]  # numbered anew


def test_entities_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for report, n in ((1, 5), (2, 1), (3, 120), (4, 30)):
        for i in range(n):
            x, y = rng.integers(0, 300, 2)
            w, h = rng.integers(5, 90, 2)
            rows.append((report, i, ("ocr", "omniparser", "detect")[i % 3], float(x), float(y), float(x + w), float(y + h), f"t{i}" if i % 4 else None, f"c{i}" if i % 5 == 0 else None, f"k{i}" if i % 3 else None, None if i % 7 == 0 else round(float(rng.uniform()), 1), bool(i % 2)))

    def aligned(a, b):
        a, b = a[3:7], b[3:7]
        size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0
        low, high = (a, b) if size(a) <= size(b) else (b, a)
        x, y = (low[0] + low[2]) / 2, (low[1] + low[3]) / 2
        return both / (size(a) + size(b) - both) >= 0.5 or (high[0] <= x <= high[2] and high[1] <= y <= high[3])

    want = []
    for report in (1, 2, 3, 4):
        groups = []
        for r in sorted((r for r in rows if r[0] == report), key=lambda r: (-(r[10] if r[10] is not None else -1), r[1])):
            next((g for g in groups if any(aligned(o, r) for o in g)), groups.append([]) or groups[-1]).append(r)
            groups = [g for g in groups if g]
        for k, g in enumerate(groups):
            rep = [r for r in g if (r[10] or -1) == max(o[10] or -1 for o in g)][-1] if any(r[10] is not None for r in g) else g[-1]
            ocr = [r for r in g if r[2] == "ocr"]
            ocr = [r for r in ocr if (r[10] or 0) == max(o[10] or 0 for o in ocr)]
            first = lambda s, i, g=g: next((r[i] for r in g if r[2] == s), None)
            want.append((report, k, rep[3], (ocr[-1][7] if ocr else None) or rep[7], first("omniparser", 8) or rep[8], first("detect", 9) or rep[9], len(g)))
    got = sorted((r["report_id"], r["id"], r["x1"], r["text"], r["caption"], r["class"], r["n_observations"]) for r in M.entities(spark.createDataFrame(rows, OBSERVED).repartition(3)).collect())
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_suppression_and_clusters(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.8), (1, 2, 50.0, 0.0, 60.0, 9.0, 0.7)], "image long, ord long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["ord"] for r in M.suppress(b, ["image"]).collect()) == [0, 2]
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 2, [0.0, 1.0])], "s long, ord long, embedding array<double>")
    c = M.greedy_clusters(v, ["s"])
    assert [r["cluster"] for r in c.orderBy("ord").collect()] == [0, 0, 1]
    assert tuple(M.cluster_metrics(M.cluster_summary(c, ["s"]), ["s"]).first())[1:] == (2, 1, 2)
    big = M.cluster_summary(c, ["s"], v).orderBy("cluster").collect()
    assert [m["ord"] for m in big[0]["members"]] == [0, 1] and math.isclose(big[0]["mean_sim"], 0.9 / math.hypot(0.9, 0.1)) and big[1]["mean_sim"] == 1.0


def test_suppression_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, i, *map(float, (x, y, x + w, y + h)), round(float(rng.uniform()), 1)) for i, (k, x, y, w, h) in enumerate(rng.integers(1, 40, (200, 5)).tolist())]
    got = {(r["image"], r["ord"]) for r in M.suppress(spark.createDataFrame(rows, "image long, ord long, x1 double, y1 double, x2 double, y2 double, score double"), ["image"], 0.3).collect()}
    want = set()
    for k in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[6], r[1])):
            if all(M.np_iou(np.array([r[2:6]]), np.array([o[2:6]]))[0, 0] <= 0.3 for o in kept):
                kept.append(r)
        want |= {(k, r[1]) for r in kept}
    assert got == want


def test_raster(spark):
    flat = spark.createDataFrame([(1, 128)] * 5 + [(2, 0)] * 50 + [(2, 255)] * 50 + [(3, g) for g in range(256)], "k long, g long")
    assert {r["k"]: r["threshold"] for r in R.otsu(flat, ["k"], "g").collect()} == {1: 128, 2: 0, 3: 127}
    img = np.zeros((64, 64, 3), np.uint8)
    img[:, 32:] = 255
    d = spark.createDataFrame([(1, 64, 64, img.tobytes())], "image_id long, w int, h int, data binary")
    pts = R.edges(d)
    assert pts.count() == 62 and all(abs(r["x"] - 31.5) <= 1 for r in pts.collect())
    assert R.pixels(d).agg(F.sum("r")).first()[0] == 64 * 32 * 255
    lines = R.peaks(R.hough(pts.withColumn("x", F.rint("x")), ["image_id"]), ["image_id"], 30).collect()
    assert lines[0]["votes"] == 62 and lines[0]["theta"] == 0
    assert [p["size"] for p in R.parts(img[..., 0] > 0, 25)] == [64 * 32]
    assert R.palette(np.array([[0, 0, 0], [255, 255, 255]]), np.array([3, 5]), 2) == [((255, 255, 255), 5), ((0, 0, 0), 3)]
    assert len(np.unique(R.superpixels(img, 16))) >= 4
    assert [r["hex"] for r in R.superpixel_colors(d, 2).collect()] == ["#000000", "#FFFFFF"]
    a = np.arange(20, dtype=np.uint8).reshape(4, 5, 1).repeat(3, 2)
    assert R.resize(a, 5, 4, "lanczos").tolist() == a.tolist() and R.resize(a, 10, 8).shape == (8, 10, 3)


def test_shapes(spark):
    sq = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert S.polygon_area(sq) == 16 and S.length(sq) == 16 and S.polygon_iou(sq, sq + 2) == 4 / 28 and S.normal_form(sq)[0] == "rect"
    assert len(S.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2 and len(S.hull(np.vstack([sq, [[2, 2]]]))) == 4
    assert len(S.outline(np.ones((3, 3), bool))) == 8
    cube = np.array([[i & 1, i >> 1 & 1, i >> 2] for i in range(8)], float)
    turn = np.array([[np.cos(0.7), -np.sin(0.7), 0], [np.sin(0.7), np.cos(0.7), 0], [0, 0, 1]])
    others = np.array([cube + [2, 0, 0], cube[[0, 2, 3, 1, 4, 6, 7, 5]], cube @ turn.T + [3, 3, 0], cube * [1, 0, 1] + [0, 4, 0], cube[0] + 0 * cube - 2])
    gaps = S.sat_gaps(S.frames(np.repeat(cube[None], 5, 0)), S.frames(others))
    assert np.allclose(gaps[[0, 1, 3]], [1, 0, 3]) and 2 < gaps[2] < 3 and np.isclose(gaps[4], 2)
    assert S.cloud_distance(cube, cube + [1, 0, 0]) == 0
    rows = [("s", i, "MESH", (cube + [x, 0, 0]).tolist(), (cube + [x, 0, 0]).tolist()) for i, x in enumerate((0, 2, 1))]
    got = S.audit3d(spark.createDataFrame(rows, "scene_id string, ord long, type string, bbox3d array<array<double>>, verts array<array<double>>"))
    assert sorted((r["a_ord"], r["b_ord"], r["rule"], r["severity"], r["method"]) for r in got.collect()) == [(0, 2, "interference", "critical", "mesh-kdtree"), (1, 2, "interference", "critical", "mesh-kdtree")]
    svg = spark.createDataFrame([(1, '<svg><rect x="1" y="2" width="3" height="4" transform="translate(10, 20)"/><circle cx="5" cy="5" r="2"/></svg>')], "doc_id long, svg string")
    assert [(r["kind"], r["bbox"]) for r in S.svg_shapes(svg).orderBy("ord").collect()] == [("rect", [11.0, 22.0, 14.0, 26.0]), ("circle", [3.0, 3.0, 7.0, 7.0])]
    tri = spark.createDataFrame([(1, [0.0, 0.0, 5.0], [4.0, 0.0, 5.0], [0.0, 4.0, 5.0]), (1, [0.0, 0.0, 3.0], [2.0, 0.0, 3.0], [0.0, 2.0, 3.0])], "camera_id long, a array<double>, b array<double>, c array<double>")
    z = {(r["x"], r["y"]): round(r["z"], 6) for r in S.z_buffer(tri, 8, 8).collect()}
    assert z[(0, 0)] == 3.0 and z[(2, 1)] == 5.0


def turned(box, angle, at):
    c, s = np.cos(angle), np.sin(angle)
    return (box @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + at).tolist()


def brute_sat(a, b):
    """Widest gap by projecting the corners on all 15 axes."""
    a, b = np.array(a), np.array(b)
    edges = [c[k] - c[0] for c in (a, b) for k in (1, 2, 4)]
    axes = [*edges, *(np.cross(u, v) for u in edges[:3] for v in edges[3:])]
    gaps = [0.0]
    for x in axes:
        if (n := np.linalg.norm(x)) > 1e-9:
            p, q = a @ x / n, b @ x / n
            gaps.append(max(p.min() - q.max(), q.min() - p.max()))
    return max(gaps)


@pytest.mark.parametrize("method", ["auto", "obb", "mesh", "aabb"])
def test_audit3d_by_brute_force(spark, method):
    rng = np.random.default_rng(6)
    cube = np.array([[i & 1, i >> 1 & 1, i >> 2] for i in range(8)], float)
    rows = []
    for i in range(40):
        box = turned(cube * rng.uniform(0.1, 2, 3), rng.uniform(0, 3), rng.uniform(0, 4, 3))
        cloud = None if i % 9 == 0 else [] if i % 9 == 1 else [*box, *rng.uniform(np.min(box, 0), np.max(box, 0), (int(rng.integers(1, 6)), 3)).tolist()]
        rows.append(("s" if i % 2 else "t", i, ("MESH", "LIGHT", "CURVE")[i % 3], box, cloud))
    gap, want = 0.4, {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] != b[0] or "LIGHT" in (a[2], b[2]):
                continue
            p, q = np.array(a[3]), np.array(b[3])
            lo, hi = np.maximum(p.min(0), q.min(0)), np.minimum(p.max(0), q.max(0))
            aabb = (lo - hi).max()
            if aabb > gap:
                continue
            sat = brute_sat(a[3], b[3]) if method in ("auto", "obb") else 0
            cloud = min((float(np.linalg.norm(np.subtract(x, y))) for x in a[4] or [] for y in b[4] or []), default=None) if method in ("auto", "mesh") else None
            if sat > gap:
                want[a[1], b[1]] = ("clearance", "obb-sat", round(sat * 1000, 4))
            elif cloud is not None:
                want[a[1], b[1]] = ("interference" if cloud <= 1e-6 else "tight_gap" if cloud < gap else "clearance", "mesh-kdtree", round(cloud * 1000, 4) if cloud > 1e-6 else 0.0)
            else:
                want[a[1], b[1]] = ("interference", "aabb-fallback", 0.0)
    d = spark.createDataFrame(rows, "scene_id string, ord long, type string, bbox3d array<array<double>>, verts array<array<double>>")
    got = {(r["a_ord"], r["b_ord"]): (r["rule"], r["method"], r["distance_mm"]) for r in S.audit3d(d, gap * 1000, method).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=2e-3) for k in want)
    n = S.audit3d_metrics(S.audit3d(d, gap * 1000, method)).collect()
    assert sum(r["interference"] + r["tight_gap"] + r["clearance"] for r in n) == len(want)


@pytest.mark.parametrize("few, most", [(64, 4096), (9, 6), (0, 2)])
def test_audit3d_of_all_sizes_split_cells_and_points_left_behind(spark, few, most):
    rng = np.random.default_rng(11)
    cube = np.array([[i & 1, i >> 1 & 1, i >> 2] for i in range(8)], float)
    rows = [("s", 0, "MESH", (cube * [2e7, 2e7, 0.1] - [1e7, 1e7, 0.1]).tolist(), [[0.0, 0.0, 0.0], [3.0, 3.0, 0.0]])]
    for i in range(1, 60):
        side = 4.0 ** rng.integers(-5, 3) * rng.uniform(0.5, 1, 3)
        box = turned(cube * side, rng.uniform(0, 3) if i % 2 else 0.0, np.round(rng.normal(0, 1, 3), 1))
        rows.append(("s" if i % 8 else None, i, "MESH", box, [*box, *box[: i % 5]] if i % 7 else None))
    gap, want = 0.25, {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            p, q = np.array(a[3]), np.array(b[3])
            aabb = (np.maximum(p.min(0), q.min(0)) - np.minimum(p.max(0), q.max(0))).max()
            if a[0] is None or b[0] is None or aabb > gap:
                continue
            sat = brute_sat(a[3], b[3])
            cloud = min((float(np.linalg.norm(np.subtract(x, y))) for x in a[4] or [] for y in b[4] or []), default=None)
            if sat > gap:
                want[a[1], b[1]] = ("clearance", "obb-sat", sat * 1000)
            elif cloud is not None:
                want[a[1], b[1]] = ("interference" if cloud <= 1e-6 else "tight_gap" if cloud < gap else "clearance", "mesh-kdtree", cloud * 1000)
            else:
                want[a[1], b[1]] = ("interference", "aabb-fallback", 0.0)
    d = spark.createDataFrame(rows, "scene_id string, ord long, type string, bbox3d array<array<double>>, verts array<array<double>>")
    found = S.audit3d(d, gap * 1000, few=few, most=most)
    got = [(r["a_ord"], r["b_ord"], r["rule"], r["method"], r["distance_mm"]) for r in found.collect()]
    assert sorted(r[:4] for r in got) == sorted((*k, *v[:2]) for k, v in want.items()) and len(want) > 100
    assert {r[3] for r in got} == {"obb-sat", "mesh-kdtree", "aabb-fallback"} and all(math.isclose(r[4], want[r[:2]][2], abs_tol=2e-3) for r in got)
    r = S.audit3d_metrics(found).first()
    assert [r["interference"], r["tight_gap"], r["clearance"]] == [sum(v[0] == k for v in want.values()) for k in ("interference", "tight_gap", "clearance")]


@pytest.mark.parametrize("name", ["audit_3d_boxes", "audit_3d", "audit_3d_metrics"])
def test_3d_audits_send_no_cells_or_points_to_every_task(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [next(x for x in plan[i + 1 :] if not re.search(r"(Project|Filter) ", x)) for i, x in enumerate(plan) if "BroadcastExchange" in x]
    assert all("HashAggregate" in x for x in below), below  # only counts of cells over the limit


def test_sources(spark, tmp_path):
    r = {"schema": "vision-report/v3", "sensors": ["dom"], "source": {"size_px": [800, 600]}, "elements": [{"id": 1, "bbox": [0, 0, 10, 10], "source": ["dom"]}, {"id": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(r))
    (tmp_path / "b.json").write_text(json.dumps({"slides": [{"slide": 1, "shapes": [{"id": 7, "pos_pt": [1, 2], "size_pt": [3, 4], "texts": [{"runs": [{"text": "hi", "size_pt": 9, "color": "#000000"}]}]}]}], "source": {"slide_size_pt": [960, 540]}}))
    e = reports.elements(reports.read_reports(spark, str(tmp_path))).orderBy("report_id", "ord").collect()
    assert [x["x2"] for x in e] == [10.0, None, 4.0] and e[2]["texts"][0]["text"] == "hi" and e[2]["canvas_w"] == 960
    raw = b"".join(b"\x00" + bytes([10 * y, 20, 30, 40, 50, 60]) for y in range(2))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    assert files.png(png) == (2, 2, bytes([0, 20, 30, 40, 50, 60, 10, 20, 30, 40, 50, 60]))
    assert bytes(files.images(spark, str(tmp_path / "*.png")).first()["data"]) == files.png(png)[2]
    assert files.listing(spark, str(tmp_path)).count() == 1
    assert files.page_range("2-9", 5) == (2, 5) and files.page_range("all", 3) == (1, 3)
    nodes = spark.createDataFrame([("App", 1, None, 0), ("App", 2, 1, 1), ("App", 3, 2, 0), ("App", 4, 1, 0), ("other", 5, None, 0)], "app string, node_id long, parent_id long, ord int")
    assert [(r["node_id"], r["depth"]) for r in files.tree(nodes, 3, "aPP").orderBy("path").collect()] == [(1, 0), (4, 1), (2, 1), (3, 2)]
    assert [r["node_id"] for r in files.tree(nodes, 3, most=2).orderBy("app", "path").collect()] == [1, 4, 5]
    (tmp_path / "broken.png").write_bytes(png[:30])
    (tmp_path / "odd.webp").write_bytes(b"RIFF....WEBP")
    read = {r["path"].rsplit("/", 1)[1]: r for r in files.images(spark, str(tmp_path / "*.[pw]*"), errors=True).collect()}
    assert read["p.png"]["error"] is None and read["broken.png"]["data"] is None and "not a PNG" in read["odd.webp"]["error"]
    gray = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\x01\x05\x05\x05\x02\x01\x01\x01")) + part(b"IEND", b"")
    assert files.png(gray) == (3, 2, bytes(v for p in (5, 10, 15, 6, 11, 16) for v in (p, p, p)))
    assert [r["length"] for r in files.listing(spark, str(tmp_path), ["webp"]).collect()] == [12]


def test_scenes_and_cameras(spark, tmp_path):
    scene = {"objects3d": [{"name": "Cube", "type": "MESH", "material": "red", "splines": None, "bbox3d": [[0, 0, 0]] * 8}, {"name": "C", "type": "CURVE", "splines": [[[0, 0, 0], [1, 1, 1]]]}], "cameras": [{"name": "Cam", "sensor_width": 36.0, "lens": 50.0}, {"name": "None", "sensor_width": 36.0, "lens": 0.0}]}
    (tmp_path / "s.json").write_text(json.dumps(scene))
    o = files.scenes(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["name"], r["material"], r["splines"]) for r in o] == [("Cube", "red", None), ("C", None, [[[0, 0, 0], [1, 1, 1]]])]
    c = files.cameras(spark, str(tmp_path)).orderBy("ord").collect()
    assert (c[0]["fov_rad"], c[0]["fov_deg"], c[1]["fov_rad"]) == (round(2 * math.atan(0.36), 6), round(math.degrees(2 * math.atan(0.36)), 4), 0.0)


def test_slides(spark, tmp_path):
    import zipfile

    head = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda i, x, more="", kind="sp": f'<p:{kind}><p:nvSpPr><p:cNvPr id="{i}" name="n{i}"/></p:nvSpPr><p:spPr><a:xfrm rot="5400000"><a:off x="{x}" y="25400"/><a:ext cx="127000" cy="12700"/></a:xfrm><a:solidFill><a:srgbClr val="FF0000"/></a:solidFill></p:spPr>{more}</p:{kind}>'
    text = '<p:txBody><a:p><a:r><a:rPr sz="1800" b="1"><a:solidFill><a:srgbClr val="00FF00"/></a:solidFill><a:latin typeface="Arial"/></a:rPr><a:t>Hello</a:t></a:r></a:p></p:txBody>'
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {head}><p:sldSz cx="12192000" cy="6858000"/></p:presentation>')
        z.writestr("ppt/slides/slide2.xml", f'<p:sld {head}><p:cSld><p:spTree>{shape(9, 0)}</p:spTree></p:cSld></p:sld>')
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {head}><p:cSld><p:spTree>{shape(2, 12700, text)}{shape(3, 0, shape(4, 38100), "grpSp")}</p:spTree></p:cSld></p:sld>')
    got = files.pptx(spark, str(tmp_path)).collect()
    assert [(r["slide"], r["shape_id"], r["parent_id"], r["depth"], r["x"], r["y"], r["w"]) for r in got] == [(1, 2, None, 0, 1.0, 2.0, 10.0), (1, 3, None, 0, 0.0, 2.0, 10.0), (1, 4, 3, 1, 3.0, 2.0, 10.0), (2, 9, None, 0, 0.0, 2.0, 10.0)]
    assert (got[0]["slide_w"], got[0]["rotation"], got[0]["fill"], got[0]["type"]) == (960.0, 90.0, "#FF0000", "sp")
    assert [tuple(x) for x in got[0]["runs"]] == [("Hello", 18.0, True, "#00FF00", "Arial")]
    assert files.pptx(spark, str(tmp_path), 2).count() == 1


def test_failures_are_logged_and_turned(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"failure {i} " + "x" * 50) for i in range(400)], "ts long, text string")
    reports.append_failures(rows, log, 10_000, 150)
    reports.append_failures(spark.createDataFrame([(1000, "last")], "ts long, text string"), log, 10_000, 150)
    assert sorted(r["ts"] for r in spark.read.json(log).collect()) == [*range(250, 400), 1000]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"sensors": ["dom"]}')
    (tmp_path / "r/b.json").write_text("no json")
    got = reports.or_errors(reports.read_reports(spark, str(tmp_path / "r"))).orderBy("report_id").collect()
    assert [r["failed"] for r in got] == [False, True] and json.loads(got[1]["json"])["error"] == "not a report" and json.loads(got[0]["json"])["sensors"] == ["dom"]
    steps = spark.createDataFrame([(1, 2, False, ["b", "a"], [7], None, True), (1, 1, False, ["a"], [5, 6], ["x"], None), (1, 0, True, ["z"], [1], None, True), (2, 0, None, None, None, None, None)], "task_id long, step int, failed boolean, sensors array<string>, elements array<int>, anomalies array<string>, truncated boolean")
    merged = {r["task_id"]: tuple(r)[1:] for r in reports.merge_reports(steps).collect()}
    assert merged == {1: (["a", "b"], [5, 6, 7], ["x"], True), 2: ([], [], [], False)}


def picture(rows):
    a = np.array(rows, np.uint8)
    return a if a.ndim == 3 else a[..., None].repeat(3, 2)


def frames_of(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate(arrays)], "image_id long, w int, h int, data binary")


def test_scene_layouts(spark):
    base = np.full((30, 30), 20)
    left, right, top, mid = (base.copy() for _ in range(4))
    left[:, :10], right[:, 20:], top[:10], mid[10:20, 10:20] = 250, 250, 250, 250
    corner = base.copy()
    corner[:10], corner[:, :10] = 250, 250
    got = {r["image_id"]: r for r in N.scene_stats(R.pixels(frames_of(spark, *map(picture, (left, right, top, mid, base, corner, base * 0))))).collect()}
    assert [got[i]["layout"] for i in range(7)] == [["left_sidebar"], ["right_sidebar"], ["top_toolbar"], ["main_content"], ["uniform"], ["left_sidebar", "top_toolbar"], ["uniform"]]
    assert [(c["hex"], c["count"], c["percent"]) for c in got[0]["color_histogram"]] == [("#141414", 600, 66.67), ("#FAFAFA", 300, 33.33)]
    assert got[6]["center_x"] == 0.5 and got[6]["coverage"] == 0.0 and got[4]["threshold"] == 20 and got[0]["pixels"] == 900


def test_pictures_compared(spark):
    one, two = np.zeros((40, 50), int), np.zeros((40, 50), int)
    two[5:15, 3:13], two[30:33, 40:43], two[20:26, 20:26] = 255, 255, 200
    two[26:30, 26:30] = 200  # joins the last one by a corner
    got = N.differences(frames_of(spark, picture(one)), frames_of(spark, picture(two))).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 3, 5, 12, 14, 100), (1, 20, 20, 29, 29, 52)]
    assert N.differences(frames_of(spark, picture(two)), frames_of(spark, picture(two.repeat(2, 0).repeat(2, 1)))).count() <= 3
    assert N.differences(frames_of(spark, picture(one)), frames_of(spark, picture(one))).count() == 0


def test_wall_groups_pictures(spark):
    d = frames_of(spark, picture([[[255, 0, 0]] * 4] * 2), picture([[10] * 2] * 4), picture([[[0, 90, 200]] * 600]))
    d = d.withColumn("error", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(9, None, None, None, "bad file")], "image_id long, w int, h int, data binary, error string"))
    got = {r["image_id"]: r for r in N.wall(d).collect()}
    assert (got[0]["hue"], got[0]["family"], got[0]["warmth"], got[0]["tone"], got[0]["aspect"]) == (0, "red", "warm", "light", "landscape")
    assert got[1]["hue"] is None and got[1]["category"] == "neutral·dark·gray" and got[1]["aspect"] == "portrait"
    assert got[2]["family"] == "blue" and got[9]["error"] == "bad file" and got[9]["category"] is None
    assert [tuple(c) for c in got[0]["dominant_colors"]] == [("#FF0000", 100.0)]


def test_saliency_segments_and_icons(spark):
    m = np.zeros((30, 40), int)
    m[2:12, 3:13], m[20:29, 20:30], m[0, 39] = 250, 150, 255
    got = N.saliency(frames_of(spark, picture(m)), 5, 0.3).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 3, 2, 12, 11, 0.98, 100), (1, 20, 20, 29, 28, 0.588, 90)]
    raw = [(1, i, 8, float(gx), 0.0, 1.0, 0.0, 1.0, 2.0, lo, 1.0, 0.0, 0.0) for i, (gx, lo) in enumerate(((1, 2.0), (1, 1.0), (5, 0.0), (9, -9.0)))]
    icons = N.icons(spark.createDataFrame(raw, "image_id long, ord long, stride int, gx double, gy double, left double, top double, right double, bottom double, logit double, scale double, pad_x double, pad_y double")).orderBy("rank").collect()
    assert [(r["ord"], r["x1"], r["x2"]) for r in icons] == [(0, 4.0, 20.0), (2, 36.0, 52.0)]


def test_page_layout_boxes(spark):
    mask = np.zeros((20, 20), np.uint8)
    mask[5:10, 5:15] = 1
    row = lambda i, cls, score, box: (1, i, cls, score, *map(float, box), 200, 200, mask.tobytes(), 20)
    d = spark.createDataFrame([row(0, 22, 0.9, (40, 40, 160, 110)), row(1, 21, 0.5, (40, 40, 160, 110)), row(2, 99, 0.9, (0, 0, 9, 9)), row(3, 0, 0.8, (0, 0, 30, 30))], "image_id long, ord long, cls int, score double, x1 double, y1 double, x2 double, y2 double, w int, h int, mask binary, side int")
    got = N.layout_boxes(d).collect()
    assert [(r["ord"], r["label"]) for r in got] == [(0, "text")] and abs(got[0]["x1"] - 50) <= 1 and abs(got[0]["y2"] - 99) <= 1


def test_edges_of_pictures(spark):
    a = np.zeros((64, 64), int)
    a[:, 32:] = 255
    i = frames_of(spark, picture(a), picture(np.zeros((8, 8), int)))
    got = {r["image_id"]: r for r in N.edge_density(i, threshold=30).collect()}
    assert got[0]["edge_points"] == 62 and got[0]["lines"] >= 1 and got[0]["density_lines"][0][1:] == [0.0, 62.0] and sum(map(sum, got[0]["density_map"])) == 62
    assert got[1]["edge_points"] == 0 and got[1]["density_lines"] == [] and got[1]["density_map"] == [[0] * 16] * 16
    e = N.edge_elements(i, threshold=30, first=10).collect()
    assert sum(r["type"] == "edge_point" for r in e) == 10 and [r["conf"] for r in e if r["id"] == 10] == [0.62]
    assert N.edge_points(i, max_points=20).count() == 21  # every third


def test_zoom_and_probe(spark):
    a = picture(np.arange(600).reshape(20, 30) % 256)
    i = frames_of(spark, a)
    r = spark.createDataFrame([(0, 12, 9, 4, 3)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    z = N.zoom(i, r, 2).first()
    assert (z["w"], z["h"], z["ox"], z["oy"]) == (16, 12, 4, 3)
    assert bytes(N.zoom(i, r, 1).first()["data"]) == a[3:9, 4:12].tobytes()
    assert N.probe(i, r, "pix").first()["hex"] == "#%02X%02X%02X" % tuple(a[6, 8])
    lines = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)], "image_id long, x1 double, y1 double, x2 double, y2 double")
    assert tuple(N.probe(i, r, "ocr", lines=lines).first())[1:] == (5.0, 5.0, 7.0, 7.0)
    assert N.probe(i, r, "edge").columns[:3] == ["image_id", "id", "type"]
    with pytest.raises(ValueError):
        N.probe(i, r, "smell")
    o = spark.createDataFrame([(1, 0, "ocr", 10.0, 20.0, 30.0, 40.0, "t", None, None, 0.9, False)], OBSERVED)
    got = N.zoomed_entities(o, spark.createDataFrame([(1, 100.0, 50.0, 7.0, 9.0)], "report_id long, x1 double, y1 double, x2 double, y2 double")).first()
    assert (got["x1"], got["y2"], got["center"]) == (12.0, 29.0, [17.0, 24.0])


def test_depth_by_projection(spark):
    # a camera at the origin that looks along z: x and y over z, the distance last
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0)])
    t = spark.createDataFrame([(1, [-2.0, -2.0, 2.0], [2.0, -2.0, 2.0], [0.0, 4.0, 2.0]), (1, [0.0, 0.0, -1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0])], "camera_id long, a array<double>, b array<double>, c array<double>")
    p = N.projected(t, m, 8, 8).collect()
    assert len(p) == 1 and p[0]["a"] == [0.0, 8.0, 2.0] and p[0]["b"] == [8.0, 8.0, 2.0]
    z = S.z_buffer(N.projected(t, m, 8, 8), 8, 8)
    s = N.z_statistics(z, 8, 8).first()
    assert s["near"] == s["far"] == s["center"] == 2.0 and s["std"] == 0.0 and 0.3 < s["seen"] < 0.8 and sum(s["histogram"]) == z.count()


def test_kernels_and_model_input():
    a = np.arange(16, dtype=float).reshape(4, 4)
    assert np.allclose(R.kernel_resize(a, 4, 4, "linear"), a) and np.allclose(R.kernel_resize(a, 4, 4, "cubic"), a)
    z = R.kernel_resize(a, 7, 7, "zoom")
    assert np.allclose(z[::2, ::2], a) and np.allclose(z[0, 1], 0.5)
    assert np.allclose(R.kernel_resize(a, 8, 8, "linear")[0], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])
    x = R.model_input(np.full((30, 40, 3), 255, np.uint8), 8, (0.5, 0.5, 0.5), (0.25, 0.5, 1.0))
    assert x.shape == (3, 8, 8) and np.allclose(x[:, 0, 0], [2, 1, 0.5])
    assert R.crop(a, -3, 1, 2, 9).tolist() == [[4, 5], [8, 9], [12, 13]] and R.upscale(a[:1, :2]).tolist() == [[0, 0, 1, 1]] * 2


def test_clusters_of_sets(spark):
    v = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.9, 0.1]), ("s", 2, [0.0, 2.0]), ("t", 0, [1.0, 1.0])], "k string, ord long, embedding array<double>")
    found, metrics = N.cluster(v, ["k"])
    assert [(r["size"], r["representative"]) for r in found.orderBy("cluster").collect()] == [(2, 0), (1, 2)] and tuple(metrics.first()) == ("s", 2, 1, 2)


def table(name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con.sql(f"WITH {sql} ").fetchall()


def elements():
    """The elements of every report of the smallest tables, in order."""
    rows = table("lineitem", f"{proxies.ELEMENTS_SQL} SELECT report_id, ord, x1, y1, x2, y2, conf, kind, seed FROM el ORDER BY 1, 2")
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def plain_iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = w * h if w > 0 and h > 0 else 0.0
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)


def plain_similarity(a, b):
    return 1.0 if a == b else 0.7 if a in b or b in a else max(0.0, 1 - distance(a, b) / max(len(a), len(b)))


def test_optimal_match_over_the_table(spark):
    """The least total cost over all ways to match, report by report."""
    import itertools

    got = {}
    for r in catalog.QUERIES["optimal_match"](spark, SF).collect():
        got.setdefault(r["report_id"], {})[r["a_ord"]] = r["b_ord"]
    cases = 0
    for report, es in elements().items():
        a, b = [e for e in es if e[7] == "ocr"], [e for e in es if e[7] == "dom"]
        if not a or not b or len(a) * len(b) > 16:
            continue
        cases += 1
        iou = {(x[1], y[1]): plain_iou(x, y) for x in a for y in b}
        cost = {k: 1 - iou[k] - 0.3 * plain_similarity(f"p{next(x[8] for x in a if x[1] == k[0])}", f"p{next(y[8] for y in b if y[1] == k[1])}") for k in iou}
        k = min(len(a), len(b))
        ways = [tuple(zip((x[1] for x in p), (y[1] for y in q), strict=True)) for p in itertools.combinations(a, k) for q in itertools.permutations(b, k)]
        best = min(sum(cost[m] for m in w) for w in ways)
        fine = [{x: y for x, y in w if iou[x, y] > 0} for w in ways if sum(cost[m] for m in w) <= best + 1e-9]
        assert got.get(report, {}) in fine
    assert cases > 500


def test_alignment_over_the_table(spark):
    want = []
    for report, es in elements().items():
        es = [e for e in es if e[7] == "dom"]  # designed ones
        for axis, of in (("left", lambda e: e[2]), ("right", lambda e: e[4]), ("hcenter", lambda e: (e[2] + e[4]) / 2)):
            groups = []
            for e in es:
                g = next((g for g in groups if abs(of(e) - of(g[0])) <= 4), None)
                if g is None:
                    groups.append([e])
                else:
                    g.append(e)
            for g in groups:
                mean = sum(map(of, g)) / len(g)
                want += [(report, e[1], axis, round(abs(of(e) - mean), 6)) for e in es if len(g) > 1 and of(e) not in map(of, g) and 4 < abs(of(e) - mean) <= 16]
    got = [(r["report_id"], r["element_ids"][0], r["axis"], r["value"]) for r in catalog.QUERIES["alignment_drift"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_greedy_over_the_tables(spark):
    """Entities, suppression and clusters against plain loops over whole tables."""
    entities, kept = [], set()
    for report, es in elements().items():
        groups = []
        for e in sorted(es, key=lambda e: (-e[6], e[1])):
            def near(o, e=e):
                small, large = (o, e) if (o[4] - o[2]) * (o[5] - o[3]) <= (e[4] - e[2]) * (e[5] - e[3]) else (e, o)
                x, y = (small[2] + small[4]) / 2, (small[3] + small[5]) / 2
                return plain_iou(o, e) >= 0.5 or (large[2] <= x <= large[4] and large[3] <= y <= large[5])

            g = next((g for g in groups if any(map(near, g))), None)
            if g is None:
                groups.append([e])
            else:
                g.append(e)
        entities += [(report, i, len(g)) for i, g in enumerate(groups)]
        up = []
        for e in sorted(es, key=lambda e: (-e[6], e[1])):
            if all(plain_iou(e, o) <= 0.3 for o in up):
                up.append(e)
        kept |= {(report, e[1]) for e in up}
    assert sorted((r["report_id"], r["id"], r["n_observations"]) for r in catalog.QUERIES["greedy_entities"](spark, SF).collect()) == sorted(entities)
    assert {(r["report_id"], r["ord"]) for r in catalog.QUERIES["suppressed_boxes"](spark, SF).collect()} == kept
    v = table("embeddings", "e AS (SELECT 1) SELECT label, vec_id, embedding FROM embeddings ORDER BY label, vec_id")
    want = {}
    for label in {r[0] for r in v}:
        groups = []
        for _, i, x in (r for r in v if r[0] == label):
            x = np.array(x, float) / np.linalg.norm(x)
            sims = [np.mean([x @ y for _, y in g]) for g in groups]
            k = int(np.argmax(sims)) if sims and max(sims) > 0.3 else len(groups)
            if k == len(groups):
                groups.append([])
            groups[k].append((i, x))
            want[label, i] = k
    assert {(r["label"], r["ord"]): r["cluster"] for r in catalog.QUERIES["greedy_clusters"](spark, SF).collect()} == want


def test_segments_over_the_table(spark):
    boxes = {}
    for r in catalog.QUERIES["mask_boxes"](spark, SF).collect():
        boxes.setdefault(r["image_id"], []).append(r)
    all_ = N.mask_boxes(catalog.sensor_queries._masks(spark, SF)).collect()
    want = set()
    for i in {r["image_id"] for r in all_}:
        kept = []
        for r in sorted((r for r in all_ if r["image_id"] == i), key=lambda r: (-r["pixels"], r["ord"])):
            box = (0, 0, r["x1"], r["y1"], r["x2"], r["y2"])
            if all(plain_iou(box, o) <= 0.5 for o in kept):
                kept.append(box)
                want.add((i, r["ord"]))
    assert {(r["image_id"], r["ord"]) for r in catalog.QUERIES["segments"](spark, SF).collect()} == want and boxes


def test_palettes_share_all_pixels(spark):
    px = [(r["image_id"], (r["r"], r["g"], r["b"])) for r in proxies.picture_px(spark, SF).collect()]
    got = {}
    for r in catalog.QUERIES["scene_palettes"](spark, SF).collect():
        got.setdefault(r["image_id"], []).append((r["hex"], r["count"]))
    for i, found in got.items():
        own = [np.array(c) for k, c in px if k == i]
        assert sum(n for _, n in found) == len(own) == 768 and len(found) <= 8 and [n for _, n in found] == sorted((n for _, n in found), reverse=True)
        means = [np.array([int(h[k : k + 2], 16) for k in (1, 3, 5)]) for h, _ in found]
        error = np.mean([min(((c - m) ** 2).sum() for m in means) for c in own])
        assert error < 0.2 * np.var(np.array(own), axis=0).sum()


def test_streams(spark, tmp_path):
    W, Fo = (0.0, "workspaces_changed", False), (0.05, "focus_changed", True)
    assert V.throttled([W, Fo, (0.09, "workspaces_changed", False)], 0.1) == [Fo]
    assert [e[0] for e in V.throttled([(0.0, "a", False), (0.3, "b", False)], 0.1)] == [0.0, 0.3]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Windows changed: 1\nnoise\nWorkspaces changed\nFocus changed\n")
    got = []
    q = V.watch(spark.readStream.format("text").load(str(tmp_path / "in")).withColumnRenamed("value", "line"), lambda df, n: got.extend(r["kind"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert got == ["windows_changed", "focus_changed"]
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "k string, value long")
    new, n = V.refresh(cache, spark.createDataFrame([("a", None), ("b", 5)], "k string, value long"), "k")
    assert {r["k"]: r["value"] for r in new.collect()} == {"a": 1, "b": 5} and tuple(n.first()) == (1, 1)
    asked = []
    got, after = V.cached(spark.createDataFrame([("a",), ("c",), ("c",)], "k string"), cache, "k", lambda d: asked.append(d.count()) or d.withColumn("value", F.lit(9).cast("long")))
    assert asked == [1] and sorted(map(tuple, got.collect())) == [("a", 1), ("c", 9), ("c", 9)] and after.count() == 3


def test_throttle_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(7)
    (tmp_path / "in").mkdir()
    rows = [(int(u), round(float(t), 3), f"k{i}", bool(rng.integers(2))) for i, (u, t) in enumerate(zip(rng.integers(0, 3, 60), np.sort(rng.uniform(0, 40, 60)), strict=True))]
    for part in range(3):  # three batches, a file each
        (tmp_path / f"in/{part}.json").write_text("\n".join(json.dumps(dict(zip(("k", "ts", "kind", "is_trigger"), r, strict=True))) for r in rows[20 * part : 20 * part + 20]))
        import os

        os.utime(tmp_path / f"in/{part}.json", (1000 + part, 1000 + part))
    stream = spark.readStream.schema("k long, ts double, kind string, is_trigger boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = V.throttle_stream(stream, "k", 5.0)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r["k"], r["ts"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for u in range(3):
        full = V.throttled([(t, name, hit, i) for i, (k, t, name, hit) in enumerate(rows) if k == u], 5.0)
        want += [(u, e[0], e[1]) for e in full]
    # the last window of each key stays open until its timer runs out
    assert set(got) <= set(want) and len(want) - len(got) <= 3 and len(got) > 6


def test_tasks(spark):
    e = sample(spark, [(100, 80, 400, 260), (300, 200, 620, 380)])
    task = tasks.load('{"name": "t", "steps": [{"as": "rules", "cmd": ["rules", "--elements", "$elements", "--margin", "2"]}, {"as": "score", "cmd": ["score"]}, {"as": "x", "cmd": ["nope"], "optional": true}, {"as": "y", "cmd": ["nope"], "if": "$gone"}]}')
    out, errors = tasks.run(task, {"elements": e})
    assert out["score"].first()["design_score"] == 75.0 and list(errors) == ["x"]
    with pytest.raises(ValueError):
        tasks.load('{"name": "bad name", "steps": []}')


def test_sensors_as_steps(spark):
    a = np.zeros((20, 30), int)
    a[:, 15:] = 200
    frames = {"images": frames_of(spark, picture(a)), "later": frames_of(spark, picture(a * 0))}
    step = lambda name, *words: {"as": name, "cmd": [name, *words]}
    task = {"name": "all", "steps": [step("scene_stats", "--colors", "2"), step("ascii", "--cols", "6", "--rows", "2", "--color", "true"), step("pix"), step("edge", "--threshold", "10"), step("saliency", "--images", "$images", "--top-n", "1"), step("diff", "--compare", "$later")]}
    out, errors = tasks.run(task, frames)
    assert not errors and out["ascii"].first()["lines"] == ["%%%:::"] * 2 or out["ascii"].first()["chars"] == 12
    assert out["scene_stats"].first()["layout"] == ["right_sidebar"] and out["pix"].first()["superpixels"] == 10
    assert tuple(out["saliency"].first())[1:6] == (0, 15, 0, 29, 19) and out["diff"].first()["count"] == 300 and out["edge"].first()["edge_points"] == 18


def test_prompts(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 1, "b</w>": 2, "ab</w>": 3, "1</w>": 4, "!</w>": 5, "c</w>": 6, "b": 7}))
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b</w>\n")
    ids = X.prompt_ids(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"), 6)
    got = [r["i"] for r in spark.createDataFrame([("ab c1!",), ("",)], "t string").select(ids("t").alias("i")).collect()]
    assert got == [[49406, 3, 6, 4, 5, 49407], [49406, 49407, 0, 0, 0, 0]]


def test_box_join_finds_all_pairs(spark):
    rng = np.random.default_rng(2)
    b = rng.integers(0, 900, (300, 2))
    rows = [(1, i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(b, rng.integers(1, 400, (300, 2)), strict=True))]
    d = spark.createDataFrame(rows, "report_id long, ord long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["a_ord"], r["b_ord"]) for r in J.box_join(d, d, ["report_id"], 100.0, F.col("a_ord") < F.col("b_ord")).select("a_ord", "b_ord").collect()}
    want = {(p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    assert got == want
    for few in (500, 20):  # by key, and by cells
        assert {(r["a_ord"], r["b_ord"]) for r in J.overlap_pairs(d, 0.0, 0.0, 100.0, few).collect()} == want


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_conversation_queries_take_whole_texts(spark, tmp_path):
    said = [(1, 0, "Please sav the fil, then logot"), (1, 1, "please save the file, then log out"), (1, 2, None), (2, 0, "ok"), (2, 1, " OK "), (2, 2, "well ok then"), (2, 2, "well ok then"), (3, 0, "123"), (3, 1, "")]
    spark.createDataFrame(said, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    listed = X.COMMON
    assert len(listed) == 37
    want = []
    for c, t, text in set(said):
        for i, w in enumerate(re.findall("[a-z]+", text or "")):
            d, _, best = min((distance(w, x), k, x) for k, x in enumerate(listed))
            want.append((c, t, i, w, best, 0.9) if len(w) >= 2 and d <= 1 else (c, t, i, w, w, 1.0))
    got = [tuple(r) for r in catalog.QUERIES["dict_correct"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (1, 0, 5, "logot", "logout", 0.9) in got

    def sim(a, b):
        a, b = a.strip(" ").lower(), b.strip(" ").lower()
        if not a or not b:
            return 0.0
        return 1.0 if a == b else 0.7 if a in b or b in a else round(1 - distance(a, b) / max(len(a), len(b)), 6)

    pairs = [(c, t, len(a), len(b), sim(a, b)) for c, t, a in set(said) for d, u, b in set(said) if c == d and u == t + 1 and a is not None and b is not None]
    assert sorted(tuple(r) for r in catalog.QUERIES["text_similarity_texts"](spark, str(tmp_path)).collect()) == sorted(pairs) and len(pairs) == 4
