"""Layout and colour rules over elements, and their audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import color as C
from .groups import annotate, per_group
from .joins import overlap_pairs

WEIGHT = {"critical": 1.0, "warn": 0.5, "info": 0.1}
#: Fills that say nothing of the colour behind a text.
NO_FILL = ("BACKGROUND (5)", "SOLID (1)")
#: The rules' thresholds where none are given.
DEFAULTS = {"align_tol": 4.0, "align_drift": 4.0, "margin": 1.0, "spacing_k": 1.8, "min_iou": 0.01, "min_area": 200.0}
FINDING = ["report_id", "rule", "element_ids", "severity", "x1", "y1", "x2", "y2", "value"]


def designed(source: Column, font: Column, z: Column) -> Column:
    return F.coalesce(F.arrays_overlap(source, F.array(F.lit("dom"), F.lit("pptx"))), F.lit(False)) | font.isNotNull() | z.isNotNull()


def label(name: Column, text: Column, kind: Column, ord_: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.substring(F.coalesce(some(name), some(text), some(kind), F.concat(F.lit("el"), ord_.cast("string"))), 1, 60)


def canvas(arg: str | None, *sources: Column) -> Column:
    """[w, h]: "WxH" if given, else the first of the sources that is there, cut to whole numbers."""
    given = [F.array(*[F.lit(int(float(v))) for v in arg.lower().split("x")]).cast("array<long>")] if arg else []
    return F.coalesce(*given, *[F.transform(s, lambda v: v.cast("long")) for s in sources])


def _finding(df: DataFrame, rule: str, severity: Column, ids: Column, value: Column) -> DataFrame:
    return df.select("report_id", F.lit(rule).alias("rule"), ids.alias("element_ids"), severity.alias("severity"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], value.cast("double").alias("value"))


def contrast(elements: DataFrame) -> DataFrame:
    """Coloured runs (texts: text, color, size_pt) against the fill: required 3 from 18 pt, else 4.5; below 2 critical."""
    runs = elements.withColumn("run", F.explode("texts")).withColumn("back", F.coalesce("fill", F.col("color.fill")))
    runs = runs.where(~F.col("back").isin(*NO_FILL) & C.hex_ok(F.col("back")) & C.hex_ok(F.col("run.color")))
    lum = lambda h: C.luminance8(*C.rgb_of_hex(h))
    ratio = C.contrast(lum(F.col("run.color")), lum(F.col("back")))
    need = F.when(F.coalesce(F.col("run.size_pt"), F.lit(11.0)) >= 18, 3.0).otherwise(4.5)
    bad = runs.withColumn("ratio", ratio).where(F.col("ratio") < need)
    return _finding(bad, "text_contrast", F.when(F.col("ratio") < 2.0, "critical").otherwise("warn"), F.array("ord"), F.col("ratio"))


def overlap(elements: DataFrame, min_iou: float = DEFAULTS["min_iou"], min_area: float = DEFAULTS["min_area"]) -> DataFrame:
    return _finding(overlap_pairs(elements, min_iou, min_area), "overlap", F.lit("warn"), F.array("a_ord", "b_ord"), F.col("iou"))


def leaders(values: np.ndarray, tol: float) -> list[list[int]]:
    """Groups by distance to a group's first member: in the order given, each value joins the
    first group in reach."""
    out: list[list[int]] = []
    first = np.empty(len(values))
    for i, v in enumerate(values):
        near = np.flatnonzero(np.abs(first[: len(out)] - v) <= tol)
        if len(near):
            out[near[0]].append(i)
        else:
            first[len(out)] = v
            out.append([i])
    return out


def alignment(elements: DataFrame, tol: float = DEFAULTS["align_tol"], drift: float = DEFAULTS["align_drift"]) -> DataFrame:
    """Designed elements off an edge or middle that two or more share; axis, at (the element's
    place), mean (the group's) and value (how far off) say how. Groups depend on the elements'
    order, so a report is one task's work; reports are the parallel unit."""

    def one(key, c):
        out = []
        left, right = np.array(c["x1"]), np.array(c["x2"])
        for axis, v in (("left", left), ("right", right), ("hcenter", (left + right) / 2)):
            for g in leaders(v, tol):
                if len(g) < 2:
                    continue
                mean = v[g].mean()
                far = np.abs(v - mean)
                for i in np.flatnonzero((far > tol) & (far <= drift * tol) & ~np.isin(v, v[g])):
                    out.append((key[0], "alignment_drift", [c["ord"][i]], "info", *(c[k][i] for k in ("x1", "y1", "x2", "y2")), float(far[i]), axis, float(v[i]), float(mean)))
        return out

    d = elements.where(designed(F.col("source"), F.col("font"), F.col("z"))).select("report_id", F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    kind = dict(elements.dtypes)["report_id"]
    return per_group(d, ["report_id"], ["ord"], one, f"report_id {kind}, rule string, element_ids array<long>, severity string, x1 double, y1 double, x2 double, y2 double, value double, axis string, at double, mean double")


def row_groups(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Row number of each box: it joins the first row whose first box it overlaps by over half the lower height."""
    first: list[int] = []
    out = np.zeros(len(top), int)
    for i in np.argsort(top, kind="stable"):
        for r, f in enumerate(first):
            if min(bottom[i], bottom[f]) - max(top[i], top[f]) > 0.5 * min(bottom[i] - top[i], bottom[f] - top[f]):
                out[i] = r
                break
        else:
            out[i] = len(first)
            first.append(int(i))
    return out


def rows_of(elements: DataFrame) -> DataFrame:
    """Designed elements with `row`, their visual row in the report."""

    def one(c):
        return [row_groups(np.array(c["y1"]), np.array(c["y2"])).tolist()]

    d = elements.where(designed(F.col("source"), F.col("font"), F.col("z"))).select("report_id", F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return annotate(d, ["report_id"], ["ord"], ["y1", "y2"], one, "row long")


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with gap, the positive space between a box and the next one to the right, and next and next_x2, that one's; boxes without are left out."""
    order = W.partitionBy(*keys).orderBy("x1", "ord")
    return df.withColumns({"gap": F.lead("x1").over(order) - F.col("x2"), "next": F.lead("ord").over(order), "next_x2": F.lead("x2").over(order)}).where("gap > 0")


def spacing(elements: DataFrame, k: float = DEFAULTS["spacing_k"], least: float = 8.0) -> DataFrame:
    """Gaps in rows of three or more that are over k times the row's upper median gap."""
    row = W.partitionBy("report_id", "row")
    d = gaps(rows_of(elements).withColumn("n", F.count(F.lit(1)).over(row)).where("n >= 3"), ["report_id", "row"])
    d = d.withColumn("gaps", F.array_sort(F.collect_list("gap").over(row))).withColumn("median", F.element_at("gaps", F.floor(F.size("gaps") / 2).cast("int") + 1))
    bad = d.where((F.size("gaps") >= 2) & (F.col("gap") > k * F.col("median")) & (F.col("gap") >= least))
    return _finding(bad.withColumn("x1", F.col("x2")).withColumn("x2", F.col("x2") + F.col("gap")), "spacing_anomaly", F.lit("info"), F.array("ord", "next"), F.col("gap"))


def safe_area(elements: DataFrame, margin: float = DEFAULTS["margin"]) -> DataFrame:
    """Needs canvas_w and canvas_h; a report without a canvas has no findings."""
    x1, y1, x2, y2, w, h = (F.col(c) for c in ("x1", "y1", "x2", "y2", "canvas_w", "canvas_h"))
    off = (x1 < 0) | (y1 < 0) | (x2 > w) | (y2 > h)
    bleed = ((x1 <= 0) & (x2 >= w)) | ((y1 <= 0) & (y2 >= h))
    edge = F.least(x1, y1, w - x2, h - y2)
    severity = F.when(off, "critical").when(~bleed & (edge <= margin) & F.col("has_text"), "warn")
    return _finding(elements.where(w.isNotNull()).withColumn("severity", severity).withColumn("edge", edge).where("severity IS NOT NULL"), "safe_area", F.col("severity"), F.array("ord"), F.col("edge"))


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with the columns that rules read, absent ones as nulls."""
    kinds = {"texts": "array<struct<text:string,color:string,size_pt:double>>", "color": "struct<fill:string,text:string>", "fill": "string", "font": "string", "z": "int", "source": "array<string>", "text": "string", "canvas_w": "double", "canvas_h": "double"}
    out = elements.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in elements.columns})
    return out.withColumn("has_text", F.col("text").isNotNull() | F.col("texts").isNotNull())


def run(elements: DataFrame, **p) -> DataFrame:
    """All findings, rule by rule."""
    p = DEFAULTS | p
    e = prepared(elements)
    ids = lambda d: d.withColumn("element_ids", F.col("element_ids").cast("array<long>"))
    parts = [contrast(e), overlap(e, p["min_iou"], p["min_area"]), alignment(e, p["align_tol"], p["align_drift"]), spacing(e, p["spacing_k"]), safe_area(e, p["margin"])]
    out = ids(parts[0]).withColumn("rule_ord", F.lit(0))
    for i, d in enumerate(parts[1:], 1):
        out = out.unionByName(ids(d).withColumn("rule_ord", F.lit(i)), allowMissingColumns=True)
    return out


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("report_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHT])


def design_score(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """100 (1 - weighted findings / elements); it may be negative."""
    n = elements.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_elements"))
    s = n.join(severities(findings), "report_id", "left").na.fill(0, list(WEIGHT))
    cost = sum(F.col(k) * w for k, w in WEIGHT.items())
    return s.withColumn("design_score", 100.0 * (1 - cost / F.greatest(F.col("n_elements"), F.lit(1))))


def audit(elements: DataFrame, min_iou: float = 0.05, min_area: float = 400.0) -> DataFrame:
    """report_id, type, element_ids, confidence: overlaps, elements off the canvas by
    more than a pixel, and first text colours below 4.5 against the fill."""
    e = prepared(elements)
    pairs = overlap_pairs(e, min_iou, min_area).select("report_id", F.lit("overlap").alias("type"), F.array("a_ord", "b_ord").cast("array<long>").alias("element_ids"), F.least(F.lit(0.99), F.col("iou") + 0.5).alias("confidence"))
    out = (F.col("x1") < -1) | (F.col("y1") < -1) | (F.col("x2") > F.col("canvas_w") + 1) | (F.col("y2") > F.col("canvas_h") + 1)
    off = e.where(out).select("report_id", F.lit("off_canvas"), F.array("ord").cast("array<long>"), F.lit(0.95))
    first = F.coalesce(F.get(F.filter("texts", lambda t: t["color"].isNotNull()), F.lit(0))["color"], F.col("color.text"))
    lum = lambda h: C.luminance8(*C.rgb_of_hex(h))
    ink = e.withColumn("ink", first).withColumn("back", F.coalesce("fill", F.col("color.fill"))).where(C.hex_ok(F.col("ink")) & C.hex_ok(F.col("back")))
    low = ink.where(C.contrast(lum(F.col("ink")), lum(F.col("back"))) < 4.5).select("report_id", F.lit("contrast"), F.array("ord").cast("array<long>"), F.lit(1.0))
    return pairs.union(off).union(low)


def tune(agreement, grid: dict[str, list], start: dict | None = None, rounds: int = 3) -> tuple[dict, float]:
    """Coordinate descent: agreement(params) -> share; a driver loop over a few settings, each a Spark job."""
    best = dict(start or {k: v[0] for k, v in grid.items()})
    score = agreement(best)
    for _ in range(rounds):
        before = score
        for k, values in grid.items():
            for v in values:
                if (now := agreement(best | {k: v})) > score:
                    best, score = best | {k: v}, now
        if score == before:
            break
    return best, score
