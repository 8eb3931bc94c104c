"""Task configurations: ordered steps over registered operators.

{"name": ..., "steps": [{"as": "ocr", "cmd": ["name", "--flag", "value"], "if": "$x", "optional": true}]}.
A step's operator gets its options and the frames of the steps before; what is lazy stays lazy."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
OPERATORS: dict[str, Callable] = {}


def operator(name: str):
    def add(f):
        OPERATORS[name] = f
        return f

    return add


def options(words: list[str]) -> dict[str, str | list[str] | bool]:
    """--flag value..., a flag without values is True, several make a list."""
    out: dict = {}
    flag = "_"
    for w in words:
        if w.startswith("--"):
            flag = w[2:].replace("-", "_")
            out.setdefault(flag, True)
        else:
            old = out.get(flag, True)
            out[flag] = w if old is True else [*old, w] if isinstance(old, list) else [old, w]
    return out


def filled(word: str, results: dict, given: dict):
    """$name is an earlier step's frame, else a given variable; None if neither is there."""
    if not word.startswith("$"):
        return word
    key = word[1:]
    return results.get(key, given.get(key, given.get(key.lower())))


def load(text: str) -> dict:
    task = json.loads(text)
    if not NAME.fullmatch(task.get("name", "")):
        raise ValueError("a task's name has 1 to 64 letters, digits, _ or -")
    return task


def run(task: dict, frames: dict[str, DataFrame], given: dict | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames by step, errors of optional steps). A step whose `if` is empty is left out."""
    results, errors = dict(frames), {}
    given = given or {}
    for step in task["steps"]:
        if "if" in step and not _truthy(filled(step["if"], results, given)):
            continue
        name, *words = step["cmd"]
        try:
            if name not in OPERATORS:
                raise KeyError(f"unknown operator {name}")
            args = {k: ([filled(x, results, given) for x in v] if isinstance(v, list) else filled(v, results, given) if isinstance(v, str) else v) for k, v in options(words).items()}
            results[step["as"]] = OPERATORS[name](results, **args)
        except Exception as e:  # noqa: BLE001  an optional step's failure is part of the result
            if not step.get("optional"):
                raise
            errors[step["as"]] = str(e)
    return {k: v for k, v in results.items() if k not in frames}, errors


def _truthy(x) -> bool:
    return x is not None and (isinstance(x, DataFrame) or bool(x))


@operator("rules")
def _rules(frames, elements="elements", **p):
    from ..operators import rules

    return rules.run(elements if isinstance(elements, DataFrame) else frames[elements], **{k: float(v) for k, v in p.items()})


@operator("audit")
def _audit(frames, elements="elements"):
    from ..operators import rules

    return rules.audit(elements if isinstance(elements, DataFrame) else frames[elements])


@operator("entities")
def _entities(frames, observations="observations", min_iou="0.5", min_conf="0"):
    from ..operators import matching

    return matching.entities(observations if isinstance(observations, DataFrame) else frames[observations], float(min_iou), float(min_conf))


@operator("score")
def _score(frames, elements="elements", findings="rules"):
    from ..operators import rules

    pick = lambda x: x if isinstance(x, DataFrame) else frames[x]
    return rules.design_score(pick(elements), pick(findings))


def _frame(frames, x):
    return x if isinstance(x, DataFrame) else frames[x]


def _sensor(name: str, **kinds):
    """Registers a sensor over a frame (given by name, `images` by default) with options of these kinds."""
    def add(f):
        def run_(frames, images="images", **p):
            return f(_frame(frames, images), **{k: kinds[k](v) if isinstance(v, str) else v for k, v in p.items()})

        OPERATORS[name] = run_
        return f

    return add


def _register() -> None:
    from ..operators import matching, sensors, shapes
    from ..operators.raster import pixels
    from ..sources import files

    yes = lambda v: str(v).lower() not in ("false", "0", "")
    box = lambda v: tuple(int(x) for x in v.split(","))
    _sensor("pix", colors=int)(sensors.pix)
    _sensor("scene_stats", colors=int)(lambda images, **p: sensors.scene_stats(pixels(images), **p))
    _sensor("ascii", cols=int, rows=int, color=yes)(lambda images, **p: sensors.ascii(pixels(images), **p))
    _sensor("edge", sigma=float, threshold=int, most=int, max_points=int)(sensors.edge_density)
    _sensor("edge_elements", sigma=float, threshold=int, most=int, max_points=int, first=int)(sensors.edge_elements)
    _sensor("saliency", top_n=int, min_score=float)(sensors.saliency)
    _sensor("depth", bins=int, region=box)(sensors.depth)
    _sensor("segment", min_area=float, most=int)(sensors.segment)
    _sensor("layout", min_conf=float, most=int)(sensors.layout_boxes)
    _sensor("icons", min_conf=float, most=int)(sensors.icons)
    _sensor("ocr", min_conf=float, most=int)(shapes.ocr_lines)
    _sensor("dom", most=int)(files.dom)
    _sensor("wall", colors=int)(sensors.wall)
    _sensor("geometry")(shapes.svg_shapes)
    _sensor("audit3d", gap_mm=float, method=str)(shapes.audit3d)
    OPERATORS["fusion"] = lambda frames, a="a", b="b", alpha="0.3": matching.fuse(_frame(frames, a), _frame(frames, b), ["report_id"], float(alpha))
    OPERATORS["diff"] = lambda frames, images="images", compare="compare", threshold="30": sensors.differences(_frame(frames, images), _frame(frames, compare), int(threshold))


_register()


def trimmed(elements: DataFrame, first: int, order: list) -> DataFrame:
    """The first elements of each report in order (a limit that is the feature), with no more than the fields a
    reader needs, captions cut to 40 characters."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    kept = [c for c in ("report_id", "id", "x1", "y1", "x2", "y2", "center", "text", "caption", "type", "conf", "sources", "assertion", "bus", "path") if c in elements.columns]
    d = elements.withColumn("_k", F.row_number().over(W.partitionBy("report_id").orderBy(*order))).where(F.col("_k") <= first).select(*kept)
    return d.withColumn("caption", F.substring("caption", 1, 40)) if "caption" in kept else d


def analyze(a11y: DataFrame, vision: DataFrame, k: int = 10, most_nodes: int = 15) -> DataFrame:
    """Perception of each report: its accessible nodes that can be used, the first most_nodes in their order, or, where
    it has none, what vision saw (report_id, id, x1..y2, center, text, conf, sources), the k surest. channel says which."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from ..operators.matching import assertion
    from ..sources.files import interactive

    nodes = interactive(a11y).withColumn("id", (F.row_number().over(W.partitionBy("report_id").orderBy("ord")) - 1).cast("long"))
    rest = vision.join(nodes.select("report_id").distinct(), "report_id", "left_anti")
    rest = rest if "assertion" in rest.columns else rest.withColumn("assertion", assertion(F.col("sources"), F.col("conf")))
    seen = trimmed(nodes, most_nodes, ["id"]).withColumn("channel", F.lit("a11y"))
    return seen.unionByName(trimmed(rest, k, [F.desc("conf"), "id"]).withColumn("channel", F.lit("vision")), allowMissingColumns=True)


def confirmed(fused: DataFrame) -> DataFrame:
    """A probe holds if it found anything, the first with at least half certainty."""
    from pyspark.sql import functions as F

    return fused.groupBy("report_id").agg((F.count(F.lit(1)) > 0).alias("any"), F.min_by("conf", "entity").alias("first")).select("report_id", (F.col("any") & (F.col("first") >= 0.5)).alias("confirmed"))


def verified(checks: DataFrame) -> DataFrame:
    """checks (task_id, screen_ok, title, expected, viewport_ok): all three must hold; null is not asked."""
    from pyspark.sql import functions as F

    from ..functions.text import title_matches

    yes = lambda c: F.coalesce(c, F.lit(True))
    return checks.withColumn("verified", yes(F.col("screen_ok")) & yes(title_matches(F.col("title"), F.col("expected"))) & yes(F.col("viewport_ok")))
