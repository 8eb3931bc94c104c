"""Files: listings, images, slides, PDF glyphs, dumped trees and scenes, saved pages."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EMU = 12700.0


def listing(spark: SparkSession, folder: str, exts: list[str] = ("png", "jpg", "jpeg", "bmp", "gif"), most: int = 200) -> DataFrame:
    """path, length of the folder's files with these endings: sorted, the first `most` (a limit that is the feature)."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(exts) + "}").load(folder)
    return d.select("path", "length").orderBy("path").limit(most)


def png(data: bytes) -> tuple[int, int, bytes]:
    """(w, h, RGB bytes) of an 8-bit, not interlaced PNG; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, head, body, table = 8, None, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            table = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    w, h, depth, kind, _, _, laced = head
    if depth != 8 or laced:
        raise ValueError("only 8-bit PNGs without interlacing")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    last = np.zeros(w * bands, np.uint8)
    for y in range(h):
        how, row = raw[y, 0], raw[y, 1:].copy()
        if how == 2:
            row += last
        elif how in (1, 3, 4):
            for i in range(w * bands):
                a = int(row[i - bands]) if i >= bands else 0
                b, c = int(last[i]), int(last[i - bands]) if i >= bands else 0
                if how == 4:
                    p = a + b - c
                    pick = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    pick = a if how == 1 else (a + b) // 2
                row[i] = (int(row[i]) + pick) & 255
        out[y] = last = row
    px = out.reshape(h, w, bands)
    rgb = table[px[..., 0]] if kind == 3 else px[..., :3] if bands >= 3 else px[..., :1].repeat(3, 2)
    return w, h, np.ascontiguousarray(rgb).tobytes()


def images(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """image_id (a hash of the path), path, w, h, data (RGB). Spark's reader gives BGR, which is
    turned; what it can't decode goes through `png`. With errors, files that neither reads are rows
    with `error` and no data; else they are left out."""
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rgb = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(h, w, n)[..., :3][..., ::-1] if n >= 3 else np.frombuffer(x, np.uint8).reshape(h, w, 1).repeat(3, 2)).tobytes() for x, w, h, n in zip(f.data, f.width, f.height, f.nChannels, strict=True)]
            yield pd.DataFrame({"path": f.origin, "w": f.width, "h": f.height, "data": rgb, "error": None})

    def other(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for at, content in zip(f.path, f.content, strict=True):
                try:
                    rows.append((at, *png(content), None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError) as e:
                    rows.append((at, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "data", "error"]).astype({"w": "Int32", "h": "Int32"})

    kind = "path string, w int, h int, data binary, error string"
    read = d.mapInPandas(turn, kind)
    rest = spark.read.format("binaryFile").load(path).join(d.select(F.col("origin").alias("path")), "path", "left_anti").select("path", "content").mapInPandas(other, kind)
    out = read.unionByName(rest).select(F.xxhash64("path").alias("image_id"), "path", "w", "h", "data", "error")
    return out if errors else out.where("error IS NULL").drop("error")


_A, _P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def pptx_shapes(data: bytes, slide: int | None = None) -> list[tuple]:
    """(slide, slide_w, slide_h, shape_id, parent_id, depth, name, type, x, y, w, h, rotation, fill, runs) of a file."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        size = ElementTree.fromstring(z.read("ppt/presentation.xml")).find(f"{_P}sldSz")
        sw, sh = (float(size.get(k)) / EMU for k in ("cx", "cy")) if size is not None else (None, None)
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in names:
            if slide is not None and number != slide:
                continue
            todo = [(c, None, 0) for c in reversed(list(ElementTree.fromstring(z.read(name)).iter(f"{_P}spTree").__next__()))]
            while todo:
                node, parent, depth = todo.pop()
                kind = node.tag.replace(_P, "")
                if kind not in ("sp", "pic", "grpSp", "graphicFrame", "cxnSp"):
                    continue
                prop = next(node.iter(f"{_P}cNvPr"), None)
                sid = int(prop.get("id", "0")) if prop is not None else 0
                place = next((c for c in node.iter() if c.tag in (f"{_A}xfrm", f"{_P}xfrm")), None)
                off, ext = (place.find(f"{_A}off"), place.find(f"{_A}ext")) if place is not None else (None, None)
                num = lambda e, k: float(e.get(k)) / EMU if e is not None else None
                spot = node.find(f"{_P}spPr/{_A}solidFill/{_A}srgbClr")
                runs = []
                if kind != "grpSp":
                    for r in node.iter(f"{_A}r"):
                        p = r.find(f"{_A}rPr")
                        color = r.find(f"{_A}rPr/{_A}solidFill/{_A}srgbClr")
                        face = r.find(f"{_A}rPr/{_A}latin")
                        points = p.get("sz") if p is not None else None
                        runs.append(((r.findtext(f"{_A}t") or "")[:120], float(points) / 100 if points else None, p is not None and p.get("b") in ("1", "true"), "#" + color.get("val") if color is not None else None, face.get("typeface") if face is not None else None))
                out.append((number, sw, sh, sid, parent, depth, prop.get("name") if prop is not None else None, kind, num(off, "x"), num(off, "y"), num(ext, "cx"), num(ext, "cy"), float(place.get("rot", "0")) / 60000 if place is not None else 0.0, "#" + spot.get("val") if spot is not None else None, runs))
                if kind == "grpSp":
                    todo += [(c, sid, depth + 1) for c in reversed(list(node))]
    return out


def pptx(spark: SparkSession, path: str, slide: int | None = None) -> DataFrame:
    """Shapes of slide files, a row each, with their place in the group tree."""
    cols = "slide int, slide_w double, slide_h double, shape_id long, parent_id long, depth int, name string, type string, x double, y double, w double, h double, rotation double, fill string, runs array<struct<text:string,size_pt:double,bold:boolean,color:string,font:string>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["report_id", *[c.strip().split(" ")[0] for c in re.split(r",\s(?=\w+ )", cols)]]
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, data in zip(f.path, f.content, strict=True) for r in pptx_shapes(data, slide)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "report_id string, " + cols)


def page_range(text: str, pages: int) -> tuple[int, int]:
    """"lo-hi", "n" or "all", from 1, both ends in, held inside the document; an empty range is an error."""
    if text == "all":
        return 1, pages
    lo, _, hi = text.partition("-")
    a, b = max(1, int(lo)), min(pages, int(hi or lo))
    if a > b:
        raise ValueError(f"no page in {text}")
    return a, b


def glyph_lines(glyphs: DataFrame, tol: float = 2.0) -> DataFrame:
    """glyphs (file, page, page_h, ord, x, y, w, h, char; y up) -> lines with boxes in page
    coordinates (y down): in order of ord, glyphs join the first line whose first glyph is at most
    tol away; line ends are no glyphs; lines are read by x, trimmed, and left out if blank. Pages
    are dealt and streamed; a page's glyphs are one task's work."""
    from ..operators.groups import per_group

    def one(key, c):
        lines: list[list[int]] = []
        first: list[float] = []
        for i, y in enumerate(c["y"]):
            k = next((k for k, f in enumerate(first) if abs(f - y) <= tol), len(first))
            if k == len(first):
                first.append(y)
                lines.append([])
            lines[k].append(i)
        n = 0
        for line in lines:
            line.sort(key=lambda i: c["x"][i])
            text = "".join(c["char"][i] for i in line).strip()
            if text:
                high = c["page_h"][line[0]]
                yield (*key, n, text[:200], min(c["x"][i] for i in line), high - max(c["y"][i] + c["h"][i] for i in line), max(c["x"][i] + c["w"][i] for i in line), high - min(c["y"][i] for i in line))
                n += 1

    d = glyphs.where(~F.col("char").isin("\r", "\n")).select("file", F.col("page").cast("int").alias("page"), "ord", *[F.col(k).cast("double").alias(k) for k in ("page_h", "x", "y", "w", "h")], "char")
    return per_group(d, ["file", "page"], ["ord"], one, "file string, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double")


#: Roles that are interactive without a text.
ROLES = ("entry", "text", "push button", "toggle button", "button", "link", "check box", "combo box", "slider", "radio button", "menu item", "list item", "heading", "paragraph", "label", "image", "table", "row", "cell")


#: Fixed value: what is said of an element that the accessibility tree gives.
CERTAIN = "此元素由 AT-SPI 无障碍树确认（结构级，conf 1.0）"


def interactive(nodes: DataFrame) -> DataFrame:
    """Accessible nodes (type, text, x1..y2) that show and can be used, as perception rows."""
    shown = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    d = nodes.where(shown & ((F.coalesce("text", F.lit("")) != "") | F.col("type").isin(*ROLES)))
    said = F.lit(CERTAIN)
    return d.withColumns({"center": F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), "conf": F.lit(1.0), "sources": F.array(F.lit("a11y")), "assertion": said})


def tree(nodes: DataFrame, depth: int = 14, app: str | None = None, most: int | None = None) -> DataFrame:
    """An adjacency table (app, node_id, parent_id, ord among its siblings, ...) with each node's
    depth and its path, the ords from the root, down to `depth` levels: one join a level, in the plan.
    Ordered by path a tree is read depth first; ord is added as node_id where it is missing. app keeps
    applications whose name holds it, in any case; most, the first nodes of each application."""
    nodes = nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.col("node_id"))
    nodes = nodes if app is None else nodes.where(F.lower("app").contains(app.lower()))
    at = F.col("ord").cast("long")
    level = nodes.where(F.col("parent_id").isNull()).withColumn("depth", F.lit(0)).withColumn("path", F.array(at))
    out = level
    for k in range(1, depth + 1):
        up = level.select("app", F.col("node_id").alias("parent_id"), F.col("path").alias("_up"))
        level = nodes.join(up, ["app", "parent_id"]).select(*nodes.columns, F.lit(k).alias("depth"), F.concat("_up", F.array(at)).alias("path"))
        out = out.unionByName(level)
    if most is None:
        return out
    rank = F.row_number().over(W.partitionBy("app").orderBy("path"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def dom(dump: DataFrame, most: int = 200) -> DataFrame:
    """Saved nodes (page_id, ord, tag, text, x, y, w, h, view_w, view_h): those of two
    pixels or more that reach into the view, largest first, texts cut to 200."""
    from ..operators.raster import top

    seen = (F.col("w") >= 2) & (F.col("h") >= 2) & (F.col("x") < F.col("view_w")) & (F.col("y") < F.col("view_h")) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0)
    d = dump.where(seen).withColumn("area", F.col("w") * F.col("h")).withColumn("text", F.substring("text", 1, 200))
    return top(d, ["page_id"], "area", most)


_SCENE = (
    "objects3d array<struct<name:string,type:string,collection:string,parent:string,bbox3d:array<array<double>>,verts:array<array<double>>,matrix_world:array<double>,"
    "material:string,tris:bigint,visible:boolean,splines:array<array<array<double>>>>>,"
    "cameras array<struct<name:string,location:array<double>,rotation_euler:array<double>,rotation_quaternion:array<double>,sensor_width:double,lens:double,matrix_world:array<double>,is_active:boolean>>"
)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Dumped scenes: a row per object, with its material and, of curves, the splines' points."""
    d = spark.read.option("multiLine", True).schema(_SCENE).json(path)
    return d.select(F.col("_metadata.file_path").alias("scene_id"), F.posexplode("objects3d").alias("ord", "o")).select("scene_id", F.col("ord").cast("long").alias("ord"), "o.*")


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """The cameras of dumped scenes, with their field of view in radians (6 digits) and degrees (4)."""
    from ..functions.boxes import fov

    d = spark.read.option("multiLine", True).schema(_SCENE).json(path)
    d = d.select(F.col("_metadata.file_path").alias("scene_id"), F.posexplode("cameras").alias("ord", "c")).select("scene_id", F.col("ord").cast("long").alias("ord"), "c.*")
    angle = F.when(F.col("lens") > 0, fov(F.col("sensor_width"), F.col("lens"))).otherwise(0.0)
    return d.withColumns({"fov_rad": F.round(angle, 6), "fov_deg": F.round(F.degrees(angle), 4)})


def html_tags(pages: DataFrame) -> DataFrame:
    """page_id, tag, n: opening tags of saved pages."""
    d = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return d.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
