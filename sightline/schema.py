"""Row types, as DDL. A report is one screenshot, page, slide or scene; elements are its parts."""

ELEMENT = (
    "id: bigint, type: string, bbox: array<double>, text: string, conf: double, "
    "color: struct<fill: string, text: string>, fill: string, "
    "texts: array<struct<text: string, color: string, size_pt: double>>, font: string, z: int, "
    "source: array<string>, coordsys: string"
)
RUN = "text: string, size_pt: double, bold: boolean, color: string, font: string"
SHAPE = (
    "id: bigint, name: string, type: string, pos_pt: array<double>, size_pt: array<double>, rotation: double, fill: string, "
    f"texts: array<struct<runs: array<struct<{RUN}>>>>"
)
SHAPES = f"array<struct<{SHAPE}>>"
SLIDES = f"array<struct<slide: bigint, shapes: {SHAPES}>>"
REPORT = (
    "schema string, task string, sensors array<string>, coordsys string, "
    "source struct<type: string, size_px: array<bigint>, viewport: array<bigint>, slide_size_pt: array<double>>, "
    f"elements array<struct<{ELEMENT}>>, slides {SLIDES}, metrics string, truncated boolean, _corrupt_record string"
)
VERSION = "vision-report/v3"
FINDING = "report_id string, rule string, element_ids array<bigint>, severity string, bbox array<double>, evidence string"
EVENT = "ts timestamp, line string"
OBJECT3D = "scene_id string, ord bigint, name string, type string, collection string, bbox3d array<array<double>>, verts array<array<double>>"
