"""One-to-one matching, evidence fusion, entity merging, suppression and clustering.

These algorithms are sequential or globally optimal inside a report, image or set; the
group is one task's work and groups are the parallel unit (groupBy().applyInPandas)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import evidence as E
from .groups import annotate, per_group


def np_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j] of rows of boxes: rounded intersection over unrounded areas."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    meets = (high > low).all(axis=2)
    both = np.where(meets, np.prod(np.maximum(np.rint(high) - np.rint(low), 0), axis=2), 0.0)
    size = lambda x: np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1)
    union = size(a)[:, None] + size(b)[None] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text_similarity(a: str | None, b: str | None) -> float:
    x, y = (a or "").strip().lower(), (b or "").strip().lower()
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.7
    return max(0.0, 1 - levenshtein(x, y) / max(len(x), len(y)))


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row at the least total cost: shortest augmenting paths over a
    square matrix padded with 1e9; -1 for rows left to the padding."""
    rows, cols = cost.shape
    n = max(rows, cols)
    full = np.full((n, n), 1e9)
    full[:rows, :cols] = cost
    u, v = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        dist, back, seen = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, col = start, -1
        while True:
            reach = full[row] - u[row] - v + (dist[col] if col >= 0 else 0.0)
            better = ~seen & (reach < dist)
            dist[better], back[better] = reach[better], col
            col = int(np.argmin(np.where(seen, np.inf, dist)))
            seen[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        far = dist[col]
        done = seen & (dist <= far)
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += far - dist[j]
            v[j] += dist[j] - far
        u[start] += far
        while col >= 0:
            prev = back[col]
            owner[col] = owner[prev] if prev >= 0 else start
            col = prev
    out = [-1] * rows
    for j, i in enumerate(owner):
        if i < rows and j < cols:
            out[i] = j
    return out


BOX = ["x1", "y1", "x2", "y2"]


def match(a: DataFrame, b: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """keys, a_ord, b_ord, iou, sim of the optimal pairs that overlap; cost 1 - IoU - alpha sim.
    a and b: keys, ord, box, text."""
    kinds = dict(a.dtypes)

    def one(key, c):
        mine, other = ([i for i, s in enumerate(c["side"]) if s == k] for k in (0, 1))
        if not mine or not other:
            return []
        at = np.array([c[k] for k in BOX], float).T
        iou = np_iou(at[mine], at[other])
        sim = np.array([[text_similarity(c["text"][i], c["text"][j]) for j in other] for i in mine])
        got = assign(1 - iou - alpha * sim)
        return [(*key, c["ord"][mine[i]], c["ord"][other[j]], float(iou[i, j]), float(sim[i, j])) for i, j in enumerate(got) if j >= 0 and iou[i, j] > 0]

    cols = [*keys, F.col("ord").cast("long").alias("ord"), *BOX, "text"]
    both = a.select(*cols, F.lit(0).alias("side")).unionByName(b.select(*cols, F.lit(1).alias("side")))
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return per_group(both, keys, ["side", "ord"], one, f"{head}, a_ord long, b_ord long, iou double, sim double")


def fuse(a: DataFrame, b: DataFrame, keys: list[str], alpha: float = 0.3) -> DataFrame:
    """Matched pairs with their combined evidence and verdict, then what only one side saw.
    a, b also carry conf and lab (array of three) or null."""
    pairs = match(a, b, keys, alpha)
    side = lambda d, p: d.select(*keys, F.col("ord").alias(f"{p}_ord"), F.col("conf").alias(f"{p}_conf"), F.col("lab").alias(f"{p}_lab"))
    both = pairs.join(side(a, "a"), [*keys, "a_ord"]).join(side(b, "b"), [*keys, "b_ord"])
    gap = F.sqrt(sum((F.col("a_lab")[i] - F.col("b_lab")[i]) * (F.col("a_lab")[i] - F.col("b_lab")[i]) for i in range(3)))
    masses = F.array_compact(
        F.array(
            E.FACTORIES["segment"](F.col("iou")),
            F.when(F.col("a_conf").isNotNull(), E.FACTORIES["detect"](F.col("a_conf"))),
            F.when(F.col("b_conf").isNotNull(), E.FACTORIES["detect"](F.col("b_conf"))),
            F.when(F.col("a_lab").isNotNull() & F.col("b_lab").isNotNull(), E.FACTORIES["color"](gap)),
        )
    )
    d = both.withColumn("masses", masses).withColumn("m", E.fold(F.col("masses"))).withColumn("k", E.most_conflict(F.col("masses")))
    found = d.select(*keys, F.lit("match").alias("type"), "a_ord", "b_ord", E.belief(F.col("m")).alias("belief"), E.plausibility(F.col("m")).alias("plausibility"), F.col("m.u").alias("uncertainty"), E.verdict(F.col("k"), F.col("m")).alias("verdict"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rest = []
    for d, p, q in ((a, "a", "b"), (b, "b", "a")):
        left = d.select(*keys, F.col("ord").alias(f"{p}_ord")).join(pairs, [*keys, f"{p}_ord"], "left_anti")
        rest.append(left.select(*keys, F.lit(f"only_{p}").alias("type"), *([f"{p}_ord", none(f"{q}_ord", "long")] if p == "a" else [none("a_ord", "long"), "b_ord"]), none("belief", "double"), none("plausibility", "double"), none("uncertainty", "double"), F.lit("needs_review").alias("verdict")))
    cast = lambda d: d.withColumn("a_ord", F.col("a_ord").cast("long")).withColumn("b_ord", F.col("b_ord").cast("long"))
    return cast(found).unionByName(cast(rest[0])).unionByName(cast(rest[1]))


def in_order(fused: DataFrame, keys: list[str]) -> DataFrame:
    """What fuse gives, by group and then by the first side's place, what only the second saw last."""
    return fused.orderBy(*keys, F.col("a_ord").asc_nulls_last(), "b_ord")


def _aligned_before(at: list[tuple], i: int, least: float, start: int = 0) -> list[int]:
    """Which of the boxes start..i-1 are aligned with box i: IoU of at least `least`, or the smaller
    box's middle inside the larger."""
    ax1, ay1, ax2, ay2 = at[i]
    size = max(ax2 - ax1, 0) * max(ay2 - ay1, 0)
    out = []
    for j in range(start, i):
        bx1, by1, bx2, by2 = at[j]
        other = max(bx2 - bx1, 0) * max(by2 - by1, 0)
        lx, ly, hx, hy = max(ax1, bx1), max(ay1, by1), min(ax2, bx2), min(ay2, by2)
        both = max(round(hx) - round(lx), 0) * max(round(hy) - round(ly), 0) if hx > lx and hy > ly else 0
        union = size + other - both
        if union > 0 and both / union >= least:
            out.append(j)
        elif other <= size:
            if ax1 <= (bx1 + bx2) / 2 <= ax2 and ay1 <= (by1 + by2) / 2 <= ay2:
                out.append(j)
        elif bx1 <= (ax1 + ax2) / 2 <= bx2 and by1 <= (ay1 + ay2) / 2 <= by2:
            out.append(j)
    return out


def clusters_of(at: list[tuple], min_iou: float) -> list[int]:
    """The cluster of each box, in order: the first one that holds a box aligned with it, else a new one."""
    label: list[int] = []
    n = 0
    if len(at) <= 48:
        for i in range(len(at)):
            k = min((label[j] for j in _aligned_before(at, i, min_iou)), default=n)
            n += k == n
            label.append(k)
        return label
    box, of = np.array(at, float), np.zeros(len(at), int)
    size = np.prod(np.maximum(box[:, 2:] - box[:, :2], 0), axis=1)
    mid = (box[:, :2] + box[:, 2:]) / 2
    inside = lambda p, b: ((p >= b[..., :2]) & (p <= b[..., 2:])).all(axis=-1)
    for i in range(len(at)):
        near = (np_iou(box[i : i + 1], box[:i])[0] >= min_iou) if i else np.zeros(0, bool)
        near |= np.where(size[i] <= size[:i], inside(mid[i], box[:i]), inside(mid[:i], box[i]))
        k = int(of[:i][near].min()) if near.any() else n
        n += k == n
        of[i] = k
    return of.tolist()


def entities(observations: DataFrame, min_iou: float = 0.5, min_conf: float = 0.0) -> DataFrame:
    """Observations (report_id, ord, source, box, text, caption, class, conf, interactive)
    merged to entities: by falling confidence, nulls last, each joins the first entity that holds
    one aligned with it. An entity has the box of its surest observation (the last of equals), the
    text of its surest ocr one, the caption of its first omniparser one and the class of its first
    detect one, or else those of the surest; an unknown confidence counts as evidence of 0.5.
    id numbers what is at or above min_conf; conf is rounded to three digits. Detector rows may
    come as owlv2 with the class in text. Only boxes are handed to Python."""
    d = observations.withColumn("class", F.when((F.col("source") == "owlv2") & F.col("class").isNull(), F.col("text")).otherwise(F.col("class"))).withColumn("source", F.when(F.col("source") == "owlv2", "detect").otherwise(F.col("source")))
    names = ["report_id", "ord", "source", *BOX, "text", "caption", "class", "conf", "interactive"]
    d = d.where(F.col("x1").isNotNull()).select(*[F.col(c).cast("double").alias(c) if c in BOX or c == "conf" else F.col(c).cast("long").alias(c) if c == "ord" else F.col(c) for c in names])

    def one(c):
        return clusters_of(list(zip(*(c[k] for k in BOX), strict=True)), min_iou), range(len(c["x1"]))

    m = annotate(d, ["report_id"], [F.col("conf").desc_nulls_last(), "ord"], BOX, one, "entity long, scan long")
    conf = F.coalesce("conf", F.lit(0.5))
    m = m.withColumn("r", F.struct("scan", "source", F.when(F.col("source") == "ocr", E.FACTORIES["ocr"](conf)).otherwise(E.FACTORIES["detect"](conf)).alias("m"), *BOX, "text", "caption", "class"))
    sure = lambda least: F.struct(F.coalesce("conf", F.lit(least)), "scan")
    of = lambda source, c: F.when(F.col("source") == source, c)
    g = m.groupBy("report_id", "entity").agg(
        F.array_sort(F.collect_list("r")).alias("rs"), F.max_by("r", sure(-1.0)).alias("rep"),
        F.max_by("text", of("ocr", sure(0.0))).alias("said"), F.min_by("caption", of("omniparser", F.col("scan"))).alias("shown"), F.min_by("class", of("detect", F.col("scan"))).alias("kind"),
        F.bool_or(F.coalesce("interactive", F.lit(False))).alias("interactive"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    g = g.withColumn("mass", E.fold(F.transform("rs", lambda r: r["m"]))).where(F.col("mass.c") >= min_conf)
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 + 0.5).cast("long")
    out = g.select(
        "report_id", (F.row_number().over(W.partitionBy("report_id").orderBy("entity")) - 1).cast("long").alias("id"), "entity", *[F.col(f"rep.{c}") for c in BOX],
        F.coalesce("said", "rep.text").alias("text"), F.coalesce("shown", "rep.caption").alias("caption"), F.coalesce("kind", "rep.class").alias("class"),
        (F.floor(F.col("mass.c") * 1000 + 0.5) / 1000).alias("conf"), "interactive", "sources", F.size("rs").alias("n_observations"),
    )
    return out.withColumns({
        "center": F.array(half("x1", "x2"), half("y1", "y2")), "type": F.when(F.col("interactive"), "interactive").otherwise("element"),
        "status": F.when(F.col("conf") >= 0.7, "confirmed").otherwise("uncertain"), "assertion": assertion(F.col("sources"), F.col("conf")),
    })


def assertion(sources, conf):
    """Fixed value: the sentence that says who saw an element and how sure that is."""
    status = F.when(conf >= 0.7, "已确认").otherwise("推测")
    return F.concat(F.lit("此元素由 "), F.array_join(sources, " + "), F.lit(" 检测，conf "), F.regexp_replace(conf.cast("string"), r"\.0$", ""), F.lit("（"), status, F.lit("）"))


def dedup_ratio(n_raw, n_fused):
    return F.when(n_raw > 0, (n_raw - n_fused) / n_raw).otherwise(0.0)


def suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.7, most: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression by falling score, ord on ties."""

    def one(c):
        at, kept = np.array([c[k] for k in BOX], float).T, []
        for i in range(len(at)):
            if most is not None and len(kept) >= most:
                break
            if not kept or np_iou(at[i : i + 1], at[kept]).max() <= threshold:
                kept.append(i)
        chosen = set(kept)
        return [[i in chosen for i in range(len(at))]]

    return annotate(boxes, keys, [F.desc("score"), "ord"], BOX, one, "_kept boolean").where("_kept").drop("_kept")


def greedy_clusters(vectors: DataFrame, keys: list[str], threshold: float = 0.75) -> DataFrame:
    """keys, ord, cluster, sim_to_rep: in order, each vector joins the cluster with the
    best mean similarity above the threshold, else opens one. Sums of members stand for
    the means, so a set of n vectors and c clusters costs n x c products, one set a task."""
    kinds = dict(vectors.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        x = np.stack(rows.embedding.to_list()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=x.copy(), where=norm > 0)
        sums, sizes, first, label = np.zeros((0, x.shape[1])), np.zeros(0), [], []
        for i, v in enumerate(x):
            mean = sums @ v / sizes if len(sizes) else np.zeros(0)
            c = int(np.argmax(mean)) if len(mean) else -1
            if c >= 0 and mean[c] > threshold:
                sums[c] += v
                sizes[c] += 1
            else:
                c = len(sizes)
                sums, sizes = np.vstack([sums, v]), np.append(sizes, 1.0)
                first.append(i)
            label.append(c)
        return pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "ord": rows.ord.to_numpy(), "cluster": label, "sim_to_rep": [float(x[i] @ x[first[c]]) for i, c in enumerate(label)]})

    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return vectors.select(*keys, "ord", "embedding").groupBy(*keys).applyInPandas(one, f"{head}, ord long, cluster long, sim_to_rep double")


def cluster_summary(clustered: DataFrame, keys: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """keys, cluster, size, representative, members (ord, sim_to_rep by falling similarity) and,
    given the vectors (keys, ord, embedding), mean_sim: the mean similarity of two different members,
    1 for a single one. The mean comes from the sums of members, not from pairs."""
    by = [*keys, "cluster"]
    members = F.array_sort(F.collect_list(F.struct((-F.col("sim_to_rep")).alias("far"), "ord")))
    out = clustered.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("representative"), members.alias("_members"))
    out = out.withColumn("members", F.transform("_members", lambda m: F.struct(m["ord"].alias("ord"), (-m["far"]).alias("sim_to_rep")))).drop("_members")
    if vectors is None:
        return out
    x = clustered.select(*by, "ord").join(vectors.select(*keys, "ord", "embedding"), [*keys, "ord"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    x = x.withColumn("_norm", norm).select(*by, F.when(F.col("_norm") > 0, 1.0).otherwise(0.0).alias("_own"), F.posexplode(F.transform("embedding", lambda v: F.when(F.col("_norm") > 0, v.cast("double") / F.col("_norm")).otherwise(0.0))).alias("_dim", "_v"))
    sums = x.groupBy(*by, "_dim").agg(F.sum("_v").alias("_s"), F.sum("_own").alias("_own"))
    square = sums.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_square"), F.max("_own").alias("_own"))
    n = F.col("size")
    mean = F.when(n > 1, (F.col("_square") - F.col("_own")) / (n * (n - 1))).otherwise(1.0)
    return out.join(square, by).withColumn("mean_sim", mean).drop("_square", "_own")


def cluster_metrics(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("size") == 1).alias("n_single"), F.max("size").alias("largest"))
