"""Figures: duplicates, clusters, captions, and the text that belongs to them. All joins are within a page."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import predicates as P
from folio.functions.text import join_lines, line_text, strip

#: Set by a plug-in: (document, page, rectangle, dots an inch) -> PNG bytes, or None where that fails.
RENDERER: Callable[[int, int, tuple[float, float, float, float], int], bytes | None] | None = None

CAPTION_DISTANCE = 120.0


def _same_page(a: str, b: str):
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page_num") == F.col(f"{b}.page_num"))


def overlaps(blocks: DataFrame, figures: DataFrame, least: float = 0.0) -> DataFrame:
    """``block_id, figure_id, ratio``: blocks and figures of a page that share area, with the share of the block."""
    f = figures.select("doc_id", "page_num", F.col("block_id").alias("figure_id"), F.col("bbox").alias("figure_box")).alias("f")
    b = blocks.alias("b")
    ratio = G.overlap_ratio(F.col("b.bbox"), F.col("f.figure_box"))
    on = _same_page("b", "f") & (F.col("b.block_id") != F.col("f.figure_id")) & (F.col("b.bbox.x0") < F.col("f.figure_box.x1"))
    on = on & (F.col("f.figure_box.x0") < F.col("b.bbox.x1")) & (F.col("b.bbox.y0") < F.col("f.figure_box.y1")) & (F.col("f.figure_box.y0") < F.col("b.bbox.y1"))
    return b.join(f, on).select("b.block_id", "figure_id", ratio.alias("ratio")).where(F.col("ratio") > least)


def nearest_captions(figures: DataFrame, candidates: DataFrame, limit: float = CAPTION_DISTANCE) -> DataFrame:
    """``figure_id, caption_id, gap``: the nearest candidate of the page nearer than ``limit``, the first on ties.

    Captions may serve several figures here; :func:`assign_captions` uses each once.
    """
    f, c = figures.alias("f"), candidates.alias("c")
    gap = G.chebyshev_gap(F.col("f.bbox"), F.col("c.bbox"))
    pairs = f.join(c, _same_page("f", "c") & (gap < limit)).select(
        F.col("f.block_id").alias("figure_id"), F.struct(gap.alias("gap"), F.col("c.block_pos").alias("pos"), F.col("c.block_id").alias("id")).alias("best")
    )
    return pairs.groupBy("figure_id").agg(F.min("best").alias("best")).select("figure_id", F.col("best.id").alias("caption_id"), F.col("best.gap").alias("gap"))


def assign_captions(figures: DataFrame, candidates: DataFrame, limit: float = CAPTION_DISTANCE, by_page: bool = False) -> DataFrame:
    """As :func:`nearest_captions`, but in the order of figures and each caption once (J03, greedy; a page is a group).

    ``by_page``: ids of figures are only unique in their page, and the result is ``doc_id, page_num, block_id, caption_id``.
    """
    f, c = figures.alias("f"), candidates.alias("c")
    gap = G.chebyshev_gap(F.col("f.bbox"), F.col("c.bbox"))
    pairs = f.join(c, _same_page("f", "c") & (gap < limit)).select(
        "f.doc_id", "f.page_num", F.col("f.block_pos").alias("fpos"), F.col("f.block_id").alias("figure_id"),
        gap.alias("gap"), F.col("c.block_pos").alias("cpos"), F.col("c.block_id").alias("caption_id"),
    )

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for figure, mine in pdf.sort_values(["fpos", "gap", "cpos", "caption_id"]).groupby("figure_id", sort=False):
            for row in mine.itertuples():
                if row.caption_id not in used:
                    used.add(row.caption_id)
                    out.append((figure, row.caption_id, row.gap))
                    break
        return pd.DataFrame(out, columns=["figure_id", "caption_id", "gap"])

    if not by_page:
        return pairs.groupBy("doc_id", "page_num").applyInPandas(greedy, "figure_id bigint, caption_id bigint, gap double")

    def placed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy(pdf)
        return pd.DataFrame({"doc_id": key[0], "page_num": key[1], "block_id": out["figure_id"], "caption_id": out["caption_id"]})

    return pairs.groupBy("doc_id", "page_num").applyInPandas(placed, "doc_id bigint, page_num int, block_id bigint, caption_id bigint")


def lines_in_figures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """``block_id, line_no`` of lines that belong to a figure: covered to 0.6, centred in it, or an axis label at its
    edge (J05). ``lines`` has doc_id, page_num, block_id, line_no, bbox, text; captions are never lines of a figure."""
    x, f = lines.alias("l"), figures.select("doc_id", "page_num", F.col("bbox").alias("fb")).alias("f")
    box, fb = F.col("l.bbox"), F.col("f.fb")
    edge = (G.chebyshev_gap(box, fb) <= 14) & (G.x_overlap(box, fb) >= F.greatest(F.lit(1.0), box["x1"] - box["x0"]) * 0.5)
    drop = (G.overlap_ratio(box, fb) >= 0.6) | G.center_inside(box, fb) | (P.looks_like_axis_label(F.col("l.text")) & edge)
    return x.join(f, _same_page("l", "f") & drop, "left_semi").select("block_id", "line_no").distinct()


def remove_figure_text(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks without the lines that belong to a figure of their page (J04, J06): ``block_id, kept, text, bbox`` of those left.

    Captions stay whole; a block that loses no line stays as it is; one that loses some is made anew from the others, and
    goes if that leaves no text; one without lines is a line itself. ``blocks`` has doc_id, page_num, block_id, text, bbox, lines.
    """
    lines = blocks.where(~P.is_caption(F.col("text"))).select(
        "doc_id", "page_num", "block_id", F.posexplode_outer("lines").alias("line_no", "line"), F.col("text").alias("whole"), F.col("bbox").alias("box")
    )
    lines = lines.select(
        "doc_id", "page_num", "block_id", F.coalesce("line_no", F.lit(-1)).alias("line_no"), F.coalesce("line.bbox", "box").alias("bbox"),
        F.coalesce(line_text(F.col("line.spans")), "whole").alias("text"),
    )
    dropped = lines_in_figures(lines, figures).groupBy("block_id").agg(F.collect_set("line_no").alias("_gone"))
    b = blocks.join(dropped, "block_id", "left")
    kept = F.filter(F.col("lines"), lambda x, i: ~F.array_contains("_gone", i))
    rest = F.struct(
        F.size(kept).alias("n"), join_lines(F.transform(kept, lambda x: line_text(x["spans"]))).alias("text"),
        F.when(F.size(kept) > 0, F.aggregate(kept, F.element_at(kept, 1)["bbox"], lambda a, x: G.union(a, x["bbox"]))).alias("bbox"),
    )
    whole = F.col("_gone").isNull()
    b = b.withColumn("_r", F.when(~whole & (F.size("lines") > 0), rest))
    return b.where(whole | (F.col("_r.n") > 0) & (F.col("_r.text") != "")).select(
        "block_id", F.when(whole, F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0))).otherwise(F.col("_r.n")).alias("kept"),
        F.when(whole, F.col("text")).otherwise(F.col("_r.text")).alias("text"), F.when(whole, F.col("bbox")).otherwise(F.col("_r.bbox")).alias("bbox"),
    )


def _apart(a, b):
    return max(0.0, max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3]))


def _area(a):
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def _common(a, b):
    return _area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def distinct_images(images: DataFrame) -> DataFrame:
    """Images (doc_id, page_num, image_pos, xref, bbox, bytes) without duplicates, in order.

    Out go placements under 300 in area and those that a kept one of the page overlaps to 0.7 of the smaller or nearly
    equals, or repeats by content where they share half or touch. Repeated references of one object count once with all
    their placements (rows of one xref and content). Order matters, so a page is a group; it sees boxes and hashes only.
    """
    slim = images.select("doc_id", "page_num", "image_pos", F.xxhash64("bytes").alias("h"), "bbox.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in pdf.sort_values("image_pos").itertuples():
            box = (r.x0, r.y0, r.x1, r.y1)
            if _area(box) < 300:
                continue
            near = lambda k: _common(box, k[1]) / min(_area(box), _area(k[1]))  # noqa: E731, B023
            twin = any(near(k) > 0.7 or (_apart(box, k[1]) < 1 and abs(_area(box) - _area(k[1])) < 0.05 * max(1, _area(box))) for k in kept)
            copy = any(k[0] == r.h and (near(k) > 0.5 or _apart(box, k[1]) < 2) for k in kept)
            if not twin and not copy:
                kept.append((r.h, box, r.image_pos))
        return pdf[pdf["image_pos"].isin([k[2] for k in kept])][["doc_id", "page_num", "image_pos"]]

    first = slim.groupBy("doc_id", "page_num").applyInPandas(run, "doc_id bigint, page_num int, image_pos int")
    return images.join(first, ["doc_id", "page_num", "image_pos"], "left_semi")


def extract_images(images: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures (doc_id, page_num, block_id = image_pos, bbox, caption, caption_id) of the images that are left, each with the
    nearest caption that none before it has, and the texts without the captions used (S05)."""
    kept = distinct_images(images).withColumns({"block_pos": F.col("image_pos"), "block_id": F.col("image_pos").cast("bigint")})
    captions = texts.where(P.is_figure_caption(F.col("text")))
    used = assign_captions(kept, captions, by_page=True)
    named = captions.select("doc_id", "page_num", F.col("block_id").alias("caption_id"), F.col("text").alias("caption"))
    figures = kept.join(used, ["doc_id", "page_num", "block_id"], "left").join(named, ["doc_id", "page_num", "caption_id"], "left")
    rest = texts.join(used.select("doc_id", "page_num", F.col("caption_id").alias("block_id")), ["doc_id", "page_num", "block_id"], "left_anti")
    return figures.select("doc_id", "page_num", "block_id", "bbox", "caption", "caption_id"), rest


def _cluster(boxes: list[tuple], gap: float, merge: bool) -> list[int]:
    """Cluster number of each box in the order given: the first cluster whose union is near enough; then, if wanted,
    clusters whose unions are near are merged until none are."""

    def apart(a, b):
        return max(0.0, max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3]))

    def grown(a, b):
        return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))

    unions, member = [], []
    for box in boxes:
        k = next((k for k, u in enumerate(unions) if apart(u, box) <= gap), None)
        if k is None:
            k = len(unions)
            unions.append(box)
        unions[k] = grown(unions[k], box)
        member.append(k)
    root = list(range(len(unions)))
    changed = merge
    while changed:
        changed = False
        alive = [k for k in range(len(unions)) if root[k] == k]
        for n, a in enumerate(alive):
            for b in alive[n + 1 :]:
                if root[a] == a and root[b] == b and apart(unions[a], unions[b]) <= gap:
                    unions[a], root[b], changed = grown(unions[a], unions[b]), a, True

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    return [find(k) for k in member]


def clusters(rects: DataFrame, gap: float, merge: bool = True) -> DataFrame:
    """``doc_id, page_num, block_id, cluster``: rectangles of a page by nearness, from top left on (W16; merged to a
    fixed point: W17). Order matters, so a page is a group; a cluster's number is the smallest block_id in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "block_id"])
        pdf["c"] = _cluster(list(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), gap, merge)
        pdf["cluster"] = pdf.groupby("c")["block_id"].transform("min")
        return pdf[["doc_id", "page_num", "block_id", "cluster"]]

    flat = rects.select("doc_id", "page_num", "block_id", "bbox.*")
    return flat.groupBy("doc_id", "page_num").applyInPandas(run, "doc_id bigint, page_num int, block_id bigint, cluster bigint")


def composite_figures(figures: DataFrame, pages: DataFrame, gap: float = 35.0) -> DataFrame:
    """``doc_id, page_num, cluster, members, bbox, caption``: clusters of two or more figures that become one (W18), with
    the first caption; not those that span the page or are tiny. Rendering is a plug-in's work."""
    size = pages.groupBy("doc_id", "page_num").agg(F.max("width").alias("pw"), F.max("height").alias("ph"))
    g = figures.join(clusters(figures, gap), ["doc_id", "page_num", "block_id"]).groupBy("doc_id", "page_num", "cluster").agg(
        F.count(F.lit(1)).alias("members"), G.union_agg("bbox").alias("bbox"), F.min_by("caption", F.when(F.col("caption").isNotNull(), F.struct("bbox.y0", "bbox.x0"))).alias("caption")
    )
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    spread = F.coalesce((w > F.col("pw") * 0.85) & (h > F.col("ph") * 0.55), F.lit(False))
    tiny = (w < 30) | (h < 20) | (w * h < 1200)
    return g.join(size, ["doc_id", "page_num"], "left").where((F.col("members") >= 2) & ~spread & ~tiny).drop("pw", "ph")


def label_rows(lines: Column, font_size: Column) -> Column:
    """Visual rows of a block: lines whose middles are nearer than max(2, 0.6 font sizes) share one (S07). At least 1."""
    size = F.when(F.coalesce(font_size, F.lit(0.0)) > 0, font_size).otherwise(10.0)
    tol = F.greatest(F.lit(2.0), size * 0.6)
    middles = F.array_sort(F.transform(lines, lambda x: (x["bbox"]["y0"] + x["bbox"]["y1"]) / 2))
    state = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))
    step = lambda a, y: F.struct((a["n"] + F.when(a["last"].isNull() | (F.abs(y - a["last"]) > tol), 1).otherwise(0)).alias("n"), y.alias("last"))
    return F.greatest(F.coalesce(F.aggregate(middles, state, step)["n"], F.lit(1)), F.lit(1))


def render(rects: DataFrame, dpi: int = 150) -> DataFrame:
    """Adds ``image`` to rows of doc_id, page_num, bbox by the plug-in's renderer; NULL without one or where it fails."""
    renderer = RENDERER
    if renderer is None:
        return rects.withColumn("image", F.lit(None).cast("binary"))

    def run(batches):
        for pdf in batches:
            images = []
            for d, p, x0, y0, x1, y1 in zip(pdf["doc_id"], pdf["page_num"], pdf["_x0"], pdf["_y0"], pdf["_x1"], pdf["_y1"]):
                try:
                    images.append(renderer(d, p, (x0, y0, x1, y1), dpi))
                except Exception:  # noqa: BLE001 - a figure that can't be drawn has no image
                    images.append(None)
            yield pdf[["_id"]].assign(image=images)

    at = rects.withColumn("_id", F.struct("doc_id", "page_num", "bbox")).withColumn("_id", F.xxhash64(F.col("_id")))
    flat = at.select("_id", "doc_id", "page_num", *[F.col(f"bbox.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]).dropDuplicates(["_id"])
    return at.join(flat.mapInPandas(run, "_id bigint, image binary"), "_id", "left").drop("_id")


def vector_figures(drawings: DataFrame, pages: DataFrame, taken: DataFrame, texts: DataFrame, gap: float = 6.0) -> DataFrame:
    """``doc_id, page_num, figure_no, bbox, caption_id, labels``: clusters of drawings that are figures.

    Drawings under 2 points or of the page's size are left out. First those with a caption: large enough, not over a table
    or raster figure (``taken``) by more than 0.4, a free figure caption nearer than 120. Then the others, of 8 points at
    least each way, apart from those found, not under a long text; they need labels, short texts that lie on them or, unless
    they are tiny or strips, near below or above, and grow around them. ``labels`` are texts that leave the flow, as captions
    do. ``texts``: doc_id, page_num, block_id, block_pos, bbox, text, lines, font_size. Order matters, so a page is a group.
    """
    size = pages.groupBy("doc_id", "page_num").agg(F.max("width").alias("pw"), F.max("height").alias("ph"))
    body = texts.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.coalesce("font_size", F.lit(0.0)))).alias("fs"))
    body = body.select("doc_id", "page_num", F.get("fs", F.floor(F.size("fs") / 2).cast("int")).alias("body"))
    t = texts.join(body, ["doc_id", "page_num"], "left")
    label = (strip(F.col("text")) != "") & P.looks_like_figure_label(F.col("text"), label_rows(F.col("lines"), F.col("font_size")), F.coalesce("font_size", F.lit(0.0)), F.coalesce("body", F.lit(0.0)))
    caption = P.is_figure_caption(F.col("text"))
    none = F.lit(None)
    row = lambda df, kind, pos, ident, what: df.select("doc_id", "page_num", F.lit(kind).alias("kind"), pos.cast("bigint").alias("pos"), ident.cast("bigint").alias("id"), F.col("bbox.*"), what.alias("what"))
    what = F.when(caption, "caption").when(label, "label").when(F.length(strip(F.col("text"))) > 80, "long")
    parts = row(drawings, "drawing", F.col("block_id"), F.col("block_id"), none.cast("string")).unionByName(row(taken, "taken", F.lit(0), F.lit(0), none.cast("string")))
    parts = parts.unionByName(row(t, "text", F.col("block_pos"), F.col("block_id"), what)).join(size, ["doc_id", "page_num"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pw, ph = float(pdf["pw"].iloc[0]), float(pdf["ph"].iloc[0])
        boxes = lambda d: list(d[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        wide, high = pdf["x1"] - pdf["x0"], pdf["y1"] - pdf["y0"]
        drawn = pdf[(pdf["kind"] == "drawing") & (wide >= 2) & (high >= 2) & ~((wide > pw * 0.95) & (high > ph * 0.95))].sort_values(["y0", "x0", "id"])
        rects = boxes(drawn)
        groups: dict[int, list] = {}
        for box, k in zip(rects, _cluster(rects, gap, False)):
            groups.setdefault(k, []).append(box)
        unions = [(min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in groups.values()]
        used_up = boxes(pdf[pdf["kind"] == "taken"])
        text = [(r.id, (r.x0, r.y0, r.x1, r.y1), r.what) for r in pdf[pdf["kind"] == "text"].sort_values(["pos", "id"]).itertuples()]
        over = lambda a, b: _common(a, b) / _area(a) if _area(a) else 0.0
        free = [u for u in unions if not any(over(u, x) > 0.4 for x in used_up)]
        strip_like = lambda u: u[2] - u[0] > pw * 0.6 and u[3] - u[1] < ph * 0.15
        large = lambda u: u[2] - u[0] >= 30 and u[3] - u[1] >= 20 and _area(u) >= 1500 and not strip_like(u)
        out, spent = [], set()
        for u in filter(large, free):
            near = [(_apart(u, box), n) for n, (i, box, w) in enumerate(text) if w == "caption" and i not in spent and _apart(u, box) < CAPTION_DISTANCE]
            if near:
                ident = text[min(near)[1]][0]
                spent.add(ident)
                out.append((u, ident, []))
        for u in free:
            if min(u[2] - u[0], u[3] - u[1]) < 8 or any(_apart(u, o[0]) < 1 for o in out):
                continue
            if any(w == "long" and i not in spent and over(box, u) > 0.6 for i, box, w in text):
                continue
            near = (u[0] - 6, u[1] - 6, u[2] + 6, u[3] + 6)
            labels = [(i, box) for i, box, w in text if w == "label" and i not in spent]
            on = [(i, box) for i, box in labels if over(box, near) >= 0.35]
            strong = large(u)
            beside = [
                (i, box) for i, box in labels
                if strong and (i, box) not in on and _apart(box, u) <= 14 and max(0.0, min(box[2], u[2]) - max(box[0], u[0])) >= 0.5 * max(1.0, box[2] - box[0])
            ]
            if not on and not beside:
                continue
            for _, b in on + beside:
                u = (min(u[0], b[0]), min(u[1], b[1]), max(u[2], b[2]), max(u[3], b[3]))
            mine = sorted(i for i, _ in on + beside)
            spent.update(mine)
            out.append((u, None, mine))
        made = [(key[0], key[1], n, *u, c, m) for n, (u, c, m) in enumerate(out)]
        return pd.DataFrame(made, columns=["doc_id", "page_num", "figure_no", "x0", "y0", "x1", "y1", "caption_id", "labels"]).astype({"caption_id": "Int64"})

    found = parts.groupBy("doc_id", "page_num").applyInPandas(run, "doc_id bigint, page_num int, figure_no int, x0 double, y0 double, x1 double, y1 double, caption_id bigint, labels array<bigint>")
    return found.select("doc_id", "page_num", "figure_no", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "caption_id", "labels")
