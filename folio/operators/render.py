"""HTML of blocks, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import PREFIXES, TAILS, escape, highlight_refs, reference_entries, strip

NO_TRANSLATION = "[ПЕРЕВОД НЕ ПОЛУЧЕН]"
BULLETS = "•\\-*►▸‣⁃◦○●▪ 0-9.)"
MAX_TABLE_ROWS = 20
PALETTES = {
    False: {"bg": "#ffffff", "text": "#222222"},
    True: {"bg": "#1b1b1f", "text": "#e4e4e7"},
}


def css(dark: bool = False) -> str:
    """Style element of a palette."""
    p = PALETTES[dark]
    return f"<style>body{{background:{p['bg']};color:{p['text']}}}.container{{max-width:1100px;margin:0 auto}}</style>"


def headings(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_id, anchor, title``: headings numbered through a document.

    Numbers are a page's offset plus the place in the page; the offset is a running sum over one row a page.
    """
    h = blocks.where("type = 'heading'")
    page = Window.partitionBy("doc_id", "page_num").orderBy("block_pos", "block_id")
    per = h.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.col("offset") + F.row_number().over(page) - 1
    return h.join(per, ["doc_id", "page_num"]).select(
        "doc_id", "page_num", "block_id", F.concat(F.lit("h"), at.cast("string")).alias("anchor"), F.coalesce("translation", "text").alias("title")
    )


def render_spans(lines: Column) -> Column:
    """Escaped spans, bold and italic by their bits, lines joined, broken words mended.

    Words are mended at line level, as a regular expression over the marked-up text: to a fixed point by two passes,
    since two breaks never share a word side.
    """
    item = lambda s: F.when(s["flags"].bitwiseAND(2) != 0, F.concat(F.lit("<i>"), _bold(s), F.lit("</i>"))).otherwise(_bold(s))
    row = lambda x: F.concat(F.array_join(F.transform(x["spans"], item), " "), F.lit(" \n"))
    html = F.array_join(F.transform(lines, row), " ")
    tails, prefixes = "|".join(TAILS), "|".join(PREFIXES)
    word, hyphen = r"[A-Za-zÀ-ÿА-Яа-яЁё]", "[-‐‑‒–—―−⁃﹘﹣]"
    gap = r"((?:</[bi]>)?)\s*\n\s*((?:<[bi]>)?)"
    kept = rf"(?i)(?<!{word})((?:{prefixes}|{word}){hyphen}){gap}(?=\p{{Ll}})"
    kept_tail = rf"({word}{hyphen}){gap}(?=(?:{tails}|\p{{Ll}})(?!{word}))"
    glued = rf"({word}{{2}}){hyphen}{gap}(?=\p{{Ll}}{word})"
    for _ in range(2):
        html = F.regexp_replace(html, kept, "$1$2$3")
        html = F.regexp_replace(html, kept_tail, "$1$2$3")
        html = F.regexp_replace(html, glued, "$1$2$3")
    return html


def _bold(s: Column) -> Column:
    t = escape(F.coalesce(s["text"], F.lit("")))
    return F.when(s["flags"].bitwiseAND(1) != 0, F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t)


def table_html(rows: Column, caption: Column, refs: bool = True) -> Column:
    """Table element: the first row is its head; at most 20 rows are shown."""
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), "")
    shown = F.slice(rows, 1, MAX_TABLE_ROWS)
    head = F.concat(F.lit("<thead><tr>"), cells(F.element_at(shown, 1), "th"), F.lit("</tr></thead><tbody>\n"))
    body = F.array_join(F.transform(F.slice(shown, 2, MAX_TABLE_ROWS), lambda r: F.concat(F.lit("<tr>"), cells(r, "td"), F.lit("</tr>\n"))), "")
    title = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit('<div class="table-caption">'), escape(caption), F.lit("</div>\n"))).otherwise("")
    return F.concat(title, F.lit('<div class="table-wrap"><table>\n'), head, body, F.lit("</tbody></table>\n</div>\n"))


def list_html(text: Column) -> Column:
    """Ordered if the first item has a number; markers are cut off."""
    items = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    lis = F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), escape(F.regexp_replace(x, f"^[{BULLETS}]+", "")), F.lit("</li>"))), "")
    tag = F.when(F.substring_index(text, "\n", 1).rlike(r"^\s*\d+[.)]"), "ol").otherwise("ul")
    return F.concat(F.lit("<"), tag, F.lit(' class="list-block">'), lis, F.lit("</"), tag, F.lit(">\n"))


def block_html(translated: bool = True) -> Column:
    """HTML of a block by its type, over type, text, translation, lines, table_data, caption, image, image_ext, page_num, anchor
    (R03; raw: R04). A text is escaped once."""
    orig = F.coalesce("text", F.lit(""))
    shown = F.coalesce("translation", F.lit(NO_TRANSLATION)) if translated else orig
    refs = lambda c: highlight_refs(escape(c))
    spans = F.when(F.col("lines").isNotNull(), highlight_refs(render_spans(F.col("lines")))).otherwise(refs(orig))
    texts = F.transform("lines", lambda x: strip(F.array_join(F.transform(x["spans"], lambda s: s["text"]), " ")))
    entries = reference_entries(texts)
    several = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<p class="ref">'), refs(e), F.lit("</p>\n"))), "")
    anchor = F.coalesce(F.concat(F.lit(' id="'), F.col("anchor"), F.lit('"')), F.lit(""))
    details = lambda c: F.concat(F.lit('<details class="original-block"><summary>Оригинал</summary><p class="orig">'), c, F.lit("</p></details>\n"))
    wrap = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    alt = F.coalesce("caption", F.concat(F.lit("Рисунок "), F.col("page_num").cast("string")))
    image = F.concat(
        F.lit('<figure class="figure"><img src="data:image/'), F.coalesce("image_ext", F.lit("png")), F.lit(";base64,"), F.regexp_replace(F.base64("image"), r"\s", ""), F.lit('" alt="'),
        escape(alt), F.lit('" />'), F.coalesce(wrap('<figcaption class="figure-caption">', escape(F.col("caption")), "</figcaption>"), F.lit("")), F.lit("</figure>\n"),
    )
    differs = (orig != shown) if translated else F.lit(False)
    kind, rows = F.col("type"), F.coalesce(F.size("table_data"), F.lit(0))
    return (
        F.when(kind == "empty", "")
        .when(kind == "reference_heading", wrap('<div class="ref-section"><h2>', refs(shown), "</h2></div>\n"))
        .when((kind == "reference") & (F.coalesce(F.size(entries), F.lit(0)) > 1), several)
        .when(kind == "reference", wrap('<p class="ref">', refs(shown), "</p>\n"))
        .when((kind == "metadata") & differs, F.concat(wrap('<div class="meta">', refs(shown), "</div>"), details(refs(orig))))
        .when(kind == "metadata", wrap("<div class='meta'>", refs(orig), "</div>\n"))
        .when((kind == "table") & (rows > 0), table_html(F.col("table_data"), F.col("caption")))
        .when((kind == "table") & (strip(orig) != ""), wrap('<div class="table-wrap"><pre class="table-pre">', escape(orig), "</pre></div>\n"))
        .when((kind == "figure") & F.col("image").isNotNull(), image)
        .when(kind == "figure", '<p class="orig">(Изображение не извлечено)</p>\n')
        .when((kind == "heading") & differs, F.concat(F.lit('<div class="trans-head"'), anchor, F.lit('><p class="orig">'), spans, F.lit("</p><h3>"), refs(shown), F.lit("</h3></div>\n")))
        .when(kind == "heading", F.concat(F.lit('<div class="trans-head"'), anchor, F.lit("><h3>"), refs(shown), F.lit("</h3></div>\n")))
        .when(kind == "list", list_html(orig))
        .when(differs, F.concat(wrap('<p class="trans">', refs(shown), "</p>"), details(spans)))
        .otherwise(wrap("<p>", spans if not translated else refs(shown), "</p>\n"))
    )


def page_html(blocks: DataFrame, translated: bool = True) -> DataFrame:
    """``doc_id, page_num, html``: a page's blocks in order in a details element."""
    anchors = headings(blocks).select("block_id", "anchor")
    b = blocks.join(anchors, "block_id", "left").withColumn("html", block_html(translated))
    pages = b.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "html"))).alias("hs"))
    body = F.array_join(F.transform("hs", lambda x: x["html"]), "")
    return pages.select(
        "doc_id", "page_num", F.concat(F.lit('<details class="page" open><summary>Страница '), F.col("page_num").cast("string"), F.lit("</summary>\n"), body, F.lit("</details>\n")).alias("html")
    )


def summary_originals(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_id, html``: rendered originals of the five text types longer than 40 characters."""
    kept = blocks.where(F.col("type").isin("paragraph", "heading", "metadata", "text", "list"))
    html = F.when(F.col("lines").isNotNull(), render_spans(F.col("lines"))).otherwise("")
    return kept.select("doc_id", "page_num", "block_id", html.alias("html")).where("length(html) > 40")


def write_html(pages: DataFrame, path: str) -> None:
    """One folder for each document with its pages in order, as text (S13, S14). A document is written page by page by
    range, never joined in memory."""
    ordered = pages.repartitionByRange("doc_id", "page_num").sortWithinPartitions("doc_id", "page_num")
    ordered.select("doc_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
