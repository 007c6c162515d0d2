"""Noise in text from scanned pages (problem 7).

Lines are rows. Running heads are found by masking digits and grouping the confusable-glyph skeletons of
lines at the edges of pages; a head seen once is known by its shape, which is learnt from those that recur. Page
numbers have a constant distance from the page's position. Words of the remaining lines are grouped by skeleton,
and a rare form of a frequent one is misread if the frequent form is supported by the words beside it. Line-end
hyphens are judged by the forms found inside lines; words broken over lines are judged whole. No window or group is
larger than a page, whatever the size of a paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.glyphs import look
from folio.operators.refs import carry_over_pages
from folio.sources.lineage import cut, share

# Glyphs that are read for one another (single ones first, then pairs read as one).
SINGLE = {"e": "c", "f": "t", "i": "l", "1": "l", "0": "o", "5": "s", "b": "h", "9": "g", "н": "и", "п": "и", "л": "и", "щ": "ш", "8": "в", "6": "б", "3": "з"}
ONLY_CYRILLIC = {"m": "т", "n": "и"}
DOUBLE = {"ы": "ьl", "cl": "d", "rn": "m", "rl": "n", "ll": "u", "vv": "w"}
HYPHENS = r"[-‐‑­¬]"
MISREAD_DIGITS = "0156893"
#: A head is on so many pages of a paper (two if it looks like a title); a page number agrees with so many others.
HEAD_PAGES, NUMBER_PAGES = 3, 3
#: A form is misread if the frequent form of its skeleton is so many times as frequent, and at least so frequent.
RATIO, FREQUENT = 8, 5
#: Letters of a form that its neighbours alone may show to be misread; a telling neighbour is beside so many forms at
#: most, or one in so many of all.
TWIN, TELLING, TELLING_SHARE = 5, 5, 100
#: Lines at the top and at the bottom of a page that may be furniture.
EDGE = 3
#: A paper has so many heads at most that aren't titles; where more lines recur, its pages are copies of one another.
PLAIN_HEADS = 2
#: Heads that recur must have had the shape of a title seen once so often, and be so much of all titles of that shape.
SHAPE_HEADS, SHAPE_SHARE = 3, 0.5
#: Fixed value: words for a page beside its number.
_PAGE = "(?:page|p|seite|s|стр|с|pag|pág)"
_ENDS = r"[.!?…:;。！？][\"'”»)\]]*\s*$"


def skeleton(text: Column, cyrillic: Column) -> Column:
    """Confusable-glyph skeleton of small-letter text: equal for a word and its misread forms."""
    s = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    s = F.when(cyrillic, F.translate(s, "".join(ONLY_CYRILLIC), "".join(ONLY_CYRILLIC.values()))).otherwise(s)
    for a, b in DOUBLE.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def scan_lines(blocks: DataFrame) -> DataFrame:
    """One row for each printed line: ``doc_id, lang, page_num, block_pos, block_id, line_no, line`` and its place
    on the page from the top (``top``) and the bottom (``bottom``), from 1."""
    texts = F.transform("lines", lambda x: F.trim(F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), " ")))
    lines = blocks.where("lines IS NOT NULL").select(
        "doc_id", "lang", "page_num", "block_pos", "block_id", F.posexplode(texts).alias("line_no", "line")
    )
    page = Window.partitionBy("doc_id", "page_num").orderBy("block_pos", "block_id", "line_no")
    whole = Window.partitionBy("doc_id", "page_num")
    return (
        lines.where("line <> ''").withColumn("top", F.row_number().over(page))
        .withColumn("bottom", F.count(F.lit(1)).over(whole) - F.col("top") + 1)
    )


def furniture(lines: DataFrame, edge_lines: int = EDGE) -> DataFrame:
    """``block_id, line_no, kind`` (runhead or pagenum) of the lines that aren't running text."""
    edge = lines.where(f"top <= {edge_lines} OR bottom <= {edge_lines}").withColumn("low", look(F.lower(F.col("line"))))
    low, digits = F.col("low"), F.translate("low", "olі", "011")
    number_only = r"^[^\p{L}\d]*(?:(?:page|p|seite|s|стр|c|с|pag|pág)\b[. ]*)?([\doli]{1,5})(?:\s*(?:/|of|von|из|de|sur)\s*\d+)?[^\p{L}\d]*$"
    edge = edge.select(
        "doc_id", "page_num", "block_id", "line_no", "line", "top", "bottom", "low", F.regexp_extract(low, number_only, 1).alias("alone"),
        F.regexp_extract(digits, r"^\W*(\d{1,5})\b", 1).alias("lead"), F.regexp_extract(digits, r"\b(\d{1,5})\W*$", 1).alias("tail"),
    )
    edge = edge.withColumn("alone", F.when(F.col("alone").rlike(r"\d"), F.translate("alone", "oli", "011")))
    page = F.col("page_num")
    masked = F.regexp_replace("low", rf"(?:\b{_PAGE}[. ]*)?(?<![\p{{L}}\d])\d+(?![\p{{L}}\d])|[^\p{{L}}\d]+", " ")
    edge = edge.withColumn("key", skeleton(F.regexp_replace(masked, " +", ""), F.col("low").rlike("[а-я]{2}")))
    bare = F.regexp_replace("line", rf"(?i)\b{_PAGE}[. ]*\d+", "")
    named = F.filter(F.split(bare, r"[^\p{L}\d]+"), lambda w: (F.length(w) > 3) & w.rlike(r"\p{L}"))
    words, titled = F.size(named), F.size(F.filter(named, lambda w: w.rlike(r"^\d?\p{Lu}")))
    edge = edge.withColumn("title", (words > 0) & (titled >= words) & ~F.col("line").rlike(r"(?<!al|a1|a]|др|и)[.!?:;,]\s*$"))
    # A title's shape: capitalised words and numbers masked, other words by their skeleton.
    shape = F.regexp_replace(F.regexp_replace(look(bare), r"\d?\p{Lu}[\p{L}\d]*", "X"), r"(?<!\p{L})\d+(?!\p{L})", "#")
    shape = F.trim(F.regexp_replace(skeleton(F.lower(shape), F.col("low").rlike("[а-я]{2}")), r"[^\p{L}#]+", " "))
    edge = cut(edge.withColumn("shape", F.when(F.col("title"), shape)).drop("line", "low"))  # every count below reads it
    # The page number less the page's position, where lines agree on it.
    seen = edge.select("doc_id", "page_num", F.explode(F.array_distinct(F.array_compact(F.array(*[
        F.when(F.col(c) != "", F.col(c).cast("int")) for c in ("alone", "lead", "tail")])))).alias("n"))
    offsets = (
        seen.groupBy("doc_id", (F.col("n") - page).alias("off")).agg(F.countDistinct("page_num").alias("pages"))
        .where(f"pages >= {NUMBER_PAGES}").groupBy("doc_id").agg(F.max_by("off", F.struct("pages", -F.col("off"))).alias("off"))
    )
    heads = edge.where("length(key) >= 5 AND coalesce(alone, '') = ''").groupBy("doc_id", "key").agg(
        F.countDistinct("page_num").alias("pages"), F.count_if("title").alias("titles")
    )
    plain = heads.where(f"pages >= {HEAD_PAGES} AND titles * 2 < pages").groupBy("doc_id").agg(F.count(F.lit(1)).alias("plain"))
    sizes = edge.groupBy("doc_id").agg(F.countDistinct("page_num").alias("paper_pages"))
    papers = sizes.join(offsets, "doc_id", "left").join(plain, "doc_id", "left")
    judged = edge.join(papers, "doc_id").join(heads, ["doc_id", "key"], "left")
    fits = lambda c: F.coalesce(F.col(c).try_cast("int") - page == F.col("off"), F.lit(False))
    numbered = fits("lead") | fits("tail")
    often = F.coalesce(F.col("pages"), F.lit(0))
    # A line of any kind that stands at the edge of most pages of a paper is a head; a title needs two pages or its page's number.
    recurs = (F.length("key") >= 5) & F.when(F.col("title"), (often >= 2) | numbered).otherwise(
        (often >= HEAD_PAGES) & ((F.col("titles") * 2 >= often) | ((often * 2 > F.col("paper_pages")) & (F.col("plain") <= PLAIN_HEADS)))
    )
    judged = share(judged.select("block_id", "line_no", "top", "bottom", "alone", "key", "shape", "title", fits("alone").alias("is_number"), recurs.alias("recurs")))
    known = judged.where("title AND coalesce(alone, '') = ''").groupBy("shape").agg(F.count_if("recurs").alias("heads"), F.count(F.lit(1)).alias("all"))
    known = known.where(f"heads >= {SHAPE_HEADS} AND heads >= {SHAPE_SHARE} * all").select("shape", F.lit(True).alias("known"))
    outer = F.least("top", "bottom") <= 2
    once = F.col("title") & (F.length("key") >= 5) & F.coalesce("known", F.lit(False)) & outer
    kind = F.when(F.col("is_number"), F.lit("pagenum")).when(F.coalesce(F.col("alone"), F.lit("")).eqNullSafe("") & (F.col("recurs") | once), F.lit("runhead"))
    return judged.join(known, "shape", "left").select("block_id", "line_no", kind.alias("kind")).where("kind IS NOT NULL")


def running(lines: DataFrame, noise: DataFrame) -> DataFrame:
    """Lines of running text with the line that follows in the paper (``after, after_block, after_no``), over page borders
    as well. ``ends``: it ends with a hyphen and another follows; ``cont``: the line before does; ``open``: the line before is
    of another block and ends no sentence, and this one goes on with a small letter."""
    text = lines.join(noise, ["block_id", "line_no"], "left_anti")
    page = Window.partitionBy("doc_id", "page_num").orderBy("top")
    at = F.struct("line", "block_id", "line_no")
    edges = text.groupBy("doc_id", "page_num").agg(F.min_by(at, "top").alias("first"), F.max_by(at, "top").alias("last"))
    none = F.lit(None).cast(edges.schema["first"].dataType)
    edges = edges.select("doc_id", (F.col("page_num") - 1).alias("page_num"), F.col("first").alias("next"), none.alias("previous")).unionByName(
        edges.select("doc_id", (F.col("page_num") + 1).alias("page_num"), none.alias("next"), F.col("last").alias("previous"))
    )
    edges = edges.groupBy("doc_id", "page_num").agg(F.max_by("next", F.col("next").isNotNull()).alias("next"), F.max_by("previous", F.col("previous").isNotNull()).alias("previous"))
    text = text.withColumns({"n": F.lead(at).over(page), "p": F.lag(at).over(page)}).join(edges, ["doc_id", "page_num"], "left")
    n, p = F.coalesce("n", "next"), F.coalesce("p", "previous")
    opens = (p["block_id"] != F.col("block_id")) & ~p["line"].rlike(_ENDS) & F.col("line").rlike(r"^\P{L}{0,2}\p{Ll}")
    return text.select(
        "doc_id", "lang", "page_num", "block_pos", "block_id", "line_no", "line", "top", n["line"].alias("after"), n["block_id"].alias("after_block"),
        n["line_no"].alias("after_no"), (F.col("line").rlike(HYPHENS + "$") & n.isNotNull()).alias("ends"),
        F.coalesce(p["line"].rlike(HYPHENS + "$"), F.lit(False)).alias("cont"), F.coalesce(opens, F.lit(False)).alias("open"),
    )


def _parts(token: Column) -> Column:
    return F.filter(F.split(token, r"[-‐‑/'’]"), lambda p: p != "")


def _words_of(clean: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(clean, r"[^\p{L}\p{M}\d\-‐‑'’/,.]+", " "), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\d]+|[^\p{L}\d]+$", ""))


def tokens(text: DataFrame) -> DataFrame:
    """Word parts of running lines in small letters, with the parts before and after them. Words broken over lines are left
    out, both halves: :func:`end_words` has them whole."""
    clean = look(F.lower(F.col("line")))
    clean = F.regexp_replace(clean, rf"\S+{HYPHENS}$", " ")
    clean = F.when(F.col("cont"), F.regexp_replace(clean, r"^\s*\S+", " ")).otherwise(clean)
    row = text.select("lang", "block_id", "line_no", _words_of(clean).alias("ws"))
    item = F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.get("ws", i - 1).alias("before"), F.get("ws", i + 1).alias("next")))
    row = row.select("lang", "block_id", "line_no", F.explode(item).alias("t")).select("lang", "block_id", "line_no", "t.*")
    return row.withColumn("form", F.explode(_parts(F.col("w")))).where(r"length(form) >= 2 AND form rlike '\\p{L}'")


_CYRILLIC = r"lang IN ('ru', 'uk') OR form rlike '[бвгджзийклмнптфцчшщъыьэюя]'"
#: Words in letters that only Latin script has are counted over all languages: names are the same in each.
_POOL = "CASE WHEN form rlike '[bdfgklrtuvz]' AND NOT form rlike '[бвгджзийклмнптфцчшщъыьэюя]' THEN '' ELSE lang END"


def supported_twins(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, form, right``: forms whose neighbours show them to be a commoner clean form of their skeleton, at any ratio.

    Half of the neighbours, by occurrence, must be beside the right form too, on the same side, and one of them
    must tell something: it is not beside many forms as an article is. Counts are of the pool of :data:`_POOL`.
    """
    pooled = share(counts.withColumn("pool", F.expr(_POOL)))
    forms = pooled.groupBy(F.col("pool").alias("lang"), "form").agg(F.sum("n").alias("n"))
    sizes = forms.groupBy("lang").agg(F.count(F.lit(1)).alias("forms"))
    clean = ~F.col("form").rlike(rf"[{MISREAD_DIGITS}]")
    best = F.max(F.when(clean, F.struct("n", "form"))).over(Window.partitionBy("lang", "skeleton"))
    forms = forms.withColumn("skeleton", skeleton(F.col("form"), F.expr(_CYRILLIC))).withColumn("best", best)
    twins = forms.where(clean & (F.col("form") != F.col("best.form")) & (F.col("n") < F.col("best.n")) & (F.length("form") >= TWIN))
    twins = twins.select("lang", "form", F.col("best.form").alias("right"))
    both = F.array_compact(F.array(F.when(F.col("before") != "", F.concat(F.lit("<"), "before")), F.when(F.col("next") != "", F.concat(F.lit(">"), "next"))))
    beside = share(words.where("w = form").select(F.expr(_POOL).alias("lang"), "form", F.explode(both).alias("side")).groupBy("lang", "form", "side").agg(F.count(F.lit(1)).alias("k")))
    sides = beside.join(twins, ["lang", "form"])
    there = beside.select("lang", F.col("form").alias("right"), "side", F.lit(True).alias("there"))
    spread = beside.groupBy("lang", "side").agg(F.count(F.lit(1)).alias("beside"))
    seen = sides.join(there, ["lang", "right", "side"], "left").join(spread, ["lang", "side"]).join(sizes, "lang")
    telling = F.col("there") & (F.col("beside") <= F.greatest(F.lit(TELLING), F.col("forms") / TELLING_SHARE))
    judged = seen.groupBy("lang", "form", "right").agg(
        F.sum("k").alias("all"), F.sum(F.when(F.col("there"), F.col("k"))).alias("held"), F.max(F.coalesce(telling, F.lit(False))).alias("telling")
    )
    held = judged.where("telling AND 2 * held >= all").select(F.col("lang").alias("pool"), "form", "right")
    return pooled.join(held, ["pool", "form"]).select("lang", "form", "right")


def misread(words: DataFrame) -> DataFrame:
    """``lang, form, right``: misread forms and the form they stand for (NULL where none is known).

    A window holds the forms of one skeleton of a language. The right form must be supported by context: seen
    beside a word that the misread form is beside, on the same side. Where counts don't decide, because a form is
    rare or often misread, :func:`supported_twins` asks for more of the context.
    """
    counts = words.groupBy("lang", "form").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("skeleton", skeleton(F.col("form"), F.expr(_CYRILLIC))))
    group = Window.partitionBy("lang", "skeleton")
    clean = ~F.col("form").rlike(rf"[{MISREAD_DIGITS}]")
    best = F.max(F.when(clean, F.struct("n", "form"))).over(group)
    joined = counts.withColumn("best", best).select("lang", "form", "n", F.col("best.form").alias("right"), F.col("best.n").alias("most"))
    digit = F.col("form").rlike(rf"^\p{{Ll}}*[{MISREAD_DIGITS}]\p{{Ll}}*$") & (F.length("form") >= 3)
    mixed = F.col("form").rlike("[бвгджзийклмнптфцчшщъыьэюя]") & F.col("form").rlike(".[mn]")
    rare = (F.col("form") != F.col("right")) & (F.col("most") >= FREQUENT) & (F.col("most") >= RATIO * F.col("n")) & (F.length("form") >= 3)
    odd = (digit & (F.col("right").isNotNull() | (F.length("form") >= 5))) | (mixed & (F.length("form") >= 3))
    found = share(joined.where(rare | odd).select("lang", "form", F.when(F.col("right") != F.col("form"), F.col("right")).alias("right"), odd.alias("sure")))
    ends = F.array(F.concat(F.lit("<"), F.coalesce("before", F.lit(""))), F.concat(F.lit(">"), F.coalesce("next", F.lit(""))), F.when(F.col("w") != F.col("form"), F.lit("-")))
    sides = words.select("lang", "form", F.explode(F.when(F.col("w") == F.col("form"), F.slice(ends, 1, 2)).otherwise(F.slice(ends, 3, 1))).alias("side")).distinct()
    wanted = sides.join(found.where("NOT sure"), ["lang", "form"]).select("lang", "form", "right", "side")
    there = sides.withColumnRenamed("form", "right").withColumn("there", F.lit(True))
    # A part of a compound has no neighbours of its own: it needs no support.
    held = wanted.join(there, ["lang", "right", "side"], "left").where("there OR side = '-'").select("lang", "form", "right").distinct()
    counted = found.where("sure").drop("sure").unionByName(held).withColumn("by", F.lit(0))
    both = counted.unionByName(supported_twins(words, counts.drop("skeleton")).withColumn("by", F.lit(1)))
    return both.groupBy("lang", "form").agg(F.min_by("right", F.when(F.col("right").isNotNull(), F.col("by"))).alias("right"))


def broken_words(text: DataFrame, words: DataFrame) -> DataFrame:
    """Lines that end with a hyphen inside or between words: ``lang, block_id, line_no, after_block, after_no``, the word
    parts at both sides (``a, b``) with the words beside them (``before, next``), and ``broken``: it is one word, written
    without hyphen."""
    bare, end, start = F.regexp_replace("line", HYPHENS + "$", ""), F.col("end"), F.col("start")
    beside_end, beside_start = _words_of(end), _words_of(start)
    ends = text.where(F.col("line").rlike(rf"[\p{{L}}\d]{HYPHENS}$") & F.col("after").isNotNull())
    ends = cut(ends.withColumns({"end": look(F.lower(bare)), "start": look(F.lower(F.col("after")))}).select(
        "lang", "block_id", "line_no", "after_block", "after_no",
        F.regexp_extract(end, r"([\p{L}\d]+)$", 1).alias("a"), F.regexp_extract(start, r"^[^\p{L}\d]*([\p{L}\d]+)", 1).alias("b"),
        F.try_element_at(beside_end, F.lit(-2)).alias("before"), F.try_element_at(beside_start, F.lit(2)).alias("next"),
        F.regexp_extract(end, r"(\p{L}+)$", 1).alias("left"), F.regexp_extract(start, r"^[^\p{L}\d]*(\p{L}+)", 1).alias("right"),
        (F.col("after").rlike(r"^\P{L}*\p{Lu}") | bare.rlike(r"(?<!\p{L})\p{Lu}{2,}$") | F.col("after").rlike(r"^\d")).alias("capital"),
    ))
    # Every count that is asked for is one row of one table: words, pairs of compounds, their first and second parts.
    two = F.split("w", "[-‐‑]")
    pairs = F.transform(F.sequence(F.lit(0), F.size(two) - 2), lambda i: F.struct(F.regexp_extract(F.get(two, i), r"(\p{L}+)$", 1).alias("a"), F.regexp_extract(F.get(two, i + 1), r"^(\p{L}+)", 1).alias("b")))
    keys = lambda p: F.array(F.concat(F.lit("p"), p["a"], F.lit("-"), p["b"]), F.concat(F.lit("f"), p["a"]), F.concat(F.lit("s"), p["b"]))
    compound = F.when(F.col("w").rlike(r"\p{L}[-‐‑]\p{L}"), F.flatten(F.transform(pairs, keys))).otherwise(F.array().cast("array<string>"))
    known = words.select("lang", F.explode(F.concat(F.array(F.concat(F.lit("w"), F.col("form"))), compound)).alias("key")).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"))
    # Asked by skeleton, so that a misread half still finds its word.
    cyrillic = F.expr("lang IN ('ru', 'uk') OR key rlike '[бвгджзийклмнптфцчшщъыьэюя]'")
    known = known.groupBy("lang", skeleton(F.col("key"), cyrillic).alias("key")).agg(F.sum("n").alias("n"))
    asked = F.array(*[
        F.concat(F.lit(k), c) for k, c in (
            ("w", F.concat("left", "right")), ("p", F.concat("left", F.lit("-"), "right")), ("f", F.col("left")), ("s", F.col("right")), ("w", F.col("left")), ("w", F.col("right"))
        )
    ])
    names = ("n_joined", "n_pair", "n_first", "n_second", "n_left", "n_right")
    looked = ends.where("left <> '' AND right <> ''").select("block_id", "line_no", "lang", "left", "right", "capital", F.posexplode(asked).alias("i", "key")).withColumn("key", skeleton(F.col("key"), cyrillic)).join(known, ["lang", "key"], "left")
    judged = looked.groupBy("block_id", "line_no", "left", "right", "capital").agg(
        *[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    )
    joined = judged.where(
        """CASE WHEN n_pair > n_joined THEN false
                WHEN n_joined > 0 THEN true
                WHEN n_pair > 0 OR capital THEN false
                WHEN n_first > 0 AND (n_second > 0 OR n_right > 2) THEN false
                WHEN n_second > 0 AND n_left > 2 THEN false
                ELSE true END"""
    ).select("block_id", "line_no", F.lit(True).alias("broken"))
    return ends.drop("left", "right", "capital").join(joined, ["block_id", "line_no"], "left").withColumn("broken", F.coalesce("broken", F.lit(False)))


def end_words(ends: DataFrame) -> DataFrame:
    """Tokens of the words at hyphened line ends, as :func:`tokens` has them: a broken word whole, the parts of a compound.
    ``half`` is the length of a broken word's first part, ``after_block, after_no`` the line of its second."""
    whole = F.concat("a", "b")
    compound = F.concat("a", F.lit("-"), "b")
    nobody = F.lit(None).cast("string")
    tok = lambda block, no, w, form, before, nxt, half: F.struct(
        block.alias("block_id"), no.alias("line_no"), w.alias("w"), before.alias("before"), nxt.alias("next"), form.alias("form"), half.alias("half")
    )
    here, there = (F.col("block_id"), F.col("line_no")), (F.col("after_block"), F.col("after_no"))
    none = F.lit(None).cast("int")
    made = F.when(F.col("broken"), F.array(tok(*here, whole, whole, F.col("before"), F.col("next"), F.length("a")))).otherwise(
        F.array(tok(*here, compound, F.col("a"), nobody, nobody, none), tok(*there, compound, F.col("b"), nobody, nobody, none))
    )
    return ends.select("lang", "after_block", "after_no", F.explode(made).alias("t")).select("lang", "t.*", "after_block", "after_no").where(
        r"length(form) >= 2 AND form rlike '\\p{L}'"
    )


def _read(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Noise, running lines, hyphened line ends, all tokens, and the tokens that are misread with their right form."""
    lines = share(scan_lines(blocks))
    noise = cut(furniture(lines))  # plans of what is persisted nest, which the driver has to hold: these cuts keep them small
    text = cut(running(lines, noise))
    inner = cut(tokens(text))
    ends = cut(broken_words(text, inner))
    none = F.lit(None)
    inner = inner.withColumns({"half": none.cast("int"), "after_block": none.cast("bigint"), "after_no": none.cast("int")})
    words = inner.unionByName(end_words(ends))
    wrong = words.join(cut(misread(words)), ["lang", "form"])
    return noise, text, ends, words, wrong


def find_noise(blocks: DataFrame) -> DataFrame:
    """``block_id, line_no, noise`` of scanned blocks (doc_id, lang, page_num, block_pos, block_id, lines).

    noise: runhead, pagenum, hyphen, ocr; a line of running text may be both of the last. A misread word that is broken
    over two lines is given at the line of its misread half. NULL lines and empty lines give nothing, a NULL language is
    one of its own, a repeated block's lines are judged as often and given once; an empty table gives an empty one.
    """
    noise, _, ends, _, wrong = _read(blocks)
    n, m = F.length("form"), F.length("right")
    same = lambda f: F.size(F.filter(F.sequence(F.lit(1), F.least(n, m)), f))
    ahead = same(lambda i: F.left("form", i) == F.left("right", i))
    behind = same(lambda i: F.right("form", i) == F.right("right", i))
    digit = lambda c: c.rlike(rf"[{MISREAD_DIGITS}]")
    second = F.substring(F.col("form"), F.col("half") + 1, n)
    in_first = F.when(F.col("right").isNull(), digit(F.left("form", F.col("half"))) | ~digit(second)).otherwise(ahead < F.col("half"))
    in_second = F.when(F.col("right").isNull(), digit(second)).otherwise(behind < n - F.col("half"))
    here, there = F.struct("block_id", "line_no"), F.struct(F.col("after_block").alias("block_id"), F.col("after_no").alias("line_no"))
    places = F.when(F.col("half").isNull(), F.array(here)).otherwise(F.array_compact(F.array(F.when(in_first | ~in_second, here), F.when(in_second, there))))
    ocr = wrong.select(F.explode(places).alias("at")).select("at.*", F.lit("ocr").alias("noise"))
    hyphen = ends.where("broken").select("block_id", "line_no", F.lit("hyphen").alias("noise"))
    furnished = noise.select("block_id", "line_no", F.col("kind").alias("noise"))
    return furnished.unionByName(ocr).unionByName(hyphen).distinct()


#: Small letters that both scripts share by look, as :func:`look` has them and as Cyrillic writes them.
_SHARED, _AS_CYRILLIC = "aeopcyxiëï", "аеорсухіёї"


def _written(right: Column, original: Column, lang: Column) -> Column:
    """The right form in the script and case of the original word."""
    cyrillic = right.rlike("[бвгджзийклмнптфцчшщъыьэюя]") | (~right.rlike("[bdfgklqrtuvwzäöüßàâçèéêîñóôú]") & lang.isin("ru", "uk"))
    own = F.when(cyrillic, F.translate(right, _SHARED, _AS_CYRILLIC)).otherwise(right)
    return (
        F.when(~original.rlike(r"\p{Ll}") & original.rlike(r"\p{Lu}.*\p{Lu}"), F.upper(own))
        .when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(own, F.lit(1))), F.substring(own, F.lit(2), F.length(own)))).otherwise(own)
    )


def repair(blocks: DataFrame) -> DataFrame:
    """``block_id, para_id, text``: running text of each scanned block that has any: without furniture, misread words mended
    where the right form is known, in the script and case they are written in, lines reflowed into one.

    A word broken over lines is whole on the line it begins on, and so in the block it begins in, over pages as well; a block
    with nothing else has no row. ``para_id`` is the block in which the block's paragraph begins: one whose last line ends
    no sentence goes on in the next block that begins with a small letter or the rest of a word.
    """
    _, text, ends, _, wrong = _read(blocks)
    fixes = cut(wrong.where("right IS NOT NULL AND form <> right").groupBy("block_id", "line_no").agg(F.collect_set(F.struct("form", "right")).alias("fixes")))
    broken = ends.where("broken").select("block_id", "line_no", F.lit(True).alias("broken"))
    row = text.join(fixes, ["block_id", "line_no"], "left").join(broken, ["block_id", "line_no"], "left")
    # The first chunk of a line after a hyphen stands at the end of the line before.
    own = F.when(F.col("cont"), F.regexp_replace("line", r"^\s*\S+\s*", "")).otherwise(F.col("line"))
    chunk = F.regexp_extract("after", r"^\s*(\S+)", 1)
    hyphen = F.when(F.col("broken"), F.lit("")).otherwise(F.lit("-"))
    own = F.when(F.col("ends"), F.concat(F.regexp_replace(own, HYPHENS + "$", ""), hyphen, chunk)).otherwise(own)
    word = r"[\p{L}\p{M}\p{N}\x{AD}\x{200B}-\x{200F}\x{2060}]"
    pieces = F.regexp_extract_all(F.col("own"), F.lit(rf"({word}+|[^\p{{L}}\p{{M}}\p{{N}}\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}]+)"), F.lit(1))

    def mend(p: Column) -> Column:
        form = look(F.lower(p))
        right = F.try_element_at(F.filter("fixes", lambda x: x["form"] == form), F.lit(1))["right"]
        # Bound by a list of one: as an expression it would be written out, and evaluated, for each use.
        return F.coalesce(F.get(F.transform(F.array(right), lambda r: _written(r, p, F.col("lang"))), F.lit(0)), p)

    row = row.withColumn("own", own)
    row = row.withColumn("m", F.when(F.col("fixes").isNull(), F.col("own")).otherwise(F.array_join(F.transform(pieces, mend), "")))
    whole = row.groupBy("doc_id", "page_num", "block_id", "block_pos").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "m"))).alias("ms"), F.min_by(F.col("cont") | F.col("open"), "line_no").alias("goes_on")
    )
    whole = carry_over_pages(cut(whole), F.when(~F.col("goes_on"), F.col("block_id")), ("block_pos", "block_id"))
    joined = F.trim(F.array_join(F.filter(F.transform("ms", lambda x: x["m"]), lambda x: x != ""), " "))
    return whole.select("block_id", F.coalesce("_state", "block_id").alias("para_id"), joined.alias("text")).where("text <> ''")
