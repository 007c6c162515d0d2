"""Protected tokens: links, citations, formulas, references, addresses masked before a text is translated.

All of it is Column expressions: a pass of a regular expression for each kind marks what it protects, later kinds pass
over what is marked, and the marks are numbered in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import strip_tags

#: Marks around a protected value, and between its kind and itself: code points that no text may hold.
OPEN, CLOSE, KIND = "\uFDD0", "\uFDD1", "\uFDD2"
_M = OPEN + CLOSE
# Signs of formulas; what links, citations, references, addresses and identifiers look like.
_SIGNS = "∫∑∏∂√∞∇±×÷≠≤≥≈∝"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψωΩ"
_SURNAME = r"[A-ZА-Я][A-Za-zА-Яа-я'’\-]+"
_OPERATOR = r"\s*[=<>≤≥≠±+*/÷^]\s*"
_RAISED = r"(?:[_^][\d{}()+\-])*"
_NUMBER = r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_GROUP = rf"\([^){_M}]+\)|\{{[^}}{_M}]+\}}"
_LETTER = rf"[A-Za-zА-Яа-я{_SIGNS}]{_RAISED}"
#: Grammar of our own: a term, terms tied by operators, and two terms or numbers in brackets.
_TERM = rf"(?:{_GROUP}|{_NUMBER}|{_LETTER})"
_CHAIN = rf"{_TERM}(?:{_OPERATOR}{_TERM})+|[∫∑∏∂√∞∇]\s*(?:{_GROUP}|{_LETTER})"
_BRACKETED = rf"[(\[]\s*(?:{_LETTER}|\d)(?:{_OPERATOR}(?:{_LETTER}|\d)|{_NUMBER})\s*[)\]]|[(\[]\s*{_NUMBER}\s*[,;]\s*{_NUMBER}\s*[)\]]"
#: Kind, pattern, and the longest value that is left as it is, in order of precedence.
KINDS: tuple[tuple[str, str, int], ...] = (
    ("LINK", r"(?is)<a\s+[^>]*href=['\"][^'\"]+['\"][^>]*>.*?</a>|href=['\"][^'\"]+['\"]", 0),
    ("CITE", rf"(?iu)\([^\n(){{}}{_M}]{{0,220}}(?:19|20)\d{{2}}[^\n(){{}}{_M}]{{0,40}}\)|\b{_SURNAME}(?:\s*,\s*{_SURNAME})*(?:\s+et\s+al\.?)?\s*\((?:19|20)\d{{2}}[^){_M}]*\)", 0),
    ("MATH", f"{_CHAIN}|{_BRACKETED}", 3),
    ("MATH", rf"(?<![\p{{L}}\p{{N}}_])[A-Za-zА-Яа-я][_^][\d{{}}()+\-]+|[{_SIGNS}{_GREEK}]{{2,}}", 1),
    ("P", r"\[\[REF\d+\]\]", 0),
    ("P", r"\[(?:[0-9][0-9,\s;\-–—]*|[A-Za-z][A-Za-z0-9-]*)\]", 0),
    ("P", rf"(?i)https?://[^\s<>\]\){_M}]+", 0),
    ("P", r"(?i)\b(?:doi:\s*)?10\.\d{4,9}/[-._;()/:A-Z0-9]+\b", 0),
    ("P", r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", 0),
    ("P", rf"(?<![\p{{L}}\p{{N}}_])[A-Za-z][A-Za-z0-9_]*(?:\s*[=<>±]\s*[^,.;\n{_M}]+)?", 0),
)
_TOKEN = r"(?i)\[\[\s*((?:AUTHOR|P|REF|CITE|LINK|MATH)_\d+)\s*\]\]"


def mask(text: Column | str) -> Column:
    """struct(masked, tokens) of a text without inline tags (M01): nothing is lost, :func:`restore` gives it back.

    NULL stays NULL. The three marks, if a text has them, are deleted.
    """
    return numbered(marked(F.col(text) if isinstance(text, str) else text))


def marked(c: Column) -> Column:
    """A text with the marks around its protected values, from which :func:`numbered` makes the masked text and the tokens.

    All passes of regular expressions are made here; who needs both at different times keeps this.
    """
    s = strip_tags(F.translate(c, OPEN + CLOSE + KIND, ""))
    for kind, pattern, short in KINDS:
        s = F.regexp_replace(s, rf"({OPEN}[^{CLOSE}]*{CLOSE})|({pattern})", f"$1{OPEN}{kind}{KIND}$2{CLOSE}")
        s = F.replace(s, F.lit(f"{OPEN}{kind}{KIND}{CLOSE}"), F.lit(""))  # where an earlier kind's value was passed over
        if short:
            s = F.regexp_replace(s, rf"{OPEN}{kind}{KIND}(\s*[^\s{CLOSE}]?[^{CLOSE}]{{0,{short - 1}}})(?=\s*{CLOSE})(\s*){CLOSE}", "$1$2")
    # A plain word of up to 20 letters is no identifier.
    return F.regexp_replace(s, rf"{OPEN}P{KIND}([A-Za-z]{{1,20}}){CLOSE}", "$1")


def numbered(s: Column) -> Column:
    """struct(masked, tokens) of a marked text."""
    # Bound as an element of an array, so that the passes are made once.
    return F.element_at(F.transform(F.array(s), _numbered), 1)


def _numbered(s: Column) -> Column:
    values = F.regexp_extract_all(s, F.lit(rf"{OPEN}([A-Z]+{KIND}[^{CLOSE}]*){CLOSE}"), F.lit(1))
    number = lambda i: F.when(i < 10000, F.lpad(i.cast("string"), 4, "0")).otherwise(i.cast("string"))
    token = lambda m, i: F.struct(
        F.concat(F.lit("[["), F.substring_index(m, KIND, 1), F.lit("_"), number(i), F.lit("]]")).alias("token"), F.substring_index(m, KIND, -1).alias("value")
    )
    tokens = F.transform(values, token)
    parts = F.split(s, rf"{OPEN}[^{CLOSE}]*{CLOSE}")
    joined = lambda ts: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(ts, i)["token"], F.lit("")))), "")
    both = F.transform(F.array(tokens), lambda ts: F.struct(joined(ts).alias("masked"), ts.alias("tokens")))
    return F.when(s.isNotNull(), F.element_at(both, 1))


def restore(text: Column, tokens: Column) -> Column:
    """Values back in place of their tokens, whatever the case or the blanks in the brackets; unknown tokens vanish.

    One pass over the text; values are never read again. NULL is ''.
    """
    c = F.coalesce(text, F.lit(""))
    names = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1))
    value = lambda name: F.try_element_at(F.filter(tokens, lambda t: t["token"] == F.concat(F.lit("[["), F.upper(name), F.lit("]]"))), F.lit(1))["value"]
    parts = F.split(c, _TOKEN)
    put = lambda ns: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(value(F.get(ns, i)), F.lit("")))), "")
    return F.element_at(F.transform(F.array(names), put), 1)
