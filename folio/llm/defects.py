"""Broken prompt and response pairs (problem 3).

Noisy labelling functions vote on every defect (1 yes, 0 no, -1 no opinion). For each defect a label model
learns by expectation-maximization, without labels, how often each function votes what on defective and on
sound pairs; a pair has the defect if its posterior exceeds the defect's cutoff.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.glyphs import fold
from folio.llm.langid import Model, in_script, passages, units
from folio.sources.lineage import share

#: Cutoffs of the posterior; tests/llm/test_defects.py holds them against a grid of others on pairs with planted defects.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "wrong_language": 0.5, "truncated": 0.5}
#: Where several posteriors exceed their cutoffs, the first of these is the block's one defect.
PRECEDENCE = ("empty", "refusal", "copy", "wrong_language", "truncated")
COPY_CHARS = 20
#: A source of fewer characters needn't end with a mark. Characters of the chunks that a whole source is compared by.
HEADING, CHUNK = 40, 8
#: Bits by which another language must be nearer to a target: at least so many, or so many a letter. One or two words may be
#: a term or a name: they are judged by their script.
MARGIN, MARGIN_LETTER, FEW_WORDS = 24.0, 0.15, 2

# Openings, inabilities and objects of refusals.
OPENINGS = (
    "i'm sorry|i am sorry|sorry,|unfortunately|as an ai|as a language model|i apologise|i apologize|извините|к сожалению|как языковая модель|простите|"
    "leider|es tut mir leid|als ki|als sprachmodell|désolé|malheureusement|en tant que modèle|en tant qu'ia|je regrette|lo siento|lamentablemente|"
    "como modelo de lenguaje|como ia|desafortunadamente|mi dispiace|purtroppo|sinto muito|infelizmente|на жаль|вибачте|抱歉|对不起|很遗憾|作为|"
    "申し訳|残念ながら|ขออภัย|เสียใจ"
)
INABILITIES = (
    "cannot|can't|can not|unable|not able|won't be able|must be declined|must decline|no answer will be given|declined|refuse|"
    "не могу|не в состоянии|отклонен|отклонён|вынужден|отказ|не будет дано|не смогу|kann ich|ich kann|nicht in der lage|muss ich|ablehnen|abgelehnt|"
    "verweiger|ne peux pas|ne suis pas en mesure|dois refuser|dois décliner|refus|décliner|impossible|no puedo|no me es posible|no estoy en condiciones|"
    "rechazar|debo|declinar|denegad|rechazad|non posso|devo rifiutare|não posso|recusar|не можу|无法|不能|拒绝|できません|お断り|ไม่สามารถ"
)
OBJECTS = (
    "this passage|this text|this request|this input|this translation|translate|usage rules|further context|help with|something else|"
    "этот запрос|этот фрагмент|этим текстом|этот текст|перевод|правила|контекста|этой просьб|diesen abschnitt|diesem text|diesen text|"
    "diese anfrage|übersetz|regeln|kontext|ce passage|ce texte|cette demande|cette requête|tradui|règles|contexte|este pasaje|este texto|"
    "esta solicitud|traduc|normas|reglas|contexto|questo testo|questo brano|este trecho|цей текст|цей запит|翻译|文本|请求|规则|翻訳|この文|ข้อความ|แปล"
)
_OPEN, _CANT, _THIS = (tuple(x.split("|")) for x in (OPENINGS, INABILITIES, OBJECTS))
_QUOTED = re.compile(r"“[^”]*”|„[^“]*“|«[^»]*»|「[^」]*」|\"[^\"]*\"")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\s”»」\"']*")
_WRAP = re.compile(r"^(?:[\s`<\[(«“„\"'*_|]|OUT\]|SRC\]|CTX\])+|[\s`>\])»”“\"'*_|]+$")
_ANCHOR = re.compile(r"\d+(?:[.,]\d+)*")
_ALNUM = re.compile(r"[\W_]+")
_TAIL = re.compile(r"([^\W\d_%]+|[%°])[\W\d_]*$")


def _any(parts: tuple[str, ...], text: str) -> bool:
    return any(p in text for p in parts)


def _squeezed(text: str) -> str:
    return _ALNUM.sub("", fold(text))


def refusals(text: str) -> int:
    """Sentences that decline, outside quotations: two of an opening, an inability and an object of the request."""
    low = text.lower()
    if not (_any(_CANT, low) or _any(_OPEN, low)):
        return 0
    found = 0
    for x in _SENTENCE.split(_QUOTED.sub(" ", low)):
        opening, cant = _any(_OPEN, x), _any(_CANT, x)
        found += (opening or cant) and opening + cant + _any(_THIS, x) >= 2
    return found


def votes(source: str, target: str, target_lang: str | None, model: Model) -> dict:
    """Votes and features of one pair."""
    out: dict = {}
    plain = target.strip()
    letters = any(map(str.isalnum, target))
    out["e_alnum"] = 0 if letters else 1
    out["e_short"] = 1 if len(plain) <= 4 and not letters else 0
    core = _WRAP.sub("", plain)
    out["e_core"] = 1 if not any(map(str.isalnum, core)) else 0

    # refusal: a text that reports one has it in its source as well
    low = target.lower()
    anchors, there = _ANCHOR.findall(source), set(re.sub(",", ".", " ".join(_ANCHOR.findall(target))).split())
    have = [a.replace(",", ".") in there for a in anchors]
    own = refusals(target)
    out["r_own"] = int(own > refusals(source)) if own else 0
    cant, this = _any(_CANT, low), _any(_THIS, low)
    out["r_cant"] = 1 if cant and this else (0 if not (cant or _any(_OPEN, low)) else -1)
    # These two read no words: what the source counts and how long it is.
    out["r_anchors"] = -1 if len(have) < 2 or not letters else (0 if sum(have) > len(have) / 2 else (1 if not any(have) else -1))
    ratio = len(plain) / max(1, len(source.strip()))
    out["r_short"] = -1 if not source.strip() or not letters or 0.5 <= ratio <= 0.8 else int(ratio < 0.5)

    # copy: chunks that cover the whole source
    out["c_whole"] = out["c_words"] = out["c_parts"] = 0
    if len(source) >= COPY_CHARS:
        s = _squeezed(source)
        if s:
            t = _squeezed(target)
            out["c_whole"] = int(s in t)
            parts = [s[i : i + CHUNK] for i in range(0, max(1, len(s) - CHUNK + 1), CHUNK)]
            covered = sum(p in t for p in parts) / len(parts)
            out["c_parts"] = 1 if covered >= 0.9 else (0 if covered < 0.5 else -1)
            if covered > 0.2:
                w, have_words = fold(source).split(), set(fold(target).split())
                common = sum(x in have_words for x in w) / max(1, len(w))
                out["c_words"] = 1 if common > 0.9 else (0 if common < 0.6 else -1)

    # language
    n = sum(map(str.isalpha, target))
    if n < 3 or not target_lang or target_lang not in model.languages:
        out["w_whole"] = out["w_margin"] = out["w_sentences"] = -1 if letters else 0
    else:
        bits = model.bits([target])[0]
        j = model.languages.index(target_lang)
        other, script = int(bits.argmin()) != j, in_script(target_lang, target)
        margin, needed = float(bits[j] - bits.min()), max(MARGIN, MARGIN_LETTER * n)
        if len(units(target)) <= FEW_WORDS:
            other, margin = not script, 0.0
        out["w_margin"] = 1 if margin > needed or not script else (0 if margin < needed / 2 else -1)
        out["w_whole"] = int(other and (margin > needed or not script))
        found = passages(model, target) if other else []
        if not other:
            out["w_sentences"] = 0
        elif found and sum(f[1] - f[0] for f in found) > 0.4 * len(target):
            out["w_sentences"] = int(all(f[2] != target_lang for f in found))
        else:
            out["w_sentences"] = -1

    # truncation
    end = re.sub(r"[\s`>\])»”“\"'*_|]+$", "", target)
    dots = re.search(r"(?:\.{2,}|…)$", end)
    mark = bool(re.search(r"[.!?。！？]$", end)) and not dots
    source_end = re.sub(r"[\s`>\])»”“\"'*_|]+$", "", source)
    source_mark = bool(re.search(r"[.!?。！？]$", source_end))
    out["t_mark"] = 0 if mark else (1 if source_mark else (-1 if len(source) >= HEADING or not source else 0))
    out["t_cut"] = 1 if (dots or re.search(r"[-‐\xad¬(]$", end)) else (0 if mark else -1)
    out["t_tail"] = -1 if len(have) < 2 or not any(have) else int(not have[-1] and any(have))
    tail = _TAIL.search(end)
    out["last_word"] = tail.group(1).lower() if tail and not mark else None
    out["ends_open"] = bool(re.search(r"\d$", end))
    out["ratio"] = len(plain) / len(source.strip()) if source.strip() else None
    return out


VOTES = {
    "empty": ("e_alnum", "e_short", "e_core"),
    "refusal": ("r_own", "r_cant", "r_anchors", "r_short"),
    "copy": ("c_whole", "c_words", "c_parts"),
    "wrong_language": ("w_whole", "w_margin", "w_sentences"),
    "truncated": ("t_mark", "t_cut", "t_tail", "t_word", "t_length"),
}
_FROM_TEXT = [v for names in VOTES.values() for v in names if v not in ("t_word", "t_length")]
#: Functions that hardly miss their defect, by what the defect is: the label model starts from so many pairs of it on which
#: they voted yes, for each no, and goes on to learn from the data.
SENSITIVE = {"empty": ("e_alnum",), "copy": ("c_parts",), "wrong_language": ("w_margin", "w_sentences"), "refusal": ("r_own",), "truncated": ("t_mark",)}
SURE = 400.0


def label_model(patterns: list[tuple[tuple[int, ...], float]], sensitive: tuple[int, ...] = (), rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by EM over (pattern, number of pairs); a few tens of patterns whatever the data.

    Starts from a vote count, with pseudo-counts that each function is rather right than wrong, which also
    decide which of the two classes is the defect; functions at ``sensitive`` have stronger ones. No vote decides alone.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    yes, no = (v == 1).sum(1), (v == 0).sum(1)
    q = np.clip(0.5 + 0.45 * (yes - no) / np.maximum(1, yes + no), 0.02, 0.98)
    if sensitive:
        q[(v[:, list(sensitive)] == 0).any(1)] = 0.02
    prior_no = {1: 1.0, 0: 20.0}
    for _ in range(rounds):
        base = ((n * q).sum() + 1.0) / (n.sum() + 10.0)
        log_yes, log_no = np.full(len(n), np.log(base)), np.full(len(n), np.log1p(-base))
        for k in range(v.shape[1]):
            prior_yes = {1: SURE, 0: 1.0} if k in sensitive else {1: 8.0, 0: 2.0}
            py = {x: (n * q)[v[:, k] == x].sum() + prior_yes[x] for x in (1, 0)}
            pn = {x: (n * (1 - q))[v[:, k] == x].sum() + prior_no[x] for x in (1, 0)}
            ty, tn = sum(py.values()), sum(pn.values())
            log_yes += np.log([py[x] / ty if x >= 0 else 1.0 for x in v[:, k]])  # no opinion says nothing
            log_no += np.log([pn[x] / tn if x >= 0 else 1.0 for x in v[:, k]])
        new = 1 / (1 + np.exp(np.clip(log_no - log_yes, -500, 500)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return {tuple(int(x) for x in p): float(x) for p, x in zip(v, q)}


def pair_votes(
    df: DataFrame, model: Model, key: str = "block_id", source: str = "source", target: str = "target", target_lang: str = "target_lang",
    source_lang: str = "source_lang",
) -> DataFrame:
    """``key`` and one column for each vote of every row whose target isn't NULL. A NULL source is an empty one."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [(f, "int") for f in _FROM_TEXT] + [("last_word", "string"), ("ends_open", "boolean"), ("ratio", "double")]
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches):
        m = shared.value
        for batch in batches:
            cols = defaultdict(list)
            _, _, src, tgt, lang = (batch.column(i).to_pylist() for i in range(5))
            for s, t, x in zip(src, tgt, lang):
                got = votes(s or "", t, x, m)
                for f, _ in fields:
                    cols[f].append(got[f])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), *(pa.array(cols[f], types[k]) for f, k in fields)],
                names=[key, "pair", target_lang, *(f for f, _ in fields)],
            )

    t = df.where(F.col(target).isNotNull())
    pair = F.concat_ws(">", F.coalesce(F.col(source_lang), F.lit("")), F.coalesce(F.col(target_lang), F.lit("")))
    schema = f"`{key}` {kind}, pair string, `{target_lang}` string, " + ", ".join(f"{f} {k}" for f, k in fields)
    first = share(t.select(key, pair.alias("pair"), source, target, target_lang).mapInArrow(run, schema))
    # Words of each target language: how often a sentence ends with them (combined before they are shuffled).
    parts = F.split(F.regexp_replace(F.lower(F.col(target)), r"\s+([.!?])", "$1"), r"[^\p{L}\p{M}%°.!?。]+")
    words = t.select(F.col(target_lang).alias("l"), F.explode(parts).alias("w"))
    words = words.select("l", F.col("w").rlike(r"[.!?。]$").alias("e"), F.regexp_replace("w", r"^[.!?]+|[.!?。]+$", "").alias("w")).where("w <> ''")
    lexicon = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"), F.count_if("e").alias("ends"))
    usual = first.where("ratio IS NOT NULL").groupBy("pair").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"))
    joined = first.join(
        lexicon, (F.col("last_word") == lexicon["w"]) & F.col(target_lang).eqNullSafe(lexicon["l"]), "left"
    ).join(F.broadcast(usual), "pair", "left")  # one row for each pair of languages
    length = (
        "CASE WHEN ratio IS NULL OR usual IS NULL THEN -1 WHEN ratio / usual < 0.8 THEN 1 WHEN ratio / usual > 0.93 THEN 0 ELSE -1 END"
    )
    return joined.withColumn("t_length", F.expr(length)).select(
        key, *[f for f in _FROM_TEXT if f != "t_cut"], "t_length",
        # An ellipsis after a text of full length is a way to write the end mark.
        F.expr("CASE WHEN t_cut = 1 AND t_length = 0 THEN -1 ELSE t_cut END").alias("t_cut"),
        F.expr(
            "CASE WHEN t_mark = 0 THEN 0 WHEN last_word IS NULL THEN -1 WHEN ends_open THEN 1 "
            "WHEN n IS NULL OR n < 4 OR ends / n < 0.03 THEN 1 WHEN ends / n > 0.25 THEN 0 ELSE -1 END"
        ).alias("t_word"),
    )


def posteriors(voted: DataFrame, key: str = "block_id") -> DataFrame:
    """``key`` and the posterior of each defect. Only counts of vote patterns (at most 3**5 a defect) reach the driver."""
    voted = share(voted)
    codes = {defect: F.concat_ws(",", *names) for defect, names in VOTES.items()}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), code.alias("code")) for d, code in codes.items()])).alias("p")
    counted: dict[str, list] = defaultdict(list)
    for r in voted.select(each).groupBy("p.defect", "p.code").agg(F.count(F.lit(1)).alias("n")).collect():
        counted[r["defect"]].append((tuple(map(int, r["code"].split(","))), r["n"]))
    out = voted
    for defect, names in VOTES.items():
        model = label_model(sorted(counted[defect]), tuple(names.index(x) for x in SENSITIVE[defect]))
        table = F.create_map(*[F.lit(x) for p, q in model.items() for x in (",".join(map(str, p)), q)]) if model else None
        out = out.withColumn(defect, F.try_element_at(table, codes[defect]) if table is not None else F.lit(0.0))
    return out.select(key, *VOTES)


def find_defects(df: DataFrame, model: Model, key: str = "block_id", **columns: str) -> DataFrame:
    """``key, defects``: for each defective row all defects whose posterior exceeds its cutoff, in order of PRECEDENCE.

    A NULL target gives no row (nothing was answered); a target without letter or digit is ``empty``. A NULL
    target language can't be wrong. Repeated rows are judged as often; an empty table gives an empty one.
    """
    scored = posteriors(pair_votes(df, model, key, **columns), key)
    defects = F.array_compact(F.array(*[F.when(F.col(d) > CUTOFFS[d], F.lit(d)) for d in PRECEDENCE]))
    return scored.select(key, defects.alias("defects")).where(F.size("defects") > 0)
