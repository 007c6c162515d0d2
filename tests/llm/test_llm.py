"""Training-data operators against brute force, exact round trips and planted cases, and on odd rows."""

import base64
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

pytest.importorskip("folio.llm")

from folio.llm import alignment, bpe, defects, glyphs, langid, leaks, lookalike, multiset, pieces, scans, sentences  # noqa: E402

EN = "The glacier reaches the second valley after a warm summer. We compare the river with the old record of the station. No effect of the salt appears below the line."
DE = "Der Gletscher erreicht das zweite Tal nach einem warmen Sommer. Wir vergleichen den Fluss mit der alten Aufzeichnung der Station. Eine Wirkung des Salzes zeigt sich unter der Linie nicht."
RU = "Ледник достигает второй долины после тёплого лета. Мы сравниваем реку со старой записью станции. Влияние соли не проявляется ниже этой линии."


@pytest.fixture(scope="module")
def model():
    lines = [("en", x + ".") for x in EN.split(".") if x.strip()] + [("de", x + ".") for x in DE.split(".") if x.strip()] + [("ru", x + ".") for x in RU.split(".") if x.strip()]
    return langid.fit(lines * 3)


# --- 1


def test_alignment_pairs_sentences(spark):
    rng = random.Random(3)
    nouns = [("river", "Fluss"), ("glacier", "Gletscher"), ("signal", "Signal"), ("filter", "Filter"), ("polymer", "Polymer"), ("soil", "Boden")]
    kinds = [("The {0} loses {1}% of its mass.", "Der {0} verliert {1} % der Masse."), ("The share of the {0} grows to {1} mm.", "Der Anteil des {0} wächst auf {1} mm."), ("We compare the {0} with {1} samples.", "Wir vergleichen den {0} mit {1} Proben.")]
    rows, want = [], set()
    for b in range(60):
        made = []
        for _ in range(4):
            (e, d), (s, t), n = rng.choice(nouns), rng.choice(kinds), rng.randint(10, 9999)
            made.append((s.format(e, n), t.format(d, n)))
        order = rng.sample(range(4), 4)[: rng.choice([3, 4])]
        src, at, starts = "", [], []
        for s, _ in made:
            at.append(len(src))
            src += s + " "
        tgt = ""
        for k in order:
            starts.append((k, len(tgt)))
            tgt += made[k][1] + " "
        want |= {(b, at[k], p) for k, p in starts}
        rows.append((b, "en>de", src, tgt))
    rows += [(100, "en>de", None, "x"), (101, None, "A b c.", ""), (102, "en>de", "", None)]
    df = spark.createDataFrame(rows, "block_id bigint, pair string, source string, target string")
    found = {tuple(r) for r in alignment.align(df, alignment.learn_concepts(df)).collect()}
    assert len(found & want) / len(want) > 0.95 and len(found & want) / len(found) > 0.95
    assert alignment.align(df.limit(0), alignment.Concepts([])).count() == 0


def test_alignment_knows_the_words_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    made = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(800)]
    nouns = list(zip(made[:400], made[400:]))
    rows, want = [], set()
    for b in range(1600):
        (e1, d1), (e2, d2) = rng.sample(nouns, 2)
        s, t = [f"The {e1} rises again. ", f"The {e2} rises again. "], [f"Der {d1} steigt wieder. ", f"Der {d2} steigt wieder. "]
        swap = rng.random() < 0.5
        want |= {(b, 0, len(t[1]) if swap else 0), (b, len(s[0]), 0 if swap else len(t[0]))}
        rows.append((b, "en>de", "".join(s), "".join(t[::-1] if swap else t)))
    df = spark.createDataFrame(rows, "block_id bigint, pair string, source string, target string").persist()
    found = {tuple(r) for r in alignment.align(df, alignment.learn_concepts(df)).collect()}
    assert len(found & want) / len(want) > 0.95 and len(found & want) / len(found) > 0.95
    # Word vectors in several parts give the same pairs.
    monkeypatch.setattr(alignment, "CELLS", 3000)
    assert {tuple(r) for r in alignment.align(df, alignment.learn_concepts(df)).collect()} == found


# --- 2


@pytest.mark.parametrize("text", ["a" * 9000, "word " * 2000, ("A sentence of some words here. " * 60 + "\n\n") * 4, "x" * 2501, "字。" * 2000, ("y" * 2450 + "\n\n") * 3])
def test_pieces(text):
    kind, at = pieces.cuts(text, 2500, 200)
    ends = [0, *at, len(text)]
    assert "".join(text[a:b] for a, b in pairwise(ends)) == text and sorted(set(ends)) == ends
    assert all(b - a + (200 if a else 0) <= 2500 for a, b in pairwise(ends))
    assert kind == {"a": "char", "w": "word", "A": "paragraph", "x": "char", "字": "sentence", "y": "paragraph"}[text[0]]


def test_pieces_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "w " * 3000), (4, "w " * 3000), (4, "w " * 3000)], "block_id bigint, text string").withColumn("cut", F.lit("clash"))
    got = pieces.split_oversized(df).collect()
    assert sorted((r.block_id or 0, r.cut) for r in got) == [(0, "word"), (4, "word"), (4, "word")]
    for p, q in pairwise(got[0].pieces):
        assert q.piece.startswith(p.piece[-200:])
    assert pieces.split_oversized(df.limit(0)).count() == 0


# --- 3


def test_defects(spark, model):
    rng = random.Random(5)
    en, de = [x.strip() + "." for x in EN.split(".") if x.strip()], [x.strip() + "." for x in DE.split(".") if x.strip()]
    rows, want = [], {}
    for i in range(400):
        k = rng.sample(range(3), 3)
        s, t = " ".join(en[j] for j in k), " ".join(de[j] for j in k)
        kind = rng.choice(["", "", "", "", "empty", "truncated", "refusal", "copy", "wrong_language", "nomark", "lower"])
        if kind == "empty":
            t = rng.choice(["", "  ", "...", "-"])
        elif kind == "truncated":
            t = t[: int(len(t) * 0.55)].rstrip(" .") + rng.choice(["", "...", "-"])
        elif kind == "refusal":
            t = rng.choice(["I'm sorry, but I cannot translate this passage.", de[k[0]] + " Leider kann ich diesen Abschnitt nicht übersetzen."])
        elif kind == "copy":
            t = rng.choice([s, s.upper(), "Note: " + s])
        elif kind == "wrong_language":
            t = " ".join(x.strip() + "." for x in RU.split(".") if x.strip())
        elif kind == "nomark":
            t = t.rstrip(".")
        elif kind == "lower":
            t = t.lower()
        rows.append((i, s, t, "de", "en"))
        if kind not in ("", "nomark", "lower"):
            want[i] = kind
    rows += [(900, None, None, "de", "en"), (901, None, "", None, None)]
    df = spark.createDataFrame(rows, "block_id bigint, source string, target string, target_lang string, source_lang string")
    got = {r.block_id: r.defects[0] for r in defects.find_defects(df, model).collect()}
    assert got.pop(901) == "empty" and 900 not in got
    right = sum(got.get(i) == k for i, k in want.items())
    assert right / len(want) > 0.95 and right / len(got) > 0.93


# --- 4


def test_look_alikes(spark):
    texts = ["The paper", "Thе pаper", "The paper", "Ｔｈｅ paper", "The  paper", "the paper", "café", "café", "cafe", "ﬁne", "fine", "well‐known", "well-known", "so​ft", "soft", "Привет", "", None, "The paper"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "block_id bigint, text string").withColumn("class_id", F.lit(1))
    got = {tuple(r) for r in lookalike.look_pairs(df).collect()}
    look = [None if t is None else glyphs.look_py(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if look[i] is not None and look[i] == look[j] and texts[i] != texts[j]}
    assert got == want and (0, 18) not in got
    one = {r.block_id: r.canonical for r in lookalike.canonical(df).collect()}
    assert one[0] == one[1] == one[2] == one[3] == "The paper" and one[17] is None and one[16] == "" and one[15] == "Привет"
    assert lookalike.look_pairs(df.limit(0)).count() == 0


# --- 5


def test_sentence_starts(spark):
    rows = [(i, "en", f"We met Dr. Smith in Fig. {i} today. The river rose. We saw it vs. the old one, cf. Sec. 3 of it. “Is it so? Yes!” was all he said. All of it was well.") for i in range(60)]
    rows += [(200 + i, "en", f"All of it rose as we were well today number {i} and he said it of the old river. The end of it was near. All of it was near. We saw that it rose.") for i in range(60)]
    rows += [(100, "zh", "他说:“好。请看!”然后走了。河流上升!对吗?"), (101, "en", None), (102, "en", ""), (103, None, "One here. Two there"), (104, "en", "  ")]
    df = spark.createDataFrame(rows, "block_id bigint, lang string, text string")
    got = {}
    for r in sentences.sentence_starts(df).collect():
        got.setdefault(r.block_id, []).append(r.sent_start)
    t = rows[7][2]
    assert [t[a:][:6] for a in sorted(got[7])] == ["We met", "The ri", "We saw", "“Is it", "All of"]
    zh = next(r[2] for r in rows if r[0] == 100)
    assert sorted(got[100]) == [0, zh.index("河"), zh.index("对")] and 101 not in got and 102 not in got and 104 not in got and len(got[103]) == 2


# --- 6


def test_copies(spark):
    rows = [
        (1, "paragraph", "One, two; three.", "a b"), (2, "paragraph", "ONE TWO  three", "A-B"), (3, "paragraph", "one two three", None), (4, "paragraph", "one two three.", None),
        (5, "metadata", "Name: X; Date: 1/2", None), (6, "metadata", "Date = 1/2 | Name = X", None), (7, "metadata", "Name: 1/2; Date: X", None), (8, "list", None, None),
        (9, "paragraph", "...", None), (10, "paragraph", "", None), (11, "metadata", "A: 1; A: 1; B: 2", None), (12, "metadata", "A: 1; B: 2; B: 2", None), (13, "paragraph", "one two three", ""),
    ]
    df = spark.createDataFrame(rows, "block_id bigint, type string, text_override string, translation string").withColumn("first_id", F.lit(0))
    assert {tuple(r) for r in multiset.copy_groups(df).collect()} == {(1, 2), (3, 4), (5, 6), (9, 10)}
    assert {tuple(r) for r in multiset.copy_counts(df).collect()} == {(1, 2), (3, 2), (5, 2), (9, 2)}
    assert multiset.copy_groups(df.limit(0)).count() == 0


# --- 7


def test_scans(spark):
    body = ["the second cycle of the pressure was", "long and the pressure rose in the sys-", "tem again while the pressurc fell and", "the system was quiet after the second"]
    rows = []
    for d in (1, 2, 3):
        for p in range(1, 9):
            lines = [f"Annals of Glacier Studies, 4{d}", *body, str(100 + p)]
            rows.append((d * 100 + p, d, "en", p, 0, [([(x, (0.0, 12.0 * k, 9.0, 12.0 * k + 9))], ) for k, x in enumerate(lines)]))
    rows.append((999, 9, None, 1, 0, None))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"block_id bigint, doc_id bigint, lang string, page_num int, block_pos int, lines array<struct<spans:array<struct<text:string,bbox:{box}>>>>")
    got = {(r.line_no, r.noise) for r in scans.find_noise(df).collect()}
    assert got == {(0, "runhead"), (5, "pagenum"), (2, "hyphen"), (3, "ocr")}
    text = {r.block_id: r.text for r in scans.repair(df).collect()}[101]
    assert "system again" in text and "Annals" not in text
    assert scans.find_noise(df.limit(0)).count() == 0 and scans.repair(df.limit(0)).count() == 0


def scanned(spark, rows):
    """Rows of (block_id, doc_id, lang, page_num, block_pos, lines)."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    made = [(b, d, lang, p, k, [([(x, (0.0, 0.0, 9.0, 9.0))],) for x in lines]) for b, d, lang, p, k, lines in rows]
    return spark.createDataFrame(made, f"block_id bigint, doc_id bigint, lang string, page_num int, block_pos int, lines array<struct<spans:array<struct<text:string,bbox:{box}>>>>")


def test_repair_keeps_script_and_case_and_joins_blocks(spark):
    rows = [(i, i, "ru", 1, 0, ["мы снова видел этот новый прибор на месте"]) for i in range(20)]
    rows += [(100, 100, "ru", 1, 0, ["Мы снова видеп этот новый прибор на месте"]), (101, 101, "ru", 1, 0, ["мы снова Впдел этот новый прибор на месте"])]
    rows += [(200 + i, 200 + i, "en", 1, 0, ["then the house stood near the river for years"]) for i in range(20)]
    rows += [(300, 300, "en", 1, 0, ["then The Housc stood near the river for years"]), (301, 301, "en", 1, 0, ["then the HOUSC stood near the river for years"])]
    # A word broken over two blocks, and one with a misread glyph in its second half over two pages.
    rows += [(400, 400, "en", 1, 0, ["then the house stood near one exam-"]), (401, 400, "en", 1, 1, ["ple, as the river rose again and went on near the ri-"]), (402, 400, "en", 2, 0, ["vcr for years. Then it fell."])]
    df = scanned(spark, rows)
    found = {(r.block_id, r.noise) for r in scans.find_noise(df).collect()}
    assert found == {(100, "ocr"), (101, "ocr"), (300, "ocr"), (301, "ocr"), (400, "hyphen"), (401, "hyphen"), (402, "ocr")}
    got = {r.block_id: r for r in scans.repair(df).collect()}
    assert got[100].text == "Мы снова видел этот новый прибор на месте" and got[101].text == "мы снова Видел этот новый прибор на месте"
    assert got[300].text == "then The House stood near the river for years" and got[301].text == "then the HOUSE stood near the river for years"
    assert [got[i].text for i in (400, 401, 402)] == ["then the house stood near one example,", "as the river rose again and went on near the river", "for years. Then it fell."]
    assert {got[i].para_id for i in (400, 401, 402)} == {400} and got[1].para_id == 1


def test_furniture_is_learnt(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("kmpsvzy") + rng.choice("aou") for _ in range(3)) for _ in range(80)]
    body = lambda: " ".join(rng.choice(words) for _ in range(7))
    rows = []
    for d in range(1, 9):  # three lines of furniture: a title, a head in small letters on every page, a number
        for p in range(1, 5):
            rows.append((d * 100 + p, d, "en", p, 0, [f"Annals 0f Zomar Studies, 4{d}" if p == 2 else f"Annals of Zomar Studies, 4{d}", "печатается по решению совета", str(10 * d + p), body(), body(), body(), body()]))
    rows.append((2000, 20, "en", 1, 0, ["Letters of Pozumav Practice, 7", body(), body(), body(), body(), body()]))  # seen once: known by its shape
    rows.append((2001, 21, "en", 1, 0, ["Mozuma Povazu", body(), body(), body(), body(), body()]))  # a heading's shape isn't learnt
    got = {(r.block_id, r.line_no): r.noise for r in scans.find_noise(scanned(spark, rows)).collect()}
    want = {(d * 100 + p, k): kind for d in range(1, 9) for p in range(1, 5) for k, kind in enumerate(("runhead", "runhead", "pagenum"))} | {(2000, 0): "runhead"}
    assert got == want


def test_rare_and_systematic_misreadings(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("kmpsvzy") + rng.choice("aou") for _ in range(3)) for _ in range(80)]
    rows = [(i, 0, rng.choice(("en", "de")), " ".join(rng.choice(words) for _ in range(6))) for i in range(300)]
    # Right forms, misread forms in a part above 1/8, in another language and once in three, and two words of one skeleton.
    rows += [(400 + i, 0, "en", f"zuku {'prcssure' if i % 3 == 0 else 'pressure'} vavo") for i in range(30)]
    rows += [(500, 0, "fr", "kamo spiethgamar povu"), (501, 0, "en", "kamo spiethgamar povu"), (502, 0, "de", "kamo spiefhgamar povu")]
    rows += [(600 + i, 0, "en", f"sazo {'bearing' if i % 3 else 'hearing'} {'mopa' if i % 3 else 'yusa'}") for i in range(9)]
    rows += [(700 + i, 0, "en", "sazo " + w) for i, w in enumerate(words)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    made = [(i, i, lang, 1, 0, [([(x, (0.0, 0.0, 9.0, 9.0))],)]) for i, _, lang, x in rows]
    df = spark.createDataFrame(made, f"block_id bigint, doc_id bigint, lang string, page_num int, block_pos int, lines array<struct<spans:array<struct<text:string,bbox:{box}>>>>")
    got = {r.block_id for r in scans.find_noise(df).collect() if r.noise == "ocr"}
    assert got == {502} | {400 + i for i in range(0, 30, 3)}
    text = {r.block_id: r.text for r in scans.repair(df).collect()}
    assert text[502] == "kamo spiethgamar povu" and text[400] == "zuku pressure vavo" and text[600] == "sazo hearing yusa"


def test_scans_plan_little_at_once(spark, monkeypatch):
    # The driver holds every plan of a job several times over (as planned again after each stage, as told to listeners).
    sizes, cut = [], scans.cut
    plan = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(scans, "cut", lambda df: sizes.append(plan(df)) or cut(df))
    df = scanned(spark, [(i, i, "en", 1, 0, ["Annals of Glacier Studies", "then the house stood near the ri-", "ver for years"]) for i in range(3)])
    for made in (scans.find_noise(df), scans.repair(df)):
        assert made.count() and max(*sizes, plan(made)) < 150_000


# --- 8


def test_ids_are_those_of_the_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.parse_vocabulary(open(bpe.DEFAULT_VOCABULARY, "rb").read())
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "don't  stop\n\n now", "a" * 5000, "ab" * 999, "<|endoftext|> x", EN, RU, "字。　か", "x² ½ 🙂👩‍🔬"]
    texts += ["".join(rng.choice("ab cé\n\t ñж字🙂\xa0.,12'") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (9999, None), (None, "a b")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert all(got[i] == ref.encode_ordinary(t) for i, t in enumerate(texts)) and got[9999] == [] and got[None] == ref.encode_ordinary("a b")
    assert bpe.encode(df.limit(0)).count() == 0 and base64


# --- 9


def test_leaks_are_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(80)]
    docs = []
    for d in range(200):
        ws = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            part = rng.choice(items)[1].split()
            k = rng.randint(0, max(0, len(part) - 12))
            ws[10:10] = part[k : k + rng.randint(9, 20)]
        docs.append((d, ", ".join(w.upper() if d % 2 else w for w in ws)))
    docs += [(900, None), (901, "")]

    def grams(t):
        w = glyphs.words(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (500, None)], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.find_leaks(a, b).collect()} == want and want
    assert leaks.find_leaks(a, b.limit(0)).count() == 0 and leaks.find_leaks(a.limit(0), b).count() == 0


def test_leak_index_in_blocks(spark, monkeypatch):
    text = " ".join(f"x{i}" for i in range(30))
    a, b = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(i, text) for i in range(9)], "item_id bigint, text string")
    monkeypatch.setattr(leaks, "MAX_INDEX_TEXT", 300)
    assert leaks.find_leaks(a, b).count() == 9


# --- 10


def test_languages(spark, model):
    docs = [(1, "en", EN + "\n" + DE), (2, "de", EN), (3, "??", RU), (4, "en", EN + "\nWir vergleichen den Fluss mit der alten Aufzeichnung der Station."), (5, "en", None), (6, None, ""), (7, "en", "12 34")]
    docs.append((8, "en", EN.replace("a", "а").replace("o", "о").replace("e", "е")))
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    assert {tuple(r) for r in langid.unnamed_languages(df, model).collect()} == {(1, "de"), (2, "en"), (3, "ru")}
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert got[3].lang == "ru" and got[3].confidence > 0.9 and got[5].lang is None and got[6].passages == [] and got[8].lang == "en"
    names = spark.createDataFrame([("EN",), ("en-US",), ("fr_CA",), ("rus",), ("German",), ("n/a",), ("",), (None,), ("xx",)], "l string")
    assert [r[0] for r in names.select(langid.named(F.col("l"))).collect()] == ["en", "en", "fr", "ru", "de", None, None, None, None]


def test_languages_that_no_tree_knows_and_short_sentences(spark, model):
    dutch = "De commissie heeft gisteren besloten dat het station gesloten blijft. Wij vergelijken het water met de oude metingen van het instituut."
    norwegian = "Jeg vet ikke hva som skjedde med elven denne uken. Det var ingen tegn til noe under broen der."
    docs = [(1, "en", dutch), (2, "en", norwegian), (3, "de", "The river. The old record. No salt appears."), (4, "en", EN + " " + dutch)]
    docs += [(5, "en", "한국어 문장입니다. 또 하나의 문장입니다."), (6, "en", EN + " Zuquavexo. " + EN)]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert got[1].lang is None and got[2].lang is None and got[5].lang is None
    assert [(p.lang, p.sentences) for p in got[3].passages] == [("en", 3)]
    assert [(p.lang, p.sentences) for p in got[4].passages] == [("en", 3), (None, 2)]
    assert [(p.lang, p.sentences) for p in got[6].passages] == [("en", 7)]  # a name alone is no language
    assert {tuple(r) for r in langid.unnamed_languages(df, model).collect()} == {(3, "en")}


def test_joint_assignment_is_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        bits = rng.uniform(0, 30, (rng.integers(1, 7), 3))
        cost = lambda w: sum(bits[i, j] for i, j in enumerate(w)) + 9 * sum(a != b for a, b in pairwise(w))  # noqa: E731, B023
        assert cost(langid.assign(bits, 9.0)) == pytest.approx(min(map(cost, itertools.product(range(3), repeat=len(bits)))))


# --- pieces, tokenizer, look-alikes: odd characters


def test_pieces_keep_characters_whole():
    text = "a" + "e\u0301" * 2000
    kind, at = pieces.cuts(text)
    assert kind == "char" and all(text[b] != "\u0301" and text[max(0, b - 200)] != "\u0301" for b in at)
    assert all(b - a <= 2300 for a, b in pairwise([200, *at, len(text)])) and pieces.cuts("\u0301" * 6000)[1]


def test_rank_queue_above_a_quarter_million():
    q = bpe.RankQueue(1_000_000)
    for rank in (999_999, 5, 300_000, 5):
        q.push(rank, rank % 7)
    out = []
    while (r := q.first()) >= 0:
        out.append((r, q.take(r)))
    assert out == [(5, [5, 5]), (300_000, [300_000 % 7]), (999_999, [999_999 % 7])]


def test_look_alikes_by_rule(spark):
    pairs = [("ν1", "v1"), ("𝐚b", "ab"), ("ıx", "ix"), ("Ⅳ.", "IV."), ("αx", "ax")]
    df = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "block_id bigint, text string")
    assert {tuple(r) for r in lookalike.look_pairs(df).collect()} == {(0, 1), (2, 3), (4, 5), (6, 7)}
    got = {(r.class_id, r.block_id, r.forms, r.copies) for r in lookalike.look_members(df).collect()}
    assert got == {(i - i % 2, i, 2, 1) for i in range(8)}
    assert lookalike.look_members(df.limit(0)).count() == 0 and lookalike.canonical(df.limit(0)).count() == 0
