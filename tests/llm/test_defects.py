"""Cutoffs of the label model on pairs with planted defects, held against a grid of others."""

import random

import pytest

pytest.importorskip("folio.llm")

from folio.llm import defects, langid  # noqa: E402

WORDS = {
    "en": "river glacier signal filter polymer soil station record summer winter valley line salt water sample layer".split(),
    "de": "Fluss Gletscher Signal Filter Polymer Boden Station Aufzeichnung Sommer Winter Tal Linie Salz Wasser Probe Schicht".split(),
    "ru": "река ледник сигнал фильтр полимер почва станция запись лето зима долина линия соль вода проба слой".split(),
}
FRAMES = {
    "en": ["The {0} reaches the {1} after {2} hours.", "We compare the {0} with the {1} at {2} mm.", "No effect of the {0} appears in the {1} below {2} grams."],
    "de": ["Das {0} erreicht das {1} nach {2} Stunden.", "Wir vergleichen das {0} mit dem {1} bei {2} mm.", "Eine Wirkung von {0} zeigt sich im {1} unter {2} Gramm nicht."],
    "ru": ["Затем {0} достигает {1} после {2} часов.", "Мы сравниваем {0} и {1} при {2} мм.", "Влияние {0} на {1} не видно ниже {2} граммов."],
}
REFUSALS = ["I'm sorry, but I cannot translate this passage.", "Leider kann ich diesen Abschnitt nicht übersetzen.", "As an AI, I am unable to help with this request."]


def sentences(rng, lang, plan):
    return [FRAMES[lang][f].format(WORDS[lang][a], WORDS[lang][b], n) for f, a, b, n in plan]


def planted(seed, size):
    """(source, target, defect or None) of English texts and their German versions."""
    rng, out = random.Random(seed), []
    for _ in range(size):
        plan = [(rng.randrange(3), rng.randrange(16), rng.randrange(16), rng.randint(10, 999)) for _ in range(rng.randint(2, 5))]
        en, de = sentences(rng, "en", plan), sentences(rng, "de", plan)
        s, t, kind = " ".join(en), " ".join(de), rng.choice([None] * 12 + ["empty", "truncated", "refusal", "copy", "wrong_language", "nomark", "lower", "added", "reported"])
        if kind == "empty":
            t = rng.choice(["", "   ", "...", "—", "?!"])
        elif kind == "truncated":
            t = t[: rng.randint(len(t) // 3, len(t) - 12)].rstrip(" .") + rng.choice(["", "...", "-"])
        elif kind == "refusal":
            t = rng.choice(REFUSALS) if rng.random() < 0.6 else de[0] + " " + rng.choice(REFUSALS)
        elif kind == "copy":
            t = rng.choice([s, s.upper(), "Übersetzung: " + s, s.replace(" ", "\n"), s.replace("e", "е").replace("o", "о")])
        elif kind == "wrong_language":
            t = " ".join(sentences(rng, "ru", plan))
        elif kind == "nomark":
            t, kind = t.rstrip("."), None
        elif kind == "lower":
            t, kind = t.lower(), None
        elif kind == "added":
            t, kind = t + " " + sentences(rng, "de", [(1, 2, 3, 44)])[0], None
        elif kind == "reported":
            s, t, kind = s + " The log says: sorry, I cannot answer this request.", t + " Das Protokoll sagt: leider kann ich diese Anfrage nicht beantworten.", None
        out.append((s, t, kind))
    return out


def score(posterior, pairs, defect, cutoff):
    """F1 of one defect at a cutoff, where a pair counts for the first of its defects (a copy is in a wrong language as well)."""
    cutoffs = defects.CUTOFFS | {defect: cutoff}
    found = {i for i, p in posterior.items() if next((d for d in defects.PRECEDENCE if p[d] > cutoffs[d]), None) == defect}
    true = {i for i, (_, _, k) in enumerate(pairs) if k == defect}
    return 2 * len(found & true) / max(1, len(found) + len(true))


def test_cutoffs_are_near_the_best_of_a_grid(spark):
    rng = random.Random(0)
    lines = [(lang, x) for lang in WORDS for _ in range(150) for x in sentences(rng, lang, [(rng.randrange(3), rng.randrange(16), rng.randrange(16), rng.randint(10, 999))])]
    model = langid.fit(lines)
    pairs = planted(1, 700)
    df = spark.createDataFrame([(i, s, t, "de", "en") for i, (s, t, _) in enumerate(pairs)], "block_id bigint, source string, target string, target_lang string, source_lang string")
    posterior = {r.block_id: r for r in defects.posteriors(defects.pair_votes(df, model)).collect()}
    for defect, cutoff in defects.CUTOFFS.items():
        grid = {c / 20: score(posterior, pairs, defect, c / 20) for c in range(1, 20)}
        own = score(posterior, pairs, defect, cutoff)
        assert own >= max(grid.values()) - 0.01 and own > 0.93, (defect, own, grid)


def test_no_vote_decides_alone():
    patterns = [((1, 1, 1), 50), ((0, 0, 0), 900), ((0, 1, 1), 3), ((1, 0, 0), 3), ((-1, 1, 1), 5), ((-1, -1, -1), 2)]
    q = defects.label_model(patterns, (0,))
    assert q[1, 1, 1] > 0.9 and q[0, 0, 0] < 0.01 and 0 < q[1, 0, 0] < q[0, 1, 1] < q[-1, 1, 1] < q[1, 1, 1]
    assert defects.label_model([]) == {}
