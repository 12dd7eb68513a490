import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import language as g

WORDS = {
    "en": "the shop makes every brass ladle by hand and sends it with care to people who wrote before noon".split(),
    "fr": "notre atelier fabrique chaque théière à la main avec soin pour les clients qui écrivent avant midi".split(),
    "de": "unsere werkstatt fertigt jeden messingteller von hand und schickt ihn gerne an kunden die früh schreiben".split(),
    "hi": "हमारी दुकान में हर दीया हाथ से बनाया जाता है और ग्राहकों को समय पर भेजा जाता है".split(),
}
HI_LATIN = "hamari dukaan mein har diya haath se banaya jata hai aur grahakon ko samay par bheja jata hai".split()
rng = random.Random(3)


def sentence(lang, n=9):
    return " ".join(rng.choice(WORDS.get(lang, HI_LATIN)) for _ in range(n)).capitalize() + ("।" if lang == "hi" else ".")


def text(lang, n=6):
    return " ".join(sentence(lang) for _ in range(n))


ROWS = [(i, text(x), x) for i, x in enumerate(["en", "fr", "de", "hi", "latin"] * 40)]
ROWS = [(i, t, {"latin": "Hindi"}.get(x, x) if rng.random() > 0.1 else rng.choice(["en", "de"])) for i, t, x in ROWS]
TRUE = ["en", "fr", "de", "hi", "hi"] * 40


@pytest.fixture(scope="module")
def model(spark):
    return g.train(spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string"))


def found(spark, model, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("sentences", F.lit("clash")).withColumn("label", F.lit(1))
    return {(r.doc_id, r.lang) for r in g.relabel(d, g.segments(d, model)).collect()}


def test_wrong_labels(spark, model):
    want = {(i, t) for (i, _, label), t in zip(ROWS, TRUE) if {"Hindi": "hi"}.get(label, label) != t}
    assert found(spark, model, ROWS) == want and want


def test_mixed_missing_and_odd(spark, model):
    rows = [
        (1, text("en") + "\n" + sentence("fr", 8) + "\n" + text("en"), "en"), (2, text("latin", 3) + " " + text("de", 3), "deu"), (3, text("fr"), "unknown"), (4, text("de"), "de-DE"), (5, text("hi") + "\ncare@shop.example\nRs. 450", "HI"),
        (6, None, None), (7, "", "en"), (8, "12345 care@x.example https://a.example/b", None), (9, text("en"), "it"), (10, text("en", 4000), "fr"), (11, "x" * 100_000, None), (12, text("fr"), "fra"), (12, text("fr"), "fra"),
    ]
    got = found(spark, model, rows)
    assert {x for x in got if x[0] != 11} == {(1, "en"), (1, "fr"), (2, "hi"), (2, "de"), (3, "fr"), (9, "en"), (10, "en")}


def test_segments_cover_and_are_sure(spark, model):
    t = text("en", 3) + " " + text("fr", 3)
    seg = model.segments(t)
    assert [s[2] for s in seg] == ["en", "fr"] and seg[0][0] == 0 and seg[-1][1] == len(t) and seg[0][1] == seg[1][0] and min(s[3] for s in seg) > 0.99
    assert abs(seg[0][1] - len(" ".join(t.split(".")[:3]))) < 8


def test_decoding_by_brute_force():
    """Path and posteriors of all sequences of languages, for texts of several lengths side by side."""
    r = np.random.default_rng(1)
    size = np.array([4, 3, 1])
    start, s = np.cumsum(size) - size, r.normal(0, 4, (8, 3))
    path, alpha, beta = g.Model._decode(s, start, size)
    stay, change = np.log1p(-np.exp(-g.SWITCH)), -g.SWITCH  # a change is to any language, the old one too
    for a, n in zip(start, size):
        every = list(itertools.product(range(3), repeat=int(n)))
        best = max(every, key=lambda w: sum(s[a + i, x] for i, x in enumerate(w)) - g.SWITCH * sum(x != y for x, y in zip(w, w[1:])))
        assert tuple(path[a : a + n]) == best
        steps = lambda w: sum(np.logaddexp(stay, change) if x == y else change for x, y in zip(w, w[1:]))
        weight = {w: np.exp(sum(s[a + i, x] for i, x in enumerate(w)) + steps(w)) for w in every}
        total = sum(weight.values())
        for i in range(n):
            for x in range(3):
                assert np.isclose(np.exp(alpha[a + i, x] + beta[a + i, x] - np.logaddexp.reduce(alpha[a + n - 1])), sum(v for w, v in weight.items() if w[i] == x) / total)


def test_short_texts_and_unknown_languages(spark, model):
    rows = [(1, "Der Messingteller.", None), (2, "la théière", None), (3, "Zorbatu kilampo wuzzek drimol fanqua yolpet brunzig hextar. " * 3, None), (4, "12 €, +91 44 55", None)]
    assert found(spark, model, rows) == {(1, "de"), (2, "fr")}
    (x,) = model.segments(rows[2][1])
    assert x[2] == g.OTHER and x[3] > 0.9


def test_a_rare_second_script_is_kept_and_wrong_labels_make_none(spark):
    """An eighth of the texts labelled hi are romanised: more than half as many are English ones so labelled; fr has wrong Hindi ones."""
    rows = [(text("hi"), "hi") for _ in range(70)] + [(text("latin"), "hi") for _ in range(11)] + [(text("en"), "hi") for _ in range(7)] + [(text("en"), "en") for _ in range(60)]
    rows += [(text("fr"), "fr") for _ in range(60)] + [(text("hi"), "fr") for _ in range(6)] + [(text("de"), "fr") for _ in range(5)] + [(text("de"), "de") for _ in range(60)]
    m = g.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string"))
    ask = [(1, text("latin"), "en"), (2, text("en"), "hi"), (3, text("hi"), "fr"), (4, text("de"), "fr"), (5, text("latin"), "hi"), (6, text("hi"), "hi")]
    assert found(spark, m, ask) == {(1, "hi"), (2, "en"), (3, "hi"), (4, "de")}


def test_forward_is_the_sum_over_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]
    p = np.array([0.2, 0.1, 0.15, 0.2, 0.05, 0.2, 0.1])
    m = g.Model(pieces, ["x", g.OTHER], [np.stack([p, p], axis=1)] * 2, np.zeros((2, 2)))

    def total(b):
        return 1.0 if not b else sum(p[k] * total(b[len(x) :]) for k, x in enumerate(pieces) if b.startswith(x))

    for w in ("a", "ab", "ababa", "bbaab"):
        assert np.isclose(m.word(w)[0], np.log(total(b" " + w.encode()))) and np.isclose(m._long(b" " + w.encode(), m.tables[0])[0], m.word(w)[0])
    a, b = m.word("ab" * 3000), m.word("ab" * 6000)  # far below the least double
    assert np.isfinite(b).all() and np.allclose(b / a, 2, rtol=1e-3) and a[0] < -1000


def test_fit_raises_the_likelihood():
    pieces = [bytes([i]) for i in range(256)] + [b" the", b"the", b"th", b"he", b" s"]
    index = g.Pieces(pieces)
    words = Counter({"the": 50, "she": 20, "he": 10})
    like = []
    for n in (0, 1, 4):
        q = g.fit(words, index, n)
        m = g.Model(pieces, ["x", g.OTHER], [np.stack([q, q], axis=1)] * 2, np.zeros((2, 2)))
        like.append(sum(c * m.word(w)[0] for w, c in words.items()))
    assert like[0] < like[1] < like[2] and np.isclose(q.sum(), 1)


def test_labels(spark):
    x = spark.createDataFrame([(v,) for v in ("en-IN", "ENG", " English ", "por", "und", "", None, "??", "it", "bn_IN")], "l string")
    assert [r.c for r in x.select(g.label_code(F.col("l")).alias("c")).collect()] == ["en", "en", "en", "pt", None, None, None, None, "it", "bn"]


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    m = g.train(e)
    assert m.languages == [] and g.segments(spark.createDataFrame(ROWS[:2], e.schema), m).count() == 0 and g.relabel(e, g.segments(e, m)).count() == 0


def test_sentences_cover():
    for t in ("A b. C d! e\nf", "", "\n\n.", "यह है। वह है।", "3.5 is a no. of x.y.z ok", "." * 50):
        assert "".join(t[a:b] for a, b in g.sentences(t)) == t
