import random

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import leakage as k

rng = random.Random(11)
VOC = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(800)]


def passage(n=70):
    return " ".join(rng.choice(VOC) for _ in range(n)).capitalize() + "."


ITEMS = [(i, passage()) for i in range(12)]
NOISE = [passage(60) for _ in range(20)]


def test_wu_manber_finds_what_a_scan_finds():
    for length, letters, n in ((12, "ab", 3000), (5, "abc", 800), (4, "ab", 200), (12, "abcdefgh", 5000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        patterns = [text[i : i + length] for i in range(0, n - length, 37)] + ["".join(rng.choice(letters) for _ in range(length)) for _ in range(50)]
        w = k.WuManber(patterns, length)
        at, which = w.find(k._codes(text))
        want = {(i, p) for p in set(patterns) for i in range(n - length + 1) if text.startswith(p, i)}
        assert {(int(a), w.patterns[b]) for a, b in zip(at, which)} == want and len(at) == len(want)
    assert len(k.WuManber([]).find(k._codes("abc"))[0]) == 0 and len(k.WuManber(["a" * 12]).find(k._codes("a"))[0]) == 0


def variants(p):
    w = p.split()
    half = " ".join(w[: len(w) // 2])
    typo = " ".join(x[:-2] + x[-1] + x[-2] if i % 6 == 5 and len(x) > 4 else x for i, x in enumerate(w))
    return {
        "case": p.upper(), "lines": "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)), "half": NOISE[0] + " " + half + " " + NOISE[1], "html": "&lt;p&gt;" + "&nbsp;".join(w) + "&lt;/p&gt;",
        "zero width": "​".join(p), "typos": typo, "pieces": " ".join(w[:20]) + " " + NOISE[2] + " " + " ".join(w[40:60]), "changed": " ".join("other" if i % 9 == 4 else x for i, x in enumerate(w)),
        "broken": p.replace(w[7], w[7][:2] + "-\n" + w[7][2:], 1),
    }


def test_cases(spark):
    docs, want = [], set()
    for i, p in ITEMS:
        for name, t in variants(p).items():
            docs.append((len(docs), t))
            want.add((len(docs) - 1, i, name))
        words = p.split()
        docs += [(len(docs), NOISE[i % 20] + " " + " ".join(words[3:15]) + " " + NOISE[(i + 3) % 20])]  # too little of it
    docs += [(9001, None), (9002, ""), (9003, "word " * 50_000 + ITEMS[0][1] + " word" * 50_000), (9004, "a"), (9005, ITEMS[1][1]), (9006, ITEMS[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).repartition(3)
    got = {(r.doc_id, r.item_id) for r in k.leaked(d, spark.createDataFrame(ITEMS, "item_id bigint, passage string")).collect()}
    assert got == {(a, b) for a, b, _ in want} | {(9003, 0), (9005, 1), (9006, 1)}


def off(w):
    """``w`` with one letter changed, if that keeps it the same word."""
    k = rng.randrange(len(w))
    return w[:k] + rng.choice("aeiouxz") + w[k + 1 :] if len(w) >= 4 else w


def altered(w):
    """Thirds and a little more of a passage that hardly keep a fragment, in one or two pieces."""
    third = len(w) // 3 + 1
    yield "misspelt", " ".join(map(off, w[:third]))
    yield "misspelt pieces", " ".join(map(off, w[:13])) + " " + NOISE[4] + " " + " ".join(map(off, w[40:53]))
    yield "every third changed", " ".join("else" if i % 3 == 2 else x for i, x in enumerate(w[:40]))
    yield "one word in six", " ".join(off(x) if i % 6 == 3 else x for i, x in enumerate(w[10:23])) + " " + NOISE[5] + " " + " ".join(off(x) if i % 6 == 1 else x for i, x in enumerate(w[50:62]))


def test_altered_thirds_are_found_as_a_plain_alignment_finds_them(spark):
    searcher, docs, want = k.Searcher(ITEMS), [], set()
    for n, (i, p) in enumerate(ITEMS):
        for name, t in altered(p.split()):
            docs.append((len(docs), NOISE[n] + " " + t + " " + NOISE[(n + 5) % 20]))
            want.add((len(docs) - 1, i))
    found = {(a, b) for a, b, _, _ in searcher.search(*map(list, zip(*docs)))}
    flat, starts = searcher.vocabulary.read([k.words(t) for _, t in docs])
    first, types = k._csr(searcher.vocabulary.readings)
    plain = set()
    for d, t in docs:
        for x, (i, p) in enumerate(ITEMS):
            m = searcher._matches(x, flat[starts[d] : starts[d] + len(k.words(t))], first, types)
            ((hits, _),) = k.carried([[m]], [None])
            plain |= {(d, i)} if hits >= k.least_words(len(m)) else set()
    assert found == plain and len(plain & want) > 0.95 * len(want)


def test_short_passages(spark):
    items = spark.createDataFrame([(1, "tea"), (2, "चाय"), (3, "kiwi"), (4, "salt and tea"), (5, "the red salt pan")], "item_id bigint, passage string")
    rows = [(1, "Some TEA, please"), (2, "हमें चाय दो"), (3, "two kiwis"), (4, "salt and more"), (5, "Salt and tea!"), (6, "a red, red salt pan"), (7, "in the red salt pan"), (8, "team"), (9, "steam and sand")]
    got = {(r.doc_id, r.item_id) for r in k.leaked(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 1), (5, 4), (7, 5)}


def test_only_tags_are_tags():
    assert k.words("price < 5 the passage and > 3") == "price 5 the passage and 3".split() and k.words("a <b the passage c> d") == "a b the passage c d".split()
    assert k.words('a <p class="x y">b</p><br/>c <!-- said so --> <img alt=\'red tea\' src=z> d') == "a b c d x y said so red tea".split()
    assert k.words("if a<b and c>d") == "if a b and c d".split() and k.words(None) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, NOISE[i] + " " + p) for i, p in ITEMS], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS + [(None, "x"), (99, None), (3, ITEMS[3][1])], "item_id bigint, passage string")
    one = {(r.doc_id, r.item_id) for r in k.leaked(d, items).collect()}
    monkeypatch.setattr(k, "ITEMS_PER_BLOCK", 5)
    assert len(k.blocks(items)) == 3 and {(r.doc_id, r.item_id) for r in k.leaked(d, items).collect()} == one == {(i, i) for i, _ in ITEMS}


def test_empty(spark):
    d, i = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, passage string")
    assert k.leaked(d, i.limit(0)).count() == 0 and k.leaked(d.limit(0), i).count() == 0 and k.leaked(d, spark.createDataFrame([(1, "!!")], "item_id bigint, passage string")).count() == 0


def test_passages(spark):
    e = spark.createDataFrame([(1, "Read.\nThe passage.\nWhy?"), (2, "only"), (3, ""), (4, None), (5, "a\n\nb")], "item_id bigint, text string")
    assert [r.passage for r in k.passages(e).orderBy("item_id").collect()] == ["The passage.", "only", None, None, "b"]


def test_alignment_by_brute_force():
    for _ in range(40):
        p, t = [rng.choice("abcd") for _ in range(rng.randrange(1, 8))], [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        match = np.array([[x == y for y in t] for x in p])
        h, best = [[0] * (len(t) + 1) for _ in range(len(p) + 1)], 0
        for i in range(len(p)):
            for j in range(len(t)):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if match[i][j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                best = max(best, h[i + 1][j + 1])
        a, b, hits = k.pieces([match, match[:, :1]], [np.ones(len(p), bool)] * 2)[0]
        assert (hits > 0) == (best > 0) and hits >= best and b - a >= hits


def test_same_word():
    assert k.same_word("abcd", "abdc") and k.same_word("abcd", "abcde") and k.same_word("abcde", "abcd") and k.same_word("abcd", "xbcd")
    assert not k.same_word("abc", "abd") and not k.same_word("abcd", "abxy") and not k.same_word("abcdef", "abcd")
