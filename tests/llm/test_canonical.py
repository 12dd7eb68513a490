import datetime as dt
import random

from pyspark.sql import functions as F

from leadloom.llm import canonical as c

CANON = [(1, "state", "Eastern Vellara", ["Purva Vellara", "Ombalur"]), (2, "state", "Western Vellara", ["Jhirkanda"]), (3, "state", "Arkanadu", None), (4, "category", "Pickles and chutneys", ["achaar jars"]), (5, "category", "Men's formal shirts", [])]
SCHEMA = "canon_id bigint, kind string, canonical string, also_known array<string>"


def meant(spark, *values):
    v = spark.createDataFrame(list(values), "kind string, value string")
    return {(r.kind, r.value): r.canon_id for r in c.resolve(v, spark.createDataFrame(CANON, SCHEMA)).collect()}


def test_values(spark):
    want = {
        ("state", "Eastern Vellara"): 1, ("state", "EasternVellara"): 1, ("state", "Vellara, Eastern"): 1, ("state", "near westérn  vellara (head office)"): 2, ("state", "Arkandau, India"): 3, ("state", "ombalur!"): 1,
        ("state", "East. Vellara"): 1, ("state", "A r k a n a d u"): 3, ("state", "state: E a s t e r n V e l l a r a !"): 1, ("state", "Ark anadu - 440 041"): 3, ("state", "pan-india"): 0, ("state", "00000"): 0, ("state", ""): 0, ("state", "Zzyzx"): 0, ("category", "pickles &amp; chutneys!"): 4,
        ("category", "best achaar jars store"): 4, ("category", "Mens-formal-shirts > Sale"): 5, ("category", "Arkanadu"): 0, ("other", "Arkanadu"): 0,
    }
    assert meant(spark, *want, ("state", None), (None, "x"), ("state", "ombalur!")) == want


def test_very_long_value(spark):
    assert meant(spark, ("state", "noise " * 3000 + "arkanadu " + "word " * 3000), ("state", "x" * 20_000)) == {("state", "noise " * 3000 + "arkanadu " + "word " * 3000): 3, ("state", "x" * 20_000): 0}


def test_windows_are_all_runs_of_words_up_to_a_length(spark):
    rng = random.Random(5)
    texts = [[("x" if rng.random() < 0.5 else "ab" * rng.randrange(1, 9)) + str(i % 7).translate(str.maketrans("0123456", "cdefghi")) for i in range(n)] for n in (1, 2, 7, 40)]
    rows = spark.createDataFrame([(str(i), w, 12) for i, w in enumerate(texts)], "value string, w array<string>, most int")
    got = {(r.value, r.form) for r in c.windows_of(rows, "most").collect()}
    assert got == {(str(i), f) for i, w in enumerate(texts) for a in range(len(w)) for b in range(a, len(w)) if len(f := "".join(w[a : b + 1])) <= 12}


def test_empty(spark):
    assert meant(spark) == {}
    v = spark.createDataFrame([("state", "Arkanadu")], "kind string, value string")
    assert c.resolve(v, spark.createDataFrame([], SCHEMA)).first().canon_id == 0


def token_set(s):
    n = {}
    out = {s[i : i + 2] for i in range(len(s) - 1)} | {s[i] + "_" + s[i + 2] for i in range(len(s) - 2)}
    for ch in s:
        n[ch] = n.get(ch, 0) + 1
        out.add(ch + str(n[ch]))
    return out


def test_filters_lose_no_pair(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
    left, right = sorted({word() for _ in range(300)}), sorted({word() for _ in range(60)})
    w = spark.createDataFrame([("k", x) for x in left], "kind string, form string")
    f = spark.createDataFrame([("k", x, i) for i, x in enumerate(right)], "kind string, form string, canon_id bigint")
    for t in (0.43, 0.7):
        got = {r.form: round(r.jaccard, 9) for r in c.similar(w, f, t).collect()}
        best = {x: max(len(token_set(x) & token_set(y)) / len(token_set(x) | token_set(y)) for y in right) for x in left}
        assert got == {x: round(v, 9) for x, v in best.items() if v >= t}


def test_map_stores_takes_current_rows(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    rows = [("a", "Arkanado", "Pickles and chutneys", t[1]), ("a", "junk", "junk", t[0]), ("b", " ", None, t[0]), ("c", "Arkanadu ", " ", None), (None, "Arkanadu", "x", t[0])]
    s = spark.createDataFrame(rows, "store_id string, state string, category string, observed_at timestamp_ntz").withColumn("value", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r.store_id, r.field_name, r.canon_id) for r in c.map_stores(s, spark.createDataFrame(CANON, SCHEMA)).collect()}
    assert got == {("a", "state", 3), ("c", "state", 3)}
