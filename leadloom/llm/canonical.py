"""Problem 5: mapping freely typed values to a reference list.

Prefix-filter set-similarity join. A value is tidied to words; its windows of words (so that what is written around the
name does no harm) become sets of tokens of the joined-up letters: bigrams, bigrams that skip a letter, and numbered
letters, none of which depends on spaces, and the last not on order either. Tokens are ordered by their global rarity over
values and list together; only the rarest ``n - ceil(t n) + 1`` tokens of a set are joined, under the length and the
positional filter; Jaccard similarity is then verified exactly and the best entry kept.

All work is on distinct values: a value that a third of all rows have is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import trimmed, unaccented
from leadloom.session import cut, small

#: Jaccard similarity from which a window means an entry.
THRESHOLD = 0.43


def words(value: Column) -> Column:
    """Words of letters: entities and ``&`` resolved, apostrophes dropped, lower case, no accents, no digits. Null gives null."""
    v = F.regexp_replace(F.lower(value), "&amp;|&#38;", "&")
    v = F.regexp_replace(v, "&[a-z]{2,8};|&#[0-9]{1,6};", " ")
    v = F.replace(v, F.lit("&"), F.lit(" and "))
    v = F.regexp_replace(unaccented(v), "['‘’`]", "")
    return F.filter(F.split(v, r"[^\p{L}\p{M}]+"), lambda w: w != "")


def tokens(joined: Column) -> Column:
    """The token set of joined-up letters; empty for the empty string."""
    n = F.length(joined)
    at = lambda i, k=1: F.substring(joined, i, F.lit(k))
    upto = lambda m: F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(upto(n - 1), lambda i: at(i, 2))
    skips = F.transform(upto(n - 2), lambda i: F.concat(at(i), F.lit("_"), at(i + 2)))
    letters = F.array_distinct(F.filter(F.split(joined, ""), lambda c: c != ""))
    count = lambda c: n - F.length(F.replace(joined, c, F.lit("")))
    numbered = F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda i: F.concat(c, i.cast("string")))))
    return F.array_distinct(F.concat(pairs, skips, numbered))


def forms(canon: DataFrame) -> DataFrame:
    """(kind, canon_id, form): the joined-up letters of each entry and each of its other names."""
    f = canon.select("kind", "canon_id", F.explode(F.concat(F.array("canonical"), F.coalesce("also_known", F.array().cast("array<string>")))).alias("f"))
    return f.select("kind", "canon_id", F.array_join(words(F.col("f")), "").alias("form")).where("form <> ''").distinct()


def _prefixes(rows: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """Columns of ``rows`` (kind, form, ...), n (tokens), pos and token of each of a set's rarest ``n - ceil(t n) + 1`` tokens."""
    keys = [c for c in rows.columns if c != "t"]
    x = rows.select(*keys, F.explode("t").alias("token")).join(small(rarity), ["kind", "token"])
    x = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rarity", "token"))).alias("o")).withColumn("n", F.size("o"))
    prefix = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    return x.select(*keys, "n", F.posexplode(F.transform(prefix, lambda t: t["token"])).alias("pos", "token"))


def similar(windows: DataFrame, canon_forms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, form, canon_id, jaccard): the best entry of each of the distinct ``windows`` (kind, form) that has one.

    Ties: the smaller Levenshtein distance, then the smaller ``canon_id``. Only the prefixes of both sides
    are joined (the list's are broadcast where they are small); each set is built once and fetched for the pairs that pass.
    """
    left, right = (cut(x.distinct().withColumn("t", tokens(F.col("form")))) for x in (windows.select("kind", "form"), canon_forms.select("kind", "form", "canon_id")))
    both = left.select("kind", "t").unionByName(right.select("kind", "t"))
    rarity = cut(both.select("kind", F.explode("t").alias("token")).groupBy("kind", "token").agg(F.count("*").alias("rarity")))
    x, y = _prefixes(left, rarity, threshold).alias("x"), small(cut(_prefixes(right, rarity, threshold))).alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    need = F.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9)
    on = (
        (F.col("x.kind") == F.col("y.kind"))
        & (F.col("x.token") == F.col("y.token"))
        & (nx >= F.ceil(ny * threshold - 1e-9))
        & (ny >= F.ceil(nx * threshold - 1e-9))
        & (F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) >= need - F.least("x.pos", "y.pos"))
    )
    pairs = x.join(y, on).select("x.kind", "x.form", "y.canon_id", F.col("y.form").alias("entry")).distinct()
    pairs = pairs.join(left.withColumnRenamed("t", "tx"), ["kind", "form"]).join(small(right.select("kind", "canon_id", F.col("form").alias("entry"), F.col("t").alias("ty"))), ["kind", "canon_id", "entry"])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("tx", "ty")))
    pairs = pairs.withColumn("jaccard", F.col("shared") / (F.size("tx") + F.size("ty") - F.col("shared"))).where(F.col("jaccard") >= threshold)
    best = F.max(F.struct("jaccard", (-F.levenshtein("form", "entry")).alias("near"), (-F.col("canon_id")).alias("id"))).alias("b")
    return pairs.groupBy("kind", "form").agg(best).select("kind", "form", (-F.col("b.id")).alias("canon_id"), F.col("b.jaccard").alias("jaccard"))


def windows_of(rows: DataFrame, most: str) -> DataFrame:
    """``rows`` (w: words, and an int column ``most``) by ``form``: the joined-up letters of each run of words that has at most ``most``.

    From each word on, ``2 most + 1`` characters are looked at: a run that goes on to their end has more than ``most`` letters.
    """
    x = rows.withColumn("_t", F.array_join("w", " ")).drop("w")
    starts = F.expr(f"regexp_extract_all(_t, concat('(?<![^ ])(?=([^ ].{{0,', cast(2 * {most} as string), '}}))'), 1)")
    x = x.withColumn("_from", F.explode(starts)).drop("_t").withColumn("_ws", F.split("_from", " ")).drop("_from")
    runs = F.transform(F.sequence(F.lit(1), F.size("_ws")), lambda k: F.array_join(F.slice("_ws", F.lit(1), k), ""))
    runs = F.filter(runs, lambda r: (F.length(r) > 0) & (F.length(r) <= F.col(most)))
    return x.withColumn("form", F.explode(F.array_distinct(runs))).drop("_ws").distinct()


def resolve(values: DataFrame, canon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, value, canon_id, jaccard) for each distinct (kind, value) of ``values``; ``canon_id`` 0 and similarity 0 where
    no entry is meant, so that unmatched values are reported. Null values and kinds are dropped; values without letters
    mean nothing. A value of any length costs windows in proportion to its words.

    A window of L letters has at least L tokens (its numbered letters), so one of more letters than the most tokens of an
    entry, divided by the threshold, can mean none: windows up to that length are all there are.
    """
    f = cut(forms(canon))
    most = f.groupBy("kind").agg(F.floor(F.max(F.size(tokens(F.col("form")))) / threshold).cast("int").alias("most"))
    v = values.where("kind IS NOT NULL AND value IS NOT NULL").select("kind", "value").distinct()
    v = cut(v.withColumn("w", words(F.col("value"))))
    whole = v.select("kind", "value", F.array_join("w", "").alias("form"))
    exact = whole.join(f.groupBy("kind", "form").agg(F.min("canon_id").alias("canon_id")), ["kind", "form"])
    exact = cut(exact.select("kind", "value", "canon_id", F.lit(1.0).alias("jaccard")))
    rest = v.join(exact.select("kind", "value"), ["kind", "value"], "left_anti").join(most, "kind").where(F.size("w") > 0)
    rest = cut(windows_of(rest, "most").select("kind", "value", "form"))
    found = rest.join(similar(rest, f, threshold), ["kind", "form"]).groupBy("kind", "value").agg(F.max(F.struct("jaccard", F.length("form").alias("len"), (-F.col("canon_id")).alias("id"))).alias("b"))
    near = found.select("kind", "value", (-F.col("b.id")).alias("canon_id"), F.col("b.jaccard").alias("jaccard"))
    return v.select("kind", "value").join(exact.unionByName(near), ["kind", "value"], "left").select("kind", "value", F.coalesce("canon_id", F.lit(0)).alias("canon_id"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def typed_fields(stores: DataFrame, fields: tuple[str, ...] = ("state", "category")) -> DataFrame:
    """(store_id, kind, value) of each current store row (latest ``observed_at``) and field that is not blank."""
    best = stores.where("store_id IS NOT NULL").groupBy("store_id").agg(F.max(F.struct("observed_at", *fields)).alias("r"))
    x = best.select("store_id", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(f"r.{c}").alias("value")) for c in fields])).alias("x"))
    x = x.select("store_id", "x.kind", "x.value")
    return x.where(trimmed(F.col("value")) != "")


def map_stores(stores: DataFrame, canon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(store_id, field_name, value, canon_id, jaccard) where the value is not exactly a ``canonical`` of its kind."""
    typed = cut(typed_fields(stores))
    kept = typed.join(canon.select("kind", F.col("canonical").alias("value")), ["kind", "value"], "left_anti")
    best = resolve(kept, canon, threshold)
    return kept.join(best, ["kind", "value"]).select("store_id", F.col("kind").alias("field_name"), "value", "canon_id", "jaccard")
