"""Order-dependent deduplication: a row wins unless an earlier winner has one of its keys.

Only winners register their keys, so this is not connected components: it is the lexicographically first maximal
independent set of the conflict graph. It is computed in rounds of two group-bys: rows that are first among the undecided in
every one of their keys win, then whatever shares a key with a winner is a duplicate of it. No group is ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import is_missing
from leadloom.functions.urls import KnownHosts
from leadloom.session import cut

#: Fields of a record that may be missing, with their kinds.
OPTIONAL = {"emails": "array", "phones": "array", "socials": "map", "category": "string", "description": "string", "logo_url": "string", "state": "string"}


def completeness():
    """How many optional fields are filled."""
    return reduce(lambda a, b: a + b, [(~is_missing(F.col(c), k)).cast("int") for c, k in OPTIONAL.items()])


def first_winners(rows: DataFrame, id_col: str, order: list[str], keys: list[str]) -> DataFrame:
    """(id, duplicate_of): null for winners; for others the winner that has the first of ``keys`` in common, else the next.

    ``order`` (ties: the id) sorts the rows, nulls first. A null key conflicts with nothing. Repeated ids are not allowed. Every
    round decides the first undecided row and all that are first in their keys, so it ends for any table; only chains in which each
    row conflicts with the next take many rounds.
    """
    every = left = cut(rows.select(F.col(id_col).alias("id"), *keys, F.struct(*order, F.col(id_col).alias("_id")).alias("rank")))
    winners = None
    while True:
        x, first = left, F.lit(True)
        for k in keys:
            low = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("rank").alias(f"_low_{k}"))
            x = x.join(low, k, "left")
            first = first & (F.col(k).isNull() | (F.col("rank") == F.col(f"_low_{k}")))
        new = cut(x.where(first).select("id", *keys, "rank"))
        winners = new if winners is None else winners.unionByName(new)
        left = left.join(new.select("id"), "id", "left_anti")
        for k in keys:
            left = left.join(new.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        left = cut(left.select("id", *keys, "rank"))
        if left.isEmpty():
            break
    # whose duplicate a row is can only be told now: the winner of its first key may have been decided after that of its second
    x = every.join(winners.select("id", F.lit(True).alias("wins")), "id", "left")
    for k in keys:
        w = winners.where(F.col(k).isNotNull()).select(k, F.col("id").alias(f"_of_{k}"), F.col("rank").alias(f"_rank_{k}"))
        x = x.join(w, k, "left").withColumn(f"_of_{k}", F.when(F.col(f"_rank_{k}") < F.col("rank"), F.col(f"_of_{k}"))).drop(f"_rank_{k}")
    return x.select("id", F.when(F.col("wins").isNull(), F.coalesce(*[f"_of_{k}" for k in keys])).alias("duplicate_of"))


def current_stores(stores: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The row of the latest ``observed_at`` of each store. Exact repeats are dropped; ties go by the greatest hash."""
    cols = columns or stores.columns
    x = stores.where("store_id IS NOT NULL").select(*cols)
    tie = F.xxhash64(*[c for c, k in x.dtypes if not k.startswith("map")])
    return x.groupBy("store_id").agg(F.max_by(F.struct(*cols), F.struct("observed_at", tie)).alias("_r")).select("_r.*")


def shop_rows(stores: DataFrame, known: KnownHosts) -> DataFrame:
    """Accepted current stores with identity (site of shop_identity), site (of domain_url), tenant and completeness."""
    x = current_stores(stores).where("status = 'accepted'")
    x = known.with_site(x, "shop_identity", "i_").withColumnRenamed("i_site", "identity").drop("i_host", "i_parent", "i_tenant")
    x = known.with_site(x, "domain_url").drop("host", "parent")
    return x.withColumns({"tenant": F.coalesce("tenant", F.lit(True)), "filled": completeness()})


def shop_winners(shops: DataFrame) -> DataFrame:
    """(id, duplicate_of) of ``shop_rows``: own domain before tenant, then most complete, then by address."""
    ranked = shops.withColumn("unfilled", -F.col("filled"))
    return first_winners(ranked, "store_id", ["tenant", "unfilled", "domain_url"], ["identity", "site"])


def merged_contacts(shops: DataFrame, decided: DataFrame) -> DataFrame:
    """(store_id, emails, phones, aliases, socials) of each winner: the sorted union over it and its duplicates (whose addresses are
    aliases), socials by network."""
    x = shops.join(decided.select(F.col("id").alias("store_id"), F.coalesce("duplicate_of", "id").alias("winner")), "store_id")
    none = F.array().cast("array<string>")
    lists = [F.struct(F.lit(c).alias("field"), F.coalesce(v, none).alias("values")) for c, v in (("emails", F.col("emails")), ("phones", F.col("phones")), ("aliases", F.coalesce(F.when(F.col("winner") != F.col("store_id"), F.array_append(F.coalesce("aliases", none), F.col("domain_url"))), "aliases")))]
    nets = F.transform(F.coalesce(F.map_entries("socials"), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: F.struct(F.concat(F.lit("socials:"), e["key"]).alias("field"), F.coalesce(e["value"], none).alias("values")))
    x = x.select("winner", F.explode(F.concat(F.array(*lists), nets)).alias("x"))
    x = x.select("winner", "x.field", F.explode_outer("x.values").alias("value")).distinct()
    x = x.groupBy("winner", "field").agg(F.array_sort(F.array_compact(F.collect_list("value"))).alias("vs"))
    of = lambda c: F.max(F.when(F.col("field") == c, F.col("vs"))).alias(c)
    net = F.struct(F.substring("field", 9, 1 << 20).alias("k"), F.col("vs").alias("v"))
    by_net = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").startswith("socials:") & (F.size("vs") > 0), net)))).alias("socials")
    return x.groupBy(F.col("winner").alias("store_id")).agg(of("emails"), of("phones"), of("aliases"), by_net)


def merged_evidence(decided: DataFrame, evidence: DataFrame, fields: tuple[str, ...] = ("emails", "phones", "socials")) -> DataFrame:
    """``evidence`` of each winner, each row once, and rows on ``fields`` of its duplicates that it hasn't itself (``added``)."""
    cols = [c for c in evidence.columns if c != "store_id"]
    to = decided.select(F.col("id").alias("store_id"), F.coalesce("duplicate_of", "id").alias("winner"), F.col("duplicate_of").isNotNull().alias("added"))
    x = evidence.join(to, "store_id").where(~F.col("added") | F.col("field").isin(*fields))
    return x.groupBy(F.col("winner").alias("store_id"), *cols).agg(F.bool_and("added").alias("added"))
