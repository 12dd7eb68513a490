"""Problem 2: one record for each group of stores that are one and the same shop.

Groups: current rows of stores are connected by the sites that their ``domain_url``, ``shop_identity`` and ``aliases`` name.
Records: Bayesian fusion with copy detection (Dong, Berti-Equille, Srivastava 2009). A *source* is whatever brought a store
(the earliest lead list, say); it claims a value for each (group, field). Rounds estimate, in turn, the probability of
each value, the accuracy of each source, and for each two sources the probability that one copies the other (shared false
values speak for copying, shared true ones hardly); votes that are probably copied are discounted. The value of greatest
probability wins; ties go to the greater value in code-point order. The rounds start from plain votes, so copies are found as
long as copied false values are not most of what is claimed.

Claims are first collapsed to distinct (group, field, value, source), so that neither a group with a third of all stores
nor a source with a third of all claims meets itself row by row. Only sources are paired, never stores: for shared values the
sources of one (group, field, value), and for different values the products of two sources' counts in a (group, field).
Every two sources that meet in a contested (group, field) are tested; what an item costs is bounded by the lists it is in.

The survivor's id follows the fixed rule of the task, which no fused value changes; still, members are the stores that the
fused records stand for, so whoever asks for them has every round computed.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contacts import phone
from leadloom.functions.text import is_missing, squeezed, trimmed, unaccented
from leadloom.functions.urls import KnownHosts, host_of
from leadloom.operators.graph import components
from leadloom.operators.incremental import row_key
from leadloom.session import cut, small

#: Fields that are fused to one value; those of UNITED are united.
FUSED = ("name", "category", "description", "logo_url", "state", "domain_url", "shop_identity")
UNITED = ("emails", "agency_emails", "phones", "aliases", "socials")
#: Fused addresses and the columns with their sites: spellings of one site count as one value, no site claims nothing.
SITES = {"domain_url": "site", "shop_identity": "i_site"}
#: Fields whose being filled counts for completeness, with their kinds.
COUNTED = {"emails": "array", "phones": "array", "socials": "map", "category": "string", "description": "string", "logo_url": "string", "state": "string"}
#: Fields whose spellings count as one value.
FOLDED = ("name", "category", "state")
FALSE_VALUES = 10.0  # n: how many false values an item is taken to have
COPY_RATE = 0.8  # c: the share of its values that a copier copies
PRIOR_COPY = 0.2  # alpha: probability, before any evidence, that two sources depend on each other
START_ACCURACY = 0.8
ROUNDS = 3
#: An address that stores of more than this many groups name is taken for an agency's: it is kept apart from the shop's own.
AGENCY_GROUPS = 3


def current_rows(stores: DataFrame) -> DataFrame:
    """The row of the latest ``observed_at`` of each ``store_id`` (null is earliest; ties: by a hash of the whole row).
    Rows without a ``store_id`` are dropped. Aggregated map-side."""
    h1, h2 = row_key(stores)
    x = stores.where("store_id IS NOT NULL").withColumns({"_h1": h1, "_h2": h2})
    best = x.groupBy("store_id").agg(F.max_by(F.struct(*stores.columns), F.struct("observed_at", "_h1", "_h2")).alias("_row"))
    return best.select("_row.*")


def site_edges(current: DataFrame, known: KnownHosts) -> DataFrame:
    """(store_id, site): the sites that each store names in any of the three fields, each once."""
    named = current.select("store_id", F.explode(F.array_distinct(F.concat(F.array("domain_url", "shop_identity"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("named"))
    sites = known.with_site(named.where("named IS NOT NULL").distinct(), "named")
    return cut(sites.select("store_id", "site").distinct()).where("site IS NOT NULL")


def groups(edges: DataFrame) -> DataFrame:
    """(store_id, group_id) of stores in groups of two or more; ``group_id`` is the smallest ``store_id``."""
    low = edges.groupBy("site").agg(F.min("store_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = edges.join(low, "site").where("store_id <> a").select("a", F.col("store_id").alias("b"))
    return components(pairs).select(F.col("node").alias("store_id"), F.col("component").alias("group_id"))


def completeness(*names: str) -> Column:
    """How many of the counted fields are neither null nor empty."""
    return reduce(lambda a, b: a + b, [(~is_missing(F.col(c), COUNTED[c])).cast("int") for c in names or COUNTED])


def survivors(members: DataFrame) -> DataFrame:
    """(group_id, survivor_id, size): off the platform before a tenant (or no site), then most complete, then the first
    ``domain_url`` in code-point order (null last), then the smallest ``store_id``."""
    rank = F.struct(F.coalesce("tenant", F.lit(True)), -completeness(), F.col("domain_url").isNull(), F.col("domain_url"), F.col("store_id"))
    return members.groupBy("group_id").agg(F.min(rank).alias("r"), F.count("*").alias("size")).select("group_id", F.col("r.store_id").alias("survivor_id"), "size")


def claims(members: DataFrame, fields: tuple[str, ...] = FUSED) -> DataFrame:
    """(group_id, field, value, shown, source) of the non-empty ``fields``. ``shown`` is the value with its white space
    squeezed; ``value`` is what is compared: of FOLDED fields the letters and digits without case and accents, of SITES the site."""
    site = lambda c: F.col(SITES[c]) if c in SITES else F.lit(None).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), squeezed(F.col(c)).alias("shown"), site(c).alias("site")) for c in fields])).alias("x")
    x = members.select("group_id", "source", pairs).select("group_id", "x.field", "x.shown", "x.site", "source").where("shown <> ''")
    x = x.where(~F.col("field").isin(*SITES) | F.col("site").isNotNull())
    fold = F.nullif(F.regexp_replace(unaccented(F.col("shown")), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    return x.withColumn("value", F.when(F.col("field").isin(*FOLDED), F.coalesce(F.trim(fold), "shown")).otherwise(F.coalesce("site", "shown"))).drop("site")


def fuse(claimed: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values (group_id, field, value, p), sources (source, accuracy) and dependences (s, t, dep: probability that s and t
    depend on each other) after ``rounds``. Items that a single source claims one value for have p 1."""
    item = ["group_id", "field"]
    c = cut(claimed)
    votes = c.groupBy(*item).agg(F.count("*").alias("all"))
    c = cut(c.join(votes, item))
    contested = cut(c.where("all > 1").select(*item, "value", "source", "all"))
    p = contested.groupBy(*item, "value", "all").agg(F.count("*").alias("n")).select(*item, "value", (F.col("n") / F.col("all")).alias("p"))
    # a single claim of an item has probability 1 in every round: of each source only how many they are
    base = cut(c.groupBy("source").agg(F.count("*").alias("claims"), F.count_if(F.col("all") == 1).alias("alone")))
    contested = contested.drop("all")
    shared, met = cut(_pairs(contested, [*item, "value"])), _pairs(contested.groupBy(*item, "source").agg(F.count("*").alias("n")), item, "n")
    met = cut(met.groupBy("s", "t").agg(F.sum("n").cast("double").alias("met")))
    accuracy, dependence = None, None
    for _ in range(rounds):
        p = cut(p)
        got = contested.join(p, [*item, "value"]).groupBy("source").agg(F.sum("p").alias("p"))
        right = F.coalesce("p", F.lit(0.0)) + F.col("alone") + 5 * START_ACCURACY
        accuracy = cut(base.join(got, "source", "left").select("source", F.least(F.lit(0.99), F.greatest(F.lit(0.05), right / (F.col("claims") + 5))).alias("accuracy")))
        dependence = cut(_dependence(shared, met, p, accuracy))
        p = _votes(contested, shared, accuracy, dependence)
    return c.where("all = 1").select(*item, "value", F.lit(1.0).alias("p")).unionByName(p), accuracy, dependence


def _pairs(rows: DataFrame, on: list[str], count: str | None = None) -> DataFrame:
    """(on..., s, t): two sources of the same ``on``, s < t; with ``count`` the product of their counts as n."""
    a, b = rows.alias("a"), rows.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]) & (F.col("a.source") < F.col("b.source"))
    n = [(F.col(f"a.{count}") * F.col(f"b.{count}")).alias("n")] if count else []
    return a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in on], F.col("a.source").alias("s"), F.col("b.source").alias("t"), *n)


def _dependence(shared: DataFrame, met: DataFrame, p: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(s, t, dep) by Bayes from the true (kt), false (kf) and different (kd) values that two sources give for shared items."""
    x = shared.join(p, ["group_id", "field", "value"]).groupBy("s", "t").agg(F.sum("p").alias("kt"), F.sum(1 - F.col("p")).alias("kf"), F.count("*").alias("same"))
    n = met.join(x, ["s", "t"], "left").fillna(0, ["kt", "kf", "same"]).withColumn("kd", F.col("met") - F.col("same"))
    acc = lambda k: accuracy.select(F.col("source").alias(k), F.col("accuracy").alias(f"a_{k}"))
    n = n.join(small(acc("s")), "s").join(small(acc("t")), "t")
    a = (F.col("a_s") + F.col("a_t")) / 2
    pt, pf = a * a, (1 - a) * (1 - a) / FALSE_VALUES
    pd = 1 - pt - pf
    log_indep = F.col("kt") * F.log(pt) + F.col("kf") * F.log(pf) + F.col("kd") * F.log(pd)
    log_dep = F.col("kt") * F.log(a * COPY_RATE + pt * (1 - COPY_RATE)) + F.col("kf") * F.log((1 - a) * COPY_RATE + pf * (1 - COPY_RATE)) + F.col("kd") * F.log(pd * (1 - COPY_RATE))
    odds = F.least(F.lit(700.0), log_indep - log_dep + F.log(F.lit((1 - PRIOR_COPY) / PRIOR_COPY)))
    return n.select("s", "t", "a_s", "a_t", (1 / (1 + F.exp(odds))).alias("dep"))


def _votes(contested: DataFrame, shared: DataFrame, accuracy: DataFrame, dependence: DataFrame) -> DataFrame:
    """New probabilities of contested values; a source's vote is discounted by the better (then smaller) sources of the same value."""
    item = ["group_id", "field"]
    c = contested.join(small(accuracy), "source")
    worse = F.when((F.col("a_t") > F.col("a_s")), F.col("s")).otherwise(F.col("t"))
    free = shared.join(small(dependence), ["s", "t"]).select(*item, "value", worse.alias("source"), F.log(1 - COPY_RATE * F.col("dep")).alias("free"))
    free = free.groupBy(*item, "value", "source").agg(F.sum("free").alias("free"))
    v = c.join(free, [*item, "value", "source"], "left")
    weight = F.log(FALSE_VALUES * F.col("accuracy") / (1 - F.col("accuracy"))) * F.exp(F.coalesce("free", F.lit(0.0)))
    score = v.groupBy(*item, "value").agg(F.sum(weight).alias("score"))
    top = score.groupBy(*item).agg(F.max("score").alias("top"), F.count("*").alias("kinds"))
    e = score.join(top, item).withColumn("e", F.exp(F.col("score") - F.col("top")))
    rest = F.exp(-F.col("top")) * F.greatest(F.lit(0.0), FALSE_VALUES - F.col("kinds"))
    total = e.groupBy(*item).agg(F.sum("e").alias("total"), F.first(rest).alias("rest"))
    return e.join(total, item).select(*item, "value", (F.col("e") / (F.col("total") + F.col("rest"))).alias("p"))


def shop_emails(members: DataFrame) -> DataFrame:
    """(group_id, field, value, n): every cleaned address that stores of a group name, n times; ``field`` is ``emails``, or
    ``agency_emails`` for an address that more than AGENCY_GROUPS groups name."""
    e = members.select("group_id", F.explode("emails").alias("e"))
    e = e.select("group_id", F.regexp_extract(F.lower(trimmed(F.col("e"))), r"^(?:mailto:)?([^\s@<>,;?]+@[^\s@<>,;?]+?)[.,;]*(?:\?.*)?$", 1).alias("value")).where("value <> ''")
    e = e.groupBy("group_id", "value").agg(F.count("*").alias("n"))
    used = e.groupBy("value").agg(F.count("*").alias("groups"))
    return e.join(used, "value").select("group_id", F.when(F.col("groups") > AGENCY_GROUPS, "agency_emails").otherwise("emails").alias("field"), "value", "n")


def shop_values(members: DataFrame) -> DataFrame:
    """(group_id, field, network, value, n): each distinct e-mail, phone number, alias and social profile of a group, named n times.

    As in the reference, each ``domain_url`` is an alias of the group; values that are no address are none. Phone numbers are
    one if their canonical forms (or digits) and extensions are; the spelling used most is shown. ``network`` is '' but for socials.
    """
    by = lambda c, rows, network: rows.select("group_id", F.lit(c).alias("field"), network.alias("network"), trimmed(F.col("v")).alias("value"))
    one = lambda c, name: by(c, members.select("group_id", F.explode(name).alias("v")), F.lit(""))
    linked = members.select("group_id", F.explode("socials").alias("k", "vs")).select("group_id", "k", F.explode("vs").alias("v"))
    x = one("phones", "phones").unionByName(one("aliases", "aliases")).unionByName(one("aliases", F.array("domain_url")))
    x = x.unionByName(by("socials", linked, F.lower(trimmed(F.col("k"))))).where("value <> ''")
    x = x.where((F.col("field") != "aliases") | host_of(F.col("value")).isNotNull())
    digits = F.coalesce(phone(F.col("value")), F.nullif(F.regexp_replace("value", "[^0-9+]", ""), F.lit("")), F.col("value"))
    number = F.concat_ws(" x", digits, F.nullif(F.regexp_extract("value", r"(?i)(?:ext\.?|x)\s*([0-9]+)\s*$", 1), F.lit("")))
    key = F.when(F.col("field") == "phones", number).otherwise(F.col("value"))
    x = x.withColumn("key", key).groupBy("group_id", "field", "network", "key", "value").agg(F.count("*").alias("n"))
    x = x.groupBy("group_id", "field", "network", "key").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.sum("n").alias("n"))
    emails = shop_emails(members).select("group_id", "field", F.lit("").alias("network"), "value", "n")
    return x.drop("key").unionByName(emails)


def united(values: DataFrame) -> DataFrame:
    """(group_id, emails, agency_emails, phones, aliases, socials): all values of each group, sorted; null where there is none."""
    x = values.groupBy("group_id", "field", "network").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    of = lambda c: F.max(F.when(F.col("field") == c, F.col("vs"))).alias(c)
    nets = F.array_sort(F.collect_list(F.when(F.col("field") == "socials", F.struct("network", "vs"))))
    return x.groupBy("group_id").agg(of("emails"), of("agency_emails"), of("phones"), of("aliases"), F.when(F.size(nets) > 0, F.map_from_entries(nets)).alias("socials"))


class Survivors:
    """``members`` (group_id, store_id, survivor_id) and ``records`` (one fused record a group) of ``stores``; ``values`` has
    the united values of the records as a long table, ``fused`` (group_id, field, value, p) the values that won.

    ``sources`` (candidate_id, name, discovered_at) says which list brought a store; stores without one count as one more
    source. Stores alone in their group are in neither result. Null and blank values claim nothing; exact repeats and
    older states are dropped first; an empty table gives empty results. Other columns of ``stores`` are ignored.
    Members come from the fused records; values need no fusion, and members no values.
    """

    def __init__(self, stores: DataFrame, sources: DataFrame, known_hosts: DataFrame, rounds: int = ROUNDS):
        self.sources, self.known, self.rounds = sources, KnownHosts.read(known_hosts), rounds
        wanted = ["store_id", "domain_url", "name", "shop_identity", "aliases", "observed_at", *COUNTED]
        now = cut(current_rows(stores.select(*wanted)))
        self.own = cut(self.known.with_site(now.join(groups(site_edges(now, self.known)), "store_id"), "domain_url"))

    @cached_property
    def survivor(self) -> DataFrame:
        return survivors(self.own)

    @cached_property
    def members(self) -> DataFrame:
        """The stores that each fused record stands for."""
        return self.own.select("group_id", "store_id").join(self.record.select("group_id", "survivor_id"), "group_id")

    @cached_property
    def values(self) -> DataFrame:
        return shop_values(self.own)

    @cached_property
    def claimed(self) -> DataFrame:
        """Claims by source: the list that named a store first, its spellings tidied."""
        brought = self.sources.where("candidate_id IS NOT NULL").groupBy(F.col("candidate_id").alias("store_id")).agg(F.min_by("name", F.struct("discovered_at", "name")).alias("source"))
        x = self.known.with_site(self.own, "shop_identity", "i_").join(brought, "store_id", "left")
        tidy = F.lower(F.regexp_replace(trimmed(F.col("source")), r"[\s_\-]+", " "))
        return cut(claims(x.withColumn("source", F.coalesce(tidy, F.lit("")))))

    @cached_property
    def fusion(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What ``fuse`` gives: values, accuracies and dependences."""
        return fuse(self.claimed.select("group_id", "field", "value", "source").distinct(), self.rounds)

    @cached_property
    def fused(self) -> DataFrame:
        spelled = self.claimed.groupBy("group_id", "field", "value", "shown").agg(F.count("*").alias("n"))
        spelled = spelled.groupBy("group_id", "field", "value").agg(F.max_by("shown", F.struct("n", "shown")).alias("shown"))
        # rounded, so that the order of sums of doubles decides no tie
        best = self.fusion[0].withColumn("p", F.round("p", 9)).groupBy("group_id", "field").agg(F.max(F.struct("p", "value")).alias("b")).select("group_id", "field", "b.value", "b.p")
        return best.join(spelled, ["group_id", "field", "value"]).select("group_id", "field", F.col("shown").alias("value"), "p")

    @cached_property
    def record(self) -> DataFrame:
        """The survivor, size and fused values of each group: a row of bounded width, however large the group. Cut, since Spark
        would drop the join with the fused values where none of them is read."""
        record = [F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in FUSED] + [F.max(F.when(F.col("field") == c, F.col("p"))).alias(f"p_{c}") for c in FUSED]
        return cut(self.survivor.join(self.fused.groupBy("group_id").agg(*record), "group_id", "left"))

    @cached_property
    def records(self) -> DataFrame:
        return self.record.join(united(self.values), "group_id", "left")
