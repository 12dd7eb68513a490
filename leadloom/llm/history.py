"""Problem 1: checking batches of leads against everything already accepted.

Each shop front (site, however its address is written) has a fingerprint of 64 bits in three blocks, in which each occurrence
(character, how many of it so far) of its folded label flips one bit, and two anchors, the letters of either half of the label.
One mistyped character (one substituted, left out, added, doubled or two swapped) lies in one half of the label, so it spoils
one anchor, and flips at most two bits, so it spoils at most two blocks. A front is kept in rotated block tables, each
led by one anchor and one block of bits: of any two such fronts at least one table holds both under the same key. A key
holds half a label and a block besides, so that a trade word that a third of all labels end in makes no hot key by itself.

A look-up is an equi-join on that key; Hamming distance (at most 2) and then the text itself (Damerau-Levenshtein
distance of at most 1, same suffix) are verified in the join's condition, so that no unverified pair is ever written.

History is five append-only tables: ``blocks`` (fingerprint rows), ``leads`` (all leads by front), ``shops`` (the shop that a
front belongs to), ``firsts`` (a shop's earliest lead) and ``reports``. A batch adds rows to them. It looks up its own keys,
fronts and shops, and works on what these touch: where that is small (its bytes are summed first) it is broadcast and history
is scanned where it lies, else joined; old leads are read only of shops whose earliest lead has changed, and nothing
is grouped, linked or labelled anew beyond the touched shops.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import unaccented
from leadloom.functions.urls import KnownHosts
from leadloom.operators.graph import components
from leadloom.operators.incremental import Versions
from leadloom.session import cut, new_folder, small

BLOCKS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 2
#: Leads without a discovery time count as the latest.
NEVER = "9999-12-31"
#: Of a replay, how many last weeks are batches of their own.
LAST_WEEKS = 2
TABLES = {
    "blocks": "key bigint, front string, name string, suffix string, bits bigint",
    "leads": "front string, id string, discovered_at timestamp_ntz",
    "shops": "front string, shop string, version int",
    "firsts": "shop string, first struct<discovered_at:timestamp_ntz,id:string>",
    "reports": "id string, discovered_at timestamp_ntz, first_id string, first_discovered_at timestamp_ntz, front string, version int",
}
#: The key that the rows of a table are looked up by, and sorted by in its files.
LOOKUP = {"blocks": "key", "leads": "front", "shops": "front", "firsts": "shop", "reports": "id"}


def folded(label: Column) -> Column:
    """A label without accents and hyphens, in which mistyping is looked for."""
    return F.regexp_replace(unaccented(label), r"[^\p{L}\p{N}]", "")


def fingerprint(name: Column) -> Column:
    """64 bits; each occurrence (character, its number) of ``name`` flips one. Null for null, 0 for the empty string."""
    letters = F.array_distinct(F.filter(F.split(name, ""), lambda ch: ch != ""))
    count = lambda ch: F.length(name) - F.length(F.replace(name, ch, F.lit("")))
    seen = F.flatten(F.transform(letters, lambda ch: F.transform(F.sequence(F.lit(1), count(ch)), lambda i: F.concat(ch, i.cast("string")))))
    # shiftleft takes the low six bits of a variable distance only from SQL, hence the power of two by a lookup of bits
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(seen, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def block_rows(fronts: DataFrame) -> DataFrame:
    """(key, front, name, suffix, bits): the rotated block tables of ``fronts`` (front, name, suffix).

    Labels of n and n + 1 letters meet under anchors of (n - 1) // 2 letters, which no edit spoils on both sides; so a label
    is kept under anchors for its own length and, where that is another, for the length before.
    """
    f = fronts.select("front", "name", "suffix").withColumn("bits", fingerprint(F.col("name"))).withColumn("n", F.length("name"))
    keys = []
    for back in (1, 2):
        size = F.greatest(F.lit(0), F.floor((F.col("n") - back) / 2)).cast("int")
        again = F.lit(False) if back == 1 else (F.col("n") % 2 == 0) | (F.col("n") < 2)  # anchors of back 2 are those of back 1
        head, tail = F.substring("name", F.lit(1), size), F.substring(F.col("name"), F.col("n") - size + 1, size)
        for t, (start, width) in enumerate(BLOCKS):
            block = _block(F.col("bits"), start, width)
            for side, anchor in enumerate((head, tail)):
                spare = again if side == 0 else again | (size == 0)  # without letters one side is as good as two
                keys.append(F.when(~spare, F.xxhash64("suffix", F.lit(10 * side + t), size, anchor, block)))
    return f.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "front", "name", "suffix", "bits")


def one_typo(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of at most 1."""
    n = F.length(a)
    swap = F.exists(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.length(b)) & (n > 1) & (F.levenshtein(a, b, 2) == 2) & swap)


def _matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b), a < b: verified pairs of a front on the left and one on the right."""
    l, r = left.alias("l"), right.alias("r")
    on = (
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.suffix") == F.col("r.suffix"))
        & (F.col("l.front") != F.col("r.front"))
        & (F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))) <= MAX_BITS)
        & (F.abs(F.length("l.name") - F.length("r.name")) <= 1)
        & one_typo(F.col("l.name"), F.col("r.name"))
    )
    return l.join(r, on).select(F.least("l.front", "r.front").alias("a"), F.greatest("l.front", "r.front").alias("b")).distinct()


def leads(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, url, discovered_at): each candidate once, with its earliest discovery. Null ids are dropped."""
    seen = sources.where("candidate_id IS NOT NULL").groupBy(F.col("candidate_id").alias("id")).agg(F.min("discovered_at").alias("discovered_at"))
    return candidates.where("id IS NOT NULL").groupBy("id").agg(F.min("url").alias("url")).join(seen, "id", "left")


def with_front(rows: DataFrame, known: KnownHosts) -> DataFrame:
    """``rows`` (with url) and front (name.suffix), name, suffix; null where the url names no site."""
    x = known.with_site(rows, "url", "_").withColumn("suffix", F.coalesce("_parent", F.lit("")))
    label = F.when(F.col("suffix") != "", F.expr("substring(_site, 1, length(_site) - length(suffix) - 1)")).otherwise(F.col("_site"))
    x = x.withColumn("name", folded(label))
    return x.withColumn("front", F.when(F.col("name") != "", F.concat_ws(".", "name", F.nullif("suffix", F.lit(""))))).drop("_host", "_site", "_parent", "_tenant")


def of_small(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose ``on`` is in ``some``, which is broadcast if it is small."""
    return rows.join(small(some), on, "left_semi")


@dataclass
class FrontHistory:
    """Everything accepted so far: DataFrames by table name, and the version and folder that they were read from."""

    tables: dict[str, DataFrame]
    folder: str = ""
    version: int = -1
    parts: list[str] = field(default_factory=list)

    #: After so many parts a commit writes the whole history as one.
    COMPACT = 20

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "FrontHistory":
        """The version that the folder's pointer names; an empty history where there is none."""
        versions = Versions(spark, folder)
        v = versions.current()
        parts = versions.folders(v)
        read = lambda name, schema: spark.read.schema(schema).parquet(*[f"{p}/{name}" for p in parts]) if parts else spark.createDataFrame([], schema)
        return cls({name: read(name, schema) for name, schema in TABLES.items()}, folder, v, parts)

    def check(self, batch: DataFrame, known: KnownHosts) -> "FrontHistory":
        """What a batch (id, url, discovered_at) adds to this history; ``tables["reports"]`` of it has what it found.

        ``reports`` (id, discovered_at, first_id, first_discovered_at, front): one row for each lead, of the batch or
        accepted before, of which the batch changes what is to be said: that its front is one which another lead has with an
        earlier discovery time. ``first_id`` is the earliest of them (ties: the smallest id); it is null where an earlier
        report of the lead no longer holds. For each lead its last report holds, so that batches tell what one
        batch of all of them would, in whatever order leads and mistyped fronts between shops come in.

        Leads without a discovery time count as the latest and are never first while another is; leads whose url names no
        site are never repeats. A lead is never a repeat of itself; one that comes again has its earliest time.
        """
        old, version, later = self.tables, self.version + 1, bool(self.parts)
        at = F.coalesce("discovered_at", F.lit(NEVER).cast("timestamp_ntz"))
        rows = with_front(batch.where("id IS NOT NULL").select("id", "url", at.alias("discovered_at")), known)
        # the filter comes after the cut: pushed below the projections it would repeat their expressions within each other
        rows = cut(rows.select("id", "front", "name", "suffix", "discovered_at")).where("front IS NOT NULL")
        rows = rows.groupBy("front", "name", "suffix", "id").agg(F.min("discovered_at").alias("discovered_at"))
        rows = cut(rows) if later else rows
        fronts = cut(rows.groupBy("front", "name", "suffix").agg(F.min(F.struct("discovered_at", "id")).alias("first")))
        label_of = lambda some: cut(of_small(old["shops"], some, ["front"]).groupBy("front").agg(F.max_by("shop", "version").alias("was")))
        known_label = label_of(fronts.select("front")) if later else None
        new = fronts.join(known_label, "front", "left_anti") if later else fronts
        blocks = cut(block_rows(new))
        links = _matches(blocks, blocks)
        if later:
            links = links.unionByName(_matches(small(blocks), old["blocks"])).distinct()
        links = cut(links)

        # links tie the shops that the fronts were in: what is touched, never all of history
        label = fronts.select("front")
        if later:
            ends = links.select(F.explode(F.array("a", "b")).alias("front")).distinct().join(label, "front", "left_anti")
            label = label.unionByName(ends).join(known_label.unionByName(label_of(cut(ends))), "front", "left")
            label = cut(label.withColumn("new", F.col("was").isNull()).withColumn("was", F.coalesce("was", "front")))
            of = lambda k: label.select(F.col("front").alias(k), F.col("was").alias(f"s_{k}"))
            ties = links.join(of("a"), "a").join(of("b"), "b")
        else:
            label = label.withColumn("new", F.lit(True)).withColumn("was", F.col("front"))
            ties = links.select(F.col("a").alias("s_a"), F.col("b").alias("s_b"))
        merged = components(ties, "s_a", "s_b").select(F.col("node").alias("was"), F.col("component").alias("shop"))
        label = label.join(merged, "was", "left").withColumn("shop", F.coalesce("shop", "was"))
        label = cut(label) if later else label

        best = fronts.join(label, "front").groupBy("shop").agg(F.min("first").alias("best"))
        said = lambda x: x.select("id", "discovered_at", F.col("best.id").alias("first_id"), F.col("best.discovered_at").alias("first_discovered_at"), F.col("shop").alias("front"))
        repeat = "(discovered_at > best.discovered_at AND id <> best.id)"
        shops = label.where("new").select("front", "shop")
        if later:
            were = label.select("was", "shop").distinct()
            had = cut(of_small(old["firsts"], were.select(F.col("was").alias("shop")), ["shop"]).groupBy(F.col("shop").alias("was")).agg(F.min("first").alias("old")))
            were = were.join(had, "was", "left")
            best = best.unionByName(were.where("old IS NOT NULL").select("shop", F.col("old").alias("best"))).groupBy("shop").agg(F.min("best").alias("best"))
            were = cut(were.join(best, "shop"))
            best = were.select("shop", "best").distinct()
            firsts = best.join(were.where("was = shop AND old IS NOT NULL").select("shop", "old"), "shop", "left").where("old IS NULL OR best < old")
            # leads that come again keep their earliest time and are told anew
            again = of_small(old["leads"], rows.select("front", "id"), ["front", "id"]).groupBy("front", "id").agg(F.min("discovered_at").alias("had"))
            mine = rows.select("front", "id", "discovered_at").join(again, ["front", "id"], "left").join(label.select("front", "shop"), "front").join(best, "shop")
            mine = cut(mine)
            fresh = mine.where("had IS NULL OR discovered_at < had")
            # shops whose name or earliest lead is another now: a shop's name goes only when it is merged away as a whole,
            # so whoever ever had a name that holds still has it
            other = cut(were.where("old IS NOT NULL AND (was <> shop OR old <> best)").select("was", "shop", "best", (F.col("old") != F.col("best")).alias("told")))
            members = old["shops"].select("front", F.col("shop").alias("was")).join(small(other), "was").dropDuplicates(["front"])
            members = cut(members)
            shops = shops.unionByName(members.where("was <> shop").select("front", "shop"))
            theirs = old["leads"].join(small(members.where("told").select("front", "shop", "best")), "front").join(rows.select("front", "id"), ["front", "id"], "left_anti")
            theirs = theirs.groupBy("front", "id", "shop", "best").agg(F.min("discovered_at").alias("discovered_at")).withColumn("had", F.col("discovered_at"))
            told = mine.withColumn("discovered_at", F.least("discovered_at", "had")).unionByName(theirs.select(*mine.columns)).where(f"{repeat} OR had IS NOT NULL")
            reports = said(told.withColumn("best", F.when(F.expr(repeat), F.col("best"))))
        else:
            best = cut(best)
            reports, fresh, firsts = said(rows.join(label.select("front", "shop"), "front").join(best, "shop").where(repeat)), rows, best
        add = {
            "blocks": blocks,
            "leads": fresh.select("front", "id", "discovered_at"),
            "shops": shops.withColumn("version", F.lit(version)),
            "firsts": firsts.select("shop", F.col("best").alias("first")),
            "reports": reports.withColumn("version", F.lit(version)),
        }
        return FrontHistory(add, self.folder, self.version, self.parts)

    def save(self) -> int:
        """Commits what ``check`` returned as the version after the one that was loaded; returns its number.

        It counts only once all of it is written, and only if no other run has committed since. After COMPACT parts the
        whole history is written as one: labels and earliest leads by their keys, the rest as it is, sorted.
        """
        spark = next(iter(self.tables.values())).sparkSession
        versions = Versions(spark, self.folder)
        part = versions.draft()
        with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables don't depend on each other
            list(pool.map(lambda x: x[1].sortWithinPartitions(LOOKUP[x[0]]).write.parquet(f"{part}/{x[0]}"), self.tables.items()))
        parts = [*self.parts, part]
        if len(parts) > self.COMPACT:
            whole, every = versions.draft(), {n: spark.read.schema(s).parquet(*[f"{p}/{n}" for p in parts]) for n, s in TABLES.items()}
            every["firsts"] = every["firsts"].groupBy("shop").agg(F.min("first").alias("first"))
            now = every["shops"].groupBy("front").agg(F.max(F.struct("version", "shop")).alias("r"))
            every["shops"] = now.select("front", "r.shop", "r.version")
            every["leads"] = every["leads"].groupBy("front", "id").agg(F.min("discovered_at").alias("discovered_at"))
            every["reports"] = last_reports(every["reports"])
            for name, rows in every.items():
                rows.repartitionByRange(F.col(LOOKUP[name])).sortWithinPartitions(LOOKUP[name]).write.parquet(f"{whole}/{name}")
            parts = [whole]
        return versions.commit(self.version, parts)


def last_reports(reports: DataFrame) -> DataFrame:
    """Of each (id), the report that holds: that of the last version."""
    best = reports.groupBy("id").agg(F.max_by(F.struct(*reports.columns), "version").alias("r"))
    return best.select("r.*")


def replayed(spark: SparkSession, candidates: DataFrame, sources: DataFrame, known_hosts: DataFrame, weeks: int = LAST_WEEKS, folder: str | None = None) -> DataFrame:
    """The reports that hold after all leads, those of the last ``weeks`` weeks in a batch of their own each.

    The first batch opens a history in ``folder`` (a new one in the shared folder by default) with all earlier leads (and
    those without a time); each weekly batch then loads it, is checked against it and saved to it. A candidate that a later
    list names again comes again in that list's batch.
    """
    folder, known = folder or new_folder(spark, "fronts"), KnownHosts.read(known_hosts)
    named = sources.where("candidate_id IS NOT NULL").select(F.col("candidate_id").alias("id"), "discovered_at", F.date_trunc("week", "discovered_at").cast("date").alias("week"))
    last = named.agg(F.max("week")).first()[0]
    back = F.when(F.col("week").isNull(), weeks).otherwise(F.least(F.lit(weeks), F.floor(F.date_diff(F.lit(last), "week") / 7))) if last else F.lit(weeks)
    each = candidates.where("id IS NOT NULL").groupBy("id").agg(F.min("url").alias("url"))
    named = named.groupBy("id", back.cast("int").alias("back")).agg(F.min("discovered_at").alias("discovered_at"))
    batches = cut(each.join(named, "id", "left").withColumn("back", F.coalesce("back", F.lit(weeks))))
    for k in range(weeks, -1, -1):
        FrontHistory.load(spark, folder).check(batches.where(F.col("back") == k), known).save()
    return last_reports(FrontHistory.load(spark, folder).tables["reports"]).where("first_id IS NOT NULL").drop("version")
