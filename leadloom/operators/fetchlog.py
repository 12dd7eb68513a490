"""What a polite fetcher's rules come to, computed over its log: pacing, retries, redirects, robots rules, byte budgets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.urls import with_normalized
from leadloom.operators.statistics import outcome_class
from leadloom.session import cut

#: Rows of a host are worked on in slices of so many.
SLICE = 200_000


def numbered(df: DataFrame, key: str, *order: str, out: str = "k") -> DataFrame:
    """``df`` and the number (from 1) of each row within ``key`` by ``order``.

    In two levels, so that a key with a third of all rows is not sorted in one task: rows are range-partitioned by key and
    order, numbered within their partition, and offset by the counts of the key's earlier partitions (one row a key and
    partition).
    """
    x = cut(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy("_p", key).orderBy(*order)
    counts = x.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    x = x.withColumn("_k", F.row_number().over(inner))
    return x.join(counts, [key, "_p"]).withColumn(out, F.col("_k") + F.col("_before")).drop("_k", "_before", "_p")


#: A busy server's answers, and how long a host is left alone after one at least (fixed values).
BUSY, BUSY_SECONDS = (429, 503), 5


def pushed(requests: DataFrame, key: str, at: str, delay: float, longest: int = 30) -> DataFrame:
    """``requests`` (start_us, status_code, and retry_after if there is one) with ``held_us``, the time until which the latest
    earlier busy answers of the host hold them back, and ``deferred``: whether that is more than ``longest`` seconds.

    A running maximum of start + max(asked for, BUSY_SECONDS, delay) over earlier busy answers, taken in two levels as in
    ``numbered``, so that no host's log is sorted in one task.
    """
    asked = retry_after(F.col("retry_after"), F.col(at)) if "retry_after" in requests.columns else F.lit(0.0)
    until = F.col("start_us") + (F.greatest(asked, F.lit(float(BUSY_SECONDS)), F.lit(delay)) * 1_000_000).cast("bigint")
    x = requests.withColumn("_until", F.when(F.col("status_code").isin(*BUSY), until))
    x = numbered(x, key, "start_us", "k", out="_n").withColumn("_s", F.floor((F.col("_n") - 1) / SLICE))
    low = x.groupBy(key, "_s").agg(F.max("_until").alias("_m"))
    low = low.withColumn("_m", F.max("_m").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(key, "_s").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_r", F.max("_until").over(inner)).join(low, [key, "_s"])
    held = F.greatest("_r", "_m")
    x = x.withColumn("held_us", F.when(held > F.col("start_us"), held))
    return x.withColumn("deferred", F.coalesce(F.col("held_us") - F.col("start_us") > longest * 1_000_000, F.lit(False))).drop("_until", "_n", "_s", "_m", "_r")


def paced(requests: DataFrame, key: str, at: str, tie: str, delay: float) -> DataFrame:
    """Each request with k (its number within ``key``), asked_us and start_us: its earliest start if a key's requests start
    ``delay`` seconds apart, in order. Rows without key or time are dropped.

    start_k = max over j <= k of (asked_j + (k - j) delay), a running maximum of asked_j - j delay. Requests are
    range-partitioned by key and time, so that no key's log is in one task; numbers and maxima are taken within partitions, and
    those of a key's earlier partitions (one row a key and partition) are added.
    """
    step = round(delay * 1_000_000)
    x = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    x = cut(x.repartitionByRange(key, at, tie).withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy("_p", key).orderBy(at, tie)
    x = x.withColumns({"_k": F.row_number().over(inner).cast("bigint"), "asked_us": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))})
    x = x.withColumn("_v", F.col("asked_us") - F.col("_k") * step)
    x = x.withColumn("_r", F.max("_v").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy(key, "_p").agg(F.count("*").alias("_n"), F.max("_v").alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    part = part.withColumn("_low", F.max(F.col("_m") - F.col("_before") * step).over(earlier)).select(key, "_p", "_before", "_low")
    x = x.join(part, [key, "_p"]).withColumn("k", F.col("_k") + F.col("_before"))
    top = F.greatest(F.col("_r") - F.col("_before") * step, F.col("_low"))
    return x.withColumn("start_us", top + F.col("k") * step).drop("_p", "_k", "_v", "_r", "_before", "_low")


#: The largest BIGINT.
LARGEST = (1 << 63) - 1


def retries(observations: DataFrame, most: int = 2, longest: int = 30) -> DataFrame:
    """(run_id, candidate_id, url, attempt, wait_s, again) of each transient failure: the wait doubles with the attempt, and is
    what the server asked for if that is more (column ``retry_after``, if there is one); there is another attempt while
    ``most`` and ``longest`` allow it. A wait that no BIGINT holds (from attempt 63 on, or asked for) is ``LARGEST``."""
    asked = retry_after(F.col("retry_after"), F.col("observed_at")) if "retry_after" in observations.columns else F.lit(0.0)
    o = observations.select("id", "run_id", "candidate_id", "url", outcome_class().alias("class"), asked.alias("asked"))
    attempt = F.row_number().over(Window.partitionBy("run_id", "candidate_id", "url").orderBy("id"))
    x = o.withColumn("attempt", attempt).where(F.col("class") == "transient")
    doubled = F.coalesce(F.pow(F.lit(2), F.col("attempt")).try_cast("bigint"), F.lit(LARGEST))
    wait = F.greatest(doubled, F.ceil("asked"))
    return x.select("run_id", "candidate_id", "url", "attempt", wait.alias("wait_s"), ((F.col("attempt") <= most) & (wait <= longest)).alias("again"))


def redirects(edges: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops, outcome) of each start of ``edges`` (url, location; one location an url): end, loop or limit, or
    ``unsafe`` before a hop to what is no public http(s) address, or ``blocked`` before one that a column ``allowed`` of the
    edges (what the robots rules say of the location) forbids."""
    e = with_normalized(edges, "location", "_to").withColumn("_bad", F.when(F.col("_to").isNull(), "unsafe"))
    if "allowed" in edges.columns:
        e = e.withColumn("_bad", F.coalesce("_bad", F.when(~F.col("allowed"), "blocked")))
    e = cut(e.select("url", "location", "_bad"))
    good = F.col("_bad").isNull()
    x = e.select("url", F.when(good, F.col("location")).otherwise(F.col("url")).alias("at"), F.array("url").alias("path"), good.cast("int").alias("hops"), F.col("_bad").alias("outcome"))
    step = e.select(F.col("url").alias("at"), F.col("location").alias("next"), F.col("_bad").alias("bad"))
    for _ in range(most):
        x = x.join(step, "at", "left")
        loop = F.array_contains("path", F.col("at"))
        outcome = F.coalesce("outcome", F.when(loop, "loop").when(F.col("next").isNull(), "end").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("hops") >= most, "limit"))
        go = outcome.isNull()
        x = x.select("url", F.when(go, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(go, F.concat("path", F.array("at"))).otherwise(F.col("path")).alias("path"), (F.col("hops") + go.cast("int")).alias("hops"), outcome.alias("outcome"))
    return x.select("url", F.col("at").alias("final_url"), "hops", F.coalesce("outcome", F.lit("limit")).alias("outcome"))


def retry_after(header: Column, at: Column | None = None) -> Column:
    """Seconds of a Retry-After header, given in seconds or as an HTTP date to be counted from ``at`` (UTC): at least 0; junk
    and null are 0, and so is a date where no ``at`` is given."""
    date = F.try_to_timestamp(F.substring(F.trim(header), 6, 20), F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    is_date = F.trim(header).rlike(r"^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} GMT$")
    until = F.when(is_date, F.timestamp_diff("SECOND", at, date).cast("double")) if at is not None else F.lit(None).cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), until, F.lit(0.0)))


def within_budget(body: Column, most: int) -> Column:
    """STRUCT<outcome, body>: a body that is cut at ``most`` bytes is ``too_large``."""
    return F.struct(F.when(F.length(body) > most, "too_large").otherwise("ok").alias("outcome"), F.substring(body, 1, most).alias("body"))


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, path pattern) of the group of a robots file that fits ``agent`` best, else of ``*`` (RFC 9309)."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_group = False
    for line in text.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = names + [value.lower()] if open_group else [value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            open_group = False
            for n in names:
                if value:
                    groups[n].append((field == "allow", value))
    fit = [n for n in groups if n != "*" and n in agent.lower()]
    return groups.get(max(fit, key=len) if fit else "*", [])


def robots_allow(text: str, agent: str, path: str) -> bool:
    """The longest matching pattern decides, allow wins ties; ``*`` is anything, ``$`` the end."""
    best = (-1, True)
    for allow, pattern in robots_rules(text, agent):
        regex = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
        if re.match(regex, path):
            best = max(best, (len(pattern), allow))
    return best[1]


#: Kinds of content that a robots file can have (fixed values).
ROBOTS_KINDS = ("", "text/plain", "application/octet-stream")


def robots_state(outcome: Column, status_code: Column, content_type: Column, fetched_at: Column, at: Column, hours: int = 24) -> Column:
    """What an origin's last answer for its robots file means at ``at``: ``rules`` (parse it), ``allow`` (there is none: 404, 410),
    ``expired`` (older than ``hours``: fetch it again), else ``defer``."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    old = fetched_at.isNull() | (fetched_at < at - F.expr(f"INTERVAL {hours} HOURS"))
    return F.when(old, "expired").when(status_code.isin(404, 410), "allow").when((outcome == "ok") & kind.isin(*ROBOTS_KINDS), "rules").otherwise("defer")


def robots_allowed(text: Column, agent: str, path: Column) -> Column:
    """``robots_allow`` as an Arrow function; a null file allows everything."""
    @F.pandas_udf("boolean")
    def allowed(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([x is None or robots_allow(x, agent, y or "/") for x, y in zip(t, p)])

    return allowed(text, path)
