"""Reading a projection: filters, search, facets, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of statuses in lists; others come with unreachable (fixed values).
STATUS_RANK = {"accepted": 0, "review": 1, "queued": 2, "blocked": 3, "unreachable": 4, "excluded": 5, "duplicate": 6}
#: Statuses behind the facet ``attention``.
ATTENTION = ("review", "blocked", "unreachable", "error", "stale")


def matches(q: str, *cols: str) -> Column:
    """``q`` occurs, in any case, in the columns joined by spaces; an empty ``q`` is everywhere."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])), F.lit(q.lower()))


def matches_any(q: str, *cols: Column) -> Column:
    """``q`` occurs, in any case, in one of the columns by itself."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return hit


def status_filter(status: str) -> Column:
    """``all``, ``attention`` or one status."""
    if status == "all":
        return F.lit(True)
    return F.col("status").isin(*ATTENTION) if status == "attention" else F.col("status") == status


def status_rank(c: Column) -> Column:
    rank = F.lit(4)
    for name, r in STATUS_RANK.items():
        rank = F.when(c == name, F.lit(r)).otherwise(rank)
    return rank


def listed(rows: DataFrame, q: str = "", status: str = "all", category: str = "", state: str = "") -> DataFrame:
    """Rows (id, url, name, state, category, status, ...) that pass all filters; empty filters pass everything."""
    x = rows.where(status_filter(status) & matches(q, "url", "name", "state"))
    x = x.where(F.col("category") == category) if category else x
    return x.where(F.col("state") == state) if state else x


def in_order(rows: DataFrame) -> DataFrame:
    """By status, then by name where a store exists (an empty name stays empty) else by address, then created_at, id."""
    shown = F.when(F.col("has_store"), F.lower(F.coalesce("name", F.lit("")))).otherwise(F.lower("url"))
    return rows.orderBy(status_rank(F.col("status")), shown, "created_at", "id")


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (1 at least) of ``size`` (1 to 100) rows of an ordered frame."""
    size = min(100, max(1, size))
    return rows.offset((max(1, number) - 1) * size).limit(size)


#: Sorts of the site's list.
SORTS = {"name": ("name", "store_id"), "coverage": ("-filled", "name", "store_id"), "newest": ("-observed_at", "name", "store_id")}


def explored(rows: DataFrame, sort: str = "name", number: int = 1, size: int = 18) -> DataFrame:
    """A page of the site's list (store_id, name, filled, observed_at, ...) in one of SORTS, with ``position`` (from 1) and ``total``;
    a number past the end gives the last page, one before the start the first."""
    total = rows.count()
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc(c) for c in SORTS[sort]]
    start = (last_page(number, size, total) - 1) * size
    x = rows.orderBy(*order).offset(start).limit(size)
    at = F.row_number().over(Window.orderBy(*order)) + start  # over one page only
    return x.withColumns({"position": at, "total": F.lit(total).cast("bigint")})


def facets(rows: DataFrame, *cols: str) -> DataFrame:
    """(facet, value): distinct non-empty values over all rows, before any filter."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in cols])).alias("x")
    return rows.select(pairs).select("x.*").where("value <> ''").distinct()


def last_page(number: int, size: int, total: int) -> int:
    """The page that is shown for ``number``: one past the end is the last page, one before the start the first."""
    return max(1, min(number, max(1, -(-total // size))))


def detail(rows: DataFrame, observations: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The row of one candidate with its last ``most`` observations (id, kind, outcome, observed_at), newest first."""
    o = observations.where(F.col("candidate_id") == key).select("id", "kind", "outcome", "observed_at").orderBy(F.desc("id")).limit(most)
    o = o.agg(F.reverse(F.array_sort(F.collect_list(F.struct("id", "kind", "outcome", "observed_at")))).alias("observations"))
    return rows.where(F.col("id") == key).join(o)


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, accepted, rows that need attention, and the share of them in percent (half up, 0 without rows)."""
    a, n = F.count_if(F.col("status").isin(*ATTENTION)), F.count("*")
    return rows.agg(n.alias("rows"), F.count_if(F.col("status") == "accepted").alias("accepted"), a.alias("attention"), F.when(n > 0, F.floor(100.0 * a / n + 0.5)).otherwise(0).alias("percent"))
