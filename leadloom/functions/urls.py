"""URLs, hosts and sites as Column expressions.

A *site* is what one owner holds: one label below a public suffix, or one label (a tenant) below a platform.
Suffixes and platforms come from a table ``known_hosts(host, role)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import trimmed

#: More known hosts than this are not put into expressions.
MAX_KNOWN_HOSTS = 10_000


def host_of(url: Column) -> Column:
    """Lower-case host of an address however it is written, or null.

    Spaces around it, a missing or upper-case scheme, user info, port and a trailing dot are dropped.
    Null for null, for blanks and for values whose authority has no dot (``n/a``, ``-``, ``null``).
    """
    u = F.lower(trimmed(url))
    u = F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.\-]*:)?[/\\]{2,}", "")
    authority = F.regexp_extract(u, r"^([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(?::[0-9]*)?$", "")
    host = F.regexp_replace(host, r"^\.+|[.\s]+$", "")
    return F.when(host.contains(".") & ~host.rlike(r"[\s<>\"'|]"), host)


@dataclass(frozen=True)
class KnownHosts:
    """The roles of ``known_hosts``, small enough for expressions (see MAX_KNOWN_HOSTS)."""

    suffixes: frozenset = field(default_factory=frozenset)
    platforms: frozenset = field(default_factory=frozenset)
    shared: frozenset = field(default_factory=frozenset)

    @classmethod
    def read(cls, known_hosts: DataFrame) -> "KnownHosts":
        """Null hosts and roles are skipped. Raises ValueError beyond MAX_KNOWN_HOSTS rows."""
        rows = known_hosts.select(F.lower(trimmed(F.col("host"))).alias("h"), F.lower(trimmed(F.col("role"))).alias("r"))
        rows = rows.where("h <> '' AND r IS NOT NULL").distinct().limit(MAX_KNOWN_HOSTS + 1).collect()
        if len(rows) > MAX_KNOWN_HOSTS:
            raise ValueError(f"more than {MAX_KNOWN_HOSTS} known hosts")
        of = lambda *roles: frozenset(r.h for r in rows if r.r in roles)
        return cls(of("suffix"), of("platform"), of("link_page", "placeholder", "mail_provider"))

    def with_site(self, rows: DataFrame, value: str, out: str = "") -> DataFrame:
        """``rows`` and, from the address or host in column ``value``, the columns

        ``{out}host``, ``{out}parent`` (the longest suffix or platform above it), ``{out}site`` (one label and the parent;
        where no parent is known, the host without a leading ``www.`` or ``m.``; null for a bare root and for hosts that
        name no single shop) and ``{out}tenant`` (true below a platform). Each is built in its own projection, so that
        no expression is repeated inside another.
        """
        h, p = F.col(f"{out}host"), F.col(f"{out}parent")
        roots, shared = sorted(self.suffixes | self.platforms), sorted(self.shared)
        x = rows.withColumn(f"{out}host", host_of(F.col(value))).withColumn("_above", F.when(h.isNotNull(), _above(h)))
        x = x.withColumn(f"{out}parent", F.get(F.filter("_above", lambda s: s.isin(roots)), F.lit(0)) if roots else F.lit(None).cast("string"))
        below = F.expr(f"substring_index(substring({out}host, 1, length({out}host) - length({out}parent) - 1), '.', -1)")
        site = F.when(p.isNotNull(), F.concat_ws(".", below, p)).otherwise(F.regexp_replace(h, r"^(?:www[0-9]*|m)\.", ""))
        if roots:
            site = F.when(~h.isin(roots), site)
        if shared:
            site = F.when(~h.isin(shared) & ~F.exists("_above", lambda s: s.isin(shared)), site)
        x = x.withColumn(f"{out}site", site)
        return x.withColumn(f"{out}tenant", F.when(h.isNotNull(), F.coalesce(p.isin(sorted(self.platforms)), F.lit(False)) if self.platforms else F.lit(False))).drop("_above")


def _above(host: Column) -> Column:
    """All parent domains of ``host``, the longest first."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


#: Query parameters that only track where a visitor came from (fixed values).
TRACKING = ("fbclid", "gclid", "msclkid")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def with_normalized(rows: DataFrame, url: str, out: str, homepage: bool = False) -> DataFrame:
    """``rows`` and, in column ``out``, the canonical form of the http(s) address in column ``url``, or null where it is none.

    https where no scheme is given; scheme and host in lower case, host without trailing dots; default port of the scheme
    dropped, the other of 80 and 443 kept; path as it is (``/`` if empty or for ``homepage``); tracking parameters and the
    fragment dropped, blank parameters kept. Null for blanks, control characters inside, other schemes, user info, other
    ports, hosts without a dot, local names and IPv4 addresses that are not global. International names stay as they are;
    ``to_ascii`` turns them into the form of the name system. Built in steps, so that no expression holds another twice.
    """
    u, scheme, authority, host, port = (F.col(f"_n_{x}") for x in ("u", "scheme", "authority", "host", "port"))
    x = rows.withColumn("_n_t", trimmed(F.col(url)))
    x = x.withColumn("_n_u", F.when(F.col("_n_t").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.col("_n_t")).otherwise(F.concat(F.lit("https://"), F.col("_n_t"))))
    x = x.withColumns({"_n_scheme": F.lower(F.regexp_extract(u, _PARTS, 1)), "_n_authority": F.regexp_extract(u, _PARTS, 2)})
    x = x.withColumns({"_n_host": F.regexp_replace(F.lower(F.regexp_replace(authority, r":[0-9]*$", "")), r"\.+$", ""), "_n_port": F.regexp_extract(authority, r":([0-9]+)$", 1)})
    shown = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), "").otherwise(F.concat(F.lit(":"), port))
    if homepage:
        path, query = F.lit("/"), F.lit("")
    else:
        path = F.coalesce(F.nullif(F.regexp_extract(u, _PARTS, 3), F.lit("")), F.lit("/"))
        keep = F.filter(F.split(F.regexp_extract(u, _PARTS, 4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(rf"^(?:utm_.*|{'|'.join(TRACKING)})$"))
        query = F.array_join(F.transform(keep, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
        query = F.regexp_replace(query, r"^(?=.)", "?")
    good = (
        scheme.isin("http", "https")
        & ~F.contains(authority, F.lit("@"))
        & ~u.rlike(r"[\x00-\x1f]")
        & port.isin("", "80", "443")
        & host.rlike(r"^(?=.*\.)[\p{L}\p{M}\p{N}.\-]+$")
        & ~host.rlike(rf"(?:^|\.)(?:localhost|local|internal|test)$|{PRIVATE_IPV4}")
    )
    x = x.withColumn("_n_good", good).withColumn(out, F.when(F.col("_n_good"), F.concat(scheme, F.lit("://"), host, shown, path, query)))
    return x.drop("_n_t", "_n_u", "_n_scheme", "_n_authority", "_n_host", "_n_port", "_n_good")


#: IPv4 addresses that are not global: this network, private, shared, loopback, link-local, multicast and above.
PRIVATE_IPV4 = r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.[0-9]+\.[0-9]+\.[0-9]+$|^192\.168\.[0-9]+\.[0-9]+$|^169\.254\.[0-9]+\.[0-9]+$|^172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+$|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]+\.[0-9]+$"


def candidate_id(normal: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a normalized address."""
    return F.substring(F.sha2(normal, 256), 1, 16)


def origin(normal: Column) -> Column:
    """scheme://host[:port] of a normalized address."""
    return F.regexp_extract(normal, r"^([a-z]+://[^/?#]+)", 1)


def host_label(normal: Column) -> Column:
    """Host of a normalized address without a leading ``www.``."""
    return F.regexp_replace(F.regexp_extract(normal, r"^[a-z]+://([^/?#:]+)", 1), r"^www\.", "")


def to_ascii(host: Column) -> Column:
    """Host in the ASCII form of the name system (IDNA), as an Arrow function; null where that is impossible."""
    @F.pandas_udf("string")
    def encode(hosts: pd.Series) -> pd.Series:
        def one(h):
            try:
                return h if h is None or h.isascii() else h.encode("idna").decode("ascii")
            except UnicodeError:
                return None

        return hosts.map(one)

    return encode(host)


def resolved(base: Column, href: Column) -> Column:
    """``href`` as it is meant on the page ``base``, as an Arrow function (relative references, RFC 3986)."""
    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return None if x is None or y is None else urljoin(x, y)
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(b, h)], dtype=object)

    return join(base, href)
