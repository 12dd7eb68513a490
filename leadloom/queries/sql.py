"""Pieces of DuckDB SQL that several of the queries' counterparts share."""

from __future__ import annotations

#: What a value is trimmed of.
BLANK = r"[\s\x00-\x1f]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def host(x: str) -> str:
    """Host of an address or host name; null where it has no dot."""
    h = f"regexp_replace(regexp_extract(lower({trim(x)}), '^(?:[a-z]+://)?([^/?#:]*)', 1), '\\.+$', '')"
    return f"CASE WHEN contains({h}, '.') THEN {h} END"


def parent(h: str) -> str:
    """The suffix or platform above a host of the test tables."""
    return f"CASE WHEN regexp_matches({h}, '.\\.(in|co|store|shops)\\.example$') THEN regexp_extract({h}, '((?:in|co|store|shops)\\.example)$', 1) ELSE 'example' END"


def site(x: str) -> str:
    """The site that a value names, null for shared hosts and bare roots. Uses the hosts of the test tables."""
    h = host(x)
    return f"""(SELECT CASE WHEN h IN ('example', 'in.example', 'co.example', 'store.example', 'shops.example') THEN NULL
      WHEN regexp_matches(h, '(^|\\.)(bio\\.hublinks|tapcards|onelink-pages|your-store\\.shops|theme-demo\\.shops|unknown\\.shops|mailbox|quickpost)\\.example$') THEN NULL
      WHEN regexp_matches(h, '\\.(in|co|store|shops)\\.example$') THEN regexp_extract(h, '([^.]+\\.(?:in|co|store|shops)\\.example)$', 1)
      ELSE regexp_extract(h, '([^.]+\\.example)$', 1) END FROM (SELECT {h} AS h))"""


NOW = """now AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status DESC, url DESC, created_at DESC, store_json DESC NULLS LAST) AS rn
  FROM candidates WHERE id IS NOT NULL) WHERE rn = 1)"""
STORE = """store AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY observed_at DESC NULLS LAST) AS rn FROM stores) WHERE rn = 1)"""
SEEN = "seen AS (SELECT DISTINCT * FROM observations)"
FILLED = """((emails IS NOT NULL AND len(emails) > 0)::INT + (phones IS NOT NULL AND len(phones) > 0)::INT + (socials IS NOT NULL AND cardinality(socials) > 0)::INT
  + (coalesce(category, '') <> '')::INT + (coalesce(description, '') <> '')::INT + (coalesce(logo_url, '') <> '')::INT + (coalesce(state, '') <> '')::INT)"""
