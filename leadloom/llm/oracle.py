"""DuckDB SQL of the queries in this package that SQL can express, over whole tables."""

from __future__ import annotations

from leadloom.llm import canonical, survivors
from leadloom.queries import shops, sql

_P1 = rf"""
WITH RECURSIVE c AS (SELECT id, min(url) AS url FROM candidates WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT candidate_id AS id, min(discovered_at) AS seen_at FROM sources GROUP BY 1),
s AS (SELECT id, seen_at, {sql.site("url")} AS site FROM c JOIN t USING (id)),
f AS (SELECT id, seen_at, {sql.parent("site")} AS suffix, site FROM s WHERE site IS NOT NULL),
g AS (SELECT id, seen_at, suffix, replace(strip_accents(left(site, len(site) - len(suffix) - 1)), '-', '') AS name FROM f),
fronts AS (SELECT DISTINCT name, suffix, name || '.' || suffix AS front FROM g),
links AS (SELECT a.front AS x, b.front AS y FROM fronts a JOIN fronts b ON a.suffix = b.suffix AND a.front <> b.front AND abs(len(a.name) - len(b.name)) <= 1 AND damerau_levenshtein(a.name, b.name) <= 1),
reach AS (SELECT front AS x, front AS y FROM fronts UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
shop AS (SELECT x AS front, min(y) AS shop FROM reach GROUP BY 1),
m AS (SELECT g.id, g.seen_at, shop.shop FROM g JOIN shop ON shop.front = g.name || '.' || g.suffix),
best AS (SELECT shop, min(seen_at) AS first_at, arg_min(id, (seen_at, id)) AS first_id FROM m GROUP BY 1)
SELECT least(id, best.first_id) AS first_id, greatest(id, best.first_id) AS second_id FROM m JOIN best USING (shop) WHERE seen_at > first_at
"""

_P2_GROUPS = f"""{sql.STORE}, named AS (SELECT store_id, unnest(list_concat([domain_url, shop_identity], coalesce(aliases, []::VARCHAR[]))) AS v FROM store),
e AS (SELECT DISTINCT store_id, {sql.site("v")} AS site FROM named),
n AS (SELECT DISTINCT a.store_id AS x, b.store_id AS y FROM e a JOIN e b ON a.site = b.site AND a.store_id <> b.store_id),
reach AS (SELECT DISTINCT x, x AS y FROM n UNION SELECT r.x, n.y FROM reach r JOIN n ON n.x = r.y),
g AS (SELECT x AS store_id, min(y) AS group_id FROM reach GROUP BY 1)"""
_P2 = f"""
WITH RECURSIVE {_P2_GROUPS},
m AS (SELECT g.group_id, s.store_id, s.domain_url, {sql.FILLED} AS filled, {sql.site("domain_url")} AS site FROM g JOIN store s USING (store_id)),
r AS (SELECT *, first_value(store_id) OVER (PARTITION BY group_id ORDER BY coalesce(site LIKE '%.shops.example', TRUE), -filled, domain_url NULLS LAST, store_id) AS survivor_id FROM m)
SELECT group_id, store_id, survivor_id FROM r
"""


def _p2_fused() -> str:
    """Claims, then the rounds of the fusion one after the other, in the names of the paper: kt, kf, kd, votes."""
    squeeze = lambda x: f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    fold = "nullif(regexp_replace(strip_accents(lower(shown)), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' ')"
    fields = ", ".join(f"{{'field': '{c}', 'shown': {squeeze(c)}, 'site': {sql.site(c) if c in survivors.SITES else 'NULL'}}}" for c in survivors.FUSED)
    folded, sites = (", ".join(f"'{c}'" for c in x) for x in (survivors.FOLDED, survivors.SITES))
    n, copy, prior, start = survivors.FALSE_VALUES, survivors.COPY_RATE, survivors.PRIOR_COPY, survivors.START_ACCURACY
    q = f"""
WITH RECURSIVE {_P2_GROUPS},
first AS (SELECT candidate_id AS store_id, arg_min(name, (discovered_at, name)) AS list FROM sources GROUP BY 1),
own AS (SELECT g.group_id, coalesce(lower(regexp_replace({sql.trim("list")}, '[\\s_-]+', ' ', 'g')), '') AS source, unnest([{fields}]) AS x FROM g JOIN store USING (store_id) LEFT JOIN first USING (store_id)),
shown AS (SELECT group_id, source, x.field AS field, x.shown AS shown, x.site AS site FROM own WHERE x.shown <> '' AND (x.field NOT IN ({sites}) OR x.site IS NOT NULL)),
claimed AS (SELECT *, CASE WHEN field IN ({folded}) THEN coalesce(trim({fold}), shown) ELSE coalesce(site, shown) END AS value FROM shown),
c AS (SELECT DISTINCT group_id, field, value, source FROM claimed),
voters AS (SELECT group_id, field, value, count(*) AS n FROM c GROUP BY ALL),
total AS (SELECT group_id, field, sum(n) AS votes FROM voters GROUP BY ALL),
p0 AS (SELECT group_id, field, value, n / votes AS p FROM voters JOIN total USING (group_id, field)),
t AS (SELECT c.* FROM c JOIN total USING (group_id, field) WHERE votes > 1),
shared AS (SELECT group_id, field, value, a.source AS s, b.source AS t FROM t a JOIN t b USING (group_id, field, value) WHERE a.source < b.source),
k AS (SELECT group_id, field, source, count(*) AS n FROM t GROUP BY ALL),
met AS (SELECT a.source AS s, b.source AS t, sum(a.n * b.n) AS met FROM k a JOIN k b USING (group_id, field) WHERE a.source < b.source GROUP BY ALL)"""
    for i in range(survivors.ROUNDS):
        q += f""",
acc{i} AS (SELECT source, least(0.99, greatest(0.05, (sum(p) + 5 * {start}) / (count(*) + 5))) AS a FROM c JOIN p{i} USING (group_id, field, value) GROUP BY 1),
s{i} AS (SELECT s, t, sum(p) AS kt, sum(1 - p) AS kf, count(*) AS same FROM shared JOIN p{i} USING (group_id, field, value) GROUP BY ALL),
d{i} AS (SELECT s, t, x.a AS a_s, y.a AS a_t, (x.a + y.a) / 2 AS a, coalesce(kt, 0) AS kt, coalesce(kf, 0) AS kf, met - coalesce(same, 0) AS kd FROM met LEFT JOIN s{i} USING (s, t) JOIN acc{i} x ON x.source = s JOIN acc{i} y ON y.source = t),
e{i} AS (SELECT *, a * a AS pt, (1 - a) * (1 - a) / {n} AS pf FROM d{i}),
dep{i} AS (SELECT s, t, a_s, a_t, 1 / (1 + exp(least(700, kt * ln(pt) + kf * ln(pf) + kd * ln(1 - pt - pf)
  - kt * ln(a * {copy} + pt * (1 - {copy})) - kf * ln((1 - a) * {copy} + pf * (1 - {copy})) - kd * ln((1 - pt - pf) * (1 - {copy})) + ln((1 - {prior}) / {prior})))) AS dep FROM e{i}),
free{i} AS (SELECT group_id, field, value, CASE WHEN a_t > a_s THEN s ELSE t END AS source, sum(ln(1 - {copy} * dep)) AS free FROM shared JOIN dep{i} USING (s, t) GROUP BY ALL),
score{i} AS (SELECT group_id, field, value, sum(ln({n} * a / (1 - a)) * exp(coalesce(free, 0))) AS score FROM t JOIN acc{i} USING (source) LEFT JOIN free{i} USING (group_id, field, value, source) GROUP BY ALL),
top{i} AS (SELECT group_id, field, max(score) AS top, count(*) AS kinds FROM score{i} GROUP BY ALL),
sum{i} AS (SELECT group_id, field, any_value(top) AS top, sum(exp(score - top)) + exp(-any_value(top)) * greatest(0, {n} - any_value(kinds)) AS norm FROM score{i} JOIN top{i} USING (group_id, field) GROUP BY ALL),
p{i + 1} AS (SELECT group_id, field, value, coalesce(exp(score - top) / norm, p) AS p FROM p{i} LEFT JOIN score{i} USING (group_id, field, value) LEFT JOIN sum{i} USING (group_id, field))"""
    return f"""{q},
spelled AS (SELECT group_id, field, value, arg_max(shown, (n, shown)) AS shown FROM (SELECT group_id, field, value, shown, count(*) AS n FROM claimed GROUP BY ALL) GROUP BY ALL),
best AS (SELECT group_id, field, arg_max(value, (round(p, 9), value)) AS value, max(round(p, 9)) AS p FROM p{survivors.ROUNDS} GROUP BY ALL)
SELECT group_id, field, shown AS value, round(best.p, 5) AS p FROM best JOIN spelled USING (group_id, field, value)"""


_NUMBER = shops._PHONE.replace("'(?i)\\s*(ext\\.?|x)\\s*[0-9]+\\s*$'", "'(?i)\\s*(?:ext\\.?|x)\\s*[0-9]{1,7}\\s*$'")
_E164 = f"CASE WHEN regexp_matches({_NUMBER}, '^(\\+?91|0)?[1-9][0-9]{{9}}$') THEN '+91' || right({_NUMBER}, 10) WHEN regexp_matches({_NUMBER}, '^\\+[1-9][0-9]{{7,14}}$') AND NOT starts_with({_NUMBER}, '+91') THEN {_NUMBER} END"
_P2_VALUES = f"""
WITH RECURSIVE {_P2_GROUPS}, own AS (SELECT g.group_id, store.* FROM g JOIN store USING (store_id)),
mail AS (SELECT group_id, regexp_extract(lower({sql.trim("e")}), '^(?:mailto:)?([^\\s@<>,;?]+@[^\\s@<>,;?]+?)[.,;]*(?:\\?.*)?$', 1) AS value FROM (SELECT group_id, unnest(emails) AS e FROM own)),
mails AS (SELECT *, count(*) OVER (PARTITION BY value) AS used FROM (SELECT group_id, value, count(*) AS n FROM mail WHERE value <> '' GROUP BY ALL)),
p AS (SELECT group_id, {sql.trim("p")} AS p FROM (SELECT group_id, unnest(phones) AS p FROM own) WHERE {sql.trim("p")} <> ''),
pk AS (SELECT group_id, p AS value, concat_ws(' x', coalesce({_E164}, nullif(regexp_replace(p, '[^0-9+]', '', 'g'), ''), p), nullif(regexp_extract(p, '(?i)(?:ext\\.?|x)\\s*([0-9]+)\\s*$', 1), '')) AS key, count(*) AS n FROM p GROUP BY ALL),
a AS (SELECT group_id, {sql.trim("v")} AS value FROM (SELECT group_id, unnest(list_append(coalesce(aliases, []::VARCHAR[]), domain_url)) AS v FROM own) WHERE {sql.host("v")} IS NOT NULL),
l AS (SELECT group_id, lower({sql.trim("k")}) AS network, {sql.trim("v")} AS value FROM (SELECT group_id, k, unnest(vs) AS v FROM (SELECT group_id, unnest(map_keys(socials)) AS k, unnest(map_values(socials)) AS vs FROM own)))
SELECT group_id, CASE WHEN used > {survivors.AGENCY_GROUPS} THEN 'agency_emails' ELSE 'emails' END AS field, '' AS network, value, n FROM mails
UNION ALL SELECT group_id, 'phones', '', arg_max(value, (n, value)), sum(n)::BIGINT FROM pk GROUP BY group_id, key
UNION ALL SELECT group_id, 'aliases', '', value, count(*) FROM a GROUP BY ALL
UNION ALL SELECT group_id, 'socials', network, value, count(*) FROM l WHERE value <> '' GROUP BY ALL
"""

_ID = f"lower({sql.trim('store_id')})"
_P4 = f"""
WITH {sql.STORE}, log AS (SELECT DISTINCT {_ID} AS id, wave FROM audit_sample WHERE store_id IS NOT NULL AND wave IS NOT NULL),
w AS (SELECT wave, lead(wave) OVER (ORDER BY wave) AS next FROM (SELECT DISTINCT wave FROM log))
SELECT s.store_id, w.next AS wave FROM log JOIN w USING (wave) JOIN store s ON {_ID.replace("store_id", "s.store_id")} = log.id
WHERE s.status = 'accepted' AND w.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log o WHERE o.id = log.id AND o.wave = w.next)
"""

_P4_SAMPLE = f"""
WITH {sql.STORE}, log AS (SELECT DISTINCT {_ID} AS id FROM audit_sample),
x AS (SELECT store_id, ('0x' || left(md5('20260929:' || store_id), 13))::BIGINT / 4503599627370496.0 AS u, least(1, greatest(1, coalesce(pages_checked, 1)) * 0.02) AS p, log.id IS NOT NULL AS kept FROM store LEFT JOIN log ON log.id = store_id WHERE status = 'accepted')
SELECT store_id, round(CASE WHEN kept THEN 1 ELSE p END, 6)::DOUBLE AS probability, kept FROM x WHERE kept OR u < p
"""

_P4_WAVES = f"""
WITH {sql.STORE}, log AS (SELECT DISTINCT {_ID} AS id, wave FROM audit_sample WHERE store_id IS NOT NULL AND wave IS NOT NULL),
w AS (SELECT wave, lag(wave) OVER (ORDER BY wave) AS before FROM (SELECT DISTINCT wave FROM log)),
x AS (SELECT store_id, ('0x' || left(md5('20260929:' || store_id), 13))::BIGINT / 4503599627370496.0 AS u, least(1, greatest(1, coalesce(pages_checked, 1)) * 0.02) AS p FROM store WHERE status = 'accepted'),
y AS (SELECT w.wave, x.u < x.p AS drawn, b.id IS NOT NULL AS kept, n.id IS NOT NULL AS again FROM x CROSS JOIN w LEFT JOIN log b ON b.id = x.store_id AND b.wave = w.before LEFT JOIN log n ON n.id = x.store_id AND n.wave = w.wave)
SELECT wave, count(*) AS selected, count_if(kept)::BIGINT AS kept, count_if(kept AND again)::BIGINT AS recorded_again FROM y WHERE drawn OR kept GROUP BY wave
"""


def _words(x: str) -> str:
    v = f"replace(regexp_replace(regexp_replace(lower({x}), '&amp;|&#38;', '&', 'g'), '&[a-z]{{2,8}};|&#[0-9]{{1,6}};', ' ', 'g'), '&', ' and ')"
    return f"list_filter(regexp_split_to_array(regexp_replace(strip_accents({v}), '[''‘’`]', '', 'g'), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w <> '')"


def _tokens(s: str) -> str:
    n = f"len({s})"
    return (
        f"list_distinct(list_concat(list_transform(range(1, {n}), lambda i: substr({s}, i, 2)), list_transform(range(1, {n} - 1), lambda i: substr({s}, i, 1) || '_' || substr({s}, i + 2, 1)),"
        f" list_transform(range(1, {n} + 1), lambda i: substr({s}, i, 1) || (len(left({s}, i)) - len(replace(left({s}, i), substr({s}, i, 1), '')))::VARCHAR)))"
    )


_P5 = f"""
WITH {sql.STORE}, typed AS (SELECT store_id, 'state' AS kind, state AS value FROM store UNION ALL SELECT store_id, 'category', category FROM store),
kept AS (SELECT * FROM typed t WHERE {sql.trim("value").replace(sql.BLANK, "[[:space:]\\p{Z}]")} <> '' AND NOT EXISTS (SELECT 1 FROM canon_values c WHERE c.kind = t.kind AND c.canonical = t.value)),
v AS (SELECT DISTINCT kind, value, {_words("value")} AS w FROM kept),
f AS (SELECT DISTINCT kind, canon_id, array_to_string(w, '') AS form FROM (SELECT kind, canon_id, {_words("n")} AS w FROM (SELECT kind, canon_id, unnest(list_prepend(canonical, coalesce(also_known, []::VARCHAR[]))) AS n FROM canon_values))),
ft AS (SELECT *, {_tokens("form")} AS t FROM f WHERE form <> ''),
win AS (SELECT DISTINCT kind, value, form FROM (SELECT kind, value, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1), lambda j: array_to_string(w[i:j], ''))))) AS form FROM v) WHERE form <> ''),
wt AS (SELECT kind, form, {_tokens("form")} AS t FROM (SELECT DISTINCT kind, form FROM win)),
j AS (SELECT wt.kind, wt.form, ft.canon_id, ft.form AS entry, len(list_intersect(wt.t, ft.t)) AS c, len(wt.t) + len(ft.t) AS n FROM wt JOIN ft USING (kind)),
k AS (SELECT kind, form, canon_id, c / (n - c) AS sim, -levenshtein(form, entry) AS near FROM j WHERE c / (n - c) >= {canonical.THRESHOLD}),
b AS (SELECT kind, form, arg_max(canon_id, (sim, near, -canon_id)) AS canon_id, max(sim) AS sim FROM k GROUP BY 1, 2),
best AS (SELECT win.kind, win.value, arg_max(b.canon_id, (b.sim, len(win.form), -b.canon_id)) AS canon_id FROM win JOIN b USING (kind, form) GROUP BY 1, 2)
"""

_P7 = """
WITH k AS (SELECT trim(regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g')) AS source, strlen(text) AS n FROM documents),
s AS (SELECT m.source, m.weight, m.max_repeats, coalesce(sum(k.n), 0) AS n FROM mix_targets m LEFT JOIN k ON k.source = m.source GROUP BY ALL)
SELECT source FROM s WHERE n * max_repeats < weight * (SELECT sum(n) FROM s)
"""

SQL: dict = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p2_fused": _p2_fused(),
    "p2_values": _P2_VALUES,
    "p4_found": _P4,
    "p4_sample": _P4_SAMPLE,
    "p4_waves": _P4_WAVES,
    "p5_found": _P5 + "SELECT kept.store_id, kept.kind AS field_name, coalesce(best.canon_id, 0) AS canon_id FROM kept LEFT JOIN best USING (kind, value)",
    "p5_unmatched": _P5 + "SELECT kept.kind AS field_name, kept.value, count(*) AS n FROM kept LEFT JOIN best USING (kind, value) WHERE best.canon_id IS NULL GROUP BY 1, 2",
    "p7_found": _P7,
}
