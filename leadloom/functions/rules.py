"""Text rules that turn page parts into evidence: names, descriptions, addresses, keyword classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import squeezed, unaccented

#: An identity that a script assigns, and assets that only the platform's runtime serves (fixed patterns).
IDENTITY = r"""(?i)Shopify\.shop\s*=\s*["']([a-z0-9][a-z0-9-]*\.myshopify\.com)["']"""
RUNTIME = r"cdn\.shopify\.com/shopifycloud/|/cdn/shopifycloud/|/cdn/shop/t/[0-9]+/assets/"
#: Vocabulary of address rules (fixed values).
CONTEXT = r"(?i)\b(?:address|registered office|corporate office|head office|principal office|office address|contact us|contact information|operated by|owned by)\b"
NON_BUSINESS = r"(?i)\b(?:shipping destinations?|deliver(?:y|ing)? (?:across|to)|ship(?:ping)? (?:across|to)|our (?:suppliers|distributors)|manufactured by)\b"
RETURN_ONLY = r"(?i)\b(?:return address|returns warehouse|fulfill?ment|logistics partner)\b"
PREMISE_WORDS = "road|street|plot|building|sector|nagar|lane|avenue|marg|villas?|colony|complex|block|house|flat|tower|layout|cross|rd"
PREMISE = rf"(?i)\b(?:{PREMISE_WORDS})\b"
STREET = rf"(?i)\b(?:{PREMISE_WORDS}|floor|office|industrial|estate|village|district|pincode|pin code|phase)\b"
REGISTERED = r"(?i)\b(?:registered|principal) (?:offices?|address)\b"
HEAD = r"(?i)head office|corporate (?:office|address)"
PIN = r"(?<![0-9])[1-9][0-9]{5}(?![0-9])"
SHORT_NUMBER = r"\b(?:[A-Z]{1,3}\s*[-/]?\s*)?[0-9]{1,5}\b"


def runtime_asset(src: Column) -> Column:
    """A script or style sheet of the platform's runtime."""
    return src.rlike(RUNTIME) & F.regexp_replace(src, r"[?#].*$", "").rlike(r"(?i)\.(?:js|mjs|css)$")


def store_name(og_site_name: Column, title: Column, host: Column) -> Column:
    """The site's name (120 characters), else the title before a separator (90), else the host."""
    og, t = F.nullif(F.trim(og_site_name), F.lit("")), F.nullif(F.trim(F.get(F.split(title, r"\s[|–—]\s"), F.lit(0))), F.lit(""))
    return F.coalesce(F.substring(og, 1, 120), F.substring(t, 1, 90), host)


def description(*candidates: Column) -> Column:
    """STRUCT<text, rule>: the first of the candidates with 20 characters or more, cut at 700."""
    pick = F.coalesce(*[F.when(F.length(F.trim(c)) >= 20, F.trim(c)) for c in candidates])
    return F.when(pick.isNotNull(), F.struct(F.substring(pick, 1, 700).alias("text"), F.when(F.length(pick) > 700, "meta_description_truncated").otherwise("meta_description").alias("rule")))


def without_nbsp(text: Column) -> Column:
    """Entities of non-breaking spaces that stayed in a text, as spaces."""
    return F.regexp_replace(text, "&nbsp;?", " ")


def words(text: Column) -> Column:
    """The words of a text: lower case, no accents, letters, marks and digits."""
    return F.filter(F.split(unaccented(text), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def word_grams(w: Column, most: int) -> Column:
    """Runs of up to ``most`` words of an array of words, with one space between them."""
    n = F.size(w)
    run = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(w, i, k), " "))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), run)))


def dimension(names: DataFrame, label: str, name: str) -> DataFrame:
    """(label, gram, words) of a list of names, in the form of ``word_grams``."""
    x = names.select(F.col(label).alias("label"), words(F.col(name)).alias("w"))
    return x.select("label", F.array_join("w", " ").alias("gram"), F.size("w").alias("words")).where("gram <> ''").distinct()


#: Up to so many different first words, runs are only begun where one of them stands.
MOST_FIRST_WORDS = 5_000


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame, most: int = 4) -> DataFrame:
    """(key, label, gram): which names occur as whole words in a text. An equi-join on word runs, no pattern is tried.

    Runs of up to ``most`` words are begun only at words that a name begins with, as long as these are few enough for an
    expression; the result is the same without that."""
    firsts = [r.f for r in names.select(F.substring_index("gram", " ", 1).alias("f")).distinct().limit(MOST_FIRST_WORDS + 1).collect()]
    w = rows.select(key, words(F.col(text)).alias("_w"))
    if len(firsts) > MOST_FIRST_WORDS:
        g = w.select(key, F.explode(word_grams(F.col("_w"), most)).alias("gram"))
    else:
        at = F.transform("_w", lambda x, i: F.when(x.isin(firsts) if firsts else F.lit(False), i + 1))
        begun = w.select(key, F.explode(F.transform(F.array_compact(at), lambda i: F.slice("_w", i, F.lit(most)))).alias("_w"))
        runs = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda k: F.array_join(F.slice("_w", F.lit(1), k), " "))
        g = begun.select(key, F.explode(runs).alias("gram"))
    return g.join(names.select("label", "gram"), "gram").select(key, "label", "gram").distinct()


def classified(rows: DataFrame, key: str, primary: str, secondary: str, keywords: DataFrame, least: int = 2) -> DataFrame:
    """(key, label, score, tied): the label of the greatest weighted keyword score, null where several tie.

    A keyword in ``primary`` scores 4, in ``secondary`` only 1; keys without a score of ``least`` are not returned.
    """
    longest = keywords.agg(F.max("words")).first()[0] or 1
    a = mentions(rows, key, primary, keywords, longest).withColumn("weight", F.lit(4))
    b = mentions(rows, key, secondary, keywords, longest).withColumn("weight", F.lit(1))
    s = a.unionByName(b).groupBy(key, "label", "gram").agg(F.max("weight").alias("weight"))
    s = s.groupBy(key, "label").agg(F.sum("weight").alias("score")).where(F.col("score") >= least)
    best = s.groupBy(key).agg(F.max("score").alias("score"))
    x = s.join(best, [key, "score"]).groupBy(key, "score").agg(F.min("label").alias("label"), F.count("*").alias("tied"))
    return x.select(key, F.when(F.col("tied") == 1, F.col("label")).alias("label"), "score", "tied")


def states_named(rows: DataFrame, key: str, text: str, states: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """(key, states): the states that a text names; a state whose name stands within a longer one's counts as that one.
    Where it names none, those of the ``towns`` (label: the state) that it names. Texts that name nothing are not returned."""
    m = mentions(rows, key, text, states)
    longer = m.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("gram").alias("_g"))
    within = (F.col(key) == F.col("_k")) & (F.col("label") != F.col("_l")) & (F.col("gram") != F.col("_g")) & F.contains(F.concat(F.lit(" "), "_g", F.lit(" ")), F.concat(F.lit(" "), "gram", F.lit(" ")))
    m = m.join(longer, within, "left_anti").select(key, "label")
    if towns is not None:
        m = m.unionByName(mentions(rows, key, text, towns).select(key, "label").join(m.select(key).distinct(), key, "left_anti"))
    return m.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("states"))


def address_candidates(blocks: DataFrame, states: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """(store_id, page_url, excerpt, states, priority, basis) of blocks (store_id, page_url, block) that give a business address.

    Accepted with a context or on a contact page, a state, and a PIN or (registered, in India, one state, premise word, short
    number), with a street or a context; or without a state with context, India, PIN and street. Registered and principal
    offices have priority 4, head and corporate 3, others 2. Containing excerpts of lesser or equal priority are dropped.
    """
    x = blocks.select("store_id", "page_url", squeezed(F.col("block")).alias("excerpt")).where(F.length("excerpt").between(20, 900)).distinct()
    x = x.where(~F.col("excerpt").rlike(NON_BUSINESS) & ~F.col("excerpt").rlike(RETURN_ONLY))
    named = states_named(x, "excerpt", "excerpt", states, towns)
    x = x.join(named, "excerpt", "left").withColumn("states", F.coalesce("states", F.array().cast("array<string>")))
    e, n = F.col("excerpt"), F.size("states")
    context, contact = e.rlike(CONTEXT), F.col("page_url").rlike(r"(?i)contact|privacy|terms|legal")
    india, pin, street = e.rlike(r"(?i)\bindia\b"), e.rlike(PIN), e.rlike(STREET)
    registered = e.rlike(REGISTERED)
    strong = registered & india & (n == 1) & e.rlike(PREMISE) & e.rlike(SHORT_NUMBER)
    full = (context | contact) & (n > 0) & (pin | strong) & (street | context) & (india | (n == 1))
    bare = context & india & pin & street & (n == 0)
    priority = F.when(~full, 2).when(registered, 4).when(e.rlike(HEAD), 3).otherwise(2)
    basis = F.when(full & ~pin, "registered_office_without_pin").otherwise("business_address")
    x = x.where(full | bare).select("store_id", "page_url", "excerpt", "states", priority.alias("priority"), basis.alias("basis"))
    a, b = x.alias("a"), x.alias("b")
    inside = (F.col("a.store_id") == F.col("b.store_id")) & (F.col("a.page_url") == F.col("b.page_url")) & (F.col("a.excerpt") != F.col("b.excerpt")) & F.contains(F.col("a.excerpt"), F.col("b.excerpt")) & (F.col("b.priority") >= F.col("a.priority"))
    return a.join(b, inside, "left_anti")


def one_state(addresses: DataFrame) -> DataFrame:
    """(store_id, state, reason): the only state of the addresses of greatest priority, else null and why."""
    top = addresses.groupBy("store_id").agg(F.max("priority").alias("priority"))
    s = addresses.join(top, ["store_id", "priority"]).select("store_id", F.explode_outer("states").alias("state")).distinct()
    s = s.groupBy("store_id").agg(F.array_compact(F.collect_set("state")).alias("s"))
    return s.select("store_id", F.when(F.size("s") == 1, F.col("s")[0]).alias("state"), F.when(F.size("s") > 1, "ambiguous").alias("reason"))
