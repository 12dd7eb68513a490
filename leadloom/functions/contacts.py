"""E-mail addresses, phone numbers and social profiles as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An address inside running text (fixed pattern, ASCII).
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}"
#: Domains of templates and providers (fixed values).
TEMPLATE_DOMAINS = (
    "example.com", "example.org", "example.net", "domain.com", "email.com", "yourdomain.com", "yourstore.com", "yourcompany.com", "yourwebsite.com",
    "yoursite.com", "sentry.io", "shopify.com", "paypal.com", "razorpay.com", "google.com", "facebook.com", "emarsys.com", "payu.in",
)
#: First path segments that are no profile, segments that are none anywhere, and a channel's tabs (fixed values).
NO_PROFILE = (
    "settings", "privacy", "help", "policies", "terms", "about", "home", "explore", "accounts", "account",
    "watch", "marketplace", "business", "signup", "register", "notifications", "messages", "search", "ads",
)
NO_SEGMENT = ("share", "sharer", "sharer.php", "share.php", "intent", "dialog", "login", "plugins", "embed", "p", "reel")
TABS = ("featured", "videos", "shorts", "playlists", "about")
#: Words near a number without a country code that tell that it is a telephone's (fixed values).
PHONE_CUES = ("+91", "phone", "call", "contact", "whatsapp", "mobile", "tel")


def emails_in(text: Column) -> Column:
    """All addresses in a text, lower case, without punctuation at the ends, each once in order. Null gives null."""
    found = F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1)
    return F.array_distinct(F.transform(found, lambda e: F.regexp_replace(F.lower(e), r"^[.,;]+|[.,;]+$", "")))


def valid_email(e: Column, suffixes: frozenset[str] = frozenset()) -> Column:
    """A whole address of a domain that is no template's, no picture's name, and not ``yourname@`` or ``example@``.

    Where public ``suffixes`` are given, the domain must have a label below one of them."""
    domain = F.lower(F.substring_index(e, "@", -1))
    below = domain.rlike(rf"[^.]\.(?:{'|'.join(re.escape(s) for s in sorted(suffixes))})$") & ~domain.isin(*sorted(suffixes)) if suffixes else F.lit(True)
    return below & e.rlike(f"^(?:{EMAIL})$") & ~domain.isin(*TEMPLATE_DOMAINS) & ~domain.rlike(r"\.(?:png|jpg|webp)$") & ~F.lower(e).rlike(r"^(?:yourname|example)@")


def phone(number: Column) -> Column:
    """E.164 of an Indian number (ten digits, the first not 0, with or without 0 or +91) or of ``+`` and 8 to 15 digits; else null.

    A documented subset of a full numbering plan: lengths and leading digits are checked, not the allocation of ranges.
    """
    raw = F.regexp_replace(number, EXTENSION, "")
    digits = F.regexp_replace(raw, r"[^0-9+]", "")
    local = F.regexp_extract(digits, r"^(?:\+?91|0)?([1-9][0-9]{9})$", 1)
    return F.when(local != "", F.concat(F.lit("+91"), local)).when(digits.rlike(r"^\+[1-9][0-9]{7,14}$") & ~digits.startswith("+91"), digits)


#: An extension at the end of a number.
EXTENSION = r"(?i)\s*(?:ext\.?|x)\s*([0-9]{1,7})\s*$"
_VISIBLE = r"(?<![0-9A-Za-z+])(\+?[0-9(][0-9 ().\-]{7,18}[0-9](?:\s*(?i:ext\.?|x)\s*[0-9]{1,7})?)(?![0-9A-Za-z])"


def phone_with_extension(number: Column) -> Column:
    """``phone``, and `` ext. N`` where the number has an extension."""
    extension = F.nullif(F.regexp_extract(number, EXTENSION, 1), F.lit(""))
    return F.when(phone(number).isNotNull(), F.concat_ws(" ext. ", phone(number), extension))


def phones_in(text: Column) -> Column:
    """Numbers as they are written in a text, in order: those with another country's code, and others (home numbers) only with a
    cue in the 50 characters before, within, or 20 after. No repeats."""
    cue = "|".join(c.replace("+", r"\+?") for c in PHONE_CUES)
    pieces = F.regexp_extract_all(text, F.lit(_VISIBLE), 1)
    own = lambda n: F.coalesce(phone(n).startswith("+91"), F.lit(False))

    def cued(n: Column) -> Column:
        at = F.instr(text, n)
        around = F.substring(text, F.greatest(F.lit(1), at - 50), F.length(n) + 20 + F.least(F.lit(50), at - 1))
        return around.rlike(f"(?i){cue}")

    return F.array_distinct(F.filter(pieces, lambda n: phone(n).isNotNull() & (~own(n) | cued(n))))


def with_social(rows: DataFrame, url: str, network: str = "network", profile: str = "profile") -> DataFrame:
    """``rows`` and the network and canonical address of the profile that column ``url`` leads to, null where it is none.

    Hosts lose ``www.``/``m.``; twitter.com is x; shares, posts, settings, log-ins and the like are no profiles; Facebook keeps
    ``people``/``pages`` paths and ``profile.php?id=``, LinkedIn company/in/school, YouTube handles, channels and users
    (a tab after them is cut off). Paths keep their case.
    Built in steps, so that no expression holds another twice.
    """
    host, path, first, n = F.col("_s_host"), F.col("_s_path"), F.col("_s_first"), F.col("_s_n")
    x = rows.withColumns({
        "_s_host": F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^(?:www\.)?(?:m\.)?", ""),
        "_s_path": F.regexp_replace(F.regexp_extract(F.trim(url), r"^(?i:https?)://[^/?#]+([^?#]*)", 1), r"^/+|/+$", ""),
        "_s_id": F.regexp_extract(url, r"[?&]id=([0-9]+)", 1),
    })
    tab = rf"/(?:{'|'.join(TABS)})$"
    x = x.withColumn("_s_path", F.when(host == "youtube.com", F.regexp_replace("_s_path", tab, "")).otherwise(F.col("_s_path")))
    x = x.withColumn("_s_parts", F.split("_s_path", "/"))
    part = lambda i: F.get("_s_parts", F.lit(i))
    x = x.withColumns({"_s_first": F.lower(part(0)), "_s_n": F.size("_s_parts"), "_s_two": F.concat_ws("/", part(0), part(1)), "_s_third": part(2)})
    networks = {"instagram.com": "instagram", "facebook.com": "facebook", "twitter.com": "x", "x.com": "x", "linkedin.com": "linkedin", "youtube.com": "youtube", "pinterest.com": "pinterest"}
    named = F.lit(None).cast("string")
    for h, name in networks.items():
        named = F.when(host == h, name).otherwise(named)
    x = x.withColumn("_s_net", named)
    net = F.col("_s_net")
    kept = (
        F.when((net == "facebook") & (path == "profile.php"), F.when(F.col("_s_id") != "", F.concat(F.lit("profile.php?id="), "_s_id")))
        .when((path == "") | first.isin(*NO_PROFILE) | path.rlike(r"(?i)[:\s]|%3A|%20|%0[9A-D]|%C2%A0"), F.lit(None))
        .when(path.rlike(rf"(?i)(?:^|/)(?:{'|'.join(re.escape(x) for x in NO_SEGMENT)})(?:/|$)"), F.lit(None))
        .when(net.isin("instagram", "x", "pinterest"), F.when(n == 1, path))
        .when(net == "facebook", F.when((n == 1) | (part(0).isin("people", "pages") & (n == 3)), path))
        .when(net == "linkedin", F.when(part(0).isin("company", "in", "school") & ((n == 2) | ((n == 3) & (F.col("_s_third") == "mycompany"))), F.col("_s_two")))
        .when(net == "youtube", F.when((n == 1) & path.rlike("^@."), path).when((n == 2) & part(0).isin("channel", "c", "user") & (part(1) != ""), path))
    )
    x = x.withColumn("_s_kept", kept)
    shown = F.when(host == "twitter.com", "x.com").otherwise(host)
    x = x.withColumn(profile, F.concat(F.lit("https://"), shown, F.lit("/"), "_s_kept")).withColumn(network, F.when(F.col("_s_kept").isNotNull(), net))
    return x.drop(*[f"_s_{c}" for c in ("host", "path", "id", "parts", "first", "n", "two", "third", "net", "kept")])
