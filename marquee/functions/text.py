"""String keys, tokens, similarity and labels, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import on_workers

ASCII = r"^[\x00-\x7F]*$"


def _no_marks(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ")

    return texts.map(one, na_action="ignore")


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks U+0300-036F, in Arrow batches; plain ASCII comes back as it is."""
    if (session := SparkSession.getActiveSession()) is not None:
        on_workers(session)
    return F.pandas_udf(_no_marks, T.StringType())(c)


def comparison_key(c: Column) -> Column:
    """Folded, lower case, letters a-z and digits only; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]", ""), F.lit(""))


def venue_key(c: Column) -> Column:
    """Folded words of a venue's name without articles, `&` as and; '' for null."""
    s = F.regexp_replace(F.replace(F.lower(fold(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    s = F.regexp_replace(s, r"\b(the|a|an)\b", " ")
    return F.coalesce(F.trim(F.regexp_replace(s, " +", " ")), F.lit(""))


def _long(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def venue_tokens(key: Column) -> Column:
    """Distinct words of two characters or more of a venue key."""
    return _long(F.split(key, " "))


def title_tokens(c: Column) -> Column:
    """Distinct folded words of two characters or more; articles stay."""
    return F.coalesce(_long(F.split(F.lower(fold(c)), "[^a-z0-9]+")), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty: 1, one empty: 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def contained(a: Column, b: Column) -> Column:
    """Neither is empty, and one holds the other."""
    both = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (both == F.least(F.size(a), F.size(b)))


def share_identity(a: Column, b: Column, least: float) -> Column:
    """Token sets that are not empty and either overlap by `least` or hold one another."""
    return contained(a, b) | ((F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= least))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, two blanks before and one after each; none of null."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.coalesce(F.array_distinct(F.flatten(each)), F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 where neither has any."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


# Words that keep capitals, and the longest title.
CAPITALS = ("DJ", "NYC", "NY", "LA", "SF", "UK", "USA", "SOLD", "OUT", "VIP", "LIVE", "FEAT", "FT", "MC", "EDM", "R&B", "B2B", "EP", "LP", "VS")
LONGEST_TITLE = 120
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1FA00}-\x{1FA9F}]"


def clean_title(c: Column) -> Column:
    """A title without emoji and runs of !?*#@, in title case, cut at a word; null if fewer than three characters are left."""
    s = F.regexp_replace(F.regexp_replace(c, EMOJI, ""), "[!?*#@]{2,}", "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))

    def cased(w: Column) -> Column:
        keep = F.upper(w).isin(*CAPITALS)
        return F.when(keep, F.upper(w)).when(w.rlike("^[A-Z]{2,}$"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))

    t = F.array_join(F.transform(F.split(s, " "), cased), " ")
    head = F.substring(t, 1, LONGEST_TITLE)
    at_word = F.regexp_replace(head, r" [^ ]*$", "")
    t = F.when(F.length(t) <= LONGEST_TITLE, t).otherwise(F.concat(F.when(head.rlike(r"^.+ "), F.rtrim(at_word)).otherwise(head), F.lit("…")))
    return F.when(F.length(s) >= 3, t)


def show_key(c: Column) -> Column:
    """Comparison key of a title without a city in parentheses at its end."""
    return comparison_key(F.regexp_replace(c, r"(?i)\s*\((ny|new york|nyc|brooklyn|queens|bronx|manhattan)\)\s*$", ""))


def price_label(is_free: Column, low: Column, high: Column, url: Column) -> Column:
    def dollars(x: Column) -> Column:
        return F.concat(F.lit("$"), js_round(x).cast("long").cast("string"))

    span = F.when(low == high, dollars(low)).otherwise(F.concat(dollars(low), F.lit("–"), dollars(high)))
    label = F.when(is_free, "Free").when(low.isNotNull() & high.isNotNull(), span).when(low.isNotNull(), F.concat(F.lit("From "), dollars(low)))
    return label.when(F.coalesce(url, F.lit("")) != "", "View Tickets").otherwise("—")


def source_label(c: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(c, "_(api|scrape)", ""), F.lit("_"), F.lit(" ")))


def html_text(c: Column, most: int | None = None) -> Column:
    """Text of a page: no script and style blocks, tags as blanks, blanks squeezed; with `most`, its first characters, as a prompt takes them."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    whole = F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))
    return whole if most is None else F.substring(whole, 1, most)


# What pages say of an event that is off.
CANCELLED = (
    r"\bcancelled\s+(mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    r"\bthis\s+event\s+has\s+been\s+cancelled\b",
    r"\bevent\s+cancelled\b",
    r"\bthis\s+event\s+has\s+been\s+canceled\b",
    r"\bthis\s+program\s+has\s+been\s+cancell?ed\b",
)


def says_cancelled(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(CANCELLED)), F.lit(False))


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def unescape(c: Column) -> Column:
    """The common HTML entities."""
    for entity, plain in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c
