"""Categories of listings from platform taxonomies and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Taxonomy labels of the platforms and the categories that they stand for.
SEGMENTS = {"music": "music", "sports": "sports", "arts & theatre": "theater", "arts & theater": "theater", "film": "film", "family & kids": "family", "family": "family", "miscellaneous": "other"}
GENRES = {
    "comedy": "comedy", "stand-up": "comedy", "stand up": "comedy", "theatre": "theater", "theater": "theater", "opera": "theater", "ballet": "theater", "dance": "theater", "film": "film",
    "food & drink": "food_drink", "food": "food_drink", "fitness": "fitness", "yoga": "fitness", "nightlife": "nightlife", "club": "nightlife", "visual arts": "art", "fine art": "art", "gallery": "art",
    "community": "community", "festival": "community", "fair": "community", "family friendly": "family", "children": "family",
}
LABELS = {
    "music": "music", "film & media": "film", "arts & entertainment": "art", "food & drink": "food_drink", "community": "community", "education & knowledge": "community", "charity": "community",
    "sports & fitness": "fitness", "family": "family", "nightlife": "nightlife", "comedy": "comedy", "theater": "theater", "theatre": "theater", "business": "other", "technology": "other",
}
FORMATS = (("concert|performance", "music"), ("comedy", "comedy"), ("film|screening", "film"))

# Word patterns by category; the first category with a match counts.
KEYWORDS = {
    "comedy": r"stand[- ]?up|comedy (night|show|hour|open mic|special)|improv|comedian|laugh",
    "film": r"film (festival|screening|series)|screening|movie night|cinema|documentary|short films?",
    "theater": r"theat(er|re)|broadway|opera|ballet|dance performance|stage (show|production|play)|musical",
    "art": r"opening (reception|night)|art (show|exhibition|exhibit|walk|fair|gallery)|gallery|exhibit(ion)?|installation|painting|sculpture|photography show",
    "food_drink": r"wine (tasting|dinner|pairing)|beer (tasting|fest|garden)|food (market|festival|fair|tour|truck)|cocktail (class|hour|party)|brunch|dinner (series|event)|tasting (menu|event)|whiskey|farm[- ]to[- ]table",
    "fitness": r"yoga|pilates|workout|5k|marathon|hike|cycling|crossfit|boot camp|run (club|series)",
    "sports": r"(knicks|yankees|mets|giants|jets|rangers|islanders|red bulls)|(nba|mlb|nfl|nhl|mls) (game|match)|championship|tournament|boxing match|wrestling|tennis (open|match)",
    "nightlife": r"dj set|night(club|life)|club night|after[- ]?party|boat party|rooftop (party|bar)|house (party|music night)|open bar|bar crawl",
    "family": r"kids?|children|all ages|family (fun|friendly|day|event)|story ?time|puppet|playground",
    "community": r"festival|fair|market|flea market|parade|block party|neighborhood|community (event|gathering|meetup)|fundraiser|charity|volunteer",
    "music": r"concert|live music|band|jazz|hip[- ]?hop|rap|indierock|rock (show|night)|eclectic (sounds|music)|open mic|performing (live|at)|tour (date|stop)|album (release|launch)",
}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.coalesce(key, F.lit("\0")))


def from_taxonomy(segment: Column | None = None, genre: Column | None = None, label: Column | None = None, form: Column | None = None) -> Column:
    """Segment, then genre, then category label, then format; the first that is known."""
    none = F.lit(None).cast("string")
    key = lambda c: none if c is None else F.trim(F.lower(c))
    by_form = F.when(F.lit(False), none)
    for pattern, category in FORMATS:
        by_form = by_form.when((none if form is None else form).rlike(f"(?i){pattern}"), category)
    return F.coalesce(lookup(SEGMENTS, key(segment)), lookup(GENRES, key(genre)), lookup(LABELS, key(label)), by_form)


def from_keywords(title: Column, description: Column) -> Column:
    """One alternation for each category, in order."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return F.coalesce(*(F.when(text.rlike(rf"(?i)\b({pattern})\b"), category) for category, pattern in KEYWORDS.items()))


def classify(taxonomy: Column, title: Column, description: Column, verdict: Column | None = None, default: str = "other") -> Column:
    """Taxonomy, keywords, an external verdict, then the default."""
    rest = [] if verdict is None else [verdict]
    return F.coalesce(taxonomy, from_keywords(title, description), *rest, F.lit(default))
