"""Scalar functions and classification: K, E1-E4, C."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, geo, text
from ..schemas import NYC
from .q_filters import listings, sim
from .registry import query
from .testviews import AS_OF, view

FOLD = "lower(strip_accents({c}))"


def texts(spark, sf_dir):
    """Documents' whole texts, which have accents."""
    return view(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("line"))


_LINE = "(SELECT doc_id, coalesce(text, '') AS line FROM documents)"


@query("k1_comparison_key", f"SELECT doc_id, regexp_replace({FOLD.format(c='line')}, '[^a-z0-9]', '', 'g') AS key FROM {_LINE}")
def k1(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.comparison_key(F.col("line")).alias("key"))


@query("k2_venue_key", "SELECT venue_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b(the|a|an)\\b', ' ', 'g'), ' +', ' ', 'g')) AS key FROM venues_v")
def k2(spark, sf_dir):
    return view(spark, sf_dir, "venues_v").select("venue_id", text.venue_key(F.col("name")).alias("key"))


@query("k3_title_tokens", f"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex({FOLD.format(c='line')}, '[^a-z0-9]+'), lambda w: len(w) > 1))) AS INTEGER) AS tokens FROM {_LINE}")
def k3(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.size(text.title_tokens(F.col("line"))).alias("tokens"))


_A, _B = ("list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: len(w) > 1)".format(c) for c in ("a.p_name", "b.p_name"))


@query("k4_jaccard", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect({_A}, {_B})) / greatest(len(list_distinct(list_concat({_A}, {_B}))), 1.0), 6) AS jaccard FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def k4(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", text.title_tokens(F.col("p_name")).alias("t"))
    pairs = p.toDF("a", "ta").withColumn("b", F.col("a") + 1).join(p.toDF("b", "tb"), "b")
    return pairs.select("a", "b", F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


@query("k5_trigrams", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({sim('a.p_name', 'b.p_name')}, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def k5(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", text.trigrams(F.col("p_name")).alias("t"))
    pairs = p.toDF("a", "ta").withColumn("b", F.col("a") + 1).join(p.toDF("b", "tb"), "b")
    return pairs.select("a", "b", F.round(text.similarity(F.col("ta"), F.col("tb")), 6).alias("similarity"))


_RAW = "concat(upper(substring(title, 1, 4)), substring(title, 5), CASE WHEN id % 3 = 0 THEN '  live!! at NYC' ELSE '' END)"


@query("k6_clean_title", f"SELECT id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace({_RAW}, '[!?*#@]{{2,}}', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN upper(w) IN ('LIVE', 'NYC') THEN upper(w) WHEN regexp_full_match(w, '[A-Z]{{2,}}') THEN w ELSE concat(upper(w[1]), lower(w[2:])) END), ' ') AS title FROM listings_v")
def k6(spark, sf_dir):
    raw = F.concat(F.upper(F.substring("title", 1, 4)), F.expr("substring(title, 5)"), F.when(F.col("id") % 3 == 0, "  live!! at NYC").otherwise(""))
    return listings(spark, sf_dir).select("id", text.clean_title(raw).alias("title"))


@query("k7_show_key", "SELECT id, regexp_replace(lower(regexp_replace(concat(title, CASE id % 3 WHEN 0 THEN ' (NY)' WHEN 1 THEN ' (Brooklyn) ' ELSE ' (LA)' END), '(?i)\\s*\\((ny|new york|nyc|brooklyn|queens|bronx|manhattan)\\)\\s*$', '')), '[^a-z0-9]', '', 'g') AS key FROM listings_v")
def k7(spark, sf_dir):
    suffix = F.when(F.col("id") % 3 == 0, " (NY)").when(F.col("id") % 3 == 1, " (Brooklyn) ").otherwise(" (LA)")
    return listings(spark, sf_dir).select("id", text.show_key(F.concat("title", suffix)).alias("key"))


_D = "concat('$', CAST(CAST(floor({c} + 0.5) AS BIGINT) AS VARCHAR))"


@query("k8_price_label", f"SELECT id, CASE WHEN is_free THEN 'Free' WHEN price_min IS NOT NULL AND price_max IS NOT NULL THEN CASE WHEN price_min = price_max THEN {_D.format(c='price_min')} ELSE concat({_D.format(c='price_min')}, '–', {_D.format(c='price_max')}) END WHEN price_min IS NOT NULL THEN concat('From ', {_D.format(c='price_min')}) WHEN ticket_url IS NOT NULL THEN 'View Tickets' ELSE '—' END AS label FROM listings_v")
def k8(spark, sf_dir):
    return listings(spark, sf_dir).select("id", text.price_label(F.col("is_free"), F.col("price_min"), F.col("price_max"), F.col("ticket_url")).alias("label"))


@query("k9_source_label", "SELECT DISTINCT source_type, CASE source_type WHEN 'ticketmaster_api' THEN 'Ticketmaster' WHEN 'eventbrite_api' THEN 'Eventbrite' WHEN 'songkick_scrape' THEN 'Songkick' WHEN 'dice_scrape' THEN 'Dice' WHEN 'ical' THEN 'Ical' ELSE 'Direct Submission' END AS label FROM listings_v")
def k9(spark, sf_dir):
    return listings(spark, sf_dir).select("source_type").distinct().select("source_type", text.source_label(F.col("source_type")).alias("label"))


@query("k10_html_text", "SELECT page_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000) AS text FROM pages")
def k10(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html"), 8000).alias("text"))


@query("k11_cancelled", "SELECT page_id, page_id % 4 = 0 OR page_id % 6 = 1 AS cancelled FROM pages")
def k11(spark, sf_dir):
    said = F.when(F.col("page_id") % 4 == 0, " Cancelled Mon, Jun 8 ").when(F.col("page_id") % 6 == 1, " This program has been canceled ").otherwise(" cancel your reservation ")
    return view(spark, sf_dir, "pages").select("page_id", text.says_cancelled(text.html_text(F.concat("html", said))).alias("cancelled"))


@query("k12_city_clock", "SELECT event_id, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS wall FROM events")
def k12(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", dates.to_wall(F.col("ts"), NYC.zone).alias("wall"))


@query("k13_date_and_clock", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('minute', ts) END AS at FROM events")
def k13(spark, sf_dir):
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.date_format("ts", "HH:mm"))
    return view(spark, sf_dir, "events").select("event_id", dates.on_clock(day, clock).alias("at"))


@query("k14_rounding", "SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS whole, round(floor(value * 100 + 0.5) / 100, 6) AS cents FROM events")
def k14(spark, sf_dir):
    v = F.col("value")
    return view(spark, sf_dir, "events").select("event_id", text.js_round(v).cast("long").alias("whole"), F.round(text.js_round(v * 100) / 100, 6).alias("cents"))


@query("k15_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def k15(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("k16_lookups", "SELECT id, CAST(CASE source_type WHEN 'ticketmaster_api' THEN 1.0 WHEN 'eventbrite_api' THEN 0.9 WHEN 'songkick_scrape' THEN 0.75 WHEN 'dice_scrape' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS trust, CAST(CASE category WHEN 'music' THEN 3 WHEN 'comedy' THEN 1.5 WHEN 'art' THEN 3 WHEN 'film' THEN 2 ELSE 2.5 END AS DOUBLE) AS hours FROM listings_v")
def k16(spark, sf_dir):
    from ..operators.match import trust

    return listings(spark, sf_dir).select("id", trust(F.col("source_type")).alias("trust"), dates.usual_hours(F.col("category")).alias("hours"))


_M = "2 * {r} * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@query("e1_haversine", f"SELECT a.venue_id AS a, round({_M.format(r=3958.8)}, 5) AS miles, round({_M.format(r=6371000)}, 2) AS metres FROM venues_v a JOIN venues_v b ON b.venue_id = a.venue_id + 1")
def e1(spark, sf_dir):
    v = view(spark, sf_dir, "venues_v").select("venue_id", "lat", "lng")
    p = v.toDF("a", "la", "oa").withColumn("b", F.col("a") + 1).join(v.toDF("b", "lb", "ob"), "b")
    d = lambda r: geo.haversine(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"), r)
    return p.select("a", F.round(d(geo.MILES), 5).alias("miles"), F.round(d(geo.METRES), 2).alias("metres"))


@query("e2_similar_venues", f"SELECT a.venue_id AS a, b.venue_id AS b FROM venues_v a JOIN venues_v b ON a.venue_id < b.venue_id WHERE contains(regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g')) OR {_M.format(r=3958.8)} <= 0.1")
def e2(spark, sf_dir):
    from ..operators.match import venue_pairs

    v = view(spark, sf_dir, "venues_v").select(F.col("venue_id").alias("place"), F.col("name").alias("venue_name"), "lat", "lng")
    return venue_pairs(v).where("place_a < place_b").select(F.col("place_a").alias("a"), F.col("place_b").alias("b"))


def _venue_token_sql(c):
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b(the|a|an)\\b', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: len(w) > 1))"


_VA, _VB = _venue_token_sql("a.name"), _venue_token_sql("b.name")
_BOTH = f"len(list_intersect({_VA}, {_VB}))"


@query("e3_shared_identity", f"SELECT a.venue_id AS a, b.venue_id AS b, {_BOTH} / greatest(len({_VA}) + len({_VB}) - {_BOTH}, 1.0) >= 0.5 OR {_BOTH} = least(len({_VA}), len({_VB})) AS shared FROM venues_v a JOIN venues_v b ON b.venue_id BETWEEN a.venue_id + 1 AND a.venue_id + 3")
def e3(spark, sf_dir):
    v = view(spark, sf_dir, "venues_v").select("venue_id", text.venue_tokens(text.venue_key(F.col("name"))).alias("t"))
    steps = v.toDF("a", "ta").select("*", F.explode(F.array(*(F.col("a") + i for i in (1, 2, 3)))).alias("b"))
    return steps.join(v.toDF("b", "tb"), "b").select("a", "b", text.share_identity(F.col("ta"), F.col("tb"), 0.5).alias("shared"))


_TB = f"len(list_intersect({_A}, {_B}))"


@query("e4_similar_titles", f"SELECT a.p_partkey AS a, b.p_partkey AS b, {_TB} / greatest(len(list_distinct({_A})) + len(list_distinct({_B})) - {_TB}, 1.0) >= 0.55 OR {_TB} = least(len(list_distinct({_A})), len(list_distinct({_B}))) AS alike FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64")
def e4(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", text.title_tokens(F.col("p_name")).alias("t"))
    pairs = p.toDF("a", "ta").withColumn("b", F.col("a") + 64).join(p.toDF("b", "tb"), "b")
    return pairs.select("a", "b", text.share_identity(F.col("ta"), F.col("tb"), 0.55).alias("alike"))


_SEG = "list_extract(['Music', 'Sports', 'Miscellaneous', NULL, ' Film ', 'Unknown'], CAST(id % 6 AS INTEGER) + 1)"


@query("c1_taxonomy", "SELECT id, CASE id % 6 WHEN 0 THEN 'music' WHEN 1 THEN 'sports' WHEN 2 THEN 'other' WHEN 3 THEN CASE id % 4 WHEN 1 THEN 'comedy' ELSE 'fitness' END WHEN 4 THEN 'film' ELSE CASE id % 4 WHEN 1 THEN 'comedy' ELSE 'fitness' END END AS category FROM listings_v")
def c1(spark, sf_dir):
    k = F.col("id")
    segment = F.get(F.array(*(F.lit(x) for x in ("Music", "Sports", "Miscellaneous", None, " Film ", "Unknown"))), (k % 6).cast("int"))
    genre = F.when(k % 4 == 1, "Stand-Up")
    return listings(spark, sf_dir).select("id", classify.from_taxonomy(segment, genre, F.lit("Sports & Fitness")).alias("category"))


_KEYWORD_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i)\\b({p})\\b') THEN '{c}' END" for c, p in classify.KEYWORDS.items()) + ")"
_PHRASES = ["comedy night", "a documentary", "broadway", "gallery opening", "wine tasting", "yoga", "nba game", "dj set", "all ages", "block party", "jazz", "nothing"]
_PHRASE = "list_extract([" + ", ".join(f"'{p}'" for p in _PHRASES) + "], CAST(id % 12 AS INTEGER) + 1)"


@query("c2_keywords", f"SELECT id, {_KEYWORD_SQL} AS category FROM (SELECT id, concat(title, ' ', coalesce(description, ''), ' ', {_PHRASE}) AS t FROM listings_v)")
def c2(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("id") % 12).cast("int"))
    return listings(spark, sf_dir).select("id", classify.from_keywords(F.col("title"), F.concat_ws(" ", "description", phrase)).alias("category"))


@query("c3_classify", f"SELECT l.id, coalesce(CASE WHEN l.id % 5 = 0 THEN 'music' END, {_KEYWORD_SQL}, CASE WHEN b.toxic = 1 THEN 'nightlife' END, 'other') AS category FROM (SELECT id, concat(title, ' ', coalesce(description, ''), ' ', CASE WHEN id % 2 = 0 THEN {_PHRASE} ELSE '' END) AS t FROM listings_v) l LEFT JOIN labels b ON b.doc_id = l.id")
def c3(spark, sf_dir):
    verdicts = view(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("nightlife").alias("verdict"))
    phrase = F.when(F.col("id") % 2 == 0, F.get(F.array(*map(F.lit, _PHRASES)), (F.col("id") % 12).cast("int"))).otherwise("")
    taxonomy = classify.from_taxonomy(F.when(F.col("id") % 5 == 0, "music"))
    rows = listings(spark, sf_dir).join(verdicts, "id", "left")
    return rows.select("id", classify.classify(taxonomy, F.col("title"), F.concat_ws(" ", "description", phrase), F.col("verdict")).alias("category"))


_CLEAN = "array_to_string(list_transform(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN upper(w) IN ('LIVE', 'NYC') THEN upper(w) WHEN regexp_full_match(w, '[A-Z]{2,}') THEN w ELSE concat(upper(w[1]), lower(w[2:])) END), ' ')"


@query("c4_reclean", f"SELECT CAST(count_if({_CLEAN} <> title) AS BIGINT) AS titles, CAST(count_if(category = 'other' AND coalesce({_KEYWORD_SQL}, 'other') <> 'other') AS BIGINT) AS categories FROM (SELECT *, concat(title, ' ', coalesce(description, '')) AS t FROM listings_v)")
def c4(spark, sf_dir):
    rows = listings(spark, sf_dir)
    new = text.clean_title(F.col("title"))
    category = F.when(F.col("category").isNull() | (F.col("category") == "other"), classify.from_keywords(F.col("title"), F.col("description"))).otherwise(F.col("category"))
    return rows.agg(F.count_if(~new.eqNullSafe(F.col("title"))).alias("titles"), F.count_if(F.coalesce(category, F.lit("other")) != F.coalesce("category", F.lit("other"))).alias("categories"))


@query("c4_recleaned_rows", f"SELECT id, {_CLEAN} AS title, CASE WHEN category = 'other' THEN coalesce({_KEYWORD_SQL}, 'other') ELSE category END AS category FROM (SELECT *, concat(title, ' ', coalesce(description, '')) AS t FROM listings_v)")
def c4_rows(spark, sf_dir):
    """The rows as the backfill leaves them."""
    rows = listings(spark, sf_dir)
    found = F.coalesce(classify.from_keywords(F.col("title"), F.col("description")), F.lit("other"))
    category = F.when(F.coalesce("category", F.lit("other")) == "other", found).otherwise(F.col("category"))
    return rows.select("id", F.coalesce(text.clean_title(F.col("title")), F.col("title")).alias("title"), category.alias("category"))
