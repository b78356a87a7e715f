"""Pairs, merges and the venue registry: J7-J11, D1, D2, D4-D11, Q4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, merge, tables, venues
from .q_filters import _GENERIC, BOX, LIVE, listings, sim
from .q_scalars import _venue_token_sql
from .registry import query
from .testviews import view

_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: len(w) > 1))"
_MI = "2 * 3958.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"
_TRUST = "CASE {} WHEN 'ticketmaster_api' THEN 1.0 WHEN 'eventbrite_api' THEN 0.9 WHEN 'songkick_scrape' THEN 0.75 WHEN 'dice_scrape' THEN 0.7 ELSE 0.5 END"
_BOTH = "len(list_intersect(a.t, b.t))"
_VENUE = f"CASE WHEN a.venue_id IS NOT NULL AND b.venue_id IS NOT NULL THEN a.venue_id = b.venue_id ELSE contains(a.k, b.k) OR contains(b.k, a.k) OR coalesce({_MI} <= 0.1, FALSE) END"
_TITLE = f"({_BOTH} / greatest(len(a.t) + len(b.t) - {_BOTH}, 1.0) >= 0.55 OR {_BOTH} = least(len(a.t), len(b.t)))"
_ROWS = f"rows_ AS MATERIALIZED (SELECT *, {_TOKENS.format('title')} AS t, {_KEY.format('venue_name')} AS k, CAST(floor(epoch(start_at) / 1800) AS BIGINT) AS h FROM listings_v WHERE status = 'active')"
_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, a.start_at AS sa, b.start_at AS sb, {_TRUST.format('b.source_type')} AS trust FROM rows_ a JOIN (SELECT *, unnest([h - 1, h, h + 1]) AS near FROM rows_) b ON a.h = b.near AND a.source_type <> b.source_type AND b.start_at BETWEEN a.start_at - INTERVAL 30 MINUTE AND a.start_at + INTERVAL 30 MINUTE AND ({_VENUE}) AND {_TITLE})"


#: Greedy passes as rounds: o is the place in order; a row is a head (1) once all edges before it come from folded ones (2).
_ROUNDS = 40
_HEADS = f"""r(step, o, s) AS (SELECT 0, o, 0 FROM n UNION ALL SELECT step + 1, o, s FROM (SELECT r.step, r.o, CASE WHEN r.s <> 0 THEN r.s WHEN bool_or(p.s = 1) THEN 2 WHEN bool_or(p.s = 0) THEN 0 ELSE 1 END AS s FROM r LEFT JOIN e ON e.v = r.o LEFT JOIN r AS p ON p.o = e.u GROUP BY r.step, r.o, r.s) WHERE step < {_ROUNDS}),
folded AS (SELECT f.o, min(h.o) AS head FROM r AS f JOIN e ON e.v = f.o JOIN r AS h ON h.o = e.u WHERE f.step = {_ROUNDS} AND h.step = {_ROUNDS} AND f.s = 2 AND h.s = 1 GROUP BY f.o)"""


@query("j7_cross_platform", f"WITH {_ROWS}, {_PAIRS} SELECT a, b FROM pairs")
def j7(spark, sf_dir):
    return match.cross_platform_pairs(listings(spark, sf_dir))


@query("j7_best_match", f"WITH {_ROWS}, {_PAIRS} SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY trust DESC, abs(epoch(sa - sb)), b) AS n FROM pairs) WHERE n = 1")
def j7_best(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return match.best_match(match.cross_platform_pairs(rows), rows)


_DUP = f"""titles AS (SELECT DISTINCT title FROM listings_v), scored AS (SELECT a.title AS ta, b.title AS tb, {sim('a.title', 'b.title')} AS s FROM titles a, titles b),
dup AS (SELECT a.id, b.id AS candidate, a.title AS title_a, b.title AS title_b, s AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) AS n FROM listings_v a JOIN listings_v b ON a.status = 'active' AND b.status = 'active' AND a.id <> b.id AND b.start_at BETWEEN a.start_at - INTERVAL 4 HOUR AND a.start_at + INTERVAL 4 HOUR JOIN scored ON ta = a.title AND tb = b.title AND s > 0.3)"""


@query("j8_duplicates", f"WITH {_DUP} SELECT id, candidate, round(similarity, 6) AS similarity FROM dup WHERE n <= 20")
def j8(spark, sf_dir):
    return match.duplicate_candidates(listings(spark, sf_dir)).select("id", "candidate", F.round("similarity", 6).alias("similarity"))


_JT = f"len(list_intersect({_TOKENS.format('title_a')}, {_TOKENS.format('title_b')}))"
_JACC = f"({_JT} / greatest(len({_TOKENS.format('title_a')}) + len({_TOKENS.format('title_b')}) - {_JT}, 1.0))"


@query("q4_duplicate_check", f"WITH {_DUP} SELECT id, count(*) AS suspects, round(max(floor({_JACC} * 100 + 0.5) / 100), 4) AS best FROM dup WHERE n <= 20 AND {_JACC} >= 0.4 GROUP BY id")
def q4(spark, sf_dir):
    found = match.suspected_duplicates(match.duplicate_candidates(listings(spark, sf_dir)))
    return found.groupBy("id").agg(F.count("*").alias("suspects"), F.round(F.max("score"), 4).alias("best"))


def registry(spark, sf_dir):
    """Every third venue is known; one alias of each tenth; all names ask."""
    v = view(spark, sf_dir, "venues_v")
    known = v.where("venue_id % 3 = 0")
    aliases = v.where("venue_id % 10 = 4").select(venues.venue_key(F.col("name")).alias("normalized_alias"), (F.col("venue_id") - 1).alias("venue_id"))
    return v, known, aliases


_METRES = _MI.replace("3958.8", "6371000")
_SHARE = f"({_BOTH} / greatest(len(a.t) + len(b.t) - {_BOTH}, 1.0) >= 0.5 OR {_BOTH} = least(len(a.t), len(b.t)))"
_VENUE_KEY = _venue_token_sql("name").removeprefix("list_distinct(list_filter(string_split(").split(", ' '), lambda")[0]
#: Names in order; `a` asks, `b` is there. Places of askers count where they are valid.
_RESOLVED = f"""k AS MATERIALIZED (SELECT venue_id, name, {_venue_token_sql('name')} AS t, {_VENUE_KEY} AS key, CASE WHEN {BOX} AND NOT ({_GENERIC}) THEN lat END AS lat, CASE WHEN {BOX} AND NOT ({_GENERIC}) THEN lng END AS lng, lat AS raw_lat, lng AS raw_lng FROM venues_v),
known AS (SELECT venue_id, t, key, raw_lat AS lat, raw_lng AS lng FROM k WHERE venue_id % 3 = 0), near AS (SELECT a.name, arg_min(b.venue_id, (len(b.t), {_METRES}, b.venue_id)) AS id FROM k AS a JOIN known AS b ON {_METRES} <= 150 AND len(a.t) > 0 AND len(b.t) > 0 AND {_SHARE} GROUP BY a.name),
x AS (SELECT key, min(venue_id) AS id FROM known GROUP BY key), l AS (SELECT key, min(venue_id - 1) AS id FROM k WHERE venue_id % 10 = 4 GROUP BY key),
found AS MATERIALIZED (SELECT k.*, x.id AS exact_id, l.id AS alias_id, CASE WHEN x.id IS NULL AND l.id IS NULL THEN near.id END AS near_id FROM k LEFT JOIN x USING (key) LEFT JOIN l USING (key) LEFT JOIN near USING (name))"""


@query("j9_resolve_venues", f"""WITH RECURSIVE {_RESOLVED}, v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY name) AS o FROM found WHERE coalesce(exact_id, alias_id, near_id) IS NULL),
m AS MATERIALIZED (SELECT b.o AS u, a.o AS v, (len(b.t), {_METRES}, b.name) AS rank, b.key FROM v AS a JOIN v AS b ON b.o < a.o AND {_METRES} <= 150 AND {_SHARE}), e AS (SELECT u, v FROM m), n AS (SELECT o FROM v), {_HEADS},
best AS (SELECT m.v AS o, arg_min(m.key, m.rank) AS key FROM m JOIN r ON r.o = m.u AND r.s = 1 AND r.step = {_ROUNDS} JOIN folded ON folded.o = m.v GROUP BY m.v)
SELECT f.name, coalesce(f.exact_id, f.alias_id, f.near_id) AS venue_id, CASE WHEN f.exact_id IS NOT NULL THEN 'exact_name' WHEN f.alias_id IS NOT NULL THEN 'alias' WHEN f.near_id IS NOT NULL OR best.key IS NOT NULL THEN 'proximity' ELSE 'created' END AS matched_by, CASE WHEN v.o IS NOT NULL THEN coalesce(best.key, f.key) END AS new_key
FROM found f LEFT JOIN v ON v.name = f.name LEFT JOIN best ON best.o = v.o""")
def j9(spark, sf_dir):
    v, known, aliases = registry(spark, sf_dir)
    return venues.resolve(v.select("name", "lat", "lng"), known, aliases).select("name", "venue_id", "matched_by", "new_key")


@query("j10_backfill_places", "SELECT venue_id, CASE WHEN lat IS NULL THEN 40.7001 ELSE lat END AS lat FROM venues_v")
def j10(spark, sf_dir):
    v = view(spark, sf_dir, "venues_v").select("venue_id", "name", "lat", "lng")
    came = v.select("venue_id", "name", F.lit(40.7001).alias("lat"), F.lit(-73.9003).alias("lng"))
    return venues.backfilled(v, came).select("venue_id", "lat")


@query("j11_aliases", f"SELECT key, min(venue_id) AS venue_id FROM (SELECT array_to_string(list_sort({_venue_token_sql('name')}), ' ') AS key, venue_id FROM venues_v) GROUP BY key")
def j11(spark, sf_dir):
    keys = venues.keyed(view(spark, sf_dir, "venues_v").select("venue_id", "name")).select(F.array_join(F.array_sort("tokens"), " ").alias("normalized_alias"), "venue_id")
    return tables.first_alias(keys, F.col("venue_id")).select(F.col("normalized_alias").alias("key"), "venue_id")


@query("d1_merged", f"WITH m AS (SELECT id - id % 10 AS c, max_by(struct_pack(title := title, source_type := source_type), ({_TRUST.format('source_type')}, -id)) AS best, max({_TRUST.format('source_type')}) AS trust, count(*) AS sources FROM listings_v WHERE id % 10 <> 0 GROUP BY 1), p AS (SELECT id - id % 10 AS c, count(DISTINCT lower(coalesce(platform, 'unknown'))) AS tickets FROM listings_v GROUP BY 1) SELECT l.id, CASE WHEN m.trust > {_TRUST.format('l.source_type')} THEN best.title ELSE l.title END AS title, CASE WHEN m.trust > {_TRUST.format('l.source_type')} THEN best.source_type ELSE l.source_type END AS source_type, coalesce(m.trust > {_TRUST.format('l.source_type')}, FALSE) AS promoted, CAST(p.tickets AS INTEGER) AS tickets, CAST(coalesce(m.sources, 0) AS INTEGER) AS sources FROM listings_v l LEFT JOIN m ON m.c = l.id JOIN p ON p.c = l.id WHERE l.id % 10 = 0")
def d1(spark, sf_dir):
    rows = listings(spark, sf_dir)
    incoming = rows.where("id % 10 <> 0").withColumn("canonical_id", F.col("id") - F.col("id") % 10)
    out = merge.merged(rows.where("id % 10 = 0"), incoming, ["title", "start_at", "image_url", "source_type", "external_id"])
    return out.select("id", "title", "source_type", "promoted", F.size("ticket_urls").alias("tickets"), F.size("merged_source_ids").alias("sources"))


_DEC = "(id - id % 10)"


@query("d1_merge_counts", f"WITH m AS (SELECT {_DEC} AS canonical, count(*) FILTER (id % 10 <> 0) AS sources, count(DISTINCT lower(coalesce(platform, 'unknown'))) AS tickets, max({_TRUST.format('source_type')}) FILTER (id % 10 <> 0) > max({_TRUST.format('source_type')}) FILTER (id % 10 = 0) AS promoted FROM listings_v GROUP BY 1 HAVING count(*) FILTER (id % 10 = 0) > 0) SELECT canonical AS id, CAST(tickets AS INTEGER) AS tickets, CAST(sources AS INTEGER) AS sources, coalesce(promoted, FALSE) AS promoted FROM m")
def d1_counts(spark, sf_dir):
    return d1(spark, sf_dir).select("id", "tickets", "sources", "promoted")


#: Greedy groups by a walk over all rows that match any, in order: grp holds the groups whose shown row is within two hours.
#: To be formatted with the rows' condition and a further one of pairs.
WALK = f"""shows AS MATERIALIZED (SELECT *, {_KEY.format('title')} AS tk, {_KEY.format('venue_name')} AS k, CAST(floor(epoch(start_at) / 7200) AS BIGINT) AS h FROM listings_v WHERE %s),
same AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM shows AS a JOIN (SELECT *, unnest([h - 1, h, h + 1]) AS near FROM shows) AS b ON a.h = b.near AND (a.start_at < b.start_at OR (a.start_at = b.start_at AND a.id < b.id)) AND b.start_at <= a.start_at + INTERVAL 2 HOUR AND (contains(a.tk, b.tk) OR contains(b.tk, a.tk)) AND (contains(a.k, b.k) OR contains(b.k, a.k) OR coalesce({_MI} <= 0.1, FALSE)) AND %s),
q AS MATERIALIZED (SELECT s.id, s.start_at, coalesce(s.confidence_score, 1.0) AS score, coalesce(e.earlier, []) AS earlier, row_number() OVER (ORDER BY s.start_at, s.id) AS k FROM shows AS s LEFT JOIN (SELECT b AS id, list(a) AS earlier FROM same GROUP BY b) AS e USING (id) WHERE s.id IN (SELECT a FROM same UNION SELECT b FROM same)),
w(k, grp, num, shown) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(num BIGINT, shown BIGINT, score DOUBLE, start TIMESTAMP)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
SELECT k, CASE WHEN home IS NULL THEN list_append(near, own) ELSE list_transform(near, lambda g: CASE WHEN g.num = home.num AND score > g.score THEN struct_pack(num := g.num, shown := id, score := score, start := start_at) ELSE g END) END, coalesce(home.num, k), CASE WHEN home IS NULL OR score > home.score THEN id ELSE home.shown END
FROM (SELECT *, list_filter(near, lambda g: list_contains(earlier, g.shown))[1] AS home, struct_pack(num := k, shown := id, score := score, start := start_at) AS own FROM (SELECT q.*, list_filter(w.grp, lambda g: g.start >= q.start_at - INTERVAL 2 HOUR) AS near FROM w JOIN q ON q.k = w.k + 1))),
placed AS (SELECT q.id, x.shown FROM w JOIN q USING (k) JOIN (SELECT num, arg_max(shown, k) AS shown FROM w GROUP BY num) AS x USING (num)),
member AS MATERIALIZED (SELECT s.*, coalesce(p.shown, s.id) AS shown FROM shows AS s LEFT JOIN placed AS p USING (id))"""


@query("d2_query_time_dedup", f"WITH RECURSIVE {WALK % (LIVE, 'TRUE')} SELECT id, title, confidence_score FROM member WHERE shown = id")
def d2(spark, sf_dir):
    from ..functions.dates import live
    from .testviews import AS_OF

    return merge.deduplicate(listings(spark, sf_dir).where(live(AS_OF))).select("id", "title", "confidence_score")


@query("d2_united_tickets", f"WITH RECURSIVE {WALK % (LIVE, 'TRUE')}, t AS (SELECT shown, arg_min(coalesce(nullif(platform, ''), 'Unknown'), (start_at, id)) AS platform, min((start_at, id)) AS first_at FROM member GROUP BY shown, lower(coalesce(nullif(platform, ''), 'Unknown'))) SELECT shown AS id, CAST(count(*) AS INTEGER) AS tickets, string_agg(platform, ',' ORDER BY first_at) AS platforms FROM t GROUP BY shown")
def d2_tickets(spark, sf_dir):
    from ..functions.dates import live
    from .testviews import AS_OF

    out = merge.deduplicate(listings(spark, sf_dir).where(live(AS_OF)))
    return out.select("id", F.size("ticket_sources").alias("tickets"), F.array_join(F.transform("ticket_sources", lambda t: t["platform"]), ",").alias("platforms"))


@query("j14_comparison", f"WITH RECURSIVE {WALK % (chr(39).join(['status = ', 'active', '']), 'CAST(a.start_at AS DATE) = CAST(b.start_at AS DATE)')}, g AS (SELECT shown, min((start_at, id)) AS first, count(DISTINCT lower(coalesce(platform, 'unknown'))) AS tickets FROM member GROUP BY shown), n AS (SELECT id, shown, CAST(start_at AS DATE) AS day, lower(title) AS t, lower(venue_name) AS v FROM member), best AS (SELECT n.day, n.t, n.v, arg_min(struct_pack(shown := g.shown, tickets := g.tickets), g.first) AS g FROM n JOIN g ON g.shown = n.id WHERE n.id = n.shown GROUP BY ALL) SELECT n.id, coalesce(best.g.shown, n.id) AS shown, CAST(coalesce(best.g.tickets, 1) AS INTEGER) AS tickets FROM n LEFT JOIN best USING (day, t, v)")
def j14_comparison(spark, sf_dir):
    out = merge.same_day_comparison(listings(spark, sf_dir))
    return out.select("id", "shown", F.size("tickets").alias("tickets"))


@query("d4_batch_merge", f"WITH RECURSIVE {_ROWS}, {_PAIRS}, ord AS (SELECT id, platform, row_number() OVER (ORDER BY {_TRUST.format('source_type')} DESC, start_at, id) AS o FROM listings_v), e AS MATERIALIZED (SELECT x.o AS u, y.o AS v FROM pairs JOIN ord AS x ON x.id = a JOIN ord AS y ON y.id = b WHERE x.o < y.o), n AS (SELECT u AS o FROM e UNION SELECT v FROM e), {_HEADS}, m AS (SELECT coalesce(f.head, ord.o) AS o, count(*) - 1 AS sources, count(DISTINCT lower(coalesce(platform, 'unknown'))) AS tickets FROM ord LEFT JOIN folded f ON f.o = ord.o GROUP BY 1) SELECT l.id, l.source_type, FALSE AS promoted, CAST(m.tickets AS INTEGER) AS tickets, CAST(m.sources AS INTEGER) AS sources FROM listings_v l JOIN ord USING (id) JOIN m ON m.o = ord.o WHERE l.status = 'active' AND ord.o NOT IN (SELECT o FROM folded)")
def d4(spark, sf_dir):
    out = merge.batch_merge(listings(spark, sf_dir), ["title", "start_at", "source_type", "external_id"])
    return out.select("id", "source_type", "promoted", F.size("ticket_urls").alias("tickets"), F.size("merged_source_ids").alias("sources"))


@query("d5_trust", f"SELECT source_type, CAST({_TRUST.format('source_type')} AS DOUBLE) AS trust, count(*) AS n FROM listings_v GROUP BY source_type")
def d5(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n")).select("source_type", match.trust(F.col("source_type")).alias("trust"), "n")


@query("d6_initial_tickets", "SELECT id, coalesce(platform, 'unknown') AS platform, ticket_url AS url FROM listings_v")
def d6(spark, sf_dir):
    return listings(spark, sf_dir).select("id", F.explode(merge.initial_tickets()).alias("t")).select("id", "t.platform", "t.url")


_M = _MI.replace("3958.8", "6371000")


def _venue_pass(tokens: str, source: str, inside: str) -> str:
    """The scripts' loop over venues of source(venue_id, name, lat, lng) in order of their number of tokens."""
    return f"""WITH RECURSIVE k AS (SELECT *, {tokens} AS t FROM {source}), v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY len(t), venue_id) AS o FROM k),
e AS MATERIALIZED (SELECT a.o AS u, b.o AS v FROM v AS a JOIN v AS b ON a.o < b.o WHERE {inside}), n AS (SELECT o FROM v), {_HEADS}
SELECT d.venue_id AS duplicate, c.venue_id AS canonical FROM folded f JOIN v AS d ON d.o = f.o JOIN v AS c ON c.o = f.head"""


@query("d7_dedupe_by_tokens", _venue_pass(_venue_token_sql("name"), "venues_v", f"len(a.t) > 0 AND len(list_intersect(a.t, b.t)) = len(a.t) AND (len(a.t) = len(b.t) OR coalesce({_M} <= 150, FALSE))"))
def d7(spark, sf_dir):
    return venues.dedupe_by_tokens(view(spark, sf_dir, "venues_v"))


_PLAYHOUSES = "(SELECT venue_id, concat(name, CASE WHEN venue_id % 9 < 6 THEN ' Theatre' ELSE ' Block Party' END, CASE WHEN venue_id % 9 IN (1, 7) THEN ' Annex' ELSE '' END) AS name, lat, lng FROM venues_v)"


@query("d8_dedupe_by_name", _venue_pass(_venue_token_sql("name"), _PLAYHOUSES, f"len(a.t) >= 3 AND len(a.t) < len(b.t) AND len(list_intersect(a.t, b.t)) = len(a.t) AND coalesce({_M} <= 500, FALSE) AND NOT contains(lower(a.name), 'block party')"))
def d8(spark, sf_dir):
    i = F.col("venue_id") % 9
    named = F.concat("name", F.when(i < 6, " Theatre").otherwise(" Block Party"), F.when(i.isin(1, 7), " Annex").otherwise(""))
    return venues.dedupe_by_name(view(spark, sf_dir, "venues_v").withColumn("name", named))


@query("d9_merge_venues", "SELECT CASE WHEN venue_id % 3 = 1 THEN venue_id - 1 ELSE venue_id END AS venue_id, count(*) AS events FROM listings_v WHERE venue_id IS NOT NULL GROUP BY 1")
def d9(spark, sf_dir):
    v = view(spark, sf_dir, "venues_v").select("venue_id", "name", "lat", "lng")
    none = spark.createDataFrame([], "alias string, normalized_alias string, venue_id long, source_type string")
    mapping = v.where("venue_id % 3 = 1").select(F.col("venue_id").alias("duplicate"), (F.col("venue_id") - 1).alias("canonical"))
    rows, _, _ = venues.merge_into(listings(spark, sf_dir), v, none, mapping)
    return rows.where("venue_id is not null").groupBy("venue_id").agg(F.count("*").alias("events"))


@query("d10_first_wins", "SELECT user_id, min_by(event_id, (ts, event_id)) AS first_id, max_by(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def d10(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    first = tables.latest(e, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", F.col("event_id").alias("first_id"))
    last = tables.latest(e, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query("d11_colliding_names", f"SELECT key, count(*) AS n FROM (SELECT {_KEY.format('name')} AS key FROM (SELECT regexp_replace(regexp_replace(name, '^The ', ''), '( - .*| & .*)$', '') AS name FROM venues_v)) GROUP BY key HAVING count(*) > 1")
def d11(spark, sf_dir):
    keys = view(spark, sf_dir, "venues_v").select("name", F.replace(venues.venue_key(F.regexp_replace("name", "( - .*| & .*)$", "")), F.lit(" "), F.lit("")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


@query("w4_top_candidates", f"WITH {_DUP} SELECT id, candidate, n AS rank FROM dup WHERE n <= 3")
def w4(spark, sf_dir):
    from pyspark.sql.window import Window

    top = Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate")
    rows = match.duplicate_candidates(listings(spark, sf_dir), most=3)
    return rows.select("id", "candidate", F.row_number().over(top).cast("long").alias("rank"))


@query("w5_best_venue", f"WITH {_RESOLVED} SELECT name, near_id AS venue_id FROM found WHERE near_id IS NOT NULL")
def w5(spark, sf_dir):
    v, known, aliases = registry(spark, sf_dir)
    return venues.resolve(v.select("name", "lat", "lng"), known, aliases).where("matched_by = 'proximity' and venue_id is not null").select("name", "venue_id")
