"""Pairs, merges, registry and tables against brute force and on small literal frames."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import feed, graph, match, merge, tables, venues, verify
from marquee.plans.testviews import view
from marquee.schemas import NYC

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 2, 1, 20)
LISTING = "id long, external_id string, source_type string, title string, start_at timestamp_ntz, venue_id long, venue_name string, lat double, lng double, status string, ticket_url string, platform string, price_min double, price_max double, is_free boolean, confidence_score double"


def listing(spark, rows):
    out = []
    for i, (source, title, minutes, venue, lat, score) in enumerate(rows, 1):
        out.append((i, f"x{i}", source, title, T0 + timedelta(minutes=minutes), None, venue, lat, -73.9 if lat else None, "active", "http://t", source, None, None, False, score))
    return spark.createDataFrame(out, LISTING)


def test_pages_are_scanned_to_their_end(spark):
    rows = spark.createDataFrame([(i, "http://t", "active") for i in (1, 2, 3)], "event_id long, ticket_url string, status string")
    said = "<p>This event has been cancelled</p>"
    pages = spark.createDataFrame([(1, 200, "word " * 1100 + said), (2, 200, "word " * 3000 + said), (3, 200, "word " * 3000)], "event_id long, http_status int, html string")
    verdicts = spark.createDataFrame([(i, True, "seen") for i in (1, 2, 3)], "event_id long, confirmed boolean, reason string")
    got = {r.event_id: (r.expire, r.reason) for r in verify.verify_pages(rows, pages, verdicts, spark.createDataFrame([], "event_id long, delta double"), []).collect()}
    assert got == {1: (True, "page says cancelled"), 2: (True, "page says cancelled"), 3: (False, "seen")}


def test_thirty_minutes_are_included(spark):
    rows = listing(spark, [("ical", "Jazz Night", 0, "Hall", None, None), ("dice_scrape", "Jazz Night", 30, "The Hall", None, None), ("ra_scrape", "Jazz Night", -31, "Hall", None, None), ("ical", "Jazz Night", 5, "Hall", None, None), ("dice_scrape", "Jazz Night", 0, None, 40.7, None)])
    got = {(r.a, r.b) for r in match.cross_platform_pairs(rows).collect()}
    assert got == {(1, 2), (2, 1), (2, 4), (4, 2)}


def test_places_match_without_names(spark):
    rows = listing(spark, [("ical", "Jazz Night", 0, "One", 40.7, None), ("dice_scrape", "Jazz Night", 0, "Two", 40.7014, None), ("ra_scrape", "Jazz Night", 0, "Three", 40.71, None)])
    assert {(r.a, r.b) for r in match.cross_platform_pairs(rows).collect()} == {(1, 2), (2, 1)}


def test_short_names_are_contained_too(spark):
    v = spark.createDataFrame([(1, "A1", None, None), (2, "The A1 Club", None, None), (3, "Other", None, None), (4, None, None, None)], "place long, venue_name string, lat double, lng double")
    assert {(r.place_a, r.place_b) for r in match.venue_pairs(v).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_best_match_order(spark):
    rows = listing(spark, [("ical", "Jazz Night", 0, "Hall", None, None), ("dice_scrape", "Jazz Night", 10, "Hall", None, None), ("ticketmaster_api", "Jazz Night", 20, "Hall", None, None), ("rss", "Jazz Night", 0, "Hall", None, None)])
    best = {r.a: r.b for r in match.best_match(match.cross_platform_pairs(rows), rows).collect()}
    assert best == {1: 3, 2: 3, 3: 2, 4: 3}


def greedy(rows):
    return {r.id for r in grouped(rows)}


def grouped(rows):
    """The query-time merge as a plain loop over rows in (start, id) order: the shown rows in order of groups."""
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    groups = []
    for r in sorted(rows, key=lambda r: (r.start_at, r.id)):
        def same(g):
            s = g[0]
            a, b, x, y = key(s.title), key(r.title), key(s.venue_name), key(r.venue_name)
            near = s.lat is not None and r.lat is not None and abs(s.lat - r.lat) < 0.0014
            return abs((s.start_at - r.start_at).total_seconds()) <= 7200 and (a in b or b in a) and ((x and y and (x in y or y in x)) or near)

        home = next((g for g in groups if same(g)), None)
        if home is None:
            groups.append([r])
        else:
            score = lambda z: 1.0 if z.confidence_score is None else z.confidence_score
            if score(r) > score(home[0]):
                home[0] = r
    return [g[0] for g in groups]


def test_query_time_dedup_is_the_greedy_loop(spark):
    rng = random.Random(8)
    rows = listing(spark, [(rng.choice(["ical", "rss"]), rng.choice(["Jazz", "Jazz Night", "Poetry", "!!"]), rng.randrange(0, 900, 15), rng.choice(["Hall", "The Hall", "Bar", None]), rng.choice([None, 40.7, 40.7005]), rng.choice([None, 0.5, 0.9, 0.95])) for _ in range(120)])
    got = {r.id for r in merge.deduplicate(rows).collect()}
    assert got == greedy(rows.collect())


def test_same_day_comparison_is_a_loop_over_days(spark):
    rng = random.Random(4)
    rows = listing(spark, [(rng.choice(["ical", "rss"]), rng.choice(["Jazz", "jazz", "Jazz Night", "Poetry"]), rng.randrange(0, 4 * 1440, 40), rng.choice(["Hall", "The Hall", "Bar", None]), rng.choice([None, 40.7, 40.7005]), rng.choice([None, 0.5, 0.9])) for _ in range(150)])
    rows = rows.withColumn("status", F.lit("active"))
    day, key = lambda r: r.start_at.date(), lambda r: (r.title.lower(), (r.venue_name or "").lower())
    data, want = rows.collect(), {}
    for d in {day(r) for r in data}:
        today = [r for r in data if day(r) == d]
        shown = grouped(today)
        for r in today:
            want[r.id] = next((g.id for g in shown if g.id == r.id or key(g) == key(r)), r.id)
    got = {r.id: r.shown for r in merge.same_day_comparison(rows).collect()}
    assert got == want and any(i != s for i, s in got.items())


def test_page_state_walk(spark):
    """Depth, shape and bad JSON; keys of a cached object that another kind holds in another form."""
    import json

    from marquee.sources import payloads as p

    event = {"id": "1", "name": "x", "start_date": "2024-01-01", "start_time": "20:00", "url": "u"}
    at = lambda d: json.dumps(eval("[" * d + "o" + "]" * d, {"o": {"results": [event]}}))
    nameless = json.dumps({"events": [event | {"name": 5}, {k: v for k, v in event.items() if k != "id"}, None, [], event | {"eid": "2", "id": 3}]})
    states = [(0, at(12)), (1, at(13)), (2, nameless), (3, "{bad"), (4, None), (5, json.dumps({"events": {"events": [event]}, "results": "no"}))]
    got = {r.i: r.n for r in spark.createDataFrame(states, "i int, s string").select("i", F.size(p.state_events(F.col("s"))).alias("n")).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    cache = {"Event:1": {"__typename": "Event", "id": "1", "title": "t", "dateTime": "2024-02-01T20:00:00Z", "eventType": "PHYSICAL", "featuredEventPhoto": {"__ref": "P:1"}}, "P:1": {"__typename": "PhotoInfo", "highResUrl": "h"}, "Event:2": {"__typename": "Event", "title": {"a": 1}, "dateTime": "d", "eventType": "PHYSICAL"}, "Event:3": {"__typename": "Event", "title": "gone", "dateTime": "d", "eventType": "PHYSICAL", "displayPhoto": {"__ref": "P:9"}}}
    html = lambda c: '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": c}}}) + "</script>"
    pages = spark.createDataFrame([(html(cache),), ("<html>",), (None,), (html({}),)], "h string")
    got = [[(e.title, e.photo_url) for e in r.e] for r in pages.select(p.cached_meetups(F.col("h")).alias("e")).collect()]
    assert got == [[("t", "h"), ('{"a":1}', None), ("gone", None)], [], [], []]


def test_batch_merge_folds_once(spark):
    rows = listing(spark, [("ticketmaster_api", "Jazz Night", 0, "Hall", None, 0.9), ("ical", "Jazz Night", 10, "Hall", None, 0.5), ("dice_scrape", "Jazz Night", 20, "Hall", None, 0.5), ("rss", "Other Thing", 0, "Hall", None, 0.5)])
    out = {r.id: r for r in merge.batch_merge(rows, ["title", "start_at"]).collect()}
    assert set(out) == {1, 4} and {t.platform for t in out[1].ticket_urls} == {"ticketmaster_api", "ical", "dice_scrape"} and len(out[1].merged_source_ids) == 2 and not out[1].promoted


def test_higher_trust_is_promoted(spark):
    rows = listing(spark, [("rss", "Old", 0, "Hall", None, 0.5), ("ticketmaster_api", "New", 0, "Hall", None, 0.9), ("ical", "Newer", 0, "Hall", None, 0.9)])
    out = merge.merged(rows.where("id = 1"), rows.where("id > 1").withColumn("canonical_id", F.lit(1).cast("long")), ["title", "source_type"]).first()
    assert out.promoted and out.title == "New" and out.source_type == "ticketmaster_api" and len(out.ticket_urls) == 3


def test_duplicate_candidates_are_exact(spark):
    from marquee.functions.text import similarity, trigrams

    rows = view(spark, SMALL, "listings_v")
    got = {(r.id, r.candidate) for r in match.duplicate_candidates(rows, most=10**6).collect()}
    a = rows.where("status = 'active'").select("id", "title", "start_at").limit(250)
    pairs = a.toDF("i", "t", "s").join(a.toDF("j", "u", "v"), F.expr("i <> j and abs(unix_micros(cast(s as timestamp)) - unix_micros(cast(v as timestamp))) <= 4 * 3600000000L"))
    want = {(r.i, r.j) for r in pairs.where(similarity(trigrams(F.col("t")), trigrams(F.col("u"))) > 0.3).collect()}
    ids = {r.id for r in a.collect()}
    assert want and {p for p in got if p[0] in ids and p[1] in ids} == want


def brute_titles(t, u, least):
    grams = lambda x: {p[i : i + 3] for w in re.findall(r"[a-z0-9]+", x.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}
    a, b = grams(t), grams(u)
    return bool(a | b) and len(a & b) / len(a | b) > least


@pytest.mark.parametrize("most", [4, 2_000])
def test_similar_titles_within_buckets(spark, most):
    """Titles of all lengths, repeats and bare signs; with small squares, too."""
    rng = random.Random(5)
    words = ["jazz", "night", "live", "the", "tour", "of", "moon", "x"]
    cells = [(rng.randrange(6), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(150)] + [(2, "!!"), (3, "!!"), (2, "jazz night"), (2, "jazz night")]
    table = spark.createDataFrame(cells, "bucket long, title string").distinct()
    grams = match.grams_by_rarity(table)
    got = [(r.bucket, r.title_a, r.title_b) for r in match.similar_titles(table, grams, 0.3, most).collect()]
    assert match.gram_matches(table, grams, 0.3) >= len(got)
    size = lambda t: len({p[i : i + 3] for w in t.split() for p in [f"  {w} "] for i in range(len(p) - 2)})
    want = {(k, t, u) for k, t in cells for m, u in cells if abs(k - m) <= 1 and (size(t), t) <= (size(u), u) and brute_titles(t, u, 0.3)}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_of_shows_that_recur_and_of_others(spark):
    """The same rows whether titles are compared within time or once: few titles at many times, many titles at few times."""
    for titles, days in ((4, 12), (40, 1)):
        rng = random.Random(titles)
        rows = [("ical", f"jazz night {rng.randrange(titles):02d} live", 1440 * rng.randrange(days) + rng.randrange(600), "Hall", None, None) for _ in range(60)]
        got = {(r.id, r.candidate) for r in match.duplicate_candidates(listing(spark, rows), most=10**6).collect()}
        want = {(i, j) for i, a in enumerate(rows, 1) for j, b in enumerate(rows, 1) if i != j and abs(a[2] - b[2]) <= 240 and brute_titles(a[1], b[1], 0.3)}
        assert want and got == want


@pytest.mark.parametrize("order", ["forwards", "backwards", "mixed"])
@pytest.mark.parametrize("most", [1, 3, 20])
def test_best_candidates_are_the_first_of_all(spark, most, order):
    """Ties by id, times at the limit and buckets beside, with ids along the times, against them and at random."""
    rng = random.Random(most)
    titles = ["jazz night", "jazz night live", "jazz nights", "moon", "!!"]
    rows = sorted((30 * rng.randrange(-40, 60), rng.choice(titles)) for _ in range(220))
    rows = {"forwards": rows, "backwards": rows[::-1], "mixed": rng.sample(rows, len(rows))}[order]
    got = [(r.id, r.candidate) for r in match.duplicate_candidates(listing(spark, [("ical", t, m, "Hall", None, None) for m, t in rows]), most=most).orderBy("id", F.desc("similarity"), "candidate").collect()]
    grams = lambda x: {p[i : i + 3] for w in re.findall(r"[a-z0-9]+", x) for p in [f"  {w} "] for i in range(len(p) - 2)}
    alike = {(t, u): len(grams(t) & grams(u)) / max(len(grams(t) | grams(u)), 1) for t in titles for u in titles}
    want = []
    for i, (m, t) in enumerate(rows, 1):
        near = sorted((-alike[t, u], j) for j, (n, u) in enumerate(rows, 1) if i != j and abs(m - n) <= 240 and alike[t, u] > 0.3)
        want += [(i, j) for _, j in near[:most]]
    assert want and got == want


def test_candidates_of_one_title_do_not_all_meet(spark):
    """40,000 listings of one title and evening have 1.6 billion pairs."""
    ids = spark.range(1, 40_001)
    at = F.timestamp_micros(F.lit(1_706_817_600_000_000) + F.pmod(F.col("id") * 7919, F.lit(14_400)) * 1_000_000)
    rows = ids.select("id", F.lit("jazz night").alias("title"), at.cast("timestamp_ntz").alias("start_at"), F.lit("active").alias("status"))
    began = time.monotonic()
    got = match.duplicate_candidates(rows, most=2).groupBy("candidate").count().collect()
    assert {r.candidate: r["count"] for r in got} == {1: 39_999, 2: 39_999, 3: 2} and time.monotonic() - began < 100


def test_many_venues_of_one_place_have_few_links(spark):
    """1,500 names at one place and 1,500 places of one name are 4.5 million pairs of venues, but few links."""
    one = spark.range(1500).select(F.concat(F.lit("Room "), F.col("id") + 100_000).alias("venue_name"), F.lit(40.7).alias("lat"), F.lit(-73.9).alias("lng"))
    other = spark.range(1500).select(F.lit("Park"), F.lit(40.5) + F.col("id") / 100, F.lit(-73.5))
    v = match.placed(one.unionAll(other))
    links = match.venue_links(v)
    assert links.count() == links.distinct().count() == 1502
    last = links.join(v.where("venue_name = 'Park'").select(F.inline("spots")).where("named").distinct().toDF("spot_a", "named"), "spot_a").select("spot_a", "spot_b").collect()
    assert len(last) == 1 and last[0].spot_a == last[0].spot_b


def test_names_and_places_give_each_pair_once(spark):
    """Listings of one name near and far, without a place, and of other names, against all pairs."""
    from marquee.functions.geo import haversine

    rng = random.Random(3)
    rows = [(rng.choice(["ical", "rss", "dice_scrape"]), "Jazz Night", rng.randrange(60), rng.choice(["Hall", "The Hall", "Long Hall 100", "Hall 1", "!", "", None, "B"]), rng.choice([None, 40.7, 40.7007, 40.7018, 40.71]), None) for _ in range(120)]
    rows = listing(spark, rows)
    key = F.regexp_replace(F.lower(F.coalesce("venue_name", F.lit(""))), "[^a-z0-9]", "")
    v = rows.select("id", "source_type", "start_at", key.alias("k"), "lat", "lng")
    both = v.toDF(*(f"{c}_a" for c in v.columns)).crossJoin(v.toDF(*(f"{c}_b" for c in v.columns)))
    named = F.expr("k_a <> '' and k_b <> '' and (contains(k_a, k_b) or contains(k_b, k_a))")
    near = F.coalesce(haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"), 3958.8) <= 0.1, F.lit(False))
    close = F.expr("abs(unix_micros(cast(start_at_a as timestamp)) - unix_micros(cast(start_at_b as timestamp))) <= 1800000000 and id_a <> id_b")
    venue = both.where(close & (named | near))
    want = sorted((r.id_a, r.id_b) for r in venue.where("source_type_a <> source_type_b").collect())
    assert want and sorted((r.a, r.b) for r in match.cross_platform_pairs(rows).collect()) == want
    want = sorted((r.id_a, r.id_b) for r in both.where(F.expr("(start_at_a, id_a) < (start_at_b, id_b)") & (named | near)).collect())
    assert sorted((r.a, r.b) for r in merge.same_show_pairs(rows).collect()) == want


def test_large_tables_are_not_broadcast(spark):
    """A table of few values is small in files, whatever its rows take in memory."""
    big = graph.checkpointed(spark.range(graph.SMALL + 1).select((F.col("id") % 10).alias("k"), F.lit(1).alias("x")))
    few = graph.checkpointed(spark.range(10).select(F.col("id").alias("k")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(few.join(big, "k")) and "BroadcastExchange" in plan(few.join(few.withColumn("y", F.lit(1)), "k"))


@pytest.mark.parametrize("most", [1, 40])
def test_heavy_venue_hours_give_the_same_pairs(spark, most):
    """A busy venue and hour, by id and by name, met through titles' rarest tokens and in squares."""
    rng = random.Random(6)
    words = ["jazz", "night", "live", "tour", "moon", "late", "show", "festival"]
    sources = ["ical", "dice_scrape", "ticketmaster_api"]
    rows = listing(spark, [(rng.choice(sources), " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.randrange(50), rng.choice(["Hall", "The Hall", "Barn"]), None, None) for _ in range(160)])
    rows = rows.withColumn("venue_id", F.when(F.col("id") % 3 != 0, F.col("id") % 2))
    plain = match.cross_platform_pairs(rows, most=10**6).collect()
    got = match.cross_platform_pairs(rows, most=most).collect()
    assert len(got) == len(set(got)) and set(got) == set(plain) and len(plain) > 500


def test_squares_are_bounded_and_whole(spark):
    """A planted cell of 100,000 rows: every task holds a bounded part of it, and each pair comes once."""
    left = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    met = match.in_squares(left, right, ["k"], "a", "b", 2_000)
    count, pairs = met.agg(F.count("*"), F.approx_count_distinct(F.struct("a", "b"))).first()
    assert count == 300 * 100_000 and pairs > 0.9 * count


def test_a_planted_venue_hour_of_many_listings(spark):
    """100,000 listings of one venue and one hour, each title twice: pairs come from titles, not from all of the cell."""
    rows = spark.range(100_000).select(
        "id", F.concat(F.lit("Live Night "), F.sha1((F.col("id") / 2).cast("long").cast("string"))).alias("title"), F.when(F.col("id") % 2 == 0, "ical").otherwise("rss").alias("source_type"),
        F.lit(T0).cast("timestamp_ntz").alias("start_at"), F.lit(7).cast("long").alias("venue_id"), F.lit("Hall").alias("venue_name"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit("active").alias("status"),
    )
    got = match.cross_platform_pairs(rows).agg(F.count("*").alias("n"), F.sum((F.floor(F.col("a") / 2) != F.floor(F.col("b") / 2)).cast("int")).alias("wrong")).first()
    # "Live", "Night" and a hash of its own: two of three tokens are 0.5 of four, not enough.
    assert (got.n, got.wrong) == (100_000, 0)


def test_collapsed_shows_keep_a_few_dates(spark):
    """Shows with many dates, repeated times, past ones only, and none: next row, count and the next three distinct dates."""
    rng = random.Random(4)
    rows = [("ical", t, 60 * rng.randrange(-40, n), "Hall", None, None) for t, n in (("One", 400), ("Two", 3), ("Three", -30)) for _ in range(120)]
    table = listing(spark, rows).withColumn("start_at", F.when(F.col("id") % 50 != 0, F.col("start_at")))
    got = {r.title: r for r in feed.collapse(table, str(T0)).collect()}
    for title in ("One", "Two", "Three"):
        mine = [(T0 + timedelta(minutes=m), i) for i, (_, t, m, *_) in enumerate(rows, 1) if t == title and i % 50]
        missing = sum(t == title and i % 50 == 0 for i, (_, t, *_) in enumerate(rows, 1))
        ahead = sorted(x for x in mine if x[0] >= T0)
        assert got[title].id == (ahead[0] if ahead else max(mine))[1]
        assert got[title].occurrences == (len(ahead) or len(mine) + missing)
        assert got[title].next_dates == sorted({x[0] for x in ahead})[1:4]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {i: root(i) for i in {n for a, b in pairs if a != b for n in (a, b)}}


VARIANTS = [("Zone One Hall", 40.70, -73.95), ("The Zone One Hall", 40.7003, -73.95), ("Zone One Hall - Main Room", 40.7006, -73.95), ("ZONE ONE HALL", None, None), ("Elsewhere", 40.70, -73.95), ("Unknown Venue", 40.70, -73.95), ("", None, None)]


def test_resolve(spark):
    names = spark.createDataFrame(VARIANTS + [("New Place", 40.60, -73.95), ("Known As", None, None)], "name string, lat double, lng double")
    known = spark.createDataFrame([(1, "Zone One Hall", 40.70, -73.95), (2, "Zone One", 40.7001, -73.95)], "venue_id long, name string, lat double, lng double")
    aliases = spark.createDataFrame([("known as", 2)], "normalized_alias string, venue_id long")
    got = {r.name: (r.venue_id, r.matched_by) for r in venues.resolve(names, known, aliases).collect()}
    assert got["The Zone One Hall"] == got["ZONE ONE HALL"] == (1, "exact_name")
    assert got["Zone One Hall - Main Room"] == (2, "proximity") and got["Known As"] == (2, "alias")
    assert got["Elsewhere"] == got["New Place"] == (None, "created") and got["Unknown Venue"] == got[""] == (None, None)


def test_venue_dedupe(spark):
    rows = [(1, "Hall", 40.70, -73.95), (2, "The Hall", 40.90, -73.95), (3, "Hall Annex", 40.7005, -73.95), (4, "Hall Annex Bar", 40.80, -73.95), (5, "Grand Old Town Hall", 40.70, -73.90), (6, "Grand Old Town Hall Garden", 40.704, -73.90)]
    v = spark.createDataFrame(rows, "venue_id long, name string, lat double, lng double")
    assert {(r.duplicate, r.canonical) for r in venues.dedupe_by_tokens(v).collect()} == {(2, 1), (3, 1)}
    assert {(r.duplicate, r.canonical) for r in venues.dedupe_by_name(v).collect()} == {(6, 5)}


def test_merge_into(spark):
    v = spark.createDataFrame([(1, "Hall", None, None), (2, "Hall Annex", None, None)], "venue_id long, name string, lat double, lng double")
    rows = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, venue_id long")
    aliases = spark.createDataFrame([("Annexe", "annexe", 2, "ical")], "alias string, normalized_alias string, venue_id long, source_type string")
    l2, v2, a2 = venues.merge_into(rows, v, aliases, spark.createDataFrame([(2, 1)], "duplicate long, canonical long"))
    assert {(r.id, r.venue_id) for r in l2.collect()} == {(10, 1), (11, 1), (12, None)} and [r.venue_id for r in v2.collect()] == [1]
    assert {(r.normalized_alias, r.venue_id) for r in a2.collect()} == {("annexe", 1), ("hall annex", 1)}


@pytest.mark.parametrize("parts", [1, 7])
def test_upsert(spark, parts):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k long, x string, y int").repartition(parts)
    new = spark.createDataFrame([(2, "B", None), (3, "C", 9), (None, "N", 4)], "k long, x string, y int").repartition(parts)
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a", 1), (2, "B", None), (3, "C", 9), (None, "N", 4)}
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], ["x"]).collect()} == {(1, "a", 1), (2, "B", 2), (3, "C", 9), (None, "N", 3)}


def test_match_does_not_depend_on_partitions(spark):
    rows = view(spark, SMALL, "listings_v")
    a, b = ({(r.a, r.b) for r in match.cross_platform_pairs(rows.repartition(n)).collect()} for n in (1, 9))
    assert a == b


def test_city_values():
    assert NYC.min_lat < NYC.center[0] < NYC.max_lat and len(NYC.centroids) == 7
