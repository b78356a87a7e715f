"""Greedy passes as rounds and walks against the loops that they stand for."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import graph, merge, venues


def loop(nodes, edges):
    """nodes: (id, place, group) ; edges: (u, v), u before v."""
    head, heads, led = {}, [], {}
    before = {}
    for u, v in edges:
        before.setdefault(v, set()).add(u)
    for i, _, g in sorted(nodes, key=lambda n: (n[1], n[0])):
        found = [h for h in heads if h in before.get(i, ()) or (g is not None and led.get(g) == h)]
        head[i] = found[0] if found else i
        if not found:
            heads.append(i)
            led[g] = i
    return head


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_heads_are_the_loops(spark, rounds):
    rng = random.Random(rounds)
    nodes = [(i, (rng.randrange(6), i), rng.choice([None, None, "g1", "g2", "g3"])) for i in range(120)]
    place = {i: p for i, p, _ in nodes}
    edges = [(a, b) for a, b in (sorted(rng.sample(range(120), 2), key=place.get) for _ in range(200))]
    edges += list(zip(*[sorted(range(40), key=place.get)[k:] for k in (0, 1)], strict=False))  # a long chain
    df = spark.createDataFrame([(i, *p, g) for i, p, g in nodes], "id long, a int, b int, group string").select("id", F.struct("a", "b").alias("place"), "group")
    got = graph.greedy_heads(df, spark.createDataFrame(edges + edges[:5], "u long, v long"), rounds)
    assert {r.id: r["head"] for r in got.collect()} == loop(nodes, edges)


def test_no_nodes_and_no_edges(spark):
    nodes = spark.createDataFrame([], "id long, place struct<a:int>, group string")
    edges = spark.createDataFrame([], "u long, v long")
    assert graph.greedy_heads(nodes, edges).collect() == []
    one = spark.createDataFrame([(1, (2,), None)], nodes.schema)
    assert [tuple(r) for r in graph.greedy_heads(one, edges).collect()] == [(1, 1)]


def test_walk_streams_keys_in_order(spark):
    class Sums:
        def __init__(self):
            self.t = 0

        def row(self, i, x):
            self.t += x
            return [(i, self.t)]

        def end(self):
            return [(-1, self.t)]

    rows = spark.createDataFrame([(k, i, 1) for k in range(50) for i in range(k)], "k long, i long, x long").repartition(7)
    got = sorted(tuple(r) for r in graph.sorted_walk(rows, "k", ["i", "x"], ["i"], Sums, "i long, t long").collect())
    assert got == sorted([(i, i + 1) for k in range(50) for i in range(k)] + [(-1, k) for k in range(1, 50)])


def pairs_loop(rows, inside, barred=()):
    """The scripts' loop: rows (id, tokens) in order of size, then id."""
    into, order = {}, sorted(rows, key=lambda r: (len(r[1]), r[0]))
    for i, t in order:
        if i in into or i in barred:
            continue
        for j, u in order:
            if j != i and j not in into and inside(i, t, j, u):
                into[j] = i
    return into


def test_venue_passes_are_the_loops(spark):
    rng = random.Random(5)
    words = ["hall", "park", "green", "stage", "north", "block", "party"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 6))), 40.7 + rng.randrange(4) * 0.0012, -73.95) for i in range(90)]
    v = spark.createDataFrame(rows, "venue_id long, name string, lat double, lng double").repartition(3)
    tokens, lat = [(i, frozenset(n.split())) for i, n, _, _ in rows], {r[0]: r[2] for r in rows}
    metres = lambda i, j: abs(lat[i] - lat[j]) * 111_195
    by_name = pairs_loop(tokens, lambda i, t, j, u: len(t) >= 3 and t < u and metres(i, j) <= 500, {i for i, n, _, _ in rows if "block party" in n})
    assert {r.duplicate: r.canonical for r in venues.dedupe_by_name(v).collect()} == by_name and by_name
    by_tokens = pairs_loop(tokens, lambda i, t, j, u: t == u or (t <= u and metres(i, j) <= 150))
    assert {r.duplicate: r.canonical for r in venues.dedupe_by_tokens(v).collect()} == by_tokens


def test_permit_titles_take_no_venue(spark):
    rows = [(1, "Green Park Block Party", 40.7, -73.9), (2, "Green Park Block Party Hall Annex", 40.7, -73.9), (3, "Old Green Park", 40.7, -73.9), (4, "Old Green Park Farmers Market", 40.7, -73.9)]
    v = spark.createDataFrame(rows, "venue_id long, name string, lat double, lng double")
    assert [tuple(r) for r in venues.dedupe_by_name(v).collect()] == [(4, 3)]


def test_united_tickets_and_a_null_place(spark):
    at = lambda m: F.lit("2024-01-15 20:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m, F.lit(0).cast("decimal(18,6)"))
    data = [(1, "Jazz", 0, "Hall", 0.5, "Dice", "a"), (2, "Jazz", 10, "Hall", 0.9, "dice", "b"), (3, "Jazz", 20, "Hall", 0.7, None, "c"), (4, "Jazz", 30, "Hall", 0.7, "RA", None), (5, "Poetry", 0, "Hall", None, "", "e")]
    rows = spark.createDataFrame(data, "id long, title string, m int, venue_name string, confidence_score double, platform string, ticket_url string")
    rows = rows.select("id", "title", at(F.col("m")).alias("start_at"), "venue_name", *(F.lit(None).cast("double").alias(c) for c in ("lat", "lng", "price_min", "price_max")), F.lit(False).alias("is_free"), "confidence_score", "platform", "ticket_url")
    got = {r.id: [(t.platform, t.url) for t in r.ticket_sources] for r in merge.deduplicate(rows).collect()}
    assert got == {2: [("Dice", "a"), ("Unknown", "c"), ("RA", None)], 5: [("Unknown", "e")]}
    known = spark.createDataFrame([(1, "Foo Hall", 40.7305, -73.99)], "venue_id long, name string, lat double, lng double")
    names = spark.createDataFrame([("Foo Hall Upstairs", 40.7306, -73.99), ("Foo Hall Upstairs", None, None), ("Foo Hall Upstairs", 0.0, 0.0)], "name string, lat double, lng double")
    none = spark.createDataFrame([], "normalized_alias string, venue_id long")
    assert [(r.venue_id, r.matched_by) for r in venues.resolve(names, known, none).collect()] == [(1, "proximity")]


def test_new_venues_take_later_names_and_addresses_out_of_the_city(spark):
    none = spark.createDataFrame([], "normalized_alias string, venue_id long")
    known = spark.createDataFrame([(9, "Far Away", 40.80, -73.95)], "venue_id long, name string, lat double, lng double")
    rows = [("Elsewhere", 40.7305, -73.99), ("Elsewhere Zone One", 40.7306, -73.99), ("Rooftop Elsewhere", 40.7305, -73.9901), ("Elsewhere, Far", 40.75, -73.97), ("ELSEWHERE", None, None), ("Zzz", None, None)]
    names = spark.createDataFrame(rows, "name string, lat double, lng double")
    got = {r.name: (r.matched_by, r.new_key) for r in venues.resolve(names, known, none).collect()}
    assert got == {"Elsewhere": ("created", "elsewhere"), "ELSEWHERE": ("created", "elsewhere"), "Elsewhere Zone One": ("proximity", "elsewhere"), "Rooftop Elsewhere": ("proximity", "elsewhere"), "Elsewhere, Far": ("created", "elsewhere far"), "Zzz": ("created", "zzz")}
    asked = spark.createDataFrame([("Far Away Annex", None, None, "1 Main St, Hoboken, NJ"), ("Far Away Too", None, None, "1 Main St, New York")], "name string, lat double, lng double, address string")
    geo = spark.createDataFrame([("Far Away Annex", 40.80, -73.95), ("Far Away Too", 40.80, -73.95)], "name string, lat double, lng double")
    assert {r.name: r.matched_by for r in venues.resolve(asked, known, none, geo).collect()} == {"Far Away Annex": "created", "Far Away Too": "proximity"}


@pytest.mark.parametrize("most", [3, 40, 2000])
def test_busy_cells_give_the_same_pairs(spark, most):
    """One venue, and venues like it, full within two hours: met in squares or whole, the pairs are those of all against all."""
    rng = random.Random(7)
    titles = ["Jazz Night", "Jazz Night Late", "Open Mic", "Mic", "!!!", "Trio"]
    at = datetime(2024, 2, 1, 20)
    rows = [(i, at + timedelta(minutes=rng.randrange(400)), rng.choice(["Hall", "Hall", "The Hall", "Hallway Bar", "Attic"]), rng.choice(titles)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, start_at timestamp_ntz, venue_name string, title string").selectExpr("*", "cast(null as double) lat", "cast(null as double) lng")
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    alike = lambda x, y: key(x) in key(y) or key(y) in key(x)
    want = {(a[0], b[0]) for a in rows for b in rows if (a[1], a[0]) < (b[1], b[0]) and b[1] - a[1] <= timedelta(hours=2) and alike(a[2], b[2]) and alike(a[3], b[3])}
    got = [tuple(r) for r in merge.same_show_pairs(df, most=most).collect()]
    assert len(got) == len(want) and set(got) == want
