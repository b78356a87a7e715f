"""Search through the index gives the scan's rows, and reads a share of the postings."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import feed
from marquee.operators.search import SearchIndex
from marquee.plans.testviews import AS_OF, view
from marquee.schemas import FeedQuery

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "Lace & Green", "The Hall"), (2, None, "Green Lace Bar"), (3, "Necklace", None), (4, None, None), (5, "", ""),
    (6, "A-B C", "x"), (7, "a b", "A-b"), (8, "Ünder ÇA", "ünder"), (9, "ΑΣ ΣΑΣ", "İstanbul"), (10, "Same", "Same"), (10, "Same", "Other"),
    (11, "!!! 100% ???", "100%"), (12, "日本語の夜", "夜"), (13, "green " * 200, "lace"),
]
SEARCHES = ["green lace", "lace", "e & g", "LACE", "b c", "ab", "", "100%", "!!!", "ünder", "ΣΑΣ", "istanbul", "日本語", "same other"]


def scanned(rows, search):
    return {(r.id, round(r.best, 9)) for r in rows.where(feed.search_matches(search)).groupBy("id").agg(F.max(feed.relevance(search)).alias("best")).collect()}


def test_index_equals_the_scan_on_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame(ODD, "id int, title string, venue_name string")
    index = SearchIndex.build(rows, str(tmp_path / "odd"), 4)
    for search in SEARCHES:
        got = [(r.id, round(r.relevance, 9)) for r in index.search(search).collect()]
        assert len(got) == len(set(got)) and set(got) == scanned(rows, search), search


def test_index_equals_the_scan_and_prunes(spark, tmp_path):
    rows = view(spark, SMALL, "listings_v")
    index = SearchIndex.build(rows, str(tmp_path / "index"))
    for search in ("green lace", "hall 103", "zone", "qqq"):
        assert {(r.id, round(r.relevance, 9)) for r in index.search(search).collect()} == scanned(rows, search), search
    part = index.postings(["zon", "one"])
    assert 0 < part.count() < index.postings().count() / 4
    files = lambda df: len(set(df.inputFiles()))
    assert files(part) <= files(index.postings()) and "PartitionFilters: [" in part._jdf.queryExecution().toString()
    q = FeedQuery(as_of=AS_OF, search="zone")
    assert {r.id for r in feed.matching(rows, q, index.search(q.search)).collect()} == {r.id for r in feed.matching(rows, q).collect()}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        SearchIndex.build(rows, str(tmp_path / "index"))


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, title string, venue_name string")
    index = SearchIndex.build(rows, str(tmp_path / "none"))
    assert index.search("green lace").count() == 0 and index.search("a").count() == 0 and index.search("").count() == 0
