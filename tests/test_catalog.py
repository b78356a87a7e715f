"""Every catalogued query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import math
from datetime import datetime

import duckdb
import pytest

from marquee.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat() if isinstance(v, datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name in catalog.oracle_sql():
        got = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert ordered(rows) == ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title", "venue_name", "start_at", "occurrences", "n_next"]
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())
