"""The conversation trie against a plain one, its search and batches, and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import prefix_trie, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, n long, s int, e string, edge string, key string"


def plain(rows, shared=True):
    """Rows of the trie of (conv_id, turn, role, text), node by node."""
    turns = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        turns[c].append((r or "", x or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        here = (len(members) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += here
            leaves[p[:d]] += p not in kids
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "e", "x", "k") for r in rows], SCHEMA).repartition(3)


def test_query_is_the_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_trie(spark, SMALL)) == plain(rows)


def test_awkward_conversations(spark):
    rows = [
        (0, 0, "user", "hello  there\n you"), (0, 1, None, None), (0, 2, "user", ""), (1, None, "user", "first"), (1, 0, "user", "then"), (2, 0, "user", "only"), (2, 0, "user", "only"),
        (None, 0, "user", "nobody"), (21, 5, "a", "long " * 5000), (22, 5, "a", "long " * 5000), (23, 1, "b", "z"), (45, 1, "x", "no family"), (7, 3, "user", "hello  there\n you"),
    ]
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == plain(rows)
    assert got(prefix_trie.conversation_trie(frame(spark, rows), shared=False)) == plain(rows, False)
    assert prefix_trie.conversation_trie(frame(spark, rows[:0])).collect() == []
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    turnless = [c for c in range(20, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, t, "user", f"{c} {t}") for c in turnless for t in range(2)]
    want = plain(rows)
    assert want[0][4] == 0 and len(want) == 1
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == want


def test_deep_branching_and_copies(spark):
    """Nested prefixes, caterpillars and copies: few rounds although the trie is deep."""
    rng = random.Random(3)
    rows, c = [], 0
    for depth in range(1, 40):
        for tail in ("", "x", "y"):
            rows += [(c, i, "u", f"t{i}") for i in range(depth)] + ([(c, depth, "u", tail)] if tail else [])
            c += 1
    for _ in range(40):
        rows += [(c, i, "u", x) for i, x in enumerate("same words here".split())]
        c += 1
    for _ in range(30):
        rows += [(c, i, rng.choice("ab"), rng.choice("pq")) for i in range(rng.randrange(1, 9))]
        c += 1
    assert got(prefix_trie.conversation_trie(frame(spark, rows), shared=False)) == plain(rows, False)


def test_two_fattest():
    for b in range(1, 70):
        for a in range(b):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_batches_one_after_another_make_the_same_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns = prefix_trie.turn_rows(frame(spark, rows))
    seqs = prefix_trie.sequences(turns.where("i = 1").select("conv_id"), prefix_trie.share_first_turns(turns)).dropDuplicates(prefix_trie.KEY).cache()
    nodes = None
    for k in range(3):
        nodes, _ = prefix_trie.insert(seqs.where(F.col("conv_id") % 3 == k), nodes)
    whole, _ = prefix_trie.insert(seqs)
    assert sorted(map(tuple, nodes.select("s", "e", "k1").collect())) == sorted(map(tuple, whole.select("s", "e", "k1").collect()))


def test_hash_of_ends_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 10)
    ids = list(range(3, 400, 3))
    seqs = spark.createDataFrame([(i, 1, 5, 6) for i in ids] + [(1, 2, 5, 6)], "conv_id long, e int, k1 long, k2 long").repartition(4)
    out = {r.e: r.ends_sha256 for r in prefix_trie.ends_hash(seqs).collect()}
    assert out == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"1").hexdigest()}
