"""Shared prefixes of conversations as a z-fast trie: fat binary search over handles, insertion in batches.

A conversation is a sequence of turns. Its prefixes have fingerprints of 128 bits (the exclusive or of its turns' hashes,
each taken with its place), so texts are read once and never gathered. The compacted trie is a table of nodes: an edge
from depth s to depth e with the prefixes' fingerprints along it, and a handle, the prefix whose length in (s, e] is
divisible by the greatest power of two. A sequence finds the node that it leaves the trie at by joins on handles, as many as
its length has bits. Rounds of batches insert all sequences: each round splits edges where sequences leave them, and at
each exit and next turn adds the sequence of least hash as a leaf; the others go on below it. A sequence's group is
expected to halve in a round, so rounds grow with the logarithm of the number of sequences, not with their depth. Sums over
subtrees are taken on the compacted nodes by jumps that double, and edges are expanded at last.

Rows with a null conv_id are left out; null roles and texts are empty; null turns come first. Rows of one conversation and
turn come by role, then by the texts' hashes; equal rows are turns of their own. An empty table gives an empty result.
A conversation's fingerprints (28 bytes a turn) are one row; only those, not its text, bound its length. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import on_workers
from .arrow import drop, shared_folder, written

KEY = ["e", "k1", "k2"]  # of a node, or of a sequence: its length and fingerprint
FAMILY, MOST_SHARED = 20, 3
ID_BLOCK = 1 << 16  # ids whose text is one row on the way to a node's hash


def _kept(df: DataFrame, *old: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, with its path; the tables that it came from are deleted."""
    path = shared_folder(df.sparkSession)
    out = written(df, path=path)
    for x in old:
        drop(df.sparkSession, x)
    return out, path


def n_words(text) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, i, a, b, words: the turns of each conversation, numbered from 1; a, b are hashes of role and text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), *(F.xxhash64(F.lit(x), role, text).alias(x) for x in "ab"), n_words(text).alias("words")).where("conv_id is not null")
    in_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    return rows.select("conv_id", F.row_number().over(in_turn).alias("i"), "a", "b", "words")


def share_first_turns(turns: DataFrame) -> DataFrame:
    """turn_rows' rows with each conversation c rebuilt: the first h turns of c - c % 20, then its own after its first h; h = crc32(c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    members = turns.where("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    heads = turns.where(F.col("i") <= MOST_SHARED).select(F.col("conv_id").alias("base"), "i", "a", "b", "words")
    own = turns.where(F.col("i") > h)
    return own.unionByName(members.where("h > 0").join(heads, "base").where("i <= h").select(own.columns))


def sequences(members: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, e, k1, k2, p for members(conv_id): p holds (d, h1, h2, w) for each prefix from the empty one on, w its words."""
    in_order = Window.partitionBy("conv_id").orderBy("i")
    placed = turns.withColumn("d", F.row_number().over(in_order))
    marks = (F.bit_xor(F.xxhash64(F.lit(x), "d", "a", "b")).over(in_order).alias(f"h{x}") for x in (1, 2))
    prefixes = placed.select("conv_id", "d", *marks, F.sum("words").over(in_order).alias("w"))
    start = members.select("conv_id", F.lit(0).alias("d"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("w"))
    p = prefixes.unionByName(start).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "h1", "h2", "w"))).alias("p"))
    last = F.element_at("p", -1)
    return p.select("conv_id", last["d"].alias("e"), last["h1"].alias("k1"), last["h2"].alias("k2"), "p")


def two_fattest(a, b):
    """The number in (a, b] that the greatest power of two divides; integers or columns."""
    if isinstance(a, int):
        return b & -(1 << ((a ^ b).bit_length() - 1))
    high = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(-F.call_function("shiftleft", F.lit(1), high))


def node_columns(df: DataFrame) -> DataFrame:
    """s, e, k1, k2 (node), p1, p2 (parent), f, f1, f2 (handle), c1, c2 (first turn), edge, for df(edge): (d, h1, h2, w) from depth s to e."""
    s, e = F.element_at("edge", 1)["d"], F.element_at("edge", -1)["d"]
    f = two_fattest(s, e)

    def at(d, *names):
        return [F.element_at("edge", d)[h].alias(n) for h, n in zip(("h1", "h2"), names, strict=True)]

    return df.select(s.alias("s"), e.alias("e"), *at(-1, "k1", "k2"), *at(1, "p1", "p2"), f.alias("f"), *at(f - s + 1, "f1", "f2"), *at(2, "c1", "c2"), "edge")


def _prefix(d, h):
    """Fingerprint h of a sequence's prefix of length d, null beyond its end."""
    return F.get(F.col("p"), d)[h]


def _along() -> F.Column:
    """Depth up to which a sequence keeps to the edge joined to it."""
    same = F.filter("edge", lambda x: (_prefix(x["d"], "h1") == x["h1"]) & (_prefix(x["d"], "h2") == x["h2"]))
    return F.col("s") + F.size(same) - 1


def locate(nodes: DataFrame, seqs: DataFrame, bits: int) -> DataFrame:
    """seqs(e, k1, k2, p, a) with m, the depth that they share with the trie, and exit(e, k1, k2), the node on whose edge
    they leave it: null if they leave or end at a node's own depth m. a: a depth at which their path has a node.

    bits: of the greatest length; so many joins on handles narrow (a, b], one more finds the child of the last node.
    """
    node = nodes.select("s", F.col("e").alias("ne"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "f", "f1", "f2", "c1", "c2", "edge")
    handles, children = node.drop("c1", "c2"), node.drop("f", "f1", "f2")
    now = seqs.withColumns({"b": F.col("e"), "m": F.lit(None).cast("int"), "exit": F.lit(None).cast("struct<e:int,k1:bigint,k2:bigint>")})
    found = F.struct(F.col("ne").alias("e"), F.col("n1").alias("k1"), F.col("n2").alias("k2"))
    hit, out = F.col("s").isNotNull(), ["e", "k1", "k2", "p", "a", "b", "m", "exit"]
    for _ in range(bits):
        open_ = F.col("m").isNull() & (F.col("a") < F.col("b"))
        q = F.when(open_, two_fattest(F.col("a"), F.col("b"))).otherwise(-1)  # closed ones match nothing and are spread by their keys
        asked = now.withColumn("q", q).withColumns({f"q{i}": F.when(F.col("q") < 0, F.col(f"k{i}")).otherwise(_prefix(F.col("q"), f"h{i}")) for i in (1, 2)})
        got = asked.join(handles, (asked["q"] == handles["f"]) & (asked["q1"] == handles["f1"]) & (asked["q2"] == handles["f2"]), "left")
        whole = hit & (_prefix(F.col("ne"), "h1") == F.col("n1")) & (_prefix(F.col("ne"), "h2") == F.col("n2"))
        whole = F.coalesce(whole, F.lit(False))
        now = got.select(
            "e", "k1", "k2", "p",
            F.when(whole, F.col("ne")).otherwise(F.col("a")).alias("a"),
            F.when((F.col("q") > 0) & ~hit, F.col("q") - 1).otherwise(F.col("b")).alias("b"),
            F.when(hit & ~whole, _along()).otherwise(F.col("m")).alias("m"),
            F.when(hit & ~whole, found).otherwise(F.col("exit")).alias("exit"),
        )
    open_ = F.col("m").isNull() & (F.col("a") < F.col("e"))
    asked = now.withColumn("q", F.when(open_, F.col("a")).otherwise(-1)).withColumns({f"q{i}": F.when(open_, _prefix(F.col("a") + 1, f"h{i}")).otherwise(F.col(f"k{i}")) for i in (1, 2)})
    got = asked.join(children, (asked["q"] == children["s"]) & (asked["q1"] == children["c1"]) & (asked["q2"] == children["c2"]), "left")
    m = F.when(hit, _along()).otherwise(F.coalesce("m", "a"))
    ended = got.select(*(c for c in out if c not in ("b", "m", "exit")), m.alias("m"), F.when(hit, found).otherwise(F.col("exit")).alias("exit"))
    return ended.withColumn("exit", F.when(F.col("m") < F.col("exit")["e"], F.col("exit")))


def _split(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """nodes with their edges cut at the depths where sequences leave them or end."""
    cuts = located.where("exit is not null").groupBy(*(F.col("exit")[c].alias(c) for c in KEY)).agg(F.sort_array(F.collect_set("m")).alias("cuts"))
    bounds = F.concat(F.array("s"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("e"))
    runs = nodes.join(cuts, KEY, "left").withColumn("bounds", bounds)
    pieces = F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda x, i: F.slice("edge", x - F.col("s") + 1, F.col("bounds")[i + 1] - x + 1))
    return runs.select(F.explode(pieces).alias("edge"))


def insert(seqs: DataFrame, nodes: DataFrame | None = None, rounds: int = 200) -> tuple[DataFrame, str]:
    """The trie's nodes (see node_columns) with all of seqs(e, k1, k2, p) in it, one row for each different sequence, as a table with its path.

    nodes: a trie that they are inserted into, as this gives it; else they make one. The root has no row.
    """
    deepest = seqs.agg(F.max("e")).first()[0] or 0
    bits, owned = deepest.bit_length(), []
    left = seqs.where("e > 0").select("e", "k1", "k2", "p", F.lit(0).alias("a"))
    for _ in range(rounds):
        if nodes is None:
            located, at = left.withColumns({"m": F.lit(0), "exit": F.lit(None).cast("struct<e:int,k1:bigint,k2:bigint>")}), []
        else:
            located, path = _kept(locate(nodes, left, bits))
            at = [path]
        pending = located.where("m < e").withColumns({"next": F.col("m") + 1}).withColumns({f"g{i}": _prefix(F.col("next"), f"h{i}") for i in (1, 2)})
        group = ["next", "g1", "g2"]
        chosen = pending.groupBy(*group).agg(F.min(F.struct(F.xxhash64("k1", "k2").alias("r"), "k1", "k2", "e", "m", "p")).alias("x"))
        reps, reps_path = _kept(chosen)
        leaves = reps.select(F.slice(F.col("x")["p"], F.col("x")["m"] + 1, F.col("x")["e"] - F.col("x")["m"] + 1).alias("edge"))
        grown = node_columns(leaves if nodes is None else _split(nodes, located).unionByName(leaves))
        ids = reps.select(*group, *(F.col("x")[c].alias(f"x_{c}") for c in KEY))
        others = pending.join(ids, group).where(" or ".join(f"{c} <> x_{c}" for c in KEY)).select("e", "k1", "k2", "p", F.col("m").alias("a"))
        left, left_path = _kept(others)
        nodes, nodes_path = _kept(grown, *owned[:1])
        for old in (*at, reps_path, *owned[1:]):
            drop(seqs.sparkSession, old)
        owned = [nodes_path, left_path]
        if left.isEmpty():
            drop(seqs.sparkSession, left_path)
            return nodes, nodes_path
    raise RuntimeError("insertion did not settle")


def subtree_sums(values: DataFrame, sums: list[str], least: str, rounds: int = 64) -> tuple[DataFrame, str]:
    """values(key, up, ...) with each of sums, and the least of least, taken over the node and all below it; as a table with its path.

    up: the parent's key, null at the top. A round adds what lies 2^k below and doubles the jump.
    """
    now, path = _kept(values)
    cols = [*sums, least]
    for _ in range(rounds):
        if now.where("up is not null").isEmpty():
            return now, path
        below = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(*(F.sum(c).alias(f"+{c}") for c in sums), F.min(least).alias(f"+{least}"))
        jumps = now.select(F.col("key").alias("up"), F.col("up").alias("jump"))
        climbing = now.where("up is not null").join(jumps, "up").select("key", F.col("jump").alias("up"), *cols)
        both = climbing.unionByName(now.where("up is null")).join(below, "key", "left")
        added = [(F.col(c) + F.coalesce(F.col(f"+{c}"), F.lit(0))).alias(c) for c in sums]
        now, path = _kept(both.select("key", "up", *added, F.least(least, f"+{least}").alias(least)), path)
    raise RuntimeError("sums did not settle")


def ends_hash(seqs: DataFrame) -> DataFrame:
    """e, k1, k2, ends_sha256: SHA-256 of the ascending ids of the conversations that are this sequence, joined by commas.

    Ids are joined in blocks of ID_BLOCK; the task that hashes a sequence's blocks holds one at a time.
    """
    on_workers(seqs.sparkSession)
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = seqs.groupBy(*KEY, block.alias("block")).agg(ids.alias("ids"))

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch[c] for c in KEY), batch["ids"], strict=True):
                if k != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInPandas(hashed, "e int, k1 long, k2 long, ends_sha256 string")


def expanded(nodes: DataFrame, seqs: DataFrame, distinct: DataFrame) -> DataFrame:
    """A row for each node of the trie that isn't compacted: see conversation_trie."""
    key, up = F.struct(*KEY), F.struct(F.col("s").alias("e"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    n_children = nodes.groupBy(F.col("s").alias("e"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = nodes.join(n_children, KEY, "left").join(distinct.select(*KEY, "n", "first"), KEY, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_children": F.coalesce("n_children", F.lit(0))})
    last, head = F.element_at("edge", -1)["w"], F.element_at("edge", 1)["w"]
    values = full.select(key.alias("key"), F.when(F.col("s") > 0, up).alias("up"), "n", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), (F.col("n") * last - (last - head)).alias("tokens"), "first")
    summed, _ = subtree_sums(values, ["n", "leaves", "tokens"], "first")
    whole = summed.where("key.e >= 1").join(nodes.where("s = 0").select(key.alias("key")), "key", "left_semi")
    top = whole.agg(F.count("*").alias("kids"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"), F.min("first").alias("first")).first()  # one row
    turnless = distinct.where("e = 0").select("n", "first").first()
    n_all, least = (top["n"] or 0) + (turnless["n"] if turnless else 0), min((x for x in (top["first"], turnless and turnless["first"]) if x is not None), default=None)
    empty = hashlib.sha256(b"").hexdigest()
    ends = ends_hash(seqs)

    parents = summed.select(F.col("key").alias("up"), F.col("first").alias("up_first"))
    rows = full.select(key.alias("key"), "s", up.alias("up"), "n_children", "edge").join(summed.select("key", "n", "leaves", "tokens", "first"), "key").join(parents, "up", "left")
    steps = rows.select("*", F.explode(F.slice("edge", F.lit(2), F.size("edge") - 1)).alias("x"))
    before, here = F.col("edge")[F.col("x")["d"] - F.col("s") - 1]["w"], F.col("x")["d"]
    inner = here < F.col("key")["e"]
    above = F.when(here > F.col("s") + 1, F.col("first")).when(F.col("s") == 0, F.lit(least)).otherwise(F.col("up_first"))
    out = steps.select(
        F.col("first").alias("conv_id"), here.cast("long").alias("depth"), above.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, 1).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("tokens") - F.col("n") * before + before - F.element_at("edge", 1)["w"]).alias("saved_tokens"),
        here.alias("e"), F.col("x")["h1"].alias("k1"), F.col("x")["h2"].alias("k2"),
    )
    if least is not None:
        root = seqs.sparkSession.createDataFrame([(least, 0, None, n_all, top["kids"], top["leaves"] or 1, top["tokens"] or 0, 0, 0, 0)], out.schema)
        out = out.unionByName(root)
    return out.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop(*KEY)


def trie_of(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of members(conv_id) whose turns are turns(conv_id, i, a, b, words): see conversation_trie."""
    seqs, _ = _kept(sequences(members, turns))
    distinct, _ = _kept(seqs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.any_value("p").alias("p")))
    nodes, _ = insert(distinct)
    return expanded(nodes, seqs, distinct)


def conversation_trie(conversations: DataFrame, shared: bool = True) -> DataFrame:
    """A row for each distinct prefix of conversations(conv_id, turn, role, text), the empty one included.

    conv_id: the least conversation that starts with it; depth; parent_conv_id, the same of the prefix without its last turn;
    n_convs, conversations that start with it; n_children, its prefixes longer by one turn; n_leaves, longest prefixes below it
    (itself if it is one); saved_tokens, over it and all below it, words of the last turn times (n_convs - 1); ends_sha256, of
    the ids of the conversations that it is the whole of. shared: conversations are rebuilt by share_first_turns.
    """
    turns, _ = _kept(turn_rows(conversations))
    return trie_of(turns.where("i = 1").select("conv_id"), share_first_turns(turns) if shared else turns)
