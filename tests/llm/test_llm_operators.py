"""Every operator against brute force on small tables, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from marquee.llm import bpe, decontaminate, fertility, jaccard_join, langid_ppm, pii, quality_cnn, queries, stages, token_counts, token_output, tokenizer, toxicity_cnn, training  # noqa: E402
from marquee.llm.textvec import Pieces  # noqa: E402
from marquee.llm.tokenizer import library_pieces, load, values_by_text  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BPE = P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Null and empty texts, a long one, repeated rows, equal texts, a null id, rare characters; columns whose names operators use.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "one two three"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "nobody's text here with words"),
    (7, "word " * 30_000), (8, "naïve Ω 日本語 🎉\x00 x\x85y"), (9, "<|endoftext|>a  <|endoftext|>"), (10, "x" * 3000), (11, "mail a@b.co 10.0.0.1 +1 (988) 555-2485 or 4111 1111 1111 1111"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, key long, n int, ids string, seen string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, 1.0, "b", 2, 3, "i", "z") for i, t in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def encoded(t):
    return load(BPE).encode(t or "", add_special_tokens=False).ids


def test_op1_round_trip_in_order(spark, texts):
    got, start = by_id(queries.op1_token_output(spark, SMALL)), 0
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*encoded(texts[i]), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_awkward_and_empty(awkward, empty):
    rows = sorted(token_output.token_output(awkward, BPE).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(i for i, _ in AWKWARD if i is not None)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in rows) == Counter((i, (*encoded(t), 2)) for i, t in AWKWARD)
    assert token_output.token_output(empty, BPE).count() == 0


@pytest.mark.parametrize("limit", [4, 6, 18])
def test_op1_code_lengths_are_bounded_and_complete(limit):
    lengths = token_output.limited_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]), limit)
    assert lengths.max() <= limit and math.isclose(sum(2.0**-x for x in lengths), 1.0)
    coder = token_output.Coder(np.arange(13) * 7, lengths)
    ids, n = np.random.default_rng(1).integers(0, 13, 2000) * 7, np.array([1, 700, 299, 1000])
    payload, size, marks = coder.encode(ids, n)
    start = marks + np.repeat((np.cumsum(size) - size) * 8, -(-n // token_output.EVERY))
    assert (coder.decode(payload, start, n) == ids).all()


def test_op1_new_pieces_reach_the_library_as_one_text_that_it_need_not_split(monkeypatch):
    seen = []

    class Watched:
        def __init__(self, path):
            self.__dict__["inner"] = load(path)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **kw):
            seen.append((len(texts), type(self.inner.pre_tokenizer).__name__))
            return self.inner.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(tokenizer, "load", Watched)
    pieces = [" erpföie", "Tiedha", " 日本", "82", "\n", "   ", "'s", " \x00", "🎉", "<|endoftext|>", " ...", "x" * 300]
    ids, n = library_pieces.__wrapped__(BPE).learn(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [encoded(p) for p in pieces]
    assert seen == [(1, "WhitespaceSplit")]


def test_op1_piece_table_keeps_apart_keys_that_share_slots():
    rng = np.random.default_rng(3)
    table = Pieces(None, lambda pieces: (np.array([int(p) for p in pieces], np.int64), np.ones(len(pieces), np.int64)), np.int64, None)
    keys = np.unique(np.concatenate([rng.integers(0, 9000, 6000).astype(np.uint64) << np.uint64(40), np.arange(3000, dtype=np.uint64), rng.integers(0, 1 << 63, 6000).astype(np.uint64)]))
    for _ in range(30):
        some = rng.choice(keys, 1000)
        assert (table.gather(table._rows(some, lambda at, k=some: [str(x) for x in k[at]])) == some.astype(np.int64)).all()
    assert table.rows == len(np.unique(table.key[: table.rows])) and 2 * table.rows <= len(table.slot)


def base_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_op2_base_spans(spark, texts):
    got = by_id(queries.op2_pii(spark, SMALL))
    assert {i: r.base_sha256 for i, r in got.items()} == {i: hashlib.sha256(base_spans(t or "").encode()).hexdigest() for i, t in texts.items()}


def test_op2_patterns_match_their_definitions(spark):
    rng = random.Random(5)
    hard = ["a@b.c_d@e.f g@h.i@j.k", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111-5 4111-1111-1111-1111", "é 🎉 x@y.zz 🎉 10.0.0.1", "9" * 3000, "1." * 2000, "x@" + "a." * 2000, "1 " * 3000]
    hard += ["".join(rng.choice("012345 4111-+().@ab.%") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    rows = pii.base_entities(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).select("doc_id", pii.rendered(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: base_spans(t) for i, t in enumerate(hard)}


def test_op2_patterns_learned_from_seeds_find_more(spark):
    rows = [(i, f"some words email: user{i}@mail.com and more") for i in range(20)] + [(100, "the email: jane_doe77 and more"), (101, "a random99x word")]
    found = {r.doc_id: r.added for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in found[100]] == [("email", 11, 21)]
    assert not any(found[i] for i in found if i != 100)
    assert by_id(pii.redact(spark.createDataFrame(rows, "doc_id long, text string")))[100].text == "the email: <EMAIL> and more"


def test_op2_planted_identifiers(spark, texts):
    """Seeds and identifiers of other forms planted in like contexts into all documents, every third with decoys."""
    rng = random.Random(6)
    rows, want = [], set()
    for i, t in texts.items():
        at = len(t or "") // 2
        forms = [f"reach me at u{i}@mail.com or", f"reach me at jane.doe{i}@intranet or", f"my number: +49 30 555{i:05d} is", f"my number: 030 {i:03d} 45 67 is", f"password={rng.getrandbits(72):018x} was", f'token = "{rng.getrandbits(160):040x}" was', f"version v{i}.2.30-rc1 of", f"in the year 19{i % 100:02d} of"]
        form = forms[i % 8] if i % 3 else forms[i % 2 * 2]
        rows.append((i, f"{(t or '')[:at]} {form} {(t or '')[at:]}"))
        value = {1: f"jane.doe{i}@intranet", 3: f"030 {i:03d} 45 67", 4: form[9:27], 5: form[9:49]}.get(forms.index(form))
        if value:
            a = rows[-1][1].index(value)
            want.add((i, a, a + len(value)))
    got = {(r.doc_id, s.start, s.end) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.added}
    assert len(want) > 40 and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_op2_awkward_and_empty(awkward, empty):
    rows = pii.find_pii(awkward).collect()
    assert Counter((r.doc_id, len(r.base)) for r in rows) == Counter((i, len([x for x in base_spans(t or "").split(",") if x])) for i, t in AWKWARD)
    clean = pii.redact(awkward)
    assert clean.columns == awkward.columns and clean.count() == len(AWKWARD)
    assert by_id(clean)[11].text == "mail <EMAIL> <IP> <PHONE> or <CARD>" and by_id(clean)[1].text is None
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def shingles(t, width=5):
    w = WORD.findall((t or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_op3_containment_is_exact(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    items[900], items[901], items[902] = "one two three", None, texts[0][:200]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(5000, "zero one two three four five six"), (5001, None), (5002, "")], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.find_contained(more, table).collect()}
    want = set()
    for i, t in [*texts.items(), (5000, "zero one two three four five six")]:
        for j, x in items.items():
            if s := shingles(x):
                k = len(s & shingles(t, len(next(iter(s)))))
                if 100 * k >= 75 * len(s):
                    want.add((i, j, k))
    assert got == want and (5000, 900, 1) in got


def test_op3_finds_every_item_at_the_bound(spark):
    """Items of many sizes, documents that hold just enough of them, or one shingle less, in pieces among other words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items, docs = [], []
    for j, n in enumerate([1, 2, 3, 5, 8, 13, 40, 100, 333]):
        w = [word() for _ in range(n + 4)]
        items.append((j, " ".join(w)))
        for short in (0, 1):
            keep = -(-75 * n // 100) - short
            a = keep // 2
            parts = [w[: a + 4] if a else [], w[n - (keep - a) : n + 4] if keep - a else []]
            docs.append((10 * j + short, " ".join([*(word() for _ in range(30)), *parts[0], *(word() for _ in range(3000)), *parts[1], word()])))
    items.append((3, "another text under an id that is taken already by one"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in docs}
    want = {(i, j) for i, s in sets.items() for j, x in items if 100 * len(shingles(x) & s) >= 75 * len(shingles(x))}
    assert got == want and {j for _, j in want} == set(range(9))


def test_op3_awkward_and_empty(spark, awkward, empty):
    items = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contained(awkward, items).collect()] == [(6, 1)]
    assert decontaminate.find_contained(empty, items).count() == 0 and decontaminate.find_contained(awkward, items.where("false")).count() == 0


def test_op4_and_op9_match_the_library(spark, texts):
    counts, coded = by_id(queries.op4_token_counts(spark, SMALL)), by_id(queries.op9_bpe(spark, SMALL))
    for i, t in texts.items():
        ids = encoded(t)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 512)
        assert coded[i].n_tokens == len(ids) and coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(load(BPE).decode(ids, skip_special_tokens=False).encode()).hexdigest()


def hard_texts():
    rng = random.Random(3)
    out = ["it's we're I'll 'd''s  x\n\n y \t\tz  ", "", "a<|endoftext|>b  <|endoftext|>", "日本語 テスト　x 中 a  b", "'tis '  's 'S don't've12'3 !!'s  're", "\n \n", "a\x00b", "x\x85y 🎉🎉 naïve Ω", "a" * 300, "     " * 50 + "x", "-" * 300]
    return out + ["".join(rng.choice("ab  \n\t'slreéñΩ<|endoftext|>1.! ") for _ in range(rng.randint(0, 50))) for _ in range(150)]


def test_op4_counts_every_prefix():
    table, t = token_counts.step_pieces(BPE), load(BPE)
    for x, steps in zip(hard_texts(), token_counts.text_steps(table, hard_texts()), strict=True):
        assert list(np.cumsum(steps, dtype=int)) == [len(t.encode(x[:i], add_special_tokens=False).ids) for i in range(1, len(x) + 1)]
        for budget in (0, 1, 5):
            fits = [i for i in range(len(x) + 1) if token_counts.count_at(steps.tobytes(), i) <= budget]
            assert token_counts.cut_at(steps.tobytes(), budget) == max(fits)


def test_op9_pieces_match_the_library():
    ours, theirs = (list(values_by_text(f(BPE), hard_texts())) for f in (bpe.bpe_pieces, library_pieces))
    assert all(list(a) == list(b) == encoded(x) for a, b, x in zip(ours, theirs, hard_texts(), strict=True))


def test_op9_speculation_agrees_with_merging():
    m, rng = bpe.merges(BPE), random.Random(9)
    words = ["".join(rng.choice("thendroiasly") for _ in range(rng.randint(1, 14))).encode() for _ in range(2000)]
    ids, count, failed = m.speculate(words)
    assert 0 < len(failed) < len(words)
    for k, x in enumerate(np.split(ids, np.cumsum(count)[:-1])):
        assert (list(x) == m.merged(words[k])) == (k not in set(failed))


def test_op4_op9_awkward_and_empty(awkward, empty):
    for r in bpe.encode(awkward, BPE).collect():
        want = dict(AWKWARD)[r.doc_id] or ""
        assert r.decoded == want and list(np.frombuffer(r.ids, "<u4")) == encoded(want)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(awkward, BPE).collect()} == {(i, len(encoded(t))) for i, t in AWKWARD}
    assert bpe.encode(empty, BPE).count() == 0 and token_counts.token_counts(empty, BPE).count() == 0


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op5_quality, "quality", 0.95), (queries.op10_toxicity, "toxic", 0.7)])
def test_classifiers_on_held_out_labels(spark, query, label, least):
    d = "/root/testdata/sf0.01"
    got = query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got[label].to_numpy()) > least and got.score.between(0, 1).all()


@pytest.mark.parametrize(("module", "label"), [(quality_cnn, "quality"), (toxicity_cnn, "toxic")])
def test_classifiers_awkward_and_empty(spark, awkward, empty, module, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None), (4, 7)], f"doc_id long, {label} int")
    network = module.train(awkward, labels, label)
    rows = module.predict(awkward, network).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    for none in (labels.where("false"), labels.where(f"{label} = 1")):
        assert len({r.score for r in module.predict(awkward, module.train(awkward, none, label)).collect()}) == 1
    assert module.predict(empty, network).count() == 0


def test_samples_weigh_as_all_labels_do(spark):
    docs = spark.range(50).selectExpr("id doc_id", "concat('text ', id) text")
    got = training.sample(docs, docs.selectExpr("doc_id", "int(doc_id < 10) toxic"), "toxic", per_class=10)
    assert len(got) == 20 and math.isclose(np.average(got.y, weights=got.weight), 0.2) and math.isclose(got.weight.mean(), 1)
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], [9000, 1000])
    score = np.clip(rng.normal(0.35 + 0.3 * y, 0.15), 0, 1)
    few = np.concatenate([np.arange(1000), np.arange(9000, 10_000)])
    whole, drawn, plain = training.best_cut(score, y), training.best_cut(score[few], y[few], weight=np.where(y[few] == 1, 0.2, 1.8)), training.best_cut(score[few], y[few])
    assert abs(whole - drawn) < 0.05 < whole - plain


def test_op10_learns_word_embeddings():
    texts = [f"{'vile' if i % 2 else 'kind'} words number {'abcdefgh'[i % 8]} here" for i in range(80)]
    got, dealt = toxicity_cnn.Network().fit(texts, np.arange(80) % 2), toxicity_cnn.Network()
    ids = np.unique(toxicity_cnn.word_ids(texts)[0])
    moved = (got.p["embed"] != dealt.p["embed"])[:, 1:].any(1)
    assert moved[ids].any() and not np.delete(moved, ids).any()


def components_by_force(rows):
    sets, holders, up = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 2}])
def test_op6_components(spark, blocks):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(word() if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join(base[:20] + [word() for _ in range(40)])) for i in range(40)]
    rows += [(200 + i, "same text in every one of these rows") for i in range(30)] + [(300, "Same TEXT in every one of these rows"), (301, "three words only"), (302, "three words only"), (303, ""), (304, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **blocks).collect()}
    assert got == components_by_force(rows)


def test_op6_whole_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, SMALL).collect()}
    assert got == components_by_force(list(texts.items()))


def test_op6_awkward_and_empty(awkward, empty):
    rows = jaccard_join.jaccard_components(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[5] == 4 and got[1] == 1 and got[2] == 2 and got[None] is None
    assert jaccard_join.jaccard_components(empty).count() == 0


def rules_by_force(t):
    w, seen, dup, covered = WORD.findall(t), set(), 0, set()
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(covered)


def test_op7_counts_and_measures(spark, texts, awkward, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = by_id(fertility.fertility_rules(spark.read.parquet(f"{SMALL}/documents.parquet"), P.path("piece_bpe_32k.model"), BPE))
    for i, t in texts.items():
        r, n = got[i], rules_by_force(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
        ids = [x for w in WORD.findall(t or "") for x in model.encode(w)]
        entropy = -sum(k / len(ids) * math.log2(k / len(ids)) for k in Counter(ids).values()) if ids else 0
        assert r.n_tokens == len(ids) and math.isclose(r.entropy, entropy, abs_tol=1e-6)
        second = sum(len(x.ids) for x in load(BPE).encode_batch([" " + w for w in WORD.findall(t or "")], add_special_tokens=False)) if i < 40 else None
        assert second is None or math.isclose(r.chars_per_token_2, n[1] / max(second, 1), abs_tol=1e-9)
    rows = fertility.fertility_rules(awkward, P.path("piece_bpe_32k.model"), BPE).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t in AWKWARD)
    assert fertility.fertility_rules(empty, P.path("piece_bpe_32k.model"), BPE).count() == 0


def test_op7_rejects_what_lies_far_out_among_its_like(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    plain = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(200)]
    few = [(1000 + i, " ".join(words[(i + j * j) % 7 + j % 23] for j in range(120)), "en") for i in range(5)]
    rare = [(2000 + i, t, "xx") for i, (_, t, _) in enumerate(few)]
    copies = [(3000 + i, plain[0][1], "en") for i in range(600)]
    rows = spark.createDataFrame(plain + few + rare + copies, "doc_id long, text string, lang string")
    got = by_id(fertility.fertility_rules(rows, P.path("piece_bpe_32k.model"), BPE))
    assert len(got) == len(plain) + 5 + 5 + 600
    assert not any(got[i].base_failed for i, *_ in plain + few + rare + copies)
    assert sum(got[i].kept for i, *_ in plain) >= 199 and all(got[i].kept for i, *_ in rare + copies)
    assert not any(got[i].kept for i, *_ in few)


FEW = ["", "a", "x" * 130, "one two three four " * 40, "naïve Ω 日本語 🎉 " * 30 + "end", "ab" * 5000]


def test_op5_scores_are_a_plain_forward_pass():
    """Every filter at every second byte, every chunk's maximum, mean and maximum over chunks, by loops."""
    net, C = quality_cnn.Network(), quality_cnn
    net.p["offset"] += np.linspace(-0.3, 0.3, C.FILTERS).astype(np.float32)
    for t, got in zip(FEW, net.score(FEW), strict=True):
        raw = t.encode()
        b = bytes(C.PAD) + raw + bytes(C.PAD)
        mark = [any(b[i : i + 4] == b[i - lag : i - lag + 4] for lag in C.LAGS if i >= lag) for i in range(len(b) - 3)] + [False] * 3
        n = max((len(raw) + C.STRIDE - 1) // C.STRIDE, 1)
        h = []
        for p in range(n):
            seen = [x for j in range(C.WIDTH) for i in [C.PAD + p * C.STRIDE + j] for x in (*net.p["embed"][b[i]], float(mark[i]))]
            h.append(np.array(seen) @ net.p["filters"])
        chunks = [np.maximum(np.max(h[a : a + C.CHUNK], axis=0) + net.p["offset"], 0) for a in range(0, n, C.HOP)]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        assert math.isclose(got, 1 / (1 + math.exp(-(z @ net.p["out"] + net.p["bias"][0]))), abs_tol=1e-4)


def test_op10_scores_are_a_plain_forward_pass():
    net, T = toxicity_cnn.Network(), toxicity_cnn
    for t, got in zip(FEW, net.score(FEW), strict=True):
        words = re.findall(r"[A-Za-z\u00c0-\uffff\U00010000-\U0010ffff]+", t)
        ids, _ = T.word_ids([t])
        assert len(words) == len(ids)
        x = [net.p["embed"][row].sum(0) for row in ids] + [np.zeros(T.DIM)] * 3
        z = []
        for w in T.WIDTHS:
            seen = [np.concatenate(x[p : p + w]) @ net.p[f"filters{w}"] + net.p[f"offset{w}"] for p in range(max(len(words), 1))]
            z.extend(np.maximum(np.max(seen, axis=0), 0))
        p = 1 / (1 + math.exp(-(np.array(z) @ net.p["out"] + net.p["bias"][0])))
        assert math.isclose(got, 0.6 * p if p < 0.5 else 0.3 + 1.4 * (p - 0.5), abs_tol=1e-4)


def test_op10_cuts_belong_to_learned_languages():
    rng = random.Random(1)
    words = {"en": "the of and to in is that for".split(), "fr": "le la les et des est que pour".split()}
    rows = [(" ".join(rng.choice(words[g]) for _ in range(20)) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0), g) for i in range(400) for g in words]
    net = toxicity_cnn.Network().fit([t for t, _, _ in rows], np.array([y for _, y, _ in rows]), langs=[g for *_, g in rows])
    assert net.trees.languages == ["en", "fr"] and len(net.cuts) == 3
    assert net.groups([t for t, *_ in rows]).tolist() == [1 if g == "en" else 2 for *_, g in rows]
    assert toxicity_cnn.Network().fit([t for t, _, _ in rows], np.array([y for _, y, _ in rows])).groups(["x"]).tolist() == [0]


def test_samples_are_bounded_in_rows_and_bytes_whatever_a_text_is_long(spark):
    docs = spark.range(60).selectExpr("id doc_id", "repeat('x', int(id % 3) * 50000 + 10) text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) toxic")
    got = training.sample(docs, labels, "toxic", per_class=20, class_bytes=400_000)
    size = got.text.str.len()
    assert (got.groupby("y").size() <= 20).all() and (size.groupby(got.y).sum() <= 400_000).all() and size.max() == 100_010
    assert len(training.sample(docs, labels, "toxic", per_class=20, class_bytes=1)) == 2


def ppm_by_force(counts, text, order=3):
    """Bits of a text: counts maps a context (bytes) to a Counter of next bytes."""
    b, bits = bytes(order) + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k : i])
            if c is None:
                continue
            total, kinds = sum(c.values()), len(c)
            bits -= math.log2((c[b[i]] or kinds) / (total + kinds))
            if c[b[i]]:
                break
        else:
            bits += 8
    return bits


def test_op8_code_lengths_of_whole_texts(texts, docs):
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").orderBy("doc_id").limit(60).collect()]
    trees = langid_ppm.counted([t for t, _ in rows], [x for _, x in rows])
    counts = {x: defaultdict(Counter) for x in trees.languages}
    for t, x in rows:
        b = bytes(3) + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[x][b[i - k : i]][b[i]] += 1
    some = [t for t in list(texts.values())[60:80] if t] + ["", "é", "zzz qqq \x00 €"]
    bits, n = langid_ppm.Scorer(trees).bits(some)
    for t, row, size in zip(some, bits, n, strict=True):
        want = [ppm_by_force(counts[x], t) for x in trees.languages]
        assert size == len(t.encode()) and np.allclose(row, want, rtol=1e-9, atol=1e-6) and (not t or row.argmin() == int(np.argmin(want)))
    alone, _ = langid_ppm.Scorer(trees).bits(some[3:4])
    assert (alone[0] == bits[3]).all()


def test_op8_costs_are_the_definition():
    grams, _ = langid_ppm._grams(["abab", "abba"])
    code, n = np.unique(grams, return_counts=True)
    trees = langid_ppm.Trees(["x"], np.zeros(len(code), int), code, n.astype(float))
    # after zeros, 'a' came twice of two: 2 of 2 + 1 symbols
    assert math.isclose(trees.costs(np.array([ord("a")]))[0, 0], -math.log2(2 / 3))
    # 'c' in no context: escapes from 0,0,0 (1 of 3), then shorter contexts where held, at last 8 bits
    assert trees.costs(np.array([ord("c")]))[0, 0] > 8


def test_op8_held_out_and_awkward(spark, awkward, empty):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    trees = langid_ppm.train(spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "le chat et la souris", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"), per_language=10)
    rows = by_id(langid_ppm.predict(awkward, trees))
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[4].lang_pred in ("en", "fr")
    assert langid_ppm.predict(empty, trees).count() == 0
    assert {r.lang_pred for r in langid_ppm.predict(awkward, langid_ppm.train(awkward)).collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, d)
        assert name == "bpe" or docs.columns == before.columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept, was = ({r.doc_id: r for r in x.collect()} for x in (docs, before))
        if name == "quality":
            gone = [i for i in was if i not in kept and i in labels]
            assert gone and np.mean([labels[i].quality for i in gone]) < 0.05
        if name == "near_duplicates":
            want = components_by_force([(i, r.text) for i, r in was.items()])
            assert set(kept) == {i for i in was if want[i][1] == i}
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            bad = {i for i, r in was.items() if any(x and 100 * len(x & shingles(r.text)) >= 75 * len(x) for x in items)}
            assert set(kept) == set(was) - bad and bad
        if name == "pii":
            assert set(kept) == set(was) and not any(base_spans(r.text) for r in kept.values())
        if name == "bpe":
            assert all(r.decoded == was[i].text and r.n_tokens == len(encoded(was[i].text)) for i, r in kept.items())


def test_stages_take_awkward_rows(spark, awkward, empty):
    d = "/root/testdata/sf0.001"
    for stage in (stages.keep_one_of_each_group, stages.drop_contaminated, stages.redact_pii, stages.keep_quality):
        out = stage(spark, awkward, d)
        assert out.columns == awkward.columns and out.count() <= len(AWKWARD)
        assert stage(spark, empty, d).count() == 0
    left = stages.keep_one_of_each_group(spark, awkward, d)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
