"""The operators' queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark, sf_dir):
    from .token_output import token_output

    got = token_output(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=2)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pii(spark, sf_dir):
    from .pii import BASE, find_pii, of_kind, rendered

    got = find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op3_decontamination(spark, sf_dir):
    from .decontaminate import find_contained

    return find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    got = token_counts(_table(spark, sf_dir, "documents"), _tokenizer(), budget=512)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")


def op5_quality(spark, sf_dir):
    from .langid_ppm import remainder
    from .quality_cnn import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return predict(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_fertility(spark, sf_dir):
    from .fertility import fertility_rules

    got = fertility_rules(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), _tokenizer())
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("entropy", 6).alias("entropy"), F.round("chars_per_token_2", 6).alias("chars_per_token_2"))


def op8_language_id(spark, sf_dir):
    from .langid_ppm import predict, remainder, train

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return predict(docs, train(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark, sf_dir):
    from .bpe import encode

    got = encode(_table(spark, sf_dir, "documents"), _tokenizer())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_toxicity(spark, sf_dir):
    from .langid_ppm import remainder
    from .toxicity_cnn import CUT, predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    network = train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return predict(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op11_hard_negatives(spark, sf_dir):
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_conversation_trie(spark, sf_dir):
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_sentence_pieces(spark, sf_dir):
    from .sentence_pieces import encode

    got = encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", "n_tokens", F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = """list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""
_SHINGLES = "unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"

#: The other operators' results come from library tokenizers, trained models or iterations: tests/llm holds brute-force versions.
ORACLES = {
    "op3_decontamination": f"""
        WITH s AS (SELECT DISTINCT doc_id, {_SHINGLES} AS shingle FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5),
        t AS (SELECT DISTINCT item_id, {_SHINGLES} AS shingle FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
        n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id)
        SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
        FROM s JOIN t USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
    """,
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS codes FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(CAST(a.codes AS DOUBLE[]), CAST(v.codes AS DOUBLE[])) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT * FROM n WHERE rank <= 10
    """,
    "op12_conversation_trie": """
        WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list(turn ORDER BY i) AS turns FROM o GROUP BY conv_id),
        h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM c),
        s AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
        p AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM s, unnest(range(0, len(turns) + 1)) AS u(d)),
        n AS (SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM p GROUP BY p),
        k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(n.p[d].t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS saved FROM n LEFT JOIN k USING (p)),
        t AS (SELECT f.p[1:u.d] AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM f, unnest(range(0, f.d + 1)) AS u(d) GROUP BY ALL)
        SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, CASE WHEN f.d > 0 THEN q.conv_id END AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
        FROM f JOIN t USING (p) LEFT JOIN n AS q ON q.p = f.p[1:f.d - 1]
    """,
}


def oracle_sql():
    return dict(ORACLES)
