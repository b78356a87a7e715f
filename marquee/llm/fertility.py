"""Quality rules on tokeniser fertility: how a public vocabulary takes a text, against bands for its script.

A text's words are encoded by a SentencePiece model with byte fallback and counted under a byte-level BPE. Measured per
text: characters per token under both, the share of byte-fallback tokens, and the entropy of the model's tokens in bits.
A text outside a band of its main script is rejected; so
is one that fails the base rules. So is one that lies far out among its like: the texts of its script, language (the
column lang, where docs have it) and length in powers of two of tokens that pass the base rules.

Nulls: a null text has no words; a null lang is one language. Equal rows stay. A text without words fails the base rule
on word count; its measures are 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import kept_for_stage, map_batches, written
from .textvec import Pieces, _MIXERS, in_chunks, mix, span_hashes, sums_by_text, word_spans
from .tokenizer import load


@dataclass(frozen=True)
class Band:
    """Measures that a text of a script must keep to. The least entropy is that of FULL tokens or more; fewer can have
    log2 of their number at most, and the least falls in proportion to that."""

    chars_per_token: tuple[float, float]
    most_bytes: float
    least_entropy: float


#: Scripts by UTF-8 lead bytes, and their bands. Vocabularies spend more tokens on scripts that they know less of.
SCRIPTS = {
    "latin": ([*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], Band((1.2, 9.0), 0.2, 4.0)),
    "greek": ([0xCD, 0xCE, 0xCF], Band((0.7, 5.0), 0.4, 4.0)),
    "cyrillic": ([*range(0xD0, 0xD4)], Band((0.9, 7.0), 0.3, 4.0)),
    "semitic": ([*range(0xD6, 0xDC)], Band((0.5, 4.0), 0.5, 4.0)),
    "indic": ([0xE0], Band((0.3, 4.0), 0.9, 3.0)),
    "east_asian": ([*range(0xE3, 0xEE)], Band((0.3, 3.0), 0.9, 3.0)),
}
OTHER = Band((0.2, 12.0), 1.0, 2.0)
FULL = 64
#: Far out is FENCE spreads between quartiles beyond one. A spread is at least LEAST_SPREAD of the median, or LEAST_BYTES
#: for the byte share; groups of fewer than GROUP different texts have the bands alone; from 2^LONGEST tokens on is one length.
FENCE, LEAST_SPREAD, LEAST_BYTES, GROUP, LONGEST = 3.0, 0.01, 0.05, 50, 11
MOST_WORDS = 1_000_000  # that a worker remembers

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.full(256, len(SCRIPTS), dtype=np.int64)
for _i, (_bytes, _) in enumerate(SCRIPTS.values()):
    _LEAD[_bytes] = _i

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy double, chars_per_token_2 double"
MEASURES = ("chars_per_token", "byte_share", "entropy", "chars_per_token_2")
LIKE = ["script", "lang", "length"]


@kept_for_stage
def piece_words(path: str) -> Pieces:
    """A table of words whose values are their SentencePiece ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def learn(words: list[bytes]):
        ids = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32), list(map(len, ids))

    table = Pieces(None, learn, np.int32, None)
    table.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return table


@kept_for_stage
def word_counts(path: str) -> Pieces:
    """A table of words whose values are the number of their tokens under a byte-level BPE, a blank before each word."""
    library = load(path)

    def learn(words: list[bytes]):
        got = library.encode_batch_fast([" " + w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return np.array([len(x.ids) for x in got], dtype=np.int32), np.ones(len(words), np.int64)

    return Pieces(None, learn, np.int32, None)


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def _repeat_words(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each text: its words in windows of three that it holds twice or more."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    covered = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        own = np.flatnonzero(doc[2:] == doc[:-2])
        key = mix(h[own] * _MIXERS[0] + h[own + 1] * _MIXERS[1] + h[own + 2] * _MIXERS[2] + doc[own].astype(np.uint64) * _MIXERS[3])
        codes, _ = pd.factorize(key)
        again = own[np.bincount(codes)[codes] > 1] if len(own) else own
        for i in range(3):
            covered[again + i] = True
    return sums_by_text(covered, cut)


def _entropy(ids: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of each text's token distribution."""
    _, first, count = np.unique(doc * (1 << 20) + ids, return_index=True, return_counts=True)
    weight = np.bincount(doc[first], count * np.log2(count), minlength=len(n)) if len(first) else np.zeros(len(n))
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - weight / np.maximum(n, 1), 0.0)


def _measure(table: Pieces, second: Pieces, texts: list[str]) -> dict:
    raw_texts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw, starts, ends, cut = word_spans(raw_texts)
    edges = np.cumsum([1, *(len(t) + 1 for t in raw_texts)])
    h = span_hashes(raw, starts, ends)
    n_words = np.diff(cut)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word_chars = sums_by_text(heads[ends] - heads[starts], cut)
    repeat = _repeat_words(h, cut)

    def spelled(at):
        return [raw[starts[i] : ends[i]].tobytes() for i in at]

    rows = table._rows(h, spelled) if len(h) else np.empty(0, np.int64)
    n_second = sums_by_text(second.gather(second._rows(h, spelled)), cut) if len(h) else np.zeros(len(texts), np.int64)
    ids = table.gather(rows).astype(np.int64)
    n_tokens = sums_by_text(table.count[rows], cut)
    doc = np.repeat(np.arange(len(texts)), n_tokens)
    byte_share = np.bincount(doc, table.is_byte[ids], minlength=len(texts)) / np.maximum(n_tokens, 1)
    entropy = _entropy(ids, doc, n_tokens)
    ratio = word_chars / np.maximum(n_tokens, 1)

    which = np.repeat(np.arange(len(texts)), [len(t) for t in raw_texts])
    inside = np.concatenate([np.frombuffer(t, np.uint8) for t in raw_texts]) if raw_texts else np.empty(0, np.uint8)
    lead = _LEAD[inside]
    votes = np.bincount(which * (len(SCRIPTS) + 1) + lead, minlength=len(texts) * (len(SCRIPTS) + 1)).reshape(len(texts), -1)[:, :-1]
    script = np.where(votes.sum(1) > 0, votes.argmax(1), len(SCRIPTS))
    bands = [b for _, b in SCRIPTS.values()] + [OTHER]
    low, high, most, least = (np.array(x)[script] for x in zip(*((*b.chars_per_token, b.most_bytes, b.least_entropy) for b in bands), strict=True))
    least = least * np.minimum(np.log2(np.maximum(n_tokens, 1)) / np.log2(FULL), 1)
    base_failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    fits = (ratio >= low) & (ratio <= high) & (byte_share <= most) & (entropy >= least)
    names = np.array([*SCRIPTS, "other"])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": sums_by_text(_SYMBOL[raw], edges), "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": repeat, "base_failed": base_failed, "kept": ~base_failed & fits, "script": names[script].tolist(), "n_tokens": n_tokens, "chars_per_token": ratio, "byte_share": byte_share, "entropy": entropy, "chars_per_token_2": word_chars / np.maximum(n_second, 1)}


def fences(measured: DataFrame) -> DataFrame:
    """script, lang, length, and limits of the measures, for each group of enough texts that pass the base rules.

    Texts of equal measures count once, so that copies of one text do not narrow a group.
    """
    of = measured.where("not base_failed").select(*LIKE, "n_tokens", *MEASURES).distinct()
    got = of.groupBy(*LIKE).agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in MEASURES))

    def spread(c, least):
        return FENCE * F.greatest(F.col(c)[2] - F.col(c)[0], least)

    ratio, entropy, ratio_2 = (spread(c, LEAST_SPREAD * F.col(c)[1]) for c in ("chars_per_token", "entropy", "chars_per_token_2"))
    limits = [(F.col("chars_per_token")[0] - ratio).alias("low"), (F.col("chars_per_token")[2] + ratio).alias("high"), (F.col("chars_per_token_2")[0] - ratio_2).alias("low_2"), (F.col("chars_per_token_2")[2] + ratio_2).alias("high_2"), (F.col("byte_share")[2] + spread("byte_share", F.lit(LEAST_BYTES))).alias("most"), (F.col("entropy")[0] - entropy).alias("least")]
    return got.where(F.col("n") >= GROUP).select(*LIKE, *limits)


def fertility_rules(docs: DataFrame, model: str, tokenizer: str) -> DataFrame:
    """model: a SentencePiece file, tokenizer: a byte-level BPE's. SCHEMA, one row for each row of docs(doc_id, text), with lang or without: base counts, measures, verdicts."""

    def make():
        table, second = piece_words(model), word_counts(tokenizer)

        def step(batch):
            if table.rows > MOST_WORDS:
                table.clear()
                second.clear()
            texts = [x or "" for x in batch["text"].to_pylist()]
            for a, b in in_chunks(texts):
                got = _measure(table, second, texts[a:b])
                length = np.minimum(np.log2(np.maximum(got["n_tokens"], 1)).astype(np.int32), LONGEST)
                yield {"doc_id": batch["doc_id"][a:b], "lang": batch["lang"][a:b], "length": length, **got}

        return step

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    measured = written(map_batches(docs.select(F.col("doc_id").cast("long"), "text", lang.alias("lang")), make, f"{SCHEMA}, lang string, length int"))
    near = F.col("chars_per_token").between(F.col("low"), F.col("high")) & (F.col("byte_share") <= F.col("most")) & (F.col("entropy") >= F.col("least")) & F.col("chars_per_token_2").between(F.col("low_2"), F.col("high_2"))
    judged = measured.join(F.broadcast(fences(measured)), LIKE, "left").withColumn("kept", F.col("kept") & F.coalesce(near, F.lit(True)))
    return judged.select([c.split()[0] for c in SCHEMA.split(", ")])
