"""Exact token counts at every prefix of every text, by dynamic programming over byte-level BPE.

The last token of a prefix's encoding is the one token that ends there and is compatible with the last token of the
prefix before it. So each piece of text is counted at all its prefixes in one pass, and a text's prefix counts are the
running sum of its pieces' steps. They are stored as one signed step for each code point.

Nulls: a null text is an empty one, with no steps. Repeated rows stay. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import kept_for_stage, map_batches
from .bpe import MOST_PIECES, SHORT, Merges, merges, prefix_sums
from .textvec import Pieces
from .tokenizer import load, special_string

STEP = np.dtype("<i2")
#: fixed values: code points with the property White_Space
WHITE_SPACE = frozenset(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def prefix_counts(m: Merges, words: list[bytes]) -> np.ndarray:
    """For words of at most SHORT bytes, one after another: the word's token count at each byte prefix."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = np.array([len(w) for w in words], dtype=np.int64)
    base = np.cumsum(n) - n
    sums = prefix_sums(raw)
    last, count = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
    for i in range(1, int(n.max()) + 1 if len(n) else 0):
        open_ = np.flatnonzero(n >= i)
        for size in range(min(i, m.longest), 0, -1):
            if not len(open_):
                break
            end = base[open_] + i
            token = m.find(sums, end - size, end)
            hit = token >= 0
            if size < i:
                k = np.flatnonzero(hit)
                hit[k] = m.compatible(last[end[k] - size - 1], token[k])
            at = end[hit] - 1
            last[at] = token[hit]
            count[at] = 1 if size == i else count[at - size] + 1
            open_ = open_[~hit]
    return count


def long_prefix_counts(m: Merges, word: bytes) -> np.ndarray:
    """The same for one long word."""
    last, count = [0] * (len(word) + 1), np.zeros(len(word) + 1, dtype=np.int64)
    for i in range(1, len(word) + 1):
        ends = [(i - size, t) for size in range(min(i, m.longest), 0, -1) if (t := m.by_bytes.get(word[i - size : i])) is not None]
        fits = m.compatible(np.array([last[j] for j, _ in ends]), np.array([t for _, t in ends])) | np.array([j == 0 for j, _ in ends])
        j, last[i] = ends[int(np.argmax(fits))]
        count[i] = count[j] + 1
    return count[1:]


@kept_for_stage
def step_pieces(path: str) -> Pieces:
    """Pieces whose values are the steps of the token count, one for each code point."""
    m, library = merges(path), load(path)
    special = special_string(library)

    def learn(pieces: list[str]):
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        n = np.array([len(w) for w in raw], dtype=np.int64)
        count = np.empty(int(n.sum()), dtype=np.int64)
        is_short = n <= SHORT
        count[np.repeat(is_short, n)] = prefix_counts(m, [w for w in raw if len(w) <= SHORT])
        first = np.cumsum(n) - n
        for i in np.flatnonzero(~is_short):
            count[first[i] : first[i] + n[i]] = long_prefix_counts(m, raw[i])
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        closes = np.append((b[1:] & 0xC0) != 0x80, True)  # the last byte of each code point
        closes[first[1:] - 1] = True
        sizes = np.add.reduceat(closes, first, dtype=np.int64)
        count = count[closes]
        steps, first = np.diff(count, prepend=0), np.cumsum(sizes) - sizes
        steps[first] = count[first]
        for i, p in enumerate(pieces):
            if p in ("'re", "'ve", "'ll"):  # their first letter alone would be a piece apart from '
                steps[first[i] : first[i] + 3] = (1, 1, count[first[i] + 2] - 2)
        return steps.astype(STEP), sizes

    return Pieces(library, learn, STEP, special, MOST_PIECES)


def text_steps(table: Pieces, texts: list[str]):
    """Yields the steps of each text."""
    for a, b, rows, cut, starts, ends, units in table.batch(texts):
        if units is None:
            yield slow_steps(table, texts[a])
            continue
        steps, first = table.gather(rows), np.cumsum(ends - starts) - (ends - starts)
        # A run of blanks before a solid piece: its last blank belongs to the next piece, but while it ends the prefix, to the run.
        blank = np.isin(units, [9, 10, 13, 32])
        j = np.flatnonzero((starts[1:] == ends[:-1]) & blank[starts[1:]] & blank[ends[:-1] - 1]) + 1
        if len(j):
            whole = table.rows_of((units, starts[j - 1], ends[j - 1] + 1))
            seen = table.flat[table.offset[whole] + table.count[whole] - 1] - steps[first[j]]
            np.add.at(steps, first[j], seen)
            np.add.at(steps, first[j] + 1, -seen)  # a solid piece follows, so there is a next code point
        sizes = ends - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        yield from np.split(steps, total[cut[1:]][:-1])


def slow_steps(table: Pieces, text: str) -> np.ndarray:
    """The same for one text with a special string or rare characters."""
    out: list[int] = []

    def plain(part: str) -> np.ndarray:
        pieces = [p for p, _ in table.split_plain(part)]
        steps = [_steps_of(table, p) for p in pieces]
        for i in range(1, len(pieces)):
            if pieces[i][0] in WHITE_SPACE and pieces[i - 1][-1] in WHITE_SPACE:
                seen = _steps_of(table, pieces[i - 1] + pieces[i][0])[-1] - steps[i][0]
                steps[i][0] += seen
                if len(steps[i]) > 1:
                    steps[i][1] -= seen
                elif i + 1 < len(pieces):
                    steps[i + 1][0] -= seen
        return np.concatenate(steps) if steps else np.empty(0, STEP)

    parts = text.split(table.special) if table.special else [text]
    for k, part in enumerate(parts):
        steps = plain(part)
        out.extend(steps.tolist())
        if k + 1 < len(parts):  # the string's beginnings are ordinary text, the whole of it is one token
            base = int(steps.sum())
            ahead = [int(plain(part + table.special[:i]).sum()) for i in range(1, len(table.special))]
            out.extend(np.diff([base, *ahead, base + 1]).tolist())
    return np.array(out, dtype=STEP)


def _steps_of(table: Pieces, piece: str) -> np.ndarray:
    units = np.array([ord(c) for c in piece], dtype=np.uint32)
    row = table.rows_of((units, np.array([0]), np.array([len(units)])))
    return table.gather(row).copy()


def token_counts(docs: DataFrame, tokenizer: str, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fit_chars (code points of the longest prefix with at most budget tokens), steps.

    steps holds two little-endian signed bytes for each code point; count_at() and cut_at() answer questions from them.
    """

    def make():
        table = step_pieces(tokenizer)

        def step(batch):
            texts = [x or "" for x in batch["text"].to_pylist()]
            total, fit, steps = [], [], []
            for s in text_steps(table, texts):
                run = np.cumsum(s, dtype=np.int64)
                total.append(int(run[-1]) if len(run) else 0)
                fit.append(_fit(run, budget))
                steps.append(s.tobytes())
            yield {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": total, "fit_chars": fit, "steps": pa.array(steps, pa.binary())}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_bytes long, n_tokens long, fit_chars long, steps binary")


def _fit(run: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most budget tokens."""
    if not len(run) or run[-1] <= budget:
        return len(run)
    fits = np.flatnonzero(run <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count_at(steps: bytes, chars: int) -> int:
    """Tokens of the first chars code points."""
    return int(np.frombuffer(steps, STEP)[:chars].sum(dtype=np.int64))


def cut_at(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most budget tokens."""
    return _fit(np.cumsum(np.frombuffer(steps, STEP), dtype=np.int64), budget)
