"""Vectorised text splitting for Arrow batches: words, and byte-level-BPE pieces.

Both splitters work on one concatenated array for many texts, so a batch costs a
handful of numpy passes. Strings are compared through 64-bit polynomial hashes; spans
longer than LONG units take xxhash instead, because a polynomial modulo 2**64 is only
known to behave well on short strings.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LONG = 64
CHUNK = 600_000  # units of text handled at once; one longer text is handled alone

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 65536), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span units[start:end]."""
    sums = np.empty(len(units) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((units.astype(U64) + U64(1)) * _power(BASE, len(units)), out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * _power(INVERSE, len(units) + 1)[starts])
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh64_intdigest(units[starts[i] : ends[i]].tobytes())
    return out


def in_chunks(texts: list[str], size=len):
    """Runs (first, last) of texts that stay near CHUNK units together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = size(t)
        if total and total + n > CHUNK:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(texts):
        yield first, len(texts)


# ---------------------------------------------------------------- words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words before each text) for words [^\\x20\\x09-\\x0D]+."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    gap = _SPACE[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return raw, starts, ends, np.searchsorted(starts, edges)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text); lower: A-Z count as a-z."""
    raw, starts, ends, cut = word_spans(texts)
    return span_hashes(_LOWER[raw] if lower else raw, starts, ends), cut


_MIXERS = [U64(pow(BASE, 3 + 2 * i, 1 << 64)) for i in range(16)]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashed word shingles; fewer words than width: the whole sequence."""
    out: list[np.ndarray] = []
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in in_chunks(coded):
        w, cut = words(coded[a:b])
        rolled = np.zeros(max(0, len(w) - width + 1), dtype=U64)
        for i in range(width):
            rolled += w[i : len(w) - width + 1 + i] * _MIXERS[i]
        rolled = mix(rolled)
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s >= width:
                out.append(np.unique(rolled[s : e - width + 1]))
            elif e > s:
                seed = np.array([e - s], dtype=U64)
                for i in range(s, e):
                    seed = mix(seed * _MIXERS[1] + w[i : i + 1])
                out.append(seed)
            else:
                out.append(np.empty(0, dtype=U64))
    return out


# ---------------------------------------------------------------- pieces of a byte-level BPE

LETTER, NUMBER, OTHER, BLANK, WHITE, END, ODD = 1, 2, 3, 4, 5, 8, 9
_FAST = 0x250


def _classes() -> np.ndarray:
    """Classes of code points below _FAST. Rarer controls and blanks are left to the library (ODD)."""
    out = np.full(_FAST + 1, ODD, dtype=np.uint8)
    for c in [9, 10, 13, *range(32, 127), *range(0xA1, _FAST)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 13]], out[32], out[0] = WHITE, BLANK, END
    return out


_CLASS = _classes()


def piece_spans(units: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pieces in units, texts that are each closed by an END.

    Splits as 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    white = (kind == BLANK) | (kind == WHITE)
    before = np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    after = np.empty_like(kind)
    after[-1], after[:-1] = END, kind[1:]
    white_before = (before == BLANK) | (before == WHITE)
    solid_after = (after >= LETTER) & (after <= OTHER)
    start = np.where(white, ~white_before | solid_after, (kind != before) & (before != BLANK))
    start |= kind == END
    for i in np.flatnonzero((units == 39) & (before != BLANK) & (before != OTHER) & (after == LETTER)):
        a, b = chr(units[i + 1]), units[i + 2]
        n = 2 if a in "stmd" else 3 if (a, chr(b)) in (("r", "e"), ("v", "e"), ("l", "l")) else 0
        if n:
            start[i + 1 : i + n] = False
            start[i + n] = True
    at = np.flatnonzero(start)
    keep = kind[at] != END
    keep[-1] = False
    return at[keep], at[1:][keep[:-1]]


class Pieces:
    """Splits texts and gives each distinct piece a row in a growing table.

    learn(pieces) -> (values of all new pieces one after another, how many each has).
    The table starts anew beyond most entries, so a worker's memory is bounded.
    """

    def __init__(self, tokenizer, learn, dtype, special: str | None, most: int = 2_000_000):
        self.tokenizer, self.learn, self.dtype, self.most = tokenizer, learn, dtype, most
        self.special = special
        self.clear()

    def clear(self):
        self.key, self.slot = np.empty(1024, dtype=U64), np.full(2048, -1, dtype=np.int32)  # key of each row; rows by key, open addressing
        self.flat, self.used = np.empty(1024, dtype=self.dtype), 0
        self.offset, self.count, self.rows = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0

    def _add(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        flat, n = self.learn(pieces)
        n = np.asarray(n, dtype=np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(n) > len(self.offset):
            self.key, self.offset, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.offset, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        new = np.arange(self.rows, self.rows + len(n))
        self.offset[new] = self.used + np.cumsum(n) - n
        self.count[new] = n
        self.used += len(flat)
        self.key[new] = keys
        self.rows += len(n)
        if 2 * self.rows > len(self.slot):
            self.slot = np.full(2 * len(self.key), -1, dtype=np.int32)
            self._place(np.arange(self.rows))
        else:
            self._place(new)
        return new

    def _place(self, rows: np.ndarray) -> None:
        """Give each of these rows, whose keys differ, the first free slot from its key on."""
        mask = len(self.slot) - 1
        at = (self.key[rows] & U64(mask)).astype(np.int64)
        while len(rows):
            free = self.slot[at] < 0
            self.slot[at[free]] = rows[free]
            lost = self.slot[at] != rows
            rows, at = rows[lost], (at[lost] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        mask = len(self.slot) - 1
        out, left, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), (keys & U64(mask)).astype(np.int64)
        while len(left):
            row = self.slot[at]
            taken = row >= 0
            left, at, row = left[taken], at[taken], row[taken]
            other = self.key[row] != keys[left]
            out[left[~other]] = row[~other]
            left, at = left[other], (at[other] + 1) & mask
        return out

    def _rows(self, keys: np.ndarray, fetch) -> np.ndarray:
        codes, distinct = pd.factorize(keys)
        rows = self._find(distinct)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            first = np.empty(len(distinct), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            rows[missing] = self._add(distinct[missing], fetch(first[missing]))
        return rows[codes]

    def rows_of(self, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Table rows of any spans (units, starts, ends)."""
        u, s, e = spans

        def fetch(at):
            n = e[at] - s[at]
            ends = np.cumsum(n)
            text = u[np.repeat(s[at] - (ends - n), n) + np.arange(int(n.sum()))].tobytes().decode("utf-32-le", "surrogatepass")
            return [text[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]

        return self._rows(span_hashes(u, s, e), fetch)

    def slow(self, text: str) -> list[str]:
        """The library's own split, special strings apart."""
        parts = re.split(f"({re.escape(self.special)})", text) if self.special else [text]
        out = []
        for p in parts:
            out += [p] if p == self.special else [x for x, _ in self.split_plain(p)]
        return out

    def split_plain(self, text: str):
        if not text:
            return []
        return [(text[a:b], (a, b)) for _, (a, b) in _merged(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))]

    def batch(self, texts: list[str]):
        """Yields (first, last, rows of the pieces, pieces before each text, starts, ends, units) by chunk of texts.

        units: the chunk's code points; None where one text took the slow split.
        """
        if self.rows > self.most:
            self.clear()
        for a, b in in_chunks(texts):
            part = texts[a:b]
            units = np.frombuffer("".join([t + "\0" for t in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            kind = _CLASS[np.minimum(units, _FAST)]
            edges = np.cumsum([0, *(len(t) + 1 for t in part)])
            odd = np.add.reduceat(kind == ODD, edges[:-1]) > 0
            odd |= np.add.reduceat(kind == END, edges[:-1]) > 1
            hard = {i for i, t in enumerate(part) if odd[i] or (self.special and self.special in t)}
            if hard:
                yield from self._mixed(a, part, hard)
                continue
            starts, ends = piece_spans(units, kind)
            rows = self.rows_of((units, starts, ends))
            yield a, b, rows, np.searchsorted(starts, edges), starts, ends, units

    def _mixed(self, a: int, part: list[str], hard: set[int]):
        """Chunks with texts that the fast split can't take: those one by one, the runs between them as ever."""
        i = 0
        while i < len(part):
            if i in hard:
                pieces = self.slow(part[i])
                lengths = np.array([len(p) for p in pieces], dtype=np.int64)
                ends = np.cumsum(lengths)
                keys = np.array([xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), seed=7) for p in pieces], dtype=U64)
                rows = self._rows(keys, lambda at, p=pieces: [p[j] for j in at]) if pieces else np.empty(0, np.int64)
                yield a + i, a + i + 1, rows, np.array([0, len(pieces)]), ends - lengths, ends, None
                i += 1
                continue
            j = i
            while j < len(part) and j not in hard:
                j += 1
            for x, y, *rest in self.batch(part[i:j]):
                yield a + i + x, a + i + y, *rest
            i = j

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The values of these rows, one after another."""
        n = self.count[rows].astype(np.int64)
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.offset[rows] - before, n) + np.arange(int(n.sum()))]


def _merged(pieces):
    """Pre-tokens by character span: a character's bytes are never parted."""
    return [(p, (a, b)) for p, (a, b) in pieces if b > a]


def sums_by_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum of values[cut[i]:cut[i+1]] for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cut[1:]] - total[cut[:-1]]
