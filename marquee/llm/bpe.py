"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, failing words are merged exactly.

A run of tokens is what BPE makes of its bytes if and only if each token is what BPE makes of its own bytes and each
adjacent pair is what BPE makes of the pair's bytes. Pairs are checked for a whole batch at once by undoing merges on
both sides of the boundary, latest first, and looking for a merge across it that would have come earlier.

Nulls: a null text is an empty one; an empty text has no ids. Repeated rows stay. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import kept_for_stage, map_batches
from .textvec import BASE, INVERSE, U64, Pieces, _power, mix, sums_by_text
from .tokenizer import byte_symbols, load, special_string, values_by_text

NEVER = np.int64(1) << 40
MOST_PIECES = 700_000  # that a worker remembers
SHORT = 64  # bytes of a word that the vectorised forms take; longer ones are merged alone


class Merges:
    """A vocabulary's merges as arrays by token id: rank (-1 for a byte), left and right part, bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        alphabet = byte_symbols()
        self.size = max([*vocab.values(), *(x["id"] for x in whole["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for text, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in text)
        for x in whole["added_tokens"]:
            self.bytes[x["id"]] = x["content"].encode()
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.arange(self.size, dtype=np.int64)
        self.right = np.arange(self.size, dtype=np.int64)
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair[i, j] = (r, k)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        keys = np.array([i * self.size + j for i, j in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.pair.values()], dtype=np.int64)[order]
        self.made = np.zeros(len(merges), dtype=np.int64)  # what the merge of each rank makes
        for r, k in self.pair.values():
            self.made[r] = k
        self._words()

    def _words(self):
        """Tokens by the hash of their bytes; only those that BPE makes of their own bytes."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.zeros(self.size, dtype=bool)
        good[self.byte_id] = True
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in sorted(made, key=self.rank.__getitem__):  # parts come before what they make
            good[i] &= good[self.left[i]] and good[self.right[i]]
        ids = np.flatnonzero(good)
        self.by_bytes = {self.bytes[i]: int(i) for i in ids}
        raw = np.frombuffer(b"".join(self.bytes[i] for i in ids), dtype=np.uint8)
        n = np.array([len(self.bytes[i]) for i in ids], dtype=np.int64)
        self.longest = int(n.max())
        ends = np.cumsum(n)
        keys = mix(self._span(prefix_sums(raw), ends - n, ends) + n.astype(U64))
        order = np.argsort(keys)
        self.word_keys, self.word_ids = keys[order], ids[order]
        n_all = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat, self.n_bytes, self.at = np.frombuffer(b"".join(self.bytes), dtype=np.uint8), n_all, np.cumsum(n_all) - n_all

    @staticmethod
    def _span(sums, starts, ends):
        return (sums[ends] - sums[starts]) * _power(INVERSE, len(sums))[starts]

    def find(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token ids of the spans, or -1."""
        keys = mix(self._span(sums, starts, ends) + (ends - starts).astype(U64))
        at = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        return np.where(self.word_keys[at] == keys, self.word_ids[at], -1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE keeps a boundary between tokens a and b: for good, or until the merge of rank until."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        over_x, over_y = limit.copy(), limit + (until is None)  # when x, or y, becomes part of more; y's tie comes after
        while len(live):
            m = self.pair_rank(x, y)
            ok[live] = (crosses := (m < over_x) & (m < over_y)) == 0
            undo_y = self.rank[y] >= self.rank[x]  # of equal merges the left one came first
            ended = crosses | ((self.rank[x] < 0) & (self.rank[y] < 0))
            over_x, over_y = np.where(undo_y, over_x, self.rank[x]), np.where(undo_y, self.rank[y] + 1, over_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
            keep = ~ended
            live, x, y, over_x, over_y = live[keep], x[keep], y[keep], over_x[keep], over_y[keep]
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: always the pair of lowest rank, the leftmost of equal ones."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) <= SHORT:
            while len(ids) > 1:
                rank, i = min((self.pair.get(p, (NEVER,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
                if rank == NEVER:
                    break
                ids[i : i + 2] = [self.pair[ids[i], ids[i + 1]][1]]
            return ids
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(self.pair[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.pair[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (ids[p], ids[q]) in self.pair:
                    heapq.heappush(heap, (self.pair[ids[p], ids[q]][0], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words of at most SHORT bytes: in each round every word's first pair of lowest rank."""
        out: list[np.ndarray] = [None] * len(words)
        n_all = np.array([len(w) for w in words], dtype=np.int64)
        by_length = np.argsort(n_all, kind="stable")
        for rows in np.split(by_length, np.searchsorted(n_all[by_length], [7, 9, 12, 17, 33])):
            if not len(rows):
                continue
            n, width = n_all[rows], int(n_all[rows].max())
            at = np.arange(width)
            ids = np.full((len(rows), width + 1), 0, dtype=np.int64)
            ids[:, :width][at < n[:, None]] = np.array(self.byte_id)[np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8)]
            rank = np.where(at < n[:, None] - 1, self.pair_rank(ids[:, :-1], ids[:, 1:]), NEVER)
            rank = np.concatenate([rank, np.full((len(rows), 1), NEVER)], axis=1)
            live = np.arange(len(rows))
            while len(live):
                here = rank[live]
                j = here.argmin(1)
                least = here[np.arange(len(live)), j]
                going = least < NEVER
                live, j, least, here = live[going], j[going], least[going], here[going]
                if not len(live):
                    break
                k, col = np.arange(len(live)), np.arange(width)
                own = ids[live]
                own[k, j] = self.made[least]
                moved = col + (col > j[:, None])
                own[:, :width], here[:, :width] = np.take_along_axis(own, moved, 1), np.take_along_axis(here, moved, 1)
                n[live] -= 1
                left = np.flatnonzero(j > 0)
                here[left, j[left] - 1] = self.pair_rank(own[left, j[left] - 1], own[left, j[left]])
                here[k, j] = np.where(j < n[live] - 1, self.pair_rank(own[k, j], own[k, j + 1]), NEVER)
                ids[live], rank[live] = own, here
            for i, x, m in zip(rows, ids, n, strict=True):
                out[i] = x[:m]
        return out

    def greedy(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) by longest match; spans of the bytes that sums belongs to."""
        words, found = [], []
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            left = end[live] - at[live]
            token, n = np.full(len(live), -1, dtype=np.int64), np.ones(len(live), dtype=np.int64)
            for size in range(min(self.longest, int(left.max())), 0, -1):
                i = np.flatnonzero((token < 0) & (left >= size))
                if len(i):
                    got = self.find(sums, at[live[i]], at[live[i]] + size)
                    token[i], n[i] = got, np.where(got >= 0, size, n[i])
            words.append(live)
            found.append(token)
            at[live] += n
            live = live[at[live] < end[live]]
        w, f = np.concatenate(words), np.concatenate(found)
        order = np.argsort(w, kind="stable")
        return f[order], np.bincount(w, minlength=len(start))

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each word has, words that had to be merged) for words of at most SHORT bytes."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = np.array([len(w) for w in words], dtype=np.int64)
        end = np.cumsum(n)
        ids, count = self.greedy(prefix_sums(raw), end - n, end)
        owner = np.repeat(np.arange(len(words)), count)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.unique(owner[inside[~self.compatible(ids[inside], ids[inside + 1])]])
        return ids, count, failed

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        parts: list[np.ndarray | None] = [None] * len(raw)
        short = [i for i, w in enumerate(raw) if 0 < len(w) <= SHORT]
        if short:
            ids, count, failed = self.speculate([raw[i] for i in short])
            for i, x in zip(short, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                parts[i] = x
            for k, x in zip(failed, self.merged_together([raw[short[k]] for k in failed]), strict=True):
                parts[short[k]] = x
        for i, x in enumerate(parts):
            if x is None:
                parts[i] = np.array(self.merged(raw[i]), dtype=np.int64)
        return np.concatenate(parts).astype(np.uint32), [len(x) for x in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.n_bytes[ids]
        return self.flat[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.empty(len(raw) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * _power(BASE, len(raw)), out=sums[1:])
    return sums


@kept_for_stage
def merges(path: str) -> Merges:
    return Merges(path)


@kept_for_stage
def bpe_pieces(path: str) -> Pieces:
    """Pieces whose values are ids by speculation; the special string has its own id."""
    m, library = merges(path), load(path)
    special = special_string(library)

    def learn(pieces: list[str]):
        if special in pieces:
            k = pieces.index(special)
            a, b = (learn(x) if x else (np.empty(0, np.uint32), []) for x in (pieces[:k], pieces[k + 1 :]))
            return np.concatenate([a[0], np.array([library.token_to_id(special)], np.uint32), b[0]]), [*a[1], 1, *b[1]]
        return m.encode_words(pieces)

    return Pieces(library, learn, np.uint32, special, MOST_PIECES)


def encode(docs: DataFrame, tokenizer: str, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (null unless asked for) for docs(doc_id, text)."""

    def make():
        m, table = merges(tokenizer), bpe_pieces(tokenizer)

        def step(batch):
            ids = list(values_by_text(table, [x or "" for x in batch["text"].to_pylist()]))
            back = pa.array([m.decode(x).decode("utf-8", "replace") if decoded else None for x in ids], pa.string())
            yield {"doc_id": batch["doc_id"], "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids], "decoded": back}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids binary, decoded string")
