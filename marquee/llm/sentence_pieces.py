"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of whitespace markers with what follows it up to the next run, or a run of line feeds with what follows.
Where no piece of a model crosses from a character to a marker or a line feed after it, nothing that the model does in one
chunk depends on another: each distinct chunk of a task's texts is segmented once, and the texts' ids are gathered from
the table by position. A model with such a piece gets whole texts as chunks, which is the same result at more cost.
The table starts anew beyond MOST_CHUNKS, so a worker's memory doesn't grow with the corpus; nothing is shuffled, and a
lost task is repeated from its own rows.

Nulls: a null text is an empty one; an empty text has no ids; a null doc_id stays null. Repeated rows stay, and so do ties.
Very long texts are taken whole, one at a time. An empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import kept_for_stage, map_batches
from .textvec import Pieces, in_chunks, sums_by_text

MARKER, BLANK, LINE_FEED = "▁", 32, 10
MOST_CHUNKS = 700_000


class Model:
    """A SentencePiece model's segmentation of single chunks, and its pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = m.encode("a  b ") and m.decode(m.encode(" a  b ")) == " a  b "  # blanks are neither dropped nor joined
        if not plain or m.encode("a") != m.encode("b a")[-len(m.encode("a")) :]:
            raise ValueError("the model must keep blanks and put a marker before a text")
        self.marker = m.piece_to_id(MARKER)
        self.apart = not any(MARKER in x.lstrip(MARKER) or "\n" in x for x in pieces)
        spelled = [b"" if m.is_control(i) else bytes([int(x[3:5], 16)]) if m.is_byte(i) else " ⁇ ".encode() if m.is_unknown(i) else x.replace(MARKER, " ").encode() for i, x in enumerate(pieces)]
        self.n_bytes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.flat, self.at = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum(self.n_bytes) - self.n_bytes
        self.leads = np.array([x.startswith(MARKER) for x in pieces])

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The library puts a marker before what it gets: it stands for a chunk's own first one."""
        led = [c[0] in (MARKER, " ") for c in chunks]
        got = self.model.encode([c[1:] if x else c for c, x in zip(chunks, led, strict=True)], num_threads=1)
        return [(ids or [self.marker]) if x else ids[1:] for ids, x in zip(got, led, strict=True)]

    def spans(self, units: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of texts that begin at edges[:-1] with a marker of their own."""
        start = np.zeros(len(units) + 1, dtype=bool)
        start[edges] = True
        if self.apart:
            for mark in ((units == BLANK) | (units == ord(MARKER)), units == LINE_FEED):
                start[1:-1] |= mark[1:] & ~mark[:-1]
        start[-1] = True
        at = np.flatnonzero(start)
        return at[:-1], at[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        """What the library's decode gives: the pieces' bytes, without the marker before a text."""
        if not len(ids):
            return b""
        n = self.n_bytes[ids]
        out = self.flat[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        return out[1:] if self.leads[ids[0]] else out


@kept_for_stage
def model_of(path: str) -> Model:
    return Model(path)


@kept_for_stage
def chunk_table(path: str) -> Pieces:
    """Distinct chunks whose values are their ids."""
    model = model_of(path)

    def learn(chunks: list[str]):
        ids = model.segment(chunks)
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32), list(map(len, ids))

    return Pieces(None, learn, np.int32, None, MOST_CHUNKS)


def ids_by_text(model: Model, table: Pieces, texts: list[str]):
    """Yields (first, last, ids of texts[first:last] one after another, how many each has)."""
    for a, b in in_chunks(texts):
        if table.rows > table.most:
            table.clear()
        part = [" " + t if t else "" for t in texts[a:b]]
        units = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        edges = np.cumsum([0, *map(len, part)])
        if not len(units):
            yield a, b, np.empty(0, np.int32), np.zeros(b - a, np.int64)
            continue
        starts, ends = model.spans(units, edges)
        rows = table.rows_of((units, starts, ends))
        yield a, b, table.gather(rows), sums_by_text(table.count[rows], np.searchsorted(starts, edges))


def encode(docs: DataFrame, model_file: str, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded (null unless asked for), one row for each row of docs(doc_id, text)."""

    def make():
        model, table = model_of(model_file), chunk_table(model_file)

        def step(batch):
            for a, b, ids, n in ids_by_text(model, table, [x or "" for x in batch["text"].to_pylist()]):
                ends = np.cumsum(n)
                back = [model.decode(x).decode("utf-8", "replace") for x in np.split(ids, ends[:-1])] if decoded else [None] * (b - a)
                yield {"doc_id": batch["doc_id"][a:b], "n_tokens": n, "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(back, pa.string())}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids array<int>, decoded string")


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text for coded(doc_id, ids array<int>), as the library decodes them; null ids are none. Ids outside the model raise an error."""

    def make():
        model = model_of(model_file)

        def step(batch):
            texts = [model.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())}

        return step

    return map_batches(coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), make, "doc_id long, text string")
