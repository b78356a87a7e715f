"""Token-id output in a compressed file format: canonical length-limited Huffman codes.

Format: a folder of two Parquet tables.
  codes   id, length: the code lengths; canonical codes follow from them (shorter first, then by id).
  blocks  part, block, offset (ids of this part before the block), doc_ids, doc_n (ids of each document),
          doc_bytes (coded bytes of each), checkpoints (bit offset of each `every`-th id within its document),
          payload (the documents' bit strings, each filled up to a whole byte).
A block is decoded from its own row and the codes alone. Parts and blocks are in ascending doc_id order.

Nulls: a null text is an empty one (only the end id); a null doc_id sorts first. Equal doc_ids stay apart, in the
order of their coded bytes. An empty table gives two empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import map_batches, shared_folder, written
from .tokenizer import library_pieces, values_by_text

LIMIT = 18  # longest code in bits; the decoding table has 2**LIMIT entries
EVERY = 256  # ids between two checkpoints
BLOCK_BYTES = 1 << 17  # coded bytes after which a block is closed; a document is never split
BLOCKS = "part int, block int, offset long, n_ids long, doc_ids array<long>, doc_n array<int>, doc_bytes array<int>, checkpoints binary, payload binary"


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights, packages, levels = counts[order].astype(np.float64), np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        packages = both[by][: len(by) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in code order, code of each of these rows)."""
    order = np.lexsort((ids, lengths))
    n = lengths[order]
    slots = (1 << (int(n.max()) - n)).astype(np.int64) if len(n) else n
    return order, (np.cumsum(slots) - slots) >> (int(n.max()) - n) if len(n) else n


class Coder:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order, codes = canonical(ids, lengths)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.code[ids[order]], self.length[ids] = codes, lengths
        self.bits = int(lengths.max()) if len(lengths) else 1
        self.symbol, self.step = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        spread = 1 << (self.bits - lengths[order])
        self.symbol[: spread.sum()] = np.repeat(ids[order], spread)
        self.step[: spread.sum()] = np.repeat(lengths[order], spread)

    def encode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, bytes of each document, bit offsets of every EVERY-th id) of documents of n ids each."""
        length = self.length[ids]
        ends = np.cumsum(length)
        doc = np.repeat(np.arange(len(n)), n)
        last = np.cumsum(n)
        before = np.concatenate([[0], ends])[last - n]
        size = (np.concatenate([[0], ends])[last] - before + 7) // 8
        at = ends - length - before[doc]  # within the document
        marks = at[(np.arange(len(ids)) - (last - n)[doc]) % EVERY == 0]
        at += ((np.cumsum(size) - size) * 8)[doc]
        words = np.zeros(int(size.sum()) // 8 + 2, dtype=np.uint64)
        word, room = at >> 6, 64 - (at & 63) - length
        code = self.code[ids]
        inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.add.reduceat(inside, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").view(np.uint8)[: int(size.sum())], size, marks

    def decode(self, payload: np.ndarray, start_bit: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of all documents: each starts at its bit and has n ids. start_bit: of each checkpoint."""
        lanes = -(-n // EVERY)
        left = np.full(int(lanes.sum()), EVERY)
        left[np.cumsum(lanes) - 1] = n - (lanes - 1) * EVERY  # every document has an id at least
        b = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        out, to, at = np.empty(int(n.sum()), np.uint32), np.cumsum(left) - left, start_bit.astype(np.int64)
        order = np.argsort(-left, kind="stable")
        left, to, at = left[order], to[order], at[order]
        shift = np.uint32(32 - self.bits)
        for i in range(int(left[0]) if len(left) else 0):
            k = int(np.searchsorted(-left, -i))  # lanes with more than i ids
            a = at[:k]
            key = (window[a >> 3] << (a & 7).astype(np.uint32)) >> shift
            out[to[:k] + i] = self.symbol[key]
            at[:k] = a + self.step[key]
        return out


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids: every whole text as the library encodes it, the end id appended; two or four little-endian bytes an id."""

    def make():
        table = library_pieces(tokenizer)
        kind = np.dtype("<u2" if table.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")

        def step(batch):
            texts = [x or "" for x in batch["text"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "width": [kind.itemsize] * len(texts), "ids": [np.append(x, end_id).astype(kind).tobytes() for x in values_by_text(table, texts)]}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, width int, ids binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    got = [np.frombuffer(x, dtype=f"<u{w}") for x, w in zip(batch["ids"].to_pylist(), batch["width"].to_pylist(), strict=True)]
    return (np.concatenate(got).astype(np.int64) if got else np.empty(0, np.int64)), np.array([len(x) for x in got], dtype=np.int64)


def id_counts(coded: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all documents. Counted within tasks, then summed: no task gets more than the vocabulary's rows from each."""

    def make():
        def step(batch):
            ids, _ = _flat(batch)
            got, n = np.unique(ids, return_counts=True) if len(ids) < 1000 else ((c := np.bincount(ids)).nonzero()[0], c[c > 0])
            yield {"id": got.astype(np.int64), "n": n.astype(np.int64)}

        return step

    return map_batches(coded.select("width", "ids"), make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, limit: int = LIMIT) -> None:
    """Encode docs(doc_id, text) and write the format above to path."""
    spark = docs.sparkSession
    coded = written(encode_ids(docs, tokenizer, end_id))
    counts = id_counts(coded).toPandas()  # one row for each id of the vocabulary at most
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    lengths = limited_lengths(n, limit)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, lengths, strict=True)], "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Each part is a range of doc_ids. Bounds come from the ids alone, so that nothing is coded twice to sample it.
    at = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    bounds = np.unique(np.array(coded.agg(F.percentile_approx("doc_id", at, 100 * parts)).first()[0] or [], dtype=np.int64))
    shared = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    def code():
        coder = Coder(*shared.value)

        def step(batch):
            flat, n = _flat(batch)
            payload, size, marks = coder.encode(flat, n)
            cut, lanes = np.cumsum(size), np.cumsum(-(-n // EVERY))
            doc_ids = batch["doc_id"].fill_null(-(1 << 63)).to_numpy()
            yield {"to": np.searchsorted(bounds, doc_ids).astype(np.int32), "doc_id": batch["doc_id"], "n": n.astype(np.int32), "marks": [x.astype("<u4").tobytes() for x in np.split(marks, lanes[:-1])], "payload": [x.tobytes() for x in np.split(payload, cut[:-1])]}

        return step

    def pack():
        part, block, offset = -1, 0, 0

        def step(batch):
            nonlocal part, block, offset
            n, sizes = batch["n"].to_numpy(), np.array([len(x) for x in batch["payload"].to_pylist()], dtype=np.int64)
            of = batch["to"].to_numpy()
            number = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
            edges = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (of[1:] != of[:-1]), [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if of[a] != part:
                    part, block, offset = int(of[a]), 0, 0
                total = int(n[a:b].sum())
                yield {"part": [part], "block": [block], "offset": [offset], "n_ids": [total], "doc_ids": [batch["doc_id"][a:b].to_pylist()], "doc_n": [n[a:b]], "doc_bytes": [sizes[a:b].astype(np.int32)], "checkpoints": [b"".join(batch["marks"][a:b].to_pylist())], "payload": [b"".join(batch["payload"][a:b].to_pylist())]}
                block, offset = block + 1, offset + total

        return step

    small = map_batches(coded, code, "to int, doc_id long, n int, marks binary, payload binary")
    ordered = small.repartitionById(parts, F.col("to")).sortWithinPartitions("to", F.col("doc_id").asc_nulls_first(), "payload")
    map_batches(ordered, pack, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), decoded from the files."""
    codes = spark.read.schema("id long, length int").parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((codes["id"].to_numpy(np.int64), codes["length"].to_numpy(np.int64)))
    blocks = spark.read.schema(T.StructType.fromDDL(BLOCKS)).parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def make():
        coder = Coder(*shared.value)

        def step(batch):
            for a in range(0, batch.num_rows, 16):
                yield decode(batch.slice(a, 16))

        def decode(rows):
            n = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["doc_n"].to_pylist()])
            size = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["doc_bytes"].to_pylist()])
            marks = np.frombuffer(b"".join(rows["checkpoints"].to_pylist()), dtype="<u4").astype(np.int64)
            payload = np.frombuffer(b"".join(rows["payload"].to_pylist()), dtype=np.uint8)
            start_bit = marks + np.repeat((np.cumsum(size) - size) * 8, -(-n // EVERY))
            ids = coder.decode(payload, start_bit, n)
            start = []
            for base, off, k in zip(rows["base"].to_pylist(), rows["offset"].to_pylist(), rows["doc_n"].to_pylist(), strict=True):
                start.append(base + off + np.cumsum(k) - k)
            docs = [d for x in rows["doc_ids"].to_pylist() for d in x]
            return {"doc_id": docs, "start": np.concatenate(start).astype(np.int64), "n_tokens": n, "ids": [x.tobytes() for x in np.split(ids.astype("<u4"), np.cumsum(n)[:-1])]}

        return step

    return map_batches(blocks.drop("block", "n_ids").join(parts, "part").drop("part"), make, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write docs as token files (to a new shared folder by default) and read them back."""
    path = path or shared_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
