"""The tokenizers library behind a table of pieces: each distinct piece of text is encoded once per worker."""

from __future__ import annotations

import itertools
import os

import numpy as np

from .arrow import kept_for_stage
from .textvec import Pieces, sums_by_text


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_string(tokenizer) -> str | None:
    """The one added token that a text may hold; the vocabularies here have one at most."""
    found = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    assert len(found) <= 1, found
    return found[0] if found else None


def byte_symbols() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}


@kept_for_stage
def library_pieces(path: str) -> Pieces:
    """Pieces whose values are the ids that the library gives them."""
    from tokenizers.pre_tokenizers import WhitespaceSplit

    t, by_letters = load(path), load(path)
    # Pieces are split already, and no letter of the byte-level alphabet is a blank: spelled in it, with blanks between
    # them, they need neither the library's split nor its spelling, which cost more than its merges.
    by_letters.pre_tokenizer = WhitespaceSplit()
    letter = np.empty(256, dtype="<u2")
    for c, b in byte_symbols().items():
        letter[b] = ord(c)
    n_bytes = np.zeros(t.get_vocab_size(), dtype=np.int64)
    for token, i in t.get_vocab().items():
        n_bytes[i] = len(token)  # the byte-level alphabet has a letter for each byte

    def apart(pieces: list[str]):
        ids = [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64)

    def learn(pieces: list[str]):
        raw = np.frombuffer("".join(pieces).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        want = points[np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))]  # bytes up to each piece's end
        spelled = np.full(len(raw) + len(pieces), ord(" "), dtype="<u2")
        spelled[np.arange(len(raw)) + np.repeat(np.arange(len(pieces)), np.diff(want, prepend=0))] = letter[raw]
        ids = np.array(by_letters.encode_batch_fast([spelled.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.cumsum(n_bytes[ids])
        at = np.searchsorted(ends, want)
        if len(ends) == 0 or ends[-1] != want[-1] or (ends[at] != want).any():
            return apart(pieces)
        return ids, np.diff(at, prepend=-1)

    return Pieces(t, learn, np.uint32, special_string(t))


def values_by_text(table: Pieces, texts: list[str]):
    """Yields each text's values in the table, in order."""
    for _, _, rows, cut, *_ in table.batch(texts):
        flat = table.gather(rows)
        ends = np.cumsum(sums_by_text(table.count[rows], cut))
        yield from np.split(flat, ends[:-1]) if len(ends) else []
