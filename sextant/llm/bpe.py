"""Exact byte-level BPE encoding and decoding in time linear in the text, from a file of ranks.

A text is cut into pre-tokens by a pattern; each distinct pre-token is encoded once per worker while it stays in a bounded
memo. Bytes map to Latin-1 characters, so that an Aho-Corasick automaton over strings serves: it holds the reversed tokens
and, run over a reversed pre-token, gives the longest token that starts at each byte. Encoding then takes longest matches
and backtracks: a token may follow another only if the merges would leave the two apart, which is tested by undoing merges
on both sides and memoised for each pair; a place that has been left behind in vain is not entered again. The only
sequence in which all neighbours are compatible is the one that the merges in rank order produce.

Cases: a null text is an empty one, which has no tokens; any valid text can be encoded, as every byte is a token; unpaired
surrogates become U+FFFD first, as the reference encoders do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Pre-tokens that a worker remembers at most, and the length up to which it does; longer ones are encoded each time.
MEMO_ENTRIES, MEMO_BYTES = 400_000, 64
#: Pairs of tokens whose compatibility a worker remembers at most.
PAIR_ENTRIES = 500_000


class BytePairs:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.token[i] = piece
        text = {i: piece.decode("latin-1") for piece, i in ranks.items()}
        self.by_text = {s: i for i, s in text.items()}
        self.shorter = {i: self._longest_prefix(s) for i, s in text.items()}
        self.left, self.right = list(range(len(self.token))), list(range(len(self.token)))
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        for i in sorted(text):
            self._find_split(i, text[i])
        self.apart.clear()  # what was known while merges were missing may not hold
        self.automaton = ahocorasick.Automaton()
        for i, s in text.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()

    def _longest_prefix(self, s: str) -> int:
        for n in range(len(s) - 1, 0, -1):
            if (i := self.by_text.get(s[:n])) is not None:
                return i
        return -1

    def _find_split(self, i: int, s: str) -> None:
        """The pair whose merge makes token i: two older tokens that stay apart until then."""
        a = self.shorter[i]
        while a >= 0:
            b = self.by_text.get(s[len(self.token[a]) :])
            if b is not None and a < i and b < i and self._stay_apart(a, b):
                self.merged[a, b], self.left[i], self.right[i] = i, a, b
                return
            a = self.shorter[a]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a followed by b gives these two tokens. The last merge inside either is undone in
        turn, the younger first; a merge across the border that is older than the one undone would have come before it."""
        limit = 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:  # a single byte: undo b instead
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= PAIR_ENTRIES:
                self.apart.clear()
            known = self.apart[a, b] = self._stay_apart(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, token, shorter = len(piece), self.token, self.shorter
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or len(token[longest[at]]) < len(token[i]):
                longest[at] = i
        open_at, out, at, following = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while at < n:
            end = at + len(token[following])
            if open_at[end] and (not out or self.compatible(out[-1], following)):
                out.append(following)
                at, following = end, longest[end]
            elif shorter[following] >= 0:
                following = shorter[following]
            else:
                open_at[at] = 0
                following = out.pop()
                at -= len(token[following])
        return out


class Memo(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = np.array(self.pairs.encode_piece(raw), "<u4").tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def load(path: str) -> tuple[BytePairs, Memo]:
    with open(path, "rb") as f:
        pairs = BytePairs({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
    return pairs, Memo(pairs)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern).findall


def clean(text: str | None) -> str:
    text = text or ""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def encode(text: str | None, path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(map(load(path)[1].__getitem__, splitter(pattern)(clean(text))))


def decode(ids: bytes, path: str) -> bytes:
    return b"".join(map(load(path)[0].token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_table(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col and `ids`: binary, little-endian unsigned 32-bit integers."""
    return _mapped(df, id_col, text_col, path, "ids binary", lambda p: lambda texts: [pa.array((encode(x, p, pattern) for x in texts), pa.binary())])


def decode_table(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """id_col and `bytes`: what the ids stand for."""
    return _mapped(df, id_col, ids_col, path, "bytes binary", lambda p: lambda cells: [pa.array((decode(x or b"", p) for x in cells), pa.binary())])


def _mapped(df: DataFrame, id_col: str, col: str, path: str | None, schema: str, columns) -> DataFrame:
    named = df.select(F.col(id_col).alias("id"), F.col(col).alias("cell"))
    make, names = columns(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), ["id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(part.column(1).to_pylist())], names=names)

    return map_rows(named, run, f"id {named.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark, sf_dir):
    """Every document encoded, and its ids decoded again, with digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode_table(table(spark, sf_dir, "documents"), "doc_id", "text", path)

    def digests(cells: list[bytes]) -> list[pa.Array]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in cells], pa.int64()), pa.array([sha(x) for x in cells]), pa.array([sha(decode(x, path)) for x in cells])]

    return _mapped(ids, "doc_id", "ids", path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda p: digests)
