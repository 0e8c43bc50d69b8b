"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The tokens and their order come from a public vocabulary file; the model gives rank r the Zipf-Mandelbrot weight
1 / (r + OFFSET). The count of a pre-token is the number of tokens in its likeliest segmentation (the fewest tokens among
equally likely ones). New distinct pre-tokens of a batch are inserted in a trie, and the trie is walked once: a node holds
the forward score and count of its prefix, computed from its ancestors' once for all pre-tokens that share the prefix, and
a terminal node's count is stored under its pre-token in a bounded memo.

Cases: a null or empty text has no tokens; every byte is a token, so any text can be segmented.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import clean, splitter
from .common import map_rows, table

OFFSET = 2.7
MEMO_ENTRIES, MEMO_BYTES = 600_000, 64


class Unigram:
    def __init__(self, score: dict[str, float]):
        """score: byte strings (as Latin-1) -> logarithm of the weight."""
        self.score = score
        self.longest = max(map(len, score))
        self.counts: dict[str, int] = {}

    def count_all(self, pieces: set[str]) -> dict[str, int]:
        """Counts of distinct byte strings, each trie node visited once."""
        root: dict = {}
        for piece in pieces:
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece  # terminal
        found, score, longest = {}, self.score, self.longest
        prefix, best, tokens = "", [0.0], [0]  # forward scores and counts of the prefixes on the way down
        stack = [(0, "", root)]
        while stack:
            depth, c, node = stack.pop()
            if depth:
                prefix = prefix[: depth - 1] + c
                del best[depth:], tokens[depth:]
                top, n = -math.inf, 0
                for start in range(max(0, depth - longest), depth):
                    s = score.get(prefix[start:])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and tokens[start] + 1 < n:
                            top, n = s, tokens[start] + 1
                best.append(top)
                tokens.append(n)
            for c, below in node.items():
                if c:
                    stack.append((depth + 1, c, below))
                else:
                    found[below] = tokens[depth]
        return found

    def count_texts(self, texts: list[list[str]]) -> list[int]:
        """Tokens in each list of pre-tokens."""
        known = self.counts
        if len(known) > MEMO_ENTRIES:
            known.clear()
        new = {p: p.encode("utf-8").decode("latin-1") for p in set().union(*texts).difference(known)}
        counted = self.count_all(set(new.values()))
        fresh = {p: counted[raw] for p, raw in new.items()}
        short = {p: n for p, n in fresh.items() if len(p) <= MEMO_BYTES}
        known.update(short)
        long = {p: n for p, n in fresh.items() if len(p) > MEMO_BYTES}
        if long:
            return [sum(long[p] if p in long else known[p] for p in pieces) for pieces in texts]
        return [sum(map(known.__getitem__, pieces)) for pieces in texts]


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Unigram({s: -math.log(r + OFFSET) for s, r in ranks.items()})


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN, texts_at_once: int = 256) -> DataFrame:
    """id_col, n_pretokens and n_tokens of every row."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, split = load(where), splitter(pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(lo, texts_at_once)
                pieces = [split(clean(x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, pieces), pa.int64()), pa.array(model.count_texts(pieces), pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    return map_rows(named, run, f"id {named.schema['id'].dataType.simpleString()}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op4_token_counts(spark, sf_dir):
    """Unigram token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
