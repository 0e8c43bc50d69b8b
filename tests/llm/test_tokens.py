import base64
import hashlib
import math
import random
from functools import lru_cache

import public_tokenizers as P
import pytest
import tiktoken

from sextant.llm import bpe, tokcount

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(7)
    yield from ["", " ", "\n\n \t x", "a" * 3000, "ab" * 2000, "<|endoftext|>", "naïve café 北京 😀🏽‍♀️ \u0000​", "don't WE'LL 123 4567,,,!!! ", "0" * 999, " " * 500 + "x"]
    letters = "abcdeeeiiinnorstthu"
    for _ in range(300):
        yield " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 25))) for _ in range(20))
    for _ in range(200):
        yield "".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F6FF)))) for _ in range(60))


def test_same_ids_as_the_library(encoding):
    import numpy as np

    for text in odd_texts():
        ids = bpe.encode(text, PATH)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert bpe.decode(ids, PATH) == text.encode()


def test_tables(spark, tmp_path, encoding):
    texts = [None, *odd_texts()][:120]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    import numpy as np

    for r in bpe.op2_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_table(bpe.encode_table(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokcount.op4_token_counts(spark, str(tmp_path)).collect()}
    model = tokcount.load(PATH)
    for i, t in enumerate(texts):
        pieces = bpe.splitter(P.PATTERN)(t or "")
        if sum(map(len, pieces)) < 600:
            assert got[i] == (len(pieces), sum(best(p.encode().decode("latin-1"), model.score)[1] for p in pieces))
    assert bpe.encode_table(df.limit(0), "doc_id", "text").count() == 0 == tokcount.token_counts(df.limit(0), "doc_id", "text").count()


def best(piece, score):
    """By plain recursion over all segmentations: (score, tokens)."""

    @lru_cache(maxsize=None)
    def upto(n):
        if n == 0:
            return 0.0, 0
        options = []
        for k in range(n):
            if piece[k:n] in score:
                s, c = upto(k)
                options.append((s + score[piece[k:n]], -c - 1))
        s, c = max(options)
        return s, -c

    return upto(len(piece))


def test_trie_against_all_segmentations():
    r = random.Random(3)
    score = {c: -math.log(2 + i) for i, c in enumerate("abcd")} | {"".join(r.choice("abcd") for _ in range(r.randrange(2, 5))): -r.random() * 4 for _ in range(60)}
    pieces = {"".join(r.choice("abcd") for _ in range(r.randrange(1, 12))) for _ in range(500)}
    got = tokcount.Unigram(score).count_all(pieces)
    assert set(got) == pieces and all(got[p] == best(p, score)[1] for p in pieces)
