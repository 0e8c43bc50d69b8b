"""Near-duplicate documents by min-max hashing, with links confirmed on full sets.

A document's set holds its distinct shingles of five words (lower-cased A-Z, runs of anything but ASCII white space); a
shorter document is one shingle. Two documents are linked if 100 * |intersection| >= 75 * |union|, and a component holds all
that links reach.

1. Every document is hashed under PERMUTATIONS functions, and each keeps both its minimum and its maximum, so that 128
   signature values cost 64 evaluations of the set. BANDS bands of ROWS values, each from a function of its own, make
   buckets; documents of similarity 0.75 miss each other in all of them with a probability of 5e-6.
2. Documents of equal sets collapse to the class with the smallest id, so copies cost nothing from here on.
3. In each bucket every class is paired with the bucket's smallest (a star, linear in the bucket), and the pairs are
   confirmed on their full sets. Components of these links are found by large-star and small-star steps.
4. A bucket that still holds several components may hide links between members other than its smallest. It is cut into
   blocks of about BLOCK members, or BLOCK_SHINGLES shingles if these are fewer; each pair of blocks that holds more than one component counts all its intersections
   exactly and gives back only links that join components, fewer than it has members. So no link is lost to the size of a bucket, and no list of all pairs is made.

Hashes of shingles have 64 bits. Nothing is capped. Only counts and sums reach the driver.

Cases: a null text, or one without words, has an empty set, which is linked with nothing, itself a component; equal texts are
in one component; rows that repeat an id and its text get the same result; an id with several texts is one document that has
the links of all of them, and each of its rows tells the set of its own text; rows without an id are classes with their equals
only, and are kept if no equal has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, table, utf8

WORDS, PERCENT = 5, 75
PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Members, and shingles of them together, that a block holds on average (a longer text fills one by itself).
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Bytes of text that are shingled at a time (a longer text makes a chunk of its own).
CHUNK = 2_000_000

U64 = np.uint64
_r = np.random.default_rng(20_240_229)
BYTE = _r.integers(1, 2**63, 256, dtype=U64)
PLACE, LENGTH = _r.integers(1, 2**63, WORDS, dtype=U64) | U64(1), U64(0x9E3779B97F4A7C15)
XOR, FACTOR = _r.integers(1, 2**63, PERMUTATIONS, dtype=U64), _r.integers(1, 2**63, PERMUTATIONS, dtype=U64) | U64(1)
#: Values of the signature (minima, then maxima) that make each band: always of different functions.
BANDED = np.concatenate([_r.permutation(PERMUTATIONS), PERMUTATIONS + _r.permutation(PERMUTATIONS)]).reshape(BANDS, ROWS)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, end to end, and how many each has."""
    sets, sizes, lo = [], [], 0
    while lo < len(texts):
        raw, total = [], 0
        while lo < len(texts) and (not raw or total < CHUNK):
            raw.append(utf8(texts[lo]).lower())  # bytes: A-Z only
            total += len(raw[-1])
            lo += 1
        h, n = _shingles(raw)
        sets.append(h)
        sizes.append(n)
    return np.concatenate(sets or [np.zeros(0, U64)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def _shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    edges = np.flatnonzero(np.diff(SPACE[a], prepend=True))
    first, end = edges[::2], edges[1::2]  # of words
    sizes = np.zeros(len(raw), np.int64)
    if not len(first):
        return np.zeros(0, U64), sizes
    length = end - first
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)  # place in the word
    bytes_in = a[np.repeat(first, length) + at]
    word = mix(np.add.reduceat(mix(BYTE[bytes_in] + at.astype(U64) * LENGTH), np.cumsum(length) - length))
    doc = np.searchsorted(begins, first, "right") - 1
    n_words = np.bincount(doc, minlength=len(raw))
    starts = np.cumsum(n_words) - n_words
    many = np.maximum(n_words - WORDS + 1, n_words > 0).astype(np.int64)  # shingles, with repeats
    which = np.repeat(np.arange(len(raw)), many)
    place = starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    h = np.zeros(len(which), U64)
    left = n_words[which] - (place - starts[which])
    padded = np.concatenate([word, np.zeros(WORDS, U64)])
    for k in range(WORDS):
        h += np.where(left > k, padded[place + k], U64(k + 1)) * PLACE[k]
    h = mix(h)
    out = []
    ends = np.cumsum(many)
    for d, (lo, hi) in enumerate(zip((ends - many).tolist(), ends.tolist())):
        if hi > lo:
            out.append(np.unique(h[lo:hi]))
            sizes[d] = len(out[-1])
    return np.concatenate(out), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, 2 PERMUTATIONS): minima, then maxima; zero for empty sets."""
    out, full = np.zeros((len(sizes), 2 * PERMUTATIONS), np.uint32), np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(full):  # as many sets at a time as a cache holds
        hi = max(lo + 1, int(np.searchsorted(ends[full], ends[full[lo]] - sizes[full[lo]] + 40_000)))
        part = full[lo:hi]
        begin = ends[part[0]] - sizes[part[0]]
        x, at = sets[begin : ends[part[-1]]], (ends[part] - sizes[part]) - begin
        for k in range(PERMUTATIONS):
            h = (((x ^ XOR[k]) * FACTOR[k]) >> U64(32)).astype(np.uint32)
            out[part, k] = np.minimum.reduceat(h, at)
            out[part, PERMUTATIONS + k] = np.maximum.reduceat(h, at)
        lo = hi
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket numbers."""
    h = np.repeat(np.arange(BANDS, dtype=U64)[None] * LENGTH, len(signature), 0)
    for k in range(ROWS):
        h = mix(h + signature[:, BANDED[:, k]].astype(U64) * PLACE[k])
    return h.view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            sets, sizes = shingle_sets(part.column(1).to_pylist())
            ends = np.cumsum(sizes)
            keys = [hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
            bands = buckets(signatures(sets, sizes))
            offsets = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, bands.ravel())], names=["id", "n_shingles", "key", "bands"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b), the (a, b) that are linked."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
            distinct = list(dict.fromkeys(left))  # the rows of one star share their text
            sets, sizes = shingle_sets(distinct + right)
            cuts = np.split(sets, np.cumsum(sizes)[:-1])
            of = dict(zip(distinct, cuts))
            linked = [_similar(of[x], y) for x, y in zip(left, cuts[len(distinct) :])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])


def joins_in_block(ids: np.ndarray, group: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """Links that join different groups, a spanning forest of them, found from all exact intersections."""
    sets, sizes = shingle_sets(texts)
    n, whose = len(ids), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(sets, kind="stable")
    values, whose = sets[order], whose[order]
    column = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))) - 1 if len(values) else np.zeros(0, np.int64)
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        one = np.zeros((n, 4096), np.float32)
        one[whose[a:b], column[a:b] - lo] = 1
        both += one @ one.T
    union = sizes[:, None] + sizes[None] - both
    linked = np.triu(100 * both >= PERCENT * union, 1) & (group[:, None] != group[None])
    parent = {int(g): int(g) for g in group}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        p, q = root(int(group[i])), root(int(group[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


#: Edges in a partition, in the rounds of components.
EDGES_AT_ONCE = 100_000


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows.groupBy(*keys) whose result is not yet dealt out by the keys: a join on them then has a plain exchange on both sides,
    and adaptive execution can split the partition of a key that many rows of the other side have."""
    return rows.groupBy(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_0"))


def components(edges: DataFrame, most_files: int | None = None) -> DataFrame:
    """(node, component): every node of the edges (a, b), with the smallest node it reaches. Alternates large-star and
    small-star steps until nothing changes, which takes a number of rounds that grows with the logarithm of the longest path.

    An edge leads from its larger end a to its smaller end b. Large-star: b gives way to the least of its own smaller ends, so
    a centre, which has none, stays. Small-star: a node and its smaller ends go to the least of these.
    """
    e = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most_files)
    seen = _checksum(e)
    least = lambda x: _spread(x, "a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    while seen[0]:
        large = e.join(least(e), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least(large), F.col("a") == F.col("u")).select(F.explode(both).alias("x"))
        # A round leaves at most twice the edges of the one before: their number gives that of the files to write.
        e = cut(small.select("x.*").filter("a != b").distinct(), 1 + seen[0] // EDGES_AT_ONCE)
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable) and kept (whether that is the row's own)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = cut(map_rows(docs, _hashed, "id long, n_shingles long, key binary, bands array<bigint>"))
    several = hashed.filter("id is not null").groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("n_shingles").alias("least")).filter("lo != hi or least = 0 and lo is not null")
    out = _linked(docs, hashed) if several.isEmpty() else _of_repeated_ids(docs)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def number_rows(df: DataFrame, id_col: str, mark) -> DataFrame:
    """df with _number, one for each different pair of id_col and mark, in the order of the ids; null for a null id."""
    marked = df.withColumn("_mark", mark)
    pairs = marked.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col("_mark").alias("_m")).distinct().orderBy("_id", "_m")
    numbers = cut(df.sparkSession.createDataFrame(pairs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), "_id long, _m long, _number long"))
    same = (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_mark") == F.col("_m"))
    return marked.join(numbers, same, "left").drop("_id", "_m", "_mark")


def _of_repeated_ids(docs: DataFrame) -> DataFrame:
    """Where texts of one id differ: the texts are linked under numbers of their own, and then what shares a number or an id."""
    numbered = cut(number_rows(docs, "id", F.xxhash64("text")))
    found = cut(near_duplicates(numbered.select("_number", "text"), "_number"))
    ids = numbered.filter("_number is not null").select(F.col("_number").alias("k"), F.col("id").alias("own")).distinct()
    named = found.join(ids, F.col("_number") == F.col("k"), "left").join(ids.toDF("c", "first"), F.col("component_id") == F.col("c"), "left").select("own", "n_shingles", "first")
    named = cut(named)
    higher = components(named.filter("own is not null").select(F.col("own").alias("a"), F.col("first").alias("b")).distinct())
    return named.join(higher, F.col("first") == F.col("node"), "left").select(F.col("own").alias("id"), "n_shingles", F.coalesce("component", "first").alias("component_id"))


def _linked(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """id, n_shingles, component_id of rows whose ids tell their texts."""
    parts = hashed.rdd.getNumPartitions()  # what follows is no larger than the documents
    files = 1 + hashed.count() // EDGES_AT_ONCE
    classes = hashed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep"))
    first = hashed.join(classes.filter(F.col("rep").isNotNull()).select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key", "id"])  # a repeated row is one class
    banded = first.select("id", F.explode("bands").alias("bucket"))
    stars = _spread(banded, "bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print")).filter("n > 1").drop("_0")
    shared = cut(banded.join(stars, "bucket"), parts)
    texts = cut(docs.join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), parts)
    pairs = shared.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirm(pairs, texts)
    found = components(links, files)
    joined = components(_between_components(shared, first.select("id", "n_shingles"), found, texts, parts), files)
    lifted = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("higher")), "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    # Links of the second kind run between components, or classes that had no link before.
    final = lifted.unionByName(joined.join(found.select("node"), "node", "left_anti"))
    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    return hashed.select("id", "n_shingles", "key").join(of_class, "key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return map_rows(with_a.select("a", "b", "text_a", "text_b"), _confirmed, "a long, b long")


def _between_components(shared: DataFrame, sizes: DataFrame, found: DataFrame, texts: DataFrame, most_files: int) -> DataFrame:
    """Links between components that share a bucket of three or more, as pairs of components. sizes: n_shingles by id."""
    nodes = sizes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = shared.filter("n > 2").join(nodes, "id")
    # Buckets of the same members say the same; one of them is looked at.
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("print").alias("print"), F.first("n").alias("n")).filter("lo != hi")
    mixed = mixed.groupBy("print", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    # A component that fills a block has blocks to itself, the smaller ones share theirs; so most pairs of blocks hold one
    # component and need no look. Counts decide, so no bucket has to be sorted in one task.
    held = member.select("bucket", "id", "component", "n_shingles").join(mixed, "bucket", "left_semi")
    blocks = lambda n, weight: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(weight) / BLOCK_SHINGLES))
    each = _spread(held, "bucket", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w")).drop("_0").withColumn("own", blocks("c", "w"))
    small = each.filter("own <= 1").groupBy("bucket").agg(F.sum("c").alias("small_c"), F.sum("w").alias("small_w"))
    counts = each.join(small, "bucket", "left").select("bucket", "component", "own", blocks("small_c", "small_w").alias("small"))
    alone = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("own")))
    block = F.when(F.col("own") > 1, alone).otherwise(F.pmod(F.xxhash64("component"), F.col("small")))
    rows = cut(held.join(counts, ["bucket", "component"]).select("bucket", "id", "component", block.alias("block")), most_files)
    block = rows.groupBy("bucket", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    i, j = block.toDF("bucket", "i", "i_lo", "i_hi"), block.toDF("bucket", "j", "j_lo", "j_hi")
    looked = i.join(j, "bucket").filter("i <= j and least(i_lo, j_lo) != greatest(i_hi, j_hi)").select("bucket", "i", "j")
    sides = looked.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = rows.join(sides, ["bucket", "block"]).select("bucket", "i", "j", "id", "component").join(texts, "id")

    def run(pdf):
        import pandas as pd

        group = dict(zip(pdf["id"], pdf["component"]))
        links = joins_in_block(pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["text"].tolist())
        return pd.DataFrame([(group[a], group[b]) for a, b in links], columns=["a", "b"]).astype("int64")

    return rows.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def op7_minhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
