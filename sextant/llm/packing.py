"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

A bin never holds two pieces of one source, nor two of one duplicate cluster (null sources and clusters conflict with
nothing). Documents longer than the capacity give full pieces, each a bin of its own, and one rest. The rests of a packing
group go in by falling length, each into the tightest bin that has room and no conflict, or else into a new one.

Open bins are ordered by their residual room, and every bin carries a bitmap of the sources and clusters it holds. The search
starts at the successor of the wanted length and goes on to the next residual while all bins met conflict. For the conflict
classes that are frequent in a group, the residuals at which some bin is free of the class are kept beside, so that the search
doesn't step through the bins that a hot source has filled.

Groups are formed by hash and grow in number, not in size, with the input: GROUP_ROWS rows on average. Rows that are equal
in every column read here are counted before the shuffle and told apart by `copy`, which takes part in the hash, so a
repeated row, a hot source or a large cluster is spread over all groups.

Cases: a document of no or null length gives one row without a bin; a null id is an id like any other; equal lengths are
ordered by id and copy, and equally tight bins by number; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand, prepare, table

CAPACITY, GROUP_ROWS, FREQUENT = 8192, 2048, 8


class Bins:
    """Open bins by residual room; found by the tightest fit without conflict."""

    def __init__(self, capacity: int, frequent: list[int]):
        """frequent: bits of the classes for which free residuals are indexed."""
        self.capacity = capacity
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> bitmap -> heap of bins
        self.occupied = 0  # bit r: some open bin has residual r
        self.free = {bit: 0 for bit in frequent}  # bit r: some bin of residual r lacks the class
        self.lacking = {bit: [0] * (capacity + 1) for bit in frequent}
        self.used = 0

    def _put(self, residual: int, bitmap: int, number: int) -> None:
        if not residual:
            return  # full: closed
        heapq.heappush(self.at[residual].setdefault(bitmap, []), number)
        self.occupied |= 1 << residual
        for bit, counts in self.lacking.items():
            if not bitmap & bit:
                counts[residual] += 1
                self.free[bit] |= 1 << residual

    def _take(self, residual: int, bitmap: int) -> int:
        heaps = self.at[residual]
        number = heapq.heappop(heaps[bitmap])
        if not heaps[bitmap]:
            del heaps[bitmap]
            if not heaps:
                self.occupied ^= 1 << residual
        for bit, counts in self.lacking.items():
            if not bitmap & bit:
                counts[residual] -= 1
                if not counts[residual]:
                    self.free[bit] ^= 1 << residual
        return number

    def place(self, length: int, bitmap: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        hopeful = self.occupied
        for bit, residuals in self.free.items():
            if bitmap & bit:
                hopeful &= residuals
        hopeful >>= length
        residual = length
        while hopeful:
            step = (hopeful & -hopeful).bit_length() - 1
            residual += step
            fits = [(heap[0], held) for held, heap in self.at[residual].items() if not held & bitmap]
            if fits:
                number, held = min(fits)
                self._take(residual, held)
                self._put(residual - length, held | bitmap, number)
                return number, self.capacity - residual
            hopeful >>= step + 1
            residual += 1
        number = self.new()
        self._put(self.capacity - length, bitmap, number)
        return number, 0

    def new(self) -> int:
        self.used += 1
        return self.used - 1


def pack_group(rows: pd.DataFrame, capacity: int) -> list[tuple]:
    """(row, piece, start, length, bin, offset) of the pieces of rows (length, source, cluster), which are in order."""
    keys = [[(k, v) for k, v in (("s", s), ("c", c)) if not pd.isna(v)] for s, c in zip(rows["source"], rows["cluster"])]
    counts = Counter(k for ks in keys for k in ks)
    bits = {k: 1 << i for i, k in enumerate(k for k, n in counts.items() if n > 1)}  # one alone can't conflict
    bins = Bins(capacity, [bits[k] for k, n in counts.most_common(FREQUENT) if n > 1])
    out = []
    lengths = rows["length"].tolist()
    for i in sorted(range(len(lengths)), key=lambda i: -(lengths[i] % capacity)):
        n_full, rest = divmod(lengths[i], capacity)
        out += [(i, p, p * capacity, capacity, bins.new(), 0) for p in range(n_full)]
        if rest:
            out.append((i, n_full, n_full * capacity, rest, *bins.place(rest, sum(bits.get(k, 0) for k in keys[i]))))
    return out


def best_fit(df: DataFrame, id_col: str, length: Column, source: Column, cluster: Column, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: id_col, copy (0 unless rows repeat), piece, start and length of the piece, bin_id, bin_offset."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    units = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    items = expand(units, "n", "copy").drop("n")
    n_groups = max(1, -(-df.count() // group_rows))
    items = items.withColumn("pack_group", F.pmod(F.xxhash64("id", "length", "source", "cluster", "copy"), F.lit(n_groups)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "copy", "length"], kind="stable", na_position="first").reset_index(drop=True)
        out = pd.DataFrame(pack_group(pdf, capacity), columns=["row", "piece", "start", "size", "bin", "bin_offset"])
        out["id"], out["copy"] = pdf["id"].to_numpy()[out["row"]], pdf["copy"].to_numpy()[out["row"]]
        out["bin_id"] = pdf["pack_group"].iloc[0] * (1 << 32) + out["bin"]
        return out[["id", "copy", "piece", "start", "size", "bin_id", "bin_offset"]]

    schema = f"id {kind}, copy long, piece long, start long, size long, bin_id long, bin_offset long"
    packed = items.filter("length > 0").groupBy("pack_group").applyInPandas(run, schema)
    nothing = items.filter("length = 0").select("id", "copy", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(nothing).withColumnRenamed("size", "length").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents by the UTF-8 bytes of their texts; documents of equal texts are a cluster."""
    return best_fit(docs, "doc_id", F.octet_length("text"), F.col("source"), F.xxhash64("text"))


def op1_packing(spark, sf_dir):
    """All documents packed into bins of 8192 bytes."""
    return pack_documents(table(spark, sf_dir, "documents"))
