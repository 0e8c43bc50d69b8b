"""Topic models over Spark: plain LDA (batch variational) and label-constrained LDA.

Label-constrained LDA owns a block of topics for each label and some latent topics for all. A labelled document may use its
label's block and the latent topics; an unlabelled one all. Fitting alternates an E-step over partitions of documents (each
document's posterior by fixed-point iteration against the broadcast topic-word table) and an M-step that sums expected counts
by cell. The table has as many cells as topics times vocabulary, which min_cf and rm_top bound, and is what the driver holds
(MAX_CELLS at most); documents never leave the executors, and move once, as numbers of terms. Starting values come from a
seed, so a fit is deterministic.
"""

from __future__ import annotations

import ctypes
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from .aggs import first_seen

#: Cells of the topic-word table that a fit takes at most; a larger vocabulary needs a higher min_cf.
MAX_CELLS = 20_000_000
#: Terms times topics that are worked on at once.
BLOCK_CELLS = 400_000
#: A vocabulary without a bound, of PlainLDA.
ALL_TERMS = (1 << 31) - 1
#: Words of a block of documents of PlainLDA (a quarter where nothing is kept), and terms whose sums travel together.
BLOCK_WORDS, RANGE = 1_000_000, 1 << 16
#: PlainLDA's variational step: rounds at most, in three parts, and the change of weights at which a document rests.
ROUNDS, TOLERANCE, TINY = (10, 20, 70), 1e-3, 1e-35
#: Words times topics that it works on at once, few enough for a core's cache.
STEP_CELLS = 200_000


@dataclass(frozen=True)
class Params:
    topics_per_label: int = 3
    latent_topics: int = 1
    alpha: float = 0.1
    eta: float = 0.01
    min_cf: int = 3
    rm_top: int = 0
    seed: int = 42


@dataclass
class LabelledModel:
    labels: list[str]
    vocabulary: list[str]
    beta: np.ndarray  # topics x terms, rows sum to 1
    params: Params
    log: list[tuple[int, float, float]] = field(default_factory=list)  # iteration, log likelihood a word, perplexity

    @property
    def topics(self) -> list[tuple[int, str]]:
        """(topic, display name): blocks in the order of the labels, latent topics last."""
        t = self.params.topics_per_label
        names = [f"{label} {i}" for label in self.labels for i in range(1, t + 1)]
        return list(enumerate(names + [f"latent {i}" for i in range(1, self.params.latent_topics + 1)]))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(self.beta)], "topic int, p array<double>").write.mode("overwrite").parquet(f"{path}/beta")
        spark.createDataFrame([(self.vocabulary,)], "terms array<string>").write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([(i, x) for i, x in enumerate(self.labels)], "position int, label string").write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame([vars(self.params)]).write.mode("overwrite").json(f"{path}/params")

    @staticmethod
    def load(spark, path: str) -> LabelledModel:
        labels = [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("position").collect()]
        p = spark.read.json(f"{path}/params").first().asDict()
        beta = [r.p for r in spark.read.parquet(f"{path}/beta").orderBy("topic").collect()]  # the topics, within MAX_CELLS
        vocabulary = list(spark.read.parquet(f"{path}/vocabulary").first().terms)
        return LabelledModel(labels, vocabulary, np.array(beta).reshape(len(beta), len(vocabulary)), Params(**{k: type(getattr(Params(), k))(v) for k, v in p.items()}))


def _vocabulary(df: DataFrame, text: str, min_cf: int, rm_top: int, most: int) -> list[str]:
    """Terms that occur min_cf times or more, less the rm_top most frequent ones (of equals the smaller); an error beyond
    `most` of them, before they reach the driver."""
    cf = df.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("cf")).filter(F.col("cf") >= min_cf)
    rows = cf.limit(most + rm_top + 1).toArrow()
    if len(rows) > most + rm_top:
        raise ValueError(f"more than {most} terms for so many topics; raise min_cf")
    rows = rows.take(pc.sort_indices(rows, [("cf", "descending"), ("term", "ascending")])[rm_top:])
    return rows.take(pc.sort_indices(rows, [("term", "ascending")]))["term"].to_pylist()


def _bags(df: DataFrame, doc: str, text: str, label: str | None, vocabulary: Sequence[str]) -> DataFrame:
    """(doc, label, terms, counts) of documents with known terms, by their numbers. Terms are counted within a row; rows of one
    id are one document, with the least label. Rows without an id are left out."""
    shared = df.sparkSession.sparkContext.broadcast(list(vocabulary))  # within MAX_CELLS
    named = F.col(label) if label else F.lit(None).cast("string")
    rows = df.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), named.alias("label"), terms(F.col(text)).alias("words"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc", "label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        size = max(len(known), 1)
        for b in batches:
            words = b.column("words")
            lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            numbers = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(b)), lengths)[numbers >= 0]
            code, n = np.unique(row * size + numbers[numbers >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(code // size, np.arange(len(b) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code % size, n)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("label"), *lists], ["doc", "label", "terms", "counts"])

    bags = rows.mapInArrow(count, f"{kinds}, terms array<int>, counts array<int>").filter(F.size("terms") > 0)
    merged = bags.groupBy("doc").agg(F.min("label").alias("label"), F.collect_list(F.struct("terms", "counts")).alias("parts"))
    return merged.select("doc", "label", F.flatten("parts.terms").alias("terms"), F.flatten("parts.counts").alias("counts"))


def _one(terms: Sequence[int], counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each term once."""
    t, place = np.unique(np.asarray(terms), return_inverse=True)
    return t, np.bincount(place, weights=np.asarray(counts, float), minlength=len(t))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows, 512 at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), 512):
            yield pdf.iloc[at : at + 512]


def _posteriors(docs: Sequence[tuple[np.ndarray, np.ndarray]], allowed: np.ndarray, by_topic: np.ndarray, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents (terms, counts) with the same topics: topic shares (topics x documents), the terms one after the other,
    their expected counts (topics x terms), and log likelihoods. A document rests once its shares do. by_topic: topics x terms."""
    lengths = np.array([len(t) for t, _ in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    terms, counts = np.concatenate([t for t, _ in docs]), np.concatenate([c for _, c in docs])
    b = by_topic[np.ix_(allowed, terms)]
    theta, live = np.full((len(allowed), len(docs)), 1.0 / len(allowed)), np.ones(len(docs), bool)
    mass = lambda: np.maximum(np.einsum("kj,kj->j", b, np.repeat(theta, lengths, axis=1)), 1e-300)
    for _ in range(rounds):
        n = theta * np.add.reduceat(b * (counts / mass()), starts, axis=1) + alpha
        new = n / n.sum(0)
        moved = np.abs(new - theta).max(0) >= 1e-6
        theta = np.where(live, new, theta)
        live &= moved
        if not live.any():
            break
    m = mass()
    return theta, terms, b * np.repeat(theta, lengths, axis=1) * (counts / m), np.add.reduceat(counts * np.log(m), starts)


def _blocks(docs: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence, place: dict, p: Params, n_topics: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(allowed topics, positions) of documents with the same topics, BLOCK_CELLS or one document at a time."""
    by_label: dict = {}
    for i, x in enumerate(labels):
        by_label.setdefault(x if x in place else None, []).append(i)
    for x, members in by_label.items():
        allowed, held, cells = _allowed(x, place, p, n_topics), [], 0
        for i in members:
            size = len(docs[i][0]) * len(allowed)
            if held and cells + size > BLOCK_CELLS:
                yield allowed, held
                held, cells = [], 0
            held.append(i)
            cells += size
        yield allowed, held


def _allowed(label: str | None, place: dict[str, int], p: Params, n_topics: int) -> np.ndarray:
    if label is None or label not in place:
        return np.arange(n_topics)
    own = place[label] * p.topics_per_label
    return np.concatenate([np.arange(own, own + p.topics_per_label), np.arange(n_topics - p.latent_topics, n_topics)])


def _start(n_topics: int, vocabulary: Sequence[str], seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    beta = 1.0 + 0.5 * r.random((n_topics, len(vocabulary)))
    return beta / beta.sum(1, keepdims=True)


def fit_labelled(df: DataFrame, doc: str, text: str, label: str, order: Sequence[str], params: Params = Params(), iterations: int = 240, step: int = 30) -> LabelledModel:
    """A model of the labelled documents of df (null labels are left out). Topic blocks follow the first occurrence of labels
    by `order`. The log likelihood is logged every `step` iterations."""
    spark = df.sparkSession
    labelled = df.dropna(subset=[label])
    labels = [r[label] for r in first_seen(labelled, label, order).orderBy("position").collect()]
    n_topics = len(labels) * params.topics_per_label + params.latent_topics
    vocabulary = _vocabulary(labelled, text, params.min_cf, params.rm_top, MAX_CELLS // n_topics)
    place = {x: i for i, x in enumerate(labels)}
    docs = _bags(labelled, doc, text, label, vocabulary).select("label", "terms", "counts").persist()
    model = LabelledModel(labels, vocabulary, _start(n_topics, vocabulary, params.seed), params)
    for i in range(1, iterations + 1):
        shared = spark.sparkContext.broadcast(model.beta)

        def e_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_topic = shared.value
            sums, ll, n = np.zeros_like(by_topic), 0.0, 0.0
            for pdf in _pieces(batches):
                bags = [_one(ts, cs) for ts, cs in zip(pdf["terms"], pdf["counts"])]
                for allowed, held in _blocks(bags, pdf["label"], place, params, n_topics):
                    _, t, expected, one = _posteriors([bags[i] for i in held], allowed, by_topic, params.alpha, 20)
                    for k, row in zip(allowed, expected):
                        np.add.at(sums[k], t, row)
                    ll, n = ll + float(one.sum()), n + sum(float(bags[i][1].sum()) for i in held)
            flat = sums.reshape(-1)
            cells = np.flatnonzero(flat)
            yield pd.DataFrame({"cell": np.concatenate([[-2, -1], cells]), "value": np.concatenate([[n, ll], flat[cells]])})

        # Cells are numbered topic by topic; -1 has the log likelihood, -2 the number of words.
        parts = docs.mapInPandas(e_step, "cell long, value double")
        got = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # MAX_CELLS at most
        cell, value = got["cell"].to_numpy(), got["value"].to_numpy()
        del got
        ll, n = (float(value[cell == k].sum()) for k in (-1, -2))
        beta = np.full(n_topics * len(vocabulary), params.eta)
        beta[cell[cell >= 0]] += value[cell >= 0]
        beta = beta.reshape(n_topics, len(vocabulary))
        model.beta = beta / beta.sum(1, keepdims=True)
        shared.destroy()
        if i % step == 0 or i == iterations:
            model.log.append((i, ll / max(n, 1.0), math.exp(-ll / max(n, 1.0))))
    docs.unpersist()
    return model


def infer_labelled(df: DataFrame, doc: str, text: str, model: LabelledModel, label: str | None = None, iterations: int = 100) -> DataFrame:
    """(doc, topics array, ll): shares of all topics, or where a known label is given of its block and the latent ones."""
    spark, p = df.sparkSession, model.params
    place = {x: i for i, x in enumerate(model.labels)}
    shared = spark.sparkContext.broadcast(model.beta)
    rows = _bags(df, doc, text, label, model.vocabulary)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_topic = shared.value
        for pdf in _pieces(batches):
            bags, out = [_one(ts, cs) for ts, cs in zip(pdf["terms"], pdf["counts"])], []
            for allowed, held in _blocks(bags, pdf["label"], place, p, len(by_topic)):
                theta, _, _, ll = _posteriors([bags[i] for i in held], allowed, by_topic, p.alpha, iterations)
                full = np.zeros((len(held), len(by_topic)))
                full[:, allowed] = theta.T
                out += [(pdf["doc"].iloc[i], row.tolist(), one / bags[i][1].sum()) for i, row, one in zip(held, full, ll)]
            yield pd.DataFrame(out, columns=["doc", "topics", "ll_per_word"])

    return rows.mapInPandas(run, f"doc {kind}, topics array<double>, ll_per_word double").withColumnRenamed("doc", doc)


def grid(**values: Sequence) -> list[Params]:
    """All combinations, the last parameter changing fastest."""
    names = list(values)
    return [Params(**dict(zip(names, combination))) for combination in itertools.product(*values.values())]


def grid_search(df: DataFrame, doc: str, text: str, label: str, order: Sequence[str], candidates: Sequence[Params], iterations: int = 240, step: int = 30) -> tuple[LabelledModel, list[dict]]:
    """The candidate of least perplexity (the first of equals) and a log of all."""
    best, log = None, []
    for p in candidates:
        m = fit_labelled(df, doc, text, label, order, p, iterations, step)
        log.append(vars(p) | {"ll_per_word": m.log[-1][1], "perplexity": m.log[-1][2]})
        if best is None or m.log[-1][2] < best.log[-1][2]:
            best = m
    least = min(range(len(log)), key=lambda i: log[i]["perplexity"])
    return best, [row | {"is_best": i == least} for i, row in enumerate(log)]


def split_docs(df: DataFrame, doc: str, seed: int, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training and test documents; a hash of id and seed decides, so a split can be repeated anywhere."""
    u = F.pmod(F.xxhash64(F.col(doc), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.filter(u >= share), df.filter(u < share)


def _digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to 1e-10."""
    y = x + 6.0
    z = 1.0 / (y * y)
    out = np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    for i in range(6):
        out -= 1.0 / (x + i)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to 1e-9."""
    y = x + 8.0
    z = 1.0 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    for i in range(8):
        out -= np.log(x + i)
    return out


def _expected_logs(x: np.ndarray) -> np.ndarray:
    """E log of Dirichlet variables, a row each."""
    return _digamma(x) - _digamma(x.sum(-1, keepdims=True))


def _word_bags(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of rows of words: distinct words of each, these one row after the other as places in a list of all, their counts; the list."""
    coded = words.flatten().dictionary_encode()
    size = max(len(coded.dictionary), 1)
    rows = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    code, counts = np.unique(rows * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    rows, places = np.divmod(code, size)
    return np.bincount(rows, minlength=len(words)), places, counts, coded.dictionary


def _slices(words: pa.ListArray, most: int) -> Iterator[pa.ListArray]:
    """All rows, so many words or one row at a time."""
    ends, at = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)), 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield words.slice(at, to - at)
        at = to


def _known(lengths: np.ndarray, places: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bags of known words only; numbers: of the words in the list, -1 if unknown. The list becomes one of numbers that rise."""
    held = np.unique(numbers[numbers >= 0])
    keep = numbers[places] >= 0
    rows = np.repeat(np.arange(len(lengths)), lengths)[keep]
    return np.bincount(rows, minlength=len(lengths)), np.searchsorted(held, numbers)[places[keep]], counts[keep], held


def _variational(lengths: np.ndarray, places: np.ndarray, counts: np.ndarray, b: np.ndarray, prior: float, sums: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Topic weights (documents x topics) of documents with words, and their summed log likelihood, by the variational step of
    LDA: until the weights of a document change by less than TOLERANCE in the mean, ROUNDS at most. b: words x topics, the
    exponentials of the expected logs. To sums (words x topics) each word's expected shares of counts are added, to be
    multiplied by b. Documents of like length are worked on together, some STEP_CELLS cells or one document at a time."""
    k, starts = b.shape[1], np.cumsum(lengths) - lengths
    out, left = np.ones((len(lengths), k)), np.argsort(lengths, kind="stable")
    kind = np.float32 if k <= 16 else np.float64  # a prior of 1 / 16 leaves products of e and b far above the least 32-bit float
    for rounds in ROUNDS:  # what doesn't rest in these rounds is grouped anew
        later, at = [], 0
        while at < len(left):
            # The longest of a group decides its width.
            like = np.searchsorted(lengths[left], 1.1 * lengths[left[at]] + 4, "right")
            live = left[at : min(like, at + max(1, STEP_CELLS // (k * int(lengths[left[at]]))))]
            at += len(live)
            wide = np.arange(lengths[live[-1]])
            real = wide < lengths[live][:, None]
            where = np.where(real, starts[live][:, None] + wide, 0)
            cells = np.ascontiguousarray(b[places[where]].transpose(0, 2, 1), kind)  # documents x topics x words
            n, mine, rests = np.where(real, counts[where], 0).astype(kind), out[live], np.zeros(len(live), bool)
            for _ in range(rounds):
                e = np.exp(_digamma(mine)).astype(kind)  # less that of the sum, which cancels out
                share = n / (np.matmul(e[:, None, :], cells)[:, 0] + kind(TINY))
                new = np.where(rests[:, None], mine, prior + e * np.matmul(cells, share[:, :, None])[:, :, 0])
                rests |= np.abs(new - mine).sum(1) < k * TOLERANCE
                mine, moving = new, len(rests) - np.count_nonzero(rests)
                if moving < 0.8 * len(rests):
                    out[live] = mine
                    live, mine, cells, n, rests = live[~rests], mine[~rests], cells[~rests], n[~rests], np.zeros(moving, bool)
                    if not moving:
                        break
            out[live] = mine
            later.append(live[~rests])
        left = np.concatenate([left[:0], *later])
    e, mass = np.exp(_expected_logs(out)), np.full(len(places), TINY)
    for topic in range(k):
        mass += b[places, topic] * np.repeat(e[:, topic], lengths)
    if sums is not None:
        for topic in range(k):
            sums[:, topic] += np.bincount(places, counts / mass * np.repeat(e[:, topic], lengths), minlength=len(b))
    return out, float((counts * np.log(mass)).sum())


@dataclass
class Vocabulary:
    """Terms from the most frequent one down (of equals the smaller first), and their numbers by hash."""

    terms: pa.Array
    salt: int
    hashes: np.ndarray  # sorted
    numbers: np.ndarray

    @property
    def vocabulary(self) -> list[str]:
        return self.terms.to_pylist()

    @staticmethod
    def hashed(words: Column, salt: int) -> Column:
        return F.transform(words, lambda w: F.xxhash64(w, F.lit(salt)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def _tidy() -> None:
    """Hands memory that is free back to the system, which allocators else keep for later; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def _ints(x: np.ndarray) -> bytes:
    """Small numbers, most of them: compressed, behind the size."""
    plain = x.astype(np.int32).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _read(x: pa.BinaryScalar) -> np.ndarray:
    packed = x.as_buffer()
    return np.frombuffer(pa.decompress(packed.slice(8), int.from_bytes(packed.slice(0, 8).to_pybytes(), "little"), "zstd"), np.int32)


class PlainLDA:
    """Batch variational LDA, as the reference fits it, over a term-count vocabulary that is learnt once and reused: priors of
    1 / topics; each iteration reads all documents. Documents are split into words once a fit and then kept, on the executors,
    as blocks of numbers; what a task adds to the topics' words is summed by ranges of words before it reaches the driver,
    which holds topics x vocabulary (MAX_CELLS at most). Tables of words by topics travel as 32-bit floats. In transform() a
    word is known by its 64-bit hash; no two words of a vocabulary share one."""

    def __init__(self, n_topics: int, seed: int = 42, iterations: int = 20, vocabulary: int = 1 << 16, stop_words: Sequence[str] = ()):
        self.n_topics, self.seed, self.iterations, self.vocabulary, self.stop_words = n_topics, seed, iterations, vocabulary, list(stop_words)

    def _words(self, text: str) -> Column:
        words = terms(F.col(text))
        return F.filter(words, lambda w: ~w.isin(self.stop_words)) if self.stop_words else words

    def _learn(self, blocks: DataFrame) -> Vocabulary:
        most = MAX_CELLS // self.n_topics
        cf = blocks.select(F.explode(F.arrays_zip("words", "cf")).alias("x")).groupBy(F.col("x.words").alias("term")).agg(F.sum("x.cf").alias("cf"))
        cf = cf.orderBy(F.desc("cf"), "term").limit(self.vocabulary) if self.vocabulary <= most else cf.limit(most + 1)
        for salt in itertools.count():  # until all hashes differ: the first time, but for one vocabulary in millions
            rows = cf.withColumn("hash", F.xxhash64("term", F.lit(salt))).toArrow()
            if len(rows) > most:
                raise ValueError(f"{self.n_topics} topics x more than {most} terms; bound the vocabulary")
            rows = rows.take(pc.sort_indices(rows, [("cf", "descending"), ("term", "ascending")]))
            hashes = rows["hash"].to_numpy()
            order = np.argsort(hashes).astype(np.int32)
            hashes, found = hashes[order], rows["term"].combine_chunks()
            del rows
            _tidy()
            if (hashes[1:] != hashes[:-1]).all():
                return Vocabulary(found, salt, hashes, order)

    def fit(self, df: DataFrame, text: str) -> PlainLDA:
        spark, k = df.sparkSession, self.n_topics

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words in _slices(batch.column("words"), BLOCK_WORDS):
                    lengths, places, counts, names = _word_bags(words)
                    cf = np.bincount(places, counts, minlength=len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lengths": [_ints(lengths)], "places": [_ints(places)], "counts": [_ints(counts)], "words": pa.ListArray.from_arrays([0, len(names)], names), "cf": [cf]}, schema)

        schema = pa.schema({"lengths": pa.binary(), "places": pa.binary(), "counts": pa.binary(), "words": pa.list_(pa.string()), "cf": pa.list_(pa.int64())})
        blocks = df.select(self._words(text).alias("words")).mapInArrow(split, "lengths binary, places binary, counts binary, words array<string>, cf array<long>").persist()
        self.counts = self._learn(blocks)
        size, known = len(self.counts.terms), spark.sparkContext.broadcast((self.counts.salt, self.counts.hashes, self.counts.numbers))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = Vocabulary(None, *known.value)
            for batch in batches:
                for i in range(len(batch)):
                    numbers = names.find(batch.column("words")[i].values.to_numpy(zero_copy_only=False))
                    lengths, places, counts, held = _known(*(_read(batch.column(c)[i]) for c in ("lengths", "places", "counts")), numbers)
                    yield pa.RecordBatch.from_pydict({"lengths": [_ints(lengths[lengths > 0])], "places": [_ints(places)], "counts": [_ints(counts)], "held": [_ints(held)], "cells": [len(places)]})

        numbered = blocks.withColumn("words", Vocabulary.hashed(F.col("words"), self.counts.salt)).drop("cf")
        bags = numbered.mapInArrow(number, "lengths binary, places binary, counts binary, held binary, cells long").filter("cells > 0").persist()
        # A task sends its words' sums on, so there are as few tasks as the cores and their memory ask for.
        cells = bags.agg(F.sum("cells")).first()[0] or 0
        blocks.unpersist()
        tasks = bags.drop("cells").coalesce(max(spark.sparkContext.defaultParallelism, cells // (4 * BLOCK_WORDS)))
        ranges = -(-size // RANGE)

        def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, parts = shared.value, []
            _tidy()
            for batch in batches:
                for i in range(len(batch)):
                    lengths, places, counts, held = (_read(batch.column(c)[i]) for c in ("lengths", "places", "counts", "held"))
                    mine, sums = b[held].astype(float), np.zeros((len(held), k))
                    _variational(lengths, places, counts, mine, 1 / k, sums)
                    parts.append((held, mine * sums))
            if not parts:
                return
            rows = np.unique(np.concatenate([held for held, _ in parts]))
            total = np.zeros((len(rows), k))
            for held, sums in parts:
                total[np.searchsorted(rows, held)] += sums
            for r in range(ranges):
                at = slice(*np.searchsorted(rows, [r * RANGE, (r + 1) * RANGE]))
                if at.start < at.stop:
                    yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "rows": [_ints(rows[at] - r * RANGE)], "v": [total[at].astype(np.float32).tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for r, rows, v in zip(batch.column("r").to_pylist(), batch.column("rows"), batch.column("v")):
                    part = sums.setdefault(r, np.zeros((min(RANGE, size - r * RANGE), k)))
                    part[_read(rows)] += np.frombuffer(v.as_buffer(), np.float32).reshape(-1, k)
            for r, part in sums.items():
                yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "v": [part.astype(np.float32).tobytes()]})

        start = np.random.default_rng(self.seed)
        self.weights = np.empty((size, k), np.float32)
        for at in range(0, size, RANGE):
            self.weights[at : at + RANGE] = start.gamma(100.0, 0.01, (min(RANGE, size - at), k))
        for _ in range(self.iterations if size else 0):
            shared = spark.sparkContext.broadcast(self._exponentials())
            parts = tasks.mapInArrow(e_step, "r int, rows binary, v binary").repartition(min(ranges, tasks.rdd.getNumPartitions()), "r")
            got = parts.mapInArrow(add, "r int, v binary").toArrow()  # MAX_CELLS at most
            self.weights.fill(1 / k)
            for r, v in zip(got["r"].to_pylist(), got["v"]):
                self.weights[r * RANGE : (r + 1) * RANGE] += np.frombuffer(v.as_buffer(), np.float32).reshape(-1, k)
            del got
            shared.destroy()
            _tidy()
        known.destroy()
        bags.unpersist()
        return self

    def _exponentials(self) -> np.ndarray:
        out, total = np.empty(self.weights.shape, np.float32), _digamma(np.maximum(self.weights.sum(0, dtype=float), TINY))
        for at in range(0, len(out), RANGE):
            out[at : at + RANGE] = np.exp(_digamma(self.weights[at : at + RANGE].astype(float)) - total)
        return out

    def _bags(self, shared) -> Callable[[pa.ListArray], tuple]:
        _tidy()
        hashes, b = shared.value  # b in the order of the hashes
        names = Vocabulary(None, 0, hashes, np.arange(len(hashes), dtype=np.int32))

        def bags(words: pa.ListArray) -> tuple:
            lengths, places, counts, found = _word_bags(words)
            lengths, places, counts, held = _known(lengths, places, counts, names.find(found.to_numpy(zero_copy_only=False)))
            return lengths, places, counts, b[held].astype(float)

        return bags

    def _share(self, df: DataFrame):
        return df.sparkSession.sparkContext.broadcast((self.counts.hashes, self._exponentials()[self.counts.numbers]))  # within MAX_CELLS

    def transform(self, df: DataFrame, text: str, name: str = "topics") -> DataFrame:
        """df with topic shares; rows without a known word are left out."""
        k, shared, bags_by = self.n_topics, self._share(df), self._bags

        @F.arrow_udf("array<double>")
        def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bags = bags_by(shared)
            for batch in batches:
                pieces = [pa.array([], pa.list_(pa.float64()))]
                for hashes in _slices(batch, BLOCK_WORDS // 4):
                    lengths, places, counts, b = bags(hashes)
                    some = lengths > 0
                    weights, _ = _variational(lengths[some], places, counts, b, 1 / k)
                    ends = np.concatenate([[0], np.cumsum(some * k)]).astype(np.int32)
                    pieces.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((weights / weights.sum(1, keepdims=True)).ravel()), mask=pa.array(~some)))
                yield pa.concat_arrays(pieces)

        found = shares.asNondeterministic()(Vocabulary.hashed(self._words(text), self.counts.salt))  # else it would run for the filter too
        return df.withColumn(name, found).filter(F.col(name).isNotNull())

    def perplexity(self, df: DataFrame, text: str) -> float:
        """Of the rows that have a known word: e to the less the variational bound of a word."""
        k, shared, bags_by = self.n_topics, self._share(df), self._bags

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bags = bags_by(shared)
            for batch in batches:
                for hashes in _slices(batch.column("words"), BLOCK_WORDS // 4):
                    lengths, places, counts, b = bags(hashes)
                    weights, ll = _variational(lengths[lengths > 0], places, counts, b, 1 / k)
                    yield pa.RecordBatch.from_pydict({"bound": [ll + _dirichlet_bound(weights, 1 / k)], "n": [float(counts.sum())]})

        rows = df.select(Vocabulary.hashed(self._words(text), self.counts.salt).alias("words")).mapInArrow(bounds, "bound double, n double")
        bound, n = rows.agg(F.sum("bound"), F.sum("n")).first()
        shared.destroy()
        return math.exp(-(bound + _dirichlet_bound(self.weights.T.astype(float), 1 / k)) / n)

    def top_words(self, k: int) -> list[list[str]]:
        """Of each topic, most likely first."""
        return [[self.counts.terms[int(i)].as_py() for i in np.argsort(-w, kind="stable")[:k]] for w in self.weights.T]


def _dirichlet_bound(weights: np.ndarray, prior: float) -> float:
    """Sum over rows of E log p - E log q of Dirichlet variables of this prior."""
    size, total = weights.shape[-1], 0.0
    for row in np.array_split(weights, max(1, weights.size // BLOCK_CELLS)) if len(weights) > 1 else [weights]:
        total += float(((prior - row) * _expected_logs(row) + _log_gamma(row)).sum() - _log_gamma(row.sum(-1)).sum()) + len(row) * (math.lgamma(prior * size) - size * math.lgamma(prior))
    return total


def held_out_perplexity(df: DataFrame, doc: str, text: str, topic_counts: Sequence[int], runs: int = 3, seed: int = 42, **options) -> list[tuple[int, int, float]]:
    """(topics, seed, perplexity) over seeds seed, seed + 1, ...: fitted on the training part, measured on the rest."""
    out = []
    for k in topic_counts:
        for run in range(runs):
            train, test = split_docs(df, doc, seed + run)
            out.append((k, seed + run, PlainLDA(k, seed + run, **options).fit(train, text).perplexity(test, text)))
    return out


def topic_count(given: int | None, configured: Sequence[int]) -> int:
    """The count asked for, else the only one configured."""
    if given is not None:
        if given <= 0:
            raise ValueError("the number of topics must be positive")
        return given
    if len(configured) != 1:
        raise ValueError("several topic counts are configured: one has to be given")
    return configured[0]


def perplexity_profile(df: DataFrame, doc: str, text: str, topic_counts: Sequence[int], runs: int = 0, seed: int = 42, **options) -> list[tuple[int, int, float]]:
    """(topics, seed, perplexity): held out over so many runs, or without runs in the sample itself."""
    if runs > 0:
        return held_out_perplexity(df, doc, text, topic_counts, runs, seed, **options)
    return [(k, seed, PlainLDA(k, seed, **options).fit(df, text).perplexity(df, text)) for k in topic_counts]


def best_topic_count(profile: Sequence[tuple[int, int, float]]) -> int:
    """The topic count of least mean perplexity, the smaller of equals."""
    means: dict[int, list[float]] = {}
    for k, _, value in profile:
        means.setdefault(k, []).append(value)
    return min(sorted(means), key=lambda k: sum(means[k]) / len(means[k]))


def coherence_profile(df: DataFrame, text: str, topic_counts: Sequence[int], runs: int = 3, seed: int = 42, top: int = 10, **options) -> list[dict]:
    """For each topic count the mean and sample deviation, over seeds, of the mean NPMI of top-word pairs and of the context
    coherence of topics."""
    from .cooccurrence import context_coherence, pair_npmi

    out = []
    for k in topic_counts:
        npmi, cv = [], []
        for run in range(runs):
            found = PlainLDA(k, seed + run, **options).fit(df, text).top_words(top)
            pairs = [pair_npmi(df, text, words).persist() for words in found]
            npmi.append(float(np.mean([p.agg(F.avg("value")).first()[0] for p in pairs])))
            cv.append(float(np.mean([context_coherence(p)[0] for p in pairs])))
            for p in pairs:
                p.unpersist()
        spread = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
        out.append({"n_topics": k, "npmi_mean": float(np.mean(npmi)), "npmi_std": spread(npmi), "c_v_mean": float(np.mean(cv)), "c_v_std": spread(cv), "runs": runs})
    return out


def topic_diversity(top_words: Sequence[Sequence[str]]) -> float:
    """Distinct top words over all."""
    words = [w for ws in top_words for w in ws]
    return len(set(words)) / len(words) if words else 0.0


def shared_space(speeches: DataFrame, programmes: DataFrame, text: str, n_topics: int, **options) -> tuple[DataFrame, DataFrame, PlainLDA]:
    """Both sides' topic shares under one model, fitted on both."""
    model = PlainLDA(n_topics, **options).fit(speeches.select(text).unionByName(programmes.select(text)), text)
    return model.transform(speeches, text), model.transform(programmes, text), model


def party_subsets(df: DataFrame, party: str, n: int) -> dict[str, DataFrame]:
    """All rows, those of the most frequent party, those of the n most frequent."""
    from .aggs import top_groups

    return {"all": df, "top1": top_groups(df, party, 1), f"top{n}": top_groups(df, party, n)}
