"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A token (run between white space, lower case, without punctuation at its ends) enters as its word's hashed embedding beside
the mean of the hashed embeddings of its byte 3- and 5-grams. Two gated recurrent layers read a window of WINDOW tokens in
both directions, attention pools their states, and a logistic unit scores the window. Windows start every STRIDE tokens, so
they overlap and every token is in one; a document's score is the highest of its windows'.

Training takes a bounded sample: of the labelled documents that may be learnt from, SAMPLE_EACH of either label with the
smallest hashes. Of a text of over SAMPLE_CHARS characters a stretch of so many is learnt from, at a place given by the id's
hash. One task on an executor holds the sample and trains; only the model, of a fixed size, reaches the driver. The first epochs learn from random windows, the later ones
from each document's highest scoring window and a random one of the label-0 documents. Scores are shifted from the sample's
share of label 1 to that among all rows that may be learnt from.

Cases: a null or empty text scores as a window of no tokens; without labels of both kinds every score is the share of label 1
(0 without labels); of repeated labels of a document the largest counts; null labels are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

SAMPLE_EACH, SAMPLE_CHARS = 1500, 50_000
WINDOW, STRIDE = 48, 32
HIDDEN, DIM, ATTENTION, WORD_ROWS, GRAM_ROWS = 16, 16, 16, 1 << 13, 1 << 14
GRAM_SIZES = (3, 5)
EPOCHS, RANDOM_EPOCHS, BATCH, RATE, SEED = 8, 3, 128, 0.01, 7
THRESHOLD = 0.3
#: Distinct tokens whose inputs a worker keeps.
MEMO_TOKENS = 150_000
ENDS = ".,;:!?()[]{}<>\"'*#%"
F32 = np.float32
GRAM_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def token_inputs(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each token; and all grams' buckets, with the token each belongs to (in order)."""
    raw = [b"\2" + t.strip(ENDS).encode("utf-8", "replace") + b"\3" for t in tokens]
    lengths = np.array([len(x) for x in raw], np.int64)
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = ends[owner] - np.arange(len(a))  # bytes from here to the token's end
    # The word's hash: a sum over positions within the token, each position with a factor of its own.
    position = (lengths[owner] - left).astype(np.uint64)
    words = np.add.reduceat(_mix(a + (position + np.uint64(1)) * GRAM_FACTORS[0]), np.concatenate(([0], ends[:-1])))
    grams, whose = [], []
    for n in GRAM_SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += (a[at + k] + np.uint64(1)) * GRAM_FACTORS[k]
        grams.append(_mix(h) >> np.uint64(20))
        whose.append(owner[at])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return (_mix(words) % np.uint64(WORD_ROWS)).astype(np.int64), (np.concatenate(grams)[order] % np.uint64(GRAM_ROWS)).astype(np.int64), whose_all[order]


def _sums(rows: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by the sorted index whose."""
    out = np.zeros((n, rows.shape[1]), F32)
    if len(whose):
        starts = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        out[whose[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


Model = dict[str, np.ndarray]


def start(seed: int = SEED) -> Model:
    r = np.random.default_rng(seed)
    new = lambda *shape, by: (r.normal(size=shape) * by).astype(F32)
    m = {"word": new(WORD_ROWS, DIM, by=0.1), "gram": new(GRAM_ROWS, DIM, by=0.3)}
    for d in "fb":
        m |= {f"w{d}": new(2 * DIM, 3 * HIDDEN, by=0.25), f"c{d}": np.zeros(3 * HIDDEN, F32), f"u{d}": new(HIDDEN, 3 * HIDDEN, by=0.25)}
    return m | {"a": new(2 * HIDDEN, ATTENTION, by=0.3), "v": new(ATTENTION, by=0.3), "o": new(2 * HIDDEN, by=0.3), "bias": np.zeros(1, F32)}


def embed(m: Model, words: np.ndarray, grams: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of tokens, and the number of grams of each."""
    n = np.maximum(np.bincount(whose, minlength=len(words)), 1).astype(F32)[:, None]
    return np.hstack([m["word"][words], _sums(m["gram"][grams], whose, len(words)) / n]), n


def _read(m: Model, d: str, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool):
    """States (steps, windows, HIDDEN) of one direction. inputs: a row of 3 HIDDEN for each token; ids: (windows, steps)."""
    n, steps = ids.shape
    h, u = np.zeros((n, HIDDEN), F32), m[f"u{d}"]
    states, kept = np.empty((steps, n, HIDDEN), F32), {}
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x, g = inputs[ids[:, t]], h @ u
        gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if not mask[:, t].all():
            new = np.where(mask[:, t, None], new, h)
        if keep:
            kept[t] = (h, z, r, c, g[:, 2 * HIDDEN :])
        states[t] = h = new
    return states, kept


def forward(m: Model, pf: np.ndarray, pb: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. pf, pb: input rows of each direction."""
    (sf, kf), (sb, kb) = _read(m, "f", pf, ids, mask, keep), _read(m, "b", pb, ids, mask, keep)
    s = np.concatenate([sf, sb], 2)
    e = np.tanh(s @ m["a"])
    score = np.where(mask.T, e @ m["v"], -1e9)
    p = np.exp(score - score.max(0))
    p *= mask.T  # a window without tokens pools to zero
    p /= np.maximum(p.sum(0), 1e-9)
    pooled = (p[:, :, None] * s).sum(0)
    logits = pooled @ m["o"] + m["bias"][0]
    return (logits, (s, e, p, pooled, kf, kb)) if keep else logits


def _back_read(m: Model, d: str, ds: np.ndarray, ids: np.ndarray, mask: np.ndarray, kept: dict, n_rows: int):
    n, steps = ids.shape
    u, du, dp = m[f"u{d}"], np.zeros_like(m[f"u{d}"]), np.zeros((n_rows, 3 * HIDDEN), F32)
    dh = np.zeros((n, HIDDEN), F32)
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        h, z, r, c, g = kept[t]
        dh = dh + ds[t]
        on = mask[:, t, None]
        dn = dh * on
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * g * r * (1 - r)
        dx = np.hstack([dz, dr, dc])
        dg = np.hstack([dz, dr, dc * r])
        np.add.at(dp, ids[:, t], dx)
        du += h.T @ dg
        dh = dh * ~on + dn * z + dg @ u.T
    return du, dp


def gradients(m: Model, tokens: tuple, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Model]:
    """Weighted mean log loss of windows and its gradients. tokens: what token_inputs gave for the distinct tokens."""
    x, n_grams = embed(m, *tokens)
    pf, pb = x @ m["wf"] + m["cf"], x @ m["wb"] + m["cb"]
    logits, (s, e, p, pooled, kf, kb) = forward(m, pf, pb, ids, mask, True)
    q = _sigmoid(logits)
    loss = float((weight * (np.logaddexp(0, logits) - y * logits)).sum() / weight.sum())
    dl = ((q - y) * weight / weight.sum()).astype(F32)
    g: Model = {"bias": dl.sum(keepdims=True), "o": pooled.T @ dl}
    dpool = dl[:, None] * m["o"]
    dp = (dpool[None] * s).sum(2)
    dscore = p * (dp - (p * dp).sum(0))
    de = dscore[:, :, None] * m["v"] * (1 - e * e)
    g["v"] = np.einsum("tn,tna->a", dscore, e)
    g["a"] = np.einsum("tnh,tna->ha", s, de)
    ds = p[:, :, None] * dpool[None] + de @ m["a"].T
    dx = np.zeros_like(x)
    for d, rows, kept, part in (("f", pf, kf, ds[:, :, :HIDDEN]), ("b", pb, kb, ds[:, :, HIDDEN:])):
        g[f"u{d}"], drows = _back_read(m, d, part, ids, mask, kept, len(rows))
        g[f"w{d}"], g[f"c{d}"] = x.T @ drows, drows.sum(0)
        dx += drows @ m[f"w{d}"].T
    words, grams, whose = tokens
    g["word"], g["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
    np.add.at(g["word"], words, dx[:, :DIM])
    np.add.at(g["gram"], grams, (dx[:, DIM:] / n_grams)[whose])
    return loss, g


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many tokens, laid end to end: each window's document, first token and number of tokens."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, (np.cumsum(lengths) - lengths)[doc] + k * STRIDE, np.minimum(WINDOW, lengths[doc] - k * STRIDE)


def cells(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of windows over the token ids flat."""
    steps = np.arange(max(1, int(size.max(initial=0))))
    mask = steps < size[:, None]
    at = np.where(mask, first[:, None] + steps, 0)
    return np.where(mask, flat[at], 0) if len(flat) else np.zeros(at.shape, np.int64), mask


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """share: of label 1 among all rows that may be learnt from; scores are shifted to it."""
    y = np.array(labels, F32)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array([share], F32)}
    r, m = np.random.default_rng(seed), start(seed)
    number: dict[str, int] = {"": 0}
    ids_of = [np.array([number.setdefault(w, len(number)) for w in tokens_of(t)], np.int64) for t in texts]
    lengths, flat = np.array([len(x) for x in ids_of], np.int64), np.concatenate(ids_of)
    words, grams, whose = token_inputs(list(number))
    first_gram = np.searchsorted(whose, np.arange(len(number) + 1))
    doc, first, size = windows(lengths)
    starts = np.searchsorted(doc, np.arange(len(y) + 1))
    mean, square = {k: np.zeros_like(a) for k, a in m.items()}, {k: np.zeros_like(a) for k, a in m.items()}
    weight_of = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(F32)
    step, per_epoch = 0, 1 if len(y) >= 1000 else -(-1000 // len(y))
    for epoch in range(epochs):
        any_window = lambda: starts[:-1] + (r.random(len(y)) * np.diff(starts)).astype(np.int64)
        if epoch < RANDOM_EPOCHS:
            chosen = np.concatenate([any_window() for _ in range(2 * per_epoch)])
        else:
            logits = _score_windows(m, words, grams, whose, flat, first, size)
            best = np.array([lo + int(logits[lo:hi].argmax()) for lo, hi in zip(starts[:-1], starts[1:])])
            chosen = np.concatenate([np.concatenate([best, any_window()[y == 0]]) for _ in range(per_epoch)])
        chosen = r.permutation(chosen)
        for lo in range(0, len(chosen), BATCH):
            w = chosen[lo : lo + BATCH]
            ids, mask = cells(flat, first[w], size[w])
            used, inverse = np.unique(ids, return_inverse=True)
            counts = first_gram[used + 1] - first_gram[used]
            at = np.repeat(first_gram[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            _, g = gradients(m, (words[used], grams[at], np.repeat(np.arange(len(used)), counts)), inverse.reshape(ids.shape), mask, y[doc[w]], weight_of[doc[w]])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * F32(min(1.0, 1.0 / (norm + 1e-9)))
                mean[k] = 0.9 * mean[k] + 0.1 * a
                square[k] = 0.99 * square[k] + 0.01 * a * a
                m[k] = m[k] - F32(RATE) * (mean[k] / F32(1 - 0.9**step)) / (np.sqrt(square[k] / F32(1 - 0.99**step)) + F32(1e-8))
    share = min(max(share, 1e-6), 1 - 1e-6)
    m["bias"] = m["bias"] + F32(np.log(share / (1 - share)))  # both labels weighed the same in training
    return m


def _score_windows(m: Model, words, grams, whose, flat, first, size, at_once: int = 2048) -> np.ndarray:
    x, first_gram = np.empty((len(words), 2 * DIM), F32), np.searchsorted(whose, np.arange(len(words) + 1))
    for lo in range(0, len(words), 10_000):  # the rows of all grams at once would take the driver's memory
        hi = min(lo + 10_000, len(words))
        at = slice(first_gram[lo], first_gram[hi])
        x[lo:hi] = embed(m, words[lo:hi], grams[at], whose[at] - lo)[0]
    pf, pb = x @ m["wf"] + m["cf"], x @ m["wb"] + m["cb"]
    return np.concatenate([forward(m, pf, pb, *cells(flat, first[k : k + at_once], size[k : k + at_once])) for k in range(0, len(first), at_once)] or [np.zeros(0, F32)])


class Scorer:
    """Scores texts; keeps the inputs of the tokens seen, MEMO_TOKENS at most and those of one call. Beyond that it goes back
    to the first third, which holds the frequent ones."""

    def __init__(self, m: Model):
        self.m = m
        self.number: dict[str, int] = {}
        self.pf = self.pb = np.zeros((0, 3 * HIDDEN), F32)
        self.size = 0
        self._add([""])

    def _forget(self) -> None:
        self.size = min(self.size, MEMO_TOKENS // 3)
        self.number = dict(zip(self.number, range(self.size)))  # in the order of their numbers

    def _add(self, tokens: list[str]) -> None:
        if "constant" in self.m:
            return
        for lo in range(0, len(tokens), 20_000):
            part = tokens[lo : lo + 20_000]
            x, _ = embed(self.m, *token_inputs(part))
            n = self.size + len(part)
            if n > len(self.pf):
                grow = lambda a: np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), 3 * HIDDEN), F32)])
                self.pf, self.pb = grow(self.pf), grow(self.pb)
            self.pf[self.size : n], self.pb[self.size : n] = x @ self.m["wf"] + self.m["cf"], x @ self.m["wb"] + self.m["cb"]
            self.number.update(zip(part, range(self.size, n)))
            self.size = n

    def score(self, texts: list[str | None]) -> np.ndarray:
        if "constant" in self.m:
            return np.full(len(texts), float(self.m["constant"][0]))
        lists = [tokens_of(t) for t in texts]
        if self.size > MEMO_TOKENS:
            self._forget()
        self._add(sorted(set().union(*lists).difference(self.number)))
        number = self.number
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int32)
        doc, first, size = windows(np.array([len(ws) for ws in lists], np.int64))
        full = np.argsort(-size, kind="stable")  # short windows together need fewer steps
        logits = np.empty(len(doc), F32)
        for k in range(0, len(doc), 1024):
            w = full[k : k + 1024]
            logits[w] = forward(self.m, self.pf, self.pb, *cells(flat, first[w], size[w]))
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, logits)
        return 1 / (1 + np.exp(-top))


def may_learn(id_col: str = "doc_id"):
    """Whether labels may be learnt from a row: its remainder is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & may_learn("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    sample = known.filter("y = 1").orderBy("h", "id").limit(each).unionByName(known.filter("y = 0").orderBy("h", "id").limit(each))
    size, text = F.length("text"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    stretch = F.when(size <= chars, F.col("text")).otherwise(F.substring(F.col("text"), (F.pmod("h", size - chars + 1) + 1).cast("int"), F.lit(chars)))
    texts = docs.select(F.col(id_col).alias("id"), text).filter(may_learn("id"))
    rows = texts.join(F.broadcast(sample), "id").select("id", "h", "y", stretch.alias("text")).groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.max("h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        held.sort(key=lambda r: (r[1], r[0]))
        model = train([r[3] for r in held], [r[2] for r in held], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = map_rows(rows.select("id", "h", "y", "text").repartition(1), run, "model binary").collect()  # 2 x each rows go in, one comes out
    return pickle.loads(one[0].model) if one else train([], [], share)


def score_table(df: DataFrame, text_col: str, model: Model, name: str = "score") -> DataFrame:
    """df with a column of scores from 0 to 1. A column of df that has this name is replaced."""
    at = df.columns.index(text_col)
    old = [i for i, c in enumerate(df.columns) if c == name]
    shared = df.sparkSession.sparkContext.broadcast(model)  # 1.6 MB, by the sizes above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = pa.array(scorer.score(part.column(at).to_pylist()), pa.float64())
                kept = [i for i in range(part.num_columns) if i not in old]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), s], names=[*(part.schema.names[i] for i in kept), name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_rows(df, run, StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, DoubleType())]))


def op5_toxicity(spark, sf_dir):
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_table(docs, "text", model)
    return scored.select("doc_id", (~may_learn()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
