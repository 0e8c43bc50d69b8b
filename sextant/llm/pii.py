"""Personal data: exact patterns, and a skip-chain conditional random field that adds spans to theirs.

Base spans of each kind are the leftmost non-overlapping matches of its pattern that pass its test (parts of an address up
to 255, 13 to 19 digits with a Luhn sum, 9 to 15 digits of a phone number); matches that fail are dropped without retries.
The patterns are matched in time linear in the text.

The field labels tokens (runs between white space) with O, one of the four kinds, or private (secrets and names). Candidates are the tokens with
a digit or an @, those that a cue precedes (a word for a secret and = or :, a title before a capital), and wherever the document
repeats one of the latter or the name before an @, that token too; all others are always O, so inference runs over candidates
only. Neighbours form a chain. Skip edges lead from a token to the next one in the document that repeats it (but for punctuation
at its ends) or is similar (the same digits, seven at least; the same domain after an @; the name before it), so that however
often a token recurs its edges grow linearly, and evidence flows between all occurrences. Potentials of edges are shared;
inference is damped loopy message passing in log space.

Weights are fitted by pseudo-likelihood in numpy, in one task on an executor, to a bounded sample: SAMPLE_DOCS documents that can
hold personal data, those with the smallest hashes, of a long one a stretch of SAMPLE_CHARS characters. The labels learnt from
are the base spans, and for secrets and names what a cue tells, carried to the same token elsewhere in the document. Tokens that have
skip edges are learnt from in two more copies: without features, so that the label has to be told from the occurrences that the
token is linked with, and without neighbours. Runs of neighbouring tokens that get a kind with a probability of THRESHOLD or more, and touch no
base span (a secret may cover some), become added spans of that kind, without punctuation at the ends and without the cue.

Cases: a null or empty text has no spans; without any sample nothing is added; repeated rows get equal spans; the same token
in thousands of places costs as many edges. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans. The field has one label for what is private besides the base kinds: its tokens are names if they are words
#: with a capital, and secrets otherwise.
LABELS = (*KINDS, "secret", "name")
SECRET, NAME = len(KINDS), len(KINDS) + 1
SAMPLE_DOCS, SAMPLE_CHARS, STEPS, RATE, RIDGE = 1500, 20_000, 250, 0.1, 1e-4
ROUNDS, DAMPING, THRESHOLD = 10, 0.5, 0.9

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits either leads to a match from its first digit or from none of them.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\s]++")
ENDS = ".,;:!?()[]{}<>\"'"

# Words that stand before secrets and names, and formats of keys that are public.
SECRET_WORDS = ("token", "tokens", "secret", "secrets", "password", "passwords", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "private key", "private_key", "private-key", "credential", "credentials")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra")
KEY_FORMAT = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{24,})")

TITLE = re.compile(r"\b(?:" + "|".join(TITLES) + r")\b\.?[^\S\n]")
ASSIGNED = re.compile(r"[=:]")
#: Characters before a token in which a cue is looked for.
CUE_CHARS = 32
QUOTES = " \t\"'"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, end := m.end()))
    if DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


# The field: nodes are candidate tokens.

BUCKETS = 8
N_TOKEN = 16 + 3 * BUCKETS  # features of a token itself
SECRET_CUE, NAME_CUE, KEY, CAPITAL, LONG_MIX, ASSIGNS = range(10 + 3 * BUCKETS, N_TOKEN)


def _secret_word(text: str) -> bool:
    """Whether text, up to an = or a :, ends with a word for a secret."""
    return text.rstrip(QUOTES).lower().endswith(SECRET_WORDS)


def value_at(token: str) -> int:
    """Where the value begins in a token that holds its cue, as in password=...; 0 in any other."""
    m = ASSIGNED.search(token)
    return m.end() if m and _secret_word(token[: m.start()]) else 0


def _cues(text: str, start: int, token: str) -> list[int]:
    """Features of what stands before a token, or of a cue in it."""
    before = text[max(0, start - CUE_CHARS) : start].rstrip(QUOTES)
    f = []
    if before[-1:] in ("=", ":"):
        f.append(ASSIGNS)
        if _secret_word(before[:-1]):
            f.append(SECRET_CUE)
    elif value_at(token):
        f.append(SECRET_CUE)
    if token[:1].isupper():
        f.append(CAPITAL)
        words = before.split()[-2:]
        title = [w.rstrip(".") in TITLES for w in words]
        if title[-1:] == [True] or title[:1] == [True] and words[-1][:1].isupper():
            f.append(NAME_CUE)
    return f


def _features(token: str, cues: list[int] = []) -> list[int]:
    """Indices of the binary features of a token."""
    digits = "".join(DIGITS.findall(token))
    core = token.strip(ENDS)
    f = [0]
    if "@" in token:
        f.append(1)
    if token.startswith("+"):
        f.append(2)
    if any(c.isalpha() for c in token):
        f.append(3)
    if core.isdigit():
        f.append(4)
    if 13 <= len(digits) <= 19 and luhn(digits):
        f.append(5)
    if "-" in core:
        f.append(6)
    if "(" in token:
        f.append(7)
    if "=" in token or '"' in token:
        f.append(8)
    if DOMAIN.search(token):
        f.append(9)
    f.append(10 + min(core.count("."), BUCKETS - 1))
    f.append(10 + BUCKETS + min(len(digits) // 3, BUCKETS - 1))
    f.append(10 + 2 * BUCKETS + min(len(core) // 4, BUCKETS - 1))
    if KEY_FORMAT.search(token):
        f.append(KEY)
    if len(core) >= 16 and digits and len(digits) < len(core) and core.isalnum():
        f.append(LONG_MIX)
    return f + cues


def _handle(token: str) -> str:
    """The name before an @, if it is telling."""
    local = token.strip(ENDS).lower().partition("@")[0] if "@" in token[1:] else ""
    return local if len(local) >= 5 and any(c.isdigit() or c in "._-" for c in local) else ""


def _keys(token: str) -> Iterator[tuple[str, str]]:
    """What a repeated or similar token has in common with this one."""
    core = token.strip(ENDS).lower()
    yield "same", core
    digits = "".join(DIGITS.findall(core))
    if len(digits) >= 7:
        yield "digits", digits
    if "@" in core[1:]:
        yield "domain", core[core.index("@", 1) :]
    if handle := _handle(token):
        yield "same", handle
    if at := value_at(token):
        yield "same", token[at:].strip(ENDS).lower()


class Graph:
    """Nodes and edges of many documents at once."""

    def __init__(self, texts: list[str]):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        features, chain, skip = [], [], []
        for d, text in enumerate(texts):
            last: dict[tuple[str, str], int] = {}
            previous, k = -1, -2
            for start, end in _candidates(text):
                i, token = len(self.spans), text[start:end]
                self.spans.append((d, start, end))
                features.append(_features(token, _cues(text, start, token)))
                if previous == i - 1 and previous >= 0 and text[k:start].isspace():
                    chain.append((previous, i))
                previous, k = i, end
                for key in dict.fromkeys(_keys(token)):
                    if key in last and (not skip or skip[-1] != (last[key], i)):
                        skip.append((last[key], i))
                    last[key] = i
        self.n = len(self.spans)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        own = np.zeros((self.n, N_TOKEN))
        if self.n:
            rows = np.repeat(np.arange(self.n), [len(f) for f in features])
            own[rows, np.concatenate([np.array(f) for f in features])] = 1
        before, after = np.zeros_like(own), np.zeros_like(own)  # features of the neighbours
        before[self.chain[:, 1]] = own[self.chain[:, 0]]
        after[self.chain[:, 0]] = own[self.chain[:, 1]]
        self.x = np.hstack([own, before, after])
        self.own = features


def _around(text: str, hints: re.Pattern) -> Iterator[tuple[int, int]]:
    """Tokens that hold a hint, found from the hints outwards."""
    at = 0
    while (hint := hints.search(text, at)) is not None:
        start = hint.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = TOKEN.match(text, start).end()
        yield start, at


def _after_cues(text: str) -> Iterator[tuple[int, int]]:
    for m in TITLE.finditer(text):
        at = m.end()
        for _ in range(2):  # a first and a last name
            token = TOKEN.search(text, at)
            if not token or not token[0][:1].isupper() or token.start() - at > 2:
                break
            yield token.span()
            at = token.end()
    end = 0
    for m in ASSIGNED.finditer(text):
        if m.start() >= end and _secret_word(text[max(0, m.start() - CUE_CHARS) : m.start()]):
            start = m.start()
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            end = TOKEN.match(text, start).end()
            if not value_at(text[start:end]) or not text[m.end() : end].strip(QUOTES):  # the value is the next token
                token = TOKEN.search(text, end)
                if not token or token.start() - end > 3:
                    continue
                start, end = token.span()
            yield start, end


def _candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that may get a label, in order."""
    found = set(_around(text, HINT))
    cued = set(_after_cues(text))
    again = {key for a, b in cued for kind, key in _keys(text[a:b]) if kind == "same" and len(key) > 2}
    if "@" in text:
        again |= {h for a, b in found if (h := _handle(text[a:b]))}
    if again:
        found |= {m.span() for m in TOKEN.finditer(text) if m[0].strip(ENDS).lower() in again}
    return sorted(found | cued)


K = len(KINDS) + 2
PRIVATE = K - 1


def silver(graph: Graph, texts: list[str]) -> np.ndarray:
    """The label of each node by the base spans: 0, or 1 + kind where one overlaps it; then by cues, which hold for the whole
    text."""
    y, k = np.zeros(graph.n, np.int64), 0
    for d, text in enumerate(texts):
        first = k
        while k < graph.n and graph.spans[k][0] == d:
            k += 1
        if first == k:
            continue
        starts = np.array([s for _, s, _ in graph.spans[first:k]])
        ends = np.array([e for _, _, e in graph.spans[first:k]])
        for kind, start, end in reversed(base_spans(text)):
            y[first + np.searchsorted(ends, start, "right") : first + np.searchsorted(starts, end, "left")] = kind + 1
        told: set[str] = set()  # tokens of this text that a cue makes a secret or a name
        for i in range(first, k):
            token = text[graph.spans[i][1] : graph.spans[i][2]]
            core = token[value_at(token) :].strip(ENDS)
            if SECRET_CUE in graph.own[i] and len(core) >= 6 and (not core.isalpha() or '"' in token) or KEY in graph.own[i]:
                told.add(core.lower())
            elif NAME_CUE in graph.own[i] and core.isalpha():
                told.add(core.lower())
        for i in range(first, k) if told else ():
            token = text[graph.spans[i][1] : graph.spans[i][2]]
            if not y[i] and token[value_at(token) :].strip(ENDS).lower() in told:
                y[i] = PRIVATE
    return y


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood: each label given its neighbours', by Adam on all nodes."""
    graph = Graph(texts)
    y = silver(graph, texts)
    w = {"unary": np.zeros((3 * N_TOKEN, K)), "chain": np.zeros((K, K)), "skip": np.zeros((K, K))}
    if not graph.n:
        return w
    one = np.eye(K)[y]
    left, right, linked = np.zeros((graph.n, K)), np.zeros((graph.n, K)), np.zeros((graph.n, K))
    left[graph.chain[:, 1]] = one[graph.chain[:, 0]]
    right[graph.chain[:, 0]] = one[graph.chain[:, 1]]
    np.add.at(linked, graph.skip[:, 1], one[graph.skip[:, 0]])
    np.add.at(linked, graph.skip[:, 0], one[graph.skip[:, 1]])
    # Each token with a skip edge has two more copies: one without features and neighbours, one with nothing but features.
    joined_up = np.flatnonzero(linked.any(1))
    blank, nothing = np.zeros((len(joined_up), 3 * N_TOKEN)), np.zeros((len(joined_up), K))
    blank[:, 0] = 1
    x, one = np.vstack([graph.x, blank, graph.x[joined_up]]), np.vstack([one, one[joined_up], one[joined_up]])
    linked, left, right = np.vstack([linked, linked[joined_up], nothing]), np.vstack([left, nothing, nothing]), np.vstack([right, nothing, nothing])
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for t in range(1, STEPS + 1):
        s = x @ w["unary"] + left @ w["chain"] + right @ w["chain"].T + linked @ w["skip"]
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        e = (p - one) / len(x)
        g = {"unary": x.T @ e, "chain": left.T @ e + (right.T @ e).T, "skip": linked.T @ e}
        g["skip"] = (g["skip"] + g["skip"].T) / 2
        for k in w:
            g[k] += RIDGE * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def marginals(graph: Graph, w: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node by damped sum-product message passing."""
    unary = graph.x @ w["unary"]
    edges = np.vstack([graph.chain, graph.skip])
    if not len(edges):
        top = unary - _logsum(unary)[:, None] if graph.n else unary
        return np.exp(top)
    potential = np.concatenate([np.repeat(w["chain"][None], len(graph.chain), 0), np.repeat(w["skip"][None], len(graph.skip), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([potential, potential.transpose(0, 2, 1)])  # [message, label at source, label at target]
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), K))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = belief[source] - messages[back]
        new = np.stack([_logsum(out + pair[:, :, k]) for k in range(K)], 1)
        new -= _logsum(new)[:, None]
        messages = DAMPING * messages + (1 - DAMPING) * new
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return np.exp(belief - _logsum(belief)[:, None])


def added_spans(texts: list[str], base: list[list[Span]], w: dict[str, np.ndarray]) -> list[list[Span]]:
    graph = Graph(texts)
    out: list[list[Span]] = [[] for _ in texts]
    if not graph.n:
        return out
    p = marginals(graph, w)
    label = np.where(p.max(1) >= THRESHOLD, p.argmax(1), 0)
    joined = {int(b): int(a) for a, b in graph.chain}
    runs: list[tuple[int, int, int, int]] = []  # document, kind, start, end; the last node of the run is the one before
    last = -2
    for i in np.flatnonzero(label).tolist():
        d, start, end = graph.spans[i]
        if runs and last == i - 1 and joined.get(i) == last and runs[-1][1] == label[i] - 1:
            runs[-1] = (*runs[-1][:3], end)
        else:
            runs.append((d, int(label[i]) - 1, start, end))
        last = i
    known = {d: _merged(base[d]) for d in {r[0] for r in runs}}
    for d, kind, start, end in runs:
        text = texts[d]
        if kind == PRIVATE - 1:
            start += value_at(text[start:end])
        while start < end and text[start] in ENDS and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in ENDS:
            end -= 1
        if kind == PRIVATE - 1 and text[start:end].replace(" ", "").isalpha() and text[start].isupper():
            kind = NAME
        if end > start and not _touches(known[d], start, end, kind == SECRET):
            out[d].append((kind, start, end))
    return out


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _touches(known: tuple[list[int], list[int]], start: int, end: int, may_cover: bool) -> bool:
    """Whether the span has something in common with what is known, other than wholly covering it if it may."""
    starts, ends = known
    at = bisect_left(starts, end) - 1  # the last that begins before the end
    if at < 0 or ends[at] <= start:
        return False
    return not (may_cover and ends[at] <= end and starts[bisect_right(ends, start)] >= start)


def find_spans(texts: list[str | None], w: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return list(zip(base, added_spans(whole, base, w)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; of overlapping ones the union goes under the first's kind."""
    if not spans:
        return text
    out, at, inside = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= inside:
            out.append(text[at:start])
            out.append(f"<{LABELS[kind].upper()}>")
        at = inside = max(inside, end)
    return "".join(out) + text[at:]


def train(df: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """Weights from the sample_docs texts with the smallest hashes among those that can hold personal data. One task holds them;
    the weights, of a fixed size, come back."""
    text = F.col(text_col)
    able = df.filter(text.rlike("[0-9@]|" + TITLE.pattern)).select(text.alias("t"), F.xxhash64(text).alias("h"))
    hashes = [r.h for r in able.select("h").distinct().orderBy("h").limit(sample_docs).collect()]
    if not hashes:
        return fit([])
    size = F.length("t")
    stretch = F.when(size <= sample_chars, F.col("t")).otherwise(F.substring(F.col("t"), (F.pmod("h", size - sample_chars + 1) + 1).cast("int"), F.lit(sample_chars)))
    sample = able.filter((F.col("h") <= hashes[-1]) & F.col("h").isin(hashes)).select("h", stretch.alias("t")).groupBy("h").agg(F.min("t").alias("t")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t in held]))], pa.binary())], names=["weights"])

    return pickle.loads(map_rows(sample, run, "weights binary").first().weights)


def spans_table(df: DataFrame, id_col: str, text_col: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """id_col and base and added spans: arrays of (kind, start, end)."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": LABELS[k], "start": s, "end": e} for k, s, e in sorted(spans)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = find_spans(part.column(1).to_pylist(), weights)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([rows(f[i]) for f in found], kind) for i in (0, 1))], names=["id", "base", "added"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(named, run, f"id {named.schema['id'].dataType.simpleString()}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def mask_table(df: DataFrame, text_col: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """df with its texts masked."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                clean = [masked(t, b + a) for t, (b, a) in zip(texts, find_spans(texts, weights))]
                yield pa.RecordBatch.from_arrays([pa.array(clean, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return map_rows(df, run, df.schema)


def op10_pii(spark, sf_dir):
    """Personal data of every document; the counts and base_sha256 are those of the base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 512):  # a batch is bounded by bytes
                for base, added in find_spans(batch.column(1).slice(lo, 512).to_pylist(), weights):
                    n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return map_rows(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
