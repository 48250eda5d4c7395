r"""Document quality by a linear-chain conditional random field over lines.

Every `\n`-split line of a text gets features of its own and of its neighbours; the field labels it good or bad, and
forward-backward marginals, weighted by line length, average to the document's share of good lines. A power of it, chosen
from POWERS by likelihood on the fitted documents, is the score.

Labels are of documents; those of lines are latent. The fit starts from a model of single lines that gives each line its
document's label, then goes ROUNDS times through two steps: the lines' posteriors under the field, shifted alike in a document
until its share of good lines is at least GOOD_LEAST (label 1) or at most BAD_MOST (label 0); and the field, by L-BFGS, that
expects these posteriors and moves. So a bad document may have good lines, and a move between labels is learned where it is.
The fit runs on the driver, on at most FIT_ROWS labelled documents taken by a hash, of a document with more than FIT_LINES
lines on so many consecutive ones from a place picked by a hash. All else, features and scores, is made where the text is.

Nothing but the text enters a score. Defined cases: null and empty texts count as one empty line and get a score; with no
labelled rows at all every score is FLAT; a null doc_id is not held out; repeated rows score alike; whole texts are read;
other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, renamed, running, slices, split_words

#: Labelled documents, and lines of one, that the fit uses at most; score where nothing is labelled; penalty of the fit.
FIT_ROWS, FIT_LINES, FLAT, RIDGE = 3000, 200, 0.5, 1.0
#: Steps of the first model and of each later one, rounds, steps by which a document's shift is found.
STEPS, LATER, ROUNDS, HALVES = 40, 20, 3, 12
#: Share of good lines (by length) that a good document has at least and a bad one at most; powers of the share to choose from.
GOOD_LEAST, BAD_MOST, POWERS = 0.9, 0.5, (1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
#: Features of a line itself; those of the line before and of that after follow.
OWN = 16

CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ",.;:", " \t")


def _tables() -> np.ndarray:
    t = np.zeros((len(CLASSES) + 1, 256), np.uint8)
    for i, chars in enumerate(CLASSES):
        t[i, [ord(c) for c in chars]] = 1
    t[-1] = (np.arange(256) & 0xC0) != 0x80  # starts of code points
    return t


TABLES = _tables()


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its text's index, its weight."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    lines = lists.flatten()
    n, doc = len(lines), np.repeat(np.arange(len(texts)), counts)
    off = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    sums = []
    for t in TABLES:
        c = running(t[data])
        sums.append(c[off[1:]] - c[off[:-1]])
    upper, lower, digit, symbol, shout, stop, blank, chars = (x.astype(float) for x in sums)
    codes, vocabulary, owner = split_words(lines)
    words = np.bincount(owner, minlength=n).astype(float)
    pair = np.unique(owner * max(len(vocabulary), 1) + codes)
    distinct = np.bincount(pair // max(len(vocabulary), 1), minlength=n).astype(float)
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(doc * (n + 1) + code, return_index=True)
    again = np.ones(n)
    again[first] = 0
    again[words == 0] = 0
    last = data[np.maximum(off[1:] - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    per = 1 / np.maximum(chars, 1)
    letters = np.maximum(upper + lower, 1)
    own = np.stack(
        [
            (symbol * per) ** 0.5, symbol * per, (upper / letters) ** 0.5, upper / letters, (shout * per) ** 0.5, digit * per, stop / np.maximum(words, 1),
            1 - distinct / np.maximum(words, 1), again, np.log1p(words) / 4, chars / np.maximum(words, 1) / 10, np.isin(last, [46, 33, 63]) * 1.0 * (chars > 0), (words == 0) * 1.0,
            (symbol / np.maximum(words, 1) > 0.2) * 1.0, (shout / np.maximum(words, 1) > 0.2) * 1.0, (upper / letters > 0.6) * 1.0,
        ],
        axis=1,
    )
    same = np.concatenate([[False], doc[1:] == doc[:-1]])[:n]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same[1:]] = own[:-1][same[1:]]
    after[:-1][same[1:]] = own[1:][same[1:]]
    ends = np.stack([~same, ~np.concatenate([same[1:], [False]])[:n], np.ones(n, bool)], axis=1).astype(float)
    return np.concatenate([own, before, after, ends], axis=1), doc, chars + 1


class Chains:
    """Lines of many documents in time-major order: at each step, the documents that have so many lines."""

    def __init__(self, doc: np.ndarray, docs: int):
        size = np.bincount(doc, minlength=docs)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(-size, kind="stable")
        self.steps = []
        alive, t = docs, 0
        ordered = size[order]
        while alive := int(np.searchsorted(-ordered[:alive], -t, side="left")):
            self.steps.append(start[order[:alive]] + t)
            t += 1


def marginals(e: np.ndarray, a: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of log-odds e of label 1 at each line and transition weights a (2x2): P(label 1), expected transitions, log Z of each document by chain order."""
    unary = np.stack([np.zeros_like(e), e], axis=1)
    f, b = np.zeros_like(unary), np.zeros_like(unary)
    for t, at in enumerate(chains.steps):
        f[at] = unary[at] + (np.logaddexp(f[prev[: len(at)], 0, None] + a[0], f[prev[: len(at)], 1, None] + a[1]) if t else 0)
        prev = at
    for t in range(len(chains.steps) - 1, 0, -1):
        at, prev = chains.steps[t], chains.steps[t - 1][: len(chains.steps[t])]
        x = unary[at] + b[at]
        b[prev] = np.logaddexp(x[:, 0, None] + a[:, 0], x[:, 1, None] + a[:, 1])
    z = np.zeros(len(e))
    first = chains.steps[0]
    total = np.logaddexp(*(f[first] + b[first]).T)
    for at in chains.steps:
        z[at] = total[: len(at)]
    moves = np.zeros((2, 2))
    for t in range(1, len(chains.steps)):
        at, prev = chains.steps[t], chains.steps[t - 1][: len(chains.steps[t])]
        for i in (0, 1):
            for j in (0, 1):
                moves[i, j] += np.exp(f[prev, i] + a[i, j] + unary[at, j] + b[at, j] - z[at]).sum()
    return np.exp(f[:, 1] + b[:, 1] - z), moves, total


def lbfgs(fun, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimises fun (value, gradient) with backtracking."""
    v, g = fun(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, al = g.copy(), []
        for s, y in reversed(past):
            al.append((s @ q) / (s @ y))
            q -= al[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, np.abs(q).sum())
        for (s, y), k in zip(past, reversed(al)):
            q += s * (k - (y @ q) / (s @ y))
        step, slope = 1.0, -(g @ q)
        if slope >= -1e-9:
            break
        while step > 1e-8:
            w, h = fun(x - step * q)
            if w <= v + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, h - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        x, v, g = x + s, w, h
    return x


def _fitted(x: np.ndarray, chains: Chains, targets: np.ndarray, seen: np.ndarray, w: np.ndarray, steps: int, use: np.ndarray) -> np.ndarray:
    """Weights (features, then 2x2 transitions; those not in `use` stay 0) whose field expects targets and moves."""
    k = x.shape[1]

    def loss(w):
        e, a = x @ w[:k], w[k:].reshape(2, 2)
        p, moves, total = marginals(e, a, chains)
        v = total.sum() - (e * targets).sum() - (seen * a).sum() + RIDGE * 0.5 * (w @ w)
        return v, (np.concatenate([x.T @ (p - targets), (moves - seen).ravel()]) + RIDGE * w) * use

    return lbfgs(loss, w * use, steps)


def shares(p: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Share of good lines of each document, by length."""
    return np.clip(np.bincount(doc, p * weight, docs) / np.bincount(doc, weight, docs), 0, 1)


def bounded_shift(e: np.ndarray, a: np.ndarray, doc: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What to add to the log odds of each document's lines so that its share keeps the bound of its label."""
    share = shares(marginals(e, a, Chains(doc, len(labels)))[0], doc, weight, len(labels))
    shift, goal = np.zeros(len(labels)), np.where(labels == 1, GOOD_LEAST, BAD_MOST)
    off = np.flatnonzero(np.where(labels == 1, share < goal, share > goal))
    if not len(off):
        return shift
    number = np.full(len(labels), -1)
    number[off] = np.arange(len(off))
    mine = number[doc] >= 0
    e, doc, weight = e[mine], number[doc[mine]], weight[mine]
    chains, low, high = Chains(doc, len(off)), np.full(len(off), -32.0), np.full(len(off), 32.0)
    for _ in range(HALVES):
        middle = (low + high) / 2
        less = shares(marginals(e + middle[doc], a, chains)[0], doc, weight, len(off)) < goal[off]
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    shift[off] = np.where(labels[off] == 1, high, low)
    return shift


def fit(x: np.ndarray, doc: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> dict:
    """Weights of the field from the lines' features, their documents (in order) and weights, and the documents' labels."""
    weight = np.ones(len(doc)) if weight is None else weight
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[-1] = 1
    x, chains, k = x / scale, Chains(doc, len(labels)), x.shape[1]
    alone = np.zeros(k + 4)
    alone[:OWN] = alone[k - 1] = 1  # a line by itself
    w = _fitted(x, chains, labels[doc].astype(float), np.zeros((2, 2)), np.zeros(k + 4), STEPS, alone)
    for _ in range(ROUNDS):
        e, a = x @ w[:k], w[k:].reshape(2, 2)
        q, moves, _ = marginals(e + bounded_shift(e, a, doc, weight, labels)[doc], a, chains)
        w = _fitted(x, chains, q, moves, w, LATER, np.ones(k + 4))
    model = {"w": w[:k] / scale, "a": w[k:].reshape(2, 2), "power": 1.0}
    share = np.clip(shares(marginals(x @ w[:k], model["a"], chains)[0], doc, weight, len(labels)), 1e-6, 1 - 1e-6)
    model["power"] = max(POWERS, key=lambda z: float(np.where(labels == 1, np.log(share**z), np.log1p(-(share**z))).sum()))
    return model


def score_texts(texts: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), FLAT)
    x, doc, weight = line_features(texts)
    p, _, _ = marginals(x @ model["w"], model["a"], Chains(doc, len(texts)))
    return shares(p, doc, weight, len(texts)) ** model["power"]


def _lines(batches):
    """Features and weights of labelled documents' lines, one row each; of many lines FIT_LINES consecutive ones."""
    for b in slices(batches, "text"):
        x, doc, weight = line_features(b.column("text"))
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))])
        rows = np.concatenate([x, weight[:, None]], axis=1).astype(np.float32)
        more = np.maximum(np.diff(at) - FIT_LINES, 0)
        start = at[:-1] + (mix(np.diff(at).astype(np.uint64)) % (more + 1).astype(np.uint64)).astype(np.int64)
        rows = [rows[i : min(i + FIT_LINES, j)].tobytes() for i, j in zip(start, at[1:])]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.binary())], ["label", "lines"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1); at most `rows` of them, by a hash of doc_id. None without both labels."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows` ids: broadcast, so that the texts stay where they are; a doc_id may be repeated, so rows are bounded again
    found = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_lines, "label int, lines binary").orderBy(F.xxhash64("lines"), "lines").limit(rows).collect()
    if len({r.label for r in found}) < 2:
        return None
    size = len(line_features(pa.array(["a"]))[0][0]) + 1
    parts = [np.frombuffer(r.lines, np.float32).reshape(-1, size).astype(float) for r in found]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    every = np.concatenate(parts)
    return fit(every[:, :-1], doc, np.array([r.label for r in found]), every[:, -1])


def _score(batches, model, names):
    for b in slices(batches, "text"):
        s = score_texts(b.column("text"), model)
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s)], [*names, "score"])


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (columns c0, c1, ..., and text) with the column `score` in place of text."""
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(T.StructField(n, docs.schema[n].dataType) for n in names), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(partial(_score, model=model, names=names), schema)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the field is fitted on labelled rows that aren't held out."""
    use = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out())
    out = scored(docs.select(F.col("doc_id").alias("c0"), F.col("text").cast("string").alias("text")), train(docs, use))
    return out.select(F.col("c0").alias("doc_id"), "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns."""
    use = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out())
    work, names = renamed(docs)
    out = scored(work.withColumn("text", F.col(names["text"]).cast("string")), train(docs, use))
    return out.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
