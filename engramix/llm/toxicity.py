"""Operator 6, toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word edges) and of itself, hashed into buckets; a
window of words averages its bags' vectors and a linear softmax scores it. A document's score is that
of its most toxic window: toxic passages are short, and an average over a whole long text would drown
them. Misspelt words share most n-gram vectors with the words that were seen.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 6)
WINDOW = 3
#: Documented bound of the training sample: labelled rows of each class, the least by hash of the id, and characters over all.
PER_CLASS = 3000
MAX_CHARS = 30_000_000

_WORD = re.compile(r"\w+")
#: Runs of word characters longer than this are split: at underscores, and what is still longer into pieces of PIECE, each half over the next.
LONG, PIECE = 40, 20


def _text_words(text: str | None) -> list[str]:
    """The runs of word characters of a text in lower case; all of a long run is kept, as several words."""
    ws = _WORD.findall(text.lower()) if text else []
    if not ws or max(map(len, ws)) <= LONG:
        return ws
    out = []
    for w in ws:
        for x in ([w] if len(w) <= LONG else [x for x in w.split("_") if x] or [w]):
            out.extend([x] if len(x) <= LONG else [x[i : i + PIECE] for i in range(0, len(x) - PIECE // 2, PIECE // 2)])
    return out


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    out = {w}
    for n in range(NGRAMS[0], NGRAMS[1] + 1):
        out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in out})


class _Words(dict):
    """Each word's place in two tables: the sum of its buckets' weights and their number. New words enter when asked for."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight, self.sums, self.counts = weight, np.empty(1 << 12), np.empty(1 << 12)

    def __missing__(self, w: str) -> int:
        i = len(self)
        if i == len(self.sums):
            self.sums, self.counts = np.resize(self.sums, 2 * i), np.resize(self.counts, 2 * i)
        ids = _grams(w)
        self.sums[i], self.counts[i] = float(self.weight[ids].sum()), len(ids)
        self[w] = i
        return i


class Model:
    """Scores texts. weight holds each bucket's embedding times the softmax direction, so a window's logit is a mean of bucket weights."""

    def __init__(self, weight: np.ndarray, bias: float, scale: float = 1.0):
        self.weight, self.bias, self.scale = weight, bias, scale
        self.words = _Words(weight)

    def score(self, text: str | None) -> float:
        ws = _text_words(text)
        if not ws:
            return float(1 / (1 + np.exp(-self.scale * self.bias)))
        if len(self.words) > 500_000:  # a cache only, of words of at most LONG characters; between texts, as places are in use within one
            self.words = _Words(self.weight)
        at = np.fromiter(map(self.words.__getitem__, ws), np.int64, len(ws))
        s, c = self.words.sums[at], self.words.counts[at]
        k = min(WINDOW, len(ws))
        s, c = np.cumsum(np.concatenate(([0.0], s))), np.cumsum(np.concatenate(([0.0], c)))
        top = ((s[k:] - s[:-k]) / (c[k:] - c[:-k])).max()
        return float(1 / (1 + np.exp(-self.scale * (top + self.bias))))


def train(texts: list[str], labels: list[int], epochs: int = 12, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax.

    Documents are bags of windows; the loss is that of the best window, so gradients of a toxic text
    go to the window that looks most toxic and those of a clean text to the window that looks so by
    mistake. Embeddings start from the log-odds of the words that hold their n-gram, which finds the
    telling windows; with two classes the gradient of an embedding points along the difference of the
    softmax rows, which is trained with them. Without texts of both classes nothing can be learnt:
    every text, the empty one too, then scores the share of label 1, but under 0.5.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs, grams = [], []
    for t in texts:
        ws = _text_words(t)
        ids = []
        for w in ws:
            i = vocab.get(w)
            if i is None:
                i = vocab[w] = len(grams)
                grams.append(np.array(_grams(w), np.int32))
            ids.append(i)
        docs.append(np.array(ids, np.int32))
    if not docs or len(set(labels)) < 2:
        prior = (sum(labels) + 1) / (len(labels) + 2)
        prior = min(prior, 0.49)
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    y = np.array(labels, float)
    n_words = len(grams)
    count = np.array([len(g) for g in grams], float)
    flat = np.concatenate(grams) if grams else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n_words), count.astype(int))
    # log-odds of words by the share of clean and toxic texts that hold them starts the embeddings off
    pos, neg = np.zeros(n_words), np.zeros(n_words)
    for d, t in zip(docs, labels, strict=True):
        u = np.unique(d)
        (pos if t else neg)[u] += 1
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    mass, seen = np.zeros(BUCKETS), np.zeros(BUCKETS)
    trust = np.minimum(1.0, (pos + neg) / 5)
    np.add.at(mass, flat, (odds * trust)[owner])
    np.add.at(seen, flat, trust[owner])
    first = mass / (seen + 1)
    out = rng.normal(0, 0.5, DIM)
    out /= np.linalg.norm(out)
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)) + first[:, None] * out[None, :]
    bias, lr = -1.0, 0.5
    g2 = np.full(BUCKETS, 1e-2)
    pair = np.stack([-out / 2, out / 2])  # softmax rows of the two classes; their difference is the direction
    for _ in range(epochs):
        direction = pair[1] - pair[0]
        weight = emb @ direction
        word_sum = np.bincount(owner, weight[flat], n_words)
        grad_w = np.zeros(BUCKETS)
        grad_dir = np.zeros(DIM)
        grad_b = 0.0
        for i, d in enumerate(docs):
            if not len(d):
                continue
            k = min(WINDOW, len(d))
            s = np.concatenate(([0.0], np.cumsum(word_sum[d])))
            c = np.concatenate(([0.0], np.cumsum(count[d])))
            z = (s[k:] - s[:-k]) / (c[k:] - c[:-k])
            j = int(z.argmax())
            p = 1 / (1 + np.exp(-(z[j] + bias)))
            g = (p - y[i]) * (n0 / n1 if y[i] else 1.0)
            if abs(g) < 1e-4:
                continue
            ids = np.concatenate([grams[w] for w in d[j : j + k]])
            np.add.at(grad_w, ids, g / len(ids))
            grad_dir += g * emb[ids].mean(0)
            grad_b += g
        hit = np.flatnonzero(grad_w)
        g2[hit] += grad_w[hit] ** 2
        emb[hit] -= (lr * grad_w[hit] / np.sqrt(g2[hit]))[:, None] * direction[None, :]
        step = 0.05 * grad_dir / (np.linalg.norm(grad_dir) + 1e-9)
        pair[1] -= step / 2
        pair[0] += step / 2
        bias -= 0.05 * np.sign(grad_b) * min(1.0, abs(grad_b) / 10)
    model = Model(emb @ (pair[1] - pair[0]), bias)
    _calibrate(model, docs, grams, y)
    return model


def _calibrate(model: Model, docs, grams, y: np.ndarray) -> None:
    """Slope and bias of the final logit by logistic regression on the training sample's top windows."""
    word = np.array([model.weight[g].sum() for g in grams])
    count = np.array([len(g) for g in grams], float)
    z = np.zeros(len(docs))
    for i, d in enumerate(docs):
        if len(d):
            k = min(WINDOW, len(d))
            s, c = np.concatenate(([0.0], np.cumsum(word[d]))), np.concatenate(([0.0], np.cumsum(count[d])))
            z[i] = ((s[k:] - s[:-k]) / (c[k:] - c[:-k])).max()
    # the cut that separates best, in the middle of the widest gap of best cost
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    cost = np.concatenate(([(1 - ys).sum()], (1 - ys).sum() - np.cumsum(1 - ys) + np.cumsum(ys)))
    edges = np.concatenate(([zs[0] - 1], zs, [zs[-1] + 1]))
    best = np.flatnonzero(cost == cost.min())
    gap = edges[best + 1] - edges[best]
    k = int(best[gap.argmax()])
    at = (edges[k] + edges[k + 1]) / 2
    spread = max(1e-3, float(np.median(np.abs(z - at))))
    model.bias = -float(at)
    model.scale = 3.0 / spread


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows outside the held-out fold (crc32 of the id as text, mod 5, is not 0).

    Training reads at most per_class ids of each class, those with the least hash of the id, and
    stops at MAX_CHARS characters; scores then cover every row. Labels other than 0 and 1 and ids
    that are null or missing in docs are left out; an id with both labels trains as both, one with
    several rows as each of them, and repeated labels once. Without rows of both classes see train.
    """
    lab = labels.filter(F.col(label).isin(0, 1) & (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) != 0)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    picked = None
    for v in (0, 1):
        part = lab.filter(F.col("_y") == v).orderBy(F.xxhash64(F.col("_id"), F.lit("toxicity")), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    got = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(picked), "_id").orderBy(F.xxhash64(F.col("_id"), F.lit("toxicity")), "_id", "_t")
    texts, ys, size = [], [], 0
    for r in got.toLocalIterator():
        texts.append(r["_t"] or "")
        ys.append(r["_y"])
        size += len(texts[-1])
        if size > MAX_CHARS:
            break
    return train(texts, ys)


def _shared(docs: DataFrame, model: Model):
    """The model for the executors, 512 KB. A worker keeps it, and the words it has met, from task to task."""
    return docs.sparkSession.sparkContext.broadcast(Model(model.weight.astype(np.float32), model.bias, model.scale))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row; null and empty texts, and texts without words, get the score of an empty bag.

    Rows are scored one by one: repeated rows and null keys repeat, other columns are ignored, an
    empty table gives no rows.
    """
    shared = _shared(docs, model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches threshold, all columns kept.

    Rows without words stay, and so do all rows if the model saw one class only (at a threshold of 0.5
    or more). Repeated rows share their fate.
    """
    shared = _shared(docs, model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([not _WORD.search(t) or m.score(t) < threshold if t else True for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
