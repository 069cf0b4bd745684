"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A document is a bag of sentences. A sentence's score is the logistic function of the summed weights of its distinct
features (whole words and word beginnings); a document's score is the noisy-or of its sentences', 1 - prod(1 - p). The
weights are fitted to document labels only, and the sentence scores then locate the offending sentences. In a long document
the sentences that as many clean ones would match are held against what clean text has, so that length alone is no sign.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, packs, small_batches

#: Word beginnings of these many bytes are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: At most so many labelled documents of each class are fitted, and of each only this many MB of text in all.
SAMPLE_ROWS, SAMPLE_MB = 1500, 8
#: In the sample, a clean text counts by its first so many MB, as a part of it is as clean; a toxic one is used whole, up to so many MB.
CLEAN_MB, TOXIC_MB = 0.25, 2
#: -log(1 - p) that clean sentences may add up to by their number alone; so many times their mean is what chance explains of the others.
BACKGROUND, CHANCE = 0.1, 3
#: At most so many features get a weight.
FEATURES = 2000

RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("sentence_start", T.ArrayType(T.IntegerType())),
        T.StructField("sentence_end", T.ArrayType(T.IntegerType())),
        T.StructField("sentence_score", T.ArrayType(T.DoubleType())),
    ]
)

_IS_WORD = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
_IS_END = np.array([c in b".!?\n" for c in range(256)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of the joined texts, the sentence number of each, and the number of sentences of each text.

    A sentence ends at a full stop, exclamation mark, question mark or line end; every text has one sentence at least.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    word = np.concatenate(([False], _IS_WORD[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    stops = np.flatnonzero(_IS_END[data])
    text_end = np.cumsum([len(r) for r in raw])
    sentence = np.searchsorted(stops, start)
    counts = np.diff(np.append(0, np.searchsorted(stops, text_end)))
    h = SpanHasher(data)
    out, of = [h.spans(start, end)], [sentence]
    for k in PREFIXES:
        long = end - start > k
        out.append(h.spans(start[long], start[long] + k) ^ np.uint64(k))
        of.append(sentence[long])
    return np.concatenate(out), np.concatenate(of), counts


@dataclass
class Model:
    """hashes (sorted) and their weights; bias of every sentence; distinct -log(1 - p) of clean sentences, the largest first, and the means of what reaches each."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)  # passes every known feature and few others
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each sentence and the number of sentences of each text."""
        h, s, counts = features(texts)
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        h, s = h[at], s[at]
        i = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        at = self.hashes[i] == h if len(self.hashes) else np.zeros(len(h), bool)
        pair = np.unique(s[at].astype(np.int64) * len(self.hashes) + i[at])
        z = np.bincount(pair // max(1, len(self.hashes)), self.weights[pair % max(1, len(self.hashes))], minlength=int(counts.sum()))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))), counts

    def score(self, texts: list[str]) -> list[tuple[float, np.ndarray]]:
        p, counts = self.sentences(texts)
        parts = np.split(p, np.cumsum(counts)[:-1])
        return [(float(-np.expm1(-self.evidence(-np.log1p(-x)))), x) for x in parts]

    def calibrate(self, texts: list[str]) -> None:
        """Take the background from the sentences of clean texts."""
        q = [-np.log1p(-self.sentences(texts[part])[0]) for part in packs([len(t) for t in texts])]
        levels, n = np.unique(np.concatenate(q), return_counts=True) if q else (np.zeros(0), np.zeros(0))
        self.levels, self.reach = levels[::-1], np.cumsum((levels * n)[::-1]) / max(1, n.sum())

    def evidence(self, q: np.ndarray) -> float:
        """The sum of a document's -log(1 - p), less what its length explains.

        A sentence counts in full above the level down to which as many clean sentences would add up to BACKGROUND; that is 0 for
        short documents, and at most p = 0.5, where a sentence is toxic alone. The others count by what they have beyond chance.
        """
        k = int(np.searchsorted(self.reach, BACKGROUND / len(q), side="right"))
        if k == len(self.reach):
            return float(q.sum())
        full = q > (min(self.levels[k], np.log(2)) if k else np.log(2))
        return float(q[full].sum() + max(0.0, q[~full].sum() - CHANCE * self.reach[-1] * len(q)))


def train(texts: list[str], labels: np.ndarray, *, steps: int = 300, rate: float = 0.1, l2: float = 1e-2) -> Model:
    """Fit the noisy-or of sentence scores to document labels by full-batch Adam.

    Only features that occur in six documents or more, and in toxic ones at least twice as often as in others, or
    the reverse, get a weight. Without both classes the model is a constant.
    """
    y = np.asarray(labels, float)
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(base / (1 - base))))
    hs, ss, ds, n, doc_of = [], [], [], 0, []
    for part in packs([len(t) for t in texts]):
        h, s, counts = features(texts[part])
        d = np.repeat(np.arange(part.start, part.start + len(counts)), counts)
        hs.append(h), ss.append((s + n).astype(np.int32)), ds.append(d[s].astype(np.int32)), doc_of.append(d)
        n += len(d)
    # this runs in the driver: what is not needed any more is let go at once
    h, s, d, doc = (np.concatenate(x) for x in (hs, ss, ds, doc_of))
    del hs, ss, ds, doc_of
    distinct, f = np.unique(h, return_inverse=True)
    del h
    f = f.astype(np.int32)
    pair = np.unique(f * np.int64(len(y)) + d)
    del d
    bad = np.bincount(pair // len(y), y[pair % len(y)], minlength=len(distinct))
    good = np.bincount(pair // len(y), minlength=len(distinct)) - bad
    lift = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / (len(y) - y.sum() + 1))
    use = np.flatnonzero((bad + good >= 6) & (np.abs(lift) > np.log(2)))
    use = np.sort(use[np.argsort(-np.abs(lift[use]) * np.sqrt((bad + good)[use]), kind="stable")[:FEATURES]])
    slot = np.full(len(distinct), -1)
    slot[use] = np.arange(len(use))
    on = slot[f] >= 0
    k = max(1, len(use))
    pair = np.unique(s[on].astype(np.int64) * k + slot[f[on]])
    row, col = pair // k, pair % k
    del f, s, on, pair
    w, b = np.zeros(k), -4.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(row, w[col], minlength=n) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        q = np.clip(np.bincount(doc, np.log1p(-p), minlength=len(y)), -30, -1e-9)  # log of the chance of no toxic sentence
        # d loss / d z: for a clean document each sentence adds p; for a toxic one p is weighted by -e^q / (1 - e^q)
        g = p * np.where(y > 0, -1 / np.expm1(-q), 1.0)[doc] / len(y)
        grad = np.append(np.bincount(col, g[row], minlength=k) + l2 * w / len(y), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    order = np.argsort(distinct[use])
    model = Model(distinct[use][order], w[order], float(b))
    model.calibrate([t for t, bad in zip(texts, y, strict=True) if not bad])
    return model


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, rows: int, mb: int) -> DataFrame:
    """The texts of at most ``rows`` ids of each class, the first by a hash of the id; long clean texts by their beginning.

    A toxic text beyond TOXIC_MB is left out, as any part of it may be without what makes it toxic. Ids are chosen from the labels alone, so what is broadcast to the documents is ``2 * rows`` ids, whatever the input.
    """
    clean, toxic = (int(min(x, mb) * 1_000_000) for x in (CLEAN_MB, TOXIC_MB))
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__y")).filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = [known.filter(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(rows) for c in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).filter("__text is not null")
    known = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "__id").filter((F.col("__y") == 0) | (F.length("__text") <= toxic))
    return known.withColumn("__text", F.when(F.col("__y") == 0, F.substring("__text", 1, clean)).otherwise(F.col("__text")))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, mb: int = SAMPLE_MB) -> Model:
    """A model from a bounded sample of labelled documents.

    Rows with a null id, text or label, or a label other than 0 and 1, are left out; of repeated labels of one id the
    larger counts. The sample is the only data that reaches the driver: the texts of twice ``rows`` ids at most, in hash order.
    One that would take the sample beyond ``mb`` is passed over, and reading ends when twice ``mb`` are read.
    """
    got, total, read = [], 0, 0
    chosen = sample(docs, labels, doc_id=doc_id, text=text, label=label, rows=rows, mb=mb)
    for r in chosen.orderBy(F.xxhash64("__id"), "__id").select("__text", "__y").toLocalIterator():
        read += len(r[0])
        if total + len(r[0]) <= mb * 1_000_000:
            total += len(r[0])
            got.append((r[0], r[1]))
        if read > 2 * mb * 1_000_000:
            break
    return train([t for t, _ in got], np.array([y for _, y in got]))


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into``: score (0 to 1) and, for each sentence, start, end (characters) and score.

    Null and empty texts are one empty sentence with the model's base score. All columns of ``docs`` stay; one that is
    called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        whole, rows = [t or "" for t in texts], []
        for part in packs([len(t) for t in whole]):
            for t, (p, each) in zip(whole[part], model.score(whole[part]), strict=True):
                u = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
                stop = np.append(np.flatnonzero((u == 0x2E) | (u == 0x21) | (u == 0x3F) | (u == 0x0A)), len(u))
                rows.append((p, np.append(0, stop[:-1] + 1).astype(np.int32), stop.astype(np.int32), each))
        return pd.DataFrame(rows, columns=["score", "sentence_start", "sentence_end", "sentence_score"])

    return docs.withColumn(into, run(F.col(text)))
