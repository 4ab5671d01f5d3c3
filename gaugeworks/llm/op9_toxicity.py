"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed vectors of the word and of its prefixes of
four and six letters, so inflected and compound forms share what is learned;
words and prefixes that fewer than ``KNOWN_DOCS`` training texts have stay at
zero, so that the rare words of single texts are not learned by heart.
Filters of one, two and three words slide over the whole text, each filter's
maximum is kept, and a linear layer makes the logit. The filters are linear
before pooling, so for scoring the hashed vectors are multiplied by them once,
and a text costs table look-ups, additions and maxima.

Training uses at most ``SAMPLE`` labelled rows of each class, those with the
smallest hash of doc_id, none of them held out, over their whole texts (long ones
in slices, of which max pooling keeps the strongest places); every document is
scored over its whole text. A fifth of the sample
calibrates a threshold for each language that the text itself shows (by
function words; of equal counts, the first in the alphabet), with class weights
that restore the labels' own proportions. A language with fewer than 40
calibrating texts, or ten of either class, takes the threshold of all, and below
200 texts the training texts calibrate; below 1,000 there are more rounds. The
score is the logistic function of the logit less the threshold, so that 0.5
is always the cut. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without words;
repeated rows get equal scores, and of rows that repeat a doc_id the text with
the smallest hash trains; a null doc_id is not held out and never trains;
labels that are null train nothing; without labels of both classes every score
is the share of toxic labels, at most 0.49; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import bound_batches, held, strings, table, text_of

#: Labelled rows of each class that train the model.
SAMPLE = 2500
BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS = 1 << 16, 16, 12, (1, 2, 3), 6
PREFIXES = (4, 6)
#: Training texts that must have a word or prefix for it to count.
KNOWN_DOCS = 10
#: Words of one scoring step; longer texts are scored in overlapping slices.
STEP_WORDS = 20_000
#: Common function words by language.
FUNCTION_WORDS = {
    "de": {"der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "auf", "für", "ein", "eine", "dem", "nicht"},
    "en": {"the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as", "on", "this", "at", "by"},
    "es": {"el", "que", "los", "se", "del", "las", "por", "con", "una", "para", "su", "al", "lo", "como", "más", "y"},
    "fr": {"le", "et", "les", "des", "est", "une", "du", "dans", "qui", "pour", "au", "sur", "pas", "par", "ne", "il"},
}
_STRIP = ".,;:!?\"'()[]{}<>*#%$&-_/\\«»“”’"


def buckets_of(word: str) -> bytes:
    """The hash buckets of a word and its prefixes, as unsigned 16-bit integers."""
    word = word.strip(_STRIP).lower()
    forms = [word, *(f"{n}^{word[:n]}" for n in PREFIXES)]
    return np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in forms], "<u2").tobytes()


def language(words: set[str] | dict) -> str:
    """The language whose function words the text shows most of; ``other`` without any."""
    best = max(FUNCTION_WORDS, key=lambda k: len(FUNCTION_WORDS[k] & words))
    return best if FUNCTION_WORDS[best] & words else "other"


@dataclass
class Model:
    """Weights: hashed vectors, filters by width and place, biases, output layer, thresholds."""

    vectors: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    const: float
    thresholds: dict[str, float]
    prior: float | None = None

    def projected(self) -> np.ndarray:
        """The hashed vectors times every filter place, one row a bucket."""
        places = [w[o] for w in self.filters for o in range(len(w))]
        return np.concatenate([self.vectors @ p for p in places], axis=1).astype(np.float32)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.const


class Words:
    """Splits texts into words and numbers a batch's distinct words."""

    def __init__(self) -> None:
        self.memo = PieceMemo(lambda ws: [buckets_of(w) for w in ws])

    def batch(self, texts: list[list[str]]) -> tuple[np.ndarray, dict[str, int]]:
        """Buckets of the distinct words, and each word's row."""
        distinct = list(set().union(*texts)) if texts else []
        rows = np.frombuffer(b"".join(self.memo.values([distinct])[0]), "<u2").reshape(len(distinct), 1 + len(PREFIXES))
        return rows, {w: i for i, w in enumerate(distinct)}


def _conv(places: np.ndarray) -> np.ndarray:
    """Filter outputs at each word from place-wise products; the last two rows must be padding."""
    n = len(places) - 2
    out, at = [], 0
    for width in WIDTHS:
        part = places[:n, at : at + FILTERS].copy()
        for o in range(1, width):
            part += places[o : n + o, at + o * FILTERS : at + (o + 1) * FILTERS]
        out.append(part)
        at += width * FILTERS
    return np.concatenate(out, axis=1)


def _strongest(x: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter is strongest in each text, and how strong; long texts are walked in slices."""
    best = np.zeros((len(begin), FILTERS * len(WIDTHS)), np.int64)
    pooled = np.full(best.shape, -np.inf, np.float32)
    for d, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        for at in range(b, b + n - 2, STEP_WORDS):
            end = min(at + STEP_WORDS, b + n - 2)
            flat = x[ids[at : end + 2]]
            conv = _conv(np.concatenate([flat @ w[o] for w in filters for o in range(len(w))], axis=1))
            where = conv.argmax(0)
            value = np.take_along_axis(conv, where[None], 0)[0]
            more = value > pooled[d]
            best[d, more], pooled[d, more] = at + where[more], value[more]
    return best, pooled


class Scorer:
    """Scores texts by a model; one per Python worker."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.table = model.projected() if model.prior is None else None

    def scores(self, texts: list[str]) -> list[float]:
        m = self.model
        if m.prior is not None:
            return [min(0.49, m.prior)] * len(texts)
        out: list[float] = []
        held: list[list[str]] = []
        total = 0
        for text in texts:
            words = text.split()
            held.append(words)
            total += len(words)
            if total >= STEP_WORDS:
                out += self._some(held)
                held, total = [], 0
        return out + (self._some(held) if held else [])

    def _some(self, docs: list[list[str]]) -> list[float]:
        slices: list[list[str]] = []
        owner: list[int] = []
        cut: list[bool] = []
        for d, words in enumerate(docs):
            for at in range(0, max(1, len(words)), STEP_WORDS):
                slices.append(words[at : at + STEP_WORDS + 2])
                owner.append(d)
                cut.append(at + STEP_WORDS < len(words))
        pooled = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        start = 0
        while start < len(slices):
            end, n = start, 0
            while end < len(slices) and (n == 0 or n + len(slices[end]) <= 2 * STEP_WORDS):
                n += len(slices[end]) + 2
                end += 1
            got = self._pool(slices[start:end], cut[start:end])
            for d, row in zip(owner[start:end], got, strict=True):
                np.maximum(pooled[d], row, out=pooled[d])
            start = end
        tau = np.array([self.model.thresholds.get(language({w.lower() for w in words}), self.model.thresholds["other"]) for words in docs])
        z = np.clip(self.model.logit(pooled) - tau, -30, 30)
        return (1 / (1 + np.exp(-z))).tolist()

    def _pool(self, slices: list[list[str]], cut: list[bool]) -> np.ndarray:
        rows, index = self.words.batch(slices)
        places = np.zeros((len(rows) + 1, self.table.shape[1]), np.float32)
        for k in range(rows.shape[1]):
            places[:-1] += self.table[rows[:, k]]
        pad = len(rows)
        ids = np.fromiter((i for s in slices for i in (*map(index.__getitem__, s), pad, pad, pad, pad)), np.int64)
        size = np.array([len(s) + 4 for s in slices])
        begin = np.cumsum(size) - size
        conv = _conv(np.concatenate([places[ids], np.zeros((2, places.shape[1]), np.float32)]))
        # Filters that start at the last two pads would reach into the next text.
        conv[begin + size - 1] = conv[begin + size - 2] = -np.inf
        for k in np.flatnonzero(cut):  # the next slice begins with the words that overlap
            conv[begin[k] + STEP_WORDS : begin[k] + size[k]] = -np.inf
        return np.maximum.reduceat(conv, begin, axis=0)


def train(texts: list[str], toxic: list[int], clean_weight: float, seed: int = 7) -> Model:
    """Fit the classifier; ``clean_weight`` is how many clean labels each sampled clean row stands for."""
    y = np.array(toxic, np.float64)
    if len(set(toxic)) < 2:
        return Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0, {"other": 0.0}, prior=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    const = np.zeros(1, np.float32)
    squares = {id(p): np.full(p.shape, 1e-3, np.float32) for p in (vectors, bias, out, const, *filters)}

    def step(p: np.ndarray, g: np.ndarray, at: np.ndarray | slice = slice(None), rate: float = 0.05) -> None:
        s = squares[id(p)]
        s[at] += g * g
        p[at] -= rate * g / np.sqrt(s[at])

    # Words are numbered once; a text is an array of numbers, and the row after the last word is the padding.
    index: dict[str, int] = {}
    numbered = [np.fromiter((index.setdefault(w, len(index)) for w in t.split()), np.int32) for t in texts]
    pad = len(index)
    rows = np.frombuffer(b"".join(map(buckets_of, index)), "<u2").reshape(pad, 1 + len(PREFIXES))
    tongue = [language({w.lower() for w in t.split()}) for t in texts]
    del index
    # Words and prefixes that few texts have say nothing of other texts: they stay at zero.
    seen = np.zeros(BUCKETS, np.int32)
    for some in numbered:
        seen[np.unique(rows[np.unique(some)])] += 1
    known = seen >= min(KNOWN_DOCS, 1 + len(texts) // 100)
    vectors[~known] = 0
    checks = np.arange(len(texts)) % 5 == 0 if len(texts) >= 200 else np.zeros(len(texts), bool)
    fit = np.flatnonzero(~checks)
    for _ in range(EPOCHS if len(fit) > 1000 else 3 * EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), 32):
            some = fit[at : at + 32]
            docs = [numbered[i] for i in some]
            padded = [part for d in docs for part in (d, np.full(4, pad))]
            used, ids = np.unique(np.r_[(*padded, pad, pad)].astype(np.int64), return_inverse=True)
            own = rows[used[:-1]]  # the last is the padding
            x = np.concatenate([vectors[own].sum(1), np.zeros((1, DIM), np.float32)])
            size = np.array([len(d) + 4 for d in docs])
            begin = np.cumsum(size) - size
            best, pooled = _strongest(x, ids, begin, size, filters)
            hidden = np.maximum(pooled + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + const, -30, 30)))
            err = ((p - y[some]) / len(some)).astype(np.float32)
            back = err[:, None] * out * (hidden > 0)
            grow = np.zeros((len(x), DIM), np.float32)
            for k, w in enumerate(filters):
                part, where = back[:, k * FILTERS : (k + 1) * FILTERS], best[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(w)
                for o in range(len(w)):
                    word = ids[where + o]
                    g[o] = np.einsum("bfd,bf->df", x[word], part)
                    np.add.at(grow, word, part[:, :, None] * w[o].T[None])
                step(w, g)
            step(out, hidden.T @ err)
            step(bias, back.sum(0))
            step(const, err.sum(keepdims=True))
            hit = np.flatnonzero(np.abs(grow[:-1]).sum(1) > 0)
            if len(hit):
                target, inverse = np.unique(own[hit], return_inverse=True)
                g = np.zeros((len(target), DIM), np.float32)
                np.add.at(g, inverse.reshape(own[hit].shape), grow[hit][:, None, :])
                step(vectors, g[known[target]], target[known[target]])
    model = Model(vectors, filters, bias, out, float(const[0]), {"other": 0.0})
    judged = np.flatnonzero(checks) if checks.any() else np.arange(len(texts))
    scorer = Scorer(model)
    logits = np.array([math.log(s / (1 - s)) for s in scorer.scores([texts[i] for i in judged])])
    tongue = [tongue[i] for i in judged]
    weight = np.where(y[judged] > 0, 1.0, clean_weight)
    model.thresholds["other"] = _cut(logits, y[judged], weight)
    for name in FUNCTION_WORDS:
        own = np.array([t == name for t in tongue])
        if own.sum() >= 40 and 10 <= y[judged][own].sum() <= own.sum() - 10:
            model.thresholds[name] = _cut(logits[own], y[judged][own], weight[own])
    return model


def _cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the least weighted error; of equals, the middle of the widest gap."""
    order = np.argsort(logits, kind="stable")
    z, pos, w = logits[order], y[order], weight[order]
    error = np.r_[0.0, np.cumsum(np.where(pos > 0, w, -w))] + w[pos == 0].sum()
    edge = np.r_[z[0] - 2, z, z[-1] + 2]
    gap = np.where(error <= error.min() + 1e-9, edge[1:] - edge[:-1], -1.0)
    k = int(gap.argmax())
    return float((edge[k] + edge[k + 1]) / 2)


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out, in one task."""
    import pandas as pd

    used = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0")
    used = used.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {int(r[0]): r[1] for r in used.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        some = used.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * sample rows of two integers: small enough to broadcast at any size.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat a number, one text trains, so the training task's input is bounded too.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    clean_weight = max(1.0, count.get(0, 0) / sample) / max(1.0, count.get(1, 0) / sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        got = [b for b in batches if len(b)]
        if got:
            all_rows = pd.concat(got).sort_values(["doc_id", "text"])
            model = train(all_rows["text"].tolist(), all_rows["toxic"].astype(int).tolist(), clean_weight)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    import pickle

    fitted = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else train([], [], 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with a ``score`` for each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights
    number = uuid.uuid4().hex
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", number), lambda: Scorer(sent.value))
        for batch in batches:
            row = batch.column(0)
            texts = strings(row.field(row.type.get_field_index("text")))
            yield pa.record_batch([row, pa.array(scorer.scores(texts), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, columns as they were."""
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit_model(used, labels)).where("score < 0.5").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, fit_model(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
