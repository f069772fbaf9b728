"""Toxic passages: maximum-scoring segments of token log-odds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import fold, prepare, texts

#: Labelled documents that the model is fitted on at most: those of the smallest id hashes.
SAMPLE = 20_000

#: Rows with this fold of so many are held out.
FOLDS = 5

#: Prior counts of the log-odds, as a share of all counts, spread like the whole sample.
PRIOR = 0.03

#: Toxic documents a feature must occur in, and the signed root of its likelihood ratio that chance may
#: reach among very many features: log-odds are shrunk towards zero by the square of their quotient.
LEAST, CHANCE = 4, 4.0

#: Log-odds a feature must keep after that.
STRONG = 1.0

#: Beginnings of words that are features beside the words, so that inflected forms are known.
PREFIXES = (4, 5, 6)

#: Expected number of such segments by chance in a clean text below which a passage is significant.
EXPECTED = 0.01

#: Judged words that a worker keeps at most.
CACHE = 60_000

_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¿¡«»„“”‘’…–—"


def features(chunk: bytes) -> tuple[str, ...]:
    """The word without outer punctuation, in lower case, and its beginnings."""
    word = chunk.decode("utf-8", "replace").strip(_STRIP).lower()
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)) if word else ()


def segments(scores: np.ndarray, at: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) in linear time.

    at, scores: places and values of the positive tokens; every other token scores -background.
    A maximal segment is one that no extension or part of it beats, and none overlap.
    """
    kept: list[list[float]] = []  # start, end, cumulative score before and after
    total, last = 0.0, -1
    for place, value in zip(at.tolist(), scores.tolist(), strict=True):
        total -= background * (place - last - 1)
        new = [place, place + 1, total, total + value]
        total, last = new[3], place
        while kept:
            j = len(kept) - 1  # the last one that begins lower; those after it are dominated
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append(new)
    return [(int(s), int(e), after - before) for s, e, before, after in kept]


@dataclass
class Model:
    """Positive features, the score of all other tokens, and the calibration of a text's best segment."""

    odds: dict[str, float] = field(default_factory=dict)
    background: float = 1.0
    scale: float = 1.0  # lambda of the extreme-value distribution
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-8.0, 0.0, 0.0)
    cache: dict[bytes, float] = field(default_factory=dict)

    def token(self, chunk: bytes) -> float:
        found = [self.odds[f] for f in features(chunk) if f in self.odds]
        return max(found) if found else 0.0

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        chunks = text.split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        for chunk in chunks:
            if chunk not in cache:
                cache[chunk] = self.token(chunk)
        values = np.fromiter(map(cache.__getitem__, chunks), np.float64, len(chunks))
        at = np.flatnonzero(values)
        return len(chunks), segments(values[at], at, self.background)

    def normalised(self, score: float, n: int) -> float:
        """Minus the log of the number of segments as good that a clean text of n tokens has by chance."""
        return self.scale * score - self.log_k - np.log(max(n, 1))

    def summary(self, best: float, found: list[float], n: int) -> tuple[float, float]:
        """What is calibrated: the normalised best score, and the logarithm of the number of passages.

        A best segment that chance explains counts as none, so a text is not suspect for being short.
        """
        passages = sum(self.normalised(s, n) >= -np.log(EXPECTED) for s in found)
        return float(np.clip(self.normalised(best, n), 0, 30)) if best > 0 else 0.0, float(np.log1p(passages))

    def row(self, text: bytes) -> tuple[tuple[float, float], list[tuple[int, int, float]]]:
        """The summary, and the significant passages."""
        n, found = self.scan(text)
        best = max((s[2] for s in found), default=0.0)
        passages = [s for s in found if self.normalised(s[2], n) >= -np.log(EXPECTED)]
        return self.summary(best, [s[2] for s in found], n), passages

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a feature, reduced per task; the empty feature counts all features."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        names = sorted(counts[0].keys() | counts[1].keys())
        columns = [[c[f] for f in names] for c in counts]
        for c in counts:
            c.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string())] + [pa.array(c, pa.int64()) for c in columns], ["feature", "clean", "toxic"]
        )

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            found = {f for chunk in set(text.split()) for f in features(chunk)}
            counts[label].update(found)
            counts[label][""] += len(found)
        if sum(map(len, counts)) > 1_000_000:
            yield from out()
    yield from out()


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` ids outside the held-out fold; the larger of several labels counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Log-odds, extreme-value parameters and calibration from a bounded sample of the labels.

    Feature counts are summed by Spark and only features that are surely toxic come to the driver; then
    the sample's best segments, one row each.
    """
    prepare(docs.sparkSession)
    rows = labelled(docs, labels, sample)
    counted = rows.mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature")
    counted = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = counted.where("feature = ''").first()
    model = Model()
    if not sums or not sums["toxic"] or not sums["clean"]:
        return model
    n0, n1 = sums["clean"], sums["toxic"]
    prior = PRIOR * (n0 + n1)
    share = prior * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    a, b = F.col("clean") + share, F.col("toxic") + share
    odds = F.log(b / (n1 + prior - b)) - F.log(a / (n0 + prior - a))
    seen = F.col("clean") + F.col("toxic")
    ratio = 2 * (_term("toxic", seen * n1 / (n0 + n1)) + _term("clean", seen * n0 / (n0 + n1)))
    judged = counted.where("feature <> ''").where((odds > 0) & (ratio > CHANCE**2)).withColumn("odds", odds * (1 - CHANCE**2 / ratio))
    surely = judged.where((F.col("odds") > STRONG) & (F.col("toxic") >= LEAST))
    model.odds = {r["feature"]: r["odds"] for r in surely.select("feature", "odds").collect()}
    strength = float(np.mean(list(model.odds.values()))) if model.odds else 1.0
    model.background = max(0.1, strength / 4)  # a gap of four clean tokens outweighs a mean positive one
    return _calibrated(model, rows, sample)


def _term(count: str, expected: Column) -> Column:
    return F.when(F.col(count) > 0, F.col(count) * F.log(F.col(count) / expected)).otherwise(0.0)


def _calibrated(model: Model, rows: DataFrame, sample: int) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            best, tokens, positive, found_all = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, found = own.scan(text)
                best.append(max((s[2] for s in found), default=0.0))
                tokens.append(n)
                positive.append(float(sum(e - s for s, e, _ in found)))
                found_all.append([s[2] for s in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(best, pa.float64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(positive, pa.float64()),
                    pa.array(found_all, pa.list_(pa.float64())),
                    batch.column("label"),
                ],
                ["doc_id", "best", "n", "positive", "segments", "label"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = rows.mapInArrow(run, f"doc_id {kind}, best double, n long, positive double, segments array<double>, label int")
    # repeated ids could multiply the sample
    got = scanned.orderBy(F.xxhash64("doc_id"), "doc_id", "best", "n").limit(sample).toPandas()
    clean = got[got.label == 0]
    share = (clean.positive.sum() + 0.5) / (clean.n.sum() + 1.0)
    strength = float(np.mean(list(model.odds.values()))) if model.odds else 1.0
    low, high = 1e-6, 200.0
    for _ in range(80):  # the positive root of share * e^(l s) + (1 - share) * e^(-l b) = 1
        mid = (low + high) / 2
        value = np.log(share) + mid * strength, np.log1p(-share) - mid * model.background
        low, high = (low, mid) if np.logaddexp(*value) > 0 else (mid, high)
    model.scale = low
    # mean of the extreme-value distribution on clean texts
    model.log_k = float((model.scale * clean.best - np.log(clean.n.clip(1))).mean() - 0.5772) if len(clean) else 0.0
    x = np.array([model.summary(b, list(f), n) for b, f, n in zip(got.best, got.segments, got.n, strict=True)])
    model.weights = logistic(x.reshape(-1, 2), got.label.to_numpy(float))
    model.cache = {}
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - y) + 1e-2 * w
        hessian = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


RESULT = "score double, best double, passages array<struct<start: int, stop: int, score: double>>"


def scorer(model: Model, docs: DataFrame) -> Column:
    """Column of struct (score, best, passages) for the text of docs; places are words, stop is exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judge(text: pd.Series) -> pd.DataFrame:
        own = shared.value
        rows = [own.row(t) for t in text]
        x = np.array([summary for summary, _ in rows]).reshape(-1, 2)
        passages = [[{"start": s, "stop": e, "score": v} for s, e, v in p] for _, p in rows]
        return pd.DataFrame({"score": own.probability(x), "best": x[:, 0], "passages": passages})

    return judge(F.coalesce(docs["text"], F.lit("")).cast("binary"))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_passages, passages.

    The score is the probability of the label toxic from the text alone.  passages are all
    significant segments as (start, stop, score) in words.  Null and empty texts have no
    passage and the score of a clean text; null ids count as held out; labels of unknown documents are
    ignored, of several labels of an id the larger one counts; without labels of both classes
    every score is near 0.  Repeated rows give repeated rows; further columns are not looked at.
    An empty table gives an empty result.  A text of any length is scanned whole, in time proportional to it.
    """
    judged = docs.select("doc_id", scorer(fit(docs, labels, sample), docs).alias("judged"))
    return judged.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "judged.score",
        F.when(F.col("judged.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("judged.passages").alias("n_passages"),
        "judged.passages",
    )


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are predicted toxic; columns as they are."""
    judged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        scorer(fit(docs, labels, sample), docs).getField("score").alias("toxic_score"),
    )
    return judged.where("toxic_score < 0.5").select("row.*")
