"""Quality rules: boosted trees with monotonic constraints over statistics of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.llm.common import prepare

#: Labelled documents that the trees are fitted on at most: those of the smallest id hashes.
SAMPLE = 20_000

#: Probability of quality from which a document is kept.
KEEP = 0.5

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20  # words; words; per cent

#: Statistic -> whether more of it may only raise (1) or only lower (-1) the probability of quality.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "duplicate_line_share": -1,
    "repeated_word_share": -1,
    "distinct_word_share": 0,
    "top_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "line_length": 0,
    "same_next_share": -1,
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    size = int(ids.max()) + 1
    for i in range(1, window):  # ranks stay below 2**32, so that keys are exact
        if int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + ids[i : i + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """n_words and the four base counts; and FEATURES in their order."""
    words = text.split()
    n, size = len(words), len(text.decode("utf-8", "replace"))
    chars = size - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeated = repeated_words(ids)
    base = [n, chars, symbols, duplicates, repeated]
    if not n:
        return base, [0.0] * len(FEATURES)
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
    upper, lower, digits = letters[65:91].sum(), letters[97:123].sum(), letters[48:58].sum()
    marks = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
    return base, [
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        duplicates / lines,
        repeated / n,
        len(index) / n,
        float(np.bincount(ids).max() / n),
        float(upper / max(1, upper + lower)),
        float(digits / chars),
        float(marks / chars),
        n / lines,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
    ]


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])


@dataclass
class Trees:
    """All trees in flat arrays: inner nodes ask feature <= threshold, leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        total = self.start + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(
    x: np.ndarray,
    y: np.ndarray,
    signs: list[int],
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smooth: float = 1.0,
    least: float = 5.0,
) -> Trees:
    """Gradient-boosted trees for the log loss, on quantile bins.

    A constrained feature is split only where the side that must not be lower has the higher value, and
    the middle of the two values then bounds all that lies below either side, so each tree is monotone.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for column in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    total = np.full(len(x), start)

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + smooth), low, high))
        me = len(nodes)
        nodes.append([0, 0.0, me, me, rate * value])
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f, sign in enumerate(signs):
                if not len(edges[f]):
                    continue
                width = len(edges[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], width))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, f], minlength=width))[:-1]
                vl = np.clip(-gl / (hl + smooth), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + smooth), low, high)
                # gain of the clipped values, so that bounded leaves are judged by what they do
                gain = -(gl * vl + (hl + smooth) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + smooth) * vr**2 / 2)
                fits = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * sign >= 0)
                gain = np.where(fits, gain + gs * value + (hs + smooth) * value**2 / 2, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, vl[at], vr[at])
        if best is None:
            total[rows] += rate * value
            return me
        _, f, at, vl, vr = best
        goes = binned[rows, f] <= at
        middle, sign = float(vl + vr) / 2, signs[f]
        bounds = [(low, high), (low, high)]
        if sign:
            bounds = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
        nodes[me][0], nodes[me][1] = f, float(edges[f][at])
        nodes[me][2] = grow(rows[goes], level + 1, *bounds[0], g, h)
        nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1], g, h)
        return me

    if len(x) and 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    table = np.array(nodes, float).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots, np.int64), depth, start)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RESULT = ", ".join(f"{c} long" for c in _COUNTS)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit("")).cast("binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents; of several labels of an id the lower one counts."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in text])

    rows = docs.select("doc_id", _text(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "label", measure("text").alias("x"))
    # repeated ids could multiply the sample
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toPandas()
    x = np.array(got.x.tolist(), float).reshape(-1, len(FEATURES))
    return boost(x, got.label.to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    quality is the trees' probability of the label quality from the text alone; kept is
    false where the base rules fail, else whether it reaches ``keep``.  Null and empty texts have no words, fail
    and have quality 0.  Without labels of both classes the trees say the share of good labels.
    Repeated rows give repeated rows; an empty table an empty result; further columns are not looked at.
    A text of any length is measured whole, one at a time within its batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf(_RESULT + ", base_failed boolean, kept boolean, quality double")
    def rate(text: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in text]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
        p = shared.value.probability(np.array([x for _, x in found], float).reshape(-1, len(FEATURES)))
        p = np.where(base[:, 0] > 0, p, 0.0)
        failed = base_failed(base)
        out = pd.DataFrame(base, columns=_COUNTS)
        return out.assign(base_failed=failed, kept=~failed & (p >= keep), quality=p)

    return docs.select("doc_id", rate(_text(docs)).alias("judged")).select("doc_id", "judged.*")
