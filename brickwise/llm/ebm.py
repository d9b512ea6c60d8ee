"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature (later: one pair of features) at a time, on binned features, so the
model is one lookup table per feature and pair; a score is the logistic function of the looked-up values' sum. The tables
are a few kilobytes and are fitted on a bounded sample of labelled rows; features and scores are computed in
the workers for all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are fitted at most; beyond it those with the lowest hashes of their ids.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Rows whose id's crc32 has this remainder modulo 4 are held out.
HELD_OUT = 2

FEATURES = [
    "log_words", "word_length", "upper", "digits", "symbols", "pipes", "exclaims", "stops", "commas", "non_ascii",
    "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "words_per_line", "capitalised", "odd_ends", "longest_word",
]

_UPPER, _DIGIT, _COMMON = bytes(range(65, 91)), b"0123456789", b" \t\n\r\v\f.,;:'\"?()-" + bytes(range(65, 91)) + bytes(range(97,
    123)) + b"0123456789" + bytes(range(128, 256))
_NON_ASCII = bytes(range(128, 256))
_CAPITAL = re.compile(rb"(?:^|[\s])[A-Z][a-z]")


def features(text: bytes) -> list[float]:
    """The numbers that a score is made of, from the whole text's bytes; all zero for an empty text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = len(words)
    without = lambda chars: n - len(text.translate(None, chars))
    tally = Counter(words)
    lines = text.split(b"\n")
    letters = max(1, sum(map(len, words)))
    ends = sum(v for w, v in tally.items() if w[-1] in b"#$%&*!|~^@<>=+_")
    return [
        float(np.log1p(count)), letters / count, without(_UPPER) / letters, without(_DIGIT) / letters, len(text.translate(None, _COMMON)) / n,
        text.count(b"|") / count, text.count(b"!") / count, text.count(b".") / count, text.count(b",") / count, without(_NON_ASCII) / n,
        len(tally) / count, len(set(zip(words, words[1:], strict=False))) / max(1, count - 1), max(tally.values()) / count,
        len(set(lines)) / len(lines), float(np.log1p(count / len(lines))), len(_CAPITAL.findall(text)) / count, ends / count, float(np.log1p(max(map(len,
            tally)))),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(x.as_py() or b"") for x in texts.cast(pa.large_binary())], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``pairs`` are places of features, with coarser bins of their own."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in 0 to 1 of a matrix of features, by bin additions."""
        total = np.full(len(x), self.intercept)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, f], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values per bin of a tree with up to ``leaves`` leaves, split greedily where the gain is largest."""
    parts, value = [(0, len(gradient))], np.zeros(len(gradient))
    cg, ch = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain = lambda g, h: g * g / (h + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in parts:
            at = np.arange(lo + 1, hi)
            if len(at) == 0:
                continue
            gl, hl, g, h = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo]
            won = np.where((hl >= least) & (h - hl >= least), gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h), -1)
            if won.max() > best[0]:
                best = (won.max(), (lo, hi), int(at[won.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in parts:
        value[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return value


def _cross_tree(gradient: np.ndarray, hessian: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree that splits one feature once and each side by the other feature once."""
    best = (0.0, np.zeros_like(gradient))
    gain = lambda g, h: g * g / (h + 1.0)
    for turned in (False, True):
        g, h = (gradient.T, hessian.T) if turned else (gradient, hessian)
        for cut in range(1, g.shape[0]):
            value, won = np.zeros_like(g), -gain(g.sum(), h.sum())
            for side in (slice(0, cut), slice(cut, None)):
                sg, shh = np.cumsum(g[side].sum(0)), np.cumsum(h[side].sum(0))
                left = np.where((shh >= least) & (shh[-1] - shh >= least), gain(sg, shh) + gain(sg[-1] - sg, shh[-1] - shh), -1)
                at = int(left.argmax()) + 1
                if left[at - 1] <= gain(sg[-1], shh[-1]):
                    at = g.shape[1]
                for s in (slice(0, at), slice(at, None)):
                    if g[side, s].size:
                        value[side, s] = g[side, s].sum() / (h[side, s].sum() + 1.0)
                        won += gain(g[side, s].sum(), h[side, s].sum())
            if won > best[0]:
                best = (float(won), value.T if turned else value)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 20, pairs: int = 4, bins: int = 32, rate: float = 0.15,
    leaves: int = 3) -> AdditiveModel:
    """Fit by cyclic boosting of the logistic loss. Without rows, or with one label only, the model is its (smoothed) prior."""
    model = AdditiveModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    if len(np.unique(y)) < 2:
        return model
    cuts = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
    model.edges, model.coarse = cuts(bins), cuts(8)
    place = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(rounds):
        for f, at in enumerate(place):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * np.clip(_tree(np.bincount(at, g, size), np.bincount(at, h, size), leaves, 2.0), -4, 4)
            model.tables[f] += step
            total += step[at]
    rough = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T, strict=True)]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return rough[a] * shape[1] + rough[b], shape

    def grown(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        at, shape = cells(a, b)
        size = shape[0] * shape[1]
        return _cross_tree(np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape), 2.0)

    gains = {(a, b): grown(a, b)[0] for a in range(x.shape[1]) for b in range(a)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pair_tables = [np.zeros(cells(a, b)[1]) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * np.clip(grown(a, b)[1], -4, 4)
            model.pair_tables[k] += step
            total += step.ravel()[cells(a, b)[0]]
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the labelled rows that aren't held out, ``sample_rows`` at most (those with the lowest hashes of their ids).

    Labels that are null are ignored; of several labels of one id their mean decides, 0.5 counting as 1; of several texts
    of one id the one with the lowest hash is learnt from, so that an id is one row, however often it occurs. Without usable rows
    the model is the constant 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_bw_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_bw_label"))
    chosen = known.orderBy(F.xxhash64("_bw_id"), "_bw_id").limit(sample_rows)  # 16 bytes a row: small enough to broadcast

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(texts)), pa.list_(pa.float64()))

    joined = documents.join(F.broadcast(chosen), documents[id_col] == chosen["_bw_id"])
    seen = joined.select("_bw_id", "_bw_label", F.xxhash64(text_col).alias("_bw_tie"), numbers(text_col).alias("_bw_x"))
    rows = seen.groupBy("_bw_id").agg(F.first("_bw_label").alias("_bw_label"), F.min(F.struct("_bw_tie", "_bw_x")).alias("_bw_low"))
    found = rows.select("_bw_id", "_bw_label", F.col("_bw_low._bw_x").alias("_bw_x")).toPandas().sort_values("_bw_id")  # sample_rows at most
    return fit(np.array(found["_bw_x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), found["_bw_label"].to_numpy(dtype=np.float64))


def score(model: AdditiveModel, text: Column | str) -> Column:
    """Score of a text in 0 to 1, higher if label 1 is likelier; a null text counts as empty."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(texts)))

    return of(text)


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted (1 from a score of 0.7 on).

    Every row is scored: null and empty texts by the empty text's features, null ids count as held out; ids may repeat; an
    empty table gives no rows. Only the text is an input of a score.
    """
    scored = documents.select(F.col(id_col), held_out(id_col).alias("held_out"), score(learn(documents, labels, id_col, text_col), text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def crc_remainder(doc_id: int) -> int:
    """The remainder that :func:`held_out` tests, for one id."""
    return zlib.crc32(str(doc_id).encode()) % 4
