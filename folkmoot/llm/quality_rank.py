"""Quality scores by Bradley-Terry ranking.

Every text becomes shares of characters, words and lines of certain kinds, each of which is coded by the quantile bins
of a sample, so that a linear score can bend. Preference pairs are drawn from labelled rows (a row of label 1 is
preferred to one of label 0), and weights are learned by logistic loss on the difference of the pair's features. Scores
are then cut at the quantile that matches the share of label 0 among the labelled rows, and mapped so that the cut falls
on ``at_cut``.

Null texts count as empty and get a score as any text does. Labels that are null are not learned from; without both
labels every score is 0.5. Repeated ids stay separate rows. Texts are used whole, whatever their length. Columns other
than id and text are not read, and the model knows nothing else of a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.llm._bytes import batches_of, joined, per_text

FEATURES = 18
BINS = 12
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes [start, end) each: differences of polynomial prefix sums modulo 2**64."""
    powers = np.cumprod(np.full(len(b), MULTIPLIER, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers)])
    inverse = np.cumprod(np.full(len(b), INVERSE, np.uint64))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return h ^ (h >> np.uint64(29))


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each text."""
    order = np.lexsort((h, of))
    o, x = of[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]) if len(o) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=n).astype(float)


def features(texts: list[str | None]) -> np.ndarray:
    """[text, feature]; the empty text has zeros."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), FEATURES))
    for a, z in batches_of(texts):
        b, offsets = joined(texts[a:z])
        n, text_of = z - a, np.repeat(np.arange(z - a), np.diff(offsets))

        def total(mask: np.ndarray) -> np.ndarray:
            return per_text(mask.astype(np.float64), offsets)

        space = (b == 32) | ((b >= 9) & (b <= 13))
        upper, lower, digit, high = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), b >= 0xC0
        chars = np.maximum(total(~space), 1.0)
        before = np.concatenate([[True], space[:-1]])
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(space & ~before)  # each text ends in a space, so every word does
        of = text_of[starts] if len(starts) else np.zeros(0, np.int64)
        words = np.bincount(of, minlength=n).astype(float)
        some = np.maximum(words, 1.0)
        h = _hashes(b, starts, ends)
        length = ends - starts
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again = np.zeros(len(h), bool)
        again[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
        stop = np.flatnonzero((b == 10) | (np.arange(len(b)) == offsets[text_of + 1] - 1))
        line_start = np.concatenate([[0], stop[:-1] + 1])
        line_of = text_of[stop]
        lines = np.bincount(line_of, minlength=n).astype(float)
        bar = (b == ord("|")) & before
        columns = [
            np.log1p(words),
            np.log1p(lines),
            chars / some,
            total(np.isin(b, SYMBOLS)) / chars,
            total(b == ord("!")) / chars,
            total(upper) / np.maximum(total(upper | lower), 1.0),
            total(digit) / chars,
            total(bar) / some,
            total((b == 44) | (b == 46) | (b == 58) | (b == 59)) / some,
            np.bincount(of, weights=same, minlength=n) / some,
            np.bincount(of, weights=again, minlength=n) / some,
            _distinct(of, h, n) / some,
            1 - _distinct(line_of, _hashes(b, line_start, stop), n) / np.maximum(lines, 1.0),
            np.bincount(of, weights=length <= 2, minlength=n) / some,
            np.bincount(of, weights=length > 15, minlength=n) / some,
            total(high) / chars,
            words / np.maximum(lines, 1.0),
            np.bincount(of, weights=lower[starts], minlength=n) / some if len(starts) else words,
        ]
        out[a:z] = np.stack(columns, 1)
    return out


class QualityModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float, at_cut: float):
        self.edges, self.weights, self.cut, self.at_cut = edges, weights, cut, at_cut

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Column of each feature's bin in the coding."""
        return np.stack([np.searchsorted(self.edges[f], x[:, f], side="right") + f * BINS for f in range(FEATURES)], 1)

    def margin(self, texts: list[str | None]) -> np.ndarray:
        return self.weights[self.bins(features(texts))].sum(1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-(self.margin(texts) - self.cut) - np.log(self.at_cut / (1 - self.at_cut))))


def train(texts: list[str | None], labels: list[int], at_cut: float = 0.3, pairs: int = 60_000, rounds: int = 300, rate: float = 1.0, decay: float = 2e-4, seed: int = 9) -> QualityModel:
    x, y = features(texts), np.array(labels)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((FEATURES, BINS - 1))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(edges, np.zeros(0), 0.0, at_cut)
    # The rare label's own tail gets bins too: half of the edges come from it.
    rare = np.quantile(x[bad if len(bad) < len(good) else good], np.linspace(0, 1, BINS + 1)[1:-1:2], axis=0).T
    edges = np.sort(np.concatenate([edges[:, 1::2], rare], 1), axis=1)[:, : BINS - 1]
    model = QualityModel(edges, np.zeros(FEATURES * BINS), 0.0, at_cut)
    rng = np.random.default_rng(seed)
    coded = np.zeros((len(x), FEATURES * BINS), np.float32)
    coded[np.arange(len(x))[:, None], model.bins(x)] = 1
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, speed = np.zeros(FEATURES * BINS), np.zeros(FEATURES * BINS)
    for _ in range(rounds):  # full gradient of the pairs, gathered by row
        s = coded @ w.astype(np.float32)
        pull = 1 / (1 + np.exp(s[a] - s[b])) / pairs
        row = np.bincount(a, weights=pull, minlength=len(x)) - np.bincount(b, weights=pull, minlength=len(x))
        speed = 0.9 * speed + coded.T @ row.astype(np.float32) - decay * w
        w = w + rate * speed
    model.weights = w
    model.cut = float(np.quantile(coded @ w.astype(np.float32), len(bad) / len(x)))
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = 12_000, at_cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Train on at most ``sample_rows`` labelled rows for which ``usable`` holds, picked by a hash of their id.

    The ids are picked before texts are looked up, so texts of other rows are not shuffled. Where ids repeat, the rows
    found are cut to the bound again, by a hash of id and text. Of several labels of an id the smallest counts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & usable).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(sample_rows).select("text", "label").collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows], at_cut)


def quality(text: Column, model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t if isinstance(t, str) else "" for t in texts]))

    return run(text)
