"""Language identification by averaged hashed subword embeddings.

A text is the mean embedding of its byte n-grams (n = 1 to 4, lower case, words marked by single spaces), hashed into
``buckets``; a linear softmax over it gives the language. Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. One part of the sample is kept back: it sets the temperature
that makes scores calibrated, and the score below which a prediction is rejected.

Since both steps are linear, prediction adds up one row of logits per n-gram. Texts that are null or hold no letter are
``und`` with score 0, and rejected. Labels that are null are not learned from. Without any labelled row every text is
``und``. Rows are neither moved nor dropped; repeated rows get equal results; any length of text is used whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.llm._bytes import batches_of, joined, per_text

UNKNOWN = "und"
GRAMS = 4
REJECT = (0.45, 0.6)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets_of(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, [byte, n], and the texts' offsets; n-grams that would start in another text fall in
    bucket 0, which has no weight."""
    b, offsets = joined([" " + " ".join(t.lower().split()) for t in texts])
    code = b.astype(np.uint32) + 1
    out = np.zeros((len(b), GRAMS), np.uint32)
    inside = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.zeros(len(b), np.uint32)
    for n in range(GRAMS):
        h[n:] = h[n:] + code[: len(b) - n] * np.uint32(pow(0x01000193, n + 1, 1 << 32))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out[:, n] = np.where(inside >= n, 1 + (mixed >> np.uint32(8)) % np.uint32(buckets - 1), 0)
    return out, offsets


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.reject = languages, table, bias, temperature, reject

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a, z in batches_of(texts):
            grams, offsets = buckets_of(texts[a:z], len(self.table))
            total = np.zeros((z - a, len(self.languages)))
            for n in range(GRAMS):
                total += per_text(self.table[grams[:, n]], offsets)
            counts = np.zeros(z - a)
            for n in range(GRAMS):
                counts += np.maximum(np.diff(offsets) - n, 0)
            out[a:z] = total / counts[:, None] + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether it is rejected."""
        seen = np.array([has_letter(t) for t in texts], bool) & bool(self.languages)
        labels, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if seen.any():
            z = self.logits([t for t, s in zip(texts, seen) if s]) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            labels[seen] = np.array(self.languages, object)[p.argmax(1)]
            score[seen] = p.max(1)
        return labels.tolist(), score, ~seen | (score < self.reject)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 4.0, wrong_rate: float = 0.001, seed: int = 3) -> LanguageModel:
    """Fit on nine tenths of the rows; temperature and rejection come from the rest.

    A prediction is rejected below the score that all but ``wrong_rate`` of the right predictions reach, within
    ``REJECT``: near chance always, and never a likely one. Temperatures below 1/2 are not tried: on a sample that is
    told apart without fault, they would only grow scores without end.
    """
    usable = [(t, x) for t, x in zip(texts, labels) if has_letter(t)]
    languages = sorted({x for _, x in usable})
    if not languages:
        return LanguageModel([], np.zeros((2, 0), np.float32), np.zeros(0))
    index = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(usable))
    back = set(order[: len(usable) // 10].tolist()) if len(usable) >= 50 else set()
    rows = []
    for i, (t, x) in enumerate(usable):
        if i not in back:
            grams, _ = buckets_of([t], buckets)
            used, count = np.unique(grams, return_counts=True)
            count = count[used > 0]
            rows.append((used[used > 0], (count / count.sum()).astype(np.float32), index[x]))
    embedding = (rng.standard_normal((buckets, dim)) / dim).astype(np.float32)
    embedding[0] = 0
    softmax, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            used, share, y = rows[i]
            mean = share @ embedding[used]
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back_to = softmax @ p
            softmax -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.01 * p
            embedding[used] -= lr * len(used) ** 0.5 * share[:, None] * back_to[None, :]
            step += 1
    table = (embedding @ softmax).astype(np.float32)
    table[0] = 0
    model = LanguageModel(languages, table, bias)
    if back:
        held = [usable[i] for i in sorted(back)]
        z, y = model.logits([t for t, _ in held]), np.array([index[x] for _, x in held])
        temperatures = np.geomspace(0.5, 20, 40)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

        model.temperature = float(min(temperatures, key=loss))
        _, score, _ = model.predict([t for t, _ in held])
        right = z.argmax(1) == y
        model.reject = float(np.clip(np.quantile(score[right], wrong_rate), *REJECT)) if right.any() and len(languages) > 1 else 0.0
    return model


def fit(labelled: DataFrame, sample_rows: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **how) -> LanguageModel:
    """Train on at most ``sample_rows`` rows with a language, picked by a hash of their id and text; the order is total, so
    reruns agree."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    total = rows.count()
    # The sampled share is a bit above the bound, which the limit then meets; so few rows are sorted.
    share = min(1.0, 1.2 * sample_rows / total) if total else 1.0
    rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h", "lang", "text").limit(sample_rows).select("text", "lang").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **how)


def identify(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        labels, score, rejected = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": labels, "score": score, "rejected": rejected})

    return run(text)
