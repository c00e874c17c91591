"""Texts of a batch as one array of bytes, with sums per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_CHARS = 1 << 20


def batches_of(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive texts with about ``most`` characters together; a longer text stands alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each ended by a space, and the offset of each text (one more for the end)."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; no text is empty, as each has its space."""
    return np.add.reduceat(values, offsets[:-1], axis=0)
