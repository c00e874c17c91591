"""Sampled segmentation with a SentencePiece vocabulary, and its exact inverse.

The pieces that match a text form a lattice over its characters. Forward filtering sums the weights of all paths to
each character; backward sampling then draws one path from the end, piece by piece, in proportion to its weight. The
draw at a character is a hash of the row's key and the character's place, so a row is always cut in the same way.

No piece of these vocabularies reaches over the start of a space run or over a line break, so the lattice falls apart
there without changing the distribution. Forward sums and backward draws of all parts of a batch run together in numpy,
the sums once for each distinct part. A character without a piece becomes its UTF-8 bytes. A
literal U+2581, which stands for a space inside the vocabulary, becomes bytes too, so decoding is lossless.

A part without any such place, of more than ``WINDOW`` characters, is filtered window by window: the sums at the end of a
window are carried into the next, and sampling goes back over the windows, filtering each once more. A text of more than
``BATCH_CHARS`` characters goes through in runs of parts. So what a task holds beside a text does not grow with it.

Null and empty texts give no pieces and decode to the empty text. Any row key is fine, null and repeated ones too
(equal key and text are cut equally). An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
BATCH_CHARS = 1 << 20
WINDOW = 1 << 16
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
MARKS = 21  # bits of a hash that tell whether a run of characters may end a piece, or be one
GAIN = 24.0  # per character, the same for every path: keeps sums near 1
BYTE_WEIGHT = 1e-6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceSampler:
    """Pieces of a model weigh (rank + 1) ** -alpha by merge rank (BPE), or exp(alpha * score) where scores are logs."""

    def __init__(self, model_file: str, alpha: float = 1.0, ranked: bool = True, seed: int = 5):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.seed = np.uint64(seed)
        self.byte_ids = np.zeros(256, np.int64)
        self.weights: dict[str, tuple[int, float]] = {}
        out: list[bytes] = []
        rank, weight_of = 0, np.zeros(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                out.append(b"")
            else:
                log_weight = -alpha * math.log(rank + 1.0) if ranked else alpha * sp.get_score(i)
                self.weights[piece] = (i, math.exp(log_weight) * GAIN ** len(piece))
                weight_of[i] = self.weights[piece][1]
                out.append(piece.replace(SPACE, " ").encode())
                rank += 1
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.weights):
            raise ValueError("a piece reaches over a cut of the lattice")
        self.longest = max(map(len, self.weights))
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.piece_ends = np.cumsum([len(b) for b in out])
        self.piece_sizes = np.array([len(b) for b in out])
        self.weight_of = weight_of
        hashes, endings = [], set()
        for piece in self.weights:
            h, power = 0, 1
            for c in reversed(piece):
                h, power = (h + (ord(c) + 1) * power) % (1 << 64), power * int(HASH_BASE) % (1 << 64)
                endings.add(h)
            hashes.append(h)
        if len(set(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        self.hashed_ids = np.array([i for i, _ in self.weights.values()], np.int32)[order]
        self.marks = np.zeros(1 << MARKS, np.uint8)  # 1: the end of a piece, 2: a whole one; others may share a mark
        self.marks[self._marked(np.fromiter(endings, np.uint64, len(endings)))] = 1
        self.marks[self._marked(self.hashes)] = 2

    @staticmethod
    def _marked(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MARKS)

    def _lattice(self, parts: list[str], given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(base, ids, upto, forward): character j of part k is node base[k] + j; ids[node, m] is the piece of m + 1 characters
        that ends there (0: none; below 0: -1 - code point of a character without a piece), and upto[node, m] the
        share of the paths to the node whose last piece is no longer than that. ``given`` are the sums at the first nodes
        of a single part that is a window of a longer one."""
        size = np.array([len(p) for p in parts])
        base = np.cumsum(size + 1) - (size + 1)
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.repeat(np.cumsum(size) - size, size)
        inside = np.arange(len(code)) - first  # place in its part
        node = inside + 1 + np.repeat(base, size)
        most, hits = 1, []
        ends, window = np.arange(len(code)), np.zeros(len(code), np.uint64)  # hash of the last m characters, by end
        power = np.uint64(1)
        for m in range(min(self.longest, int(size.max()))):
            if m:
                on = inside[ends] >= m
                ends, window = ends[on], window[on]
            window = window + (code[ends - m] + np.uint64(1)) * power
            power = np.uint64(int(power) * int(HASH_BASE) % (1 << 64))
            # Only what ends a piece can grow into one, and few runs are one.
            mark = self.marks[self._marked(window)]
            whole = np.flatnonzero(mark == 2)
            spot = np.minimum(np.searchsorted(self.hashes, window[whole]), len(self.hashes) - 1)
            hit = self.hashes[spot] == window[whole]
            if hit.any():
                most = m + 1
                hits.append((node[ends[whole[hit]]], m, self.hashed_ids[spot[hit]]))
            on = np.flatnonzero(mark)
            ends, window = ends[on], window[on]
        ids = np.zeros((len(code) + len(parts), most), np.int32)
        for where, m, piece in hits:
            ids[where, m] = piece
        bare = ids[node, 0] == 0
        ids[node[bare], 0] = -1 - code[bare].astype(np.int64)
        forward = np.zeros(len(ids))
        forward[base] = 1.0
        known = 0
        if given is not None:
            known = len(given) - 1
            forward[: known + 1] = given
        upto = np.zeros(ids.shape, np.float32)
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        for j in range(known + 1, int(size.max()) + 1):
            at = base[order[: np.searchsorted(falling, -j, side="right")]] + j
            reach = min(j, most)
            piece = ids[at, :reach]
            sums = np.cumsum(forward[at[:, None] - np.arange(1, reach + 1)] * np.where(piece < 0, BYTE_WEIGHT, self.weight_of[np.maximum(piece, 0)]), axis=1)
            total = sums[:, -1]
            upto[at, :reach] = sums / total[:, None]
            forward[at] = total
            far = ~((total > 1e-100) & (total < 1e100))
            if far.any():  # only ratios matter: bring what later sums still use near 1
                for m in range(min(j, self.longest) + 1):
                    forward[at[far] - m] /= total[far]
        return base, ids, upto, forward

    def _draws(self, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A number from 0 to 1 for a row's place."""
        return (_mixed(seeds + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)

    def _sample_long(self, part: str, seed: np.uint64, inner: int) -> list[tuple[int, int]]:
        """(first character, code) of the pieces drawn for one part, window by window."""
        windows, given = [], np.ones(1)
        for a in range(0, len(part), WINDOW):
            first, b = a - min(a, self.longest), min(len(part), a + WINDOW)
            windows.append((first, a, b, given))
            forward = self._lattice([part[first:b]], given)[3]
            given = forward[-min(b, self.longest) - 1 :].copy()
        drawn, j = [], len(part)
        for first, a, b, given in reversed(windows):
            if j <= a:
                continue
            _, pieces, upto, _ = self._lattice([part[first:b]], given)
            u = self._draws(np.full(b - a, seed), inner + np.arange(a + 1, b + 1))
            while j > a:
                m = int((upto[j - first] > u[j - a - 1]).argmax())
                drawn.append((j - m - 1, int(pieces[j - first, m])))
                j -= m + 1
        return drawn

    def encode(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, drawn by key."""
        # No piece holds a plain space, so a literal mark that becomes one goes to bytes.
        swap = str.maketrans({" ": SPACE, SPACE: " "})
        marked = [SPACE + (t.translate(swap) if SPACE in t else t.replace(" ", SPACE)) if t else "" for t in texts]
        if all(len(t) <= 2 * BATCH_CHARS for t in marked):
            return self._encode_parts(keys, [PARTS.findall(t) for t in marked], 0)
        out = []
        for key, text in zip(keys, marked):
            ids, parts, size, done = [], [], 0, 0
            for m in PARTS.finditer(text):
                parts.append(m[0])
                size += len(m[0])
                if size >= BATCH_CHARS:
                    ids += self._encode_parts([key], [parts], done)
                    parts, size, done = [], 0, done + size
            ids += self._encode_parts([key], [parts], done)
            out.append(np.concatenate(ids))
        return out

    def _encode_parts(self, keys: list, split: list[list[str]], done: int) -> list[np.ndarray]:
        """Piece ids of texts in parts, of which ``done`` characters came before."""
        names = list(set(chain.from_iterable(split)))
        if not names:
            return [np.zeros(0, np.int32) for _ in split]
        place = dict(zip(names, range(len(names))))
        sizes = np.array([len(p) for p in names])
        short = np.flatnonzero(sizes <= WINDOW)
        base = np.zeros(len(names), np.int64)
        if len(short):
            base[short], pieces, upto, _ = self._lattice([names[k] for k in short])
        which = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        doc = np.repeat(np.arange(len(split)), [len(d) for d in split])
        left = sizes[which]
        ends = np.cumsum(left)  # places in the text of the batch
        starts = ends - left
        doc_chars = np.bincount(doc, weights=left, minlength=len(split)).astype(np.int64)
        doc_start = np.cumsum(doc_chars) - doc_chars
        row_seed = _mixed(np.array([zlib.crc32(str(k).encode()) for k in keys], np.uint64) ^ (self.seed << np.uint64(32)))
        out = np.zeros(int(ends[-1]), np.int64)  # at the first character of a drawn piece: its id, or a code below 0
        base, row_seed, inner = base[which], row_seed[doc], starts - doc_start[doc] + done
        for k in np.flatnonzero(left > WINDOW):
            for j, code in self._sample_long(names[which[k]], row_seed[k], int(inner[k])):
                out[starts[k] + j] = code
        at = np.flatnonzero(left <= WINDOW)
        while len(at):
            j = left[at]
            u = self._draws(row_seed[at], inner[at] + j)
            node = base[at] + j
            m = (upto[node] > u[:, None]).argmax(1)
            j = j - m - 1
            out[starts[at] + j] = pieces[node, m]
            left[at] = j
            at = at[j > 0]
        used = np.flatnonzero(out)
        ids = out[used]
        bounds = np.searchsorted(used, np.append(doc_start, len(out)))
        return [self._with_bytes(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = {c: self.byte_ids[np.frombuffer((SPACE if chr(-c - 1) == " " else chr(-c - 1)).encode(), np.uint8)] for c in set(ids[odd].tolist())}
            cuts, parts, a = odd.tolist(), [], 0
            for k in cuts:
                parts += (ids[a:k], spelled[int(ids[k])])
                a = k + 1
            ids = np.concatenate([*parts, ids[a:]])
        return ids.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: their bytes in a row, without the space put in front."""
        if not len(ids):
            return ""
        size = self.piece_sizes[ids]
        first = self.piece_ends[ids] - size
        spots = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.piece_bytes[spots].tobytes()[1:].decode()


def _encode(model_file: str, alpha: float, ranked: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler(model_file, alpha, ranked, seed)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(keys):
                to, size = at, 0
                while to < len(keys) and (to == at or size < BATCH_CHARS):
                    size += len(texts[to])
                    to += 1
                ids = sampler.encode(keys[at:to], texts[at:to])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at:to], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([sampler.decode(x) == t for x, t in zip(ids, texts[at:to])]),
                    ],
                    names=["doc_id", "piece_ids", "ids_crc32", "lossless"],
                )
                at = to

    return run


def encode_pieces(docs: DataFrame, model_file: str, alpha: float = 1.0, ranked: bool = True, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, piece_ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers)
    and lossless (whether decoding them gave the whole text back). Rows stay where they are; nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encode(model_file, alpha, ranked, seed), "doc_id bigint, piece_ids array<int>, ids_crc32 bigint, lossless boolean")
    return out.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "ids_crc32", "lossless")


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler(model_file)
        for batch in batches:
            texts = [sampler.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows with piece_ids; null ids give the empty text."""
    return encoded.select(F.col("doc_id").cast("long"), "piece_ids").mapInArrow(_decode(model_file), "doc_id bigint, text string")
