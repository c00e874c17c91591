"""Token ids as directly addressable codes (DACs).

An id is cut into chunks of eight bits, low chunk first. Level 0 holds the first chunk of every id and a bitmap that
says which ids go on; level 1 holds the second chunk of those ids only, and so on. A rank directory over each bitmap
gives the place of an id's next chunk, so any token is read without decoding its neighbours.

``write_tokens`` writes shards (Parquet rows that hold one code each, in ascending order of document) and
``read_tokens`` gives back one row per document. Null and empty texts become documents of the end id alone, a null
document id sorts first, repeated ids stay separate documents, and an empty table gives no shard. Only the id and text
columns are read, so further columns never clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"DAC1"
RANK_EVERY = 512  # bits of a bitmap to an entry of its rank directory
SHARD_SCHEMA = "part int, seq int, before bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, code binary"
MOST_PARTS = 2_000_000  # rows of (part, offset) that are sent to every task; more are joined by a shuffle
#: The text rules under which a text may be encoded word by word. White space parts tokens, a run of
#: letters is one piece and a run of marks another, so the ids of a text are those of its words, and the ids of a word
#: are those of the marks and letters it is made of.
WORDWISE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"  # how special tokens begin; a word that holds it is never cut or lowered
MARKS = r"[!-&(-/:;=>?@\[-`{-~]*"  # of ASCII, without the apostrophe and what begins a special token
WORD = f"^(?P<lead>{MARKS})(?P<core>[a-zÀ-ÖØ-öø-ÿ]+)(?P<rest>{MARKS})$"
ENCODE_SLICE = 1024  # words handed to the tokenizer at once
CACHED_WORDS = 300_000  # of a worker; beyond them the half used last stays
SLICE_BYTES = 1 << 21  # of text encoded at once
SPACE = re.compile(rb"[ \t\n\v\f\r]")


def dac_encode(ids: np.ndarray) -> bytes:
    """The code of unsigned ids below 2**32."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        per_block = RANK_EVERY // 8
        padded = np.zeros(-(-len(bits) // per_block) * per_block, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, per_block).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[goes_on] >> np.uint32(8)
        if not len(rest):
            break
    head = MAGIC + struct.pack("<B", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class DacReader:
    """Random access to a code: ``reader[i]`` for one token, ``reader.slice(a, b)`` for a run."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a DAC")
        k, at = code[4], 5
        counts = struct.unpack_from(f"<{k}Q", code, at)
        at += 8 * k
        self.levels = []
        for n in counts:
            n_bits, n_ranks = -(-n // 8), -(-(-(-n // 8)) // (RANK_EVERY // 8)) + 1
            chunks = np.frombuffer(code, np.uint8, n, at)
            bits = np.frombuffer(code, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(code, "<u8", n_ranks, at + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + 8 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        block, start = i // RANK_EVERY, i // RANK_EVERY * (RANK_EVERY // 8)
        ones = int(ranks[block]) + int(np.bitwise_count(bits[start : i // 8]).sum())
        return ones + (int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        return self._slice(0, a, b)

    def _slice(self, level: int, a: int, b: int) -> np.ndarray:
        chunks, bits, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if level + 1 < len(self.levels) and b > a:
            first = a // 8
            goes_on = np.unpackbits(bits[first : -(-b // 8)], bitorder="little")[a - first * 8 : b - first * 8].astype(bool)
            start = self._rank(level, a)
            out[goes_on] |= self._slice(level + 1, start, start + int(goes_on.sum())) << np.uint32(8)
        return out


def _alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


ALPHABET = _alphabet()


def spelling(word: str) -> str | None:
    """A word of Latin letters only, as the normalizer and pre-tokenizer would hand it to the model: one run in lower
    case, spelled in bytes. None for any other word, which goes through the whole tokenizer."""
    if not word.isalpha():
        return None
    if word.isascii():
        return word.lower()
    if max(word) >= "\u0250" or not (word := word.lower()).isalpha() or max(word) >= "\u0250":
        return None
    return word.encode("utf-8").decode("latin-1").translate(ALPHABET)


def wordwise(tokenizer_json: str) -> bool:
    """Whether a tokenizer follows the rules under which texts may be encoded word by word."""
    spec = json.loads(tokenizer_json)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": WORDWISE_SPLIT}, "behavior": "Removed", "invert": True}
    return (
        spec.get("normalizer") == WORDWISE_NORMALIZER
        and len(steps) == 2 and steps[0] == split and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        and not any((spec.get(k) for k in ("truncation", "padding", "post_processor")))
        and all(t["content"].startswith(SPECIAL) and not SPACE.search(t["content"].encode()) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    )


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one behind the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Encodes slices of texts in Arrow: split at white space, make words distinct, and gather their ids.

    Distinct words are cut into marks and letters, and only pieces that the cache lacks reach the tokenizer. The cache
    is one Arrow array of pieces beside one array of ids with offsets. A tokenizer with other rules than ``wordwise``
    asks for gets whole texts.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        with open(tokenizer_file, encoding="utf-8") as f:
            self.wordwise = wordwise(f.read())
        self.pieces = pa.array([""], pa.large_string())
        self.ids, self.starts, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.turn = 0

    def _tokenize(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        odd: list[int] = []
        for k, word in enumerate(words):
            spelled = spelling(word)
            out.append(None if spelled is None else [t.id for t in self.model.tokenize(spelled)])
            if spelled is None:
                odd.append(k)
        for a in range(0, len(odd), ENCODE_SLICE):
            some = odd[a : a + ENCODE_SLICE]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([words[k] for k in some], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the cache has each of these distinct pieces; those it lacks are encoded."""
        self.turn += 1
        if len(self.pieces) > CACHED_WORDS:
            stay = np.sort(np.argpartition(self.used, len(self.used) // 2)[len(self.used) // 2 :])
            self.pieces = self.pieces.take(pa.array(stay))
            self.ids, self.lengths, self.used = ragged(self.ids, self.starts[stay], self.lengths[stay]), self.lengths[stay], self.used[stay]
            self.starts = np.cumsum(self.lengths) - self.lengths
        at = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = at < 0
        if lacking.any():
            fresh = pieces.filter(pa.array(lacking))
            coded = self._tokenize(fresh.to_pylist())
            at[lacking] = len(self.pieces) + np.arange(len(fresh))
            lengths = np.array([len(c) for c in coded], np.int64)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.uint32, int(lengths.sum()))])
            self.pieces = pa.concat_arrays([self.pieces, fresh])
        self.used[at] = self.turn
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if not self.wordwise:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            lengths = np.array([len(c) for c in coded], np.int64)
            return np.fromiter((i for c in coded for i in c), np.uint32, int(lengths.sum())), lengths
        words = pc.ascii_split_whitespace(texts)
        distinct = words.values.dictionary_encode()
        names = distinct.dictionary
        names = pc.if_else(pc.match_substring(names, SPECIAL), names, pc.ascii_lower(names))
        cut = pc.extract_regex(names, WORD)
        whole = cut.is_null()
        none = pa.scalar("", names.type)
        lead, core, rest = (pc.if_else(whole, other, cut.field(c)) for c, other in (("lead", none), ("core", names), ("rest", none)))
        pieces = pa.concat_arrays([lead, core, rest]).dictionary_encode()
        at = self._places(pieces.dictionary)[pieces.indices.to_numpy()].reshape(3, -1).T.ravel()
        of_words, lengths = ragged(self.ids, self.starts[at], self.lengths[at]), self.lengths[at].reshape(-1, 3).sum(1)
        which = distinct.indices.to_numpy()
        starts, lengths = (np.cumsum(lengths) - lengths)[which], lengths[which]
        before = np.concatenate([[0], np.cumsum(lengths)])[words.offsets.to_numpy()]
        return ragged(of_words, starts, lengths), np.diff(before)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, int, bool]]:
    """(texts, number of documents that they end, whether the last one goes on): consecutive texts of about ``most``
    bytes. A longer text is cut at white space, so that its words stay whole."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        if sizes[at] > 2 * most:
            raw, a = texts[at].as_py().encode("utf-8"), 0
            while a < len(raw):
                cut = SPACE.search(raw, a + most)
                z = cut.end() if cut else len(raw)
                yield pa.array([raw[a:z].decode("utf-8")], pa.large_string()), int(z == len(raw)), z < len(raw)
                a = z
            at += 1
        else:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(at + 1, to)
            yield texts.slice(at, to - at), to - at, False
            at = to


class _Shards:
    """Collects documents of a write task and gives out shards of about ``most`` tokens."""

    def __init__(self, part: int, end_id: int, most: int):
        self.part, self.end_id, self.most = part, np.uint32(end_id), most
        self.seq = self.before = self.total = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.parts: list[np.ndarray] = []
        self.open = 0  # tokens so far of a document that goes on

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, goes_on: bool) -> Iterator[pa.RecordBatch]:
        if goes_on:
            self.parts.append(ids)
            self.open += len(ids)
            return
        ends = np.cumsum(counts)
        at = 0  # documents of these that are dealt with
        while at < len(counts):
            # Up to and with the document that fills the shard.
            full = int(np.searchsorted(ends - (ends[at - 1] if at else 0) + np.arange(1, len(counts) + 1) - at, self.most - self.total - self.open))
            to = min(len(counts), max(full, at) + 1)
            first = int(ends[at - 1]) if at else 0
            own, n = ids[first : int(ends[to - 1])], counts[at:to]
            with_ends = np.full(len(own) + len(n), self.end_id, np.uint32)
            stays = np.ones(len(with_ends), bool)
            stays[np.cumsum(n + 1) - 1] = False
            with_ends[stays] = own
            n = n + 1
            n[0] += self.open
            self.total, self.open = self.total + int(n.sum()), 0
            self.parts.append(with_ends)
            self.doc_ids += doc_ids[at:to]
            self.counts += n.tolist()
            at = to
            if self.total >= self.most:
                yield self.shard()

    def shard(self) -> pa.RecordBatch:
        code = dac_encode(np.concatenate(self.parts))
        out = pa.RecordBatch.from_pydict(
            {"part": pa.array([self.part], pa.int32()), "seq": pa.array([self.seq], pa.int32()), "before": pa.array([self.before], pa.int64()), "doc_ids": pa.array([self.doc_ids], pa.list_(pa.int64())),
             "doc_tokens": pa.array([self.counts], pa.list_(pa.int64())), "n_tokens": pa.array([self.total], pa.int64()), "code": pa.array([code], pa.binary())}
        )
        self.seq, self.before, self.total = self.seq + 1, self.before + self.total, 0
        self.doc_ids, self.counts, self.parts = [], [], []
        return out


def _shards(tokenizer_file: str, end_id: int, shard_tokens: int, slice_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shards = WordEncoder(tokenizer_file), _Shards(TaskContext.get().partitionId(), end_id, shard_tokens)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts, n, goes_on in slices(batch.column(1).cast(pa.large_string()).fill_null(""), slice_bytes):
                yield from shards.add(ids[at : at + n], *encoder.encode(texts), goes_on)
                at += n
        if shards.counts:
            yield shards.shard()

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, slice_bytes: int = SLICE_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write the shards in ascending order of id.

    One range shuffle of (id, text) sorts the documents; shards are cut inside its partitions, so a task holds one
    shard of ``shard_tokens`` and the longest document at most. Rows of one id, or without one, are told apart by the
    partition that they come from, so very many of them are several ranges; their order among themselves is that.
    """
    by_id = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    by_id = by_id.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part").select("doc_id", "text")
    by_id.mapInArrow(_shards(tokenizer_file, end_id, shard_tokens, slice_bytes), SHARD_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a shard at a time
            row = batch.slice(k, 1).to_pylist()[0]
            reader, counts = DacReader(row["code"]), np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            ids = reader.slice(0, len(reader)).astype("<u4")
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["before"] + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64())}
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    A shard knows the tokens before it in its part, so only the sums of whole parts (one row for each task of the write)
    go through a window; they are sent to every task up to ``MOST_PARTS`` of them. Codes are not shuffled.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("part_before"))
    few = parts.limit(MOST_PARTS + 1).count() <= MOST_PARTS
    whole = shards.join(F.broadcast(parts) if few else parts.hint("shuffle_hash"), "part")
    whole = whole.select((F.col("part_before") + F.col("before")).alias("before"), "doc_ids", "doc_tokens", "code")
    return whole.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
