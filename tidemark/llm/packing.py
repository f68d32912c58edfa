"""Harmonic packing of tokenised documents into sequences of CAPACITY tokens.

Lengths fall into classes (CAPACITY/(j+1), CAPACITY/j]: class j fills a sequence with just j pieces, so that a worker needs no search and
no knowledge of the others: it counts to j. A document longer than a sequence is cut into full ones first. What remains may be cut
further: if class j would leave more than SLACK of its sequence empty, a piece of exactly CAPACITY/(j+1) is cut off for the
next class and the rest goes on. Rests under CAPACITY/CLASSES are the last class, filled by next fit.

A worker ends with at most j-1 pieces in each class that fill no sequence; these tails (a bound on a worker, whatever its input) are
packed best fit, longest first, by groups of TAIL_WORKERS workers, so that padding does not grow with the number of workers.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces; other columns
are ignored. Every id lies in just one piece.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .common import Memo, read, slices, small_batches, stored

CAPACITY = 2048
CLASSES = 32
SLACK = 1 / 64
END_ID = 1
TAIL_WORKERS = 128
#: The memo is emptied beyond so many bytes.
MEMO_BYTES = 96 << 20
#: Sequence ids: worker * SEQUENCES + its own count; tails follow after the workers.
SEQUENCES = 1 << 40
FIRST_TAIL = 1 << 22

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, worker int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer's normaliser makes every white space a blank, and its pre-tokenizer splits runs of letters, single digits and runs of other signs,
    which are then encoded alone. So a text's ids are those of its chunks between white space in turn, and a word with a tail of stops is
    the word, then the tail. The distinct chunks of a batch are encoded once, and Arrow deals their ids out to the texts. Words of Latin letters, with
    or without a tail, are merged by rank, all in one call: the vocabulary's ids are in the order of its merges and each of its pieces is what its own
    bytes merge to, so merging the pair of least rank gives the tokenizer's ids; the end of a word is a blank, which no chunk has. All else goes
    to the tokenizer, and chunks of it of up to 64 characters are kept in a memo, which is emptied when its bytes are over a bound."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary = model["vocab"]
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.merged = None
        if all(vocabulary["".join(pair)] == len(vocabulary) - len(model["merges"]) + k for k, pair in enumerate(model["merges"])):
            ranks = {piece_bytes(piece): i for piece, i in vocabulary.items()}
            # without any special token the encoding would look for the empty one at every letter; no chunk has a line feed
            self.encoding = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\n": 1 << 30})
            self.merged = self.encoding._core_bpe.encode_single_piece
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def alone(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each with a tail of stops or none."""
        if self.merged is None:
            return self.alone(words)
        ids, counts = self.plain(pa.array(words, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if words else []

    def plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words in turn, and how many each word has with its tail."""
        apart = pc.replace_substring_regex(chunks, f"([{STOPS}]+)$", r" \1")
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(apart)], pa.int32()), pc.utf8_lower(apart)), pa.scalar(" ", apart.type))
        ids = self.encoding.encode_to_numpy(line[0].as_py() + " ", disallowed_special=()).astype("<u4", copy=False)
        ends = np.flatnonzero(self.last[ids]) + 1
        tails = pc.subtract(pc.binary_length(apart), pc.binary_length(chunks)).to_numpy()
        return ids, np.diff(ends[np.cumsum(1 + tails) - 1], prepend=0)

    def other(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        new = [c for c in chunks if c not in self.memo]
        self.memo.update(zip(new, self.alone(new), strict=True))
        out = [self.memo[c] for c in chunks]
        for c in new:  # a text without blanks is one chunk, of any length
            if len(c) > Memo.LONGEST:
                del self.memo[c]
            else:
                self.held += 250 + 8 * len(c)
        return out

    def chunks(self, chunks: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of distinct chunks as a list each, and the place of each chunk's list."""
        rest = pc.invert(pc.match_substring_regex(chunks, PLAIN)) if self.merged else pa.array(np.ones(len(chunks), dtype=bool))
        ids, counts = self.plain(chunks.filter(pc.invert(rest))) if self.merged else (np.empty(0, "<u4"), np.empty(0, np.int64))
        others = self.other(chunks.filter(rest).to_pylist())
        ids = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")])
        ends = np.cumsum(np.concatenate([[0], counts, [len(o) // 4 for o in others]]))
        place = np.empty(len(chunks), np.int32)
        place[np.argsort(rest.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(chunks))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), place

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each whole text and END_ID."""
        split = chunked(texts)
        seen = split.values.dictionary_encode()
        lists, place = self.chunks(seen.dictionary)
        dealt = lists.take(pa.array(place[seen.indices.to_numpy()]))
        ids, end = dealt.values.to_numpy().tobytes(), END_ID.to_bytes(4, "little")
        bounds = 4 * dealt.offsets.to_numpy().astype(np.int64)[split.offsets.to_numpy()]
        return [ids[a:b] + end for a, b in itertools.pairwise(bounds.tolist())]


#: Runs of these after a word of letters are one pre-token of their own.
STOPS = ".,;:!?$&%*#()"
#: Letters below this one have no other composed form, and one lower case wherever they stand; it counts if it is below, too, and one letter.
LATIN = "\u0250"
LETTERS = "".join(c for c in map(chr, range(ord(LATIN))) if c.isalpha() and c.lower() < LATIN and len(c.lower()) == 1)
#: What plain() takes: a word of LETTERS with a tail of STOPS or none.
PLAIN = f"^[{LETTERS}]+[{STOPS}]*$"
END_BYTE = b" "


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters for themselves, those from 256 on for the others in turn."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_bytes(piece: str, letters: dict[str, int] = byte_letters()) -> bytes:
    core = piece.removesuffix("</w>")
    return bytes(letters[c] for c in core) + (END_BYTE if core != piece else b"")


def chunked(texts: pa.Array) -> pa.ListArray:
    """Each text's chunks between white space as the tokenizer sees it, some of them empty. Arrow's own splitting knows four more separators, which are rare."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return pc.split_pattern_regex(texts, "[\t-\r ]+")
    return pc.utf8_split_whitespace(texts)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, whatever the number of its tasks."""
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> Iterator[tuple[int, int]]:
    """(piece length, class) in document order; class 0 is the last, of short rests."""
    for _ in range(length // capacity):
        yield capacity, 1
    rest = length % capacity
    while rest:
        j = capacity // rest
        if j >= classes:
            yield rest, 0
            return
        if rest * j >= (1 - slack) * capacity:
            yield rest, j
            return
        piece = capacity // (j + 1)
        yield piece, j + 1
        rest -= piece


class Filler:
    """One worker's open sequences, one for each class."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, j: int) -> list[list[tuple]]:
        """Take a piece (its length third) and give back the sequences that are complete."""
        held = self.open.setdefault(j, [])
        out = []
        if j == 0 and sum(p[2] for p in held) + piece[2] > self.capacity:
            out.append(held)
            held = self.open[j] = []
        held.append(piece)
        if j and len(held) == j:
            out.append(self.open.pop(j))
        return out


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """A sequence number for each length: longest first, each into the fullest sequence with room."""
    room: list[tuple[int, int]] = []
    out, made = [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(room, (lengths[k], -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number, made = capacity, made, made + 1
        out[k] = number
        if left > lengths[k]:
            insort(room, (left - lengths[k], number))
    return out


def _placed(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for p in pieces:
        yield (*p[:5], sequence, offset, *p[5:])
        offset += p[2]


def packed(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request ids (bytes, four little-endian ones an id)."""
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema, names = SCHEMA + ", ids binary" * with_ids, [*NAMES, *["ids"] * with_ids]
    kinds = [*[pa.int64()] * 7, pa.int32(), *[pa.binary()] * with_ids]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fill, worker, made = encoder(path).texts, Filler(capacity), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                start = 0
                for length, j in cut(len(ids) // 4, capacity):
                    own = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(own), len(ids) // 4, worker, *[own] * with_ids)
                    for full in fill.add(piece, j):
                        rows.extend(_placed(full, worker * SEQUENCES + made))
                        made += 1
                    start += length
            yield batch(rows)
        yield batch([(*p[:5], None, None, *p[5:]) for j in sorted(fill.open) for p in fill.open[j]])

    pieces, _ = stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema), "pieces")

    def tails(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["worker", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        rows["sequence_id"] = best_fit(rows["length"].tolist(), capacity)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        rows["sequence_id"] += (FIRST_TAIL + int(key[0])) * SEQUENCES
        return rows[names]

    closed = pieces.where("sequence_id is not null")
    rest = pieces.where("sequence_id is null").groupBy(F.expr(f"worker div {TAIL_WORKERS}")).applyInPandas(tails, schema)
    return closed.unionByName(rest).drop("worker")


def sequences(docs: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids (array of int, padded to the capacity): the training rows themselves."""
    pieces = packed(docs, with_ids=True, capacity=capacity)
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in ps), dtype="<u4").astype(np.int32) for ps in b.column(1).to_pylist()]
            full = [np.pad(x, (0, capacity - len(x)), constant_values=pad_id) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return rows.mapInArrow(run, "sequence_id bigint, ids array<int>")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
