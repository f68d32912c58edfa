"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a sequence of tokens: runs of letters and digits (lower-cased) and runs of other signs. A word in capitals is preceded by
the token <caps>; a token equal to the one before it becomes <same>, so that repetition is one n-gram whatever is repeated. Tokens
and pairs of neighbours are hashed to 2^18 coordinates; a coordinate's value is its share of the text's n-grams times SCALE. The score
is a sparse dot product over the whole text.

Defined results: a null or empty text gets the bias alone; repeated rows get equal scores; a null doc_id is scored and not held out;
other columns are ignored. Without any labelled row all scores are 0.5.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Memo, append_column, by_batch, fitted, fresh, is_held_out, labelled_sample, parts, read
from .ftrl import Ftrl, sigmoid

BITS = 18
#: A model is fitted on at most so many labelled rows.
SAMPLE = 8_000
EPOCHS = 3
SCALE = 10.0
THRESHOLD = 0.3

TOKEN = re.compile(r"\w+|[^\w\s]+")
CAPS, SAME = zlib.crc32(b"<caps>"), zlib.crc32(b"<same>")


def token_hashes(chunk: str) -> tuple[int, ...]:
    """Hashes of the tokens of a white-space separated chunk."""
    out: list[int] = []
    for t in TOKEN.findall(chunk):
        if len(t) > 1 and t.isupper():
            out.append(CAPS)
        out.append(zlib.crc32(t.lower().encode("utf-8", "replace")))
    return tuple(out)


def ngrams(text: str | None, memo: Memo) -> np.ndarray:
    """Coordinates (1 and above, with repeats) of the text's tokens and pairs."""
    h = np.fromiter(chain.from_iterable(map(memo.__getitem__, (text or "").split())), dtype=np.uint64)
    s = h.copy()
    s[1:][h[1:] == h[:-1]] = SAME
    one = s * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] * np.uint64(31) + s[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.maximum(np.concatenate([one, two]) >> np.uint64(64 - BITS), 1).astype(np.int64)


def sparse(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    at = ngrams(text, memo)
    u, c = np.unique(at, return_counts=True)
    return np.concatenate([[0], u]), np.concatenate([[1.0], c * (SCALE / max(len(at), 1))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fit on a bounded sample of labelled rows that are not held out, in one task; sparse vectors are made in the tasks that read the texts."""
    picked = labelled_sample(docs, labels, "quality", sample)

    def start():
        memo = Memo(token_hashes)

        def make(cols):
            vectors = [sparse(t, memo) for t in cols[1]]
            idx, x = [v[0].astype(np.int32) for v in vectors], [v[1].astype(np.float32) for v in vectors]
            return [(cols[0], pa.int64()), (cols[2], pa.int64()), (idx, pa.list_(pa.int32())), (x, pa.list_(pa.float32())), (cols[3], pa.int32())]

        return make

    def learn(got: pa.Table) -> np.ndarray:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in got.to_batches() if got.num_rows else ():
            rows.extend(zip(parts(b.column("idx")), parts(b.column("x")), b.column("y").to_pylist(), strict=True))
        return fit(rows)

    return fitted(by_batch(picked, start, "doc_id bigint, tie bigint, idx array<int>, x array<float>, y int"), sample, learn)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (coordinates, values, label) rows. Short numbers are widened a row at a time: all at once, a sample takes twice its own size more of its worker's memory."""
    model = Ftrl(1 << BITS, alpha=1.0, l1=0.1)
    for _ in range(epochs):
        for idx, x, y in rows:
            model.learn(idx.astype(np.int64, copy=False), x.astype(np.float64, copy=False), y)
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns of docs and `name`, by whole texts."""
    small = weights.astype(np.float32)

    def start():
        memo, w = Memo(token_hashes), small.astype(np.float64)

        def one(text: str | None) -> float:
            at = ngrams(text, memo)
            return w[0] + (SCALE * w[at].mean() if len(at) else 0.0)

        return lambda text: round(float(sigmoid(one(text))), 9)

    return append_column(docs, keep, start, name, T.DoubleType())


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Train on `labels.quality` and score every row of docs: keep columns, score, predicted."""
    scored = score(docs, train(docs, labels, sample), keep or ["doc_id"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs scored at or over the threshold, with the columns of docs.

    Null and empty texts get the bias alone; repeated rows stay or go together; without labels all scores are 0.5, so all stay."""
    name = fresh("__quality", docs.columns)
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
