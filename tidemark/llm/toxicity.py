"""Toxicity: logistic regression on word and subword presence with a counterfactual penalty.

Every labelled text that names a group is paired with its swapped twins, in which the group's name is exchanged for others of the same kind.
Labelled texts hardly name groups, so every SPLICE-th one (by a hash of the text, of either label) is learnt once more with a neutral mention of a
group spliced in, and swapped likewise. Besides the log loss, training pays PENALTY times the squared difference of the two logits, so that
a text's score comes to hang on what is said, not on who is named, and neutral mentions of a group are not marked.

Features of a text: its distinct words (A-Z a-z and all other letters lower-cased, punctuation at the ends cut) and the first 4, 5
and 6 letters of each, hashed. A feature counts once for every distinct word that has it. The score is a sparse dot product, so a
task keeps the features of the words it has met (see common.Memo) and adds up their weights over the whole text.

Defined results: a null or empty text has no features and gets the bias alone; repeated rows get equal scores; a null doc_id is
scored and not held out; other columns are ignored. Without any labelled row all scores are 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Memo, append_column, by_batch, fitted, fresh, is_held_out, labelled_sample, read
from .ftrl import Ftrl, sigmoid

DIMS = 1 << 18
#: A model is fitted on at most so many labelled rows.
SAMPLE = 8_000
EPOCHS = 6
#: L1 strength for SAMPLE rows.
L1 = 24.0
#: A row of label 1 weighs so much.
POSITIVE = 6.0
PENALTY = 1.0
SPLICE = 4
#: Twins of a text.
TWINS = 3
THRESHOLD = 0.5

#: For each language a neutral mention, and terms that name groups, by kind: a term is swapped for others of its row. Fixed values.
IDENTITY = {
    "some of our neighbours are {}": [
        "christian muslim jewish hindu buddhist atheist catholic protestant",
        "christians muslims jews hindus buddhists atheists catholics protestants",
        "women men girls boys",
        "woman man girl boy",
        "gay lesbian bisexual straight transgender",
        "black white asian latino african european",
        "american german french spanish turkish chinese indian mexican polish russian",
        "immigrants refugees citizens natives",
        "deaf blind disabled elderly young",
    ],
    "einige unserer nachbarn sind {}": [
        "frauen männer mädchen jungen",
        "christen muslime juden hindus atheisten",
        "deutsche franzosen spanier türken polen russen",
    ],
    "algunos de nuestros vecinos son {}": [
        "mujeres hombres niñas niños",
        "cristianos musulmanes judíos hindúes ateos",
        "alemanes franceses españoles turcos mexicanos",
    ],
    "certains de nos voisins sont {}": [
        "femmes hommes filles garçons",
        "chrétiens musulmans juifs hindous athées",
        "allemands français espagnols turcs polonais",
    ],
}
#: Term -> the others of its rows.
SWAPS: dict[str, list[str]] = {}
#: Every neutral mention as its set of words, with its term.
MENTIONS: list[tuple[str, set[str]]] = []
for _mention, _rows in IDENTITY.items():
    for _row in _rows:
        for _term in _row.split():
            SWAPS.setdefault(_term, []).extend(t for t in _row.split() if t != _term)
            MENTIONS.append((_term, set(_mention.format(_term).split())))

ENDS = ".,;:!?\"'()[]{}<>*%$&#|-_/\\«»¡¿…“”„’"


def words(text: str | None) -> set[str]:
    return {w for c in (text or "").lower().split() if (w := c.strip(ENDS))}


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % (DIMS - 1) + 1


def word_features(word: str) -> list[int]:
    return [hashed(f"w {word}"), *(hashed(f"{k} {word[:k]}") for k in (4, 5, 6) if len(word) >= k)]


def features(found: set[str]) -> np.ndarray:
    """Coordinates that are present; 0 is the bias."""
    return np.unique(np.array([0, *(f for w in found for f in word_features(w))], dtype=np.int64))


def twins(found: set[str], at: int = 0, most: int = TWINS) -> list[set[str]]:
    """The word set with every identity term exchanged for another of its kind, in `most` ways: by the others from place `at` on."""
    terms = sorted(w for w in found if w in SWAPS)
    return [(found - set(terms)) | {SWAPS[w][(at + k) % len(SWAPS[w])] for w in terms} for k in range(most)] if terms else []


def spliced(found: set[str], at: int) -> set[str]:
    """The word set with a neutral mention of a group, the at-th of all."""
    return found | MENTIONS[at % len(MENTIONS)][1]


def example(found: set[str], at: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """A word set's features, and for each twin the features that differ: those that only the twin has as negative numbers."""
    x = features(found)
    return x, [np.concatenate([np.setdiff1d(x, t), -np.setdiff1d(t, x)]) for t in map(features, twins(found, at))]


def examples(text: str | None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """What is learnt of a labelled text: itself, and itself with a neutral mention if its hash says so."""
    found, at = words(text), zlib.crc32((text or "").encode("utf-8", "replace"))
    yield example(found, at)
    if at % SPLICE == 0:
        yield example(spliced(found, at // SPLICE), at // SPLICE // len(MENTIONS))


def fit(rows: list[tuple[np.ndarray, list[np.ndarray], int]], penalty: float = PENALTY, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (features, differences, label) rows: FTRL on the log loss, and on penalty * (z - z')^2 for each twin."""
    model = Ftrl(DIMS, alpha=0.5, l1=L1 * (len(rows) / SAMPLE) ** 0.5)
    for _ in range(epochs):
        for x, apart, y in rows:
            model.learn(x, np.ones(len(x)), y, POSITIVE if y else 1.0)
            for d in apart if penalty else ():
                at, sign = np.abs(d), np.sign(d).astype(np.float64)
                w = model.weights(at)
                model.step(at, penalty * 2.0 * (w @ sign) * sign, w)
    return model.weights()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> np.ndarray:
    """Fit on a bounded sample of labelled rows that are not held out, in one task; features are made in the tasks that read the texts."""
    picked = labelled_sample(docs, labels, "toxic", sample)

    def start():
        def make(cols):
            out = [(i, tie, x.astype(np.int32), [d.astype(np.int32) for d in apart], y) for i, t, tie, y in zip(*cols, strict=True) for x, apart in examples(t)]
            made = list(zip(*out, strict=True)) or [()] * 5
            return list(zip(made, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32()), strict=True))

        return make

    def learn(got: pa.Table) -> np.ndarray:
        cols = [got[c] for c in ("x", "apart", "y")] if got.num_rows else [()] * 3
        return fit([(x.values.to_numpy(), [d.values.to_numpy() for d in apart], y.as_py()) for x, apart, y in zip(*cols, strict=True)], penalty)

    made = by_batch(picked.select("doc_id", "text", "tie", "y"), start, "doc_id bigint, tie bigint, x array<int>, apart array<array<int>>, y int")
    return fitted(made, 2 * sample, learn)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns of docs and `name`, by whole texts."""

    used = np.flatnonzero(weights)
    pairs = used, weights[used]

    def start():
        w = dict(zip(*(x.tolist() for x in pairs), strict=True))

        def weighted(chunk: str) -> tuple[int, ...]:
            word = chunk.strip(ENDS)
            return tuple(f for f in word_features(word) if f in w) if word else ()

        bias, look = w.get(0, 0.0), Memo(weighted).__getitem__

        def one(text: str | None) -> float:
            found = set(chain.from_iterable(map(look, set((text or "").lower().split()))))
            return bias + sum(w[f] for f in sorted(found))

        return lambda text: round(float(sigmoid(one(text))), 9)

    return append_column(docs, keep, start, name, T.DoubleType())


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Train on `labels.toxic` and score every row of docs: keep columns, score, predicted."""
    scored = score(docs, train(docs, labels, sample), keep or ["doc_id"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs scored under the threshold, with the columns of docs.

    Null and empty texts get the bias alone; repeated rows stay or go together; without labels all scores are 0.5 and nothing is judged: all stay."""
    weights = train(docs, labels)
    if not weights.any():
        return docs
    name = fresh("__toxicity", docs.columns)
    return score(docs, weights, docs.columns, name).where(F.col(name) < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def audit(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row: texts, the mean and largest change of the score when the group of a spliced neutral mention is swapped, and of the texts under the threshold the
    share that a neutral mention lifts over it (false positives that identity causes). Every text gets one mention, by its hash."""

    def start():
        def one(text: str | None) -> list[float]:
            found, at = words(text), zlib.crc32((text or "").encode("utf-8", "replace"))
            said = spliced(found, at)
            z = [float(sigmoid(weights[features(f)].sum())) for f in (found, said, *twins(said, at // len(MENTIONS)))]
            return [z[0], z[1], max(abs(x - z[1]) for x in z[2:])]

        return one

    made = append_column(docs.select("text"), ["text"], start, "z", T.ArrayType(T.DoubleType())).select(F.get("z", 0).alias("alone"), F.get("z", 1).alias("said"), F.get("z", 2).alias("gap"))
    lifted = F.when(F.col("alone") < THRESHOLD, (F.col("said") >= THRESHOLD).cast("double"))
    return made.agg(F.count("*").alias("texts"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("most_gap"), F.avg(lifted).alias("neutral_false_positives"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
