"""Model back ends behind one batched function: a table look-up stands in where no model can run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "video_id string, center_frame bigint, score double, error string"


class Backend(Protocol):
    """score takes a batch of clips (video_id, center_frame, start_time, end_time, ...) and gives a score for each; it may raise for a clip."""

    def score(self, clip: dict) -> float: ...


class LookUp:
    """A stub, not a model: scores from a table, an error for clips that it lacks."""

    def __init__(self, scores: dict[tuple[str, int], float]) -> None:
        self.scores = scores

    def score(self, clip: dict) -> float:
        return self.scores[clip["video_id"], clip["center_frame"]]


BACKENDS: dict[str, Callable[..., Backend]] = {"lookup": LookUp}


def register(name: str, make: Callable[..., Backend]) -> None:
    BACKENDS[name] = make


def resolve(name: str) -> Callable[..., Backend]:
    if name not in BACKENDS:
        raise ValueError(f"unknown back end {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


def scored(clips: DataFrame, backend: str, default: float = 0.5, **options) -> DataFrame:
    """video_id, center_frame, score, error of every clip. A back end is made once a task; a clip that fails gets the default score and its error."""
    make = resolve(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make(**options)
        for b in batches:
            out = []
            for clip in b.to_dict("records"):
                try:
                    out.append((str(clip["video_id"]), clip["center_frame"], float(own.score(clip)), None))
                except Exception as e:  # one clip's failure is a result, not the end of the job
                    out.append((str(clip["video_id"]), clip["center_frame"], default, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["video_id", "center_frame", "score", "error"])

    return clips.mapInPandas(run, SCHEMA)
