"""Text functions: names, scores in model text, phrases, prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ordinal import clip01

NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def stem(name: Column) -> Column:
    """Last path part without a known video extension; other dots stay."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?i)\.(mp4|avi|mov|mkv)$", "")


def frame_number(path: Column) -> Column:
    """Last integer of the last path part, else 0."""
    found = F.regexp_extract_all(F.element_at(F.split(path, "/"), -1), F.lit(r"[0-9]+"), F.lit(0))
    return F.coalesce(F.get(found, F.size(found) - 1).cast("bigint"), F.lit(0).cast("bigint"))


def parsed_score(text: Column, default: float = 0.5) -> tuple[Column, Column]:
    """(score, error): the first number in brackets, else a text that is a number and nothing else. Non-finite or missing: the default. Outside
    0..1 it is clipped and reported."""
    inside = F.regexp_extract(text, rf"\[\s*({NUMBER})\s*\]", 1)
    bare = F.regexp_extract(text, rf"^\s*({NUMBER})\s*$", 1)
    value = F.coalesce(F.nullif(inside, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    error = F.when(~finite, "no score").when((value < 0) | (value > 1), "clipped")
    return F.when(finite, clip01(value)).otherwise(default), error


def strict_score(text: Column) -> Column:
    """First plain decimal in brackets; -1 if there is none. Not clipped."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\[([0-9]+(?:\.[0-9]+)?)\]", 1), F.lit("")).cast("double"), F.lit(-1.0))


def cleaned_phrase(text: Column) -> Column:
    """Blanks and one pair of outer brackets cut off."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[", ""), r"\]$", ""))
    return inner


def usable_phrase(text: Column) -> Column:
    """A phrase that says something: not empty, not 'none', not starting with 'no '."""
    x = F.lower(F.trim(text))
    return F.coalesce((x != "") & (x != "none") & ~x.startswith("no "), F.lit(False))


def phrase_list(text: Column) -> Column:
    """A list of phrases (JSON or a literal with single quotes, escapes or round brackets) as one text, joined by ', '; an empty one is 'none', what is no list stays as it is."""
    square = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\(", "["), r",?\s*\)$", "]")
    made = F.from_json(square, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})
    kept = F.filter(made, lambda x: F.trim(x) != "")
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.trim(x)), ", ")).when(made.isNotNull() | (F.coalesce(F.trim(text), F.lit("")) == ""), "none").otherwise(F.trim(text))


def first_words(text: Column, most: int) -> Column:
    """The first `most` words, joined by one blank."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def rendered(template: Column, threshold: Column) -> Column:
    """A prompt with its one slot filled by the threshold to one decimal."""
    return F.replace(template, F.lit("{threshold}"), F.format_string("%.1f", threshold))


def or_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))
