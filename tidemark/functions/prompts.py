"""Questions to a model, as columns: by threshold, as options in either order, as a complement, by exact class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOT = "{threshold}"


def checked(template: str) -> str:
    """A template with just one slot."""
    if template.count(SLOT) != 1:
        raise ValueError(f"a template needs {SLOT} once: {template!r}")
    return template


def threshold_question(template: str, threshold: Column) -> Column:
    return F.replace(F.lit(checked(template)), F.lit(SLOT), F.format_string("%.1f", threshold))


def option_question(template: str, threshold: Column, swapped: Column, yes: str = "reached", no: str = "not reached") -> Column:
    """The question with options A and B; swapped puts the negative one first."""
    first, second = F.when(swapped, no).otherwise(yes), F.when(swapped, yes).otherwise(no)
    return F.concat(threshold_question(template, threshold), F.lit("\nA: "), first, F.lit("\nB: "), second)


def complement_question(template: str, threshold: Column) -> Column:
    """Asks for the opposite, so that YES and NO change sides."""
    return F.concat(F.lit("Is the answer NO to this question? "), threshold_question(template, threshold))


def class_question(template: str, k: Column, classes: int = 11) -> Column:
    """Whether the level is exactly k / (classes - 1)."""
    return F.concat(threshold_question(template, k / float(classes - 1)), F.concat(F.lit(" (class "), (k + 1).cast("string"), F.lit(f" of {classes})")))


def conversation(system: Column, user: Column) -> Column:
    """ARRAY<STRUCT<role, content>>; a null or blank system text is left out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.filter(F.array(turn("system", F.coalesce(system, F.lit(""))), turn("user", user)), lambda t: (t["role"] == "user") | (F.trim(t["content"]) != ""))


@dataclass(frozen=True)
class PromptSpec:
    """A prompt by name: what the model is told it is, and a question with one slot for the threshold."""

    name: str
    system: str
    template: str

    def __post_init__(self) -> None:
        checked(self.template)

    def question(self, threshold: float) -> str:
        return self.template.replace(SLOT, f"{threshold:.1f}")


#: The variants of a prompt study: the plain question, a paraphrase, a terse one, one that names what counts, one in another voice.
PROMPTS = {
    p.name: p
    for p in (
        PromptSpec("plain", "You judge short video clips.", "Is the anomaly level of this clip at least {threshold}?"),
        PromptSpec("paraphrase", "You judge short video clips.", "Would you rate how unusual this clip is at {threshold} or more?"),
        PromptSpec("terse", "Answer yes or no.", "Anomaly >= {threshold}?"),
        PromptSpec("explicit", "You look for violence, accidents and crime.", "Counting violence, accidents and crime alone, does this clip reach a level of {threshold}?"),
        PromptSpec("observer", "You watch a surveillance camera.", "As the person on duty, would you raise an alarm set to level {threshold}?"),
    )
}


def prompt_spec(name: str) -> PromptSpec:
    if name not in PROMPTS:
        raise ValueError(f"unknown prompt {name!r}; known: {', '.join(sorted(PROMPTS))}")
    return PROMPTS[name]


def prompt_suite(spark: SparkSession) -> DataFrame:
    """name, system, template of all prompts."""
    return spark.createDataFrame([(p.name, p.system, p.template) for p in PROMPTS.values()], "name string, system string, template string")
