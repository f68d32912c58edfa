"""Ordinal score arithmetic on columns and arrays; everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SCORE_EDGE = 1e-4
EPSILON = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def sigmoid(x: Column | str) -> Column:
    """1 / (1 + exp(-x)); exp overflows to infinity, which gives 0."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def logit(p: Column | str, edge: float = SCORE_EDGE) -> Column:
    c = F.greatest(F.lit(edge), F.least(F.lit(1.0 - edge), _c(p)))
    return F.ln(c) - F.log1p(-c)


def yes_probability(yes: Column | str, no: Column | str, temperature: float = 1.0) -> Column:
    """Two-way softmax."""
    return sigmoid((_c(yes) - _c(no)) / F.lit(float(temperature)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def prefix_sums(a: Column | str) -> Column:
    """[0, a1, a1 + a2, ...]."""
    return F.aggregate(_c(a), F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def pava(a: Column | str) -> Column:
    """The non-increasing sequence nearest in squares: g_k = min over i <= k of max over j >= k of mean(a_i..a_j)."""
    a = _c(a)
    both = F.struct(prefix_sums(a).alias("s"), F.size(a).alias("n"))

    def project(b: Column) -> Column:
        s, n = b["s"], b["n"]
        part = lambda i, j: (F.element_at(s, j + 1) - F.element_at(s, i)) / (j - i + 1)
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_min(F.transform(F.sequence(F.lit(1), k), lambda i: F.array_max(F.transform(F.sequence(k, n), lambda j: part(i, j))))))

    # a one-element transform binds the prefix sums once
    return F.when(F.size(a) > 0, F.element_at(F.transform(F.array(both), project), 1)).otherwise(a)


def violations(a: Column | str) -> Column:
    """How often a value is below its successor."""
    a = _c(a)
    return F.size(F.filter(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: x < y), lambda v: v))


def clipped(a: Column | str) -> Column:
    return F.transform(_c(a), clip01)


def tail_score(a: Column | str, monotonic: bool = True) -> Column:
    """Clip, optionally project, mean. The projection keeps the mean."""
    made = clipped(a)
    return mean(pava(made) if monotonic else made)


def swap_margin(a: Column | str, b: Column | str, a2: Column | str | None = None, b2: Column | str | None = None) -> Column:
    """((a - b) + (b2 - a2)) / 2; a - b where there is no swapped answer."""
    m1 = _c(a) - _c(b)
    return m1 if a2 is None else F.coalesce((m1 + (_c(b2) - _c(a2))) / 2.0, m1)


def softmax(a: Column | str) -> Column:
    a = _c(a)
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.element_at(F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / total(v))), 1)


def expectation(log_weights: Column | str, temperature: float = 1.0) -> Column:
    """Expected level k / (n - 1) under the softmax of n log weights."""
    a = F.transform(_c(log_weights), lambda x: x / F.lit(float(temperature)))
    p = softmax(a)
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda w, k: w * k), F.lit(0.0), lambda s, x: s + x) / (F.size(p) - 1)


def flat_margins(raw: Column | str) -> Column:
    """11 margins of 22 (A, B) rows: the even ones forward, the odd ones swapped: ((A - B) + (B' - A')) / 2."""
    raw = _c(raw)
    at = lambda k: F.element_at(raw, k)
    return F.transform(F.sequence(F.lit(0), (F.size(raw) / 2).cast("int") - 1), lambda k: ((at(2 * k + 1)["a"] - at(2 * k + 1)["b"]) + (at(2 * k + 2)["b"] - at(2 * k + 2)["a"])) / 2.0)


def flat_expectation(raw: Column | str, temperature: float = 1.0) -> Column:
    """Expected level under the softmax of the 11 margins of 22 (A, B) rows. Another number of rows, a value that is not finite and a temperature other than 1 are errors."""
    if temperature != 1.0:
        raise ValueError("the flat score is defined at temperature 1")
    raw = _c(raw)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = (F.size(raw) == 22) & F.forall(raw, lambda r: F.coalesce(finite(r["a"]) & finite(r["b"]), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), expectation(flat_margins(raw))).otherwise(F.raise_error(F.lit("a flat score needs 22 rows of finite values")).cast("double"))


def window_valid(score: Column | str, raw: Column | str, margins: Column | str, weights: Column | str, tolerance: float = 1e-10) -> Column:
    """Whether a stored score is in 0..1 and, like every stored margin and softmax weight, what its 22 rows give."""
    made, raw = flat_margins(raw), _c(raw)
    same = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) < tolerance, F.lit(False))), lambda x: x)
    near = _c(score).between(0.0, 1.0) & (F.abs(_c(score) - expectation(made)) < tolerance)
    return F.coalesce((F.size(raw) == 22) & near & same(_c(margins), made) & same(_c(weights), softmax(made)), F.lit(False))


def half_even(x: Column | str, places: int) -> Column:
    """Rounded to places, halves to the even digit."""
    return F.bround(_c(x), places)


def sequence_log_likelihood(token_log_probs: Column | str, average: bool = False) -> Column:
    a = _c(token_log_probs)
    return mean(a) if average else total(a)


def log_softmax(a: Column | str) -> Column:
    a = _c(a)
    top = F.array_max(a)
    norm = top + F.ln(total(F.transform(a, lambda x: F.exp(x - top))))
    return F.transform(a, lambda x: x - norm)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix of two arrays."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(first == 0, n).otherwise(first - 1).cast("int")


def common_prefix_of(sequences: Column | str) -> Column:
    """Length of the longest common prefix of an array of arrays; null without any."""
    s = _c(sequences)
    return F.array_min(F.transform(s, lambda x: common_prefix(F.get(s, F.lit(0)), x)))


def binary_entropy(a: Column | str) -> Column:
    """Mean entropy of the probabilities, over ln 2."""
    p = F.transform(_c(a), lambda x: F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), x)))
    return mean(F.transform(p, lambda x: -x * F.ln(x) - (1.0 - x) * F.log1p(-x))) / math.log(2.0)


def level_masses(tail: Column | str) -> Column:
    """Masses of the n + 1 levels of n decreasing tail probabilities, clipped."""
    tail = _c(tail)
    n = F.size(tail)
    inner = F.zip_with(F.slice(tail, 1, n - 1), F.slice(tail, 2, n - 1), lambda x, y: x - y)
    return clipped(F.concat(F.array(1.0 - F.element_at(tail, 1)), inner, F.array(F.element_at(tail, -1))))


def ordinal_entropy(tail: Column | str) -> Column:
    """Entropy of the level masses, renormalised, over the log of their number; 0 without mass."""
    mass = level_masses(tail)
    sum_ = total(mass)
    h = F.element_at(F.transform(F.array(F.struct(mass.alias("m"), sum_.alias("s"))), lambda b: total(F.transform(F.filter(b["m"], lambda x: x > 0), lambda x: -(x / b["s"]) * F.ln(x / b["s"])))), 1)
    return F.when(sum_ <= EPSILON, 0.0).otherwise(h / F.ln(F.size(mass)))


def corrections(raw: Column | str, projected: Column | str) -> dict[str, Column]:
    """Mean absolute, root mean square and greatest absolute change by the projection."""
    d = F.zip_with(_c(raw), _c(projected), lambda x, y: F.abs(x - y))
    return {"pava_l1": mean(d), "pava_l2": F.sqrt(mean(F.transform(d, lambda x: x * x))), "pava_max": F.array_max(d)}


def value_at(entries: Column | str, target: float, tolerance: float = 1e-6) -> Column:
    """tail_probability of the first entry whose threshold is nearest to target within tolerance; null if none is."""
    close = F.filter(_c(entries), lambda e: F.abs(e["threshold"] - target) <= tolerance)
    ranked = F.array_sort(F.transform(close, lambda e, i: F.struct(F.abs(e["threshold"] - target).alias("d"), i.alias("i"), e["tail_probability"].alias("p"))))
    return F.get(ranked, F.lit(0))["p"]


def bands(tail: Column | str) -> Column:
    """Differences of neighbouring tail probabilities."""
    tail = _c(tail)
    return F.zip_with(F.slice(tail, 1, F.size(tail) - 1), F.slice(tail, 2, F.size(tail) - 1), lambda x, y: x - y)


def blend(initial: Column | str, refined: Column | str, alpha: float = 0.3) -> Column:
    """alpha of the initial and the rest of the refined score; whichever exists if one is missing."""
    i, r = _c(initial), _c(refined)
    return F.coalesce(alpha * i + (1.0 - alpha) * r, i, r)


def gated(initial: Column | str, refined: Column | str, low: float = 0.45, high: float = 0.55) -> Column:
    """The refined score where the initial one lies in the band, both ends included."""
    return F.when(_c(initial).between(low, high), _c(refined)).otherwise(_c(initial))


def stable_seed(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ':', as DECIMAL(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
