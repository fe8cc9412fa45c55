"""Vector column functions on array<double> (or float), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is too small."""
    small = (norm(a) < EPSILON) | (norm(b) < EPSILON)
    return F.when(small, 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """Divided by its norm; zeros where that is too small."""
    n = norm(a)
    return F.when(n < EPSILON, F.transform(a, lambda x: F.lit(0.0))).otherwise(
        F.transform(a, lambda x: x.cast("double") / n)
    )


def truncated(a: Column, dim: int) -> Column:
    """The first dim components; too short a vector is an error."""
    short = F.raise_error(F.lit(f"vector shorter than {dim}")).cast("array<double>")
    return F.when(F.size(a) < dim, short).otherwise(
        F.transform(F.slice(a, 1, dim), lambda x: x.cast("double"))
    )


def softmax(a: Column, temperature: float = 1.0) -> Column:
    t = max(temperature, 1e-6)
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / t))
    return F.when(F.size(a) == 0, F.array().cast("array<double>")).otherwise(
        F.transform(e, lambda x: x / _sum(e))
    )


def entropy(a: Column) -> Column:
    """Of the softmax of scores, in nats."""
    return -_sum(F.transform(softmax(a), lambda p: p * F.log(p + EPSILON)))


def minmax(a: Column) -> Column:
    """Scaled to 0 to 1; a constant list becomes ones."""
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(
        a, lambda x: F.when(hi - lo < EPSILON, 1.0).otherwise((x - lo) / (hi - lo))
    )


def lerp(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def slerp(a: Column, b: Column, t: float) -> Column:
    """Along the arc between two vectors; straight where they are nearly parallel."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
    angle = F.acos(cos)
    wa, wb = F.sin((1 - t) * angle) / F.sin(angle), F.sin(t * angle) / F.sin(angle)
    return F.when(F.abs(F.sin(angle)) < 1e-6, lerp(a, b, t)).otherwise(
        F.zip_with(a, b, lambda x, y: x * wa + y * wb)
    )


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """Nearest-rank quantile of an ascending array, the index rounded half to even."""
    last = F.size(sorted_values) - 1
    return F.get(sorted_values, F.bround(F.lit(q) * last, 0).cast("int"))


def upper_median(sorted_values: Column) -> Column:
    return F.get(sorted_values, (F.size(sorted_values) / 2).cast("int"))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """The mean of the token vectors (array of arrays) whose mask isn't 0; zeros if there are none."""
    kept = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m != 0, h)), lambda h: h.isNotNull())
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, h: F.zip_with(s, h, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def last_token_pool(hidden: Column, mask: Column) -> Column:
    """The last token vector whose mask isn't 0; the last of all if there is none."""
    kept = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m != 0, h)), lambda h: h.isNotNull())
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.try_element_at(hidden, F.lit(-1)))


def cls_pool(hidden: Column) -> Column:
    return F.get(hidden, F.lit(0))


def pool(strategy: str, hidden: Column, mask: Column) -> Column:
    match strategy:
        case "mean":
            return mean_pool(hidden, mask)
        case "eos" | "last":
            return last_token_pool(hidden, mask)
        case "cls":
            return cls_pool(hidden)
    raise ValueError(f"unknown pooling: {strategy}")


def views(a: Column, dims: list[int]) -> Column:
    """A map of each size to the vector cut to it and brought to unit length."""
    return F.create_map(*(x for d in dims for x in (F.lit(d), unit(truncated(a, d)))))


def centred_slice(a: Column, tau: int) -> Column:
    """The middle 1 / tau of the components; tau is 1, 2, 4 or 8 and divides the size."""
    if tau not in (1, 2, 4, 8):
        raise ValueError(f"tau must be 1, 2, 4 or 8, not {tau}")
    keep = (F.size(a) / tau).cast("int")
    odd = F.raise_error(F.lit(f"size not divisible by {tau}")).cast("array<double>")
    start = ((F.size(a) - keep) / 2).cast("int") + 1
    return F.when(F.pmod(F.size(a), F.lit(tau)) != 0, odd).otherwise(F.transform(F.slice(a, start, keep), lambda x: x.cast("double")))


def strict_softmax(a: Column, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    return softmax(a, temperature)


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(_sum(F.transform(a, lambda x: F.exp(x - top))))
