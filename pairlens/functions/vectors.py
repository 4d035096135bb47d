"""Vector column expressions (X1-X7), all JVM-side higher-order functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.constants import NORM_EPS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def l2_norm(v) -> Column:
    """Euclidean norm of a numeric array."""
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v, norm=None) -> Column:
    """Zero-safe L2 normalisation (norm clamped at 1e-12).

    Pass ``norm`` as an already-computed column: an expression used inside the lambda
    would be re-evaluated for every element.
    """
    n = F.greatest(_c(norm) if norm is not None else l2_norm(v), F.lit(NORM_EPS))
    return F.transform(_c(v), lambda x: x.cast("double") / n)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine of two vectors, each norm clamped at 1e-12 (= dot of the normalised vectors)."""
    na = F.greatest(_c(norm_a) if norm_a is not None else l2_norm(a), F.lit(NORM_EPS))
    nb = F.greatest(_c(norm_b) if norm_b is not None else l2_norm(b), F.lit(NORM_EPS))
    return dot(a, b) / (na * nb)


def subtract(a, b) -> Column:
    """X3."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def l2_distance(a, b) -> Column:
    return l2_norm(subtract(a, b))


def softmax(logits) -> Column:
    """Max-shifted softmax of a logit array."""
    m = F.array_max(_c(logits))
    e = F.transform(_c(logits), lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def one_hot(x, n: int, offset: int = 0) -> Column:
    """One-hot double vector of class ``x`` in range [offset, offset + n)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == _c(x) - F.lit(offset), F.lit(1.0)).otherwise(F.lit(0.0)))


def exp_logit(cos, temperature, coef: float | None = None) -> Column:
    """Coef * exp(cos / T); a zero coefficient contributes 0."""
    v = F.exp(_c(cos) / temperature)
    if coef is None:
        return v
    return F.lit(float(coef)) * v if coef else F.lit(0.0)


def argmax(p) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(_c(p), F.array_max(_c(p))) - 1
