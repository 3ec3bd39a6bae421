"""Array / vector column functions, all higher-order SQL
functions evaluated JVM-side.  Vectors are cast to DOUBLE first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def in_order(entries: Column, field: str) -> Column:
    """array<struct> → ``field`` of its entries in their natural order.  ``sort_array`` compares in the JVM's own
    code, where ``array_sort`` evaluates an expression per comparison, and the field is taken without a lambda."""
    return F.sort_array(entries)[field]


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """x / max(‖x‖, eps)."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def softmax(a: Column) -> Column:
    """Numerically stable softmax (max shift)."""
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = asum(e)
    return F.transform(e, lambda x: x / s)


def log_softmax(a: Column) -> Column:
    m = F.array_max(a)
    lse = m + F.log(asum(F.transform(a, lambda x: F.exp(x - m))))
    return F.transform(a, lambda x: x - lse)


def argmax(a: Column) -> Column:
    """0-based index of the maximum, first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normalize_target(t: Column) -> Column:
    """t / sum(t); the unclear sentinel [-1,-1,-1] becomes [⅓,⅓,⅓]."""
    s = asum(t)
    return F.transform(t, lambda x: x / s)


def xlogy(x: Column, y: Column) -> Column:
    """x·ln(y) with 0·ln(anything) = 0; NULL for a negative y (NaN in torch)."""
    return F.when(x == 0, F.lit(0.0)).when(y > 0, x * F.log(y))


def kl_row(logits: Column, target: Column) -> Column:
    """Σ t (ln t − log_softmax(p)) for one row, target renormalised."""
    t = normalize_target(target)
    lp = log_softmax(logits)
    terms = F.zip_with(t, lp, lambda ti, li: xlogy(ti, ti) - ti * li)
    return asum(terms)


def kl_row_clamped(logits: Column, target: Column, eps: float = 1e-12) -> Column:
    """Per-member variant: targets renormalised with a clamped sum, logs of
    clamped targets."""
    s = F.greatest(asum(target), F.lit(eps))
    t = F.transform(target, lambda x: x / s)
    lp = log_softmax(logits)
    return asum(F.zip_with(t, lp, lambda ti, li: ti * (F.log(F.greatest(ti, F.lit(eps))) - li)))


def squared_error_sum(logits: Column, target: Column) -> Column:
    p = softmax(logits)
    return asum(F.zip_with(p, target, lambda a, b: (a - b) * (a - b)))


def pad_to(a: Column, width: Column, fill=0) -> Column:
    """Right-pad ``a`` with ``fill`` to ``width`` (no-op when longer)."""
    k = F.greatest(width - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(fill).cast(a_type_hint(fill)), k))


def a_type_hint(fill) -> str:
    return "double" if isinstance(fill, float) else "int"


def mask_of(a: Column, width: Column) -> Column:
    """1 for real positions, 0 for padding."""
    ones = F.array_repeat(F.lit(1), F.size(a))
    return F.concat(ones, F.array_repeat(F.lit(0), F.greatest(width - F.size(a), F.lit(0))))
