"""Vector columns: arrays of numbers, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """``x`` rounded half up, away from zero; what becomes zero keeps its sign, as in SQL (``F.round`` drops it)."""
    r = F.round(x, places)
    return F.when(r == 0, x.cast("double") * 0.0).otherwise(r)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top_values(a: Column, k: int) -> Column:
    """The k largest, descending, nulls last."""
    return F.slice(F.sort_array(a, asc=False), 1, k)


def top_gather(by: Column, other: Column, k: int) -> Column:
    """Values of ``other`` at the places of the k largest of ``by`` (first place wins ties),
    padded with the last to k."""
    pairs = F.transform(by, lambda x, i: F.struct((-x).alias("d"), i.alias("i")))
    got = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.element_at(other, p["i"] + 1))
    return F.concat(got, F.array_repeat(F.try_element_at(got, F.lit(-1)), F.greatest(F.lit(0), F.lit(k) - F.size(got))))


def log_mean(a: Column, least: float = 1e-12) -> Column:
    """Mean of logarithms, small values lifted to ``least``."""
    return mean(F.transform(a, lambda x: F.log(F.greatest(x.cast("double"), F.lit(least)))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def zscore(a: Column, mu: Column, sigma: Column) -> Column:
    return F.zip_with(F.zip_with(a, mu, lambda x, m: x - m), sigma, lambda x, s: x / s)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probe(x: Column, mu: Column, sigma: Column, weights: Column, bias: Column) -> Column:
    """A stored linear probe's probability."""
    return logistic(dot(zscore(x, mu, sigma), weights) + bias)


def log_softmax_at(logits: Column, at: Column) -> Column:
    """Log probability of the logit at place ``at`` (from 0)."""
    top = F.array_max(logits).cast("double")
    return F.element_at(logits, at + 1).cast("double") - (top + F.log(total(F.transform(logits, lambda x: F.exp(x.cast("double") - top)))))


def length_normalised(sum_lp: Column, n: Column, alpha: float = 1.0) -> Column:
    return sum_lp / F.pow(F.greatest(n, F.lit(1)), F.lit(alpha))


def matrix_diagonal(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.element_at(F.element_at(m, i + 1), i + 1))


def laplacian_diagonal(m: Column, edge: float = 0.0) -> Column:
    """Column sums over causal out-degrees, less the self weights. A vertical ``edge`` to the layer
    below adds its weight to the sum and one to the degree; the first layer has none."""
    n = F.size(m)
    more = 1 if edge else 0
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: (total(F.transform(m, lambda r: F.element_at(r, j + 1))) + edge) / (n - j + more) - F.element_at(F.element_at(m, j + 1), j + 1))


def layer_laplacians(layers: Column, edge: float = 0.0) -> Column:
    """``laplacian_diagonal`` of a stack of matrices, vertical edges from the second on."""
    return F.transform(layers, lambda m, i: F.when(i == 0, laplacian_diagonal(m)).otherwise(laplacian_diagonal(m, edge)))


def mean_top(a: Column, k: int = 5) -> Column:
    """Mean of the k largest, of fewer where there are fewer."""
    return mean(top_values(a, k))


def answer_log_prob(logits: Column, targets: Column) -> Column:
    """Sum over positions of the log probability of each target (ids from 0)."""
    return total(F.zip_with(logits, targets, lambda row, t: log_softmax_at(row, t)))


def lens_scores(layers: Column, targets: Column, alpha: float = 1.0) -> Column:
    """By layer, the length-normalised log probability of the targets from that layer's logits."""
    return F.transform(layers, lambda logits: length_normalised(answer_log_prob(logits, targets), F.size(targets), alpha))


def widened(x: Column) -> Column:
    """Half-precision numbers, stored as their 16 bits, as floats; other arrays as floats."""

    def number(h: Column) -> Column:
        bits = h.cast("int").bitwiseAND(0xFFFF)
        sign = F.when(bits >= 0x8000, -1.0).otherwise(1.0)
        power, part = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023) / 1024.0
        whole = F.when(power == 0, part * 2.0**-14).when(power == 31, F.when(part == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + part) * F.pow(F.lit(2.0), power - 15))
        return (sign * whole).cast("float")

    return F.transform(x, number)


def k_grid(longest: Column, grid: tuple[int, ...] = (5, 10, 25, 50, 100)) -> Column:
    """The grid's values up to ``longest``, else ``longest`` alone."""
    fit = F.filter(F.array(*map(F.lit, grid)), lambda k: k <= longest)
    return F.when(F.size(fit) > 0, fit).otherwise(F.array(longest.cast("int")))


def peak_window(peak: Column, lo: int, hi: int, reach: int = 2) -> Column:
    return F.filter(F.sequence(peak - reach, peak + reach), lambda x: x.between(lo, hi))
