"""Losses and pooling as columns over arrays (survey L)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import dot, mean_of, ratio, std_of, sum_of
from .spectral import centred


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of equal length."""
    return ratio(ratio(dot(centred(a), centred(b)), F.size(a).cast("double")), std_of(a) * std_of(b))


def mse(a: Column, b: Column) -> Column:
    return mean_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _magnitudes(bins: Column) -> Column:
    return F.transform(bins, lambda b: F.sqrt(b.power))


def _shares(bins: Column) -> Column:
    m = _magnitudes(bins)
    return F.get(F.transform(F.array(F.array_max(m)), lambda high: F.transform(m, lambda v: v / (high + 1e-9))), F.lit(0))


def spectral_loss(p: Column, y: Column) -> Column:
    """Mean distance of two spectra's magnitudes as shares of their largest ones (bins of spectral.spectrum from 0 up)."""
    return mean_of(F.zip_with(_shares(p), _shares(y), lambda a, b: F.abs(a - b)))


def frequency_loss(p: Column, y: Column, low: float = 0.833, high: float = 3.0, outside: float = 0.1) -> Column:
    """Mean distance of magnitudes in the cardiac band, and `outside` of that beyond it."""
    apart = F.zip_with(p, y, lambda a, b: F.struct(a.hz.alias("hz"), F.abs(F.sqrt(a.power) - F.sqrt(b.power)).alias("d")))
    mean_where = lambda keep: mean_of(F.transform(F.filter(apart, keep), lambda x: x.d))
    return mean_where(lambda x: x.hz.between(low, high)) + outside * mean_where(lambda x: ~x.hz.between(low, high))


def waveform_loss(p: Column, y: Column, p_bins: Column, y_bins: Column, by_correlation: float = 0.5, by_spectrum: float = 0.3) -> Column:
    """Squared error, correlation and spectrum together."""
    return mse(p, y) + by_correlation * (1 - correlation(p, y)) + by_spectrum * spectral_loss(p_bins, y_bins)


def bce(p: Column, y: Column, tiny: float = 1e-7) -> Column:
    """Binary cross-entropy of a probability held to tiny..1 - tiny."""
    p = F.greatest(F.lit(tiny), F.least(F.lit(1 - tiny), p))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pooled(x: Column, padded: Column, kind: str, scores: Column | None = None) -> Column:
    """X pooled over steps that aren't padded: mean, max, last, or softmax of scores (attention)."""
    kept = F.transform(F.filter(F.arrays_zip(x.alias("v"), padded.alias("p"), (scores if scores is not None else x).alias("s")), lambda z: ~z.p), lambda z: z)
    values = F.transform(kept, lambda z: z.v)
    if kind == "max":
        return F.array_max(values)
    if kind == "last":
        return F.element_at(values, -1)
    if kind == "mean":
        return mean_of(values)
    return ratio(sum_of(F.transform(kept, lambda z: F.exp(z.s) * z.v)), sum_of(F.transform(kept, lambda z: F.exp(z.s))))


def to_rate(z: Column, low: float = 40.0, high: float = 200.0) -> Column:
    """A logit to a rate in low..high."""
    return low + (high - low) / (1 + F.exp(-z))


def mean_of_available(loss: Column, available: Column) -> Column:
    """L2, as an aggregate: a batch's mean loss over the rows whose label is available, 0 where none is."""
    return F.coalesce(F.avg(F.when(available, loss)), F.lit(0.0))


def confidence_loss(confidence: Column, error: Column, available: Column, exact: float = 0.1, by_spread: float = 0.1) -> Column:
    """L2, as an aggregate: cross-entropy of confidences against whether the rate was right, and a little of their variance."""
    right = F.when(error < exact, 1.0).otherwise(0.0)
    return mean_of_available(bce(confidence, right), available) + by_spread * F.coalesce(F.var_samp(F.when(available, confidence)), F.lit(0.0))


def focal_loss(p: Column, y: Column, least: Column, most: Column, available: Column, gamma: float = 2.0) -> Column:
    """L2, as an aggregate: squared errors weighed by how far below the batch's largest target each target is; 0 where targets don't vary."""
    weight = F.when(most > least, F.pow(1 - (y - least) / F.nullif(most - least, F.lit(0.0)), F.lit(gamma))).otherwise(0.0)
    return mean_of_available(weight * (p - y) * (p - y), available)


def masked_mse(p: Column, y: Column, mask: Column) -> Column:
    """L3, as an aggregate over arrays: squared error of the masked steps, by their number."""
    errors = F.zip_with(F.zip_with(p, y, lambda a, b: (a - b) * (a - b)), mask, lambda e, m: F.when(m, e).otherwise(0.0))
    return F.sum(sum_of(errors)) / (F.sum(F.size(F.filter(mask, lambda m: m))) + 1e-9)


def spread_loss(x: Column, weight: float = 0.1) -> Column:
    """L3, as an aggregate: the negative mean deviation (n - 1) of representations: collapsed ones cost."""
    n = F.size(x)
    return -weight * F.avg(std_of(x) * F.sqrt(n / (n - 1)))


def agreement_loss(online: Column, target: Column) -> Column:
    """L3 (BYOL), as an aggregate: 2 less twice the mean cosine of two views."""
    return 2 - 2 * F.avg(cosine(online, target))
