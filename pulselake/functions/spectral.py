"""Spectra of short array columns by higher-order functions; the bases are constants, so the plans stay in the JVM."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import dot, mean_of, sum_of

WINDOWS = {
    "hann": lambda i, n: 0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)),
    "hamming": lambda i, n: 0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)),
    "blackman": lambda i, n: 0.42 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) + 0.08 * math.cos(4 * math.pi * i / (n - 1)),
}


def table(values, kind: str) -> Column:
    """A constant array as one literal: read from JSON when the plan is optimised, so that no plan holds thousands of numbers as expressions."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def windowed(x: Column, n: int, kind: str = "hann") -> Column:
    """x (n values) times a symmetric window; unknown kinds are all ones."""
    shape = WINDOWS.get(kind.lower(), lambda i, n: 1.0)
    return F.zip_with(x, table([shape(i, n) for i in range(n)], "array<double>"), lambda a, b: a * b)


def centred(x: Column) -> Column:
    return F.get(F.transform(F.array(mean_of(x)), lambda m: F.transform(x, lambda v: v - m)), F.lit(0))


def spectrum(x: Column, n: int, fps: float, low: int, high: int) -> Column:
    """Array of (k, hz, re, im, power) for bins low..high of an array of n values."""
    turn = [[2 * math.pi * k * i / n for i in range(n)] for k in range(low, high + 1)]
    basis = [{"k": low + j, "hz": (low + j) * fps / n, "c": [math.cos(w) for w in t], "s": [-math.sin(w) for w in t]} for j, t in enumerate(turn)]
    bins = F.transform(table(basis, "array<struct<k:int,hz:double,c:array<double>,s:array<double>>>"), lambda b: F.struct(b.k.alias("k"), b.hz.alias("hz"), dot(x, b.c).alias("re"), dot(x, b.s).alias("im")))
    return F.transform(bins, lambda b: F.struct(b.k.alias("k"), b.hz.alias("hz"), b.re.alias("re"), b.im.alias("im"), (b.re * b.re + b.im * b.im).alias("power")))


def band_power(bins: Column, low: float, high: float) -> Column:
    """Sum of power over low <= hz <= high."""
    return sum_of(F.transform(F.filter(bins, lambda b: (b.hz >= low) & (b.hz <= high)), lambda b: b.power))


def peak(bins: Column) -> Column:
    """The bin of most power, of equal ones the lowest."""
    return F.array_max(F.transform(bins, lambda b: F.struct(b.power.alias("power"), (-b.k).alias("lower"), b.hz.alias("hz"))))


def is_harmonic(bins: Column, hz: Column, low: float = 0.7, share: float = 0.15) -> Column:
    """Whether a peak at hz belongs to another rate: its half or third (from `low` up) holds 0.6 of its power (0.4 above
    140 a minute), or its double or triple holds `share` of it. Powers are the highest within 0.1 Hz."""
    at = lambda f: F.array_max(F.transform(F.filter(bins, lambda b: (b.hz >= f - 0.1) & (b.hz <= f + 0.1)), lambda b: b.power))
    main, yes = at(hz), lambda c: F.coalesce(c, F.lit(False))
    below = F.when(hz * 60 > 140, 0.4).otherwise(0.6) * main
    return yes((hz / 2 >= low) & (at(hz / 2) > below)) | yes((hz / 3 >= low) & (at(hz / 3) > below)) | yes(at(2 * hz) > share * main) | yes(at(3 * hz) > share * main)


def resolved(bins: Column, hz: Column, before: Column, low: float = 50 / 60, high: float = 3.0) -> Column:
    """A peak at hz, or its half or double where that holds enough of its energy (magnitudes within 0.12 Hz, in low..high).

    The half needs 0.30 of it, 0.15 if the rate before was under 90 a minute and the peak is over 130. Else a peak under
    1.25 Hz gives way to its double with 0.40, 0.25 if the rate before was over 80 and the peak is under 60. before may be null.
    """
    band = F.filter(bins, lambda b: b.hz.between(low, high))
    energy = lambda f: sum_of(F.transform(F.filter(band, lambda b: b.hz.between(f - 0.12, f + 0.12)), lambda b: F.sqrt(b.power)))
    own, highest = energy(hz), F.array_max(F.transform(band, lambda b: b.hz))
    half = F.when((before < 90) & (hz * 60 > 130), 0.15).otherwise(0.30)
    double = F.when((before > 80) & (hz * 60 < 60), 0.25).otherwise(0.40)
    usable = (hz > 0) & (own >= 1e-12)
    return F.when(usable & (hz / 2 >= low) & (energy(hz / 2) >= half * own), hz / 2).when(usable & (hz < 1.25) & (2 * hz <= highest) & (energy(2 * hz) >= double * own), 2 * hz).otherwise(hz)
