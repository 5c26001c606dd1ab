"""Numeric expressions used by scaling, scoring and output."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Fixed value: log(1 / sqrt(2 pi)) as the six digit constant that all scores share.
LOG_INV_SQRT_2PI = -0.918938
MAD_SCALE = 1.4826


def log_normal_pdf(x: Column, mean: Column, stdv: Column) -> Column:
    a = (x - mean) / stdv
    return F.lit(LOG_INV_SQRT_2PI) - F.log(stdv) - F.lit(0.5) * a * a


def match_log_prob(level: Column, level_mean: Column, level_stdv: Column,
                   shift: Column, scale: Column, var: Column) -> Column:
    """Score of an event against a k-mer of the model brought to the scale of the read."""
    return log_normal_pdf(level, scale * level_mean + shift, level_stdv * var)


def z_score(level: Column, level_mean: Column, level_stdv: Column,
            shift: Column, scale: Column, var: Column) -> Column:
    return (level - (scale * level_mean + shift)) / (level_stdv * var)


def scaled_level(level: Column, shift: Column, scale: Column) -> Column:
    return (level - shift) / scale


def standardized_level(level: Column, model_mean: Column, model_stdv: Column,
                       var: Column) -> Column:
    """The spread is divided by sqrt(var) on top of a model_stdv that may already carry var."""
    return (level - model_mean) / (F.sqrt(var) * model_stdv)


def scaled_samples(samples: Column, shift: Column, scale: Column) -> Column:
    return F.transform(samples, lambda s: (s - shift) / scale)


def to_picoamps(raw: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    """ADC counts to current, computed in single precision."""
    unit = (range_.cast("float") / digitisation.cast("float")).cast("float")
    off = offset.cast("float")
    return F.transform(raw, lambda x: (((x.cast("float") + off).cast("float")) * unit).cast("float"))


def sorted_median(values: Column) -> Column:
    """Order statistic n/2 of an array already sorted: the upper median, never an average."""
    return F.element_at(values, (F.size(values) / 2).cast("int") + 1)


def sorted_quantile(values: Column, p: float) -> Column:
    """Linear interpolation between order statistics of a sorted array."""
    at = F.lit(float(p)) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    rem = at - low
    upper = F.least(low + 2, F.size(values))
    return (1 - rem) * F.element_at(values, low + 1) + rem * F.element_at(values, upper)


def mad(sorted_values: Column) -> Column:
    """Median absolute deviation on the normal scale; zero for a single value."""
    med = sorted_median(sorted_values)
    dev = F.array_sort(F.transform(sorted_values, lambda x: F.abs(x - med)))
    return F.when(F.size(sorted_values) == 1, F.lit(0.0)).otherwise(
        sorted_median(dev) * F.lit(MAD_SCALE))


def fixed(x: Column, digits: int) -> Column:
    """printf("%.Nf") text: rounds the exact binary value, ties to even, without grouping.

    Java's formatters round the shortest decimal that names the value, which differs for numbers
    like 0.0025. Here the distance to the tie between two candidates is computed without error:
    a double splits into a single precision part and a rest, and both products are exact.
    """
    x = x.cast("double")
    scale = 10 ** digits
    size = F.abs(x)
    low = F.floor(size * scale)
    part = size.cast("float").cast("double")
    beyond_tie = (part * (2 * scale) - (2 * low + 1)) + (size - part) * (2 * scale)
    # each part is named as seldom as can be: branches repeat what they name, and large code is not compiled
    n = low + F.when(F.signum(beyond_tie) * 2 + low % 2 > 0, 1).otherwise(0)
    if digits == 0:
        text = n.cast("string")
    elif digits <= 6:   # a decimal of more places may be written with an exponent
        text = (n.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    else:
        text = F.concat(((n - n % scale) / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text)))


def general(x: Column) -> Column:
    """printf("%g") text: six significant digits, trailing zeros cut off, exponents below -4 and from 6 on."""
    x = x.cast("double")
    size = F.abs(x)
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    text = F.when(x == 0, F.lit("0"))
    for exponent in range(-4, 6):
        text = text.when((size >= 10.0 ** exponent) & (size < (999999.5 if exponent == 5 else 10.0 ** (exponent + 1))),
                         bare(fixed(x, 5 - exponent)))
    special = F.isnan(x) | (size == float("inf"))
    return F.when(special, fixed(x, 0)).otherwise(text.otherwise(bare(F.format_string("%.5e", x))))
