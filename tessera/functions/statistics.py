"""Column expressions of population genetics and of normal statistics.  All stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five-term error function approximation of Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# The rational approximation of the inverse normal, Abramowitz and Stegun 26.2.23.
PROBIT_C = (2.515517, 0.802853, 0.010328)
PROBIT_D = (1.432788, 0.189269, 0.001308)


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def erf(x: Column) -> Column:
    z = F.abs(_d(x))
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(_d(x)) * (1 - poly * F.exp(-z * z))


def normal_cdf(x: Column) -> Column:
    return (1 + erf(_d(x) / F.sqrt(F.lit(2.0)))) * 0.5


def inverse_normal_cdf(p: Column) -> Column:
    """Infinite at 0 and 1."""
    p = _d(p)
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(F.when((tail > 0), tail)))
    c, d = PROBIT_C, PROBIT_D
    z = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).when(p < 0.5, -z).otherwise(z)


def chi_square_p(chi2: Column) -> Column:
    """One degree of freedom; 1 at or below 0, and a flat 0.001 from 10 on."""
    return F.when(chi2 <= 0, 1.0).when(chi2 >= 10, 0.001).otherwise(1 - erf(F.sqrt(chi2) / F.sqrt(F.lit(2.0))))


def allele_frequency(aa: Column, ab: Column, bb: Column) -> Column:
    """Of the first allele; a half without calls."""
    n = aa + ab + bb
    return F.coalesce(F.try_divide((2 * aa + ab).cast("double"), (2 * n).cast("double")), F.lit(0.5))


def hardy_weinberg_chi2(aa: Column, ab: Column, bb: Column) -> Column:
    """Terms without an expected count are skipped; 0 below two samples."""
    n = (aa + ab + bb).cast("double")
    p = allele_frequency(aa, ab, bb)
    terms = [(aa, p * p * n), (ab, 2 * p * (1 - p) * n), (bb, (1 - p) * (1 - p) * n)]
    total = sum((F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in terms), F.lit(0.0))
    return F.when(n < 2, 0.0).otherwise(total)


def hardy_weinberg_p(aa: Column, ab: Column, bb: Column) -> Column:
    return F.when(aa + ab + bb < 2, 1.0).otherwise(chi_square_p(hardy_weinberg_chi2(aa, ab, bb)))


def maf(af: Column) -> Column:
    return F.least(af, 1 - af)


def maf_bin(m: Column) -> Column:
    return F.when(m > 0.05, "common").when(m >= 0.01, "low").when(m >= 0.001, "rare").otherwise("very_rare")


def power(effect: Column, n: Column, alpha: Column) -> Column:
    """alpha where effect^2 n is below 1, else 1 - cdf(z - root), within 0 and 1."""
    shift = _d(effect) * _d(effect) * _d(n)
    z = inverse_normal_cdf(1 - _d(alpha) / 2)
    return F.when(shift < 1, _d(alpha)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - normal_cdf(z - F.sqrt(shift)))))


def min_sample_size(effect: Column, alpha: Column, power_: Column) -> Column:
    z = (inverse_normal_cdf(1 - _d(alpha) / 2) + inverse_normal_cdf(_d(power_))) / _d(effect)
    return F.greatest(F.lit(2), F.ceil(z * z)).cast("long")


def fixation_probability(s: Column, n: Column) -> Column:
    """Kimura: (1 - e^-2s) / (1 - e^-2Ns); 1 / 2N for |s| near 0; 0 and 1 where it saturates."""
    s, n = _d(s), _d(n)
    down, up = -2 * s, -2 * n * s
    value = (1 - F.exp(F.least(down, F.lit(700.0)))) / (1 - F.exp(F.least(up, F.lit(700.0))))
    return F.when(n <= 0, 0.0).when(F.abs(s) < 1e-9, 1 / (2 * n)).when(up > 700, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
