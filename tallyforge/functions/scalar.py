"""Element-wise functions on double columns; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    """max(0, x); NaN gives 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(x, F.lit(0.0)))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    """x above 0, else slope * x; NaN stays."""
    return F.when(x <= 0, x * slope).otherwise(x)


def leaky_relu_split(x: Column, slope: float = 0.01) -> Column:
    """The same from two clamps; NaN gives 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(x, F.lit(0.0)) + F.least(x, F.lit(0.0)) * slope)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    """min(max(x, low), high); NaN gives low."""
    return F.when(F.isnan(x), F.least(F.lit(float(low)), F.lit(float(high)))).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


# Cody's rational approximations of the error function (Mathematics of Computation 23, 1969), each numerator
# and denominator in the order of Horner's rule.
_ERF_TOP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_LOW = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC_TOP = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_ERFC_LOW = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_FAR_TOP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_FAR_LOW = (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_ROOT_PI = 0.5641895835477562869  # 1 / sqrt(pi)


def _horner(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def erf(x: Column) -> Column:
    """The error function to about 1e-15, in plain arithmetic; null and NaN stay."""
    y, z = F.abs(x), x * x
    middle = F.exp(-z) * _horner(y, _ERFC_TOP) / _horner(y, _ERFC_LOW)
    far = F.exp(-z) * (F.lit(_ROOT_PI) - _horner(1.0 / z, _FAR_TOP) / _horner(1.0 / z, _FAR_LOW) / z) / y
    beyond = F.when(y <= 4.0, middle).when(y <= 6.0, far).otherwise(0.0)
    return F.when(F.isnan(x) | x.isNull(), x).when(y <= 0.46875, x * _horner(z, _ERF_TOP) / _horner(z, _ERF_LOW)).otherwise(F.signum(x) * (F.lit(1.0) - beyond))


def gelu(x: Column) -> Column:
    return x * 0.5 * (F.lit(1.0) + erf(x * 0.7071067811865476))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    # The luma weights.
    return r * 0.299 + g * 0.587 + b * 0.114


def ceil_div(a: Column, b: Column) -> Column:
    """Ceiling of a / b for positive whole numbers."""
    return F.floor((a + b - 1) / b).cast("long")


def next_pow2(n: Column) -> Column:
    """The smallest power of two >= n, for n from 1 to 2^62."""
    digits = F.length(F.bin(n.cast("long") - 1))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), digits))


def float_order_key(x: Column) -> Column:
    """An unsigned 32-bit number, as a long, in the order of the single-precision value."""
    bits = F.java_method(F.lit("java.lang.Float"), F.lit("floatToIntBits"), x.cast("float")).cast("int").cast("long")
    return F.when(bits < 0, F.bitwise_not(bits).bitwiseAND(0xFFFFFFFF)).otherwise(bits + F.lit(2147483648).cast("long"))
