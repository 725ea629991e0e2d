"""Column expressions: vectors, poses, scales, colours and names. All stay inside Catalyst."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.params import SCALE_FACTORS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: list, b: list) -> Column:
    return sum((col(x) * col(y) for x, y in zip(a[1:], b[1:])), col(a[0]) * col(b[0]))


def norm(a: list) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: list) -> list[Column]:
    """a over its length; a length under 1e-12 counts as 1e-12."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return [col(x) / n for x in a]


def cross(a: list, b: list) -> list[Column]:
    a, b = [col(x) for x in a], [col(x) for x in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle_deg(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def rotation_angle_deg(trace: str | Column) -> Column:
    """Angle of the rotation with this matrix trace."""
    return angle_deg((col(trace) - 1) / 2)


def pair_scales(t: str | Column, res: str | Column) -> dict[str, Column]:
    """Each length scale: the larger of its multiples of thickness and resolution."""
    return {k: F.greatest(m * col(t), r * col(res)) for k, (m, r) in SCALE_FACTORS.items()}


def face_budget(area: str | Column, t: str | Column, target: int = 200_000, least: int = 50_000, per_t2: float = 600.0) -> Column:
    return F.least(F.greatest(per_t2 * col(area) / (col(t) * col(t)), F.lit(float(least))), F.lit(float(target)))


def voxel(p: str | Column, low: Column | float, size: Column | float) -> Column:
    return F.floor((col(p) - low) / size)


def pair_key(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def srgb_to_lab(r: str | Column, g: str | Column, b: str | Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of sRGB values in 0 to 255."""
    lin = []
    for c in (r, g, b):
        v = col(c) / 255.0
        lin.append(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))
    # sRGB to XYZ over the D65 white point, fixed values
    x = (0.4124564 * lin[0] + 0.3575761 * lin[1] + 0.1804375 * lin[2]) / 0.95047
    y = 0.2126729 * lin[0] + 0.7151522 * lin[1] + 0.0721750 * lin[2]
    z = (0.0193339 * lin[0] + 0.1191920 * lin[1] + 0.9503041 * lin[2]) / 1.08883
    f = [F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116) for v in (x, y, z)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def bin_index(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin; values outside go to the end bins."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((col(x) - low) / (high - low) * bins))).cast("int")


def delta_e(a: list, b: list) -> Column:
    """CIE76 difference of two L*a*b* colours."""
    return F.sqrt(sum(((col(x) - col(y)) ** 2 for x, y in zip(a[1:], b[1:])), (col(a[0]) - col(b[0])) ** 2))


def array_variation(a: str | Column, b: str | Column) -> Column:
    """Total variation of two histograms that are arrays of shares."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def file_stem(path: str | Column) -> Column:
    """The last part of a path or URL, without query, fragment and extension."""
    last = F.regexp_extract(F.regexp_replace(col(path), r"[?#].*$", ""), r"([^/]*)/*$", 1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def digits_label(name: str | Column) -> Column:
    """The last three digits of a name (all of them when there are fewer)."""
    return F.right(F.regexp_replace(col(name), r"\D", ""), F.lit(3))


def within(a: Column, low: float, high: float) -> Column:
    """False, not null, for null and NaN."""
    return F.coalesce(~F.isnan(a) & (a >= low) & (a <= high), F.lit(False))


def fixed(c: str | Column, digits: int) -> Column:
    """A number with so many digits behind the point (one at least), rounded from its exact binary value; NaN, inf and -inf. Null stays null."""
    x = col(c).cast("double")
    half = Decimal(5).scaleb(-digits - 1)
    # half a unit of the last digit is no binary number: the nearest one lies on either side of it
    up = (F.abs(x) >= float(half)) if Decimal(float(half)) > half else (F.abs(x) > float(half))
    # a number under the last digit is settled here, as the formatter takes its shortest decimal form for the number
    small = F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), F.lit("0." + "0" * (digits - 1)), F.when(up, "1").otherwise("0"))
    text = F.when(F.abs(x) < 10.0**-digits, small).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits)))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(text)
