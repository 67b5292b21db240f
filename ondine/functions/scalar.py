"""Column functions on levels, rounding, time and text; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def db_from_linear(x: Column) -> Column:
    """20 log10 of a level; minus infinity where it is not finite or not positive."""
    return F.when(finite(x) & (x > 0), 20 * F.log10(x)).otherwise(F.lit(-INF))


def lufs_from_power(p: Column) -> Column:
    """Loudness of a mean square summed over channels; minus infinity where there is none."""
    return F.when(p > 0, F.lit(-0.691) + 10 * F.log10(p)).when(p <= 0, F.lit(-INF))


def exact_avg(x: Column) -> Column:
    """Mean of the group's doubles from their exact sum, so that neither order nor partitions turn its last bits or its sign.

    A value is a whole number of 2 ** -32 and a rest in 2 ** -94; bits below that, which values under 2 ** -42 may have, are dropped.
    The sum's size must stay below 2 ** 32.
    """
    scaled = x * float(1 << 32)
    whole = F.floor(scaled)
    rest = F.floor((scaled - whole) * float(1 << 62))
    total = F.sum(whole.cast("decimal(19,0)")).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.sum(rest.cast("decimal(19,0)"))
    return total.cast("double") / float(1 << 94) / F.count(x)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def fixed(x: Column, digits: int) -> Column:
    """Text of a number with ``digits`` decimals, rounded by the exact value of the double; a value in the middle goes away from zero.

    The formatter takes exact values but sends middles to even digits. A double in the middle is an odd multiple of
    2 ** -(digits + 1), which scaling by a power of two shows without error; its decimal form is short, and exact.
    """
    scaled = F.abs(x) * float(1 << digits)
    middle = scaled - F.floor(scaled) == 0.5
    pattern = F.lit("0." + "0" * digits if digits else "0")
    return F.call_function("format_number", F.when(middle, F.round(x, digits)).otherwise(x), pattern)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def megabytes(x: Column) -> Column:
    return x / F.lit(1048576.0)


def next_power_of_2(n: Column) -> Column:
    """The least power of two that is not below n (1 for n < 2), exact for whole n up to 2**31."""
    bits = F.length(F.bin(F.greatest(n.cast("bigint"), F.lit(1)) - 1))
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")))


def is_power_of_2(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def amplitude_of_lufs(lufs: Column) -> Column:
    """Peak of a sine whose mean square gives this loudness."""
    return F.sqrt(F.lit(2.0)) * F.pow(F.lit(10.0), (lufs + 0.691) / 20)


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; negative values count as 0."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("bigint")
    h, m, rest = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(rest))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(rest)))


def time_text(seconds: Column) -> Column:
    """m:ss; a dash where there is no time."""
    s = F.floor(seconds).cast("bigint")
    return F.when(seconds.isNull(), F.lit("—")).otherwise(F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def iso_text(at: Column) -> Column:
    """A time in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", "-"))


def a_weight_db(f: Column) -> Column:
    """A-weighting in dB; -80 below 20 Hz."""
    q = f * f
    r = (12194.0**2 * q * q) / ((q + 20.6**2) * F.sqrt((q + 107.7**2) * (q + 737.9**2)) * (q + 12194.0**2))
    return F.when(f < 20, F.lit(-80.0)).otherwise(20 * F.log10(r) + 2.0)


def pitch_class(f: Column) -> Column:
    """0 (C) to 11 (B) of a frequency, against 440 Hz."""
    return F.pmod(half_up(12 * F.log2(f / 440.0) + 69), F.lit(12)).cast("int")


def rotated(a: Column, n: Column) -> Column:
    """Element i is the old element (i + n) modulo the size."""
    k = F.pmod(n, F.size(a))
    return F.concat(F.slice(a, k + 1, F.size(a) - k), F.slice(a, F.lit(1), k))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; 0 where a side doesn't vary."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: F.zip_with(x, y, lambda u, v: u * v)
    num = n * total(times(a, b)) - total(a) * total(b)
    den = F.sqrt((n * total(times(a, a)) - total(a) * total(a)) * (n * total(times(b, b)) - total(b) * total(b)))
    return F.when(den == 0, 0.0).otherwise(F.try_divide(num, den))


def at_share(values: Column, p: float) -> Column:
    """sorted[floor(n p)] of an array; null beyond the end or of nothing. For groups without a bound: operators/ranks."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * F.lit(p)).cast("int"))


def upper_median(values: Column) -> Column:
    """sorted[floor(n / 2)] of an array, 0 of nothing."""
    return F.coalesce(at_share(values, 0.5), F.lit(0.0))
