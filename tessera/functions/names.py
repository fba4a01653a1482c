"""Formatting: fixed-point numbers, output file names, result lines.

``format_string('%.1f')`` rounds half-up on a decimal rendering, while the
documents we reproduce round the *exact binary value* half-to-even (so 0.25
gives 0.2 and 0.15 gives 0.1).  ``fixed`` reproduces that exactly with
integer arithmetic on the double's mantissa, natively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv

TWO52 = float(2 ** 52)
TWO53 = float(2 ** 53)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _exponent(a: Column) -> Column:
    """Binary exponent e with 2^e <= a < 2^(e+1) for a > 0 (log2 corrected)."""
    e0 = F.floor(F.log2(a)).cast("int")
    m0 = a * F.pow(F.lit(2.0), (F.lit(52) - e0).cast("double"))
    return (F.when(m0 >= F.lit(TWO53), e0 + 1).when(m0 < F.lit(TWO52), e0 - 1).otherwise(e0))


def fixed(x: Column | str, digits: int = 1) -> Column:
    """``f"{x:.<digits>f}"`` for finite doubles, digits 0..3, exactly as Python."""
    if not 0 <= digits <= 3:
        raise ValueError("digits must be within 0..3")
    x = _col(x).cast("double")
    scale = 10 ** digits
    a = F.abs(x)
    e = _exponent(a)
    q = F.lit(52) - e                                    # a = m / 2^q exactly
    m = (a * F.pow(F.lit(2.0), q.cast("double"))).cast("bigint")
    big = m * F.lit(scale)                               # < 2^63 for digits <= 3
    fl = F.call_function("shiftright", big, q)
    rem = big - F.call_function("shiftleft", fl, q)
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), q - 1)
    up = (rem > half) | ((rem == half) & (fl % 2 == 1))
    frac_rounded = fl + F.when(up, 1).otherwise(0)
    rounded = (F.when(a == 0, F.lit(0).cast("bigint"))
               .when(q <= 0, (a * scale).cast("bigint"))
               .when(q >= 64, F.lit(0).cast("bigint"))       # a < 2^-11: rounds to 0
               .otherwise(frac_rounded))
    int_part = (rounded / F.lit(scale)).cast("bigint") if digits else rounded
    body = int_part.cast("string")
    if digits:
        frac = F.lpad((rounded % F.lit(scale)).cast("string"), digits, "0")
        body = F.concat(body, F.lit("."), frac)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(x.isNull(), F.lit(None))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(F.concat(sign, body)))


def transcript_file_name(ts: Column | str, url: Column | str, ordinal: Column | str) -> Column:
    """``transcript_<ts>_<8 hex of md5(url)>.md``, or ``_<ordinal:03d>`` without a URL.

    A stable md5 replaces the per-process salted hash, so a name is
    reproducible across runs and executors.
    """
    u = _col(url)
    tail = F.when(F.coalesce(u, F.lit("")) != F.lit(""), F.substring(F.md5(u), 1, 8)) \
        .otherwise(F.format_string("%03d", _col(ordinal)))
    return F.concat(F.lit("transcript_"), _col(ts), F.lit("_"), tail, F.lit(".md"))


def run_timestamp() -> Column:
    """One wall-clock stamp per batch: ``yyyyMMdd_HHmmss``."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def result_lines(rank: Column | str, score: Column | str, text: Column | str,
                 start_time: Column | str, end_time: Column | str, source_file: Column | str,
                 preview: int = 300) -> Column:
    """the printed block of one search result.

    The time line appears only when the start time is truthy (not null, not 0).
    """
    st = _col(start_time)
    head = F.concat(F.lit(fv.REPORT_RESULT), _col(rank).cast("string"), F.lit(fv.REPORT_SCORE),
                    fixed(score, 3), F.lit(fv.REPORT_END))
    body = F.concat(F.lit(fv.REPORT_TEXT), F.substring(_col(text), 1, preview), F.lit("..."))
    time_line = F.when(F.coalesce(st, F.lit(0.0)) != F.lit(0.0), F.concat(
        F.lit(fv.REPORT_TIME), fixed(st, 1), F.lit("s - "), fixed(end_time, 1), F.lit("s")))
    src = F.concat(F.lit(fv.REPORT_SOURCE), F.coalesce(_col(source_file).cast("string"), F.lit("None")))
    return F.concat_ws("\n", head, body, time_line, src)
