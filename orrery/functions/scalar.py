"""Scalar helpers: division, shifts, strings by characters, temporal parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import CapExceeded, SqlError, Unsupported

WIDTH = {"int": 32, "bigint": 64}
#: Most characters of a padded string.
PAD_CAP = 1 << 20
#: Format elements of CAST(.. FORMAT ..) and Spark's letters for them.
FORMAT_ELEMENTS = {"YYYY": "yyyy", "HH24": "HH", "MM": "MM", "DD": "dd", "HH": "HH", "MI": "mm", "SS": "ss"}


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Integers: truncated, NULL at zero. Floats: IEEE, with infinities and NaN at zero."""
    if integers:
        return F.call_function("div", a, F.nullif(b, F.lit(0)))
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, F.when(a.isNotNull(), at_zero)).otherwise(a / F.nullif(b, F.lit(0.0)))


def modulo(a: Column, b: Column) -> Column:
    """Sign of the dividend; NULL at zero."""
    return a % F.nullif(b, F.lit(0))


def wrapping(op: str, a: Column, b: Column, kind: str = "bigint") -> Column:
    """``+``, ``-`` or ``*`` of integers in two's complement of the kind's width, without overflow errors."""
    wide = lambda x: x.cast("decimal(19,0)")
    made = {"+": lambda: wide(a) + wide(b), "-": lambda: wide(a) - wide(b), "*": lambda: wide(a) * wide(b)}
    if op not in made:
        raise SqlError(f"no operator {op!r}")
    span, half = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (WIDTH[kind], WIDTH[kind] - 1))
    rest = made[op]().cast("decimal(38,0)") % span
    return F.when(rest >= half, rest - span).when(rest < -half, rest + span).otherwise(rest).cast(kind)


def concat_ws(separator: str, *texts: Column) -> Column:
    """Texts joined by the separator; null ones are left out."""
    return F.concat_ws(separator, *texts)


def decimal_divide(a: Column, b: Column, precision: int, scale: int) -> Column:
    """A quotient truncated to the scale; NULL at zero."""
    wide = a.cast("decimal(38,12)") / F.nullif(b.cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))
    factor = F.lit(10**scale).cast("decimal(38,0)")
    return (F.when(wide < 0, F.ceil(wide * factor)).otherwise(F.floor(wide * factor)) / factor).cast(f"decimal({precision},{scale})")


def shift_left(a: Column, n: Column, kind: str = "bigint") -> Column:
    return F.when((n < 0) | (n >= WIDTH[kind]), F.when(a.isNotNull(), F.lit(0).cast(kind))).otherwise(F.call_function("shiftleft", a, n.cast("int")))


def shift_right(a: Column, n: Column, kind: str = "bigint") -> Column:
    fill = F.when(a < 0, F.lit(-1)).when(a >= 0, F.lit(0)).cast(kind)
    return F.when((n < 0) | (n >= WIDTH[kind]), fill).otherwise(F.call_function("shiftright", a, n.cast("int")))


def like(text: Column, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """Without an escape character every backslash of the pattern stands for itself."""
    if escape is not None and len(escape) != 1:
        raise SqlError("ESCAPE takes one character")
    name = "ilike" if ignore_case else "like"
    if escape is None:
        return F.call_function(name, text, F.lit(pattern.replace("\\", "\\\\")))
    return F.call_function(name, text, F.lit(pattern), F.lit(escape))


def length(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def octet_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def substring(text: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """The window [start, start + count) clipped at the first character."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(text, first, F.lit(2**31 - 1))
    count = F.lit(count) if isinstance(count, int) else count
    return F.substring(text, first, F.greatest(start + count - first, F.lit(0)))


def left(text: Column, n: int) -> Column:
    """The first n characters; a negative n leaves out the last -n."""
    return F.substring(text, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.char_length(text) + n, F.lit(0)))


def right(text: Column, n: int) -> Column:
    """The last n characters; a negative n leaves out the first -n."""
    if n >= 0:
        return F.substring(text, F.greatest(F.char_length(text) - n + 1, F.lit(1)), F.lit(n))
    return F.substring(text, F.lit(1 - n), F.lit(2**31 - 1))


def trim(text: Column, side: str = "both", characters: str | None = None) -> Column:
    """Unicode white space by default."""
    inner = r"\s" if characters is None else "[" + "".join("\\" + c if not c.isalnum() else c for c in characters) + "]"
    parts = {"leading": f"^{inner}+", "trailing": f"{inner}+$", "both": f"^{inner}+|{inner}+$"}
    if side not in parts:
        raise SqlError(f"no side {side!r}")
    return F.regexp_replace(text, "(?U)" + parts[side], "") if characters != "" else text


def position(needle: Column, text: Column) -> Column:
    """From 1; 0 if absent; 1 for an empty needle."""
    return F.call_function("locate", needle, text).cast("bigint")


def _pad(name: str, text: Column, n: int, fill: str) -> Column:
    if n > PAD_CAP:
        raise CapExceeded(f"padding to {n} characters; at most {PAD_CAP}")
    return F.call_function(name, text, F.lit(n), F.lit(fill))


def lpad(text: Column, n: int, fill: str = " ") -> Column:
    return _pad("lpad", text, n, fill)


def rpad(text: Column, n: int, fill: str = " ") -> Column:
    return _pad("rpad", text, n, fill)


def initcap(text: Column) -> Column:
    """The first letter of every run of letters and digits in upper case, the others in lower."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.lit(2**31 - 1))))
    return F.array_join(F.transform(runs, word), "")


def safe_cast(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def cast_format(value: Column, kind: str, pattern: str, source: str) -> Column:
    """CAST(value AS kind FORMAT pattern), from ``source`` 'string' or a temporal type; text that doesn't fit is an error."""
    out, rest = "", pattern
    while rest:
        element = next((e for e in FORMAT_ELEMENTS if rest.upper().startswith(e)), None)
        if element is None and rest[0] not in "-/: ":
            raise SqlError(f"no format element at {rest!r}")
        out += FORMAT_ELEMENTS[element] if element else rest[0]
        rest = rest[len(element) if element else 1 :]
    if source != "string":
        return F.date_format(value, out)
    if kind == "date":
        return F.to_date(F.trim(value), out)
    return F.to_timestamp(F.trim(value), out).cast("timestamp_ntz")


def extract(part: str, when: Column) -> Column:
    names = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    if part.lower() not in names:
        raise Unsupported(f"EXTRACT({part})")
    return names[part.lower()](when).cast("bigint")


def date_trunc(part: str, when: Column, kind: str = "timestamp_ntz") -> Column:
    """Type kept: dates stay dates, naive timestamps naive."""
    return F.trunc(when, part) if kind == "date" else F.date_trunc(part, when).cast(kind)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def ticks_between(a: Column, b: Column) -> Column:
    """Microseconds from b to a."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def add_days(when: Column, n: int) -> Column:
    return F.date_add(when, n)
