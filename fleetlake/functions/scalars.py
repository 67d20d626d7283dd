"""Column functions (all JVM-side built-ins, no UDFs).

Each returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats the results must use.
DATETIME_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_TEXT_FORMAT = "yyyy-MM-dd"
ISO_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def datetime_text(c) -> Column:
    """K1: timestamp -> ``yyyy-MM-dd HH:mm:ss`` text (null stays null)."""
    return F.date_format(_col(c), DATETIME_TEXT_FORMAT)


def iso_json(c, options: dict | None = None) -> Column:
    """K2/K8: JSON text of a struct or map, datetimes as ISO text at any
    depth, null fields written as ``null``."""
    opts = {"timestampFormat": ISO_TIMESTAMP_FORMAT,
            "timestampNTZFormat": ISO_TIMESTAMP_FORMAT,
            "dateFormat": DATE_TEXT_FORMAT, "ignoreNullFields": "false"}
    opts.update(options or {})
    return F.to_json(_col(c), opts)


def first_forwarded(forwarded, peer) -> Column:
    """K5: first address of a forwarded list, trimmed; the peer address when
    the header is missing or empty (an empty first entry stays empty)."""
    fwd = _col(forwarded)
    first = F.trim(F.split(fwd, ",", 2).getItem(0))
    return F.when(fwd.isNull() | (fwd == F.lit("")), _col(peer)).otherwise(first)


def percent_value(c) -> Column:
    """``"55%"`` -> 55; text that is not a whole number -> null."""
    return F.rtrim(_col(c), F.lit("%")).try_cast("int")


def json_int(c, path: str) -> Column:
    """K9: an integer field of a JSON text column; null when absent or not a number."""
    return F.get_json_object(_col(c), path).try_cast("int")


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (negative when end is earlier)."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def narrow_decimal(c) -> Column:
    """K6: exact decimal -> double, the way the metric store keeps numbers."""
    return _col(c).cast("double")


def uuid_text(c) -> Column:
    """K7: a 16-byte identifier as its usual text; other bytes as hex."""
    h = F.lower(F.hex(_col(c)))
    parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(h) == 32, F.concat_ws("-", *parts)).otherwise(h)


def known_number(c) -> Column:
    """A measure's value, with NaN as missing: sums, counts, minima and maxima
    of a measure all leave NaN out."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)


def exact_sum(c, scale: int | None) -> Column:
    """``total`` as double."""
    return total(c, scale).cast("double")


def total(c, scale: int | None) -> Column:
    """Sum of a measure.  Declared to have ``scale`` decimals, it is summed as
    decimal, so every run and every partitioning gives the same bits; a value
    that has more decimals, or does not fit ``decimal(38, scale)``, raises
    instead of being rounded.  Without a scale (real-valued telemetry) it is a
    sum of doubles, whose last bits depend on the order."""
    x = known_number(c)
    if scale is None:
        return F.sum(x)
    exact = x.try_cast(f"decimal(38,{scale})")
    wrong = F.raise_error(F.concat(F.lit(f"value does not fit {scale} decimals: "), x.cast("string")))
    fits = exact.isNotNull() & (exact.cast("double") == x)
    return F.sum(F.when(x.isNull() | fits, exact).otherwise(wrong.cast(f"decimal(38,{scale})")))


def lower_camel(name: str) -> str:
    """``user_login_count`` -> ``userLoginCount``: the words between
    underscores are joined, each but the first with a capital; an underscore
    before anything but a letter stays, and the first letter is small."""
    first, *words = name.split("_")
    joined = first
    for word in words:
        joined += word[0].upper() + word[1:] if word[:1].isascii() and word[:1].isalpha() else "_" + word
    return joined[:1].lower() + joined[1:]


def seconds_exact(start, end) -> Column:
    """Elapsed seconds with microseconds, as double (``end - start``)."""
    s = _col(start).cast("timestamp")
    e = _col(end).cast("timestamp")
    return (F.unix_micros(e) - F.unix_micros(s)) / F.lit(1e6)
