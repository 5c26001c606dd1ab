"""Scalar text parsing shared by the file readers and the option parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The integer types of signal files with their inclusive bounds.
INTEGER_BOUNDS = {
    "int8_t": (-128, 127),
    "int16_t": (-32768, 32767),
    "int32_t": (-2147483648, 2147483647),
    "int64_t": (-9223372036854775808, 9223372036854775807),
    "uint8_t": (0, 255),
    "uint16_t": (0, 65535),
    "uint32_t": (0, 4294967295),
    "uint64_t": (0, 18446744073709551615),
}


def parse_count(text: str) -> int:
    """A count with an optional K, M or G suffix, e.g. ``2.5M``."""
    match = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)([kKmMgG]?)\s*", text)
    if not match:
        raise ValueError(f"not a count: {text!r}")
    factor = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[match.group(2).lower()]
    return int(float(match.group(1)) * factor + 0.499)


def parse_region(text: str) -> tuple[str, int, int]:
    """``contig:beg-end`` (1-based, inclusive) to a 0-based half-open interval."""
    match = re.fullmatch(r"(.+):([0-9,]+)-([0-9,]+)", text)
    if not match:
        return text, 0, 2**31 - 1
    beg, end = (int(g.replace(",", "")) for g in match.groups()[1:])
    return match.group(1), max(beg - 1, 0), end


def version_key(version: str) -> tuple[int, ...]:
    """Dotted version as a comparable tuple."""
    return tuple(int(part) for part in version.split("."))


def checked_integer(text: Column, type_name: str) -> Column:
    """Strict integer parse: plain digits within the bounds of the type, otherwise NULL."""
    low, high = INTEGER_BOUNDS[type_name]
    sign = "-?" if low < 0 else ""
    number = F.when(text.rlike(f"^{sign}[0-9]+$"), text.try_cast("decimal(20,0)"))
    return F.when(number.between(F.lit(low).cast("decimal(20,0)"),
                                 F.lit(high).cast("decimal(20,0)")), number)


def checked_float(text: Column) -> Column:
    """Strict floating point parse; NULL for the missing marker and for malformed text."""
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"),
                  text.try_cast("double"))
