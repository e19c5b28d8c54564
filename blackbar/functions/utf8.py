"""Strict UTF-8 checks on BINARY columns, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex of a well-formed UTF-8 sequence that lacks its last byte or bytes
# (Unicode table 3-7: no overlong forms, no surrogates, nothing above U+10FFFF).
TRUNCATED = (
    "C[2-9A-F]"
    "|D."
    "|E0(?:[AB].)?"
    "|E[1-9A-CEF](?:[89AB].)?"
    "|ED(?:[89].)?"
    "|F0(?:[9AB].(?:[89AB].)?)?"
    "|F[1-3](?:[89AB].(?:[89AB].)?)?"
    "|F4(?:8.(?:[89AB].)?)?"
)
_TAIL = f"^(?:..){{0,2}}?({TRUNCATED})$"


def well_formed(binary: Column) -> Column:
    return F.is_valid_utf8(binary.cast("string"))


def truncated_tail(binary: Column) -> Column:
    """Bytes (0-3) of a cut-off last character; says nothing about what comes before."""
    tail = F.hex(F.substring(binary, -3, 3))
    return (F.length(F.regexp_extract(tail, _TAIL, 1)) / 2).cast("int")


def without_tail(binary: Column, dropped: Column) -> Column:
    return binary.substr(F.lit(1), F.octet_length(binary) - dropped)


def utf8_state(binary: Column) -> Column:
    """'valid', 'incomplete' (only a cut-off last character is missing bytes) or 'invalid'."""
    tail = truncated_tail(binary)
    return (
        F.when(well_formed(binary), "valid")
        .when((tail > 0) & well_formed(without_tail(binary, tail)), "incomplete")
        .otherwise(F.when(binary.isNotNull(), "invalid"))
    )
