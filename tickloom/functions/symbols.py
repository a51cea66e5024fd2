"""Listing codes: canonical spelling, exchange and board, as plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of each board.
STAR = ("688", "689")
CHINEXT = ("300", "301", "302")
SZ_MAIN = ("000", "001", "002", "003", "004")
BSE_TWO = ("43", "83", "87", "88", "82", "89")


def code_of(value: Column) -> Column:
    """Six digits of any usual spelling: 600519, 600519.SH, sh600519, 600519.XSHG."""
    raw = F.replace(F.trim(value), F.lit("_"), F.lit("."))
    body = F.split_part(F.regexp_replace(raw, "^(?i)(sh|sz|bj)(?=[0-9]+$)", ""), F.lit("."), F.lit(1))
    padded = F.lpad(body, 6, "0")
    return F.when(padded.rlike("^[0-9]{6}$") & (F.length(body) <= 6), padded)


def board_of(code: Column) -> Column:
    p3, p2, p1 = F.substring(code, 1, 3), F.substring(code, 1, 2), F.substring(code, 1, 1)
    return (
        F.when(code.isNull(), None)
        .when(p3.isin(*STAR), "star")
        .when(p3 == "900", "sh_main")
        .when(p1 == "6", "sh_main")
        .when(p3.isin(*CHINEXT), "chinext")
        .when(p3 == "200", "sz_main")
        .when(p3.isin(*SZ_MAIN), "sz_main")
        .when((p3 == "920") | p2.isin(*BSE_TWO), "bse")
        .otherwise("other")
    )


def exchange_of(code: Column) -> Column:
    board = board_of(code)
    return (
        F.when(board.isin("star", "sh_main"), "SH")
        .when(board.isin("chinext", "sz_main"), "SZ")
        .when(board == "bse", "BJ")
        .when(board == "other", F.when(F.substring(code, 1, 1).isin("0", "1", "2", "3"), "SZ").otherwise("SH"))
    )


def canonical_symbol(value: Column) -> Column:
    """``<code>.<SH|SZ|BJ>``; NULL for text that is no code or whose suffix contradicts the code."""
    code = code_of(value)
    tail = F.upper(F.split_part(F.replace(F.trim(value), F.lit("_"), F.lit(".")), F.lit("."), F.lit(2)))
    lead = F.upper(F.regexp_extract(F.trim(value), "^(?i)(sh|sz|bj)[0-9]+$", 1))
    claim = F.when(tail.isin("SH", "XSHG"), "SH").when(tail.isin("SZ", "XSHE"), "SZ").when(tail.isin("BJ", "XBSE"), "BJ")
    claim = F.coalesce(claim, F.nullif(lead, F.lit("")))
    home = exchange_of(code)
    return F.when(claim.isNull() | (claim == home), F.concat(code, F.lit("."), home))
