"""Option symbols: [O:]ROOT + yymmdd + C|P + strike in thousandths, eight digits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = r"^(?:O:)?([A-Z]+)([0-9]{6})([CP])([0-9]{8})$"


def parse_symbol(symbol: Column) -> dict[str, Column]:
    """Columns underlying, expiry, cp_flag and strike; all null where the symbol doesn't parse."""
    part = lambda k: F.nullif(F.regexp_extract(symbol, FULL, k), F.lit(""))
    expiry = F.try_to_date(part(2), "yyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(part(2), F.lit("yyMMdd")))
    return {"underlying": part(1), "expiry": expiry, "cp_flag": part(3), "strike": part(4).cast("long") / F.lit(1000.0)}


def quote_pattern(roots: Iterable[str]) -> str:
    """The pattern of quote symbols of these roots; what follows the right isn't looked at."""
    return "^O:(" + "|".join(roots) + ")[0-9]{6}[CP]"


def of_roots(symbol: Column, roots: Iterable[str]) -> Column:
    return symbol.rlike(quote_pattern(roots))
