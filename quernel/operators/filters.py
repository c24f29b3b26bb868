"""Filters on result rows, all joined by AND. They stand above the candidate limits: a filter never brings in further candidates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    date_from: str | None = None
    date_to: str | None = None
    tools: tuple[str, ...] = ()
    sentiment: str | None = None
    source: str | None = None
    subjectivity: str | None = None
    aspect: str | None = None


def parsed_day(text: str) -> date:
    """A day written yyyy-mm-dd; anything else is an error."""
    day = date.fromisoformat(text)
    if len(text) != 10 or day.isoformat() != text:
        raise ValueError(f"not a date of the form yyyy-mm-dd: {text}")
    return day


def has_aspect(part: str) -> Column:
    """Whether an aspect's name, polarity not included, holds the text, in any case."""
    return F.coalesce(F.exists("aspects", lambda a: F.contains(F.lower(F.substring_index(a, ":", 1)), F.lit(part.lower()))), F.lit(False))


def condition(f: Filters) -> Column:
    """Rows without a date pass date filters; rows without another filtered value don't pass. Tools are compared without spaces around; empty ones ask for nothing."""
    out = F.lit(True)
    if f.date_from:
        out &= F.col("date").isNull() | (F.col("date") >= F.lit(parsed_day(f.date_from)).cast("timestamp"))
    if f.date_to:
        out &= F.col("date").isNull() | (F.col("date") < F.lit(parsed_day(f.date_to) + timedelta(days=1)).cast("timestamp"))
    if f.tools:
        wanted = [t.strip() for t in f.tools if t]
        out &= F.coalesce(F.exists("tools", lambda t: F.trim(t).isin(*wanted)), F.lit(False)) if wanted else F.lit(False)
    for name in ("sentiment", "source", "subjectivity"):
        if value := getattr(f, name):
            out &= F.coalesce(F.col(name) == value, F.lit(False))
    if f.aspect:
        out &= has_aspect(f.aspect)
    return out


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    return rows.where(condition(f))


def validated(q: str, mode: str, page: int, page_size: int, least: float = 0.0, max_page_size: int = 100) -> str | None:
    """What is wrong with a search request, if anything."""
    if not q.strip():
        return "query is empty"
    if mode not in ("keyword", "semantic", "hybrid"):
        return f"unknown mode {mode}"
    if page < 1:
        return "page must be at least 1"
    if not 1 <= page_size <= max_page_size:
        return f"page size must be 1 to {max_page_size}"
    if not 0 <= least <= 1:
        return "similarity must be 0 to 1"
    return None
