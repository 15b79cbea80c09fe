"""Predicates: filter dictionaries, date windows, and which messages take part in chunking."""

from __future__ import annotations

import datetime
import functools
import operator
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a message as a hook's or a system tool's. Signs that name a product are the caller's.
HOOK_EVENTS = ["pretooluse", "posttooluse", "notification", "stop", "subagentstop"]
HOOK_SIGNS = ["hook:", "hooks.json"]
SYSTEM_SIGNS = ["pretooluse:", "posttooluse:", "completed successfully:", "tool use:", "system:"]

RANGES = {"gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt}


def predicate(column: str, value: Any) -> Column:
    """A dict is a range, a list is membership, a project name a part in any case, all else equality."""
    c = F.col(column)
    if isinstance(value, dict):
        return functools.reduce(operator.and_, [RANGES[k](c, F.lit(v)) for k, v in value.items() if k in RANGES], F.lit(True))
    if isinstance(value, (list, tuple, set)):
        return c.isin(list(value))
    if column == "project_name" and isinstance(value, str):
        return F.contains(F.lower(c), F.lower(F.lit(value)))
    return c == F.lit(value)


def matching(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Rows for which all filters hold; a key that is no column is ignored."""
    for k, v in (filters or {}).items():
        if k in df.columns:
            df = df.where(predicate(k, v))
    return df


def _is_day(day: str) -> bool:
    try:
        datetime.date.fromisoformat(day)
    except ValueError:
        return False
    return True


def date_window(after: str | None = None, before: str | None = None) -> dict[str, Any]:
    """A range over whole days (YYYY-MM-DD) for the column ts; both ends belong to it."""
    for day in (after, before):
        if day and not (re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and _is_day(day)):
            raise ValueError(f"invalid date: {day}; use YYYY-MM-DD")
    out: dict[str, Any] = {}
    if after:
        out["gte"] = after
    if before and before < "9999-12-31":
        out["lt"] = (datetime.date.fromisoformat(before) + datetime.timedelta(1)).isoformat()
    return {"ts": out} if out else {}


def search_filters(project: str | None = None, has_code: bool = False, session: str | None = None, after: str | None = None, before: str | None = None) -> dict[str, Any]:
    """The filter dictionary of a search; has_code can ask for code, never for its absence."""
    out: dict[str, Any] = date_window(after, before)
    if project:
        out["project_name"] = project
    if has_code:
        out["has_code"] = True
    if session:
        out["session_id"] = session
    return out


def chunkable(messages: DataFrame, signs: list[str] = ()) -> DataFrame:
    """Messages of a known role that no hook or system tool wrote."""
    low = F.lower("content")
    marks = [*HOOK_EVENTS, *HOOK_SIGNS, *SYSTEM_SIGNS, *signs]
    return messages.where((F.col("role") != "unknown") & ~functools.reduce(operator.or_, [low.contains(m) for m in marks]))
