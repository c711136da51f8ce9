"""Scalar functions on routes, paths and code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def merge_route(prefix: str | Column, route: str | Column, lead: bool = False) -> Column:
    """prefix and route with exactly one slash between; lead adds one in front."""
    p, r = F.coalesce(_c(prefix), F.lit("")), F.coalesce(_c(route), F.lit(""))
    joined = F.when(p == "", r).when(r == "", p).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"), F.regexp_replace(r, "^/+", "")))
    return F.when(F.lit(lead) & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


_PARAM = {
    "flask": r"<(?:\w+:)?(\w+)>",
    "django": r"<(?:\w+:)?(\w+)>",
    "fastapi": r"\{(\w+)(?::\w+)?\}",
    "spring": r"\{(\w+)(?::[^}]*)?\}",
    "express": r":(\w+)",
}


def path_params(route: str | Column, framework: str) -> Column:
    """Names of the parameters in a route, in order."""
    return F.regexp_extract_all(_c(route), F.lit(_PARAM[framework]), F.lit(1))


def base_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent(path: str | Column) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


_LANGUAGES = {"python": "py pyi", "javascript": "js jsx mjs cjs", "java": "java"}


def language(path: str | Column) -> Column:
    """The language of a file by its extension; null for others."""
    extension = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z]+)$", 1))
    return F.coalesce(*(F.when(extension.isin(x.split()), F.lit(name)) for name, x in _LANGUAGES.items()))


def hidden(relative: str | Column) -> Column:
    """Whether a relative path has a part that begins with '.' or is __pycache__."""
    return _c(relative).rlike(r"(^|/)(\.|__pycache__(/|$))")
