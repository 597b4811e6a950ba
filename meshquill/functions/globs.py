"""Globs: `*` any run, `?` one UTF-16 unit, all else literal, anchored."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


@lru_cache(maxsize=1024)
def glob_regex(pattern: str) -> str:
    r"""A regular expression for Java's engine. \A and \z, as $ also matches
    before a last newline."""
    parts = {"*": r"[\s\S]*", "?": r"[\s\S]"}
    return r"\A" + "".join(parts.get(c) or (c if c.isalnum() or c in "_/ " or ord(c) > 127 else "\\" + c) for c in pattern) + r"\z"


def matches_any(label: Column, patterns) -> Column:
    """Whether one of the globs matches; none of an empty list does."""
    return reduce(lambda a, b: a | b, [label.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def filtered_out(label: Column, include, exclude) -> Column:
    """Excluded, or not included where there are includes."""
    out = matches_any(label, exclude)
    return out | ~matches_any(label, include) if include else out


def parse_globs(text: str | None) -> list[str]:
    return [g for g in (text or "").split(SEPARATOR) if g]


def serialize_globs(globs) -> str | None:
    return SEPARATOR.join(g for g in globs if g) or None


def normalize_glob(raw: str) -> str | None:
    """The trimmed glob; None if empty or holding the separator."""
    glob = raw.strip()
    return glob if glob and SEPARATOR not in glob else None


def parse_globs_col(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\|"), lambda g: g != "")


def serialize_globs_col(globs: Column) -> Column:
    return F.nullif(F.array_join(F.filter(globs, lambda g: g != ""), SEPARATOR), F.lit(""))
