"""Predicates on passages and evidence. All of them reach the parquet scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Equalities and an inclusive range of dates; unset fields filter nothing. Rows without
    a date fail a range."""

    language: str | None = None
    source_type: str | None = None
    press_meet_id: str | None = None
    publication: str | None = None
    since: str | None = None
    until: str | None = None

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))

    def predicates(self, column=F.col) -> list[Column]:
        out = [column(k) == F.lit(getattr(self, k)) for k in ("language", "source_type", "press_meet_id", "publication") if getattr(self, k)]
        if self.since:
            out.append(column("date") >= F.lit(self.since))
        if self.until:
            out.append(column("date") <= F.lit(self.until))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, p: d.where(p), self.predicates(), df)

    def of(self, item: Column) -> Column:
        """The same predicate on one struct of evidence."""
        return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in self.predicates(lambda k: item[k])], F.lit(True))


def glob(path: Column, pattern: str) -> Column:
    """Whether a path contains a shell pattern."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return path.rlike(f"(?s)^.*{body}.*$")
