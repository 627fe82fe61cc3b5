"""Regular expressions as columns: where they match, in characters.

Spark returns matched strings, not places. ``spans`` recovers the places from what lies between the
matches. The classes below are those of Python's ``re`` over str, written for Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: Python's \w and \s.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """ARRAY<STRUCT<beg INT, m STRING>> of the matches of a pattern that never matches nothing.

    gate: a cheap condition that any match implies; the pattern runs only where it holds. Texts without a
    match are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<beg:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        beg = acc["at"] + pair["gap"]
        return F.struct((beg + F.length(pair["m"])).alias("at"), F.array_append(acc["out"], F.struct(beg.alias("beg"), pair["m"].alias("m"))).alias("out"))

    located = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    hit = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(F.coalesce(hit, F.lit(False)), located).otherwise(none)
