"""Path expressions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """One spelling per file: `/` separators, without empty, `.` and `..` segments. Case is kept.

    A `..` above the root is dropped. Paths that are already plain skip the segment fold.
    """
    slashed = F.translate(path, "\\", "/")
    step = lambda acc, s: (
        F.when(s.isin("", "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    folded = F.array_join(F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), step), "/")
    odd = F.concat(F.lit("/"), slashed, F.lit("/")).rlike(r"^//|//$|/\.{0,2}/")
    return F.when(odd, folded).otherwise(slashed)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
