"""Money text to numbers in column expressions: currency signs, grouping, decimal commas, accountants' parentheses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column | str) -> Column:
    """The number a money text stands for; null where it is none.

    Of two separators the later one is the decimal. A lone kind of separator groups thousands where it stands as
    grouping does (after one to three digits that don't begin with 0, before threes) or stands twice; else it is
    the decimal. Parentheses, or a minus of any kind, negate.
    """
    c = F.col(text) if isinstance(text, str) else text
    s = F.regexp_replace(F.regexp_replace(c, "−", "-"), r"[$€£\s  ]", "")
    wrapped = s.rlike(r"^\(.*\)$")
    s = F.when(wrapped, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    comma, dot = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    no_comma, no_dot = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    comma_last = F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s))
    plain = (
        F.when((comma > 0) & (dot > 0), F.when(comma_last, F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(comma > 0, F.when((comma > 1) | s.rlike(r"^[+-]?[1-9]\d{0,2}(,\d{3})+$"), no_comma).otherwise(F.replace(s, F.lit(","), F.lit("."))))
        .when(dot > 1, F.when(s.rlike(r"^[+-]?[1-9]\d{0,2}(\.\d{3})+$"), no_dot))
        .otherwise(s)
    )
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    number = F.when(wrapped, -F.abs(number)).otherwise(number)
    return F.when(F.abs(number) < F.lit(float("inf")), number)
