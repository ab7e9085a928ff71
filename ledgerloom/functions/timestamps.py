"""Time text of mixed formats to instants, row by row; what can't be told is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IngestError
from .sessions import localised

#: Tried in this order; the first that reads the text wins.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy", "yyyyMMdd HH:mm:ss", "yyyyMMdd HHmmss", "yyyyMMdd",
)
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
TIME_ONLY = r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([AaPp][Mm])?$"
DATE_ONLY = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$|^\d{8}$"


# fixed values: directives of strftime and the letters of Spark's patterns
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "D", "%": "'%'"}


def pattern(text: str) -> str:
    """A Spark pattern of a format with % directives (one and two digits are read alike); a text without % is a pattern already."""
    if "%" not in text:
        return text
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "%":
            i += 1
            if i == len(text) or text[i] not in DIRECTIVES:
                raise IngestError(f"the time format {text!r} has a directive that is not known")
            out += DIRECTIVES[text[i]]
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


def wall_clock(text: Column, formats=FORMATS) -> Column:
    """A text without offset as if its zone were UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_instant(text: Column | str, tz: str = "UTC", formats=FORMATS) -> Column:
    """The instant of a time text: its own offset if it has one, else wall time of tz; null in that zone's gaps and folds."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    off = F.regexp_extract(t, OFFSET, 1)
    has = (off != "") & t.rlike(r":\d{2}")
    bare = F.trim(F.regexp_replace(t, OFFSET, ""))
    minutes = F.when(off == "Z", 0).otherwise(F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1) * (F.substring(off, 2, 2).try_cast("int") * 60 + F.regexp_extract(off, r"(\d{2})$", 1).try_cast("int")))
    fixed = wall_clock(bare, formats) - F.make_interval(mins=minutes.cast("int"))
    naive = wall_clock(t, formats)
    return F.when(has, fixed).otherwise(naive if tz == "UTC" else localised(naive, tz))


def is_naive(text: Column | str) -> Column:
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return ~((F.regexp_extract(t, OFFSET, 1) != "") & t.rlike(r":\d{2}"))


def joined(date: Column, time: Column) -> Column:
    """A date and a time cell as one text; an empty time is midnight, hours and minutes get their seconds."""
    t = F.trim(F.coalesce(time, F.lit("")))
    t = F.when(t == "", "00:00:00").when(t.rlike(r"^\d{1,2}:\d{2}$"), F.concat(t, F.lit(":00"))).otherwise(t)
    return F.concat_ws(" ", F.trim(date), F.lpad(t, 8, "0"))
