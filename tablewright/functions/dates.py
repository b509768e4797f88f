"""Parsing of mixed date text, month first, with a day-first fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import strip

# Fixed values: (shape of the text, patterns tried in order).
DATE_PATTERNS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["y-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["y/M/d"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/y", "d/M/y"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-y", "d-M-y"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["M.d.y", "d.M.y"]),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", ["MMM d, y"]),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", ["MMMM d, y"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM y"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ["d MMMM y"]),
    (r"^[A-Za-z]{3} \d{4}$", ["MMM y"]),
    (r"^[A-Za-z]{4,9} \d{4}$", ["MMMM y"]),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ["M/d/yy", "d/M/yy"]),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", ["M-d-yy", "d-M-yy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", ["M/d/y H:mm[:ss]", "d/M/y H:mm[:ss]"]),
]

# A date with a time: fraction and zone may follow; Spark's own reading of timestamps takes all of it.
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?$"


# Any text with one of the shapes; everything else is not tried.
DATE_LIKE = r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d|\d{8}$|[A-Za-z]{3,9} \d|\d{1,2} [A-Za-z]{3})"


def parse_date(x: Column) -> Column:
    """Timestamp of a date text, NULL when no known shape fits.

    The shape picks the patterns, so each value is parsed at most twice.
    """
    s = F.regexp_replace(strip(x), "(?i)^(\\d{1,2} )?sept ", "$1Sep ")
    zoned = F.regexp_replace(s, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    out = F.when(~s.rlike(DATE_LIKE), F.lit(None).cast("timestamp"))
    out = out.when(s.rlike(ISO_TIME), F.when(s.rlike(r":\d{2}.*[+-]\d{2}:?\d{2}$"), zoned).otherwise(s).try_cast("timestamp"))
    for shape, patterns in DATE_PATTERNS:
        out = out.when(s.rlike(shape), F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in patterns]))
    return out
