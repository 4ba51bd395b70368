"""Calendar dates carried as DD.MM.YYYY text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.text import let, strip

# Day-first layouts (after "." and "/" became "-") and the year they mean;
# two-digit years up to 35 belong to this century.
DAY_FIRST = [
    (r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})\z", "$3-$2-$1"),
    (r"^([0-9]{1,2})-([0-9]{1,2})-([0-2][0-9]|3[0-5])\z", "20$3-$2-$1"),
    (r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})\z", "19$3-$2-$1"),
]
YEAR_FIRST = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"


def parse_date(c: Column) -> Column:
    """DateType, or null when the layout or the calendar day is not valid."""
    iso = F.translate(strip(c), "./", "--")
    for pattern, replacement in DAY_FIRST:
        iso = F.regexp_replace(iso, pattern, replacement)
    return F.regexp_extract(iso, YEAR_FIRST, 0).try_cast("date")


def format_date(c: Column) -> Column:
    """DD.MM.YYYY when the text is a date, else the trimmed text."""
    shown = F.regexp_replace(parse_date(c).cast("string"), r"^(.+)-(..)-(..)\z", "$3.$2.$1")
    return F.coalesce(shown, strip(c))


def cross_verify_dates(top: Column, bottom: Column) -> Column:
    """Settle the form's head date against the signature date."""
    both = F.struct(
        format_date(top).alias("t"), format_date(bottom).alias("b"),
        F.split(format_date(top), r"\.").alias("tp"), F.split(format_date(bottom), r"\.").alias("bp"),
    )

    def settle(v: Column) -> Column:
        t, b, tp, bp = v["t"], v["b"], v["tp"], v["bp"]

        def confused(*months: str) -> Column:
            return tp[1].isin(*months) & bp[1].isin(*months)

        same_day = (tp[0] == bp[0]) & (confused("04", "07") | confused("01", "07"))
        april_july = (tp[1] == "04") & (bp[1] == "07")
        comparable = F.when((F.size(tp) == 3) & (F.size(bp) == 3), tp[2] == bp[2])
        return (
            F.when(t == "", b)
            .when((b == "") | (t == b) | ~F.coalesce(comparable, F.lit(False)), t)
            .when(same_day, b)
            .when(april_july, F.concat(tp[0], F.lit(".07."), tp[2]))
            .otherwise(t)
        )

    return let(both, settle)
