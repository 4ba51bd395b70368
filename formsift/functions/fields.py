"""Rules chosen by the field's name: formatting, comparison keys, validity, review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions import dates, ids, names, text
from formsift.functions.text import contains_any, strip

# Field name fragments (lower case) and the shape of a votable number.
NUMERIC_KINDS = ["дата", "паспорт", "телефон", "снилс"]
MIXED_NUMBER = r"^[0-9\s\x{A0}+().№—–-]+\z"
SHOWN_DATE = r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}\z"


def _named(field: Column, *parts: str) -> Column:
    return contains_any(F.lower(field), list(parts))


def is_numeric_field(field: Column) -> Column:
    return _named(field, *NUMERIC_KINDS)


def auto_format(field: Column, value: Column) -> Column:
    """Format a value by the kind its field name announces; first rule wins."""
    v = strip(value)
    passport = F.regexp_replace(v, r"(?iu)(?<![\p{L}\p{N}_])рмсд(?![\p{L}\p{N}_])", "РЖД")
    snils = ids.snils_format(v)
    return (
        F.when(text.blank_to_empty(value) == "", "")
        .when(_named(field, "снилс"), F.when(snils == "", v).otherwise(snils))
        .when(_named(field, "телефон"), ids.format_phone(v))
        .when(_named(field, "дата"), dates.format_date(v))
        .when(_named(field, "фио"), names.format_fio(v))
        .when(_named(field, "паспорт"), ids.format_passport(passport))
        .when(_named(field, "адрес"), text.normalize_address(v))
        .when(_named(field, "льгот", "отметк", "notes"), text.normalize_notes(v))
        .when(_named(field, "класс", "профиль"), text.normalize_profile(v))
        .otherwise(v)
    )


def comparison_value(field: Column, value: Column) -> Column:
    """Key under which two readings of one field count as the same."""
    folded = text.fold(strip(value))
    return (
        F.when(
            _named(field, "телефон") & ~_named(field, "дата"),
            ids.local_phone_digits(text.digits_only(folded)),
        )
        .when(_named(field, "дата"), text.digits_only(dates.format_date(folded)))
        .when(_named(field, "паспорт", "снилс"), text.digits_only(folded))
        .otherwise(text.squeeze(folded))
    )


def snils_text_valid(value: Column) -> Column:
    """``structurally_valid`` of an insurance number's field."""
    v = strip(value)
    return (v != "") & ~text.is_unclear(v) & ids.snils_valid(v)


def structurally_valid(field: Column, value: Column) -> Column:
    v = strip(value)
    d = text.digits_only(v)
    by_kind = (
        F.when(_named(field, "снилс"), ids.snils_valid(v))
        .when(
            _named(field, "телефон"),
            ids.is_phone_text(v)
            & ((F.length(d) == 10) | ((F.length(d) == 11) & F.substring(d, 1, 1).isin("7", "8"))),
        )
        .when(_named(field, "дата"), dates.parse_date(v).isNotNull())
        .when(
            _named(field, "паспорт"),
            (F.length(d) >= 10) | ((F.length(v) >= 12) & (d != "")),
        )
        .when(_named(field, "фио"), (F.size(text.words(v)) >= 2) & (d == ""))
        .otherwise(F.lit(True))
    )
    return (v != "") & ~text.is_unclear(v) & by_kind


def candidate_value(value: Column, status: Column, error: Column) -> Column:
    """Usable text of a reading, blank when it failed, was unclear or is marked illegible."""
    v = strip(value)
    unusable = (
        (text.blank_to_empty(error) != "")
        | text.blank_to_empty(status).isin("unclear", "empty")
        | text.is_unclear(v)
    )
    return F.when(unusable, "").otherwise(v)


def votable_shape(field: Column, value: Column) -> Column:
    """May this reading take part in a vote digit by digit?"""
    return (
        F.when(_named(field, "дата"), F.rlike(dates.format_date(value), F.lit(SHOWN_DATE)))
        .when(_named(field, "телефон", "снилс", "паспорт"), F.rlike(value, F.lit(MIXED_NUMBER)))
        .otherwise(F.lit(False))
    )


def votable_length(field: Column) -> Column:
    return F.when(_named(field, "дата"), 8).when(_named(field, "снилс"), 11).otherwise(10)


def metric_value(field: Column, value: Column) -> Column:
    """Value form that the quality metrics compare."""
    return (
        F.when(_named(field, "дата"), dates.format_date(value))
        .when(_named(field, "телефон"), text.metric_norm(ids.format_phone(value)))
        .when(_named(field, "снилс") & ~text.is_unclear(value), text.digits_only(value))
        .otherwise(text.metric_norm(value))
    )


def needs_review(field: Column, value: Column, status: Column) -> Column:
    """Flag shown to the reviewer; field tests are case-sensitive on purpose."""
    n = F.length(text.digits_only(value))

    def named(part: str) -> Column:
        return F.contains(field, F.lit(part))

    return (
        F.when(text.blank_to_empty(status).isin("unclear", "needs_review"), True)
        .when(named("СНИЛС"), n != 11)
        .when(named("телефон"), n < 10)
        .when(named("Дата"), n < 8)
        .otherwise(False)
    )


def correction_category(field_part: Column, field: Column) -> Column:
    """Dictionary category an accepted correction belongs to."""
    by_field = (
        F.when(F.contains(field, F.lit("Паспорт")), "organizations")
        .when(F.contains(field, F.lit("Адрес")), "cities")
        .otherwise("surnames")
    )
    return F.coalesce(F.nullif(field_part, F.lit("")), by_field)
