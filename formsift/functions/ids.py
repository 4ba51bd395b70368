"""Identifiers: insurance number, phone, passport."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.text import blank_to_empty, digits_only, let, strip

# --- Fixed values ------------------------------------------------------------------------
SNILS_UNCHECKED_MAX = "001001998"
SNILS_MISSING = "СНИЛС не указан"
SNILS_BAD_LENGTH = "Неверная длина: %s цифр вместо 11"
SNILS_UNCHECKED = "СНИЛС корректен"
SNILS_GENUINE = "СНИЛС подлинный (контрольная сумма сошлась)"
SNILS_BAD_SUM = "Ошибка контрольной суммы: ожидалось %s, указано %s"

PHONE_CHARS = r"^\+?[0-9 ()\t.—–-]+\z"

PASSPORT_MISSING = "Паспортные данные не указаны"
PASSPORT_GOOD = "Паспортные данные корректны (код региона РФ подтвержден)"
PASSPORT_ODD_REGION = "Предупреждение: нестандартный код региона серии (%s)"
PASSPORT_KEPT = "Паспортные данные сохранены"
# -----------------------------------------------------------------------------------------


def _snils_control(digits: Column) -> Column:
    """Control number of eleven digits as two characters."""
    weighted = sum(
        (F.ascii(F.substring(digits, i + 1, 1)) - F.lit(48)) * (9 - i) for i in range(9)
    )
    return F.lpad((weighted % 101 % 100).cast("string"), 2, "0")


def _unchecked(digits: Column) -> Column:
    return F.substring(digits, 1, 9) <= SNILS_UNCHECKED_MAX


def snils_valid(c: Column) -> Column:
    return let(
        digits_only(c),
        lambda d: (F.length(d) == 11)
        & (_unchecked(d) | (_snils_control(d) == F.substring(d, 10, 2))),
    )


def snils_format(c: Column) -> Column:
    """ddd-ddd-ddd dd for eleven digits, else the bare digits."""
    return F.regexp_replace(digits_only(c), r"^(\d{3})(\d{3})(\d{3})(\d{2})\z", "$1-$2-$3 $4")


def snils_message(c: Column) -> Column:
    def message(d: Column) -> Column:
        given = F.substring(d, 10, 2)
        return (
            F.when(F.length(d) != 11, F.format_string(SNILS_BAD_LENGTH, F.length(d).cast("string")))
            .when(_unchecked(d), SNILS_UNCHECKED)
            .when(_snils_control(d) == given, SNILS_GENUINE)
            .otherwise(F.format_string(SNILS_BAD_SUM, _snils_control(d), given))
        )

    return F.when(blank_to_empty(c) == "", SNILS_MISSING).otherwise(let(digits_only(c), message))


def is_phone_text(c: Column) -> Column:
    """Only phone characters, so one number and nothing else."""
    return F.rlike(strip(c), F.lit(PHONE_CHARS))


def local_phone_digits(digits: Column) -> Column:
    """Drop a leading country 7 or trunk 8 of an eleven-digit number."""
    return F.regexp_replace(digits, r"^[78](\d{10})\z", "$1")


def format_phone(c: Column) -> Column:
    """+7 (AAA) BBB-CC-DD for a lone number; anything else stays as written."""
    shown = F.regexp_replace(
        digits_only(c), r"^[78]?(\d{3})(\d{3})(\d{2})(\d{2})\z", "+7 ($1) $2-$3-$4"
    )
    return F.when(is_phone_text(c) & F.startswith(shown, F.lit("+")), shown).otherwise(strip(c))


def passport_valid(c: Column) -> Column:
    return blank_to_empty(c) != ""


def format_passport(c: Column) -> Column:
    """RR YY NNNNNN for exactly ten digits, else the trimmed text."""
    shown = F.regexp_replace(digits_only(c), r"^(\d{2})(\d{2})(\d{6})\z", "$1 $2 $3")
    return F.when(F.contains(shown, F.lit(" ")), shown).otherwise(strip(c))


def passport_message(c: Column) -> Column:
    d = digits_only(c)
    region = F.substring(d, 1, 2)
    return (
        F.when(blank_to_empty(c) == "", PASSPORT_MISSING)
        .when((F.length(d) == 10) & (region != "00"), PASSPORT_GOOD)
        .when(F.length(d) == 10, F.format_string(PASSPORT_ODD_REGION, region))
        .otherwise(PASSPORT_KEPT)
    )
