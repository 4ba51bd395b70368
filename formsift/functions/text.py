"""Plain text: whitespace, case, headers, notes, addresses, cell safety."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters Python's str.strip() and str.split() treat as whitespace.
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# --- Fixed values ------------------------------------------------------------------------
NO_NOTE = "нет"
NO_NOTE_MISREADS = ["item", "hem", "nem", "rem", "ltem", "het", "net", "неm", "нem", "heт"]
NO_NOTE_WORDS = ["-", "—", "–", "none", "null", "no", "отсутствуют", "отсутствует"]

PROFILE_MATH = "Физико-математический класс"
PROFILE_HUMANITIES = "Гуманитарный класс"
PROFILE_SOCIAL = "Социально-экономический класс"
PROFILE_SCIENCE = "Естественно-научный класс"
PROFILE_TECH = "Технологический класс"
PROFILE_UNIVERSAL = "Универсальный класс"

ADDRESS_WORD_ABBREVIATIONS = ["г", "ул", "пер", "просп", "обл"]
ADDRESS_NUMBER_ABBREVIATIONS = ["д", "кв", "корп"]
# -----------------------------------------------------------------------------------------

# Word boundaries that know Cyrillic letters under any JDK.
_WORD = r"[\p{L}\p{N}_]"
_START = rf"(?<!{_WORD})"
_END = rf"(?!{_WORD})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace; null becomes an empty string."""
    return F.btrim(blank_to_empty(c), F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """Trim and collapse inner whitespace to single spaces."""
    return strip(F.regexp_replace(blank_to_empty(c), SPACE + "+", " "))


def words(c: Column) -> Column:
    """Whitespace-separated words; an empty array for a blank text."""
    text = squeeze(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(blank_to_empty(c), "[^0-9]", "")


def fold(c: Column) -> Column:
    """Lower case with ё read as е."""
    return F.translate(F.lower(blank_to_empty(c)), "ё", "е")


def dict_norm(c: Column) -> Column:
    """Key under which dictionary words are compared."""
    return squeeze(fold(c))


def metric_norm(c: Column) -> Column:
    """Text form used by the error-rate metrics."""
    return squeeze(fold(strip(c)))


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def ends_with_any(c: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(c, F.lit(e)) for e in endings])


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def normalize_header(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(blank_to_empty(c)), "[^a-zа-яё0-9]", "")


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet will not run as a formula."""
    one_line = strip(F.translate(blank_to_empty(c), "\r\n\x00", "  "))
    return F.when(
        F.substring(one_line, 1, 1).isin("=", "+", "-", "@", "\t"), F.concat(F.lit("'"), one_line)
    ).otherwise(one_line)


def is_unclear(c: Column) -> Column:
    """The reader marked at least a part of the value as illegible."""
    return F.contains(blank_to_empty(c), F.lit("["))


def starts_unclear(c: Column) -> Column:
    return F.startswith(blank_to_empty(c), F.lit("["))


def mask_secret(c: Column) -> Column:
    key = blank_to_empty(c)
    return F.when(F.length(key) <= 4, F.repeat(F.lit("*"), F.length(key))).otherwise(
        F.concat(F.substring(key, 1, 2), F.lit("…"), F.right(key, F.lit(1)))
    )


def normalize_notes(c: Column) -> Column:
    """Every spelling of "no" becomes one word."""
    text = strip(c)
    bare = F.rtrim(F.lower(text), F.lit(".,;! "))
    says_no = bare.isin(*NO_NOTE_MISREADS, *NO_NOTE_WORDS)
    return F.when((blank_to_empty(c) == "") | says_no, F.lit(NO_NOTE)).otherwise(text)


def normalize_profile(c: Column) -> Column:
    """Canonical school profile by the first keyword rule that fits."""
    text = strip(c)
    low = F.lower(text)

    def has(*parts: str) -> Column:
        return contains_any(low, list(parts))

    math = (has("музыко", "физико", "физмат", "физ-мат") & has("математ")) | (
        has("физико") & has("класс")
    )
    return (
        F.when(math, PROFILE_MATH)
        .when(has("гуманитар"), PROFILE_HUMANITIES)
        .when(has("социальн", "эконом"), PROFILE_SOCIAL)
        .when(has("естествен", "биолог", "хим"), PROFILE_SCIENCE)
        .when(has("технолог", "инженер", "it"), PROFILE_TECH)
        .when(has("универсальн"), PROFILE_UNIVERSAL)
        .otherwise(text)
    )


def normalize_address(c: Column) -> Column:
    """Abbreviations, city misreads and spacing, applied once in a fixed order."""
    rewrites = [
        *[(rf"{_START}{w}{SPACE}+([А-ЯЁа-яё])", f"{w}. $1") for w in ADDRESS_WORD_ABBREVIATIONS],
        *[(rf"{_START}{w}{SPACE}*([0-9]+)", f"{w}. $1") for w in ADDRESS_NUMBER_ABBREVIATIONS],
        (rf"{_START}(?:Город|город|г\.?){SPACE}+Еж{_END}", "г. Воронеж"),
        (rf"(?iu){_START}Вор-?онеж{_END}", "Воронеж"),
        (rf"{SPACE}+([,.\-])", "$1"),
        (rf"([,.\-])(?=[^0-9{SPACE[1:]})", "$1 "),
        (SPACE + "{2,}", " "),
    ]
    text = strip(c)
    for pattern, replacement in rewrites:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)
