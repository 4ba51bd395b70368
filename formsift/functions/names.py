"""Person names: case, patronymics, surnames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.text import (
    capitalize, ends_with_any, fold, squeeze, strip, words,
)

# --- Fixed values ------------------------------------------------------------------------
PATRONYMICS = [
    "александрович", "алексеевич", "анатольевич", "андреевич", "антонович", "аркадьевич", "артемович",
    "артёмович", "борисович", "вадимович", "валентинович", "валерьевич", "васильевич", "викторович",
    "витальевич", "владимирович", "владиславович", "вячеславович", "геннадьевич", "георгиевич",
    "григорьевич", "даниилович", "данилович", "денисович", "дмитриевич", "евгеньевич", "егорович",
    "иванович", "игоревич", "ильич", "кириллович", "константинович", "леонидович", "львович", "максимович",
    "матвеевич", "михайлович", "никитич", "николаевич", "олегович", "павлович", "петрович", "пётрович",
    "романович", "русланович", "сергеевич", "станиславович", "степанович", "тимофеевич", "федорович",
    "фёдорович", "филиппович", "эдуардович", "юрьевич", "ярославович", "александровна", "алексеевна",
    "анатольевна", "андреевна", "антоновна", "аркадьевна", "артемовна", "артёмовна", "борисовна",
    "вадимовна", "валентиновна", "валерьевна", "васильевна", "викторовна", "витальевна", "владимировна",
    "владиславовна", "вячеславовна", "геннадьевна", "георгиевна", "григорьевна", "данииловна", "даниловна",
    "денисовна", "дмитриевна", "евгеньевна", "егоровна", "ивановна", "игоревна", "ильинична", "кирилловна",
    "константиновна", "леонидовна", "львовна", "максимовна", "матвеевна", "михайловна", "никитична",
    "николаевна", "олеговна", "павловна", "петровна", "пётровна", "романовна", "руслановна", "сергеевна",
    "станиславовна", "степановна", "тимофеевна", "федоровна", "фёдоровна", "филипповна", "эдуардовна",
    "юрьевна", "ярославовна",
]
PATRONYMIC_ENDINGS = ["ович", "евич", "ич", "овна", "евна", "ична", "инична", "внч", "внa"]
LATER_WORD_ENDINGS = ["ович", "евич", "ич", "овна", "евна", "ична", "внч"]
MALE_INPUT_ENDINGS = ["ч", "вич", "ич", "внч", "вч"]
FEMALE_INPUT_ENDINGS = ["а", "на", "вна"]
MALE_ENTRY_ENDINGS = ["ович", "евич", "ич"]
SURNAME_ENDINGS_DROP_ONE = ["ова", "ева", "ина", "ына"]
SURNAME_ENDINGS_DROP_TWO = ["ская", "цкая", "ский", "цкий"]

SURNAMES_INCOMPLETE = "Недостаточно данных для сверки фамилий"
SURNAMES_EQUAL = "Фамилии полностью совпадают"
SURNAMES_EQUAL_ROOT = "Фамилии совпадают с учетом рода (муж./жен.)"
SURNAMES_DIFFER = "Фамилия ребенка (%s) отличается от фамилии родителя (%s)"
# -----------------------------------------------------------------------------------------

# Sorted, so that the first of several equally near entries is the smallest.
_ENTRIES = sorted(PATRONYMICS)


def _capitalize_word(word: Column) -> Column:
    return F.when(
        F.contains(word, F.lit("-")),
        F.array_join(F.transform(F.split(word, "-"), capitalize), "-"),
    ).otherwise(capitalize(word))


def format_fio(c: Column) -> Column:
    """Every word capitalised, hyphenated parts too."""
    return F.array_join(F.transform(words(c), _capitalize_word), " ")


def toggle_fio_case(c: Column) -> Column:
    """Upper case becomes title case, anything else becomes upper case."""
    text = strip(c)
    all_upper = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(all_upper, format_fio(text)).otherwise(F.upper(text))


def _entry_table() -> Column:
    """Constant array of (written, folded, is_male) entries; Catalyst folds it to a literal."""
    return F.array(*[
        F.struct(
            F.lit(e).alias("entry"),
            F.lit(e.replace("ё", "е")).alias("folded"),
            F.lit(e.endswith(tuple(MALE_ENTRY_ENDINGS))).alias("male"),
        )
        for e in _ENTRIES
    ])


def _nearest_patronymic(low: Column) -> Column:
    """struct(cost, entry) of the nearest listed patronymic, null when none is near."""
    male_input = ends_with_any(low, MALE_INPUT_ENDINGS)
    female_input = ~male_input & ends_with_any(low, FEMALE_INPUT_ENDINGS)

    def scored(e: Column) -> Column:
        distance = F.levenshtein(low, e["folded"], 2)
        other_gender = (male_input & ~e["male"]) | (female_input & e["male"])
        cost = distance + F.when(other_gender, 0.5).otherwise(0.0)
        # -1 means farther than 2, which no rule accepts.
        return F.when(distance >= 0, F.struct(cost.alias("cost"), e["entry"].alias("entry")))

    near = F.filter(_entry_table(), lambda e: F.abs(F.length(low) - F.length(e["folded"])) <= 2)
    return F.array_min(F.transform(near, scored))


def patronymic_exact(word: Column) -> Column:
    return fold(word).isin(*sorted({e.replace("ё", "е") for e in PATRONYMICS}))


def correct_patronymic(word: Column) -> Column:
    """Nearest listed patronymic within the allowed distance, else the capitalised word."""
    low = fold(word)
    plausible = ends_with_any(low, PATRONYMIC_ENDINGS) | (F.length(low) >= 6)
    allowed = F.when(F.length(low) >= 8, 2.0).otherwise(1.0)
    best = _nearest_patronymic(low)
    fixed = F.when(best["cost"] <= allowed, capitalize(best["entry"]))
    # The scan of the list runs only for words that are not listed as they are.
    return F.when(patronymic_exact(word) | ~plausible, capitalize(word)).otherwise(
        F.coalesce(fixed, capitalize(word))
    )


def correct_fio(c: Column) -> Column:
    """Title case, with the patronymic position checked against the list."""

    def each(word: Column, i: Column) -> Column:
        is_patronymic = (i == 2) | ((i > 2) & ends_with_any(F.lower(word), LATER_WORD_ENDINGS))
        return (
            F.when(F.contains(word, F.lit("-")), _capitalize_word(word))
            .when(is_patronymic, correct_patronymic(word))
            .otherwise(capitalize(word))
        )

    return F.array_join(F.transform(words(c), each), " ")


def extract_surname(c: Column) -> Column:
    return F.split_part(squeeze(c), F.lit(" "), F.lit(1))


def _surname_root(low: Column) -> Column:
    def longer(endings: list[str]) -> Column:
        return ends_with_any(low, endings) & (F.length(low) > len(endings[0]) + 2)

    return (
        F.when(longer(SURNAME_ENDINGS_DROP_ONE), F.left(low, F.length(low) - 1))
        .when(longer(SURNAME_ENDINGS_DROP_TWO), F.left(low, F.length(low) - 2))
        .otherwise(low)
    )


def surnames_match(child: Column, parent: Column) -> Column:
    a, b = F.lower(extract_surname(child)), F.lower(extract_surname(parent))
    return (a == "") | (b == "") | (_surname_root(a) == _surname_root(b))


def surnames_message(child: Column, parent: Column) -> Column:
    sa, sb = extract_surname(child), extract_surname(parent)
    a, b = F.lower(sa), F.lower(sb)
    return (
        F.when((a == "") | (b == ""), SURNAMES_INCOMPLETE)
        .when(a == b, SURNAMES_EQUAL)
        .when(_surname_root(a) == _surname_root(b), SURNAMES_EQUAL_ROOT)
        .otherwise(F.format_string(SURNAMES_DIFFER, sa, sb))
    )


def surname_suggestion(child: Column, parent: Column) -> Column:
    """Parent name with the child's surname when the two differ in one letter, else null."""
    a, b = extract_surname(child), extract_surname(parent)
    differing = F.aggregate(
        F.zip_with(
            F.split(F.lower(a), ""), F.split(F.lower(b), ""),
            lambda x, y: F.when(x != y, 1).otherwise(0),
        ),
        F.lit(0), lambda n, d: n + d,
    )
    close = (a != "") & (b != "") & (F.lower(a) != F.lower(b)) & (F.length(a) == F.length(b))
    rest = F.substr(squeeze(parent), F.length(b) + 1)
    return F.when(close & (differing == 1), F.concat(a, rest))


