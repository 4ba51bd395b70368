"""Golden values of the column functions."""

import pytest

from formsift.functions import dates, errors, fields, ids, metrics, names, text
from formsift.schema import (
    ADDRESS, APPLICATION_DATE, BIRTH_DATE, CHILD_FIO, NOTES, PASSPORT, PHONE, SNILS, TARGET_CLASS,
)

NOT_DATES = [
    "31.02.2026", "29.02.1900", "00.01.2026", "01.13.2026", "01.01.0000", "01.01.026", "",
    "[неразборчиво]", "26-1-2", "2026-01", "1.2.26 x",
]
DATES = {
    "2000-02-29": "29.02.2000", "29/2/24": "29.02.2024", "1-2-95": "01.02.1995",
    "1.2.26": "01.02.2026", "01.01.0001": "01.01.0001", " 1.2.35 ": "01.02.2035",
    "1.2.36": "01.02.1936", "2014/7/4": "04.07.2014",
}


def test_dates(apply):
    assert apply(dates.parse_date, NOT_DATES) == [None] * len(NOT_DATES)
    assert apply(dates.format_date, NOT_DATES) == NOT_DATES
    assert apply(dates.format_date, list(DATES)) == list(DATES.values())
    once = apply(dates.format_date, list(DATES))
    assert apply(dates.format_date, once) == once
    assert apply(dates.format_date, [None]) == [""]


def test_cross_verify_dates(apply):
    rows = [
        ("27.04.2027", "27.07.2027", "27.07.2027"), ("27.01.2027", "27.07.2027", "27.07.2027"),
        ("26.04.2027", "27.07.2027", "26.07.2027"), ("26.05.2027", "27.07.2027", "26.05.2027"),
        ("", "1.2.26", "01.02.2026"), ("1.2.26", "", "01.02.2026"), ("", "", ""), ("нет", "1.2.26", "нет"),
    ]
    assert apply(dates.cross_verify_dates, [r[:2] for r in rows]) == [r[2] for r in rows]


def test_phone(apply):
    kept = [
        "79001234567123", "+7 900 123-45-67 доб. 123", "79001234567; 79007654321",
        "9001234567 [неразборчиво]", "12345/67890", "--", "",
    ]
    assert apply(ids.format_phone, kept) == kept
    same = ["8 900 123 45 67", "+7 (900) 123-45-67", "9001234567", " 7900\t1234567 "]
    assert set(apply(ids.format_phone, same)) == {"+7 (900) 123-45-67"}


def test_snils(apply):
    rows = ["11223344595", "112-233-445 95", "11223344594", "00100199800", "1122334459", "", None]
    assert apply(ids.snils_valid, rows) == [True, True, False, True, False, False, False]
    assert apply(ids.snils_format, rows) == [
        "112-233-445 95", "112-233-445 95", "112-233-445 94", "001-001-998 00", "1122334459", "", "",
    ]
    assert apply(ids.snils_message, rows)[2] == "Ошибка контрольной суммы: ожидалось 95, указано 94"
    assert apply(ids.snils_message, rows)[4] == "Неверная длина: 10 цифр вместо 11"


def test_passport(apply):
    rows = ["4512123456", "00 12 654321", "45 12 123456 выдан", ""]
    assert apply(ids.format_passport, rows) == ["45 12 123456", "00 12 654321", "45 12 123456", ""]
    assert apply(ids.format_passport, ["45 12 1234567 выдан"]) == ["45 12 1234567 выдан"]
    assert apply(ids.passport_message, rows)[1].endswith("(00)")


def test_names(apply):
    assert apply(names.format_fio, ["ИВАНОВ-ПЕТРОВ  иван", "", " o'нил 1а "]) == ["Иванов-Петров Иван", "", "O'нил 1а"]
    assert apply(names.toggle_fio_case, ["ИВАНОВ ИВАН", "Иванов", "12"]) == ["Иванов Иван", "ИВАНОВ", "12"]
    cases = {
        "Алексеевнч": "Алексеевич", "Влалимирович": "Владимирович", "Петровна": "Петровна",
        "Артёмович": "Артёмович", "Ильнч": "Ильнч", "Кот": "Кот", "Сергеевнa": "Сергеевна",
    }
    assert apply(names.correct_patronymic, list(cases)) == list(cases.values())
    fio = {
        "иванов петр алексеевнч": "Иванов Петр Алексеевич",
        "римский-корсаков ник андреевич": "Римский-Корсаков Ник Андреевич",
        "а б в Ивановнч": "А Б В Иванович", "": "",
    }
    assert apply(names.correct_fio, list(fio)) == list(fio.values())


def test_patronymic_against_brute_force(apply):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def expected(word):
        low = word.lower().replace("ё", "е")
        listed = {e: e.replace("ё", "е") for e in names.PATRONYMICS}
        if low in listed.values():
            return word.capitalize()
        if not (low.endswith(tuple(names.PATRONYMIC_ENDINGS)) or len(low) >= 6):
            return word.capitalize()
        best = []
        for entry, folded in listed.items():
            if abs(len(low) - len(folded)) <= 2:
                male = folded.endswith(("ович", "евич", "ич"))
                fine = 0.5 if low.endswith("ч") and not male else 0.0
                if not low.endswith("ч") and male and low.endswith("а"):
                    fine = 0.5
                best.append((distance(low, folded) + fine, entry))
        limit = 2.0 if len(low) >= 8 else 1.0
        cost, entry = min(best, default=(99, ""))
        return entry.capitalize() if cost <= limit else word.capitalize()

    words = [w[:k] + "н" + w[k + 1:] for i, w in enumerate(names.PATRONYMICS) for k in (i % len(w), len(w) - 2)]
    words += [w[1:] for w in names.PATRONYMICS] + [w + "а" for w in names.PATRONYMICS]
    assert apply(names.correct_patronymic, words) == [expected(w) for w in words]


def test_surnames(apply):
    rows = [("Иванова Анна", "Иванов Игорь", True), ("Троицкая А", "Троицкий Б", True), ("Бобров А", "Бодров Б", False), ("", "Бодров", True)]
    assert apply(names.surnames_match, [r[:2] for r in rows]) == [r[2] for r in rows]
    assert apply(names.surname_suggestion, [("Бобров Иван", "бодров Игорь  П"), ("Бобров", "Бобров"), ("Бобр", "Бобров")]) == ["Бобров Игорь П", None, None]


def test_texts(apply):
    address = {
        "г Воронеж, ул Мира, д5": "г. Воронеж, ул. Мира, д. 5", "Город Еж ,пер Тихий кв12": "г. Воронеж, пер. Тихий кв. 12",
        "Ростов-на-Дону": "Ростов- на- Дону", "ВОР-ОНЕЖ": "Воронеж", "д5,кв7": "д. 5, кв. 7", "": "",
    }
    assert apply(text.normalize_address, list(address)) == list(address.values())
    assert apply(text.normalize_notes, ["item", "HET", "hem.", "—", "", None, " сирота "]) == ["нет"] * 6 + ["сирота"]
    assert apply(text.normalize_profile, ["музыко-математический", "физико класс", "соц-эконом", "IT", "другой"]) == [
        text.PROFILE_MATH, text.PROFILE_MATH, text.PROFILE_SOCIAL, text.PROFILE_TECH, "другой"]
    assert apply(text.safe_cell, ["=1+1", " -x", "a\r\nb", None, "\tq", "a\x00b"]) == ["'=1+1", "'-x", "a  b", "", "q", "ab"]
    assert apply(text.mask_secret, ["", "abc", "abcd", "abcde", None]) == ["", "***", "****", "ab…e", ""]
    assert apply(text.normalize_header, ["ФИО ребёнка (полн.) №1"]) == ["фиоребёнкаполн1"]
    assert apply(text.squeeze, [" a  b\n", None]) == ["a b", ""]


@pytest.mark.parametrize("field, value, shown", [
    (SNILS, "11223344595", "112-233-445 95"), (SNILS, "нет", "нет"), (PHONE, "89001234567", "+7 (900) 123-45-67"),
    (BIRTH_DATE, "1.2.06", "01.02.2006"), (CHILD_FIO, "ИВАНОВ иван", "Иванов Иван"),
    (PASSPORT, "45 12 123456 выдан рмсд 1", "45 12 123456 выдан РЖД 1"), (ADDRESS, "г Воронеж", "г. Воронеж"),
    (NOTES, "het", "нет"), (TARGET_CLASS, "гуманитарный", "Гуманитарный класс"), ("Предмет", " физика ", "физика"), (NOTES, "", ""),
])
def test_auto_format(apply, field, value, shown):
    assert apply(fields.auto_format, [(field, value)]) == [shown]


def test_comparison_and_validity(apply):
    rows = [(PHONE, "8 (900) 123-45-67", "9001234567"), (BIRTH_DATE, "1.2.06", "01022006"), (CHILD_FIO, " Ёж  ИВАН", "еж иван"), (PASSPORT, "45 12 № 1", "45121")]
    assert apply(fields.comparison_value, [r[:2] for r in rows]) == [r[2] for r in rows]
    rows = [
        (SNILS, "11223344595", True), (SNILS, "11223344594", False), (PHONE, "9001234567", True), (PHONE, "900123456", False),
        (PHONE, "9001234567 доб", False), (APPLICATION_DATE, "31.02.2026", False), (PASSPORT, "выдан в 2001", True),
        (PASSPORT, "4512", False), (CHILD_FIO, "Иван", False), (CHILD_FIO, "Иван 2", False), (NOTES, "x", True), (NOTES, "[x]", False), (NOTES, "", False),
    ]
    assert apply(fields.structurally_valid, [r[:2] for r in rows]) == [r[2] for r in rows]
    rows = [("x", "read", "", "x"), ("x", "unclear", "", ""), ("x", "read", "timeout", ""), ("[x", "read", "", ""), (" ", "read", "", "")]
    assert apply(fields.candidate_value, [r[:3] for r in rows]) == [r[3] for r in rows]


def test_error_rates(apply):
    assert apply(metrics.cer, [("абв", "абг"), ("", "ab"), ("a", "a")]) == [pytest.approx(1 / 3), 2.0, 0.0]
    rows = [("а б в", "а в"), ("а б", "б а"), ("", "а"), ("а а", "а")]
    assert apply(metrics.wer, rows) == [pytest.approx(1 / 3), 1.0, 1.0, 0.5]
    long = " ".join(f"w{i}" for i in range(700))
    assert apply(metrics.word_distance, [(long, long.replace("w5 ", "x "))]) == [1]


def test_friendly_error(apply):
    rows = [("KeyError", "secret"), ("ValueError", "bad"), ("ValueError", ""), ("KeyError", "Connection refused"), ("X", "errno 61")]
    assert apply(errors.friendly_error, rows) == [
        errors.INTERNAL_ERROR, "bad", errors.UNKNOWN_ERROR, errors.CONNECTION_REFUSED, errors.CONNECTION_REFUSED]


def test_repeated_formatting_is_stable(apply):
    for fn, rows in (
        (ids.format_phone, ["8 900 123 45 67", "123", "x"]), (dates.format_date, ["1.2.26", "x"]),
        (names.format_fio, ["иванов-петров ИВАН", "x"]),
    ):
        once = apply(fn, rows)
        assert apply(fn, once) == once
