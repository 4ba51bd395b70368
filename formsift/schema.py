"""Field names, fixed value lists and table schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names of the business and service fields -----------------------------

APPLICATION_DATE = "Дата подачи заявления"
CHILD_FIO = "ФИО поступающего ученика"
BIRTH_DATE = "Дата рождения ребенка"
TARGET_CLASS = "Класс / профиль обучения"
PARENT_FIO = "ФИО родителя / заявителя"
PASSPORT = "Паспортные данные"
ADDRESS = "Адрес регистрации / проживания"
PHONE = "Контактный телефон"
SNILS = "СНИЛС поступающего"
NOTES = "Особые отметки / льготы"

ROW_NUMBER = "№ п/п"
SOURCE_FILE = "Имя файла источника"
REVIEW_STATUS = "Статус проверки"

BUSINESS_FIELDS = [
    APPLICATION_DATE, CHILD_FIO, BIRTH_DATE, TARGET_CLASS, PARENT_FIO,
    PASSPORT, ADDRESS, PHONE, SNILS, NOTES,
]
SERVICE_FIELDS = [SOURCE_FILE, REVIEW_STATUS]
JOURNAL_COLUMNS = [ROW_NUMBER, *BUSINESS_FIELDS, *SERVICE_FIELDS]

# Fields that are re-read and voted on unless a mode says otherwise.
CRITICAL_FIELDS = [
    APPLICATION_DATE, CHILD_FIO, BIRTH_DATE, PARENT_FIO, PASSPORT, PHONE, SNILS,
]

# Technical key of a model answer -> field name, in order.
ENGLISH_KEYS = {
    "application_date": APPLICATION_DATE,
    "child_fio": CHILD_FIO,
    "birth_date": BIRTH_DATE,
    "target_class": TARGET_CLASS,
    "parent_fio": PARENT_FIO,
    "passport_data": PASSPORT,
    "address": ADDRESS,
    "phone": PHONE,
    "snils": SNILS,
    "notes": NOTES,
}

# Field name -> text fragments of keys that may fill it, in order.
ALIAS_RULES = {
    SNILS: ["снилс", "страховой номер", "лицевого счета", "индивидуального лицевого"],
    NOTES: ["льгот", "дополнительные сведения", "особые отметки", "наличие льгот"],
    APPLICATION_DATE: ["дата подачи", "дата заявления"],
    CHILD_FIO: [
        "поступающего (ребенка)", "поступающего ученика", "фио ребенка", "фио ученика",
        "фио поступающего", "фамилия, имя, отчество поступающего",
    ],
    BIRTH_DATE: ["дата рождения", "дата и место рождения"],
    TARGET_CLASS: ["желаемый класс", "профиль обучения", "класс обучения"],
    PARENT_FIO: ["родителя", "заявителя", "законного представителя"],
    PASSPORT: ["паспортные данные", "паспорт"],
    ADDRESS: ["адрес регистрации", "фактического проживания", "адрес проживания"],
    PHONE: ["телефон для связи", "контактный телефон"],
}
# Key fragments that disqualify a key for one target.
ALIAS_EXCLUSIONS = {
    CHILD_FIO: ["родител", "заявител", "представител", "снилс", "страхов", "лицев", "номер"],
    APPLICATION_DATE: ["рождени"],
}

# Review screen groups.
FIELD_GROUPS = {
    "Заявление": [APPLICATION_DATE, NOTES],
    "Ученик": [CHILD_FIO, BIRTH_DATE, TARGET_CLASS, SNILS],
    "Заявитель": [PARENT_FIO, PASSPORT, ADDRESS, PHONE],
}

# Header synonym groups in order of precedence.
HEADER_GROUPS = {
    "фио_родителя": ["родител", "заявител", "матер", "отц", "представител"],
    "снилс": ["снилс"],
    "дата_рождения": ["рождени"],
    "дата_подачи": ["подач", "заявлени", "согласи", "обращен"],
    "паспорт": ["паспорт"],
    "адрес": ["адрес", "проживан", "регистрац"],
    "телефон": ["телефон", "связ", "мобильн"],
    "класс": ["класс", "профиль", "направлен", "литер"],
    "льготы": ["льгот", "особ"],
    "файл": ["файл", "источник"],
    "статус": ["статус"],
    "предметы": ["предмет"],
    "подпись": ["подпис"],
    "фио_ученика": ["фио", "ученик", "ребенок", "учащ", "поступающ"],
}

# Statuses and labels.
STATUS_VERIFIED_DUP = "Проверено · возможный дубль"
STATUS_VERIFIED = "Проверено"
STATUS_DUP = "Возможный дубль"
STATUS_REVIEW = "Требует проверки"

NOTE_SNILS_CHECKSUM = "Вариант подтверждён контрольной суммой СНИЛС"
NOTE_DIGIT_MAJORITY = "Восстановлено по большинству голосов для каждой цифры"
NOTE_VALUE_MAJORITY = "Восстановлено по совпадающим проверочным проходам"
NOTE_INVALID_WINNER = "Значение не прошло проверку структуры или календаря"
NOTE_DIFFERENT_READS = "Проверочные проходы дали разные значения"
NOTE_ADJUDICATED_KEPT = "Значение подтверждено повторным чтением без подсказок"
NOTE_ADJUDICATED_NEW = "Значение восстановлено повторным чтением без подсказок"
NOTE_CROP_UNREADABLE = "Проверочный кроп не удалось уверенно прочитать"
NOTE_CROP_RECOVERED = "Восстановлено из проверочного кропа"
NOTE_CROP_DIFFERS = "Полный лист и проверочный кроп дали разные значения"
NOTE_PAGES_DIFFER = "значения на страницах различаются — проверьте"
NOTE_SURNAMES_DIFFER = "Фамилии отличаются: проверьте написание по документу"

REASON_SNILS = "Совпадение по СНИЛС"
REASON_NAME_BIRTH = "Совпадение по ФИО и дате рождения"
REASON_NAME = "Совпадение по ФИО"

# Dictionary entries known without any file.
DICTIONARY_DEFAULTS = {
    "surnames": ["Бобров", "Боброва", "Иванов", "Иванова", "Петров", "Петрова", "Смирнов", "Смирнова"],
    "first_names": ["Александр", "Александра", "Алексей", "Анна", "Владислав", "Владимир", "Мария", "Иван"],
    "patronymics": ["Александрович", "Алексеевич", "Владимирович", "Иванович", "Сергеевич", "Владиславовна"],
    "cities": ["Воронеж", "Москва", "Санкт-Петербург", "Липецк", "Белгород", "Ростов-на-Дону"],
    "organizations": ["РЖД", "МФЦ", "МВД", "ГИБДД"],
    "profiles": ["Физико-математический класс", "Гуманитарный класс", "Социально-экономический класс"],
}

# Acceptance thresholds of the dictionary match per category.
MATCH_THRESHOLDS = {
    "surnames": 0.80, "first_names": 0.86, "patronymics": 0.86,
    "cities": 0.84, "organizations": 0.66,
}

# Intake and retention limits.
MAX_PDF_PAGES = 20
MAX_IMAGE_PIXELS = 25_000_000
MAX_PAYLOAD_CHARS = 80 * 1024 * 1024
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "webp"]
KEEP_FINISHED_JOBS = 20
MAX_FAILED_USER = 5
MAX_FAILED_IP = 15
LOCK_WINDOW_SECONDS = 15 * 60
SESSION_TTL_HOURS = 24

# Symbols of the confusion matrix; the last one marks a missing or extra character.
GAP = "∅"
MATRIX_SYMBOLS = [*"0123456789", GAP]

# --- Table schemas ----------------------------------------------------------------------

LABEL_FILE = T.StructType([
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])
CORRECTIONS = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("wrong", T.StringType()),
    T.StructField("right", T.StringType()),
])

# Fixed values of the verification audit.
REASONS_OF_SELECTED = ["region_not_found", "locator_error"]
REASON_VERIFICATION_ERROR = "verification_error"
