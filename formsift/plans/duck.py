"""DuckDB expressions for the checks, written independently of the Spark columns.

Each helper takes and returns SQL text.
"""

from __future__ import annotations

from formsift import schema as S
from formsift.functions import ids, names, text

_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*~"
_W = "[^а-яёА-ЯЁa-zA-Z0-9_]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {lit(text.SPACE_CHARS)})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def fold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ё', 'е')"


def metric_norm(x: str) -> str:
    return squeeze(fold(x))


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w0: w0 <> '')"


def ascii_text(x: str) -> str:
    """Lower-case Cyrillic as single bytes, because DuckDB's edit distance counts bytes."""
    return f"translate({x}, {lit(_CYRILLIC)}, {lit(_ASCII)})"


def edit_distance(a: str, b: str) -> str:
    return f"levenshtein({ascii_text(a)}, {ascii_text(b)})"


def header(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-zа-яё0-9]', '', 'g')"


def has_any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def ends_any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {lit(p)})" for p in parts) + ")"


def snils_control(d: str) -> str:
    total = f"list_sum(list_transform(range(1, 10), lambda i0: try_cast({d}[i0] AS int) * (10 - i0)))"
    return f"lpad(CAST(CAST({total} AS bigint) % 101 % 100 AS varchar), 2, '0')"


def snils_valid(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN length({d}) <> 11 THEN false WHEN {d}[1:9] <= '001001998' THEN true "
        f"ELSE {snils_control(d)} = {d}[10:11] END"
    )


def snils_format(x: str) -> str:
    d = digits(x)
    return f"regexp_replace({d}, '^(\\d{{3}})(\\d{{3}})(\\d{{3}})(\\d{{2}})$', '\\1-\\2-\\3 \\4')"


def is_phone(x: str) -> str:
    return f"regexp_full_match({strip(x)}, '\\+?[0-9 ()\\t.—–-]+')"


def local_digits(d: str) -> str:
    return f"regexp_replace({d}, '^[78](\\d{{10}})$', '\\1')"


def format_phone(x: str) -> str:
    n = local_digits(digits(x))
    return (
        f"CASE WHEN {is_phone(x)} AND length({n}) = 10 THEN "
        f"regexp_replace({n}, '^(\\d{{3}})(\\d{{3}})(\\d{{2}})(\\d{{2}})$', '+7 (\\1) \\2-\\3-\\4') "
        f"ELSE {strip(x)} END"
    )


def parse_date(x: str) -> str:
    s = f"regexp_replace({strip(x)}, '[./]', '-', 'g')"
    p = f"string_split({s}, '-')"
    year = (
        f"CASE WHEN length({p}[3]) = 2 THEN CASE WHEN {p}[3] <= '35' THEN '20' ELSE '19' END "
        f"ELSE '' END || {p}[3]"
    )
    return (
        f"CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND {s}[1:4] <> '0000' "
        f"THEN try_cast({s} AS date) "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}-\\d{{1,2}}-(\\d{{2}}|\\d{{4}})') AND {p}[3] <> '0000' "
        f"THEN try_cast(({year}) || '-' || {p}[2] || '-' || {p}[1] AS date) END"
    )


def format_date(x: str) -> str:
    return f"coalesce(strftime({parse_date(x)}, '%d.%m.%Y'), {strip(x)})"


def capitalize(w: str) -> str:
    return f"(upper({w}[1]) || lower({w}[2:]))"


def format_fio(x: str) -> str:
    part = f"list_transform(string_split(w1, '-'), lambda q1: {capitalize('q1')})"
    return (
        f"array_to_string(list_transform(string_split({squeeze(x)}, ' '), "
        f"lambda w1: array_to_string({part}, '-')), ' ')"
    )


def format_passport(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN length({d}) = 10 THEN {d}[1:2] || ' ' || {d}[3:4] || ' ' || {d}[5:10] "
        f"ELSE {strip(x)} END"
    )


def normalize_address(x: str) -> str:
    out = strip(x)

    def sub(pattern: str, to: str) -> None:
        nonlocal out
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(to)}, 'g')"

    for w in ["г", "ул", "пер", "просп", "обл"]:
        sub(rf"(^|{_W}){w}\s+([А-ЯЁа-яё])", rf"\1{w}. \2")
    for w in ["д", "кв", "корп"]:
        sub(rf"(^|{_W}){w}\s*(\d+)", rf"\1{w}. \2")
    sub(rf"(^|{_W})(?:Город|город|г\.?)\s+Еж($|{_W})", r"\1г. Воронеж\2")
    sub(rf"(?i)(^|{_W})Вор-?онеж($|{_W})", r"\1Воронеж\2")
    sub(r"\s+([,.\-])", r"\1")
    sub(r"([,.\-])([^\s\d])", r"\1 \2")
    sub(r"\s{2,}", " ")
    return strip(out)


def normalize_notes(x: str) -> str:
    bare = f"rtrim(lower({strip(x)}), '.,;! ')"
    no_words = in_list([*text.NO_NOTE_MISREADS, *text.NO_NOTE_WORDS])
    return f"CASE WHEN coalesce({x}, '') = '' OR {bare} IN {no_words} THEN 'нет' ELSE {strip(x)} END"


def normalize_profile(x: str) -> str:
    low = f"lower({strip(x)})"
    return (
        f"CASE WHEN ({has_any(low, ['музыко', 'физико', 'физмат', 'физ-мат'])} AND contains({low}, 'математ')) "
        f"OR (contains({low}, 'физико') AND contains({low}, 'класс')) THEN {lit(text.PROFILE_MATH)} "
        f"WHEN contains({low}, 'гуманитар') THEN {lit(text.PROFILE_HUMANITIES)} "
        f"WHEN {has_any(low, ['социальн', 'эконом'])} THEN {lit(text.PROFILE_SOCIAL)} "
        f"WHEN {has_any(low, ['естествен', 'биолог', 'хим'])} THEN {lit(text.PROFILE_SCIENCE)} "
        f"WHEN {has_any(low, ['технолог', 'инженер', 'it'])} THEN {lit(text.PROFILE_TECH)} "
        f"WHEN contains({low}, 'универсальн') THEN {lit(text.PROFILE_UNIVERSAL)} ELSE {strip(x)} END"
    )


def auto_format(field: str, value: str) -> str:
    f = f"lower({field})"
    rzd = f"regexp_replace({strip(value)}, '(^|{_W})[рР][мМ][сС][дД]($|{_W})', '\\1РЖД\\2', 'g')"
    return (
        f"CASE WHEN coalesce({value}, '') = '' THEN '' "
        f"WHEN contains({f}, 'снилс') THEN coalesce(nullif({snils_format(value)}, ''), {strip(value)}) "
        f"WHEN contains({f}, 'телефон') THEN {format_phone(value)} "
        f"WHEN contains({f}, 'дата') THEN {format_date(value)} "
        f"WHEN contains({f}, 'фио') THEN {format_fio(value)} "
        f"WHEN contains({f}, 'паспорт') THEN {format_passport(rzd)} "
        f"WHEN contains({f}, 'адрес') THEN {normalize_address(value)} "
        f"WHEN {has_any(f, ['льгот', 'отметк', 'notes'])} THEN {normalize_notes(value)} "
        f"WHEN {has_any(f, ['класс', 'профиль'])} THEN {normalize_profile(value)} "
        f"ELSE {strip(value)} END"
    )


def comparison(field: str, value: str) -> str:
    f, v = f"lower({field})", fold(strip(value))
    return (
        f"CASE WHEN contains({f}, 'телефон') THEN {local_digits(digits(v))} "
        f"WHEN contains({f}, 'дата') THEN {digits(format_date(v))} "
        f"WHEN {has_any(f, ['паспорт', 'снилс'])} THEN {digits(v)} ELSE {squeeze(v)} END"
    )


def valid(field: str, value: str) -> str:
    f, v, d = f"lower({field})", strip(value), digits(value)
    return (
        f"CASE WHEN {v} = '' OR contains({v}, '[') THEN false "
        f"WHEN contains({f}, 'снилс') THEN {snils_valid(v)} "
        f"WHEN contains({f}, 'телефон') THEN {is_phone(v)} AND (length({d}) = 10 "
        f"OR (length({d}) = 11 AND {d}[1] IN ('7', '8'))) "
        f"WHEN contains({f}, 'дата') THEN ({parse_date(v)}) IS NOT NULL "
        f"WHEN contains({f}, 'паспорт') THEN length({d}) >= 10 OR (length({v}) >= 12 AND {d} <> '') "
        f"WHEN contains({f}, 'фио') THEN len({words(v)}) >= 2 AND {d} = '' ELSE true END"
    )


def candidate(value: str, status: str, error: str) -> str:
    return (
        f"CASE WHEN coalesce({error}, '') <> '' OR coalesce({status}, '') IN ('unclear', 'empty') "
        f"OR contains({strip(value)}, '[') THEN '' ELSE {strip(value)} END"
    )


def metric_value(field: str, value: str) -> str:
    f = f"lower({field})"
    return (
        f"CASE WHEN contains({f}, 'дата') THEN {format_date(value)} "
        f"WHEN contains({f}, 'телефон') THEN {metric_norm(format_phone(value))} "
        f"WHEN contains({f}, 'снилс') AND NOT contains({value}, '[') THEN {digits(value)} "
        f"ELSE {metric_norm(value)} END"
    )


def needs_review(field: str, value: str, status: str) -> str:
    n = f"length({digits(value)})"
    return (
        f"CASE WHEN coalesce({status}, '') IN ('unclear', 'needs_review') THEN true "
        f"WHEN contains({field}, 'СНИЛС') THEN {n} <> 11 WHEN contains({field}, 'телефон') THEN {n} < 10 "
        f"WHEN contains({field}, 'Дата') THEN {n} < 8 ELSE false END"
    )


def header_group(x: str) -> str:
    h = header(x)
    return (
        "CASE "
        + " ".join(f"WHEN {has_any(h, parts)} THEN {lit(g)}" for g, parts in S.HEADER_GROUPS.items())
        + " END"
    )


def patronymic_ctes(words_sql: str) -> str:
    """CTE ``fixed(word, fixed_word)``: list correction of the distinct words of a query."""
    entries = "|".join(names.PATRONYMICS)
    male_in, female_in = names.MALE_INPUT_ENDINGS, names.FEMALE_INPUT_ENDINGS
    return f"""
entries AS (SELECT e AS entry, replace(e, 'ё', 'е') AS folded, {ends_any('e', names.MALE_ENTRY_ENDINGS)} AS male
  FROM (SELECT unnest(string_split('{entries}', '|')) AS e) t),
vocabulary AS (SELECT DISTINCT w AS word, {fold('w')} AS low FROM ({words_sql}) t),
scored AS (SELECT word, low, entry, {edit_distance('low', 'folded')}
    + CASE WHEN ({ends_any('low', male_in)} AND NOT male) OR (NOT {ends_any('low', male_in)} AND {ends_any('low', female_in)} AND male)
      THEN 0.5 ELSE 0 END AS cost
  FROM vocabulary JOIN entries ON abs(length(low) - length(folded)) <= 2),
nearest AS (SELECT word, arg_min(entry, (cost, entry)) AS entry, min(cost) AS cost FROM scored GROUP BY word),
fixed AS (SELECT v.word, CASE
    WHEN low IN (SELECT folded FROM entries) OR NOT ({ends_any('low', names.PATRONYMIC_ENDINGS)} OR length(low) >= 6)
      OR n.cost IS NULL OR n.cost > CASE WHEN length(low) >= 8 THEN 2 ELSE 1 END THEN {capitalize('v.word')}
    ELSE {capitalize('n.entry')} END AS fixed_word
  FROM vocabulary v LEFT JOIN nearest n ON v.word = n.word)"""


def passport_message(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN {lit(ids.PASSPORT_MISSING)} "
        f"WHEN length({d}) = 10 AND {d}[1:2] <> '00' THEN {lit(ids.PASSPORT_GOOD)} "
        f"WHEN length({d}) = 10 THEN replace({lit(ids.PASSPORT_ODD_REGION)}, '%s', {d}[1:2]) "
        f"ELSE {lit(ids.PASSPORT_KEPT)} END"
    )
