"""Queries over records of a batch and over the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields
from formsift.operators import activity, canon, duplicates, journal, ranking
from formsift.plans import duck as D
from formsift.plans.flows import (
    answer_records, batch_journal, checked_records, reviewed_applications, status_summary,
)
from formsift.plans.registry import query
from formsift.sources.fixtures import derived, table

c = F.col

_KEYS = f"""
keys AS (SELECT doc_id, filename, CASE WHEN length({D.digits('snils')}) = 11 THEN {D.digits('snils')} END AS snils,
  {D.header('child_fio')} AS name, {D.digits(D.format_date('birth_date'))} AS birth FROM fx_applications)"""
_PAIRS = f"""{_KEYS},
pairs AS (SELECT * FROM (SELECT a.doc_id, b.doc_id AS prev, b.filename, CASE WHEN a.snils = b.snils THEN '{S.REASON_SNILS}'
    WHEN a.birth <> '' AND a.birth = b.birth THEN '{S.REASON_NAME_BIRTH}' WHEN a.birth = '' OR b.birth = '' THEN '{S.REASON_NAME}' END AS reason
  FROM keys a JOIN keys b ON b.doc_id < a.doc_id AND (a.snils = b.snils OR (a.name = b.name AND a.name <> ''))) t WHERE reason IS NOT NULL),
found AS (SELECT doc_id, count(*) FILTER (WHERE reason = '{S.REASON_SNILS}') AS n_snils, count(*) FILTER (WHERE reason = '{S.REASON_NAME_BIRTH}') AS n_name_birth,
   count(*) FILTER (WHERE reason = '{S.REASON_NAME}') AS n_name, min(prev) AS first_index, arg_min(filename, prev) AS duplicate_of, arg_min(reason, prev) AS first_reason
  FROM pairs GROUP BY doc_id)"""


@query("c1_batch_duplicates", f"WITH {_PAIRS} SELECT * FROM found")
def c1_batch_duplicates(spark, sf):
    return duplicates.batch_duplicates(duplicates.application_keys(derived(spark, sf, "fx_applications")))


@query("c1_record_keys", f"""
WITH normed AS (SELECT *, {D.header('key')} AS h FROM fx_raw),
role AS (SELECT *, CASE WHEN contains(h, 'снилс') THEN 'snils' WHEN {D.has_any('h', duplicates.PARENT_PARTS)} THEN 'ignored'
   WHEN contains(h, 'рождени') THEN 'birth' WHEN {D.has_any('h', duplicates.NAME_PARTS)} THEN 'name' END AS r FROM normed),
vals AS (SELECT doc_id, arg_max(value, key_ord) FILTER (WHERE r = 'snils') AS s, arg_max(value, key_ord) FILTER (WHERE r = 'name') AS n,
   arg_max(value, key_ord) FILTER (WHERE r = 'birth') AS b FROM role GROUP BY doc_id)
SELECT doc_id, CASE WHEN length({D.digits('s')}) = 11 THEN {D.digits('s')} END AS snils, {D.header('n')} AS name, {D.digits('b')} AS birth FROM vals""")
def c1_record_keys(spark, sf):
    return duplicates.record_keys(derived(spark, sf, "fx_raw"))


_INCOMING = """
incoming AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN snils END AS snils, name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE birth END AS birth FROM keys)"""


@query("c2_journal_duplicates", f"""
WITH {_KEYS}, {_INCOMING},
hits AS (SELECT * FROM (SELECT a.doc_id, b.doc_id AS row_id, CASE WHEN a.snils = b.snils THEN '{S.REASON_SNILS}'
    WHEN a.birth <> '' AND a.birth = b.birth THEN '{S.REASON_NAME_BIRTH}' WHEN a.birth = '' THEN '{S.REASON_NAME}' END AS reason
  FROM incoming a JOIN keys b ON a.snils = b.snils OR (a.name = b.name AND a.name <> '')) t WHERE reason IS NOT NULL)
SELECT doc_id, count(*) FILTER (WHERE reason = '{S.REASON_SNILS}') AS n_snils, count(*) FILTER (WHERE reason = '{S.REASON_NAME_BIRTH}') AS n_name_birth,
   count(*) FILTER (WHERE reason = '{S.REASON_NAME}') AS n_name, min(row_id) AS first_row, arg_min(reason, row_id) AS first_reason FROM hits GROUP BY doc_id""")
def c2_journal_duplicates(spark, sf):
    keys = duplicates.application_keys(derived(spark, sf, "fx_applications"))
    incoming = keys.select(
        "doc_id", F.when(c("doc_id") % 3 != 0, c("snils")).alias("snils"), "name",
        F.when(c("doc_id") % 4 == 0, "").otherwise(c("birth")).alias("birth"),
    )
    return duplicates.journal_duplicates(incoming, keys)


@query("c2_matched_rows", f"""
WITH {_KEYS}, {_INCOMING},
hits AS (SELECT * FROM (SELECT a.doc_id, b.doc_id AS row_id, CASE WHEN a.snils = b.snils THEN '{S.REASON_SNILS}'
    WHEN a.birth <> '' AND a.birth = b.birth THEN '{S.REASON_NAME_BIRTH}' WHEN a.birth = '' THEN '{S.REASON_NAME}' END AS reason
  FROM incoming a JOIN keys b ON a.snils = b.snils OR (a.name = b.name AND a.name <> '')) t WHERE reason IS NOT NULL),
firsts AS (SELECT doc_id, min(row_id) AS first_row, arg_min(reason, row_id) AS first_reason FROM hits GROUP BY doc_id)
SELECT f.doc_id, first_row, first_reason, j.filename AS row_filename, j.child_fio AS row_child_fio, j.birth_date AS row_birth_date, j.snils AS row_snils_text
FROM firsts f JOIN fx_applications j ON j.doc_id = f.first_row""")
def c2_matched_rows(spark, sf):
    """The journal's first matching row: its number, name, birth date, number of insurance, file."""
    applications = derived(spark, sf, "fx_applications")
    keys = duplicates.application_keys(applications)
    journal = duplicates.application_keys(applications).join(
        applications.select("doc_id", "child_fio", "birth_date", c("snils").alias("snils_text")), "doc_id")
    incoming = keys.select(
        "doc_id", F.when(c("doc_id") % 3 != 0, c("snils")).alias("snils"), "name",
        F.when(c("doc_id") % 4 == 0, "").otherwise(c("birth")).alias("birth"))
    found = duplicates.journal_duplicates(incoming, journal, details=("filename", "child_fio", "birth_date", "snils_text"))
    return found.drop("n_snils", "n_name_birth", "n_name")


@query("c1_matches", f"""
WITH {_PAIRS} SELECT p.doc_id, prev AS "index", filename AS duplicate_of, reason FROM pairs p WHERE p.doc_id IN (SELECT doc_id FROM labels)""")
def c1_matches(spark, sf):
    """Every earlier match of the records that have labels."""
    keys = duplicates.application_keys(derived(spark, sf, "fx_applications"))
    chosen = keys.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return duplicates.matches_of(chosen, keys)


@query("c12_duplicate_annotation", f"""
WITH keys AS (SELECT doc_id, filename, CASE WHEN length({D.digits('snils')}) = 11 THEN {D.digits('snils')} END AS snils,
  {D.header('child_fio')} AS name, {D.digits(D.format_date('birth_date'))} AS birth FROM fx_applications WHERE NOT contains(phone, '[')),
pairs AS (SELECT a.doc_id FROM keys a JOIN keys b ON b.doc_id < a.doc_id AND (coalesce(a.snils = b.snils, false) OR (a.name = b.name AND a.name <> '' AND (a.birth = b.birth OR a.birth = '' OR b.birth = ''))))
SELECT a.doc_id, (SELECT count(*) FROM pairs p WHERE p.doc_id = a.doc_id) AS n_duplicates FROM fx_applications a""")
def c12_duplicate_annotation(spark, sf):
    items = derived(spark, sf, "fx_applications")
    done = items.filter(~F.contains("phone", F.lit("[")))
    found = duplicates.batch_duplicates(duplicates.application_keys(done))
    return duplicates.annotate(items.select("doc_id"), found).select("doc_id", "n_duplicates")


@query("d16_job_duplicates", f"""
WITH {_PAIRS} SELECT i.job_id, count(f.doc_id) AS duplicates FROM fx_items i LEFT JOIN found f ON f.doc_id = i.idx GROUP BY i.job_id""")
def d16_job_duplicates(spark, sf):
    """How many of a job's records repeat an earlier one."""
    found = duplicates.batch_duplicates(duplicates.application_keys(derived(spark, sf, "fx_applications")))
    return activity.job_duplicates(derived(spark, sf, "fx_items"), found)


@query("b5_review_status", f"""
WITH {_PAIRS} SELECT a.doc_id, CASE WHEN reviewer_confirmed AND f.doc_id IS NOT NULL THEN '{S.STATUS_VERIFIED_DUP}' WHEN reviewer_confirmed THEN '{S.STATUS_VERIFIED}'
  WHEN f.doc_id IS NOT NULL THEN '{S.STATUS_DUP}' ELSE '{S.STATUS_REVIEW}' END AS review_status
FROM fx_applications a LEFT JOIN found f ON a.doc_id = f.doc_id""")
def b5_review_status(spark, sf):
    return reviewed_applications(spark, sf).select("doc_id", "review_status")


@query("review_status_summary", f"""
WITH {_PAIRS} SELECT CASE WHEN reviewer_confirmed AND f.doc_id IS NOT NULL THEN '{S.STATUS_VERIFIED_DUP}' WHEN reviewer_confirmed THEN '{S.STATUS_VERIFIED}'
  WHEN f.doc_id IS NOT NULL THEN '{S.STATUS_DUP}' ELSE '{S.STATUS_REVIEW}' END AS review_status, count(*) AS applications,
  CAST(sum(coalesce(n_snils + n_name_birth + n_name, 0)) AS bigint) AS duplicate_links
FROM fx_applications a LEFT JOIN found f ON a.doc_id = f.doc_id GROUP BY 1""")
def review_status_summary(spark, sf):
    return status_summary(spark, sf)


@query("e4_group_original", f"""
WITH {_KEYS} SELECT doc_id, snils, min(doc_id) OVER (PARTITION BY snils) AS original FROM keys WHERE snils IS NOT NULL""")
def e4_group_original(spark, sf):
    return duplicates.originals(duplicates.application_keys(derived(spark, sf, "fx_applications")), "snils")


@query("c9_header_match", f"""
WITH cols AS (SELECT generate_subscripts(l, 1) AS ord, unnest(l) AS col FROM (SELECT {str(S.JOURNAL_COLUMNS)} AS l) t),
names AS (SELECT DISTINCT key FROM fx_raw),
tiers AS (SELECT n.key, c.col, CASE WHEN n.key = c.col THEN 1 WHEN {D.header('n.key')} = {D.header('c.col')} THEN 2
   WHEN ({D.header_group('n.key')}) = ({D.header_group('c.col')}) THEN 3 END AS tier, c.ord FROM names n, cols c),
best AS (SELECT key, arg_min(col, tier * 100 + ord) AS col FROM tiers WHERE tier IS NOT NULL GROUP BY key)
SELECT names.key, best.col AS matched FROM names LEFT JOIN best USING (key)""")
def c9_header_match(spark, sf):
    keys = derived(spark, sf, "fx_raw").select("key").distinct()
    return keys.select("key", canon.match_header(S.JOURNAL_COLUMNS, c("key")).alias("matched"))


def _wide(spark, sf):
    """Applications as a small journal with four columns."""
    return derived(spark, sf, "fx_applications").select(
        c("doc_id").cast("string").alias(S.ROW_NUMBER), c("child_fio").alias(S.CHILD_FIO),
        c("phone").alias(S.PHONE), c("filename").alias(S.SOURCE_FILE),
    )


_CELL = "CASE WHEN {x}[1] IN ('=', '+', '-', '@') THEN '''' || {x} ELSE {x} END"


@query("f1_evolving_append", f"""
SELECT CAST(doc_id AS varchar) AS "{S.ROW_NUMBER}", child_fio AS "{S.CHILD_FIO}", phone AS "{S.PHONE}", NULL AS "Предметы на выбор", filename AS "{S.SOURCE_FILE}" FROM fx_applications
UNION ALL SELECT CAST((SELECT count(*) FROM fx_applications) + row_number() OVER (ORDER BY doc_id) AS varchar), trim(parent_fio), {_CELL.format(x='trim(phone)')}, {_CELL.format(x='trim(notes)')}, filename FROM fx_applications""")
def f1_evolving_append(spark, sf):
    incoming = derived(spark, sf, "fx_applications").select(
        "doc_id", c("parent_fio").alias("ФИО ребенка"), c("phone").alias("Телефон для связи"),
        c("notes").alias("Предметы на выбор"), c("filename").alias("Файл"),
    )
    return journal.append_records(_wide(spark, sf), incoming, "doc_id")


def _long_records(spark, sf):
    formatted = derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.auto_format(c("field"), c("value")).alias("value")
    )
    service = derived(spark, sf, "fx_applications").select(
        "doc_id",
        F.inline(F.array(
            F.struct(F.lit(S.SOURCE_FILE).alias("field"), c("filename").alias("value")),
            F.struct(F.lit(S.REVIEW_STATUS).alias("field"),
                     canon.review_status(c("reviewer_confirmed"), F.lit(False)).alias("value")),
        )),
    )
    return formatted.unionByName(service)


def _duck_export() -> str:
    cells = []
    for i, name in enumerate(S.BUSINESS_FIELDS):
        column = ["application_date", "child_fio", "birth_date", "profile", "parent_fio", "passport", "address", "phone", "snils", "notes"][i]
        cells.append(f'(SELECT {_CELL.format(x="v")} FROM (SELECT trim({D.auto_format(D.lit(name), column)}) AS v) z) AS "{name}"')
    return ", ".join(cells)


@query("a8_journal_export", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS "{S.ROW_NUMBER}", {_duck_export()}, filename AS "{S.SOURCE_FILE}",
  CASE WHEN reviewer_confirmed THEN '{S.STATUS_VERIFIED}' ELSE '{S.STATUS_REVIEW}' END AS "{S.REVIEW_STATUS}" FROM fx_applications""")
def a8_journal_export(spark, sf):
    return journal.export_records(_long_records(spark, sf))


@query("e1_row_numbers", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no FROM fx_applications")
def e1_row_numbers(spark, sf):
    return ranking.number_by_id(derived(spark, sf, "fx_applications").select("doc_id"), "doc_id")


@query("c10_journal_delete", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no FROM fx_applications WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def c10_journal_delete(spark, sf):
    rows = derived(spark, sf, "fx_applications").select("doc_id")
    return journal.delete_rows(rows, table(spark, sf, "labels"), "doc_id")


@query("c11_journal_update", f"""
SELECT a.doc_id, child_fio AS "{S.CHILD_FIO}", CASE WHEN l.doc_id IS NOT NULL THEN 'Проверено ' || CAST(l.quality AS varchar) ELSE '' END AS "{S.REVIEW_STATUS}"
FROM fx_applications a LEFT JOIN labels l ON a.doc_id = l.doc_id""")
def c11_journal_update(spark, sf):
    rows = derived(spark, sf, "fx_applications").select(
        "doc_id", c("child_fio").alias(S.CHILD_FIO), F.lit("").alias(S.REVIEW_STATUS)
    )
    label = F.concat(F.lit("Проверено "), c("quality").cast("string"))
    updates = table(spark, sf, "labels").select("doc_id", F.create_map(F.lit(S.REVIEW_STATUS), label).alias("changes"))
    return journal.update_rows(rows, updates, "doc_id")


def _status_rows(spark, sf):
    df = derived(spark, sf, "fx_applications")
    status = canon.review_status(c("reviewer_confirmed"), F.lit(False))
    return df.select("profile", status.alias("status"))


@query("d14_journal_summary", """
WITH top AS (SELECT upper(profile) AS p, count(*) AS n FROM fx_applications GROUP BY 1)
SELECT count(*) AS total_count, count(*) FILTER (WHERE reviewer_confirmed) AS verified_count, count(*) FILTER (WHERE NOT reviewer_confirmed) AS pending_count,
  (SELECT count(*) FROM top) AS class_count, (SELECT p FROM top ORDER BY n DESC, p DESC LIMIT 1) AS top_profile,
  CAST(floor(100.0 * (SELECT max(n) FROM top) / count(*)) AS bigint) AS top_profile_pct FROM fx_applications""")
def d14_journal_summary(spark, sf):
    return journal.summary(_status_rows(spark, sf), "profile", "status")


@query("d14_class_distribution", "SELECT upper(profile) AS class_name, count(*) AS n FROM fx_applications GROUP BY 1")
def d14_class_distribution(spark, sf):
    return journal.class_distribution(_status_rows(spark, sf), "profile")


# --- whole flows --------------------------------------------------------------------------


@query("flow_answer_records", f"""
WITH truth AS (SELECT doc_id, regexp_extract(raw || ' ' || thinking, '"child_fio": "(\\w+)"', 1) AS fio, regexp_extract(raw || ' ' || thinking, '"phone": "(\\d+)', 1) AS phone FROM fx_responses)
SELECT doc_id, '{S.CHILD_FIO}' AS field, {D.format_fio('fio')} AS value FROM truth WHERE fio <> ''
UNION ALL SELECT doc_id, '{S.PHONE}', {D.format_phone('phone')} FROM truth WHERE fio <> ''""")
def flow_answer_records(spark, sf):
    return answer_records(derived(spark, sf, "fx_responses"))


@query("flow_batch_journal", f"""
WITH {_PAIRS} SELECT a.doc_id, row_number() OVER (ORDER BY a.doc_id) AS "{S.ROW_NUMBER}", {_duck_export()}, a.filename AS "{S.SOURCE_FILE}",
  CASE WHEN reviewer_confirmed AND f.doc_id IS NOT NULL THEN '{S.STATUS_VERIFIED_DUP}' WHEN reviewer_confirmed THEN '{S.STATUS_VERIFIED}'
  WHEN f.doc_id IS NOT NULL THEN '{S.STATUS_DUP}' ELSE '{S.STATUS_REVIEW}' END AS "{S.REVIEW_STATUS}"
FROM fx_applications a LEFT JOIN found f ON a.doc_id = f.doc_id""")
def flow_batch_journal(spark, sf):
    formatted = derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.auto_format(c("field"), c("value")).alias("value")
    )
    return batch_journal(formatted, reviewed_applications(spark, sf))


@query("flow_checked_records")
def flow_checked_records(spark, sf):
    from formsift.plans.dictionary_queries import _corrections, _entries

    records = derived(spark, sf, "fx_fields").withColumns(
        {"verified": c("status") == "read", "alternative": F.lit("")}
    )
    return checked_records(records, _entries(spark, sf), _corrections(spark, sf))
