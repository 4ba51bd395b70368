"""Queries over single values: validation, formatting, predicates, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import dates, errors, fields, ids, metrics, names, text
from formsift.operators import canon
from formsift.plans import duck as D
from formsift.plans.registry import query
from formsift.sources.fixtures import derived, table

c = F.col


@query("g1_snils", f"""
SELECT doc_id, {D.snils_valid('snils')} AS valid, {D.snils_format('snils')} AS formatted,
  CASE WHEN snils = '' THEN '{ids.SNILS_MISSING}'
       WHEN length({D.digits('snils')}) <> 11 THEN replace('{ids.SNILS_BAD_LENGTH}', '%s', CAST(length({D.digits('snils')}) AS varchar))
       WHEN {D.digits('snils')}[1:9] <= '001001998' THEN '{ids.SNILS_UNCHECKED}'
       WHEN {D.snils_valid('snils')} THEN '{ids.SNILS_GENUINE}'
       ELSE 'Ошибка контрольной суммы: ожидалось ' || {D.snils_control(D.digits('snils'))} || ', указано ' || {D.digits('snils')}[10:11] END AS message
FROM fx_applications""")
def g1_snils(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", ids.snils_valid(c("snils")).alias("valid"),
        ids.snils_format(c("snils")).alias("formatted"),
        ids.snils_message(c("snils")).alias("message"),
    )


@query("g2_format_phone", f"SELECT doc_id, {D.format_phone('phone')} AS formatted FROM fx_applications")
def g2_format_phone(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", ids.format_phone(c("phone")).alias("formatted")
    )


@query("g3_parse_date", f"""
SELECT doc_id, strftime({D.parse_date('birth_date')}, '%Y-%m-%d') AS parsed FROM fx_applications""")
def g3_parse_date(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", dates.parse_date(c("birth_date")).cast("string").alias("parsed")
    )


@query("g4_format_date", f"SELECT doc_id, {D.format_date('birth_date')} AS formatted FROM fx_applications")
def g4_format_date(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", dates.format_date(c("birth_date")).alias("formatted")
    )


@query("g5_cross_verify_dates", """
SELECT doc_id, CASE WHEN b = '' OR t = b THEN t WHEN t = '' THEN b
  WHEN t[1:2] = b[1:2] AND t[7:10] = b[7:10] AND ((t[4:5] IN ('04', '07') AND b[4:5] IN ('04', '07'))
    OR (t[4:5] IN ('01', '07') AND b[4:5] IN ('01', '07'))) THEN b
  WHEN t[7:10] = b[7:10] AND t[4:5] = '04' AND b[4:5] = '07' THEN t[1:2] || '.07.' || t[7:10]
  ELSE t END AS settled
FROM (SELECT doc_id, application_date AS t, signature_date AS b FROM fx_applications) s""")
def g5_cross_verify_dates(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id",
        dates.cross_verify_dates(c("application_date"), c("signature_date")).alias("settled"),
    )


@query("g6_format_fio", f"SELECT doc_id, {D.format_fio('child_fio')} AS formatted FROM fx_applications")
def g6_format_fio(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", names.format_fio(c("child_fio")).alias("formatted")
    )


@query("g7_toggle_fio_case", f"""
SELECT doc_id, CASE WHEN upper(v) = v AND lower(v) <> v THEN {D.format_fio('v')} ELSE upper(v) END AS toggled
FROM (SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 THEN upper(child_fio) ELSE child_fio END) AS v FROM fx_applications) s""")
def g7_toggle_fio_case(spark, sf):
    df = derived(spark, sf, "fx_applications")
    name = F.when(c("doc_id") % 2 == 0, F.upper("child_fio")).otherwise(c("child_fio"))
    return df.select("doc_id", names.toggle_fio_case(name).alias("toggled"))


@query("g8_levenshtein", f"""
SELECT case_id, field, CAST({D.edit_distance(D.metric_norm('reference'), D.metric_norm('predicted'))} AS int) AS distance FROM fx_eval""")
def g8_levenshtein(spark, sf):
    return derived(spark, sf, "fx_eval").select(
        "case_id", "field",
        F.levenshtein(text.metric_norm(c("reference")), text.metric_norm(c("predicted"))).alias("distance"),
    )


_PATRONYMIC_WORDS = "SELECT patronymic AS w FROM fx_person UNION ALL SELECT surname FROM fx_person"


@query("g9_correct_patronymic", f"""
WITH {D.patronymic_ctes('SELECT patronymic AS w FROM fx_person')}
SELECT doc_id, fixed_word AS corrected, {D.fold('fixed_word')} <> {D.fold('patronymic')} AS changed
FROM fx_person JOIN fixed ON word = patronymic""")
def g9_correct_patronymic(spark, sf):
    fixed = names.correct_patronymic(c("patronymic"))
    return derived(spark, sf, "fx_person").select(
        "doc_id", fixed.alias("corrected"),
        (text.fold(fixed) != text.fold(c("patronymic"))).alias("changed"),
    )


@query("g10_correct_fio", f"""
WITH {D.patronymic_ctes("SELECT string_split(" + D.squeeze('child_fio') + ", ' ')[3] AS w FROM fx_applications")}
SELECT doc_id, {D.format_fio("w[1] || ' ' || w[2]")} || ' ' || fixed_word AS corrected
FROM (SELECT doc_id, string_split({D.squeeze('child_fio')}, ' ') AS w FROM fx_applications) s JOIN fixed ON word = w[3]""")
def g10_correct_fio(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", names.correct_fio(c("child_fio")).alias("corrected")
    )


@query("g11_format_passport", f"""
SELECT doc_id, {D.format_passport('passport')} AS formatted, true AS valid, {D.passport_message('passport')} AS message FROM fx_applications""")
def g11_format_passport(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", ids.format_passport(c("passport")).alias("formatted"),
        ids.passport_valid(c("passport")).alias("valid"),
        ids.passport_message(c("passport")).alias("message"),
    )


@query("g12_normalize_address", f"SELECT doc_id, {D.normalize_address('address')} AS normalized FROM fx_applications")
def g12_normalize_address(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", text.normalize_address(c("address")).alias("normalized")
    )


@query("g13_normalize_notes", f"SELECT doc_id, {D.normalize_notes('notes')} AS normalized FROM fx_applications")
def g13_normalize_notes(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", text.normalize_notes(c("notes")).alias("normalized")
    )


@query("g14_normalize_profile", f"SELECT doc_id, {D.normalize_profile('profile')} AS normalized FROM fx_applications")
def g14_normalize_profile(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", text.normalize_profile(c("profile")).alias("normalized")
    )


@query("g15_auto_format", f"SELECT doc_id, field, {D.auto_format('field', 'value')} AS formatted FROM fx_fields")
def g15_auto_format(spark, sf):
    return derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.auto_format(c("field"), c("value")).alias("formatted")
    )


@query("g16_extract_surname", f"SELECT doc_id, {D.words('child_fio')}[1] AS surname FROM fx_applications")
def g16_extract_surname(spark, sf):
    return derived(spark, sf, "fx_applications").select(
        "doc_id", names.extract_surname(c("child_fio")).alias("surname")
    )


def _duck_root(x: str) -> str:
    return (
        f"CASE WHEN {D.ends_any(x, names.SURNAME_ENDINGS_DROP_ONE)} AND length({x}) > 5 THEN {x}[1:length({x})-1] "
        f"WHEN {D.ends_any(x, names.SURNAME_ENDINGS_DROP_TWO)} AND length({x}) > 6 THEN {x}[1:length({x})-2] ELSE {x} END"
    )


@query("g17_surnames_match", f"""
SELECT doc_id, a = '' OR b = '' OR {_duck_root('a')} = {_duck_root('b')} AS matching,
  CASE WHEN a = '' OR b = '' THEN '{names.SURNAMES_INCOMPLETE}' WHEN a = b THEN '{names.SURNAMES_EQUAL}'
       WHEN {_duck_root('a')} = {_duck_root('b')} THEN '{names.SURNAMES_EQUAL_ROOT}'
       ELSE 'Фамилия ребенка (' || sa || ') отличается от фамилии родителя (' || sb || ')' END AS message
FROM (SELECT *, lower(sa) AS a, lower(sb) AS b FROM (SELECT doc_id, string_split({D.squeeze('child_fio')}, ' ')[1] AS sa,
   string_split({D.squeeze('parent_fio')}, ' ')[1] AS sb FROM fx_applications) s0) s""")
def g17_surnames_match(spark, sf):
    child, parent = c("child_fio"), c("parent_fio")
    return derived(spark, sf, "fx_applications").select(
        "doc_id", names.surnames_match(child, parent).alias("matching"),
        names.surnames_message(child, parent).alias("message"),
    )


@query("g18_surname_suggestion", f"""
SELECT doc_id, sa || substr(p, length(sb) + 1) AS suggestion
FROM (SELECT *, string_split(child, ' ')[1] AS sa, string_split(p, ' ')[1] AS sb
      FROM (SELECT doc_id, {D.squeeze('child_fio')} AS child, {D.squeeze('parent_fio')} AS p FROM fx_applications) s0) s
WHERE length(sa) = length(sb) AND lower(sa) <> lower(sb)
  AND list_sum(list_transform(range(1, length(sa) + 1), lambda i: CASE WHEN lower(sa)[i] <> lower(sb)[i] THEN 1 ELSE 0 END)) = 1""")
def g18_surname_suggestion(spark, sf):
    suggestion = names.surname_suggestion(c("child_fio"), c("parent_fio"))
    return (
        derived(spark, sf, "fx_applications")
        .select("doc_id", suggestion.alias("suggestion"))
        .filter(c("suggestion").isNotNull())
    )


@query("g19_normalize_header", f"SELECT doc_id, key_ord, {D.header('key')} AS normalized FROM fx_raw")
def g19_normalize_header(spark, sf):
    return derived(spark, sf, "fx_raw").select(
        "doc_id", "key_ord", text.normalize_header(c("key")).alias("normalized")
    )


@query("g20_safe_cell", f"""
SELECT doc_id, CASE WHEN v[1] IN ('=', '+', '-', '@', chr(9)) THEN '''' || v ELSE v END AS cell
FROM (SELECT doc_id, {D.strip("replace(replace(text, chr(13), ' '), chr(10), ' ')")} AS v FROM documents
      UNION ALL SELECT doc_id, {D.strip('phone')} FROM fx_applications) s""")
def g20_safe_cell(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", c("text").alias("v"))
    phones = derived(spark, sf, "fx_applications").select("doc_id", c("phone").alias("v"))
    return docs.unionByName(phones).select("doc_id", text.safe_cell(c("v")).alias("cell"))


@query("g21_digits_only", "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def g21_digits_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.digits_only(c("text")).alias("digits"))


@query("g22_comparison_value", f"SELECT doc_id, field, {D.comparison('field', 'value')} AS cmp FROM fx_fields")
def g22_comparison_value(spark, sf):
    return derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.comparison_value(c("field"), c("value")).alias("cmp")
    )


@query("g23_structurally_valid", f"SELECT doc_id, field, {D.valid('field', 'value')} AS valid FROM fx_fields")
def g23_structurally_valid(spark, sf):
    return derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.structurally_valid(c("field"), c("value")).alias("valid")
    )


@query("g24_candidate_value", f"""
SELECT doc_id, field, view_no, {D.candidate('value', 'status', 'error')} AS candidate FROM fx_readings""")
def g24_candidate_value(spark, sf):
    return derived(spark, sf, "fx_readings").select(
        "doc_id", "field", "view_no",
        fields.candidate_value(c("value"), c("status"), c("error")).alias("candidate"),
    )


@query("g25_metric_value", f"""
SELECT case_id, field, {D.metric_value('field', 'reference')} AS expected, {D.metric_value('field', 'predicted')} AS predicted FROM fx_eval""")
def g25_metric_value(spark, sf):
    return derived(spark, sf, "fx_eval").select(
        "case_id", "field",
        fields.metric_value(c("field"), c("reference")).alias("expected"),
        fields.metric_value(c("field"), c("predicted")).alias("predicted"),
    )


DUCK_RATES = f"""
normed AS (SELECT *, {D.metric_value('field', 'reference')} AS r, {D.metric_value('field', 'predicted')} AS p FROM fx_eval),
tokens AS (SELECT *, {D.words('r')} AS rw, {D.words('p')} AS pw FROM normed),
seen AS (SELECT *, list_distinct(list_concat(rw, pw)) AS toks FROM tokens),
rated AS (SELECT case_id, field, r, p, status, verified, audit_status, audit_reason, attempted, completed,
  {D.edit_distance('r', 'p')} / greatest(length(r), 1) AS cer,
  levenshtein(array_to_string(list_transform(rw, lambda w: chr(64 + CAST(list_position(toks, w) AS int))), ''),
              array_to_string(list_transform(pw, lambda w: chr(64 + CAST(list_position(toks, w) AS int))), '')) / greatest(len(rw), 1) AS wer,
  r = p AS exact, verified AND status = 'read' AS confirmed FROM seen)"""


@query("g26_cer_wer", f"""
WITH {DUCK_RATES} SELECT case_id, field, round(cer, 6) AS cer, round(wer, 6) AS wer FROM rated""")
def g26_cer_wer(spark, sf):
    normed = derived(spark, sf, "fx_eval").select(
        "case_id", "field",
        fields.metric_value(c("field"), c("reference")).alias("r"),
        fields.metric_value(c("field"), c("predicted")).alias("p"),
    )
    return normed.select(
        "case_id", "field", F.round(metrics.cer(c("r"), c("p")), 6).alias("cer"),
        F.round(metrics.wer(c("r"), c("p")), 6).alias("wer"),
    )


@query("g27_dict_norm", f"SELECT doc_id, {D.squeeze(D.fold('text'))} AS normalized FROM documents")
def g27_dict_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.dict_norm(c("text")).alias("normalized"))


@query("g28_friendly_error", f"""
SELECT idx, CASE WHEN contains(coalesce(error_text, ''), '61') OR contains(lower(coalesce(error_text, '')), 'connection refused')
     OR contains(lower(coalesce(error_text, '')), 'connecterror') THEN '{errors.CONNECTION_REFUSED}'
   WHEN error_type IN ('ValueError', 'RuntimeError') THEN coalesce(nullif(error_text, ''), '{errors.UNKNOWN_ERROR}')
   ELSE '{errors.INTERNAL_ERROR}' END AS message FROM fx_items WHERE status = 'error'""")
def g28_friendly_error(spark, sf):
    return (
        derived(spark, sf, "fx_items").filter(c("status") == "error")
        .select("idx", errors.friendly_error(c("error_type"), c("error_text")).alias("message"))
    )


# --- predicates and projections -----------------------------------------------------------


@query("b1_target_fields", """
SELECT doc_id, key_ord, key FROM fx_raw WHERE NOT starts_with(key, '№') AND key NOT IN ('Имя файла источника', 'Статус проверки')""")
def b1_target_fields(spark, sf):
    return canon.target_fields(derived(spark, sf, "fx_raw")).select("doc_id", "key_ord", "key")


def _duck_alias(target: str) -> str:
    hit = D.has_any("lower(key)", S.ALIAS_RULES[target])
    if target in S.ALIAS_EXCLUSIONS:
        hit += f" AND NOT {D.has_any('lower(key)', S.ALIAS_EXCLUSIONS[target])}"
    if "ФИО" in target:
        hit += " AND NOT regexp_matches(value, '[0-9]')"
    return hit


_ENGLISH = "CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ENGLISH_KEYS.items()) + " END"
_TARGET_RULE = " OR ".join(f"(target = '{t}' AND {_duck_alias(t)})" for t in S.ALIAS_RULES)


@query("b2_canonical_fields", f"""
WITH raw AS (SELECT *, {_ENGLISH} AS russian FROM fx_raw),
named AS (SELECT doc_id, CASE WHEN russian IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.doc_id = raw.doc_id AND o.key = raw.russian)
    THEN russian ELSE key END AS key, key_ord AS ord, value FROM raw),
targets AS (SELECT DISTINCT doc_id, unnest({str(list(S.ALIAS_RULES))}) AS target FROM fx_raw),
own AS (SELECT t.doc_id, t.target, max(trim(n.value)) AS value FROM targets t LEFT JOIN named n ON n.doc_id = t.doc_id AND n.key = t.target GROUP BY ALL),
hits AS (SELECT t.doc_id, t.target, arg_min(trim(n.value), n.ord) AS value FROM targets t JOIN named n ON n.doc_id = t.doc_id
   WHERE n.key <> t.target AND trim(n.value) <> '' AND ({_TARGET_RULE}) GROUP BY ALL)
SELECT own.doc_id, own.target AS field, coalesce(nullif(own.value, ''), hits.value, own.value) AS value
FROM own LEFT JOIN hits ON own.doc_id = hits.doc_id AND own.target = hits.target""")
def b2_canonical_fields(spark, sf):
    return canon.canonical_fields(derived(spark, sf, "fx_raw"))


@query("b3_strip_internal_keys", "SELECT doc_id, key, value FROM fx_raw WHERE key[1] <> '_'")
def b3_strip_internal_keys(spark, sf):
    return canon.strip_internal(derived(spark, sf, "fx_raw")).select("doc_id", "key", "value")


@query("b4_needs_review", f"""
SELECT doc_id, field, {D.needs_review('field', 'value', 'status')} AS flagged FROM fx_fields""")
def b4_needs_review(spark, sf):
    return derived(spark, sf, "fx_fields").select(
        "doc_id", "field", fields.needs_review(c("field"), c("value"), c("status")).alias("flagged")
    )


@query("b4_warning_count", f"""
SELECT doc_id, CAST(count(*) FILTER (WHERE {D.needs_review('field', 'value', 'status')}) AS bigint) AS warnings FROM fx_fields GROUP BY doc_id""")
def b4_warning_count(spark, sf):
    return canon.warning_count(derived(spark, sf, "fx_fields"))


@query("b6_unclear_filter", """
SELECT doc_id, page_no, field, contains(value, '[') AS unclear, value[1] = '[' AS page_unclear FROM fx_page_values WHERE trim(value) <> ''""")
def b6_unclear_filter(spark, sf):
    return (
        derived(spark, sf, "fx_page_values").filter(~text.is_blank(c("value")))
        .select("doc_id", "page_no", "field", text.is_unclear(c("value")).alias("unclear"),
                text.starts_unclear(c("value")).alias("page_unclear"))
    )


_ROUTING_INPUT = {
    "mode": "CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'paddle' ELSE 'vlm' END",
    "explicit_reason": "CASE WHEN doc_id % 10 = 7 THEN 'multipage_disabled' ELSE '' END",
    "assist": "doc_id % 11 <> 5",
    "image": "doc_id % 13 <> 6",
    "detector": "doc_id % 17 <> 8",
    "locator_failed": "doc_id % 19 = 3",
    "located": "(doc_id + field_ord) % 4 <> 0 AND doc_id % 19 <> 3",
}
_ROUTING_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in _ROUTING_INPUT.items())


@query("b7_verification_routing", f"""
SELECT doc_id, field, CASE WHEN explicit_reason <> '' THEN explicit_reason WHEN mode = 'vlm' THEN 'mode_disabled'
   WHEN NOT assist THEN 'assist_disabled' WHEN NOT image THEN 'image_unavailable' WHEN NOT detector THEN 'paddle_unavailable'
   WHEN mode = 'auto' AND field NOT IN {D.in_list(S.CRITICAL_FIELDS)} THEN 'field_not_selected'
   WHEN locator_failed THEN 'locator_error' WHEN NOT located THEN 'region_not_found' ELSE '' END AS reason
FROM (SELECT doc_id, field, {_ROUTING_COLUMNS} FROM fx_fields) s""")
def b7_verification_routing(spark, sf):
    df = derived(spark, sf, "fx_fields").selectExpr(
        "doc_id", "field", *[f"{sql} AS {name}" for name, sql in _ROUTING_INPUT.items()]
    )
    reason = canon.skip_reason(
        c("field"), c("mode"), c("explicit_reason"), c("assist"), c("image"), c("detector"),
        c("locator_failed"), c("located"),
    )
    return df.select("doc_id", "field", reason.alias("reason"))


@query("b8_pii_safe_log", "SELECT id, ts, username, action, ok, elapsed_ms, model, backend FROM fx_activity")
def b8_pii_safe_log(spark, sf):
    df = derived(spark, sf, "fx_activity").withColumns(
        {S.CHILD_FIO: c("username"), "filename": c("action")}
    )
    return canon.pii_safe(df)


@query("b9_mask_secret", """
SELECT c_custkey, CASE WHEN length(s) <= 4 THEN repeat('*', length(s)) ELSE s[1:2] || '…' || right(s, 1) END AS masked
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN left(c_name, 4) ELSE c_name END AS s FROM customer) q""")
def b9_mask_secret(spark, sf):
    key = (
        F.when(c("c_custkey") % 5 == 0, "").when(c("c_custkey") % 5 == 1, F.left("c_name", F.lit(4)))
        .otherwise(c("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", text.mask_secret(key).alias("masked"))


_GROUP_OF = "CASE " + " ".join(
    f"WHEN field IN {D.in_list(v)} THEN '{k}'" for k, v in S.FIELD_GROUPS.items()
) + " END"


@query("b13_review_groups", f"""
SELECT doc_id, field, {_GROUP_OF} AS field_group FROM fx_fields WHERE {D.needs_review('field', 'value', 'status')}""")
def b13_review_groups(spark, sf):
    return canon.review_groups(derived(spark, sf, "fx_fields"), only_flagged=True).select(
        "doc_id", "field", "field_group"
    )
