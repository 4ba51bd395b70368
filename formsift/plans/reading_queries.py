"""Queries over several readings of a field and over the pages of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import text
from formsift.operators import pages, reconcile, responses
from formsift.plans import duck as D
from formsift.plans import field_queries  # noqa: F401  registers a body used below
from formsift.plans.flows import finish_records
from formsift.plans.registry import BODIES, QUERIES, query
from formsift.sources.fixtures import derived

c = F.col

_SHAPE = (
    f"CASE WHEN contains(lower(field), 'дата') THEN regexp_full_match({D.format_date('cand')}, '\\d\\d\\.\\d\\d\\.\\d{{4}}') "
    "ELSE regexp_full_match(cand, '[0-9\\s+().№—–-]+') END"
)
_LENGTH = "CASE WHEN contains(lower(field), 'дата') THEN 8 WHEN contains(lower(field), 'снилс') THEN 11 ELSE 10 END"

# Views, groups, votes and the page as separate tables; the checks join them.
_VOTES = f"""
views AS (SELECT *, {D.comparison('field', 'cand')} AS cmp FROM (
  SELECT doc_id, field, view_no, {D.candidate('value', 'status', 'error')} AS cand FROM fx_readings WHERE kind = 'view') v WHERE cand <> ''),
docs AS (SELECT DISTINCT doc_id, field FROM fx_readings),
page AS (SELECT doc_id, field, {D.strip('value')} AS page, {D.comparison('field', 'value')} AS page_cmp, {D.valid('field', 'value')} AS page_valid
  FROM fx_readings WHERE kind = 'page'),
grp AS (SELECT doc_id, field, cmp, count(*) AS n, arg_min(cand, view_no) AS txt, min(view_no) AS fv FROM views WHERE cmp <> '' GROUP BY ALL),
used AS (SELECT doc_id, field, count(*) AS usable FROM views GROUP BY ALL),
eligible AS (SELECT doc_id, field, count(*) AS usable FROM views GROUP BY doc_id, field
  HAVING count(*) >= 2 AND bool_and({_SHAPE}) AND min(length(cmp)) = max(length(cmp)) AND bool_and(length(cmp) = {_LENGTH})),
cells AS (SELECT doc_id, field, pos, cmp[pos] AS digit, usable, count(*) AS k
  FROM (SELECT v.doc_id, v.field, v.cmp, e.usable, unnest(range(1, length(v.cmp) + 1)) AS pos FROM views v JOIN eligible e USING (doc_id, field)) t GROUP BY ALL),
leaders AS (SELECT *, k >= 2 AND k * 2 > usable AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field, pos ORDER BY k DESC, digit) AS rn FROM cells) t WHERE rn = 1),
vote AS (SELECT doc_id, field, string_agg(CASE WHEN NOT accepted THEN CAST(pos AS varchar) END, ',' ORDER BY pos) AS unresolved,
  bool_and(accepted) AS full_vote, string_agg(digit, '' ORDER BY pos) AS raw FROM leaders GROUP BY ALL),
consensus AS (SELECT doc_id, field, coalesce(unresolved, '') AS unresolved, CASE WHEN NOT full_vote THEN '' ELSE
  {D.auto_format('field', "CASE WHEN contains(lower(field), 'дата') THEN raw[1:2] || '.' || raw[3:4] || '.' || raw[5:8] ELSE raw END")} END AS consensus FROM vote),
best AS (SELECT g.doc_id, g.field, arg_min(txt, fv) AS majority FROM grp g JOIN used u USING (doc_id, field) WHERE g.n >= 2 AND g.n * 2 > u.usable GROUP BY ALL)"""


@query("d2_digit_vote", f"""
WITH {_VOTES} SELECT doc_id, field, unresolved, consensus FROM consensus""")
def d2_digit_vote(spark, sf):
    voted = reconcile.with_digit_vote(reconcile.tally(derived(spark, sf, "fx_readings")))
    return voted.filter("unresolved IS NOT NULL").select(
        "doc_id", "field", F.array_join("unresolved", ",").alias("unresolved"), "consensus"
    )


@query("d3_value_majority", f"""
WITH {_VOTES} SELECT doc_id, field, coalesce(majority, '') AS majority FROM docs LEFT JOIN best USING (doc_id, field)""")
def d3_value_majority(spark, sf):
    t = reconcile.tally(derived(spark, sf, "fx_readings"))
    return t.select("doc_id", "field", reconcile.majority(c("options"), c("usable")).alias("majority"))


@query("d17_distinct_candidates", f"""
WITH {_VOTES} SELECT doc_id, field, coalesce(string_agg(txt, ' | ' ORDER BY fv), '') AS candidates
FROM docs LEFT JOIN grp USING (doc_id, field) GROUP BY ALL""")
def d17_distinct_candidates(spark, sf):
    t = reconcile.tally(derived(spark, sf, "fx_readings"))
    texts = F.transform("options", lambda o: o["text"])
    return t.select("doc_id", "field", F.array_join(texts, " | ").alias("candidates"))


_CHECKSUM = f"""
sums AS (SELECT doc_id, field, count(DISTINCT cmp) AS n, arg_max(txt, ord) AS winner FROM (
    SELECT doc_id, field, cmp, txt, fv AS ord FROM grp WHERE contains(field, 'СНИЛС') AND {D.valid('field', 'txt')}
    UNION ALL SELECT doc_id, field, page_cmp, page, -1 FROM page WHERE contains(field, 'СНИЛС') AND page_valid) t
  GROUP BY ALL HAVING count(DISTINCT cmp) = 1)"""


@query("d18_checksum_winner", f"""
WITH {_VOTES}, {_CHECKSUM} SELECT doc_id, field, winner FROM sums""")
def d18_checksum_winner(spark, sf):
    t = reconcile.tally(derived(spark, sf, "fx_readings"))
    winner = reconcile.checksum_winner(c("page"), c("page_valid"), c("page_cmp"), c("options"), c("field"))
    return t.select("doc_id", "field", winner.alias("winner")).filter("winner IS NOT NULL")


_DECIDED = f"""
joined AS (SELECT d.doc_id, d.field, coalesce(p.page, '') AS page, coalesce(p.page_cmp, '') AS page_cmp, coalesce(p.page_valid, false) AS page_valid,
    s.winner AS by_sum, coalesce(b.majority, '') AS majority, coalesce(k.consensus, '') AS consensus,
    coalesce(nullif(b.majority, ''), k.consensus, '') AS winner
  FROM docs d LEFT JOIN page p USING (doc_id, field) LEFT JOIN sums s USING (doc_id, field)
  LEFT JOIN best b USING (doc_id, field) LEFT JOIN consensus k USING (doc_id, field)),
keyed AS (SELECT *, {D.comparison('field', 'winner')} AS winner_cmp, {D.valid('field', 'winner')} AS winner_valid,
    {D.comparison('field', 'consensus')} AS consensus_cmp FROM joined),
ruled AS (SELECT *, CASE WHEN by_sum IS NOT NULL THEN 'sum' WHEN winner <> '' AND winner_cmp = page_cmp AND winner_valid THEN 'agree'
    WHEN winner <> '' AND NOT page_valid AND winner_valid THEN 'recover' ELSE 'review' END AS rule FROM keyed),
others AS (SELECT r.doc_id, r.field, string_agg(g.txt, ' / ' ORDER BY g.fv) AS texts, bool_or(g.cmp = r.consensus_cmp) AS has_consensus
  FROM ruled r JOIN grp g USING (doc_id, field) WHERE g.cmp <> r.page_cmp GROUP BY ALL),
decided AS (SELECT r.doc_id, r.field, page, page_cmp, page_valid,
    CASE rule WHEN 'sum' THEN by_sum WHEN 'recover' THEN winner ELSE page END AS value,
    CASE rule WHEN 'review' THEN 'needs_review' ELSE 'read' END AS status, rule <> 'review' AS verified,
    CASE WHEN rule <> 'review' THEN '' WHEN consensus <> '' AND consensus_cmp <> page_cmp AND NOT coalesce(has_consensus, false)
      THEN concat_ws(' / ', consensus, texts) ELSE coalesce(texts, '') END AS alternative,
    CASE WHEN rule = 'sum' THEN '{S.NOTE_SNILS_CHECKSUM}' WHEN rule = 'agree' THEN ''
      WHEN rule = 'recover' AND majority = '' THEN '{S.NOTE_DIGIT_MAJORITY}' WHEN rule = 'recover' THEN '{S.NOTE_VALUE_MAJORITY}'
      WHEN winner <> '' AND NOT winner_valid THEN '{S.NOTE_INVALID_WINNER}' ELSE '{S.NOTE_DIFFERENT_READS}' END AS note
  FROM ruled r LEFT JOIN others o USING (doc_id, field))"""


@query("h6_multi_view_merge", f"""
WITH {_VOTES}, {_CHECKSUM}, {_DECIDED} SELECT doc_id, field, value, status, verified, alternative, note FROM decided""")
def h6_multi_view_merge(spark, sf):
    return reconcile.multi_view(derived(spark, sf, "fx_readings")).select(
        "doc_id", "field", "value", "status", "verified", "alternative", "note"
    )


@query("e7_alternatives", f"""
WITH {_VOTES}, {_CHECKSUM}, {_DECIDED} SELECT doc_id, field, alternative FROM decided WHERE status = 'needs_review'""")
def e7_alternatives(spark, sf):
    return (
        reconcile.multi_view(derived(spark, sf, "fx_readings"))
        .filter("status = 'needs_review'").select("doc_id", "field", "alternative")
    )


_RIVALS = f"""
rivals AS (SELECT doc_id, field, page_cmp AS cmp, page AS txt, -1 AS ord FROM page WHERE page <> '' AND NOT contains(page, '[')
  UNION ALL SELECT doc_id, field, cmp, txt, fv FROM grp),
contested AS (SELECT r.doc_id, r.field, max(length(r.cmp)) AS top, min(length(r.cmp)) AS low FROM rivals r JOIN decided d USING (doc_id, field)
  WHERE d.status = 'needs_review' AND r.cmp <> '' GROUP BY ALL HAVING count(DISTINCT r.cmp) >= 2),
spots AS (SELECT doc_id, field, string_agg(CAST(pos AS varchar), ',' ORDER BY pos) AS conflict_positions FROM (
    SELECT r.doc_id, r.field, s.pos FROM rivals r JOIN (SELECT doc_id, field, unnest(range(1, top + 1)) AS pos FROM contested WHERE top = low) s USING (doc_id, field)
    WHERE r.cmp <> '' GROUP BY ALL HAVING count(DISTINCT r.cmp[s.pos]) > 1) t GROUP BY ALL)"""


@query("d19_conflict_positions", f"""
WITH {_VOTES}, {_CHECKSUM}, {_DECIDED}, {_RIVALS}
SELECT doc_id, field, coalesce(conflict_positions, '') AS conflict_positions, top <> low AS length_conflict
FROM contested LEFT JOIN spots USING (doc_id, field)""")
def d19_conflict_positions(spark, sf):
    out = reconcile.adjudicate(reconcile.multi_view(derived(spark, sf, "fx_readings")))
    return out.filter("open_conflict").select(
        "doc_id", "field", F.array_join("conflict_positions", ",").alias("conflict_positions"),
        "length_conflict",
    )


@query("h7_adjudication", f"""
WITH {_VOTES}, {_CHECKSUM}, {_DECIDED}, {_RIVALS},
extra AS (SELECT doc_id, field, {D.candidate('value', 'status', 'error')} AS second, {D.comparison('field', D.candidate('value', 'status', 'error'))} AS second_cmp
  FROM fx_readings WHERE kind = 'adjudication'),
matching AS (SELECT x.doc_id, x.field, arg_min(r.txt, r.ord) AS matched FROM extra x JOIN contested USING (doc_id, field)
  JOIN rivals r ON r.doc_id = x.doc_id AND r.field = x.field AND r.cmp = x.second_cmp GROUP BY ALL),
settled AS (SELECT d.*, q.doc_id IS NOT NULL AS contested, coalesce(x.second, '') AS second, coalesce(m.matched, '') AS matched,
   {D.valid('d.field', "coalesce(m.matched, '')")} AS matched_valid, x.second_cmp
  FROM decided d LEFT JOIN contested q USING (doc_id, field) LEFT JOIN extra x USING (doc_id, field) LEFT JOIN matching m USING (doc_id, field)),
ruled2 AS (SELECT *, CASE WHEN NOT contested THEN 'none' WHEN matched = '' AND second = '' THEN 'none' WHEN matched = '' THEN 'extra'
   WHEN second_cmp = page_cmp AND page_valid THEN 'keep' WHEN NOT page_valid AND matched_valid THEN 'replace' ELSE 'stay' END AS act FROM settled)
SELECT doc_id, field, CASE act WHEN 'replace' THEN matched ELSE value END AS value,
  CASE WHEN act IN ('keep', 'replace') THEN 'read' ELSE status END AS status, verified OR act IN ('keep', 'replace') AS verified,
  CASE act WHEN 'extra' THEN concat_ws(' / ', nullif(alternative, ''), second) ELSE alternative END AS alternative,
  CASE act WHEN 'extra' THEN second WHEN 'stay' THEN matched ELSE '' END AS adjudicated_alternative,
  CASE act WHEN 'keep' THEN '{S.NOTE_ADJUDICATED_KEPT}' WHEN 'replace' THEN '{S.NOTE_ADJUDICATED_NEW}' ELSE note END AS note
FROM ruled2""")
def h7_adjudication(spark, sf):
    out = reconcile.adjudicate(reconcile.multi_view(derived(spark, sf, "fx_readings")))
    return out.select(
        "doc_id", "field", "value", "status", "verified", "alternative", "adjudicated_alternative", "note"
    )


@query("h5_single_crop", f"""
WITH pair AS (SELECT doc_id, field, max(CASE WHEN kind = 'page' THEN {D.strip('value')} END) AS page,
   max(CASE WHEN kind = 'view' AND view_no = 1 THEN {D.candidate('value', 'status', 'error')} END) AS crop FROM fx_readings GROUP BY ALL),
tested AS (SELECT *, {D.comparison('field', 'page')} AS pc, {D.comparison('field', 'crop')} AS cc, {D.valid('field', 'page')} AS pv, {D.valid('field', 'crop')} AS cv FROM pair),
ruled AS (SELECT *, CASE WHEN crop = '' THEN 'none' WHEN pc <> '' AND pc = cc AND pv THEN 'agree' WHEN NOT pv AND cv THEN 'recover' ELSE 'differ' END AS rule FROM tested)
SELECT doc_id, field, CASE rule WHEN 'recover' THEN crop ELSE page END AS value, CASE WHEN rule IN ('agree', 'recover') THEN 'read' ELSE 'needs_review' END AS status,
  rule IN ('agree', 'recover') AS verified, CASE rule WHEN 'differ' THEN crop ELSE '' END AS alternative,
  CASE rule WHEN 'none' THEN '{S.NOTE_CROP_UNREADABLE}' WHEN 'agree' THEN '' WHEN 'recover' THEN '{S.NOTE_CROP_RECOVERED}' ELSE '{S.NOTE_CROP_DIFFERS}' END AS note FROM ruled""")
def h5_single_crop(spark, sf):
    return reconcile.single_crop(derived(spark, sf, "fx_readings"))


@query("h8_verification_audit", """
SELECT doc_id, field, CASE WHEN count(*) = count(*) FILTER (WHERE error IS NULL) THEN 'completed' ELSE 'partial' END AS status,
  CASE WHEN count(*) = count(*) FILTER (WHERE error IS NULL) THEN '' ELSE 'recognition_error' END AS reason,
  CAST(count(*) AS bigint) AS attempted, CAST(count(*) FILTER (WHERE error IS NULL) AS bigint) AS completed
FROM fx_readings WHERE kind <> 'page' GROUP BY doc_id, field""")
def h8_verification_audit(spark, sf):
    return reconcile.verification_audit(derived(spark, sf, "fx_readings"))


@query("h8_whole_audit", f"""
WITH routing AS ({BODIES["b7_verification_routing"]}),
made AS (SELECT r.doc_id, r.field, count(*) AS attempted, count(*) FILTER (WHERE error IS NULL) AS completed
  FROM fx_readings r JOIN routing t ON t.doc_id = r.doc_id AND t.field = r.field AND t.reason = '' WHERE kind <> 'page' GROUP BY ALL),
both_sides AS (SELECT doc_id, field, coalesce(reason, '') AS skip, attempted, completed, doc_id % 12 = 5 AS broken FROM routing FULL JOIN made USING (doc_id, field)),
marked AS (SELECT *, broken AND skip IN ('', 'region_not_found', 'locator_error') AND (attempted IS NULL OR field = '{S.PHONE}') AS stopped FROM both_sides)
SELECT doc_id, field, CASE WHEN stopped THEN 'error' WHEN attempted = completed THEN 'completed' WHEN attempted > completed THEN 'partial' WHEN skip <> '' THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN stopped THEN 'verification_error' WHEN attempted = completed THEN '' WHEN attempted > completed THEN 'recognition_error' ELSE skip END AS reason,
  coalesce(attempted, 0) AS attempted, coalesce(completed, 0) AS completed FROM marked""")
def h8_whole_audit(spark, sf):
    """All outcomes: completed, partial, skipped for each reason, and errors of stopped documents."""
    routing = QUERIES["b7_verification_routing"](spark, sf)
    readings = derived(spark, sf, "fx_readings")
    routed = readings.join(routing.filter("reason = ''"), ["doc_id", "field"], "left_semi")
    broken = derived(spark, sf, "fx_person").filter("doc_id % 12 = 5").select("doc_id", F.lit(S.PHONE).alias("broken_field"))
    return reconcile.whole_audit(routing, routed, broken)


# --- pages --------------------------------------------------------------------------------

_MERGED = """
filled AS (SELECT *, trim(value) AS v, contains(value, '[') AS unclear FROM fx_page_values WHERE trim(value) <> ''),
firsts AS (SELECT doc_id, field, min(page_no) AS first_filled, min(page_no) FILTER (WHERE NOT unclear) AS first_solid,
   min(page_no) FILTER (WHERE NOT unclear AND status = 'read') AS first_read, count(DISTINCT v) FILTER (WHERE NOT unclear) AS n_solid FROM filled GROUP BY ALL),
groups AS (SELECT DISTINCT doc_id, field FROM fx_page_values),
picked AS (SELECT g.doc_id, g.field, coalesce(n_solid > 1, false) AS conflict, first_solid IS NOT NULL AS solid,
   CASE WHEN n_solid > 1 THEN coalesce(first_read, first_solid) ELSE coalesce(first_solid, first_filled) END AS page_no
  FROM groups g LEFT JOIN firsts USING (doc_id, field)),
merged AS (SELECT k.doc_id, k.field, coalesce(f.v, '') AS value, CASE WHEN k.solid AND NOT k.conflict THEN f.status ELSE 'needs_review' END AS status,
   coalesce(k.page_no, 1) AS page_no, k.conflict, p.verified, p.audit_status, p.audit_reason, p.attempted, p.completed
  FROM picked k LEFT JOIN filled f ON f.doc_id = k.doc_id AND f.field = k.field AND f.page_no = k.page_no
  LEFT JOIN fx_page_values p ON p.doc_id = k.doc_id AND p.field = k.field AND p.page_no = coalesce(k.page_no, 1))"""


@query("d1_page_merge", f"""
WITH {_MERGED} SELECT doc_id, field, value, status, page_no, coalesce(verified, false) AND status = 'read' AS verified, conflict,
  coalesce(audit_status, 'skipped') AS audit_status, coalesce(audit_reason, 'multipage_disabled') AS audit_reason,
  coalesce(attempted, 0) AS attempted, coalesce(completed, 0) AS completed FROM merged""")
def d1_page_merge(spark, sf):
    return pages.merge_pages(derived(spark, sf, "fx_page_values")).drop("source", "note")


@query("d1_page_conflicts", f"""
WITH {_MERGED} SELECT f.doc_id, f.field, f.page_no, f.v AS value, f.status FROM filled f JOIN merged m USING (doc_id, field)
WHERE m.conflict AND NOT f.unclear AND f.v <> m.value""")
def d1_page_conflicts(spark, sf):
    return pages.page_conflicts(derived(spark, sf, "fx_page_values"))


@query("f3_field_union", """
SELECT doc_id, field, (min(page_no * 1000 + field_ord) // 1000) AS first_page, (min(page_no * 1000 + field_ord) % 1000) AS first_ord
FROM fx_page_values GROUP BY doc_id, field""")
def f3_field_union(spark, sf):
    return pages.field_union(derived(spark, sf, "fx_page_values"))


@query("d4_stats_merge", """
SELECT doc_id, CAST(sum(requests) AS bigint) AS requests, CAST(sum(tokens_total) AS bigint) AS tokens_total, round(sum(elapsed), 2) AS elapsed,
  coalesce(arg_max(backend, page_no) FILTER (WHERE coalesce(backend, '') <> ''), '') AS backend,
  coalesce(arg_max(model, page_no) FILTER (WHERE coalesce(model, '') <> ''), '') AS model,
  CAST(coalesce(arg_max(speed, page_no) FILTER (WHERE speed > 0), 0) AS double) AS speed
FROM fx_page_stats GROUP BY doc_id""")
def d4_stats_merge(spark, sf):
    return pages.merge_stats(derived(spark, sf, "fx_page_stats"))


@query("b12_document_gate", """
SELECT doc_id, bool_and(error IS NULL AND n_fields > 0) AS accepted, min(page_no) FILTER (WHERE error IS NOT NULL OR n_fields = 0) AS bad_page
FROM fx_page_stats GROUP BY doc_id""")
def b12_document_gate(spark, sf):
    return pages.document_gate(derived(spark, sf, "fx_page_stats"))


@query("b12_accepted_pages", """
SELECT doc_id, page_no FROM fx_page_stats WHERE doc_id NOT IN (SELECT doc_id FROM fx_page_stats WHERE error IS NOT NULL OR n_fields = 0)""")
def b12_accepted_pages(spark, sf):
    return pages.accepted_pages(derived(spark, sf, "fx_page_stats")).select("doc_id", "page_no")


# --- model answers ------------------------------------------------------------------------

_BLOCKS = "regexp_extract_all(clean, '\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}')"
_CLEAN = "regexp_replace(raw, '```(json)?\\s*', '', 'g') AS clean"


@query("h1_parse_json", f"""
WITH blocks AS (SELECT doc_id, b, length(b) AS n FROM (SELECT doc_id, unnest({_BLOCKS}) AS b FROM (SELECT doc_id, {_CLEAN} FROM fx_responses) r) t
   WHERE json_valid(b) AND b <> '{{}}'),
best AS (SELECT doc_id, arg_max(b, n) AS b FROM blocks GROUP BY doc_id)
SELECT doc_id, json_extract_string(b, '$.child_fio') AS child_fio, json_extract_string(b, '$.phone') AS phone FROM best""")
def h1_parse_json(spark, sf):
    df = derived(spark, sf, "fx_responses").select("doc_id", responses.parse_model_json(c("raw")).alias("m"))
    return df.filter("m IS NOT NULL").select("doc_id", c("m")["child_fio"].alias("child_fio"), c("m")["phone"].alias("phone"))


_REPAIRED = (
    "CASE WHEN length(regexp_replace(t, '[^\"]', '', 'g')) % 2 = 1 THEN t || '\"' ELSE t END"
)


@query("h2_repair_json", f"""
WITH cut AS (SELECT doc_id, trim(substr(raw, strpos(raw, '{{'))) AS t FROM fx_responses WHERE contains(raw, '{{')),
closed AS (SELECT doc_id, CASE WHEN ends_with(q, '}}') THEN q ELSE q || chr(10) || '}}' END AS j FROM (SELECT doc_id, {_REPAIRED} AS q FROM cut) s)
SELECT doc_id, json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.child_fio') AS child_fio,
  json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.phone') AS phone FROM closed WHERE json_valid(j)""")
def h2_repair_json(spark, sf):
    df = derived(spark, sf, "fx_responses").select("doc_id", responses.repair_model_json(c("raw")).alias("m"))
    return df.filter("m IS NOT NULL").select("doc_id", c("m")["child_fio"].alias("child_fio"), c("m")["phone"].alias("phone"))


@query("h3_answers_to_fields", f"""
WITH truth AS (SELECT doc_id, regexp_extract(raw || ' ' || thinking, '"child_fio": "(\\w+)"', 1) AS fio,
    regexp_extract(raw || ' ' || thinking, '"phone": "(\\d+)', 1) AS phone, raw, thinking FROM fx_responses)
SELECT doc_id, n AS key_ord, CASE WHEN fio = '' THEN NULL WHEN n = 0 THEN 'child_fio' ELSE 'phone' END AS key,
  CASE WHEN fio = '' THEN NULL WHEN n = 0 THEN fio ELSE phone END AS value,
  CASE WHEN fio <> '' THEN NULL WHEN trim(raw) = '' AND trim(thinking) = '' THEN 'backend' || '{responses.EMPTY_ANSWER[2:]}' ELSE '{responses.UNREADABLE_ANSWER}' END AS error
FROM (SELECT *, unnest(CASE WHEN fio = '' THEN [0] ELSE [0, 1] END) AS n FROM truth) t""")
def h3_answers_to_fields(spark, sf):
    return responses.answers_to_fields(derived(spark, sf, "fx_responses"), backend="backend")


@query("h10_field_status", """
SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS status FROM events""")
def h10_field_status(spark, sf):
    from formsift.sources.fixtures import table

    meta = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select(
        c("event_id").alias("doc_id"), F.try_element_at(meta, F.lit("k")).alias("status")
    )


@query("a3_payload_decode", """
WITH packed AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '%PDF-1.7 ' ELSE '' END || raw AS body, doc_id % 7 = 3 AS broken FROM fx_responses)
SELECT doc_id, CASE WHEN broken THEN NULL ELSE md5(body) END AS digest,
  CASE WHEN broken THEN 'rejected' WHEN starts_with(body, '%PDF-') THEN 'pdf' ELSE 'other' END AS kind FROM packed""")
def a3_payload_decode(spark, sf):
    df = derived(spark, sf, "fx_responses")
    body = F.concat(F.when(c("doc_id") % 5 == 0, "%PDF-1.7 ").otherwise(""), c("raw"))
    encoded = F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "[\r\n]", "")
    url = F.concat(F.lit("data:application/octet-stream;base64,"), encoded,
                   F.when(c("doc_id") % 7 == 3, "*").otherwise(""))
    content = responses.decode_payload(url)
    decoded = df.select("doc_id", content.alias("content"))
    return decoded.select(
        "doc_id", F.md5("content").alias("digest"),
        F.when(c("content").isNull(), "rejected").otherwise(responses.payload_kind(c("content"))).alias("kind"),
    )


def _finish(spark, sf):
    """Records after reconciliation: surname check, formatting, suggestions."""
    from formsift.plans.flows import finish_records

    df = derived(spark, sf, "fx_fields").withColumn("verified", c("status") == "read").withColumn("alternative", F.lit(""))
    return finish_records(df)


@query("h9_finish_record", f"""
WITH hint AS (SELECT doc_id, sa || substr(p, length(sb) + 1) AS suggestion
  FROM (SELECT *, string_split(child, ' ')[1] AS sa, string_split(p, ' ')[1] AS sb
        FROM (SELECT doc_id, {D.squeeze('child_fio')} AS child, {D.squeeze('parent_fio')} AS p FROM fx_applications) s0) s
  WHERE length(sa) = length(sb) AND lower(sa) <> lower(sb)
    AND list_sum(list_transform(range(1, length(sa) + 1), lambda i: CASE WHEN lower(sa)[i] <> lower(sb)[i] THEN 1 ELSE 0 END)) = 1)
SELECT f.doc_id, f.field, {D.auto_format('f.field', 'f.value')} AS value,
  CASE WHEN suggestion IS NOT NULL THEN 'needs_review' ELSE status END AS status,
  status = 'read' AND suggestion IS NULL AS verified, coalesce(suggestion, '') AS alternative
FROM fx_fields f LEFT JOIN hint h ON h.doc_id = f.doc_id AND f.field = '{S.PARENT_FIO}'""")
def h9_finish_record(spark, sf):
    return _finish(spark, sf)


_SURNAME_HINT = f"""
hint AS (SELECT doc_id, sa || substr(p, length(sb) + 1) AS suggestion FROM (SELECT *, string_split(child, ' ')[1] AS sa, string_split(p, ' ')[1] AS sb
    FROM (SELECT doc_id, {D.squeeze('child_fio')} AS child, {D.squeeze('parent_fio')} AS p FROM fx_applications) s0) s
  WHERE length(sa) = length(sb) AND lower(sa) <> lower(sb)
    AND list_sum(list_transform(range(1, length(sa) + 1), lambda i: CASE WHEN lower(sa)[i] <> lower(sb)[i] THEN 1 ELSE 0 END)) = 1)"""


@query("h9_surname_notes", f"""
WITH {_SURNAME_HINT}
SELECT f.doc_id, f.field, {D.auto_format('f.field', 'f.value')} AS value, CASE WHEN h.doc_id IS NOT NULL THEN 'needs_review' ELSE status END AS status,
  coalesce(suggestion, '') AS alternative, CASE WHEN h.doc_id IS NOT NULL THEN '{S.NOTE_SURNAMES_DIFFER}' ELSE 'n' || CAST(f.doc_id AS varchar) END AS note
FROM fx_fields f LEFT JOIN hint h ON h.doc_id = f.doc_id AND f.field = '{S.PARENT_FIO}' WHERE f.field IN ('{S.CHILD_FIO}', '{S.PARENT_FIO}')""")
def h9_surname_notes(spark, sf):
    """The note that a reviewer reads beside a parent's name that differs in one letter."""
    names = derived(spark, sf, "fx_fields").filter(c("field").isin(S.CHILD_FIO, S.PARENT_FIO)).select(
        "doc_id", "field", "value", "status", (c("status") == "read").alias("verified"), F.lit("").alias("alternative"),
        F.concat(F.lit("n"), c("doc_id").cast("string")).alias("note"))
    return finish_records(names).drop("verified")


@query("h10_record_status", "SELECT doc_id, field, status, status = 'read' AS verified FROM fx_fields")
def h10_record_status(spark, sf):
    """Status and confirmation of every field, from the metadata that a record carries as JSON."""
    entry = F.struct("field", F.struct("status", (c("status") == "read").alias("verified")).alias("meta"))
    records = derived(spark, sf, "fx_fields").groupBy("doc_id").agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(entry)).alias("_fields"))).alias("record"))
    return responses.field_statuses(records, "record")


@query("l3_attach_suggestions", f"""
SELECT f.doc_id, f.field, f.value, CASE WHEN differs THEN 'needs_review' ELSE status END AS status,
  status = 'read' AND NOT differs AS verified, CASE WHEN differs THEN hint ELSE '' END AS alternative
FROM (SELECT *, {D.comparison('field', 'hint')} <> {D.comparison('field', 'value')} AS differs
  FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN upper(value) ELSE value || ' Младший' END AS hint FROM fx_fields) a) f""")
def l3_attach_suggestions(spark, sf):
    df = derived(spark, sf, "fx_fields")
    records = df.select("doc_id", "field", "value", "status", (c("status") == "read").alias("verified"),
                        F.lit("").alias("alternative"))
    hint = F.when(c("doc_id") % 2 == 0, F.upper("value")).otherwise(F.concat("value", F.lit(" Младший")))
    return reconcile.attach_suggestions(records, df.select("doc_id", "field", hint.alias("suggestion"))).drop("suggestion")
