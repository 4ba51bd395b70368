"""Queries that measure extraction quality, and the location of fields on pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.operators import quality, regions, report
from formsift.plans import duck as D
from formsift.plans.field_queries import DUCK_RATES
from formsift.plans.registry import BODIES, query
from formsift.sources.fixtures import derived

c = F.col


def _scored(spark, sf):
    return quality.score_fields(derived(spark, sf, "fx_eval"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("c8_label_predictions", f"""
WITH labels8 AS (SELECT doc_id AS case_id, field, value AS reference FROM fx_fields),
pred8 AS (SELECT doc_id AS case_id, field, value AS predicted, status, status = 'read' AS verified FROM fx_page_values WHERE page_no = 1)
SELECT l.case_id, l.field, l.reference, coalesce(p.predicted, '') AS predicted, coalesce(p.status, '') AS status, coalesce(p.verified, false) AS verified
FROM labels8 l LEFT JOIN pred8 p USING (case_id, field)""")
def c8_label_predictions(spark, sf):
    labels = derived(spark, sf, "fx_fields").select(c("doc_id").alias("case_id"), "field", c("value").alias("reference"))
    predictions = derived(spark, sf, "fx_page_values").filter("page_no = 1").select(
        c("doc_id").alias("case_id"), "field", c("value").alias("predicted"), "status",
        (c("status") == "read").alias("verified"),
    )
    return quality.label_predictions(labels, predictions)


@query("d5_case_quality", f"""
WITH {DUCK_RATES} SELECT case_id, round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer, count(*) FILTER (WHERE exact) AS exact_fields, count(*) AS field_count
FROM rated GROUP BY case_id""")
def d5_case_quality(spark, sf):
    return _rounded(quality.case_quality(_scored(spark, sf)), "mean_cer", "mean_wer")


@query("d6_corpus_quality", f"""
WITH {DUCK_RATES}, cases AS (SELECT case_id, avg(cer) AS c, avg(wer) AS w, count(*) FILTER (WHERE exact) AS e, count(*) AS n FROM rated GROUP BY case_id)
SELECT CAST(sum(e) AS bigint) AS exact_fields, CAST(sum(n) AS bigint) AS field_count, round(avg(c), 6) AS mean_cer, round(avg(w), 6) AS mean_wer, count(*) AS cases FROM cases""")
def d6_corpus_quality(spark, sf):
    return _rounded(quality.corpus_quality(_scored(spark, sf)), "mean_cer", "mean_wer")


@query("d7_field_quality", f"""
WITH {DUCK_RATES}, f AS (SELECT field, count(*) FILTER (WHERE exact) AS exact, count(*) AS total, count(*) FILTER (WHERE confirmed) AS verified,
   count(*) FILTER (WHERE confirmed AND NOT exact) AS false_verified, count(*) FILTER (WHERE NOT confirmed) AS needs_review FROM rated GROUP BY field)
SELECT *, round(CASE WHEN verified > 0 THEN false_verified / verified END, 6) AS false_rate, round(needs_review / total, 6) AS review_rate FROM f""")
def d7_field_quality(spark, sf):
    return _rounded(quality.field_quality(_scored(spark, sf)), "false_rate", "review_rate")


# Edit alignment in SQL: the cost table row by row, then the way back from its last cell.
_ALIGNED = f"""
pairs AS (SELECT field, r, p, count(*) AS n FROM (SELECT field, {D.digits(D.metric_value('field', 'reference'))} AS r, {D.digits(D.metric_value('field', 'predicted'))} AS p
   FROM fx_eval WHERE {D.has_any('lower(field)', ['дата', 'паспорт', 'телефон', 'снилс'])}) t GROUP BY ALL),
strings AS (SELECT DISTINCT r, p FROM pairs),
costs AS (SELECT r, p, CAST(0 AS bigint) AS i, [range(0, length(p) + 1)] AS m FROM strings
  UNION ALL SELECT r, p, i + 1, list_append(m, list_transform(range(0, length(p) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: best[k + 1] + j - k))))
  FROM (SELECT *, list_transform(range(0, length(p) + 1), lambda j: CASE WHEN j = 0 THEN i + 1
        ELSE least(m[i + 1][j + 1] + 1, m[i + 1][j] + CASE WHEN r[i + 1] = p[j] THEN 0 ELSE 1 END) END) AS best FROM costs WHERE i < length(r)) s),
way AS (SELECT r, p, m, i, CAST(length(p) AS bigint) AS j, '' AS reference, '' AS predicted, CAST(0 AS bigint) AS position FROM costs WHERE i = length(r)
  UNION ALL SELECT r, p, m, CASE WHEN move = 'i' THEN i ELSE i - 1 END, CASE WHEN move = 'd' THEN j ELSE j - 1 END,
     CASE WHEN move = 'i' THEN '{S.GAP}' ELSE r[i] END, CASE WHEN move = 'd' THEN '{S.GAP}' ELSE p[j] END, CASE WHEN move = 'i' THEN i + 1 ELSE i END
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND m[i + 1][j + 1] = m[i][j] + CASE WHEN r[i] = p[j] THEN 0 ELSE 1 END THEN 'm'
        WHEN i > 0 AND m[i + 1][j + 1] = m[i][j + 1] + 1 THEN 'd' ELSE 'i' END AS move FROM way WHERE i > 0 OR j > 0) s),
aligned AS (SELECT pairs.field, way.reference, way.predicted, way.position, pairs.n FROM way JOIN pairs USING (r, p) WHERE way.position > 0)"""


@query("h4_digit_alignment", f"""
WITH RECURSIVE {_ALIGNED} SELECT field, reference, predicted, CAST(position AS int) AS position, CAST(sum(n) AS bigint) AS n FROM aligned GROUP BY ALL""")
def h4_digit_alignment(spark, sf):
    aligned = quality.aligned_digits(derived(spark, sf, "fx_eval"))
    return aligned.groupBy("field", "reference", "predicted", "position").agg(F.sum("n").alias("n"))


_MATRIX = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE predicted = '{s}'), 0) AS bigint) AS pred_{'gap' if s == S.GAP else s}"
    for s in S.MATRIX_SYMBOLS
)


@query("d8_confusion_matrix", f"""
WITH RECURSIVE {_ALIGNED} SELECT s.reference, {_MATRIX} FROM (SELECT unnest({str(S.MATRIX_SYMBOLS)}) AS reference) s LEFT JOIN aligned a ON a.reference = s.reference GROUP BY s.reference""")
def d8_confusion_matrix(spark, sf):
    return quality.confusion_matrix(quality.aligned_digits(derived(spark, sf, "fx_eval")))


@query("d9_position_errors", f"""
WITH RECURSIVE {_ALIGNED} SELECT field, CAST(position AS int) AS position, reference, predicted, CAST(sum(n) AS bigint) AS n FROM aligned WHERE reference <> predicted GROUP BY ALL""")
def d9_position_errors(spark, sf):
    return quality.position_errors(quality.aligned_digits(derived(spark, sf, "fx_eval")))


@query("j3_align_udtf", f"""
WITH RECURSIVE {_ALIGNED} SELECT field, reference, predicted, CAST(position AS int) AS position, CAST(sum(n) AS bigint) AS n FROM aligned GROUP BY ALL""")
def j3_align_udtf(spark, sf):
    aligned = quality.alignments(quality.numeric_pairs(derived(spark, sf, "fx_eval")))
    return aligned.groupBy("field", "reference", "predicted", "position").agg(F.sum("n").alias("n"))


@query("d10_skip_reasons", """
SELECT audit_status, audit_reason, count(*) AS n FROM fx_eval WHERE audit_reason <> '' GROUP BY ALL""")
def d10_skip_reasons(spark, sf):
    return quality.skip_reasons(derived(spark, sf, "fx_eval"))


@query("d11_verification_totals", """
SELECT CAST(sum(attempted) AS bigint) AS attempted, CAST(sum(completed) AS bigint) AS completed FROM fx_eval""")
def d11_verification_totals(spark, sf):
    return quality.verification_totals(derived(spark, sf, "fx_eval"))


@query("d11_run_totals", "SELECT round(sum(elapsed), 6) AS elapsed, CAST(sum(requests) AS bigint) AS requests FROM fx_page_stats")
def d11_run_totals(spark, sf):
    return _rounded(quality.run_totals(derived(spark, sf, "fx_page_stats")), "elapsed")


@query("e6_first_cases", "SELECT DISTINCT case_id FROM fx_eval ORDER BY case_id LIMIT 25")
def e6_first_cases(spark, sf):
    return quality.first_cases(derived(spark, sf, "fx_eval"), 25)


@query("e5_reading_order", """
SELECT page_id, det_no, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, det_no) AS reading_no FROM fx_detections""")
def e5_reading_order(spark, sf):
    return regions.reading_order(derived(spark, sf, "fx_detections")).select("page_id", "det_no", "reading_no")


_ALIAS_ROWS = ", ".join(
    f"({D.lit(f)}, {D.lit(a)})" for f, names in regions.LABEL_ALIASES.items() for a in names
)


@query("c3_field_regions", f"""
WITH boxes AS (SELECT *, regexp_replace(lower(text), '[^а-яё0-9 ]', ' ', 'g') AS norm FROM fx_detections WHERE score >= 0.25),
alias AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) v(field, alias)),
hits AS (SELECT DISTINCT b.page_id, a.field, b.det_no, b.x1, b.y1, b.x2, b.y2 FROM boxes b JOIN alias a ON contains(b.norm, a.alias)),
label AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY y1, x1, det_no) AS rn FROM hits) t WHERE rn = 1)
SELECT l.page_id, l.field, greatest(0, l.x2 - 8) AS x1, greatest(0, l.y1 - 8) AS y1, max(b.x2) + 12 AS x2, max(b.y2) + 12 AS y2
FROM label l JOIN boxes b ON b.page_id = l.page_id AND b.x1 >= l.x2 - 8
  AND CASE WHEN l.field = '{S.PASSPORT}' THEN b.y1 BETWEEN l.y1 AND l.y1 + 180 ELSE abs(b.y1 - l.y1) <= greatest(30, 2 * (l.y2 - l.y1)) END
GROUP BY l.page_id, l.field, l.x2, l.y1""")
def c3_field_regions(spark, sf):
    return regions.locate_fields(derived(spark, sf, "fx_detections"))


#: Keys and measures of the report's tables, and the queries that give them one by one.
REPORT = {
    "cases": ("d5_case_quality", ["case_id"], ["mean_cer", "mean_wer", "exact_fields", "field_count"]),
    "corpus": ("d6_corpus_quality", [], ["exact_fields", "field_count", "mean_cer", "mean_wer", "cases"]),
    "fields": ("d7_field_quality", ["field"], ["exact", "total", "verified", "false_verified", "needs_review", "false_rate", "review_rate"]),
    "audits": ("d11_verification_totals", [], ["attempted", "completed"]),
    "skips": ("d10_skip_reasons", ["audit_status", "audit_reason"], ["n"]),
    "matrix": ("d8_confusion_matrix", ["reference"], [f"pred_{'gap' if s == S.GAP else s}" for s in S.MATRIX_SYMBOLS]),
    "positions": ("d9_position_errors", ["field", "position", "reference", "predicted"], ["n"]),
}


def _measures_sql(name: str, keys: list[str], measures: list[str], body: str) -> str:
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    pairs = ", ".join(f"{{'measure': '{m}', 'value': round(CAST({m} AS double), 6)}}" for m in measures)
    return f"SELECT '{name}' AS table_name, {key} AS key, unnest([{pairs}], recursive := true) FROM ({body}) t_{name}"


@query("a11_report", " UNION ALL ".join(_measures_sql(n, k, m, BODIES[b]) for n, (b, k, m) in REPORT.items()))
def a11_report(spark, sf):
    """All tables of the report, written as one run and read back."""
    scored = _scored(spark, sf)
    aligned = quality.aligned_digits(derived(spark, sf, "fx_eval"))
    folder = report.write_report(spark, report.report_tables(scored, aligned), {"tables": sf.rsplit("/", 1)[-1]})
    parts = []
    for name, rows in report.read_report(spark, folder).items():
        _, keys, measures = REPORT[name]
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(c(m).cast("double"), 6).alias("value")) for m in measures])
        key = F.concat_ws("|", *[c(k).cast("string") for k in keys]) if keys else F.lit("")
        parts.append(rows.select(F.lit(name).alias("table_name"), key.alias("key"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)
