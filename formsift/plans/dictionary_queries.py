"""Queries over dictionaries, corrections and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import text
from formsift.operators import dictionary
from formsift.plans import duck as D
from formsift.plans.registry import query
from formsift.session import shared_folder
from formsift.sources import intake
from formsift.sources.fixtures import derived, table

c = F.col


def _corrections(spark, sf):
    return derived(spark, sf, "fx_corrections").withColumnRenamed("right_value", "right")


def _entries(spark, sf):
    return dictionary.dictionary_entries(
        dictionary.default_entries(spark).unionByName(derived(spark, sf, "fx_entries")), _corrections(spark, sf)
    )


_DEFAULTS = ", ".join(f"({D.lit(k)}, {D.lit(v)})" for k, vs in S.DICTIONARY_DEFAULTS.items() for v in vs)
_KNOWN = D.in_list(list(S.DICTIONARY_DEFAULTS))
_VALID = f"""
valid_corrections AS (SELECT seq, category, trim(wrong) AS wrong, trim(right_value) AS good FROM fx_corrections WHERE category IN {_KNOWN} AND trim(right_value) <> '')"""
_ENTRIES = f"""{_VALID},
entries AS (SELECT * FROM (VALUES {_DEFAULTS}) v(category, value) UNION SELECT category, value FROM fx_entries UNION SELECT category, good FROM valid_corrections),
mapping AS (SELECT category, {D.squeeze(D.fold('wrong'))} AS norm, arg_max(good, seq) AS good FROM valid_corrections WHERE wrong <> '' GROUP BY ALL)"""


@query("a4_dictionary_files", """
SELECT DISTINCT category, value FROM (SELECT 'surnames' AS category, surname AS value FROM fx_person UNION ALL SELECT 'first_names', first_name FROM fx_person) t""")
def a4_dictionary_files(spark, sf):
    people = derived(spark, sf, "fx_person")
    folder = shared_folder(spark, "dictionary")
    for category, column in (("surnames", "surname"), ("first_names", "first_name")):
        lines = F.array(c(column), F.concat(F.lit("# "), c(column)), F.lit("  "), F.concat(F.lit(" "), c(column)))
        people.select(F.explode(lines).alias("value")).write.text(f"{folder}/{category}.txt")
    return intake.read_dictionary(spark, folder).distinct()


@query("a5_corrections_csv", f"""
SELECT category, trim(wrong) AS wrong, trim(right_value) AS "right", count(*) AS n FROM fx_corrections
WHERE category IN {_KNOWN} AND trim(right_value) <> '' GROUP BY ALL""")
def a5_corrections_csv(spark, sf):
    path = shared_folder(spark, "corrections")
    _corrections(spark, sf).select("category", "wrong", "right").write.option("header", True).option("escape", '"').csv(path)
    read = dictionary.valid_corrections(intake.read_corrections(spark, path))
    return read.groupBy("category", "wrong", "right").agg(F.count("*").alias("n"))


@query("f2_dictionary_union", f"WITH {_ENTRIES} SELECT category, value FROM entries")
def f2_dictionary_union(spark, sf):
    return _entries(spark, sf)


@query("c6_custom_lookup", f"""
WITH {_ENTRIES} SELECT p.doc_id, p.surname AS word, m.good AS "right" FROM fx_person p LEFT JOIN mapping m
  ON m.category = 'surnames' AND m.norm = {D.squeeze(D.fold('p.surname'))}""")
def c6_custom_lookup(spark, sf):
    mapping = dictionary.current_corrections(_corrections(spark, sf)).filter("category = 'surnames'")
    people = derived(spark, sf, "fx_person").select(
        "doc_id", c("surname").alias("word"), text.dict_norm(c("surname")).alias("norm")
    )
    return people.join(mapping, "norm", "left").select("doc_id", "word", "right")


@query("a10_new_corrections", f"""
WITH {_ENTRIES}, fresh AS (SELECT p.doc_id, 'surnames' AS category, lower(p.surname) AS wrong, CASE WHEN doc_id % 2 = 0 THEN 'Бобров' ELSE p.surname END AS good FROM fx_person p)
SELECT f.doc_id, f.category, f.wrong, f.good AS "right" FROM fresh f LEFT JOIN mapping m ON m.category = f.category AND m.norm = {D.fold('f.wrong')}
WHERE m.good IS NULL OR m.good <> f.good""")
def a10_new_corrections(spark, sf):
    confirmed = derived(spark, sf, "fx_person").select(
        "doc_id", F.lit("surnames").alias("category"), F.lower("surname").alias("wrong"),
        F.when(c("doc_id") % 2 == 0, "Бобров").otherwise(c("surname")).alias("right"),
    )
    return dictionary.new_corrections(_corrections(spark, sf), confirmed).select("doc_id", "category", "wrong", "right")


# Words whose best score is 1: a custom mapping or an entry with the same folded text.
_TOKENS = f"""
fio_words AS (SELECT doc_id, field, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS part_no FROM (SELECT doc_id, field, {D.words('value')} AS w FROM fx_fields
   WHERE field IN ('{S.CHILD_FIO}', '{S.PARENT_FIO}')) t),
fio_tokens AS (SELECT *, split_part('surnames|first_names|patronymics', '|', CAST(part_no + 1 AS int)) AS category, {D.fold('word')} AS norm FROM fio_words WHERE part_no < 3),
text_words AS (SELECT doc_id, field, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS part_no FROM (SELECT doc_id, field, {D.words('value')} AS w FROM fx_fields
   WHERE field IN ('{S.ADDRESS}', '{S.PASSPORT}')) t),
text_tokens AS (SELECT *, CASE WHEN field = '{S.ADDRESS}' THEN 'cities' ELSE 'organizations' END AS category, {D.fold("trim(word, '.,')")} AS norm FROM text_words)"""
_EXACT = f"""
exact AS (SELECT category, {D.squeeze(D.fold('value'))} AS norm, min(value) AS value FROM entries GROUP BY ALL), {_TOKENS}"""


# The similarity ratio in SQL: twice the characters of matching blocks over all. The longest common
# block comes first (ties: the first in the word, then in the entry), then those left and right of it.
_RATIO = """
thresholds AS (SELECT * FROM (VALUES {thresholds}) v(category, least_score)),
known AS (SELECT category, value AS "to", {norm} AS b FROM {entries}),
candidates AS (SELECT k.category, k.norm AS a, e."to", e.b, least_score FROM {keys} k JOIN known e ON e.category = k.category AND e.b <> '' JOIN thresholds t ON t.category = k.category
  WHERE k.norm <> '' AND 2.0 * least(length(k.norm), length(e.b)) / (length(k.norm) + length(e.b)) >= least_score),
blocks AS (SELECT a, b, [{{'a1': 1, 'a2': length(a) + 1, 'b1': 1, 'b2': length(b) + 1}}] AS open_parts, CAST(0 AS bigint) AS matched FROM (SELECT DISTINCT a, b FROM candidates) t
  UNION ALL SELECT a, b, CASE WHEN found IS NULL THEN open_parts[2:] ELSE list_concat(open_parts[2:], [
      {{'a1': part.a1, 'a2': found.i, 'b1': part.b1, 'b2': found.j}}, {{'a1': found.i + found.k, 'a2': part.a2, 'b1': found.j + found.k, 'b2': part.b2}}]) END,
    matched + coalesce(found.k, 0)
  FROM (SELECT *, list_sort(flatten(list_transform(range(1, least(part.a2 - part.a1, part.b2 - part.b1) + 1), lambda k: flatten(list_transform(range(part.a1, part.a2 - k + 1),
      lambda i: list_transform(list_filter(range(part.b1, part.b2 - k + 1), lambda j: substr(a, i, k) = substr(b, j, k)), lambda j: {{'longest': -k, 'i': i, 'j': j, 'k': k}}))))))[1] AS found
    FROM (SELECT *, open_parts[1] AS part FROM blocks WHERE length(open_parts) > 0) x) y),
ratios AS (SELECT a, b, 2.0 * max(matched) / (length(a) + length(b)) AS score FROM blocks GROUP BY a, b),
nearest AS (SELECT category, a AS norm, arg_min("to", struct_pack(cost := -score, t := "to")) AS "to", max(score) AS score
  FROM candidates JOIN ratios USING (a, b) WHERE score >= least_score GROUP BY category, a)"""


def _ratio(keys: str, entries: str = "entries") -> str:
    thresholds = ", ".join(f"({D.lit(k)}, CAST({t} AS double))" for k, t in S.MATCH_THRESHOLDS.items())
    return _RATIO.format(thresholds=thresholds, keys=keys, entries=entries, norm=D.squeeze(D.fold("value")))


@query("c4_nearest_entry", f"""
WITH RECURSIVE {_ENTRIES}, {_TOKENS}, wanted AS (SELECT DISTINCT category, norm FROM fio_tokens), {_ratio("wanted")}
SELECT category, norm, "to", round(score, 6) AS score FROM nearest""")
def c4_nearest_entry(spark, sf):
    tokens = dictionary.fio_tokens(derived(spark, sf, "fx_fields"))
    keys = tokens.select("category", "norm").distinct()
    best = dictionary.nearest_entries(keys, _entries(spark, sf))
    return best.withColumn("score", F.round("score", 6))


def _exact_changes(tokens: str) -> str:
    return f"""WITH {_ENTRIES}, {_EXACT}
SELECT t.doc_id, t.field, CAST(t.part_no AS int) AS part_no, t.category, t.word AS "from", coalesce(m.good, e.value) AS "to", CAST(1 AS double) AS score,
  CASE WHEN m.good IS NOT NULL THEN 'custom' ELSE '' END AS source
FROM {tokens} t LEFT JOIN mapping m ON m.category = t.category AND m.norm = t.norm LEFT JOIN exact e ON e.category = t.category AND e.norm = t.norm
WHERE m.good IS NOT NULL OR e.value <> t.word"""


@query("l1_exact_name_changes", _exact_changes("fio_tokens"))
def l1_exact_name_changes(spark, sf):
    tokens = dictionary.fio_tokens(derived(spark, sf, "fx_fields"))
    return dictionary.changes(dictionary.propose(tokens, _entries(spark, sf), _corrections(spark, sf), fuzzy=False))


def _corrected(tokens: str, words: str) -> str:
    """Texts with all changes: the mapping, an entry of the same folded text, else the nearest one."""
    return f"""WITH RECURSIVE {_ENTRIES}, {_EXACT},
open_words AS (SELECT DISTINCT t.category, t.norm FROM {tokens} t LEFT JOIN mapping m USING (category, norm) LEFT JOIN exact e USING (category, norm) WHERE m.good IS NULL AND e.value IS NULL),
{_ratio("open_words")},
changed AS (SELECT t.doc_id, t.field, t.part_no, coalesce(m.good, e.value, n."to") AS "to" FROM {tokens} t
  LEFT JOIN mapping m ON m.category = t.category AND m.norm = t.norm LEFT JOIN exact e ON e.category = t.category AND e.norm = t.norm
  LEFT JOIN nearest n ON n.category = t.category AND n.norm = t.norm
  WHERE m.good IS NOT NULL OR coalesce(e.value, n."to") <> t.word),
patched AS (SELECT w.doc_id, w.field, string_agg(coalesce(c."to", w.word), ' ' ORDER BY w.part_no) AS corrected, count(c."to") AS n FROM {words} w LEFT JOIN changed c USING (doc_id, field, part_no) GROUP BY ALL)
SELECT doc_id, field, corrected FROM patched WHERE n > 0"""


@query("l1_suggest_fio", _corrected("fio_tokens", "fio_words"))
def l1_suggest_fio(spark, sf):
    records = derived(spark, sf, "fx_fields")
    proposed = dictionary.propose(dictionary.fio_tokens(records), _entries(spark, sf), _corrections(spark, sf))
    return dictionary.rebuilt(records, proposed)


@query("l2_exact_text_changes", _exact_changes("text_tokens"))
def l2_exact_text_changes(spark, sf):
    tokens = dictionary.text_tokens(derived(spark, sf, "fx_fields"))
    return dictionary.changes(dictionary.propose(tokens, _entries(spark, sf), _corrections(spark, sf), fuzzy=False))


@query("l2_correct_texts", _corrected("text_tokens", "text_words"))
def l2_correct_texts(spark, sf):
    records = derived(spark, sf, "fx_fields")
    proposed = dictionary.propose(dictionary.text_tokens(records), _entries(spark, sf), _corrections(spark, sf))
    return dictionary.rebuilt(records, proposed)


@query("c5_patronymic_match", f"""
WITH {D.patronymic_ctes('SELECT patronymic AS w FROM fx_person UNION ALL SELECT surname FROM fx_person')}
SELECT word, fixed_word FROM fixed""")
def c5_patronymic_match(spark, sf):
    from formsift.functions.names import correct_patronymic

    people = derived(spark, sf, "fx_person").select(F.explode(F.array("patronymic", "surname")).alias("word"))
    return people.distinct().select("word", correct_patronymic(c("word")).alias("fixed_word"))


@query("l4_learned_pairs", f"""
SELECT doc_id, field, CASE WHEN part <> '' THEN part WHEN contains(field, 'Паспорт') THEN 'organizations' WHEN contains(field, 'Адрес') THEN 'cities' ELSE 'surnames' END AS category
FROM (SELECT doc_id, field, CASE WHEN field_ord = 2 THEN 'first_names' ELSE '' END AS part FROM fx_fields) t""")
def l4_learned_pairs(spark, sf):
    from formsift.functions.fields import correction_category

    part = F.when(c("field_ord") == 2, "first_names").otherwise("")
    return derived(spark, sf, "fx_fields").select("doc_id", "field", correction_category(part, c("field")).alias("category"))


@query("l4_appended_corrections", f"""WITH {_ENTRIES}, {_EXACT},
tokens AS (SELECT * FROM fio_tokens UNION ALL SELECT * FROM text_tokens),
accepted AS (SELECT t.*, coalesce(m.good, e.value) AS "to", m.good AS in_force FROM tokens t LEFT JOIN mapping m ON m.category = t.category AND m.norm = t.norm
  LEFT JOIN exact e ON e.category = t.category AND e.norm = t.norm WHERE (m.good IS NOT NULL OR e.value <> t.word) AND t.doc_id % 2 = 0),
pairs AS (SELECT doc_id, category, trim(word) AS wrong, trim("to") AS "right" FROM accepted)
SELECT p.* FROM pairs p LEFT JOIN mapping m ON m.category = p.category AND m.norm = {D.squeeze(D.fold("p.wrong"))} WHERE p.wrong <> '' AND p."right" <> '' AND (m.good IS NULL OR m.good <> p."right")""")
def l4_appended_corrections(spark, sf):
    """Changes that reviewers accept become pairs of all categories; what the mapping says already is left out."""
    records, mapping = derived(spark, sf, "fx_fields"), _corrections(spark, sf)
    tokens = dictionary.fio_tokens(records).unionByName(dictionary.text_tokens(records))
    offered = dictionary.changes(dictionary.propose(tokens, _entries(spark, sf), mapping, fuzzy=False))
    named = F.when(c("category").isin(*dictionary.FIO_CATEGORIES), c("category")).otherwise("")
    accepted = offered.filter("doc_id % 2 = 0").withColumn("field_part", named)
    pairs = dictionary.learned_pairs(accepted, "doc_id")
    return dictionary.new_corrections(mapping, pairs).select("doc_id", "category", "wrong", "right")


@query("c6_lookup_all", f"""
WITH {_ENTRIES}, {_TOKENS}, tokens AS (SELECT * FROM fio_tokens UNION ALL SELECT * FROM text_tokens)
SELECT t.doc_id, t.field, CAST(t.part_no AS int) AS part_no, t.category, t.word, m.good AS "right" FROM tokens t LEFT JOIN mapping m ON m.category = t.category AND m.norm = t.norm""")
def c6_lookup_all(spark, sf):
    """The mapping in force for every word of the names, addresses and passport texts."""
    records = derived(spark, sf, "fx_fields")
    tokens = dictionary.fio_tokens(records).unionByName(dictionary.text_tokens(records))
    mapping = dictionary.current_corrections(_corrections(spark, sf))
    return tokens.join(mapping, ["category", "norm"], "left").select("doc_id", "field", "part_no", "category", "word", "right")


@query("a4_all_categories", f"WITH {_ENTRIES} SELECT category, value FROM entries")
def a4_all_categories(spark, sf):
    """All categories as files of one value per line, with comments and blank lines, read back."""
    values, folder = _entries(spark, sf), shared_folder(spark, "dictionary")
    for category in S.DICTIONARY_DEFAULTS:
        lines = F.array(F.concat(F.lit("  "), c("value")), F.concat(F.lit("# "), c("value")), F.lit(""))
        values.filter(c("category") == category).select(F.explode(lines).alias("value")).write.text(f"{folder}/{category}.txt")
    return intake.read_dictionary(spark, folder).distinct()


@query("a6_signature_bands", f"""
SELECT 'form ' || CAST(s_suppkey AS varchar) AS template, CASE WHEN s_suppkey % 3 = 0 THEN 0.7 WHEN s_suppkey % 3 = 1 THEN NULL ELSE 0.6 END AS y1,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.8 WHEN s_suppkey % 3 = 1 THEN NULL ELSE CAST(s_suppkey % 50 / 100 AS double) END AS y2 FROM supplier
UNION ALL SELECT {D.lit(intake.STANDARD_TEMPLATE)}, {intake.SIGNATURE_DATE_Y[0]}, {intake.SIGNATURE_DATE_Y[1]}""")
def a6_signature_bands(spark, sf):
    """Where each form has the signature's date; bad pairs are dropped, the standard form has its own."""
    k = c("s_suppkey")
    pair = F.when(k % 3 == 0, F.array(F.lit(0.7), F.lit(0.8))).when(k % 3 == 1, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.6), k % 50 / 100))
    forms = table(spark, sf, "supplier").select(F.create_map(F.concat(F.lit("form "), k.cast("string")), F.struct(
        F.array(F.lit("Поле")).alias("fields"), pair.alias("signature_date_y"))).alias("t"))
    path = shared_folder(spark, "templates")
    forms.select(F.to_json("t")).write.text(path)
    return intake.signature_bands(spark, path, per_line=True)


_FIELD_Y = "CASE WHEN s_suppkey % 3 = 0 THEN [0.1, 0.2] WHEN s_suppkey % 3 = 1 THEN [0.5] ELSE [0.25, s_suppkey % 50 / 100] END"


@query("a6_templates", f"""
WITH src AS (SELECT s_suppkey AS k FROM supplier),
own AS (SELECT 'form ' || CAST(k AS varchar) AS template, unnest(['Поле А', 'Поле Б']) AS field, unnest([0, 1]) AS field_ord, k FROM src),
custom AS (SELECT template, field, field_ord, CASE WHEN field_ord = 0 THEN 'поле а|первое поле' WHEN k % 2 = 0 THEN 'поле б' END AS aliases,
   CASE WHEN field_ord = 0 AND k % 3 <> 1 THEN CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0.25 END END AS y1,
   CASE WHEN field_ord = 0 AND k % 3 <> 1 THEN CASE WHEN k % 3 = 0 THEN 0.2 ELSE (k % 50) / 100.0 END END AS y2 FROM own),
standard AS (SELECT * FROM (VALUES {", ".join(f"({D.lit(intake.STANDARD_TEMPLATE)}, {D.lit(f)}, {i}, {D.lit('|'.join(intake.LABEL_ALIASES[f]))}, {intake.FALLBACK_Y[f][0]}, {intake.FALLBACK_Y[f][1]})" for i, f in enumerate(S.BUSINESS_FIELDS))}) v(template, field, field_ord, aliases, y1, y2))
SELECT template, field, CAST(field_ord AS int) AS field_ord, aliases, CAST(y1 AS double) AS y1, CAST(y2 AS double) AS y2 FROM custom
UNION ALL SELECT template, field, CAST(field_ord AS int), CASE WHEN field = '{S.PHONE}' THEN 'номер ' || CAST((SELECT max(k) FROM src) AS varchar) ELSE aliases END,
  CAST(CASE WHEN field = '{S.NOTES}' THEN 0.5 ELSE y1 END AS double), CAST(CASE WHEN field = '{S.NOTES}' THEN 0.6 ELSE y2 END AS double) FROM standard""")
def a6_templates(spark, sf):
    k = c("s_suppkey")
    suppliers = table(spark, sf, "supplier").select("s_suppkey")
    text_array = "array<string>"
    pair = F.when(k % 3 == 0, F.array(F.lit(0.1), F.lit(0.2))).when(k % 3 == 1, F.array(F.lit(0.5))).otherwise(
        F.array(F.lit(0.25), k % 50 / 100)
    )
    custom = suppliers.select(F.create_map(F.concat(F.lit("form "), k.cast("string")), F.struct(
        F.array(F.lit("Поле А"), F.lit("Поле Б")).alias("fields"),
        F.create_map(
            F.lit("Поле А"), F.array(F.lit("поле а"), F.lit("первое поле")),
            F.lit("Поле Б"), F.when(k % 2 == 0, F.array(F.lit("поле б"))).otherwise(F.array().cast(text_array)),
        ).alias("label_aliases"),
        F.create_map(F.lit("Поле А"), pair).alias("fallback_y"),
    )).alias("t"))
    standard = suppliers.agg(F.max("s_suppkey").alias("top")).select(F.create_map(F.lit(intake.STANDARD_TEMPLATE), F.struct(
        F.array().cast(text_array).alias("fields"),
        F.create_map(F.lit(S.PHONE), F.array(F.concat(F.lit("номер "), c("top").cast("string")))).alias("label_aliases"),
        F.create_map(F.lit(S.NOTES), F.array(F.lit(0.5), F.lit(0.6)),
                     F.lit(S.SNILS), F.array(F.lit(0.9))).alias("fallback_y"),
    )).alias("t"))
    path = shared_folder(spark, "templates")
    custom.unionByName(standard).select(F.to_json("t")).write.text(path)
    rows = intake.read_templates(spark, path, per_line=True)
    return rows.select("template", "field", "field_ord", F.array_join("aliases", "|").alias("aliases"), "y1", "y2")
