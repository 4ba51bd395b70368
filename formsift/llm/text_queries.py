"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift.llm import (
    collocations, fingerprint, line_dedup, mixing, neighbours, ngram_join, packing, periodic_runs, quality, suffix_dedup, token_prefix,
    transducer, url_filter,
)
from formsift.llm.common import table
from formsift.llm.registry import query
from formsift.session import use_utc

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Words as a DuckDB pattern, and their count.
WORD_SQL = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))"


@query("op2_url_filter", check=r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
good AS (SELECT doc_id AS page_id, min(quality * (1 - toxic)) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS k,
    regexp_extract(host, '(?:^|\.)(ac\.uk|co\.jp|co\.nz|co\.uk|com\.au|com\.br|gov\.uk|org\.au|org\.uk|[^.]*)$', 1) AS suffix,
    regexp_extract(host, '((?:^|[^.]*\.)(?:ac\.uk|co\.jp|co\.nz|co\.uk|com\.au|com\.br|gov\.uk|org\.au|org\.uk|[^.]*))$', 1) AS found
  FROM parsed LEFT JOIN good USING (page_id) GROUP BY host),
named AS (SELECT host, n, k, suffix, CASE WHEN found = '' THEN host ELSE found END AS domain FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
levels AS (SELECT 'h' AS level, n, k FROM named UNION ALL SELECT 'd', n, k FROM domains UNION ALL SELECT 's', n, k FROM suffixes),
moments AS (SELECT level, sum(n)::DOUBLE AS n, sum(k) AS k, count(*)::DOUBLE AS m, sum(k * k / n) AS kk, sum(n * n)::DOUBLE AS nn
  FROM levels WHERE n > 0 GROUP BY level),
fits AS (SELECT level, k / n AS p, (kk - k * k / n) / ((k / n) * (1 - k / n)) - (m - 1) AS spread, n - nn / n - (m - 1) AS room FROM moments),
strengths AS (SELECT level, greatest(2.0, least(10000.0, CASE WHEN p > 0 AND p < 1 AND room > 0 AND spread > 0
    THEN (1 - least(spread / room, 1.0)) / least(spread / room, 1.0) ELSE 10000.0 END)) AS strength FROM fits),
rate AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS rate FROM named),
suffix_means AS (SELECT suffix, (k + s.strength * rate) / (n + s.strength) AS suffix_mean FROM suffixes, rate, strengths s WHERE s.level = 's'),
domain_means AS (SELECT domain, (k + s.strength * suffix_mean) / (n + s.strength) AS domain_mean
  FROM domains JOIN suffix_means USING (suffix), strengths s WHERE s.level = 'd'),
beliefs AS (SELECT host, (k + s.strength * domain_mean) / (n + s.strength) AS mean, n + s.strength AS total
  FROM named JOIN domain_means USING (domain), strengths s WHERE s.level = 'h'),
bounds AS (SELECT host, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM beliefs),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, round(mean, 6) AS posterior_mean, round(bound, 6) AS lower_bound
FROM ruled JOIN bounds USING (host)
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") * (1 - F.col("toxic"))).alias("good"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), good, URL_RULES)


@query("op4_fair_mix", check=f"""
WITH base AS (SELECT doc_id, source, {WORD_SQL}::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS p FROM base GROUP BY source),
weighted AS (SELECT source, source_size, 3 * source_size AS cap, CASE (p - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighted),
final AS (SELECT max(level) AS level FROM levels WHERE level <= cap / w),
targets AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT level FROM final)) AS target FROM weighted),
entries AS (SELECT b.*, t.source_size, t.target, e.epoch, e.epoch * t.source_size + coalesce(sum(b.size) OVER (
    PARTITION BY b.source, e.epoch ORDER BY substr(md5('mix|' || e.epoch || '|' || b.doc_id), 1, 12), b.doc_id, b.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) e(epoch)),
served AS (SELECT *, greatest(0, least(size, floor(target) - start))::BIGINT AS taken FROM entries)
SELECT doc_id, source, size, source_size, target, sum(taken)::BIGINT AS taken FROM served GROUP BY ALL
""")
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mix, mixing.in_order(mix)).drop("first_place")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op7_line_dedup", check="""
WITH lines AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
wide AS (SELECT trim(line) AS line, min(doc_id) AS first_doc FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT coalesce('+' || source, '-')) >= 5),
judged AS (SELECT l.doc_id, l.pos, l.line, w.line IS NOT NULL AND NOT (w.first_doc = l.doc_id AND
    row_number() OVER (PARTITION BY l.doc_id, trim(l.line) ORDER BY l.pos) = 1) AS gone
  FROM lines l LEFT JOIN wide w ON w.line = trim(l.line)),
kept AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, length(k.text)::INT AS n_kept, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.prefix_table(table(spark, sf_dir, "documents"), PIECES, 4096).drop("steps")


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, keep_ids=False)


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trips(table(spark, sf_dir, "documents"), BYTES)


@query("op13_collocations", check=r"""
WITH pieces AS (SELECT row_number() OVER () AS id, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
grams AS (SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
one AS (SELECT lang, w1 AS phrase, count(*) AS f FROM grams GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL),
counts AS (SELECT lang, phrase, f FROM one UNION ALL SELECT lang, w1 || ' ' || w2, f FROM two),
found AS (SELECT lang, w1 || ' ' || w2 AS phrase, f AS a, 1 AS k, w1 AS head, w2 AS rest FROM two WHERE f >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f, 1, w1, w2 || ' ' || w3 FROM three WHERE f >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f, 2, w1 || ' ' || w2, w3 FROM three WHERE f >= 10),
scored AS (SELECT d.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM found d JOIN counts x ON x.lang = d.lang AND x.phrase = d.head JOIN counts y ON y.lang = d.lang AND y.phrase = d.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS around FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM three WHERE f >= 10
  UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three WHERE f >= 10) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
