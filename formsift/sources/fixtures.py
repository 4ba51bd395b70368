"""Form-extraction tables derived from the driver's star-schema tables.

Each derived table is one SELECT in the SQL that Spark and DuckDB share, so the Spark query
and its check read the same rows. ``{rows:a,b,c}`` stands for one output row per listed
integer: ``explode(array(..))`` in Spark, ``unnest(list_value(..))`` in DuckDB. ``{micros:x}``
is a timestamp as microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from formsift.session import use_utc

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES = {
    # One applicant per customer; 1 in 11 repeats the person three keys earlier.
    # The control number is wrong for 1 in 13.
    "fx_person": """
SELECT *, lpad(CAST((chk + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END) % 100 AS string), 2, '0') AS cc
FROM (SELECT *, ((
    CAST(substr(base9,1,1) AS int)*9 + CAST(substr(base9,2,1) AS int)*8 + CAST(substr(base9,3,1) AS int)*7 +
    CAST(substr(base9,4,1) AS int)*6 + CAST(substr(base9,5,1) AS int)*5 + CAST(substr(base9,6,1) AS int)*4 +
    CAST(substr(base9,7,1) AS int)*3 + CAST(substr(base9,8,1) AS int)*2 + CAST(substr(base9,9,1) AS int)) % 101) % 100 AS chk
  FROM (SELECT k AS doc_id, p,
      lpad(CAST((p * 7919 + 100000007) % 1000000000 AS string), 9, '0') AS base9,
      '9' || lpad(CAST((p * 104729 + 12345) % 1000000000 AS string), 9, '0') AS phone10,
      split_part('Иванов|Петрова|Бобров|Смирнова|Бодров|Римский-Корсаков|Троицкий|Иванова', '|', CAST(p % 8 + 1 AS int)) AS surname,
      split_part('Алексей|Мария|Иван|Анна|Владислав', '|', CAST(p % 5 + 1 AS int)) AS first_name,
      split_part('Алексеевич|Ивановна|Сергеевнч|Владимировна|Влалимирович|Петровна', '|', CAST(p % 6 + 1 AS int)) AS patronymic,
      2006 + p % 6 AS birth_y, 1 + p % 12 AS birth_m, 1 + p % 28 AS birth_d
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 3 THEN c_custkey - 3 ELSE c_custkey END AS p FROM customer) s0) s1) s2
""",
    # Raw field texts, one row per document.
    "fx_applications": """
SELECT doc_id, 'file_' || CAST(doc_id AS string) || '.png' AS filename,
  CASE WHEN doc_id % 3 = 0 THEN upper(surname) ELSE lower(surname) END || ' ' || first_name || '  ' || patronymic AS child_fio,
  split_part('Иванов|Петров|Бобров|Смирнов|Бобров|Римский-Корсаков|Троицкая|Сидоров', '|', CAST(p % 8 + 1 AS int)) || ' Игорь' AS parent_fio,
  CASE WHEN doc_id % 19 = 7 THEN ''
       WHEN doc_id % 17 = 4 THEN '31.02.' || CAST(birth_y AS string)
       WHEN doc_id % 3 = 0 THEN CAST(birth_y AS string) || '-' || lpad(CAST(birth_m AS string), 2, '0') || '-' || lpad(CAST(birth_d AS string), 2, '0')
       WHEN doc_id % 3 = 1 THEN CAST(birth_d AS string) || '/' || CAST(birth_m AS string) || '/' || lpad(CAST(birth_y % 100 AS string), 2, '0')
       ELSE lpad(CAST(birth_d AS string), 2, '0') || '.' || lpad(CAST(birth_m AS string), 2, '0') || '.' || CAST(birth_y AS string) END AS birth_date,
  lpad(CAST(birth_d AS string), 2, '0') || CASE WHEN doc_id % 5 = 0 THEN '.04.2026' WHEN doc_id % 5 = 1 THEN '.01.2026' ELSE '.07.2026' END AS application_date,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 < 4 THEN lpad(CAST(birth_d AS string), 2, '0') ELSE '15' END
    || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '.07.2026' END AS signature_date,
  CASE CAST(doc_id % 5 AS int)
       WHEN 0 THEN '+7 (' || substr(phone10,1,3) || ') ' || substr(phone10,4,3) || '-' || substr(phone10,7,2) || '-' || substr(phone10,9,2)
       WHEN 1 THEN '8 ' || substr(phone10,1,3) || ' ' || substr(phone10,4,3) || ' ' || substr(phone10,7,4)
       WHEN 2 THEN phone10
       WHEN 3 THEN '+7 ' || phone10 || ' доб. 12'
       ELSE CASE WHEN doc_id % 2 = 0 THEN '[неразборчиво]' ELSE '7' || phone10 END END AS phone,
  CASE WHEN doc_id % 23 = 9 THEN ''
       WHEN doc_id % 3 = 0 THEN substr(base9,1,3) || '-' || substr(base9,4,3) || '-' || substr(base9,7,3) || ' ' || cc
       WHEN doc_id % 3 = 1 THEN base9 || cc
       ELSE substr(base9,1,3) || ' ' || substr(base9,4,3) || ' ' || substr(base9,7,3) || ' ' || cc END AS snils,
  CASE WHEN doc_id % 4 = 0 THEN '4512 123456' WHEN doc_id % 4 = 1 THEN '00 12 654321' ELSE '45 12 123456 выдан рмсд' END AS passport,
  split_part('г Воронеж, ул Мира, д5|Город Еж ,пер Тихий кв12|обл Липецк,просп Победы корп 2|Ростов-на-Дону, ул. Садовая', '|', CAST(doc_id % 4 + 1 AS int)) AS address,
  split_part('музыко-математический|гуманитарный|соц-эконом|биолого-химический|инженерный|универсальный|другой', '|', CAST(doc_id % 7 + 1 AS int)) AS profile,
  split_part('item|нет|-|многодетная семья|None|hem.|отсутствуют', '|', CAST(doc_id % 7 + 1 AS int)) AS notes,
  doc_id % 6 IN (0, 1) AS reviewer_confirmed
FROM fx_person
""",
    # The same texts one row per field, under the field names.
    "fx_fields": """
SELECT doc_id, n AS field_ord,
  split_part('Дата подачи заявления|ФИО поступающего ученика|Дата рождения ребенка|Класс / профиль обучения|ФИО родителя / заявителя|Паспортные данные|Адрес регистрации / проживания|Контактный телефон|СНИЛС поступающего|Особые отметки / льготы', '|', n) AS field,
  CASE n WHEN 1 THEN application_date WHEN 2 THEN child_fio WHEN 3 THEN birth_date WHEN 4 THEN profile
         WHEN 5 THEN parent_fio WHEN 6 THEN passport WHEN 7 THEN address WHEN 8 THEN phone WHEN 9 THEN snils ELSE notes END AS value,
  CASE WHEN (doc_id + n) % 9 = 0 THEN 'needs_review' WHEN (doc_id + n) % 14 = 1 THEN 'unclear' ELSE 'read' END AS status
FROM (SELECT *, {rows:1,2,3,4,5,6,7,8,9,10} AS n FROM fx_applications) s
""",
    # Keys as a model may spell them: technical names, aliases, decoys, internal keys.
    "fx_raw": """
SELECT doc_id, n AS key_ord,
  CASE n WHEN 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'application_date' ELSE 'Дата заявления (штамп)' END
         WHEN 2 THEN split_part('child_fio|ФИО ребенка|Фамилия, имя, отчество поступающего (полностью)|ФИО поступающего ученика', '|', CAST(doc_id % 4 + 1 AS int))
         WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'birth_date' ELSE 'Дата и место рождения' END
         WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'Желаемый класс' ELSE 'target_class' END
         WHEN 5 THEN CASE WHEN doc_id % 5 = 0 THEN 'parent_fio' ELSE 'ФИО законного представителя' END
         WHEN 6 THEN CASE WHEN doc_id % 3 = 1 THEN 'Паспорт заявителя' ELSE 'passport_data' END
         WHEN 7 THEN CASE WHEN doc_id % 2 = 1 THEN 'Адрес проживания семьи' ELSE 'address' END
         WHEN 8 THEN split_part('phone|Телефон для связи|Контактный телефон|Телефон родителя', '|', CAST(doc_id % 4 + 1 AS int))
         WHEN 9 THEN CASE WHEN doc_id % 3 = 2 THEN 'Страховой номер индивидуального лицевого счета' ELSE 'snils' END
         WHEN 10 THEN CASE WHEN doc_id % 6 = 1 THEN 'Наличие льгот' ELSE 'notes' END
         WHEN 11 THEN '_fields'
         WHEN 12 THEN '№ п/п'
         WHEN 13 THEN 'СНИЛС поступающего'
         WHEN 14 THEN 'Имя файла источника'
         ELSE 'Предметы на выбор' END AS key,
  CASE n WHEN 1 THEN application_date WHEN 2 THEN child_fio WHEN 3 THEN birth_date WHEN 4 THEN profile
         WHEN 5 THEN parent_fio WHEN 6 THEN passport WHEN 7 THEN address WHEN 8 THEN phone WHEN 9 THEN snils
         WHEN 10 THEN notes WHEN 11 THEN '{}' WHEN 12 THEN CAST(doc_id AS string) WHEN 13 THEN '  '
         WHEN 14 THEN filename ELSE 'физика' END AS value
FROM (SELECT *, {rows:1,2,3,4,5,6,7,8,9,10,11,12,13,14,15} AS n FROM fx_applications) s
WHERE NOT (n = 13 AND doc_id % 5 < 3)
""",
    # Page reading (0), three views (1-3) and an adjudication (4) of phone, number and birth date.
    "fx_readings": """
SELECT doc_id, field, v AS view_no, truth,
  CASE WHEN v = 0 THEN 'page' WHEN v = 4 THEN 'adjudication' ELSE 'view' END AS kind,
  CASE WHEN v BETWEEN 1 AND 3 AND (doc_id * v) % 29 = 3 THEN NULL
       WHEN v = 0 AND doc_id % 10 = 6 THEN '[неразборчиво]'
       WHEN (doc_id + 2 * v) % 31 = 0 THEN substr(truth, 1, length(truth) - 1)
       WHEN (v = 0 AND doc_id % 9 = 2) OR (v > 0 AND (doc_id + v) % 4 = 0) OR (v > 0 AND (doc_id + v) % 7 = 0) THEN
         substr(truth, 1, pos - 1) || CAST((CAST(substr(truth, pos, 1) AS int) + 1) % 10 AS string) || substr(truth, pos + 1, length(truth))
       WHEN v = 2 AND f = 1 THEN '8' || truth ELSE truth END AS value,
  CASE WHEN v BETWEEN 1 AND 3 AND (doc_id + v) % 37 = 0 THEN 'unclear' ELSE 'read' END AS status,
  CASE WHEN v BETWEEN 1 AND 3 AND (doc_id * v) % 29 = 3 THEN 'timeout' ELSE NULL END AS error
FROM (SELECT doc_id, f, v, split_part('Контактный телефон|СНИЛС поступающего|Дата рождения ребенка', '|', f) AS field,
        CASE f WHEN 1 THEN phone10 WHEN 2 THEN base9 || cc
               ELSE lpad(CAST(birth_d AS string), 2, '0') || '.' || lpad(CAST(birth_m AS string), 2, '0') || '.' || CAST(birth_y AS string) END AS truth,
        CASE WHEN f = 3 THEN CASE WHEN (doc_id + v) % 3 = 0 THEN 5 WHEN (doc_id + v) % 3 = 1 THEN 2 ELSE 10 END
             ELSE CAST((doc_id + v * 3) % 9 + 2 AS int) END AS pos
      FROM (SELECT *, {rows:0,1,2,3,4} AS v FROM (SELECT *, {rows:1,2,3} AS f FROM fx_person) a) b) s
""",
    # One to three pages per document.
    "fx_page_values": """
SELECT doc_id, page_no, field_ord, field,
  CASE WHEN (doc_id + page_no) % 5 = 0 THEN '' WHEN (doc_id + page_no) % 7 = 0 THEN '[неразборчиво]'
       WHEN page_no = 2 AND doc_id % 6 = 1 THEN base || ' *' ELSE base END AS value,
  CASE WHEN (doc_id * page_no) % 3 = 1 THEN 'read' ELSE 'needs_review' END AS status,
  'vlm_page' AS source, (doc_id * page_no) % 3 = 1 AND doc_id % 2 = 0 AS verified,
  CASE WHEN (doc_id + page_no) % 4 = 0 THEN 'skipped' ELSE 'completed' END AS audit_status,
  CASE WHEN (doc_id + page_no) % 4 = 0 THEN 'multipage_disabled' ELSE '' END AS audit_reason,
  CASE WHEN (doc_id + page_no) % 4 = 0 THEN 0 ELSE 1 END AS attempted,
  CASE WHEN (doc_id + page_no) % 4 = 0 THEN 0 ELSE 1 END AS completed
FROM (SELECT doc_id, page_no, f AS field_ord,
        split_part('ФИО поступающего ученика|Контактный телефон', '|', f) AS field,
        CASE WHEN f = 1 THEN child_fio ELSE phone END AS base
      FROM (SELECT *, {rows:1,2} AS f FROM (SELECT *, {rows:1,2,3} AS page_no FROM fx_applications) a
            WHERE page_no <= 1 + doc_id % 3) b) s
""",
    # Per-page request statistics and outcome.
    "fx_page_stats": """
SELECT o_custkey AS doc_id, o_orderkey AS page_no, 1 + o_orderkey % 3 AS requests, o_orderkey % 900 AS tokens_total,
  CAST(o_orderkey % 50 AS double) / 4 AS elapsed,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'backend' || CAST(o_orderkey % 3 AS string) END AS backend,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'model' || CAST(o_orderkey % 2 AS string) END AS model,
  CASE WHEN o_orderkey % 6 = 0 THEN 0.0 ELSE CAST(o_orderkey % 80 AS double) / 2 END AS speed,
  CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' ELSE NULL END AS error,
  CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 2 END AS n_fields
FROM orders
""",
    # Labels against predictions.
    "fx_eval": """
SELECT case_id, field, reference, predicted, status, verified, audit_status, audit_reason, attempted, completed FROM (
SELECT doc_id AS case_id, field, truth AS reference, coalesce(value, '') AS predicted,
  status, doc_id % 2 = 0 AND status = 'read' AS verified,
  CASE WHEN error IS NOT NULL THEN 'partial' ELSE 'completed' END AS audit_status,
  CASE WHEN error IS NOT NULL THEN 'recognition_error' ELSE '' END AS audit_reason,
  3 AS attempted, CASE WHEN error IS NOT NULL THEN 2 ELSE 3 END AS completed
FROM fx_readings WHERE view_no = 1
UNION ALL
SELECT doc_id, 'ФИО поступающего ученика', surname || ' ' || first_name || ' ' || patronymic,
  CASE WHEN doc_id % 4 = 0 THEN surname || ' ' || patronymic WHEN doc_id % 4 = 1 THEN lower(surname) || '  ' || first_name || ' ' || patronymic
       WHEN doc_id % 4 = 2 THEN 'Бодров ' || first_name || ' ' || patronymic ELSE '' END, 'read', doc_id % 3 = 0,
  'skipped', 'region_not_found', 0, 0
FROM fx_person) s
""",
    # Events as an activity log, and the batch items they stand for.
    "fx_activity": """
SELECT event_id AS id, ts, 'user' || CAST(user_id AS string) AS username, event_type AS action,
  event_type <> 'error' AS ok, CAST(floor(value) AS int) AS elapsed_ms,
  'model' || CAST(event_id % 3 AS string) AS model, 'backend' || CAST(user_id % 2 AS string) AS backend
FROM events
""",
    "fx_items": """
SELECT user_id AS job_id, user_id % 7 AS owner_id, event_id AS idx, 'scan_' || CAST(event_id AS string) || '.png' AS filename,
  CASE WHEN user_id % 20 = 4 THEN 'error'
       WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN user_id % 20 = 4 OR event_type = 'error' THEN
    split_part('ValueError|ConnectError|KeyError|RuntimeError', '|', CAST(event_id % 4 + 1 AS int)) END AS error_type,
  CASE WHEN user_id % 20 = 4 OR event_type = 'error' THEN
    split_part('bad page|Connection refused by host||errno 61|secret path|', '|', CAST(event_id % 6 + 1 AS int)) END AS error_text,
  event_type = 'purchase' AS verified, user_id % 10 = 1 AS job_cancelled, user_id % 11 = 2 AS job_running,
  props AS data
FROM events
""",
    # Sign-in attempts: a month of events squeezed into hours so that bursts occur.
    "fx_logins": """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END || CAST(user_id AS string) AS username,
  '10.0.0.' || CAST(user_id % 7 AS string) AS ip, event_type = 'purchase' AS success,
  CAST(floor({micros:ts} / 1000000.0 / 100) AS bigint) AS at_s
FROM events
""",
    # Raw model answers, some fenced, prefixed, cut or empty.
    "fx_responses": """
SELECT event_id AS doc_id,
  CASE CAST(event_id % 6 AS int)
    WHEN 0 THEN body
    WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 2 THEN 'answer: ' || body || ' note {}'
    WHEN 3 THEN substr(body, 1, length(body) - 1)
    WHEN 4 THEN substr(body, 1, length(body) - 2)
    ELSE CASE WHEN event_id % 4 = 1 THEN '' ELSE 'no object here' END END AS raw,
  CASE WHEN event_id % 12 = 11 THEN 'so it is ' || body ELSE '' END AS thinking
FROM (SELECT event_id, '{"child_fio": "' || event_type || '", "phone": "' || CAST(9000000000 + event_id AS string) || '"}' AS body FROM events) s
""",
    # A log of confirmed corrections; some rows are incomplete or of an unknown category.
    "fx_corrections": """
SELECT doc_id AS seq,
  split_part('surnames|organizations|surnames|first_names|cities|surnames|patronymics|colours', '|', CAST(doc_id % 8 + 1 AS int)) AS category,
  CASE WHEN doc_id % 9 = 4 THEN '' ELSE split_part('Бодров|ГУСД|Зодцов|АЛЕКСЕЙ|Липецк,|Добров|Влалимирович|рыжий', '|', CAST(doc_id % 8 + 1 AS int)) END AS wrong,
  CASE WHEN doc_id % 13 = 6 THEN '  ' WHEN doc_id % 3 = 0 THEN split_part('Бобров|РЖД|Бобров|Алексей|Липецк|Бобров|Владимирович|красный', '|', CAST(doc_id % 8 + 1 AS int))
       ELSE split_part(' Боброва|МВД|Бобров |Алексей|Липецк|Добров|Владимировна|красный', '|', CAST(doc_id % 8 + 1 AS int)) END AS right_value
FROM fx_person
""",
    # Dictionary entries seen in the data, besides the built-in ones.
    "fx_entries": """
SELECT DISTINCT category, value FROM (
  SELECT split_part('surnames|first_names|patronymics', '|', n) AS category,
    CASE n WHEN 1 THEN surname WHEN 2 THEN first_name ELSE 'Петровна' END AS value
  FROM (SELECT *, {rows:1,2,3} AS n FROM fx_person) a) b
""",
    # Text boxes per page (page = order).
    "fx_detections": """
SELECT o_orderkey AS page_id, n AS det_no,
  split_part('Контактный телефон:|9001234567|СНИЛС|112-233-445 95|Паспортные данные|45 12 123456', '|', n) AS text,
  CASE WHEN n % 2 = 1 THEN 40 ELSE 300 + CAST(o_orderkey % 40 AS int) END AS x1,
  CAST(100 * floor((n + 1) / 2.0) AS int) + CASE WHEN n % 2 = 0 THEN CAST(o_orderkey % 90 AS int) - 40 ELSE 0 END AS y1,
  CASE WHEN n % 2 = 1 THEN 260 ELSE 520 END AS x2,
  CAST(100 * floor((n + 1) / 2.0) AS int) + 30 + CASE WHEN n % 2 = 0 THEN CAST(o_orderkey % 90 AS int) - 40 ELSE 0 END AS y2,
  CASE WHEN (o_orderkey + n) % 10 = 0 THEN CAST(0.2 AS double) ELSE CAST(0.9 AS double) END AS score
FROM (SELECT o_orderkey, {rows:1,2,3,4,5,6} AS n FROM orders) s
""",
}

_DEPENDS = {
    name: [other for other in (*FIXTURES, *BASE_TABLES) if re.search(rf"\b{other}\b", text)]
    for name, text in FIXTURES.items()
}


def _needed(names: list[str]) -> list[str]:
    """Fixtures used by ``names``, dependencies first, and the base tables they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            if other != name:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _spark_text(text: str) -> str:
    text = re.sub(r"\{rows:([\d,]+)\}", r"explode(array(\1))", text)
    return re.sub(r"\{micros:(\w+)\}", r"unix_micros(CAST(\1 AS timestamp))", text)


def _duck_text(text: str) -> str:
    text = re.sub(r"\{rows:([\d,]+)\}", r"unnest(list_value(\1))", text)
    return re.sub(r"\{micros:(\w+)\}", r"epoch_us(\1)", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Applicants whose derived rows (up to 15 readings or fields each) one task makes.
APPLICANTS_PER_TASK = 4000


def _scan(spark: SparkSession, sf_dir: str, item: str) -> str:
    """SQL that reads a base table.

    A customer is a few bytes in the file and dozens of rows in the derived tables, so that the
    reader's split by bytes leaves millions of readings to one task. The keys are dealt by number of
    rows instead; what is made of them stays hashed by document, and is grouped without another shuffle.
    """
    path = f"{sf_dir}/{item}.parquet"
    if item != "customer":
        return f"SELECT * FROM parquet.`{path}`"
    tasks = -(-spark.read.parquet(path).count() // APPLICANTS_PER_TASK) or 1
    return f"SELECT /*+ REPARTITION({tasks}, c_custkey) */ c_custkey FROM parquet.`{path}`"


def derived(spark: SparkSession, sf_dir: str, name: str, views: dict[str, str] | None = None) -> DataFrame:
    """A derived table as a lazy DataFrame; ``views`` maps a base table to a (streaming) view."""
    use_utc(spark)
    views = views or {}
    parts = []
    for item in _needed([name]):
        if item in FIXTURES:
            parts.append(f"{item} AS ({_spark_text(FIXTURES[item])})")
        else:
            scan = f"SELECT * FROM {views[item]}" if item in views else _scan(spark, sf_dir, item)
            parts.append(f"{item} AS ({scan})")
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")


def check_sql(body: str) -> str:
    """DuckDB text: the derived tables that ``body`` names, as CTEs in front of it."""
    used = [name for name in FIXTURES if re.search(rf"\b{name}\b", body)]
    parts = [
        f"{item} AS ({_duck_text(FIXTURES[item])})" for item in _needed(used) if item in FIXTURES
    ]
    body = body.strip()
    if not parts:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return opening + ",\n".join(parts) + ",\n" + body[len(opening):]
    return "WITH " + ",\n".join(parts) + "\n" + body
