"""Raw model answers to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift.functions import text
from formsift.functions.text import let

# Balanced object up to depth two, and the texts of the two failures.
OBJECT_BLOCK = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
EMPTY_ANSWER = "%s вернул пустой ответ: провайдер модели не прислал текст. " \
    "Повторите распознавание или выберите другую модель."
UNREADABLE_ANSWER = "Не удалось распарсить ответ модели"

FIELD_MAP = T.MapType(T.StringType(), T.StringType())


def _object(c: Column) -> Column:
    """Map of a JSON object with at least one member, else null.

    Inside brackets the parser rejects text after the object, which it ignores otherwise.
    """
    parsed = F.from_json(
        F.concat(F.lit("["), c, F.lit("]")), T.ArrayType(FIELD_MAP), {"allowSingleQuotes": "false"}
    )
    return let(parsed, lambda p: F.when((F.size(p) == 1) & (F.size(p[0]) > 0), p[0]))


def parse_model_json(c: Column) -> Column:
    """Longest balanced block that parses, else the text between the outermost braces."""
    bare = F.regexp_replace(text.blank_to_empty(c), r"```(?:json)?\s*", "")

    def parse(clean: Column) -> Column:
        blocks = F.transform(
            F.regexp_extract_all(clean, F.lit(OBJECT_BLOCK), F.lit(0)),
            lambda b, i: F.struct((-F.length(b)).alias("size"), i.alias("place"), b.alias("body")),
        )
        parsed = F.transform(F.array_sort(blocks), lambda b: _object(b["body"]))
        found = F.filter(parsed, lambda m: m.isNotNull())
        outer = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
        return F.coalesce(F.try_element_at(found, F.lit(1)), _object(outer))

    return let(bare, parse)


def repair_model_json(c: Column) -> Column:
    """Close a cut answer: a missing quote, then a missing brace."""
    start = text.strip(F.regexp_extract(text.blank_to_empty(c), r"(?s)\{.*", 0))

    def close(t: Column) -> Column:
        odd = F.length(F.regexp_replace(t, '[^"]', "")) % 2 == 1
        quoted = F.when(odd, F.concat(t, F.lit('"'))).otherwise(t)
        return F.when(F.endswith(quoted, F.lit("}")), quoted).otherwise(F.concat(quoted, F.lit("\n}")))

    return F.when(F.startswith(start, F.lit("{")), _object(let(start, close)))


def parse_answer(content: Column, thinking: Column) -> Column:
    """Fields of an answer: its text first, then its reasoning, then both repaired."""
    return F.coalesce(
        parse_model_json(content), parse_model_json(thinking),
        repair_model_json(content), repair_model_json(thinking),
    )


def answer_error(content: Column, thinking: Column, backend: str) -> Column:
    blank = text.is_blank(content) & text.is_blank(thinking)
    return F.when(blank, EMPTY_ANSWER % backend).otherwise(UNREADABLE_ANSWER)


def answers_to_fields(df: DataFrame, backend: str = "") -> DataFrame:
    """Long rows ``doc_id, key_ord, key, value, error``; a failed answer gives one error row.

    Map entries keep the order of the answer.
    """
    content, thinking = F.col("raw"), F.col("thinking")
    answer = df.select("doc_id", parse_answer(content, thinking).alias("answer"),
                       answer_error(content, thinking, backend).alias("failure"))
    rows = answer.select("doc_id", "answer", "failure", F.posexplode_outer("answer"))
    return rows.select(
        "doc_id", F.coalesce("pos", F.lit(0)).alias("key_ord"), "key", "value",
        F.when(F.col("answer").isNull(), F.col("failure")).alias("error"),
    )


def decode_payload(data_url: Column) -> Column:
    """Bytes of a data URL or bare base64 text; null when it is not strict base64."""
    body = F.regexp_replace(data_url, "(?s)^[^,]*,", "")
    strict = F.rlike(body, F.lit(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"))
    return F.when(strict, F.try_to_binary(body, F.lit("base64")))


def payload_kind(content: Column) -> Column:
    """Kind of file by its first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return (
        F.when(head == "255044462D", "pdf")
        .when(F.startswith(head, F.lit("89504E47")), "png")
        .otherwise("other")
    )


def field_statuses(records: DataFrame, column: str) -> DataFrame:
    """``doc_id, field, status, verified`` of the ``_fields`` metadata in a record's JSON; a record that
    is not JSON, or has no metadata, gives no rows."""
    schema = "_fields map<string, struct<status: string, verified: boolean>>"
    fields_ = F.from_json(F.col(column), schema)["_fields"]
    return records.select("doc_id", F.explode(fields_).alias("field", "meta")).select("doc_id", "field", "meta.status", "meta.verified")
