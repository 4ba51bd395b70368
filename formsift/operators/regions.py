"""Where on a page a field's value stands: labels first, then the boxes beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions.text import contains_any
from formsift.operators.ranking import number_rows

# Detection score floor and the pixel distances of the search.
MIN_SCORE = 0.25
LABEL_OVERLAP = 8
MIN_BAND = 30
PASSPORT_DEPTH = 180
MARGIN = 12
READING_BAND = 256

# Printed labels of the standard form.
LABEL_ALIASES = {
    S.APPLICATION_DATE: ["дата подачи", "дата подачи заявления"],
    S.CHILD_FIO: ["фио поступающего", "фамилия, имя, отчество поступающего", "поступающего (ребенка)"],
    S.BIRTH_DATE: ["дата и место рождения", "дата рождения ребенка", "дата рождения"],
    S.TARGET_CLASS: ["желаемый класс", "профиль обучения", "класс"],
    S.PARENT_FIO: ["фио родителя", "фио заявителя", "родителя (законного представителя)"],
    S.PASSPORT: ["паспортные данные", "паспорт"],
    S.ADDRESS: ["адрес регистрации", "фактического проживания", "адрес проживания"],
    S.PHONE: ["контактный номер телефона", "контактный телефон", "телефон для связи"],
    S.SNILS: ["страховой номер", "снилс", "лицевого счета"],
    S.NOTES: ["дополнительные сведения", "наличие льгот", "особые отметки"],
}


def reading_order(detections: DataFrame) -> DataFrame:
    """Number the boxes of each page from top to bottom, then left to right."""
    return number_rows(
        detections, [F.col("y1"), F.col("x1"), F.col("det_no")],
        F.floor(F.col("y1") / READING_BAND), "reading_no", keys=["page_id"],
    )


def locate_fields(detections: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Region ``x1, y1, x2, y2`` per (page_id, field).

    Only the first box in reading order that contains an alias is a field's label, so the
    second join has at most one label row per page and field and stays linear in the boxes.
    """
    aliases = aliases or LABEL_ALIASES
    boxes = detections.filter(F.col("score") >= MIN_SCORE)
    norm = F.regexp_replace(F.lower("text"), "[^а-яё0-9 ]", " ")
    box = F.struct("y1", "x1", "det_no", "x2", "y2")

    def label_of(names: list[str]) -> Column:
        return F.min(F.when(contains_any(norm, names), box))

    found = boxes.groupBy("page_id").agg(
        *[label_of(names).alias(f"label_{i}") for i, names in enumerate(aliases.values())]
    )
    pairs = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(f"label_{i}").alias("label"))
        for i, field in enumerate(aliases)
    ])
    labels = found.select("page_id", F.inline(pairs)).filter("label IS NOT NULL").select(
        "page_id", "field", *[F.col(f"label.{c}").alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    band = F.greatest(F.lit(MIN_BAND), 2 * (F.col("ly2") - F.col("ly1")))
    beside = F.col("x1") >= F.col("lx2") - LABEL_OVERLAP
    near = F.when(
        F.col("field") == S.PASSPORT,
        F.col("y1").between(F.col("ly1"), F.col("ly1") + PASSPORT_DEPTH),
    ).otherwise(F.abs(F.col("y1") - F.col("ly1")) <= band)
    values = boxes.select("page_id", "x1", "y1", "x2", "y2").join(labels, "page_id").filter(beside & near)
    return values.groupBy("page_id", "field").agg(
        F.greatest(F.lit(0), F.min("lx2") - LABEL_OVERLAP).alias("x1"),
        F.greatest(F.lit(0), F.min("ly1") - LABEL_OVERLAP).alias("y1"),
        (F.max("x2") + MARGIN).alias("x2"), (F.max("y2") + MARGIN).alias("y2"),
    )
