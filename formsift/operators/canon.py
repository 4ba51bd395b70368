"""Field names of a record: projection, canonical names, headers, review predicates.

Long tables carry one row per (doc_id, key); a record's open key set lives in rows, so new
fields need no schema change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields, text

# Columns a log row may carry; anything else could hold personal data.
LOG_COLUMNS = [
    "id", "ts", "username", "action", "ok", "elapsed_ms", "model", "backend",
    "files", "ok_files", "error_files", "job_status",
]


def target_fields(df: DataFrame, key: str = "key") -> DataFrame:
    """Keep the keys that name readable fields."""
    name = F.col(key)
    return df.filter(~F.startswith(name, F.lit("№")) & ~name.isin(*S.SERVICE_FIELDS))


def strip_internal(df: DataFrame, key: str = "key") -> DataFrame:
    return df.filter(~F.startswith(F.col(key), F.lit("_")))


def _alias_hit(target: str, key: Column, value: Column) -> Column:
    low = F.lower(key)
    hit = (key != target) & ~text.is_blank(value) & text.contains_any(low, S.ALIAS_RULES[target])
    if target in S.ALIAS_EXCLUSIONS:
        hit = hit & ~text.contains_any(low, S.ALIAS_EXCLUSIONS[target])
    if "фио" in target.lower():
        hit = hit & ~F.rlike(value, F.lit("[0-9]"))
    return hit


def canonical_fields(df: DataFrame) -> DataFrame:
    """One row per (doc_id, standard field) from raw keys ``(doc_id, key_ord, key, value)``.

    A target keeps its own value, then that of its technical key; a blank one takes the first
    key, in record order, that contains one of its aliases. Everything is a conditional
    aggregate of one ``groupBy(doc_id)``, so partial aggregation runs before the shuffle and
    no record is collected.
    """
    key, value = F.col("key"), F.col("value")
    order = F.col("key_ord")
    technical = {russian: english for english, russian in S.ENGLISH_KEYS.items()}

    def by_key(name: str) -> Column:
        return F.max(F.when(key == name, text.strip(value)))

    aggregates = []
    for i, target in enumerate(S.ALIAS_RULES):
        hit = _alias_hit(target, key, value)
        aggregates += [
            by_key(target).alias(f"own_{i}"),
            by_key(technical[target]).alias(f"technical_{i}"),
            F.min_by(F.when(hit, text.strip(value)), F.when(hit, order)).alias(f"alias_{i}"),
        ]
    wide = df.groupBy("doc_id").agg(*aggregates)

    def resolved(i: int) -> Column:
        own = F.coalesce(F.col(f"own_{i}"), F.col(f"technical_{i}"))
        return F.coalesce(F.nullif(own, F.lit("")), F.col(f"alias_{i}"), own)

    pairs = F.array(*[
        F.struct(F.lit(target).alias("field"), resolved(i).alias("value"))
        for i, target in enumerate(S.ALIAS_RULES)
    ])
    return wide.select("doc_id", F.inline(pairs))


def warning_count(df: DataFrame) -> DataFrame:
    """Flagged fields per record."""
    flagged = fields.needs_review(F.col("field"), F.col("value"), F.col("status"))
    return df.groupBy("doc_id").agg(F.count_if(flagged).alias("warnings"))


def review_groups(df: DataFrame, only_flagged: bool = False) -> DataFrame:
    """Screen group of each field; the map of ten names is part of the plan, not a join."""
    pairs = [F.lit(x) for group, names in S.FIELD_GROUPS.items() for n in names for x in (n, group)]
    out = df.withColumn("field_group", F.try_element_at(F.create_map(*pairs), F.col("field")))
    if only_flagged:
        out = out.filter(
            fields.needs_review(F.col("field"), F.col("value"), F.col("status"))
        )
    return out


def skip_reason(
    field: Column, mode: Column, explicit_reason: Column, assist: Column, image: Column,
    detector: Column, locator_failed: Column, located: Column,
) -> Column:
    """Why a field is not re-read; blank when it is. The first reason that holds wins."""
    selected = (mode == "paddle") | field.isin(*S.CRITICAL_FIELDS)
    return (
        F.when(text.blank_to_empty(explicit_reason) != "", explicit_reason)
        .when(mode == "vlm", "mode_disabled")
        .when(~assist, "assist_disabled")
        .when(~image, "image_unavailable")
        .when(~detector, "paddle_unavailable")
        .when(~selected, "field_not_selected")
        .when(locator_failed, "locator_error")
        .when(~located, "region_not_found")
        .otherwise("")
    )


def pii_safe(df: DataFrame) -> DataFrame:
    """Only the columns a log may hold."""
    return df.select(*[name for name in LOG_COLUMNS if name in df.columns])


def review_status(verified: Column, has_duplicates: Column) -> Column:
    return (
        F.when(verified & has_duplicates, S.STATUS_VERIFIED_DUP)
        .when(verified, S.STATUS_VERIFIED)
        .when(has_duplicates, S.STATUS_DUP)
        .otherwise(S.STATUS_REVIEW)
    )


def header_group(name: Column) -> Column:
    """Synonym group of a header; the first group that fits wins."""
    norm = text.normalize_header(name)
    chain = None
    for group, parts in S.HEADER_GROUPS.items():
        hit = text.contains_any(norm, parts)
        chain = F.when(hit, group) if chain is None else chain.when(hit, group)
    return chain


def match_header(existing: list[str], field: Column) -> Column:
    """Column of ``existing`` that takes ``field``: exact, then normalised, then synonym group.

    ``existing`` is the header of one table. The three lookup arrays are constants that
    Catalyst folds, so matching is one expression without a join.
    """
    names = F.array(*[F.lit(n) for n in existing])
    norms = F.array(*[text.normalize_header(F.lit(n)) for n in existing])
    groups = F.array(*[header_group(F.lit(n)) for n in existing])
    tiers = [
        F.array_position(names, field),
        F.array_position(norms, text.normalize_header(field)),
        F.coalesce(F.array_position(groups, header_group(field)), F.lit(0)),
    ]
    place = F.when(tiers[0] > 0, tiers[0]).when(tiers[1] > 0, tiers[1]).otherwise(tiers[2])
    return F.when(place > 0, F.try_element_at(names, place.cast("int")))
