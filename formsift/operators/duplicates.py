"""Duplicate applications: inside a batch and against a journal.

A hot key must not produce its square of pairs. Each record therefore gets, per reason, the
number of its earlier matches, and the first of them; together with the keys this says the
same as the pair list, in space linear in the records. ``matches_of`` lists the pairs of
chosen records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import dates, text
from formsift.operators.ranking import BUCKETS, count_earlier
from formsift.operators.stages import computed
from formsift.session import settled

# Header fragments (normalised) that decide a column's role, in order.
SNILS_PARTS = ["снилс"]
PARENT_PARTS = ["родител", "заявител", "представител"]
BIRTH_PARTS = ["рождени"]
NAME_PARTS = ["фио", "ученик", "ребенок", "учащ", "поступающ"]


def key_columns(snils: Column, name: Column, birth: Column) -> list[Column]:
    """Comparison keys of a record; ``snils`` is null unless it has eleven digits."""
    digits = text.digits_only(snils)
    return [
        F.when(F.length(digits) == 11, digits).alias("snils"),
        text.normalize_header(name).alias("name"),
        text.digits_only(birth).alias("birth"),
    ]


def record_keys(df: DataFrame) -> DataFrame:
    """Keys of long records ``(doc_id, key_ord, key, value)``; the last fitting key wins."""
    header = text.normalize_header(F.col("key"))
    role = (
        F.when(text.contains_any(header, SNILS_PARTS), "snils")
        .when(text.contains_any(header, PARENT_PARTS), "ignored")
        .when(text.contains_any(header, BIRTH_PARTS), "birth")
        .when(text.contains_any(header, NAME_PARTS), "name")
    )

    def last(which: str) -> Column:
        return F.max_by(
            F.when(role == which, text.blank_to_empty(F.col("value"))),
            F.when(role == which, F.col("key_ord")),
        )

    values = df.groupBy("doc_id").agg(*[last(r).alias(f"_{r}") for r in ("snils", "name", "birth")])
    return values.select(
        "doc_id", *key_columns(F.col("_snils"), F.col("_name"), F.col("_birth"))
    )


def application_keys(df: DataFrame) -> DataFrame:
    """Keys of wide applications, dates compared in their normal form."""
    return df.select(
        "doc_id", "filename",
        *key_columns(F.col("snils"), F.col("child_fio"), dates.format_date(F.col("birth_date"))),
    )


def _join_key(key: str) -> Column:
    """The key, or a value of its own for a record without one, so that these do not pile up."""
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("#"), F.col("doc_id")))


def _first(condition: Column | None = None) -> Column:
    member = F.struct("doc_id", "filename")
    return F.min(member if condition is None else F.when(condition, member))


def _repeated(keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First members of the groups that have more than one: by number, name+birth, name."""
    by_snils = (
        keys.filter("snils IS NOT NULL").groupBy("snils")
        .agg(F.count("*").alias("_n"), _first().alias("first_snils")).filter("_n > 1").drop("_n")
    )
    by_pair = (
        keys.filter("name <> ''").groupBy("name", "birth")
        .agg(F.count("*").alias("_n"), _first().alias("first_pair"))
    )
    by_name = by_pair.groupBy("name").agg(
        F.sum("_n").alias("_total"), F.min("first_pair").alias("first_name"),
        F.min(F.when(F.col("birth") == "", F.col("first_pair"))).alias("first_blank"),
    ).filter("_total > 1").drop("_total")
    return by_snils, by_pair.filter("_n > 1 AND birth <> ''").drop("_n"), by_name


def level_entries(keys: DataFrame) -> DataFrame:
    """Every record once for each grouping that it belongs to: by number, name, name and birth,
    and the last two once more together with the number; ``blank`` without a birth date."""
    none = F.lit(None).cast("string")
    name = F.when(F.col("name") != "", F.col("name"))
    birth = F.when(F.col("birth") != "", F.col("birth"))
    snils = F.col("snils")

    def grouping(level: str, s: Column, n: Column, b: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), s.alias("ks"), n.alias("kn"), b.alias("kb"))

    return keys.select("doc_id", (F.col("birth") == "").alias("blank"), F.inline(F.array(
        F.when(snils.isNotNull(), grouping("snils", snils, none, none)),
        F.when(name.isNotNull(), grouping("name", none, name, none)),
        F.when(name.isNotNull() & snils.isNotNull(), grouping("name_snils", snils, name, none)),
        F.when(name.isNotNull() & birth.isNotNull(), grouping("pair", none, name, birth)),
        F.when(
            name.isNotNull() & birth.isNotNull() & snils.isNotNull(),
            grouping("pair_snils", snils, name, birth),
        ),
    ))).filter("level IS NOT NULL")


def _earlier_matches(members: DataFrame, buckets: int) -> DataFrame:
    """Earlier matches per record and reason; a pair with equal numbers counts as that only.

    All groupings are counted in one pass.
    """
    entries = level_entries(members)
    counted = count_earlier(entries, ["level", "ks", "kn", "kb"], "doc_id", "blank", buckets)

    return _level_sums(counted, "earlier", "earlier_flagged")


def level_totals(entries: DataFrame, groups: DataFrame, grouping: list[str]) -> DataFrame:
    """Matches per record among the records that ``groups`` counts: per grouping ``n`` in all and
    ``undated`` ones. A hot grouping is one row of ``groups``."""
    same = lambda df: df.withColumn("_group", F.struct(*grouping))
    met = same(entries).join(same(groups).select("_group", "n", "undated"), "_group")
    return _level_sums(met, "n", "undated").filter("n_snils + n_name_birth + n_name > 0")


def _level_sums(counted: DataFrame, all_matches: str, undated: str) -> DataFrame:
    """Matches per record and reason from those of the groupings it belongs to."""

    def total(level: str, plus: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level") == level, plus)), F.lit(0))

    # A record without birth date matches every earlier namesake, others the undated ones.
    namesakes, every = F.when(F.col("blank"), F.col(all_matches)).otherwise(F.col(undated)), F.col(all_matches)
    return counted.groupBy("doc_id").agg(
        total("snils", every).alias("n_snils"),
        (total("pair", every) - total("pair_snils", every)).alias("n_name_birth"),
        (total("name", namesakes) - total("name_snils", namesakes)).alias("n_name"),
    )


def batch_duplicates(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Records with at least one earlier match: counts per reason and the earliest match.

    ``keys`` holds ``doc_id, filename, snils, name, birth`` with a unique integer ``doc_id``
    that gives the batch order.
    """
    by_snils, by_pair, by_name = _repeated(keys)
    spread = keys.withColumns({"_s": _join_key("snils"), "_n": _join_key("name")})
    members = settled(
        spread.join(by_snils.withColumnRenamed("snils", "_s"), "_s", "left")
        .join(by_pair.withColumnRenamed("name", "_n"), ["_n", "birth"], "left")
        .join(by_name.withColumnRenamed("name", "_n"), "_n", "left")
        .filter("first_snils IS NOT NULL OR first_name IS NOT NULL")
        .drop("filename", "_s", "_n"),
        "duplicate-members",
    )
    counted = members.join(_earlier_matches(members, buckets), "doc_id")
    blank = F.col("birth") == ""

    def if_earlier(first: Column) -> Column:
        return F.when(first.doc_id < F.col("doc_id"), first)

    firsts = {
        "_snils": if_earlier(F.col("first_snils")),
        "_pair": if_earlier(F.col("first_pair")),
        "_name": if_earlier(F.when(blank, F.col("first_name")).otherwise(F.col("first_blank"))),
    }
    first = F.least(F.col("_snils"), F.col("_pair"), F.col("_name"))
    reason = (
        F.when(first == F.col("_snils"), S.REASON_SNILS)
        .when(first == F.col("_pair"), S.REASON_NAME_BIRTH)
        .otherwise(S.REASON_NAME)
    )
    return (
        computed(counted, firsts)
        .filter("n_snils + n_name_birth + n_name > 0")
        .select(
            "doc_id", "n_snils", "n_name_birth", "n_name",
            first.doc_id.alias("first_index"), first.filename.alias("duplicate_of"),
            reason.alias("first_reason"),
        )
    )


def annotate(records: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Every record with its duplicate counts; records without matches get zero."""
    joined = records.join(duplicates, "doc_id", "left")
    counts = ["n_snils", "n_name_birth", "n_name"]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) for n in counts])
    return joined.withColumn("n_duplicates", total)


def originals(keys: DataFrame, key: str) -> DataFrame:
    """First member of every group of equal keys, next to each member."""
    firsts = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias("original"))
    return keys.join(firsts, key, "inner").select("doc_id", key, "original")


def journal_duplicates(
    incoming: DataFrame, journal: DataFrame, undated_rows: bool = False, details: tuple[str, ...] = ()) -> DataFrame:
    """Incoming records with a match in the journal: counts per reason and the first row.

    ``details`` are columns of the journal that the first row brings along, as ``row_<name>``.

    The journal is reduced to one row per key before any join, so a key that fills a third of
    either side costs one match per incoming record. A match by name alone needs an incoming
    record without birth date; ``undated_rows`` also lets journal rows without one match, the
    rule inside a batch.
    """
    # One pass over the journal; all levels are rolled up from its distinct keys.
    finest = settled(journal.filter("name <> '' OR snils IS NOT NULL").groupBy("name", "birth", "snils").agg(
        F.count("*").alias("_n"), F.min(F.struct("doc_id", *details)).alias("_first")
    ), "journal-keys")
    undated = F.when(F.col("birth") == "", F.col("_n"))
    undated_first = F.when(F.col("birth") == "", F.col("_first"))

    def rolled(keys: list[str], tag: str) -> DataFrame:
        return finest.filter(f"name <> '' AND {keys[-1]} IS NOT NULL").groupBy(*keys).agg(
            F.sum("_n").alias(f"n_{tag}"), F.min("_first").alias(f"first_{tag}"),
            F.sum(undated).alias(f"undated_{tag}"), F.min(undated_first).alias(f"undated_first_{tag}"),
        )

    by_snils = finest.filter("snils IS NOT NULL").groupBy("snils").agg(
        F.sum("_n").alias("n_s"), F.min("_first").alias("first_s")
    )
    spread = incoming.withColumns({"_s": _join_key("snils"), "_n": _join_key("name")})
    joined = spread.join(by_snils.withColumnRenamed("snils", "_s"), "_s", "left")
    for keys, tag in (
        (["name"], "name"), (["name", "birth"], "pair"),
        (["name", "snils"], "name_s"), (["name", "birth", "snils"], "pair_s"),
    ):
        side = rolled(keys, tag).withColumnsRenamed({"name": "_n", "snils": "_s"})
        joined = joined.join(side, [{"name": "_n", "snils": "_s"}.get(k, k) for k in keys], "left")
    blank = F.col("birth") == ""

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    by_undated = n("undated_name") - n("undated_name_s") if undated_rows else F.lit(0)
    first_undated = F.col("undated_first_name") if undated_rows else F.when(F.lit(False), F.col("undated_first_name"))
    counts = computed(joined, {
        "n_snils": n("n_s"),
        "n_name_birth": F.when(~blank, n("n_pair") - n("n_pair_s")).otherwise(0),
        "n_name": F.when(blank, n("n_name") - n("n_name_s")).otherwise(by_undated),
        "_snils": F.col("first_s"),
        "_pair": F.when(~blank, F.col("first_pair")),
        "_name": F.when(blank, F.col("first_name")).otherwise(first_undated),
    })
    first = F.least("_snils", "_pair", "_name")
    reason = (
        F.when(first == F.col("_snils"), S.REASON_SNILS)
        .when(first == F.col("_pair"), S.REASON_NAME_BIRTH).otherwise(S.REASON_NAME)
    )
    return counts.filter("n_snils + n_name_birth + n_name > 0").select(
        "doc_id", "n_snils", "n_name_birth", "n_name",
        first.doc_id.alias("first_row"), reason.alias("first_reason"), *[first[name].alias(f"row_{name}") for name in details],
    )


def matches_of(selected: DataFrame, keys: DataFrame) -> DataFrame:
    """All earlier matches ``(doc_id, index, duplicate_of, reason)`` of the chosen records.

    Meant for the records on a reviewer's screen; the output grows with their matches only.
    """
    a, b = selected.alias("a"), keys.alias("b")
    earlier = F.col("b.doc_id") < F.col("a.doc_id")
    by_snils = a.join(b, (F.col("a.snils") == F.col("b.snils")) & earlier)
    blank = (F.col("a.birth") == "") | (F.col("b.birth") == "")
    same_birth = F.col("a.birth") == F.col("b.birth")
    same_snils = F.coalesce(F.col("a.snils") == F.col("b.snils"), F.lit(False))
    by_name = a.join(
        b, (F.col("a.name") == F.col("b.name")) & (F.col("a.name") != "") & earlier
        & (blank | same_birth) & ~same_snils,
    )

    def shaped(df: DataFrame, reason: Column) -> DataFrame:
        return df.select(
            F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("index"),
            F.col("b.filename").alias("duplicate_of"), reason.alias("reason"),
        )

    return shaped(by_snils, F.lit(S.REASON_SNILS)).unionByName(
        shaped(by_name, F.when(blank, S.REASON_NAME).otherwise(S.REASON_NAME_BIRTH))
    )
