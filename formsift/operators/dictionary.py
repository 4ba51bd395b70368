"""Dictionary correction: custom mappings, exact entries, nearest entries.

Tables: dictionary ``category, value``; corrections ``category, wrong, right, seq``; tokens
``doc_id, field, part_no, word, category``. Matching works on the distinct words of the whole
table, never per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields, text
from formsift.functions.align import similarity
from formsift.session import settled

FIO_CATEGORIES = ["surnames", "first_names", "patronymics"]


def default_entries(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(category).alias("category"), F.lit(value).alias("value"))
        for category, values in S.DICTIONARY_DEFAULTS.items() for value in values
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def known_category(category: Column) -> Column:
    return category.isin(*S.DICTIONARY_DEFAULTS)


def valid_corrections(corrections: DataFrame) -> DataFrame:
    """Rows of a known category with a right-hand side, trimmed."""
    return corrections.withColumns({
        "wrong": text.strip(F.col("wrong")), "right": text.strip(F.col("right")),
    }).filter(known_category(F.col("category")) & (F.col("right") != ""))


def dictionary_entries(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Entries of all sources and the right-hand sides of corrections, each once."""
    rights = valid_corrections(corrections).select("category", F.col("right").alias("value"))
    return entries.select("category", "value").unionByName(rights).distinct()


def current_corrections(corrections: DataFrame) -> DataFrame:
    """Mapping in force per (category, folded wrong word): the latest one."""
    valid = valid_corrections(corrections).filter("wrong <> ''")
    return valid.groupBy("category", text.dict_norm(F.col("wrong")).alias("norm")).agg(
        F.max_by("right", "seq").alias("right")
    )


def new_corrections(existing: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed pairs to append: complete, and not what the mapping already says.

    With a ``seq`` column, a pair that equals the mapping is still kept when an earlier pair of
    the same table has changed that mapping.
    """
    pairs = confirmed.withColumns({
        name: text.strip(F.col(name)) for name in ("category", "wrong", "right")
    }).filter("category <> '' AND wrong <> '' AND right <> ''")
    pairs = pairs.withColumn("norm", text.dict_norm(F.col("wrong")))
    known = current_corrections(existing).withColumnRenamed("right", "in_force")
    joined = pairs.join(known, ["category", "norm"], "left")
    changes = ~F.coalesce(F.col("right") == F.col("in_force"), F.lit(False))
    if "seq" not in confirmed.columns:
        return joined.filter(changes).select(*confirmed.columns)
    first_change = joined.filter(changes).groupBy("category", "norm").agg(F.min("seq").alias("changed_at"))
    return joined.join(first_change, ["category", "norm"]).filter(
        changes | (F.col("seq") > F.col("changed_at"))
    ).select(*confirmed.columns)


def learned_pairs(accepted: DataFrame, *more: str) -> DataFrame:
    """Accepted changes ``field_part, field, from, to`` as correction pairs, with ``more`` columns."""
    return accepted.select(
        fields.correction_category(F.col("field_part"), F.col("field")).alias("category"),
        F.col("from").alias("wrong"), F.col("to").alias("right"), *more,
    )


def _threshold(category: Column) -> Column:
    pairs = [F.lit(x) for name, t in S.MATCH_THRESHOLDS.items() for x in (name, t)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(1.0))


def _numbered_letters(norm: Column) -> Column:
    """Letters from the end of the alphabet first, repeated ones told apart by a count."""
    letters = F.sort_array(F.split(norm, ""), asc=False)
    return F.transform(
        letters,
        lambda x, i: F.concat(x, (i + 1 - F.array_position(letters, x)).cast("string")),
    )


#: Letters whose frequency is told apart; the others count as rare.
FREQUENT_LETTERS = 512


def _letter_rank(words: DataFrame) -> Column:
    """Rank of the lambda's letter, rarest first, as measured over ``words``; a bounded list."""
    counts = words.select(F.explode(_numbered_letters(F.col("norm"))).alias("letter")).groupBy("letter").count()
    top = [r["letter"] for r in counts.orderBy(F.desc("count"), "letter").limit(FREQUENT_LETTERS).collect()]
    pairs = [F.lit(x) for rank, letter in enumerate(reversed(top), 1) for x in (letter, rank)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")


def _joined(prefix: Column, many: int) -> Column:
    """All combinations of so many letters of a prefix, each as one text."""
    if many == 1:
        return prefix
    rest = lambda i: F.slice(prefix, i + 2, F.size(prefix))
    return F.flatten(F.transform(prefix, lambda x, i: F.transform(
        _joined(rest(i), many - 1), lambda y: F.concat(x, F.lit("|"), y))))


def _with_letters(df: DataFrame, rank: Column) -> DataFrame:
    """Add the word's numbered letters, rarest first, and the keys of which a match shares one.

    The ratio of two words is at most their letter overlap, 2*shared/(m+n). For a ratio of t a
    word of m letters must share at least t*m/(2-t) of them. Two words that share s letters have
    the first k shared ones among the first m - s + k of each, so a combination of k letters of
    that prefix meets. Words too short to share k letters meet by one. Nothing is lost.
    """
    t, m = _threshold(F.col("category")), F.length("norm")
    needed = F.greatest(F.lit(1), F.ceil(m * t / (2 - t) - 1e-9))
    lettered = df.withColumn("letters", F.transform(
        F.array_sort(F.transform(_numbered_letters(F.col("norm")), lambda x: F.struct(
            F.coalesce(F.try_element_at(rank, x), F.lit(0)).alias("rank"), x.alias("letter")))),
        lambda e: e["letter"]))

    def first(least: Column, k: int) -> Column:
        return F.slice("letters", F.lit(1), F.greatest(F.lit(0), m - least + k).cast("int"))

    def keys(k: int) -> Column:
        many = _joined(first(F.greatest(needed, F.lit(k)), k), k)
        few = F.transform(first(needed, 1), lambda x: F.concat(F.lit("1|"), x))
        return F.when(needed < k, F.concat(many, few)).otherwise(many)

    # A low threshold takes longer prefixes, which three letters narrow as much as two do others.
    return lettered.withColumn("keys", F.when(t < 0.75, keys(3)).otherwise(keys(2)))


def candidate_pairs(words: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of ``words`` (category, norm) and ``known`` (category, to, norm) that share a key and
    whose lengths allow a match; a pair comes once for each key that it shares."""
    rank = _letter_rank(words.select("norm").unionByName(known.select("norm")))
    t, m = _threshold(F.col("category")), F.length("norm")
    shortest = F.greatest(F.lit(1), F.ceil(m * t / (2 - t) - 1e-9))
    lengths = F.sequence(shortest, F.greatest(shortest, F.floor(m * (2 - t) / t + 1e-9)))
    left = _with_letters(words, rank).withColumn("length", F.explode(lengths)).withColumn("key", F.explode("keys")).drop("keys")
    right = _with_letters(known, rank).select(
        "category", "to", F.col("norm").alias("known"), F.col("letters").alias("known_letters"),
        m.cast("long").alias("length"), F.explode("keys").alias("key"))
    return left.join(right, ["category", "key", "length"])


def nearest_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Best entry ``category, norm, to, score`` for each key with a score over its threshold.

    Candidates come from an equi-join on rare letters and length; the letter overlap is checked
    in the JVM, and only distinct surviving pairs reach the similarity function. Equal scores go
    to the smallest entry. Distinct words and entries are written first: the letters are counted
    and joined from them, and no condition on a word's keys is moved below their distinct to the rows.
    """
    words = settled(keys.filter("norm <> ''"), "dictionary-words")
    known = settled(entries, "dictionary-known").select("category", F.col("value").alias("to"), text.dict_norm(F.col("value")).alias("norm")).filter("norm <> ''")
    pairs = candidate_pairs(words, known)
    shared = F.size(F.array_intersect("letters", "known_letters"))
    bound = 2 * shared / (F.size("letters") + F.size("known_letters"))
    pairs = (
        pairs.filter(bound >= _threshold(F.col("category")) - 1e-9)
        .select("category", "norm", "to", "known").distinct()
    )
    scored = pairs.withColumn("score", similarity("norm", "known")).filter(
        F.col("score") >= _threshold(F.col("category"))
    )
    best = scored.groupBy("category", "norm").agg(
        F.min(F.struct((-F.col("score")).alias("cost"), F.col("to").alias("to"))).alias("best")
    )
    return best.select("category", "norm", F.col("best.to").alias("to"), (-F.col("best.cost")).alias("score"))


def resolve(keys: DataFrame, entries: DataFrame, corrections: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``category, norm, to, score, source`` for the distinct keys: custom, exact, then nearest.

    The distinct keys and entries are read by several joins, so both are written once first.
    """
    keys, entries = settled(keys, "dictionary-keys"), settled(entries, "dictionary-entries")
    custom = keys.join(
        current_corrections(corrections).withColumnRenamed("right", "to"), ["category", "norm"]
    ).select("category", "norm", "to", F.lit(1.0).alias("score"), F.lit("custom").alias("source"))
    open_keys = keys.join(custom, ["category", "norm"], "left_anti")
    by_norm = entries.groupBy("category", text.dict_norm(F.col("value")).alias("norm")).agg(
        F.min("value").alias("to")
    )
    exact = open_keys.join(by_norm, ["category", "norm"]).select(
        "category", "norm", "to", F.lit(1.0).alias("score"), F.lit("").alias("source")
    )
    found = custom.unionByName(exact)
    if fuzzy:
        rest = open_keys.join(by_norm, ["category", "norm"], "left_anti")
        found = found.unionByName(nearest_entries(rest, entries).withColumn("source", F.lit("")))
    return found


def fio_tokens(df: DataFrame, value: str = "value") -> DataFrame:
    """Words 1 to 3 of the name fields under their categories."""
    category = F.try_element_at(F.array(*[F.lit(x) for x in FIO_CATEGORIES]), (F.col("pos") + 1).cast("int"))
    return (
        df.filter(F.col("field").isin(S.CHILD_FIO, S.PARENT_FIO))
        .select("doc_id", "field", F.posexplode(text.words(F.col(value))))
        .select("doc_id", "field", F.col("pos").alias("part_no"), F.col("col").alias("word"),
                category.alias("category"), text.dict_norm(F.col("col")).alias("norm"))
        .filter("category IS NOT NULL")
    )


def text_tokens(df: DataFrame, value: str = "value") -> DataFrame:
    """Words of the address (cities) and passport (organisations) texts, looked up bare."""
    category = F.when(F.col("field") == S.ADDRESS, "cities").otherwise("organizations")
    bare = F.btrim(F.col("col"), F.lit(".,"))
    return (
        df.filter(F.col("field").isin(S.ADDRESS, S.PASSPORT))
        .select("doc_id", "field", F.posexplode(text.words(F.col(value))))
        .select("doc_id", "field", F.col("pos").alias("part_no"), F.col("col").alias("word"),
                category.alias("category"), text.dict_norm(bare).alias("norm"))
    )


def propose(tokens: DataFrame, entries: DataFrame, corrections: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Tokens with ``to, score, source`` where a change applies (null elsewhere)."""
    keys = tokens.filter("norm <> ''").select("category", "norm").distinct()
    # The answers per distinct word are written too: scoring runs once, whatever reads them.
    found = settled(resolve(keys, entries, corrections, fuzzy), "dictionary-answers")
    joined = tokens.join(found, ["category", "norm"], "left")
    applies = (F.col("source") == "custom") | (F.col("to") != F.col("word"))
    return joined.select(
        "doc_id", "field", "part_no", "category", "word",
        *[F.when(applies, F.col(name)).alias(name) for name in ("to", "score", "source")],
    )


def changes(proposed: DataFrame) -> DataFrame:
    """One row per changed word."""
    return proposed.filter("to IS NOT NULL").select(
        "doc_id", "field", "part_no", "category", F.col("word").alias("from"), "to",
        F.round("score", 3).alias("score"), "source",
    )


def rebuilt(records: DataFrame, proposed: DataFrame, value: str = "value") -> DataFrame:
    """``doc_id, field, corrected`` for the values with at least one changed word.

    Only the changed words are grouped; the texts meet them by (doc_id, field).
    """
    entry = F.struct("part_no", "to")
    patches = proposed.filter("to IS NOT NULL").groupBy("doc_id", "field").agg(
        F.map_from_entries(F.collect_list(entry)).alias("patch")
    )
    patched = F.transform(
        text.words(F.col(value)), lambda w, i: F.coalesce(F.try_element_at("patch", i), w)
    )
    return records.select("doc_id", "field", value).join(patches, ["doc_id", "field"]).select(
        "doc_id", "field", F.array_join(patched, " ").alias("corrected")
    )
