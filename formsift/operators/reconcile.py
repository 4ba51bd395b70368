"""Reconciling several readings of one field.

``tally`` turns readings into one row per (doc_id, field): equal readings are counted before
the second shuffle, so a field read a billion times with few distinct answers stays small.
Everything after it is column expressions over that row.

Readings: ``doc_id, field, kind, view_no, value, status, error`` with kind ``page``, ``view``
or ``adjudication``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields, text
from formsift.functions.text import let
from formsift.operators.stages import computed


def ballots(readings: DataFrame) -> DataFrame:
    """Readings counted per (doc_id, field, kind, comparison key)."""
    field = F.col("field")
    usable = fields.candidate_value(F.col("value"), F.col("status"), F.col("error"))
    shown = F.when(F.col("kind") == "page", text.strip(F.col("value"))).otherwise(usable)
    failed = text.blank_to_empty(F.col("error")) != ""
    # Staged, so that each step is a method small enough for the JVM to compile.
    staged = computed(readings.select("doc_id", "field", "kind", "view_no", "value", "status", "error"), {
        "text": shown, "failed": failed}).drop("value", "status", "error")
    staged = computed(staged, {"cmp": fields.comparison_value(field, F.col("text"))})
    staged = computed(staged, {"votable": (F.col("text") == "") | fields.votable_shape(field, F.col("text"))})
    return (
        staged.groupBy("doc_id", "field", "kind", "cmp")
        .agg(
            F.count("*").alias("attempted"),
            F.count_if(~F.col("failed")).alias("completed"),
            F.count_if(F.col("text") != "").alias("n"),
            F.min(F.when(F.col("text") != "", F.struct("view_no", "text"))).alias("first"),
            F.bool_and("votable").alias("votable"),
        )
    )


def tally(readings: DataFrame) -> DataFrame:
    """One row per (doc_id, field).

    ``page`` page text; ``options`` distinct usable views in first-seen order with their vote
    counts; ``usable`` number of usable views; ``votable`` all of them can vote by digit;
    ``second`` the adjudication text; ``attempted``/``completed`` reads of views, ``checks``/``checks_done``
    those of views and adjudications (null without any).
    """
    view, check = F.col("kind") == "view", F.col("kind") != "page"
    option = F.struct(
        F.col("first.view_no").alias("view_no"), F.col("cmp"), F.col("n"), F.col("first.text").alias("text")
    )
    grouped = ballots(readings).groupBy("doc_id", "field").agg(
        F.max(F.when(F.col("kind") == "page", F.col("first.text"))).alias("page"),
        F.max(F.when(F.col("kind") == "adjudication", F.col("first.text"))).alias("second"),
        F.sort_array(F.collect_list(F.when(view & (F.col("n") > 0), option))).alias("ballots"),
        F.coalesce(F.sum(F.when(view, F.col("n"))), F.lit(0)).alias("usable"),
        F.coalesce(F.bool_and(F.when(view, F.col("votable"))), F.lit(False)).alias("votable"),
        F.coalesce(F.sum(F.when(view, F.col("attempted"))), F.lit(0)).alias("attempted"),
        F.coalesce(F.sum(F.when(view, F.col("completed"))), F.lit(0)).alias("completed"),
        F.sum(F.when(check, F.col("attempted"))).alias("checks"),
        F.sum(F.when(check, F.col("completed"))).alias("checks_done"),
    )
    page = text.blank_to_empty(F.col("page"))
    return computed(grouped, {
        "page": page,
        "page_cmp": fields.comparison_value(F.col("field"), page),
        "page_valid": fields.structurally_valid(F.col("field"), page),
        "second": text.blank_to_empty(F.col("second")),
        "options": F.filter("ballots", lambda o: o["cmp"] != ""),
    }).drop("ballots")


def _positions(options: Column) -> Column:
    """Per position the leading digit: struct(n, rank, digit), smallest digit on ties."""

    def at(p: Column) -> Column:
        def vote(o: Column) -> Column:
            digit = F.substr(o["cmp"], p, F.lit(1))
            same = F.aggregate(
                options, F.lit(0).cast("long"),
                lambda acc, other: acc + F.when(F.substr(other["cmp"], p, F.lit(1)) == digit, other["n"]).otherwise(0),
            )
            return F.struct(same.alias("n"), (-F.ascii(digit)).alias("rank"), digit.alias("digit"))

        return F.array_max(F.transform(options, vote))

    return F.transform(F.sequence(F.lit(1), F.length(options[0]["cmp"])), at)


def with_digit_vote(tallied: DataFrame) -> DataFrame:
    """Add ``vote``: struct(unresolved, consensus) when the views can vote digit by digit."""
    options, field = F.col("options"), F.col("field")
    length = fields.votable_length(field)
    total = F.aggregate(options, F.lit(0).cast("long"), lambda a, o: a + o["n"])
    eligible = (
        F.col("votable") & (F.col("usable") >= 2) & (total == F.col("usable"))
        & F.forall(options, lambda o: F.length(o["cmp"]) == length)
    )

    def shown(digits: Column) -> Column:
        date = F.regexp_replace(digits, r"^(\d{2})(\d{2})(\d{4})\z", "$1.$2.$3")
        return F.when(F.contains(F.lower(field), F.lit("дата")), date).otherwise(digits)

    def outcome(p: Column) -> Column:
        accepted = F.transform(p, lambda x: (x["n"] >= 2) & (2 * x["n"] > F.col("usable")))
        unresolved = F.filter(
            F.transform(accepted, lambda ok, i: F.when(~ok, i + 1)), lambda i: i.isNotNull()
        )
        joined = F.array_join(F.transform(p, lambda x: x["digit"]), "")
        return F.struct(
            unresolved.alias("unresolved"),
            F.when(F.size(unresolved) == 0, shown(joined)).alias("digits"),
        )

    # An answer of more than half of the views, the usual case, leads at every position: no count is needed.
    agreed = F.struct(
        F.array().cast("array<int>").alias("unresolved"), shown(F.col("lead.cmp")).alias("digits")
    )
    raw = F.when(F.col("eligible"), F.when(
        (F.col("lead.n") >= 2) & (2 * F.col("lead.n") > F.col("usable")), agreed
    ).otherwise(let(_positions(options), outcome)))
    lead = F.array_max(F.transform(options, lambda o: F.struct(o["n"].alias("n"), o["cmp"].alias("cmp"))))
    staged = computed(tallied, {"eligible": eligible, "lead": lead})
    voted = computed(staged, {"raw_vote": raw}).drop("eligible", "lead")
    return computed(voted, {
        "unresolved": F.col("raw_vote.unresolved"),
        "consensus": text.blank_to_empty(fields.auto_format(field, F.col("raw_vote.digits"))),
    }).drop("raw_vote")


def majority(options: Column, usable: Column) -> Column:
    """First text of the largest group with at least two votes and over half; else blank."""
    ranked = F.array_max(F.transform(
        options, lambda o: F.struct(o["n"].alias("n"), (-o["view_no"]).alias("rank"), o["text"].alias("text"))
    ))
    wins = (ranked["n"] >= 2) & (2 * ranked["n"] > usable)
    return F.coalesce(F.when(wins, ranked["text"]), F.lit(""))


def checksum_winner(page: Column, page_valid: Column, page_cmp: Column, options: Column, field: Column) -> Column:
    """The only distinct value, page included, whose checksum holds; else null."""
    good = F.filter(options, lambda o: fields.snils_text_valid(o["text"]))
    others = F.filter(good, lambda o: o["cmp"] != page_cmp)
    n = F.size(others) + F.when(page_valid, 1).otherwise(F.when(F.size(good) > F.size(others), 1).otherwise(0))
    # For one key the view's text wins over the page's.
    return F.when(
        F.contains(F.lower(field), F.lit("снилс")),
        F.when(n == 1, F.coalesce(F.try_element_at(good, F.lit(1))["text"], page)),
    )


def multi_view(readings: DataFrame) -> DataFrame:
    """Decide every numeric field from its page reading and views; the first rule that fits wins."""
    field, page, options = F.col("field"), F.col("page"), F.col("options")
    voted = computed(with_digit_vote(tally(readings)), {
        "by_sum": checksum_winner(page, F.col("page_valid"), F.col("page_cmp"), options, field),
        "majority": majority(options, F.col("usable")),
    })
    voted = voted.withColumn(
        "winner", F.when(F.col("majority") != "", F.col("majority")).otherwise(F.col("consensus"))
    )
    voted = computed(voted, {
        "winner_cmp": fields.comparison_value(field, F.col("winner")),
        "winner_valid": fields.structurally_valid(field, F.col("winner")),
        "consensus_cmp": F.when(F.col("consensus") != "", fields.comparison_value(field, F.col("consensus"))),
        "others": F.filter(options, lambda o: o["cmp"] != F.col("page_cmp")),
    })
    has_winner, valid = F.col("winner") != "", F.col("winner_valid")
    agrees = has_winner & (F.col("winner_cmp") == F.col("page_cmp")) & valid
    recovers = has_winner & ~F.col("page_valid") & valid
    by_sum = F.col("by_sum").isNotNull()
    settled = by_sum | agrees | recovers
    new_consensus = (
        (F.col("consensus") != "") & (F.col("consensus_cmp") != F.col("page_cmp"))
        & ~F.exists("others", lambda o: o["cmp"] == F.col("consensus_cmp"))
    )
    other_texts = F.transform("others", lambda o: o["text"])
    alternatives = F.when(
        new_consensus, F.concat(F.array("consensus"), other_texts)
    ).otherwise(other_texts)
    return computed(voted, {
        "value": F.when(by_sum, F.col("by_sum")).when(agrees | ~recovers, page).otherwise(F.col("winner")),
        "status": F.when(settled, "read").otherwise("needs_review"),
        "verified": settled,
        "alternative": F.when(~settled, F.array_join(alternatives, " / ")).otherwise(""),
        "note": F.when(by_sum, S.NOTE_SNILS_CHECKSUM).when(agrees, "")
        .when(recovers & (F.col("majority") == ""), S.NOTE_DIGIT_MAJORITY)
        .when(recovers, S.NOTE_VALUE_MAJORITY)
        .when(has_winner & ~valid, S.NOTE_INVALID_WINNER)
        .otherwise(S.NOTE_DIFFERENT_READS),
    })


def adjudicate(decided: DataFrame) -> DataFrame:
    """Use the extra blind reading where at least two different values remain."""
    field, page, second = F.col("field"), F.col("page"), F.col("second")
    page_counts = (page != "") & ~text.is_unclear(page)
    page_option = F.struct(F.col("page_cmp").alias("cmp"), page.alias("text"))
    view_options = F.transform("options", lambda o: F.struct(o["cmp"].alias("cmp"), o["text"].alias("text")))
    rivals = F.when(page_counts, F.concat(F.array(page_option), view_options)).otherwise(view_options)
    known = F.array_distinct(F.transform(F.col("rivals"), lambda r: r["cmp"]))
    staged = computed(decided, {"rivals": rivals, "second_cmp": fields.comparison_value(field, second)})
    staged = computed(staged, {"keys": F.array_sort(F.filter(known, lambda k: k != ""))})
    open_conflict = (F.col("status") == "needs_review") & (F.size("keys") >= 2)
    one_length = F.size(F.array_distinct(F.transform("keys", lambda k: F.length(k)))) == 1

    def differs(i: Column) -> Column:
        return F.size(F.array_distinct(F.transform("keys", lambda k: F.substr(k, i, F.lit(1))))) > 1

    conflicts = F.when(
        one_length, F.filter(F.sequence(F.lit(1), F.length(F.col("keys")[0])), differs)
    ).otherwise(F.array().cast("array<int>"))
    match = F.try_element_at(
        F.filter("rivals", lambda r: r["cmp"] == F.col("second_cmp")), F.lit(1)
    )["text"]
    staged = computed(staged, {
        "open_conflict": open_conflict,
        "conflict_positions": F.when(open_conflict, conflicts),
        "length_conflict": F.when(open_conflict, ~one_length),
        # A rival list may hold a text without a key; it matches a blank second reading only.
        "matching": F.when(open_conflict, text.blank_to_empty(match)).otherwise(""),
    })
    staged = computed(staged, {"match_valid": fields.structurally_valid(field, F.col("matching"))})
    matched = F.col("open_conflict") & (F.col("matching") != "")
    keeps = matched & (F.col("second_cmp") == F.col("page_cmp")) & F.col("page_valid")
    replaces = matched & ~keeps & ~F.col("page_valid") & F.col("match_valid")
    stays = matched & ~keeps & ~replaces
    extra = F.col("open_conflict") & (F.col("matching") == "") & (second != "")
    return computed(staged, {
        "value": F.when(replaces, F.col("matching")).otherwise(F.col("value")),
        "status": F.when(keeps | replaces, "read").otherwise(F.col("status")),
        "verified": F.col("verified") | keeps | replaces,
        "note": F.when(keeps, S.NOTE_ADJUDICATED_KEPT).when(replaces, S.NOTE_ADJUDICATED_NEW)
        .otherwise(F.col("note")),
        "alternative": F.when(
            extra, F.array_join(F.filter(F.array("alternative", "second"), lambda x: x != ""), " / ")
        ).otherwise(F.col("alternative")),
        "adjudicated_alternative": F.when(extra, second).when(stays, F.col("matching")).otherwise(""),
        "adjudication_matched": F.when(F.col("open_conflict"), matched),
    }).drop("rivals", "keys", "second_cmp", "matching", "match_valid")


def verification_audit(readings: DataFrame) -> DataFrame:
    """Attempted and completed verification reads per field, and what they amount to."""
    failed = text.blank_to_empty(F.col("error")) != ""
    counted = readings.filter("kind <> 'page'").groupBy("doc_id", "field").agg(
        F.count("*").alias("attempted"), F.count_if(~failed).alias("completed")
    )
    status, reason = audit_outcome(F.col("attempted"), F.col("completed"))
    return counted.select(
        "doc_id", "field", status.alias("status"), reason.alias("reason"), "attempted", "completed")


def audit_outcome(attempted: Column, completed: Column) -> tuple[Column, Column]:
    """Status and reason of a field's verification reads; null without any."""
    full = attempted == completed
    return (
        F.when(full, "completed").when(~full, "partial"),
        F.when(full, "").when(~full, "recognition_error"),
    )


def whole_audit(routing: DataFrame, readings: DataFrame, broken: DataFrame) -> DataFrame:
    """The audit of every field that was routed or read.

    ``routing`` has ``doc_id, field, reason`` (blank: to be read), ``readings`` the reads made, and
    ``broken`` one row ``doc_id, broken_field`` per document whose verification stopped with an
    error (at a field, or null). A field whose reads ended keeps its count; in a broken document
    the field that it stopped at and the selected fields not read yet are errors. Else a field is skipped
    for its reason. Reads without a routing row are audited all the same.
    """
    reason = F.coalesce("route.reason", F.lit(""))
    both = routing.alias("route").join(
        verification_audit(readings).alias("made"), ["doc_id", "field"], "full").select(
        "doc_id", "field", reason.alias("_skip"), "made.status", F.col("made.reason").alias("_partial"),
        *[F.coalesce(f"made.{n}", F.lit(0)).alias(n) for n in ("attempted", "completed")])
    joined = both.join(broken.withColumn("_broken", F.lit(True)), "doc_id", "left")
    selected = F.col("_skip").isin("", *S.REASONS_OF_SELECTED)
    stopped = F.col("_broken") & selected & (F.col("status").isNull() | F.coalesce(F.col("field") == F.col("broken_field"), F.lit(False)))
    status = (
        F.when(stopped, "error").when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("_skip") != "", "skipped").otherwise("completed"))
    why = (
        F.when(stopped, S.REASON_VERIFICATION_ERROR).when(F.col("status").isNotNull(), F.col("_partial")).otherwise(F.col("_skip")))
    return joined.select("doc_id", "field", status.alias("status"), why.alias("reason"), "attempted", "completed")


def single_crop(readings: DataFrame) -> DataFrame:
    """Merge the page reading with one crop reading (view 1)."""
    field = F.col("field")
    first_view = (F.col("kind") == "view") & (F.col("view_no") == 1)
    pair = readings.filter((F.col("kind") == "page") | first_view).groupBy("doc_id", "field").agg(
        F.max(F.when(F.col("kind") == "page", text.strip(F.col("value")))).alias("page"),
        F.max(F.when(
            first_view, fields.candidate_value(F.col("value"), F.col("status"), F.col("error"))
        )).alias("crop"),
    )
    pair = pair.fillna("", ["page", "crop"])
    pair = computed(pair, {
        "page_cmp": fields.comparison_value(field, F.col("page")),
        "crop_cmp": fields.comparison_value(field, F.col("crop")),
        "page_valid": fields.structurally_valid(field, F.col("page")),
        "crop_valid": fields.structurally_valid(field, F.col("crop")),
    })
    unusable = F.col("crop") == ""
    agrees = (
        ~unusable & (F.col("page_cmp") != "") & (F.col("page_cmp") == F.col("crop_cmp"))
        & F.col("page_valid")
    )
    recovers = ~unusable & ~agrees & ~F.col("page_valid") & F.col("crop_valid")
    return pair.select(
        "doc_id", "field",
        F.when(recovers, F.col("crop")).otherwise(F.col("page")).alias("value"),
        F.when(agrees | recovers, "read").otherwise("needs_review").alias("status"),
        (agrees | recovers).alias("verified"),
        F.when(unusable | agrees | recovers, "").otherwise(F.col("crop")).alias("alternative"),
        F.when(unusable, S.NOTE_CROP_UNREADABLE).when(agrees, "")
        .when(recovers, S.NOTE_CROP_RECOVERED).otherwise(S.NOTE_CROP_DIFFERS).alias("note"),
    )


def attach_suggestions(records: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Dictionary suggestions become alternatives and ask for review; equal ones are ignored.

    ``records``: ``doc_id, field, value, status, verified, alternative``;
    ``suggestions``: ``doc_id, field, suggestion``.
    """
    joined = records.join(suggestions, ["doc_id", "field"], "left")
    field = F.col("field")
    differs = F.coalesce(
        fields.comparison_value(field, F.col("suggestion")) != fields.comparison_value(field, F.col("value")),
        F.lit(False),
    ) & F.col("suggestion").isNotNull()
    return joined.withColumns({
        "status": F.when(differs, "needs_review").otherwise(F.col("status")),
        "verified": F.col("verified") & ~differs,
        "alternative": F.when(
            differs & (text.blank_to_empty(F.col("alternative")) == ""), F.col("suggestion")
        ).otherwise(F.col("alternative")),
        "suggestion": F.when(differs, F.col("suggestion")),
    })
