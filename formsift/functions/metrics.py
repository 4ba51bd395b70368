"""Error rates between a label and a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.text import let, words


def _as_character(position: Column) -> Column:
    """One distinct character per position, from the supplementary planes."""
    return F.decode(F.unhex(F.lpad(F.hex(position + 0x10000), 8, "0")), "UTF-32")


def cer(reference: Column, predicted: Column) -> Column:
    return F.levenshtein(reference, predicted) / F.greatest(F.length(reference), F.lit(1))


def word_distance(reference: Column, predicted: Column) -> Column:
    """Edit distance over words: each distinct word of the pair becomes one character."""
    pair = F.struct(words(reference).alias("r"), words(predicted).alias("p"))

    def distance(v: Column) -> Column:
        def over(seen: Column) -> Column:
            def encoded(w: Column) -> Column:
                return F.array_join(F.transform(w, lambda x: _as_character(F.array_position(seen, x))), "")

            return F.levenshtein(encoded(v["r"]), encoded(v["p"]))

        return let(F.array_distinct(F.concat(v["r"], v["p"])), over)

    # Equal texts need no encoding at all.
    return F.when(reference == predicted, 0).otherwise(let(pair, distance))


def wer(reference: Column, predicted: Column) -> Column:
    return word_distance(reference, predicted) / F.greatest(F.size(words(reference)), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two texts of one length."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)),
        F.lit(0), lambda n, d: n + d,
    )
