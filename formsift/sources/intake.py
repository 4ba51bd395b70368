"""Scans: documents, label files, dictionary files, corrections, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift import schema as S
from formsift.functions import headers, text
from formsift.operators.regions import LABEL_ALIASES
from formsift.operators.stages import computed

# --- Fixed values: the standard form -----------------------------------------------------
STANDARD_TEMPLATE = "Заявление о приеме (1/10 класс)"
FALLBACK_Y = {
    S.APPLICATION_DATE: (0.23, 0.30), S.CHILD_FIO: (0.29, 0.35), S.BIRTH_DATE: (0.35, 0.41),
    S.TARGET_CLASS: (0.40, 0.47), S.PARENT_FIO: (0.46, 0.52), S.PASSPORT: (0.51, 0.58),
    S.ADDRESS: (0.57, 0.64), S.PHONE: (0.63, 0.70), S.SNILS: (0.69, 0.76), S.NOTES: (0.75, 0.83),
}
FALLBACK_X = {
    S.APPLICATION_DATE: (0.08, 0.58), S.PASSPORT: (0.08, 0.96), S.SNILS: (0.08, 0.78),
    S.PHONE: (0.08, 0.72),
}
SIGNATURE_DATE_Y = (0.80, 0.90)
# -----------------------------------------------------------------------------------------

TEMPLATE_FILE = (
    "map<string, struct<fields: array<string>, label_aliases: map<string, array<string>>, "
    "fallback_y: map<string, array<double>>, fallback_x: map<string, array<double>>, "
    "signature_date_y: array<double>>>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder: ``path, length, content, ext``. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "content", extension(F.col("path")).alias("ext"))


def opened(files: DataFrame) -> DataFrame:
    """Add to ``path, content`` what the bytes say: ``payload_chars`` (in base 64), ``width, height``
    of an image, ``pages`` of a PDF file (null where they cannot be seen), ``unreadable``."""
    ext = extension(F.col("path"))
    size = headers.image_size(F.col("content"))
    sized = computed(files, {"_size": F.when(ext.isin(*S.IMAGE_EXTENSIONS), size), "_pdf": (ext == "pdf") & headers.is_pdf(F.col("content"))})
    return sized.withColumns({
        "payload_chars": 4 * F.ceil(F.length("content") / 3), "width": F.col("_size.width"), "height": F.col("_size.height"),
        "pages": F.when(F.col("_pdf"), headers.pdf_pages(F.col("content"))),
        "unreadable": F.when(ext == "pdf", ~F.col("_pdf")).otherwise(F.col("_size").isNull()),
    }).drop("_size", "_pdf")


def intake_gate(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (blank when accepted) to ``path, payload_chars, width, height, pages``.

    With ``unreadable``, files of a known kind that do not begin like one are rejected. A PDF file
    whose ``pages`` are null is not rejected for their number.
    """
    ext = extension(F.col("path"))
    image = ext.isin(*S.IMAGE_EXTENSIONS)
    pixels = F.col("width").cast("long") * F.col("height")
    reason = (
        F.when(F.col("payload_chars") > S.MAX_PAYLOAD_CHARS, "payload_too_long")
        .when(~image & (ext != "pdf"), "unsupported_format")
        .when(F.col("unreadable") if "unreadable" in df.columns else F.lit(False), "unreadable")
        .when(image & ((F.col("width") <= 0) | (F.col("height") <= 0)), "bad_size")
        .when(image & (pixels > S.MAX_IMAGE_PIXELS), "too_many_pixels")
        .when((ext == "pdf") & (F.col("pages") <= 0), "no_pages")
        .when((ext == "pdf") & (F.col("pages") > S.MAX_PDF_PAGES), "too_many_pages")
        .otherwise("")
    )
    return df.withColumns({"kind": F.when(image, "image").when(ext == "pdf", "pdf"), "reject_reason": reason})


def read_labels(
    spark: SparkSession, folder: str, case_pattern: str = r"([^/]+)\.json$", per_line: bool = False
) -> DataFrame:
    """``case_id, field, reference, error`` from one JSON object per file or, with ``per_line``, per line.

    A file is named after its case; an object on a line has its ``case_id`` beside ``fields``, so that
    many cases share a file. A case whose ``fields`` is not an object gives one error row and stops no
    other case; a line that is no JSON object at all gives one without a case.
    """
    if per_line:
        lines = spark.read.schema(T.StructType([T.StructField("case_id", T.StringType()), *S.LABEL_FILE])).json(folder)
        files = lines.select("case_id", "fields", "_corrupt_record")
    else:
        files = (
            spark.read.schema(S.LABEL_FILE).option("multiLine", True).option("recursiveFileLookup", True)
            .json(folder)
            .select(F.regexp_extract(F.input_file_name(), case_pattern, 1).alias("case_id"), "fields", "_corrupt_record")
        )
    broken = F.col("_corrupt_record").isNotNull()
    rows = files.select("case_id", "fields", broken.alias("broken"), F.explode_outer("fields").alias("field", "reference"))
    return rows.select(
        "case_id", "field", "reference", F.when(F.col("broken"), "fields is not an object").alias("error")
    )


def missing_labels(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases without a label file."""
    return cases.join(labels.select("case_id").distinct(), "case_id", "left_anti").select(
        "case_id", F.lit("no label file").alias("error")
    )


def read_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """``category, value`` from ``<category>.txt`` files or folders of one value per line."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    rows = lines.select(
        F.regexp_extract(F.input_file_name(), r"([a-z_]+)\.txt(?:/|$)", 1).alias("category"),
        text.strip(F.col("value")).alias("value"),
    )
    return rows.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns category, wrong, right."""
    return spark.read.schema(S.CORRECTIONS).option("header", True).option("escape", '"').csv(path)


def standard_template(spark: SparkSession) -> DataFrame:
    """The built-in form as ``template, field, field_ord, aliases, y1, y2, x1, x2``."""

    def number(value: float | None) -> Column:
        return F.lit(value).cast("double")

    rows = []
    for i, field in enumerate(S.BUSINESS_FIELDS):
        y, x = FALLBACK_Y.get(field, (None, None)), FALLBACK_X.get(field, (None, None))
        rows.append(F.struct(
            F.lit(STANDARD_TEMPLATE).alias("template"), F.lit(field).alias("field"), F.lit(i).alias("field_ord"),
            F.array(*[F.lit(a) for a in LABEL_ALIASES[field]]).alias("aliases"),
            number(y[0]).alias("y1"), number(y[1]).alias("y2"), number(x[0]).alias("x1"), number(x[1]).alias("x2"),
        ))
    return spark.range(1).select(F.inline(F.array(*rows)))


def signature_bands(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``template, y1, y2``: the band of the signature's date per form, null without a pair of two
    numbers; the standard form has its own unless a file gives it another."""
    raw = spark.read.option("wholetext", not per_line).text(path)
    entries = raw.select(F.explode(F.from_json("value", TEMPLATE_FILE)).alias("template", "t")).filter("t IS NOT NULL")
    pair = F.col("t.signature_date_y")
    good = (F.size(pair) == 2) & F.forall(pair, lambda v: v.isNotNull())
    given = entries.select("template", F.when(good, pair[0]).alias("y1"), F.when(good, pair[1]).alias("y2"))
    own = spark.range(1).select(F.lit(STANDARD_TEMPLATE).alias("template"), *[
        F.lit(y).cast("double").alias(n) for n, y in zip(("y1", "y2"), SIGNATURE_DATE_Y)])
    replaced = given.filter((F.col("template") == STANDARD_TEMPLATE) & F.col("y1").isNotNull())
    others = given.filter(F.col("template") != STANDARD_TEMPLATE)
    return others.unionByName(replaced).unionByName(own.join(replaced.select("template"), "template", "left_anti"))


def read_templates(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Templates of JSON files as long rows, the standard form overlaid on the built-in one.

    Each file (or, with ``per_line``, each line) is an object of templates by name. Pairs that
    do not have two numbers and empty alias lists are dropped.
    """
    raw = spark.read.option("wholetext", not per_line).text(path)
    entries = raw.select(F.explode(F.from_json("value", TEMPLATE_FILE)).alias("template", "t")).filter("t IS NOT NULL")
    texts = F.coalesce(F.filter("t.fields", lambda f: f.isNotNull()), F.array().cast("array<string>"))

    def keys(name: str) -> Column:
        return F.coalesce(F.map_keys(f"t.{name}"), F.array().cast("array<string>"))

    named = entries.select(
        "template", "t", texts.alias("fields"),
        F.explode(F.array_distinct(F.concat(texts, keys("label_aliases"), keys("fallback_y"), keys("fallback_x")))).alias("field"),
    )

    def pair(name: str, i: int) -> Column:
        value = F.try_element_at(f"t.{name}", F.col("field"))
        good = (F.size(value) == 2) & F.forall(value, lambda v: v.isNotNull())
        return F.when(good, value[i])

    aliases = F.filter(F.try_element_at("t.label_aliases", F.col("field")), lambda a: a.isNotNull())
    rows = named.select(
        "template", "field",
        F.nullif(F.array_position("fields", F.col("field")) - 1, F.lit(-1)).cast("int").alias("field_ord"),
        F.when(F.size(aliases) > 0, aliases).alias("aliases"),
        pair("fallback_y", 0).alias("y1"), pair("fallback_y", 1).alias("y2"),
        pair("fallback_x", 0).alias("x1"), pair("fallback_x", 1).alias("x2"),
    )
    values = ["field_ord", "aliases", "y1", "y2", "x1", "x2"]
    over = rows.filter(F.col("template") == STANDARD_TEMPLATE).alias("o")
    base = standard_template(spark).alias("b")
    overlaid = base.join(over, ["template", "field"], "full").select(
        "template", "field", *[F.coalesce(f"o.{v}", f"b.{v}").alias(v) for v in values]
    )
    return rows.filter(F.col("template") != STANDARD_TEMPLATE).unionByName(overlaid)


def template_or_standard(templates: DataFrame, name: str) -> DataFrame:
    """Rows of the named template; the standard form when there is none of that name."""
    wanted = templates.filter(F.col("template") == name)
    known = wanted.select("template").limit(1).select(F.lit(True).alias("known"))
    fallback = templates.filter(F.col("template") == STANDARD_TEMPLATE).join(known, how="left_anti")
    return wanted.unionByName(fallback)
