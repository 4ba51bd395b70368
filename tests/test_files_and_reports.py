"""Files read as bytes, the whole audit, the report's sink."""

import json
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from formsift.operators import quality, reconcile, report
from formsift.plans import catalog
from formsift.sources import intake
from tests.conftest import SF_DIR


def jpeg(width, height, *segments):
    body = b"".join(b"\xff" + bytes([code]) + struct.pack(">H", len(data) + 2) + data for code, data in segments)
    return b"\xff\xd8" + body + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00\xff\xda"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"\x08\x02\x00\x00\x00"


def bmp(width, height):
    return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, height) + bytes(28)


def webp(kind, data):
    return b"RIFF" + struct.pack("<I", 4) + b"WEBP" + kind + struct.pack("<I", len(data)) + data


def pdf(pages, more=b""):
    return b"junk%PDF-1.4\n" + b"<< /Type /Pages /Count 9 >>" + b"<< /Type/Page /Parent 1 0 R >>\n<< /Type\n/Page>>"[:31 if pages == 1 else 99] * (pages > 0) + more


FILES = {
    "a.png": (png(640, 480), ("image", 640, 480, None, "")),
    "b.PNG": (png(0, 480), ("image", 0, 480, None, "bad_size")),
    "c.png": (png(6000, 5000), ("image", 6000, 5000, None, "too_many_pixels")),
    "d.png": (b"\x89PNG\r\n\x1a\n\x00\x00", ("image", None, None, None, "unreadable")),
    "e.bmp": (bmp(31, -77), ("image", 31, 77, None, "")),
    "f.bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 300, 200), ("image", 300, 200, None, "")),
    "g.jpg": (jpeg(1200, 900, (0xE0, b"JFIF\x00" + bytes(9)), (0xC4, bytes(40)), (0xFE, b"\xff\xc0 comment"), (0xDB, bytes(65))), ("image", 1200, 900, None, "")),
    "h.jpeg": (b"\xff\xd8\xff\xd9", ("image", None, None, None, "unreadable")),
    "i.webp": (webp(b"VP8X", bytes(4) + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")), ("image", 800, 600, None, "")),
    "j.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (320 - 1) | (241 - 1) << 14)), ("image", 320, 241, None, "")),
    "k.webp": (webp(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 64 | 0x4000, 48)), ("image", 64, 48, None, "")),
    "l.pdf": (pdf(1), ("pdf", None, None, 1, "")),
    "m.pdf": (pdf(2), ("pdf", None, None, 2, "")),
    "n.pdf": (pdf(0), ("pdf", None, None, 0, "no_pages")),
    "o.pdf": (pdf(0, b"<< /Type /ObjStm >>"), ("pdf", None, None, None, "")),
    "p.pdf": (b"<< /Type /Page >>", ("pdf", None, None, None, "unreadable")),
    "q.pdf": (pdf(2, b"<</Type/Page>>" * 19), ("pdf", None, None, 21, "too_many_pages")),
    "r.gif": (b"GIF89a", (None, None, None, None, "unsupported_format")),
    "t.jpg": (jpeg(9, 7, *[(0xE1, b"x")] * 60), ("image", 9, 7, None, "")),
}


def test_gate_opens_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for i, (name, (data, _)) in enumerate(FILES.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(data)
    files = intake.opened(intake.read_documents(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.width, r.height, r.pages, r.reject_reason) for r in intake.intake_gate(files).collect()}
    assert got == {name: want for name, (_, want) in FILES.items()}
    assert {r.payload_chars for r in files.filter("path like '%a.png'").collect()} == {4 * -(-len(FILES["a.png"][0]) // 3)}


def test_form_by_name_or_the_standard_one(spark, tmp_path):
    (tmp_path / "forms.json").write_text(json.dumps({
        "own": {"fields": ["A"], "signature_date_y": [0.1, 0.2]}, "bad": {"fields": [], "signature_date_y": [0.1]},
        intake.STANDARD_TEMPLATE: {"signature_date_y": [0.5, "x"]}}, ensure_ascii=False))
    forms = intake.read_templates(spark, str(tmp_path))
    fields_of = lambda name: {(r.template, r.field) for r in intake.template_or_standard(forms, name).collect()}
    assert fields_of("own") == {("own", "A")} and len(fields_of("none")) == 10 and {t for t, _ in fields_of("none")} == {intake.STANDARD_TEMPLATE}
    bands = {r.template: (r.y1, r.y2) for r in intake.signature_bands(spark, str(tmp_path)).collect()}
    assert bands == {"own": (0.1, 0.2), "bad": (None, None), intake.STANDARD_TEMPLATE: intake.SIGNATURE_DATE_Y}


def test_audit_gives_every_outcome(spark):
    routing = spark.createDataFrame([
        (1, "a", ""), (1, "b", ""), (1, "c", "field_not_selected"), (2, "a", ""), (2, "b", "region_not_found"), (2, "c", "field_not_selected"),
        (2, "d", ""), (3, "a", "mode_disabled"), (4, "a", "")], "doc_id long, field string, reason string")
    reads = [(1, "a", None), (1, "a", None), (1, "b", None), (1, "b", "timeout"), (2, "a", None), (2, "d", "timeout"), (5, "x", None)]
    readings = spark.createDataFrame([(d, f, "view", e) for d, f, e in reads] + [(1, "a", "page", "no")], "doc_id long, field string, kind string, error string")
    broken = spark.createDataFrame([(2, "d"), (4, None)], "doc_id long, broken_field string")
    got = {(r.doc_id, r.field): tuple(r)[2:] for r in reconcile.whole_audit(routing, readings, broken).collect()}
    assert got == {
        (1, "a"): ("completed", "", 2, 2), (1, "b"): ("partial", "recognition_error", 2, 1), (1, "c"): ("skipped", "field_not_selected", 0, 0),
        (2, "a"): ("completed", "", 1, 1), (2, "b"): ("error", "verification_error", 0, 0), (2, "c"): ("skipped", "field_not_selected", 0, 0),
        (2, "d"): ("error", "verification_error", 1, 0), (3, "a"): ("skipped", "mode_disabled", 0, 0), (4, "a"): ("error", "verification_error", 0, 0),
        (5, "x"): ("completed", "", 1, 1)}


EVAL = ("case_id long, field string, reference string, predicted string, status string, verified boolean, "
        "audit_status string, audit_reason string, attempted long, completed long")


def test_report_is_one_pass_and_read_whole_or_not(spark, monkeypatch, tmp_path):
    rows = [(i % 4, f"Телефон {i % 3}", "9001234567", "9001234567" if i % 2 else "900123456", "read", i % 5 == 0,
             ["skipped", "partial", None][i % 3], ["x", "", None][i % 3], i, i // 2) for i in range(30)]
    scored = quality.score_fields(spark.createDataFrame(rows, EVAL))
    aligned = quality.aligned_digits(spark.createDataFrame(rows, EVAL))
    passes = []
    settled = report.settled
    monkeypatch.setattr(report, "settled", lambda df, name: passes.append(name) or settled(df, name))
    tables = report.report_tables(scored, aligned)
    want = {
        "cases": quality.case_quality(scored), "corpus": quality.corpus_quality(scored), "fields": quality.field_quality(scored),
        "audits": quality.verification_totals(scored), "skips": quality.skip_reasons(scored), "matrix": quality.confusion_matrix(aligned),
        "positions": quality.position_errors(aligned)}
    folder = report.write_report(spark, tables, {"модель": "m"})
    got = report.read_report(spark, folder)
    plain = lambda df: sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())))
    assert passes == ["report-pass"] and got.keys() == want.keys()
    for name, table in want.items():
        assert plain(got[name].select(*table.columns)) == plain(table), name
    assert json.loads(spark.read.json(f"{folder}/manifest").first()["run"]) == {"модель": "m"}
    with pytest.raises(AnalysisException):
        report.read_report(spark, f"{folder}/cases")
    tables["cases"].limit(1).write.mode("overwrite").json(f"{folder}/cases")
    with pytest.raises(ValueError):
        report.read_report(spark, folder)


def test_report_of_an_empty_table(spark):
    empty = spark.createDataFrame([], EVAL)
    tables = report.report_tables(quality.score_fields(empty), quality.aligned_digits(empty))
    assert tables["cases"].count() == tables["skips"].count() == 0 and tables["matrix"].agg(F.sum("pred_1")).first()[0] == 0


def test_labels_of_a_file_per_case_and_of_many_cases_a_file(spark, tmp_path):
    """Both layouts give the same rows; a damaged case stops no other."""
    cases = {"1": {"quality": "0", "toxic": "1"}, "2": "none", "3": {"quality": "1"}}
    (tmp_path / "files").mkdir()
    for case, given in cases.items():
        (tmp_path / "files" / f"{case}.json").write_text(json.dumps({"fields": given}, indent=1))
    lines = [json.dumps({"case_id": case, "fields": given}) for case, given in cases.items()]
    (tmp_path / "lines.json").write_text("\n".join(lines) + "\n")
    expected = [("1", "quality", "0", None), ("1", "toxic", "1", None),
                ("2", None, None, "fields is not an object"), ("3", "quality", "1", None)]
    by_file = intake.read_labels(spark, str(tmp_path / "files"))
    by_line = intake.read_labels(spark, str(tmp_path / "lines.json"), per_line=True)
    for rows in (by_file, by_line):
        assert sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or "")) == expected
    (tmp_path / "lines.json").write_text("{no json\n" + lines[0])
    found = intake.read_labels(spark, str(tmp_path / "lines.json"), per_line=True).collect()
    assert sorted(map(tuple, found), key=lambda r: r[0] or "") == [(None, None, None, "fields is not an object"), *expected[:2]]


def test_label_scan_writes_no_file_per_case(spark):
    scanned = catalog.QUERIES["a1_label_scan"](spark, SF_DIR)
    assert 0 < len(scanned.inputFiles()) < 10 < spark.read.parquet(f"{SF_DIR}/labels.parquet").count()
