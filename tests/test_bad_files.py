"""Damaged, encrypted and hostile files give errors in their rows."""

import io
import time
import zipfile
import zlib

import pytest

from folioscope.sources import connectors, readers


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


SHEET = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>{}</v></c></row></sheetData></worksheet>'


def test_members_that_inflate_without_end_are_errors(monkeypatch):
    monkeypatch.setattr(readers, "MOST_INFLATED", 1 << 20)
    for read, content in ((readers._xlsx, archive(xl__worksheets__s1_xml="<worksheet>" + " " * (8 << 20) + "</worksheet>")), (readers._docx, archive(word__document_xml="<document>" + " " * (8 << 20) + "</document>"))):
        with pytest.raises(ValueError, match="inflates beyond"):
            list(read(content))


def test_bad_workbooks_and_documents_give_error_rows(spark):
    good = archive(xl__sharedStrings_xml="<sst><si><t>one</t></si></sst>", xl__worksheets__s1_xml=SHEET.format(0))
    far = archive(xl__sharedStrings_xml="<sst><si><t>one</t></si></sst>", xl__worksheets__s1_xml=SHEET.format(7))
    minus = archive(xl__sharedStrings_xml="<sst><si><t>one</t></si></sst>", xl__worksheets__s1_xml=SHEET.format(-1))
    broken = bytearray(good)
    broken[60] ^= 255
    files = {"good": good, "far": far, "minus": minus, "broken": bytes(broken), "junk": b"PK junk", "none": None}
    got = {r.path: r for r in readers.spreadsheets(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert got["good"].value == "one" and got["good"].error is None and "none" not in got
    assert all(got[k].error for k in ("far", "minus", "broken", "junk"))
    locked = bytearray(archive(word__document_xml="<document/>"))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1  # the bit that says encrypted
    assert all(r.error for r in readers.word_tables(spark.createDataFrame([("locked", bytes(locked))], "path string, content binary")).collect())


def test_a_page_that_inflates_without_end_is_refused():
    stream = zlib.compress(b"(x) Tj " * (10 << 20))
    page = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Contents 4 0 R >> endobj 4 0 obj << /Filter /FlateDecode >> stream\n" + stream + b"endstream endobj trailer"
    began = time.time()
    with pytest.raises(ValueError, match="more than"):
        connectors.first_page(page)
    assert time.time() - began < 5
