"""Layout memory with several writers, profiles and their history, benchmark integrity, clean frames, competing tables."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import candidates, frames, integrity
from ledgerloom.operators.memory import LayoutMemory, VersionConflict, changes_between_versions, events_of, export_profiles, layouts_of

LEARNED = "supplier string, signature string, headers array<string>, n_documents long, first_seen string, last_seen string"


def learned(spark, *rows):
    return spark.createDataFrame(list(rows), LEARNED)


def test_versions_and_conflicts(spark, tmp_path):
    a, b = (LayoutMemory(spark, f"file://{tmp_path}/m") for _ in range(2))
    assert a.version() == 0 and a.profiles().count() == 0 and a.audit().count() == 0
    first = learned(spark, ("S", "x", ["Item", "Qty"], 2, "1", "5"), ("S", "y", ["Item"], 1, "0", "0"), (None, "z", ["A"], 1, "1", "1"), ("T", None, ["A"], 1, "1", "1"))
    assert a.commit(first, 0) == 1
    with pytest.raises(VersionConflict):  # b has not seen version 1
        b.commit(learned(spark, ("S", "x", ["Item", "Qty"], 9, "9", "9")), 0)
    assert b.commit(learned(spark, ("S", "x", ["Item", "QTY."], 3, "0", "9"), ("S", "w", ["Item", "Rate"], 1, "7", "7"), ("T", "x", ["B"], 1, "2", "2")), b.version()) == 2
    assert a.commit(first.limit(0), 2) == 2 == a.version()
    got = {(r.supplier, r.signature): (r.version, r.n_documents, r.first_seen, r.last_seen, r.headers, r.memory_version) for r in a.profiles().collect()}
    assert got == {("S", "y"): (1, 1, "0", "0", ["Item"], 1), ("S", "x"): (2, 5, "0", "9", ["Item", "Qty"], 2), ("S", "w"): (3, 1, "7", "7", ["Item", "Rate"], 2), ("T", "x"): (1, 1, "2", "2", ["B"], 2)}
    assert {(r.signature, r.n_documents) for r in a.profiles(1).collect()} == {("x", 2), ("y", 1)} and a.history().count() == 5
    assert [(r.event_type, r.signature, json.loads(r.event_data)["n_documents"]) for r in events_of(a.audit(), "S").collect()] == [("LAYOUT_CREATED", "x", 2), ("LAYOUT_CREATED", "y", 1), ("LAYOUT_CREATED", "w", 1), ("LAYOUT_UPDATED", "x", 5)]
    assert [r.signature for r in layouts_of(a.profiles(), "S").collect()] == ["y", "x", "w"]


def test_writers_at_once(spark, tmp_path):
    won, lost = [], []

    def write(k):
        try:
            won.append(LayoutMemory(spark, f"file://{tmp_path}/m").commit(learned(spark, ("S", f"s{k}", ["A"], 1, "1", "1")), 0))
        except VersionConflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    memory = LayoutMemory(spark, f"file://{tmp_path}/m")
    assert won == [1] and len(lost) == 2 and memory.profiles().count() == 1 == memory.audit().count()


def test_profile_maps(spark):
    rows = spark.createDataFrame([("S", "a", ["Item", "Qty"], 1, 2, "1", "2"), ("S", "b", ["ITEM", "M.R.P"], 2, 1, "3", "3"), ("T", "a", [], 1, 1, "1", "1")], "supplier string, signature string, headers array<string>, version int, n_documents long, first_seen string, last_seen string")
    assert [(r.new, r.missing) for r in changes_between_versions(rows).orderBy("supplier", "version").collect()] == [([], []), (["mrp"], ["qty"]), ([], [])]
    got = {r.supplier: r for r in export_profiles(spark.createDataFrame([("S", "Acme"), ("U", "None")], "supplier string, supplier_name string"), rows).collect()}
    assert list(got["S"].layout_profiles) == ["a", "b"] and got["S"].layout_profiles["b"].missing == ["qty"] and got["S"].n_documents == 3 and got["S"].profile_version == 2
    assert got["U"].layout_profiles is None and got["U"].profile_version == 0


def test_integrity(spark, tmp_path):
    docs = [{"filename": f"{k}.pdf", "sha256": h, "supplier_name": "A", "gstin": None, "expected_rows": 3} for k, h in (("a", "AA"), ("b", "bb"), ("c", "cc"), ("d", None), ("e", "ee"), ("e", "e2"))]
    (tmp_path / "m.json").write_text(json.dumps({"benchmark_version": "v1", "documents": docs}, indent=1))
    manifest = integrity.load_manifest(spark, f"file://{tmp_path}/m.json")
    files = spark.createDataFrame([("a.pdf", "aa"), ("b.pdf", "xx"), ("d.pdf", "dd"), ("e.pdf", "ee"), ("f.pdf", "ff")], "filename string, sha256 string")
    found = integrity.verify_files(manifest, files)
    assert {r.filename[0]: r.status for r in found.collect()} == {"a": "VERIFIED", "b": "CHANGED", "c": "MISSING", "d": "CHANGED", "e": "CHANGED", "f": "UNEXPECTED"}
    s = integrity.summary(found).first()
    assert (s.verified, s.changed, s.missing, s.unexpected, s.expected_rows, s.passed) == (1, 3, 1, 1, 3, False)
    only = found.where("status = 'VERIFIED'")
    assert integrity.summary(only, 1).first().status == "PASS" and not integrity.summary(only, 2).first().passed and not integrity.summary(only.limit(0)).first().passed


def test_truth(spark, tmp_path):
    cell = lambda v, s=None: {"value": v, "state": s}
    doc = {"document_id": "d", "filename": "f", "sha256": "s", "rows": [{"row_index": 0, "fields": {"rate": cell("1.5"), "mrp": cell("9", "ambiguous"), "hsn": cell(None), "qty": cell("3", "odd")}}, {"row_index": 1, "fields": {"rate": cell("2", "KNOWN")}}]}
    (tmp_path / "t.json").write_text(json.dumps({"documents": [doc]}))
    cells = integrity.load_truth(spark, f"file://{tmp_path}/t.json")
    want = {(0, "rate", "1.5", "KNOWN"), (0, "mrp", None, "AMBIGUOUS"), (0, "hsn", None, "UNKNOWN"), (0, "qty", None, "UNKNOWN"), (1, "rate", "2", "KNOWN")}
    shown = lambda df: {(r.row_index, r.field, r.value, r.state) for r in df.collect()}
    assert shown(cells) == want
    integrity.save_truth(cells, f"file://{tmp_path}/saved")
    assert shown(integrity.load_truth(spark, f"file://{tmp_path}/saved")) == want


def test_value_quality(spark):
    cases = [("itemName", "DOLO", 56.0), ("itemName", "x" * 60, 20.0), ("batchNo", "123", 47.0), ("rate", "0", 5.0), ("rate", "12.50", 46.0), ("rate", "2000000", 0.0), ("rate", "123456789", 0.0), ("rate", "150000", 34.0), ("quantity", "10", 33.0), ("quantity", "100000", 0.0), ("gstPercent", "12", 33.0), ("amount", "abc", -1.0), ("itemName", " ", -1.0), ("rate", None, -1.0), ("expiryDate", "05/27", 1.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "f string, v string").select(frames.value_quality(F.col("f"), F.col("v")).alias("q"))
    assert [r.q for r in df.collect()] == [c[2] for c in cases]


def test_clean_items(spark):
    heads = ["S.No", "Item Name", "Qty", "Free Qty", "Rate", "PTR", "GST%", "Zork"]
    headers = spark.createDataFrame([(1, k, h) for k, h in enumerate(heads)], "doc int, pos int, header string")
    rows = spark.createDataFrame([(1, 0, ["1", "DOLO   650\nTAB", "10+2", "", "", "20.00", "5%", "99.50"]), (1, 1, ["2", "PAN D CAPS", "2.5", "500", "30", "31", "-12"]), (1, 2, ["3", "12", "1"]), (1, 3, None), (2, 0, ["x"]), (1, 4, ["4", "AMARYL", "60", "600", "1", "2", "3", "4", "beyond"])], "doc int, row_no int, cells array<string>")
    confirmed = spark.createDataFrame([(1, "ZORK!", "mrp"), (1, "", "rate"), (1, None, "rate")], "doc int, header string, field string")
    got = frames.numbered(frames.clean_items(rows, frames.header_fields(headers, confirmed))).orderBy("row_no").collect()
    assert [(r.s_no, r.itemName, r.quantity, r.freeQuantity, r.rate, r.gstPercent, r.mrp) for r in got] == [(1, "DOLO 650 TAB", 10, 2, 20, 5, 99.5), (2, "PAN D CAPS", 2.5, 0.5, 30, 12, None), (3, "AMARYL", 60, 600, 1, 3, 4)]
    upper = spark.createDataFrame([(1, 0, "Qty"), (1, 1, ""), (1, 2, "Rate")], "doc int, pos int, header string")
    below = spark.createDataFrame([(1, 0, "Billed Qty"), (1, 1, "Free"), (1, 2, "Net")], "doc int, pos int, header string")
    assert [r.header for r in frames.merge_subheaders(upper, below).orderBy("pos").collect()] == ["Billed Qty", "Free", "Rate"]


def test_candidates(spark):
    head, good, more, note = ["Item Name", "Batch", "Qty", "Rate"], ["DOLO 650", "B1", "2", "3.00"], ["", "extra pack", "B2", "4"], ["", "", "", ""]
    rows = [(1, 0, 0, x) for x in ([head, good, good, more, note], [head[:1] + ["x"], ["DOLO 650 B1 2 3.00", ""]], [["a" * 250], head, good])]
    tables = spark.createDataFrame([(1, 1, c, 0, k, cells) for c, (_, _, _, t) in enumerate(rows) for k, cells in enumerate(t)] + [(2, 1, 0, 0, 0, None), (2, 1, 0, 0, 1, [])], "doc int, page int, candidate int, table_no int, row_no int, cells array<string>")
    got = {(r.doc, r.candidate): r for r in candidates.score_tables(tables).collect()}
    assert (got[1, 0].n_primary, got[1, 0].n_fields, got[1, 0].header_row) == (2, 4, 0) and got[1, 0].score == 40 + 12 + 5 - 5 * got[1, 0].n_continued
    assert got[1, 1].score is None and got[2, 0].score is None
    assert got[1, 2].score == 20 + 12 + 3 - (80 + 12) and got[1, 2].header_row == 1 and got[1, 2].longest == 250
    best = candidates.best_tables(tables).collect()
    assert [(r.doc, r.candidate) for r in best] == [(1, 0)]
    wide = candidates.score_tables(tables, spark.createDataFrame([(1, 4)], "doc int, expected_columns int"))
    assert {r.candidate: r.score for r in wide.where("doc = 1").collect()}[0] == got[1, 0].score + 50
    bonus = spark.createDataFrame([(4, 4), (4, 6), (4, 8), (4, 9), (4, None), (4, 0)], "w int, e int").select(candidates.width_bonus(F.col("w"), F.col("e")).alias("b"))
    assert [r.b for r in bonus.collect()] == [50, 35, 10, -90, 0, 0]


def test_segments(spark):
    words = [(1, 1, "Item", 0.0, 20.0, 10.0), (1, 1, "Name", 24.0, 40.0, 10.5), (1, 1, "Qty", 60.0, 70.0, 10.0), (1, 1, "DOLO", 0.0, 20.0, 30.0), (1, 1, "5", 60.0, 64.0, 31.0), (1, 1, None, 1.0, 2.0, 50.0)]
    df = spark.createDataFrame(words, "doc int, page int, text string, x0 double, x1 double, top double")
    got = {(r.candidate, r.row_no): r.cells for r in candidates.segment(df, [2.0, 8.0, 99.0]).collect()}
    assert got == {(0, 0): ["Item", "Name", "Qty"], (0, 1): ["DOLO", "5"], (1, 0): ["Item Name", "Qty"], (1, 1): ["DOLO", "5"], (2, 0): ["Item Name Qty"], (2, 1): ["DOLO 5"]}
