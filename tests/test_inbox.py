"""Sweeps of a folder with growing, repeated and vanishing files; letterheads by their characters."""

import time

from pyspark.sql import functions as F

from ledgerloom.operators import lettering
from ledgerloom.streaming import inbox


def test_growing_and_repeated_files(spark, tmp_path):
    folder, listing = tmp_path / "in", f"file://{tmp_path}/list"
    folder.mkdir()
    got, counters = {}, inbox.Counters()
    spark.streams.addListener(counters)
    decide = lambda df: df.withColumn("decision", F.when(F.col("is_duplicate"), "REVIEW_REQUIRED").when(F.col("length") > 5, "AUTO_ACCEPT").otherwise("UNRESOLVED"))

    def run(writes, goes=()):
        for name, text in writes.items():
            (folder / name).write_text(text)
        for name in goes:
            (folder / name).unlink()
        inbox.sweep(spark, f"file://{folder}", listing)
        box = inbox.Inbox(spark, listing, f"file://{tmp_path}/out", f"file://{tmp_path}/check", decide)
        box.add_listener(lambda rows, n: got.setdefault("files", []).extend((r.path.rpartition("/")[2], r.length, r.decision) for r in rows.orderBy("path").collect()))
        q = box.start()
        q.awaitTermination(120)
        return box

    assert run({"a.txt": "123", "b.txt": "whole text", "empty.txt": ""}).metrics() == {"is_running": False, "scanned": 0, "duplicates": 0} and "files" not in got or got["files"] == []
    run({"a.txt": "123456"})  # a grows, b has come to rest
    assert got["files"] == [("b.txt", 10, "AUTO_ACCEPT")]
    assert run({"c.txt": "whole text"}).metrics()["scanned"] == 1  # a rests
    assert got["files"][1:] == [("a.txt", 6, "AUTO_ACCEPT")]
    box = run({"d.txt": "1"})  # c rests: as b, whom history knows
    assert got["files"][2:] == [("c.txt", 10, "REVIEW_REQUIRED")] and box.metrics()["duplicates"] == 1
    run({"a.txt": "123456789"}, ["d.txt"])
    run({})
    assert got["files"][3:] == [("a.txt", 9, "AUTO_ACCEPT")]  # grown anew; d has gone before it rested
    assert sorted(r.path.rpartition("/")[2] for r in box.history().collect()) == ["a.txt", "a.txt", "b.txt", "c.txt"]
    for _ in range(50):  # events come late
        if counters.ended and sum(counters.rows.values()) >= 10:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert len(counters.rows) == 1 and sum(counters.rows.values()) >= 10 and set(counters.ended.values()) == {None}


def test_names_of_moved_files(spark):
    df = spark.createDataFrame([("AUTO_ACCEPT", "/in/a.b.pdf", 0), ("FAILED", "/in/x", 2), ("other", "/in/y.txt", 1)], "d string, p string, k int")
    got = df.select(inbox.moved_to(F.col("d"), {"AUTO_ACCEPT": "/done", "FAILED": "/bad"}, "/review", F.col("p"), F.col("k")).alias("x"))
    assert [r.x for r in got.collect()] == ["/done/a.b.pdf", "/bad/x_2", "/review/y_1.txt"]


def chars(line, x, top, size=8.0, font="Helvetica", page=1):
    return [(1, page, c, x + 5.0 * k, x + 5.0 * k + 5, top + (k % 2) * 0.6, size, font) for k, c in enumerate(line)]


CHARS, PAGES = "doc int, page int, text string, x0 double, x1 double, top double, size double, fontname string", "doc int, page int, width double, height double, header_top double, text string"


def test_lines_of_characters(spark):
    rows = [*chars("ACME PHARMA", 20.0, 30.0, 16.0, "Arial-BoldMT"), *chars("Plot 5,  Main Road", 20.0, 45.0), (1, 1, None, 300.0, None, 45.0, None, None), (1, 1, "x", None, None, 45.0, 1.0, ""), (1, 1, "9", 20.0, 25.0, 60.0, 0.0, "IDAutomation-Barcode39")]
    df = spark.createDataFrame(rows, CHARS)
    got = {r.line: r for r in lettering.line_figures(lettering.line_numbers(df)).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["ACME PHARMA", "Plot 5, Main Road", "9"]
    assert (got[1].max_size, got[1].mean_size, got[1].bold, got[1].top, got[1].x0, got[1].x1) == (16.0, 16.0, 1.0, 30.0, 20.0, 75.0)
    assert (got[2].mean_size, got[2].bold, got[2].x1) == (8.0, 0.0, 300.0) and (got[3].mean_size, got[3].barcode) == (0.0, 1.0)


def test_supplier_of_a_page(spark):
    rows = [*chars("ACME PHARMA", 20.0, 30.0, 16.0, "Arial-BoldMT"), *chars("GREAT PHARMA", 20.0, 300.0, 40.0), *chars("FAR PHARMA", 500.0, 30.0, 40.0), *chars("27ABCDE1234F1Z5", 20.0, 60.0, 30.0), *chars("GREAT PHARMA", 20.0, 300.0, 40.0, page=2)]
    pages = [(1, 1, 600.0, 800.0, 200.0, "other name"), (1, 2, 600.0, 800.0, 30.0, "SUN MEDICAL AGENCIES\nPlot 5"), (2, 1, None, None, None, None)]
    got = {(r.doc, r.page): (r.name, r.confidence, r.source) for r in lettering.supplier_names(spark.createDataFrame(rows, CHARS), spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {(1, 1): ("ACME PHARMA", 0.95, "LINE"), (1, 2): ("SUN MEDICAL AGENCIES", 0.55, "TEXT"), (2, 1): (None, 0.0, "NONE")}
    assert lettering.supplier_names(spark.createDataFrame([], CHARS), spark.createDataFrame([], PAGES)).count() == 0
