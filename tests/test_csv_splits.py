"""CSV records over the borders of splits, headings, and records that do not fit."""

import csv
import random

import pytest

from tabulark.sources import delimited


@pytest.fixture(params=[40, 700, 1 << 20])
def small_splits(spark, request):
    """Splits of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def plain(rows):
    return sorted(tuple(c or "" for c in row) for row in rows)


def test_breaks_across_splits(spark, small_splits, tmp_path):
    draw = random.Random(8)
    parts = ["a", "bc", "\n", "\n\n", ",", '"', '""', "NULL", "x\ny", " z", '",', ',"']
    rows = [[str(i), *["".join(draw.choices(parts, k=draw.randint(0, 5))) for _ in range(2)]] for i in range(150)]
    rows.append(["long", "line\n" * 60, 'end"'])
    for name, some in (("one", rows[:90]), ("two", rows[90:])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerows([["id", "first, of two", "second"], *some])
    df = delimited.import_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "first, of two", "second"]
    assert plain(df.collect()) == plain(rows)
    assert delimited.rejected_records(spark, str(tmp_path)).count() == 0


def test_quotes_inside_cells_are_text(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,5" pipe\n2,6" pipe\n3,"open\nand closed"\n4,7" pipe\n5,"a ""b"" c"\n')
    want = [("1", '5" pipe'), ("2", '6" pipe'), ("3", "open\nand closed"), ("4", '7" pipe'), ("5", 'a "b" c')]
    assert plain(delimited.import_delimited(spark, str(tmp_path / "a.csv")).collect()) == want


def test_blank_lines_before_the_heading(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("\n  \nid,note\n1,x\n\n2,NULL\n3,\"NULL\"\n")
    path = str(tmp_path / "a.csv")
    assert plain(delimited.import_delimited(spark, path).collect()) == [("1", "x"), ("2", "NULL"), ("3", "NULL")]
    assert plain(delimited.import_delimited(spark, path, null_literal=True).collect()) == [("1", "x"), ("2", ""), ("3", "NULL")]
    assert delimited.import_delimited(spark, path, remove_empty_rows=False).count() == 4


def test_breaks_go_with_the_null_literal_and_blank_rows(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"NULL\nNULL"\n\n2,NULL\n3,"x,NULL,\n,NULL"\n')
    path = str(tmp_path / "a.csv")
    rows = delimited.import_delimited(spark, path, null_literal=True, remove_empty_rows=False).collect()
    assert plain(rows) == [("", ""), ("1", "NULL\nNULL"), ("2", ""), ("3", "x,NULL,\n,NULL")]


def test_records_that_do_not_fit_are_kept_whole(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,x\n2,"y\ny",surplus\n3\n4,z\n')
    rejects = str(tmp_path / "rejects")
    rows = delimited.import_delimited(spark, str(tmp_path / "a.csv"), rejects=rejects)
    assert plain(rows.collect()) == [("1", "x"), ("2", "y\ny"), ("3", ""), ("4", "z")]
    assert sorted(r.record for r in spark.read.parquet(rejects).collect()) == ['2,"y\ny",surplus', "3"]


def test_only_a_heading_and_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n")
    assert delimited.import_delimited(spark, str(tmp_path / "a.csv")).collect() == []


def test_a_block_is_worked_on_in_stretches(spark, tmp_path, monkeypatch):
    draw = random.Random(5)
    rows = [[str(i), "".join(draw.choices(["a", "\n", '"', ",", ' "'], k=draw.randint(0, 9)))] for i in range(3000)]
    with open(tmp_path / "one.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["id", "text"], *rows])
    for bits in (0, 3, 10):  # a stretch of one line, of 8, of 1024
        monkeypatch.setattr(delimited, "STRETCH_BITS", bits)
        written = {}
        kept = delimited.cut
        with monkeypatch.context() as patched:
            patched.setattr(delimited, "cut", lambda df, label: written.setdefault(label, kept(df, label)))
            assert plain(delimited.import_delimited(spark, str(tmp_path)).collect()) == plain(rows)
        lines = written["csv-lines"]
        assert lines.select("file", "block").distinct().count() == 1
        assert lines.groupBy(*delimited.STRETCH).count().agg({"count": "max"}).first()[0] <= 2**bits
        assert written["csv-stretches"].count() == lines.select(*delimited.STRETCH).distinct().count()
