"""Inputs that the registered queries do not hold: odd files, repeated keys, long numbers, several facets."""

import base64
import hashlib
import hmac

import pytest


from tabulark.functions import dates, hashes, lists
from tabulark.operators import diffs, facets, sorts
from tabulark.sources import delimited, documents, writes


def test_heading_like_rows_and_quoted_headings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"id, main",note\n1,x\n"id, main",note\n2,NULL\n3,"NULL"\n4,"a,NULL"\n')
    df = delimited.import_delimited(spark, str(tmp_path / "a.csv"), null_literal=True)
    assert df.columns == ["id, main", "note"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "x"), ("2", None), ("3", "NULL"), ("4", "a,NULL"), ("id, main", "note")]


def test_blank_lines_line_breaks_and_surplus_cells(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,note\n1,x\n\n\n2,y,z\n")
    assert delimited.import_delimited(spark, str(path), remove_empty_rows=False).count() == 4
    assert delimited.import_delimited(spark, str(path)).count() == 2
    assert [r.record for r in delimited.rejected_records(spark, str(path)).collect()] == ["2,y,z"]
    path = tmp_path / "c.csv"
    path.write_text('id,note\n1,"two\nlines"\n')
    assert [tuple(r) for r in delimited.import_delimited(spark, str(path), multi_line=True).collect()] == [("1", "two\nlines")]


def test_catalog_layouts(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{\n "page": 1,\n "dataset": [{"identifier": "https://x.org/a", "title": "old"},\n {"identifier": "a", "title": "new"}, {"title": "lost"}]\n}')
    schema = "identifier: string, title: string"
    rows = documents.read_catalog(spark, str(path), schema, whole_files=True).collect()
    assert [r.title for r in rows] == ["new"]
    assert [r.title for r in documents.entries_without_id(spark, str(path), schema, whole_files=True).collect()] == ["lost"]
    path.write_text('{"page": 1}')
    with pytest.raises(Exception, match="no dataset list"):
        documents.read_catalog(spark, str(path), schema).collect()


def test_repeated_new_keys_are_inserted_once(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (2, "c"), (1, "z")], "id int, v string")
    assert sorted(map(tuple, writes.merge_absent(old, new, ["id"]).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, writes.upsert(old, new, "id").collect())) == [(1, "z"), (2, "c")]


def test_facets_do_not_mix(spark):
    shown = spark.createDataFrame(
        [("tag", "x", 3, True), ("tag", "y", 2, False), ("place", "x", 1, False), ("place", "q", 1, False)],
        "facet string, value string, count int, active boolean",
    )
    tree = spark.createDataFrame(
        [("tag", "x", None), ("tag", "y", None), ("tag", "z", None), ("place", "x", None), ("place", "q", None)],
        "facet string, value string, parent string",
    )
    hidden = facets.hide_inactive_siblings(shown, tree).select("facet", "value").collect()
    assert sorted(map(tuple, hidden)) == [("place", "q"), ("place", "x"), ("tag", "x")]
    flat = facets.hide_inactive_siblings(shown).select("facet", "value").collect()
    assert sorted(map(tuple, flat)) == [("place", "q"), ("place", "x"), ("tag", "x")]
    more = facets.show_siblings(shown, tree).filter("count = 0").select("facet", "value").collect()
    assert [tuple(r) for r in more] == [("tag", "z")]


def test_slider_with_fractions(spark):
    values = spark.createDataFrame([(0.5, 1), (1.5, 2), (2.0, 4)], "value double, count int")
    assert sorted(map(tuple, facets.slider(values, 0.5).collect())) == [(0.5, 1), (1.0, 0), (1.5, 2), (2.0, 4)]


def test_long_numbers_and_quoted_tags(spark, value):
    names = ["100000000000000000000", "99999999999999999999", "9", "010"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(sorts.natural_key("n")).collect()
    assert [r.n for r in rows] == ["9", "010", "99999999999999999999", "100000000000000000000"]
    long = "x," * 20_000
    assert value(lists.explode_tags, f'"{long}", b') == [long, "b"]
    assert value(lists.quoted_list, f'a,"{long}"') == ["a", long]


def test_lists_differ_by_their_items(spark):
    one = spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>")
    other = spark.createDataFrame([(1, ["a, b"])], "k int, v array<string>")
    assert diffs.difference(one, other, "k").count() == 1


def test_zones_and_hmac(value):
    assert value(dates.zone_of_offset, 28800, "int") == "Asia/Shanghai"
    assert value(dates.zone_of_offset, 21600, "int") == "Asia/Novosibirsk"
    for key in ("k", "long" * 40):
        digest = hmac.new(key.encode(), "tëxt".encode(), hashlib.sha256).digest()
        expected = base64.urlsafe_b64encode(digest).decode().rstrip("=")
        assert value(lambda x: hashes.url_safe_hmac(x, key), "tëxt") == expected
