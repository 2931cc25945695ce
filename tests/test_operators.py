"""Operators on small literal rows."""

import pytest
from pyspark.sql import functions as F

from tabulark.operators import aggregates, diffs, facets, joins, predicates as p, search
from tabulark.plans import process, spec
from tabulark.sources import delimited, documents, writes


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "John", 25, "Singer"), (2, "George", 27, "Singer"), (3, "Ringo", 28, "Drummer"), (4, "Paul", 26, "Songwriter")]
    return spark.createDataFrame(rows, "id bigint, name string, age int, job string")


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_spec_orders_by_two_keys_and_pages(people):
    query = {"resource": "t", "sorts": [("job", "asc"), ("age", "asc")], "fields": {"name": "name", "job": "job", "age": "age"}}
    assert names(spec.run({"t": people}, query)) == ["Ringo", "John", "George", "Paul"]
    assert names(spec.run({"t": people}, query | {"limit": 2, "offset": 1})) == ["John", "George"]
    assert len(names(spec.run({"t": people}, query | {"limit": 100}, maximum=3))) == 3


def test_spec_joins_an_alias_once():
    join = {"resource": "x", "on": "a = b"}
    assert spec.joins_of({"joins": [join, join, {"resource": "x", "alias": "y", "on": "a = b"}]}) == [
        join,
        {"resource": "x", "alias": "y", "on": "a = b"},
    ]


def test_null_conditions(spark):
    df = spark.createDataFrame([("Kermit", 25), ("Ernie", None), ("Gonzo", 27)], "name string, age int")
    assert names(df.filter(p.condition("age", None))) == ["Ernie"]
    assert names(df.filter(p.condition("age", None, "<>"))) == ["Kermit", "Gonzo"]
    assert names(df.filter(p.condition("age", [25, None], "NOT IN"))) == []
    assert names(writes.delete_where(df, F.col("age") > 26)) == ["Kermit", "Ernie"]
    assert writes.delete_where(df).count() == 0
    with pytest.raises(TypeError):
        p.condition("age", "25", "IN")
    with pytest.raises(ValueError):
        p.group("XOR", [])


@pytest.mark.parametrize("text, numeric", [("1", True), (" 1.5e3 ", True), (".5", True), ("1d", False), ("NaN", False), ("0x1A", False), ("", False), ("1 2", False)])
def test_numeric_text(value, text, numeric):
    assert value(p.is_numeric_text, text) is numeric


def test_slider_bounds():
    assert p.slider_bounds("(min:-5,max:10.5)") == (-5.0, 10.5)
    assert p.slider_bounds("5") is None


def test_upsert_overwrites_with_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, writes.upsert(old, new, "id").collect()), key=str) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_hierarchy_walk(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("a", None)]
    tree = spark.createDataFrame(links, "term string, parent string")
    root = tree.filter("term = 'a'")
    walk = lambda roots, depth: sorted(names(joins.terms_to_depth(tree, roots, depth), "term"))
    assert walk(root, 0) == ["a"]
    assert walk(root, 1) == ["a", "b"]
    assert walk(root, 99) == ["a", "b", "c", "d"]
    assert walk(tree.filter("term = 'c'"), -1) == ["b", "c"]


def facet_rows(spark, rows):
    return spark.createDataFrame(rows, "facet string, value string, count bigint, active boolean, parent string")


def test_hide_only_item(spark):
    one = facet_rows(spark, [("f", "llama", 10, False, None)])
    chosen = facet_rows(spark, [("f", "llama", 10, True, None)])
    two = one.unionByName(facet_rows(spark, [("f", "duck", 15, False, None)]))
    assert [facets.hide_only_item(df).count() for df in (one, chosen, two)] == [0, 1, 2]


def test_deepest_only(spark):
    rows = [("f", "a", 1, False, None), ("f", "a_1", 1, False, "a"), ("f", "b", 1, False, None), ("f", "c", 1, False, None)]
    assert sorted(names(facets.deepest_only(facet_rows(spark, rows)), "value")) == ["a_1", "b", "c"]


def test_date_parent(value):
    assert value(facets.date_parent, "2024-05-01") == "2024-05"
    assert value(facets.date_parent, "2024-05-01T10:30") == "2024-05-01T10"
    assert value(facets.date_parent, "2024") is None


def test_slider_rounds_up_and_fills(spark):
    counts = spark.createDataFrame([(2, 5), (4, 1), (7, 3)], "value int, count bigint")
    rows = sorted(map(tuple, facets.slider(counts, 3).collect()))
    assert rows == [(2.0, 5), (5.0, 0), (8.0, 0)]
    assert sorted(map(tuple, facets.slider(counts, 1, 6, 8).collect())) == [(6.0, 0), (7.0, 3), (8.0, 0)]


def test_glossary(spark):
    df = spark.createDataFrame([(c,) for c in "abbccc"], "title string")
    assert [tuple(r) for r in aggregates.glossary(df, "title").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_difference_is_strict_and_one_sided(spark):
    left = spark.sql("SELECT 1 AS id, named_struct('x', 1, 'y', 'a') AS s, cast(null AS string) AS n")
    right = spark.sql("SELECT 1 AS id, named_struct('x', '1', 'y', 'a', 'z', 3) AS s, cast(null AS string) AS n")
    assert [tuple(r) for r in diffs.difference(left, right, "id").collect()] == [(1, "s.x", "1")]


def test_search_needs_a_keyword(spark):
    docs = spark.createDataFrame([(1, "Big cats"), (2, "cats, cats!"), (3, "category")], "id int, text string")
    with pytest.raises(ValueError):
        search.search(docs, "id", "text", [" "])
    assert sorted(r.id for r in search.search(docs, "id", "text", ["CATS"]).collect()) == [1, 2]
    assert names(search.completions(docs, "text", "cat"), "term") == ["cats", "category"]
    assert names(docs.filter(p.phrase("text", "Big CATS")), "id") == [1]


def test_orphans(spark):
    old = spark.createDataFrame([("theme", "a"), ("theme", "b")], "property string, ref string")
    new = spark.createDataFrame([("theme", "b")], "property string, ref string")
    assert [tuple(r) for r in joins.orphans(old, new, ["property", "ref"]).collect()] == [("theme", "a")]


def test_processors_replace_and_order(spark):
    order = []
    found = process.Processors()
    found.add(lambda df: order.append("late") or df, 5)
    found.add(lambda df: order.append("gone") or df, 1)
    found.add(lambda df: order.append("early") or df, 1)
    found.run(spark.range(1))
    assert order == ["early", "late"]


def test_catalog_keeps_the_last_entry(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{"page":1,"dataset":[{"identifier":"x","title":"old"},{"identifier":"y","title":"y"},{"identifier":"x","title":"new"}]}\n')
    rows = documents.read_catalog(spark, str(path), "identifier: string, title: string").collect()
    assert sorted(map(tuple, rows)) == [("x", "new"), ("y", "y")]


def test_extract_guard(spark):
    items = spark.createDataFrame([("[1]",)], "item string")
    with pytest.raises(ValueError):
        documents.guard_items(items, "item")
    with pytest.raises(ValueError):
        documents.guard_items(items.limit(0), "item")
    good = spark.createDataFrame([('{"a":1}',)], "item string")
    assert documents.guard_items(good, "item").count() == 1


def test_wide_csv_and_long_headings(spark, tmp_path):
    headings = [f"{i:03d}_" + "h" * 74 for i in range(400)]
    (tmp_path / "wide.csv").write_text(",".join(headings) + "\n" + ",".join(str(i) for i in range(400)) + "\n")
    df = delimited.import_delimited(spark, str(tmp_path / "wide.csv"))
    assert len(set(df.columns)) == 400 and {len(c) for c in df.columns} == {64}
    assert df.first()[399] == "399"
    assert delimited.heading("a" * 64) == "a" * 64


def test_null_literal(spark, tmp_path):
    (tmp_path / "n.csv").write_text('a,b,c\nNULL,"NULL",x\n"p, NULL,q",NULL,NULL\n"NULL ""NULL"" y",NULLABLE,1\n')
    rows = [tuple(r) for r in delimited.import_delimited(spark, str(tmp_path / "n.csv"), null_literal=True).collect()]
    assert rows == [(None, "NULL", "x"), ("p, NULL,q", None, None), ('NULL "NULL" y', "NULLABLE", "1")]


def test_spec_counts_all_pages_and_alters_by_tag(people):
    query = {"resource": "t", "conditions": {"field": "age", "value": 26, "op": ">="}, "limit": 1}
    assert spec.count({"t": people}, query).first()["count"] == 3
    rules = {"range": lambda df: df.orderBy("id").limit(2), "drop": lambda df: df.drop("age"), "other": lambda df: df.limit(0)}
    assert spec.altered(people, ["range", "drop", "unknown"], rules).columns == ["id", "name", "job"]


def test_relevance_sort_needs_a_score(people):
    from tabulark.operators import sorts

    assert sorts.by_relevance(people) == []
    assert len(sorts.by_relevance(people.withColumn("score", F.lit(1)))) == 1
    with pytest.raises(ValueError):
        sorts.by_header(people, "nobody", "asc")
    assert names(sorts.page(people, [sorts.by_header(people, "age;", "DESC")], 2)) == ["Ringo", "George"]


def test_salting_allows_map_columns(spark):
    from tabulark import scale

    df = spark.range(100).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"), "id")
    lookup = spark.range(3).select(F.col("id").cast("int").alias("k"))
    assert scale.salted_join(df, lookup, ["k"], min_rows=1).count() == 100


def test_tree_rows_lose_no_child(spark):
    schema = "facet string, value string, parent string, count int"
    rows = [("t", "a", None, 5), ("t", "b", "a", 2), ("t", "c", "b", 1), ("t", "ab", "a", 4), ("t", "z", "gone", 3), ("t", "y", "z", 7), ("t", None, None, 9)]
    rows += [("s", "a", "a", 1), ("s", "b", "a", 1)]
    numbered = facets.tree_rows(spark.createDataFrame(rows, schema)).collect()
    got = {(r.facet, r.value): (r.depth, r.left, r.right, r.subtree) for r in numbered}
    assert got == {
        ("s", "a"): (1, 1, 2, 2), ("s", "b"): (2, 2, 2, 1), ("t", None): (1, 3, 3, 9), ("t", "a"): (1, 4, 7, 12), ("t", "ab"): (2, 5, 5, 4),
        ("t", "b"): (2, 6, 7, 3), ("t", "c"): (3, 7, 7, 1), ("t", "z"): (1, 8, 9, 10), ("t", "y"): (2, 9, 9, 7),
    }
    tree = spark.createDataFrame(numbered)
    assert sorted(r.value for r in facets.below(tree, "t", ["b", "a", "z"]).collect()) == ["a", "ab", "b", "c", "y", "z"]
    by_count = facets.tree_rows(spark.createDataFrame(rows, schema), order=["count"])
    assert [r.value for r in by_count.filter("facet = 't'").orderBy("left").collect()] == ["z", "y", "a", "b", "c", "ab", None]
    texts = facets.tree(spark.createDataFrame(rows, schema).selectExpr("*", "value AS label", "false AS active").filter("facet = 't'"))
    assert {r.value: r.tree for r in texts.collect()}["z"] == '{"value":"z","count":3,"children":[{"value":"y","count":7}]}'
    empty = spark.createDataFrame([], schema)
    assert facets.tree_rows(empty).columns == empty.columns + ["depth", "left", "right", "subtree"] and facets.tree_rows(empty).isEmpty()
    for wrong in ([("t", "p", "q", 1), ("t", "q", "p", 1), ("t", "a", None, 1)], [("t", "a", None, 1), ("t", "a", "b", 1), ("t", "b", None, 1)]):
        with pytest.raises(ValueError):
            facets.tree_rows(spark.createDataFrame(wrong, schema))
