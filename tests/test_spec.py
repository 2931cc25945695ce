"""Datastore queries: aliases, implied joins, limits."""

import pytest

from tabulark.plans import spec


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame([(1, "ann", None), (2, "bob", 1), (3, "cy", 1), (4, "di", 3)], "id int, name string, boss int")
    pets = spark.createDataFrame([(1, "rex", 2), (2, "tom", 4)], "id int, name string, owner int")
    return {"people": people, "pets": pets}


RELATIONS = {
    "boss": {"resource": "people", "on": "people.boss = boss.id"},
    "top": {"resource": "people", "on": "boss.boss = top.id", "how": "left"},
    "pet": {"resource": "pets", "on": "pet.owner = people.id"},
}


def rows(tables, query, **how):
    return sorted(map(tuple, spec.run(tables, query, **how).collect()), key=str)


def test_one_table_by_two_aliases(tables):
    query = {"resource": "people", "relations": RELATIONS, "fields": {"who": "people.name", "boss": "boss.name"}}
    assert rows(tables, query) == [("bob", "ann"), ("cy", "ann"), ("di", "cy")]
    join = {"resource": "people", "alias": "b", "on": "p.boss = b.id"}
    query = {"resource": "people", "alias": "p", "joins": [join, join], "fields": {"who": "p.name"}, "conditions": {"field": "b.name", "value": "ann"}}
    assert rows(tables, query) == [("bob",), ("cy",)]


def test_only_named_relations_are_joined_and_what_they_need(tables):
    query = {"resource": "people", "relations": RELATIONS, "fields": {"who": "people.name", "top": "top.name"}}
    assert [spec.alias_of(j) for j in spec.joins_of(query)] == ["boss", "top"]
    assert rows(tables, query) == [("bob", None), ("cy", None), ("di", "ann")]
    none = {"resource": "people", "relations": RELATIONS, "fields": {"who": "concat(name, ' boss.')"}}
    assert spec.joins_of(none) == [] and len(rows(tables, none)) == 4


def test_shared_column_names_in_conditions_groups_and_sorts(tables):
    query = {
        "resource": "people", "relations": RELATIONS, "fields": {"who": "people.name"}, "sorts": [("pet.name", "desc")],
        "conditions": {"group": "OR", "conditions": [{"field": "pet.name", "value": "rex"}, {"field": "pet.id", "value": 2}]},
    }
    assert [r.who for r in spec.run(tables, query).collect()] == ["di", "bob"]
    query = {"resource": "people", "relations": RELATIONS, "group_by": ["boss.name"], "aggregates": {"n": "count(people.id)"}}
    assert rows(tables, query) == [("ann", 2), ("cy", 1)]


def test_names_that_clash_and_circles_are_refused():
    query = {"resource": "people", "joins": [{"resource": "people", "on": "true"}]}
    with pytest.raises(ValueError, match="go by the name"):
        spec.joins_of(query)
    with pytest.raises(ValueError, match="two different joins"):
        spec.joins_of({"resource": "people", "joins": [{"resource": "pets", "on": "a"}, {"resource": "pets", "on": "b"}]})
    circle = {"a": {"resource": "pets", "on": "a.id = b.id"}, "b": {"resource": "pets", "on": "b.id = a.id"}}
    with pytest.raises(ValueError, match="need each other"):
        spec.joins_of({"resource": "people", "relations": circle, "fields": {"x": "a.id"}})


def test_requests_beyond_the_maximum_are_reported_or_refused(tables):
    query = {"resource": "people", "fields": {"id": "id"}, "limit": 4}
    with pytest.warns(UserWarning, match="4 rows asked, 3 is the maximum"):
        assert len(rows(tables, query, maximum=3)) == 3
    with pytest.raises(ValueError, match="4 rows asked"):
        spec.run(tables, query, rows_limit=3, strict=True)
    assert len(rows(tables, query, rows_limit=4, strict=True)) == 4
    # One setting is the default and the maximum.
    assert len(rows(tables, {"resource": "people", "fields": {"id": "id"}}, rows_limit=2)) == 2
