"""Plan shapes that must hold at any size."""

import os

import pytest

import workload
from tabulark.session import prepare

FOLDER = "/root/testdata/sf0.001"
QUERIES, _ = workload.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture
def plan(spark, capsys):
    def explained(name):
        df = QUERIES[name](prepare(spark), FOLDER)
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return explained


@pytest.mark.parametrize("name", ["newest_first", "limit_and_offset", "pager_first", "datastore_query", "page_cap"])
def test_pages_are_a_top_k(plan, name):
    text = plan(name)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["condition_groups", "comparison_predicates", "between", "like_pattern"])
def test_filters_and_columns_reach_the_scan(plan, name):
    text = plan(name)
    assert "PushedFilters: [" in text and "PushedFilters: []" not in text
    assert "l_shipdate" not in text and "p_retailprice" not in text


@pytest.mark.parametrize(
    "name", ["exists_or_local", "theta_join", "join_on_override", "cast_key_join", "row_grant_filter", "show_siblings", "harvest_classification"]
)
def test_no_nested_loops(plan, name):
    text = plan(name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["latest_or_published", "representative_row", "max_per_group", "is_all_of", "date_hierarchy", "flood_limit"])
def test_groups_are_combined_before_the_shuffle(plan, name):
    text = plan(name)
    assert "partial_" in text and "SinglePartition" not in text


def test_facets_of_several_fields_share_one_shuffle(spark):
    from pyspark.sql import functions as F

    from tabulark.operators import facets

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counted = facets.counts(docs, {"language": "lang", "publisher": "source"})
    assert counted.filter("facet = 'language'").agg(F.sum("count")).first()[0] == docs.count()
