"""Which texts are moved to look for repeated passages."""

import re

from pyspark.sql import functions as F

from tabulark.llm import substring_dedup
from tabulark.llm.common import keyed, text_key
from tabulark.scratch import cut

SCHEMA = "doc_id bigint, text string, likely boolean, bits string"


def texts(n):
    """Every tenth text ends in one passage; a null id and a null text are among them."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(50)) + (f" {passage}" if i % 10 == 0 else ""), i % 2 == 0, "x") for i in range(n)]
    return [*rows, (None, "alone", None, None), (n, None, True, "y")]


def test_texts_in_a_table_are_always_likely_and_few_others_are(spark):
    docs = keyed(spark.createDataFrame(texts(4000), SCHEMA))
    table = cut(docs.where("doc_id % 10 = 0").select("doc_id", "text_key"), "some")
    rows = substring_dedup.with_likely(docs, docs["text_key"], table, "likely").select("doc_id", "likely").collect()
    assert len(rows) == 4002 and all(r.likely for r in rows if r.doc_id is not None and r.doc_id % 10 == 0)
    assert sum(r.likely for r in rows) < 401 + 0.2 * 3600
    empty = cut(table.limit(0), "none")
    assert not substring_dedup.with_likely(docs, docs["text_key"], empty, "likely").where("likely").head(1)


def test_only_texts_with_repeats_are_moved(spark):
    docs = spark.createDataFrame(texts(300), SCHEMA)
    done = substring_dedup.without_repeats(docs, 35, "passages")
    assert done.columns == [*docs.columns, "passages"]
    found = {r.doc_id: r for r in done.collect()}
    assert len(found) == 302 and {k for k, r in found.items() if r.passages.n_removed} == set(range(0, 300, 10))
    assert all(found[k].passages.n_removed == 40 and found[k].passages.n_words == 90 for k in range(0, 300, 10))
    assert bytes(found[None].passages.kept) == b"alone" and found[300].passages.n_words == 0 and found[300].text is None
    assert (found[7].likely, found[7].bits) == (False, "x")
    # Before the shuffle of the texts stands the filter; the other branch has none.
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and re.search(r"Filter .*getbit", plan)


def test_the_bitmap_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FEWEST_BITS", 64)
    docs = keyed(spark.createDataFrame(texts(2000), SCHEMA))
    table = cut(docs.where("doc_id < 1000").select("doc_id", "text_key"), "some")
    likely = substring_dedup.with_likely(docs, text_key(), table, "likely").where("likely")
    assert likely.where("doc_id < 1000").count() == 1000 and likely.count() < 1000 + 0.25 * 1002
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 64)
    assert substring_dedup.with_likely(docs, text_key(), table, "likely").where(F.col("likely") & (F.col("doc_id") < 1000)).count() == 1000
