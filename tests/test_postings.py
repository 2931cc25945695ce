"""The written index: phrases, changes, merges, pruning."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulark.operators import postings, search
from tabulark.operators.postings import Index
from tabulark.operators.predicates import words_of
from tabulark.scratch import table_path

TEXTS = {
    1: "The bunny's ears were fluffy.", 2: "Dignissim & Aliquam; the bunny ears", 3: "ears ears ears, the THE the", 4: "", 5: None,
    6: "the bunny s ears of the bunny's ears", 7: "straße Łódź 2024 éa",
}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "Src", 1) for k, t in texts.items()], "id bigint, text string, kind string, bucket int")


def made(spark, texts, **how):
    index = Index(spark, table_path(spark, "index"), "id", "bigint", {"text": "text", "kind": "string"})
    return index.build(frame(spark, texts), buckets=8, **how)


def cut(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, keys):
    units = {tuple(words_of(k)) for k in keys} - {()}
    tf = {}
    for unit in units:
        found = {k: sum(tuple(cut(t)[i : i + len(unit)]) == unit for i in range(len(cut(t)))) for k, t in texts.items()}
        tf[unit] = {k: n for k, n in found.items() if n}
    score = Counter()
    for found in tf.values():
        for k, n in found.items():
            score[k] += n * math.log(len(texts) / len(found))
    return {k: round(v, 4) for k, v in score.items()}


def scores(index, keys, how="OR"):
    return {r.id: r.score for r in index.search("text", keys, how).collect()}


@pytest.fixture(scope="module")
def index(spark):
    return made(spark, TEXTS)


@pytest.mark.parametrize("keys", [["bunny's"], ["bunny's ears"], ["the"], ["the the"], ["ears", "the bunny"], ["&amp;", "fluffy!"], ["nothing here"], ["STRASSE", "Straße"]])
def test_keys_with_punctuation_and_phrases(index, keys):
    assert scores(index, keys) == brute(TEXTS, keys)
    scanned = search.search(frame(index.spark, TEXTS), "id", "text", keys)
    assert {r.id: r.score for r in scanned.collect()} == brute(TEXTS, keys)


@pytest.mark.parametrize("keys", [["&"], ["&amp;"], [" ", "--"], []])
def test_a_search_without_a_keyword_is_refused(index, keys):
    with pytest.raises(ValueError, match="at least one keyword"):
        index.search("text", keys)


def test_all_keys(index):
    assert set(scores(index, ["bunny's", "fluffy"], "AND")) == {1}


def test_only_the_buckets_of_the_keywords_are_read(index):
    plan = index.postings(["bunny"], "text")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan) and "EqualTo(term,bunny)" in plan
    assert "Python" not in plan


def state_of(index):
    entries = sorted((r.field, r.term, r.id, r.tf, tuple(r.positions)) for r in index.postings().collect())
    return entries, sorted(r.id for r in index.items().collect()), index.state().items


def test_changes_show_without_a_rebuild_and_merge_to_a_fresh_index(spark):
    texts = dict(TEXTS)
    index = made(spark, texts)

    def change(new, removed):
        index.change(frame(spark, new), spark.createDataFrame([(k,) for k in removed], "id bigint"))
        texts.update(new)
        for k in removed:
            texts.pop(k, None)

    change({8: "a new bunny", 3: "rewritten ears"}, [2, 99])
    assert scores(index, ["bunny", "ears"]) == brute(texts, ["bunny", "ears"])
    change({2: "the bunny is back"}, [8])
    assert state_of(index) == state_of(made(spark, texts))
    assert [(r.term, r.results) for r in index.completions("text", "b").collect()] == [("bunny", 3), ("back", 1)]
    index.merge()
    assert state_of(index) == state_of(made(spark, texts)) and len(index.state().segments) == 1
    assert [(r.term, r.results) for r in index.completions("text", "b").collect()] == [("bunny", 3), ("back", 1)]
    # What a failed job leaves behind is not visible.
    before = state_of(index)
    index._add("unfinished", index.postings().limit(3).withColumns({"bucket": F.lit(1), "slice": F.lit(1)}), index.items(), None)
    assert state_of(index) == before
    change({4: "after the merge"}, [1])
    assert state_of(index) == state_of(made(spark, texts))


def test_completions_read_one_bucket(index):
    counts = Counter(w for t in TEXTS.values() for w in set(cut(t)))
    for prefix in ("t", "the", "B", "é", "zz"):
        want = sorted(((-n, w) for w, n in counts.items() if w.startswith(prefix.lower())))[:10]
        assert [(r.term, r.results) for r in index.completions("text", prefix).collect()] == [(w, -n) for n, w in want]
    plan = index.completions("text", "th")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    # More than were listed are counted from the postings.
    assert index.completions("text", "", 100).count() == len(counts)


def test_completions_can_be_added_later(spark):
    index = made(spark, TEXTS, listed=0)
    before = index.completions("text", "b").collect()
    index.complete()
    index.complete()
    assert index.state().listed == 10 and len(index.state().segments) == 1
    assert index.completions("text", "b").collect() == before and state_of(index) == state_of(made(spark, TEXTS))


def test_more_like_this(spark, index):
    found = [r.id for r in index.more_like_this(frame(spark, TEXTS), "text", 1).collect()]
    assert found[0] == 6 and set(found) == {2, 3, 6}
    assert index.more_like_this(frame(spark, TEXTS), "text", 99).collect() == []


def test_no_items(spark):
    index = made(spark, {})
    assert scores(index, ["the"]) == {} and index.completions("text", "t").collect() == []
    index.change(frame(spark, {1: "the"}), spark.createDataFrame([], "id bigint"))
    assert scores(index, ["the"]) == {1: 0.0}


def test_words_are_put_together_without_moving_them(spark):
    long = " ".join(f"w{i % 700} the" for i in range(5000))
    texts = {**TEXTS, 8: long, 9: "\n--\n"}
    entries = postings._entries(frame(spark, texts), "id", {"text": "text", "kind": "string"}, 8)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    want = {(k, w): [i for i, x in enumerate(cut(t)) if x == w] for k, t in texts.items() for w in cut(t)}
    assert {(r.id, r.term): r.positions for r in entries.where("field = 'text'").collect()} == want
    assert entries.where("field = 'text' and tf != size(positions)").count() == 0 and entries.where("field = 'kind'").count() == len(texts)


def test_items_of_older_segments_are_hidden_by_a_broadcast_or_a_join(spark, monkeypatch):
    index = made(spark, TEXTS, listed=0)
    index.change(frame(spark, {3: "the bunny"}), spark.createDataFrame([(1,)], "id bigint"))
    few, joined = index.postings(), "SortMergeJoin"
    # Whatever Spark would choose itself, a counted number of keys is broadcast.
    monkeypatch.setattr(postings, "FEW_GONE", 0)
    many = index.postings()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joined not in few._jdf.queryExecution().executedPlan().toString()
        assert joined in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_phrases_read_positions(index, monkeypatch):
    plans = []
    kept = postings.cut
    monkeypatch.setattr(postings, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, label))
    assert scores(index, ["ears", "bunny"]) == brute(TEXTS, ["ears", "bunny"])
    assert scores(index, ["ears", "the bunny"]) == brute(TEXTS, ["ears", "the bunny"])
    assert "positions" not in plans[0] and "positions" in plans[1]
