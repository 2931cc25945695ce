"""Toxicity: exact counts and ratios against a model written out by hand, and both ways of scoring."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabulark.llm import toxicity
from tabulark.llm.common import settled

TEXTS = [
    ("Vile scum, vile!", 1), ("a fine day\nfine", 0), ("Łódź ist schön", 0), ("vilest мерзость мерзости", 1), ("день и ночь", None),
    ("scumbag", None), ("", 0), (None, 1), ("x" * 3000 + " fine", 0), ("day night scam 12 _", None),
]


def by_hand():
    """Evidence of a word, by the definition of the two models."""
    tops = {0: Counter(), 1: Counter()}
    groups = set()
    for text, toxic in TEXTS:
        for word in toxicity.words_of(text or ""):
            padded = "\n\n\n\n" + word + "\n"
            for end in range(5, len(padded) + 1):
                groups.add(padded[end - 5 : end])
                if toxic is not None:
                    tops[toxic][padded[end - 5 : end]] += 1
    before = {}
    for size in (4, 3, 2, 1):
        counts = defaultdict(set)
        for g in groups:
            counts[g[5 - size :]].add(g[4 - size])
        before[size] = {g: len(letters) for g, letters in counts.items()}
    letters = len(before[1])

    def share(counts, group, lower):
        beside = {g: n for g, n in counts.items() if g[:-1] == group[:-1] and n}
        total = sum(beside.values())
        if not total:
            return lower
        return max(beside.get(group, 0) - 0.75, 0) / total + 0.75 * len(beside) / total * lower

    def probability(group, toxic):
        p = 1 / letters
        for size in (1, 2, 3, 4):
            p = share(before[size], group[5 - size :], p)
        return share(tops[toxic], group, p)

    def evidence(word):
        padded = "\n\n\n\n" + word + "\n"
        parts = [padded[i : i + 5] for i in range(len(word) + 1)]
        return sum(math.log(probability(g, 1) / probability(g, 0)) for g in parts) / len(parts)

    return groups, tops, evidence


def test_counts_and_evidence_by_hand(spark):
    settled(spark)
    data = spark.createDataFrame(TEXTS, "text string, toxic int").repartition(3)
    grams = toxicity.train_counts(data)
    groups, tops, evidence = by_hand()
    assert {r.gram: (r.toxic, r.ordinary) for r in grams.collect()} == {g: (tops[1][g], tops[0][g]) for g in groups}
    ratio = {r.gram: r.ratio for r in toxicity.ratios(grams).collect()}
    for word in {w for text, _ in TEXTS for w in toxicity.words_of(text or "")}:
        assert math.isclose(toxicity.word_evidence(word, ratio), evidence(word), rel_tol=1e-9, abs_tol=1e-12), word


def test_large_models_score_alike(spark, monkeypatch):
    settled(spark)
    docs = spark.createDataFrame([(i % 9, text, i) for i, (text, _) in enumerate(TEXTS * 2 + [("unheard", 0)])], "doc_id bigint, text string, evidence_ int")
    model = toxicity.Model(toxicity.cut(toxicity.ratios(toxicity.train_counts(spark.createDataFrame(TEXTS, "text string, toxic int")))), 3.0, -1.0)
    scores = lambda: sorted((r.evidence_, round(r.score, 12)) for r in toxicity.scored(docs, model, "score").collect())
    small = scores()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    assert scores() == small and len(small) == len(TEXTS) * 2 + 1
    assert toxicity.scored(docs.where(F.lit(False)), model).collect() == []


def test_groups_leave_a_worker_in_parts(spark, monkeypatch):
    batches = list(toxicity._count(iter([_batch(["ab cd", "cd"], [1, None])])))
    monkeypatch.setattr(toxicity, "WORDS", 1)
    monkeypatch.setattr(toxicity, "GROUPS", 1)
    parts = list(toxicity._count(iter([_batch(["ab cd", "cd"], [1, None]), _batch(["ef gh"], [0])])))
    assert len(batches) == 1 and len(parts) > 2
    total = Counter()
    for part in parts:
        for row in part.to_pylist():
            total[row["gram"]] += row["toxic"] + row["ordinary"]
    assert total["\n\n\n\na"] == total["\n\n\n\nc"] == total["\n\n\n\ng"] == 1


def _batch(texts, toxic):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic, pa.int32())], names=["text", "toxic"])
