from tabulark.llm import toxicity
from tabulark.llm.common import settled


def test_only_rows_of_the_curve_are_not_counted(spark, monkeypatch):
    settled(spark)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 5)
    seen, count = [], toxicity.train_counts

    def counting(docs):
        seen.append(docs.where("toxic is not null").count())
        return count(docs)

    monkeypatch.setattr(toxicity, "train_counts", counting)
    docs = spark.range(300).selectExpr("id as doc_id", "'some words' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    toxicity.train(docs, labels)
    usable = labels.where(~toxicity.held_out(labels["doc_id"])).count()
    assert seen == [usable - 5]
