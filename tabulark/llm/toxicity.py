"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models of order ``ORDER`` predict each letter of a word from the letters before it, one from toxic and one from
ordinary labelled documents. Their highest order holds class counts; all lower orders are shared, so that rare
expressions fall back on continuation counts (how many different letters precede a letter group) gathered from the
words of every document, labelled or not. A word's evidence is the difference of its two
log-likelihoods divided by its length; a document's is that of its most toxic word, so one insult
in a long text is not diluted. A logistic curve turns it into a score.

Counts are exact, one row per letter group in tables that grow with the corpus; letters are code points of any script.
Tasks add up what they meet, groups are summed and joined by Spark. What scoring needs are log ratios of the groups that
labelled texts hold: up to ``MODEL_ROWS`` of them are sent to the workers, more are joined to the words of the texts. Both
ways give the same scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import bounded, free_names
from tabulark.scratch import cut

# Letters of a group: the history and the letter it predicts.
ORDER = 5
DISCOUNT = 0.75
# Distinct words a worker counts or remembers, and letter groups it adds up, at a time.
WORDS = 300_000
GROUPS = 1_000_000
# Rows of a model that travel to the workers whole.
MODEL_ROWS = 500_000
# The curve is fitted on labelled rows that were not counted, one of SPARED, and on so many at most.
SPARED = 4
CALIBRATION_ROWS = 20_000

WORD = re.compile(r"[^\W\d_]+")
# Stands before a word's first letter, as often as a history is long, and once after its last.
EDGE = "\n"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def groups_of(word: str) -> list[str]:
    """A letter group for each letter of a word and for its end."""
    padded = EDGE * (ORDER - 1) + word + EDGE
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    counted = {"toxic": Counter(), "ordinary": Counter()}
    sums: dict[str, list[int]] = {}

    def gather():
        for word in seen:
            toxic, ordinary = counted["toxic"][word], counted["ordinary"][word]
            for group in groups_of(word):
                own = sums.setdefault(group, [0, 0])
                own[0] += toxic
                own[1] += ordinary
        seen.clear()
        for own in counted.values():
            own.clear()

    def rows():
        columns = [list(sums), [s[0] for s in sums.values()], [s[1] for s in sums.values()]]
        sums.clear()
        types = [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["gram", "toxic", "ordinary"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = words_of(text.as_py())
            seen.update(words)
            if toxic is not None:
                counted["toxic" if toxic else "ordinary"].update(words)
            if len(seen) > WORDS:
                gather()
                if len(sums) > GROUPS:
                    yield rows()
    gather()
    yield rows()


def train_counts(docs: DataFrame) -> DataFrame:
    """Letter groups of all rows of ``docs`` (text, toxic: 0, 1 or null where there is no label to learn from).

    One row per ``gram``, with how often it stands in toxic and in ordinary texts; groups of texts without a label have zeros.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    parts = rows.mapInArrow(_count, "gram string, toxic bigint, ordinary bigint")
    return cut(parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")


def _history(letters: int) -> Column:
    return F.substring("gram", 1, letters).alias("history")


def shared_model(grams: DataFrame) -> DataFrame:
    """(lower, p): the shared probability of the last letter of each group one letter shorter than ``gram``.

    Each order discounts how many different letters precede a group and spreads the rest as the order below says; at the
    bottom all letters are alike, so what a letter gives up it gets back.
    """
    tables = {ORDER: grams}
    for size in range(ORDER - 1, 0, -1):
        shorter = tables[size + 1].groupBy(F.substring("gram", 2, size).alias("gram"))
        tables[size] = cut(shorter.agg(F.count(F.lit(1)).alias("n")), f"before{size}")
    total = float(tables[1].agg(F.sum("n")).first()[0] or 1)
    lower = tables[1].select(F.col("gram").alias("lower"), (F.col("n") / total).alias("p"))
    for size in range(2, ORDER):
        totals = tables[size].groupBy(_history(size - 1)).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        here = tables[size].withColumn("history", _history(size - 1)).withColumn("lower", F.substring("gram", 2, size - 1))
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")
        lower = here.join(totals, "history").join(lower, "lower").select(F.col("gram").alias("lower"), p.alias("p"))
    return lower


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood as toxic less that as ordinary, for each group that a labelled text holds.

    A row whose ``gram`` is a history alone is for all its letters that no labelled text has there: the shared
    probability is the same on both sides, so only what the classes leave to it differs. Other groups have ratio 0.
    """
    known = grams.where("toxic + ordinary > 0").withColumn("history", _history(ORDER - 1))
    sums = [F.sum(c).alias(f"{c}_total") for c in ("toxic", "ordinary")] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    totals = known.groupBy("history").agg(*sums)

    def left(name: str) -> Column:
        total, kinds = F.col(f"{name}_total"), F.col(f"{name}_kinds")
        return F.when(total > 0, DISCOUNT * kinds / total).otherwise(1.0)

    def share(name: str) -> Column:
        own = F.greatest(F.col(name) - F.lit(DISCOUNT), F.lit(0.0)) / F.greatest(F.col(f"{name}_total"), F.lit(1))
        return own + left(name) * F.col("p")

    seen = known.withColumn("lower", F.substring("gram", 2, ORDER - 1)).join(shared_model(grams), "lower").join(totals, "history")
    unseen = totals.select(F.col("history").alias("gram"), F.log(left("toxic") / left("ordinary")).alias("ratio"))
    return seen.select("gram", F.log(share("toxic") / share("ordinary")).alias("ratio")).unionByName(unseen)


@dataclass
class Model:
    """A written table of log ratios, and the curve from evidence to score."""

    ratios: DataFrame
    slope: float = 0.0
    shift: float = 0.0


def word_evidence(word: str, ratio: dict[str, float]) -> float:
    total = 0.0
    for group in groups_of(word):
        own = ratio.get(group)
        total += ratio.get(group[:-1], 0.0) if own is None else own
    return total / (len(word) + 1)


def _evidence_of_known(model: Model, ratio: dict[str, float]):
    """Column function: the evidence of a text's most toxic word; 0 where there is no word."""
    shipped = model.ratios.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def worst(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, known = shipped.value, {}
        for texts in parts:
            found = []
            for text in texts:
                words = set(words_of(text))
                new = [w for w in words if w not in known]
                if new and len(known) > WORDS:
                    known.clear()
                    new = words
                for word in new:
                    known[word] = word_evidence(word, ratio)
                found.append(max(map(known.__getitem__, words), default=0.0))
            yield pd.Series(found, dtype="float64")

    return worst


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            words = list(set(words_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(words), pa.string()), pa.array(words, pa.string())], names=["key", "word"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word in batch.column(0).to_pylist():
            counts = Counter(groups_of(word))
            columns = [[word] * len(counts), list(counts), list(counts.values()), [len(word) + 1] * len(counts)]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "gram", "n", "size"])


def _evidence_by_joins(texts: DataFrame, model: Model) -> DataFrame:
    """(key, x): the evidence of each distinct text (key, text), whatever the size of the model."""
    words = cut(texts.mapInArrow(_words, "key string, word string"), "words")
    groups = words.select("word").distinct().mapInArrow(_groups, "word string, gram string, n bigint, size bigint")
    history = model.ratios.select(F.col("gram").alias("history"), F.col("ratio").alias("otherwise"))
    joined = groups.withColumn("history", _history(ORDER - 1)).join(model.ratios, "gram", "left").join(history, "history", "left")
    each = F.col("n") * F.coalesce("ratio", "otherwise", F.lit(0.0)) / F.col("size")
    evidence = joined.groupBy("word").agg(F.sum(each).alias("x"))
    return cut(words.join(evidence, "word").groupBy("key").agg(F.max("x").alias("x")), "evidence")


def with_evidence(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The rows of ``docs`` with the evidence of their texts as column ``name``, which is none of theirs."""
    text = F.coalesce(docs["text"], F.lit(""))
    if model.ratios.count() <= MODEL_ROWS:
        ratio = {row["gram"]: row["ratio"] for row in model.ratios.collect()}
        return docs.select("*", _evidence_of_known(model, ratio)(text).alias(name))
    key = F.sha2(text, 256)
    found = _evidence_by_joins(docs.select(key.alias("key"), text.alias("text")).dropDuplicates(["key"]), model)
    joined = docs.join(found, key == found["key"], "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(found["x"], F.lit(0.0)).alias(name))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, penalty: float = 1e-6) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    n1, n0 = float(toxic.sum()), float((1 - toxic).sum())
    if not n1 or not n0:
        return 0.0, (50.0 if n1 else -50.0)
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.full(len(toxic), 1 / (n0 + n1))
    x = np.stack([evidence, np.ones(len(evidence))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
        gradient = x @ (weight * (p - target)) + penalty * w * (1, 0)
        hessian = (x * (weight * p * (1 - p))) @ x.T + np.diag([penalty, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_of(evidence: Column, model: Model) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(evidence * F.lit(model.slope) + F.lit(model.shift))))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of all ``docs`` and the labels of those that are not held out.

    ``labels`` has (doc_id, toxic); null labels and ids teach nothing, and of several labels of one document the
    largest counts. Of the labelled rows one in ``SPARED``, by a hash of the id, may be spared from the counts: the
    ``CALIBRATION_ROWS`` with the smallest hash at most, on which the curve is fitted. All others are counted. Without a toxic or without an ordinary label every score is
    that of the class there is, and 0 with no label at all.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = cut(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    spared = F.pmod(F.xxhash64("doc_id"), F.lit(SPARED)) == 0
    few = known.where(spared).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    few = cut(few.withColumnRenamed("doc_id", "known_id"), "calibration")
    # Ids and labels alone; beyond the bound texts meet them in a shuffled join.
    counted = cut(known.join(F.broadcast(few.select("known_id")), F.col("doc_id") == F.col("known_id"), "left_anti"), "counted")
    counted = bounded(counted.withColumnRenamed("doc_id", "known_id"))
    texts = docs.select("doc_id", "text").join(counted, F.col("doc_id") == F.col("known_id"), "left")
    model = Model(cut(ratios(train_counts(texts)), "ratios"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("known_id"))
    points = with_evidence(chosen, model, "x").groupBy(F.round("x", 2).alias("x"), "toxic")
    # Evidence to two places: a few hundred rows, whatever the number of documents.
    rows = points.agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.repeat([r["x"] for r in rows], [r["n"] for r in rows]) if rows else np.zeros(0)
    y = np.repeat([r["toxic"] for r in rows], [r["n"] for r in rows]) if rows else np.zeros(0)
    model.slope, model.shift = fit_curve(np.asarray(x, float), np.asarray(y, float))
    return model


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with the score added as column ``name`` (in place of one so called).

    Only the text is looked at, all of it. A null text, an empty one and one without letters have no evidence and
    get the curve's value at 0. Repeated rows are scored alike; no rows give none.
    """
    (evidence,) = free_names(docs, "evidence")
    others = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return with_evidence(docs, model, evidence).select(*others, score_of(F.col(f"`{evidence}`"), model).alias(name))
