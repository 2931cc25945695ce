"""Keyword search: an inverted index, scored search, completion, more-like-this.

The reference's scoring is not visible; the score here is tf * ln(N / df). Query terms
filter the words of a text before anything is shuffled, so a search moves hits only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.operators.diffs import merged
from tabulark.operators.predicates import group, words, words_of
from tabulark.scale import lookup_join
from tabulark.scratch import cut


def exploded(docs: DataFrame, terms: Column, *keep: str, name: str = "term") -> DataFrame:
    """One row per term. The outer form spares the size and NULL checks that would cut the text again."""
    return docs.select(*keep, F.explode_outer(terms).alias(name)).filter(F.col(name).isNotNull())


def index(docs: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Term frequencies (field, term, key, tf). ``fields`` maps a column to ``text`` or ``string``.

    Text fields are cut into words; string fields are one lower-case term.
    """

    def entries(name: str, kind: str) -> DataFrame:
        if kind == "text":
            terms = exploded(docs.select(key, name), words(name), key)
        else:
            terms = docs.select(key, F.lower(name).alias("term")).filter(F.col("term").isNotNull())
        return terms.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf")).withColumn("field", F.lit(name))

    return merged([entries(name, kind) for name, kind in fields.items()]).select("field", "term", key, "tf")


def terms_of(keys: str | Sequence[str], mode: str = "terms") -> list[str]:
    """Query keys by parse mode: ``direct`` passes them on, ``phrase`` is one key, ``terms`` splits."""
    if not isinstance(keys, str):
        return list(keys)
    if mode in ("direct", "phrase"):
        return [keys]
    return keys.split()


def search(docs: DataFrame, key: str, field: str, keys: Sequence[str], conjunction: str = "OR") -> DataFrame:
    """Matching documents with a relevance score, without an index; at least one keyword is required.

    Keys are cut as the texts are; several words are a phrase, keys without a word are left out. One pass over the
    texts counts every key per document; the hits are written, and scored there without a shuffle.
    Document frequencies are one number per key.
    """
    units = sorted({tuple(found) for found in map(words_of, keys) if found})
    if not units:
        raise ValueError("a search needs at least one keyword")

    def count(found: Column, unit: tuple[str, ...]) -> Column:
        if len(unit) == 1:
            return F.size(F.filter(found, lambda word: word == unit[0]))
        wanted = F.array(*[F.lit(word) for word in unit])
        return F.size(F.filter(F.transform(found, lambda _, i: F.slice(found, i + 1, len(unit))), lambda run: run == wanted))

    def counts(found: Column) -> Column:
        return F.array(*[count(found, unit) for unit in units])

    # A one-element array binds the words, so they are cut once for all keywords.
    tf = F.transform(F.array(words(field)), counts)[0]
    # A text without the letters of the keywords need not be cut into words.
    lowered = F.lower(field)
    likely = docs.filter(group("OR", [group("AND", [lowered.contains(word) for word in unit]) for unit in units]))
    texts = likely.select(key, field)
    hits = cut(texts.select(key, tf.alias("tf")), "hits").filter(F.exists("tf", lambda n: n > 0))
    total = docs.count()
    with_term = hits.agg(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(units))]).first()
    idf = [math.log(total / n) if n else 0.0 for n in with_term]
    score = sum((F.col("tf")[i] * F.lit(weight) for i, weight in enumerate(idf)), F.lit(0.0))
    scored = hits.select(key, F.round(score, 4).alias("score"), F.size(F.filter("tf", lambda n: n > 0)).cast("bigint").alias("terms"))
    return scored.filter(F.col("terms") == len(units)) if conjunction == "AND" else scored


def completions(docs: DataFrame, field: str, prefix: str, limit: int = 10) -> DataFrame:
    """Words that begin with the prefix, with the number of documents that hold them."""
    starts = F.array_distinct(F.filter(words(field), lambda w: w.startswith(prefix.lower())))
    likely = docs.filter(F.lower(field).contains(prefix.lower()))
    return exploded(likely, starts).groupBy("term").agg(F.count(F.lit(1)).alias("results")).orderBy(F.desc("results"), "term").limit(limit)


def more_like_this(docs: DataFrame, key: str, field: str, item, limit: int = 10) -> DataFrame:
    """Documents most similar to one: shared terms weighted by rarity, damped by length.

    Only the item's own terms are matched, so the pairs are (document, shared term).
    """
    seed = exploded(docs.filter(F.col(key) == item), words(field)).groupBy("term").agg(F.count(F.lit(1)).alias("seed_tf"))
    # The length is taken below the explode: beside it, it would be worked out per word.
    sized = docs.select(key, field).withColumn("length", F.length(field))
    hits = lookup_join(exploded(sized, words(field), key, "length"), seed, ["term"])
    shared = cut(hits.groupBy(key, "length", "term", "seed_tf").agg(F.count(F.lit(1)).alias("tf")), "shared")
    total = docs.count()
    rarity = shared.groupBy("term").agg(F.log(F.lit(float(total)) / F.count(F.lit(1))).alias("idf"))
    weighted = lookup_join(shared, rarity, ["term"])
    weight = F.col("tf") * F.col("seed_tf") * F.col("idf") * F.col("idf")
    scores = weighted.filter(F.col(key) != item).groupBy(key, "length").agg(F.sum(weight).alias("weight"))
    score = F.round(F.col("weight") / F.sqrt("length"), 4)
    return scores.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def with_index_columns(items: DataFrame, url_base: str, key: str, entity_type: str, values: Mapping[str, Column]) -> DataFrame:
    """Columns added per item before indexing: its URL, its type and custom values."""
    url = F.concat(F.lit(url_base.rstrip("/") + "/"), F.col(key).cast("string"))
    return items.withColumns({"url": url, "entity_type": F.lit(entity_type), **values})
