"""Search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.operators import search
from tabulark.operators.postings import Index
from tabulark.scratch import table_path
from workload import registered, table
from workload.sorts import WORDS, search_sql

FIELDS = {"text": "text", "source": "string"}

# The index of a table is built once in a session, as long as the table has the same files, and searched by all.
_built: dict[tuple, Index] = {}


def built(spark, sf_dir) -> Index:
    docs = table(spark, sf_dir, "documents")
    name = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if name not in _built:
        _built[name] = Index(spark, table_path(spark, "index"), "doc_id", "bigint", FIELDS).build(docs.select("doc_id", *FIELDS), listed=0)
    return _built[name]


@registered(
    f"SELECT 'text' AS field, term, doc_id, count(*) AS tf FROM {WORDS} GROUP BY term, doc_id UNION ALL "
    "SELECT 'source', lower(source), doc_id, 1 FROM documents"
)
def index_build(spark, sf_dir):
    return built(spark, sf_dir).postings().drop("positions")


PLACED = (
    "(SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS place FROM "
    "(SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents))"
)
# The words of the keys below: one word, and phrases of two and three words, whatever stands between them.
PHRASES = (
    f"(WITH w AS MATERIALIZED (SELECT * FROM {PLACED}), hit AS ("
    "SELECT doc_id, 1 AS unit, count(*) AS tf FROM w WHERE term = 'eriner' GROUP BY ALL UNION ALL "
    "SELECT a.doc_id, 2, count(*) FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.place = a.place + 1 WHERE a.term = 'the' AND b.term = 'is' GROUP BY ALL UNION ALL "
    "SELECT a.doc_id, 3, count(*) FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.place = a.place + 1 JOIN w c ON a.doc_id = c.doc_id AND c.place = a.place + 2 "
    "WHERE a.term = 'the' AND b.term = 'the' AND c.term = 'the' GROUP BY ALL), "
    "idf AS (SELECT unit, ln((SELECT count(*) FROM documents)::double / count(*)) AS idf FROM hit GROUP BY unit) "
    "SELECT doc_id, round(sum(tf * idf), 4) AS score, 'phrase' AS mode FROM hit JOIN idf USING (unit) GROUP BY doc_id)"
)


@registered(
    f"SELECT doc_id, score, 'any' AS mode FROM {search_sql(['for', 'with'])} UNION ALL "
    f"SELECT doc_id, score, 'all' FROM {search_sql(['for', 'with'])} WHERE terms = 2 UNION ALL SELECT * FROM {PHRASES}"
)
def keyword_search(spark, sf_dir):
    index = built(spark, sf_dir)
    keys = search.terms_of("For with &amp;")
    some = index.search("text", keys).withColumn("mode", F.lit("any"))
    every = index.search("text", keys, "AND").withColumn("mode", F.lit("all"))
    phrases = index.search("text", ["(Eriner!)", "the &amp; is", "the 'the' the"]).withColumn("mode", F.lit("phrase"))
    return some.unionByName(every).unionByName(phrases).drop("terms")


@registered(
    f"SELECT term, count(DISTINCT doc_id) AS results FROM {WORDS} WHERE term LIKE 'th%' GROUP BY term ORDER BY results DESC, term LIMIT 10"
)
def keyword_completion(spark, sf_dir):
    index = built(spark, sf_dir)
    index.complete()
    return index.completions("text", "Th")


@registered(
    f"WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {WORDS} GROUP BY ALL), "
    "len AS (SELECT doc_id, length(text) AS length FROM documents), "
    "seed AS (SELECT term, tf AS seed_tf FROM tf WHERE doc_id = 1), "
    "idf AS (SELECT term, ln((SELECT count(*) FROM documents)::double / count(*)) AS idf FROM tf SEMI JOIN seed USING (term) GROUP BY term) "
    "SELECT doc_id, round(sum(tf * seed_tf * idf * idf) / sqrt(length), 4) AS score FROM tf JOIN seed USING (term) "
    "JOIN idf USING (term) JOIN len USING (doc_id) WHERE doc_id <> 1 GROUP BY doc_id, length ORDER BY score DESC, doc_id LIMIT 10"
)
def more_like_this(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return built(spark, sf_dir).more_like_this(docs, "text", 1)


CHANGED = (
    "(SELECT doc_id, CASE WHEN lang = 'de' THEN source || ' with for ' || text ELSE text END AS text FROM documents WHERE lang <> 'fr')"
)
CHANGED_WORDS = f"(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {CHANGED})"


@registered(
    f"WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {CHANGED_WORDS} WHERE term IN ('for', 'with') GROUP BY ALL), "
    f"idf AS (SELECT term, ln((SELECT count(*) FROM {CHANGED})::double / count(*)) AS idf FROM tf GROUP BY term) "
    "SELECT state, doc_id, score FROM (SELECT doc_id, round(sum(tf * idf), 4) AS score FROM tf JOIN idf USING (term) GROUP BY doc_id), "
    "(VALUES ('changed'), ('merged')) AS states(state)"
)
def index_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    index = Index(spark, table_path(spark, "changing-index"), "doc_id", "bigint", {"text": "text"})
    # All but Spanish at first; then Spanish comes in, German is rewritten, French goes.
    index.build(docs.where("lang <> 'es'").select("doc_id", "text"), buckets=16, listed=0)
    rewritten = docs.where("lang = 'de'").select("doc_id", F.concat_ws(" ", "source", F.lit("with for"), "text").alias("text"))
    index.change(docs.where("lang = 'es'").select("doc_id", "text").unionByName(rewritten), docs.where("lang = 'fr'").select("doc_id"))
    changed = index.search("text", ["for", "with"]).withColumn("state", F.lit("changed"))
    index.merge(listed=0)
    merged = index.search("text", ["for", "with"]).withColumn("state", F.lit("merged"))
    return changed.unionByName(merged).drop("terms")


@registered(
    "SELECT doc_id, 'https://data.example.org/dataset/' || doc_id AS url, 'dataset' AS entity_type, "
    "lang || ':' || source AS lang_source FROM documents"
)
def synthetic_index_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    values = {"lang_source": F.concat_ws(":", "lang", "source")}
    return search.with_index_columns(docs, "https://data.example.org/dataset/", "doc_id", "dataset", values).drop("lang", "source")
