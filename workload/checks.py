"""Transform hooks, process chains and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.plans import checks, process, rules
from workload import registered, table


@registered("SELECT doc_id, upper(lang) AS lang, 'harvest/' || source AS publisher FROM documents")
def harvest_transform(spark, sf_dir):
    transforms = [
        lambda df: df,
        lambda df: df.withColumn("publisher", F.concat(F.lit("harvest/"), "source")),
        lambda df: df.withColumn("lang", F.upper("lang")).select("doc_id", "lang", "publisher"),
    ]
    return process.transformed(table(spark, sf_dir, "documents"), transforms)


@registered(
    "SELECT c_custkey, lower(c_mktsegment) AS segment, CASE WHEN c_acctbal > 0 THEN cast(round(c_acctbal) AS bigint) END AS balance, "
    "'ok' AS state FROM customer WHERE c_nationkey <> 5 UNION ALL "
    "SELECT c_custkey, NULL, NULL, 'embargo' FROM customer WHERE c_nationkey = 5"
)
def process_chain(spark, sf_dir):
    chains = {
        "segment": ("c_mktsegment", [F.lower, F.trim]),
        "balance": ("c_acctbal", [process.Guard(lambda v: v > 0), F.round, lambda v: v.cast("bigint")]),
        "nation": ("c_nationkey", [process.Guard(lambda v: v != 5, skip_row=True, message="embargo")]),
    }
    done, skipped = process.processed(table(spark, sf_dir, "customer"), chains, keep=["c_custkey"])
    done = done.drop("nation").withColumn("state", F.lit("ok"))
    return done.unionByName(skipped.withColumnRenamed("message", "state"), allowMissingColumns=True)


@registered("SELECT o_orderkey, 'second,last' AS steps FROM orders")
def post_import_processors(spark, sf_dir):
    def step(name):
        return lambda df: df.withColumn("steps", F.concat_ws(",", "steps", F.lit(name)))

    processors = process.Processors()
    processors.add(step("last"), 20)
    processors.add(step("first"), 10)
    processors.add(step("second"), 10)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(None).cast("string").alias("steps"))
    return processors.run(orders)


@registered(
    "SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN json_extract_string(props, '$.k')::int END AS k, "
    "event_type IN ('signup', 'purchase') AS valid FROM events"
)
def schema_validation(spark, sf_dir):
    text = (
        F.when(F.col("event_type") == "error", '{"k": ')
        .when(F.col("event_type") == "view", '{"k": "many"}')
        .when(F.col("event_type") == "click", '{"j": 1}')
        .otherwise(F.col("props"))
    )
    events = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    checked = checks.validated(events, "text", "k int", required=["k"])
    return checked.select("event_id", F.when(F.col("valid"), F.col("record.k")).alias("k"), "valid")


EVENT_RECORD = {
    "type": "object",
    "required": ["contact"],
    "properties": {
        "kind": {"type": "string", "enum": ["signup", "purchase", "click"]},
        "amount": {"type": "number", "minimum": 1, "exclusiveMaximum": 100},
        "contact": {"required": ["email"], "properties": {"email": {"format": "email"}}},
        "marks": {"type": "array", "uniqueItems": True, "items": {"type": "integer", "maximum": 89}},
    },
}


# Some records are cut off, the others break each rule now and then.
@registered(
    "WITH e AS (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events), "
    "f AS (SELECT event_id, CASE WHEN event_type = 'view' AND k = 7 THEN '$:json' ELSE concat_ws(';', "
    "CASE WHEN event_type = 'error' THEN '$.contact:required' END, CASE WHEN event_type IN ('view', 'error') THEN '$.kind:enum' END, "
    "CASE WHEN value < 1 THEN '$.amount:minimum' END, CASE WHEN value >= 100 THEN '$.amount:exclusiveMaximum' END, "
    "CASE WHEN event_type <> 'error' AND user_id % 3 = 0 THEN '$.contact.email:format' END, "
    "CASE WHEN k = user_id % 10 THEN '$.marks:uniqueItems' END, CASE WHEN k > 89 THEN '$.marks[0]:maximum' END) END AS failures FROM e) "
    "SELECT *, failures = '' AS valid FROM f"
)
def schema_rules(spark, sf_dir):
    k, host = F.get_json_object("props", "$.k").cast("int"), F.when(F.col("user_id") % 3 == 0, "").otherwise("@example.org")
    contact = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string"), host).alias("email"))
    members = [
        F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
        F.when(F.col("event_type") != "error", contact).alias("contact"),
        F.array(k.cast("bigint"), F.col("user_id") % 10).alias("marks"),
    ]
    text = F.to_json(F.struct(*members))
    cut_off = (F.col("event_type") == "view") & (k == 7)
    records = table(spark, sf_dir, "events").select("event_id", F.when(cut_off, F.substring(text, 1, 20)).otherwise(text).alias("text"))
    done = rules.checked(records, "text", EVENT_RECORD)
    failing = F.array_join(F.transform("failures", lambda f: F.concat_ws(":", f["path"], f["rule"])), ";")
    return done.select("event_id", failing.alias("failures"), "valid")


@registered(
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'failure' ELSE 'loaded' END AS outcome FROM documents"
)
def required_field(spark, sf_dir):
    level = F.when(F.col("lang") != "fr", "public")
    items = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("doc_id", level.alias("accessLevel"))).alias("item")
    )
    loaded, failed = checks.split(items, ~checks.missing_member("item", "accessLevel"))
    return (
        loaded.withColumn("outcome", F.lit("loaded"))
        .unionByName(failed.withColumn("outcome", F.lit("failure")))
        .drop("item")
    )


@registered(
    "SELECT 'timestamp' AS rule, count(*) FILTER (event_type = 'error') AS violations FROM events UNION ALL "
    "SELECT 'value', count(*) FILTER (value > 50) FROM events"
)
def range_check(spark, sf_dir):
    moved = F.when(F.col("event_type") == "error", 1_000_000_000).otherwise(0)
    events = table(spark, sf_dir, "events").select(
        (F.unix_seconds(F.col("ts").cast("timestamp")) + moved).alias("at"), "value"
    )
    return checks.violations(events, timestamp=checks.in_range("at"), value=F.col("value") <= 50)
