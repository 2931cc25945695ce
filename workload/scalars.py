"""Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.functions import dates, hashes, lists, text, values
from tabulark.operators import search
from tabulark.operators.predicates import phrase
from tabulark.plans import dictionary, process
from workload import registered, table

SECONDS = "cast(epoch(date_trunc('second', ts)) AS bigint)"


def seconds(column: str = "ts"):
    return F.unix_seconds(F.col(column).cast("timestamp"))


@registered(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%y %G-W%V %b %m %-m %B %a %d %A %-d %H:%I:%M:%S %p') AS shown FROM orders"
)
def date_formatting(spark, sf_dir):
    # The W of an ISO week is a literal here, so it goes between two formats.
    shown = dates.formatted("o_orderdate", "Y-y o-")
    rest = dates.formatted("o_orderdate", "W M m n F D d l j H:h:i:s A")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(shown, F.lit("W"), rest).alias("shown"))


@registered(f"SELECT event_id, make_timestamp({SECONDS} * 1000000) AS moment FROM events")
def epoch_to_date(spark, sf_dir):
    moment = dates.from_epoch(seconds()).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", moment.alias("moment"))


@registered("SELECT event_id, ts + INTERVAL 19800 SECOND AS moved, ts AS kept FROM events")
def timezone_offset(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", dates.with_offset("ts", 19800).alias("moved"), dates.with_offset("ts", 0).alias("kept")
    )


@registered(
    " UNION ALL ".join(
        f"SELECT '{name}' AS part, strftime(o_orderdate, '{pattern}') AS argument, min(strftime(o_orderdate, '{label}')) AS label, "
        "count(*) AS n FROM orders GROUP BY 2"
        for name, pattern, label in (
            ("day", "%d", "%-d"),
            ("month", "%m", "%B"),
            ("year", "%Y", "%Y"),
            ("year_month", "%Y%m", "%B %Y"),
            ("week", "%V", "Week %V"),
            ("full_date", "%Y%m%d", "%B %-d, %Y"),
        )
    )
)
def date_part_arguments(spark, sf_dir):
    labels = {"day": "j", "month": "F", "year": "Y", "year_month": "F Y", "full_date": "F j, Y"}
    shown = {name: dates.formatted("o_orderdate", tokens) for name, tokens in labels.items()}
    shown["week"] = F.concat(F.lit("Week "), dates.formatted("o_orderdate", "W"))
    parts = [
        F.struct(F.lit(name).alias("part"), argument.alias("argument"), shown[name].alias("label"))
        for name, argument in dates.date_arguments("o_orderdate").items()
    ]
    # Dates repeat: count the days first, then format each day once.
    days = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    each = days.select(F.explode(F.array(*parts)).alias("entry"), "n").select("entry.*", "n")
    return each.groupBy("part", "argument").agg(F.min("label").alias("label"), F.sum("n").alias("n"))


def interval_sql(seconds: str) -> str:
    """The first unit a duration fills, and the next one if it is not zero."""

    def rest(i: int) -> str:
        return seconds if i == 0 else f"({rest(i - 1)}) % {dates.UNITS[i - 1][0]}"

    def unit(i: int) -> str:
        size, one, many = dates.UNITS[i]
        n = f"(({rest(i)}) // {size})"
        return f"CASE WHEN {n} = 1 THEN '1 {one}' WHEN {n} > 1 THEN {n} || ' {many}' END"

    last = len(dates.UNITS) - 1
    cases = [
        f"WHEN ({rest(i)}) // {dates.UNITS[i][0]} > 0 THEN {unit(i)} || coalesce(' ' || {unit(i + 1)}, '')" for i in range(last)
    ]
    return f"CASE {' '.join(cases)} ELSE coalesce({unit(last)}, '0 sec') END"


@registered(f"SELECT o_orderkey, {interval_sql('cast(floor(o_totalprice * 7) AS bigint) * (o_orderkey + 1)')} AS shown FROM orders")
def interval_text(spark, sf_dir):
    duration = F.floor(F.col("o_totalprice") * 7).cast("bigint") * (F.col("o_orderkey") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.interval_text(duration, 2).alias("shown"))


@registered(
    "WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 0 ELSE n_chars * n_chars END AS size FROM documents) "
    "SELECT doc_id, CASE WHEN size = 0 THEN '' WHEN size = 1 THEN '1 byte' WHEN size < 1024 THEN size || ' bytes' "
    "WHEN round(size / 1024.0::double, 2) < 1024 THEN regexp_replace(printf('%.2f', round(size / 1024.0::double, 2)), '[.]?0+$', '') || ' KB' "
    "WHEN round(size / 1048576.0::double, 2) < 1024 THEN regexp_replace(printf('%.2f', round(size / 1048576.0::double, 2)), '[.]?0+$', '') || ' MB' "
    "ELSE regexp_replace(printf('%.2f', round(size / 1073741824.0::double, 2)), '[.]?0+$', '') || ' GB' END AS shown FROM d"
)
def byte_size_text(spark, sf_dir):
    size = F.when(F.col("lang") == "de", 0).otherwise(F.col("n_chars") * F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_size(size).alias("shown"))


@registered(
    "SELECT c_custkey, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'P') > 0 THEN max(o_orderdate) END AS last_comment "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
)
def timestamp_with_comments(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("at"), F.count_if(F.col("o_orderstatus") == "P").alias("comments")
    )
    people = table(spark, sf_dir, "customer").select("c_custkey").join(per_customer, "c_custkey", "left")
    return people.select("c_custkey", values.shown_with_comments("at", "comments").alias("last_comment"))


@registered(
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS plain, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS custom, "
    "CASE WHEN toxic = 0 THEN 'True' ELSE 'False' END AS negated FROM labels"
)
def boolean_rendering(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        values.yes_no("toxic").alias("plain"),
        values.yes_no("toxic", "bad", "good").alias("custom"),
        values.yes_no("toxic", "True", "False", negate=True).alias("negated"),
    )


@registered(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE o_orderstatus END AS label, "
    "o_orderstatus AS raw FROM orders"
)
def label_mapping(spark, sf_dir):
    labels = {"O": "Open", "F": "Finished"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        values.label_of("o_orderstatus", labels).alias("label"),
        values.label_of("o_orderstatus", labels, raw=True).alias("raw"),
    )


@registered(
    "SELECT event_id, CASE user_id WHEN 1 THEN 'anonymous' WHEN 2 THEN 'authenticated' ELSE cast(user_id AS varchar) END AS role FROM events"
)
def static_code_map(spark, sf_dir):
    role = values.code_map("user_id", {1: "anonymous", 2: "authenticated"})
    return table(spark, sf_dir, "events").select("event_id", role.alias("role"))


@registered(
    "SELECT event_id, props AS raw, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS whole, json_extract_string(props, '$.k') AS k FROM events"
)
def decoded_column(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("props").alias("raw"), values.decoded("props").alias("whole"), values.decoded("props", "k").alias("k")
    )


@registered(
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS strict, "
    "CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') ELSE 'none' END AS lenient, "
    "event_type = 'error' AS rejected FROM events"
)
def nested_path_extract(spark, sf_dir):
    inner = F.when(F.col("event_type") != "error", F.from_json("props", "map<string,int>"))
    wrapped = F.to_json(F.struct(F.struct(inner.alias("settings")).alias("data")))
    events = table(spark, sf_dir, "events").select("event_id", wrapped.alias("doc"))
    path = ["data", "settings", "k"]
    found = events.select("event_id", values.member("doc", path).alias("strict"), values.member("doc", path, "none").alias("lenient"))
    return found.withColumn("rejected", F.col("strict").isNull())


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey || ',' || l_suppkey || ',' || l_returnflag || ',' || l_linestatus || ',' || l_linenumber "
    "AS flat FROM lineitem"
)
def flatten_nested(spark, sf_dir):
    def texts(*names):
        return F.array(*[F.col(n).cast("string") for n in names])

    nested = F.array(
        F.array(texts("l_partkey", "l_suppkey"), texts("l_returnflag")), F.array(texts("l_linestatus"), texts("l_linenumber"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(lists.flatten_levels(nested, 2), ",").alias("flat")
    )


@registered(
    "SELECT c_custkey, c_mktsegment AS segment, c_name AS name, 3 AS entries FROM customer"
)
def pairs_to_map(spark, sf_dir):
    def pair(key, value):
        return F.struct(F.lit(key).alias("k"), value.alias("v"))

    pairs = F.array(
        pair("segment", F.lit("old")),
        pair("name", F.col("c_name")),
        pair("segment", F.col("c_mktsegment")),
        pair("nation", F.col("c_nationkey").cast("string")),
    )
    built = table(spark, sf_dir, "customer").select("c_custkey", lists.pairs_to_map(pairs, "k", "v").alias("m"))
    return built.select("c_custkey", F.col("m.segment").alias("segment"), F.col("m.name").alias("name"), F.size("m").alias("entries"))


@registered(
    "SELECT c_custkey, c_mktsegment || '/' || CASE WHEN c_nationkey < 12 THEN cast(c_nationkey AS varchar) ELSE '' END || '/' || c_name AS joined FROM customer"
)
def concat_with_delimiter(spark, sf_dir):
    nation = F.when(F.col("c_nationkey") < 12, F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", lists.join_list(F.array("c_mktsegment", nation, "c_name"), "/").alias("joined")
    )


FALSY = "CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' WHEN 'click' THEN '0' ELSE event_type END"


@registered(
    f"SELECT event_id, coalesce({FALSY}, 'none') AS strict, CASE WHEN {FALSY} IS NULL OR {FALSY} IN ('', '0') THEN 'none' "
    f"ELSE {FALSY} END AS loose FROM events"
)
def default_value(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "0").when(
        F.col("event_type") != "error", F.col("event_type")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        values.default_value(kind, "none", strict=True).alias("strict"),
        values.default_value(kind, "none").alias("loose"),
    )


@registered(
    "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN 'seen' END, CASE WHEN event_type = 'click' THEN 'hit' END, 'other') AS first FROM events"
)
def null_coalesce(spark, sf_dir):
    seen = F.when(F.col("event_type") == "view", "seen")
    hit = F.when(F.col("event_type") == "click", "hit")
    return table(spark, sf_dir, "events").select("event_id", values.null_coalesce(seen, hit, default="other").alias("first"))


@registered(
    "SELECT event_id, 'kept' AS kind, NULL AS message FROM events WHERE event_type <> 'error' UNION ALL "
    "SELECT event_id, 'skipped', 'value is not set' FROM events WHERE event_type = 'error'"
)
def skip_row_when_unset(spark, sf_dir):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    kept, skipped = process.skip_unset(rows, "value")
    kept = kept.select("event_id", F.lit("kept").alias("kind"), F.lit(None).cast("string").alias("message"))
    return kept.unionByName(skipped.select("event_id", F.lit("skipped").alias("kind"), "message"))


SPACED = "replace(url, '/en', '/en é')"
URL = "'^([^:/?#]+)://([^/?#]*)([^?#]*)([?]([^#]*))?(#(.*))?$'"


@registered(
    f"WITH p AS (SELECT page_id, {SPACED} AS u FROM pages) "
    f"SELECT page_id, regexp_extract(u, {URL}, 1) || '://' || regexp_extract(u, {URL}, 2) || "
    f"replace(url_encode(regexp_extract(u, {URL}, 3)), '%2F', '/') || "
    f"CASE WHEN regexp_extract(u, {URL}, 5) <> '' THEN '?' || replace(url_encode(regexp_extract(u, {URL}, 5)), '%26', '&') ELSE '' END || "
    f"CASE WHEN regexp_extract(u, {URL}, 7) <> '' THEN '#' || url_encode(regexp_extract(u, {URL}, 7)) ELSE '' END AS encoded FROM p"
)
def url_encode(spark, sf_dir):
    spaced = F.replace("url", F.lit("/en"), F.lit("/en é"))
    return table(spark, sf_dir, "pages").select("page_id", text.url_encoded(spaced).alias("encoded"))


@registered("SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages")
def url_host(spark, sf_dir):
    bare = F.when(F.col("url").startswith("http://"), F.substring("url", 8, 10_000_000)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.url_host(bare).alias("host"))


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN '/user/' || l_partkey "
    "WHEN l_linestatus = 'O' THEN '/node/' || l_suppkey ELSE '/node/' || l_partkey END AS path FROM lineitem"
)
def path_rewrite(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "/user/").otherwise("/node/")
    path = F.concat(kind, F.col("l_partkey").cast("string"))
    new_id = F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.translated_path(path, new_id).alias("path")
    )


@registered(
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'temporary://' || p_name WHEN p_size < 30 THEN 'public://a/' || p_name "
    "ELSE 'private://a/' || p_name END AS uri FROM part"
)
def file_uri(spark, sf_dir):
    path = F.concat(F.when(F.col("p_size") < 10, "/tmp/").otherwise("sites/default/files/a/"), "p_name")
    uri = text.file_uri(path, "sites/default/files", "/tmp", F.col("p_size") < 30)
    return table(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"))


@registered("SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS name FROM pages")
def base_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.base_name("url").alias("name"))


@registered(
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'create blog content, edit any forum content' "
    "WHEN 'click' THEN 'create blog content, pre-create blog entries' ELSE 'create blog content, ' || event_type END AS permissions FROM events"
)
def regex_replace_chain(spark, sf_dir):
    more = (
        F.when(F.col("event_type") == "view", "edit any forum topic")
        .when(F.col("event_type") == "click", "pre-create blog entries")
        .otherwise(F.col("event_type"))
    )
    listed = F.concat_ws(", ", F.lit("create blog entries"), more)
    return table(spark, sf_dir, "events").select("event_id", text.renamed_items(listed).alias("permissions"))


@registered(
    "SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE 'Dear [user:name], [site:name] on [date:medium]: ' || text END AS mail FROM conversations"
)
def token_substitution(spark, sf_dir):
    raw = F.when(F.col("role") != "system", F.concat(F.lit("Dear !username, !site on !date: !password"), "text"))
    mail = lists.replace_tokens(raw, text.MAIL_TOKENS)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mail.alias("mail"))


@registered(
    "SELECT event_id, event_type AS permission FROM events WHERE event_type <> 'signup' UNION ALL "
    "SELECT event_id, unnest(['administer nodes', 'access content overview']) FROM events WHERE event_type = 'signup'"
)
def one_value_to_many(spark, sf_dir):
    held = F.when(F.col("event_type") == "signup", "administer nodes").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select("event_id", held.alias("permission"))
    return process.expand(events, "permission", {"administer nodes": ["administer nodes", "access content overview"]})


@registered(
    "SELECT doc_id, generate_subscripts(pieces, 1) AS place, unnest(pieces) AS piece "
    "FROM (SELECT doc_id, string_split_regex(text, '[\\r\\n,]+') AS pieces FROM documents)"
)
def split_by_delimiters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", F.posexplode(lists.split_list("text")).alias("place", "piece"))
    return pieces.withColumn("place", (F.col("place") + 1).cast("bigint"))


@registered(
    "SELECT c_custkey, c_name || '|a, b|' || c_mktsegment || '|3' AS cells, 4 AS n FROM customer"
)
def comma_list_with_quotes(spark, sf_dir):
    record = F.concat("c_name", F.lit(' , "a, b",  '), "c_mktsegment", F.lit(" ,3"))
    cells = table(spark, sf_dir, "customer").select("c_custkey", lists.quoted_list(record).alias("cells"))
    return cells.select("c_custkey", F.array_join("cells", "|").alias("cells"), F.size("cells").alias("n"))


@registered(
    "SELECT p_partkey, p_name || '|' || p_type || ', inc|the \"best\"' AS exploded, "
    "p_name || ', \"' || p_type || ', inc\", \"the \"\"best\"\"\"' AS imploded FROM part"
)
def tag_lists(spark, sf_dir):
    typed = F.concat("p_name", F.lit(', "'), "p_type", F.lit(', inc", , "the ""best""", '), "p_name")
    tags = table(spark, sf_dir, "part").select("p_partkey", lists.explode_tags(typed).alias("tags"))
    return tags.select(
        "p_partkey", F.array_join("tags", "|").alias("exploded"), lists.implode_tags("tags").alias("imploded")
    )


@registered(
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'a,0' WHEN 'view' THEN 'a,0' ELSE 'a,' || event_type || ',0' END AS kept FROM events"
)
def remove_empty_strings(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    listed = lists.without_empty(F.array(F.lit("a"), kind, F.lit(""), F.lit("0")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(listed, ",").alias("kept"))


OFFSETS = "CASE WHEN c_nationkey = 24 THEN 12345 ELSE (c_nationkey - 11) * 3600 END"


@registered(
    f"SELECT c_custkey, {OFFSETS} AS seconds, CASE {OFFSETS} "
    "WHEN -39600 THEN 'Pacific/Apia' WHEN -36000 THEN 'Pacific/Honolulu' WHEN -32400 THEN 'America/Anchorage' "
    "WHEN -28800 THEN 'America/Los_Angeles' WHEN -25200 THEN 'America/Denver' WHEN -21600 THEN 'America/Chicago' "
    "WHEN -18000 THEN 'America/New_York' WHEN -14400 THEN 'America/Halifax' WHEN -10800 THEN 'America/Sao_Paulo' "
    "WHEN -3600 THEN 'Atlantic/Azores' WHEN 0 THEN 'Europe/London' WHEN 3600 THEN 'Europe/Paris' "
    "WHEN 7200 THEN 'Europe/Helsinki' WHEN 10800 THEN 'Europe/Moscow' WHEN 14400 THEN 'Asia/Dubai' "
    "WHEN 18000 THEN 'Asia/Karachi' WHEN 19800 THEN 'Asia/Kolkata' WHEN 20700 THEN 'Asia/Katmandu' "
    "WHEN 21600 THEN 'Asia/Novosibirsk' WHEN 25200 THEN 'Asia/Krasnoyarsk' WHEN 28800 THEN 'Asia/Shanghai' "
    "WHEN 32400 THEN 'Asia/Tokyo' WHEN 36000 THEN 'Australia/Melbourne' WHEN 43200 THEN 'Pacific/Auckland'"
    + " ELSE 'UTC' END AS zone FROM customer"
)
def timezone_from_offset(spark, sf_dir):
    offset = F.when(F.col("c_nationkey") == 24, 12345).otherwise((F.col("c_nationkey") - 11) * 3600)
    people = table(spark, sf_dir, "customer").select("c_custkey", offset.alias("seconds"))
    return people.withColumn("zone", dates.zone_of_offset("seconds"))


@registered(
    "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'Europe/Paris' WHEN c_mktsegment = 'BUILDING' THEN 'Asia/Tokyo' ELSE 'UTC' END AS zone FROM customer"
)
def timezone_fallback(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 5, "Europe/Paris").when(F.col("c_nationkey") < 9, "Mars/Base").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Asia/Tokyo").otherwise("nowhere").alias("event"),
    )
    zone = dates.first_valid_zone(["name", "event"], list(dates.ZONES_BY_OFFSET.values()), "UTC")
    return people.select("c_custkey", zone.alias("zone"))


@registered(
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'en' WHEN lang = 'de' THEN 'es' WHEN lang = 'es' THEN 'es' ELSE lang END AS langcode FROM documents"
)
def language_fallback(spark, sf_dir):
    code = F.when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    shown = values.language_or_default(code, ["en", "es"], "es", to_site_default=False)
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("langcode"))


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_partkey END AS part_rank, 'none' AS flag_rank FROM lineitem"
)
def prefixed_columns_to_map(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("node_rank_part"),
        F.col("l_returnflag").alias("node_rank_flag"),
    )
    ranks = ranked.select(*ranked.columns[:3], lists.prefixed_columns(ranked.columns, "node_rank_").alias("ranks"))
    return ranks.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.try_element_at("ranks", F.lit("part")).cast("bigint").alias("part_rank"),
        F.coalesce(F.try_element_at("ranks", F.lit("flag")), F.lit("none")).alias("flag_rank"),
    )


@registered("SELECT doc_id, lower(text) AS text FROM documents")
def lowercase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))


@registered(f"SELECT doc_id, translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}') AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.folded("text").alias("folded"))


# Signs from several scripts, with accents as part of the sign or behind it.
SIGNS = ["Łódź", "Škoda", "mañana", "Đặng", "İstanbul", "e\u0301te\u0301", "Άλφα", "Йод", "Øre", "ǖ"]


@registered(
    "WITH named AS (SELECT c_custkey, c_name || ' ' || (["
    + ", ".join(f"'{sign}'" for sign in SIGNS)
    + f"])[c_custkey % {len(SIGNS)} + 1] AS name FROM customer) "
    f"SELECT translate(lower(strip_accents(lower(name))), '{text.STROKED}', '{text.PLAIN_STROKED}') AS folded, count(*) AS n FROM named GROUP BY ALL"
)
def accent_fold_key(spark, sf_dir):
    signs = F.array(*[F.lit(sign) for sign in SIGNS])
    sign = F.get(signs, (F.col("c_custkey") % len(SIGNS)).cast("int"))
    named = table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_name", sign).alias("name"))
    return named.groupBy(text.folded("name").alias("folded")).agg(F.count(F.lit(1)).alias("n"))


@registered(
    "SELECT doc_id, regexp_replace(text, '[" + "".join(rf"\p{{{c}}}" for c in text.CHARACTER_CLASSES) + "]', '', 'g') AS stripped FROM documents"
)
def character_class_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.without_classes("text").alias("stripped"))


CODED = (
    "CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN json_extract_string(props, '$.k') || '.75x' "
    "WHEN 'click' THEN strftime(ts, '%Y-%m-%d') WHEN 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE json_extract_string(props, '$.k') END"
)


@registered(
    f"WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, ts, {CODED} AS raw FROM events) SELECT event_id, raw AS text, "
    "raw NOT IN ('', '0') AS as_boolean, cast(CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('click', 'signup') THEN 2024 ELSE k::int END AS bigint) AS as_integer, "
    "cast(CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('click', 'signup') THEN 2024 WHEN event_type = 'view' THEN k::int + 0.75 ELSE k::int END AS double) AS as_decimal, "
    "CASE event_type WHEN 'click' THEN cast(epoch(date_trunc('day', ts)) + 43200 AS bigint) WHEN 'signup' THEN cast(epoch(date_trunc('second', ts)) AS bigint) "
    "WHEN 'purchase' THEN k::bigint END AS as_date FROM e"
)
def type_coercions(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "view", F.concat(k, F.lit(".75x")))
        .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(k)
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("text")).withColumns(
        {
            "as_boolean": values.to_boolean("text"),
            "as_integer": values.to_integer("text"),
            "as_decimal": values.to_decimal("text"),
            "as_date": values.to_date_seconds("text"),
        }
    )


@registered(
    "SELECT o_orderkey, cast(o_totalprice AS decimal(18,2)) AS o_totalprice, cast(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS date) AS o_orderdate, "
    "o_orderstatus = 'P' AS rejected FROM orders"
)
def dictionary_type_cast(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("o_orderdate"),
    )
    fields = [
        {"name": "o_orderkey", "title": "Order", "type": "integer"},
        {"name": "o_totalprice", "title": "Price", "type": "number", "precision": 18, "scale": 2},
        {"name": "o_orderdate", "title": "Ordered on", "type": "date", "format": "%d/%m/%Y"},
    ]
    typed = dictionary.apply(raw, fields)
    return typed.select("o_orderkey", "o_totalprice", "o_orderdate", (F.size("_rejected") > 0).alias("rejected"))


@registered(
    "SELECT c_custkey, sha256('{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"place\":{\"nation\":' || c_nationkey || "
    "',\"segment\":\"' || c_mktsegment || '\"}}') AS hash, true AS same FROM customer"
)
def canonical_record_hash(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    one = people.select(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("place"), F.col("c_custkey").alias("key"))
    other = F.to_json(F.struct(F.struct(F.col("place.segment"), F.col("place.nation")).alias("place"), "key", "name"))
    return one.select(F.col("key").alias("c_custkey"), hashes.record_hash(one).alias("hash"), (hashes.record_hash(one) == hashes.json_hash(other)).alias("same"))


@registered("SELECT c_custkey, rtrim(translate(to_base64(unhex(sha256(c_name))), '+/', '-_'), '=') AS hash FROM customer")
def url_safe_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashes.url_safe_hash("c_name").alias("hash"))


@registered(
    "WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('dataset:' || c_name)) AS h FROM customer) "
    "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
    "translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h"
)
def name_based_uuid(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashes.uuid5("dataset", "c_name").alias("uuid"))


@registered(
    "SELECT page_id, CASE WHEN url LIKE 'https%' THEN string_split(url, '/')[-1] ELSE 'id/' || page_id END AS identifier FROM pages"
)
def last_url_segment(spark, sf_dir):
    given = F.when(F.col("url").startswith("https"), F.col("url")).otherwise(F.concat(F.lit("id/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", text.identifier_of(given).alias("identifier"))


@registered("SELECT conv_id, turn, turn AS depth FROM (SELECT conv_id, cast(turn AS integer) AS turn FROM conversations)")
def thread_depth(spark, sf_dir):
    thread = F.concat(F.lit("1"), F.repeat(F.lit(".01"), F.col("turn").cast("int")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), thread.alias("thread"))
    return turns.select("conv_id", "turn", text.thread_depth("thread").alias("depth"))


@registered(
    "SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])with[^\\p{L}\\p{N}]+the($|[^\\p{L}\\p{N}])') AS as_phrase, "
    "contains(text, 'with the') AS as_given FROM documents"
)
def search_key_parsing(spark, sf_dir):
    key = search.terms_of("with the", "direct")[0]
    whole = search.terms_of("With the", "phrase")[0]
    return table(spark, sf_dir, "documents").select(
        "doc_id", phrase("text", whole).alias("as_phrase"), F.col("text").contains(key).alias("as_given")
    )
