"""Column functions on hand-worked values."""

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tabulark.functions import dates, hashes, lists, text, values
from tabulark.operators import sorts
from tabulark.plans import dictionary


@pytest.mark.parametrize(
    "seconds, shown, granularity",
    [
        (0, "0 sec", 2),
        (1000, "16 min", 1),
        (1000000, "1 week 4 days 13 hours 46 min", 4),
        (100000000, "3 years 2 months", 5),
        (None, "", 3),
        (1, "1 sec", 2),
        (3605, "1 hour", 2),
    ],
)
def test_interval_text(value, seconds, shown, granularity):
    assert value(lambda x: dates.interval_text(x, granularity), seconds, "bigint") == shown


@pytest.mark.parametrize(
    "size, shown",
    [(0, ""), (None, ""), (1, "1 byte"), (10, "10 bytes"), (1000, "1000 bytes"), (10000, "9.77 KB"), (1024, "1 KB")]
    + [(1536 * 1024, "1.5 MB"), (1048575, "1 MB"), (-2048, "-2 KB"), (10 * 1024**3, "10 GB")],
)
def test_byte_size(value, size, shown):
    assert value(text.byte_size, size, "bigint") == shown


@pytest.mark.parametrize(
    "tokens, shown",
    [("Y-m-d", "2021-01-03"), ("o-W", "2020-53"), ("D, j M y", "Sun, 3 Jan 21"), ("l F n", "Sunday January 1"), ("h:i A", "04:05 PM")],
)
def test_date_tokens(value, tokens, shown):
    assert value(lambda x: dates.formatted(F.col(x).cast("timestamp"), tokens), "2021-01-03 16:05:09") == shown


@pytest.mark.parametrize(
    "given, seconds",
    [
        ("1400000000", 1400000000),
        ("1400000000.12", 1400000000),
        ("2014-05-13 16:53:20", 1400000000),
        ("2014-05-13 18:53:20+02:00", 1400000000),
        ("2014-05-13", 1399939200 + 43200),
        ("foobar", None),
        ("", None),
    ],
)
def test_date_coercion(value, given, seconds):
    assert value(values.to_date_seconds, given) == seconds


@pytest.mark.parametrize(
    "given, boolean, integer, decimal",
    [("12abc", True, 12, 12.0), ("abc", True, 0, 0.0), ("", False, 0, 0.0), ("0", False, 0, 0.0), ("-1.5x", True, -1, -1.5), (" 7", True, 7, 7.0)],
)
def test_text_coercions(value, given, boolean, integer, decimal):
    assert value(values.to_boolean, given) is boolean
    assert value(values.to_integer, given) == integer
    assert value(values.to_decimal, given) == decimal


@pytest.mark.parametrize("given, loose, strict", [(None, "d", "d"), ("", "d", ""), ("0", "d", "0"), ("x", "x", "x")])
def test_default_value(value, given, loose, strict):
    assert value(lambda x: values.default_value(x, "d"), given) == loose
    assert value(lambda x: values.default_value(x, "d", strict=True), given) == strict


@pytest.mark.parametrize(
    "typed, tags",
    [
        ("this, that", ["this", "that"]),
        ('this, "somecompany, llc", "and ""this"" w,o.rks", foo bar', ["this", "somecompany, llc", 'and "this" w,o.rks', "foo bar"]),
        ("a, a, , b", ["a", "b"]),
        ("", []),
    ],
)
def test_tags(value, typed, tags):
    assert value(lists.explode_tags, typed) == tags
    assert value(lambda x: lists.explode_tags(lists.implode_tags(lists.explode_tags(x))), typed) == tags


def test_lists(value):
    assert value(lambda x: lists.split_list(x), "a\r\nb,c\n\nd") == ["a", "b", "c", "d"]
    assert value(lambda x: lists.quoted_list(x), 'a, "b, c" , "d ""e"""') == ["a", "b, c", 'd "e"']
    assert value(lambda x: lists.join_list(F.array(F.lit("a"), F.lit(None), F.lit("b")), "-"), "") == "a--b"
    pairs = lambda x: lists.pairs_to_map(F.array(*[F.struct(F.lit(k).alias("foo"), F.lit(v).alias("bar")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))]), "foo", "bar")
    assert value(pairs, "") == {"a": "3", "b": "2"}


@pytest.mark.parametrize("given, lowered", [("Foo bar", "foo bar"), ("ÄÖÜÀÁ<>»«", "äöüàá<>»«"), ("FOO", "foo")])
def test_lowercase_keeps_accents(value, given, lowered):
    assert value(F.lower, given) == lowered
    assert value(text.folded, "Crème Brûlée") == "creme brulee"


@pytest.mark.parametrize(
    "given, plain",
    [("Łódź", "lodz"), ("Škoda", "skoda"), ("Ñandú", "nandu"), ("e\u0301a\u0308\u0301", "ea"), ("İstanbul", "istanbul"), ("Άλφα Ώ", "αλφα ω"),
     ("Йод", "иод"), ("Đặng Ệ", "dang e"), ("が", "か"), ("straße Æ ﬁ", "straße æ ﬁ"), ("한국 你好 \U0001f600", "한국 你好 \U0001f600"), ("", ""), (None, None)],
)
def test_accents_fold_in_any_script(value, given, plain):
    assert value(text.folded, given) == plain


def test_urls_and_paths(value):
    assert value(text.url_encoded, "http://a.org/b c/é?x=1&y=ü*~#t t") == "http://a.org/b%20c/%C3%A9?x%3D1&y%3D%C3%BC%2A~#t%20t"
    assert value(text.url_encoded, "b c") == "b c"
    assert value(text.url_host, "https://user@a.org:80/x") == "a.org"
    assert value(text.url_host, "a.org") == "a.org"
    assert value(lambda x: text.translated_path(x, F.lit(5)), "/node/3") == "/node/5"
    assert value(lambda x: text.translated_path(x, F.lit(5)), "/node/3/edit") == "/node/3/edit"
    assert value(lambda x: text.file_uri(x, "sites/default/files", "/tmp", F.lit(False)), "sites/default/files/a/b.txt") == "private://a/b.txt"
    assert value(text.identifier_of, "https://a.org/x/y-1") == "y-1"
    assert value(text.identifier_of, "a/b") == "a/b"
    assert value(text.renamed_items, "create blog entries, edit own blog entries now, edit any blog entry") == "create blog content, edit own blog entries now, edit any blog content"
    assert value(lambda x: lists.replace_tokens(x, text.MAIL_TOKENS), None) == ""
    assert value(text.thread_depth, "01.02.03/") == 2


def test_natural_key_orders_numbers(spark):
    names = ["item10", "Item2", "item1", "ITEM 3", "item02b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(sorts.natural_key("n")).collect()
    assert [r.n for r in rows] == ["ITEM 3", "item1", "Item2", "item02b", "item10"]


def test_hashes(spark, value):
    assert value(lambda x: hashes.uuid5("dataset", x), "é-1") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "dataset:é-1"))
    digest = base64.urlsafe_b64encode(hashlib.sha256(b"abc").digest()).decode().rstrip("=")
    assert value(hashes.url_safe_hash, "abc") == digest
    one = spark.sql("SELECT 1 AS a, named_struct('y', 2, 'x', map('q', 1, 'p', 2)) AS b")
    other = spark.sql("SELECT named_struct('x', map('p', 2, 'q', 1), 'y', 2) AS b, 1 AS a")
    changed = spark.sql("SELECT named_struct('x', map('p', 3, 'q', 1), 'y', 2) AS b, 1 AS a")
    found = [df.select(hashes.record_hash(df).alias("h")).first().h for df in (one, other, changed)]
    assert found[0] == found[1] != found[2]
    assert value(hashes.json_hash, '{"b": [1], "a": 2}') == value(hashes.json_hash, '{"a":2,"b":[1]}')


def test_dictionary(spark):
    raw = spark.createDataFrame([("1", "03/02/2021", "x"), ("one", "soon", "y"), ("", None, "z")], "n string, d string, s string")
    fields = [{"name": "n", "title": "Number", "type": "integer"}, {"name": "d", "type": "date", "format": "%m/%d/%Y"}]
    typed = dictionary.apply(raw, fields)
    assert [f.dataType.simpleString() for f in typed.schema.fields[:3]] == ["bigint", "date", "string"]
    assert typed.schema["n"].metadata == {"comment": "Number"}
    rows = typed.collect()
    assert str(rows[0].d) == "2021-03-02" and rows[0]._rejected == []
    assert rows[1]._rejected == ["n", "d"] and rows[2]._rejected == []


def test_zones(value):
    assert value(dates.zone_of_offset, 3600, "int") == "Europe/Paris"
    assert value(dates.zone_of_offset, 17, "int") == "UTC"
    assert value(lambda x: dates.first_valid_zone([x, F.lit("Asia/Tokyo")], ["Asia/Tokyo"], "UTC"), "Mars") == "Asia/Tokyo"
