"""Chat formatting: layouts are recognised by a hash of their nested field paths and mapped to canonical turns.

A mapping is declared once, with sample records of the layouts it reads. Typed tables are recognised by the paths
of their schema, JSON records one by one by the paths of each record, so a table may mix layouts. Canonical turns
are rows (conversation, turn, role, text); the template marks them and escapes what looks like a mark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, LINE_MARK = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Mapping:
    """Sample records of the layouts, and how a record (variant) becomes an array of (role, text)."""

    name: str
    samples: tuple[str, ...]
    turns: Callable[[Column], Column]


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _listed(path: str, role: str, text: str, roles: dict[str, str] | None = None):
    def turns(record: Column) -> Column:
        items = F.try_variant_get(record, path, "array<variant>")
        named = {key: value for key, value in (roles or {}).items()}

        def one(item: Column) -> Column:
            found = _text(item, f"$.{role}")
            for theirs, ours in named.items():
                found = F.when(_text(item, f"$.{role}") == theirs, F.lit(ours)).otherwise(found)
            return F.struct(found.alias("role"), _text(item, f"$.{text}").alias("text"))

        return F.transform(items, one)

    return turns


def _instruction(record: Column) -> Column:
    asked, given = _text(record, "$.instruction"), _text(record, "$.input")
    question = F.when(given == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), given))
    return F.array(_turn("user", question), _turn("assistant", _text(record, "$.output")))


def _pair(asked: str, answer: str):
    return lambda record: F.array(_turn("user", _text(record, asked)), _turn("assistant", _text(record, answer)))


MAPPINGS = (
    Mapping("messages", ('{"messages":[{"role":"","content":""}]}',), _listed("$.messages", "role", "content")),
    Mapping(
        "conversations",
        ('{"conversations":[{"from":"","value":""}]}',),
        _listed("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    Mapping(
        "instruction",
        ('{"instruction":"","output":""}', '{"instruction":"","input":"","output":""}'),
        _instruction,
    ),
    Mapping("completion", ('{"prompt":"","completion":""}',), _pair("$.prompt", "$.completion")),
    Mapping("response", ('{"prompt":"","response":""}',), _pair("$.prompt", "$.response")),
)


def paths_of(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type: ``a``, ``a.b``, ``a[]``, ``a[].b``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return [at]


def schema_fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def record_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of one record; types of plain values do not count."""
    shape = F.schema_of_variant(record)
    return F.xxhash64(F.regexp_replace(shape, r"(?<=[:<] ?)(?!OBJECT<|ARRAY<)[A-Z]+(\(\d+, ?\d+\))?", "."))


def turns_of_records(records: DataFrame, key: str, column: str, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records (text ``column``) of any mix of layouts.

    A record of unknown layout, or that is no JSON, gives one row with null layout, turn, role and text: nothing is lost in
    silence. Missing and null texts are empty.
    """
    parsed = records.select(F.col(key).alias("conv_id"), F.try_parse_json(F.col(column)).alias("record"))
    parsed = parsed.withColumn("print", F.when(F.col("record").isNotNull(), record_fingerprint(F.col("record"))))
    empty = F.lit(None).cast("array<struct<role:string,text:string>>")
    turns, layout = empty, F.lit(None).cast("string")
    for mapping in mappings:
        known = F.lit(False)
        for sample in mapping.samples:
            json.loads(sample)
            known = known | (F.col("print") == record_fingerprint(F.parse_json(F.lit(sample))))
        turns = F.when(known, mapping.turns(F.col("record"))).otherwise(turns)
        layout = F.when(known, F.lit(mapping.name)).otherwise(layout)
    found = parsed.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return found.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text", "layout")


ROWS_BY_TURN = schema_fingerprint(["conv_id", "turn", "role", "text"])


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a typed table with one row per turn; other layouts are refused.

    Columns beside the four are left behind. A null role or text is empty.
    """
    wanted = rows.select(*[c for c in ("conv_id", "turn", "role", "text") if c in rows.columns])
    if schema_fingerprint(paths_of(wanted.schema)) != ROWS_BY_TURN:
        raise ValueError(f"no mapping for a table with the paths {paths_of(rows.schema)}")
    return wanted.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])


def escaped(text: Column) -> Column:
    """No mark can begin inside: a backslash is doubled and ``<|`` gets one in between."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def formatted(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points, of trained texts).

    Turns are ordered by turn, then role and text, so repeated rows stay and ties have one order. A null conv_id is a
    conversation like any other. One conversation is one value and is made in one task, with a sort that can spill.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE_MARK))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    size = F.length("piece").cast("bigint")
    pieces = pieces.withColumn("place", F.row_number().over(order))
    pieces = pieces.withColumn("before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    span = F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length"))
    listed = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", F.when(F.col("role") == trained_role, span).alias("span")))).alias("all")
    )
    return listed.select(
        "conv_id",
        F.array_join("all.piece", "").alias("formatted"),
        F.filter("all.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def turns_read_back(text: Column) -> Column:
    """Array of (role, text) from a formatted conversation, unescaped."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda part: part != "")

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(START) + 1))
        at = F.instr(inner, "\n")
        role = F.replace(F.substr(inner, F.lit(1), at - 1), F.lit(LINE_MARK), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inner, at + 1)).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
