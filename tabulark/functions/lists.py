"""Lists and maps inside a row: tags, splits, flattening, pairs to maps."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulark.operators.predicates import is_numeric_text


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def encode_tag(tag: str | Column) -> Column:
    """Quote a tag that holds a comma or a quote, doubling its quotes."""
    tag = _column(tag)
    quoted = F.concat(F.lit('"'), F.replace(tag, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(tag.contains(",") | tag.contains('"'), quoted).otherwise(tag)


def explode_tags(text: str | Column) -> Column:
    """Tags of a comma list: quotes removed, doubled quotes single, repeats and empties dropped."""
    found = F.regexp_extract_all(_column(text), F.lit(r'(?:^|, *)("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'), 1)

    def unquoted(tag: Column) -> Column:
        inner = F.regexp_replace(tag, r'(?s)^"(.*)"$', "$1")
        return F.trim(F.replace(inner, F.lit('""'), F.lit('"')))

    return F.filter(F.transform(F.array_distinct(found), unquoted), lambda tag: tag != "")


def implode_tags(tags: str | Column) -> Column:
    return F.array_join(F.transform(_column(tags), encode_tag), ", ")


def without_empty(values: str | Column) -> Column:
    """Items whose text is not empty; NULL counts as empty."""
    return F.filter(_column(values), lambda v: v.isNotNull() & (v != ""))


def split_list(text: str | Column) -> Column:
    """Pieces between runs of line breaks and commas."""
    return F.split(_column(text), r"[\r\n,]+")


def quoted_list(text: str | Column) -> Column:
    """Cells of one CSV record, trimmed; commas inside quotes do not split."""
    cells = F.regexp_extract_all(_column(text), F.lit(r'(?:^|,)\s*("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), 1)

    def clean(cell: Column) -> Column:
        bare = F.regexp_replace(F.trim(cell), r'(?s)^"(.*)"$', "$1")
        return F.trim(F.replace(bare, F.lit('""'), F.lit('"')))

    return F.transform(cells, clean)


def join_list(values: str | Column, delimiter: str = "") -> Column:
    """Items joined in order; a NULL item leaves an empty place."""
    return F.array_join(_column(values), delimiter, "")


def flatten_levels(values: str | Column, levels: int) -> Column:
    """Leaves of arrays nested ``levels`` deep below the top."""
    return functools.reduce(lambda v, _: F.flatten(v), range(levels), _column(values))


def pairs_to_map(pairs: str | Column, key: str, value: str) -> Column:
    """A map from an array of structs; a later pair replaces an earlier one of the same key."""
    pairs = _column(pairs)
    last = F.filter(
        pairs,
        lambda pair, i: ~F.exists(
            F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda other: other[key] == pair[key]
        ),
    )
    return F.map_from_entries(F.transform(last, lambda pair: F.struct(pair[key], pair[value])))


def prefixed_columns(columns: Sequence[str], prefix: str) -> Column:
    """Numeric columns of a prefix as a map without it; NULL when there are none."""
    named = [c for c in columns if c.startswith(prefix)]
    entries = [item for c in named for item in (F.lit(c[len(prefix) :]), F.col(c).cast("string"))]
    numeric = F.map_filter(F.create_map(*entries), lambda _, v: is_numeric_text(v))
    return F.when(F.size(numeric) > 0, numeric)


def replace_tokens(text: str | Column, tokens: Mapping[str, str]) -> Column:
    """Replace fixed tokens one after the other; NULL text becomes empty."""
    start = F.coalesce(_column(text), F.lit(""))
    return functools.reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), tokens.items(), start)
