"""Text: case and accents, character classes, paths and URLs, fixed replacements."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"

# Lower-case letters with a stroke, or without a dot, that Unicode does not take apart, and their plain forms.
STROKED = "øłđħŧı"
PLAIN_STROKED = "oldhti"

# The Unicode classes an index may ignore.
CHARACTER_CLASSES = ["Cc", "Cf", "Co", "Me", "Pc", "Pd", "Pe", "Pf", "Pi", "Ps", "Sc", "Sk", "Zl", "Zp", "Zs"]

# Renamed permissions.
RENAMED_PERMISSIONS = {
    "create blog entries": "create blog content",
    "edit own blog entries": "edit own blog content",
    "edit any blog entry": "edit any blog content",
    "delete own blog entries": "delete own blog content",
    "delete any blog entry": "delete any blog content",
    "create forum topics": "create forum content",
    "delete any forum topic": "delete any forum content",
    "delete own forum topics": "delete own forum content",
    "edit any forum topic": "edit any forum content",
    "edit own forum topics": "edit own forum content",
}

# Mail tokens and their replacements.
MAIL_TOKENS = {
    "!site": "[site:name]",
    "!username": "[user:name]",
    "!mailto": "[user:mail]",
    "!login_uri": "[site:login-url]",
    "!uri_brief": "[site:url-brief]",
    "!edit_uri": "[user:edit-url]",
    "!login_url": "[user:one-time-login-url]",
    "!uri": "[site:url]",
    "!date": "[date:medium]",
    "!password": "",
}

# Scheme, authority, path, query and fragment of a URL.
_URL = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?([^#]*))?(#(.*))?$"


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


@functools.cache
def _folding() -> tuple[str, str]:
    """What ``translate`` takes: every lower-case letter that is a letter and accents, and its letter; then the accents, which go.

    By the decompositions of Unicode's basic plane, whatever the script.
    """
    letters, plain, accents = list(STROKED), list(PLAIN_STROKED), []
    for code in range(0x80, 0x10000):
        sign = chr(code)
        if 0x300 <= code < 0x370:
            accents.append(sign)
            continue
        base, *marks = unicodedata.normalize("NFD", sign)
        letter = unicodedata.category(sign)[0] == "L" and sign == sign.lower()
        if letter and marks and all(unicodedata.category(m) == "Mn" for m in marks):
            letters.append(sign)
            plain.append(base)
    return "".join(letters + accents), "".join(plain)


def folded(text: str | Column) -> Column:
    """Lower case without accents, for letters of any script, whether an accent is part of the sign or follows it.

    Letters with a stroke lose it (``ł``, ``ø``, ``đ``); ligatures and ``ß`` stay.
    """
    return F.translate(F.lower(_column(text)), *_folding())


def without_classes(text: str | Column, classes: Sequence[str] = tuple(CHARACTER_CLASSES)) -> Column:
    unknown = set(classes) - set(CHARACTER_CLASSES)
    if unknown:
        raise ValueError(f"unknown character classes {sorted(unknown)}")
    return F.regexp_replace(_column(text), "[" + "".join(rf"\p{{{c}}}" for c in classes) + "]", "")


def byte_size(size: str | Column) -> Column:
    """A size in bytes or 1024-based units with two decimals; empty for none."""
    number = _column(size).cast("bigint")
    scaled = F.abs(number).cast("double")
    units = ["KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
    text = None
    for power in range(len(units), 0, -1):
        rounded = F.round(scaled / F.lit(float(1024**power)), 2)
        digits = F.regexp_replace((F.signum(number) * rounded).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
        shown = F.concat(digits, F.lit(" " + units[power - 1]))
        # A unit serves while its rounded number stays below 1024.
        text = shown if text is None else F.when(rounded < 1024, shown).otherwise(text)
    small = F.when(F.abs(number) == 1, F.concat(number.cast("string"), F.lit(" byte"))).otherwise(
        F.concat(number.cast("string"), F.lit(" bytes"))
    )
    whole = F.when(F.abs(number) < 1024, small).otherwise(text)
    return F.when(number.isNull() | (number == 0), F.lit("")).otherwise(whole)


def renamed_items(text: str | Column, names: Mapping[str, str] = RENAMED_PERMISSIONS) -> Column:
    """Rename whole items of a list separated by comma and blank."""
    return functools.reduce(
        lambda t, pair: F.regexp_replace(t, rf"(?<=^|, ){re.escape(pair[0])}(?=,|$)", pair[1]),
        names.items(),
        _column(text),
    )


def raw_url_encode(text: Column) -> Column:
    """Percent-encode all but letters, digits and ``-_.~``."""
    form = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(found), F.lit(wanted))
    return form


def url_encoded(url: str | Column) -> Column:
    """Encode path, query and fragment of a full URL; other text stays as it is."""
    column = _column(url)

    def part(group: int) -> Column:
        return F.regexp_extract(column, _URL, group)

    path = F.replace(raw_url_encode(part(3)), F.lit("%2F"), F.lit("/"))
    query = F.replace(raw_url_encode(part(5)), F.lit("%26"), F.lit("&"))
    fragment = raw_url_encode(part(7))
    whole = F.concat(
        part(1),
        F.lit("://"),
        part(2),
        path,
        F.when(part(5) != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(part(7) != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(column.rlike(_URL), whole).otherwise(column)


def url_host(domain: str | Column) -> Column:
    """The host of a domain given with or without protocol; no port, path or user."""
    bare = F.regexp_replace(_column(domain), "https?://", "")
    return F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)


def translated_path(path: str | Column, new_id: str | Column) -> Column:
    """``/node/N`` with the new id where there is one; other paths stay."""
    path, new_id = _column(path), _column(new_id)
    hit = path.rlike(r"^/node/\d+$") & new_id.isNotNull()
    return F.when(hit, F.concat(F.lit("/node/"), new_id.cast("string"))).otherwise(F.coalesce(path, F.lit("")))


def file_uri(path: str | Column, files: str, temporary: str, is_public: Column) -> Column:
    """A stored path as a stream URI: temporary, public or private."""
    path = _column(path)

    def after(prefix: str) -> Column:
        return F.regexp_replace(F.regexp_replace(path, "^" + re.escape(prefix), ""), "^/+", "")

    scheme = F.when(is_public, "public://").otherwise("private://")
    return F.when(path.startswith(temporary), F.concat(F.lit("temporary://"), after(temporary))).otherwise(
        F.concat(scheme, after(files))
    )


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(_column(path), "/+$", ""), "/"), -1)


def identifier_of(identifier: str | Column) -> Column:
    """The last path segment of an identifier that is a URL; other identifiers stay."""
    column = _column(identifier)
    is_url = column.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+[^\s]*$")
    return F.when(is_url, F.element_at(F.split(column, "/"), -1)).otherwise(column)


def thread_depth(thread: str | Column) -> Column:
    return F.size(F.split(_column(thread), r"\.")) - 1
