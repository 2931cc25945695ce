"""Secret scans: an incremental ledger of text blobs, of which each is scanned once by each version of each rule.

Every version of every path is addressed by the SHA-256 of its text (its blob), so copies and reverted texts are one blob.
The ledger is a Parquet table of what has been scanned: a blob, the rule versions it was scanned by, and the
spans they found. A scan drops the copies of a blob inside each task, moves one text of each blob
to its ledger entries, runs only the rules that the entries lack, and appends. Findings go back to all paths by the
blob alone; no text takes part in that join. A rule's version is a digest of the rule itself, so a changed rule scans anew.

DataFrame functions only; no Python runs beside the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = {"blob": "binary", "rules": "array<string>", "found": "array<struct<rule: string, start: bigint, end: bigint>>"}
# Hits of one text and rule whose places are summed up together.
STRIDE = 256


@dataclass(frozen=True)
class Rule:
    """Matches of a Java pattern, leftmost and non-overlapping, whose group ``judged`` has ``least`` characters or more.

    Shorter matches are dropped, but what they cover is not searched again. The pattern must not match an empty text.
    """

    kind: str
    pattern: str
    judged: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """The kind and a digest of everything that decides what the rule finds."""
        digest = hashlib.sha256(repr((self.pattern, self.judged, self.least)).encode()).hexdigest()
        return f"{self.kind}@{digest[:16]}"


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of hex digits is matched whole, so shorter runs need not be matched to be dropped.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge", r"(gh[opsur]_|glpat-|xox[abprs]-)([A-Za-z0-9_-]+)", 2, 20),
    Rule("login", r"""[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D/@:"'<>]{1,64}:([^\x20\x09-\x0D/@:"'<>]{1,128})@""", 1, 4),
)


def blob_of(text: Column) -> Column:
    """The address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _running(steps: Column) -> Column:
    """Sums of an array of longs up to each place, in strides, so that very long arrays stay far from quadratic."""

    def added(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def stride(k: Column) -> Column:
        base = F.struct(added(F.slice(steps, 1, k * STRIDE)).alias("base"), F.slice(steps, k * STRIDE + 1, STRIDE).alias("own"))
        return F.flatten(
            F.transform(
                F.array(base),
                lambda s: F.transform(s["own"], lambda _, j: s["base"] + added(F.slice(s["own"], 1, j + 1))),
            )
        )

    strides = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRIDE).cast("int"))
    return F.when(F.size(steps) > 0, F.flatten(F.transform(strides, stride))).otherwise(F.array().cast("array<bigint>"))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.length(part).cast("bigint"))


def _spans(rule: Rule, k: int) -> Column:
    """The hits of one rule that are long enough, from their lengths, ends and judged lengths."""
    each = F.transform(
        f"ends{k}",
        lambda end, i: F.struct((end - F.get(f"long{k}", i)).alias("start"), end.alias("end"), F.get(f"judged{k}", i).alias("size")),
    )
    return F.transform(
        F.filter(each, lambda s: s["size"] >= rule.least),
        lambda s: F.struct(F.lit(rule.version).alias("rule"), s["start"].alias("start"), s["end"].alias("end")),
    )


def _scanned(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of (blob, text, rules) as ledger entries; a rule that a row does not list is not run on its text.

    The hits and the stretches between them alternate, so their lengths add up to the hits' places. Stretches are only
    cut from texts that have a hit.
    """
    text, none, no_sizes = F.col("text"), F.array().cast("array<string>"), F.array().cast("array<bigint>")
    hits, sizes, ends, spans = [], [], [], []
    for k, rule in enumerate(rules):
        pattern, own = F.lit(rule.pattern), F.col(f"hits{k}")
        hits.append(F.when(F.array_contains("rules", rule.version), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none).alias(f"hits{k}"))
        between = F.split(text, rule.pattern, -1)
        judged = F.regexp_extract_all(text, pattern, F.lit(rule.judged)) if rule.judged else own
        for name, parts in (("between", between), ("long", own), ("judged", judged)):
            sizes.append(F.when(F.size(own) > 0, _lengths(parts)).otherwise(no_sizes).alias(f"{name}{k}"))
        # The last stretch has no hit behind it.
        ends.append(_running(F.zip_with(f"long{k}", F.slice(f"between{k}", 1, F.size(f"long{k}")), lambda a, b: a + b)).alias(f"ends{k}"))
        spans.append(_spans(rule, k))
    found = texts.select("blob", "rules", "text", *hits).select("blob", "rules", *sizes)
    found = found.select("blob", "rules", *[f"{name}{k}" for k in range(len(rules)) for name in ("long", "judged")], *ends)
    return found.select("blob", "rules", F.concat(*spans).alias("found"))


def opened(spark: SparkSession, path: str) -> str:
    """Start an empty ledger at ``path``."""
    spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in ENTRY.items()]).write.parquet(path)
    return path


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Everything the ledger holds: a blob, the rule versions of one scan of it, and their spans."""
    return spark.read.schema(", ".join(f"{name} {kind}" for name, kind in ENTRY.items())).parquet(path)


def unseen(versions: DataFrame, rules: Sequence[Rule], ledger: DataFrame) -> DataFrame:
    """One row per blob that some of the rules have not scanned: (blob, text, rules), ``rules`` being those."""
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
    # A pair is scanned once, so a blob has no more entries than there have been rule versions.
    seen = ledger.groupBy(F.col("blob").alias("seen_blob")).agg(F.flatten(F.collect_list("rules")).alias("seen"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    left = F.array_except(wanted, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    joined = texts.join(seen, F.col("blob") == F.col("seen_blob"), "left").select("blob", "text", left.alias("rules"))
    return joined.where(F.size("rules") > 0)


def scan(versions: DataFrame, rules: Sequence[Rule], path: str) -> None:
    """Scan the blobs of ``versions`` (text) by the rules that have not seen them, and append the entries to the ledger.

    A pair of a blob and a rule version is scanned once, however many paths, versions or calls hold it. A
    call that fails appends nothing and may be made again; two calls on one ledger must not overlap in time.
    """
    ledger = entries(versions.sparkSession, path)
    _scanned(unseen(versions, rules, ledger), rules).write.mode("append").parquet(path)


def findings(versions: DataFrame, rules: Sequence[Rule], path: str, paths: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``versions`` its columns ``paths``, its ``blob``, and ``found``: the ledger's spans under these rules.

    ``found`` is an array of (kind, start, end) by start, then kind as the rules are listed; places are in characters
    (code points), the end is exclusive. Rules of one kind share it. Spans of other rule versions in the ledger are left out.
    Null texts are empty texts, which have no spans; null paths, repeated rows and texts of any length keep their
    rows; no rows give none. Columns of ``versions`` beyond the paths and the text are not read; no path may
    be named ``blob`` or ``found``. Text that no scan has seen has no spans.
    """
    at = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = [r.version for r in rules]
    placed = F.transform(
        F.filter("found", lambda s: s["rule"].isin(current)),
        lambda s: F.struct(s["start"].alias("start"), at[s["rule"]].alias("place"), s["end"].alias("end")),
    )
    hits = entries(versions.sparkSession, path).where(F.size("found") > 0).select(F.col("blob").alias("hit_blob"), placed.alias("placed"))
    hits = hits.groupBy("hit_blob").agg(F.array_sort(F.flatten(F.collect_list("placed"))).alias("placed"))
    named = F.transform(
        "placed", lambda s: F.struct(F.get(kinds, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    empty = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    rows = versions.select(*[F.col(f"`{c}`") for c in paths], blob_of(F.col("text")).alias("blob"))
    joined = rows.join(hits, F.col("blob") == F.col("hit_blob"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in paths], "blob", F.coalesce(named, empty).alias("found"))


def listed(found: Column) -> Column:
    """Spans as text: `kind:start:end`, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
