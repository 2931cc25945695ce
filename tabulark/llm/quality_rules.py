"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

A few rules reject a document when one of its numbers is above a cutoff. For every stratum, rule and
candidate cutoff, the good documents among the labelled holdout that the rule would reject are counted, and the exact binomial
tail says how likely so few would be if the rule rejected more than its share of the risk. A cutoff is
used only if that is below ``error`` divided by the number of all tests (Bonferroni). So with probability 1 - ``error`` all
strata lose at most ``risk`` of their good documents to the rules. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import bounded, text_key
from tabulark.scratch import cut

WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Per rule: the number it looks at, and the candidate cutoffs above which it rejects, in rising order."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / chars, (0.01, 0.02, 0.05, 0.1, 0.2)),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), (0.1, 0.2, 0.3, 0.5)),
        "repeats": (F.col("n_repeat_words") / words, (0.05, 0.1, 0.2)),
        "long_words": (F.col("word_chars") / words, (10.0, 12.0, 15.0, 20.0)),
    }


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """Per row: doc_id, text_key, the columns ``more``, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    names = ["doc_id", "text_key", *more]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key().alias("text_key"), *more, text.alias("text"))
    blank = F.lit(WHITE)
    words = F.split(F.btrim("text", blank), r"[ \t\n\u000b\f\r]+")
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, blank) != "")
    rows = rows.select(
        *names,
        F.array_remove(words, "").alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        *names,
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # One hash per window of words, then the windows that have an equal one, found by sorting only where there are any.
    starts = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    kept = [*names, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, window.alias("windows"))
    ranked = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ranked).alias("s"))

    def equal(i: Column) -> Column:
        here, before, after = F.get("s", i)["h"], F.get("s", i - 1)["h"], F.get("s", i + 1)["h"]
        return F.when((here == before) | (here == after), F.get("s", i)["i"])

    repeated = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), equal), lambda i: i.isNotNull())
    rows = rows.select(*kept, F.when(F.col("s").isNotNull(), F.array_sort(repeated)).alias("p"))
    step = lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - F.get("p", i), F.lit(WINDOW)))
    total = F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.lit(0), lambda done, i: done + step(i))
    return rows.select(*kept, F.when(F.col("p").isNull(), 0).otherwise(total).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps further up, where it is exact to double precision."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - reduce(lambda a, b: a + b, [F.log(x + k) for k in range(8)])


def binomial_tail(n: Column, r: Column, share: float) -> Column:
    """P(X <= r) for a binomial of n draws at ``share``, by its largest term and those below it.

    From the mean on the tail is not small, and 1 stands for it. Below, the terms fall faster than a geometric
    series away from the mean, and those further than 40 deviations are beyond double precision.
    """
    log_term = (
        _log_gamma(n + 1.0) - _log_gamma(r + 1.0) - _log_gamma(n - r + 1.0) + r * math.log(share) + (n - r) * math.log1p(-share)
    )
    count = F.least(r, F.ceil(40 * F.sqrt(n * share * (1 - share)) + 40)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(done: Column, j: Column) -> Column:
        k = (r - j + 1).cast("double")
        term = done["term"] * k * (1 - share) / ((n - k + 1) * share)
        return F.struct(term.alias("term"), (done["sum"] + term).alias("sum"))

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    summed = F.aggregate(steps, start, down, lambda done: done["sum"])
    return F.when(r >= n * share, 1.0).otherwise(F.exp(log_term) * summed)


def cutoffs(held: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the lowest certified cutoff, from measured good documents of the holdout.

    Every rule has an equal part of the risk. The number of tests counts every stratum that has a good document.
    """
    numbers = rules()
    share = risk / len(numbers)
    tests = [
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), (number > c).alias("rejects"))
        for rule, (number, candidates) in numbers.items()
        for c in candidates
    ]
    each = held.select("stratum", F.explode(F.array(*tests)).alias("t")).select("stratum", "t.*")
    counts = each.groupBy("stratum", "rule", "cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rejects").cast("bigint")).alias("r")
    )
    counts = cut(counts, "tests")
    total = counts.agg(F.count(F.lit(1)).alias("tests"))
    tail = binomial_tail(F.col("n"), F.col("r"), share)
    certified = counts.join(F.broadcast(total)).where(tail <= error / F.col("tests"))
    return certified.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, the measured numbers, base_failed and kept.

    ``labels`` (doc_id, quality) is the holdout; its good documents (quality 1) that do not fail the base rules decide the
    cutoffs. Words are runs without white space in the whole text; null and empty texts have none and fail the base
    rules. A null stratum is one of its own; null labels and ids of labels are ignored; repeated rows are judged
    alike, and a document labelled both ways counts as not good. No labels give no cutoffs, so that only base failures go.
    """
    numbers = measured(docs.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))), "stratum")
    numbers = cut(numbers.withColumn("base_failed", base_failed()), "measured")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    good = good.agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = numbers.where("not base_failed").join(good, "doc_id", "left_semi")
    found = cut(cutoffs(held, risk, error), "cutoffs")
    limits = bounded(found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")), 10_000)
    joined = numbers.join(limits, "stratum", "left")
    rejects = reduce(
        lambda a, b: a | b,
        [F.coalesce(number > F.element_at("limits", F.lit(rule)), F.lit(False)) for rule, (number, _) in rules().items()],
    )
    kept = ~F.col("base_failed") & ~rejects
    return joined.select(*[c for c in numbers.columns if c != "stratum"], kept.alias("kept"))
