"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides. Spark expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.session import cut

WINDOW = 5
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``words``: words inside a five-word window that the text has twice or more."""
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("windows", windows)
    # most texts repeat nothing; only the others sort their windows
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(repeats, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.coalesce(F.get("sorted", k)["h"] == F.get("sorted", j)["h"], F.lit(False))
    places = F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
        lambda k: F.get("sorted", k)["i"]))
    df = df.withColumn("places", F.when(F.col("sorted").isNotNull(), places))
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def signals(docs: DataFrame) -> DataFrame:
    """Counts over each whole text; null text has no words. One row per row of ``docs``; other columns are dropped."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    base = base.select(
        "doc_id", "text", F.translate("text", SPACES, "").alias("packed"),
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
    )
    base = base.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length("packed").cast("long").alias("word_chars"),
        (F.length("packed") - F.length(F.translate("packed", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'»)][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[#*$%&|<>].*[#*$%&|<>]"))).cast("long").alias("n_symbol_lines"),
        (F.length("packed") - F.length(F.regexp_replace("packed", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length("packed") - F.length(F.regexp_replace("packed", r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )
    return _repeat_words(base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
        "n_symbol_lines", "n_upper", "n_letters")


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(good, 1).when(bad, -1).otherwise(0).cast("tinyint")


def votes(counts: DataFrame) -> DataFrame:
    """Adds one column per rule: 1 for good, -1 for bad, 0 when the rule abstains."""
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    rules = {
        "v_length": (F.col("n_words"), lambda x: x >= 50, lambda x: x < 20),
        "v_word_length": (share("word_chars", "n_words"), lambda x: x.between(3, 10), lambda x: (x < 2.5) | (x > 12)),
        "v_symbols": (share("n_symbols", "word_chars"), lambda x: x < 0.01, lambda x: x > 0.05),
        "v_symbol_lines": (share("n_symbol_lines", "n_lines"), lambda x: x < 0.05, lambda x: x > 0.3),
        "v_letters": (share("n_letters", "word_chars"), lambda x: x > 0.9, lambda x: x < 0.75),
        "v_upper": (share("n_upper", "n_letters"), lambda x: x < 0.15, lambda x: x > 0.4),
        "v_dup_lines": (share("n_dup_lines", "n_lines"), lambda x: x < 0.05, lambda x: x > 0.3),
        "v_repeats": (share("n_repeat_words", "n_words"), lambda x: x < 0.05, lambda x: x > 0.2),
        "v_endings": (share("n_ended_lines", "n_lines"), lambda x: x > 0.7, lambda x: x < 0.3),
    }
    return counts.withColumns({name: _vote(x, good(x), bad(x)) for name, (x, good, bad) in rules.items()})


RULES = [
    "v_length", "v_word_length", "v_symbols", "v_symbol_lines", "v_letters", "v_upper", "v_dup_lines", "v_repeats", "v_endings",
]


def _log_odds(model: dict) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for rule in RULES:
        good, bad = model[rule]
        step = F.lit(0.0)
        for vote in (-1, 1):
            step = F.when(F.col(rule) == vote, math.log(good[vote] / bad[vote])).otherwise(step)
        odds = odds + step
    return odds


def posterior(model: dict) -> Column:
    return 1 / (1 + F.exp(-_log_odds(model)))


def fit(voted: DataFrame, rounds: int = 25, smooth: float = 1.0) -> dict:
    """Expectation-maximisation of the two-class model over the counts of all vote patterns.

    Each rule has, for good and for bad texts, an accuracy: the probability of either vote where it votes at all.
    An abstention is no evidence. The votes of all rows are first summed to a table of patterns (3 ** rules at
    most), which each round reads. A round starts from the posterior and sums expected counts; the first takes the share of good votes among the votes as posterior.
    An empty table gives even odds.
    """
    patterns = cut(voted.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    cast = sum((F.abs(F.col(r)).cast("double") for r in RULES), F.lit(0.0))
    p = (F.lit(0.5) + sum((F.col(r).cast("double") for r in RULES), F.lit(0.0)) / (2 * F.nullif(cast, F.lit(0.0))))
    p = F.coalesce(p, F.lit(0.5))
    model: dict = {}
    for _ in range(rounds):
        weighed = patterns.select(*RULES, F.col("n").cast("double").alias("n"), (F.col("n") * p).alias("g"))
        sums = weighed.agg(F.sum("n").alias("n"), F.sum("g").alias("g"), *(
            F.sum(F.when(F.col(r) == v, F.col(x)).otherwise(0.0)).alias(f"{r} {v} {x}") for r in RULES for v in (-1, 1) for x in ("n", "g"))).first()
        n, g = sums["n"] or 0.0, sums["g"] or 0.0
        at = lambda r, v, x: sums[f"{r} {v} {x}"] or 0.0  # noqa: B023, E731
        model = {"prior": (g + smooth) / (n + 2 * smooth)}
        for r in RULES:
            good = {v: at(r, v, "g") + smooth for v in (-1, 1)}
            bad = {v: at(r, v, "n") - at(r, v, "g") + smooth for v in (-1, 1)}
            model[r] = tuple({v: x / sum(of.values()) for v, x in of.items()} for of in (good, bad))
        p = posterior(model)
    return model


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its counts and votes, ``base_failed``, the posterior probability of quality, ``kept``.

    The counts are written once to the shared folder; the rules' reliabilities come from all rows of ``docs``.
    Null and empty texts have no words and so fail the base rule; repeated rows are judged alike.
    """
    voted = cut(votes(signals(docs)), "quality-votes")
    model = fit(voted)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "quality": posterior(model)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least))
