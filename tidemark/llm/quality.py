"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 8
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Also seen by the rules.
MORE = ["n_lines", "n_digits", "n_marks", "n_distinct", "n_closed"]


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FEATURES and MORE (all long). Null text counts as empty. Docs must not have these names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    split = (
        docs.withColumn("_t", text)
        .withColumn("_words", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
        .withColumn("_n", F.size("_words"))
    )
    # a hash of the words of each window, by the window's first word from 0
    windows = F.when(F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.withColumn("_w", windows)
    ranked = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda a, b: (F.get("_s", a)["g"] == F.get("_s", b)["g"]) & (F.slice("_words", F.get("_s", a)["i"] + 1, F.lit(WINDOW)) == F.slice("_words", F.get("_s", b)["i"] + 1, F.lit(WINDOW)))
    repeated = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce((k < F.size("_s") - 1) & same(k, k + 1), F.lit(False)))
    placed = ranked.withColumn("_at", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(repeated, lambda k: F.get("_s", k)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_at") - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get("_at", k) - F.get("_at", k - 1)))
    counted = placed.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": without("#*$%&|<>"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_at") > 1, covered).otherwise(0).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_digits": without("0123456789"),
            "n_marks": without("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_closed": F.size(F.filter("_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(*'.!?:;"»”…'))).cast("long"),
        }
    )
    return counted.drop("_t", "_words", "_lines", "_n", "_w", "_s", "_at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0).cast("int")


def default_rules() -> dict[str, Column]:
    """Votes on the features: 1 for, -1 against, 0 abstains. At most 3 ** len(rules) patterns."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    mean = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return {
        "v_length": _vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "v_word_length": _vote(mean.between(2.5, 12), mean.isNull() | (mean < 2) | (mean > 16)),
        "v_symbols": _vote(share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.1),
        "v_marks": _vote(share("n_marks", "word_chars") <= 0.08, share("n_marks", "word_chars") > 0.12),
        "v_lines": _vote(share("n_dup_lines", "n_lines") <= 0.05, share("n_dup_lines", "n_lines") > 0.3),
        "v_repeats": _vote(share("n_repeat_words", "n_words") <= 0.05, share("n_repeat_words", "n_words") > 0.3),
        "v_digits": _vote(share("n_digits", "word_chars") <= 0.1, share("n_digits", "word_chars") > 0.3),
        "v_variety": _vote((share("n_distinct", "n_words") >= 0.25) & (F.col("n_words") > 0), share("n_distinct", "n_words") < 0.1),
        "v_closed": _vote((share("n_closed", "n_lines") >= 0.5) & (F.col("n_lines") > 0), (share("n_closed", "n_lines") < 0.1) & (F.col("n_lines") >= 4)),
    }


#: At first a good document draws right votes thus often, a bad one thus often; worth so many votes later.
_GOOD, _BAD, _IMAGINED = 0.98, 0.5, 20
_FLOOR = 0.002


def _posterior(rules: list[str], prior: float, right: dict[str, tuple[float, float]]) -> Column:
    """Probability of good quality given the votes. A vote for never lowers it, a vote against never
    raises it, an abstention leaves it."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r in rules:
        good, bad = right[r]
        odds = odds + F.when(F.col(r) == 1, max(0.0, math.log(good / (1 - bad)))).when(F.col(r) == -1, min(0.0, math.log((1 - good) / bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, rules: list[str], steps: int = 12, settled: float = 1e-4) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior of good quality and, per rule, its accuracy on good and on bad documents it votes on, by EM.

    All rows of `votes` count: they are first summed to their patterns of votes (at most
    3 ** len(rules) rows, however many documents), and each step is one aggregate over those. Imagined votes
    keep the classes apart where one is rare; accuracies on good documents stay in 0.55 to 0.998, on bad
    in 0.002 to 0.998, the prior in 0.5 to 0.99. It ends after `steps`, or when nothing moves by more than `settled`.
    """
    patterns = materialise(votes.groupBy(*rules).agg(F.count("*").cast("double").alias("_n")).coalesce(1), "vote-patterns")
    prior, right, clip = 0.9, dict.fromkeys(rules, (_GOOD, _BAD)), lambda x, a, b: round(min(max(x, a), b), 6)
    votes_of = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in rules]))
    on = lambda v, x: F.sum(F.when(F.col("v.vote").isin(*v), x).otherwise(0.0))
    for _ in range(steps):
        weighed = patterns.withColumn("good", F.col("_n") * _posterior(rules, prior, right)).select("_n", "good", votes_of.alias("v"))
        good, bad = F.col("good"), F.col("_n") - F.col("good")
        sums = weighed.groupBy("v.rule").agg(F.sum("_n").alias("n"), F.sum("good").alias("good"), on([1], good).alias("rightly_for"), on([1, -1], good).alias("on_good"), on([-1], bad).alias("rightly_against"), on([1, -1], bad).alias("on_bad"))
        of = {s["rule"]: s for s in sums.collect()}  # a row per rule
        if not of:
            break
        one = of[rules[0]]
        before, prior = (prior, *right.values()), clip(one["good"] / one["n"], 0.5, 0.99)
        share = lambda a, b, imagined: (a + _IMAGINED * imagined) / (b + _IMAGINED)
        right = {r: (clip(share(of[r]["rightly_for"], of[r]["on_good"], _GOOD), 0.55, 1 - _FLOOR), clip(share(of[r]["rightly_against"], of[r]["on_bad"], _BAD), _FLOOR, 1 - _FLOOR)) for r in rules}
        if np.allclose(np.hstack(before), np.hstack((prior, *right.values())), rtol=0, atol=settled):
            break
    return prior, right


def _judge(docs: DataFrame, keep: list[str], text_col: str, least: float) -> DataFrame:
    """_keep0, _keep1, ... and all that is found out; the features are written once, fit and verdicts read them."""
    rules = default_rules()
    base = docs.select(*[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"))
    votes = materialise(text_features(base, "_text").drop("_text").withColumns(rules), "votes")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    based = votes.withColumn("base_failed", failed)
    # what the base rules reject is decided and would pass for the only kind of bad text
    prior, right = fit(based.where("not base_failed"), list(rules))
    return based.withColumn("quality", _posterior(list(rules), prior, right)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def score_quality(docs: DataFrame, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`keep` columns of each row with FEATURES, the votes, quality (posterior), base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words in 8-word windows found twice. kept: not
    base_failed and quality of at least `least`. Null and empty texts fail; rows are judged one by one, so
    repeated rows get equal verdicts; an empty table gives no rows; columns not in `keep` are ignored, and
    those in it must not have the names of the columns added (ValueError). Whole texts are judged, however long.
    """
    if clash := {*keep} & {*FEATURES, *default_rules(), "quality", "base_failed", "kept"}:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    judged = _judge(docs, keep, text_col, least)
    return judged.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *FEATURES, *default_rules(), "quality", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score_quality keeps; the columns stay as they are, whatever their names."""
    judged = _judge(docs, docs.columns, text_col, least)
    return judged.where("kept").select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(docs.columns)])
