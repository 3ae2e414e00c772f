"""Operator 3, quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns estimates the share of
good documents and, for each rule and class, how often it votes which way; a document is kept if its posterior probability of being good
reaches the threshold. Vote patterns are at most 3 to the number of rules, whatever the input's size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import common

#: Shares from which on a rule votes bad; it abstains below.
SYMBOLS, CAPITALS, SHOUTS, MARKS, REPEATS, DUP_LINES, DOUBLES = 0.1, 0.3, 0.1, 0.1, 0.2, 0.1, 0.15
#: Shares below which a rule votes bad, and from which on it votes good; it abstains between.
PLAIN, VARIED, SHORT = (0.85, 0.95), (0.25, 0.4), (0.02, 0.12)
#: Words of a plain word form: letters, and the marks of running text around them.
PLAIN_WORD = r"^[\"'(\u00AB\u00BF\u00A1]?[\p{L}\p{N}][\p{L}\p{N}'\u2019.-]*[.,;:!?)\"'\u00BB]?$"
ROUNDS, THRESHOLD = 25, 0.5
#: Fixed starting values: a rule's vote is right this often; prior of good.
START, PRIOR = 0.9, 0.8
RULES = ("symbols", "capitals", "shouts", "marks", "repeats", "dup_lines", "doubles", "plain", "varied", "short")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more."""

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            n = F.size(s)
            at = F.array_sort(F.transform(F.filter(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
                (((k > 1) & (F.get(s, k - 2)["h"] == F.get(s, k - 1)["h"])) | ((k < n) & (F.get(s, k)["h"] == F.get(s, k - 1)["h"]))).alias("hit"),
                F.get(s, k - 1)["i"].alias("i"))), lambda x: x["hit"]), lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last"))
            return F.aggregate(at, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(8), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(ranked, flagged))

    def doubled(h: Column, width: int) -> Column:
        """Hashes of runs twice as long; the last ``width`` are cut off later."""
        return F.zip_with(h, F.slice(h, width + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    each = F.transform(words, lambda w: F.xxhash64(w))
    eight = _let(_let(_let(each, lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), lambda h: F.slice(doubled(h, 4), 1, F.size(h) - 7))
    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(_let(eight, covered))


def _count(text: Column, pattern: str) -> Column:
    """How often a pattern of single characters occurs."""
    return (F.size(F.split(text, pattern)) - 1).cast("long")


def _features(text: Column) -> Column:
    def build(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).alias("word_chars"),
            _count(text, "[#*$%&|<>]").alias("n_symbols"),
            _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeats(words).alias("n_repeat_words"),
            _count(text, "[A-Z]").alias("n_capitals"),
            _count(text, "[!?]").alias("n_shouts"),
            _count(text, r"[|<>{}#*$%&=\\](?=[\x20\x09-\x0D]|\z)").alias("n_marked"),
            F.size(F.filter(words, lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain"),
            F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_doubles"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
        )

    return _let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), build)


def with_features(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """All columns of ``docs`` and struct column ``name`` with the counts that the rules look at."""
    return docs.withColumn(name, _let(F.coalesce(F.col(f"`{text}`"), F.lit("")), _features))


def votes(f: Column) -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains, for the counts in struct ``f``."""
    n = F.greatest(f["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(f["word_chars"], F.lit(1)).cast("double")

    def high(x: Column, bad: float) -> Column:
        return F.when(x >= bad, -1).otherwise(0)

    def low(x: Column, bad_good: tuple[float, float]) -> Column:
        return F.when(x < bad_good[0], -1).when(x >= bad_good[1], 1).otherwise(0)

    return {
        "symbols": high(f["n_symbols"] / n, SYMBOLS), "capitals": high(f["n_capitals"] / chars, CAPITALS), "shouts": high(f["n_shouts"] / n, SHOUTS),
        "marks": high(f["n_marked"] / n, MARKS), "repeats": high(f["n_repeat_words"] / n, REPEATS), "dup_lines": high(f["n_dup_lines"] / n, DUP_LINES),
        "doubles": high(f["n_doubles"] / n, DOUBLES),
        "plain": low(f["n_plain"] / n, PLAIN), "varied": low(f["n_distinct"] / F.sqrt(n) / 10, VARIED), "short": low(f["n_short"] / n, SHORT),
    }


def pattern(f: Column) -> Column:
    """The votes as one number in base three."""
    return reduce(lambda acc, v: acc * 3 + (v + 1), votes(f).values(), F.lit(0))


def vote_of(code: Column, k: int) -> Column:
    return F.floor(code / 3 ** (len(RULES) - 1 - k)) % 3 - 1


def posterior(code: Column, model: Row) -> Column:
    """Posterior probability of good for a vote pattern: only votes count, abstaining says nothing."""
    score = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (good, bad) in enumerate(zip(model.good, model.bad, strict=True)):
        score = score + F.element_at(F.array(F.lit(math.log((1 - good) / (1 - bad))), F.lit(0.0), F.lit(math.log(good / bad))), (vote_of(code, k) + 2).cast("int"))
    return 1 / (1 + F.exp(-score))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> Row:
    """prior (share of good), good and bad (by rule: how often a vote is for good, given a good or bad document).

    EM over (code, n), one row for each vote pattern, gathered into one array of at most 3 to the number of rules entries and
    iterated by an aggregate over the rounds; one row reaches the driver. Estimates carry one pseudo-vote, and a
    rule's votes never come to speak against their own direction.
    """
    ks, zero = F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.lit(0.0)

    def total(xs: Column, value) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: acc + value(x))

    def step(model: Column, xs: Column) -> Column:
        weights = F.transform(ks, lambda k: F.struct(F.log(F.get(model["good"], k) / F.get(model["bad"], k)).alias("up"), F.log((1 - F.get(model["good"], k)) / (1 - F.get(model["bad"], k))).alias("down")))

        def score(x: Column, w: Column) -> Column:
            return F.aggregate(ks, F.log(model["prior"] / (1 - model["prior"])), lambda acc, k: acc + F.when(F.get(x["v"], k) == 1, F.get(w, k)["up"]).when(F.get(x["v"], k) == -1, F.get(w, k)["down"]).otherwise(zero))

        def judged(w: Column) -> Column:
            return F.transform(xs, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["n"] / (1 + F.exp(-score(x, w)))).alias("good")))

        def share(k: Column, ys: Column, part, start: float) -> Column:
            ups = total(ys, lambda y: F.when(F.get(y["v"], k) == 1, part(y)).otherwise(zero))
            alls = total(ys, lambda y: F.when(F.get(y["v"], k) != 0, part(y)).otherwise(zero))
            return (ups + start) / (alls + 1)

        def update(ys: Column) -> Column:
            return F.struct(
                F.least(F.greatest((total(ys, lambda y: y["good"]) + PRIOR) / (total(ys, lambda y: y["n"]) + 1), F.lit(0.01)), F.lit(0.99)).alias("prior"),
                F.transform(ks, lambda k: F.greatest(share(k, ys, lambda y: y["good"], START), F.lit(0.5))).alias("good"),
                F.transform(ks, lambda k: F.least(share(k, ys, lambda y: y["n"] - y["good"], 1 - START), F.lit(0.5))).alias("bad"))

        return _let(_let(weights, judged), update)

    first = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(START), len(RULES)).alias("good"), F.array_repeat(F.lit(1 - START), len(RULES)).alias("bad"))
    each = patterns.select(F.struct("code", F.array(*[vote_of(F.col("code"), k).cast("int") for k in range(len(RULES))]).alias("v"), F.col("n").cast("double").alias("n")).alias("x"))
    gathered = each.agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select(_let(F.col("xs"), lambda xs: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda model, _: step(model, xs))).alias("model")).select("model.*").first()


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior and kept, for every row of ``docs``.

    A null text has no words, so it fails the base; a null doc_id and repeated rows stay. An empty table gives an empty table
    (the model is then the starting one). Other columns are not read.
    """
    found = common.written(with_features(docs.select("doc_id", "text")).select("doc_id", "quality.*"), "quality")
    f = F.struct(*found.columns[1:])
    coded = found.withColumn("code", pattern(f))
    model = fit(common.written(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "votes"))
    p = posterior(F.col("code"), model)
    return coded.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed(f).alias("base_failed"), (~base_failed(f) & (p >= THRESHOLD)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; null, repeated, empty and clashing cases as for ``judged``.

    Rows are written with their counts once, so that no filter works them out again.
    """
    found = common.written(with_features(docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))).select("row", "quality"), "quality-rows")
    f = F.col("quality")
    coded = found.select("row", pattern(f).alias("code"), base_failed(f).alias("failed"))
    model = fit(common.written(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "votes"))
    return coded.where(~F.col("failed") & (posterior(F.col("code"), model) >= THRESHOLD)).select("row.*")
