"""Quality by weak supervision: rules vote or abstain, EM weighs them; DataFrame functions only.

Eight rules look at a whole text and vote good, bad or abstain. Votes are counted by pattern (at most 3**8 patterns,
whatever the corpus), and expectation-maximisation on that table estimates how often each rule votes bad. Bad documents
are bad in different ways, and one rule may be the only one to see it, so the model has a class of good documents and
a failure mode for each rule, which starts from that rule and learns how all rules vote in it. Weak priors, a tenth of a
class's own mass for its rule and a hundredth for the others, and so alike at every size, keep rates off 0 and 1. A document's
verdict is its posterior probability of being good, not the wish that all rules pass: a bad vote of a rule that good
documents fail, too, is outvoted; only the fixed base limits reject by themselves. All rounds are one SQL expression over
the array of patterns, in one job.

The shares of distinct and of repeated words fall and rise with length whatever the quality, so the rules on them look
at windows of ``WINDOW`` words over the whole text, and take the mean by words; n_repeat_words and the base limit on it
are of the whole text.

Everything about a document is computed within its row: words are an array, windows of three words are hashed, their
positions packed under the hash and sorted as longs, and equal neighbours are repeats. No word is ever shuffled. The
words of neighbours are compared, and a text in which different windows share a hash is sorted by its words instead, so
counts are exact. A text's words and windows are held at once, some 20 bytes for each of its bytes.

Defined results: a null, empty or blank text has no words and fails; repeated rows are scored alike and each count in
the estimates; an empty table gives no rows; extra columns are kept by filter_quality(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
ROUNDS = 60
#: Prior weight of a class's rates as a share of its mass: on good documents and a mode's own rule; on other rules.
WEIGHT, WEAK = 0.1, 0.01
#: Words in which distinct and repeated ones are counted for the votes.
WINDOW = 20_000

#: The hash of the window of three words at i; for the windows within WINDOW words with their number besides.
WINDOW_HASH = "xxhash64(words[i], words[i + 1], words[i + 2]{})"

#: (rule, measure, bad if below, bad if above, good from, good up to); in between a rule abstains.
RULES = (
    ("length", "n_words", 30, math.inf, 80, 100_000),
    ("word_length", "mean_word", 2.5, 12, 3.5, 8),
    ("symbols", "symbol_share", -1, 0.1, 0, 0.02),
    ("lines", "dup_line_share", -1, 0.5, 0, 0.1),
    ("repeats", "repeat_share", -1, 0.4, 0, 0.1),
    ("distinct", "distinct_share", 0.15, 2, 0.4, 1),
    ("shouting", "bang_share", -1, 0.3, 0, 0.05),
    ("stops", "stop_share", 0.005, 0.7, 0.02, 0.4),
)


def _per(n: str, d: str = "n_words") -> Column:
    return F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the measures of its column ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"), F.trim(text, F.lit(_TRIM)).alias("__trimmed"))

    def without(mark: str) -> Column:
        return F.length(F.replace("__text", F.lit(mark), F.lit("")))

    rows = rows.select(
        *keep,
        F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", _SPACE)).alias("words"),
        F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(_TRIM)) != "").alias("lines"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("__text") - without("!")).alias("n_bangs"),
        (3 * F.length("__text") - without(".") - without("!") - without("?")).alias("n_stops"),
    )
    distinct = f"aggregate(sequence(0, (size(words) - 1) div {WINDOW}), 0, (a, w) -> a + size(array_distinct(slice(words, cast(w * {WINDOW} + 1 as int), {WINDOW}))))"
    rows = rows.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_bangs",
        "n_stops",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.expr(f"case when size(words) <= {WINDOW} then size(array_distinct(words)) else {distinct} end").alias("n_distinct"),
        F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
    )
    # The hash of each window of three words above, its position in the low bits; for long texts also those within each
    # window, which are equal in the same window only.
    packed = "sort_array(transform({}, i -> shiftleft(" + WINDOW_HASH + ", bits) | i))"
    whole = packed.format("sequence(0, n_words - 3)", "")
    inside = packed.format(f"filter(sequence(0, n_words - 3), i -> i % {WINDOW} <= {WINDOW - 3})", f", i div {WINDOW}")
    none = "cast(array() as array<bigint>)"
    rows = rows.withColumns({"packed": F.expr(f"case when n_words >= 3 then {whole} else {none} end"), "inside": F.expr(f"case when n_words > {WINDOW} then {inside} else {none} end")})
    one, two = "cast(x & (shiftleft(1L, bits) - 1) as int)", "cast({} & (shiftleft(1L, bits) - 1) as int)"

    def alike(other: str) -> str:
        """Whether the window of x and that of another entry have one hash."""
        return f"shiftright(x, bits) = shiftright({other}, bits)"

    def equal(other: str) -> str:
        at = two.format(other)
        return f"words[{one}] = words[{at}] and words[{one} + 1] = words[{at} + 1] and words[{one} + 2] = words[{at} + 2]"

    def repeated(of: str) -> str:
        before, after = f"get({of}, cast(i - 1 as int))", f"get({of}, cast(i + 1 as int))"
        found = f"filter({of}, (x, i) -> ({alike(before)} and {equal(before)}) or ({alike(after)} and {equal(after)}))"
        return f"sort_array(transform({found}, x -> x & (shiftleft(1L, bits) - 1)))"

    def differ(of: str) -> str:
        before = f"get({of}, cast(i - 1 as int))"
        return f"size(filter({of}, (x, i) -> coalesce({alike(before)} and not ({equal(before)}), false))) > 0"

    windows = "sort_array(transform(sequence(0, n_words - 3), i -> struct(words[i] as a, words[i + 1] as b, words[i + 2] as c, i as at)))"
    same = "(x.a = {0}.a and x.b = {0}.b and x.c = {0}.c)"
    sorted_ = f"filter(w, (x, i) -> {same.format('get(w, cast(i - 1 as int))')} or {same.format('get(w, cast(i + 1 as int))')})"
    exact = f"transform(array({windows}), w -> sort_array(transform({sorted_}, x -> cast(x.at as bigint))))[0]"
    rows = rows.withColumns({"repeats": F.expr(f"case when {differ('packed')} then {exact} else {repeated('packed')} end"), "inside": F.expr(repeated("inside"))}).drop("packed", "words")
    covered = "aggregate({}, named_struct('n', 0L, 'last', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.last), 'last', p), a -> a.n)"
    rows = rows.withColumn("n_repeat_words", F.expr(covered.format("repeats")))
    rows = rows.withColumn("n_inside", F.expr(f"case when n_words > {WINDOW} then {covered.format('inside')} else n_repeat_words end")).drop("repeats", "inside", "bits")
    return rows.select(
        *keep,
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        _per("word_chars").alias("mean_word"),
        _per("n_symbols").alias("symbol_share"),
        _per("n_dup_lines", "n_lines").alias("dup_line_share"),
        _per("n_inside").alias("repeat_share"),
        _per("n_distinct").alias("distinct_share"),
        _per("n_bangs").alias("bang_share"),
        _per("n_stops").alias("stop_share"),
    )


def votes(measured: DataFrame) -> DataFrame:
    """``measured`` with a column votes, one for each rule: 1 good, -1 bad, 0 abstains."""
    cast = []
    for _, of, low, high, start, stop in RULES:
        x = F.col(of)
        bad = (x < F.lit(float(low))) | (x > F.lit(float(high)))
        good = (x >= F.lit(float(start))) & (x <= F.lit(float(stop)))
        cast.append(F.when(bad, -1).when(good, 1).otherwise(0))
    return measured.withColumn("votes", F.array(*cast))


def _doubles(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + of(x))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def posteriors(share: Column, bad: Column, votes: Column) -> Column:
    """P(class) given an array of votes: good first, then a failure mode for each rule. ``share`` is the classes' array,
    ``bad`` each class's array of the rates at which rules vote bad."""

    def likelihood(s: Column, c: Column) -> Column:
        def times(product: Column, r: Column) -> Column:
            vote, rate = F.get(votes, r), F.get(F.get(bad, c), r)
            return product * F.when(vote < 0, rate).when(vote > 0, 1 - rate).otherwise(F.lit(1.0))

        return F.aggregate(_numbers(len(RULES)), s, times)

    return _let(F.transform(share, likelihood), lambda joint: F.transform(joint, lambda x: x / _total(joint, lambda y: y)))


def _start() -> dict:
    rules = len(RULES)
    modes = [[0.9 if r == k else 0.2 for r in range(rules)] for k in range(rules)]
    return {"share": [0.8] + [0.2 / rules] * rules, "bad": [[0.02] * rules, *modes]}


def _round(model: Column, patterns: Column) -> Column:
    """The model after one step of expectation and maximisation over patterns (votes, n)."""
    rules = len(RULES)

    def rates(seen: Column) -> Column:
        def rate(c: Column, r: Column) -> Column:
            mass = _total(seen, lambda x: F.get(x.p, c))
            bad = _total(seen, lambda x: F.when(F.get(x.votes, r) < 0, F.get(x.p, c)).otherwise(0.0))
            good = _total(seen, lambda x: F.when(F.get(x.votes, r) > 0, F.get(x.p, c)).otherwise(0.0))
            expected = F.when(c == 0, 0.01).when(r == c - 1, 0.9).otherwise(0.2)
            weight = F.when((c == 0) | (r == c - 1), WEIGHT).otherwise(WEAK) * mass + 1
            return (bad + weight * expected) / (bad + good + weight)

        return F.transform(_numbers(rules + 1), lambda c: F.transform(_numbers(rules), lambda r: rate(c, r)))

    def share(seen: Column) -> Column:
        total = _total(seen, lambda x: _total(x.p, lambda y: y))
        return F.transform(_numbers(rules + 1), lambda c: (_total(seen, lambda x: F.get(x.p, c)) + 0.001 * total) / (total * (1 + 0.001 * (rules + 1))))

    seen = F.transform(patterns, lambda x: F.struct(x.votes.alias("votes"), F.transform(posteriors(model.share, model.bad, x.votes), lambda y: y * x.n).alias("p")))
    return _let(seen, lambda s: F.struct(share(s).alias("share"), rates(s).alias("bad")))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM on the counts of vote patterns: the share of each class and how often each rule votes bad in it."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    patterns = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # at most 3**8
    start = _start()
    model = F.struct(_doubles(start["share"]).alias("share"), F.array(*map(_doubles, start["bad"])).alias("bad"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), model, lambda m, _: _round(m, F.col("patterns")))
    found = patterns.where(F.size("patterns") > 0).select(model.alias("m")).select("m.*").first()  # one row
    return {"share": list(found["share"]), "bad": [list(x) for x in found["bad"]]} if found else start


def score_quality(docs: DataFrame, keep: list[str], least: float = 0.5) -> DataFrame:
    """The columns ``keep``, the measures, quality (the posterior), base_failed and kept; computed once and written."""
    voted = materialize(votes(measures(docs, keep)))
    model = estimate(voted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.get(posteriors(_doubles(model["share"]), F.array(*map(_doubles, model["bad"])), F.col("votes")), F.lit(0))
    out = voted.withColumn("quality", good).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def filter_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("text"))
    return score_quality(rows, ["__row"], least).where("kept").select("__row.*")
