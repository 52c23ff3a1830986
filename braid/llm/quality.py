"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Each rule rejects a text whose measure is above a cutoff. For every stratum, rule and
cutoff of a fixed grid, the labelled good texts of the stratum are a holdout: n of them,
k rejected. The exact binomial test rejects "this cutoff loses more than alpha of the
good texts" if P(Bin(n, alpha) <= k) is at most delta over the number of all tests
(Bonferroni), which is the Clopper-Pearson bound k-of-n below alpha at that level. Of a
rule's certified cutoffs in a stratum, that which rejects most labelled bad texts
is taken, of equals the most lenient; without a certified cutoff that rejects any, the
rule is off there. ``alpha`` is shared among the rules, so with chance 1 - delta all
strata lose at most ``alpha`` of their good texts.
"""

from __future__ import annotations

from functools import reduce
from math import lgamma, log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_names, written

BLANKS = " \t\n\x0b\f\r"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Each rule's measure, a quotient of counts, and the cutoffs that are tried, from lenient to strict.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.8, 0.6, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "repeated_words": ("n_repeat_words", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("n_capital_words", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "long_words": ("word_chars", "n_words", (100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each text, as long. A null text counts as empty.

    Repeats are found among 64-bit hashes of the text's own windows, so the work is that
    of one sort of them, in the texts that have any.
    """
    names = dict(zip((*COUNTS, "t", "w", "h", "g", "s", "p"), fresh_names(docs, *COUNTS, "b_t", "b_w", "b_h", "b_g", "b_s", "b_p"), strict=True))
    c = {k: F.col(v) for k, v in names.items()}
    done = docs.withColumn(names["t"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bare = F.btrim(c["t"], F.lit(BLANKS))
    done = done.withColumn(names["w"], F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(c["t"], "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    done = done.withColumns({names["n_words"]: F.size(c["w"]).cast("long"), names["h"]: F.transform(c["w"], lambda x: F.xxhash64(x)), names["p"]: lines})
    blanks_out, symbols_out = (F.translate(c["t"], x, "") for x in (BLANKS, SYMBOLS))
    window = lambda i: F.xxhash64(*(F.get(c["h"], i + k) for k in range(WINDOW)))
    grams = F.when(c["n_words"] >= WINDOW, F.transform(F.sequence(F.lit(0), (c["n_words"] - WINDOW).cast("int")), window)).otherwise(F.array().cast("array<long>"))
    done = done.withColumns(
        {
            names["word_chars"]: F.length(blanks_out).cast("long"),
            names["n_symbols"]: (F.length(c["t"]) - F.length(symbols_out)).cast("long"),
            names["n_lines"]: F.size(c["p"]).cast("long"),
            names["n_dup_lines"]: (F.size(c["p"]) - F.size(F.array_distinct(c["p"]))).cast("long"),
            names["n_capital_words"]: F.regexp_count(c["t"], F.lit(r"\p{Lu}{3,}")).cast("long"),
            names["g"]: grams,
        }
    )
    sorted_grams = F.sort_array(F.transform(c["g"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    done = done.withColumn(names["s"], F.when(F.size(F.array_distinct(c["g"])) < F.size(c["g"]), sorted_grams))
    beside = lambda x, i, k: F.get(c["s"], i + k)["h"].eqNullSafe(x["h"])
    twice = F.filter(F.transform(c["s"], lambda x, i: F.struct(x["i"].alias("i"), (beside(x, i, -1) | beside(x, i, 1)).alias("d"))), lambda x: x["d"])
    done = done.withColumn(names["p"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(c["p"], start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])
    done = done.withColumn(names["n_repeat_words"], F.coalesce(covered, F.lit(0).cast("long")))
    return done.drop(*(names[x] for x in "twhgsp"))


#: ln n! less its Stirling approximation, of the first numbers; the rest by the series.
_STIRLING_ERRORS = (0.0, *(lgamma(n + 1) - (n + 0.5) * log(n) + n - log(2 * pi) / 2 for n in range(1, 16)))


def _stirling_error(n: Column) -> Column:
    square = n * n
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / square) / square) / square) / n
    return F.when(n < len(_STIRLING_ERRORS), F.get(F.array(*map(F.lit, _STIRLING_ERRORS)), n.cast("int"))).otherwise(series)


def _chance_of(k: Column, n: Column, rate: float) -> Column:
    """The logarithm of P(Bin(n, rate) = k) for 0 < k < n, by the saddle point: exact to rounding at any size."""
    apart = lambda x, m: x * F.log(x / m) + m - x
    errors = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    return errors - apart(k, n * rate) - apart(n - k, n * (1 - rate)) + F.log(n / (F.lit(2 * pi) * k * (n - k))) / 2


def chance_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k); 1 where k is at its mean or above, which no test passes.

    Terms are summed from k down, each from the one before, as far as they count at all: below the
    mean they fall at least as fast as those of a normal curve, so about 9 of its spreads are enough.
    """
    wide, whole = n.cast("double"), k.cast("double")
    terms = F.least(k, F.ceil(10 * F.sqrt(wide * rate)).cast("long") + 50)
    odds = (1 - rate) / rate

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (i + 1) * odds / (wide - i)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    # i runs over k - 1, k - 2, ...
    steps = F.when(terms > 0, F.transform(F.sequence(F.lit(1).cast("long"), terms), lambda j: (k - j).cast("double"))).otherwise(F.array().cast("array<double>"))
    one = F.lit(1.0)
    total = F.aggregate(steps, F.struct(one.alias("term"), one.alias("total")), add, lambda a: a["total"])
    first = F.when(k == 0, wide * F.log1p(F.lit(-rate))).otherwise(_chance_of(whole, wide, rate))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(first + F.log(total)))


def _value(rule: str, counts: dict[str, str]) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(counts[under]) > 0, F.col(counts[over]) / F.col(counts[under])).otherwise(F.lit(0.0))


def cutoffs(labelled: DataFrame, counts: dict[str, str], alpha: float, delta: float, names: dict[str, str]) -> DataFrame:
    """(stratum, a cutoff column for each rule, null where the rule is off) from rows (stratum, good, counts)."""
    tries = len(next(iter(RULES.values()))[2])
    level = lambda rule: reduce(lambda a, b: a + b, ((_value(rule, counts) > c).cast("int") for c in RULES[rule][2]))
    rows = labelled.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("x")).select("stratum", "good", "x.*")
    # a text of level L is above the L strictest cutoffs, which stand last
    lost = lambda good: F.array(*(F.count(F.when((F.col("good") == good) & (F.col("level") >= tries - j), 1)) for j in range(tries)))
    tables = rows.groupBy("stratum", "rule").agg(F.count(F.when(F.col("good"), 1)).alias("n"), lost(True).alias("k"), lost(False).alias("b"))
    strata = tables.groupBy("rule").agg(F.count("*").alias("strata"))
    tried = tables.join(strata, "rule").select("stratum", "rule", "n", "strata", F.posexplode(F.arrays_zip("k", "b")).alias("j", "kb"))
    passed = tried.where((F.col("kb.b") > 0) & (chance_at_most(F.col("kb.k"), F.col("n"), alpha / len(RULES)) <= F.lit(delta / (len(RULES) * tries)) / F.col("strata")))
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct(F.col("kb.b").alias("b"), (-F.col("j")).alias("j"))).alias("best"))
    grid = lambda r: F.get(F.array(*map(F.lit, RULES[r][2])), -F.col("best.j"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, grid(r))).alias(names[r]) for r in RULES))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    keep_text: bool = True,
    alpha: float = 0.05,
    delta: float = 0.05,
    least_words: int = 10,
    most_repeat: int = 20,
) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with the counts, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeat`` percent
    of them in repeated windows. ``labels`` has ids and a column that is 1 for good texts
    and 0 for bad ones; null labels and null ids are no labels, and an id with several
    labels is good if one is. Null strata are one stratum. A stratum without labels has no
    cutoffs: nothing is rejected there beyond the base. Equal rows get equal verdicts, an empty
    table gives none; names that are taken get a leading underscore.
    """
    measures = measured(docs, text_col)
    names = dict(zip(COUNTS, fresh_names(docs, *COUNTS), strict=True))
    plain = measures if keep_text else measures.drop(text_col)
    rows = written(plain, "measures")
    base, kept, stratum, *taken = fresh_names(rows, "base_failed", "kept", "b_stratum", *(f"cut_{r}" for r in RULES))
    cuts = dict(zip(RULES, taken, strict=True))
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("b_id")).agg((F.max(label_col) > 0).alias("good"))
    labelled = rows.select(F.col(id_col).alias("b_id"), F.col(stratum_col).alias("stratum"), *names.values()).join(good, "b_id")
    cut = written(cutoffs(labelled, names, alpha, delta, cuts).withColumnRenamed("stratum", stratum), "cutoffs")
    judged = rows.join(cut, F.col(stratum_col).eqNullSafe(F.col(stratum)), "left")
    n, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n < least_words) | (100 * repeats > most_repeat * n)
    above = reduce(lambda a, b: a | b, (F.coalesce(_value(r, names) > F.col(cuts[r]), F.lit(False)) for r in RULES))
    return judged.withColumns({base: failed, kept: ~failed & ~above}).select(*rows.columns, base, kept)
