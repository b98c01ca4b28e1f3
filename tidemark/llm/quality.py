"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose statistic is beyond a cutoff. Cutoffs are chosen per
stratum (language) on the labelled good rows as a holdout: a cutoff is accepted if the
hypothesis "it falsely rejects more than ``alpha / rules`` of good texts" is refuted by
the exact binomial lower tail at level ``delta / (strata * rules)`` (Bonferroni over
strata and rules); along a rule's grid the cutoffs are tested from the most lenient on and
testing stops at the first that fails (fixed-sequence testing), so the chance that any
chosen cutoff breaks its limit is ``delta`` at most. A rule without an accepted cutoff
is not applied in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage_table

#: Rule, statistic, and cutoffs from the most lenient on; a text is rejected at or beyond the cutoff.
RULES = (
    ("symbols", "n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("repeats", "n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("long_words", "word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 17.5, 15.0, 12.5, 11.0, 10.0, 9.0)),
    ("short_words", "-word_chars / n_words", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0)),
)
ALPHA, DELTA = 0.03, 0.05
_SPACE = "\x20\t\n\x0b\f\r"
#: Terms of the binomial tail that are summed; what is beyond them is bounded by a geometric series.
TAIL_TERMS = 400


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    Null and empty texts have no words, so base_failed; a null stratum is its own stratum
    ``none``; repeated rows each give a row. All within the row: nothing is shuffled."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("none")) if stratum_col in docs.columns else F.lit("none")
    df = docs.select(F.col(id_col), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(_SPACE))
    df = df.select(
        id_col, "stratum",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")).alias("w"),
        F.expr("regexp_count(t, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"))
    # a projection's column that is used more than once is kept as it is, not computed per use
    df = df.select(
        id_col, "stratum", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"))
    base = [id_col, "stratum", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    df = df.select(*base, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, k, by: F.coalesce(x["h"] == F.get("s", k + by)["h"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform("s", lambda x, k: F.when(same(x, k, -1) | same(x, k, 1), x["i"])),
                                   lambda i: i.isNotNull()))
    df = df.select(*base, starts.alias("starts"))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    df = df.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_factorial(n: Column) -> Column:
    """ln n!: exact product below 16, Stirling's series (error under 1e-11) from there on."""
    small = F.log(F.factorial(F.least(n, F.lit(16)).cast("int")).cast("double"))
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3.0)) + 1 / (1260 * F.pow(x, 5.0))
    return F.when(n < 16, small).otherwise(series)


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), never below its true value; 1 where k is not under n * p."""
    lead = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    odds = (1 - p) / p

    def add(a, j):
        i = (k - j).cast("double")                                   # from the term at i to the one below it
        t = a["t"] * i / (n - i + 1) * odds
        return F.struct((a["s"] + a["t"]).alias("s"), t.alias("t"))

    last = F.least(k, F.lit(TAIL_TERMS))
    rest_ratio = F.greatest(k - last, F.lit(0)).cast("double") / (n - k + last + 1) * odds
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), last.cast("long")),
                        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), add,
                        lambda a: a["s"] + a["t"] / (1 - rest_ratio))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(lead + F.log(total))))


def _statistic(expr: str) -> Column:
    num, den = expr.split(" / ")
    return F.expr(f"case when {den} > 0 then cast({num} as double) / {den} end")


def thresholds(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
               alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum and rule with an accepted cutoff: stratum, rule, cutoff, false_rejects, n_good.

    Labels that are null are no holdout rows; an id labelled twice counts as good only if
    every label says so. Holdout rows are counted by partial aggregates, one pass."""
    good = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_good")).where("_good = 1")
    held = stats.where(~F.col("base_failed")).join(good.select(id_col), id_col, "left_semi")
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"),
        *[F.array(*[F.sum(F.when(_statistic(e) >= c, 1).otherwise(0)) for c in cuts]).alias(name) for name, e, cuts in RULES])
    counts = stage_table(counts, "quality-counts")
    n_tests = max(1, counts.count()) * len(RULES)
    per_rule = F.array(*[F.struct(F.lit(name).alias("rule"), F.array(*map(F.lit, cuts)).alias("cuts"), F.col(name).alias("k"))
                         for name, _, cuts in RULES])
    tests = (counts.select("stratum", "n_good", F.explode(per_rule).alias("r"))
             .select("stratum", "n_good", "r.rule", "r.cuts", F.posexplode("r.k").alias("i", "k"))
             .withColumn("p", lower_tail(F.col("k"), F.col("n_good"), alpha / len(RULES))))
    chosen = tests.groupBy("stratum", "rule", "n_good").agg(
        F.min(F.when(F.col("p") > delta / n_tests, F.col("i"))).alias("stop"),
        F.first("cuts").alias("cuts"), F.sort_array(F.collect_list(F.struct("i", "k"))).alias("k"))   # a grid's length at most
    last = F.coalesce(F.col("stop"), F.size("cuts")) - 1
    return chosen.where(last >= 0).select("stratum", "rule", F.get("cuts", last).alias("cutoff"),
                                          F.get("k", last)["k"].alias("false_rejects"), "n_good")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: the statistics, ``base_failed``, ``kept`` and ``rejected_by`` (rules, comma-joined).

    Cases as in :func:`statistics`; without labels only the base rule applies."""
    stats = stage_table(statistics(docs, id_col, text_col, stratum_col), "quality-stats")    # read twice, a few numbers a row
    cuts = thresholds(stats, labels, id_col, alpha=alpha, delta=delta).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = stage_table(cuts, "quality-cuts")         # one row per stratum: its measured size decides how it joins
    hits = F.filter(F.array(*[F.when(_statistic(e) >= F.try_element_at("cuts", F.lit(name)), F.lit(name)) for name, e, _ in RULES]),
                    lambda x: x.isNotNull())
    out = stats.join(cuts, "stratum", "left").withColumn("rejected_by", F.coalesce(F.array_join(hits, ","), F.lit("")))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "stratum", "rejected_by")
