"""Quality rules with risk-controlled thresholds (DataFrame functions only).

A composite filter rejects a document if any signal is above its cutoff. The
filters are a fixed sequence of ``STEPS`` steps, from the loosest cutoffs of all
signals to the strictest, each step rejecting what the one before does and more.
For each stratum (a language) the steps are tested in order on the labelled good
documents: with k of n good ones rejected, the exact binomial tail
P(Bin(n, risk) <= k) must not exceed the stratum's share of delta, else the test
stops there (fixed-sequence testing, which needs no correction along the
sequence). The share is delta divided by the number of strata tested
(Bonferroni), so that with confidence 1 - delta every stratum rejects at most
``risk`` of its good documents. A stratum with too few labels to pass even
without a rejection is not tested: the number s of strata is the largest for which
the s-th largest one could pass at delta / s, and depends on numbers of labels
only, never on outcomes. Of the steps that pass, the one that rejects most bad
documents less good ones is taken, the loosest among equals.

Trials are distinct texts of a stratum, as copies are not independent. Strata
come from the data; more than ``MAX_STRATA`` tested ones are an error, as their
steps come to the driver.

Defined results: a null or blank text has no words and fails the base rule;
documents without a language are a stratum of their own; strata without enough
labels have the base rule only; a text labelled more than once is good if any
label says so; null labels and ids are ignored; repeated rows are judged each;
an empty table gives no rows and empty labels switch the rules off; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import let, words_of, written

#: Signal and its cutoffs, loosest first: one for each step.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.06, 0.03),
    "bang_ratio": (0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.06, 0.03),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3),
    "repeat_ratio": (0.2, 0.2, 0.2, 0.19, 0.19, 0.19, 0.18, 0.18, 0.17, 0.16),
    "word_length": (40.0, 25.0, 20.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0),
}
STEPS = 10
RISK, DELTA, WINDOW, MAX_STRATA = 0.02, 0.05, 5, 1000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that are found twice or more in the array, the first one included.

    Windows are compared by 64-bit hash. Sorted (hash, start) pairs put equal
    windows side by side; the lengths of the union of [start, start + window)
    are then added up in start order. Texts without a repeat skip the sorting.
    """

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.when(F.size(w) >= window, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            last = F.size(p) - 1
            seen = F.transform(p, lambda x, j: F.when(((j > 0) & (F.get(p, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])) | ((j < last) & (F.get(p, j + 1)["h"] == x["h"])), x["i"]))
            return F.sort_array(F.filter(seen, lambda x: x.isNotNull()))

        first = F.struct(F.lit(-window).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, s: F.struct(s.cast("bigint").alias("at"), (acc["n"] + F.least(F.lit(window).cast("bigint"), s - acc["at"])).alias("n"))
        return let(pairs, lambda p: F.aggregate(starts(p), first, step, lambda acc: acc["n"]))

    return let(words, count)


def text_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: counts of the base rule, the signals, and the stratum."""
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    split = used.select(
        "doc_id",
        F.coalesce("lang", F.lit("und")).alias("stratum"),
        F.xxhash64(t).alias("text_key"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        chars("[#*$%&|<>]").cast("long").alias("n_symbols"),
        chars("!").alias("n_bangs"),
        chars("\\p{Lu}").alias("n_upper"),
    )
    counted = split.select(
        "doc_id",
        "stratum",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        "n_bangs",
        "n_upper",
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.select(
        "doc_id", "stratum", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_bangs", "word_chars").alias("bang_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("word_length"),
    )


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exact up to rounding; 1 where k is above the mean (never significant)."""
    log_odds = F.lit(alpha / (1 - alpha))
    first = F.struct((n * F.log1p(F.lit(-alpha))).alias("log"), F.exp(n * F.log1p(F.lit(-alpha))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.ln((n - i + 1) / i * log_odds)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * alpha, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda acc: acc["sum"]))


def first_step(rules: dict[str, tuple[float, ...]] = RULES) -> Column:
    """The first step that rejects a document; one past the last if none does."""
    passed = lambda signal, cutoffs: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c >= F.col(signal)))
    return F.least(*[passed(*rule) + 1 for rule in rules.items()])


def fit_steps(features: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """(stratum, step, n_good, k, p_value) of the strata with a step that passed."""
    last = len(next(iter(rules.values())))
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    labelled = features.filter("not base_failed").join(good, "doc_id").select("stratum", "text_key", "good", first_step(rules).alias("first"))
    texts = labelled.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), F.min("first").alias("first"))
    cells = texts.groupBy("stratum", "first").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
    strata = cells.groupBy("stratum").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("first", "good", "bad")).alias("cells"))
    #: a row a stratum from here on
    ranked = strata.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_good"), "stratum")))
    able = F.when(F.col("n_good") * F.log1p(F.lit(-risk)) <= F.ln(F.lit(delta) / F.col("rank")), F.col("rank")).otherwise(0)
    counted = ranked.withColumn("tested", F.max(able).over(Window.partitionBy())).filter("rank <= tested")
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(last))))
    summed = lambda what: F.aggregate(F.filter("cells", lambda c: c["first"] <= F.col("step")), F.lit(0).cast("bigint"), lambda a, c: a + c[what])
    tested = steps.withColumn("k", summed("good")).withColumn("gain", summed("bad") - F.col("k")).withColumn("p_value", binomial_tail(F.col("k"), F.col("n_good"), risk))
    order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("worst", F.max("p_value").over(order)).filter(F.col("worst") <= F.lit(delta) / F.col("tested")).filter("gain > 0")
    best = passed.withColumn("pick", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "step"))).filter("pick = 1")
    return best.select("stratum", "step", "n_good", "k", "p_value")


def judge_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Features, base_failed, failed_rule (the first of RULES that rejects, or null) and kept."""
    features = written(text_features(docs), "quality")
    chosen = fit_steps(features, labels, **options).limit(MAX_STRATA + 1).collect()
    if len(chosen) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    steps = F.create_map(*[x for r in chosen for x in (F.lit(r["stratum"]), F.lit(r["step"]))])[F.col("stratum")] if chosen else F.lit(None).cast("int")
    failed = F.lit(None).cast("string")
    for signal, cutoffs in reversed(options.get("rules", RULES).items()):
        cutoff = F.get(F.array(*[F.lit(float(c)) for c in cutoffs]), F.col("use_step") - 1)
        failed = F.when(F.col(signal) > cutoff, F.lit(signal)).otherwise(failed)
    judged = features.withColumn("use_step", steps).withColumn("failed_rule", failed).drop("use_step")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
