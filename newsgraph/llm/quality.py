"""Quality rules: robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.llm.common import BLANKS, small, words_of, written

#: Rejects beyond the 1 - 1e-10 quantile of the chi-square distribution with 3 degrees of freedom.
CUTOFF = 50.0
#: Share of a group's rows that the estimate rests on.
SUPPORT = 0.75
#: The spread of each statistic that counts as one unit, and the rows such units are worth.
UNITS = {"x1": 0.12, "x2": 0.08, "x3": 0.10}
PRIOR_ROWS = 50
#: Words of usual length that are added to every text, so that statistics of short texts vary less.
PRIOR_WORDS = 50
#: Distances fall into bins; this many per doubling.
BINS = 16
STEPS = 4
P = len(UNITS)


def text_statistics(text: Column) -> dict[str, Column]:
    """Words, their code points, symbols, capitals A-Z, and the lines with a word."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return {
        "words": words_of(text),
        "word_chars": (F.length(text) - F.length(F.regexp_replace(text, f"[^{BLANKS}]+", ""))).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
        "lines": lines,
    }


def with_repeats(df: DataFrame, words: str, out: str, window: int = 8) -> DataFrame:
    """Adds the number of words inside windows that occur twice or more.

    Window hashes decide first whether any window repeats; only then are the
    windows compared as text, sorted next to their equals.
    """
    n = F.size(words)
    starts = F.when(n > window, F.sequence(F.lit(1), n - window + 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_starts", starts)
    df = df.withColumn("_windows", F.transform("_starts", lambda i: F.xxhash64(F.slice("_hashes", i, window))))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(again, F.sort_array(F.transform(
        "_starts", lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("i"))))))
    count = F.size("_sorted")
    twice = F.filter("_sorted", lambda e, j: (
        (j > 0) & (F.get("_sorted", j - 1)["w"] == e["w"])) | (
        (j < count - 1) & (F.get("_sorted", j + 1)["w"] == e["w"])))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.coalesce(
            F.least(F.lit(window), F.get("_at", j + 1) - p), F.lit(window))),
        F.lit(0), lambda a, b: a + b)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_hashes", "_starts", "_windows", "_sorted", "_at")


def measured(docs: DataFrame, id_column: str, text_column: str, lang: str, source: str) -> DataFrame:
    """(doc_id, text_key, lang, source, n_words, word_chars, n_symbols, n_capitals, n_dup_lines, n_repeat_words)."""
    text = F.col(text_column)
    s = text_statistics(text)
    df = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        s["words"].alias("_words"), s["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"), s["n_capitals"].alias("n_capitals"), s["lines"].alias("_lines"))
    df = with_repeats(df, "_words", "n_repeat_words")
    return df.select(
        "doc_id", "text_key", "lang", "source", F.size("_words").cast("long").alias("n_words"), "word_chars",
        "n_symbols", "n_capitals", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words")


def _transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector: log of mean word length, roots of the shares of symbols
    and of capitals - each over the text plus PRIOR_WORDS usual words. Repeats are
    left to the base rule: a clean text may well repeat a line."""
    n = F.col("n_words") + PRIOR_WORDS
    return (
        stats.withColumn("x1", F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / n))
        .withColumn("x2", F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 5 * PRIOR_WORDS)))
        .withColumn("x3", F.sqrt(F.col("n_capitals") / (F.col("word_chars") + 5 * PRIOR_WORDS))))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]


def _estimate(sums: DataFrame) -> DataFrame:
    """Mean m_i and Cholesky factor l_ij per group from sums of the kept rows. The
    prior rows have unit spread, so no statistic is without spread and small
    groups stay near the units."""
    df = sums
    n = F.col("n")
    for i in range(1, P + 1):
        df = df.withColumn(f"m{i}", F.col(f"s{i}") / n)
    for i, j in _pairs():
        c = F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / n
        df = df.withColumn(f"c{i}{j}", (c + (PRIOR_ROWS if i == j else 0)) / (n + PRIOR_ROWS))
    for i, j in _pairs():
        rest = F.col(f"c{i}{j}")
        for k in range(1, j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(1, P + 1):
        det = det * F.col(f"l{i}{i}")
    return df.withColumn("det", det).select(
        "grp", "start", "det", *[f"m{i}" for i in range(1, P + 1)], *[f"l{i}{j}" for i, j in _pairs()])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(1, P + 1):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(1, i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = F.lit(0.0)
    for i in range(1, P + 1):
        d2 = d2 + F.col(f"y{i}") * F.col(f"y{i}")
    return df.withColumn("d2", d2)


def mcd_distances(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """``vectors`` (grp, z1..zp, other columns) with d2 from the group's
    minimum-covariance-determinant estimate.

    Two starts per group: mean and covariance of all rows, and the median with
    unit covariance. A concentration step keeps the rows nearest to the present
    estimate, ``support`` of the group up to the width of a distance bin, and
    estimates anew; rows are summed per group and bin before the exchange, so a
    group of any size costs its bins. The start with the smaller determinant
    wins. All rows count.
    """
    sums = [F.count("*").alias("n")]
    sums += [F.sum(f"z{i}").alias(f"s{i}") for i in range(1, P + 1)]
    sums += [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in _pairs()]
    names = ["n", *[f"s{i}" for i in range(1, P + 1)], *[f"q{i}{j}" for i, j in _pairs()]]
    mean = _estimate(vectors.groupBy("grp").agg(*sums).withColumn("start", F.lit(0)))
    zero = {f"l{i}{j}": F.lit(1.0 if i == j else 0.0) for i, j in _pairs()}
    median = vectors.groupBy("grp").agg(
        *[F.percentile_approx(f"z{i}", 0.5).alias(f"m{i}") for i in range(1, P + 1)]
    ).withColumns({"start": F.lit(1), "det": F.lit(1.0), **zero}).select(*mean.columns)
    now = written(mean.unionByName(median), "estimates")
    for _ in range(steps):
        near = _distance(vectors.join(now, "grp"))
        bins = near.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS)).groupBy("grp", "start", "bin").agg(*sums)
        group = Window.partitionBy("grp", "start")
        upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        inside = bins.withColumn("all", F.sum("n").over(group)).withColumn(
            "below", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("below") < F.ceil(F.col("all") * support))
        now = written(_estimate(inside.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names])), "estimates")
    best = now.groupBy("grp").agg(F.min_by(F.struct(*[c for c in now.columns if c != "grp"]), F.struct("det", "start")).alias("e"))
    # one row per group: written, so that its size decides how it meets the documents
    best = small(written(best.select("grp", "e.*").drop("start", "det"), "best"), 200)
    kept = [c for c in vectors.columns if c != "grp"]
    return _distance(vectors.join(best, "grp")).select("grp", *kept, "d2")


def judged_quality(docs: DataFrame, cutoff: float = CUTOFF, id_column: str = "doc_id", text_column: str = "text",
                   lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: the statistics, base_failed, d2 and kept.

    base_failed: fewer than 20 words, or more than 30 percent of them repeated.
    Of the others those are kept whose transformed statistics lie within
    ``cutoff`` (squared Mahalanobis distance) of the estimate for their language
    and source; null languages and sources are values of their own. The
    estimates rest on all rows. Null, empty and blank texts have no words and
    fail. Repeated rows are judged alike; other columns are ignored.
    """
    stats = written(measured(docs, id_column, text_column, lang, source), "statistics")
    vectors = _transformed(stats).withColumn("grp", F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(),
                                                             F.coalesce("source", F.lit("")), F.col("source").isNull()))
    for i, (name, unit) in enumerate(UNITS.items(), 1):
        vectors = vectors.withColumn(f"z{i}", F.col(name) / unit)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        mcd_distances(vectors.drop("x1", "x2", "x3"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= cutoff))
        .select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "d2", "kept"))
