"""Quality rules: base rules on a text's words, and robust multivariate outliers among the rest."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Aside, Stash

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics are rounded to 1 / UNIT and summed as integers, so that sums do not depend on their order.
UNIT = 4096
#: Scales below which no statistic's spread is taken to lie, in its own transformed unit: log words,
#: log mean word length, and the arcsine roots of the shares of symbols, repeated lines and repeated words.
LEAST_SCALE = (0.8, 0.08, 0.06, 0.15, 0.15)
DIMS = len(LEAST_SCALE)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
#: Share of a group that the estimate rests on, and documents a group needs.
SUBSET, LEAST_DOCS = 0.75, 50
#: Probability under normality of a squared distance within the bound for which documents are kept.
KEEP = 0.9999


def chi2_cdf(x: float, df: int) -> float:
    """Distribution function of chi-square, by the series of the lower incomplete gamma function."""
    a, h = df / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= h / (a + n)
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more, by one sort of the windows."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])), lambda x: x["i"]))
    covered = lambda at: F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: let(twice(s), covered)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counts = let(F.array_remove(F.split(text, SPACE), ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({
        "q_words": counts, "q_lines": by_line, "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumns({k: F.col(f"q_words.{k}") for k in ("n_words", "n_repeat_words")} | {k: F.col(f"q_lines.{k}") for k in ("n_lines", "n_dup_lines")}).drop("q_words", "q_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed() -> Column:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    values = (F.log("n_words"), F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return F.array(*[F.round(v * UNIT).cast("long") for v in values])


def factored(groups: DataFrame) -> DataFrame:
    """From the means m0.. and covariances c_i_j of each group and start, the Cholesky factor l_i_j, all in one
    row, and the logarithm of the determinant."""
    out = groups
    for i, j in sorted(PAIRS):
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = reduce(add, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(DIMS)])
    return out.select("q_lang", "q_source", "start", log_det.alias("log_det"), *[f"m{i}" for i in range(DIMS)], *[f"l_{i}_{j}" for i, j in PAIRS])


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from their group's estimate; others' d2 is null."""
    out = rows.join(estimate, ["q_lang", "q_source"], "left")
    for i in range(DIMS):
        rest = F.get("v", F.lit(i)) / F.lit(float(UNIT)) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = reduce(add, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)])
    return out.withColumn("d2", d2).drop(*[f"z{i}" for i in range(DIMS)], *[f"m{i}" for i in range(DIMS)], *[f"l_{i}_{j}" for i, j in PAIRS])


def floored(i: int, j: int, variance: Column) -> Column:
    return F.greatest(variance, F.lit(LEAST_SCALE[i] ** 2)) if i == j else variance


def mcd(rows: DataFrame) -> Stash:
    """Minimum covariance determinant of each group (q_lang, q_source) of vectors v, by concentration steps.

    A step takes the SUBSET of a group that is nearest by the last estimate, and estimates from it. The starts
    are the medians with quartile ranges (0), and the means and covariances of the middle half by every statistic (1)
    and of the documents whose every statistic lies within three scales of its median (2). Steps go on until no group's
    determinant falls by a thousandth; of a group's estimates that of least determinant stands. A step adds up moments by group, start
    and bin of distance, so that a group of any size is summed where its rows lie.
    """
    x = [F.get("v", F.lit(i)) for i in range(DIMS)]
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    centre = rows.groupBy("q_lang", "q_source").agg(*[F.percentile(x[i], at).alias(f"p{i}") for i in range(DIMS)])
    centre = centre.withColumns({f"m{i}": F.col(f"p{i}")[1] / UNIT for i in range(DIMS)} | {
        f"s{i}": F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / F.lit(1.349 * UNIT), F.lit(LEAST_SCALE[i])) for i in range(DIMS)})
    middle = Stash(centre.select("q_lang", "q_source", *[f"m{i}" for i in range(DIMS)], *[f"s{i}" for i in range(DIMS)]), "middle")
    moments = [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)], *[F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in PAIRS]]

    def estimated(total: DataFrame, widen: float) -> DataFrame:
        total = total.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(DIMS)})
        return factored(total.withColumns({f"c_{i}_{j}": floored(i, j, (F.col(f"s_{i}_{j}") / F.col("n") / F.lit(float(UNIT * UNIT)) - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(widen)) for i, j in PAIRS}))

    first = factored(middle.df.withColumns({"start": F.lit(0)} | {f"c_{i}_{j}": F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0) for i, j in PAIRS}))
    far = lambda i: F.abs(x[i] / F.lit(float(UNIT)) - F.col(f"m{i}")) / F.col(f"s{i}")
    near = rows.join(middle.side(), ["q_lang", "q_source"]).withColumn("far", F.greatest(*[far(i) for i in range(DIMS)]))
    inner = near.withColumn("start", F.explode(F.filter(F.array(F.when(F.col("far") <= 1.5, 1), F.when(F.col("far") <= 3, 2)), lambda s: s.isNotNull())))
    more = estimated(inner.groupBy("q_lang", "q_source", "start").agg(*moments).where(F.col("n") > 2 * DIMS), 1.0)
    begun = Stash(more, "starts")
    estimate = Stash(first.unionByName(begun.df).withColumn("moving", F.lit(True)), "mcd")
    begun.drop()
    # the determinants of the starts are of other subsets than the steps', and not compared with them
    compared = False
    widen = SUBSET / chi2_cdf(chi2_quantile(SUBSET, DIMS), DIMS + 2)
    keys = ("q_lang", "q_source", "start")
    while True:
        moving = estimate.df.where("moving")
        if not moving.limit(1).count():
            break
        binned = distances(rows, F.broadcast(moving) if estimate.bytes_in_memory() <= BROADCAST_BYTES else moving).where("d2 is not null").withColumn("bin", F.least(F.floor(16 * F.log2(1 + F.col("d2"))), F.lit(1023)).cast("int"))
        sums = Stash(binned.groupBy(*keys, "bin").agg(*moments), "sums")
        # at most 1024 bins a group, gathered without a window: the lowest bin whose running count holds SUBSET
        ordered = sums.df.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        cut = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("bin")), lambda a, b: F.when(a["n"] >= F.col("all_n") * SUBSET, a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["bin"].alias("bin"))), lambda a: a["bin"])
        inside = sums.df.join(ordered.select(*keys, cut.alias("cut")), list(keys)).where("bin <= cut")
        total = inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(DIMS)], *[f"s_{i}_{j}" for i, j in PAIRS]]])
        made = Stash(estimated(total, widen), "step")
        step = made.df.join(moving.select(*keys, F.col("log_det").alias("was")), list(keys))
        fell = step.where(F.col("log_det") < F.col("was") - 1e-3) if compared else step
        better = Stash(fell.drop("was").withColumn("moving", F.lit(True)), "mcd")
        still = estimate.df.join(better.side(*keys), list(keys), "left_anti").withColumn("moving", F.lit(False))
        done, estimate, compared = estimate, Stash(better.df.unionByName(still), "mcd"), True
        for old in (sums, made, better, done):
            old.drop()
    chosen = estimate.df.groupBy("q_lang", "q_source").agg(F.min(F.struct("log_det", "start")).alias("c")).select("q_lang", "q_source", F.col("c.start").alias("start"))
    out = Stash(estimate.df.join(chosen, list(keys)).drop("moving"), "mcd")
    estimate.drop()
    middle.drop()
    return out


def quality_rules(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Judge each document by the base rules, and those they leave by robust outlier distance.

    docs: text, lang, source and any other columns. Returned: those columns, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words (long), base_failed, distance2 double, estimate and kept. A document
    is kept if the base rules pass it and its squared Mahalanobis distance from the minimum covariance
    determinant estimate is within the chi-square quantile at keep. The estimate is that of its language and source
    ("source"); where these have under LEAST_DOCS passing documents, too few for one, that of all of the language's
    ("language"), else that of all documents ("all"). If these too are fewer, distance2 and estimate are
    null and the base rules decide alone.

    A null text has no words and fails. A null lang or source is a value of its own. Repeated rows are
    rows of their own; a distance on the bound is within it. A text is split and its windows sorted by one task, at about 100 bytes a word. Columns with the names
    returned are replaced; others may have any name. An empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    given = Aside(docs, [*names, "distance2", "estimate", "kept"])
    measured = text_statistics(given.df.withColumn("text", given.col("text"))).drop("text")
    own = lambda c: F.coalesce(F.concat(F.lit("="), given.col(c).cast("string")), F.lit(""))
    keyed = measured.withColumns({"q_lang": own("lang"), "q_own": own("source"), "v": F.when(~F.col("base_failed"), transformed())})
    # written once: the estimates read the vectors alone, and no text is split twice
    whole = Stash(keyed, "quality").df
    vectors = whole.where("v is not null").select("q_lang", "q_own", "v")
    sizes = Stash(vectors.groupBy("q_lang", "q_own").agg(F.count(F.lit(1)).alias("n")), "sizes")
    of_lang = sizes.df.groupBy("q_lang").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least_n"))
    total = of_lang.agg(F.sum("lang_n").alias("all_n"), F.min("lang_n").alias("least_lang")).first()
    all_n, least_lang = total["all_n"] or 0, total["least_lang"] or 0
    pair = lambda a, b: F.struct(a.alias("q_lang"), b.alias("q_source"))
    source, language, everything = pair(F.col("q_lang"), F.col("q_own")), pair(F.col("q_lang"), F.lit("(language)")), pair(F.lit("(all)"), F.lit("(all)"))
    judged = F.when(F.col("n") >= LEAST_DOCS, source).when(F.col("lang_n") >= LEAST_DOCS, language).when(F.lit(all_n >= LEAST_DOCS), everything)
    # a document counts in its source's estimate, and in those of its language and of all where some document is judged by them
    parts = F.array(F.when(F.col("n") >= LEAST_DOCS, source), F.when((F.col("least_n") < LEAST_DOCS) & (F.col("lang_n") >= LEAST_DOCS), language), F.when(F.lit(least_lang < LEAST_DOCS <= all_n), everything))
    groups = Stash(sizes.df.join(of_lang, "q_lang").select("q_lang", "q_own", judged.alias("judged"), F.filter(parts, lambda p: p.isNotNull()).alias("parts")), "groups")
    members = vectors.join(groups.side("q_lang", "q_own", "parts"), ["q_lang", "q_own"]).select("v", F.explode("parts").alias("p")).select("v", "p.q_lang", "p.q_source")
    estimate = mcd(members)
    placed = whole.join(groups.side("q_lang", "q_own", "judged"), ["q_lang", "q_own"], "left").drop("q_lang", "q_own").withColumns({"q_lang": F.col("judged.q_lang"), "q_source": F.col("judged.q_source")})
    out = distances(placed, estimate.side())
    kind = F.when(F.col("d2").isNull(), F.lit(None)).when(F.col("q_lang") == "(all)", "all").when(F.col("q_source") == "(language)", "language").otherwise("source")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(keep, DIMS), F.lit(True))
    return out.select(*given.back(), *names, F.col("d2").alias("distance2"), kind.alias("estimate"), kept.alias("kept"))
