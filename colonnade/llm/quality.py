r"""Operator 2, quality rules with robust multivariate outliers, native.

Every document has word statistics and a vector of transformed ones. For each (lang, source) group, each language and all rows together,
a minimum covariance determinant estimate of centre and scatter is found: from STARTS starts (median and spread, all rows,
two random fifths) concentration steps keep the SHARE of the rows with the least Mahalanobis distances and estimate again, until no
determinant falls any more; the start with the least determinant counts, and a factor makes the scatter consistent for
normal rows. One formula holds for groups of every size: a group's estimate with the weight of its n rows is mixed with its
language's, which has the weight of PRIOR rows, and the language's likewise with that of all rows. Rows whose squared distance is
beyond the chi-square limit are rejected. Everything is DataFrame expressions: groups are aggregated with partial sums, and the
rows to keep come from counts over a fixed grid of bins, so the size or skew of a group does not matter.

Rows that fail the base rule take no part in the estimates. Null text has no words and fails the base rule; null lang and null
source are groups like any other. Repeated rows get equal verdicts. An empty table gives no row. Only doc_id, text, lang and
source are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.common import discard, materialize, text_of

SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT = 50, 50
DIMS = ("v1", "v2", "v3", "v4", "v5")
#: Starts, the most concentration steps, share of rows kept in a step, bins a unit of a log distance, rows that a wider estimate counts as.
STARTS, STEPS, SHARE, BINS, PRIOR = 4, 12, 0.75, 32, 30
#: Estimates (of some 200 bytes) that are broadcast at most, and the parts of a group beyond that.
MAX_BROADCAST, SALTS = 50_000, 32
#: A fall of a log determinant that counts, and the share of good rows that the limit may reject.
FALL, ALPHA = 1e-3, 1e-6
#: Added to each scatter's diagonal: the squared spread below which a statistic does not tell documents apart.
RIDGE = (0.05**2, 0.035**2, 0.13**2, 0.09**2, 0.05**2)


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution function with k degrees of freedom."""
    term = total = 1 / math.gamma(k / 2 + 1)
    i = 0
    while term > 1e-17 * total:
        i += 1
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < p else (lo, mid)
    return lo


#: Rejected beyond this squared distance, and what makes the scatter of the kept share consistent.
LIMIT = chi_square_quantile(1 - ALPHA, len(DIMS))
CONSISTENCY = SHARE / chi_square(chi_square_quantile(SHARE, len(DIMS)), len(DIMS) + 2)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_loud, n_lines of the column text."""
    t = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, F.array_remove(F.split(t, SPACES), "").alias("_w"), t.alias("_t"))
    lines = "filter(split(_t, '\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    one = base.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z!?]+", "")).cast("long").alias("n_loud"), F.expr(lines).alias("_l"),
    )
    side = ["word_chars", "n_symbols", "n_loud", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines")]
    three = one.select(*keep, "n_words", *side, F.expr("if(n_words < 3, array(), transform(sequence(2, size(_h) - 1), i -> xxhash64(_h[i - 2], _h[i - 1], _h[i])))").cast("array<bigint>").alias("_g"))
    side = ["word_chars", "n_symbols", "n_loud", "n_lines", "n_dup_lines"]
    # only texts in which a window comes twice are sorted
    order = three.select(*keep, "n_words", *side, F.expr("if(size(array_distinct(_g)) = size(_g), array(), sort_array(transform(_g, (h, i) -> struct(h, i))))").cast("array<struct<h: bigint, i: int>>").alias("_s"))
    twice = order.select(*keep, "n_words", *side, F.expr("sort_array(transform(filter(_s, (x, k) -> get(_s, k - 1).h <=> x.h or get(_s, k + 1).h <=> x.h), x -> x.i))").alias("_p"))
    covered = F.expr("if(size(_p) = 0, 0L, aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0L, (a, b) -> a + b))")
    return twice.select(*keep, "n_words", *side, covered.alias("n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """stats with its transformed vector v1..v5, base_failed and the names of its three groups."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    made = (F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_loud") / chars))
    named = lambda level, *cols: F.concat(F.lit(level), F.to_json(F.struct(*cols))) if cols else F.lit(level)
    groups = (named("0"), named("1", "lang"), named("2", "lang", "source"))
    return stats.select("*", *(c.alias(n) for c, n in zip(made, DIMS, strict=True)), base_failed().alias("base_failed"), *(g.alias(f"g{i}") for i, g in enumerate(groups)))


PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]
KEYS = ("gid", "start")
CENTRE, SCATTER = [f"m{i}" for i in range(5)], [f"s{i}{j}" for i, j in PAIRS]


def sums() -> list[F.Column]:
    return [F.count("*").alias("k"), *(F.sum(d).alias(f"t{i}") for i, d in enumerate(DIMS)), *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def moments(added: DataFrame, factor: float) -> DataFrame:
    """KEYS, n, the mean and factor times the covariance of the sums of k rows."""
    means = added.select(*KEYS, "n", *((F.col(f"t{i}") / F.col("k")).alias(f"m{i}") for i in range(5)), *((F.col(f"q{i}{j}") / F.col("k")).alias(f"q{i}{j}") for i, j in PAIRS))
    cov = {(i, j): F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    return means.select(*KEYS, "n", *CENTRE, *((factor * (F.greatest(c, F.lit(0.0)) if i == j else c)).alias(f"s{i}{j}") for (i, j), c in cov.items()))


def trimmed_moments(held: DataFrame, value: F.Column, share: float) -> DataFrame:
    """KEYS, n (rows of the group), mean and consistent covariance of the rows in the lowest bins of value that hold the share of the group, in one pass.

    Sums are kept per bin of the value's log, and partial before the shuffle; then whole bins are added up."""
    binned = held.withColumn("bin", F.floor(F.log(value + 1e-9) * BINS)).groupBy(*KEYS, "bin").agg(*sums())
    per = Window.partitionBy(*KEYS)  # over bins, of which there are under 2,000 a group
    run = binned.select("*", F.sum("k").over(per.orderBy("bin")).alias("upto"), F.sum("k").over(per).alias("n"))
    added = run.where(F.col("upto") - F.col("k") < share * F.col("n")).groupBy(*KEYS).agg(F.first("n").alias("n"), *(F.sum(c).alias(c) for c in ["k", *(f"t{i}" for i in range(5)), *(f"q{i}{j}" for i, j in PAIRS)]))
    return moments(added, CONSISTENCY)


def inverse(est: DataFrame) -> DataFrame:
    """est with the inverse l00.. of the lower Cholesky factor of the ridged scatter, and its log determinant."""
    keep = [c for c in est.columns if c not in SCATTER]
    held = est.select(*keep, *SCATTER, *((F.col(f"s{i}{j}") + (RIDGE[i] if i == j else 0.0)).alias(f"r{i}{j}") for i, j in PAIRS))
    for j in range(5):  # factor, a column at a time
        less = lambda i: reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(j), F.col(f"r{i}{j}"))  # noqa: B023
        held = held.withColumn(f"c{j}{j}", F.sqrt(F.greatest(less(j), F.lit(RIDGE[j] / 16))))
        held = held.withColumns({f"c{i}{j}": less(i) / F.col(f"c{j}{j}") for i in range(j + 1, 5)}) if j < 4 else held
    for i in range(5):  # invert the factor, a row at a time
        inner = lambda j: reduce(lambda a, b: a + b, [F.col(f"c{i}{k}") * F.col(f"l{k}{j}") for k in range(j, i)])  # noqa: B023
        held = held.withColumns({f"l{i}{j}": 1 / F.col(f"c{i}{i}") if i == j else -inner(j) / F.col(f"c{i}{i}") for j in range(i + 1)})
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"c{i}{i}") for i in range(5)])
    return held.select(*keep, *SCATTER, *(f"l{i}{j}" for i, j in PAIRS), logdet.alias("logdet"))


def distance() -> F.Column:
    """Squared Mahalanobis distance of v1.. from m0.., l00.."""
    parts = [reduce(lambda a, b: a + b, [F.col(f"l{i}{j}") * (F.col(DIMS[j]) - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(5)]
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def meet(rows: DataFrame, group: str, est: DataFrame, few: bool) -> DataFrame:
    """rows joined with the estimates (gid, ...) of their group. A few estimates (MAX_BROADCAST at most) are broadcast; more meet the rows in a join in which
    each group is split into SALTS parts, so that a group of any size is spread out."""
    est = est.withColumnRenamed("gid", "_gid")
    if few:
        return rows.join(F.broadcast(est), rows[group] == est["_gid"]).drop("_gid")
    some = rows.withColumn("_salt", F.pmod(F.xxhash64(*DIMS), F.lit(SALTS)))
    each = est.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return some.join(each, (some[group] == each["_gid"]) & (some["_salt"] == each["_part"])).drop("_gid", "_salt", "_part")


def starts(rows: DataFrame) -> DataFrame:
    """The first estimates of each group: 0 from median and quartiles, 1 from all rows, others from the rows of a hash's fifth, if there are any."""
    spread = rows.groupBy("gid").agg(F.count("*").alias("n"), *(F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, d in enumerate(DIMS)))
    scale = [F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) for i in range(5)]
    middle = spread.select("gid", F.lit(0).alias("start"), "n", *(F.col(f"p{i}")[1].alias(f"m{i}") for i in range(5)), *((scale[i] if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS))
    which = F.filter(F.array(*map(F.lit, range(1, STARTS))), lambda k: (k == 1) | (F.pmod(F.xxhash64(k, *DIMS), F.lit(5)) == 0))
    some = rows.select("gid", F.explode(which).alias("start"), *DIMS).groupBy("gid", "start").agg(*sums()).withColumn("n", F.col("k"))
    return middle.unionAll(moments(some, 1.0))


def estimates(rows: DataFrame) -> DataFrame:
    """gid, n, m0.., s00.. of the minimum covariance determinant estimate of each group gid of rows with v1..v5.

    Each start ends by itself, when a step does not lower its determinant any more, and takes no part in further steps."""
    est = materialize(inverse(starts(rows)).withColumn("falls", F.lit(True)), "estimates")
    fields, few = [c for c in est.columns if c not in KEYS], est.count() <= MAX_BROADCAST
    for step in range(STEPS):
        held = meet(rows, "gid", est.where("falls").drop("n", *SCATTER, "logdet", "falls"), few)
        new = inverse(trimmed_moments(held.select(*KEYS, *DIMS, distance().alias("d")), F.col("d"), SHARE)).withColumn("falls", F.lit(True))
        if step:
            found = new.select(*KEYS, F.struct(*(F.col(c) for c in fields)).alias("new"))
            better = F.coalesce(F.col("new.logdet") < F.col("logdet") - FALL, F.lit(False))
            new = est.join(found, [*KEYS], "left").select(*KEYS, *(F.when(better, F.col(f"new.{c}")).otherwise(F.lit(False) if c == "falls" else F.col(c)).alias(c) for c in fields))
        was, est = est, materialize(new, "estimates")
        discard(was)
        if step and est.where("falls").isEmpty():
            break
    best = est.groupBy("gid").agg(F.min_by(F.struct("n", *CENTRE, *SCATTER), F.struct("logdet", "start")).alias("e"))
    return best.select("gid", "e.*")


def shrunk(own: DataFrame, wide: DataFrame) -> DataFrame:
    """own (with the gid of its wider group as `up`), mixed with that group's estimate as if it stood on PRIOR rows."""
    fields = [*CENTRE, *SCATTER]
    w = wide.select(F.col("gid").alias("_up"), *(F.col(c).alias(f"w_{c}") for c in fields))
    mixed = lambda c: ((F.col("n") * F.col(c) + PRIOR * F.col(f"w_{c}")) / (F.col("n") + PRIOR)).alias(c)
    return own.join(w, own["up"] == w["_up"]).select("gid", "n", *map(mixed, fields))


def judge(rows: DataFrame) -> DataFrame:
    """rows of vectors(), written already, with distance (squared) and kept."""
    usable = rows.where("not base_failed")
    est = materialize(estimates(usable.select(F.explode(F.array("g0", "g1", "g2")).alias("gid"), *DIMS)), "estimates")
    tree = materialize(usable.select("g0", "g1", "g2").distinct(), "groups")
    of = lambda low, up: est.join(tree.select(F.col(low).alias("gid"), F.col(up).alias("up")).distinct(), "gid")
    languages = shrunk(of("g1", "g0"), est)
    final = materialize(inverse(shrunk(of("g2", "g1"), languages)).drop("n", *SCATTER, "logdet"), "final")
    known = meet(rows.where("not base_failed"), "g2", final, final.count() <= MAX_BROADCAST).select(*(rows[c] for c in rows.columns), distance().alias("distance"))
    failed = rows.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"))
    return known.unionAll(failed).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= LIMIT)).withColumn("kept", F.coalesce("kept", F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; further ones are the lines, the distance and the loud characters."""
    rows = materialize(vectors(statistics(text_of(docs, "doc_id", "text", "lang", "source"), "doc_id", "lang", "source")), "statistics")
    return judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_loud", "distance")


def base_digest(docs: DataFrame) -> DataFrame:
    """The counts and the base rule alone."""
    stats = statistics(text_of(docs, "doc_id", "text"), "doc_id")
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are kept; repeated rows stay or go together, null texts go, since they have no words. Each row is
    written beside its statistics, so that its verdict needs no join with it."""
    whole = docs.select(docs["text"], docs["lang"], docs["source"], F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    rows = materialize(vectors(statistics(whole, "_row", "lang", "source")), "statistics")
    return judge(rows).where("kept").select(*(F.col("_row")[c].alias(c) for c in docs.columns))
