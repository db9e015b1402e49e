r"""Operator 5, mixing sources to target weights by temperature, native.

A source of token share p has the weight p^a / sum p^a. H(a), the weights' entropy, falls as the exponent a grows; a is found by
bisection (a grid of ARMS points each turn, one small aggregate for all of them): the greatest a whose entropy is at least
target_entropy of the greatest possible, moved towards 1 where needed until the budget repeats no source more than max_repeats
times. At a = 1 every source is repeated budget / total times, the least that is possible; a budget beyond max_repeats times the
corpus is an error. The weights are then realised within the budget: a source's quota is whole passes over its documents
and a first part of one more, each pass in a random order of its own (a hash), and every copy gets a block such that each block of
block_tokens holds all sources in their weights, in random order.

The order within a source is a prefix sum over hash slices and within a slice, so a source of any size is spread out.
Tokens are words between spaces. Null text has no tokens and is in no pass. A null source is a source of its own.
Rows that are equal in all columns are documents of their own: each has its own places, spread over the slices. Rows that differ in
any column are told apart. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.common import fresh_name, materialize, row_marks, text_of

#: Share of the greatest entropy ln(sources) aimed at; most passes over a source; tokens a block; points a turn and turns.
TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, ARMS, TURNS = 0.985, 4.0, 250_000, 64, 4
#: Rows a hash slice should hold, and the most slices of a source (their sums are added up in one task).
SLICE_ROWS, MAX_SLICES = 2_000, 100_000
#: The greatest exponent looked at.
MAX_EXPONENT = 8.0


def exponent(shares: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> float:
    """shares: one row a source with its tokens (over 0). Between 0 and MAX_EXPONENT."""
    total = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).first()
    if not total.k:
        return 1.0
    passes = (budget or total.t) / total.t
    if passes > max_repeats + 1e-9:
        raise ValueError(f"a budget of {passes:.3g} times the tokens repeats some source more than {max_repeats:g} times whatever the weights")
    if total.k == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(total.t))

    def last(lo: float, hi: float, good: Callable[[float, float], bool]) -> float:
        """The point of the way from lo, where good(entropy, repeats) holds, to hi up to which it holds."""
        for _ in range(TURNS):
            arms = [lo + (hi - lo) * i / ARMS for i in range(ARMS + 1)]
            each = shares.select("tokens", F.explode(F.array(*map(F.lit, arms))).alias("a")).select("a", p.alias("p"), F.pow(p, F.col("a")).alias("w"))
            seen = each.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("e"), F.max(F.col("w") / F.col("p")).alias("r")).collect()  # ARMS + 1 rows
            passed = {r.a: good(math.log(r.z) - r.e / r.z, passes * r.r / r.z) for r in seen}
            best = 0
            while best < ARMS and passed[arms[best + 1]]:
                best += 1
            lo, hi = arms[best], arms[min(best + 1, ARMS)]
            if lo == hi:
                break
        return lo

    aim = last(0.0, MAX_EXPONENT, lambda h, r: h >= target_entropy * math.log(total.k))
    return last(1.0, aim, lambda h, r: r <= max_repeats + 1e-9)


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and the two marks of every row with a token, written; key tells rows of equal marks apart."""
    a, b = row_marks(docs)
    words = F.size(F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    rows = docs.select(docs["doc_id"], docs["source"], words.alias("n_tokens"), a.alias("mark_a"), b.alias("mark_b"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "tokens").where("n_tokens > 0")
    again = materialize(rows.groupBy("mark_a", "mark_b").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    key = F.xxhash64("mark_a", "mark_b")
    if again.isEmpty():
        return rows.select("*", key.alias("key"))
    found = rows.join(again, ["mark_a", "mark_b"], "left")
    return found.select(*rows.columns, F.when(F.col("n").isNull(), key).otherwise(F.xxhash64("mark_a", "mark_b", "row")).alias("key"))


def places(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, n_tokens, mark_a, mark_b, pass (from 0), block and spot (the order within the block) of every copy."""
    rows = token_rows(docs)
    shares = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "shares")
    total = shares.agg(F.sum("tokens").alias("t")).first().t or 0
    budget = budget or total
    a = exponent(shares, target_entropy, max_repeats, budget)
    z = shares.agg(F.sum(F.pow(F.col("tokens") / float(max(total, 1)), F.lit(a)))).first()[0] or 1.0
    quota = F.floor(F.lit(float(budget) / z) * F.pow(F.col("tokens") / float(max(total, 1)), F.lit(a)))
    plan = shares.select(F.col("source").alias("_source"), "tokens", quota.alias("quota"), F.least(F.lit(MAX_SLICES), F.greatest(F.lit(1), F.ceil(F.col("docs") / SLICE_ROWS))).alias("slices"))
    each = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("quota") / F.col("tokens")))).alias("pass"))
    # where a document stands in a pass: slices of the hash, then within the slice
    h = F.xxhash64("key", "pass")
    each = each.withColumn("h", h).withColumn("slice", F.pmod(F.shiftrightunsigned("h", 32), F.col("slices")))
    slot = ["source", "pass", "slice"]
    sums = each.groupBy(*slot).agg(F.sum("n_tokens").alias("held"))
    before = sums.select(*(F.col(k).alias(f"_{k}") for k in slot), (F.sum("held").over(Window.partitionBy("source", "pass").orderBy("slice")) - F.col("held")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*slot).orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("inside", inside)
    each = each.join(before, each["source"].eqNullSafe(before["_source"]) & (each["pass"] == before["_pass"]) & (each["slice"] == before["_slice"]))
    upto = F.col("pass") * F.col("tokens") + F.col("before") + F.col("inside")
    taken = each.withColumn("upto", upto).where("upto <= quota")
    blocks = max(1, -(-int(budget) // block_tokens))
    block = F.least(F.floor((F.col("upto") - F.col("n_tokens")) * blocks / F.col("quota")), F.lit(blocks - 1))
    return taken.select("doc_id", "source", "n_tokens", "mark_a", "mark_b", "pass", block.alias("block"), F.xxhash64("key", "pass", F.lit(17)).alias("spot"))


def digest(docs: DataFrame) -> DataFrame:
    """Every copy of a document in the mixture, and its place."""
    return places(text_of(docs, "doc_id", "source", "text")).select("doc_id", "source", "n_tokens", F.col("pass").alias("epoch"), "block", F.col("spot").alias("order_in_block"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, as often as the mixture has them, in its order: partition after partition, by block and by spot within it.

    Rows that are equal in all columns can stand for each other, so one of them meets the places of all of them."""
    a, b, m, n, block, spot, held = (fresh_name(docs.columns, c) for c in ("mark_1", "mark_2", "found_1", "found_2", "block_no", "spot_no", "row_of"))
    found = materialize(places(docs, **how).select(F.col("mark_a").alias(m), F.col("mark_b").alias(n), F.col("block").alias(block), F.col("spot").alias(spot)), "places")
    mark_a, mark_b = row_marks(docs)
    marked = docs.withColumns({a: mark_a, b: mark_b})
    again = materialize(marked.groupBy(a, b).agg(F.count("*").alias(held)).where(F.col(held) > 1).select(F.col(a).alias(m), F.col(b).alias(n)), "repeated")
    same = (F.col(a) == F.col(m)) & (F.col(b) == F.col(n))
    if not again.isEmpty():
        once = marked.join(again, same, "left_semi").groupBy(a, b).agg(F.first(F.struct(*(marked[f"`{c}`"] for c in docs.columns))).alias(held))
        marked = marked.join(again, same, "left_anti").unionAll(once.select(*(F.col(held)[c].alias(c) for c in docs.columns), a, b))
    out = marked.join(found, same)
    ordered = out.repartitionByRange(F.col(block), F.col(spot)).sortWithinPartitions(block, spot)
    return ordered.select(*(F.col(f"`{c}`") for c in docs.columns))
