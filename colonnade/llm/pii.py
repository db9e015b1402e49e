r"""Operator 4, personal data by bootstrapped contextual extraction, native.

Base spans (email, ip, card, phone) come from fixed patterns. They are the seeds of a bootstrap: tokens that look like
identifiers (three digits or more, or an @) are instances; the word before them, the two words before them, the word behind them and
the words on both sides are lexical patterns, and (pattern, instance) pairs are the edges of a graph. In each round a pattern's
confidence is the mean score of its instances, one added that is not personal, and an instance's score is what its patterns make
probable. Instances that reach MIN_CONFIDENCE count as seeds in later rounds, so the bootstrap goes over several hops. Patterns that
stay confident with enough seeds mark further instances as spans of the kind `context`.

Context words come from the text itself, other identifiers included: the CONTEXT characters on either side of a token, in lower case,
digits as 0, and of each word the WORD_CHARACTERS next to the token.

Offsets are code points. A match is marked with a private character on both sides and the text is split there; that
character in a text is first replaced by another one of its kind, which no pattern can match either. Everything is DataFrame expressions.

Null text counts as empty and has no spans. Repeated rows get equal spans. An empty table gives no row. Only doc_id and
text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\ue000", "\ue001"
#: Java forms of the base patterns: possessive, and started only where a leftmost match can start, so long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^@\x20\x09-\x0D]*+@|(?:[^0-9\x20\x09-\x0D]*+[0-9]){3})[^\x20\x09-\x0D]++"
#: Rounds; what a pattern needs to discover: seeds among its instances, and confidence; the characters on either side and of a word.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, CONTEXT, WORD_CHARACTERS = 4, 4, 0.8, 120, 40
#: Pieces whose lengths are added up at once.
STRIDE = 64


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marked(pattern: str, also: str = "") -> str:
    """SQL for array<struct<s, m, ...>> of the matches of pattern in _t: start, text, and further fields over i, p (the pieces).

    A start is the sum of the lengths of the pieces before it: of whole blocks of blocks (r), of the blocks before it in its own (q) and of the
    pieces before it in its block (n), so the work for a match does not grow with the number of matches."""
    add = "(a, x) -> a + x"
    pieces = f"split(regexp_replace(_t, {quoted(pattern)}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    sums = lambda of: f"transform(sequence(0, (size({of}) - 1) div {STRIDE}), b -> aggregate(slice({of}, b * {STRIDE} + 1, {STRIDE}), 0, {add}))"
    prefix = f"transform(sequence(0, size(w) - 1), j -> aggregate(slice(w, 1, j), 0, {add}))"
    upto = lambda of, at: f"aggregate(slice({of}, ({at} div {STRIDE}) * {STRIDE} + 1, {at} % {STRIDE}), 0, {add})"
    start = f"r[i div {STRIDE * STRIDE}] + {upto('q', f'(i div {STRIDE})')} + {upto('n', 'i')}"
    spans = f"transform(sequence(1, size(p) - 2, 2), i -> named_struct('s', {start}, 'm', p[i]{also}))"
    let = spans
    for name, made in (("r", prefix), ("w", sums("q")), ("q", sums("n")), ("n", "transform(p, x -> length(x))")):
        let = f"transform(array({made}), {name} -> {let})[0]"
    return f"transform(array({pieces}), p -> if(size(p) < 3, null, {let}))[0]"


def luhn(d: str) -> str:
    digit = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (a, k) -> a + if(k % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0"


def sound(kind: str) -> str:
    """SQL over the match m.m: whether it stands."""
    digits = "regexp_replace(m.m, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"m.m rlike {quoted(IP)}"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return f"length({digits}) between 13 and 19 and transform(array({digits}), d -> {luhn('d')})[0]"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind number, kind, s, e) and cands (identifier-like tokens with their contexts and whether a base span meets them)."""
    texts = text_of(docs, "doc_id", "text").select("doc_id", F.translate(F.coalesce("text", F.lit("")), MARK, OTHER).alias("_t"))
    only = {"email": "contains(_t, '@')", "phone": "contains(_t, '+')"}
    # a token without digits or @ in the whole text needs no search at all
    found = {k: f"if({only.get(k, '_d')}, {marked(p)}, null)" for k, p in PATTERNS.items()}
    # the text on either side: a few pieces, of which all but the nearest are tokens or what stands between them
    near = lambda side, order: f"{side}(concat({', '.join(f'coalesce(get(p, i + ({k})), {chr(39) * 2})' for k in order)}), {CONTEXT})"
    sides = f", 'a', {near('right', (-5, -4, -3, -2, -1))}, 'b', {near('left', (1, 2, 3, 4, 5))}"
    texts = texts.withColumn("_d", F.expr("_t rlike '[0-9]'"))
    one = texts.select("doc_id", *(F.expr(v).alias(k) for k, v in found.items()), F.expr(f"if(_d or contains(_t, '@'), {marked(TOKEN, sides)}, null)").alias("tokens"))
    each = [f"transform(filter(coalesce({k}, array()), m -> {sound(k)}), m -> named_struct('o', {i}, 'kind', '{k}', 's', m.s, 'e', m.s + length(m.m)))" for i, k in enumerate(KINDS)]
    two = one.select("doc_id", F.expr(f"concat({', '.join(each)})").alias("base"), "tokens")
    head, trimmed = "length(regexp_extract(m.m, '^[^0-9A-Za-z]*', 0))", "regexp_replace(m.m, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '')"
    clean = lambda x: f"regexp_replace(lower({x}), '[0-9]', '0')"
    word = lambda of, n, cut: f"{cut}(coalesce(try_element_at({of}, {n}), ''), {WORD_CHARACTERS})"
    split = lambda side: f"regexp_extract_all({clean('m.' + side)}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    made = f"named_struct('l1', {word('l', -1, 'right')}, 'l2', {word('l', -2, 'right')}, 'r1', {word('r', 1, 'left')})"
    context = f"transform(array({split('a')}), l -> transform(array({split('b')}), r -> {made})[0])[0]"
    cands = f"transform(coalesce(tokens, array()), m -> named_struct('s', m.s + {head}, 'e', m.s + {head} + length({trimmed}), 'token', lower({trimmed}), 'x', {context}))"
    three = two.select("doc_id", "base", F.expr(cands).alias("cands"))
    return three.select("doc_id", "base", F.expr("transform(cands, c -> named_struct('s', c.s, 'e', c.e, 'token', c.token, 'x', c.x, 'seed', exists(base, b -> b.s < c.e and b.e > c.s)))").alias("cands"))


def confident_patterns(spots: DataFrame) -> DataFrame:
    """spots: pattern, token, seed of every occurrence. The patterns that may discover, with their confidence."""
    edges = materialize(spots.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
    scores = None
    for k in range(ROUNDS):
        known = edges.withColumn("score", F.col("seed").cast("double")) if scores is None else edges.join(scores, "token")
        patterns = known.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("score") >= MIN_CONFIDENCE).alias("seeds")).where(f"seeds >= {MIN_SEEDS}")
        patterns = materialize(patterns, "patterns")
        if k + 1 < ROUNDS:
            held = edges.join(patterns, "pattern", "left")
            doubt = F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999))))
            scores = materialize(held.groupBy("token").agg(F.max("seed").alias("known"), (1 - F.exp(doubt)).alias("made")).select("token", F.when(F.col("known"), 1.0).otherwise(F.col("made")).alias("score")), "scores")
    return patterns.where(f"confidence >= {MIN_CONFIDENCE}")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of o, kind, s, e; by kind and start) of every row; o is under 4 for base spans."""
    rows = materialize(base_spans(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "cands"), "spans")
    each = rows.where("size(cands) > 0").select("row", F.explode("cands").alias("c")).select("row", "c.*")
    l1, l2, r1 = (F.col(f"x.{k}") for k in ("l1", "l2", "r1"))
    patterns = (F.when(l1 != "", F.concat_ws(" ", l1, F.lit("_"))), F.when(l2 != "", F.concat_ws(" ", l2, l1, F.lit("_"))), F.when(r1 != "", F.concat_ws(" ", F.lit("_"), r1)), F.when((l1 != "") & (r1 != ""), F.concat_ws(" ", l1, F.lit("_"), r1)))
    spots = each.select("row", "s", "e", "token", "seed", F.explode(F.array(*patterns)).alias("pattern")).where("pattern is not null and token != ''")
    good = confident_patterns(spots).select("pattern")
    more = spots.where("not seed").join(good, "pattern").groupBy("row").agg(F.collect_set(F.struct(F.lit(len(KINDS)).alias("o"), F.lit("context").alias("kind"), "s", "e")).alias("more"))
    both = rows.select("row", "doc_id", "base").join(more, "row", "left")
    order = F.sort_array(F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<o: int, kind: string, s: int, e: int>>"))), lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return both.select("doc_id", order.alias("spans"))


def base_digest(docs: DataFrame) -> DataFrame:
    """The counts of base spans alone."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return base_spans(docs).select("doc_id", *map(count, KINDS))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of find_pii()."""
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["o"] < len(KINDS))
    return find_pii(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("context"), F.size("spans").cast("long").alias("n_spans"))
