"""The text operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colonnade.llm import common, decontaminate, language, lm_score, mixing, near_dup, pii, quality, queries, secrets, token_binary, toxicity
from tests import oracle

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(3000)]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves.
CLASHES = ("node", "key", "bucket", "n", "w", "row", "comp", "bag", "bands", "_t", "_w", "level", "distance", "kept", "value", "pass", "block", "spot", "m0", "jk", "row_hash", "mark", "Row_Key", "token", "place", "kind", "tokens", "grade")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, lang="en", source="a", clash=True):
    """Documents of texts (or of (doc_id, text) pairs), with extra columns of clashing names."""
    rows = [(*(t if isinstance(t, tuple) else (i, t)), lang, source, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, FIELDS)
    return df.withColumns({c: F.lit(1) for c in CLASHES}) if clash else df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def bench_of(spark, *items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").withColumn("n", F.lit(1))


DIGESTS = {
    "op1": lambda d: secrets.digest(d), "op2": lambda d: quality.digest(d), "op3": lambda d: decontaminate.digest(d, bench_of(d.sparkSession, "one two three")), "op4": lambda d: pii.digest(d), "op5": lambda d: mixing.digest(d),
    "op6": lambda d: language.digest(d), "op7": lambda d: near_dup.digest(d), "op8": lambda d: token_binary.digest(d), "op9": lambda d: lm_score.digest(d),
    "op10": lambda d: toxicity.digest(d, d.sparkSession.createDataFrame([(0, 1, 1), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows(spark, name):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names: a row comes back for each (the mixture has none for texts without words)."""
    odd = [None, "", " \n\t", "###", prose(30_000), "one two three", "é漢字 ß", "a" * 50_000, "same text here again", "same text here again"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(odd)] + [(None, None, None, None, None), (None, "no id at all", None, None, None), (4, odd[4], "en", "s", None), (8, odd[8], None, None, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    got = DIGESTS[name](df).collect()
    if name == "op5":
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r.n_tokens > 0 for r in got)
    else:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert DIGESTS[name](df.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.oracle_sql() if n.startswith("base_")])
def test_base_columns_match_sql(spark, name):
    oracle.check(oracle.connect(MEDIUM), queries.queries()[name](spark, MEDIUM), queries.oracle_sql()[name])


# 1 ------------------------------------------------------------------------------------------------------------------


def base_secrets(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(1)) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets_match_base_rules(spark, docs, texts):
    more = ["password=short PASSWORD = 'abcdef1' token:x", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "é" * 5 + "0123456789abcdef01234567", "api_key: a=b=c=d", "KKey apiKey=abcdefgh"]
    for source, known in ((docs, texts), (frame(spark, more), dict(enumerate(more)))):
        for r in secrets.digest(source).collect():
            base = base_secrets(known[r.doc_id] or "")
            assert r.base_sha256 == secrets.sha(base)
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in base) for k in secrets.KINDS[:3]]
            assert set(x for x in r.spans.split(",") if x and not x.startswith("literal")) == {f"{k}:{s}:{e}" for s, e, k in base}


@pytest.mark.parametrize(
    ("text", "secret"),
    [("cfg.k = 'Zx81!qPw0Lr5'\nbearer: cfg.k", "Zx81!qPw0Lr5"), ("[db]\nk = Zx81!qPw0Lr5\nclient_secret_value = db.k", "Zx81!qPw0Lr5"), ('settings["db_passphrase"] = "x9F!kq27Lm0z"', "x9F!kq27Lm0z"), ('private_key = """-----BEGIN\nx9F!kq27Lm0z"""', "-----BEGIN\nx9F!kq27Lm0z"), ("passphrase = b'x9F!kq27Lm0z'", "x9F!kq27Lm0z"), ("db_passphrase = \"x9F!kq27Lm0z\"", "x9F!kq27Lm0z"), ("k = 'Zx81!qPw0Lr5'\nclient_secret_value = k", "Zx81!qPw0Lr5"), ("auth.credentials: pQ7-zz81xL0a", "pQ7-zz81xL0a"), ("signing_key = 'ab12!CDe' + '34fg!HIj'", "34fg!HIj"), ("title = \"x9F!kq27Lm0z\"", None), ("password = \"changeme-example\"", None), ("the token = something", None)],
)
def test_secrets_follow_assignments(text, secret):
    found = [text[s:e] for s, e, k in secrets.find_spans(text) if k == "literal"]
    assert secret in found if secret else not found


@pytest.mark.parametrize("size", [40, 512, 513, 5000])
@pytest.mark.parametrize("form", ['private_key = "{}"', "bearer: '{}'", "credentials={}", 'x = "{}"\npassphrase = x', 'passphrase = "a" + "{}"', 'auth_token_pwd = "ab\\"{}"'])
def test_secrets_of_any_length(form, size):
    rng = random.Random(size)
    secret = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(size)).replace("x", "y").replace("X", "Y")
    text = form.format(secret) + " end"
    at = text.index(secret)
    assert any(s <= at and e >= at + size and k == "literal" for s, e, k in secrets.find_spans(text))


def test_secrets_beyond_the_base_rules(spark):
    """Planted secrets under names that no base rule knows, among as many harmless assignments: all are found, and no other text."""
    rng = random.Random(17)
    value = lambda: "".join(rng.choice("abcdefghjkmnpqrstuvwyzABCDEFGHJKMNPQRSTUVWYZ0123456789") for _ in range(rng.randrange(14, 40)))
    names, harmless = ["db_passphrase", "authBearer", "private_key", "credentials", "cfg.signing.private.key", "x" * 200 + "_pwd"], ["title", "color", "path", "version", "user", "monkey_count"]
    texts, planted = [], []
    for i in range(240):
        name, v = rng.choice(names if i % 2 else harmless), value()
        texts.append(f"{prose(8, rng)}\n{name} = '{v}'\n{prose(8, rng)}")
        planted.append({texts[-1].index(v)} if i % 2 else set())
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    assert not any(base_secrets(t) for t in texts)
    assert all({x.start for x in got[i].spans} == planted[i] for i in range(240))



# 2 ------------------------------------------------------------------------------------------------------------------


def brute_quality(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w, lines = SPACED.findall(text), [x for x in text.split("\n") if SPACED.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, docs, texts):
    more = ["a b c a b c a b c x", "x x x x", "# a\n# a\n\n \n# a", "a\x0bb c d", "é漢 | é漢"]
    for source, known in ((docs, texts), (frame(spark, more), dict(enumerate(more)))):
        for r in quality.digest(source).collect():
            n = brute_quality(known[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.kept and r.base_failed)


def test_quality_rejects_outliers(spark):
    rng = random.Random(2)
    good = [prose(rng.randrange(80, 400), rng) for _ in range(300)]
    junk = [" ".join("#$%&*|" * 3 + str(rng.random()) for _ in range(90)) for _ in range(6)] + ["AAAA!!!! " * 2 + " ".join(str(rng.random()) * 6 for _ in range(80)) for _ in range(6)]
    got = {r.doc_id: r for r in quality.digest(frame(spark, good + junk)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 312))
    kept = quality.keep_good(frame(spark, good + junk))
    assert kept.count() == 300 and set(CLASHES) <= set(kept.columns)


def numpy_estimates(x: np.ndarray, starts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The minimum covariance determinant estimate of the rows x from some starts: plain concentration steps."""
    found = []
    for centre, scatter in starts:
        last = np.inf
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter + np.diag(quality.RIDGE)), x - centre)
            spot = np.floor(np.log(d + 1e-9) * quality.BINS)
            kept = x[spot <= np.sort(spot)[math.ceil(quality.SHARE * len(x)) - 1]]
            middle = kept.mean(axis=0)
            spread = quality.CONSISTENCY * ((kept - middle).T @ (kept - middle) / len(kept))
            volume = np.linalg.slogdet(spread + np.diag(quality.RIDGE))[1]
            if volume >= last - quality.FALL:
                break
            centre, scatter, last = middle, spread, volume
        found.append((last, centre, scatter))
    return min(found, key=lambda f: f[0])[1:]


@pytest.mark.parametrize("broadcast", [quality.MAX_BROADCAST, 0])
def test_quality_matches_numpy(spark, monkeypatch, broadcast):
    """Verdicts of groups of 5 to 500 rows, with planted outliers, against a plain estimate in numpy with the same shrinkage."""
    monkeypatch.setattr(quality, "MAX_BROADCAST", broadcast)
    rng, rows = np.random.default_rng(4), []
    for lang, source, n in (("en", "a", 500), ("en", "b", 60), ("en", None, 5), ("fr", "a", 25), (None, "a", 9)):
        x = rng.normal(size=(n, 5)) * [0.2, 0.1, 0.1, 0.1, 0.1] + rng.normal(size=5)
        x[: n // 6] += rng.normal(size=(n // 6, 5)) * 3 + 4
        rows += [(*map(float, r), lang, source, False) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{d} double" for d in quality.DIMS) + ", lang string, source string, base_failed boolean")
    named = lambda level, *cols: F.concat(F.lit(level), F.to_json(F.struct(*cols))) if cols else F.lit(level)
    df = common.materialize(df.withColumns({"g0": named("0"), "g1": named("1", "lang"), "g2": named("2", "lang", "source")}), "vectors")
    each = df.select(F.explode(F.array("g0", "g1", "g2")).alias("gid"), *quality.DIMS)
    starts, members = {}, {}
    for r in quality.starts(each).collect():
        scatter = np.array([[r[f"s{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
        starts.setdefault(r.gid, []).append((r.start, (np.array([r[f"m{i}"] for i in range(5)]), scatter)))
    for r in each.collect():
        members.setdefault(r.gid, []).append([r[d] for d in quality.DIMS])
    plain = {g: numpy_estimates(np.array(members[g]), [x for _, x in sorted(starts[g], key=lambda s: s[0])]) for g in members}
    mixed = lambda own, wide, n: tuple((n * a + quality.PRIOR * b) / (n + quality.PRIOR) for a, b in zip(own, wide, strict=True))
    verdicts = {True: 0, False: 0}
    for r in quality.judge(df).collect():
        language = mixed(plain[r.g1], plain[r.g0], len(members[r.g1]))
        centre, scatter = mixed(plain[r.g2], language, len(members[r.g2]))
        x = np.array([r[d] for d in quality.DIMS]) - centre
        d = x @ np.linalg.inv(scatter + np.diag(quality.RIDGE)) @ x
        assert abs(r.distance - d) <= 1e-6 * (1 + d) and r.kept == (d <= quality.LIMIT)
        verdicts[r.kept] += 1
    assert verdicts[False] >= 60


def test_quality_of_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.digest(docs).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi_square_quantile(0.99, 7) - 18.4753) < 1e-3


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 400])
def test_contamination(spark, docs, max_words):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    oracle.check(oracle.connect(SMALL), decontaminate.digest(docs, bench, max_words), queries.OP3_SQL)


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 20])
def test_contamination_cases(spark, max_words):
    rng = random.Random(8)
    few = ["a", "b", "c"]
    items = [" ".join(rng.choice(few) for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 12, 20)] + ["", None, "É à ß x", "b c"]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(60)] + ["É-à  ß.X", None]
    bench, sources = bench_of(spark, *items), frame(spark, texts)
    got = {r.doc_id: r for r in decontaminate.digest(sources, bench, max_words).collect()}
    for i, t in enumerate(texts):
        w, hit, which = words(t), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            m = min(8, len(v))
            patterns = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if m else set()
            for j in range(len(w) - m + 1) if m else ():
                if tuple(w[j : j + m]) in patterns:
                    hit |= set(range(j, j + m))
                    which.add(k)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(which), decontaminate.sha(list(which)))
    assert {got[i].contaminated for i in got} == {True, False}
    for least in (1, 2):
        kept = decontaminate.decontaminate(sources, bench, max_words, least)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if got[i].n_items < least]
        assert kept.columns == sources.columns


def test_decontamination_drops_planted_passages(spark):
    rng = random.Random(21)
    items = [prose(rng.randrange(9, 60), rng) for _ in range(30)]
    texts = [f"{prose(40, rng)} {' '.join(rng.choice(items).split()[:9])} {prose(40, rng)}" for _ in range(50)] + [prose(90, rng) for _ in range(50)] + [None, "", "--"] + [prose(30, rng)] * 2
    kept = decontaminate.decontaminate(frame(spark, texts), bench_of(spark, *items))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(50, len(texts)))
    assert decontaminate.decontaminate(frame(spark, texts), bench_of(spark, *items).where("false")).count() == len(texts)
    assert decontaminate.decontaminate(frame(spark, texts).where("false"), bench_of(spark, *items)).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text: str) -> list[tuple[int, int, str]]:
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return found


def test_pii_matches_base_rules(spark, docs, texts):
    rng = random.Random(6)
    more = ["".join(rng.choice("a0123456789.-@+ ()\né") for _ in range(rng.randrange(120))) for _ in range(400)] + ["x@y.z.@q.r a@b@c.d.e.", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4" * 30, "+1 (555) 010-9999)", "0001.02.3.255 256.1.1.1"]
    for source, known in ((docs, texts), (frame(spark, more), dict(enumerate(more)))):
        for r in pii.digest(source).collect():
            base = base_pii(known[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest(), known[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in pii.KINDS]


def test_pii_patterns_discover(spark):
    texts = [f"{prose(5)} reach customer: user{i}@mail.example today" for i in range(40)] + [f"{prose(5)} reach customer: ID99{i}77123 today" for i in range(8)] + [f"{prose(5)} invoice total 88{i}12345 paid" for i in range(8)]
    got = {r.doc_id: r for r in pii.digest(frame(spark, texts)).collect()}
    for i in range(40, 48):
        kind, s, e = got[i].spans.split(":")
        assert kind == "context" and texts[i][int(s) : int(e)] == f"ID99{i - 40}77123"
    assert all(got[i].spans == "" for i in range(48, 56))


def test_pii_finds_planted_identifiers(spark):
    """Unseen identifiers behind and before the words of known ones, and over a second hop, among harmless numbers: precision and recall."""
    rng = random.Random(23)
    forms = ["write to my inbox {} please", "{} is my private address", "customer contact: {} today", "total of {} pieces", "in the year {} already", "member {} since then", "room {} upstairs", "page {} of it"]
    texts, planted = [], []
    for i in range(800):
        kind, ident = i % 8, f"Q{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}x"
        if kind < 3:  # known ones first, unseen ones in the same places later
            what = f"u{rng.randrange(10**6)}@mail{i % 7}.example.com" if i < 480 else ident
        elif kind == 5:  # known from nowhere but the unseen ones; few are new
            what = "none" if i < 520 else ident if i % 160 == 5 else rng.choice([p for p in planted if p])
        else:
            what = str(rng.randrange(1000, 9999999))
        texts.append(f"{prose(6, rng)} {forms[kind].format(what)} {prose(6, rng)}")
        planted.append(what if what.startswith("Q") else None)
    found = {(r.doc_id, texts[r.doc_id][int(s) : int(e)]) for r in pii.digest(frame(spark, texts)).collect() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "context"}
    want = {(i, p) for i, p in enumerate(planted) if p}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.95 * len(found)


# 5 ------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(1)
    sizes = {"a": 600, "b": 150, "c": 40, None: 10}
    rows = [(i, prose(rng.randrange(5, 60), rng), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    size, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[3] for r in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    all_of = sum(total.values())
    shares = spark.createDataFrame([(k, v) for k, v in total.items()], "source string, tokens long")
    a = mixing.exponent(shares)

    def state(x):
        w = {k: (v / all_of) ** x for k, v in total.items()}
        z = sum(w.values())
        p = {k: v / z for k, v in w.items()}
        return p, -sum(v * math.log(v) for v in p.values()), max(p[k] * all_of / total[k] for k in p)

    entropies = [x / 1000 for x in range(8001)]
    aim = max([x for x in entropies if state(x)[1] >= mixing.TARGET_ENTROPY * math.log(4)], default=0)
    fair = min(x for x in entropies if state(x)[2] <= mixing.MAX_REPEATS)
    assert abs(a - max(aim, fair)) < 0.002
    got = mixing.places(df, block_tokens=2000).collect()
    weight = state(a)[0]
    for s, n in total.items():
        mine = [r for r in got if r.source == s]
        quota = math.floor(all_of * weight[s])
        held = sum(r.n_tokens for r in mine)
        assert quota - 60 <= held <= quota
        for i in (i for i in source if source[i] == s):  # whole passes, then a part of one
            times = sum(r.doc_id == i for r in mine)
            assert quota // n <= times <= quota // n + 1
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got)
    blocks = Counter()
    for r in got:
        blocks[r.block] += r.n_tokens
    assert max(blocks.values()) < 2000 * 1.2
    per_block = Counter()
    for r in got:
        per_block[r.block, r.source] += r.n_tokens
    whole = [b for b in blocks if b != max(blocks)]
    assert all(abs(per_block[b, s] / blocks[b] - weight[s]) < 0.12 for b in whole for s in total)  # each block holds the weights
    mixed = mixing.mix_sources(df, block_tokens=2000)
    assert mixed.columns == df.columns
    order = [(r.block, r.spot, r.doc_id) for r in mixing.places(df, block_tokens=2000).collect()]
    assert [r.doc_id for r in mixed.collect()] == [x[2] for x in sorted(order)]


def test_mixing_keeps_rows_apart(spark):
    """Rows that differ in any column are told apart; equal rows each have their places."""
    rows = [(1, "a b c", "en", "x", 1), (1, "a b c", "fr", "x", 2), (1, "a b c", "fr", "x", 3)] + [(2, "d e", "en", "x", 1)] * 5 + [(3, None, "en", "x", 1), (None, "f g", None, None, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    got = mixing.mix_sources(df, target_entropy=0.0)  # weights as they are: nothing is repeated, nothing left out but the text without a token
    count = lambda found: Counter(tuple(r)[:5] for r in found)
    state = count(got.collect())
    assert got.columns == df.columns and set(state) <= set(count(df.collect()))
    whole = mixing.mix_sources(df.where("source = 'x'"))
    assert count(whole.collect()) == count(df.where("source = 'x' and text is not null").collect())
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_mixing_budget(spark):
    df = frame(spark, [(i, prose(10)) for i in range(300)], clash=False).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    got = mixing.places(df, budget=4 * 3000).collect()
    assert sum(r.n_tokens for r in got) == 4 * 3000 and max(r["pass"] for r in got) == 3
    with pytest.raises(ValueError, match="repeats some source"):
        mixing.places(df, budget=8 * 3000)
    shares = spark.createDataFrame([("a", 1_000_000), ("b", 1000), ("c", 10)], "source string, tokens long")
    for budget in (500_000, 1_001_010, 2_500_000):
        a = mixing.exponent(shares, budget=budget)
        w = [n**a for n in (1_000_000, 1000, 10)]
        assert max(budget * x / sum(w) / n for x, n in zip(w, (1_000_000, 1000, 10), strict=True)) <= mixing.MAX_REPEATS + 1e-2


# 6 ------------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    truth = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = language.digest(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and truth[r.doc_id][1] is not None and len(words(truth[r.doc_id][0])) >= 5]
    assert sum(r.lang_pred == truth[r.doc_id][1] for r in judged) / len(judged) >= 0.95
    moved = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.digest(moved).collect())) == sorted(map(tuple, got))  # labels of the held-out fold are not used


def test_language_matches_plain_margins(spark):
    """Predictions against the machines applied one text at a time, from n-grams made by slicing."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["É", "ab", "Straße ÜBER", "x" * 300]
    got, _ = model.predict(pa.array(texts))
    for t, p in zip(texts, got, strict=True):
        c = [ord(x) if "a" <= x <= "z" or ord(x) > 127 else 32 for x in t.lower()]
        margin, size = np.zeros(model.w.shape[1]), max(1, len(c))
        for i in range(len(c)):
            grams = ([c[i]], [c[i - 1] if i else 32, c[i]], [c[i - 2] if i > 1 else 32, c[i - 1] if i else 32, c[i]])
            base = 0
            for gram, bits in zip(grams, language.BITS, strict=True):
                h = gram[0] * 2654435761 % 2**32
                for x in gram[1:]:
                    h = (h ^ x) * 2654435761 % 2**32
                margin += model.w[base + (h >> (32 - bits))]
                base += 1 << bits
        margin = margin / size + model.b
        k = len(model.families) if len(model.families) > 1 else 0
        members = model.members[int(margin[:k].argmax())] if k else model.members[0]
        votes = Counter({m: 0 for m in members})
        strength = Counter()
        for j, (a, b) in enumerate(model.pairs):
            if a in members:
                votes[a if margin[k + j] >= 0 else b] += 1
                strength[a] += margin[k + j]
                strength[b] -= margin[k + j]
        assert model.langs.index(p) in [m for m in members if votes[m] == max(votes.values())]


def test_languages_are_all_learned(spark):
    rng = random.Random(31)
    letters = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(230)]
    rows = [(230 * k + i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(30)), f"l{i}", "s", 0) for k in range(8) for i, a in enumerate(letters)]
    model = language.train(spark.createDataFrame(rows, FIELDS).where("lang in ('l0', 'l7', 'l229') or doc_id % 40 = 0"))
    assert {"l0", "l7", "l229"} <= set(model.langs)


def test_language_without_letters(spark):
    got = language.digest(frame(spark, [None, "", "123 -- !", "\u00b2 \u00bd \u2167 \u2460", *("the cat sat on the mat",) * 8])).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)][:5] == ["und"] * 4 + ["en"]


# 7 ------------------------------------------------------------------------------------------------------------------


def bag(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts: list[str | None]) -> list[int]:
    bags, of = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if bags[i] and bags[j] and 10 * both >= 8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_match_sql(spark, docs):
    oracle.check(oracle.connect(SMALL), near_dup.digest(docs), queries.OP7_SQL)


def test_near_duplicates_against_brute_force(spark):
    """Chains of edits and a crowd around one original, most of them just apart from each other."""
    rng = random.Random(12)
    edit = lambda t, k: " ".join(rng.choice(VOCABULARY) if x else w for w, x in zip(t.split(), (i in set(rng.sample(range(len(t.split())), k)) for i in range(len(t.split()))), strict=True))
    texts: list[str | None] = [prose(rng.randrange(5, 60), rng) for _ in range(30)] + [None, "", "--", "a", "A.", "a b c", "a b c a b c"]
    chain = prose(140, rng)
    for _ in range(25):
        chain = edit(chain, 2)
        texts.append(chain)
    middle = prose(150, rng)
    texts += [edit(middle, rng.randrange(1, 6)) for _ in range(120)] + [middle.upper(), middle]
    texts += [" ".join([prose(3, rng)] * n) for n in (40, 41, 60)]
    expected = classes(texts)
    got = {r.doc_id: r for r in near_dup.digest(frame(spark, texts)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == expected
    sizes = Counter(expected)
    assert all(got[i].class_size == sizes[expected[i]] and got[i].kept == (expected[i] == i) for i in range(len(texts)))
    kept = near_dup.drop_near_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected)) and set(CLASHES) <= set(kept.columns)


def test_near_duplicates_keep_one_row_a_class(spark):
    same, other = prose(60), prose(60)
    rows = [(1, same, "en", "s", 1), (5, same, "fr", "s", 2), (5, other, "fr", "s", 2), (1, same, "en", "s", 1), (1, same, "de", "s", 1), (None, None, None, None, None), (None, None, None, None, None), (9, "--", None, None, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    got = near_dup.digest(df).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in got) == Counter({(1, 1, 4, True): 1, (1, 1, 4, False): 2, (5, 1, 4, False): 1, (5, 5, 1, True): 1, (None, None, 1, True): 2, (9, 9, 1, True): 1})
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter({(1, same): 1, (5, other): 1, (None, None): 2, (9, "--"): 1})
    assert near_dup.drop_near_duplicates(df.where("false")).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(41)
    names = rng.sample(range(10**6), 3000)
    edges = [tuple(sorted((names[i], names[i + 1]))) for i in range(2999) if i % 500 != 499] + [(7_000_000, 7_000_000 + k) for k in range(1, 500)] + [(8_000_000 + k, 8_000_001 + k) for k in range(40)]
    got = {r.node: r.comp for r in near_dup.components(common.materialize(spark.createDataFrame(edges, "a long, b long"), "edges")).collect()}
    for k in range(6):
        part = names[500 * k : 500 * k + 500]
        assert {got.get(x, x) for x in part} == {min(part)}
    assert {got.get(7_000_000 + k, 0) for k in range(1, 500)} == {7_000_000} and {got[8_000_000 + k] for k in range(1, 41)} == {8_000_000}


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(3)
    pool = [rng.getrandbits(63) for _ in range(60)]
    bags = [sorted(rng.sample(pool, rng.randrange(1, 60))) for _ in range(80)]
    tokens = near_dup.prefixes(spark.createDataFrame([(i, i, b) for i, b in enumerate(bags)], "node long, comp long, bag array<long>")).collect()
    first = {i: {} for i in range(80)}
    for r in tokens:
        first[r.node][r.token] = r.place
    for i in range(80):
        for j in range(i):
            a, b = set(bags[i]), set(bags[j])
            if 10 * len(a & b) >= 8 * len(a | b):
                both = first[i].keys() & first[j].keys()
                assert any(9 * min(len(a) - first[i][t], len(b) - first[j][t]) >= 4 * (len(a) + len(b)) for t in both)


def test_signatures_estimate_similarity():
    a = prose(400)
    b = " ".join(a.split()[:360] + prose(40).split())
    x, y = bag(a), bag(b)
    true = sum((x & y).values()) / sum((x | y).values())
    r = near_dup.bag_min_hash(near_dup.Bags(pa.array([a, b])))
    assert abs((r[0] == r[1]).mean() - true) < 0.12
    repeated = near_dup.bag_min_hash(near_dup.Bags(pa.array([" ".join([a] * 6), " ".join([a] * 3)])))
    assert abs((repeated[0] == repeated[1]).mean() - 0.5) < 0.15  # weights count


# 8 ------------------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_binary.default_tokenizer())
    odd = dict(enumerate([None, "", "It's 20°C—naïve CAFÉ́ İ ﬁ x\r\ny\tz", "<|endoftext|> a", "日本語 text", "a" * 300, prose(3000), "I'LL we've\n\n#tag 12345"]))
    for source, known in ((docs, texts), (frame(spark, list(odd.values())), odd)):
        got = {r.doc_id: r for r in token_binary.read_tokens(token_binary.write_tokens(source), ids=True).collect()}
        start = 0
        for i in sorted(known):
            ids = [*plain.encode(known[i] or "", add_special_tokens=False).ids, token_binary.END_ID]
            assert list(got[i].ids) == ids
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, step in ((1, 1), (2, 1000), (600, 0), (5000, 3), (5000, 4000)):
        values = np.cumsum(rng.integers(0, step + 1, n)).astype(np.uint64)
        made = token_binary.EliasFano.from_bytes(token_binary.EliasFano.build(values).to_bytes())
        assert made.select_range(0, n).tolist() == values.tolist()
        a, b = sorted(map(int, rng.integers(0, n + 1, 2)))
        assert made.select_range(a, b).tolist() == values[a:b].tolist()
        assert all(made.select(int(i)) == values[i] for i in rng.integers(0, n, 50))
        assert len(made.low) + len(made.high) <= n * (2 + math.log2(max(1, values[-1] / n) + 1)) / 8 + 40
        with pytest.raises(IndexError):
            made.select(n)
    with pytest.raises(ValueError):
        token_binary.EliasFano.from_bytes(made.to_bytes()[:-1])
    with pytest.raises(ValueError):
        token_binary.Shard(pa.BufferReader(b"no shard at all" * 9))


@pytest.mark.parametrize("keys", [[], [None], [None, None, -5, 3, 3, 1 << 62], [-(1 << 63), (1 << 63) - 1], [5, None, 3, 3, -1], list(range(1500)), [(i * 7919) % 1000 for i in range(1000)]])
def test_shard_keys(keys):
    made = token_binary.Keys(token_binary.encode_keys(keys), len(keys))
    assert made.range(0, len(keys)) == keys
    assert all(made.range(i, i + 1) == [keys[i]] for i in range(0, len(keys), 7))


def test_tokens_in_table_order(spark, docs):
    table = common.materialize(docs.repartition(3), "shuffled")
    order = [r.doc_id for r in table.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    got = sorted(token_binary.digest(table, table_order=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == order
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_binary.digest(docs).collect()}


# 9 ------------------------------------------------------------------------------------------------------------------


def plain_score(text: str, net: lm_score.Network, counts: lm_score.WordCounts, exact: Counter) -> float:
    """The sum of the conditionals, one word at a time."""
    h = {w: int(common.Words(pa.array([w]), common.ALNUM).hashes[0]) for w in words(text)}
    rank = {int(x): i for i, x in enumerate(counts.vocabulary.words)}
    leaf = lambda w: rank[h[w]] + lm_score.REST if h[w] in rank else h[w] % lm_score.REST
    spread = lambda z: z - np.log(np.exp(z).sum())
    total, w = 0.0, words(text)
    for k, x in enumerate(w):
        side = [leaf(w[k + s]) if 0 <= k + s < len(w) else lm_score.LEAVES for s in (-2, -1, 1, 2)]
        hidden = np.tanh(sum(net.embed[p][c] for p, c in enumerate(side)))
        c, m = divmod(leaf(x), lm_score.MEMBERS)
        total += spread(hidden @ net.out + net.bias)[c] + spread(hidden @ net.leaf_out[c] + net.leaf_bias[c])[m]
        if leaf(x) < lm_score.REST:
            total += math.log((exact[x] + 1) / (counts.total[leaf(x)] + counts.distinct[leaf(x)] + 1))
    return total


@pytest.fixture
def few_own_leaves(monkeypatch):
    """A vocabulary of 50 words, so that others share leaves."""
    monkeypatch.setattr(lm_score, "TOP", 50)
    counts = lm_score.WordCounts.__init__

    def init(self, table):
        counts(self, table)
        self.leaf_counts = np.concatenate([self.leaf_counts, np.zeros(lm_score.LEAVES - len(self.leaf_counts), np.int64)])

    monkeypatch.setattr(lm_score.WordCounts, "__init__", init)


def test_scores_sum_conditionals(spark, few_own_leaves):
    texts = [prose(200) for _ in range(40)] + ["one", None, ""]
    df = frame(spark, texts)
    counts = lm_score.word_counts(df)
    net, exact = lm_score.train(df, counts), Counter(w for t in texts for w in words(t))
    assert counts.sum() == 40 * 200 + 1 and len(counts.vocabulary.words) == 50
    got = {r.doc_id: r for r in lm_score.score(df, net, counts).collect()}
    for i in (0, 7, 40):
        assert abs(got[i].log_likelihood - plain_score(texts[i], net, counts, exact)) < 1e-3 * max(1, got[i].n_words)
        assert got[i].n_once == sum(exact[w] == 1 and True for w in words(texts[i]))
    assert got[41].n_words == got[42].n_words == 0 and got[41].log_likelihood == 0 and got[41].mean_log_likelihood is None


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 1500)
    df = frame(spark, [prose(RNG.randrange(1, 300)) for _ in range(80)] + [None, ""])
    a, b = ({r.doc_id: r for r in lm_score.digest(x).collect()} for x in (df.repartition(2), df.repartition(9, "text")))
    assert all(abs(a[i].log_likelihood - b[i].log_likelihood) < 1e-6 * max(1, a[i].n_words) for i in a)


def test_gradient():
    rng = np.random.default_rng(8)
    net = lm_score.Network(lm_score.Network.first(rng.integers(0, 50, lm_score.LEAVES)).flat.astype(np.float64))
    context, leaf = rng.integers(0, lm_score.LEAVES + 1, (lm_score.PLACES, 40)).astype(np.int32), rng.integers(0, lm_score.LEAVES, 40).astype(np.int32)
    g = net.gradient(context, leaf)
    ends = np.cumsum(net.SIZES)
    embedded = [(k * (lm_score.LEAVES + 1) + context[k, i]) * lm_score.WIDTH + 3 for k in range(lm_score.PLACES) for i in (0, 9)]
    own = ends[2] + (leaf[5] // lm_score.MEMBERS) * lm_score.WIDTH * lm_score.MEMBERS + 2 * lm_score.MEMBERS + leaf[5] % lm_score.MEMBERS
    for at in [*embedded, ends[0] + 7, ends[1] + 3, own, ends[3] + leaf[5]]:
        moved = []
        for step in (1e-4, -1e-4):
            flat = net.flat.copy()
            flat[at] += step
            moved.append(-lm_score.Network(flat).log_probs(context, leaf).sum())
        assert abs((moved[0] - moved[1]) / 2e-4 - g[at]) < 1e-3 * max(1, abs(g[at]))
    all_leaves = np.arange(lm_score.LEAVES, dtype=np.int32)
    assert abs(np.exp(net.log_probs(np.repeat(context[:, :1], lm_score.LEAVES, axis=1), all_leaves)).sum() - 1) < 1e-5  # a distribution


def test_every_word_is_a_target(monkeypatch):
    seen, step = [], lm_score.Trainer._step
    monkeypatch.setattr(lm_score.Trainer, "_step", lambda self, context, leaf: (seen.append(len(leaf)), step(self, context, leaf)))
    monkeypatch.setattr(lm_score, "BATCH", 16)
    net = lm_score.Network.first(np.ones(lm_score.LEAVES))
    moves = []
    for sizes in ((1, 2, 3, 5, 40), (40, 11)):  # the calls do not matter, the words do
        trainer, at = lm_score.Trainer(net.flat, 0.1), 0
        context, leaf = np.arange(4 * 51, dtype=np.int32).reshape(4, 51), np.arange(51, dtype=np.int32) * 70
        for n in sizes:
            trainer.add(context[:, at : at + n], leaf[at : at + n])
            at += n
        moves.append(trainer.moved())
    assert sum(seen) == 2 * 51
    assert (moves[0][0] == moves[1][0]).all() and moves[0][1] == moves[1][1] == 1


def test_context_tells_words_apart(spark):
    """Held-out pairs: behind its own word each of two words is far likelier than by its frequency, and order matters."""
    rng = random.Random(4)
    pairs = [("red", "apple"), ("blue", "sky"), ("old", "house"), ("new", "car")]
    text = lambda: " ".join(x for _ in range(60) for x in (*rng.choice(pairs), rng.choice(VOCABULARY[:200])))
    df = frame(spark, [text() for _ in range(200)])
    counts = lm_score.word_counts(df)
    unigram = lm_score.Network.first(counts.leaf_counts)
    unigram.flat[: unigram.SIZES[0]] = 0
    net = lm_score.train(df, counts, rounds=3)
    held = [text() for _ in range(5)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    mean = lambda n, t: np.mean([r.mean_log_likelihood for r in lm_score.score(frame(spark, t), n, counts).collect()])
    assert mean(net, held) > mean(unigram, held) + 0.1 and mean(net, held) > mean(net, mixed) + 0.1


def test_scores_beat_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    some, held = docs.where("doc_id % 5 > 0"), docs.where("doc_id % 5 = 0")
    counts = lm_score.word_counts(some)
    unigram = lm_score.Network.first(counts.leaf_counts)
    unigram.flat[: unigram.SIZES[0]] = 0
    total = lambda n: sum(r.log_likelihood for r in lm_score.score(held, n, counts).collect())
    assert total(lm_score.train(some, counts)) > total(unigram)


def test_scores_count_words_exactly(spark, monkeypatch, few_own_leaves):
    seen, pair, k = {}, None, 0
    while pair is None:  # two words of one leaf whose hashes agree in the first 18 bits
        h = int(common.Words(pa.array([f"word{k}"]), common.ALNUM).hashes[0])
        pair = (seen[h >> 46, h & 63], f"word{k}") if (h >> 46, h & 63) in seen else None
        seen[h >> 46, h & 63] = f"word{k}"
        k += 1
    texts = [*(" ".join(VOCABULARY[:60]) + " " for _ in range(9)), f"{pair[0]} " * 5, pair[1], *(prose(300) for _ in range(20)), f"{pair[1]} newword {pair[0]}", None, ""]
    df = frame(spark, texts)
    counts = lm_score.word_counts(df)
    net, exact = lm_score.Network.first(counts.leaf_counts), Counter(w for t in texts for w in words(t))
    hashes = {w: int(common.Words(pa.array([w]), common.ALNUM).hashes[0]) for w in exact}
    assert {r.word % 2**64: r.n for r in counts.table.collect()} == {hashes[w]: n for w, n in exact.items()}
    odd = frame(spark, [*texts, "neverseen before", texts[13]])
    want = sorted(map(tuple, lm_score.score(odd, net, counts).collect()))
    for head in (0, 100):  # words beyond the head come from the join, with the same scores
        monkeypatch.setattr(lm_score, "HEAD", head)
        small = lm_score.WordCounts(counts.table)
        assert not small.complete and len(small.words) <= head
        got = sorted(map(tuple, lm_score.score(odd, net, small).collect()))
        assert [(*x[:2], x[4]) for x in got] == [(*x[:2], x[4]) for x in want]
        assert all(abs(x[2] - y[2]) < 1e-6 * max(1, x[1]) for x, y in zip(got, want, strict=True))


# 10 -----------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["vileword", "grimslur", "hatefulness"]
    rows, labels = [], []
    for i in range(600):
        level = rng.choice([0, 0, 0, 1, 2])
        w = prose(60, rng).split()
        for _ in range(3 * level):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, level))
    model = toxicity.train(frame(spark, rows[:400]), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.fit.cuts) >= 0).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    held = range(400, 600)
    assert sum(got[i].toxic == (labels[i][2] > 0) for i in held) >= 0.95 * len(held)
    means = [np.mean([got[i].severity for i in held if labels[i][2] == g]) for g in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.2


def test_toxicity_of_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r.toxic for r in toxicity.digest(docs, labels).collect()}
    # 12 rows labelled toxic hold none of the features that training keeps
    assert sum(got[i] == bool(t) for i, t in truth.items() if i in got) >= 0.95 * len(truth)
    assert sum(got[i] for i, t in truth.items() if i in got and not t) <= 0.02 * sum(not t for t in truth.values())


def test_toxicity_keeps_words_of_no_clean_row(spark):
    rng = random.Random(12)
    rows, labels, slurs = [], [], [f"xq{c}zslur" for c in "abcdefghijklmnopqrstuvwxyz"]
    for i in range(1200):
        toxic = i % 2
        rows.append((i, prose(40, rng) + (" " + slurs[i // 2 % 26]) * toxic))  # each in 4 % of the toxic rows
        labels.append((i, 1, toxic))
    model = toxicity.train(frame(spark, rows[:1000]), spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    for ids in (range(1000), range(1000, 1200)):
        assert sum(got[i] for i in ids if i % 2) >= 0.95 * len(ids) / 2
        assert sum(got[i] for i in ids if not i % 2) <= 0.02 * len(ids) / 2


def test_toxicity_matches_plain_regression(spark):
    """Scores against the model applied one text at a time; grades of binary labels do not follow the number of features."""
    rng = random.Random(15)
    mild, harsh = ["mildword", "meanie"], ["vileslur", "hatefulness"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 2
        bad = [rng.choice(harsh)] if i % 4 == 1 else [rng.choice(mild)] * 3
        rows.append((i, " ".join(rng.sample([*prose(30, rng).split(), *(bad if toxic else ["kindly"])], 30 + (len(bad) if toxic else 1)))))
        labels.append((i, 1, toxic))
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.fit.k == 2 and (model.fit.w < 0).any() and (model.fit.w > 0).any()
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    place = {int(h): i for i, h in enumerate(model.words)}
    for i in range(0, 800, 37):
        held = {int(h) for h in toxicity.distinct_features(pa.array([rows[i][1]]))[0]} & place.keys()
        score = sum(model.fit.w[place[h]] for h in held)
        above = [1 / (1 + math.exp(c - score)) for c in model.fit.cuts]
        assert abs(got[i].severity - sum(above)) < 1e-9 and got[i].toxic == (above[0] >= 0.5)
    assert sum(got[i].toxic == bool(i % 2) for i in range(800)) >= 790


def test_toxicity_of_held_out_rows(spark):
    """Rows whose labels training has not seen, on the check tool's shape of data at a small size: few are missed or wrongly flagged."""
    rng = random.Random(16)
    bad = [f"slur{chr(97 + k)}{chr(98 + k)}x" for k in range(12)]
    rows = [(i, prose(50, rng) + (" " + " ".join(rng.sample(bad, 2)) if i % 3 == 0 else "")) for i in range(900)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(600)]
    got = {r.doc_id: r.toxic for r in toxicity.digest(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[i] for i in range(600, 900) if i % 3 == 0) >= 95 and sum(got[i] for i in range(600, 900) if i % 3) <= 4


# -- -----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline

    held, before = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        before, held = held, common.materialize(stage(spark, held, SMALL), name)
        if name != "token_output":
            assert held.columns == docs.columns
        a, b = ({r.doc_id for r in x.select("doc_id").collect()} for x in (before, held))
        assert b <= a
        if name == "quality_rules":
            assert b == {r.doc_id for r in quality.digest(before).where("kept").collect()}
        if name == "near_duplicates":
            ids = sorted((r.doc_id, r.text) for r in before.collect())
            firsts = set(classes([t for _, t in ids]))
            assert b == {ids[i][0] for i in firsts}
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            found = {r.doc_id: r.n_items for r in decontaminate.digest(before, bench).collect()}
            assert b == {i for i, n in found.items() if n == 0} and any(found.values())
        if name == "token_output":
            assert b == a and held.count() == before.count()
            order = [r.doc_id for r in before.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
            assert [r.doc_id for r in held.orderBy("start").collect()] == order
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, held.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns of clashing names and empty tables: which rows each stage keeps."""
    import corpus_pipeline

    rng = random.Random(51)
    good = [prose(80, rng) for _ in range(40)]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good)] + [(None, None, None, None, None), (41, "", "en", None, 0), (42, prose(80, rng), None, None, None), (43, "few words", "en", "s", 9), (7, good[7], "en", "s", 1), (7, good[7], "en", "s", 2)]
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    leaky = spark.createDataFrame([(50, f"{good[0]} {item} {good[1]}", "en", "s", 1)], FIELDS).withColumns({c: F.lit(1) for c in CLASHES})
    count = lambda d: Counter((r.doc_id, r.n_chars) for r in d.collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, df, SMALL)
    assert count(kept) == count(df) - Counter({(None, None): 1, (41, 0): 1, (43, 9): 1})
    single = stages["near_duplicates"](spark, df, SMALL)
    assert Counter(r.doc_id for r in single.collect()) == Counter([*range(40), None, 41, 42, 43])
    clean = stages["benchmark_decontamination"](spark, df.unionByName(leaky), SMALL)
    assert count(clean) == count(df)
    mixed = stages["source_mixing"](spark, df, SMALL)
    assert set(count(mixed)) <= set(count(df)) - {(None, None), (41, 0)}
    for d in (kept, single, clean, mixed):
        assert d.columns == df.columns
    assert Counter(r.doc_id for r in stages["token_output"](spark, df, SMALL).collect()) == Counter(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), SMALL).count() == 0, name
