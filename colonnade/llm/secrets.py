r"""Operator 1, secret scans by assignment-aware lexing.

Base spans are fixed patterns (assign, access, hex). Beside them a small lexer reads source and configuration
syntax into (name, literal) pairs: `=`, `:`, `:=` and `=>` after a bare, dotted, quoted or subscripted name, and quoted (with
escapes, prefixes, joined parts or triple quotes) or bare literals, all of any length. It follows names that are set to other
names, by the whole dotted name or else by its last part, in the order of the text, and scores every literal by the
sensitive names that it reaches. Literals over the threshold are spans of the kind `literal`.

Null text counts as empty and gives no spans. Rows are independent: repeated rows give repeated results, an empty
table gives an empty result, and only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from colonnade.llm.common import map_batches, text_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
OPERATOR = re.compile(r"=>|:=|(?<![=!<>:])[=:](?![=:])")
NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: Quoted literals hold escapes; the runs are possessive, so that a missing end is found in one pass.
QUOTED = r"""(?:"((?:[^"\\\n]|\\[^\n])++)"|'((?:[^'\\\n]|\\[^\n])++)')"""
PREFIX = r"(?:[bBrRuUfF]{1,2}(?=[\"']))?"
VALUE = re.compile(r"[\x20\t]*" + PREFIX + QUOTED)
LONG = re.compile(r"[\x20\t]*" + PREFIX + r"""(?:\"{3}((?:[^"\\]|\\.|"(?!""))++)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))++)'{3})""", re.DOTALL)
BLANK, BARE = re.compile(r"[\x20\t]*"), re.compile(r"""[^\s"'`,;(){}\[\]<>]*""")
JOINED = re.compile(r"[\x20\t]*[+.][\x20\t]*" + QUOTED)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
#: How strongly a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5, "signing": 0.4, "api": 0.4, "client": 0.1}
PLACEHOLDER = re.compile(r"(?i)(?:your|example|change|dummy|sample|placeholder|redacted|x{4,}|\*{3,}|\$\{|%\(|<)")
#: The least score of a reported literal.
THRESHOLD = 1.2


def name_score(name: str) -> float:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in parts))


def literal_score(value: str) -> float:
    """0 to 1: length, kinds of characters and entropy."""
    n = len(value)
    if n < 6 or PLACEHOLDER.search(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]", "[^0-9A-Za-z]"))
    return 0.4 * min(1.0, entropy / 3.5) + 0.3 * min(1.0, n / 16) + 0.1 * min(kinds, 3)


def name_before(text: str, at: int) -> str:
    """The name that ends before position at: bare or dotted, in quotes, or a subscript in quotes; empty if there is none."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARACTERS:
        start -= 1
    return text[start:end].lstrip("0123456789.-")


def lex(text: str) -> list[tuple[str, str, list[tuple[int, int]], str | None]]:
    """(name, literal, spans, name that it is set to) for each assignment in text."""
    pairs, run, inside = [], 0, 0  # the ends of the last unquoted run, which all that begin within it share, and of the last long literal
    for op in OPERATOR.finditer(text):
        if op.start() < inside:
            continue
        name = name_before(text, op.start())
        if not name:
            continue
        kind, end = 3, op.end()
        if value := LONG.match(text, end) or VALUE.match(text, end):
            kind, end = value.lastindex, value.end()
            literal, spans = value.group(kind), [value.span(kind)]
            inside = end if value.re is LONG else inside
            while more := JOINED.match(text, end):
                literal += more.group(more.lastindex)
                spans.append(more.span(more.lastindex))
                end = more.end()
        else:
            start = BLANK.match(text, end).end()
            run = run if start < run else BARE.match(text, start).end()
            if run == start:
                continue
            literal, spans = text[start:run], [(start, run)]
        bare = literal.lstrip("$") if kind == 3 else ""
        pairs.append((name, literal, spans, bare if IDENTIFIER.fullmatch(bare) else None))
    return pairs


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose sensitive names and own shape score over the threshold; constants are followed in order."""
    if "=" not in text and ":" not in text:
        return []
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    found: set[tuple[int, int, str]] = set()
    for name, literal, spans, to in lex(text):
        source = None if to is None else known.get(to) or known.get(to.rpartition(".")[2])
        if source:
            literal, spans = source
        elif to is not None and to.isalpha():
            continue  # an unknown name or a plain word is no literal
        known[name] = known[name.rpartition(".")[2]] = (literal, spans)
        sure = name_score(name)
        if sure >= 0.5 and sure + literal_score(literal) >= THRESHOLD and literal_score(literal) > 0:
            found |= {(s, e, "literal") for s, e in spans}
    return sorted(found)


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text in code points, by start and kind."""
    if not text:
        return []
    spans, low = [], text.lower()
    if any(w in low for w in WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    spans += literal_spans(text)
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Every row's doc_id and its spans, an array of (kind, start, end)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t)] for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return map_batches(text_of(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of scan_secrets()."""
    from pyspark.sql import functions as F

    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return scan_secrets(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("literal"))


def sha(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
