"""Secret scan by assignment-aware lexing.

A text is read as source or configuration syntax: ``name = literal``, ``name: literal``, ``"name": "literal"``,
``name => literal``, ``name := literal``, ``export NAME=literal``, ``<name>literal</name>`` attributes included. A right side may be a quoted or
bare literal, another name, or a sum of them; constants are propagated in text order, so that in ``a = "k1"`` followed by
``db.password = a`` the literal k1 is charged to db.password. A literal is scored by the sensitive parts of the names it
reaches, its length, its variety of characters and their entropy; placeholders (``changeme``, ``${VAR}``, ``xxxx``) score
nothing. From THRESHOLD on its span is reported as kind ``lexed``.

Beside it stand the base patterns, which are always reported: ``assign``, ``access`` and ``hex``.

Defined results: a null text is empty and has no spans; spans are in code points, end exclusive, sorted by start, then
kind; repeated rows are scanned alike; other columns are not read. Every text is scanned whole, in time linear in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import table

KINDS = ("assign", "access", "hex", "lexed")
# Fixed values of the base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_FIRST = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)

#: What a word of a name adds to the score of the literals it is given.
NAME_SCORES = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5,
    "signing": 1.0, "encryption": 1.0, "bearer": 2.0,
}
THRESHOLD = 5.0
_PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|your[_-].*|example.*|placeholder|todo|none|null|true|false|test|dummy|redacted|[*x.#-]+|\$\{.*|\$\(.*|<.*|\{\{.*|\$[a-z_][a-z0-9_]*|%[a-z_][a-z0-9_]*%)$")
_OPERATOR = re.compile(r":=|[:=]")
#: A quoted literal ends at its own quote; a bare one stops at & only where another assignment follows, as in a query string.
_RIGHT = re.compile(
    r"""[>\x20\t]*(?:(?P<q>["'`])(?P<quoted>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>(?:[A-Za-z0-9_+/.=@!#$%^*~?|\\-]|&(?![A-Za-z_][A-Za-z0-9_.-]*=))+))"""
)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
_PLUS = re.compile(r"[\x20\t]*[+.]{1,2}(?=[\x20\t\"'])")
_PARTS = re.compile(r"[.-]")
_NAME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    if _FIRST.search(text):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = "".join(parts)
    score = sum(NAME_SCORES.get(w, 0.0) for w in set(parts))
    return max(score, 3.0 if re.search("apikey|accesskey|privatekey|passphrase", joined) else 0.0)


def literal_score(literal: str) -> float:
    """0 for placeholders and plain words; up to 4 for long, mixed, high-entropy literals."""
    if len(literal) < 8 or _PLACEHOLDER.match(literal) or " " in literal:
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds < 2:
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    return min(2.0, len(literal) / 12) + min(1.0, entropy / 4) + (kinds - 1) / 3


def _name_before(text: str, at: int) -> str:
    """The name that ends right before position at, quotes and blanks between them allowed; "" if none."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'])":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_CHARACTERS:
        start -= 1
    # Parts between dots and dashes begin with a letter or an underline; the first one may follow digits.
    begin = end
    for part in reversed(_PARTS.split(text[start:end])):
        rest = part.lstrip("0123456789")
        if not rest:
            break
        begin -= len(rest) + (begin < end)
        if len(rest) < len(part):
            break
    return text[begin:end]


def lexed_spans(text: str) -> list[tuple[int, str, int]]:
    """Literals that reach a sensitive name, directly or through other names."""
    latest: dict[str, int] = {}
    # By assignment: the weight of its name, and what it is given: spans of literals, and numbers of earlier assignments.
    weights: list[float] = []
    given: list[list[tuple[int, int] | int]] = []
    at = 0
    while m := _OPERATOR.search(text, at):
        at = m.end()
        if text[at : at + 1] in ("=", ":") or (m[0] == ":" and text.startswith("//", at)) or text[m.start() - 1 : m.start()] in ("=", "!", "<", ">"):
            continue  # a comparison, a URL, a scope
        name = _name_before(text, m.start())
        if not name:
            continue
        sources: list[tuple[int, int] | int] = []
        within = None
        while right := _RIGHT.match(text, at):
            at = right.end()
            if right["q"]:
                sources.append(right.span("quoted"))
                if within is None and any(q in right["quoted"] for q in "\"'`"):
                    within = right.start("quoted")  # what is quoted may hold assignments of its own
            else:
                sources.append(latest.get(right["bare"], right.span("bare")))
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        at = at if within is None else within
        if sources:
            latest[name] = len(given)
            weights.append(name_score(name))
            given.append(sources)
    # From the last assignment to the first, each hands its weight on: one step a link, however names build on each other.
    reached: dict[tuple[int, int], float] = {}
    for weight, sources in zip(map(weights.__getitem__, range(len(given) - 1, -1, -1)), reversed(given), strict=True):
        for source in sources if weight else ():
            if isinstance(source, int):
                weights[source] = max(weights[source], weight)
            else:
                reached[source] = max(reached.get(source, 0.0), weight)
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        if weight := name_score(m[1]):
            literal = m[2].strip()
            start = m.start(2) + len(m[2]) - len(m[2].lstrip())
            span = (start, start + len(literal))
            reached[span] = max(reached.get(span, 0.0), weight)
    return [(a, "lexed", b) for (a, b), weight in reached.items() if (value := literal_score(text[a:b])) and weight + value >= THRESHOLD]


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans, each sorted by start and kind."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted([*base, *lexed_spans(text)], key=order)


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


SCANNED = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, with base and spans: arrays of (kind, start, end). No shuffle; one pass over the texts."""
    kept = [c for c in keep if c not in ("base", "spans")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("__text")]
            cells = lambda i: pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in f[i]] for f in found], kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), cells(0), cells(1)], [*kept, "base", "spans"])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(emit, f"{schema}, {SCANNED}")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the text of every span replaced by a mark; overlapping spans are one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text)
            yield batch.set_column(where, batch.schema.field(where), pa.array([redact(t.as_py(), mark) for t in batch.column(where)], batch.schema.field(where).type))

    return docs.mapInArrow(emit, docs.schema)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
