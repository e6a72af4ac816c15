"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. On top of them a lexer
(:mod:`timberline.llm.assignments`) reads assignments of source, configuration and markup
into pairs of a name and the pieces of a literal, follows constants through later
assignments, concatenations and lists, and each literal is scored by how sensitive the
names are that it reaches. All pieces of literals that score enough, but for those that lie
in a base span, become spans of kind ``named``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.assignments import GENERIC, pairs
from timberline.llm.common import by_text_chunks, texts_of

#: Order of kinds among spans with the same start.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
THRESHOLD = 0.8
REDACTED = "[REDACTED]"

#: Words of a name and how sensitive they make its value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.8, "signature": 0.5}
#: Pairs of neighbouring words that count together.
SENSITIVE_PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 0.9, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("client", "secret"): 1.0, ("pass", "word"): 1.0}
#: Last words that make a name speak about a secret rather than hold it.
HARMLESS_LAST = frozenset("count counts length len size name names type path file url uri field header expiry expires ttl limit max min id label prompt regex pattern policy hint".split())
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|todo|changeme|change_me|example|placeholder|redacted|password|secret|token|your[-_ ].*|<.*>|\$?\{.*\}|%.*%|\[.*\])$", re.IGNORECASE | re.ASCII)
#: What a text must hold for any name in it to score: a word, or a pair with nothing but separators of names between.
_ANY_SENSITIVE = re.compile("|".join([*map(re.escape, SENSITIVE), *[rf"{a}[_.$-]*{b}" for a, b in SENSITIVE_PAIRS]]), re.IGNORECASE | re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Words in s that are no plurals here: counts of tokens are not secret.
_NO_PLURALS = frozenset(("tokens", "credentials", "access", "pass"))
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind, too short ones dropped."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """0 to 1: how surely a value of this name is a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return 0.0
    best = 0.0
    for read in (words, [w.lower() for w in _RUNS.findall(name)]):  # APIkey is API and key
        read = [w[:-1] if w.endswith("s") and w not in _NO_PLURALS else w for w in read]
        best = max([best, *[SENSITIVE.get(w, 0.0) for w in read], *[SENSITIVE_PAIRS.get(p, 0.0) for p in zip(read, read[1:])]])
    words = words[:-1] if len(words) > 1 and words[-1] in GENERIC else words
    return best - 0.6 if words[-1] in HARMLESS_LAST else best


def literal_score(value: str) -> float:
    """What the literal's own form adds to or takes from its name's score."""
    if len(value) < 8 or _PLACEHOLDER.match(value):
        return -1.0
    counts = Counter(value)
    total = sum(counts.values())
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    score = 0.1 * any(c.isdigit() for c in value) + (0.1 if entropy >= 3 else -0.3)
    return score - 0.5 * (" " in value) - 0.4 * value.startswith(("http://", "https://", "/", "./"))


def named_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the pieces of literals that sensitive names hold, directly or through constants."""
    if not ("=" in text or ":" in text or "</" in text) or not _ANY_SENSITIVE.search(text):
        return []
    scores: dict[tuple[int, int], float] = {}
    for name, spans in pairs(text):
        if (n := name_score(name)) > 0 and (s := n + literal_score("".join(text[a:b] for a, b in spans))) >= THRESHOLD:
            for span in spans:
                scores[span] = max(s, scores.get(span, 0.0))
    return sorted((a, b, s) for (a, b), s in scores.items() if b > a)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and named spans together, both in order."""
    base = base_spans(text)
    named = [(a, 3, b) for a, b, _ in named_literals(text) if not any(s <= a and b <= e for s, _, e in base)]
    return base, sorted(base + named)


def redact(text: str) -> str:
    """The text with every secret value replaced; names and the rest stay."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    values = sorted(values + [(a, b) for a, kind, b in all_spans(text)[1] if kind])
    out, at = [], 0
    for a, b in values:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in texts_of(batch):
        base, spans = all_spans(text)
        n = Counter(k for _, k, _ in spans)
        rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4]), pa.array(columns[5])],
        names=["doc_id", "n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans"],
    )


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each row's whole text, in code points, end exclusive.

    Null text counts as empty and has none (the digest is that of the empty
    string); repeated rows stay; an empty table gives an empty frame; columns
    other than doc_id and text are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        by_text_chunks(_scan_batch), "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secret values in ``text`` replaced by ``[REDACTED]``; other columns and null texts are kept as they are."""
    schema = docs.schema
    place = schema.names.index("text")

    def replace(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(by_text_chunks(replace), schema)
