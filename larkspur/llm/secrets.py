"""Secret scans: fixed patterns plus sliding-window Shannon entropy with an allow-list.

Candidate strings are maximal runs of one character class (hexadecimal, or base-64). Over each,
a window slides whose character counts are updated by the one character that enters and the one
that leaves; windows above the class's entropy are merged into spans. Spans that match an
allow-list pattern (identifiers that look random but are public) are dropped.

Defined results: null is an empty text and has no spans; an empty table gives no rows; a long text is scanned whole, by
its task alone; positions are code points, ends are
exclusive; repeated rows give equal results; spans are sorted by start and then kind. The result
has its own columns only, so clashing input names don't matter.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_texts

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Without one of these in the lower-cased text there is nothing for ASSIGN to match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Character class: candidate runs, width of the window, least bits a character in a window.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])"), 24, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.8),
}
#: Random-looking strings that are no secrets: UUIDs, dashed or underscored words, runs without a digit, paths.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[^0-9]*"),
    re.compile(r"[A-Za-z]+([-_/=+][A-Za-z]+)*[0-9]{0,4}"),
    re.compile(r"[0-9]+([-_/][0-9]+)*"),
    re.compile(r"(EXAMPLE|example|test|sample|dummy)[A-Za-z0-9+/_=-]*|[A-Za-z0-9+/_=-]*EXAMPLE"),
)


def _terms(width: int) -> list[float]:
    return [0.0] + [c / width * math.log2(width / c) for c in range(1, width + 1)]


_TERM = {width: _terms(width) for _, width, _ in CLASSES.values()}


def entropy_spans(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy is at least ``least`` bits a character.

    Each step changes two counts only, so a run costs time in proportion to its length."""
    term, counts, bits, spans = _TERM.get(width) or _terms(width), {}, 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        bits += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width:
            gone = run[i - width]
            c = counts[gone]
            bits += term[c - 1] - term[c]
            counts[gone] = c - 1
        if i >= width - 1 and bits >= least - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOW)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def high_entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans found by entropy, without those on the allow-list."""
    out = []
    for kind, (runs, width, least) in CLASSES.items():
        number = KINDS.index(kind)
        for m in runs.finditer(text):
            if not allowed(m.group()):
                for a, b in entropy_spans(m.group(), width, least):
                    if not allowed(m.group()[a:b]):
                        out.append((m.start() + a, number, m.start() + b))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by fixed pattern, the fixed spans and all spans as ``kind:start:end``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = sorted(base_spans(text))
            every = sorted(base + high_entropy_spans(text))
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), _joined(base), _joined(every)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, work, SCHEMA)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; all their columns stay."""

    def cut(text):
        if text is None:
            return None
        out, at = [], 0
        for a, _, b in sorted(base_spans(text) + high_entropy_spans(text)):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        column = pa.array([cut(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return map_texts(docs, work, docs.schema, text_col)
