"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are runs of the characters that keys are written in.  Each run
belongs to a class with a threshold of its own (hexadecimal, letters of both
cases without a digit, others with digits and letters); over each window of
``WINDOW`` characters the counts of characters are moved along by one in and
one out, and with them the sum that gives the Shannon entropy.  A candidate in which a window is more random than
text of its alphabet can be is a secret, unless the allow list names it: words,
paths, numbers, identifiers of one case, and whatever patterns the caller adds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.llm.shared import id_or_last, id_or_null, tidy

# Patterns and least lengths of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

# A run is a candidate from this length on; windows have it too.
WINDOW = 20
# Bits a character: a window of 20 characters of which few repeat.  Random hexadecimal windows
# lie at 3.3 bits on average, random base-64 ones at 4.1, and words of one case rarely above 3.4.
LEAST_BITS = {"hex": 3.0, "mixed": 3.6, "letters": 3.7}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Only these runs can hold a hexadecimal match; equal to HEX and its least length.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
ALLOWED = (
    r"[A-Za-z]+",                     # words, however long
    r"[0-9]+",                        # numbers
    r"[=_+/-]+",                      # rules
    r"[A-Za-z]+(?:[-_/][A-Za-z]+)*",  # phrases and paths of words
)

_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def highest_entropy(run: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy, in bits a character, of the windows of a run."""
    terms = _TERM if window <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    size = min(window, len(run))
    for c in run[:size]:
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
    least = total
    for i in range(size, len(run)):
        gone, come = run[i - size], run[i]
        if gone != come:
            n = counts[gone]
            total += terms[n - 1] - terms[n]
            counts[gone] = n - 1
            n = counts.get(come, 0)
            total += terms[n + 1] - terms[n]
            counts[come] = n + 1
            if total < least:
                least = total
    return math.log2(size) - least / size if size else 0.0


def alphabet(run: str) -> str:
    """Class of a run by the characters it is made of: ``hex``, ``mixed``, ``letters``, or ``plain`` if it cannot be a key."""
    lower, upper = any("a" <= c <= "z" for c in run), any("A" <= c <= "Z" for c in run)
    if not any(c.isdigit() for c in run):
        return "letters" if lower and upper else "plain"
    if all(c in "0123456789abcdef" for c in run) or all(c in "0123456789ABCDEF" for c in run):
        return "hex"
    return "mixed" if lower or upper else "plain"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns: (start, kind number, end), leftmost and non-overlapping by kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end()) for m in _LONG_ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(spans)


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    spans = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if allowed.fullmatch(run):
            continue
        kind = alphabet(run)
        if kind != "plain" and highest_entropy(run) >= LEAST_BITS[kind]:
            spans.append((m.start(), 3, m.end()))
    return spans


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(allowed: tuple[str, ...], mark: str | None):
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["clean_text"] * (mark is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{p})" for p in allowed) or r"(?!)")
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, listed, clean = [], [], []
            for value in batch.column("__text"):
                text = value.as_py() or ""
                base = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans = sorted(base + entropy_spans(text, allow))
                listed.append(_listed(spans))
                if mark is not None:
                    clean.append(redacted(text, spans, mark) if value.is_valid else None)
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            columns += [pa.array(clean, pa.string())] * (mark is not None)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + columns, [batch.schema.names[i] for i in kept] + names)

    return run


def find_secrets(docs: DataFrame, id_: str = "doc_id", text: str = "text", allowed: Sequence[str] = ALLOWED,
                 keep: Sequence[str] = (), redact_with: str | None = None) -> DataFrame:
    """Secrets of each whole text, one row for each row of ``docs``.

    Returns ``doc_id``, the columns of ``keep``, ``n_assign, n_access, n_hex``
    (matches of the fixed patterns), ``base_sha256`` (digest of their list),
    ``spans`` (all as ``kind:start:end`` in code points, by start and then kind)
    and, with ``redact_with``, ``clean_text`` in which every span is replaced by
    that mark (null for a null text).  ``allowed`` are patterns that a whole
    candidate of the entropy scan may match to be left alone; they do not touch
    fixed patterns.  A null text counts as empty; repeated rows and null ids are
    kept as they are.  An empty table gives an empty result.
    """
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(id_or_last(id_).alias("doc_id"), *kept, F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    for name in ["base_sha256", "spans"] + ["clean_text"] * (redact_with is not None):
        schema = schema.add(name, "string")
    found = rows.mapInArrow(tidy(_scan(tuple(allowed), redact_with)), schema)
    names = {f"__keep{i}": c for i, c in enumerate(keep)}
    return found.withColumn("doc_id", id_or_null("doc_id")).withColumnsRenamed(names)
