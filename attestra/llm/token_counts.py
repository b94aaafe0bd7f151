"""Token counts by section, from one encoding of each whole document.

The text is encoded once. Tokens are byte strings that add up to the text, so the running sum of
their lengths is each token's span. Sections are byte ranges that cover the text; a token belongs
to the section that holds its start, found by an interval join (binary search of the token starts
among the sections' starts). A token that crosses a boundary is counted where ``rule`` says.

Defined cases: a null or empty text has one empty section with no tokens; a text without separators
is one section; repeated rows and null ids each give their own rows; an empty table gives an empty
result. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where a token goes that crosses a boundary: "first" (the section with its first byte), "last"
#: (with its last byte) or "most" (with most of its bytes, the first of those with equally many).
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str):
    """The worker's encoder of a ranks file and the length in bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(text: bytes) -> np.ndarray:
    """Byte places where lines begin; a line keeps its line feed."""
    raw = np.frombuffer(text, dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    return starts[starts < len(raw)] if len(raw) else starts[:1]


def attribute(starts: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens per section; ``lengths`` are those of the tokens in bytes."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = last > first
    where = first if rule == "first" else last
    if rule == "most":
        where = first.copy()
        bounds = np.append(starts, ends[-1] if len(ends) else 0)
        for t in np.flatnonzero(crossing).tolist():
            parts = bounds[first[t]:last[t] + 2].clip(begins[t], ends[t])
            where[t] = first[t] + int(np.argmax(np.diff(parts)))
    n = len(starts)
    return np.bincount(where, minlength=n), np.bincount(where[crossing], minlength=n)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",),
                 sections: str = "lines", rule: str = "first", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, section, start, length, n_tokens, n_crossing``: a row per section of each document.

    With one field the sections are its lines (``sections="lines"``) or the field itself; with
    several, the document is the fields joined by line feeds, encoded as a whole, and the sections
    are the fields, each with the line feed after it. ``start`` and ``length`` are in bytes.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    by_line = sections == "lines" and len(fields) == 1
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = byte_encoder(ranks_path, pattern)
        names = ["section", "start", "length", "n_tokens", "n_crossing"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows, columns = [], [[] for _ in names]
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)):
                    fielded = [v or "" for v in values]
                    text = "\n".join(fielded)
                    raw = text.encode("utf-8", "replace")
                    if by_line:
                        starts = line_starts(raw)
                    else:
                        ends = np.cumsum([len(v.encode("utf-8", "replace")) + 1 for v in fielded])
                        starts = np.concatenate([[0], ends[:-1]])
                    ids = np.asarray(encoder.encode_ordinary(text), dtype=np.int64)
                    tokens, crossing = attribute(starts, sizes[ids], rule)
                    rows.append(np.full(len(starts), i, dtype=np.int32))
                    for out, new in zip(columns, (np.arange(len(starts)), starts, np.diff(
                            np.append(starts, len(raw))), tokens, crossing), strict=True):
                        out.append(new)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(rows))),
                     *[pa.array(np.concatenate(c).astype(np.int64)) for c in columns]],
                    names=["doc_id", *names])

    return docs.select(id_column, *fields).mapInArrow(
        count, f"doc_id {kind}, section long, start long, length long, n_tokens long, n_crossing long")
