"""Byte-level BPE: token ids of whole texts by the tiktoken library, and back to bytes.

``encode`` reads a local rank file and gives each text's ids; ``decode`` puts the tokens' raw bytes
together again. The pattern splits a text into matches that are encoded separately, so a long text
may be cut where a match must end anyway: before white space that follows another character, or
between a letter and a punctuation mark. Parts are encoded one after the other, which bounds
the library's memory. A white-space run of ``LONG_RUN`` characters or more, which the library's
pattern engine gives up on at some length, is a match of its own up to its last character (to its
end, where the text ends) and is encoded as one.

Defined cases: a null or empty text has no ids, and no ids decode to empty bytes; null ids decode to
null; a text that is not valid UTF-8 has its faulty bytes replaced by U+FFFD first; marks of special
tokens are ordinary text; very long texts give the ids that the library gives for the whole;
repeated rows and null ids of documents each keep their own row; an empty table gives an empty
result. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.tokens import slices

#: Characters of a text that are encoded at a time, to the next safe boundary.
PART_CHARS = 200_000
#: Bytes of texts, or ids, that make one batch of results.
BATCH_BYTES, BATCH_IDS = 2_000_000, 500_000
#: White-space runs from this length on are not given to the pattern engine.
LONG_RUN = 1_000

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
#: Where a match ends whatever follows, and the next one is the same whatever went before.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n\r\t])|(?<=[A-Za-z\u4e00-\u9fff])(?=[.,;:!?()\u3001\u3002])")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: lines of a base64 token, a space and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in the order of their ranks, and where each begins (one more at the end)."""
    tokens = {i: t for t, i in ranks(path).items()}
    lengths = [len(tokens.get(i, b"")) for i in range(max(tokens) + 1)]
    flat = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), dtype=np.uint8)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def parts(text: str, most: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """Stretches that add up to the text and are encoded by themselves; True: a single match."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > most and (cut := BOUNDARY.search(text, at + most)):
            stop = cut.start()
        if stop - at >= LONG_RUN:
            for run in RUN.finditer(text, at, stop):
                # The pattern looks one character ahead: a run's last one goes with what follows it.
                end = run.end() if run.end() == len(text) else run.end() - 1
                if run.start() > at:
                    yield text[at:run.start()], False
                yield text[run.start():end], True
                at = end
        if stop > at:
            yield text[at:stop], False
        at = stop


def encode_text(encoder, text: str) -> np.ndarray:
    """The ids of one text."""
    if len(text) < LONG_RUN:
        return encoder.encode_to_numpy(text)
    out = [np.asarray(encoder._encode_single_piece(part), dtype=np.uint32) if single
           else encoder.encode_to_numpy(part) for part, single in parts(text)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
           text_column: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``ids array<int>``, a row per document.

    ``ranks_path`` is a file on every machine; ``keep`` must not hold a column ``ids``.
    """
    if "ids" in keep:
        raise ValueError("the ids need a column of their own: rename the column ids first")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(0)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for begin, stop in slices(sizes, BATCH_BYTES):
                ids = [encode_text(encoder, t or "") for t in texts.slice(begin, stop - begin).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                    np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, stop - begin) for c in batch.columns[1:]), lists], names=[*keep, "ids"])

    text = F.make_valid_utf8(F.col(f"`{text_column}`")).alias("_text")
    return docs.select(text, *[F.col(f"`{c}`") for c in keep]).mapInArrow(
        run, f"{schema}, ids array<int>" if keep else "ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, ids_column: str = "ids") -> DataFrame:
    """All columns and ``decoded binary``: the raw bytes of the tokens, which may not be whole characters.

    An id that the rank file does not have is an error. The table must not hold a column ``decoded``.
    """
    if "decoded" in tokens.columns:
        raise ValueError("the bytes need a column of their own: rename the column decoded first")
    place, names = tokens.columns.index(ids_column), tokens.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts = token_bytes(ranks_path)
        for batch in batches:
            lists = batch.column(place)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for begin, stop in slices(counts, BATCH_IDS):
                part = lists.slice(begin, stop - begin)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(starts) - 1:
                    raise ValueError("an id is not in the rank file")
                lengths = starts[ids + 1] - starts[ids]
                ends = np.concatenate([[0], np.cumsum(lengths)])
                data = flat[np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], lengths)]
                bounds = ends[np.concatenate([[0], np.cumsum(counts[begin:stop])])].tolist()
                raw = data.tobytes()
                decoded = [raw[x:y] if ok else None for x, y, ok in zip(
                    bounds, bounds[1:], part.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(begin, stop - begin) for c in batch.columns), pa.array(decoded, pa.binary())],
                    names=[*names, "decoded"])

    return tokens.mapInArrow(run, f"{schema}, decoded binary")
