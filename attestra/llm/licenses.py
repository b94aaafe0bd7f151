"""License scan: exact phrases, and short notices found within a bounded number of edits.

Fuzzy search by the pigeonhole principle: a notice with at most k edits is cut into k + 1 seeds, one
of which a match holds unchanged. Seeds are looked for in the whole folded text; the regex library
then matches the notice with its error bound around each place and reports the span. A match must
also hold the words that name the license, within an error bound of their own and with no rival word
or other version number in their place, so that other licenses do not pass as edits.

Folding: A-Z lower-cased, every run of ASCII characters other than letters and digits one space.
Words are what then stands between spaces, so ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: a null or empty text has no words, no places, no labels and score 0; repeated rows
and null ids each give their own row; an empty table gives an empty result. Only the id and the text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Phrases of whole words and their labels (fixed values).
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Short notices of well-known licenses, folded, and their labels (fixed values).
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("dedicated to the public domain", "public-domain"),
)

#: One edit is allowed for so many characters of a notice, and of a word that names the license.
CHARS_PER_EDIT = 10
CHARS_PER_TELLING_EDIT = 3

#: Words that name a license, and words that name another one in their place (fixed values).
TELLING = {
    "mit": (), "apache": (), "mozilla": (), "lesser": (), "affero": (), "domain": (),
    "nc": ("nd", "sa"), "sa": ("nc", "nd"),
    "noncommercial": ("commercial", "noderivatives", "noderivs", "sharealike"),
    "sharealike": ("commercial", "noderivatives", "noderivs", "noncommercial"),
}
#: The version of a license, at the end of a notice, and numbers in a text with at most one stray character.
VERSION = regex.compile(rb"(?<=version )[0-9 ]+$")
NUMBER = regex.compile(rb"(?<![^ ])[^0-9 ]?([0-9]+)|([0-9]+)(?=[^0-9 ]?(?: |$))")

_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32
              for c in range(256))


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    pattern: regex.Pattern
    seeds: tuple[tuple[bytes, int], ...]  # with the seed's place in the notice
    telling: tuple[tuple[int, int, regex.Pattern, frozenset[bytes]], ...]  # place, length, wording, rivals
    version: tuple[int, bytes] | None  # place and digits


def notice(text: str, label: str) -> Notice:
    raw = text.encode()
    edits = max(1, len(raw) // CHARS_PER_EDIT)
    cuts = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
    # Substitutions, insertions and deletions count alike; a match found is then fitted better.
    pattern = regex.compile(b"(?e)(?:%s){e<=%d}" % (regex.escape(raw), edits))
    seeds = tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False))
    telling = []
    for m in regex.finditer(rb"[^ ]+", raw):
        word = m[0].decode()
        if word in TELLING:
            own = regex.compile(b"(?:%s){e<=%d}" % (regex.escape(m[0]), max(1, len(m[0]) // CHARS_PER_TELLING_EDIT)))
            telling.append((m.start(), len(m[0]), own, frozenset(x.encode() for x in TELLING[word])))
    v = VERSION.search(raw)
    return Notice(raw, label, edits, pattern, seeds, tuple(telling), v and (v.start(), v[0].replace(b" ", b"")))


def names_license(text: bytes, begin: int, stop: int, n: Notice) -> bool:
    """Whether a match holds the notice's telling words and version, or only its other words."""
    for place, size, own, rivals in n.telling:
        a, b = max(0, begin + place - n.edits), begin + place + size + n.edits
        if not own.search(text, a, min(b, len(text))):
            return False
        # Whole words that reach into the place of the telling word.
        a, b = text.rfind(b" ", 0, begin + place + 1) + 1, text.find(b" ", begin + place + size)
        if rivals & set(text[max(begin, a - n.edits):b if b >= 0 else len(text)].split()):
            return False
    if n.version:
        place, digits = n.version
        end = text.find(b" ", max(stop - 1, 0) + (text[stop - 1:stop] == b" "))
        end = end if end >= 0 else len(text)
        a = max(begin, begin + place - n.edits)
        found = b"".join(x or y for x, y in NUMBER.findall(text, a, end))
        if len(found) < len(digits):
            after = text.find(b" ", end + 1)
            found = b"".join(x or y for x, y in NUMBER.findall(text, a, after if after >= 0 else len(text)))
        rest = iter(digits)
        return all(d in rest for d in found)
    return True


def folded(text: str | None) -> bytes:
    """The words of a text, single spaces between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def places(text: bytes, phrase: bytes) -> Iterator[int]:
    """Byte places where the phrase's words stand consecutively."""
    padded, wanted = b" " + text + b" ", b" " + phrase + b" "
    at = padded.find(wanted)
    while at >= 0:
        yield at
        at = padded.find(wanted, at + 1)


def windows(text: bytes, n: Notice) -> list[tuple[int, int]]:
    """Where a match may lie: around each seed, as far as the edits can move it; joined if they meet."""
    found = []
    for seed, place in n.seeds:
        at = text.find(seed)
        while at >= 0:
            found.append((max(0, at - place - n.edits), at - place + len(n.text) + n.edits))
            at = text.find(seed, at + 1)
    joined: list[tuple[int, int]] = []
    for begin, stop in sorted(found):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((begin, stop))
    return joined


def fuzzy_spans(text: bytes, notices: tuple[Notice, ...]) -> list[tuple[int, int, str, int]]:
    """Spans within the error bound: ``start, stop, label, edits``.

    Where notices of different wording meet, those with more edits than another give way.
    """
    out = []
    for n in notices:
        for begin, stop in windows(text, n):
            at, stop = begin, min(stop, len(text))
            while m := n.pattern.search(text, at, stop):
                named = names_license(text, m.start(), m.end(), n)
                if named:
                    out.append((m.start(), m.end(), n.label, sum(m.fuzzy_counts)))
                at = m.end() if named else m.start() + 1
    return sorted(x for x in set(out)
                  if not any(y[3] < x[3] and y[0] < x[1] and x[0] < y[1] for y in out))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, words`` (places of base phrases) and ``spans``.

    ``words`` has the word number, from 0, and label of each exact phrase; ``spans`` the byte range
    in the folded text, the label and the edits of each notice found, with its folded wording.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, words array<struct<word: long, label: string>>, "
              "spans array<struct<start: long, stop: long, label: string, edits: int, found: string>>")
    exact = tuple((p.encode(), label) for p, label in phrases)
    listed = tuple((text, label) for text, label in notices)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tuple(notice(*x) for x in listed)
        for batch in batches:
            for begin in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(begin, 500)
                counts, words, spans = [], [], []
                for value in part.column(1):
                    text = folded(value.as_py())
                    counts.append(text.count(b" ") + 1 if text else 0)
                    words.append(sorted(
                        ({"word": text.count(b" ", 0, at), "label": label}
                         for phrase, label in exact for at in places(text, phrase)),
                        key=lambda x: (x["word"], x["label"])))
                    spans.append([{"start": a, "stop": b, "label": label, "edits": edits,
                                   "found": text[a:b].decode("utf-8", "replace")}
                                  for a, b, label, edits in fuzzy_spans(text, compiled)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()),
                     pa.array(words, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                     pa.array(spans, pa.list_(pa.struct([
                         ("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()),
                         ("edits", pa.int32()), ("found", pa.string())])))],
                    names=["doc_id", "n_words", "words", "spans"])

    return docs.select(id_column, text_column).mapInArrow(scan, schema)
