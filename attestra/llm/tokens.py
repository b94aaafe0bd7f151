"""Token ids of whole texts for the word BPE vocabulary, encoding each different word once.

The vocabulary splits at white space and at letter, digit and other runs, so the ids of a text are
those of its white-space separated parts, one after the other. A batch of texts is split and its
different parts are numbered by Arrow; parts are looked up in a bounded memory of the worker, and
only new ones are encoded: letters by the BPE model alone, anything else by the whole tokenizer.
Texts beyond Latin-1, or with the marks of special tokens, go to the whole tokenizer as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker remembers; when half as many are met, those of the time before are forgotten.
REMEMBERED = 500_000

#: Bytes of text that are encoded at a time; a longer text is encoded alone.
SLICE_BYTES = 3_000_000

#: Lower-case letters that normal forms and the byte alphabet treat alike in every library.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: Texts that are not lower-cased and split here: beyond Latin-1, special tokens, odd white space.
SPECIAL = r"[^\x00-\x{FF}]|<\||[\x1c-\x1f]"


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose lengths add up to ``most`` at the utmost, or one row."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out


class WordEncoder:
    """Encodes batches of texts; keeps what it has learned."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = self._byte_letters()
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, dtype=bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves."""
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                   for w in words]
        lines = [" ".join(spelled[i:i + 100]) for i in range(0, len(spelled), 100)]
        ids = np.concatenate([np.asarray(e.ids, dtype="<u4") for e in self.words.encode_batch_fast(
            lines, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a word must end with an end-of-word token")
        raw, at, out = ids.tobytes(), 0, []
        for stop in (stops * 4).tolist():
            out.append(raw[at:stop])
            at = stop
        return out

    def _learn(self, parts: list[str]) -> None:
        plain, other = [], []
        for part in parts:
            (plain if PLAIN.fullmatch(part) else other).append(part)
        self.young.update(zip(plain, self._encode_plain(plain), strict=True))
        for part, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False),
                           strict=True):
            self.young[part] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _known(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        if None in found:
            new = [p for p, x in zip(parts, found, strict=True) if x is None]
            for p in new:
                if p in self.old:
                    self.young[p] = self.old[p]
            self._learn([p for p in new if p not in self.old])
            found = list(map(self.young.get, parts))
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, nulls as empty ones."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, SPECIAL).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i in np.flatnonzero(special).tolist():
            ids = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = np.asarray(ids, dtype="<u4")
        rows = np.flatnonzero(~special)
        if not len(rows):
            return out
        lowered = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(rows))),
                                             r"([a-zß-öø-ÿ])([.,])(\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.values.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begin = np.concatenate([[0], np.cumsum(length)])[:-1]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        which = coded.indices.to_numpy()
        each = length[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        shift = np.repeat(begin[which] - ends[:-1], each)
        tokens = flat[np.arange(ends[-1]) + shift]
        bounds = ends[lists.offsets.to_numpy()]
        for k, i in enumerate(rows.tolist()):
            out[i] = tokens[bounds[k]:bounds[k + 1]]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; files are read once per worker."""
    return WordEncoder(path)
