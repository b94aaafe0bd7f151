"""Spelling variants, conversation tries and byte-level BPE against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, prefix_trie, spelling
from attestra.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()
CLASHING = "ids array<int>, path string, word string, n long, shard int, skeleton int, key string, decoded string"
CLASHING_VALUES = ([1], "p", "w", 5, 1, 2, "k", "d")


# --- byte-level BPE ----------------------------------------------------------------------------

TEXTS = [None, "", " ", "plain words, and some more.", "don't we'll 'S it's", "  two  spaces \n\n\t tabs ",
         "<|endoftext|> is text", "naïve café 日本語。中文、文字 👍🏽", "1234567 abc123 x_y", " " * 5000 + "x",
         "\n" * 3000, "a" * 4000, "word " * 3000 + " " * 2000, "　" * 1500 + "!", "\x00\x1c\x85 odd"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, *CLASHING_VALUES) for i, t in enumerate(TEXTS)] + [(None, "again", *CLASHING_VALUES)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASHING).repartition(3).cache()


def test_byte_bpe_equals_the_library(spark, texts):
    library = byte_bpe.library_encoder(RANKS, public_tokenizers.PATTERN)
    out = byte_bpe.decode(byte_bpe.encode(texts, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "ids", "decoded"]
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted([*map(str, range(len(TEXTS))), "None", "None"])
    for r in rows:
        text = "again" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert byte_bpe.encode(texts.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_cuts_only_where_matches_end(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_RUN", 4)
    monkeypatch.setattr(byte_bpe, "RUN", re.compile(f"[{byte_bpe.SPACE}]{{4,}}"))
    library = byte_bpe.library_encoder(RANKS, public_tokenizers.PATTERN)
    letters = [*"ab'srel 1  \n\t.,;-é中。 ", "'s", "   ", "'ll", "    ", "\x1c", "\x85", "　", "​"]
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        cut = list(byte_bpe.parts(text, rng.randint(1, 12)))
        assert "".join(part for part, _ in cut) == text
        ids = [i for part, single in cut for i in (
            library._encode_single_piece(part) if single else library.encode_ordinary(part))]
        assert ids == library.encode_ordinary(text)


def test_byte_bpe_takes_very_long_runs_and_broken_text(spark):
    long = "x" + " " * 2_000_000 + "y"
    broken = spark.createDataFrame([(1, long, bytearray(b"a\xffb"))], "doc_id long, text string, raw binary")
    r = byte_bpe.decode(byte_bpe.encode(broken, RANKS, public_tokenizers.PATTERN), RANKS).first()
    assert bytes(r["decoded"]).decode() == long
    bad = broken.select("doc_id", F.col("raw").cast("string").alias("text"))
    r = byte_bpe.decode(byte_bpe.encode(bad, RANKS, public_tokenizers.PATTERN), RANKS).first()
    assert bytes(r["decoded"]).decode() == "a�b"


def test_decode_gives_raw_bytes_and_refuses_unknown_ids(spark):
    ids = byte_bpe.library_encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary("日本")
    rows = spark.createDataFrame([(0, ids[:1]), (1, None), (2, [])], "k int, ids array<int>")
    out = {r["k"]: r["decoded"] for r in byte_bpe.decode(rows, RANKS).collect()}
    assert "日本".encode().startswith(bytes(out[0])) and out[1] is None and bytes(out[2]) == b""
    with pytest.raises(Exception, match="not in the rank file"):
        byte_bpe.decode(spark.createDataFrame([(0, [999_999])], "k int, ids array<int>"), RANKS).collect()
    with pytest.raises(ValueError):
        byte_bpe.decode(rows.withColumn("decoded", F.lit(1)), RANKS)
    with pytest.raises(ValueError):
        byte_bpe.encode(rows.withColumn("text", F.lit("")), RANKS, public_tokenizers.PATTERN, keep=("ids",))


def test_op13_digests(spark):
    library = byte_bpe.library_encoder(RANKS, public_tokenizers.PATTERN)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


# --- conversation prefix trie ------------------------------------------------------------------

def brute_trie(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(conversations):
        path = tuple(conversations[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(frame) -> list[str]:
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in frame.collect())


def random_conversations(seed: int, n: int) -> dict[int, list[tuple[str, str]]]:
    """Short turns of few kinds, so that prefixes are shared; a third are copies of one conversation."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", ""]), rng.choice(["", "a", "bb", "çé", "long " * 9]))
    copy = [turn() for _ in range(6)]
    out = {}
    for _ in range(n):
        c = rng.randrange(-20_000, 60_000)
        out[c] = list(copy) if rng.random() < 0.34 else [turn() for _ in range(rng.randint(0, 7))]
    out[70_001] = copy + [turn() for _ in range(40)]
    return out


@pytest.mark.parametrize("shards,sampled,turns", [(1, 32, 512), (5, 32, 512), (24, 2, 3)])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, shards, sampled, turns):
    """Also with splitters that are cut, few samples and many shards."""
    monkeypatch.setattr(prefix_trie, "SAMPLED", sampled)
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", turns)
    conversations = random_conversations(shards, 300)
    rows = [(c, k, r, t) for c, path in conversations.items() for k, (r, t) in enumerate(path)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    paths = prefix_trie.turn_paths(table)
    # Conversations without turns have no rows; the trie takes them as empty paths.
    empty = spark.createDataFrame([(c,) for c, path in conversations.items() if not path], "conv_id long")
    paths = paths.unionByName(empty.withColumn("path", F.lit(b"")))
    got = trie_rows(prefix_trie.prefix_trie(paths, shards))
    assert got == sorted(map(str, brute_trie(conversations)))


def test_skeleton_holds_every_node_of_two_shards():
    rng = random.Random(4)
    alphabet = [bytes([k]) * prefix_trie.TURN_BYTES for k in range(3)]
    paths = sorted({b"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(300)})
    for shards in (2, 7, 40):
        skeleton = prefix_trie.Skeleton.of_sample(rng.sample(paths, 60), shards)
        assert len(skeleton.splitters) < shards and [skeleton.shard(p) for p in paths] == sorted(
            skeleton.shard(p) for p in paths)
        where = collections.defaultdict(set)
        for p in paths:
            for d in range(0, len(p) + 1, prefix_trie.TURN_BYTES):
                where[p[:d]].add(skeleton.shard(p))
        assert all(p in skeleton.ids for p, s in where.items() if len(s) > 1)


def test_turns_order_and_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", "first"), (1, 2, "assistant", "b"), (None, 1, "user", "x"),
            (2, 0, None, None), (2, 1, "", ""), (3, 0, "user", "x" * 100_000), (3, 0, "user", "x" * 100_000)]
    table = spark.createDataFrame([(*r, *CLASHING_VALUES) for r in rows],
                                  "conv_id long, turn long, role string, text string, " + CLASHING)
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_paths(table), 3))
    assert got == sorted(map(str, brute_trie({
        1: [("user", "first"), ("assistant", "b"), ("user", "b")], 2: [("", ""), ("", "")],
        3: [("user", "x" * 100_000)] * 2})))
    assert prefix_trie.prefix_trie(prefix_trie.turn_paths(table.where("false")), 3).count() == 0


def test_op12_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(9)
    original = {c: [("user", rng.choice("abc") * rng.randint(1, 9)) for _ in range(rng.randint(1, 6))]
                for c in [*range(100, 160), *range(215, 260), -100, -7, 0]}
    rows = [(c, k, r, t) for c, path in original.items() for k, (r, t) in enumerate(path)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    rebuilt = {}
    for c, path in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = original.get(base, [])[:h] + path[h:]
    assert any(not path for path in rebuilt.values())
    assert trie_rows(QUERIES["op12_conversation_prefix_trie"](spark, str(tmp_path))) == sorted(
        map(str, brute_trie(rebuilt)))


# --- spelling variants -------------------------------------------------------------------------

def edits(word: str, alphabet: str) -> set[str]:
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute_variants(counts: dict[str, int]) -> list[tuple]:
    alphabet = "".join(sorted({c for w in counts for c in w}))
    form, near = {}, {}
    for w, n in counts.items():
        found = [x for x in edits(w, alphabet) if x in counts]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return [(w, form[w], root(w), n, near[w], counts.get(form[w])) for w, n in counts.items()]


def random_words(seed: int, n: int, alphabet: str) -> dict[str, int]:
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9)))
        words.add(w)
        if rng.random() < 0.6:
            other = rng.choice(sorted(edits(w, alphabet)))
            words |= {other} if len(other) >= 5 else set()
    return {w: int(2 ** (rng.random() * 12)) + 3 for w in sorted(words)}


@pytest.mark.parametrize("frequent,alphabet,rows,broadcast", [
    (32, "abcdefgh", 20_000, 9), (1, "ab", 40, 0), (1, "abc", 15, 500), (10 ** 9, "abcé", 20_000, 9)])
def test_variants_equal_brute_force(spark, monkeypatch, frequent, alphabet, rows, broadcast):
    """With a usual dictionary, two in which nearly every gram is frequent and lists are dealt, an empty one."""
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "LIST_ROWS", rows)
    monkeypatch.setattr(spelling, "BROADCAST_LISTS", broadcast)
    counts = random_words(len(alphabet), 250 if alphabet == "ab" else 700, alphabet)
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.group_variants(table).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_variants(counts)))


def test_the_dictionary_counts_grams(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 1)
    words = ["banana", "bananas", "cabana", "xyzzy", "ééééé"]
    counts = collections.Counter(
        m[p:p + n] for m in (spelling.BEGIN + w + spelling.END for w in words)
        for n in range(2, 5) for p in range(len(m) - n + 1))
    table = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling.frequent_grams(table) == {g: n for g, n in counts.items() if n > 1}


def test_an_edit_changes_at_most_the_bound():
    rng = random.Random(2)
    frequent = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 3))): 5 for _ in range(14)}
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 10)))
        grams, bound = spelling.decompose(word, frequent)
        assert 0 < bound < len(grams)
        for other in edits(word, "abc"):
            if len(other) < 5:
                continue
            theirs, their_bound = spelling.decompose(other, frequent)
            shared = sum((collections.Counter(grams) & collections.Counter(theirs)).values())
            assert shared >= max(len(grams) - bound, len(theirs) - their_bound)
            left = {grams[p] for p in spelling.rarest(grams, bound + 1, frequent)}
            assert left & {theirs[p] for p in spelling.rarest(theirs, their_bound + 1, frequent)}


def test_lists_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(spelling, "SIDE_BY_SIDE", 4)
    monkeypatch.setattr(spelling, "BLOCK", 8)
    group = np.repeat(np.arange(60), rng.integers(1, 40, 60))
    letters = rng.integers(0, 64, len(group)).astype(np.uint64)
    found = [(x, y) for i, j in spelling.list_pairs(group, letters) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == {
        (x, y) for x in range(len(group)) for y in range(x + 1, len(group))
        if group[x] == group[y] and (int(letters[x]) ^ int(letters[y])).bit_count() <= 2}


def test_one_edit_equals_brute_force():
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    pairs = [(a, b) for a in words for b in words if len(b) - len(a) in (0, 1)]
    got = spelling.one_edit(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [b in edits(a, "ab") for a, b in pairs]


def test_forms_are_followed_to_the_end(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(20)]
    out = {r["word"]: r["root"] for r in spelling.follow(
        spark.createDataFrame(chain, "word string, form string")).collect()}
    assert out == {w: "w20" for w, _ in chain}


def test_op11_counts_damaged_words(spark, tmp_path):
    words = ["colour", "colours", "Über", "ÉTÉS", "naïve", "x÷yzzz", "harbour", "HARBOUR"]
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(60)]
    texts += [(60, None), (60, ""), (61, "123 -- 日本語"), (None, "colour colour colour"), (62, "harbour " * 3000)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit(1)).write.parquet(
        f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_variants(counts)))
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(nothing).count() == 0


def test_lists_have_letters_of_any_code_point(spark):
    table = spark.createDataFrame([("aß日本語x", 3), ("aß日本語", 9)], "word string, n long")
    out = {r["word"]: r["form"] for r in spelling.group_variants(table).collect()}
    assert out == {"aß日本語x": "aß日本語", "aß日本語": None}
    assert np.uint64(1 << 63).view(np.int64) < 0
