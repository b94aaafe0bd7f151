"""Each operator against a brute-force version, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import (
    embedding_dedup, fingerprints, licenses, mixing, ngram_join, packing, suffix_array,
    suffix_dedup, token_counts, toxicity, url_filters,
)
from attestra.llm.common import ranked
from attestra.llm.queries import QUERIES, SQL, word_vocabulary

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
#: Columns whose names clash with those the operators add.
EXTRA = "key string, rank long, size long, copies long, p_toxic double, block int, _own string"
EXTRA_VALUES = ("x", 1, 2, 3, 0.5, 4, "y")


def story(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(30)) for i in rng.integers(len(WORDS), size=n))


def odd_texts() -> list[tuple[int | None, str | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, ties, shared passages, near copies, a long text."""
    passage, base = story(1, 90), story(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "a"), (2, "", None), (3, "  \n\t ", "b"), (4, base, "a"), (5, base, None),
        (6, " ".join(near), "c"), (7, story(3, 40) + " " + passage + " " + story(4, 30), "a"),
        (8, passage + " " + story(5, 50), "b"), (9, "short text", "c"), (None, story(6, 80), "a"),
        (None, story(7, 80) + passage, None), (10, "é" * 450 + "ñ", "b"), (11, "ab" * 700, "a"),
        (12, story(8, 4000), "c"), (12, story(9, 30), "c"), (13, "one two three", "a"), (13, "one two three", "a"),
        (14, "x", "d"), (15, story(8, 3900) + " tail", "b"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, *EXTRA_VALUES) for i, t, s in odd_texts()],
                                 "doc_id long, text string, source string, " + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# --- suffix-array dedup ------------------------------------------------------------------------

def removed(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans: list[list[int]] = []
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        edges = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_classes_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        length = int(rng.integers(8, 50))
        source = rng.integers(97, 97 + int(rng.integers(1, 4)), 400).astype(np.uint8)
        parts = []
        for _ in range(int(rng.integers(1, 30))):
            a = int(rng.integers(0, 300))
            part = source[a:a + int(rng.integers(1, 150))].copy()
            if rng.random() < 0.5:
                part[rng.integers(len(part))] = rng.choice([0, 200])
            parts.append(part)
        starts, again, classes = suffix_array.repeated_starts(
            np.concatenate(parts), np.array([len(p) for p in parts]), length)
        windows = [bytes(p[i:i + length]) for p in parts for i in range(len(p) - length + 1)]
        count = collections.Counter(windows)
        assert len(starts) == len(windows)
        assert again.tolist() == [count[w] > 1 for w in windows]
        assert len(set(zip(windows, classes.tolist()))) == len(set(windows)) == len(set(classes.tolist()))


@pytest.mark.parametrize("length,shard,slice_bytes", [(400, 2_500_000, 1_500_000), (40, 3000, 700)])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, length, shard, slice_bytes):
    """The second case splits texts into slices and anchors over shards."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 50)
    rows = odd_texts()
    many = [(100 + k, story(50 + k, 12) + " " + story(1, 60) + " " + story(90 + k, 12), "a") for k in range(60)]
    rows += many if length == 40 else []
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = suffix_dedup.remove_repeats(table, length).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    expected = [(i, *x) for (i, _, _), x in zip(rows, removed([t for _, t, _ in rows], length), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_suffix_dedup_shows_passages_below_the_length(spark, docs):
    """Passages too short for the length itself: both lengths equal brute force, the contract's columns stay."""
    rows = [(i, t) for i, t, _ in odd_texts()]
    rows += [(200 + k, story(300 + k, 9) + " " + story(1, 90)[:60 + 15 * k] + "é" + story(400 + k, 9)) for k in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 110, passage=50)
    assert got.columns[:6] == suffix_dedup.remove_repeats(docs, 110).columns
    texts = [t for _, t in rows]
    expected = [(i, *x, *y[1:3]) for (i, _), x, y in zip(rows, removed(texts, 110), removed(texts, 50), strict=True)]
    assert sorted(map(str, map(tuple, got.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages").collect()))) == sorted(
        map(str, expected))
    assert any(y > 0 == x for _, _, x, _, _, y, _ in expected)


def test_suffix_dedup_names_few_windows_of_a_common_passage(spark, monkeypatch):
    """A passage in many different texts: its windows do not become rows of each text."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    settled, made = suffix_dedup.settle, []
    monkeypatch.setattr(suffix_dedup, "settle", lambda df: (made.append(settled(df)), made[-1])[1])
    rows = [(k, story(500 + k, 30) + " " + story(1, 40) + " " + story(900 + k, 30)) for k in range(80)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    expected = [(i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], 60), strict=True)]
    assert sorted(map(tuple, got)) == sorted(expected)
    named = [df.agg(F.sum(F.size("classes"))).first()[0] or 0 for df in made if "classes" in df.columns]
    assert named and sum(named) <= 2 * len(rows)
    assert max(df.count() for df in made if "piece_id" in df.columns) <= 20 * len(rows)


def test_suffix_dedup_keeps_columns(docs, nothing):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] in (4, 9, 11)}
    assert texts == {4: "", 9: "short text", 11: ""}


# --- packing -----------------------------------------------------------------------------------

def test_packing_equals_tokenizer(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_vocabulary())
    out = [r.asDict() for r in packing.pack(docs, word_vocabulary(), 512).collect()]
    expected = []
    for i, t, _ in odd_texts():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.asarray(ids[at:at + 512], dtype="<u4")
            expected.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(nothing, word_vocabulary()).count() == 0


def test_encoder_equals_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from attestra.llm.tokens import WordEncoder

    texts = ["", "  ", "I'm don't 'S É é İx <|endoftext|> a<|startoftext|>b 12 34.5 x_y", "<|ENDOFTEXT|>",
             "ΣΑΣ ﬁ ªº ß ẞ", "ªº ßü. Àé, µ. x., y.. 3. (a). a's. %.\n ÷× ÿŸ a.b. c,", "a b c\x1cd\x85e\xa0f. \x0bg\x0ch",
             "...,,, a., b,. ×÷", "ａｂ ① 日本 👍🏽", None, story(4, 500)]
    whole = Tokenizer.from_file(word_vocabulary())
    got = WordEncoder(word_vocabulary()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bin_completion_is_complete_and_near_the_bound():
    rng = np.random.default_rng(3)
    for n, low, high in ((1, 5, 6), (40, 1, 101), (3000, 1, 101), (500, 30, 60)):
        counts = np.bincount(rng.integers(low, high, n), minlength=101)
        filled, used = np.zeros(101, dtype=int), 0
        for filling, times in packing.bin_completion(counts, 100):
            assert sum(filling) <= 100
            np.add.at(filled, np.array(filling), times)
            used += times
        assert (filled == counts).all()
        assert packing.least_sequences(counts, 100) <= used <= sum(t for _, t in packing.best_fit(counts, 100))
    # Best fit needs four here; bin completion finds the three.
    counts = np.zeros(101, dtype=int)
    for size in (60, 50, 50, 40, 36, 34, 30):
        counts[size] += 1
    assert sum(t for _, t in packing.bin_completion(counts, 100)) == 3


# --- mixing ------------------------------------------------------------------------------------

def test_mixing_meets_targets(docs, nothing):
    size = mixing.word_count(F.col("text"))
    out = [r.asDict() for r in mixing.mix_sources(docs, size).collect()]
    again = [r.asDict() for r in mixing.mix_sources(docs.repartition(5), size).collect()]
    key = lambda r: str(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    words = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in odd_texts()]
    assert sorted(map(str, words)) == sorted(str((r["doc_id"], r["source"], r["size"])) for r in out)
    sizes = collections.Counter()
    for _, s, n in words:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
    target.update(share)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    for s in order:
        taken = sum(r["taken"] for r in out if r["source"] == s)
        # No choice of up to three of each document comes nearer.
        reach = {0}
        for n in [n for _, x, n in words if x == s]:
            reach = {a + n * k for a in reach for k in range(4)}
        assert abs(taken - target[s]) <= min(abs(x - target[s]) for x in reach) + 1
    assert mixing.mix_sources(nothing, size).count() == 0
    assert mixing.apply_mix(nothing, size).count() == 0
    mixed = mixing.apply_mix(docs, size)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_knapsack_fits_exactly():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 60, 12))
        counts = rng.integers(1, 9, len(sizes))
        budget = int(rng.integers(1, (sizes * counts).sum() + 1))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            reach = {r + s * k for r in reach for k in range(c + 1)}
        best = min(reach, key=lambda r: (abs(r - budget), r))
        got = mixing.knapsack(sizes, counts, budget, rng.permutation(len(sizes)))
        assert (got <= counts).all() and int((got * sizes).sum()) == best
        fitted = mixing.fit_counts(sizes, counts, budget, 1)
        assert (fitted <= counts).all() and abs(int((fitted * sizes).sum()) - budget) <= sizes.max()


def test_rank_counts_every_row(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"))
    rows = ranked(df, ["k"], "h").collect()
    for k in range(3):
        own = sorted((r["rank"], r["h"]) for r in rows if r["k"] == k)
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1])


# --- token counts ------------------------------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, rule):
    import public_tokenizers as tokenizers_of

    texts = [None, "", "one line", "a\n\n\nb\n", "\n\n", "é\nñ\n\n\n  x", story(3, 900).replace(" eta1 ", "\n\n")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizers_of.path("byte_bpe_50k.tiktoken")
    out = token_counts.count_tokens(table, path, tokenizers_of.PATTERN, rule=rule).collect()
    encoder, _ = token_counts.byte_encoder(path, tokenizers_of.PATTERN)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        lines = raw.splitlines(keepends=True) if raw else [b""]
        counts, at, place = [0] * len(lines), 0, [k for k, line in enumerate(lines) for _ in line]
        for token in encoder.encode_ordinary(text or ""):
            n = len(encoder.decode_single_token_bytes(token))
            own = place[at:at + n]
            pick = own[0] if rule == "first" else own[-1] if rule == "last" else max(own, key=lambda k: (own.count(k), -k))
            counts[pick] += 1
            at += n
        got = sorted((r["section"], r["length"], r["n_tokens"]) for r in out if r["doc_id"] == i)
        assert got == [(k, len(line), counts[k]) for k, line in enumerate(lines)]


def test_token_counts_of_fields(docs, nothing):
    import public_tokenizers as tokenizers_of

    path = tokenizers_of.path("byte_bpe_50k.tiktoken")
    out = token_counts.count_tokens(docs, path, tokenizers_of.PATTERN, fields=("source", "text")).collect()
    assert len(out) == 2 * docs.count()
    assert token_counts.count_tokens(nothing, path, tokenizers_of.PATTERN).count() == 0


# --- embeddings --------------------------------------------------------------------------------

def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(16).tolist(), i % 2) for i in range(200)]
    rows += [(1000 + i, (np.array(rows[3][1]) + 0.02 * rng.standard_normal(16)).tolist(), 1) for i in range(50)]
    rows += [(2000 + i, rows[8][1], 0) for i in range(4)] + [(2000, rows[8][1], 0)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 1), (3003, [None] + [1.0] * 15, 1),
             (3004, rows[8][1], None), (3005, [], 0), (3006, [1.0, 2.0], 0), (None, rows[10][1], 0),
             (3007, (2 * np.array(rows[12][1])).tolist(), 0), (3008, [float("inf")] * 16, 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "vec_id long, embedding array<double>, label int, node int, key string")
    out = embedding_dedup.near_duplicates(table).collect()
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v
          and np.isfinite(v).all() and np.any(v)]
    links = collections.Counter()
    least = list(range(len(rows)))
    for a in ok:
        for b in ok:
            va, vb = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(va) == len(vb) and (
                    va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98):
                links[a] += 1
                low = min(least[a], least[b])
                old = {least[a], least[b]}
                least = [low if x in old else x for x in least]
    expected = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if least[j] == least[k] and rows[j][0] is not None]
        first = min(ids) if ids else None
        expected.append((i, links[k], first, i is not None and i == first))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0


def test_dense_groups_joined_by_few_links(spark, monkeypatch):
    """Two groups fill every list from their own side; only links between them of 0.98 to 0.99 join them."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(11)
    axes = np.eye(24)
    centers = [axes[0], np.cos(0.175) * axes[0] + np.sin(0.175) * axes[1], axes[2]]
    rows = [(100 * g + k, (c + 0.004 * rng.standard_normal(24)).tolist(), 1) for g, c in enumerate(centers) for k in range(40)]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    assert sims[:40, :40].min() > 0.997 and 0.98 < sims[:40, 40:80].max() < 0.99
    for k, (i, _, _) in enumerate(rows):
        assert out[i]["n_links"] == (sims[k] >= 0.98).sum() - 1
        assert out[i]["component_id"] == (0 if i < 200 else 200) and out[i]["kept"] == (i in (0, 200))


def test_links_stay_whole_when_the_lists_lose_them(spark, monkeypatch):
    """A descent that finds nothing is seen though few nodes have links, and the result is exact all the same."""
    rng = np.random.default_rng(13)
    vectors = rng.standard_normal((1500, 16))
    vectors[1490:1500] = vectors[:10] + 0.01 * rng.standard_normal((10, 16))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)],
                                  "vec_id long, embedding array<double>, label int")
    graph = embedding_dedup.first_graph
    monkeypatch.setattr(embedding_dedup, "first_graph", lambda nodes, seed: graph(nodes, seed).where("false"))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, rounds=1).collect()}
    for i in range(1500):
        twin = i % 1490 < 10
        assert out[i]["n_links"] == twin and out[i]["component_id"] == (i % 1490 if twin else i)


# --- fingerprints ------------------------------------------------------------------------------

def test_fingerprints_estimate_generalised_jaccard(spark, nothing):
    texts = [(k, story(k % 7, 60 + k) + story(k, 40)) for k in range(60)] + [(60, None), (61, ""), (62, "é x\ty"), (None, "a b c")]
    table = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, key string, rows int")
    out = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table.repartition(3)).collect()}
    order = sorted((t for t in texts if t[0] is not None), reverse=True) + [t for t in texts if t[0] is None]
    near = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    error = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (collections.Counter(x.split()) for x in (t, edited, following))
        if a:
            error += [out[i]["near_edited"] - near(a, b), out[i]["near_next"] - near(a, c)]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08
    assert out[60]["fingerprint"] == out[61]["fingerprint"] == "" and out[61]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(nothing).count() == 0


def test_fingerprints_of_repeated_ids(docs):
    out = fingerprints.edited_fingerprints(docs).collect()
    assert len(out) == len(odd_texts())
    by_text = collections.defaultdict(set)
    texts = {(i, len(t or "")): t or "" for i, t, _ in odd_texts()}
    for r in out:
        by_text[texts[r["doc_id"], r["n_chars"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_gamma_tables(spark):
    rows = fingerprints.gamma_tables(spark, 8, False, banks=4).orderBy("bank").collect()
    x = np.array([r["table"] for r in rows]).T.ravel()
    assert np.allclose(1 - (1 + x) * np.exp(-x), (np.arange(1024) + 0.5) / 1024, atol=1e-9)


# --- toxicity ----------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    chain = toxicity.train(docs, known, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert chain[1]["weights"].shape == (len(chain[1]["chosen"]) + 2,)
    held = toxicity.score(docs, chain, ["junk", "toxic"]).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    wrong = [r for r in held if (r["p_toxic"] >= 0.5) != bool(r["toxic"])]
    assert len(held) > 100 and len(wrong) <= 0.06 * len(held)


def test_toxicity_of_odd_rows(spark, docs, nothing):
    names = ["junk", "toxic"]
    categories = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    few = spark.createDataFrame([(4, None, 1), (4, 0, 0), (6, 1, None), (7, 1, 0), (99, 1, 1), (None, 1, 1)],
                                "doc_id long, quality int, toxic int")
    for labels in (few, few.where("false")):
        chain = toxicity.train(docs, labels, categories)
        out = toxicity.score(docs, chain, names).collect()
        assert len(out) == len(odd_texts()) and all(0 <= r["p_toxic"] <= 1 for r in out)
    kept = toxicity.without_toxic(docs, chain, names)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score(nothing, chain, names).count() == 0


# --- URLs --------------------------------------------------------------------------------------

def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x", "http://example.org/en/12#y",
            "http://notexample.org/en/1", "http://x.com/fr/", "http://com/de/1", "http://y.com/de/", "http://y.com",
            "http://www.bad.net/page.html", "http://bad.net/page/", "http://bad.net/other", "a://b://c/d",
            "http://example.org:80/en/1", "http://é.org/\n?"]
    table = spark.createDataFrame([(k % 12, u, "x", "r") for k, u in enumerate(urls)] + [(3, "http://", "x", "r")],
                                  "page_id long, url string, host string, rule string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    listed = spark.createDataFrame([("bad.net/page",), (None,), ("",)], "url string")
    out = url_filters.judge_urls(table, spark.createDataFrame(rules, "verdict string, host string, path string"),
                                 listed).collect()
    expected = []
    for k, u in [*enumerate(urls), (3, "http://")]:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in rules
               if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        on_list = u in ("http://www.bad.net/page.html", "http://bad.net/page/")
        rule, verdict = max(fit)[1:] if fit else (None, "block" if on_list else "allow")
        expected.append((k % 12, host, path, rule, verdict, on_list))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_filters.judge_urls(table, none, listed.where("false")).where("verdict = 'allow'").count() == len(urls) + 1
    assert url_filters.judge_urls(table.where("false"), none, listed).count() == 0


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filters.bloom_words(keys, 800)
    assert url_filters.possible(keys, words, 800).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filters.possible(others, words, 800).count() < 500


def test_urls_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    expected = duck.execute(SQL["op8_url_filters"]).fetchall()
    got = [tuple(r) for r in QUERIES["op8_url_filters"](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


# --- licenses ----------------------------------------------------------------------------------

def test_license_phrases_equal_brute_force(spark, nothing):
    texts = [None, "", "Under the MIT License.", "under-the mit\nlicense under the mit license x", "Apache License, Version 2.0",
             "cc by-nc", "cc by nc cc by nc", "undér the mit license", "lunder the mit license", "ÀCC BY NC"]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    for i, t in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        expected = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words))
                          if words[k:k + len(phrase.split())] == phrase.split())
        assert out[i]["n_words"] == len(words)
        assert [(w["word"], w["label"]) for w in out[i]["words"]] == expected
    assert licenses.scan_licenses(nothing).count() == 0


def test_license_notices_with_edits():
    compiled = tuple(licenses.notice(*n) for n in licenses.NOTICES)
    rng = np.random.default_rng(4)
    for n in compiled:
        assert b"".join(s for s, _ in n.seeds) == n.text and len(n.seeds) == n.edits + 1
        for _ in range(12):
            text = bytearray(n.text)
            for _ in range(n.edits):
                k = int(rng.integers(len(text)))
                kind = rng.integers(3)
                if kind == 0:
                    text[k] = 120
                elif kind == 1:
                    del text[k]
                else:
                    text.insert(k, 113)
            found = licenses.fuzzy_spans(b"before words " + bytes(text) + b" after", compiled)
            assert any(label == n.label and edits <= n.edits for _, _, label, edits in found), text
    assert licenses.fuzzy_spans(licenses.folded(story(3, 3000)), compiled) == []


def test_near_miss_licenses_get_no_label():
    compiled = tuple(licenses.notice(*n) for n in licenses.NOTICES)
    for text in ("licensed under the gnu general public license version 2", "Licensed under CC BY-ND 4.0",
                 "released under the bsd license", "released under the ISC license", "released under the zlib license",
                 "licensed under the apache license version 1 1", "mozilla public license version 1 1",
                 "creative commons attribution commercial", "licensed under the gnu general public license version2"):
        for around in ("", "before words ", "x 3 2 0 "):
            got = licenses.fuzzy_spans(licenses.folded(around + text + " after mit words"), compiled)
            assert got == [], (text, got)
    for text, label in (("released under the bsd license released under the mit license", "mit"),
                        ("licensed under the gnu general public license version 3 2 files", "gpl-3"),
                        ("licensed under cc by nd 4 0 licensed under cc by nc 4 0", "cc-by-nc")):
        assert {x[2] for x in licenses.fuzzy_spans(text.encode(), compiled)} == {label}
    for n in compiled:
        assert [x[:3] for x in licenses.fuzzy_spans(b"a 1 " + n.text + b" b 5", compiled) if x[3] == 0] == [
            (4, 4 + len(n.text), n.label)]


# --- n-gram join -------------------------------------------------------------------------------

def brute_links(rows, n=5, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links, least = collections.Counter(), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, low = {least[a], least[b]}, min(least[a], least[b])
                least = [low if x in old else x for x in least]
    return links, least


def test_jaccard_join_equals_brute_force(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    rows = odd_texts()
    base = story(40, 150).split()
    for k in range(40):
        near = list(base)
        near[3 * k] = f"edit{k}"
        rows.append((200 + k, " ".join(near), "a"))
    rows += [(300, " ".join(base), "a")] * 3
    table = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string")
    out = ngram_join.jaccard_join(table.repartition(3)).collect()
    links, least = brute_links(rows)
    expected = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if least[j] == least[k] and rows[j][0] is not None]
        expected.append((i, min(ids) if ids else None, links[k]))
    assert sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in out) == sorted(map(str, expected))
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    assert kept.count() == len(set(least))
    assert ngram_join.jaccard_join(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_bands_reach_the_recall():
    assert ngram_join.choose_bands(0.8, 0.9995) == (26, 6)
    for threshold in (0.01, 0.04, 0.3, 0.8, 0.99):
        bands, rows = ngram_join.choose_bands(threshold, 0.9995)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.9995
    for threshold in (0, 1, -1):
        with pytest.raises(ValueError):
            ngram_join.choose_bands(threshold, 0.9995)


def test_sessions_without_a_checkpoint_folder():
    from attestra.llm import common

    class Session:
        """A session whose settings are empty and cannot be changed."""

        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "local[2]"

    first, second = common.shared_dir(Session), common.shared_dir(Session)
    assert first != second and first.rpartition("/")[0] == second.rpartition("/")[0]
    Session.sparkContext.master = "spark://somewhere"
    with pytest.raises(ValueError):
        common.shared_dir(Session)


# --- registered queries and the pipeline -------------------------------------------------------

def test_every_operator_is_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, name = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(name) == 5
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    links, least = brute_links(rows)
    one = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    assert {r["doc_id"] for r in one.collect()} == {
        min(rows[j][0] for j in range(len(rows)) if least[j] == k) for k in set(least)}
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    cut = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, one, SF).collect()}
    for i, x in zip(texts, removed(list(texts.values()), corpus_pipeline.PASSAGE_BYTES), strict=True):
        assert len(cut[i]["text"].encode()) <= x[0] - x[1] and (x[1] or cut[i]["text"] == texts[i])
        assert cut[i]["n_chars"] == len(cut[i]["text"])
    mixed = corpus_pipeline.mix(spark, corpus_pipeline.cut_repeats(spark, one, SF), SF)
    assert mixed.columns == columns
    packed = corpus_pipeline.pack(spark, mixed, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(17)
    for letters in (2, 3, 5, 6):
        passage = " ".join("".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (51, letters)))
        phrase = " ".join(passage.split()[:6])
        rows = [(k, f"{story(200 + k, 60)} {passage} {story(300 + k, 40)}") for k in range(2)]
        rows += [(2, f"{story(202, 60)} {phrase} {story(302, 40)}")]
        docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
        out = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
        for i, t in rows[:2]:
            assert passage not in out[i]["text"] and len(out[i]["text"]) == out[i]["n_chars"] >= len(t) - len(passage) - 8
        assert out[2]["text"] == rows[2][1]
