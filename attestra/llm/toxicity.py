"""Toxicity by a classifier chain over labelled categories.

Categories are predicted one after the other. Each has a logistic model over words and word
beginnings, and over the probabilities of the categories before it. While fitting, those come from
models that have not seen the row (out of fold); when scoring, from the fitted models.

Features are exact 64-bit hashes of lower-cased words and of their first four and five letters,
present or absent; each model keeps the ``SELECTED`` most telling ones (chi-squared).

The models are fitted on a bounded, seeded sample of labelled rows: ``sample`` rows of each value of
the last category, at the most. All rows are scored, over their whole text.

Defined cases: null and empty texts have no features and get the models' base rate; rows whose last
label is null are not fitted, other null labels count as 0; of several labels of an id the largest
counts; without both values of a category its model is its constant rate; repeated rows and null ids
each get their own row; an empty table gives an empty result. Only the named columns are read, so
extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.tokens import slices

#: Features of a model, and documents of the sample that a feature must be in.
SELECTED = 512
LEAST_DOCUMENTS = 4
#: Folds of the out-of-fold predictions, ridge of the weights, Newton steps.
FOLDS = 3
RIDGE = 0.05
STEPS = 12
SLICE_CHARS = 2_000_000

Model = dict[str, np.ndarray | float]


def _word_features(word: str) -> tuple[int, int, int]:
    """Hashes of the word and its beginnings; 0 where the word is too short to have one."""
    digest = xxhash.xxh3_64_intdigest
    return (digest("w" + word), digest("4" + word[:4]) if len(word) > 4 else 0,
            digest("5" + word[:5]) if len(word) > 5 else 0)


def features(texts: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature hashes of a batch, each pair once; only those ``among`` if given (sorted)."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(spaced)
    coded = lists.values.dictionary_encode()
    table = np.array([_word_features(w) for w in coded.dictionary.to_pylist()],
                     dtype=np.uint64).reshape(-1, 3)
    if among is not None:
        table[~np.isin(table, among)] = 0
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    which = coded.indices.to_numpy(zero_copy_only=False)
    telling = table.any(axis=1)[which] if len(table) else np.zeros(0, dtype=bool)
    rows, which = rows[telling], which[telling]
    # A word counts once in a text.
    pairs = np.unique(rows.astype(np.int64) * max(1, len(table)) + which)
    rows, which = pairs // max(1, len(table)), pairs % max(1, len(table))
    hashes = table[which].ravel() if len(table) else np.zeros(0, dtype=np.uint64)
    rows = np.repeat(rows, 3)
    kept = hashes != 0
    order = np.lexsort((hashes[kept], rows[kept]))
    rows, hashes = rows[kept][order], hashes[kept][order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _matrix(rows: np.ndarray, hashes: np.ndarray, n: int, chosen: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Presence of the chosen features, the earlier probabilities and a constant."""
    out = np.zeros((n, len(chosen) + before.shape[1] + 1))
    if len(chosen):
        place = np.searchsorted(chosen, hashes).clip(0, len(chosen) - 1)
        hit = chosen[place] == hashes
        out[rows[hit], place[hit]] = 1
    out[:, len(chosen):-1] = before
    out[:, -1] = 1
    return out


def fit_model(rows: np.ndarray, hashes: np.ndarray, before: np.ndarray, target: np.ndarray) -> Model:
    """Choose features by chi-squared and fit ridge logistic regression by Newton's method."""
    n, positive = len(target), float(target.sum())
    chosen = np.zeros(0, dtype=np.uint64)
    if 0 < positive < n:
        names, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
        with_it = np.bincount(column, weights=target[rows], minlength=len(names))
        expected = count * positive / n
        chi = (with_it - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - count / n), 1e-9)
        chi[count < min(LEAST_DOCUMENTS, positive)] = 0
        best = np.argsort(-chi, kind="stable")[:SELECTED]
        chosen = np.sort(names[best[chi[best] > 0]])
    x = _matrix(rows, hashes, n, chosen, before)
    weights = np.zeros(x.shape[1])
    if not 0 < positive < n:
        weights[-1] = np.log((positive + 0.5) / (n - positive + 0.5))
        return {"chosen": chosen, "weights": weights}
    ridge = np.full(len(weights), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ weights)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge),
                               x.T @ (target - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-5:
            break
    return {"chosen": chosen, "weights": weights}


def apply_model(model: Model, rows: np.ndarray, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probabilities, without building a matrix."""
    chosen, weights = model["chosen"], model["weights"]
    k, earlier = len(chosen), before.shape[1]
    score = before @ weights[k:k + earlier] + weights[-1]
    if k and len(hashes):
        place = np.searchsorted(chosen, hashes).clip(0, k - 1)
        hit = chosen[place] == hashes
        score = score + np.bincount(rows[hit], weights=weights[place[hit]], minlength=len(before))
    return 1 / (1 + np.exp(-score))


def fit_chain(rows: np.ndarray, hashes: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[Model]:
    """A model per column of ``targets``; each sees out-of-fold probabilities of those before."""
    n = len(targets)
    before, chain = np.zeros((n, 0)), []
    for c in range(targets.shape[1]):
        target = targets[:, c].astype(float)
        chain.append(fit_model(rows, hashes, before, target))
        if c + 1 < targets.shape[1]:
            unseen = np.zeros(n)
            for fold in range(FOLDS):
                inside = folds != fold
                place = np.cumsum(inside) - 1
                use = inside[rows]
                model = fit_model(place[rows[use]], hashes[use], before[inside], target[inside])
                place = np.cumsum(~inside) - 1
                unseen[~inside] = apply_model(model, place[rows[~use]], hashes[~use], before[~inside])
            before = np.column_stack([before, unseen])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 3000,
          seed: int = 11, id_column: str = "doc_id", text_column: str = "text") -> list[Model]:
    """Fit the chain in one task on at most ``2 * sample`` labelled rows; the models come back.

    ``categories`` gives a 0/1 column of ``labels`` for each category, in the order of the chain.
    """
    names = list(categories)
    last = names[-1]
    marked = (labels.select(F.col(id_column).alias("id"), *[c.cast("int").alias(k) for k, c in categories.items()])
              .where(F.col("id").isNotNull() & F.col(last).isNotNull())
              .groupBy("id").agg(*[F.coalesce(F.max(k), F.lit(0)).alias(k) for k in names])
              .withColumn("order", F.xxhash64(F.lit(seed), "id")))
    some = [marked.where(F.col(last) == v).orderBy("order", "id").limit(sample) for v in (0, 1)]
    drawn = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(
        F.broadcast(some[0].unionAll(some[1])), "id").select("id", "order", "text", *names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hashes, targets, order, n = [], [], [], [], 0
        for batch in batches:
            r, h = features(batch.column(2))
            rows.append(r + n)
            hashes.append(h)
            order.append(batch.column(1).to_numpy())
            targets.append(np.column_stack([batch.column(3 + k).to_numpy() for k in range(len(names))]))
            n += batch.num_rows
        if not n:
            return
        folds = np.concatenate(order).view(np.uint64) % np.uint64(FOLDS)
        chain = fit_chain(np.concatenate(rows), np.concatenate(hashes), np.concatenate(targets), folds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(chain)), pa.int32()),
             pa.array([m["chosen"].view(np.int64) for m in chain], pa.list_(pa.int64())),
             pa.array([m["weights"] for m in chain], pa.list_(pa.float64()))],
            names=["place", "chosen", "weights"])

    # The order makes reruns sum in the same order.
    fitted = drawn.repartition(1).sortWithinPartitions("order", "id", F.xxhash64("text")).mapInArrow(
        fit, "place int, chosen array<long>, weights array<double>").collect()
    chain = [{"chosen": np.asarray(r["chosen"], dtype=np.int64).view(np.uint64),
              "weights": np.asarray(r["weights"])} for r in sorted(fitted, key=lambda r: r["place"])]
    never = {"chosen": np.zeros(0, dtype=np.uint64)}
    return chain or [{**never, "weights": np.append(np.zeros(k), -20.0)} for k in range(len(names))]


def score(docs: DataFrame, chain: list[Model], names: list[str], id_column: str = "doc_id",
          text_column: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id`` (or, with ``keep``, all columns) and a probability ``p_<category>`` for each row.

    With ``keep``, more underscores go before ``p_`` if a column already has such a name.
    """
    prefix = "p_"
    while keep and any(prefix + n in docs.columns for n in names):
        prefix = "_" + prefix
    wanted = docs if keep else docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    at = wanted.columns.index(text_column if keep else "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields
                          if keep or f.name != "text"), *(f"`{prefix}{n}` double" for n in names)])
    among = np.unique(np.concatenate([m["chosen"] for m in chain]))
    columns_out = [*(c for c in wanted.columns if keep or c != "text"), *(f"{prefix}{n}" for n in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(at).to_pandas().str.len().fillna(0).to_numpy(np.int64)
            for begin, stop in slices(sizes, SLICE_CHARS):
                part = batch.slice(begin, stop - begin)
                rows, hashes = features(part.column(at), among)
                before = np.zeros((part.num_rows, 0))
                for model in chain:
                    before = np.column_stack([before, apply_model(model, rows, hashes, before)])
                columns = [c for i, c in enumerate(part.columns) if keep or i != at]
                columns += [pa.array(p) for p in before.T]
                yield pa.RecordBatch.from_arrays(columns, names=columns_out)

    return wanted.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, chain: list[Model], names: list[str], threshold: float = 0.5,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that the last category of the chain does not reach ``threshold`` for."""
    scored = score(docs, chain, names, id_column, text_column, keep=True)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < threshold).select(*docs.columns)
