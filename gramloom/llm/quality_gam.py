"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; the model is one table per feature and one per chosen
pair of features, filled by boosting: features take turns, and each turn adds a shallow
tree over one feature's bins (or a two-level tree over a pair's), with a small step.
Pairs are chosen by how much a 4-way split of them still gains after the single tables.
A score is the logistic function of the sum of table entries, found by bin.

Features are counts over the whole text alone: characters by class, words, lines and
repetition.  Labels, language, source and id are never inputs.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``sample_rows`` of them (those with the smallest hash of the id); only their features
come to the driver.  Scoring covers every row.

Defined results: null and empty texts get the score of a text with zero counts; an id
labelled more than once counts once, with its mean label rounded; null labels are not
used; without labels every score is 0.5; a null id is held out (crc32 of the empty
text); rows that repeat get equal scores; an empty table gives no rows.  Extra columns
of any name are ignored by :func:`quality_report` and returned by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import hash_words, mix64, slices, words_of
from .common import row_columns, text_of, with_row

FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "exclamations", "stops", "other_punctuation", "wide_bytes", "distinct_words", "repeated_neighbours", "repeated_pairs", "top_word", "repeated_lines", "line_words", "one_byte_words")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(chars)] = 1
    return table


_CLASSES = [_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!"), _class(b".,;:?"), _class(b"'\"()[]{}/\\-_=+~^@`"), _class(bytes(range(128, 256)))]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    size = np.maximum(1.0, np.diff(at))
    upper, digits, symbols, bangs, stops, other, wide = (_per_text(c[raw], at) for c in _CLASSES)
    words, bounds = words_of(texts)
    h = hash_words(words)
    n = np.diff(bounds).astype(float)
    n1 = np.maximum(1.0, n)
    length = pc.binary_length(words).to_numpy()
    owner = np.repeat(np.arange(len(n)), np.diff(bounds))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct, top, pairs, dup_lines = np.zeros((4, len(n)))
    for i, text in enumerate(texts):
        own = h[bounds[i] : bounds[i + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(c) / len(own), c.max() / len(own)
        if len(own) > 1:
            two = mix64(own[:-1] * np.uint64(31) + own[1:])
            pairs[i] = 1 - len(np.unique(two)) / len(two)
        lines = [x for x in text.as_py().split("\n") if x.strip()]
        dup_lines[i] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    new_lines = _per_text(raw == 10, at)
    return np.column_stack([np.log1p(n), _per_text(length, bounds) / n1, upper / size, digits / size, symbols / n1, bangs / n1, stops / n1, other / n1, wide / size, distinct, _per_text(same, bounds) / n1, pairs, top, dup_lines, n / (new_lines + 1), _per_text(length == 1, bounds) / n1])


@dataclass
class AdditiveModel:
    """Cuts per feature, tables per feature and per pair, and the intercept."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


_SMOOTH = 5.0  # added to the weight of each leaf


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g**2 / (h + _SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree grown by best splits, from gradient and weight sums per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gs, hs = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-9 and (best is None or gain[cut] > best[0]):
                best = (gain[cut], k, a, a + cut + 1, b)
        if best is None:
            break
        _, k, a, cut, b = best
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _SMOOTH)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of the rows, then of the columns on either side: four leaves over a pair's bins, and their gain."""
    best_gain, best = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        out, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            gc, hc = g[rows].sum(axis=0), h[rows].sum(axis=0)
            values = _tree(gc, hc, 2)
            out[rows] = values
            gain += (2 * values * gc - values**2 * (hc + 0)).sum()
        if gain > best_gain:
            best_gain, best = gain, out
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, step: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting on labels 0 and 1; the same rows give the same model."""
    model = AdditiveModel()
    if not len(y):
        return model
    p = min(max(float(y.mean()), 0.01), 0.99)
    model.intercept = float(np.log(p / (1 - p)))
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1]))
        model.cuts.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
    b = model.bins(x)
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            q = 1 / (1 + np.exp(-z))
            add = step * _tree(np.bincount(b[:, j], y - q, len(table)), np.bincount(b[:, j], q * (1 - q), len(table)), leaves)
            table += add
            z += add[b[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat, q = b[:, i] * shape[1] + b[:, j], 1 / (1 + np.exp(-z))
        return np.bincount(flat, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(flat, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    gains = [(_pair_tree(*sums(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            add = step * _pair_tree(*sums(i, j))[1]
            table += add
            z += add[b[:, i], b[:, j]]
    return model


def remainder(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fifth."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").filter(remainder(F.col("_id")) != 0)
    once = usable.groupBy("_id").agg(F.round(F.avg("_y")).alias("_y"))
    sample = once.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)  # bounded, so small enough to broadcast

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["_id", "_y", *FEATURES])

    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of("text").alias("text")).join(F.broadcast(sample), "_id")
    made = chosen.select("_id", "_y", "text").mapInArrow(rows, "_id long, _y double, " + ", ".join(f"{f} double" for f in FEATURES))
    # an id may stand on any number of rows: one of them, the least, goes to the driver
    got = made.groupBy("_id").agg(F.min(F.struct(*FEATURES, "_y")).alias("least")).select("_id", "least.*").toPandas().sort_values("_id")
    return fit(got[list(FEATURES)].to_numpy(), got["_y"].to_numpy())


def _scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The whole input row as ``row``, and ``quality_score``."""
    field = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), field).cast(pa.string())
            alone = pa.RecordBatch.from_arrays([texts, batch.column("row")], ["text", "row"])
            for part in slices(alone):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.score(features(part.column("text"))), pa.float64())], ["row", "quality_score"])

    rows = with_row(docs)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs``, all columns, with quality_score added; it replaces a column of that name."""
    return _scored(docs, model).select(*row_columns(docs, "quality_score"), "quality_score")


THRESHOLD = 0.3


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", text_of("text").alias("text")), train(docs, labels, sample_rows))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier predicts to be good."""
    scored = _scored(docs, train(docs, labels, sample_rows))
    return scored.filter(F.col("quality_score") >= THRESHOLD).select(*row_columns(docs))
