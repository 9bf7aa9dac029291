"""Quality rules: statistics of each text, and an isolation forest on them.

The forest's trees split random rule statistics at random places; a document
that few splits set apart is anomalous.  The range of the cuts comes from all
labelled rows, the rows in each node from all that are labelled good, and the
threshold is the score that at most SPARE of those exceed.  Nothing is sampled:
a tree is grown on LEAF rows in the usual forest, and here a node holds as many
of all good rows as would be among LEAF of them.  Each text is measured once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, slices, text_bytes, tidy
from .shingles import _STEP, _U, _WORD, mix, word_hashes

TREES, LEAF, SPARE = 128, 256, 0.001
LEVELS = 10  # cuts from a root to the deepest leaves
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_digits", "n_marks", "n_distinct", "n_lines", "n_chars", "n_symbol_words"]
_CLASS = np.zeros(256, np.uint8)
for _c in b"#*$%&|<>":
    _CLASS[_c] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b"!?.,;:\"'()-_/\\@=+~^{}[]`":
    _CLASS[_c] = 4


def statistics(x: np.ndarray, offs: np.ndarray) -> pd.DataFrame:
    """Rule statistics (COUNTS and EXTRA) of the documents x[offs[i]:offs[i+1]]."""
    n = len(offs) - 1

    full = np.flatnonzero(offs[1:] > offs[:-1])  # reduceat has no sum over nothing

    def per(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(full):
            out[full] = np.add.reduceat(flag, offs[full], dtype=np.int64)
        return out

    point, kind, inside = (x & 0xC0) != 0x80, _CLASS[x], _WORD[x]
    words, doc = word_hashes(x, offs, lower=False)
    first = np.searchsorted(doc, np.arange(n + 1))
    k = max(len(words) - WINDOW + 1, 0)
    with np.errstate(over="ignore"):
        grams = np.zeros(k, _U)
        for j in range(WINDOW):
            grams += mix(words[j : j + k] ^ _STEP[j]) * _STEP[j] + _U(j)
    repeat, distinct, dup, lines = (np.zeros(n, np.int64) for _ in range(4))
    raw = x.tobytes()
    for i in range(n):
        a, b = first[i], first[i + 1]
        distinct[i] = len(np.unique(words[a:b]))
        if b - a > WINDOW:
            _, which, count = np.unique(grams[a : b - WINDOW + 1], return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[which] > 1)
            if len(again):
                mark = np.zeros(b - a + 1, np.int64)
                np.add.at(mark, again, 1)
                np.add.at(mark, again + WINDOW, -1)
                repeat[i] = int((np.cumsum(mark) > 0).sum())
        said = [t for t in raw[offs[i] : offs[i + 1]].split(b"\n") if t.strip()]
        lines[i], dup[i] = len(said), len(said) - len(set(said))
    last = inside & ~np.r_[inside[1:], False]
    symbol_words = per(last & (kind == 1))
    return pd.DataFrame({
        "n_words": np.diff(first), "word_chars": per(point & inside), "n_symbols": per(kind == 1), "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_upper": per(kind == 2), "n_digits": per(kind == 3), "n_marks": per(kind == 4), "n_distinct": distinct, "n_lines": lines, "n_chars": per(point), "n_symbol_words": symbol_words,
    })


def base_failed(s: pd.DataFrame) -> np.ndarray:
    return ((s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)).to_numpy()


def features(s: pd.DataFrame) -> np.ndarray:
    """Shares of each rule's matter, drawn to the corpus's usual share in short
    texts (by the added constants), which would else be extreme by chance."""
    words, chars = s.n_words + 30.0, s.word_chars + 150.0
    shares = [s.n_symbols / chars, s.n_symbol_words / words, s.n_dup_lines / (s.n_lines + 8.0), s.n_repeat_words / words,
              (s.n_upper + 4.0) / chars, s.n_digits / (chars + 300.0), (s.n_marks + 4.0) / chars, s.n_lines / words]
    return np.sqrt(np.column_stack(shares).astype(np.float64))


def _expected(n):
    """Mean path in a tree of n rows; n may be a fraction or an array."""
    n = np.asarray(n, np.float64)
    more = np.maximum(n, 3)
    long = 2 * (np.log(more - 1) + 0.5772156649) - 2 * (more - 1) / more
    return np.where(n < 2, 0.0, np.where(n < 3, 1 + (n - 2) * (long - 1), long))


@dataclass
class Forest:
    """Isolation trees, a row each, nodes in heap order: feature (-1 at a leaf), cut, path length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    threshold: float = 1.0

    def nodes(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """Leaf of each row."""
        feature, cut = self.feature[tree], self.cut[tree]
        at = np.zeros(len(rows), np.int64)
        going = np.flatnonzero(feature[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = 2 * node + 2 - (rows[going, feature[node]] < cut[node])
            going = going[feature[at[going]] >= 0]
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), in 0..1; higher is more anomalous."""
        depth = np.zeros(len(rows))
        for tree in range(len(self.feature)):
            depth += self.path[tree][self.nodes(rows, tree)]
        return 2.0 ** (-depth / max(len(self.feature), 1) / _expected(LEAF))

    def weigh(self, held: np.ndarray) -> None:
        """End branches where too few rows are left, and set the paths; held: rows in each leaf of each tree."""
        held = held.astype(np.float64)
        for node in reversed(range((held.shape[1] - 1) // 2)):
            held[:, node] += held[:, 2 * node + 1] + held[:, 2 * node + 2]
        few = held * min(1.0, LEAF / max(held[0, 0], 1))
        self.feature = np.where(few < 2, -1, self.feature)
        self.path = np.floor(np.log2(np.arange(held.shape[1]) + 1)) + _expected(few)


def plant(low: np.ndarray, high: np.ndarray, trees: int = TREES, levels: int = LEVELS, seed: int = 5) -> Forest:
    """Random trees whose cuts are drawn from their node's box (the root's: low to
    high, the range of all labelled rows), so that statistics which no good
    document has lead to empty leaves: short paths."""
    rng, size = np.random.default_rng(seed), (1 << levels + 1) - 1
    feature, cut = np.full((trees, size), -1, np.int32), np.zeros((trees, size))
    able = np.flatnonzero(high > low)
    lows, highs = (np.tile(x, (trees, 1, 1)).astype(np.float64) for x in (low, high))
    for level in range(levels if len(able) else 0):
        here, n = slice((1 << level) - 1, (2 << level) - 1), 1 << level
        f = rng.choice(able, (trees, n))
        a, b = (np.take_along_axis(x, f[:, :, None], 2)[:, :, 0] for x in (lows, highs))
        feature[:, here], cut[:, here] = f, (at := a + rng.random((trees, n)) * (b - a))
        lows, highs = np.repeat(lows, 2, axis=1), np.repeat(highs, 2, axis=1)
        np.put_along_axis(highs[:, 0::2], f[:, :, None], at[:, :, None], 2)
        np.put_along_axis(lows[:, 1::2], f[:, :, None], at[:, :, None], 2)
    return Forest(feature, cut, np.zeros(cut.shape))


def _tables(batch):
    """(part of the batch, its statistics), a bounded number of bytes at a time."""
    x, offs = text_bytes(batch.column("text"))
    for a, b in slices(offs):
        yield batch.slice(a, b - a), statistics(x[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def _measured(carried: list[str]):
    @tidy
    def run(batches):
        for batch in batches:
            for part, s in _tables(batch):
                cols = [*(pa.array(s[c].to_numpy(np.int64)) for c in COUNTS + EXTRA), pa.array(base_failed(s)), *(part.column(c) for c in carried)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", *COUNTS, *EXTRA, "base_failed", *carried])

    return run


def _features(batch) -> np.ndarray:
    return features(pd.DataFrame({c: batch.column(c).to_numpy() for c in COUNTS + EXTRA}))


@tidy
def _ranges(batches):
    """Least and greatest features of a task's rows."""
    both = [(x.min(0), x.max(0)) for x in map(_features, batches) if len(x)]
    if both:
        low, high = np.min([a for a, _ in both], axis=0), np.max([b for _, b in both], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64()))], ["low", "high"])


def _held(shared):
    """Rows in each leaf of each tree."""

    @tidy
    def run(batches):
        forest = shared.value
        size = forest.feature.shape[1]
        total = np.zeros(forest.feature.size, np.int64)
        for batch in batches:
            x = _features(batch)
            for tree in range(len(forest.feature)):
                total[tree * size : (tree + 1) * size] += np.bincount(forest.nodes(x, tree), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["leaf", "n"])

    return run


def _scores(shared):
    @tidy
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(_features(batch)))], ["anomaly"])

    return run


def fit(measured: DataFrame, labels: DataFrame, spare: float = SPARE) -> Forest:
    """Forest and threshold from all labelled rows that pass the base rule; the
    driver sees a row for each task and each leaf, and the ``spare`` highest scores."""
    grades = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    seen = materialize(measured.where("not base_failed").select("doc_id", *COUNTS, *EXTRA).join(grades, "doc_id").drop("doc_id"), "labelled")
    good, context = seen.where("quality > 0"), measured.sparkSession.sparkContext
    n = good.count()
    if not n:
        return Forest(*(np.zeros((0, 1)) for _ in range(3)))
    box = seen.mapInArrow(_ranges, "low array<double>, high array<double>").collect()
    forest = plant(np.min([r.low for r in box], axis=0), np.max([r.high for r in box], axis=0))
    rows = good.mapInArrow(_held(context.broadcast(forest)), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(forest.feature.size, np.int64)
    held[rows.leaf.to_numpy()] = rows.n.to_numpy()
    forest.weigh(held.reshape(forest.feature.shape))
    top = n - min(n - 1, int(np.ceil(n * (1 - spare))))
    scores = good.mapInArrow(_scores(context.broadcast(forest)), "anomaly double")
    forest.threshold = scores.orderBy(F.desc("anomaly")).limit(top).agg(F.min("anomaly")).first()[0]
    forget(seen)
    return forest


def _judge(shared, carried: list[str]):
    @tidy
    def run(batches):
        forest = shared.value
        for batch in batches:
            score = forest.score(_features(batch))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            names = ["doc_id", *COUNTS, "base_failed"]
            cols = [*(batch.column(c) for c in names), pa.array(~failed & (score <= forest.threshold)), pa.array(score), *(batch.column(c) for c in carried)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "kept", "anomaly", *carried])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """Rule statistics and verdict of each document.

    docs: doc_id, text; labels: doc_id, quality (0 or less: bad).  Returns a row
    for each row: doc_id, COUNTS, base_failed, kept, anomaly (0..1); with
    ``carry`` also lang, source, n_chars and text.

    Null text counts as empty, and fails the base rule.  Without usable labels
    the forest is empty and the base rule decides alone.  Repeated rows are
    judged each; labels with null ids or grades are left out, and of repeated
    labels one is used.  Empty table: empty result.
    """
    kinds = {"lang": "string", "source": "string", "n_chars": "long", "text": "string"} if carry else {}
    carried = [f"{c}_" if c in COUNTS + EXTRA else c for c in kinds]  # n_chars is a statistic too
    more = [F.col(c).alias(x) for c, x in zip(kinds, carried, strict=True) if c != "text"]
    extra = "".join(f", {x} {t}" for x, t in zip(carried, kinds.values(), strict=True))
    longs = lambda names: ", ".join(f"{c} long" for c in names)
    measured = docs.select("doc_id", *more, "text").mapInArrow(_measured(carried), f"doc_id long, {longs(COUNTS + EXTRA)}, base_failed boolean{extra}")
    measured = materialize(measured, "measured")
    shared = docs.sparkSession.sparkContext.broadcast(fit(measured, labels))
    out = measured.mapInArrow(_judge(shared, carried), f"doc_id long, {longs(COUNTS)}, base_failed boolean, kept boolean, anomaly double{extra}")
    return out.withColumnsRenamed({x: c for c, x in zip(kinds, carried, strict=True) if c != x})
