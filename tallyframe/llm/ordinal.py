"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A grade is 0 for toxic documents, 1 for other bad ones and 2 for good ones.
P(grade <= k) is the logistic function of theta_k - w.x: one weight vector for
all grades over hashed words and word shapes (present or not), and ordered
thresholds.  The regression is fitted on at most SAMPLE labelled rows, those of
least hashed id; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .shingles import _U, mix, word_hashes

SAMPLE, BITS, FEATURES, SPARE = 12_000, 18, 4096, 0.005
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
for _c in b"#*$%&|<>":
    _KIND[_c] = 4
for _c in b"!?.,;:":
    _KIND[_c] = 5


def buckets(x: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of hashed words and word shapes."""
    # punctuation around a word is left to its shape
    bare = np.where((_KIND[x] == 0) | (_KIND[x] >= 4), np.uint8(32), x)
    words, doc = word_hashes(bare, offs)
    marks = np.where((_KIND[x] >= 4), x, np.uint8(32))
    runs, owner = word_hashes(marks, offs)
    n = np.bincount(owner, minlength=len(offs) - 1) if len(owner) else np.zeros(len(offs) - 1, np.int64)
    many = np.bincount(doc, minlength=len(offs) - 1) if len(doc) else np.zeros(len(offs) - 1, np.int64)
    share = np.minimum(np.log2(1 + 64.0 * n / np.maximum(many, 1)), 15).astype(_U)
    size = np.minimum(np.log2(1.0 + many), 20).astype(_U)
    each = np.arange(len(offs) - 1)
    with np.errstate(over="ignore"):
        h = np.concatenate([mix(words), mix(runs * _U(3) + _U(1)), mix(share + _U(1 << 40)), mix(size + _U(1 << 41))]) & _U((1 << bits) - 1)
    pairs = np.unique(np.concatenate([doc, owner, each, each]).astype(np.int64) << bits | h.astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


@dataclass
class Grades:
    """Weights by bucket, thresholds, and the least tail probability to keep."""

    weights: np.ndarray
    theta: np.ndarray
    least: float = 0.5

    def latent(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[bucket], n) if len(doc) else np.zeros(n)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - latent[:, None], -50, 50)))


def fit_grades(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, bits: int = BITS, rounds: int = 300, penalty: float = 2e-4) -> Grades:
    """Cumulative-link logistic regression by Adam on the whole sample.

    Only the FEATURES buckets whose presence tells most about the grade get a
    weight (by the squared z-score of each grade's share)."""
    n, levels = len(grade), max(int(grade.max()) if len(grade) else 1, 1)
    weights, theta = np.zeros(1 << bits), np.linspace(-1, 1, levels) if levels > 1 else np.zeros(1)
    if not n:
        return Grades(weights, theta, 0.0)
    has = np.bincount(bucket, minlength=1 << bits).astype(float)
    told = np.zeros(1 << bits)
    for g in range(levels + 1):
        share = (grade == g).mean()
        seen = np.bincount(bucket, (grade[doc] == g).astype(float), 1 << bits)
        told = np.maximum(told, np.where(has >= 5, (seen - share * has) ** 2 / np.maximum(has * share * (1 - share), 1e-9), 0))
    used = np.argsort(-told, kind="stable")[:FEATURES]
    used = used[told[used] > 6]
    slot = np.full(1 << bits, -1)
    slot[used] = np.arange(len(used))
    keep = slot[bucket] >= 0
    d, f = doc[keep], slot[bucket[keep]]
    p = np.zeros(len(used) + levels)
    p[len(used) :] = [np.log(max((grade <= k).mean(), 1e-3) / max((grade > k).mean(), 1e-3)) for k in range(levels)]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        z = np.bincount(d, p[f], n) if len(d) else np.zeros(n)
        theta = np.maximum.accumulate(p[len(used) :])
        upper = np.c_[1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -40, 40))), np.ones(n)]
        lower = np.c_[np.zeros(n), upper[:, :-1]]
        at = np.arange(n)
        a, b = upper[at, grade], lower[at, grade]
        chance = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        g = np.zeros_like(p)
        slope = (da - db) / chance / n  # of the loss in z
        g[: len(used)] = (np.bincount(f, slope[d], len(used)) if len(d) else 0) + penalty * p[: len(used)]
        for k in range(levels):
            g[len(used) + k] = -(np.where(grade == k, da / chance, 0) - np.where(grade == k + 1, db / chance, 0)).sum() / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = p[: len(used)]
    return Grades(weights, np.maximum.accumulate(p[len(used) :]))


def _parts(batch):
    """(part of the batch, its document and bucket pairs), a bounded number of bytes at a time."""
    x, offs = text_bytes(batch.column("text"))
    for a, b in slices(offs):
        yield batch.slice(a, b - a), *buckets(x[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def _gather(batches):
    for batch in batches:
        for part, doc, bucket in _parts(batch):
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            rows = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(rows, pa.binary())], ["doc_id", "grade", "buckets"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, spare: float = SPARE) -> Grades:
    """Fit on at most ``sample`` labelled rows; of the good ones, at most the
    share ``spare`` falls below the least tail probability kept."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "grade").limit(sample).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids and grades
    seen = rows.mapInArrow(_gather, "doc_id long, grade int, buckets binary").toPandas()
    seen = seen.sort_values(["doc_id", "grade"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
    sets = [np.frombuffer(b, np.int32) for b in seen.buckets]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64)
    bucket = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
    g = seen.grade.to_numpy(np.int64)
    model = fit_grades(doc, bucket, g)
    good = g == 2
    if good.any():
        tail = np.sort(model.tails(model.latent(doc, bucket, len(g)))[good, -1])
        model.least = min(float(tail[int(spare * len(tail))]), 0.5)
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part, doc, bucket in _parts(batch):
                tails = model.tails(model.latent(doc, bucket, len(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, 0]), pa.array(tails[:, -1] >= model.least)], ["doc_id", "expected_grade", "p_good", "p_clean", "kept"])

    return run


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected grade and tail probabilities of each document.

    docs: doc_id, text; labels: doc_id, quality, toxic.  Returns a row for each
    row: doc_id, expected_grade (0 to 2), p_good = P(grade = 2), p_clean =
    P(grade > 0), kept (p_good at least the calibrated one).

    A null toxic counts as not toxic, null or empty texts have the features of a
    text without words.  Without usable labels all probabilities follow from
    thresholds alone and everything is kept.  Repeated rows are scored each; of
    repeated labels one is used.  Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, expected_grade double, p_good double, p_clean double, kept boolean")
