"""Embedding near-dedup by product quantisation.

Vectors are scaled to length 1.  A coarse codebook gives each an inverted list,
and the residual is coded in PARTS subspaces of up to 256 words.  A vector
probes every list that can hold a neighbour: one within the distance ``reach``
that the cosine threshold stands for must lie on its own side of the bisector
of the two list centres, which bounds the distance from above for each list, so
the probes are sufficient rather than a fixed number.  Inside a list,
asymmetric table lookups estimate each cosine; the stored length of a vector's
coding error bounds how far the estimate is off, so no link is lost, and what
remains is settled by the exact cosine in double precision.

Codebooks come from at most SAMPLE vectors (those of least hashed id).  Vectors
equal in every component are one class with a count.  Lists are cut into parts
of bounded size, and the queries of a popular list are dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, roots

SAMPLE, LISTS, PARTS, WORDS = 16_384, 1024, 8, 256
MEMBERS, QUERIES = 4096, 32_768


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class Codebook:
    """Coarse centres and residual codewords; an index can be made for any sample."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, lists, rng)
        self.cuts = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.words = [_kmeans(rest[:, a:b], WORDS, rng, 5) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.gap = np.stack([np.sqrt(((self.centres - c) ** 2).sum(1)) for c in self.centres])

    def encode(self, x: np.ndarray):
        """(list, codes, coding error) of each row."""
        near = _nearest(x, self.centres)
        rest = x - self.centres[near]
        codes = np.column_stack([_nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]).astype(np.uint8)
        made = np.hstack([w[codes[:, i]] for i, w in enumerate(self.words)])
        return near, codes, np.sqrt(((rest - made) ** 2).sum(1))

    def probes(self, x: np.ndarray, near: np.ndarray, reach: float):
        """(row, list) for every list after a row's own that can hold a vector within ``reach``, and its own."""
        d2 = (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T
        own = d2[np.arange(len(x)), near]
        past = d2 - own[:, None] <= 2 * self.gap[near] * (reach + 1e-6)
        past &= np.arange(len(self.centres))[None, :] >= near[:, None]
        past[np.arange(len(x)), near] = True
        return np.nonzero(past)

    def lookup(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of queries (rows) with coded members of a list (columns)."""
        out = np.repeat((queries @ self.centres[list_])[:, None], len(codes), axis=1).astype(np.float32)
        for i, w in enumerate(self.words):
            table = (queries[:, self.cuts[i] : self.cuts[i + 1]] @ w.T).astype(np.float32)
            out += np.take(table, codes[:, i], axis=1)
        return out


def _units(data, dim: int) -> np.ndarray:
    x = np.array(data.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1)[:, None]  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


class Books:
    """A codebook for each length of vector, with lists numbered through."""

    def __init__(self, samples: dict[int, np.ndarray], lists: dict[int, int]):
        self.of, self.first, self.dim, at = {}, {}, {}, 0
        for dim in sorted(samples):
            self.of[dim], self.first[dim] = Codebook(samples[dim], lists[dim]), at
            at += len(self.of[dim].centres)
            self.dim.update(dict.fromkeys(range(self.first[dim], at), dim))

    def split(self, batch):
        """(length, codebook, its first list, part of the batch)."""
        sizes = batch.column("v").value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            for a in range(0, len(part), 4096):
                yield dim, self.of[dim], self.first[dim], part.slice(a, 4096)


def _encode(shared):
    def run(batches):
        for batch in batches:
            for dim, book, first, part in shared.value.split(batch):
                near, codes, error = book.encode(_units(part.column("v"), dim))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("many"), pa.array(first + near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), part.column("v")], ["id", "many", "list", "code", "error", "v"])

    return run


def _probe(shared, reach: float):
    def run(batches):
        for batch in batches:
            for dim, book, first, part in shared.value.split(batch):
                row, at = book.probes(_units(part.column("v"), dim), part.column("list").to_numpy() - first, reach)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(first + at, pa.int32()), *(part.column(c).take(take) for c in ("id", "many", "list", "v"))], ["at", "id", "many", "own", "v"])

    return run


def _match(shared, cosine: float):
    """Rows come sorted by list part, members (kind 0) before queries (kind 1)."""

    def run(batches):
        books, now, members = shared.value, None, []
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy() for c in ("at", "part", "deal")])
            kind, ids, own = batch.column("kind").to_numpy(), batch.column("id").to_numpy(), batch.column("own").to_numpy()
            many, error = batch.column("many").to_numpy(), batch.column("error").to_numpy(zero_copy_only=False)
            v, codes = batch.column("v"), batch.column("code")
            cut = np.flatnonzero((np.diff(at, axis=0) != 0).any(1) | (np.diff(kind) != 0)) + 1
            a_, b_, c_ = [], [], []
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(ids)], strict=True):
                if s == e:
                    continue
                if tuple(at[s]) != now:
                    now, members = tuple(at[s]), []
                dim = books.dim[int(at[s, 0])]  # a list has one length
                book, x = books.of[dim], _units(v.slice(s, e - s), dim)
                if kind[s] == 0:
                    code = np.frombuffer(b"".join(codes[i].as_py() for i in range(s, e)), np.uint8).reshape(e - s, -1)
                    members.append((ids[s:e], many[s:e], error[s:e], x, code))
                    continue
                if not members:
                    continue
                if len(members) > 1:
                    members = [tuple(np.concatenate(c) for c in zip(*members, strict=True))]
                mid, mmany, merror, mx, mcode = members[0]
                floor = (cosine - merror - 1e-5).astype(np.float32)  # the estimate is in single precision
                step = max(1, (1 << 20) // len(mid))
                for i in range(s, e, step):
                    j = min(i + step, e)
                    q, m = np.nonzero(book.lookup(x[i - s : j - s], int(at[s, 0]) - books.first[dim], mcode) >= floor)
                    q += i
                    ahead = (own[q] != at[s, 0]) | (mid[m] > ids[q])
                    q, m = q[ahead], m[ahead]
                    for k in range(0, len(q), 1 << 16):
                        u, w = q[k : k + (1 << 16)], m[k : k + (1 << 16)]
                        near = (mx[w] * x[u - s]).sum(1) >= cosine
                        u, w = u[near], w[near]
                        a_.append(np.r_[ids[u], mid[w]])
                        b_.append(np.r_[mid[w], ids[u]])
                        c_.append(np.r_[mmany[w], many[u]])
            if sum(map(len, a_)):
                a_, b_ = np.concatenate(a_), np.concatenate(b_)
                nodes, code = np.unique(np.r_[a_, b_], return_inverse=True)
                root = nodes[roots(code[: len(a_)], code[len(a_) :], len(nodes))]
                n = np.zeros(len(nodes), np.int64)
                np.add.at(n, code[: len(a_)], np.concatenate(c_))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(root, pa.int64()), pa.array(n)], ["id", "root", "n"])

    return run


def alone(rows: DataFrame) -> DataFrame:
    """Result rows of vectors that link with nothing."""
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """Links of all vectors with cosine >= ``cosine``.

    vectors: vec_id long, embedding array of numbers; other columns are ignored.
    Returns a row for each row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept (vec_id =
    component_id).

    Vectors that are null, empty or zero, or that hold null or non-finite numbers
    link with nothing; others link with vectors of their own length, for each of
    which there is a codebook (``sample`` is shared among the lengths).
    Repeated rows link with each other; ids should be unique otherwise.  Empty
    table: empty result.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "array<float>" if single else "array<double>"
    v = F.col("embedding").cast(kind)
    sound = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound & F.col("vec_id").isNotNull(), v).alias("v"))
    good = F.col("v").isNotNull()
    classes = materialize(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "classes")
    lengths = {d: n for d, n in classes.groupBy(F.size("v")).count().collect()}  # a row per length of vector
    if not lengths:
        return alone(rows)
    each = max(sample // len(lengths), 1)
    nth = F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id"))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    thin = spark.createDataFrame([(d, int((1 << 20) * min(1.0, 4 * each / n)) + 1) for d, n in lengths.items()], "d int, most int")
    some = classes.join(F.broadcast(thin), F.size("v") == F.col("d")).where(share < F.col("most"))  # about 4 * each of a length
    some = some.withColumn("nth", nth).where(F.col("nth") <= each).select("v", "d").toPandas()
    samples = {}
    for d, part in some.groupby("d"):
        fit = np.array(part.v.tolist(), np.float64)
        fit /= np.abs(fit).max(1)[:, None]
        samples[int(d)] = np.unique(fit / np.sqrt((fit * fit).sum(1))[:, None], axis=0)
    for d in lengths.keys() - samples.keys():  # the hash left a rare length without a row
        samples[d] = np.eye(1, d)
    shared = spark.sparkContext.broadcast(Books(samples, {d: int(np.clip(n**0.5, 1, LISTS)) for d, n in lengths.items()}))
    coded = materialize(classes.select("id", "many", "v").mapInArrow(_encode(shared), f"id long, many long, list int, code binary, error double, v {kind}"), "coded")
    asked = coded.select("id", "many", "list", "v").mapInArrow(_probe(shared, (2 - 2 * cosine) ** 0.5), f"at int, id long, many long, own int, v {kind}")
    # a row per list at most: LISTS rows reach the driver
    held = {r[0]: -(-r[1] // MEMBERS) for r in coded.groupBy("list").count().collect()}
    sought = {r[0]: -(-r[1] // QUERIES) for r in asked.groupBy("at").count().collect()}
    sizes = spark.createDataFrame([(k, int(p), int(sought.get(k, 1))) for k, p in held.items()], "at int, parts int, deals int")
    small = F.broadcast(sizes)
    members = coded.withColumnRenamed("list", "at").join(small, "at").select("at", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("kind"), "id", "many", F.lit(-1).alias("own"), "code", "error", "v")
    asked = asked.join(small, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), "deals").cast("int").alias("deal"), F.lit(1).alias("kind"), "id", "many", "own", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), "v")
    sets = members.union(asked).repartition("at", "part", "deal").sortWithinPartitions("at", "part", "deal", "kind", "id")
    found = materialize(sets.mapInArrow(_match(shared, cosine), "id long, root long, n long"), "matches")
    degree = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    classes = classes.join(degree, "id", "left").join(group, F.col("id") == F.col("node"), "left")
    classes = classes.select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.where(good).join(classes, F.col("v") == F.col("w")).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(alone(rows.where(~good)))
