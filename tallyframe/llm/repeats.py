"""Suffix-array dedup by a depth-limited radix sort.

A window is the first ``depth`` bytes of a suffix.  The windows that also start
elsewhere are the groups of two or more that remain when the suffixes are
sorted, most significant digit first, down to ``depth`` bytes.  Only groups
matter, so a pass needs each digit's hash (128 bits in the deciding passes),
not its rank, and suffixes leave as soon as their fate is known:

1. First digit: the ``seed``-byte string of least hash in the window (the
   leftmost on ties).  Equal windows have it at equal offsets, and neighbouring
   windows share it, so one row stands for a run of ~70 suffixes.
2. A run's whole text is the second digit: where it occurs twice, all its
   windows repeat; where its first digit is unique, none does.
3. Distinct runs that share the first digit only are cut into blocks of BLOCK
   windows; the third digit is the text that all windows of a block hold.  Where
   it is unique, none of them repeats.
4. The blocks left are sorted to full depth, one row for each window.

The same passes over words in place of bytes find the passages of PASSAGE words
or more that another document holds too, which are often shorter than ``depth``
bytes; they are counted, not removed.

Counts are combined before each shuffle, so a string found in a third of all
documents costs a row for each task, and hot strings are joined apart.  Nothing
is sampled or capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, slices, text_bytes, text_key

DEPTH, SEED, BLOCK = 400, 256, 16
#: The same for passages, in words: over 50 of them.
PASSAGE, PASSAGE_SEED, PASSAGE_BLOCK = 51, 24, 4
#: A digit or text of more than 1 / HOT of all rows is hot: it is joined by broadcast (HOT rows at most), not gathered.
HOT = 4096
CHUNK = 1 << 16
_U = np.uint64
_POS = _U((1 << 22) - 1)


class _Rolling:
    """Polynomial hashes modulo 2**64 of any substring, from prefix sums."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=_U)
        base = int(rng.integers(0, 2**62)) * 4 + 3
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.r_[_U(1), np.full(size, _U(base))])
            self.inverse = np.multiply.accumulate(np.r_[_U(1), np.full(size, _U(pow(base, -1, 2**64)))])

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, _U)
        values = self.table[x] if x.dtype == np.uint8 else mix(x ^ self.table[0])
        np.cumsum(values * self.power[: len(x)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((sums[hi] - sums[lo]) * self.inverse[lo])


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return z ^ (z >> _U(29))


_cache: dict = {}


def _rolling(size: int) -> tuple[_Rolling, _Rolling]:
    if size not in _cache:
        _cache[size] = (_Rolling(size, 11), _Rolling(size, 23))
    return _cache[size]


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets in words) of an Arrow string array, null as empty."""
    x, offs = text_bytes(column)
    space = (x == 0x20) | ((x >= 9) & (x <= 13))
    after, before = np.ones(len(x) + 1, bool), np.ones(len(x) + 1, bool)
    after[1:], before[:-1] = space, space
    after[offs] = before[offs] = True
    lo, hi = np.flatnonzero(after[:-1] & ~space), np.flatnonzero(before[1:] & ~space) + 1
    out, rolling, a = np.zeros(len(lo), _U), _rolling(CHUNK)[0], 0
    while a < len(lo):
        b = int(np.searchsorted(hi, lo[a] + CHUNK, "right"))
        if b == a:  # a word of over CHUNK bytes
            out[a] = int.from_bytes(hashlib.blake2b(x[lo[a] : hi[a]].tobytes(), digest_size=8).digest(), "little")
            a += 1
            continue
        with np.errstate(over="ignore"):
            out[a:b] = rolling.of(rolling.sums(x[lo[a] : hi[b - 1]]), lo[a:b] - lo[a], hi[a:b] - lo[a])
        a = b
    return out, np.searchsorted(lo, offs)


def _units(batches, words: bool):
    """(rows, their bytes or word hashes, offsets); words a bounded number of bytes of text at a time."""
    for batch in batches:
        if not words:
            yield batch, *text_bytes(batch.column("text"))
            continue
        for a, b in slices(text_bytes(batch.column("text"))[1], 4 << 20):
            part = batch.slice(a, b - a)
            yield part, *word_hashes(part.column("text"))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    b = np.concatenate([a, np.full((-n) % w, _U(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _pieces(offs: np.ndarray, depth: int):
    """(lo, hi, first, last) ranges of about CHUNK bytes or words: whole documents, or overlapping parts of one."""
    a, n = 0, len(offs) - 1
    while a < n:
        if offs[a + 1] - offs[a] > CHUNK:
            for s in range(offs[a], offs[a + 1] - depth + 1, CHUNK):
                yield s, min(s + CHUNK + depth - 1, offs[a + 1]), a, a + 1
            a += 1
            continue
        b = int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1
        b = max(b, a + 1)
        yield offs[a], offs[b], a, b
        a = b


def _runs(x: np.ndarray, offs: np.ndarray, depth: int, seed: int):
    """Per piece: arrays (document index, seed position, its distances from the first
    and last window as 4096 * first + last, digits)."""
    r1, r2 = _rolling(CHUNK + depth)
    w = depth - seed + 1
    for lo, hi, a, b in _pieces(offs, depth):
        y = x[lo:hi]
        if len(y) < depth:
            continue
        valid = np.zeros(len(y) - depth + 1, bool)
        for d in range(a, b):
            s, e = max(offs[d], lo) - lo, min(offs[d + 1], hi) - lo
            if e - s >= depth:
                valid[s : e - depth + 1] = True
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            c1, c2 = r1.sums(y), r2.sums(y)
            k = len(y) - seed + 1
            digit = mix((c1[seed:] - c1[:k]) * r1.inverse[:k])
            ranked = (digit & ~_POS) | np.arange(k, dtype=_U)
            p = (_sliding_min(ranked, w) & _POS).astype(np.int64)[at]
            cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(at) != 1)) + 1
            first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
            p = p[np.r_[0, cut]]
            h1, h2 = r1.of(c1, first, last + depth), r2.of(c2, first, last + depth)
            shape = ((p - first) * 4096 + (p - last)).astype(_U)
            h1, h2 = mix(h1 + shape), mix(h2 ^ shape)
        d = np.searchsorted(offs, lo + first, "right") - 1
        yield d, p + lo - offs[d], shape.astype(np.int32), digit[p].view(np.int64), h1.view(np.int64), h2.view(np.int64)


def _scan(depth: int, seed: int, words: bool):
    def run(batches):
        for batch, x, offs in _units(batches, words):
            for d, p, shape, g, s1, s2 in _runs(x, offs, depth, seed):
                take = pa.array(d)
                cols = [batch.column("doc_id").take(take), batch.column("tk").take(take), *map(pa.array, (p, shape, g, s1, s2))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tk", "p", "shape", "g", "s1", "s2"])

    return run


def _contexts(depth: int, words: bool):
    """Text of the listed runs of each document; of words, their hashes and whose they are."""

    def run(batches):
        for batch, x, offs in _units(batches, words):
            runs = batch.column("runs").to_pylist()
            out = []
            for d, found in enumerate(runs):
                for r in found:
                    far, near = divmod(r["shape"], 4096)
                    out.append((r["s1"], r["s2"], far, near, r["many"], x[offs[d] + r["p"] - far : offs[d] + r["p"] - near + depth].tobytes(), *([r["who"]] if words else [])))
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows):
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()][: len(cols)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["s1", "s2", "far", "near", "many", "ctx", "who"][: len(cols)])


def _pass(depth: int, block: int, listed: int, words: bool):
    """A radix pass over the runs' texts.

    A window at distance o before the seed is in block o // block.  Its digit is
    the text common to the block's windows (block 1: the window itself).  Rows:
    (w1, w2, s1, s2, b, many), of words also who; with a column ``left``, only for
    the blocks of ``listed`` windows in it."""
    unit = np.dtype(_U if words else np.uint8)

    def run(batches):
        r1, r2 = _rolling(CHUNK + depth)
        for batch in batches:
            data = batch.column("ctx").cast(pa.large_binary())
            _, offsets, raw = data.buffers()
            offs = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] // unit.itemsize
            x = np.frombuffer(raw, unit, offs[-1])
            s1, s2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            far, near = batch.column("far").to_numpy().astype(np.int64), batch.column("near").to_numpy().astype(np.int64)
            many = batch.column("many").to_numpy(zero_copy_only=False)
            left = batch.column("left") if "left" in batch.schema.names else None
            a = 0
            while a < len(data):
                b = max(int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1, a + 1)
                y = x[offs[a] : offs[b]]
                if left is None:
                    n = far[a:b] // block - near[a:b] // block + 1
                    who = np.repeat(np.arange(a, b), n)
                    place = near[who] // block + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                else:
                    part = left.slice(a, b - a)
                    n = part.value_lengths().to_numpy()
                    who = np.repeat(np.repeat(np.arange(a, b), n), listed)
                    place = (part.flatten().to_numpy().astype(np.int64)[:, None] * listed + np.arange(listed)).ravel()
                    inside = (place >= near[who]) & (place <= far[who])
                    who, place = who[inside], place[inside]
                # the block's windows start between these distances before the seed
                lo = offs[who] - offs[a] + far[who] - place * block
                hi = lo - (block - 1) + depth
                with np.errstate(over="ignore"):
                    w1 = mix(r1.of(r1.sums(y), lo, hi) + place.astype(_U)).view(np.int64)
                    w2 = r2.of(r2.sums(y), lo, hi).view(np.int64)
                cols = {"w1": w1, "w2": w2, "s1": s1[who], "s2": s2[who], "b": place.astype(np.int32), "many": many[who]}
                if words:
                    cols["who"] = batch.column("who").to_numpy()[who]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols.values())), list(cols))
                a = b

    return run


def _joined(cell) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of a cell's intervals."""
    if not cell.is_valid or not len(cell.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = cell.values.field("lo").to_numpy(), cell.values.field("hi").to_numpy()
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def _cut(batches):
    """Digest of what is left of each text without the union of its intervals, and its passages."""
    for batch in batches:
        x, offs = text_bytes(batch.column("text"))
        found, passages, out = batch.column("found"), batch.column("passages"), []
        for d in range(len(batch)):
            y, keep, at = x[offs[d] : offs[d + 1]], [], 0
            lo, hi = _joined(found[d])
            for s, e in zip(lo, hi, strict=True):
                keep.append(y[at:s].tobytes())
                at = e
            keep.append(y[at:].tobytes())
            rest = b"".join(keep)
            first, last = _joined(passages[d])
            out.append((len(y), int((hi - lo).sum()), len(lo), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), len(first), int((last - first).sum())))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passages", "n_passage_words"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, seed: int = SEED, words: bool = False) -> DataFrame:
    """(doc_id, tk, found): the byte intervals of each text that repeated windows cover.

    Documents without any are absent; intervals may overlap.  tk is text_key.
    With ``words``, depth, seed and intervals are in words, and a window repeats if
    another document (another id or text) holds it, not if the same one does again.
    """
    block = PASSAGE_BLOCK if words else BLOCK
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("tk"))
    runs = docs.mapInArrow(_scan(depth, seed, words), "doc_id long, tk long, p long, shape int, g long, s1 long, s2 long")
    every = materialize(runs, "runs")
    rows = every.groupBy("g").agg(F.count("*").alias("rows"))
    hot = materialize(rows.where(F.col("rows") > max(every.count() / HOT, 1)).select("g"), "hot-digits")  # HOT rows at most
    shared = rows.where("rows > 1").join(F.broadcast(hot), "g", "left_anti").select("g")
    runs = every.join(F.broadcast(hot), "g").union(every.join(F.broadcast(hot), "g", "left_anti").join(shared, "g").select("g", *[c for c in every.columns if c != "g"]))
    runs = materialize(runs, "repeated-runs")
    forget(every)
    who = F.xxhash64("doc_id", "tk")
    many = F.min(who) != F.max(who) if words else F.count("*") > 1
    kinds = materialize(runs.groupBy("g", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "p", "shape")).alias("at"), many.alias("many")), "distinct-runs")
    # groups of the first digit whose runs differ, at least one of them unique
    mixed = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("many").alias("all")).where("kinds > 1 and not all").select("g")
    of = lambda part, keys: part.join(keys, "g")
    asked = of(kinds, F.broadcast(mixed.join(F.broadcast(hot), "g"))).union(of(kinds.join(F.broadcast(hot), "g", "left_anti"), mixed.join(F.broadcast(hot), "g", "left_anti")))
    asked = asked.select("at.doc_id", "at.tk", F.struct("s1", "s2", "at.p", "at.shape", "many", *([F.xxhash64("at.doc_id", "at.tk").alias("who")] if words else [])).alias("run"))
    asked = asked.groupBy("doc_id", "tk").agg(F.collect_list("run").alias("runs")).withColumnsRenamed({"doc_id": "id2", "tk": "tk2"})
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")))
    whose = ", who long" if words else ""
    contexts = materialize(texts.select("text", "runs").mapInArrow(_contexts(depth, words), f"s1 long, s2 long, far int, near int, many boolean, ctx binary{whose}"), "contexts")
    digits = f"w1 long, w2 long, s1 long, s2 long, b int, many boolean{whose}"

    def again(rows: DataFrame) -> DataFrame:
        # a run is listed twice where a row is repeated, so different runs (of words: their documents) are counted, not rows
        run = "who" if words else "s1"
        return rows.groupBy("w1", "w2").agg(F.min(run).alias("x"), F.max(run).alias("y"), F.max("many").alias("many")).where("x <> y or many").select("w1", "w2")

    cores = materialize(contexts.mapInArrow(_pass(depth, block, block, words), digits), "cores")
    left = cores.join(again(cores), ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_set("b").alias("left"))
    windows = materialize(contexts.join(left, ["s1", "s2"]).mapInArrow(_pass(depth, 1, block, words), digits), "windows")
    part = windows.where("not many").join(again(windows), ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_set("b").alias("os"))
    whole = kinds.where("many").select("s1", "s2", F.lit(None).cast("array<int>").alias("os"))
    # a text that many runs share is found again without gathering those runs
    often = F.broadcast(materialize(kinds.where("many").where(F.col("n") > max(runs.count() / HOT, 1)).select("s1", "s2"), "hot-runs"))  # HOT rows at most
    hit = runs.join(often, ["s1", "s2"]).withColumn("os", F.lit(None).cast("array<int>"))
    hit = hit.unionByName(runs.join(often, ["s1", "s2"], "left_anti").join(whole.join(often, ["s1", "s2"], "left_anti").union(part), ["s1", "s2"]))
    lo, hi = F.col("p") - F.floor(F.col("shape") / 4096), F.col("p") - F.col("shape") % 4096 + depth
    cover = F.when(F.col("os").isNull(), F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(
        F.transform("os", lambda o: F.struct((F.col("p") - o).alias("lo"), (F.col("p") - o + depth).alias("hi")))
    )
    found = hit.select("doc_id", "tk", cover.alias("c")).groupBy("doc_id", "tk").agg(F.flatten(F.collect_set("c")).alias("found"))
    found = materialize(found, "covered")
    forget(runs, kinds, contexts, cores, windows)
    return found


def remove_repeats(docs: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """Remove every byte covered by a ``depth``-byte string that also starts elsewhere.

    docs: doc_id long, text string; other columns are ignored.  Returns doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, kept_text (bytes of characters
    that a cut has split are left out of kept_text only), and n_passages and
    n_passage_words: the maximal runs of words covered by PASSAGE words in a row
    that another document holds too, whether or not they are removed.

    Null or short texts: nothing removed (null counts as empty).  Repeated rows
    are copies of each other, but one document as to passages; rows with a null
    id are kept.  Empty table: empty result.
    """
    found = repeated_spans(docs, depth, seed)
    passages = repeated_spans(docs, PASSAGE, PASSAGE_SEED, words=True).withColumnRenamed("found", "passages")
    both = found.unionByName(passages, allowMissingColumns=True).groupBy("doc_id", "tk")
    found = both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("found", "passages"))).withColumnsRenamed({"doc_id": "id2", "tk": "tk2"})
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("tk"))
    texts = texts.join(found, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, n_passages long, n_passage_words long"
    return texts.select("doc_id", "text", "found", "passages").mapInArrow(_cut, schema)
