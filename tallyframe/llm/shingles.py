"""N-gram Jaccard join over globally ordered sets, by prefix trees.

A document's set is ordered by one order for the whole corpus: n-grams outside
the table of frequent ones first, by hash, then the frequent ones, rarest
first.  Two sets that meet the threshold share an n-gram among the first
``n - ceil(t * n) + 1`` of either (the top levels of a tree of all sets), which
is where candidates come from.  Candidates of one leader are put in a tree and
walked with the leader's set: sets that begin alike share their partial
overlap, and a branch ends where the n-grams that remain cannot reach the
threshold.

* Documents with equal sets become one class first (a sum of hashes; no group
  is gathered).
* First n-grams travel as 15 bytes each (ROW), packed by the route they take; a
  route holds about ROUTE n-grams.  The routes return those that two classes
  share.
* Rounds 1 and 2 test each class against the one leader it shares most first
  n-grams with; an n-gram's leader is the class whose first n-grams are shared
  most widely (the text that a group's copies come from), then the class that
  has it earliest.  They are linear in the input, and join most near copies.
* Round 3 orders the first n-grams that are still shared across components
  anew, rarest first, and tests every pair left that meets in one with as many
  after it as the two must share, passes the length bound and is not yet in one
  component.  A pair skipped
  because it is in one component already cannot change a component, so the
  components are exact.
* Whole texts of the classes that share anything are fetched once; a test makes
  the sets again from the texts, which are smaller than the sets.

The frequent n-grams are counted over all documents (per slice, then summed) and
are at most FREQUENT entries; the table only sets the order, so what it misses
costs time, not results.  An n-gram of more than a quarter of a route is dealt
to several, whose rows come together again in the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, materialize, slices, text_bytes, text_key, tidy
from .repeats import _rolling, mix

FREQUENT, ROUTE = 1 << 18, 1 << 20
#: Classes that meet in one n-gram in one task, on either side; more are dealt to several.
CROWD = 1 << 14
#: N-grams before its own that a row of the last round carries, to leave out pairs that met there already.
NEAR = 8
#: A first n-gram on its way: 48 bits of it, its class, the share of the set from its place on.
ROW = np.dtype([("low", "<u4"), ("high", "<u2"), ("cls", "<i8"), ("rest", "u1")])
HEAVY = np.uint64(1 << 63)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_PIECE = 1 << 18


def word_hashes(x: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of each word of the documents x[offs[i]:offs[i+1]]."""
    is_word = _WORD[x]
    inside = np.zeros(len(x) + 1, bool)
    inside[1:] = is_word
    inside[offs[:-1]] = False
    start = np.flatnonzero(is_word & ~inside[:-1])
    after = np.zeros(len(x) + 1, bool)
    after[:-1] = is_word
    after[offs] = False
    end = np.flatnonzero(is_word & ~after[1:]) + 1
    hashes, a = np.zeros(len(start), _U), 0
    while a < len(start):
        b = max(int(np.searchsorted(end, start[a] + _PIECE, "right")), a + 1)
        size = int(end[b - 1] - start[a])
        r, _ = _rolling(_PIECE if size <= _PIECE else 1 << size.bit_length())
        y = x[start[a] : end[b - 1]]
        with np.errstate(over="ignore"):
            hashes[a:b] = r.of(r.sums(_LOWER[y] if lower else y), start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return hashes, np.searchsorted(offs, start, "right") - 1


def shingle_sets(x: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Distinct n-gram hashes of each document; fewer words than ``size`` are one n-gram."""
    words, doc = word_hashes(x, offs)
    n = len(offs) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    with np.errstate(over="ignore"):
        k = max(len(words) - size + 1, 0)
        grams = np.zeros(k, _U)
        for j in range(size):
            grams += mix(words[j : j + k] ^ _STEP[j % 5]) * _STEP[j % 5] + _U(j)
        grams = mix(grams)
        out = []
        for i in range(n):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                h = _U(b - a)
                for w in words[a:b]:
                    h = mix(h * _STEP[0] + w)
                out.append(np.array([h], _U))
            else:
                out.append(np.zeros(0, _U))
    return out


def _signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(s + _STEP[2]).sum(dtype=_U) + _U(len(s))).view(np.int64))


def _set_slices(batches, size: int, limit: int):
    """(part of a batch, its sets), a bounded number of bytes of text at a time."""
    for batch in batches:
        x, offs = text_bytes(batch.column("text"))
        for a, b in slices(offs, limit):
            yield batch.slice(a, b - a), shingle_sets(x[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)


def _sum_up(size: int):
    """A row per document (kind 0) and per n-gram that a slice holds in 3 sets or more (kind 1)."""

    @tidy
    def run(batches):
        for part, sets in _set_slices(batches, size, 4 << 20):
            n = np.array([len(s) for s in sets], np.int64)
            sig = np.array([_signature(s) for s in sets], np.int64)
            zero = np.zeros(len(n), np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(zero), part.column("doc_id"), part.column("tk"), pa.array(sig), pa.array(n)], ["kind", "doc_id", "tk", "key", "n"])
            one = np.unique(sig, return_index=True)[1]
            grams, count = np.unique(np.concatenate([sets[i] for i in one]), return_counts=True)
            often = count >= 3
            grams, count = grams[often].view(np.int64), count[often].astype(np.int64)
            none = pa.nulls(len(grams), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(grams), np.int8)), none, none, pa.array(grams), pa.array(count)], ["kind", "doc_id", "tk", "key", "n"])

    return run


def ordered(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set as sorted order keys: hash >> 1, or for frequent n-grams 2**63 + rank."""
    keys = s >> _U(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hit = frequent[at] == s
        keys[hit] = HEAVY + rank[at[hit]]
    keys.sort()
    return keys


def _hashed(t: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(t * _STEP[1]) ^ _STEP[3])


def _routed(size: int, percent: int, routes: int, shared):
    """First n-grams of each set, packed by route: (route, rows)."""

    @tidy
    def run(batches):
        frequent, rank, hot, deals = shared.value
        for _, sets in _set_slices(batches, size, 16 << 20):
            keys, cls, rest, seen = [], [], [], set()
            for s in sets:
                sig = _signature(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                p = len(s) + (-percent * len(s)) // 100 + 1
                keys.append(ordered(s, frequent, rank)[:p])
                cls.append(np.full(p, sig, np.int64))
                rest.append((255 * (len(s) - np.arange(p)) + len(s) - 1) // len(s))
            if not keys:
                continue
            t, rows = np.concatenate(keys), np.empty(sum(map(len, keys)), ROW)
            h = _hashed(t)
            rows["low"], rows["high"], rows["cls"], rows["rest"] = h & _U(0xFFFFFFFF), (h >> _U(32)) & _U(0xFFFF), np.concatenate(cls), np.concatenate(rest)
            salt = np.zeros(len(t), _U)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                many = hot[at] == t
                salt[many] = _hashed(rows["cls"][many].view(_U)) % deals[at[many]]
            with np.errstate(over="ignore"):
                # a salted one carries its mark in the route, so that it is shared though alone there
                route = (mix((h >> _U(4)) + salt * _STEP[2]) % _U(routes)).astype(np.int64) * 2 + (many if len(hot) else 0)
            order = np.argsort(route, kind="stable")
            route, rows = route[order], rows[order]
            cut = np.flatnonzero(np.diff(route)) + 1
            ends = np.r_[0, cut, len(rows)]
            data = [rows[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(route[ends[:-1]]), pa.array(data, pa.binary())], ["route", "rows"])

    return run


@tidy
def _meet(batches):
    """Rows come sorted by route.  For each n-gram that two classes share, a row
    for each class (kind 0: t, cls, rest); and for each class how many others its
    n-grams of the route are shared with, in total (kind 1: cls, rest)."""

    def met(route: int, held: list):
        rows = np.concatenate([np.frombuffer(h, ROW) for h in held])
        t = rows["low"].astype(np.int64) | rows["high"].astype(np.int64) << 32
        cls, rest = rows["cls"].astype(np.int64), rows["rest"].astype(np.int64)
        order = np.lexsort((cls, t))
        t, cls, rest = t[order], cls[order], rest[order]
        one = np.r_[True, (np.diff(t) != 0) | (np.diff(cls) != 0)]  # copies of a text come from several slices
        t, cls, rest = t[one], cls[one], rest[one]
        new = np.r_[True, np.diff(t) != 0]
        group = np.cumsum(new) - 1
        other = np.bincount(group, cls != cls[np.flatnonzero(new)][group]) > 0
        many = np.bincount(group)[group]
        keep = other[group] if route % 2 == 0 else np.ones(len(t), bool)
        t, cls, rest, many = t[keep], cls[keep], rest[keep], many[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), np.int8)), pa.array(t), pa.array(cls), pa.array(rest)], ["kind", "t", "cls", "rest"])
        cls, own = np.unique(cls, return_inverse=True)
        total = np.bincount(own, many - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(cls), np.int8)), pa.nulls(len(cls), pa.int64()), pa.array(cls), pa.array(total)], ["kind", "t", "cls", "rest"])

    now, held = None, []
    for batch in batches:
        for route, rows in zip(batch.column("route").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if route != now and held:
                yield from met(now, held)
                held = []
            now = route
            held.append(rows)
    if held:
        yield from met(now, held)


class PrefixTree:
    """Ordered sets, stored as the sorted list of their sequences with the depth
    that each shares with the one before: the tree's edges, read depth first."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.depth = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.depth.append(int(differ.argmax()) if differ.any() else m)

    def linked(self, probe: np.ndarray, percent: int, step: int = 128) -> list[int]:
        """Indices of the sets S with 100 |S & probe| >= percent |S | probe|."""
        out, have, dead = [], np.zeros(1, np.int64), None
        for i, s in enumerate(self.sets):
            keep = self.depth[i]
            if dead is not None:
                if keep >= dead:  # this branch was cut above where the set leaves it
                    continue
                dead = None
            have = have[: keep + 1]
            least = -(-percent * (len(s) + len(probe)) // (100 + percent))
            alive = 100 * min(len(s), len(probe)) >= percent * max(len(s), len(probe))
            k = len(have) - 1
            while alive and k < len(s):
                part = s[k : k + step]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, len(probe) - 1)] == part
                have = np.concatenate([have, have[-1] + np.cumsum(hit)])
                k = len(have) - 1
                left = min(len(s) - k, len(probe) - int(at[-1]))
                alive = have[-1] + left >= least
            if alive and have[-1] >= least:
                out.append(self.order[i])
            elif not alive and k and self._hopeless(i, k, have[-1], probe, percent):
                dead = k
        return out

    def _hopeless(self, i: int, k: int, overlap: int, probe: np.ndarray, percent: int) -> bool:
        """No set of the branch that s[i] shares down to depth k can reach the threshold."""
        after = len(probe) - int(np.searchsorted(probe, self.sets[i][k - 1], "right"))
        for j in range(i + 1, len(self.sets)):
            if self.depth[j] < k:
                break
            n = len(self.sets[j])
            if overlap + min(n - k, after) >= -(-percent * (n + len(probe)) // (100 + percent)):
                return False
        return True


def _verify(percent: int, size: int, shared):
    """Rows (a, part, b, text) come sorted by leader and part, the leader's own text first."""

    @tidy
    def run(batches):
        frequent, rank, *_ = shared.value
        now, probe = None, None
        for block, sets in _set_slices(batches, size, 2 << 20):
            lead, part, me = (block.column(c).to_numpy() for c in ("a", "part", "b"))
            sets = [ordered(s, frequent, rank) for s in sets]
            cut = np.flatnonzero((np.diff(lead) != 0) | (np.diff(part) != 0)) + 1
            u, v = [], []
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(lead)], strict=True):
                if (lead[a], part[a]) != now:
                    now, probe, a = (lead[a], part[a]), sets[a], a + 1
                for i in PrefixTree(sets[a:b]).linked(probe, percent) if a < b else ():
                    u.append(lead[a + i])
                    v.append(me[a + i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int, size: int, shared) -> DataFrame:
    """The pairs (a, b) that meet the threshold, as (u, v).  Leaders with many
    partners are dealt to several tasks, with a copy of their text in each."""
    own = texts.select(F.col("cls").alias("b"), "text")
    rows = pairs.withColumn("part", F.when(F.col("many") > 512, F.pmod(F.xxhash64("b"), F.col("many") / 256).cast("int")).otherwise(0))
    heads = rows.select("a", "part").distinct().hint("merge").join(own.withColumnRenamed("b", "a"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = rows.hint("merge").join(own, "b").select("a", "part", F.lit(1).alias("kind"), "b", "text")
    return heads.union(rows).repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(_verify(percent, size, shared), "u long, v long")


def _fits(na, nb, percent: int):
    """The smaller set is large enough for the larger one."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _shares(na, nb, percent: int):
    """Least number of first n-grams that two linked sets share.

    Of the two, let A be the one whose first n-grams end earlier in the order:
    what it shares beyond them is at most the rest of it, ceil(t * na) - 1."""
    least = F.ceil((na + nb) * percent / (100 + percent))
    return F.greatest(least - F.ceil(F.greatest(na, nb) * percent / 100) + 1, F.lit(1))


def _rarest_first(common: DataFrame, percent: int) -> DataFrame:
    """The open first n-grams in a new order: the one that fewest open classes have comes first.

    N-grams that the same classes have (those of one passage) are one row a class,
    named by the least of them.  ``after`` counts a class's n-grams from the last
    on.  Two sets share all their common ones from the first of them on, so there
    both have an ``after`` of at least the number that they must share
    (``_shares``).  Rows too late for a partner of any size that has the n-gram
    are left out.  ``near`` holds the class's NEAR n-grams before the row's own."""
    rows = common.select("t", "cls", "n", "g").distinct()
    who = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"h{k}") for k in range(2)]
    holders = rows.groupBy("t").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), *who)
    bundles = holders.groupBy("k", "lo", "hi", "h0", "h1").agg(F.min("t").alias("t"), F.count("*").alias("w")).drop("h0", "h1")
    order = Window.partitionBy("cls").orderBy(F.desc("k"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(bundles, "t").withColumn("after", F.sum("w").over(order))
    n = F.col("n")
    # what must be shared with a set of m n-grams, without its roundings; it falls on either side of m = n
    least = lambda m: (n + m) * percent / (100 + percent) - F.greatest(n, m) * percent / 100
    needed = F.least(least(F.greatest(F.col("lo"), n * percent / 100)), least(F.least(F.col("hi"), n * 100 / percent)))
    before = Window.partitionBy("cls").orderBy("k", "t").rowsBetween(-NEAR, -1)
    rows = rows.where(F.col("after") >= needed - 1e-6).withColumn("near", F.collect_list("t").over(before))
    return rows.select("t", "k", "cls", "n", "g", "after", "near")


def _meeting(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from rows of ``_rarest_first``.

    A pair meets in each n-gram that both have.  Where an n-gram near before is
    common too, both have an ``after`` that is no smaller there, so the pair was
    found there or before, and is left out here; it stays at its first one."""
    salt = F.floor(F.col("k") / CROWD)
    x = rare.select("t", F.explode(F.sequence(F.lit(0).cast("long"), salt)).alias("salt"), *(F.col(c).alias(to) for c, to in (("cls", "a"), ("n", "na"), ("g", "ga"), ("after", "ra"), ("near", "ea"))))
    y = rare.select("t", F.pmod(F.xxhash64("cls"), salt + 1).alias("salt"), *(F.col(c).alias(to) for c, to in (("cls", "b"), ("n", "nb"), ("g", "gb"), ("after", "rb"), ("near", "eb"))))
    enough = F.least("ra", "rb") >= _shares(F.col("na"), F.col("nb"), percent)
    may = F.expr("ga <> gb and a < b") & _fits(F.col("na"), F.col("nb"), percent) & enough & ~F.arrays_overlap("ea", "eb")
    return x.join(y, may & (x.t == y.t) & (x.salt == y.salt)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """Link documents whose sets of ``size``-word n-grams have Jaccard >= percent / 100.

    docs: doc_id long, text string; other columns are ignored.  Returns a row
    for each row: doc_id, n_shingles, component_id (smallest id reachable by
    links, itself included), n_links (links to different sets found by the
    tests made; at least the links that join the component).

    Null, empty and blank texts have n_shingles 0 and link with nothing.
    Repeated rows link with each other.  A null id never is a component's id
    unless all its rows lack one.  Empty table: empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("tk"))
    rows = materialize(docs.mapInArrow(_sum_up(size), "kind byte, doc_id long, tk long, key long, n long"), "sums")
    each = rows.where("kind = 0").select("doc_id", "tk", F.when(F.col("n") > 0, F.col("key")).alias("cls"), F.col("n").alias("n_shingles"))
    counts = rows.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 8")
    often = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    grams, many = often.key.to_numpy(np.int64).view(_U), often.n.to_numpy(np.int64)
    rank = np.arange(len(grams), 0, -1).astype(_U)
    hot = np.sort(HEAVY + rank[many > ROUTE // 4])
    deals = (many // (ROUTE // 4) + 1)[: len(hot)][::-1].astype(_U)  # both by rank
    by_hash = np.argsort(grams)
    shared = spark.sparkContext.broadcast((grams[by_hash], rank[by_hash], hot, deals))

    reps = each.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("at"), F.first("n_shingles").alias("n"))
    reps = materialize(reps.select("cls", "n", F.col("at.doc_id").alias("rep"), "at.tk"), "classes")
    first = (reps.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0) // ROUTE + 1
    routed = docs.select("text").mapInArrow(_routed(size, percent, int(first), shared), "route long, rows binary")
    met = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_meet, "kind byte, t long, cls long, rest long")
    met = materialize(met, "met")
    # how widely a class's first n-grams are shared: most for the text that a group's copies come from
    wide = met.where("kind = 1").groupBy("cls").agg(F.sum("rest").alias("wide")).join(reps, "cls")
    wide = materialize(wide.select("cls", "n", "rep", F.col("tk").alias("key"), (F.col("wide") / (F.floor(F.col("n") * (100 - percent) / 100) + 1)).alias("wide")), "sharers")
    common = materialize(met.where("kind = 0").join(wide.select("cls", "n", "wide").hint("merge"), "cls").select("t", "cls", "n", "rest", "wide", F.col("cls").alias("g")), "common")
    forget(met)

    # one text of each class that shares an n-gram; rows that repeat an id and a text give their links again
    needed = wide.select("cls", "rep", "key").hint("merge")
    texts = docs.join(needed, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tk") == F.col("key"))).select("cls", "text")
    texts = materialize(texts, "texts")

    tested = found = None
    for leads in (F.struct("wide", "cls"), F.struct("rest", "cls")):
        lead = common.groupBy("t").agg(F.max_by(F.struct("cls", "n", "g"), leads).alias("a"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
        star = common.join(lead.select("t", "a"), "t").where("g <> a.g").where(_fits(F.col("a.n"), F.col("n"), percent))
        star = star.groupBy(F.col("a.cls").alias("a"), F.col("cls").alias("b"), F.col("a.n").alias("na"), F.col("n").alias("nb")).count()
        star = star.where(F.col("count") >= _shares(F.col("na"), F.col("nb"), percent))
        if tested is not None:
            star = star.join(tested.select("a", "b").union(tested.select("b", "a")), ["a", "b"], "left_anti")
        best = star.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        asked = materialize(best.join(best.groupBy("a").agg(F.count("*").alias("many")), "a").select("a", "b", "many"), "asked")
        links = materialize(_links(asked, texts, percent, size, shared), "links")
        tested, found = (asked, links) if tested is None else (tested.union(asked), found.union(links))
        groups = materialize(components(found), "groups")
        left = common.drop("g").join(groups.hint("merge"), F.col("cls") == F.col("node"), "left").select("t", "cls", "n", "rest", "wide", F.coalesce("component", "cls").alias("g"))
        open_ = left.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
        left = materialize(left.join(open_, "t"), "open")
        forget(common, groups)
        common = left

    rare = materialize(_rarest_first(common, percent), "rare")
    pairs = _meeting(rare, percent)
    pairs = materialize(pairs.join(tested.select("a", "b").union(tested.select("b", "a")), ["a", "b"], "left_anti"), "pairs")
    crowd = pairs.groupBy("a").agg(F.count("*").alias("many"))
    found = found.union(materialize(_links(pairs.join(crowd, "a").select("a", "b", "many"), texts, percent, size, shared), "links"))

    both = components(found)
    least_id = both.join(reps, F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep").alias("least_id"))
    degree = found.select("u").union(found.select("v")).groupBy("u").count()
    classes = reps.join(both, F.col("cls") == F.col("node"), "left").join(least_id, "component", "left").join(degree, F.col("cls") == F.col("u"), "left")
    classes = materialize(classes.select("cls", F.coalesce("least_id", "rep").alias("component_id"), F.coalesce("count", F.lit(0)).alias("n_links")), "groups-2")
    forget(common, rare, pairs, texts, wide)
    linked = each.where("cls is not null").join(classes, "cls")
    alone = each.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", "n_shingles", "component_id", "n_links").union(alone)
