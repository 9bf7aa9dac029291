"""Lexical retrieval packing.

Documents are tokenised whole and dealt by content to shards of about SHARD_BYTES
of ids: a document's BM25 weights are projected to SKETCH numbers, and a tree of
cuts through the sketches, balanced by tokens on a sample, leads similar documents
to the same leaf, so that neighbours stay candidates however large the input is.
A shard holds an inverted index of its documents with BM25 weights (document
frequencies are counted over the whole corpus; the table has one entry for each
id of the vocabulary).  A seed document opens a window; its unused neighbours
by BM25 on all its terms, best first, fill it; the document that crosses the window's
end is cut there and its rest seeds the next window.  What is left at a shard's end
is cut into sequences whose lengths are powers of two, which need no padding.

Neighbours in other shards are not seen; the README has the share that is.  All
documents decide the size of each leaf; one of over twice SHARD_BYTES (a hot group
of copies, say) is dealt on by a hash to as many shards as it needs.  A shard's
memory is bounded by that and its longest document.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, forget, materialize, slices, text_bytes

LENGTH, END, SHARD_BYTES = 2048, 1, 6_000_000
K1, B = 1.2, 0.75
#: Numbers in a sketch; documents for each leaf from which the cuts are drawn (every document is dealt by them).
SKETCH, LEAF_SAMPLE = 128, 48
#: Neighbours that are put in order at first.
NEAR = 32
#: Pieces of words, and words not cut into pieces, kept per worker; bytes of text encoded at a time.
KEPT_WORDS, TEXT_BYTES = 1_000_000, 16 << 20
#: Letters that every version of Unicode lower-cases alike, then ASCII marks: what
#: the tokenizer splits into two pieces.  Other words are handed to it whole.
_PLAIN = "^(?P<letters>[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
_tokenizers: dict = {}
_known: dict[str, bytes] = {}
_axes: dict[int, np.ndarray] = {}
CACHES += [_tokenizers, _known, _axes]


def _load(path: str):
    """(tokenizer, whether each id ends a piece; None if the model does not mark ends)."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        suffix = getattr(tok.model, "end_of_word_suffix", None)
        ends = None
        if suffix and json.loads(tok.to_str())["pre_tokenizer"]:
            ends = np.array([(tok.id_to_token(i) or "").endswith(suffix) for i in range(tok.get_vocab_size())])
        _tokenizers[path] = (tok, ends)
    return _tokenizers[path]


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


def _encode_pieces(path: str, pieces: list[str]) -> None:
    """Put the ids of each piece in ``_known``; pieces go to the tokenizer in
    runs, and are told apart by the ids that end one."""
    tok, ends = _load(path)
    runs = [pieces[a : a + 256] for a in range(0, len(pieces), 256)]
    for a in range(0, len(runs), 64):
        part = runs[a : a + 64]
        for run, e in zip(part, tok.encode_batch_fast([" ".join(r) for r in part], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            if len(cut) != len(run) or cut[-1] != 4 * len(ids):
                _encode_alone(path, run)
                continue
            raw = ids.tobytes()
            for p, s, t in zip(run, [0, *cut[:-1]], cut, strict=True):
                _known[p] = raw[s:t]


def _encode_alone(path: str, words: list[str]) -> None:
    for a in range(0, len(words), 4096):
        part = words[a : a + 4096]
        for w, e in zip(part, _load(path)[0].encode_batch_fast(part, add_special_tokens=False), strict=True):
            _known[w] = _raw(e.ids)


def _look_up(path: str, words: list[str], encode) -> list[bytes]:
    new = [w for w in words if w and w not in _known]
    if len(_known) + len(new) > KEPT_WORDS:
        _known.clear()
        new = [w for w in words if w]
    _known[""] = b""
    encode(path, new)
    return [_known[w] for w in words]


def _binary(raw: bytes | np.ndarray, size: np.ndarray) -> pa.Array:
    """Cells of the given sizes in bytes, cut from ``raw``."""
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size, dtype=np.int64)]), pa.py_buffer(raw)])


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    _, offsets, raw = cells.buffers()
    offs = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(raw or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _encode(path: str, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each); with ``end``, END follows each text's.

    The tokenizer drops white space and never joins across it, so the distinct
    words of the texts are found by Arrow, and the distinct pieces of those are
    encoded once and kept.  Texts with \\x1c to \\x1f, white space to Arrow
    alone, go to the tokenizer whole.
    """
    n = len(texts)
    odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False)
    split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
    words = split.flatten().dictionary_encode()
    which, distinct = words.indices.to_numpy(), words.dictionary
    per_text = split.value_lengths().to_numpy().astype(np.int64)
    cut = pc.extract_regex(distinct, _PLAIN)
    plain = cut.is_valid().to_numpy(zero_copy_only=False) & (_load(path)[1] is not None)
    letters, marks = (pc.struct_field(cut, i).filter(pa.array(plain)) for i in (0, 1))
    pieces = pa.concat_arrays([pc.utf8_lower(letters), marks]).dictionary_encode()
    rows = _look_up(path, pieces.dictionary.to_pylist(), _encode_pieces) + _look_up(path, distinct.filter(pa.array(~plain)).to_pylist(), _encode_alone)
    rows += [_raw(_load(path)[0].encode(t, add_special_tokens=False).ids) for t in texts.filter(pa.array(odd)).to_pylist()] + [b"", _raw([END] * end)]
    # ids fit in 16 bits for vocabularies up to 65,536
    ids = np.frombuffer(b"".join(rows), np.uint32)
    ids = ids.astype(np.uint16) if _load(path)[0].get_vocab_size() <= 65536 else ids
    cells = _binary(ids, np.fromiter(map(len, rows), np.int64, len(rows)) // 4 * ids.itemsize)
    # a word is two rows: letters and marks, or itself and nothing
    k, at, m = len(pieces.dictionary), pieces.indices.to_numpy(), len(distinct)
    parts = np.full((m, 2), len(rows) - 2, np.int64)
    parts[plain] = at.reshape(2, -1).T
    parts[~plain, 0] = k + np.arange(m - plain.sum())
    raw, offs = _flat(cells.take(pa.array(parts.ravel())))
    # the words' cells, one for each odd text, and what ends a text
    others = cells.slice(len(rows) - 2 - odd.sum())
    cells = pa.concat_arrays([_binary(raw, np.diff(offs[::2])), others])
    ends = np.cumsum(per_text)
    order = np.insert(which, np.r_[ends[odd], ends], np.r_[m + np.arange(odd.sum()), np.full(n, m + odd.sum() + 1)])
    raw, offs = _flat(cells.take(pa.array(order)))
    done = offs[ends + np.cumsum(odd) + np.arange(1, n + 1)] // ids.itemsize
    return raw.view(ids.dtype), np.diff(np.r_[0, done])


def _tokens(path: str):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").fill_null("")
            _, offs = text_bytes(texts)
            for a, b in slices(offs, TEXT_BYTES):
                flat, n = _encode(path, texts.slice(a, b - a), end=True)
                kept = _binary(flat, n * flat.itemsize).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), kept], ["doc_id", "doc_tokens", "ids"])

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    """Ids, in 16 bits where they are kept so."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _counts(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, how often each is there); 16-bit ids are sorted by radix."""
    if not len(doc):
        return doc, np.zeros(0, np.int64)
    doc = np.sort(doc, kind="stable")
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    return doc[at[:-1]], np.diff(at)


def _frequencies(batches):
    for batch in batches:
        n, total = batch.column("doc_tokens").to_numpy(), np.zeros(65536, np.int64)
        for raw, k in zip(batch.column("ids").to_pylist(), n, strict=True):
            at = _counts(_ids(raw, k))[0]
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
            total[at] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])


def _idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - df + 0.5) / (df + 0.5))


def _weights(doc: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(terms, BM25 weights) of a document."""
    t, c = _counts(doc)
    return t, idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(doc) / max(mean, 1)))


def sketch(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> np.ndarray:
    """Unit rows: the documents' BM25 weights on fixed random axes."""
    if len(idf) not in _axes:
        _axes[len(idf)] = np.random.default_rng(0).standard_normal((len(idf), SKETCH), np.float32)
    out = np.zeros((len(docs), SKETCH), np.float32)
    for i, d in enumerate(docs):
        t, w = _weights(d, idf, mean)
        out[i] = w.astype(np.float32) @ _axes[len(idf)][t]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Cuts through sketches; a leaf holds a like share of the tokens."""

    def __init__(self, x: np.ndarray, tokens: np.ndarray, leaves: int):
        self.axis, self.cut, self.low, self.high, self.leaves = [], [], [], [], 0
        self.root = self._grow(x, tokens.astype(np.float64), leaves)
        self.axis = np.array(self.axis, np.float32).reshape(-1, x.shape[1])
        self.cut, self.low, self.high = np.array(self.cut, np.float32), np.array(self.low, np.int64), np.array(self.high, np.int64)

    def _grow(self, x: np.ndarray, tokens: np.ndarray, leaves: int) -> int:
        """Number of a node; of a leaf, -1 less its number."""
        if leaves > 1 and len(x) > 1:
            at = x - np.average(x, axis=0, weights=tokens)
            axis = np.linalg.eigh((at * tokens[:, None].astype(np.float32)).T @ at)[1][:, -1].astype(np.float32)
            p = (x * axis).sum(1)
            order = np.argsort(p, kind="stable")
            share = np.cumsum(tokens[order]) / tokens.sum()
            p = p[order]
            # the widest gap, near the middle where there is one, so that few groups are cut
            k, gap = np.flatnonzero((share[:-1] > 0.35) & (share[:-1] < 0.65)), np.diff(p)
            if not len(k) or gap[k].max() <= 1e-5:
                k = np.flatnonzero(gap > 1e-5)
            if len(k):
                best = k[np.argmax(gap[k])]
                node, cut = len(self.cut), (p[best] + p[best + 1]) / 2
                few = min(max(round(leaves * share[best]), 1), leaves - 1)
                for a, v in ((self.axis, axis), (self.cut, cut), (self.low, 0), (self.high, 0)):
                    a.append(v)
                side = np.zeros(len(x), bool)
                side[order[: best + 1]] = True
                self.low[node] = self._grow(x[side], tokens[side], few)
                self.high[node] = self._grow(x[~side], tokens[~side], leaves - few)
                return node
        self.leaves += 1
        return -self.leaves

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root, np.int64)
        while len(at := np.flatnonzero(node >= 0)):
            n = node[at]
            node[at] = np.where((x[at] * self.axis[n]).sum(1) <= self.cut[n], self.low[n], self.high[n])
        return -1 - node


def _sketches(shared):
    def run(batches):
        df, total, mean = shared.value
        idf = _idf(df, total)
        for batch in batches:
            n = batch.column("doc_tokens").to_pylist()
            x = sketch([_ids(r, k) for r, k in zip(batch.column("ids").to_pylist(), n, strict=True)], idf, mean)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("doc_tokens")], ["sketch", "doc_tokens"])

    return run


def _leaves(shared, tree):
    def run(batches):
        df, total, mean = shared.value
        idf = _idf(df, total)
        for batch in batches:
            n = batch.column("doc_tokens").to_pylist()
            x = sketch([_ids(r, k) for r, k in zip(batch.column("ids").to_pylist(), n, strict=True)], idf, mean)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc_tokens", "ids", "order")), pa.array(tree.value.leaf(x))], ["doc_id", "doc_tokens", "ids", "order", "leaf"])

    return run


class Index:
    """BM25 postings of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, total: int, mean: float):
        self.idf = _idf(df, total)
        terms, owner, weight = [], [], []
        for i, d in enumerate(docs):
            t, w = _weights(d, self.idf, mean)
            terms.append(t)
            owner.append(np.full(len(t), i, np.int32))
            weight.append(w)
        terms, owner, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, owner, weight))
        order = np.argsort(terms, kind="stable")
        terms, self.owner, self.weight = terms[order], owner[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(terms, np.arange(len(df) + 1))
        #: the documents' numbers; how many places a term needs to bring a seed to others
        self.docs, self.count, self.least = np.arange(len(docs)), len(docs), 2
        # terms of many documents have a row over all of them, which is faster to add
        often = np.flatnonzero(np.diff(self.start) > max(self.count / 8, 1))
        self.row = np.full(len(df), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.count), np.float32)
        at = self.row[terms] >= 0
        self.rows[self.row[terms[at]], self.owner[at]] = self.weight[at]

    def left(self, open_: np.ndarray) -> Index:
        """The index of some of its documents only, with the same weights."""
        out = object.__new__(Index)
        out.idf, out.row, out.least = self.idf, self.row, 1
        out.docs, out.rows = self.docs[open_], self.rows[:, open_]
        out.count = len(out.docs)
        at = open_[self.owner]
        out.owner, out.weight = (np.cumsum(open_, dtype=np.int32) - 1)[self.owner[at]], self.weight[at]
        out.start = np.r_[0, np.cumsum(at)][self.start]
        return out

    def scores(self, seed: np.ndarray) -> np.ndarray:
        """BM25 of all documents to all terms of the seed."""
        terms = _counts(seed)[0].astype(np.int64)
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(0, dtype=np.float64)
        terms = terms[row < 0]
        lo, hi = self.start[terms], self.start[terms + 1]
        some = hi - lo >= self.least
        spans = [slice(a, b) for a, b in zip(lo[some].tolist(), hi[some].tolist(), strict=True)]
        if spans:
            score += np.bincount(np.concatenate([self.owner[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.count)
        return score

    def neighbours(self, seed: np.ndarray, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; with ``most``,
        that many and those that tie with the last, if there are more."""
        score = self.scores(seed)
        score[~unused[self.docs]] = 0
        near = np.flatnonzero(score > 0)
        if most is not None and len(near) > most:
            near = near[score[near] >= np.partition(score[near], -most)[-most]]
        return self.docs[near[np.argsort(-score[near], kind="stable")]]


def fill(docs: list[np.ndarray], index: Index, length: int = LENGTH):
    """Yield (sequence, document, start, length, offset): full windows, then powers of two."""
    unused = np.ones(len(docs), bool)
    size = np.array([len(d) for d in docs])
    sequence, room, cursor = 0, length, 0
    queue: list[tuple[int, int]] = []  # document and how much of it is placed
    pieces = []
    while True:
        if not queue:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            unused[cursor] = False
            queue.append((cursor, 0))
        doc, done = queue.pop(0)
        take = int(min(room, size[doc] - done))
        pieces.append((sequence, doc, done, take, length - room))
        room -= take
        done += take
        if not room:
            sequence, room, queue = sequence + 1, length, []
        if done < size[doc]:
            queue = [(doc, done)]  # the rest seeds the next window
        elif room and not queue:
            room_left = room
            open_ = unused[index.docs]
            if 4 * open_.sum() < 3 * len(open_):  # used documents leave the index by and by
                index = index.left(open_)
            for most in (NEAR, None):  # the others are put in order where the first don't fill the window
                found = index.neighbours(docs[doc], unused, most)
                for near in found:
                    unused[near] = False
                    queue.append((int(near), 0))
                    room_left -= size[near]
                    if room_left <= 0:
                        break
                if room_left <= 0 or len(found) < NEAR:
                    break
    tail = [p for p in pieces if p[0] == sequence]
    yield from (p for p in pieces if p[0] < sequence)
    left = sum(p[3] for p in tail)
    at = 0
    parts = [(doc, start, n) for _, doc, start, n, _ in tail]
    for bit in reversed(range(left.bit_length())):
        goal = left & (1 << bit)
        at = 0
        while at < goal:
            doc, start, n = parts.pop(0)
            take = min(n, goal - at)
            yield sequence, doc, start, take, at
            at += take
            if take < n:
                parts.insert(0, (doc, start + take, n - take))
        sequence += bool(goal)


def _pack(shared, length: int):
    def run(key, pdf):
        import pandas as pd

        df, total, mean = shared.value
        pdf = pdf.sort_values(["order", "doc_id", "doc_tokens"], kind="stable").reset_index(drop=True)
        docs = [_ids(r, n) for r, n in zip(pdf.ids, pdf.doc_tokens, strict=True)]
        rows = list(fill(docs, Index(docs, df, total, mean), length))
        own = pdf.doc_id.to_numpy()
        return pd.DataFrame({
            "doc_id": [None if own[d] is None or own[d] != own[d] else int(own[d]) for _, d, *_ in rows],
            "start": [s for _, _, s, _, _ in rows], "length": [n for _, _, _, n, _ in rows],
            "ids_crc32": [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for _, d, s, n, _ in rows],
            "doc_tokens": [len(docs[d]) for _, d, *_ in rows], "sequence_id": [int(key[0]) * (1 << 32) + q for q, *_ in rows], "offset": [o for *_, o in rows],
            "ids": [docs[d][s : s + n].astype("<u4").tobytes() for _, d, s, n, _ in rows],
        }).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    docs: doc_id, text; other columns are ignored.  tokenizer: file of a
    tokenizer that drops white space.  Returns a row for each piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned
    32-bit little-endian).  Each id of a document lies in exactly one piece.

    A null or empty text is the end id alone.  Repeated rows are packed each.
    Ties in score go by place in the shard.  Empty table: empty result.
    """
    spark = docs.sparkSession
    tokens = docs.select("doc_id", "text").mapInArrow(_tokens(tokenizer), "doc_id long, doc_tokens long, ids binary")
    tokens = materialize(tokens, "tokens")
    total, mean = tokens.agg(F.count("*"), F.avg("doc_tokens")).first()
    counts = tokens.select("doc_tokens", "ids").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row per id of the vocabulary
    df = np.zeros(max(65536, int(counts.term.max() or 0) + 1 if len(counts) else 0), np.float64)
    df[counts.term.to_numpy(np.int64)] = counts.n.to_numpy(np.float64)
    shared = spark.sparkContext.broadcast((df, total, mean or 0.0))
    tokens = tokens.withColumn("order", F.xxhash64("doc_id", "doc_tokens"))
    dealt = _dealt(tokens, shared, int(total * (mean or 0) * 4) // shard_bytes + 1, shard_bytes)
    return dealt.groupBy("shard").applyInPandas(_pack(shared, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _dealt(tokens: DataFrame, shared, leaves: int, shard_bytes: int) -> DataFrame:
    """tokens (with order, a hash) and the shard of each row, by content."""
    if leaves < 2:
        return tokens.withColumn("shard", F.lit(0).cast("long"))
    spark, (_, total, _) = tokens.sparkSession, shared.value
    some = tokens.where(F.pmod("order", F.lit(1 << 20)) < int((1 << 20) * LEAF_SAMPLE * leaves / total) + 1)
    some = some.mapInArrow(_sketches(shared), "sketch binary, doc_tokens long").toPandas().sort_values(["sketch", "doc_tokens"])
    x = np.frombuffer(b"".join(some.sketch), np.float32).reshape(-1, SKETCH)
    tree = spark.sparkContext.broadcast(Tree(x, some.doc_tokens.to_numpy(), leaves))
    dealt = materialize(tokens.mapInArrow(_leaves(shared, tree), "doc_id long, doc_tokens long, ids binary, order long, leaf long"), "dealt")
    forget(tokens)
    sizes = dealt.groupBy("leaf").agg(F.sum("doc_tokens").alias("n")).toPandas()  # a row per leaf
    parts = np.ones(tree.value.leaves, np.int64)
    parts[sizes.leaf] = np.where(4 * sizes.n > 2 * shard_bytes, -(-4 * sizes.n // shard_bytes), 1)
    first = np.cumsum(parts) - parts
    lookup = spark.createDataFrame([(int(k), int(a), int(n)) for k, (a, n) in enumerate(zip(first, parts, strict=True))], "leaf long, first long, parts long")
    shard = F.col("first") + F.pmod(F.shiftrightunsigned("order", 20), F.col("parts"))
    return dealt.join(F.broadcast(lookup), "leaf").withColumn("shard", shard).drop("leaf", "first", "parts")
