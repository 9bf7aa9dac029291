"""The corpus operators against brute force on small fixtures with nulls, ties and repeats."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import licenses, mixing, ordinal, packing, pages, pseudonyms, repeats, rules, shingles, vectors


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_repeats(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["ab", "cde", "é", "fghij"]) + str(rng.randint(0, 99)) for _ in range(n))
    p, q = words(120), words(200)
    rows = [(i, words(rng.randint(1, 120))) for i in range(8)] + [(20, words(50) + p + words(30)), (21, words(10) + p), (22, p + p), (23, q), (24, q[:-20] + "zz"), (27, None), (28, ""), (29, "a" * 900), (31, q), (31, q), (None, words(99))]
    count, bs = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in bs:
        count.update(b[s : s + 400] for s in range(len(b) - 399))
    want = []
    for i, b in bs:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in repeats.remove_repeats(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repeats.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_repeats_in_long_texts_without_hot_strings(spark, monkeypatch):
    """Texts over CHUNK are scanned in overlapping parts; no string counts as hot."""
    monkeypatch.setattr(repeats, "HOT", 1)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2 * repeats.CHUNK + 1000))
    other = "".join(rng.choice("ijklmnop ") for _ in range(3000))
    at = repeats.CHUNK - 250
    got = {r.doc_id: r for r in repeats.remove_repeats(docs_of(spark, [(1, text), (2, other[:1000] + text[at : at + 700] + other[1000:]), (3, other)])).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (700, 1) and got[1].kept_text == text[:at] + text[at + 700 :]
    assert got[2].n_removed == 3700 and got[3].n_removed == 3000 and got[3].kept_text == ""


def test_passages_of_over_50_words_in_other_documents(spark, monkeypatch):
    """Most are under 400 bytes, so their bytes stay; repeats within one document are none."""
    rng = random.Random(5)
    words = lambda n: [rng.choice("abé") + str(rng.randrange(99)) for _ in range(n)]
    p, q, r, s = words(51), words(50), words(80), words(70)
    own = lambda n: words(rng.randint(1, n))
    lists = [own(60) + p + own(60), own(60) + p + own(60) + r[:60], own(60) + q + ["x"], q + ["y"], own(9) + r + own(9), r[7:], p, s + s + own(9), s[:40] + own(200) + r[3:70], ["z"] * 300, ["z"] * 55 + p + p, ["w" * 400] + p]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(lists)] + [(30, None), (31, " "), (32, "lone " * 60), (32, "lone " * 60), (None, " ".join(own(9) + r))]
    held, texts = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for row, w in zip(rows, texts, strict=True):
        for k in range(len(w) - 50):
            held.setdefault(tuple(w[k : k + 51]), set()).add(row)
    want = []
    for (i, _), w in zip(rows, texts, strict=True):
        covered = bytearray(b"-" * len(w))
        for k in range(len(w) - 50):
            if len(held[tuple(w[k : k + 51])]) > 1:
                covered[k : k + 51] = b"+" * 51
        want.append((i, len(re.findall(rb"\++", covered)), covered.count(b"+")))
    assert [x[1:] for x in want[2:4]] == [(0, 0)] * 2 and want[0][1:] == (1, 51) and want[7][1:] == (0, 0) and want[13][1:] == (0, 0)
    for hot in (repeats.HOT, 1, 10**9):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = repeats.remove_repeats(docs_of(spark, rows)).collect()
        assert sorted(((x.doc_id, x.n_passages, x.n_passage_words) for x in got), key=str) == sorted(want, key=str)
        assert next(x.n_removed for x in got if x.doc_id == 0) == 0


def test_word_hashes_in_small_parts(monkeypatch):
    texts = [None, "", " a bc\x0b\xa0d ", "bc", "e" * 99 + "\n" + "f" * 40 + " é", "\r", "bc a", "e" * 99]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for part in (repeats.CHUNK, 50, 1):
        monkeypatch.setattr(repeats, "CHUNK", part)
        found, offs = repeats.word_hashes(pa.array(["x", *texts]).slice(1))
        assert offs.tolist() == np.cumsum([0, *map(len, words)]).tolist()
        flat = [w for ws in words for w in ws]
        assert [np.flatnonzero(found == h)[0] for h in found] == [flat.index(w) for w in flat]


@pytest.mark.parametrize("route", [1 << 20, 64])
def test_jaccard(spark, monkeypatch, route):
    monkeypatch.setattr(shingles, "ROUTE", route)  # 64: many routes, and n-grams dealt to several
    monkeypatch.setattr(shingles, "CROWD", route >> 5)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for base in [words(rng.randint(30, 200)) for _ in range(6)]:
        for _ in range(12):
            c = list(base)
            for _ in range(rng.randint(0, len(c) // 22)):
                c[rng.randrange(len(c))] = "x"
            rows.append(" ".join(c))
    shared = words(60)
    rows += [" ".join(words(rng.randint(5, 80)) + shared) for _ in range(20)] + ["", " ", None, "A b", "a B", "x"]
    rows = list(enumerate(rows))
    bridge = [f"b{k}" for k in range(200)]
    rows += [(900, " ".join(bridge)), (901, " ".join(bridge[:-12] + ["z"] * 12)), (902, " ".join(bridge[20:-24] + ["y"] * 44))]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = np.arange(len(rows))
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = shingles.jaccard_components(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(rows[i][0], len(s), rows[int(root[i])][0]) for i, s in enumerate(sets)]


def test_last_round_meets_every_pair_that_shares_enough(spark, monkeypatch):
    rng, percent = random.Random(8), 75
    rows, first = [], {}
    for cls in range(80):
        n = rng.choice([40, 50, 52, 53, 60, 100, 130])
        # a few n-grams that most sets hold, and some that few do
        own = {t for t in range(12) if rng.random() < 0.8} | {rng.randrange(12, 60) for _ in range(rng.randrange(10))}
        first[cls] = (n, set(list(own)[: n - (percent * n + 99) // 100 + 1]))
        if cls % 9 < 2:
            first[cls][1].update({99, 100, 102})  # the same classes hold all three
        rows += [(t, cls, n, cls % 7) for t in first[cls][1]]
    monkeypatch.setattr(shingles, "NEAR", 3)
    monkeypatch.setattr(shingles, "CROWD", 8)
    rare = shingles._rarest_first(spark.createDataFrame(rows, "t long, cls long, n long, g long"), percent)
    met = {(r.a, r.b) for r in shingles._meeting(rare, percent).collect()}
    rare = rare.collect()
    held, pairs = {}, 0
    for r in rare:
        held.setdefault(r.cls, {})[r.t] = r.after
    assert not {100, 102} & {r.t for r in rare}
    for a, b in combinations(range(80), 2):
        (na, sa), (nb, sb) = first[a], first[b]
        need = max(-((na + nb) * -percent // (100 + percent)) + max(na, nb) * -percent // 100 + 1, 1)
        if a % 7 != b % 7 and 100 * min(na, nb) >= percent * max(na, nb) and len(sa & sb) >= need:
            pairs += 1
            assert (a, b) in met
            assert any(min(held[a][t], held[b][t]) >= need for t in held.get(a, {}).keys() & held.get(b, {}).keys())
    assert pairs > 50


def test_jaccard_links_rows_without_id(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(7, " ".join(words)), (None, " ".join(words[:-1])), (9, " ".join(words[:-1] + ["x"])), (None, None), (3, "lone words that link with nothing at all")]
    got = shingles.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (4, 3), (195, 7), (196, 7), (196, 7)]


def test_prefix_tree_finds_all():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    tree = shingles.PrefixTree(sets)
    for s in sets[:20]:
        want = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert sorted(tree.linked(s, 75, step=4)) == want


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(10, 8))
    rows = [(k, (base[rng.integers(10)] + rng.normal(size=8) * 0.3 * rng.random()).tolist()) for k in range(120)] + [(200, None), (201, [0.0] * 8), (202, []), (203, [1.0] * 7 + [None]), (204, [float("nan")] * 8)]
    rows += [(300 + k, rows[3][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i < 200 or i >= 300]
    root = {i: i for i, _ in good}
    for _ in good:
        for i, v in good:
            root[i] = min(root[j] for j, w in good if w @ v >= 0.95)
    for i, v in good:
        assert got[i] == (sum(j != i and w @ v >= 0.95 for j, w in good), root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(200, 205))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_several_lengths_and_scales(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1.0, 0.0]), (4, [1e-200, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 0.1, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [3.0]), (9, [-3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {**{k: (3, 1) for k in (1, 2, 3, 4)}, 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9), None: (0, None)}


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), ["a", "b", "c", None][i % 4] if i < 90 else "d") for i in range(100)] + [(200, None, "e")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 101 and all(r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6
    for target, taken, size in by.values():
        assert abs(target - taken) <= 1 and target <= 3 * size + 1e-9


def test_licenses():
    s = licenses.Scanner()
    assert s.scan(b"Licensed under the Apache License, Version 2.0.")[:6] == (8, 1, 3, 3, "apache", "apache,apache-2.0")
    assert s.scan(b"the apache license")[1:5] == (1, 1, 1, "apache")
    assert s.scan(b"mit freundlichen by")[:2] == (3, 0) and s.scan(b"")[0] == 0
    assert len(licenses.rules()) > 200


def test_pseudonyms(spark):
    rows = [(0, "a.1@mail5.example.com 4068516892505468 4068516892505469"), (1, "+1 (136) 555-7479 1.2.3.4 300.1.1.1"), (2, None), (3, ""), (4, "4068516892505468 on 2024-02-29")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of(spark, rows), "k").collect()}
    assert got[2].text is None and got[3].text == "" and got[0].n_found == {"email": 1, "card": 1}
    assert "4068516892505469" in got[0].text and "300.1.1.1" in got[1].text and "1.2.3.4" not in got[1].text
    assert got[0].text.split()[1] == got[4].text.split()[0] != "4068516892505468"
    digits = [int(c) for c in got[4].text.split()[0]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert df.distinct().count() == 1000


def test_packing():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 500, n).astype(np.uint32) for n in (1, 5000, 30, 2047, 2048, 900, 700, 1, 64)]
    index = packing.Index(docs, np.ones(65536), len(docs), 100.0)
    pieces = list(packing.fill(docs, index))
    for d in range(len(docs)):
        own = sorted((s, n) for _, k, s, n, _ in pieces if k == d)
        assert [s for s, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) == len(docs[d])
    sizes = Counter()
    for q, _, _, n, _ in pieces:
        sizes[q] += n
    assert all(v == 2048 or v & (v - 1) == 0 for v in sizes.values()) and zlib.crc32(b"") == 0


def test_pages():
    page = '<nav><li>x</nav><div class="ad">buy</div><article><header><h1>T</h1></header><p><b>A<br><p>B &amp; <i>c</i><script>"</p>"</script><p class="notice">z</p></article><footer>f'
    assert [x for x, core in pages.text_lines(page) if core] == ["T", "A", "B & c"]
    assert pages.common_lines([1, 2, 3, 4], [2, 9, 4]) == [1, 3]


def test_every_page_is_differenced(spark):
    rows = [
        (1, "http://h.org/a/1", "<div>Site</div><div>Title one</div><article><p>Same</p><p>First</p></article><div>Bottom</div>"),
        (2, "http://h.org/a/2", "<div>Site</div><div>Title two</div><article><p>Same</p><p>Second</p></article><div>Bottom</div>"),
        (3, "http://h.org/a/3", "<p>Site</p><p>No article is marked here</p><p>Bottom</p>"),
        (4, "http://alone.org/x", "<div>Site</div><article><p>Alone</p></article>"),
        (5, "http://copy.org/x", "<p>A long copied text</p><p>x</p>"), (6, "http://copy.org/y", "<p>A long copied text</p><p>y</p>"),
        (7, None, None), (8, "http://h.org/a/4", "<nav>Site</nav>"),
    ]
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {
        1: "Title one\nSame\nFirst", 2: "Title two\nSame\nSecond", 3: "No article is marked here", 4: "Alone",
        5: "A long copied text\nx", 6: "A long copied text\ny", 7: "", 8: "",
    }


def test_rule_statistics():
    import pyarrow as pa

    from tallyframe.llm.common import text_bytes

    texts = ["a b c d e f a b c d e", None, "x\nx\n\n#é*", "one"]
    s = rules.statistics(*text_bytes(pa.array(texts)))
    assert s.n_words.tolist() == [11, 0, 3, 1] and s.word_chars.tolist() == [11, 0, 5, 3]
    assert s.n_symbols.tolist() == [0, 0, 2, 0] and s.n_dup_lines.tolist() == [0, 0, 1, 0] and s.n_repeat_words.tolist() == [10, 0, 0, 0]


def test_rules_are_fitted_on_every_labelled_row(spark):
    rng = random.Random(3)
    text = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 60))) + ("#" * (i % 7))
    docs, grades = [(i, text(i)) for i in range(600)], [(i, int(i % 5 > 0)) for i in range(500)] + [(3, 1), (None, 1), (4, None)]
    docs += [(900, None), (901, "#" * 400 + " a b c d e f g h i j"), (902, "$ " * 40)]
    labels = spark.createDataFrame(grades, "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.quality_rules(docs_of(spark, docs), labels).collect()}
    good = sorted(got[i].anomaly for i in range(500) if i % 5)
    assert not got[900].kept and not got[901].kept and not got[902].kept and sum(not got[i].kept for i in range(500) if i % 5) <= 1
    # the threshold and the rows held by the trees are those of all good rows, counted plainly
    table = rules.statistics(*rules.text_bytes(__import__("pyarrow").array([t for _, t in docs])))
    x, g = rules.features(table), [i for i in range(500) if i % 5]
    forest = rules.plant(x[:500].min(0), x[:500].max(0))
    held = np.stack([np.bincount(forest.nodes(x[g], t), minlength=forest.feature.shape[1]) for t in range(rules.TREES)])
    assert (held.sum(1) == len(g)).all()
    forest.weigh(held)
    assert [got[i].anomaly for i in range(600)] == pytest.approx(forest.score(x)[:600].tolist())
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if not r.base_failed and r.anomaly <= good[-1]}


def test_grades_are_ordered():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    doc, bucket = np.arange(600), grade + 10
    model = ordinal.fit_grades(doc, bucket, grade, bits=8)
    expected = model.tails(model.latent(doc, bucket, 600)).sum(1)
    assert [round(expected[grade == g].mean()) for g in range(3)] == [0, 1, 2] and (np.diff(model.theta) >= 0).all()


@pytest.mark.parametrize("f", [repeats.remove_repeats, shingles.jaccard_components, lambda d: pseudonyms.pseudonymise(d, "k"), licenses.scan_licenses])
def test_empty_table(spark, f):
    assert f(docs_of(spark, [(1, "a")]).where("doc_id = 0")).count() == 0


def test_words_in_runs_have_the_ids_of_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyframe.llm.packing import _encode

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", " \t", "a\x1cb c\x1f", "|a| || ~ ¤ x", "it's CAN'T", "é ́x", "a b　c\x85d", "w" * 5000, "same same"]
    whole = Tokenizer.from_file(path)
    texts += ["Größe,%%% ÀÉ!", "a\u0301 e\u0301É", "x\u0130 İ ß ſ µ ª", "<|endoftext|> a<|endoftext|>b", "_a_ [b]c^ `d` {e}~", "don't 'S 12a3", "x\x1fy", "\u2028z\u00a0q\u200bq"]
    ids, n = _encode(path, pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_tables_are_written_without_a_process_for_each_file(spark):
    """The local file system starts chmod for a file that has a checksum file, and for that file, too."""
    from tallyframe.llm import common

    kept = common.materialize(spark.range(100).repartition(3), "kept")
    names = os.listdir(common._paths[id(kept)].removeprefix("file://"))
    assert sum(n.endswith(".parquet") for n in names) == 3 and not [n for n in names if n.endswith(".crc")]
    assert kept.count() == 100
    path = common._paths[id(kept)].removeprefix("file://")
    common.forget(kept)
    assert not os.path.exists(path)


def test_idle_workers_hold_little():
    """A worker that packed and then ran a step of another operator has the memory of a new one again."""
    code = """if True:
        import random, re, sys
        import public_tokenizers, pyarrow as pa
        from tallyframe.llm import packing, rules, shingles
        held = lambda: sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
        rng, path = random.Random(3), public_tokenizers.path("word_bpe_49k.json")
        texts = lambda: pa.array([" ".join("%x" % rng.getrandbits(40) for _ in range(200)) for _ in range(1500)])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(1500)), texts(), pa.array(range(1500))], ["doc_id", "text", "tk"])
        rows = lambda step: sum(b.num_rows for b in step([batch()]))
        assert rows(rules._measured([])) == 1500
        new, packed = held(), rows(packing._tokens(path))
        after = held()
        assert packed == 1500 and after > new + 100, (new, after)
        assert rows({"rules": rules._measured([]), "shingles": shingles._sum_up(5)}[sys.argv[1]]) >= 1500
        assert held() < new + 60, (new, after, held())
        assert rows(packing._tokens(path)) == 1500
    """
    for step in ("rules", "shingles"):
        done = subprocess.run([sys.executable, "-c", code, step], capture_output=True, text=True)
        assert not done.returncode, done.stderr[-600:]


def test_packing_keeps_copies_together_in_many_shards(spark):
    import public_tokenizers

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(100)]
        for k in range(4):
            rows.append((4 * g + k, " ".join(w if rng.random() < 0.95 else rng.choice(words) for w in base)))
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("word_bpe_49k.json"), length=512, shard_bytes=40_000).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    assert len(shard) == 240 and len(set(shard.values())) >= 8
    assert sum(shard[4 * g] == shard[4 * g + k] for g in range(60) for k in (1, 2, 3)) >= 120  # dealt by a hash, about 20
    copies = packing.pack(docs_of(spark, [(i, " ".join(words[:100])) for i in range(300)]), public_tokenizers.path("word_bpe_49k.json"), length=512, shard_bytes=40_000).collect()
    sizes = Counter()
    for r in copies:
        sizes[r.sequence_id >> 32] += 4 * r.length
    assert len({r.doc_id for r in copies}) == 300 and max(sizes.values()) < 80_000


def test_packing_asks_for_all_terms():
    docs = [np.arange(60), np.arange(30, 60), *(np.arange(30) + 100 * k for k in range(1, 4))]
    df = np.ones(65536)
    df[30:60] = 2
    index = packing.Index([d.astype(np.uint32) for d in docs], df, 5, 40.0)
    assert index.neighbours(docs[0], np.array([False, True, True, True, True])).tolist() == [1]


def test_ids_of_texts_with_their_end():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array(["", "a b", "a\x1cb", " \t", "x\x1fy", "Größe,%% ÀÉ! 12", ""])
    ids, n = packing._encode(path, texts)
    with_end, m = packing._encode(path, texts, end=True)
    want = [[*own.tolist(), packing.END] for own in np.split(ids, np.cumsum(n)[:-1])]
    assert [own.tolist() for own in np.split(with_end, np.cumsum(m)[:-1])] == want and with_end.itemsize == 2


def test_used_documents_leave_the_index(monkeypatch):
    """Fewer documents are scored as windows are filled; the neighbours are those of the whole index."""
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.zipf(1.3, rng.integers(30, 90)) % 3000 + 2).astype(np.uint16) for _ in range(400)]
    docs += docs[:150]  # ties
    df = np.zeros(65536)
    for d in docs:
        df[np.unique(d)] += 1
    index, scored = packing.Index(docs, df, len(docs), 60.0), []
    scores, neighbours = packing.Index.scores, packing.Index.neighbours

    def checked(self, seed, unused, most=None):
        score = scores(index, seed)
        near = np.flatnonzero(unused & (score > 0))
        found = neighbours(self, seed, unused, most)
        want = near[np.argsort(-score[near], kind="stable")]
        assert found.tolist() == want[: len(found)].tolist() and len(found) >= min(len(want), most or len(want))
        return found

    monkeypatch.setattr(packing.Index, "scores", lambda self, seed: scored.append(self.count) or scores(self, seed))
    monkeypatch.setattr(packing.Index, "neighbours", checked)
    for length in (300, 3000):  # up to NEAR documents in a window, and more
        scored.clear()
        pieces = list(packing.fill(docs, index, length))
        assert sum(n for *_, n, _ in pieces) == sum(map(len, docs))
        assert len(scored) > 5 and sum(scored) < 0.8 * len(docs) * len(scored)


def test_pseudonyms_without_digits(spark):
    secrets = ["password: correcthorsebattery", "passwd=abcdefgh", "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "abcdefabcd" * 4, "ABCDEFABCD" * 4]
    rows = [(i, f"see {s} here") for i, s in enumerate(secrets)] + [(9, "a password is a word")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of(spark, rows), "k").collect()}
    for i, s in enumerate(secrets):
        assert got[i].n_found == {"secret": 1} and s not in got[i].text
    assert got[9].text == "a password is a word" and got[9].n_found == {}


def test_cards_beside_other_numbers(spark):
    card = "4068516892505468"
    rows = [(0, f"{card} 123"), (1, f"{card} 12/27"), (2, f"item 5 {card}"), (3, "4068 5168 9250 5468 123"), (4, card), (5, "4068516892505469 123")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of(spark, rows), "k").collect()}
    new = got[4].text
    assert [got[i].text for i in (0, 1, 2)] == [f"{new} 123", f"{new} 12/27", f"item 5 {new}"] and new != card
    assert got[3].text.replace(" ", "") == new + "123" and all(got[i].n_found == {"card": 1} for i in range(5))
    assert got[5].text == "4068516892505469 123"


def test_licences_in_british_spelling():
    s = licenses.Scanner()
    for text in (b"the MIT licence", b"GNU General Public Licence", b"licensed under the Apache Licence, Version 2.0"):
        ours, theirs = s.scan(text), s.scan(text.replace(b"icence", b"icense"))
        assert ours[7] == theirs[7] and ours[7] and ours[6] > 0  # base phrases, kept as spelt, add to theirs


def test_pseudonyms_of_long_tokens_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(0, "x" * 1_000_000), (1, "a@b" + ".c" * 100_000), (2, "1." * 100_000), (3, "mail a.b@c-d.example.org. 000-00-0000 (000) 000-0000 123-45-6789"), (4, "word " * 200_000)]
    docs = docs_of(spark, rows).withColumn("hits", F.lit(7)).withColumn("a.b", F.lit(8)).withColumn("N_found", F.lit(9))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert [got[i].text for i in (0, 1, 2, 4)] == [rows[i][1] for i in (0, 1, 2, 4)]
    assert got[3].n_found == {"email": 1, "number": 1} and "000-00-0000 (000) 000-0000" in got[3].text and got[3].hits == 7 and got[3]["a.b"] == 8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    base = words(120)
    rows = [(k, words(60), "en", "ab"[k % 2], 1) for k in range(30)] + [(40, base, "en", "a", 1), (41, base + " end", "en", None, 1), (42, base, None, "b", None), (43, None, None, None, None), (44, "", "en", "a", 0), (45, "x " * 500, "en", "a", 1), (46, words(50) + " card 4068516892505468", "en", "a", 1), (None, words(40), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipe.rule_stage(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == pipe.COLUMNS and {43, 44, 45}.isdisjoint(ids) and len(ids & set(range(30))) >= 28
    alone = pipe.near_copy_stage(spark, docs, str(tmp_path))
    left = [r.doc_id for r in alone.collect()]
    assert alone.columns == pipe.COLUMNS and 40 in left and 41 not in left and 42 not in left and set(range(30)) <= set(left) and None in left
    hidden = {r.doc_id: r.text for r in pipe.privacy_stage(spark, docs, str(tmp_path)).collect()}
    assert len(hidden) == len(rows) and "4068516892505468" not in hidden[46] and hidden[40] == base and hidden[43] is None
    mixed = pipe.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == pipe.COLUMNS and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = pipe.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in packed}.values())
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
