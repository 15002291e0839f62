"""Near duplicates of vectors and texts, and components, against brute force."""

import random

import numpy as np
import pytest

from skyloom.llm import jaccard, vector_dedup
from skyloom.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(pick.randint(200, 260), pick.randint(200, 260)) for _ in range(50)]
    edges += [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    pick = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        centres = pick.normal(size=(12, 16))
        for c in range(12):
            for _ in range(10):
                rows.append((centres[c] + pick.normal(size=16) * 0.25, label))
    rows += [(rows[0][0], 0)] * 30 + [(rows[0][0] * 3.5, 0)]
    rows = [(i, [float(x) for x in v], label, "x") for i, (v, label) in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [1e-300] * 16]
    rows += [(1000 + i, v, 0, "x") for i, v in enumerate(odd)] + [(None, [1.0] * 16, 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, unit string")
    usable = [(i, np.array(v) / max(map(abs, v)), label) for i, v, label, _ in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = set()
    for x, (i, v, a) in enumerate(usable):
        for j, w, b in usable[x + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= vector_dedup.LEAST:
                links.add((i, j))
    assert len(links) > 500
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = roots([r[0] for r in rows if r[0] is not None], links)
    for cell_rows, block_rows in ((2000, 4096), (15, 8)):
        got = vector_dedup.near_duplicates(table, cell_rows=cell_rows, block_rows=block_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            if i is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            else:
                assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], want[i], want[i] == i)
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def sets_of(texts, words=5):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def similar(texts):
    s = sets_of(texts)
    ids = list(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = roots(ids, links)
    return {i: (len(s[i]), want[i]) for i in ids}


def corpus():
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "ONE", "two words", "four words are here", "x" * 5000]
    for _ in range(40):  # share a passage and little else
        own = [word() for _ in range(pick.choice([4, 10, 40]))]
        texts.append(" ".join(own + passage))
    for size in (2, 5, 40):  # copies with edits, near the threshold too
        base = [word() for _ in range(pick.choice([30, 80]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                copy[pick.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if pick.random() < 0.8 else " ".join(copy).upper())
    chain = [word() for _ in range(60)]
    for k in range(0, 60, 3):  # each links with its neighbours only
        texts.append(" ".join(chain[k:] + chain[:k][: k // 2] + ["end"]))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    texts += [texts[60]] * 30
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
def test_documents_equal_brute_force(spark, monkeypatch, small):
    if small:  # every branch: large regions, chunks, blocks, dealt pivots, an order of few shingles
        for name, value in {"SMALL_REGION": 3, "CHUNK_ROWS": 7, "BLOCK_ROWS": 6, "PIVOT_MEMBERS": 4, "LOT_SHINGLES": 300, "LOT_DOCS": 9, "BUCKET_SHINGLES": 500, "ASKED": 2}.items():
            monkeypatch.setattr(jaccard, name, value)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, key string, n long").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()}
    want = similar(texts)
    assert got == want
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_documents_without_rows_or_ids(spark):
    schema = "doc_id long, text string"
    assert jaccard.similar_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z")]
    got = list(((r[0] or -1), r[2]) for r in jaccard.similar_documents(spark.createDataFrame(rows, schema)).collect())
    assert [g for g in got if g[0] == 4] == [(4, 4), (4, 4)]
    assert (-1, 4) in got and (-1, None) in got


@pytest.mark.parametrize("words", range(7))
def test_batches_of_one_short_text(words):
    text = " ".join("abcdefg"[:words])
    items, begin = jaccard.shingles([text], jaccard.WORDS)
    among, places = jaccard.shingles(["x y", text, "z " * 9], jaccard.WORDS)
    assert items.tolist() == among[places[1] : places[2]].tolist() and begin.tolist() == [0, len(items)]


def test_partitions_of_one_short_text(spark):
    texts = {1: "two words", 2: "only three words", 3: "Two  WORDS"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(3, "doc_id")
    got = {tuple(r) for r in jaccard.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_links_meet_often_enough_in_both_windows():
    pick = random.Random(6)
    for _ in range(4000):
        n, m = sorted(pick.randint(1, 90) for _ in range(2))
        shared = -(-3 * (n + m) // 7)
        if shared > n or 4 * shared < 3 * (n + m - shared):
            continue
        order = [*([0] * shared), *([1] * (n - shared)), *([2] * (m - shared))]
        pick.shuffle(order)
        places = [[k for k, x in enumerate(order) if x in (0, own)] for own in (1, 2)]
        windows = [set(p[: jaccard.window(len(p))]) for p in places]
        common = [k for k in sorted(windows[0] & windows[1]) if order[k] == 0]
        least = int(jaccard.least_met(n, m))
        assert len(common) >= least
        pos = [p.index(common[0]) for p in places]
        assert jaccard.can_link(np.array(n), pos[0], least, np.array(m), pos[1], least)


def test_windows_meet_all_partners():
    for n in range(1, 60):
        for m in range(n, 60):
            shared = -(-3 * (n + m) // 7)
            if shared <= n and 4 * shared >= 3 * (n + m - shared):
                # of two sets that share that many, the first common pivot lies in both windows
                assert n - shared < jaccard.window(n) and m - shared < jaccard.window(m)


def test_no_operator_uses_local_checkpoints():
    import pathlib

    import skyloom.llm

    for path in pathlib.Path(skyloom.llm.__file__).parent.glob("*.py"):
        assert "localCheckpoint" not in path.read_text()


def test_stages_keep_columns_named_like_helpers(spark):
    from skyloom.llm import decontaminate, quality

    names = ("gone", "least", "leaking", "label", "labelled", "features", "score", "r", "d", "hits", "place", "key", "pivot")
    rows = [(i, f"some words of text number {i} that say little and end here.", *range(len(names))) for i in range(12)]
    rows += [(90, rows[0][1], *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([("b", rows[3][1])], "item_id string, text string")
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == 12
    clean = decontaminate.drop_documents(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {3}
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns and good.count() >= 0


def test_shuffled_shingles_leave_out_bytes_that_hardly_change(spark):
    import pyarrow as pa

    words = [f"w{random.Random(i).randrange(10**9)}" for i in range(6000)]
    texts = [" ".join(words[20 * (i // 2) : 20 * (i // 2) + 400]) for i in range(500)]
    docs = spark.createDataFrame([(f"{i} {t}",) for i, t in enumerate(texts)], "text string").coalesce(1)
    shared = jaccard.shared_shingles(jaccard.lots(docs, 5, 2), 2).collect()
    raw = sum(len(r["tokens"]) for r in shared)
    assert raw > 100_000
    assert sum(len(pa.compress(r["tokens"], codec="lz4", asbytes=True)) for r in shared) < 0.8 * raw
    for kind in (np.uint16, np.int32, np.int64):
        parts = [np.array(x, dtype=kind) for x in ([], [1, 2, 30_000], [7])]
        assert jaccard.from_planes([jaccard.planes(x) for x in parts], kind).tolist() == [1, 2, 30_000, 7]
        assert jaccard.from_planes([], kind).tolist() == []
