"""BPE, conversations and periodic runs against the library and plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, conversations, periodic
from skyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- op11


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.public_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def packed(encoding):
    return np.array(encoding.ids, dtype="<u4").tobytes()


def odd_texts(n, seed=1):
    pick = random.Random(seed)
    # some of these letters are of other classes in other Unicode versions
    letters = "aabcdeeinrstth  \n\t▁éßñжи中文😀\x00.,-0129THE<>'sll　՘ễ꟎\x85²½ৼ\U00010940"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 80))) for _ in range(n)]
    return [*texts, "x" * 5000, "ab" * 5000, " " * 1000, "\n" * 77 + "a", "<|endoftext|>a<|endoftext|><|endoftext|> b", "中文" * 3000]


def test_ids_equal_the_library_and_decode(vocabulary, library):
    texts = odd_texts(4000)
    got = vocabulary.encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert got == [packed(w) for w in want]
    assert [vocabulary.decode(np.frombuffer(g, "<u4")) for g in got] == texts
    assert 0 < vocabulary.merged < len(vocabulary.known)


def test_any_ids_decode_like_the_library(vocabulary, library):
    pick = random.Random(2)
    for _ in range(2000):
        ids = [pick.randrange(50_300) for _ in range(pick.randint(0, 12))]
        assert vocabulary.decode(np.array(ids, dtype="<u4")) == library.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_when_merging_gives_them_again(vocabulary):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50_256, 8000), r.integers(0, 50_256, 8000)
    a[:5000], b[:5000] = r.integers(0, 1500, 5000), r.integers(0, 1500, 5000)
    again = vocabulary._merge([vocabulary.bytes_of[x] + vocabulary.bytes_of[y] for x, y in zip(a, b)])
    assert vocabulary.compatible(a, b).tolist() == [list(m) == [x, y] for m, x, y in zip(again, a, b)]
    assert not vocabulary.compatible(a, b).all()


def test_both_ways_of_merging_agree(vocabulary):
    pick = random.Random(5)
    words = [bytes(pick.choice(b"aabeinrst \xc3\xa9") for _ in range(pick.randint(1, 32))) for _ in range(2000)]
    for word, ids in zip(words, vocabulary._merge(words)):
        assert ids.tolist() == vocabulary._merge_long(word).tolist()


def test_full_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Vocabulary(bpe.public_vocabulary())
    texts = odd_texts(200, seed=3)
    for _ in range(2):
        assert small.encode(texts) == [packed(w) for w in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.known) <= 5 + len(small.special)


def test_other_models_are_refused(tmp_path):
    import json

    with open(bpe.public_vocabulary(), encoding="utf-8") as f:
        parts = json.load(f)
    parts["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path))


def test_bpe_on_odd_rows(spark, library):
    texts = [None, "", "same", "same", "<|endoftext|>", "long " * 50_000]
    rows = [(i if i else None, t, 7, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string")
    got = bpe.decoded(bpe.encoded(docs, bpe.public_vocabulary()), bpe.public_vocabulary()).collect()
    assert sorted(bytes(r.ids) for r in got) == sorted(packed(library.encode(t or "", add_special_tokens=False)) for t in texts)
    assert sorted(r.decoded for r in got) == sorted(t or "" for t in texts)
    assert bpe.encoded(docs.where("false"), bpe.public_vocabulary()).count() == 0


def test_op11_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode(docs[r.doc_id], add_special_tokens=False)
        back = library.decode(want.ids, skip_special_tokens=False)
        assert r.n_tokens == len(want.ids)
        assert r.ids_sha256 == hashlib.sha256(packed(want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


# ---- op12


def cheapest_of_all(rows, most):
    """Cost, audit and turns over every way with at most ``most`` insertions, by trying all; rows are (role, text, fault)."""
    best = []
    legal = re.compile(r"(s?(ua)+)?")

    def go(i, left, cost, audit, made):
        if best and cost > best[0][0]:
            return
        if i == len(rows):
            if legal.fullmatch("".join(r[:1] or "?" for r, _ in made)):
                best[:] = [min([*best, (cost, audit, made)], key=lambda b: b[:2])]
        if left:
            for role in ("user", "assistant"):
                go(i, left - 1, cost + 2, audit + "I", [*made, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, left, cost + 3, audit + "D", made)
            if fault not in (1, 2):
                more = fault == 3
                go(i + 1, left, cost + more, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, left, cost + 2 + more, audit + "R", [*made, (new, text)])

    go(0, most, 0, "", [])
    return best[0]


def codes_of(rows):
    state = {"s": 1, "u": 2, "a": 3}
    return bytes(state.get(r[:1], 0) | (4 if f in (1, 2) else 8 if f == 3 else 0) for r, _, f in rows)


def random_rows(pick, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(pick.choice(roles), f"t{k}", pick.choice([0, 0, 0, 3, 1, 2])) for k in range(n)]


def test_search_finds_the_cheapest_and_least_way():
    pick = random.Random(1)
    for _ in range(250):
        rows = random_rows(pick, pick.randint(0, 4))
        cost, audit, made = cheapest_of_all(rows, 4)
        codes = codes_of(rows)
        assert conversations.search(codes, conversations.START, conversations.ACCEPTED) == (cost, audit)
        left = conversations.edited(0, audit, conversations.keeps_system(codes, audit))
        turns = [(rows[k][0] if new is None else new, "" if e == "I" else rows[k][1]) for k, x in enumerate(left[:-1]) for e, new in x]
        assert turns + [(new, "") for _, new in left[-1]] == made


def least_by_rows(codes):
    """The same by a table over rows: least (cost, audit) per state, a row at a time."""
    inf = (1 << 60, "")

    def inserted(table):
        for _ in range(2):
            table = [
                min([table[s], *((table[p][0] + 2, table[p][1] + "I") for p in range(4) if conversations.NEXT[p] == s)])
                for s in range(4)
            ]
        return table

    table = inserted([(0, ""), inf, inf, inf])
    for code in codes:
        new = [inf] * 4
        for s in range(4):
            cost, audit = table[s]
            options = [(s, 3, "D")]
            if not code & 4:
                more = bool(code & 8)
                to = code & 3
                if (to == 1 and s == 0) or (to and to == conversations.NEXT[s]):
                    options.append((to, more, "K"))
                options.append((conversations.NEXT[s], 2 + more, "R"))
            for to, step, letter in options:
                new[to] = min(new[to], (cost + step, audit + letter))
        table = inserted(new)
    return min(table[0], table[3])


def test_long_conversations_are_solved_in_blocks():
    pick = random.Random(2)
    for _ in range(300):
        codes = codes_of(random_rows(pick, pick.randint(0, 40)))
        want = least_by_rows(codes)
        assert conversations.search(codes, 0, (0, 3)) == want
        for block in (1, 2, 7):
            cost, audits = conversations.repair(codes, block)
            assert (cost, "".join(a for _, a in audits)) == want


def damage(conv_id, turn, role, text):
    show = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_repair(rows):
    """The row of op12 for the rows of one conversation, without its id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = 1
        elif (role, text) in seen:
            fault = 2
        else:
            fault = 0 if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else 3
        seen.add((role, text))
        counts[fault - 1] += fault > 0
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
    codes = codes_of(faulty)
    cost, audit = least_by_rows(codes)
    left = conversations.edited(0, audit, conversations.keeps_system(codes, audit))
    made = [f"{faulty[k][0] if new is None else new}:{'' if e == 'I' else faulty[k][1]}" for k, x in enumerate(left[:-1]) for e, new in x]
    made += [f"{new}:" for _, new in left[-1]]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def by_conversation(rows):
    want = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        want[c] += damage(c, turn, role, text)
    return {c: plain_repair(r) for c, r in want.items()}


def test_op12_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_repair"](spark, SF).collect()}
    assert got == by_conversation(rows)


def test_op12_on_odd_rows(spark, tmp_path, monkeypatch):
    pick = random.Random(4)
    rows = []
    for c in (None, -1, *range(40)):
        for k in range(pick.randint(1, 12)):
            turn = pick.choice([k, k, k, k, None, 3])
            role = pick.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"])
            text = pick.choice([None, "", " \t\n", "Yes.", "No!  ", "why", " ", f"turn {k}.", "long " * 20_000])
            rows.append((c, turn, role, text, "own", 1, 2))
    rows += [(9, 100, "user", "Twice.", "own", 1, 2)] * 3
    schema = "conv_id long, turn int, role string, text string, audit string, position int, hash int"
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    want = by_conversation([r[:4] for r in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert {r[0]: r[1:] for r in con.sql(conversations.OP12_SQL).fetchall()} == want
    for block in (conversations.BLOCK, 3):
        monkeypatch.setattr(conversations.repaired, "__defaults__", (block,))
        got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_repair"](spark, str(tmp_path)).collect()}
        assert got == want
    turns, report = conversations.repaired(spark.createDataFrame([], schema))
    assert turns.count() == report.count() == 0


# ---- op13


def plain_runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            smallest = not any(part[p:] == part[:-p] for p in range(1, q))
            if len(part) >= max(least, times * q) and smallest:
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_python():
    pick = random.Random(3)
    for least, times in ((24, 3), (6, 3), (4, 2)):
        for _ in range(150):
            docs = []
            for _ in range(pick.randint(1, 5)):
                n, k = pick.randint(0, 120), pick.choice([1, 2, 2, 3, 5, 50])
                d = [pick.randrange(k) for _ in range(n)]
                if n > 3 and pick.random() < 0.7:
                    a, p = pick.randrange(n), pick.randint(1, 30)
                    d = d[:a] + [d[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
                    d[pick.randrange(n)] = pick.randrange(k)
                docs.append(d)
            got = periodic.runs_of([np.array(d, dtype=np.int64) for d in docs], least, times)
            assert got == [plain_runs(d, least, times) for d in docs]


def test_grams_that_come_twice_within_a_period_hide_nothing():
    # Every 16-gram of the period comes twice in it, in another order of the parts.
    x, y, z = (list(range(a, a + 20)) for a in (0, 100, 200))
    period = [*x, *y, *x, *z, *y, *z]
    assert periodic.runs_of([np.array(period * 3 + period[:7], dtype=np.int64)]) == [[(0, 367, 120)]]


def test_repetitive_texts_stay_cheap():
    assert periodic.runs_of([np.zeros(300_000, dtype=np.int64)]) == [[(0, 300_000, 1)]]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(periodic.runs_of([np.array(b)])[0]) > 1000


def plain_row(doc_id, text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    numbers = {w: k for k, w in enumerate(set(words))}
    runs = plain_runs([numbers[w] for w in words], 24, 3) if n <= 700 else periodic.runs_of([np.array([numbers[w] for w in words])])[0]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, periodic.digest(runs), hashlib.sha256(kept.encode()).hexdigest())


def test_op13_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic"](spark, SF).collect()}
    assert got == {d: plain_row(d, t) for d, t in docs}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_op13_on_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "a", "a " * 23, "a " * 24, " b  " * 30, "x y " * 40_000, "same words", "same words", "a b c " * 9 + "d e " * 13]
    rows = [(i + 1, t, 3, "own") for i, t in enumerate(texts)] + [(None, "k l " * 20, 3, "own")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").write.parquet(path)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic"](spark, str(tmp_path)).collect()}
    want = {d: plain_row(d, t) for d, t, *_ in rows if d is not None}
    assert got.pop(None)[:5] == (1, 0, 40, 2, 20_000)
    assert got == want
    empty = periodic.annotated(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
