"""Tokens, personal data, quality, decontamination and the pipeline against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, pieces, pii, quality, token_store
from skyloom.llm.common import with_columns

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "Straße Ünïcode 中文 😀 a▁b",
    "tab\tand  two spaces \n end ",
    "<|endoftext|> is text",
    "x" * 50_000,
    "word " * 20_000,
    "same text",
    "same text",
]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", "own", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans string, score double")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.public_model())


# ---- op1


def test_pieces_equal_the_library(model):
    pick = random.Random(1)
    letters = "aabcdeeinrst  \n\t▁éßñжи中文😀\x00.,-0129THE<>s"
    for _ in range(1500):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 40)))
        want = model.processor.encode(text)
        assert list(np.frombuffer(model.encode(text), "<u4")) == want or not text
        assert list(pieces.Stream(model).run(model.processor.normalize(text))) == want
        if "▁" not in text:
            assert model.decode(np.array(want)) == text


def test_stream_holds_a_bounded_window(model):
    pick = random.Random(2)
    text = "▁" + "".join(pick.choice("etaoinshrdlu") for _ in range(20_000))
    stream = pieces.Stream(model)
    got = [i for at in range(0, len(text), 777) for i in stream.push(text[at : at + 777])] + list(stream.finish())
    assert got == model.processor.encode(text[1:])
    assert stream.widest < pieces.CONVERGE_EVERY * 4


def test_unigram_paths_have_the_best_score(tmp_path):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    with open(pieces.public_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    unigram = pieces.Model(str(path))
    assert unigram.kind == pieces.UNIGRAM

    def best(text):
        """The best score over all ways to cut a text into pieces."""
        if not text:
            return 0.0
        return max(
            (unigram.score_of[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in unigram.score_of),
            default=float("-inf"),
        )

    for text in ("the whole", "other", "unnumbered"):
        ids = np.frombuffer(unigram.encode(text), "<u4").tolist()
        assert sum(map(unigram.processor.get_score, ids)) == pytest.approx(best(unigram.processor.normalize(text)))
        assert unigram.decode(np.array(ids)) == text


def test_encoded_rows(spark, model):
    docs = frame(spark, ODD_TEXTS)
    rows = {r["doc_id"]: r for r in pieces.encoded(docs, pieces.public_model()).collect()}
    assert len(rows) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        assert rows[i]["token_ids"] == (model.processor.encode(text) if text else [])
        assert rows[i]["lossless"] == ("▁" not in (text or ""))
    back = pieces.decoded(pieces.encoded(docs, pieces.public_model()), pieces.public_model(), ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in back.collect()}[4] == "one"
    assert pieces.encoded(docs.limit(0), pieces.public_model()).count() == 0


# ---- op4


def test_wavelet_matrix_answers_like_a_list():
    pick = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 1), (700, 3), (3000, 60_000), (1500, 70_000)):
        ids = pick.integers(0, most, n).astype(np.uint32)
        matrix, names, sizes = token_store.load(token_store.dump(ids, [None, 5], [n, 0]))
        assert names == [None, 5] and sizes == [n, 0]
        assert matrix.everything().tolist() == ids.tolist()
        for token in {*ids[:20].tolist(), 0, most + 5}:
            where = np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == len(where)
            assert list(matrix.positions(token)) == where
        assert [matrix.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    body = bytearray(token_store.dump(np.arange(50), [1], [50]))
    body[len(body) // 2] ^= 1
    with pytest.raises(ValueError):
        token_store.load(bytes(body))


def test_token_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(token_store, "FILE_TOKENS", 500)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.public_tokenizer())
    folder = f"file://{tmp_path}/tokens"
    docs = frame(spark, ODD_TEXTS).orderBy(F.desc("doc_id"))
    files = token_store.write_files(docs, token_store.public_tokenizer(), folder)
    assert files.count() > 3
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_files(spark, folder, files).collect()}
    start = 0
    for i, text in enumerate(ODD_TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    again = token_store.write_files(docs, token_store.public_tokenizer(), folder)  # a rerun replaces its files
    assert token_store.read_files(spark, folder, again).count() == len(ODD_TEXTS)


def test_a_full_word_memory_still_encodes(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 3)
    words = token_store.Words(token_store.public_tokenizer())
    texts = ["a b c d e", "f g h i a b", "some\nlines here"]
    want = [words._ids(t) for t in texts]
    assert words.encode(texts) == want and words.encode(texts[::-1]) == want[::-1]


def test_letters_and_the_stops_behind_them_are_asked_of_the_model_once():
    words = token_store.Words(token_store.public_tokenizer())
    asked, whole = [], words.tokenizer

    class Counted:
        model = whole.model

        def encode(self, text, **how):
            return whole.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    words.tokenizer = Counted()
    texts = [f"Word{mark} {mark}a été{mark} Word" + f"\nété{mark}{mark} le{mark}" for mark in ("", ".", "***", "!?", "$$$", ")_")]
    texts += ["Word<|endoftext|> don't. it's", "é\nWord", "  Word***\n\n été&& ", "", "x2*** 12,"]
    want = [words._ids(t) for t in texts]
    assert words.encode(texts) == want and words.encode(texts[::-1]) == want[::-1]
    letters = [t for t in asked if re.fullmatch(r"\s?[^\W\d_]+[^\w\s']*", t)]
    assert not letters and len(asked) == len(set(asked)) > 0


# ---- op10


def plain_base(text):
    """Base spans by the patterns as they are written in the contract."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        double = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(double) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    pick = random.Random(4)
    parts = ["a@b.c", "x.y%@d", "@", ".", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "79927398713", "+1 (017) 555-7713", "+", "1", "23", " ", "-", "é", "a", "%", "\n", "()", "5.6.7.8.9"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_viterbi_finds_the_best_path():
    pick = np.random.default_rng(5)
    lengths = np.array([1, 4, 3])
    scores, moves, start = pick.normal(size=(3, 4, 5)), pick.normal(size=(5, 5)), pick.normal(size=5)
    for row, n, path in zip(scores, lengths, pii.viterbi(scores, lengths, moves, start)):
        value = lambda p: start[p[0]] + sum(row[t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(path[:n]) == max(itertools.product(range(5), repeat=int(n)), key=value)


@pytest.fixture(scope="module")
def trained(spark):
    return pii.trained_on_examples(spark)


def test_field_labels_rows_it_has_not_seen(trained):
    seen: dict = {}
    for seq, _, token, label in pii.example_rows(seed=99):
        seen.setdefault(seq, []).append((pii.shape(token), pii.LABELS.index(label)))
    paths = trained.decode([[s for s, _ in x] for x in seen.values()])
    assert np.mean([list(p) == [y for _, y in x] for p, x in zip(paths, seen.values())]) > 0.95


def test_annotated_and_masked(spark, trained):
    texts = [*ODD_TEXTS, "Call (017) 555-7713 now, or +1 (017) 555-7713.", "mail me@home.org, it costs 4.0 in 2021", "a@b.c" * 2000]
    docs = frame(spark, texts)
    rows = {r["doc_id"]: r for r in pii.annotated(docs, trained).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(written.split(",")) <= set(rows[i]["spans"].split(",")) or not base
    assert rows[12]["spans"] == "phone:5:19,phone:28:45"
    masked = {r["doc_id"]: r for r in pii.masked(docs, trained).collect()}
    assert masked[12]["text"] == "Call [PHONE] now, or [PHONE]."
    assert masked[13]["text"] == "mail [EMAIL], it costs 4.0 in 2021"
    assert [masked[i]["text"] for i in range(12)] == ODD_TEXTS
    assert pii.masked(docs, trained).columns == docs.columns
    assert pii.annotated(docs.limit(0), trained).count() == 0


# ---- op6


def labelled(spark, n=240):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("aeionrst") for _ in range(pick.randint(2, 8)))
    rows = []
    for i in range(n):
        good = i % 4 > 0
        text = ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) if good else " | ".join([word()] * 50)
        rows.append((i, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_ranking_learns_without_the_held_out_third(spark):
    table = labelled(spark)
    model = quality.learn(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    flipped = table.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.learn(table.select("doc_id", "text"), flipped.select("doc_id", "quality"))
    assert np.array_equal(model.weights, other.weights) and model.threshold == other.threshold
    out = quality.scored(table, model).collect()
    assert all((r["score"] >= 0.5) == r["quality"] for r in out) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in table.where(quality.held_out(F.col("doc_id"))).collect()} == {
        i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1
    }


def test_quality_of_odd_rows(spark):
    table = labelled(spark)
    model = quality.learn(table, table.select("doc_id", "quality"))
    docs = frame(spark, ODD_TEXTS)
    rows = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert len(rows) == 12 and rows[0] == rows[1] and rows[10] == rows[11]
    kept = quality.good_documents(docs, table.select("doc_id", "quality"))
    assert kept.columns == docs.columns
    nothing = table.select("doc_id", "quality").limit(0)
    assert {r["score"] for r in quality.scored(docs, quality.learn(docs, nothing)).collect()} == {0.5}
    one = table.where("quality = 1").select("doc_id", "quality")
    assert quality.learn(table, one).constant == 1.0
    nulls = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert quality.learn(table, nulls).constant == 0.5


# ---- op2


def plain_leaks(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        size = min(n, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found)), len(found)


def test_leaks_equal_brute_force(spark, monkeypatch):
    pick = random.Random(7)
    word = lambda: pick.choice("ab cd éÉ 9x Zz".split())
    items = [(i, " ".join(word() for _ in range(pick.choice([1, 3, 3, 10, 12, 14])))) for i in range(8)]
    items += [(8, None), (9, ""), (10, "--"), (items[0][0], items[0][1]), (100, "same text")]
    texts = [*ODD_TEXTS, *(" ".join(word() for _ in range(40)) for _ in range(20)), *(f"x {t.upper()}, y" for _, t in items[:8])]
    docs = frame(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: plain_leaks(t, items) for i, t in enumerate(texts)}
    for limit in (decontaminate.BROADCAST_BYTES, 300):  # in one slice and in several
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        rows = decontaminate.digest(decontaminate.find_leaks(docs, benchmark)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, ids, count = want[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, count, hit > 0)
            assert r["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    kept = decontaminate.drop_documents(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    assert decontaminate.drop_documents(docs, benchmark.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string")).collect()}
    assert cut[4] == "one" and cut[0] is None


def test_spans_are_cut_in_place(spark):
    docs = spark.createDataFrame([(1, "Keep this. The QUICK brown fox; and that!")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "the quick brown FOX")], "item_id long, text string")
    assert decontaminate.cut_spans(docs, benchmark).first()["text"] == "Keep this; and that!"


def test_helper_replaces_clashing_columns(spark):
    from pyspark.sql import types as T

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    made = with_columns(docs, ["text"], [T.StructField("doc_id", T.LongType())], lambda: lambda c: [[9] * len(c)])
    assert made.collect()[0].asDict() == {"text": "a", "doc_id": 9}
