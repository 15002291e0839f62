"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The text is normalised by the model's own normaliser. Over its characters runs a lattice whose
states are the pieces that may end at a position:

* unigram models: a path scores the sum of its piece scores, the best path wins;
* BPE models: a path is allowed if all its neighbouring pieces are stable, that is if merging the
  two pieces' characters by the model's ranks gives these two pieces again. Merges never crossed
  the boundaries of the true result, so exactly one path survives to each position, and it is the
  one that merging by rank gives.

Each position keeps one backpointer. ``Stream`` holds the characters since the last committed
boundary only: as soon as the surviving paths (those that end less than the longest piece ago) meet
in one boundary, the ids before it are emitted and forgotten. Where no piece of the model has a
space mark behind another character, all paths meet before each run of space marks; such words are
looked up in a bounded memory of earlier results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from skyloom.llm.common import by_value, process_store, table, texts_of, with_columns

by_value(__name__)

MARK = "▁"
REMEMBERED = 200_000  # words and piece pairs kept per Python process
LONG_WORD = 64  # characters; longer ones go through the stream and are not remembered
CONVERGE_EVERY = 64  # positions between two looks for a common boundary
UNIGRAM, BPE = 1, 2  # fixed numbers of the model format
UNKNOWN_PENALTY = 10.0  # fixed: an unknown character scores this much less than the worst piece


class Model:
    """The vocabulary of a model file and what the lattice needs of it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            proto = f.read()
        self.processor = SentencePieceProcessor(model_proto=proto)
        p = self.processor
        self.kind = model_type(proto)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice of pieces")
        size = p.vocab_size()
        self.names = [p.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)}
        self.id_of = {s: i for i, s in enumerate(self.names) if i not in special}
        self.score_of = {s: p.get_score(i) for s, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.unknown = p.unk_id()
        self.unknown_score = min(self.score_of.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = {int(self.names[i][3:-1], 16): i for i in range(size) if p.is_byte(i)}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", s) for s in self.id_of)
        # by piece: which pieces are known to stand stably behind it
        self.stable: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        # every beginning of a piece, with its packed id where it is one
        self.begins: dict[str, bytes] = {s[:n]: b"" for s in self.id_of for n in range(1, len(s))}
        self.begins |= {s: packed([i]) for s, i in self.id_of.items()}
        self.words: dict[str, bytes] = {}
        self.decoded = [self._bytes(i, s, special) for i, s in enumerate(self.names)]
        self.dummy_prefix = p.normalize("x") == MARK + "x"

    def _bytes(self, i: int, name: str, special: set[int]) -> bytes:
        if self.processor.is_byte(i):
            return bytes([int(name[3:-1], 16)])
        if i == self.unknown:
            return " ⁇ ".encode()  # the library's mark for an unknown piece
        return b"" if i in special else name.replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Pieces by merging, best score first, leftmost of equals; for the short texts of ``is_stable``."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                score = self.score_of.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def is_stable(self, left: str, right: str) -> bool:
        row = self.stable.get(left)
        if row is None:
            row = self.stable[left] = {}
        known = row.get(right)
        if known is None:
            known = row[right] = self.merged(left + right) == [x for x in (left, right) if x]
            self.pairs += 1
            if self.pairs >= REMEMBERED:
                self.stable, self.pairs = {}, 0
        return known

    def word(self, text: str) -> bytes:
        """The packed ids of a word: the lattice of ``Stream`` over a whole word, from start to end."""
        if self.kind != BPE:
            return packed(Stream(self).run(text))
        n, begins, last = len(text), self.begins, [""] + [None] * len(text)
        for start in range(n):
            left, row = last[start], self.stable.get(last[start], {})
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                known = begins.get(piece)
                if known is None and end > start + 1:
                    break
                if last[end] is None and (known or end == start + 1):
                    ok = row.get(piece)
                    if self.is_stable(left, piece) if ok is None else ok:
                        last[end] = piece
        path, at = [], n
        while at > 0:
            piece = last[at]
            path.append(begins.get(piece) or packed(self.ids(piece)))
            at -= len(piece)
        path.reverse()
        return b"".join(path)

    def ids(self, piece: str) -> list[int]:
        """The id of a piece; of an unknown character the byte pieces if the model has them."""
        i = self.id_of.get(piece)
        if i is not None:
            return [i]
        if self.bytes_of:
            return [self.bytes_of[b] for b in piece.encode()]
        return [self.unknown]

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        text = self.processor.normalize(text)
        if not self.splits:
            return packed(Stream(self).run(text))
        words, out = self.words, []
        for word in text.replace(MARK, " " + MARK).split(" ") if MARK * 2 not in text else marked_words(text):
            got = words.get(word)
            if got is None:
                got = self.word(word) if len(word) <= LONG_WORD else packed(Stream(self).run(word))
                if len(words) < REMEMBERED and len(word) <= LONG_WORD:
                    words[word] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark that normalisation puts before a text is taken off again."""
        text = b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def model_type(proto: bytes) -> int:
    """The model type named in the trainer settings of a model file (unigram if it names none)."""
    for field, value in fields(proto):
        if field == 2:  # trainer settings
            return next((v for f, v in fields(value) if f == 3), UNIGRAM)
    return UNIGRAM


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Top-level fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = varint() if size is None else size
        at += size
        yield tag >> 3, message[at - size : at]


def marked_words(text: str) -> list[str]:
    """A text cut before each run of space marks."""
    return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)


def packed(ids) -> bytes:
    return np.fromiter(ids, dtype="<u4").tobytes()


class Stream:
    """Viterbi over pushed characters with a window that ends at the last common boundary."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # since the last committed boundary
        self.before = ""  # the last committed piece
        self.last = [""]  # BPE: the piece that ends at each position
        self.best = [0.0]  # unigram: the score there
        self.widest = 0  # the most characters held at once

    def run(self, text: str) -> Iterator[int]:
        yield from self.push(text)
        yield from self.finish()

    def push(self, more: str) -> Iterator[int]:
        for at in range(0, len(more), CONVERGE_EVERY):
            self.text += more[at : at + CONVERGE_EVERY]
            self._extend()
            self.widest = max(self.widest, len(self.text))
            if len(more) - at > CONVERGE_EVERY:
                yield from self._commit(self._common())

    def finish(self) -> Iterator[int]:
        yield from self._commit(len(self.text))

    def _extend(self) -> None:
        m, text, last = self.model, self.text, self.last
        ids, longest, bpe = m.id_of, m.longest, m.kind == BPE
        for end in range(len(last), len(text) + 1):
            if bpe:
                for start in range(max(0, end - longest), end):
                    piece = text[start:end]
                    if piece in ids or end - start == 1:
                        left = last[start] if start else self.before
                        if m.is_stable(left, piece):
                            last.append(piece)
                            break
            else:
                best, chosen = float("-inf"), ""
                for start in range(max(0, end - longest), end):
                    piece = text[start:end]
                    score = m.score_of.get(piece)
                    if score is None:
                        if end - start > 1:
                            continue
                        score = m.unknown_score
                    score += self.best[start]
                    if score > best:
                        best, chosen = score, piece
                last.append(chosen)
                self.best.append(best)

    def _common(self) -> int:
        """The boundary in which the paths of all positions of the window meet."""
        alive = set(range(max(0, len(self.text) - self.model.longest + 1), len(self.text) + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(self.last[top]))
        return alive.pop()

    def _commit(self, end: int) -> Iterator[int]:
        path, at = [], end
        while at > 0:
            path.append(self.last[at])
            at -= len(self.last[at])
        for piece in reversed(path):
            yield from self.model.ids(piece)
        if path:
            self.before = path[0]
            self.text, self.last, self.best = self.text[end:], self.last[end:], self.best[end:]


def loaded(path: str) -> Model:
    """The model, once per Python process."""
    models = process_store("piece_models", dict)
    if path not in models:
        models[path] = Model(path)
    return models[path]


def encoded(docs: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``token_ids`` (array<int>), ``n_tokens``, ``ids_crc32`` and ``lossless`` to every row.

    ``lossless`` tells whether decoding the ids gives the text back; a space mark inside a text comes
    back as a space and makes it false. Null and empty texts have no ids; columns of these names are
    replaced. The model file must exist under ``model_path`` on the executors.
    """
    new = [
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("lossless", T.BooleanType()),
    ]

    def make():
        model = loaded(model_path)

        def compute(column):
            texts = texts_of(column)
            ids = [np.frombuffer(model.encode(t) if t else b"", dtype="<u4") for t in texts]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, dtype="<u4")]).astype(np.int32)
            return [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                sizes,
                [zlib.crc32(x.tobytes()) for x in ids],
                [model.decode(x) == t for x, t in zip(ids, texts)],
            ]

        return compute

    return with_columns(docs, ["text"], new, make, keep)


def decoded(rows: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` decoded from ``token_ids`` to every row; null ids give an empty text."""

    def make():
        model = loaded(model_path)
        return lambda column: [[model.decode(np.array(x or [], dtype=np.int64)) for x in column.to_pylist()]]

    return with_columns(rows, ["token_ids"], [T.StructField("text", T.StringType())], make, keep)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_path or public_model(), keep=["doc_id"])
