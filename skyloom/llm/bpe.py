"""Byte-level BPE by speculation: propose the longest tokens, check neighbours, merge only what fails.

A text is cut into words by the vocabulary's own pattern. Greedy longest match proposes tokens for each
new word. Merging leaves a row of tokens alone exactly when it leaves every two neighbours alone, so all
distinct neighbours of a batch are checked at once with numpy. A word with a pair that would have merged
across its border, or with a token that merging never builds, is merged exactly.

A pair is checked backwards in time. The token left of the border grew by merges on its right edge, the
token right of it by merges on its left edge; undoing the latest merge of both, one at a time, gives every
two parts that ever met at the border. Had a merge of such two parts come before either part grew on, it
would have crossed the border. Equal merges are made from left to right.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, process_store, table, texts_of, with_columns

by_value(__name__)

REMEMBERED = 250_000  # words kept per Python process
PIECE = 1 << 20  # letters of texts that are cut into words at once
SHORT = 32  # words of at most so many bytes are merged together in one matrix
BETWEEN = "Ā"  # parts words in the text given to the matcher; no byte has this letter
NEVER = np.int64(1) << 40
# Fixed rules of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and up ...
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in PRINTABLE} | {
    chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)
}
# ... and this pattern cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# One letter for each class of the pattern, and a letter that tells whether another one is of its class.
CLASSES = {"letter": "a", "number": "1", "other": ",", "space": " "}


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON format of the ``tokenizers`` library.

    ``encode`` equals the library's ``encode(text, add_special_tokens=False)`` and ``decode`` its
    ``decode(ids, skip_special_tokens=False)``. Truncation and padding of the file are not used. A file with
    another model, a normalizer or another pattern is an error.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"))
        if model["type"] != "BPE" or not plain or parts["normalizer"] or parts["post_processor"]:
            raise ValueError("only plain BPE models are supported")
        if cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only the byte-level pattern without a leading space is supported")
        special = parts["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        vocab = model["vocab"]
        self.bytes_of = bytes_of_ids(vocab, special)
        size = len(self.bytes_of)
        self.special = {t["content"]: t["id"] for t in special}
        self.id_of_byte = np.zeros(256, dtype=np.int64)
        for i in vocab.values():
            if len(self.bytes_of[i]) == 1:
                self.id_of_byte[self.bytes_of[i][0]] = i

        # merges: (left, right) -> token, in the order of their making
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.born = np.full(size, -1, dtype=np.int64)
        self.born[made] = np.arange(len(made))
        ordered = (self.born[left] < np.arange(len(made))) & (self.born[right] < np.arange(len(made)))
        if len(np.unique(made)) != len(made) or not ordered.all():
            raise ValueError("every token must have one merge, later than those of its parts")
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.left[made], self.right[made] = left, right
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = made
        self.rank_of = {(int(a), int(b)): n for n, (a, b) in enumerate(zip(left, right))}

        self.matcher = ahocorasick.Automaton()
        for i in vocab.values():
            if i not in self.special.values():
                self.matcher.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.matcher.make_automaton()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

        self.cut = regex.compile(WORDS)
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classed: set[str] = set(map(chr, range(128)))
        self.stand_ins: dict[int, str] = {}  # letters that the library classes otherwise than the pattern's engine
        self.known: dict[str, bytes] = {}
        self.merged = 0  # words that had to be merged exactly
        self.whole = np.ones(size, dtype=bool)
        tokens = sorted(vocab.values())
        for i, ids in zip(tokens, self._merge([self.bytes_of[i] for i in tokens])):
            self.whole[i] = len(ids) == 1  # a token that merging never builds is not whole

    # ---- merges

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` without one."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a pair gives these two tokens again, for all pairs at once."""
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends, y_ends = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            rank = self._rank(x, y)
            crossed = (rank < x_ends) & (rank <= y_ends) & (rank < NEVER)
            good[at[crossed]] = False
            bx, by = self.born[x], self.born[y]
            undo_y = by >= bx
            going = ~crossed & (np.maximum(bx, by) >= 0)
            x_ends = np.where(undo_y, x_ends, bx)
            y_ends = np.where(undo_y, by, y_ends)
            x = np.where(undo_y, x, self.right[x])
            y = np.where(undo_y, self.left[y], y)
            at, x, y, x_ends, y_ends = at[going], x[going], y[going], x_ends[going], y_ends[going]
        return good

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of words by exact merging: short words in matrices, long ones with a heap."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        groups: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            if len(w) > SHORT:
                out[n] = self._merge_long(w)
            elif w:
                groups.setdefault(8 * -(-len(w) // 8), []).append(n)
        for width, members in groups.items():
            flat = np.frombuffer(b"".join(words[n].ljust(width, b"\0") for n in members), dtype=np.uint8)
            ids = self.id_of_byte[flat].reshape(-1, width)
            sizes = np.array([len(words[n]) for n in members])
            ids[np.arange(width) >= sizes[:, None]] = -1
            self._merge_matrix(ids)
            for n, row in zip(members, ids):
                out[n] = row[row >= 0]
        return out

    def _merge_matrix(self, ids: np.ndarray) -> None:
        """Merge every row (padded by -1) in place: in each turn the first pair of the least rank."""
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        at = np.arange(len(ids))
        now = ids
        while len(at):
            where = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), where]
            more = least < NEVER
            ids[at[~more]] = now[~more]
            at, now, ranks, where, least = at[more], now[more], ranks[more], where[more], least[more]
            rows = np.arange(len(at))
            now[rows, where] = self.made[least]
            moved = np.minimum(columns + (columns > where[:, None]), ids.shape[1] - 1)
            now = np.take_along_axis(now, moved, axis=1)
            now[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NEVER
            last = ranks.shape[1] - 1
            inner = where <= last
            ranks[rows[inner], where[inner]] = self._rank(now[rows, where], now[rows, where + 1])[inner]
            before = where > 0
            b = where[before]
            ranks[rows[before], b - 1] = self._rank(now[rows[before], b - 1], now[rows[before], b])

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.id_of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, made = self.rank_of, self.made
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank_of.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h))
        whole = np.array(ids, dtype=np.int64)
        return whole[whole >= 0]

    # ---- words

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest tokens of all words in a row, and how many tokens each word has."""
        texts = [w.encode().decode("latin-1") for w in words]
        found = list(self.matcher.iter_long(BETWEEN.join(texts)))
        ends = np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found))
        tokens = np.fromiter((t for _, t in found), dtype=np.int64, count=len(found))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        word = np.searchsorted(starts, ends, side="right") - 1
        return tokens, np.bincount(word, minlength=len(words))

    def solve(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that are not empty: propose, check all neighbours, merge what fails."""
        tokens, counts = self.propose(words)
        word = np.repeat(np.arange(len(words)), counts)
        failed = np.zeros(len(words), dtype=bool)
        failed[word[~self.whole[tokens]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[inside] << 20 | tokens[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & (1 << 20) - 1)
        failed[word[inside[~good[which]]]] = True
        packed = tokens.astype("<u4").tobytes()
        edges = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        out = [packed[a:b] for a, b in zip(edges, edges[1:])]
        again = np.flatnonzero(failed).tolist()
        self.merged += len(again)
        for n, ids in zip(again, self._merge([words[n].encode() for n in again])):
            out[n] = ids.astype("<u4").tobytes()
        return out

    def _classify(self, text: str) -> None:
        """Learn from the library which class new letters are of; engines differ in their Unicode version."""
        for c in set(text).difference(self.classed):
            if self.cut.fullmatch("a" + c):
                mine = "letter"
            else:
                mine = next((k for k in ("number", "other") if self.cut.fullmatch(CLASSES[k] + c)), "space")
            theirs = next((k for k in ("letter", "number", "other") if len(self.library_cut(CLASSES[k] + c)) == 1), "space")
            if mine != theirs:
                self.stand_ins[ord(c)] = {"letter": "é", "number": "²", "other": "«", "space": "\x85"}[theirs]
            self.classed.add(c)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            self._classify(text)
            if self.stand_ins and (same := text.translate(self.stand_ins)) != text:
                return [text[m.start() : m.end()] for m in self.cut.finditer(same)]
        return self.cut.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= PIECE:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []
        for t in texts:
            here: list = []
            at = 0
            if self.special and any(s in t for s in self.special):
                for m in self.special_cut.finditer(t):
                    here += [*self.words(t[at : m.start()]), self.special[m.group()]]
                    at = m.end()
            parts.append(here + self.words(t[at:]) if at else self.words(t))
        distinct = set().union(*parts)
        known = self.known
        found = {w: known[w] for w in distinct if w in known}
        new = [w for w in distinct if w not in found and isinstance(w, str)]
        solved = dict(zip(new, self.solve(new))) if new else {}
        if len(known) + len(new) <= REMEMBERED:
            known.update(solved)
        found.update(solved)
        for i in self.special.values():
            found[i] = i.to_bytes(4, "little")
        return [b"".join(map(found.__getitem__, p)) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.bytes_of, ids)


def bytes_of_ids(vocab: dict[str, int], special: list[dict]) -> list[bytes]:
    """The bytes of every id, empty for ids that are not in use."""
    out = [b""] * (max([*vocab.values(), *(t["id"] for t in special)]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(LETTERS[c] for c in token)
    for t in special:
        out[t["id"]] = t["content"].encode()
    return out


def decode(bytes_of: list[bytes], ids: np.ndarray) -> str:
    """The text of ids; unknown ids give nothing, broken UTF-8 the replacement character."""
    known = ids[ids < len(bytes_of)].tolist()
    return b"".join(map(bytes_of.__getitem__, known)).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    held = process_store("bpe_vocabularies", dict)
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def byte_table(path: str) -> list[bytes]:
    """What decoding needs of a vocabulary."""
    held = process_store("bpe_byte_tables", dict)
    if path not in held:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        held[path] = bytes_of_ids(parts["model"]["vocab"], parts["added_tokens"])
    return held[path]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids``: the packed ids (little-endian, 32 bits) of the whole text.

    Null text counts as empty and has no ids; a text of any length is one value. Rows are independent:
    repeated rows give equal ids, an empty table stays empty. A column named like ``ids`` is replaced.
    """

    def make():
        encode = vocabulary(path).encode
        return lambda column: [pa.array(encode(texts_of(column)), pa.binary())]

    return with_columns(docs, [text], [T.StructField(ids, T.BinaryType())], make)


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``text``, decoded from packed ids; null ids give an empty text.

    A column named like ``text`` is replaced. Ids outside the vocabulary give nothing.
    """

    def make():
        table = byte_table(path)
        return lambda column: [[decode(table, np.frombuffer(x or b"", dtype="<u4")) for x in column.to_pylist()]]

    return with_columns(docs, [ids], [T.StructField(text, T.StringType())], make)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: number and digest of its ids, and the digest of what they decode to."""
    path = path or public_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encoded(docs, path).select("doc_id", "ids")
    return decoded(ids, path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
