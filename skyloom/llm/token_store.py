"""Token ids in wavelet-matrix files.

A file holds the ids of a run of documents as bit-planes: plane by plane from the highest bit, ids
are parted stably into those with a 0 and those with a 1. With the number of ones before each block
of 512 bits, one file answers which id stands where, how often an id occurs, and where, without
being unpacked as a whole. Planes and index are compressed; a CRC closes the file.

Documents are laid out in ascending order: boundaries taken from all ids deal the documents to
buckets, a task sorts its bucket and writes files of about ``FILE_TOKENS`` ids. Names depend on the
data only and files appear by renaming, so a task that runs again replaces its own files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from skyloom.llm.common import bounded_batches, by_value, process_store, stored, table, texts_of, with_columns
from skyloom.session import workspace

by_value(__name__)

MAGIC = b"WAVM0001"
FILE_TOKENS = 1 << 21
ROWS_PER_BUCKET = 8192
MAX_BUCKETS = 100_000
BLOCK = 512  # bits between two entries of a rank directory
REMEMBERED = 700_000  # words kept per Python process
ENDS = 10_000  # runs of stops kept
END_ID = 0
ID = attrgetter("id")
# Texts with single spaces and line ends between words are cut by these, others before each run of white space.
PAIRS = ("  ", " \n", "\n ", "\n\n")
RARE_ASCII = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
RARE = RARE_ASCII + tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())
CHUNK = re.compile(r"\s*\S+|\s+")
STOPS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")  # part of no contraction
# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and up.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def is_even(text: str) -> bool:
    """Whether all white space is single spaces and line ends between words."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(p in text for p in PAIRS) and not any(c in text for c in (RARE_ASCII if text.isascii() else RARE))


class Words:
    """Encodes texts with the ``tokenizers`` library, each distinct word once.

    The tokenizer's pattern never joins white space with what stands before it, nor a letter with a
    stop, so the ids of a text are those of its words, each with the white space before it, and those
    of letters with stops behind them are those of the letters and of the stops.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}  # of even texts: behind a space, or with the line end before them
        self.chunks: dict[str, bytes] = {}  # of other texts, with the white space before them
        self.stops: dict[str, bytes] = {"": b""}
        self.line_end = self._ids("\n")
        # A run of letters is one unit of a byte-level tokenizer, so its model can be asked directly; stops behind it
        # are units of their own. No added token may be found in letters and stops behind them.
        self.direct = all(self._unit(w) == self._ids(w) for w in ("word", " word", " Übermäßig", " 中文", " été"))
        self.direct &= self._ids("\nword") == self.line_end + self._ids("word")
        self.direct &= all(self._ids("word" + c) == self._ids("word") + self._ids(c) for c in STOPS)
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.direct &= all(re.search(r"[!-/:-@\[-`{-~].*[^\W_]", t) for t in added)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, text: str) -> bytes:
        symbols = text.encode().decode("latin-1").translate(BYTE_LEVEL)
        return np.array([t.id for t in self.tokenizer.model.tokenize(symbols)], dtype="<u4").tobytes()

    def lookup(self, words: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of distinct words. A full memory keeps its words, which are the frequent ones."""
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [words[i] for i in missing]
            solved = self.solve(new, known)
            for i, ids in zip(missing, solved):
                found[i] = ids
            if len(known) + len(new) <= REMEMBERED:
                known.update(zip(new, solved))
        return found

    def solve(self, words: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of new words: letters are asked of the model, stops behind them are remembered, all else is encoded whole."""
        out: list[bytes] = [b""] * len(words)
        begun: dict[str, bytes] = {}
        others: list[int] = []
        model, stops, even = self.tokenizer.model.tokenize, self.stops, known is self.words
        for i, w in enumerate(words):
            begin = w.rstrip(STOPS)
            lined = w[0] == "\n"
            spaced = not lined if even else w[0] == " "
            letters = begin[1:] if lined or spaced and not even else begin
            end = w[len(begin) :]
            if not (self.direct and letters.isalpha()) or (end not in stops and len(stops) > ENDS):
                others.append(i)
                continue
            ids = known.get(begin) or begun.get(begin)
            if ids is None:
                symbols = letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_LEVEL)
                ids = array("I", map(ID, model("Ġ" + symbols if spaced else symbols))).tobytes()
                begun[begin] = ids = self.line_end + ids if lined else ids
            if end:
                if end not in stops:
                    stops[end] = self._ids(end)
                ids += stops[end]
            out[i] = ids
        encode = self.tokenizer.encode_batch_fast
        for part in iter(lambda it=iter(others): list(islice(it, 4096)), []):
            units = [words[i] for i in part]
            if even:
                units = [u[1:] if u[0] == "\n" else " " + u for u in units]
            for i, e in zip(part, encode(units, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4").tobytes()
                out[i] = self.line_end + ids if even and words[i][0] == "\n" else ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        even = [is_even(t) for t in texts]
        plain = iter(self._encode_even([t for t, e in zip(texts, even) if e]))
        chunks = [None if e else CHUNK.findall(t) for t, e in zip(texts, even)]
        distinct = list(set().union(*filter(None, chunks)))
        ids = dict(zip(distinct, self.lookup(distinct, self.chunks)))
        return [next(plain) if c is None else b"".join(map(ids.__getitem__, c)) for c in chunks]

    def _encode_even(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the words, numbers the distinct ones and lays their ids in a row: Python sees distinct words only."""
        if not texts:
            return []
        marked = pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string())
        words = pc.split_pattern(marked, " ")
        numbered = words.flatten().dictionary_encode()
        ids = self.lookup(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self.words)
        _, places, packed = pa.array(ids, pa.large_binary()).take(numbered.indices).buffers()
        edges = np.frombuffer(places, dtype=np.int64)[words.offsets.to_numpy()].tolist()
        packed, skipped = memoryview(packed), len(self.line_end)
        return [bytes(packed[a + skipped : b]) for a, b in zip(edges, edges[1:])]


def word_encoder(path: str) -> Words:
    encoders = process_store("word_encoders", dict)
    if path not in encoders:
        encoders[path] = Words(path)
    return encoders[path]


class WaveletMatrix:
    """Bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = ranks if ranks is not None else [directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            planes.append(np.packbits(bits))
            low = now[~bits]
            zeros.append(len(low))
            now = np.concatenate([low, now[bits]])
        return cls(len(ids), planes, zeros)

    def everything(self) -> np.ndarray:
        """All ids in order, by undoing the partings from the lowest plane up."""
        ids = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bits = np.unpackbits(plane, count=self.n).astype(bool)
            back = np.empty_like(ids)
            back[~bits] = ids[:zeros]
            back[bits] = ids[zeros:] | ids.dtype.type(1 << level)
            ids = back
        return ids

    def rank1(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        block = at // BLOCK
        whole = self.planes[level][block * BLOCK // 8 : at // 8 + 1]
        return int(self.ranks[level][block]) + int(np.unpackbits(whole)[: at - block * BLOCK].sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) given bit of a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * BLOCK
        bits = np.unpackbits(self.planes[level][start // 8 : (start + BLOCK) // 8])[: self.n - start]
        return start + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self.planes[level][at // 8] >> (7 - at % 8) & 1
            value = value << 1 | int(bit)
            ones = self.rank1(level, at)
            at = zeros + ones if bit else at - ones
        return value

    def _range(self, token: int) -> tuple[int, int]:
        """Where the copies of ``token`` stand behind the last plane."""
        low, high = 0, self.n
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank1(level, low), self.rank1(level, high)
            bit = token >> (len(self.planes) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if bit else (low - a, high - b)
        return low, high

    def count(self, token: int) -> int:
        low, high = self._range(token)
        return high - low

    def positions(self, token: int) -> Iterator[int]:
        """Where ``token`` occurs, ascending."""
        low, high = self._range(token)
        for at in range(low, high):
            for level in range(len(self.planes) - 1, -1, -1):
                zeros = self.zeros[level]
                at = self.select(level, 1, at - zeros) if at >= zeros else self.select(level, 0, at)
            yield at


def directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and at the end."""
    padded = np.pad(plane, (0, -len(plane) % (BLOCK // 8)))
    ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


def dump(ids: np.ndarray, doc_ids: list, sizes: list[int]) -> bytes:
    """One file: magic, length and JSON head, compressed parts, CRC of all before."""
    import zstandard

    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    index = json.dumps([doc_ids, sizes]).encode()
    parts = [pack(index), *(pack(p.tobytes()) for p in matrix.planes), *(pack(r.tobytes()) for r in matrix.ranks)]
    head = json.dumps({"n": matrix.n, "zeros": matrix.zeros, "sizes": [len(p) for p in parts]}).encode()
    body = MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def load(content: bytes) -> tuple[WaveletMatrix, list, list[int]]:
    """The matrix, document ids and sizes of a file; a damaged file is an error."""
    import zstandard

    if content[:8] != MAGIC or zlib.crc32(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a whole token file")
    (n,) = struct.unpack_from("<I", content, 8)
    head = json.loads(content[12 : 12 + n])
    unpack, at, parts = zstandard.ZstdDecompressor().decompress, 12 + n, []
    for size in head["sizes"]:
        parts.append(unpack(content[at : at + size]))
        at += size
    levels = len(head["zeros"])
    planes = [np.frombuffer(p, dtype=np.uint8) for p in parts[1 : 1 + levels]]
    ranks = [np.frombuffer(p, dtype="<u4") for p in parts[1 + levels :]]
    doc_ids, sizes = json.loads(parts[0])
    return WaveletMatrix(head["n"], planes, head["zeros"], ranks), doc_ids, sizes


def with_ids(docs: DataFrame, tokenizer_path: str, edges: list[int]) -> DataFrame:
    """``doc_id, bucket, ids``: packed ids with the end id, and the bucket between the edges."""
    fields = [T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    bounds = np.array(edges, dtype=np.int64)

    def make():
        encoder = word_encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()

        def compute(doc_id, text):
            ids = encoder.encode(texts_of(text))
            places = [0 if d is None else int(np.searchsorted(bounds, d, side="right")) for d in doc_id.to_pylist()]
            return [pa.array(places, pa.int32()), [narrowed(np.frombuffer(x + end, dtype="<u4")) for x in ids]]

        return compute

    return with_columns(docs.select("doc_id", "text"), ["doc_id", "text"], fields, make, keep=["doc_id"])


def narrowed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit; a last byte tells."""
    return ids.astype("<u2").tobytes() + b"\x01" if ids.max() < 65536 else ids.tobytes() + b"\x00"


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(memoryview(ids)[:-1], dtype="<u2" if ids[-1] else "<u4")


def write_files(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order (null first, equal ids by their tokens).

    Returns the list of files: ``bucket, part, n_tokens``. Null text is empty; other columns are not
    looked at; an empty table writes no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = ids.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    edges = ids.select(
        F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 10 * buckets).alias("e")
    ).first()["e"]
    edges = sorted(set(edges or [])) if buckets > 1 else []
    dealt = with_ids(ids, tokenizer_path, edges).repartitionById(len(edges) + 1, F.col("bucket"))
    schema = "bucket int, part int, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[np.ndarray] = []
        names: list = []
        state = {"bucket": None, "part": 0, "tokens": 0}

        def flush():
            whole = np.concatenate(held)
            path = f"{root}/tokens-{state['bucket']:06d}-{state['part']:06d}.wavm"
            hidden = f"{root}/.tmp-{state['bucket']}-{state['part']}-{zlib.crc32(whole.tobytes())}-{id(held)}"
            with store.open_output_stream(hidden) as out:
                out.write(dump(whole, names, [len(x) for x in held]))
            store.move(hidden, path)
            row = pa.RecordBatch.from_pylist(
                [{"bucket": state["bucket"], "part": state["part"], "n_tokens": len(whole)}],
                pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64())]),
            )
            held.clear()
            names.clear()
            state.update(part=state["part"] + 1, tokens=0)
            return row

        for batch in batches:
            for doc, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "ids"))):
                if held and (bucket != state["bucket"] or state["tokens"] >= FILE_TOKENS):
                    yield flush()
                if bucket != state["bucket"]:
                    state.update(bucket=bucket, part=0)
                held.append(unpacked(packed))
                names.append(doc)
                state["tokens"] += len(held[-1])
        if held:
            yield flush()

    return stored(
        dealt.sortWithinPartitions("bucket", "doc_id", "ids").mapInArrow(write, schema), "token-files"
    )


def read_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``files`` is the list that ``write_files`` returned; it is short (a row per file) and gives each
    file the ids of all files before it. A missing file makes a start null.
    """
    bounded_batches(spark)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.wavm").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                matrix, doc_ids, sizes = load(body.as_buffer().to_pybytes())
                ids = matrix.everything()
                ends = np.cumsum([0, *sizes])
                bucket, part = path.rsplit("/", 1)[1][:-5].split("-")[1:]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket)] * k, pa.int32()),
                        pa.array([int(part)] * k, pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(ends[:-1]),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])], pa.int64()),
                    ],
                    names=["bucket", "part", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = content.mapInArrow(read, "bucket int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select(
        "bucket", "part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before")
    )
    return rows.join(before, ["bucket", "part"], "left").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_store(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    folder = workspace(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    files = write_files(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizer(), folder)
    return read_files(spark, folder, files)
