"""Exact similarity join of documents in the metric space of Jaccard distance over word shingles.

Two documents link at a similarity of at least ``LEAST_PERCENT``; the distance 1 - similarity is a
metric, and links reach at most a quarter (``REACH``). Equal sets are one node.

1. How many sets have a shingle is counted exactly. Shingles are packed by buckets of their hash, a few bytes
   each, and only those of several sets come back to the lots of documents that they came from.
2. Pivots of the first level are single shingles in one global order, rare ones before frequent ones.
   A document's nearest pivot is its first shingle: the Voronoi regions. A partner shares at least
   three quarters of the larger set, so it meets the document in one of its first
   ``n - ceil(3n/4) + 1`` pivots: to these windows the document is replicated. Pivots of one document
   need no region, and a document without other pivots has no partner.
3. What two documents share behind the window that ends first is at most the rest of that set, so a
   link must meet in a known number of pivots (``least_met``). Where a pivot's place leaves fewer, or a set too
   few pivots, the pair is out. Regions of rare pivots name their pairs; in regions of frequent pivots, blocks of documents are
   counted against each other by their pivots, and only pairs that meet often enough come out.
4. Each document is compared with the partner it met most often, which gives its exact distance to that
   pivot document. Links give components, and the join recurs on pairs of different components; where both know their
   distance to one pivot document, it must differ by a quarter at most (triangle inequality). In the
   first turns a document tries a few partners; in the last turn all pairs still open are compared.

Shingles are 64-bit hashes and comparisons count all of them. Pivots are told apart by 40 bits and their bucket; more
pivots taken for one only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh3_64_intdigest

from skyloom.llm.common import bounded_batches, by_value, give_back, stored, table, texts_of
from skyloom.llm.components import components

by_value(__name__)

WORDS = 5
LEAST_PERCENT = 75
REACH = 0.25
SMALL_REGION = 16
BLOCK_ROWS = 1024
CHUNK_ROWS = 65_536  # rows of small regions held at once
TURNS = 2  # before all pairs that are still open are compared
PIVOT_MEMBERS = 2048  # members compared with one pivot in one task
NEED_WORDS = 1 << 20  # 64-bit words of the filter of needed documents
ASKED = 8  # partners that a document tries in a turn
TEXT_BYTES = 2 << 20  # of an Arrow batch: its words are in memory one by one
LOT_SHINGLES, LOT_DOCS = 1 << 19, 60_000  # documents of one task that travel together
BUCKET_SHINGLES = 3 << 19
TOKEN = (1 << 40) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes, end to end, and where each text's begin.

    A-Z are lowered; words stand between ASCII white space; a text of fewer words is one shingle.
    """
    tokens = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.array([len(t) for t in tokens], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    w = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(tokens)), np.uint64, begin[-1])
    n = len(w)
    h = np.full(n, words, dtype=np.uint64)
    for k in range(min(words, n)):  # the last words of a text run into the next; those hashes are cut off below
        h[: n - k] = h[: n - k] * FACTOR + w[k:]
        h ^= h >> np.uint64(29)
    h = mixed(h)
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, c in enumerate(count.tolist()):
        if c >= words:
            part = np.sort(h[begin[i] : begin[i + 1] - words + 1])
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif c:
            one = np.array([c], dtype=np.uint64)
            for k in range(begin[i], begin[i + 1]):
                one = one * FACTOR + w[k : k + 1]
                one ^= one >> np.uint64(29)
            part = mixed(one)
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    return np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def keys_of(items: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: the sum of hashes of its shingles."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(items ^ FACTOR), dtype=np.uint64)])
    return mixed(sums[begin[1:]] - sums[begin[:-1]]).view(np.int64)


def window(n):
    """How many of its first pivots a set of ``n`` shingles meets partners in."""
    return n - (3 * n + 3) // 4 + 1


def least_shared(n1, n2):
    """How many shingles two sets that link share at least."""
    return -(-3 * (n1 + n2) // 7)


def least_met(n1, n2):
    """In how many pivots of both windows two sets that link meet at least."""
    rest = np.maximum(n1 - window(n1), n2 - window(n2))
    return np.maximum(least_shared(n1, n2) - rest, 1)


def measured(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, place, n, key`` per document: ``key`` and ``n`` name its set, ``place`` is a hash of ``doc_id``."""
    source = docs.select("doc_id", F.xxhash64("doc_id").alias("place"), "text")
    schema = T.StructType([source.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("place", "n", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, begin = shingles(texts_of(batch.column("text")), words)
            made = [pa.array(np.diff(begin)), pa.array(keys_of(items, begin))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *made], names=schema.names)
        give_back()

    return source.mapInArrow(run, schema)


def ranges(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else [0]
    return list(zip(edges[:-1], edges[1:]))


def narrow(tokens: np.ndarray) -> bytes:
    """The lower 40 bits of each hash."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def widened(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(content, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: those that hardly change take no room in a shuffle."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(cells: list[bytes], kind) -> np.ndarray:
    """The values of all cells, end to end."""
    size = np.dtype(kind).itemsize
    bytes_of = [np.frombuffer(c, dtype=np.uint8).reshape(size, len(c) // size).T for c in cells]
    flat = np.concatenate([np.zeros((0, size), dtype=np.uint8), *bytes_of])
    return np.ascontiguousarray(flat).view(kind).ravel()


def lots(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """``bucket, lot, tokens, at, n, key``: the shingles of a lot of sets that fall into a bucket.

    ``tokens`` and ``at`` (which set of the lot) are packed; the sets' sizes and names go with one row of the lot.
    A task takes a set once as long as it remembers it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        done: set = set()
        parts, sizes, names, held = [], [], [], 0

        def lot():
            flat = np.concatenate(parts)
            at = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            flat, at, bucket = flat[order], at[order], bucket[order]
            name = task << 32 | number
            rows = [(int(bucket[a]), narrow(flat[a:b]), planes(at[a:b])) for a, b in ranges(bucket)]
            n, key = np.array(sizes, dtype=np.int32).tobytes(), np.array(names, dtype=np.int64).tobytes()
            first = name % len(rows)
            for k, (b, tokens, which) in enumerate(rows):
                more = (n, key) if k == first else (None, None)
                columns = [pa.array([b], pa.int32()), pa.array([name], pa.int64())]
                columns += [pa.array([x], pa.binary()) for x in (tokens, which, *more)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lot", "tokens", "at", "n", "key"])

        for batch in batches:
            items, begin = shingles(texts_of(batch.column("text")), words)
            for i, key in enumerate(keys_of(items, begin).tolist()):
                a, b = int(begin[i]), int(begin[i + 1])
                if a == b or (b - a, key) in done:
                    continue
                if len(done) < 200_000:
                    done.add((b - a, key))
                parts.append(items[a:b])
                sizes.append(b - a)
                names.append(key)
                held += b - a
                if held >= LOT_SHINGLES or len(sizes) >= LOT_DOCS:
                    yield from lot()
                    number += 1
                    parts, sizes, names, held = [], [], [], 0
        if held:
            yield from lot()
        parts, done = [], set()
        give_back()

    return docs.select("text").mapInArrow(run, "bucket int, lot long, tokens binary, at binary, n binary, key binary")


def groups_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[pa.RecordBatch]]:
    """The slices of a sorted stream that belong to one value of ``keys``."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            name = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and name != now:
                yield held
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def values_of(parts: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([p.column(column).to_numpy(zero_copy_only=False) for p in parts])


def shared_shingles(packed_rows: DataFrame, buckets: int) -> DataFrame:
    """``lot, tokens, at, seen, n, key``: of each lot the shingles that several sets have, and in how many."""
    source = packed_rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups_of(batches, "bucket"):
            names = values_of(parts, "lot")
            bucket = int(parts[0].column("bucket")[0].as_py())
            column = lambda c: [x for p in parts for x in p.column(c).to_pylist()]
            packed_tokens = column("tokens")
            tokens = widened(b"".join(packed_tokens))
            at = from_planes(column("at"), np.uint16)
            of = np.repeat(np.arange(len(names), dtype=np.int32), [len(t) // 5 for t in packed_tokens])
            order = np.argsort(tokens, kind="stable")
            t = tokens[order]
            edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            seen = np.zeros(len(t), dtype=np.int32)
            seen[order] = np.repeat(np.diff(edges), np.diff(edges))
            many = np.flatnonzero(seen > 1)
            pivots = tokens | np.int64(bucket) << 40
            cut = np.searchsorted(of[many], np.arange(len(names) + 1))
            for k, (n, key) in enumerate(zip(column("n"), column("key"))):
                rows = many[cut[k] : cut[k + 1]]
                if not len(rows) and n is None:
                    continue
                columns = [pa.array([int(names[k])], pa.int64())]
                packed_columns = (planes(pivots[rows]), planes(at[rows]), planes(seen[rows]), n, key)
                columns += [pa.array([x], pa.binary()) for x in packed_columns]
                yield pa.RecordBatch.from_arrays(columns, names=["lot", "tokens", "at", "seen", "n", "key"])
        give_back()

    return source.mapInArrow(run, "lot long, tokens binary, at binary, seen binary, n binary, key binary")


def windows(shared: DataFrame) -> DataFrame:
    """``n, key, alone, pivots, seen``: of each set the pivots of its window that other sets have too.

    ``alone`` counts the shingles that no other set has; they come first in the order. Sets without
    such pivots are left out.
    """
    source = shared.repartition("lot").sortWithinPartitions("lot")
    schema = "n int, key long, alone int, pivots array<long>, seen array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups_of(batches, "lot"):
            column = lambda c: [x for p in parts for x in p.column(c).to_pylist() if x is not None]
            n, key = (np.frombuffer(b"".join(column(c)), dtype=kind) for c, kind in (("n", np.int32), ("key", np.int64)))
            tokens, at, seen = (
                from_planes(column(c), kind) for c, kind in (("tokens", np.int64), ("at", np.uint16), ("seen", np.int32))
            )
            order = np.lexsort((tokens, seen, at))
            tokens, at, seen = tokens[order], at[order], seen[order]
            size = np.bincount(at, minlength=len(n))
            alone = n - size
            taken = np.clip(window(n) - alone, 0, size)
            start = np.cumsum(size) - size
            kept = np.arange(len(at)) - start[at] < taken[at]
            sets = np.flatnonzero(taken)
            ends = pa.array(np.concatenate([[0], np.cumsum(taken[sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(n[sets]),
                    pa.array(key[sets]),
                    pa.array(alone[sets].astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(tokens[kept])),
                    pa.ListArray.from_arrays(ends, pa.array(seen[kept])),
                ],
                names=["n", "key", "alone", "pivots", "seen"],
            )

    # a set that several tasks had comes once
    found = source.mapInArrow(run, schema)
    return found.groupBy("n", "key").agg(*(F.first(c).alias(c) for c in ("alone", "pivots", "seen")))


def small_pairs(found: DataFrame) -> DataFrame:
    """``n1, key1, n2, key2, met``: pairs that meet in regions of rare pivots and may link.

    Such a region has at most ``SMALL_REGION`` sets. What frequent pivots may add is bounded by how many both have.
    """
    large = F.size(F.filter("seen", lambda x: x > SMALL_REGION))
    rows = found.select(
        "n", "key", "alone", F.size("pivots").alias("size"), large.alias("large"),
        F.posexplode(F.arrays_zip("pivots", "seen")).alias("k", "p"),
    ).where(F.col("p.seen") <= SMALL_REGION)
    rows = rows.select(
        F.col("p.pivots").alias("pivot"), "n", "key", (F.col("alone") + F.col("k")).alias("pos"),
        (F.col("size") - F.col("k")).alias("left"), "large",
    )
    source = rows.repartition("pivot").sortWithinPartitions("pivot", "n", "key")
    names = ["n1", "key1", "n2", "key2", "large", "fits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def settle(c):
            pivot, n, key, pos, left, large = c
            for d in range(1, SMALL_REGION):
                i = np.flatnonzero(pivot[d:] == pivot[:-d])
                j = i + d
                ok = 4 * n[i].astype(np.int64) >= 3 * n[j].astype(np.int64)
                i, j = i[ok], j[ok]
                if len(i):
                    fits = can_link(n[i], pos[i], left[i], n[j], pos[j], left[j])
                    columns = [n[i], key[i], n[j], key[j], np.minimum(large[i], large[j]), fits]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("pivot", "n", "key", "pos", "left", "large")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut >= CHUNK_ROWS:  # the last region may go on
                yield from settle([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield from settle(held)

    # every meeting counts; the places must fit in the first one
    pairs = source.mapInArrow(run, "n1 int, key1 long, n2 int, key2 long, large int, fits boolean")
    pairs = pairs.groupBy("n1", "key1", "n2", "key2").agg(
        F.count("*").alias("met"), F.first("large").alias("large"), F.max("fits").alias("fits")
    )
    n1, n2 = F.col("n1").cast("long"), F.col("n2").cast("long")
    rest = lambda n: F.expr(f"({n} * 3 + 3) div 4 - 1")  # noqa: E731  behind the window
    least = F.ceil(3 * (n1 + n2) / 7) - F.greatest(rest("n1"), rest("n2"))
    return pairs.where(F.col("fits") & (F.col("met") + F.col("large") >= least)).drop("large", "fits")


def can_link(n1, pos1, left1, n2, pos2, left2):
    """Whether sets whose first common pivot stands at these places, the first set being the smaller, may link."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    need = least_shared(n1, n2)
    return (
        (4 * n1 >= 3 * n2)
        & (n1 - pos1 >= need)
        & (n2 - pos2 >= need)
        & (np.minimum(left1, left2) >= least_met(n1, n2))
    )


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``n1, key1, n2, key2, shared`` of every pair (pivot, member), from the sets of the whole texts.

    Only needed sets leave the scan: a filter of fixed size over hashed ids passes all of them. A
    pivot meets its members sorted behind it; pivots with many members are dealt to several tasks.
    """
    ends = pairs.select(F.col("n1").alias("n"), F.col("key1").alias("key")).unionByName(
        pairs.select(F.col("n2").alias("n"), F.col("key2").alias("key"))
    )
    needed = nodes.join(ends.distinct(), ["n", "key"], "left_semi").select("place")
    slot = F.shiftrightunsigned("place", 6).bitwiseAND(NEED_WORDS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    got = needed.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    filled = np.zeros(NEED_WORDS, dtype=np.uint64)
    filled[got.column("slot").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy().view(np.uint64)
            asked = filled[(place >> np.uint64(6)) & np.uint64(NEED_WORDS - 1)] >> (place & np.uint64(63)) & np.uint64(1)
            rows = np.flatnonzero(asked)
            items, begin = shingles(texts_of(batch.column("text").take(pa.array(rows))), words)
            if len(items):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.diff(begin).astype(np.int32)),
                        pa.array(keys_of(items, begin)),
                        pa.array([items[a:b].tobytes() for a, b in zip(begin, begin[1:])], pa.binary()),
                    ],
                    names=["n", "key", "items"],
                )

    sets = docs.select(F.xxhash64("doc_id").alias("place"), "text").mapInArrow(fetch, "n int, key long, items binary")
    load = pairs.groupBy("n1", "key1").agg(F.ceil(F.count("*") / PIVOT_MEMBERS).cast("int").alias("tasks"))
    members = pairs.join(load, ["n1", "key1"]).select(
        "n1", "key1", F.pmod(F.xxhash64("key2"), "tasks").cast("int").alias("task"), F.lit(1).alias("role"), "n2", "key2"
    )
    pivots = load.select(
        "n1",
        "key1",
        F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"),
        F.lit(0).alias("role"),
        F.col("n1").alias("n2"),
        F.col("key1").alias("key2"),
    )
    wanted = members.unionByName(pivots)
    sets = sets.withColumnsRenamed({"n": "n2", "key": "key2"})
    met = wanted.join(sets, ["n2", "key2"]).repartition("n1", "key1", "task")
    met = met.sortWithinPartitions("n1", "key1", "task", "role").select("n1", "key1", "role", "n2", "key2", "items")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            role, items = batch.column("role").to_pylist(), batch.column("items")
            kept, shared = [], []
            for i, r in enumerate(role):
                s = np.frombuffer(items[i].as_buffer(), dtype=np.uint64)
                if r == 0:
                    pivot = s
                    continue
                at = np.searchsorted(pivot, s)
                at[at == len(pivot)] = 0
                kept.append(i)
                shared.append(int((pivot[at] == s).sum()))
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("n1", "key1", "n2", "key2")), pa.array(shared, pa.int32())],
                names=["n1", "key1", "n2", "key2", "shared"],
            )

    return stored(met.mapInArrow(compare, "n1 int, key1 long, n2 int, key2 long, shared int"), "compared")


def linked(met: DataFrame) -> DataFrame:
    """The links among compared pairs, as edges between node names."""
    union = F.col("n1").cast("long") + F.col("n2") - F.col("shared")
    return met.where(100 * F.col("shared").cast("long") >= LEAST_PERCENT * union).select(
        F.struct(F.col("n1").alias("n"), F.col("key1").alias("key")).alias("a"),
        F.struct(F.col("n2").alias("n"), F.col("key2").alias("key")).alias("b"),
    )


def group_names(edges: DataFrame) -> DataFrame:
    """``n, key, group``: the smallest node name of the component of each linked node."""
    return components(edges).select(
        F.col("node.n").alias("n"), F.col("node.key").alias("key"), F.col("component").alias("group")
    )


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` after more links: only the groups that these join are contracted again, not all nodes."""
    own = lambda side: links.select(F.col(f"{side}.n").alias(f"n{side}"), F.col(f"{side}.key").alias(f"key{side}"), "a", "b")
    left = with_groups(own("a"), groups, "a").select("groupa", "b")
    right = with_groups(left.select("groupa", F.col("b.n").alias("nb"), F.col("b.key").alias("keyb")), groups, "b")
    moved = components(right.select(F.col("groupa").alias("a"), F.col("groupb").alias("b")))
    moved = moved.select("node", F.col("component").alias("to"))
    old = groups.join(moved, F.col("group") == F.col("node"), "left")
    old = old.select("n", "key", F.coalesce("to", "group").alias("group"))
    alone = moved.select(F.col("node.n").alias("n"), F.col("node.key").alias("key"), F.col("to").alias("group"))
    return stored(old.unionByName(alone.join(groups.select("n", "key"), ["n", "key"], "left_anti")), "groups")


def with_groups(df: DataFrame, groups: DataFrame, side: str) -> DataFrame:
    """Add ``group<side>`` of the node ``n<side>, key<side>``: its component's name, or its own."""
    n, key, g = f"n{side}", f"key{side}", f"group{side}"
    named = groups.select(F.col("n").alias(n), F.col("key").alias(key), F.col("group").alias(g))
    own = F.struct(F.col(n).alias("n"), F.col(key).alias("key"))
    return df.join(named, [n, key], "left").withColumn(g, F.coalesce(g, own))


def large_pairs(
    found: DataFrame, groups: DataFrame | None = None, met: DataFrame | None = None, among: DataFrame | None = None, turn: int | None = 0
) -> DataFrame:
    """``n1, key1, n2, key2, asker, met, cut``: pairs that meet in regions of frequent pivots, often enough to link.

    Pairs of one component, and pairs that their known distances keep apart, are left out. With a ``turn`` each
    set asks a few of the others in a region, other ones each turn; ``cut`` is the region where it could have asked
    more, and later turns look ``among`` those regions only. Regions above ``BLOCK_ROWS`` sets are dealt as pairs of blocks.
    """
    own = F.struct("n", "key")
    rows = found.withColumn("from", F.size("pivots") - F.size(F.filter("seen", lambda x: x > SMALL_REGION)))
    rows = rows.where(F.col("from") < F.size("pivots"))
    if groups is None:
        nothing = F.lit(None).cast("long").alias("to"), F.lit(None).cast("double").alias("far")
        rows = rows.select("*", F.xxhash64(own).alias("group"), *nothing)
    else:
        distance = 1 - F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
        known = met.groupBy(F.col("n2").alias("n"), F.col("key2").alias("key")).agg(
            F.min_by(F.struct(F.col("key1").alias("to"), distance.alias("far")), F.struct("n1", "key1")).alias("known")
        )
        rows = rows.join(groups.select("n", "key", F.col("group").alias("named")), ["n", "key"], "left")
        rows = rows.join(known, ["n", "key"], "left").select(
            *found.columns, "from", F.xxhash64(F.coalesce("named", own)).alias("group"), "known.to", "known.far"
        )
    each = F.explode(F.sequence(F.col("from"), F.size("pivots") - 1)).alias("k")
    at = lambda c: F.get(c, F.col("k"))
    # sizes of regions, counted on narrow rows; where no set is of another component there is nothing to do
    narrow_rows = rows.select("group", "pivots", "seen", each).select(at("pivots").alias("pivot"), at("seen").alias("seen"), "group")
    if groups is None:
        narrow_rows = narrow_rows.where(F.col("seen") > BLOCK_ROWS)
    sizes = narrow_rows.groupBy("pivot").agg(F.count("*").alias("m"), F.min("group").alias("low"), F.max("group").alias("high"))
    if among is not None:
        sizes = sizes.join(among, "pivot", "left_semi")
    sizes = sizes.where("low <> high").select("pivot", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.select("n", "key", "alone", "group", "to", "far", "pivots", "seen", each).select(
        at("pivots").alias("pivot"), at("seen").alias("seen"), "n", "key", (F.col("alone") + F.col("k")).alias("pos"),
        "group", "to", "far", F.slice("pivots", F.col("k") + 1, F.size("pivots") - F.col("k")).alias("rest"),
    )
    if groups is None:  # sets outside the window count in ``seen``, so most regions are known to fit into a block
        whole = rows.where(F.col("seen") <= BLOCK_ROWS).withColumn("blocks", F.lit(1))
        rows = whole.unionByName(rows.where(F.col("seen") > BLOCK_ROWS).join(sizes, "pivot"))
    else:
        rows = rows.join(sizes, "pivot")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    task = ["pivot", "first", "second"]
    source = rows.repartition(*task).sortWithinPartitions(*task, "n", "key").select(
        *task, "n", "key", "pos", "group", F.coalesce("to", F.lit(0)).alias("to"), F.coalesce("far", F.lit(-1.0)).alias("far"), "block", "rest"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups_of(batches, *task):
            n, key, pos, group, to, far, block = (
                values_of(parts, c) for c in ("n", "key", "pos", "group", "to", "far", "block")
            )
            n = n.astype(np.int64)
            rest = [x.values.to_numpy() for p in parts for x in p.column("rest")]
            left = np.array([len(x) for x in rest])
            across = parts[0].column("first")[0].as_py() != parts[0].column("second")[0].as_py()
            kept = np.arange(len(n))
            while len(kept) > 1:
                # a set whose pivots from here on are too few for any partner of the sizes that are there goes
                m, low = n[kept], -(-3 * n[kept] // 4)
                smallest = m[np.searchsorted(m, low)]
                largest = m[np.searchsorted(m, 4 * m // 3, side="right") - 1]
                enough = left[kept] >= np.minimum(least_met(m, smallest), least_met(m, largest)) - 1
                if enough.all():
                    break
                kept = kept[enough]
            if len(kept) < 2:
                continue
            # where each pivot stands: the members of its posting list
            flat = np.concatenate([rest[i] for i in kept])
            _, flat = np.unique(flat, return_inverse=True)
            member = np.repeat(np.arange(len(kept)), left[kept])
            posted = member[np.argsort(flat, kind="stable")]
            ends = np.cumsum(np.bincount(flat))
            starts = ends - np.bincount(flat)
            begin = np.cumsum(left[kept]) - left[kept]
            f, t = far[kept], to[kept]
            m, p, g, l_ = n[kept], pos[kept], group[kept], left[kept]
            region = int(parts[0].column("pivot")[0].as_py())
            left_side, right_side, times, cut = [], [], [], []
            for r in range(len(kept)):
                # the sets of like size that stand before
                b = int(np.searchsorted(m, -(-3 * int(m[r]) // 4)))
                if b == r:
                    continue
                before = slice(b, r)
                one = slice(r, r + 1)
                ok = can_link(m[before], p[before], l_[before], m[one], p[one], l_[one]) & (g[before] != g[r])
                if across:
                    ok &= block[kept[before]] != block[kept[r]]
                i = b + np.flatnonzero(ok)
                if not len(i):
                    continue
                mine = flat[begin[r] : begin[r] + left[kept[r]]]
                count = np.bincount(np.concatenate([posted[starts[v] : ends[v]] for v in mine]), minlength=len(kept))[i]
                apart = (f[i] >= 0) & (f[r] >= 0) & (t[i] == t[r]) & (np.abs(f[i] - f[r]) > REACH + 1e-9)
                good = (count >= least_met(m[i], m[r])) & ~apart
                i, count = i[good], count[good]
                more = turn is not None and len(i) > ASKED
                if more:
                    # the nearest, and in later turns the same choice in all regions that offer the same partners
                    by = -count if turn == 0 else key[kept[i]] * np.int64(2 * turn + 1) ^ key[kept[r]]
                    best = np.argsort(by, kind="stable")[:ASKED]
                    i, count = i[best], count[best]
                left_side.append(kept[i])
                right_side.append(np.full(len(i), kept[r]))
                times.append(count)
                cut.append(np.full(len(i), more))
            if left_side:
                i, j = np.concatenate(left_side), np.concatenate(right_side)
                columns = [n[i].astype(np.int32), key[i], n[j].astype(np.int32), key[j], key[j], np.concatenate(times).astype(np.int64)]
                made = [pa.array(c) for c in columns] + [pa.array(np.full(len(i), region), mask=~np.concatenate(cut))]
                yield pa.RecordBatch.from_arrays(made, names=["n1", "key1", "n2", "key2", "asker", "met", "cut"])

    return source.mapInArrow(run, "n1 int, key1 long, n2 int, key2 long, asker long, met long, cut long")


def cut_regions(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("cut").isNotNull()).select(F.col("cut").alias("pivot")).distinct()


def best_of(pairs: DataFrame, most: int) -> DataFrame:
    """For each asking set the partners it met most often, ``most`` at most."""
    order = Window.partitionBy("asker").orderBy(F.desc("met"), F.col("n2") - F.col("n1"), "key1", "key2")
    ranked = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return ranked.select("n1", "key1", "n2", "key2").distinct()


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows with
    equal sets are copies and link; a null id is never the smallest of a component of others. Other
    columns are not looked at; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    rows = stored(measured(docs, words), "sets").withColumn("n", F.col("n").cast("int"))
    nodes = rows.where("n > 0").groupBy("n", "key").agg(
        F.min("doc_id").alias("rep"), F.min_by("place", "doc_id").alias("found"), F.min("place").alias("any")
    )
    nodes = stored(nodes.select("n", "key", "rep", F.coalesce("found", "any").alias("place")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = -(-total // BUCKET_SHINGLES) or 1
    found = stored(windows(shared_shingles(lots(docs, words, buckets), buckets)), "windows")
    names = ["n1", "key1", "n2", "key2"]
    large = stored(large_pairs(found), "large-regions")
    candidates = small_pairs(found).withColumn("asker", F.col("key2")).unionByName(large.drop("cut"))
    candidates = stored(candidates.groupBy(*names, "asker").agg(F.max("met").alias("met")), "candidates")
    met = compared(stored(best_of(candidates, 1), "pairs"), docs, nodes, words)
    groups = group_names(linked(met))
    among = cut_regions(large)
    for turn in range(1, TURNS + 2):
        last = turn > TURNS
        if not among.isEmpty():
            more = stored(large_pairs(found, groups, met, among, None if last else turn), "large-regions")
            among = cut_regions(more)
            more = more.groupBy(*names, "asker").agg(F.max("met").alias("met"))
            candidates = stored(candidates.unionByName(more).groupBy(*names, "asker").agg(F.max("met").alias("met")), "candidates")
        apart = with_groups(with_groups(candidates, groups, "1"), groups, "2").where(F.col("group1") != F.col("group2"))
        open_pairs = apart.select(*names, "asker", "met").join(met.select(*names), names, "left_anti")
        pairs = stored(open_pairs.select(*names).distinct() if last else best_of(open_pairs, ASKED), "pairs")
        if pairs.isEmpty():
            continue
        new = compared(pairs, docs, nodes, words)
        met = met.unionByName(new)
        groups = joined_groups(groups, linked(new))
    known = nodes.join(groups, ["n", "key"], "left").withColumn(
        "group", F.coalesce("group", F.struct("n", "key"))
    )
    least = known.groupBy("group").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "group").select("n", "key", "component_id")
    return rows.join(known, ["n", "key"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of the smallest id of each component, with all their columns.

    Rows that repeat an id stay or go together; rows without an id stay, as nothing names them.
    """
    same = similar_documents(docs.select("doc_id", "text"), words)
    gone = same.groupBy(F.col("doc_id").alias("gone")).agg(F.min("component_id").alias("least")).where("gone <> least")
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.gone"), "left_anti")


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
