"""Periodic runs of words by seeds on diagonals.

A run has a smallest period q and at least ``max(least, times * q)`` words, so it agrees with itself, moved
by q, over at least ``max(least - q, (times - 1) * q)`` words. Lags are taken in classes; a class has one
gram length k, the least overlap that any of its lags guarantees, and ends where lags would exceed k. As
k is not below the lag, the gram at the start of a run comes next exactly one period later: a gram that came
earlier again would give the whole run a smaller period. So a document's occurrences of a gram are paired
with the next one only, never all with all, and nothing is missed.

Grams are named exactly, by sorting pairs of shorter names (no hashes), in one go for an Arrow batch of
documents; words that a document has once drop out first. Pairs are extended to the left and right along
their diagonal. A table holds, per lag, up to where the diagonal is covered, so every stretch is extended once.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, table, with_columns

by_value(__name__)

LEAST = 24  # words of a run at least
TIMES = 3  # periods of a run at least
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def lag_classes(longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(first lag, last lag, gram length)`` for all lags whose runs fit into ``longest`` words."""
    overlap = lambda q: max(least - q, (times - 1) * q)
    out, low = [], 1
    while times * low <= longest and max(least, times * low) <= longest:
        high = low
        k = overlap(low)
        while high + 1 <= min(k, overlap(high + 1)):
            high += 1
            k = min(k, overlap(high))
        out.append((low, high, k))
        low = high + 1
    return out


class Grams:
    """Exact names of the grams of a batch: equal names for equal grams of one document.

    ``at[k]`` are the ascending positions of k-grams that their document has more than once, ``name[k]``
    their names. A gram with a part that occurs once occurs once itself, so only these matter.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        size = len(words)
        keys = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        self.size = size
        self.at: dict[int, np.ndarray] = {}
        self.name: dict[int, np.ndarray] = {}
        self._keep(1, np.arange(size), keys)

    def _keep(self, k: int, at: np.ndarray, keys: np.ndarray) -> None:
        _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
        more = counts[names] > 1
        self.at[k], self.name[k] = at[more], names[more]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the k-grams that occur more than once in their document."""
        if k not in self.at:
            half = 1 << (k - 1).bit_length() - 1
            at, name = self.grams(half)
            second = at + (k - half)  # the gram's end is another gram of half the length or more
            there = np.searchsorted(at, second)
            there[there == len(at)] = 0
            both = at[there] == second if len(at) else np.zeros(0, dtype=bool)
            width = int(name.max(initial=0)) + 1
            self._keep(k, at[both], name[both] * width + name[there[both]])
        return self.at[k], self.name[k]

    def candidates(self, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(position, lag)`` of grams whose next occurrence in their document is a lag of the class away."""
        at, name = self.grams(k)
        order = np.argsort(name, kind="stable")
        at, name = at[order], name[order]
        lag = np.diff(at)
        good = (name[1:] == name[:-1]) & (lag >= low) & (lag <= high)
        return at[:-1][good], lag[good]


def agreement(words: np.ndarray, a: int, b: int, end: int, step: int) -> int:
    """How many words agree from ``a`` and ``b`` on, in direction ``step``, before ``b`` (or ``a``) passes ``end``."""
    done, size = 0, 32
    most = end - b if step > 0 else a - end + 1
    while done < most:
        size = min(size * 2, most - done)
        if step > 0:
            same = words[a + done : a + done + size] == words[b + done : b + done + size]
        else:
            same = (words[a - done - size + 1 : a - done + 1] == words[b - done - size + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += size
    return done


def runs_of(docs: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each document, by start, then period."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    long_enough = sizes >= least
    if not long_enough.any():
        return out
    words = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    grams = Grams(words, doc)
    for low, high, k in lag_classes(int(sizes.max()), least, times):
        at, lag = grams.candidates(low, high, k)
        if not len(grams.at[k]):
            break  # longer grams do not come twice either
        order = np.lexsort((at, lag, doc[at]))
        at, lag = at[order], lag[order]
        new = np.ones(len(at), dtype=bool)  # the place before on the same diagonal belongs to the same stretch
        new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        covered: dict[int, int] = {}
        now = -1
        for i, d in zip(at[new].tolist(), lag[new].tolist()):
            n = int(doc[i])
            if n != now:
                covered, now = {}, n
            if i < covered.get(d, -1):
                continue
            right = agreement(words, i, i + d, int(first[n + 1]), 1)
            left = agreement(words, i - 1, i + d - 1, int(first[n]), -1)
            covered[d] = i + right
            length = left + right + d
            if length >= max(least, times * d):
                out[n].append((i - left - int(first[n]), length, d))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those of no run, or within the first period of every run they are in."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """Words are parted by space and the control characters 9 to 13 only."""
    return text.encode().split() if text else []


def injected(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place after a document got its test run; None without one."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def annotated(
    docs: DataFrame,
    text: str = "text",
    planted_by: str | None = None,
    least: int = LEAST,
    times: int = TIMES,
) -> DataFrame:
    """All columns and ``n_words, runs, collapsed``: periodic runs of words and the text without their repeats.

    ``runs`` are structs of start (word number), length and period by start, then period; of equal texts all
    rows have equal runs. ``collapsed`` has the kept words, one space apart. Null and empty texts have no words,
    no runs and an empty ``collapsed``. Whole texts of any length are taken, alone in their batch if very long;
    overlapping runs of several periods are all listed. ``planted_by`` names an integer column that decides
    which texts get a run planted first (a test of recall; null plants none). Columns of the new names are replaced.
    """
    inputs = [text] if planted_by is None else [text, planted_by]
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("collapsed", T.StringType()),
    ]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def make():
        def compute(texts, ids=None):
            docs = [words_of(t) for t in texts.to_pylist()]
            if ids is not None:
                for n, i in enumerate(ids.to_pylist()):
                    places = injected(i, len(docs[n]))
                    if places is not None:
                        words = docs[n]
                        docs[n] = [words[k] for k in places.tolist()]
            # names in the order of first appearance: a word's number does not depend on hashing
            numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(docs)))}
            found = runs_of([np.array([numbers[w] for w in d], dtype=np.int64) for d in docs], least, times)
            collapsed = []
            for d, runs in zip(docs, found):
                if runs:
                    d = [d[k] for k in np.flatnonzero(kept_words(len(d), runs)).tolist()]
                collapsed.append(b" ".join(d).decode())
            listed = [[dict(zip(RUN.names, r)) for r in runs] for runs in found]
            return [[len(d) for d in docs], pa.array(listed, kind), collapsed]

        return compute

    return with_columns(docs, inputs, fields, make)


def digest(runs: list[tuple[int, int, int]]) -> str:
    """sha256 of a ``start,length,period`` line for every run."""
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    """Per document: its runs after planting, the one repeated most, and digests of runs and collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotated(docs, planted_by="doc_id").select("doc_id", "runs", "collapsed")
    # Fractions are compared exactly, as products of whole numbers.
    higher = lambda a, b: (
        (a["length"] * b["period"] > b["length"] * a["period"])
        | (
            (a["length"] * b["period"] == b["length"] * a["period"])
            & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
        )
    )
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda most, r: F.when(higher(r, most), r).otherwise(most),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
