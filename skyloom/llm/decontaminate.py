"""Benchmark decontamination with DataFrame functions only.

A gram is ten consecutive words of a benchmark item, or the whole item where it is shorter.
The grams of the benchmark are a small set: their number and bytes are measured, and they are
broadcast in slices of ``BROADCAST_BYTES`` at most, each of which scans the documents. Every window of
every document looks itself up by a hash of a few of its words, and a hit is verified on all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.common import table

GRAM = 10
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# after A-Z are lowered, words are runs of digits, a-z and everything beyond ASCII
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same before lowering, one match for each word with what stands before it
GAP_AND_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def fingerprint(tokens: Column, at: Column, n: int) -> Column:
    """A hash of up to four words spread over the ``n`` words from ``at`` (from 0): a window's address, not its proof."""
    return F.xxhash64(F.lit(n), *(F.get(tokens, at + k) for k in sorted({0, n // 3, 2 * n // 3, n - 1})))


def grams(benchmark: DataFrame, n: int = GRAM) -> DataFrame:
    """(gram, len, items): each gram once, with the sorted ids of its items as text."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")
    )
    items = items.select("item", "w", F.size("w").alias("size")).where("size > 0")
    length = F.least(F.col("size"), F.lit(n))
    every = items.select(
        "item",
        length.alias("len"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - length + 1),
                lambda i: F.concat_ws(" ", F.slice("w", i, length)),
            )
        ).alias("gram"),
    )
    return every.groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = GRAM) -> DataFrame:
    """One row per document row: ``doc_id, n_words, hits, items``.

    ``hits`` are the (pos, len) of the windows that occur in the benchmark, ``items`` the sorted
    ids (text) of the items they belong to. Null and empty texts have no words and no hits, as has
    everything if the benchmark is empty; repeated document rows each get a row; repeated benchmark
    rows count once; items without id or words match nothing. Other columns are not looked at.
    """
    known = grams(benchmark, n)
    facts = known.agg(
        F.sort_array(F.collect_set("len")).alias("lengths"),
        F.coalesce(F.sum(F.length("gram") + F.size("items") * 16 + 64), F.lit(0)).alias("bytes"),
    ).first()
    lengths = facts["lengths"]
    known = known.select(
        F.split("gram", " ").alias("g"), F.col("gram").alias("known_gram"), F.col("len").alias("known_len"), "items"
    ).select(
        F.coalesce(
            *(F.when(F.col("known_len") == k, fingerprint(F.col("g"), F.lit(0), k)) for k in lengths),
            F.lit(None).cast("long"),
        ).alias("address"),
        "known_gram",
        "known_len",
        F.col("items").alias("found"),
    )
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    slices = -(-facts["bytes"] // BROADCAST_BYTES) or 1
    met = None
    for k in range(slices):
        part = known if slices == 1 else known.where(F.pmod("address", F.lit(slices)) == k)
        some = matches(split, part, lengths)
        met = some if met is None else met.unionByName(some)
    hit = F.when(F.col("pos") > 0, F.struct("pos", "len"))
    return (
        met.groupBy("row", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"),
            F.sort_array(F.collect_list(hit)).alias("hits"),
            F.flatten(F.collect_set("found")).alias("all_items"),
        )
        .select("doc_id", "n_words", "hits", F.array_sort(F.array_distinct("all_items")).alias("items"))
    )


def matches(split: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Verified hits of the windows of ``split`` and a row with pos 0 for each of its rows; ``known`` is broadcast."""

    def addresses(n: int) -> Column:
        return F.transform("w", lambda _, i: fingerprint(F.col("w"), i, n))

    # one address for each length and word, behind one that stands for the document
    addressed = split.select(
        "doc_id",
        "row",
        "w",
        F.size("w").alias("n_words"),
        F.concat(F.array(F.lit(0).cast("long")), *map(addresses, lengths)).alias("every"),
    ).select("doc_id", "row", "w", "n_words", F.posexplode("every").alias("at", "window"))
    pos = F.pmod(F.col("at") - 1, F.greatest("n_words", F.lit(1))) + 1
    window = F.concat_ws(" ", F.slice("w", pos, F.col("known_len")))
    found = (F.col("window") == F.col("address")) & (F.col("at") > 0) & (window == F.col("known_gram"))
    return (
        addressed.join(F.broadcast(known), found, "left")
        .where((F.col("at") == 0) | F.col("known_gram").isNotNull())
        .select(
            "row",
            "doc_id",
            "n_words",
            F.when(F.col("at") > 0, pos).otherwise(0).alias("pos"),
            F.col("known_len").alias("len"),
            "found",
        )
    )


def hit_words(hits: Column) -> Column:
    """The positions of all words inside a hit, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))


def digest(leaks: DataFrame) -> DataFrame:
    return leaks.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(hit_words(F.col("hits"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = GRAM) -> DataFrame:
    """The documents without any hit, with all their columns.

    Rows are told apart by a hash of their text and not by id, so repeated and null ids do no harm: a
    text that leaks goes in all its rows.
    """
    leaks = find_leaks(docs.select(F.md5("text").alias("doc_id"), "text"), benchmark, n)
    leaking = leaks.where(F.size("hits") > 0).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.alias("d").join(leaking.alias("l"), F.md5("d.text") == F.col("l.leaking"), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = GRAM) -> DataFrame:
    """``doc_id, text``: every document row with the words inside hits (and what stands before them) cut out."""
    leaks = find_leaks(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"), benchmark, n)
    rows = leaks.select(
        "doc_id.doc_id",
        "doc_id.text",
        hit_words(F.col("hits")).alias("cut"),
        F.regexp_extract_all("text", F.lit(GAP_AND_WORD), F.lit(0)).alias("parts"),
    )
    tail = F.substring("text", F.length(F.array_join("parts", "")) + 1, F.length("text"))
    left = F.filter("parts", lambda x, i: ~F.array_contains("cut", (i + 1).cast("int")))
    return rows.select(
        "doc_id",
        F.when(F.size("cut") > 0, F.concat(F.array_join(left, ""), tail)).otherwise(F.col("text")).alias("text"),
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP2_SQL = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0))),
scanned AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, p, scanned.n FROM scanned JOIN grams USING (gram, n)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
