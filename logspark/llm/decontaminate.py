"""Benchmark decontamination: which documents hold a test item.

Both sides are sets of five-word shingles of normalised words (lower case, letters and digits). A document holds an item
if it has at least ``threshold`` of the item's shingles: containment, so a long document doesn't dilute a
short item.

MinHash containment search, partitioned by size. An item of q shingles that is contained to a share t
misses at most floor((1 - t) q) of them, so of any m = floor((1 - t) q) + 1 shingles at least one is in the
document. The item's sketch is its m smallest hashes (bottom-m MinHash). Items are partitioned by size
in powers of two, and m comes from the largest size of the partition, as sketch parameters do in a containment
ensemble. A document is a candidate for an item when the two share a hash of the sketch. A MinHash of a fixed length
for the documents could not do this: an item of 30 shingles in a document of 3,000 agrees with it in one of a hundred
hash functions only. Here no containment at or above the threshold is lost, whatever the sizes.

The first pass over the documents keeps nothing but hashes that are in some sketch, and gives the candidates. The second pass reads the texts of candidate documents only and counts the
shingles they share with their items exactly, as text. Only DataFrame functions are used.

A text is cut into slices of words that overlap by a shingle, so no row holds the shingles of a whole long text.

Items with fewer words than a shingle are one shingle and must occur as that run of words in the text: documents are also
cut into runs of the sizes that such items have. In scripts written without spaces each character is a word.

Cases: null or empty texts and items hold nothing; repeated rows are found once per doc_id and item; rows without
doc_id or item_id are left out; empty tables give none; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import texts
from logspark.session import sized, written

WORDS = 5
THRESHOLD = 0.8
#: Largest table of sketches or item shingles that is sent to all tasks; a larger one is joined by shuffles.
BROADCAST_BYTES = 32 << 20


#: Words whose shingles lie in one row.
SLICE = 4096

#: Letters of scripts written without spaces, and the ranges of code points that hold them all and are cheap to look for.
UNSPACED = r"(?![^\p{L}\p{N}])[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_RANGES = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\x{10FFFF}]"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; in scripts without spaces single ones."""
    lower = F.lower(text)
    apart = F.when(lower.rlike(_RANGES), F.regexp_replace(lower, UNSPACED, " $0 ")).otherwise(lower)
    return F.split(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: Column, n: int = WORDS) -> Column:
    """Runs of n words as text; fewer words are one run; no words give none."""
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.get(words, F.lit(0)) != "", runs).otherwise(F.array().cast("array<string>"))


def _slices(words: Column, n: int = WORDS) -> Column:
    """The words in slices of ``SLICE`` runs of n words each; the last words of a slice begin the next."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(SLICE))
    return F.transform(starts, lambda at: F.slice(words, at, SLICE + n - 1))


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(item_id, hash, shingle, size): the different shingles of each item and their number."""
    clean = items.select(
        F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    each = clean.where("item_id is not null and words is not null").select(
        "item_id", F.explode(_shingles(F.col("words"), n)).alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    return each.join(sizes, "item_id").select("item_id", F.xxhash64("shingle").alias("hash"), "shingle", "size")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size, part, hash): the smallest hashes of each item, as many as the largest size of its partition needs."""
    part = F.floor(F.log2("size")).cast("int")
    largest = F.pow(F.lit(2), F.col("part") + 1) - 1
    needed = (F.floor((1 - threshold) * largest + 1e-9) + 1).cast("int")
    return shingles.groupBy("item_id", "size").agg(F.sort_array(F.collect_set("hash")).alias("_all")).withColumn(
        "part", part).select("item_id", "size", "part", F.explode(F.slice("_all", F.lit(1), needed)).alias("hash"))


def _cut(docs: DataFrame, sizes: list[int], n: int) -> DataFrame:
    """(doc_id, shingle) of ``docs`` (doc_id, text): runs of n words, and of as many as ``sizes`` say."""
    part = F.col("part")
    runs = F.concat(_shingles(part, n), *[_shingles(part, size) for size in sizes])
    return docs.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", F.explode(_slices(F.col("words"), n)).alias("part")).select("doc_id", F.explode(runs).alias("shingle"))


def candidates(docs: DataFrame, sketch: DataFrame, sizes: list[int], n: int = WORDS) -> DataFrame:
    """(doc_id, item_id) of documents that have a hash of the item's ``sketch`` (item_id, part, hash)."""
    hashes = _cut(docs, sizes, n).select("doc_id", F.xxhash64("shingle").alias("hash"))
    return hashes.join(sketch.select("item_id", "hash"), "hash").select("doc_id", "item_id").distinct()


def contained(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS,
) -> DataFrame:
    """(doc_id, item_id, shared, size, containment) of all documents that hold an item."""
    shingles = written(item_shingles(items, n), "items")
    sketch = written(sketches(shingles, threshold), "sketches")
    # Items below n words, of n - 1 sizes at most, are looked up in runs of their own size.
    count = F.size(F.split("shingle", " "))
    short = sorted(row[0] for row in shingles.select(count.alias("n")).where(F.col("n") < n).distinct().collect())
    given = texts(docs).where("doc_id is not null")

    found = written(candidates(given, _sent(sketch, F.lit(64)), short, n), "candidates")
    of_found = given.join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
    wanted = shingles.join(found.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "shingle", "size")
    # A run that a document repeats counts once; only runs of some candidate's item reach the shuffle.
    hits = _cut(of_found, short, n).join(
        _sent(written(wanted, "wanted"), F.length("shingle") * 2 + 64), "shingle").distinct()
    return hits.join(found, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id", "size").agg(
        F.count(F.lit(1)).alias("shared")).select(
        "doc_id", "item_id", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"),
    ).where(F.col("containment") >= threshold)


def _sent(table: DataFrame, width: Column) -> DataFrame:
    """A written table, sent to all tasks where the sum of its rows' ``width`` in bytes allows that."""
    measured = table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if measured <= BROADCAST_BYTES else table


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, less the documents that hold an item; rows without doc_id stay."""
    found = contained(docs, items, threshold).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint") == found["_leak"], "left_anti")
