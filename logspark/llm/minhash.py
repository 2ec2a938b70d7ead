"""Near-duplicates by similarity: texts that share at least 0.8 of their five-word shingles (Jaccard).

Words are lower-case runs of letters and digits; a text without any is cut at white space. Texts with the same set of
shingles are one class; everything after works on different sets only.

Candidates. SimHash first, as op9 has it: fingerprints within 4 bits, by Golay keys (:mod:`simhash`). Sets of similarity 0.8 can
differ in a dozen bits, so MinHash adds what is farther: 96 values of each set make ``BANDS`` keys of ``ROWS`` values. Two sets of
similarity s share a key with probability 1 - (1 - s^4)^24: all but 3 in a million at 0.8. Candidates of both kinds are verified
by counting their shingles (64-bit hashes), so no link is below the threshold.

Large groups. A key of over ``BUCKET`` sets isn't paired up. Its members meet one set of it, and those that are similar are
tied to it. Then all of them get keys of another kind, exact at the threshold. Of a crowd, sets that hang together by such
keys, one is the example, and of the others only the differences from it count: what they have more and what they have less. Two sets
differ from each other where one of them differs from the example and the other doesn't, so similar ones have most of their differences in common: with
all differences in one order, frequent ones last, the first that they share stands among the first 0.25 |s| + 1 of both, and what
precedes it and what is left of both tells how far apart they are at least (prefix filter). What a crowd has in common is no difference, so it
makes no two sets meet. Members of such a group outside its largest class meet a few
representatives of that class, more of them each round, and those still outside meet members of other classes of the
group, unless sizes and places of the shared difference say that they can't be similar. Two members of one class needn't meet: whatever they are, the class stays the same. So no class is
parted, however large a key is, and a crowd of near-copies takes a few pairs for each member.

Cases: null and empty texts are one class; fewer words than a shingle are one shingle; repeated rows share a class; rows
without doc_id get a class but never name one; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import simhash
from logspark.llm.common import texts
from logspark.llm.components import components
from logspark.session import sized, written

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
BUCKET = 48
#: Representatives of a class that a set outside meets, by round; the rounds end early where one finds nothing.
REPRESENTATIVES = (4, 16, 64)
_WORD = re.compile(r"[^\W_]+")
_ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    from xxhash import xxh64_intdigest

    lowered = text.lower()
    each = np.array([xxh64_intdigest(w) for w in _WORD.findall(lowered) or lowered.split()], np.uint64)
    if not len(each):
        return each
    length = min(words, len(each))
    runs = np.full(len(each) - length + 1, length, np.uint64)
    for n in range(length):
        runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + each[n:len(each) - length + 1 + n])
    return np.unique(runs)


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none of an empty one."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2_048):
        least = np.minimum(least, (found[at:at + 2_048, None] * _ODD[0] + _ODD[1]).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, blob, id, keys, fp): ``blob`` stands for the text, ``id`` for its set of shingles, ``fp`` is the SimHash of op9."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column(2)]
            ids = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            every = [keys(s).view(np.int64) for s in sets]
            fps = np.array([simhash.fingerprint(text.as_py(), words) for text in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids.view(np.int64)), pa.array(every, pa.list_(pa.int64())),
                 pa.array(fps.view(np.int64))], ["doc_id", "blob", "id", "keys", "fp"])

    return texts(docs).select("doc_id", F.xxhash64("text").alias("blob"), "text").mapInArrow(
        run, "doc_id bigint, blob bigint, id bigint, keys array<bigint>, fp bigint")


def _pairs(key: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for step in range(1, BUCKET):
        at = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else []
        if not len(at):
            break
        a.append(own[at])
        b.append(own[at + step])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], ["a", "b"])


def pairs_in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) within the runs of (key, id), sorted by both; a run has ``BUCKET`` rows at most."""
    kept = [np.empty(0, np.int64)] * 2
    for batch in batches:
        kept = [np.concatenate([old, np.asarray(column)]) for old, column in zip(kept, batch.columns)]
        if len(kept[0]):
            opened = int(np.searchsorted(kept[0], kept[0][-1]))
            yield from _pairs(*[column[:opened] for column in kept])
            kept = [column[opened:] for column in kept]
    yield from _pairs(*kept)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) once each, from the keys of up to ``BUCKET`` of ``classes`` (id, keys), and (key, id) of the larger keys."""
    keyed = classes.where(F.size("keys") > 0).select("id", F.explode("keys").alias("key"))
    large = sized(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET).select("key"))
    small = keyed.join(large, "key", "left_anti").select("key", "id")
    pairs = small.repartition("key").sortWithinPartitions("key", "id").mapInArrow(pairs_in_runs, "a bigint, b bigint").distinct()
    return written(pairs, "candidates"), written(keyed.join(large, "key", "left_semi"), "crowded")


def fingerprint_candidates(classes: DataFrame) -> DataFrame:
    """(a, b) of ``classes`` (id, keys, fp), written: sets whose SimHash fingerprints are equal or linked by :func:`simhash.links`.

    Of the sets of one fingerprint, the others meet the smallest, and that meets those of linked fingerprints.
    """
    full = classes.where(F.size("keys") > 0).select("id", "fp")
    heads = written(full.groupBy("fp").agg(F.min("id").alias("a")), "heads")
    equal = full.join(heads, "fp").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b"))
    near = simhash.links(heads.select("fp")).withColumnsRenamed({"a": "_a", "b": "_b"})
    near = near.join(heads.select(F.col("fp").alias("_b"), F.col("a").alias("b")), "_b").join(
        heads.select(F.col("fp").alias("_a"), "a"), "_a").select("a", "b")
    return written(equal.unionByName(near), "candidates")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose similarity is at least ``threshold``, written. Of the two, b is the one that rarely repeats."""
    one, other = (sets.select(F.col("id").alias(n), F.col("shingles").alias(f"_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return written(pairs.join(other, "b").join(one, "a").where(
        shared >= threshold * (F.size("_a") + F.size("_b") - shared) - 1e-9).select("a", "b"), "links")


def _differences(sets: DataFrame, hubs: DataFrame, threshold: float) -> DataFrame:
    """(id, root, size, length, own, missing), written: what each of ``sets`` has more than the example of its crowd, and what less.

    A crowd is what hangs together by ``hubs`` (id, a), sets a that stand for the keys of set id. The hub of most of its sets
    is its example; any set would be right. ``length`` is one more than a set may have that a similar one hasn't.
    """
    crowds = written(components(hubs.select("a", F.col("id").alias("b"))).select(F.col("node").alias("id"), "root"), "crowds")
    heads = hubs.join(crowds, "id").groupBy("root", "a").agg(F.count(F.lit(1)).alias("_n")).groupBy("root").agg(
        F.max_by("a", F.struct("_n", "a")).alias("a"))
    examples = sized(heads.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_h")), "a").select("root", "_h"))
    size = F.size("shingles")
    return written(sets.join(crowds, "id").join(examples, "root").select(
        "id", "root", size.alias("size"), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int").alias("length"),
        F.array_except("shingles", "_h").alias("own"), F.array_except("_h", "shingles").alias("missing")), "own")


def _prefixes(sets: DataFrame, hubs: DataFrame, threshold: float) -> DataFrame:
    """(shingle, id, size, differing, rest) of the first differences of each set, those of others' sets too, written.

    A set's differences are its ``own`` and ``missing`` shingles and an end mark that all sets have: ``differing`` in all,
    ``rest`` of them from the one at hand on. ``shingle`` tells crowds apart. Their order: own ones, missing ones from the
    rarest on, own ones of over ``BUCKET`` sets, the mark. Any order that all sets follow would be right.
    """
    own = _differences(sets, hubs, threshold)
    first = written(own.select("id", "root", F.explode(F.slice("own", F.lit(1), F.col("length"))).alias("shingle")), "first")
    late = sized(first.groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET).select(
        "root", "shingle"))
    found = written(first.join(late, ["root", "shingle"], "left_semi").select("id", "shingle"), "late")
    # Sets that have such a shingle among their first need later ones in its place.
    more = own.where(F.size("own") > F.col("length")).join(sized(found.select("id").distinct()), "id", "left_semi").select(
        "id", "root", F.explode(F.slice("own", F.col("length") + 1, F.size("own"))).alias("shingle"))
    moved = found.unionByName(more.join(late, ["root", "shingle"], "left_semi").select("id", "shingle")).groupBy("id").agg(
        F.collect_list("shingle").alias("_m"))
    lacking = own.select("root", F.explode("missing").alias("shingle")).groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("_n"))
    # A row for each crowd, as long as its example.
    lacking = sized(lacking.groupBy("root").agg(
        F.sort_array(F.collect_list(F.struct("_n", "shingle"))).getField("shingle").alias("_l")))
    none = F.array().cast("array<bigint>")
    both = own.join(moved, "id", "left").join(lacking, "root", "left").withColumns(
        {"_m": F.coalesce("_m", none), "_l": F.coalesce("_l", none)}).withColumn("_o", F.array_except("own", "_m"))
    ordered = F.concat("_o", F.array_intersect("_l", "missing"), F.sort_array("_m"), F.array(F.lit(None).cast("bigint")))
    # One of the first ``length`` own ones is the other's too; where there are fewer, one of the first of all is.
    longer = (F.floor(F.col("size") * ((1 - threshold) / threshold) + 1e-9) + 1).cast("int")
    enough = F.when(F.size("_o") >= F.col("length"), F.col("length")).otherwise(longer)
    rows = both.select("id", "root", "size", (F.size("own") + F.size("missing") + 1).alias("differing"), F.posexplode(
        F.slice(ordered, F.lit(1), enough)).alias("_p", "shingle"))
    first = written(rows.select(F.xxhash64("root", "shingle").alias("shingle"), "id", "size", "differing", (
        F.col("differing") - F.col("_p")).alias("rest")), "prefixes")
    shared = sized(first.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("shingle"))
    return written(first.join(shared, "shingle", "left_semi"), "prefixes")


def _open_groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the ``class`` of their set over the links ``found`` and the largest, ``main``, of their group; written.

    Only of groups with more than one class.
    """
    named = components(found).withColumnRenamed("node", "id")
    classed = written(members.join(named, "id", "left").select(*members.columns, F.coalesce("root", "id").alias("class")), "classes")
    sizes = classed.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("_n"))
    mains = sizes.groupBy("shingle").agg(
        F.max_by("class", F.struct("_n", "class")).alias("main"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    return written(classed.join(sized(mains.select("shingle", "main")), "shingle"), "open")


def _may_be_similar(threshold: float) -> Column:
    """Of rows x and y of one shingle: if it is the first difference that both have, the two differ by no more than a similar pair may."""
    between = F.col("x.differing") + F.col("y.differing") - 2 * F.least("x.rest", "y.rest")
    return between <= (F.col("x.size") + F.col("y.size")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _representatives(open_: DataFrame, count: int, threshold: float) -> DataFrame:
    """(a, b): sets b outside the main class of their groups with ``count`` sets a of the main class that most of these have."""
    main = open_.where(F.col("class") == F.col("main")).select("main", F.col("id").alias("a"), F.col("size").alias("_a")).distinct()
    # Spark limits each task to the first of each class before the shuffle. Other sets for each count.
    order = Window.partitionBy("main").orderBy(F.xxhash64("a", F.lit(count)), "a")
    chosen = main.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count)
    rest = open_.where(F.col("class") != F.col("main")).groupBy("id", "size", "main").agg(F.count(F.lit(1)).alias("_n"))
    rest = rest.groupBy(F.col("id").alias("b"), F.col("size").alias("_b")).agg(F.max_by("main", F.struct("_n", "main")).alias("main"))
    near = F.least("_a", "_b") >= F.greatest("_a", "_b") * threshold - 1e-9
    return written(rest, "outside").join(sized(chosen), "main").where(near).select("a", "b")


def crowd_links(crowded: DataFrame, sets: DataFrame, links_: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among ``sets`` (id, shingles), ``crowded`` (key, id) by their keys, that, with ``links_``, leave no class parted."""
    heads = sized(crowded.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("a")))
    star = crowded.join(heads, "key").where(F.col("a") != F.col("id")).groupBy(F.col("id").alias("b")).agg(
        F.min_by("a", F.xxhash64("a")).alias("a")).select("a", "b")
    found = links_.unionByName(_similar(star, sets, threshold))
    first = _prefixes(sets, written(crowded.join(heads, "key").select("id", "a").distinct(), "hubs"), threshold)
    open_ = _open_groups(first, found)
    for count in REPRESENTATIVES:
        fresh = _similar(_representatives(open_, count, threshold), sets, threshold)
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        open_ = _open_groups(first, found)
    # Frequent shingles are written side by side with the rest, so that Spark may split them.
    x, y = written(open_.where(F.col("class") != F.col("main")), "minor").alias("x"), open_.alias("y")
    # Both in the minority: once.
    once = (F.col("y.class") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    may = F.expr("x.shingle = y.shingle AND x.class != y.class") & once & _may_be_similar(threshold)
    pairs = x.join(y, may).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return found.unionByName(_similar(pairs, sets, threshold))


def links(docs: DataFrame, classes: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of ``classes`` (id, blob, keys, fp) whose similarity is at least ``threshold``: enough of them to connect each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    pairs, crowded = candidates(classes)
    pairs = fingerprint_candidates(classes).unionByName(pairs).distinct()
    ids = crowded.select("id").distinct()
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(ids).distinct()
    # Only the texts that take part are read again, one for each set.
    blobs = sized(classes.join(wanted, "id", "left_semi").select("blob", "id"))
    chosen = texts(docs).withColumn("blob", F.xxhash64("text")).join(blobs, "blob").groupBy("id").agg(
        F.first("text").alias("text"))
    sets = written(chosen.mapInArrow(run, "id bigint, shingles array<bigint>"), "sets")
    found = _similar(pairs, sets, threshold)
    if crowded.isEmpty():
        return found
    return crowd_links(crowded, written(sets.join(ids, "id", "left_semi"), "crowd"), found, threshold)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id): ``component_id`` is the smallest doc_id reachable over links, itself included."""
    prints = written(signatures(docs, words), "signatures")
    # Texts of one set can differ in fingerprint.
    classes = written(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.min(
        F.struct("blob", "fp")).alias("_t")).select("id", "first", "_t.blob", "keys", "_t.fp"), "classes")
    grouped = components(links(docs, classes, words, threshold))
    members = written(grouped.join(classes, F.col("node") == F.col("id")).select("root", "id", "first"), "members")
    lowest = members.groupBy("root").agg(F.min("first").alias("_low"))
    linked = members.join(lowest, "root").select("id", "_low")
    # Written, so that Spark may split the join on a set that many documents have.
    named = written(classes.join(linked, "id", "left").select("id", F.coalesce("_low", "first").alias("component_id")), "named")
    return prints.join(named, "id").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates, as :func:`simhash.first_of_groups` has it."""
    return simhash.first_of_groups(docs, near_duplicates(docs, words, threshold))
