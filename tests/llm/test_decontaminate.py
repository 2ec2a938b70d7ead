import re

from brute import messy
from logspark.llm import decontaminate


def words_of(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def runs(words, size):
    return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if size else set()


def brute(docs, items, threshold=0.8):
    """Items of fewer than five words are one run of their own size, and looked for as that."""
    held = {i: words_of(t) for i, t in docs}
    cut = {size: {i: runs(w, size) for i, w in held.items()} for size in {min(5, len(words_of(t))) for _, t in items}}
    found = set()
    for k, t in items:
        words = words_of(t)
        q = runs(words, min(5, len(words)))
        for i, d in cut[min(5, len(words))].items():
            if q and len(q & d) / len(q) >= threshold:
                found.add((i, k, len(q & d), len(q)))
    return found


def test_whole_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {tuple(r)[:4] for r in decontaminate.contained(docs, items).collect()}
    assert got == want and len(want) > 10


def test_partial_items_at_every_size(spark):
    words = [f"w{n}" for n in range(400)]
    items, docs = [], []
    for size in (3, 5, 6, 9, 24, 25, 60, 300):
        item = [f"i{size}{w}" for w in words[:size]]
        items.append((size, " ".join(item)))
        for kept in {0, size // 2, size - 3, size - 1, size}:
            docs.append((size * 1000 + kept, "Start. " + " ".join(words) + "\n" + ", ".join(item[:max(kept, 0)]) + " end"))
    given = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r)[:4] for r in decontaminate.contained(messy(spark, docs, "hash"), given).collect()}
    assert got == brute(docs, items)


def test_nulls_repeats_and_clashing_names(spark):
    item = "the quick brown fox jumps over"
    docs = messy(spark, [(1, f"x {item.upper()}!"), (1, f"x {item}"), (None, item), (2, None), (3, ""), (4, "quick brown")],
                 "item_id")
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (None, item, 1)],
                                  "item_id bigint, text string, doc_id int")
    assert [tuple(r) for r in decontaminate.contained(docs, items).collect()] == [(1, 7, 2, 2, 1.0)]
    assert sorted((r.doc_id or 0) for r in decontaminate.without_leaks(docs, items).collect()) == [0, 2, 3, 4]
    assert decontaminate.contained(docs.limit(0), items).collect() == []
    assert decontaminate.contained(docs, items.limit(0)).collect() == []
    assert decontaminate.without_leaks(docs, items).columns == docs.columns


def test_short_items_are_found_as_runs_of_words(spark):
    items = spark.createDataFrame(
        [(1, "Photosynthesis"), (2, "forty-two bits"), (3, "x y z"), (4, "to be or not"), (5, "今天天气怎么样"), (6, "你好"),
         (7, "not there")], "item_id bigint, text string")
    docs = messy(spark, [
        (1, "We explain photosynthesis, step by step, to all."), (2, "It takes forty two bits to say so."),
        (3, "a b x y z c d"), (4, "a b x y c z d"), (5, "The line 'To be, or not' is old."), (6, "我想知道今天天气怎么样，谢谢。"),
        (7, "他说你好然后走了很远的路"), (8, "photosynthesises and x y"), (9, "x y z")])
    got = {tuple(r) for r in decontaminate.contained(docs, items).select("doc_id", "item_id", "containment").collect()}
    assert got == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (9, 3, 1.0), (5, 4, 1.0), (6, 5, 1.0), (7, 6, 1.0)}


def test_the_sketch_picks_the_candidates(spark):
    item = " ".join(f"w{n}" for n in range(60))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    sketch = decontaminate.sketches(decontaminate.item_shingles(items))
    chosen = {r.hash for r in sketch.collect()}
    assert len(chosen) == 13  # 56 shingles, partition 32 to 63: floor(0.2 * 63) + 1
    docs = spark.createDataFrame([(n, " ".join(item.split()[n:n + 5])) for n in range(56)], "doc_id bigint, text string")
    found = {r.doc_id for r in decontaminate.candidates(docs, sketch, []).collect()}
    assert len(found) == 13 and decontaminate.contained(docs, items).collect() == []


def test_a_long_text_goes_in_slices(spark):
    words = [f"w{n}" for n in range(200_000)]
    at = decontaminate.SLICE - 4
    items = spark.createDataFrame([(n, " ".join(words[m:m + 12])) for n, m in enumerate((0, at, 199_988))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.contained(docs, items).collect())
    assert got == [(1, n, 8, 8, 1.0) for n in range(3)]
