"""Packing: documents end to end in sequences of a fixed number of tokens.

Concatenate and cut in two passes. The first pass tokenises each partition and keeps, per document,
its ids and where it starts among the tokens of its partition. The totals of the partitions, one row
each, are summed up to the offsets of the partitions. The second pass adds the two and cuts each
document at the multiples of the sequence length. A window that reaches over the end of a
partition gets pieces from both sides (``boundary``); they carry the same sequence id and gapless
offsets, so nothing moves between tasks. Only the totals are shuffled.

Cases: null or empty text gives the end id alone; repeated rows and ids are documents of their own;
an empty table gives no piece; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.llm.common import texts
from logspark.session import written

LENGTH = 1024
END_ID = 0
#: Words kept with their ids in one Python worker; some 100 MB. When full, the memory starts anew.
MEMORY_WORDS = 600_000
#: Output of one Arrow batch.
BATCH_BYTES = 8 << 20

class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, by the tokenizer at ``path``.

    A byte-level tokenizer of this kind ends a token group before a space that follows a character other than white space.
    So a text is its words, each with the space before it, one after the other, and each different word is
    encoded once. Where white space stands before such a space, or a special token's name in the text, the whole
    text is encoded at once. ``ranks`` names the file of the same vocabulary for the faster of the two libraries; with
    it, new words go there (equal ids).
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of words with a space before them.
        self.memory: dict[str, bytes] = {}
        self.add = _by_ranks(ranks) if ranks else self._add

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def _add(self, words: list[str], memory: dict[str, bytes]) -> None:
        led = [" " + word for word in words]
        for word, found in zip(words, self.tokenizer.encode_batch_fast(led, add_special_tokens=False)):
            memory[word] = _packed(found.ids)

    def encode(self, text: str) -> bytes:
        body = text.rstrip()
        head, *words = body.split(" ")
        if not words or head[-1:].isspace() or any(special in text for special in self.specials):
            return self.whole(text)
        last = " " + words.pop() + text[len(body):]
        memory = self.memory
        found = list(map(memory.get, words))
        if None in found:
            new = {word for word, ids in zip(words, found) if ids is None}
            if any(not word or word[-1].isspace() for word in new):
                return self.whole(text)
            if len(memory) + len(new) > MEMORY_WORDS:
                memory.clear()
                new = set(words)
            self.add(list(new), memory)
            found = [memory[word] for word in words]
        return b"".join([self.whole(head), *found, self.whole(last)])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _by_ranks(path: str):
    """A function that adds the ids of many space-led words to a dictionary.

    They are encoded in one go; the byte lengths of the ids tell where each word ends.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    encode = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def add(words: list[str], memory: dict[str, bytes]) -> None:
        led = [" " + word for word in words]
        ids = np.array(encode("".join(led)), "<u4")
        ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(word.encode()) for word in led])) + 1
        packed, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            memory[word] = packed[start:end]
            start = end

    return add


#: One encoder, with its memory, for all tasks of a Python worker.
_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, ranks: str | None = None) -> WordEncoder:
    if (path, ranks) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, ranks] = WordEncoder(path, ranks)
    return _ENCODERS[path, ranks]


def tokenised(docs: DataFrame, path: str, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, before, doc_tokens, ids): ``before`` counts the tokens earlier in the same part."""
    schema = "part int, doc_id bigint, before bigint, doc_tokens bigint, ids binary"
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(path, ranks).encode
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                count = len(ids) // 4
                rows.append((part, doc_id, before, count, ids))
                before += count
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return texts(docs).mapInArrow(run, schema)


_TYPES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind.type) for column, kind in zip(zip(*rows), _TYPES)], schema=_TYPES)


def pack(
    docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, boundary,
    sequence_tokens, padded_to.

    Every sequence but the last is full. The last is padded to ``length`` unless its size is a power of
    two. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    parts = written(tokenised(docs, path, ranks, end_id), "tokens")
    totals = parts.groupBy("part").agg(F.sum("doc_tokens").alias("_n"))
    # One row per task of the first pass, whatever the number of rows.
    upto, whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(0)).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_from"), F.col("_n").alias("_size"),
        F.sum("_n").over(whole).alias("_all"))
    placed = parts.join(F.broadcast(offsets), "part").withColumn("_at", F.col("_from") + F.col("before"))
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("doc_tokens") - 1) / length)
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    opens = F.col("sequence_id") * length
    begin = F.greatest(F.col("_at"), opens)
    end = F.least(F.col("_at") + F.col("doc_tokens"), opens + length)
    tokens = F.least(F.lit(length).cast("bigint"), F.col("_all") - opens)
    return pieces.select(
        "doc_id",
        (begin - F.col("_at")).alias("start"),
        (end - begin).alias("length"),
        F.substring("ids", (4 * (begin - F.col("_at")) + 1).cast("int"), (4 * (end - begin)).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (begin - opens).alias("offset"),
        ((opens < F.col("_from")) | (opens + length > F.col("_from") + F.col("_size"))).alias("boundary"),
        tokens.alias("sequence_tokens"),
        F.when(tokens.bitwiseAND(tokens - 1) == 0, tokens).otherwise(F.lit(length)).cast("bigint").alias("padded_to"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each sequence joined; a sequence has ``length`` ids at most."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.array_join(ordered, "")).alias("ids"))
