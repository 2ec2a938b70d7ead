import struct

import public_tokenizers
from tokenizers import Tokenizer

from brute import messy
from logspark.llm import packing

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_encoder_gives_the_tokenizers_ids():
    plain = Tokenizer.from_file(PATHS[0])
    for encoder in (packing.WordEncoder(*PATHS), packing.WordEncoder(PATHS[0])):
        for text in ("", " ", "  ", "a  b", "a \n b", "don't we'll", "Éa 中文,x\n\ny z", "a\x1c b", "x <|endoftext|> y",
                     " lead", "trail ", "tab\tx y　z", "123 4a5 !?"):
            ids = plain.encode(text, add_special_tokens=False).ids
            assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_rebuild_every_document(spark):
    plain = Tokenizer.from_file(PATHS[0])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack(docs.repartition(7), *PATHS, length=64).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        ids = plain.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert b"".join(bytes(p.ids) for p in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length for p in own)
        assert [p.start for p in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, own in by_sequence.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
        total = sum(p.length for p in own)
        assert total == 64 or number == len(by_sequence) - 1
        assert {p.sequence_tokens for p in own} == {total}
        assert {p.padded_to for p in own} == {total if total & (total - 1) == 0 else 64}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(docs, *PATHS, length=64)).collect()}
    assert {len(x) for x in list(whole.values())[:-1]} <= {256, len(whole[max(whole)])}


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (1, ""), (None, "word"), (4, "a b " * 50)]
    got = packing.pack(messy(spark, rows, "ids"), *PATHS, length=16).collect()
    assert sum(p.length for p in got) == 1 + 1 + 2 + 102
    assert packing.pack(messy(spark, rows).limit(0), *PATHS).collect() == []
