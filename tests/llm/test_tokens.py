"""Encoding against the tokenizers library; packing by its own invariants."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logvane.llm import bpe, packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string, score double"
TEXTS = [
    "The cat's  sat\n\n on, the mat.\t12 345",
    None,
    "",
    " ",
    "a \n \n b   c <|endoftext|> d<|startoftext|>",
    "same text",
    "same text",
    "é è ñ 漢字 \U0001f600 İ Σς \x1c x",
    "x" * 5000,
    "word " * 9000,
    "it's it' don't. a!! b,*** C###d THE!! x`~ É. y[z] ... ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 6 else i, t, "ids", "start", 0.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


def test_merge_tree_equals_library():
    library, own = Tokenizer.from_file(BYTE_BPE), bpe.tokenizer(BYTE_BPE)
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(0x180), 0x1680, 0x2003, 0x3000, 0x301, 0x4E00, 0x1F600]]
    letters += list(" \n\t'steTHAN") * 8 + ["<|endoftext|>", "  ", "'re", " \n"] * 6
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip(docs):
    library = Tokenizer.from_file(BYTE_BPE)
    got = bpe.round_trip(docs, BYTE_BPE).collect()
    want = []
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        want.append((None if i == 6 else i, len(ids), *digests))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_encode_then_decode(docs):
    back = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for t in TEXTS)
    assert bpe.round_trip(docs.limit(0), BYTE_BPE).count() == 0


def check_pieces(rows, want):
    """Each id in one piece, gapless sequences of at most 2048, full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            own = want[key][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(want[key])
            assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += p["length"]
        assert at == len(want[key])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0
        assert len(pieces) <= packing.MAX_SEGMENTS


def test_pack_documents(docs):
    library = Tokenizer.from_file(WORD_BPE)
    named = docs.fillna({"doc_id": 6})
    want = {
        i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)
    }
    check_pieces(packing.pack_documents(named, WORD_BPE).collect(), want)
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0
    assert packing.pack_documents(docs, WORD_BPE).where("doc_id is null").count() >= 1


def test_pack_real_documents(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    library = Tokenizer.from_file(WORD_BPE)
    want = {
        r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        for r in docs.collect()
    }
    check_pieces(packing.pack_documents(docs, WORD_BPE).collect(), want)


def test_tiny_documents_hit_the_segment_limit(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'a' as text")
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    assert sum(r["length"] for r in rows) == 6000
    check_pieces(rows, {i: [320, 1] for i in range(3000)})


def test_pack_examples_keeps_every_limit(spark):
    draw = random.Random(3)
    rows = [(i % 900, draw.randint(0, 900), draw.randint(0, 300)) for i in range(2000)]
    rows += [(None, None, 5), (7, 5000, 1)]
    examples = spark.createDataFrame(rows, "key long, offset long, segment long")
    got = packing.pack_examples(examples, "key", "offset", "segment", (2048, 6, 500)).collect()
    assert len(got) == len(rows)
    sums = defaultdict(lambda: [0, 0, 0])
    for r in got:
        s = sums[r["sequence_id"]]
        assert r["segment"] < 6
        s[0] += r["tokens"]
        s[1] += 1
        s[2] += r["loss_tokens"]
    assert all(s[1] == 1 or s[0] <= 2048 and s[1] <= 6 and s[2] <= 500 for s in sums.values())
    bound = max(sum(r[1] or 0 for r in rows) / 2048, len(rows) / 6, sum(r[2] for r in rows) / 500)
    assert len(sums) <= 1.15 * bound + 2
