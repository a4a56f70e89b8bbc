"""Alignment of two tokenizers against the libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logvane.llm import alignment
from logvane.llm.token_pairs import PairEncoder

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, slice string, radix string"
TEXTS = [
    "The cat's  sat\n\n on, the mat.\t12 345",
    None,
    "",
    " ",
    "  two spaces  ",
    "a \n \n b   c <|endoftext|> d<s>e</s>",
    "same text, same text",
    "same text, same text",
    "a sign ▁ that B uses itself",
    "line;\r\nends }\r\n\r\n",
    "é è ñ 漢字 \U0001f600 İ Σς \x1c x \x00 y",
    "x" * 25_000,
    " " * 3000 + "z",
    "the same words over and over. " * 6000,
    *[" ".join(random.Random(i).choices(["the", "of", "Haus", "été", "x1", "--", "an,"], k=60)) for i in range(40)],
]


def brute(texts):
    """Per text: ids of both, ends that meet, groups; then links counted over all texts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in printable}
    sign |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    out, links = [], []
    for text in texts:
        ids = [], []
        if text:
            encoded = a.encode(" " + text, add_special_tokens=False)
            own = [bytes(sign[c] for c in a.id_to_token(i)) for i in encoded.ids], [of_b(i) for i in b.encode(text)]
            if b"".join(own[0]) == b"".join(own[1]) == (" " + text).encode():
                ids = encoded.ids, b.encode(text)
        ends = [np.cumsum([len(x) for x in own[side]]).tolist() if ids[side] else [] for side in (0, 1)]
        at = [{e: k for k, e in enumerate(s)} for s in ends]
        groups, mine, i, j = [], [], 0, 0
        for end in ends[0]:
            if end in at[1]:
                k, m = at[0][end] + 1, at[1][end] + 1
                groups.append(",".join(map(str, ids[0][i:k])) + "|" + ",".join(map(str, ids[1][j:m])))
                mine.append((ids[1][m - 1], ids[0][k - 1]))
                i, j = k, m
        links.append(mine)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append([len(ids[0]), len(ids[1]), len(groups), len(mine), digest])
    counts = Counter(x for mine in links for x in mine)
    most = defaultdict(int)
    for (b_id, _), n in counts.items():
        most[b_id] = max(most[b_id], n)
    rows = [
        (*o[:4], sum(counts[x] == most[x[0]] for x in mine), sum(counts[x] for x in mine), o[4])
        for o, mine in zip(out, links)
    ]
    return rows, counts, most


@pytest.mark.parametrize("least_group", [alignment.LEAST_GROUP, 300])
def test_align_equals_plain_counting(spark, monkeypatch, least_group):
    monkeypatch.setattr(alignment, "LEAST_GROUP", least_group)  # small groups: each radix is split
    monkeypatch.setattr(alignment, "SLICE_ROWS", 7)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, A, B).collect()}
    want = brute(TEXTS)[0]
    assert got == dict(enumerate(want))


def test_pair_counts(spark):
    docs = spark.createDataFrame([(None, t, "x", "y", "z") for t in TEXTS], SCHEMA)
    _, counts, most = brute(TEXTS)
    got = {(r["b"], r["a"]): (r["n"], r["is_best"]) for r in alignment.pair_counts(docs, A, B).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.align(docs, A, B).collect() == []
    only_null = spark.createDataFrame([(1, None, "", "", "")], SCHEMA)
    assert [tuple(r) for r in alignment.align(only_null, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_fast_merges_equal_library():
    """Both byte-level encoders agree on texts of odd signs and white space."""
    code, draw = PairEncoder(A, B), random.Random(11)
    signs = [chr(c) for c in [*range(1, 0x180), 0x1680, 0x2003, 0x2028, 0x3000, 0x301, 0x4E00, 0x1F600, 0x661]]
    signs += list(" \n\t'steTHAN.,;\r") * 9 + ["<s>", "<|endoftext|>", "  ", "'re", " \n"] * 6
    for _ in range(3000):
        text = " " + "".join(draw.choice(signs) for _ in range(draw.randint(1, 40)))
        assert code.fast.encode_ordinary(text) == code.slow.encode(text, add_special_tokens=False).ids


def test_merge_sums_runs_of_any_blocks():
    draw = np.random.default_rng(4)
    for _ in range(200):
        runs, total = [], Counter()
        for _ in range(draw.integers(0, 6)):
            pair = np.sort(draw.integers(0, 30, draw.integers(1, 40)))
            n = draw.integers(1, 5, len(pair))
            for p, k in zip(pair.tolist(), n.tolist()):
                total[p] += k
            cuts = np.sort(draw.integers(0, len(pair) + 1, 3))
            blocks = [(p, k) for p, k in zip(np.split(pair, cuts), np.split(n, cuts)) if len(p)]
            runs.append(iter([alignment._summed(p, k) for p, k in blocks]))
        got = [(int(p), int(k)) for pair, n in alignment.merged(runs) for p, k in zip(pair, n)]
        assert got == sorted(total.items())
