"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A text is cut into pre-tokens, and each pre-token's pairs are the leaves of a
segment tree whose nodes hold the smallest (rank, position) below them. The
root therefore names the leftmost pair of lowest rank. A merge changes three
leaves, each a logarithmic update, so a pre-token of n bytes takes O(n log n)
even if it is a whole text without a space.

Texts are encoded where they are read: no shuffle, memory bounded by one Arrow
batch and two caches of fixed size. A lost task is just run again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logvane.llm.common import id_and_text, texts_of

# White space as the tokenizer's pattern language defines it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The byte-level pattern (fixed value of this tokenizer family).
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|"
    r"[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)
# A single space starts a pre-token unless white space stands on both of its sides.
LONE_SPACE_FAILS = rf"[{WHITE}] [{WHITE}]"

CHUNK_CACHE = 300_000
WORD_CACHE = 1_500_000

_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class MergeTree:
    """Merges one pre-token; ``ranks`` maps a packed pair of ids to its rank."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]) -> None:
        self.ranks: dict[int, int] = {}
        for rank, (left, right) in enumerate(pairs):
            self.ranks.setdefault(left << 32 | right, rank)
        self.merged = merged

    def merge(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        find, merged = self.ranks.get, self.merged
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = find(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        top = tree[1]
        while top != _NONE:
            i = top & _PLACE
            j = after[i]
            k = after[j]
            new = ids[i] = merged[top >> 32]
            ids[j] = -1
            after[i] = k
            a = b = c = size + i
            if j < n - 1:
                tree[size + j] = _NONE
                c = size + j
            if k < n:
                before[k] = i
                rank = find(new << 32 | ids[k])
                tree[b] = _NONE if rank is None else rank << 32 | i
            else:
                tree[b] = _NONE
            h = before[i]
            if h >= 0:
                a = size + h
                rank = find(ids[h] << 32 | new)
                tree[a] = _NONE if rank is None else rank << 32 | h
            # The paths of the three leaves to the root, each shared node once.
            while a > 1:
                a, b, c = a >> 1, b >> 1, c >> 1
                left, right = tree[2 * a], tree[2 * a + 1]
                tree[a] = left if left < right else right
                if b != a:
                    left, right = tree[2 * b], tree[2 * b + 1]
                    tree[b] = left if left < right else right
                if c != b:
                    left, right = tree[2 * c], tree[2 * c + 1]
                    tree[c] = left if left < right else right
            top = tree[1]
        return [x for x in ids if x >= 0]


class ByteBpe:
    """Encodes and decodes texts as the tokenizer file at ``path`` says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        split = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in split]
        self.tree = MergeTree(pairs, [vocab[a + b] for a, b in split])
        self.of_byte = [vocab[c] for c in letters]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.text_of = {i: str(i) for i in self.bytes_of}
        ordered = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, ordered))) if ordered else None
        self.word = regex.compile(PRE_TOKEN).findall
        self.lone = re.compile(LONE_SPACE_FAILS).search
        # Tuples of numbers are of no concern to the garbage collector, lists are.
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORD_CACHE:
                self.words.clear()
            of_byte = self.of_byte
            ids = tuple(self.tree.merge([of_byte[b] for b in word.encode()]))
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def _pieces(self, text: str) -> tuple[int, ...]:
        words = self.word(text)
        if len(words) == 1:
            return self._word(words[0])
        return tuple(chain.from_iterable(map(self._word, words)))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a space and the characters up to the next space."""
        ids = self._pieces(" " + chunk)
        if len(self.chunks) >= CHUNK_CACHE:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = ids
        return ids

    def _wide(self, text: str) -> bool:
        """Whether some space has white space on both sides, as far as a quick look can tell."""
        if text.isascii():
            return any(map(text.__contains__, ("  ", " \n", "\n ", "\t", "\r", "\v", "\f")))
        return self.lone(text) is not None

    def _plain(self, text: str) -> list[int]:
        if self._wide(text):
            return list(self._pieces(text))
        first, *parts = text.split(" ")
        found = list(map(self.chunks.get, parts))
        if None in found:
            found = [self._chunk(c) if x is None else x for x, c in zip(found, parts)]
        return list(chain(self._pieces(first), chain.from_iterable(found)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become their ids."""
        if self.cut is None or "<" not in text and not self.cut.search(text):
            return self._plain(text)
        ids, at = [], 0
        for found in self.cut.finditer(text):
            ids += self._plain(text[at : found.start()])
            ids.append(self.special[found.group()])
            at = found.end()
        return ids + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digits(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer for a Python worker, with its caches."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids of every row; a null text has no ids and stays null.

    Repeated rows and null ids are rows like others; an empty table gives an
    empty result; no other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            column = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], ["doc_id", "text", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of id lists; null lists give empty texts, unknown ids are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            lists = [[i for i in x or () if i in bpe.bytes_of] for x in batch.column(1).to_pylist()]
            text = pa.array([bpe.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    rows = tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them (null: empty).

    Encoding and decoding happen in one pass, so that id lists never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for ids_in, texts in texts_of(batches):
            count, first, second = [], [], []
            for text in texts:
                ids = bpe.encode(text)
                count.append(len(ids))
                first.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids_in, pa.array(count, pa.int64()), pa.array(first), pa.array(second)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
