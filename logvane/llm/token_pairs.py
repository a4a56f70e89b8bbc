"""Both tokenizers' ids of texts, cut into groups where tokens of both end together."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from logvane.llm.common import keeper

_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
# Runs of white space or of anything else this long go to the tokenizers library, which needs no recursion for them.
_LONG_RUN = re.compile(r"\s{2000}|\S{20000}").search


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Printable Latin-1 bytes are their own signs; the others follow from U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Encoded:
    """A slice of texts: per text numbers of tokens and groups and a digest; per link text and pair code."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    row: np.ndarray
    code: np.ndarray


class PairEncoder:
    """Texts under tokenizer A (byte-level BPE, a JSON file) and B (sentencepiece with byte fallback).

    A encodes a space and the text, B the text, to which it adds that space. A
    pair's code is ``b * size_a + a``, so codes sort by B's id first. A's ranks
    are its vocabulary's ids, which the library tiktoken merges several times
    faster than tokenizers and to the same ids.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        self.size_a = max(names.values()) + 1
        sign = _byte_of_sign()
        # Special tokens, whose names are no byte strings of merges, are ordinary text here.
        ranks = {bytes(sign[c] for c in name): i for name, i in names.items() if not name.startswith("<|")}
        self.fast = tiktoken.Encoding(
            "pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.slow = Tokenizer.from_file(path_a)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        self.length_a = np.zeros(self.size_a, np.int64)
        for name, i in ranks.items():
            self.length_a[i] = len(name)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(m[1], 16)]) if (m := _BYTE(p)) else p.replace(_SPACE, " ").encode()
            for p in pieces
        ]
        self.length_b = np.array([len(p) for p in self.bytes_b], np.int64)
        if len(pieces) * self.size_a > 1 << 32:
            raise ValueError("the vocabularies are too large for 32-bit pair codes")
        # An id as text with the sign behind it: more of its side (even), the side's last (odd).
        self.signs = [f"{i}{s}" for i in range(self.size_a) for s in ",|"]
        self.signs += [f"{i}{s}" for i in range(len(pieces)) for s in ",;"]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids; None for a text that has no tokens under the contract."""
        whole = " " + text
        if _LONG_RUN(whole):
            a = np.array(self.slow.encode(whole, add_special_tokens=False).ids, np.int64)
        else:
            a = np.array(self.fast.encode_ordinary(whole), np.int64)
        listed = self.b.encode(text, num_threads=1)
        data = whole.encode()
        # A's tokens are cuts of the bytes themselves; B may change signs that it uses itself.
        if self.length_a[a].sum() != len(data) or b"".join(map(self.bytes_b.__getitem__, listed)) != data:
            return None
        return a, np.array(listed, np.int64)

    def encode(self, texts: Sequence[str | None]) -> Encoded:
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = [(self.ids(t) if t else None) or nothing for t in texts]
        n_a, n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
        a, b = (np.concatenate([x[side] for x in both] or [nothing[0]]) for side in (0, 1))
        # Both sides have the same bytes, so a place counted over all texts lies in the same text.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        size = int(end_a[-1]) + 1 if len(end_a) else 1
        met_a = _marks(end_b, size)[end_a]
        met_b = _marks(end_a, size)[end_b]
        last_a, last_b = np.flatnonzero(met_a), np.flatnonzero(met_b)
        row = np.searchsorted(np.cumsum(n_a), last_a, side="right")
        n_groups = np.bincount(row, minlength=len(texts))
        # In the text of groups, a token stands behind the other side's tokens of earlier groups,
        # and B's also behind A's of its own.
        group_a, group_b = np.cumsum(met_a) - met_a, np.cumsum(met_b) - met_b
        before_b = np.concatenate([[0], last_b + 1])
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_b[group_a]] = 2 * a + met_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * (self.size_a + b) + met_b
        stops = np.cumsum(n_a + n_b)
        digests = [self._digest(out[lo:hi]) for lo, hi in zip(stops - n_a - n_b, stops)]
        return Encoded(n_a, n_b, n_groups, digests, row, b[last_b] * self.size_a + a[last_a])

    def _digest(self, tokens: np.ndarray) -> str:
        if not len(tokens):
            return ""
        listed = "".join(map(self.signs.__getitem__, tokens.tolist()))
        return hashlib.sha256(listed[:-1].encode()).hexdigest()


def _marks(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places] = True
    return out


@keeper
@lru_cache(maxsize=1)
def encoder(path_a: str, path_b: str) -> PairEncoder:
    return PairEncoder(path_a, path_b)
