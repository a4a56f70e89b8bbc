"""Vector bin packing of token sequences by the dot-product heuristic.

Every item has three demands: tokens, segments (one) and loss-bearing tokens,
and every sequence three limits. One sequence is filled at a time: of the items
that fit, it takes the one whose demand vector has the largest dot product with
what is left of the limits, both as shares of the limits. A task keeps a pool of
bounded size, so memory doesn't grow with its input and nothing is shuffled.
Sequence ids join the partition's number to a running number, so a task that is
run again after a loss gives the same ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, keeper, texts_of

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
POOL = 512
CACHE = 700_000
_ID = 4  # bytes of one id
_GAP = "<|startoftext|>"
# Strings of text that need the library whole: special tokens and the separators it keeps.
_UNUSUAL = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
# A word of plain letters, which lower-case one by one, and perhaps a run of signs behind it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch


class WordEncoder:
    """Ids of texts as little-endian bytes, with a cache of white-space separated strings.

    The tokenizer drops white space and merges nothing across it, so a text's
    ids are those of its strings in turn. Unknown strings go to the tokenizers
    library together: words of plain letters joined by spaces, since each ends
    with an id that ends words, and others parted by a special token. Texts
    with special tokens or rare separator characters go there whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.gap = self.library.token_to_id(_GAP)
        ends = [t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        encoded = self.library.encode(text, add_special_tokens=False)
        return np.array(encoded.ids, dtype="<u4")

    def _parted(self, ids: np.ndarray, last: np.ndarray, skip: int) -> list[bytes]:
        """Ids cut behind every place in ``last``, without the ``skip`` ids there."""
        raw, stops = ids.tobytes(), ((last + 1) * _ID).tolist()
        return [raw[a : b - skip * _ID] for a, b in zip([0, *stops], stops)]

    def _learn(self, strings: list[str]) -> None:
        plain, odd, words = [], [], self.words
        for string in strings:
            found = _PLAIN(string)
            if found:
                word, sign = found.groups()
                plain.append((string, word.lower(), sign))
            else:
                odd.append(string)
        lower = {p[1] for p in plain}
        new = lower.difference(words)
        if len(words) + len(new) > CACHE:
            words.clear()
            new = lower
        for part in _slices(list(new)):
            ids = self._whole(" ".join(part))
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                words.update(zip(part, self._parted(ids, last, 0)))
            else:
                words.update((w, self._whole(w).tobytes()) for w in part)
        signs = {s: self._whole(s).tobytes() for s in {p[2] for p in plain}}
        known = self.known
        known.update((string, words[word] + signs[sign]) for string, word, sign in plain)
        for part in _slices(odd):
            ids = self._whole(_GAP.join([*part, ""]))
            known.update(zip(part, self._parted(ids, np.flatnonzero(ids == self.gap), 1)))

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [
            None if self.gap is None or any(map(t.__contains__, _UNUSUAL)) else t.split()
            for t in texts
        ]
        known = self.known
        used = set().union(*filter(None, split))
        new = used.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = used
        self._learn(list(new))
        look = known.__getitem__
        return [
            self._whole(t).tobytes() if s is None else b"".join(map(look, s))
            for s, t in zip(split, texts)
        ]


def _slices(strings: list[str], size: int = 2000) -> list[list[str]]:
    return [strings[at : at + size] for at in range(0, len(strings), size)]


@keeper
@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Packs items into sequences under limits on tokens, segments and loss-bearing tokens.

    With ``cut`` an item may be split wherever a limit asks for it; then
    sequences are filled to the last token, and what cannot fill a whole
    sequence goes into sequences whose lengths are powers of two. Without it
    items stay whole, and one that exceeds the limits by itself gets a
    sequence of its own.
    """

    def __init__(self, limits: tuple[int, int, int], cut: bool, pool: int = POOL) -> None:
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array(limits, float)
        self.cut, self.pool = cut, pool
        self.items: list = []
        self.demand = np.zeros((2 * pool + 2, 3))

    def add(self, item: object, tokens: int, loss: int) -> Iterator[list]:
        """Take in one item; yields the sequences that are full."""
        self.demand[len(self.items)] = tokens, 1, loss
        self.items.append((item, 0, tokens, loss))
        if len(self.items) >= 2 * self.pool:
            while len(self.items) > self.pool:
                yield from self._fill()

    def finish(self) -> Iterator[list]:
        while self.items:
            yield from self._fill()

    def _take(self, k: int) -> tuple:
        """Remove item k: the last one takes its place."""
        out, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.demand[k] = self.demand[len(self.items)]
        return out

    def _fill(self) -> Iterator[list]:
        left, parts = self.limits.copy(), []
        scale = 1 / self.limits**2
        while self.items and left.min() >= (1 if self.cut else 0) and left[1] >= 1:
            demand = self.demand[: len(self.items)]
            score = demand @ (left * scale)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                item, start, tokens, loss = self._take(int(np.where(fits, score, -1).argmax()))
                parts.append((item, start, tokens))
                left -= (tokens, 1, loss)
            elif self.cut:
                k = int(score.argmax())
                item, start, tokens, loss = self.items[k]
                size = int(min(left[0], left[2] + tokens - loss, tokens - 1))
                if size < 1:
                    break
                parts.append((item, start, size))
                # What a cut leaves starts a new segment, whose first token again bears no loss.
                bare = tokens - loss
                left -= (size, 1, max(0, size - bare))
                rest = tokens - size
                self.items[k] = (item, start + size, rest, max(0, rest - bare))
                self.demand[k] = rest, 1, max(0, rest - bare)
            else:
                break
        if not parts:
            item, start, tokens, _ = self._take(int(self.demand[: len(self.items), 0].argmax()))
            parts.append((item, start, tokens))
        yield from self._powers(parts) if self.cut else [parts]

    def _powers(self, parts: list) -> Iterator[list]:
        """A full sequence as it is; else pieces whose sums are powers of two, largest first."""
        total = sum(p[2] for p in parts)
        if total == int(self.limits[0]):
            yield parts
            return
        parts = parts[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out = []
            while room:
                item, start, size = parts.pop()
                used = min(size, room)
                out.append((item, start, used))
                if used < size:
                    parts.append((item, start + used, size - used))
                room -= used
            yield out


def _first_id() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def pack_examples(
    examples: DataFrame,
    id_col: str,
    tokens_col: str,
    loss_col: str,
    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS),
    pool: int = POOL,
) -> DataFrame:
    """Place whole examples into sequences: example_id, sequence_id, segment, offset, tokens, loss.

    Null counts are taken as 0; examples of no tokens still get a place.
    Examples over a limit stand alone, so that none is lost. Repeated ids are
    separate examples; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, cut=False, pool=pool), _first_id()

        def rows(full: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out = []
            for parts in full:
                at = 0
                for place, ((key, tokens, loss), _, _) in enumerate(parts):
                    out.append((key, number, place, at, tokens, loss))
                    at += tokens
                number += 1
            if out:
                kinds = [kind, *[pa.int64()] * 5]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["example_id", "sequence_id", "segment", "offset", "tokens", "loss_tokens"]
        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            full = []
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                full += packer.add((key, tokens, loss), tokens, loss)
            yield from rows(full)
        yield from rows(packer.finish())

    count = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)) for c in (tokens_col, loss_col)]
    rows = examples.select(F.col(f"`{id_col}`").alias("example_id"), *count)
    key = rows.schema["example_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"example_id {key}, sequence_id long, segment long, offset long, tokens long, "
        "loss_tokens long",
    )


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize, end and cut documents, and pack the pieces: one row for each piece.

    A document is cut into full sequences; what is left goes through the
    dot-product packer, cut again where that fills a sequence. The first token
    of a piece has nothing to be predicted from, so a piece of n tokens bears
    n - 1 losses. ``with_ids`` adds the piece's ids. Null texts count as empty
    and still have their end id; repeated rows are packed each by itself;
    an empty table gives an empty result.
    """
    size = limits[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path), np.array([end_id], "<u4").tobytes()
        packer, number, kind = Packer(limits, cut=True), _first_id(), pa.null()
        out: list[tuple] = []

        def put(full: list | Iterator) -> None:
            nonlocal number
            for parts in full:
                at = 0
                for (key, ids, base, total), start, length in parts:
                    own = ids[start * _ID : (start + length) * _ID]
                    row = (key, base + start, length, zlib.crc32(own), total, number, at)
                    out.append((*row, np.frombuffer(own, "<u4").astype(int)) if with_ids else row)
                    at += length
                number += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [kind, *[pa.int64()] * 6, pa.list_(pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                out.clear()
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        names += ["ids"] * with_ids
        for keys, texts in texts_of(batches):
            kind = keys.type
            for at in range(0, len(texts), 256):
                part = zip(keys[at : at + 256].to_pylist(), code.batch(texts[at : at + 256]))
                for key, ids in part:
                    ids += end
                    total = len(ids) // _ID
                    whole = total - total % size if limits[2] >= size - 1 else 0
                    put([((key, ids, 0, total), a, size)] for a in range(0, whole, size))
                    if rest := total - whole:
                        item = (key, ids[whole * _ID :], whole, total)
                        put(packer.add(item, rest, rest - 1))
                if len(out) > 5000:
                    yield from flush()
        put(packer.finish())
        yield from flush()

    rows = id_and_text(docs, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + ", ids array<long>" * with_ids,
    )
