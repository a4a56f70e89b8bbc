"""Repeated substrings across documents, by suffix arrays over the places where texts part.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.

*Anchors.* Of every text the hashes of all K-byte strings are taken, and the
least of each window of W is an anchor (K + W - 1 = ``length``). Equal strings of
``length`` bytes have the same anchor at the same place, so documents that
share one meet at an anchor's hash. Around an anchor stands its context: all
strings of ``length`` bytes that contain it.

*Equal contexts.* Anchors travel packed by ranges of their hash. Where two
documents have the same context, all of it goes from the larger id; this
settles the inside of copies and of shared passages, and a task does it for its
own documents before anything is shuffled. Only one document for each
different context is left open.

*Suffix arrays.* Open contexts of an anchor differ somewhere. Their texts are
fetched, cut down to what they share with another context of the anchor at
most, joined, and sorted with the linear grouping of ``suffix_array``. Equal
strings stand side by side in it, and the smallest id of a run keeps the string.
An anchor with very many contexts is dealt to several suffix arrays by what
ranges of its strings have in common; strings that are then still open are settled by a grouping.

Memory is bounded by a batch, a hash range or a bucket, each of which has a
planned size; results are written between the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, mix, prefix_hash, slices, span_hash
from logvane.llm.suffix_array import suffix_array
from logvane.session import materialize

LENGTH = 50
ANCHOR = 20
# Anchors of a hash range, open contexts of a suffix array, and contexts from which an anchor
# is dealt to several.
RANGE_ANCHORS = 1_200_000
# Bytes of texts whose anchors are looked for together.
TOGETHER = 1 << 15
BUCKET = 4096
SPLIT = 4096
# Ranges of turns in which the contexts of such an anchor are held against each other.
TURN_RANGES = 4
# So often contexts that equal a smaller document's are taken out before the rest is sorted.
ROUNDS = 20
# Up to so many spans (16 bytes each) may be broadcast; more are joined by shuffling.
BROADCAST_SPANS = 1_000_000

_LAST = (1 << 63) - 1
_PACKED = ("h", "c", "doc", "version", "q")


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Text number, place, hash and context hash of the texts' anchors; short texts have none."""
    w = length - k + 1
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(sizes.sum())
    if n < length:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none
    sums = prefix_hash(np.frombuffer(b"".join(texts), np.uint8))
    # Strings and windows that run from one text into the next do not count.
    left = np.repeat(ends, sizes) - np.arange(n)
    at = np.arange(n - k + 1)
    grams = span_hash(sums, at, at + k)
    grams[left[: n - k + 1] < k] = ~np.uint64(0)
    low = _window_min(grams, w)
    low[left[: n - length + 1] < length] = 0
    # A string is an anchor if it is the least of some window that holds it; ties are all taken.
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    places = np.flatnonzero(~_window_min(~wide, w) == grams)
    text = np.searchsorted(ends, places, "right")
    begin = ends[text] - sizes[text]
    start, stop = np.maximum(places - (w - 1), begin), np.minimum(places + length, ends[text])
    sides = ((places - start) * 128 + (stop - places)).astype(np.uint64)
    # Least hashes are small numbers; mixed again they fill the whole range evenly.
    return text, places - begin, mix(grams[places]), mix(span_hash(sums, start, stop) + sides)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: small numbers leave runs of zeros for the compressor."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _spans_of(doc, version, q, length: int, k: int) -> dict[str, np.ndarray]:
    """Whole contexts as spans; what runs over a text's end is clipped when spans are applied."""
    return {"doc": doc, "version": version, "lo": np.maximum(q - (length - k), 0), "hi": q + length}


def _numbered(rows: list[int], texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """The texts' anchors with the rows of the texts."""
    text, *found = anchors(texts, length, k)
    return np.array(rows, np.int64)[text], *found


def _collect_anchors(rows: DataFrame, length: int, k: int, ranges: int) -> DataFrame:
    """range, base, data: packed anchors; spans that the task could settle have ranges below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in slices(batches, 1 << 16):
            turn += 1
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            version = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2)
            # Ascending ids, so that a stable sort keeps the smallest of equal contexts first.
            seen, at, group, held, parts = set(), [], [], 0, []
            for i in np.argsort(doc, kind="stable"):
                key = (doc[i], version[i])
                if key in seen:
                    continue
                seen.add(key)
                at.append(i)
                group.append(texts[int(i)].as_py().encode("utf-8", "surrogatepass"))
                held += len(group[-1])
                if held >= TOGETHER:
                    parts.append(_numbered(at, group, length, k))
                    at, group, held = [], [], 0
            parts.append(_numbered(at, group, length, k))
            row, q, h, c = (np.concatenate(x) for x in zip(*parts))
            if not len(h):
                continue
            c &= np.uint64((1 << 48) - 1)
            order = np.lexsort((c, h))
            h, c, row, q = h[order], c[order], row[order], q[order]
            own, kind = doc[row], version[row]
            new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            first = own[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            settled = own > first
            if settled.any():
                s = _spans_of(own[settled], kind[settled], q[settled], length, k)
                merged = _merge(**s)
                data = b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in merged)
                yield _packed_batch([-1 - turn % ranges], [0], [data])
            h, c, q, own, kind = (x[~settled] for x in (h, c, q, own, kind))
            base = int(own.min())
            part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(h)]):
                steps = np.diff(h[a:b], prepend=np.uint64(0))
                columns = (
                    steps, c[a:b], (own[a:b] - base).view(np.uint64), kind[a:b].view(np.uint64),
                    q[a:b].astype(np.uint64),
                )
                out.append(b"".join(map(_planes, columns)))
            yield _packed_batch(part[cuts].astype(np.int32).tolist(), [base] * len(out), out)

    return rows.mapInArrow(run, "range int, base long, data binary")


def _packed_batch(part: list, base: list, data: list) -> pa.RecordBatch:
    columns = [pa.array(part, pa.int32()), pa.array(base, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "base", "data"])


def _merge(doc, version, lo, hi) -> tuple[np.ndarray, ...]:
    """Join spans of a document that overlap or touch."""
    order = np.lexsort((lo, version, doc))
    doc, version, lo, hi = doc[order], version[order], lo[order], hi[order]
    same = np.append(False, (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]))
    # Shift each document beyond the one before, so that one running maximum serves all.
    shift = np.cumsum(~same) * (int(hi.max(initial=0)) + 1)
    reach = np.maximum.accumulate(hi + shift)
    begins = np.append(True, (lo + shift)[1:] > reach[:-1]) | ~same
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], version[at], lo[at], (reach - shift)[ends]


_SETTLED = "doc long, version long, lo int, hi int, h long, c long, parts int"


def _settled_table(doc, version, lo, hi, h=None, c=None, parts=None) -> pa.Table:
    """Spans; rows with ``parts`` above 0 are open contexts with their place in ``lo``."""
    zero = np.zeros(len(doc), np.int64)
    columns = [doc, version, lo, hi, h, c, parts]
    names = [x.split()[0] for x in _SETTLED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    arrays = [pa.array(zero if x is None else x).cast(t) for x, t in zip(columns, kinds)]
    return pa.Table.from_arrays(arrays, names)


def _settle_range(table: pa.Table, length: int, k: int, split: int) -> pa.Table:
    """Spans of equal contexts in different documents, and one row for each open context."""
    if table.column("range")[0].as_py() < 0:
        found = [np.frombuffer(x, np.int64).reshape(4, -1) for x in table.column("data").to_pylist()]
        return _settled_table(*_merge(*np.concatenate(found, axis=1)))
    parts = []
    for base, data in zip(table.column("base").to_pylist(), table.column("data").to_pylist()):
        n = len(data) // (8 * len(_PACKED))
        h, c, doc, version, q = (_unplanes(data[8 * n * i : 8 * n * (i + 1)]) for i in range(len(_PACKED)))
        h = np.cumsum(h, dtype=np.uint64)
        parts.append((h, c, doc.view(np.int64) + base, version.view(np.int64), q.view(np.int64)))
    h, c, doc, version, q = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((doc, c, h))
    h, c, doc, version, q = h[order], c[order], doc[order], version[order], q[order]
    new_h = np.append(True, h[1:] != h[:-1])
    new = new_h | np.append(True, c[1:] != c[:-1])
    first = doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    settled = doc > first
    starts = np.flatnonzero(new_h)
    group = np.cumsum(new_h) - 1
    contexts = np.add.reduceat(new.astype(np.int64), starts)
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    is_open = ((contexts > 1) & several)[group] & ~settled
    s = _spans_of(doc[settled], version[settled], q[settled], length, k)
    deal = (contexts[group] + split - 1) // split
    return pa.concat_tables(
        [
            _settled_table(**s),
            _settled_table(
                doc[is_open], version[is_open], q[is_open], q[is_open], h[is_open].view(np.int64),
                c[is_open].view(np.int64), deal[is_open],
            ),
        ]
    )


def _contexts(rows: DataFrame, open_rows: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """bucket, h, parts, doc, version, places and the bytes on either side of the anchor.

    A context of an anchor that has too many (``parts`` above 1) becomes one row for
    each range of turns, cut down to that range's strings, with a hash of what is in all
    of them in place of the anchor's. Equal strings still meet, and most others do not.
    """
    wanted = open_rows.groupBy("doc", "version").agg(
        F.collect_list(F.struct("lo", "h", "c", "parts")).alias("wanted")
    )
    slack = length - k
    turns = np.array_split(np.arange(slack + 1), min(TURN_RANGES, slack + 1))
    names = ["bucket", "h", "parts", "doc", "version", "places", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            wanted = batch.column(3)
            row = np.repeat(np.arange(len(data)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            lo, h, c, parts = (wanted.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((lo, c, h, row))
            row, lo, h, c, parts = (x[order] for x in (row, lo, h, c, parts))
            same = (row[1:] == row[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            first = np.flatnonzero(np.append(True, ~same)[: len(row)])
            ends = np.append(first[1:], len(row))
            row, h, parts, q = row[first], h[first], parts[first], lo[first].tolist()
            left = [data[r][max(at - slack, 0) : at] for r, at in zip(row.tolist(), q)]
            right = [data[r][at + k : at + length] for r, at in zip(row.tolist(), q)]
            out = [(np.flatnonzero(parts == 1), h, left, right)]
            many = np.flatnonzero(parts > 1)
            if len(many):
                sums, left_n, right_n = _beside([left[i] for i in many], [right[i] for i in many], slack)
                for low, high in ((x[0], x[-1]) for x in turns):
                    fits = np.flatnonzero((left_n >= low) & (right_n >= slack - high))
                    start = fits * (2 * slack) + slack - low
                    core = span_hash(sums, start, start + slack + low - high)
                    core += mix(h[many[fits]].view(np.uint64) + np.uint64(low + 1))
                    cut_l = [left[i][max(len(left[i]) - high, 0) :] for i in many[fits]]
                    cut_r = [right[i][: slack - low] for i in many[fits]]
                    out.append((many[fits], mix(core).view(np.int64), cut_l, cut_r))
            for n, (at, key, lefts, rights) in enumerate(out):
                if not len(at):
                    continue
                if not n:
                    key, lefts, rights = key[at], [lefts[i] for i in at], [rights[i] for i in at]
                sizes = ends[at] - first[at]
                places = lo[np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
                starts = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                bucket = mix(key.view(np.uint64)) % np.uint64(buckets)
                columns = [
                    pa.array(bucket.astype(np.int32)), pa.array(key), pa.array(parts[at], pa.int32()),
                    batch.column(0).take(pa.array(row[at])), batch.column(1).take(pa.array(row[at])),
                    pa.ListArray.from_arrays(starts, pa.array(places, pa.int32())),
                    pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = rows.join(wanted, ["doc", "version"]).select("doc", "version", "text", "wanted")
    return joined.mapInArrow(
        run,
        "bucket int, h long, parts int, doc long, version long, places array<int>, "
        "left binary, right binary",
    )


def _dealt(contexts: DataFrame, buckets: int, split: int) -> DataFrame:
    """Contexts of one document alone in a range of turns go; a range with too many is dealt out."""
    contexts = materialize(contexts)
    ranged = contexts.where("parts > 1").drop("parts")
    found = ranged.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    parts = F.ceil(F.col("n") / split).cast("int")
    ranged = ranged.join(found.where("a <> b").select("h", parts.alias("parts")), "h")
    part = F.pmod(F.xxhash64("doc", "version", "places"), F.col("parts"))
    bucket = F.pmod(F.xxhash64("h", part), F.lit(buckets)).cast("int")
    return contexts.where("parts = 1").unionByName(ranged.withColumn("bucket", bucket))


def _beside(lefts: list[bytes], rights: list[bytes], slack: int) -> tuple[np.ndarray, ...]:
    """Prefix sums over the bytes beside anchors, 2 * slack a row, and how many there are to each side."""
    left, left_n = _side(lefts, slack, True)
    right, right_n = _side(rights, slack, False)
    return prefix_hash(np.concatenate([left[:, ::-1], right], axis=1).ravel()), left_n, right_n


def _side(values: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes beside the anchors as rows, nearest first, and their numbers."""
    sizes = np.array([len(v) for v in values])
    flat = b"".join((v[::-1] if backwards else v).ljust(width, b"\0") for v in values)
    return np.frombuffer(flat, np.uint8).reshape(-1, width), sizes


def _shared(side: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many bytes each row shares at most with another row of its anchor."""
    key = np.concatenate([h.astype(">i8").view(np.uint8).reshape(-1, 8), side], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    equal = np.logical_and.accumulate(side[a] == side[b], axis=1).sum(axis=1)
    equal = np.where(h[a] == h[b], np.minimum(equal, np.minimum(sizes[a], sizes[b])), 0)
    out = np.zeros(len(h), np.int64)
    np.maximum.at(out, a, equal)
    np.maximum.at(out, b, equal)
    return out


def _settle_cut(h, split, doc, left, left_n, right, right_n, slack: int) -> tuple:
    """Settle rows that equal a smaller document's as far as they can be shared at all.

    Returns the rows that are left to be sorted, how many bytes to each side
    they may share, and the rows that are settled with their least and largest turn.
    A settled row leaves nothing that another row could lack: what it may share, the
    row that settles it has too. With it gone, others may share less, and become equal.
    """
    rows = np.argsort(doc, kind="stable")
    reach_l, reach_r = left_n.copy(), right_n.copy()
    beside = np.arange(slack)
    gone: list[tuple] = []
    while True:
        whole = rows[~split[rows]]
        for reach, side in ((reach_l, left), (reach_r, right)):
            reach[whole] = _shared(side[whole], reach[whole], h[whole])
        rows = rows[reach_l[rows] + reach_r[rows] >= slack]
        key = np.concatenate(
            [
                h[rows].astype(">i8").view(np.uint8).reshape(-1, 8),
                reach_l[rows, None].astype(np.uint8),
                reach_r[rows, None].astype(np.uint8),
                np.where(beside < reach_l[rows, None], left[rows], 0),
                np.where(beside < reach_r[rows, None], right[rows], 0),
                np.ones((len(rows), 1)),
            ],
            axis=1,
        ).astype(np.uint8)
        key = key.view(f"S{key.shape[1]}").ravel()
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(rows)]
        # Rows come by their documents, so the first of equal ones is of the smallest.
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        later = np.zeros(len(rows), bool)
        later[order] = doc[rows[order]] > doc[rows[first]]
        row = rows[later]
        gone.append((row, slack - reach_r[row], reach_l[row]))
        rows = rows[~later]
        if not len(row) or len(gone) == ROUNDS:
            return rows, reach_l, reach_r, tuple(np.concatenate(x) for x in zip(*gone))


_FOUND = "doc long, version long, lo int, hi int, h long, text_hash long, places array<int>, turn int"


def _by_suffix_array(table: pa.Table, length: int, k: int) -> pa.Table:
    """Spans found in one bucket; strings of split anchors that are still open have ``turn`` >= 0."""
    slack = length - k
    h = table.column("h").to_numpy()
    split = table.column("parts").to_numpy() > 1
    doc, version = table.column("doc").to_numpy(), table.column("version").to_numpy()
    lefts, rights = table.column("left").to_pylist(), table.column("right").to_pylist()
    left, left_n = _side(lefts, slack, True)
    right, right_n = _side(rights, slack, False)
    live, reach_l, reach_r, settled = _settle_cut(h, split, doc, left, left_n, right, right_n, slack)
    order = live[np.argsort(h[live], kind="stable")]
    pieces = [_span_rows(table, *settled, doc, version, length)]
    if not len(order):
        return pa.concat_tables(pieces)
    # The farthest reach to each side in an anchor's group; what lies nearer than every string's
    # least share of a side is in all its strings and becomes one sign of the joined text.
    new = np.append(True, h[order][1:] != h[order][:-1])
    group = np.cumsum(new) - 1
    far_l = np.maximum.reduceat(reach_l[order], np.flatnonzero(new))[group]
    far_r = np.maximum.reduceat(reach_r[order], np.flatnonzero(new))[group]
    text: list[int] = []
    cores: dict[tuple, int] = {}
    starts, rows, turns, widths = [], [], [], []
    for i, g, fl, fr in zip(order.tolist(), group.tolist(), far_l.tolist(), far_r.tolist()):
        near_l, near_r = slack - fr, slack - fl
        rl, rr = int(reach_l[i]), int(reach_r[i])
        a, b = lefts[i], rights[i]
        core = (g, a[len(a) - near_l :], b[:near_r])
        sign = cores.setdefault(core, 257 + len(cores))
        text.extend([x + 1 for x in a[len(a) - rl : len(a) - near_l]])
        middle = len(text)
        text.append(sign)
        text.extend([x + 1 for x in b[near_r:rr]])
        text.append(0)
        for turn in range(max(near_l, slack - rr), rl + 1):
            starts.append(middle - (turn - near_l))
            rows.append(i)
            turns.append(turn)
            widths.append(fl + fr - slack + 1)
    starts, rows, turns, widths = map(np.array, (starts, rows, turns, widths))
    rank = np.empty(len(text), np.int64)
    rank[np.array(suffix_array(text))] = np.arange(len(text))
    by_rank = np.argsort(rank[starts])
    starts, rows, turns, widths = (x[by_rank] for x in (starts, rows, turns, widths))
    same = _equal_neighbours(np.array(text), starts, widths)
    begin = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(doc[rows], begin)[run]
    hit = doc[rows] > least
    if hit.any():
        row, turn = rows[hit], turns[hit]
        o = np.lexsort((turn, row))
        row, turn = row[o], turn[o]
        first = np.append(True, (row[1:] != row[:-1]) | (turn[1:] != turn[:-1] + 1))
        low = turn[first]
        high = turn[np.append(np.flatnonzero(first)[1:], len(row)) - 1]
        pieces.append(_span_rows(table, row[first], low, high, doc, version, length))
    still = ~hit & split[rows]
    if still.any():
        row, turn = rows[still], turns[still]
        pieces.append(_open_rows(table, row, turn, doc, version, h, left, right))
    return pa.concat_tables(pieces)


def _equal_neighbours(text: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Whether each string equals the one before it in suffix order, sign by sign."""
    same = np.append(False, widths[1:] == widths[:-1])
    padded = np.append(text, np.zeros(int(widths.max()), text.dtype))
    for step in range(int(widths.max())):
        at = np.flatnonzero(same & (widths > step))
        if not len(at):
            break
        same[at] = padded[starts[at] + step] == padded[starts[at - 1] + step]
    return same


def _lists(column: pa.ChunkedArray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows, one after the other, and their lengths."""
    lists = column.combine_chunks()
    starts, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(starts)[row]
    ahead = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts[row] - ahead, sizes)], sizes


def _found_table(doc, version, lo, hi, h, text_hash, places, sizes, turn) -> pa.Table:
    starts = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    listed = pa.ListArray.from_arrays(starts, pa.array(places, pa.int32()))
    columns = [doc, version, lo, hi, h, text_hash, None, turn]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.int32()]
    arrays = [listed if t is None else pa.array(x).cast(t) for x, t in zip(columns, kinds)]
    return pa.Table.from_arrays(arrays, names)


def _span_rows(table, row, low, high, doc, version, length) -> pa.Table:
    q, sizes = _lists(table.column("places"), row)
    row, low, high = (np.repeat(x, sizes) for x in (row, low, high))
    none = np.zeros(len(row), np.int64)
    return _found_table(doc[row], version[row], q - high, q - low + length, none, none, none[:0], none, none - 1)


def _open_rows(table, row, turn, doc, version, h, left, right) -> pa.Table:
    """Strings that are still open, each with the hash of its bytes beside the anchor and of its turn."""
    slack = left.shape[1]
    sums = prefix_hash(np.concatenate([left[:, ::-1], right], axis=1).ravel())
    start = row * (2 * slack) + slack - turn
    digest = mix(span_hash(sums, start, start + slack) + turn.astype(np.uint64)).view(np.int64)
    places, sizes = _lists(table.column("places"), row)
    none = np.zeros(len(row), np.int64)
    return _found_table(doc[row], version[row], none, none, h[row], digest, places, sizes, turn)


def _merged(spans: DataFrame) -> DataFrame:
    """One row for each document with spans: their starts and ends, sorted and disjoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            lo, hi = (listed.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            row, _, lo, hi = _merge(row, np.zeros(len(row), np.int64), lo, hi)
            starts = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *arrays], ["doc", "version", "los", "his"]
            )

    listed = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return listed.mapInArrow(run, "doc long, version long, los array<int>, his array<int>")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, doc (its order; null ids last) and version (0 unless ids repeat)."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
    )
    texts = rows.select("doc", F.xxhash64("text").alias("t")).groupBy("doc")
    repeats = texts.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").limit(1).count()
    return rows.withColumn("version", F.xxhash64("text") if repeats else F.lit(0).cast("long"))


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, split: int = SPLIT
) -> DataFrame:
    """doc, version and the disjoint byte spans to remove, of documents that have any."""
    if not 0 < anchor < length <= 100:
        raise ValueError("0 < anchor < length <= 100")
    slack = length - anchor
    keyed = rows.select("doc", "version", "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(3 * tasks, int(total * 2 / (slack + 2) / RANGE_ANCHORS) + 1)
    settled = materialize(
        _collect_anchors(keyed, length, anchor, ranges)
        .groupBy("range")
        .applyInArrow(lambda table: _settle_range(table, length, anchor, split), _SETTLED)
    )
    open_rows = settled.where("parts > 0")
    many = F.count_if(F.col("parts") > 1)
    n, n_many = open_rows.agg(F.count("*"), many).first()
    buckets = (n + (TURN_RANGES - 1) * n_many) // BUCKET + 1
    contexts = _contexts(keyed, open_rows, length, anchor, buckets)
    found = materialize(
        (_dealt(contexts, buckets, split) if n_many else contexts)
        .groupBy("bucket")
        .applyInArrow(lambda table: _by_suffix_array(table, length, anchor), _FOUND)
    )
    # Strings of anchors that were dealt to several suffix arrays: the smallest id of all keeps them.
    still = found.where("turn >= 0").drop("lo", "hi")
    least = still.groupBy("h", "text_hash").agg(F.min("doc").alias("least"))
    late = (
        still.join(least, ["h", "text_hash"])
        .where("doc > least")
        .select("doc", "version", F.explode("places").alias("q"), "turn")
        .select(
            "doc",
            "version",
            (F.col("q") - F.col("turn")).alias("lo"),
            (F.col("q") - F.col("turn") + length).alias("hi"),
        )
    )
    columns = ["doc", "version", "lo", "hi"]
    spans = (
        settled.where("parts = 0")
        .select(columns)
        .union(found.where("turn < 0").select(columns))
        .union(late.select(columns))
    )
    return materialize(_merged(spans))


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    if (spans.agg(F.sum(F.size("los"))).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    return rows.join(spans, ["doc", "version"], "left")


def _cut(data: bytes, los: list[int] | None, his: list[int] | None) -> bytes:
    """What is left of a text's bytes; spans may run over its end."""
    at, rest = 0, []
    for lo, hi in zip(los or (), his or ()):
        rest.append(data[at:lo])
        at = hi
    rest.append(data[at:])
    return b"".join(rest)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    split: int = SPLIT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row.

    Ids are integers; null ids come after all others. Rows that share an id
    are never held against each other, equal or not. Null texts count as
    empty, and texts shorter than ``length`` bytes lose nothing. An empty table gives an
    empty result; extra columns are ignored.
    """
    rows = _placed(docs, id_col, text_col)
    joined = _with_spans(rows, repeated_spans(rows, length, anchor, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, los, his in zip(*(c.to_pylist() for c in batch.columns[1:])):
                data = text.encode("utf-8", "surrogatepass")
                kept.append(_cut(data, los, his))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(los or ()))
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = joined.select("doc_id", "text", "los", "his")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with all their columns and only the kept bytes of their texts.

    Of a character that a cut leaves incomplete the rest goes too; null texts stay null.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    rows = _placed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, anchor)
    version = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    repeats = not spans.where("version <> 0").isEmpty()
    named = docs.select(
        key.alias("doc"),
        (version if repeats else F.lit(0).cast("long")).alias("version"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, los, his in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if text is not None and los:
                    text = _cut(text.encode("utf-8", "surrogatepass"), los, his).decode("utf-8", "ignore")
                texts.append(text)
            rows = batch.column(0)
            columns = [
                pa.array(texts, pa.string()) if name == text_col else rows.field(i)
                for i, name in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    joined = _with_spans(named, spans).select("all", "text", "los", "his")
    return joined.mapInArrow(run, docs.schema)
