"""The highest-scoring documents for each query, over posting lists cut into geometric blocks.

Documents are dealt into segments of bounded size, each an index of its own.
In a segment, the documents of every term's posting list are clustered by the
similarity of their whole term vectors (a nearest-centre pass over projected
vectors, centres drawn from the list), and each cluster, a block, keeps the
coordinatewise maximum of its documents' impacts, rounded up. The product of a
query with that summary bounds the score of every document in the block, so
blocks whose bound lies below the query's tenth-best score so far are skipped,
all others are scored in full; a term whose own and later terms' largest
impacts together can't reach that score ends the query. Nothing is skipped that
could be in the result.

A task builds its segments one after the other and takes all queries through
each, keeping the best so far; only these leave it. A frequent term is many
short lists, one in each segment, so nothing grows with a term's frequency.
Queries come in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logvane.llm.common import id_and_text, mix, slices
from logvane.session import materialize

# Runs of digits, ASCII letters and everything beyond ASCII, as UTF-8 bytes.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Documents and postings of a segment, documents of a block, and dimensions of the projected vectors.
SEGMENT_DOCS = 1024
SEGMENT_POSTINGS = 1 << 18
BLOCK_DOCS = 64
PROJECTED = 64
# Impacts are below 10^6; a summary keeps them in steps of this, rounded up.
STEP = 4096
# Bytes of query texts that are searched for at once.
QUERY_BYTES = 1 << 20
# Parts that merge each query's results before the last one does.
MERGES = 64


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, A-Z lower-cased; a null text has none."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _query_terms(items: DataFrame) -> DataFrame:
    """item_id and its terms, each once; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    key = items.schema["doc_id"].dataType.simpleString()
    listed = items.mapInArrow(run, f"item {key}, terms array<binary>")
    return listed.select("item", F.explode("terms").alias("term")).distinct()


def forward(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """block, doc_id, n (terms with repeats) and the queries' terms with their occurrences, written.

    A block of queries is as many as QUERY_BYTES of text hold, so the terms
    that travel to every task are bounded; each block has all documents.
    """
    asked = id_and_text(items, item_col, item_text_col)
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = -(-int(size) // QUERY_BYTES) or 1
    rows = id_and_text(docs, id_col, text_col)
    spark, out = rows.sparkSession, None
    for block in range(blocks):
        terms = _dictionary(asked, block, blocks)
        number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

        def run(batches: Iterator[pa.RecordBatch], number=number, block=block) -> Iterator[pa.RecordBatch]:
            wanted = number.value
            look = wanted.keys()
            for batch in slices(batches):
                sizes, places, times = [], [], []
                for text in batch.column(1).to_pylist():
                    found = terms_of(text)
                    counts = Counter(found)
                    both = sorted((wanted[t], counts[t]) for t in counts.keys() & look)
                    sizes.append(len(found))
                    places.append([t for t, _ in both])
                    times.append([n for _, n in both])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * batch.num_rows, pa.int32()),
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["block", "doc_id", "n", "terms", "tf"],
                )

        kind = rows.schema["doc_id"].dataType.simpleString()
        part = rows.mapInArrow(run, f"block int, doc_id {kind}, n long, terms array<int>, tf array<long>")
        out = part if out is None else out.union(part)
    return materialize(out)


def _of_block(asked: DataFrame, block: int, blocks: int) -> DataFrame:
    return asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)


def _dictionary(asked: DataFrame, block: int, blocks: int) -> list[bytes]:
    """The block's terms in order; a term's place is its number."""
    found = _query_terms(_of_block(asked, block, blocks)).select("term").distinct().collect()
    return sorted(bytes(r["term"]) for r in found)


def _impacts(index: DataFrame, total_docs: int, total_terms: int) -> DataFrame:
    """Each document's impacts: tf against its length. Whole numbers, divided rounding down."""
    length = f"(10 + (90 * n * {total_docs}L) div {total_terms}L)"
    impact = f"transform(tf, x -> (1000000000L * x) div (1000 * x + 8 * {length}))"
    return index.where("n > 0").select("doc_id", "terms", F.expr(impact).alias("impacts"))


class Segment:
    """An index of a bounded number of documents: dense impacts, and each term's blocks with their summaries."""

    def __init__(self, owners: list, terms: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        self.owners = owners
        self.terms, at = np.unique(np.concatenate(terms), return_inverse=True)
        row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        self.impact = np.zeros((len(terms), len(self.terms)), np.int32)
        self.impact[row, at] = np.concatenate(impacts)
        self.largest = self.impact.max(axis=0).astype(np.int64)
        near = self._projected()
        members: list[np.ndarray] = []
        # Blocks stand in order of their terms; ``first`` is each term's first block.
        self.first = np.zeros(len(self.terms) + 1, np.int64)
        for t in range(len(self.terms)):
            members += self._clusters(np.flatnonzero(self.impact[:, t]), near)
            self.first[t + 1] = len(members)
        self.starts = np.concatenate([[0], np.cumsum([len(own) for own in members])])
        self.docs = np.concatenate(members)
        self.summary = np.empty((len(members), len(self.terms)), np.uint8)
        for b, own in enumerate(members):
            # Rounded up, so that the summary never lies below a member.
            self.summary[b] = -(-self.impact[own].max(axis=0) // STEP)

    def _projected(self) -> np.ndarray:
        """Unit vectors of fewer dimensions: signs that depend on a term alone keep angles roughly."""
        seeds = mix(self.terms.astype(np.uint64)[:, None] * np.uint64(PROJECTED) + np.arange(PROJECTED, dtype=np.uint64))
        signs = np.where(seeds & np.uint64(1), 1, -1).astype(np.float32)
        near = np.concatenate([self.impact[i : i + 128].astype(np.float32) @ signs for i in range(0, len(self.impact), 128)])
        return near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)

    def _clusters(self, own: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        """A posting list's documents by their nearest centre; a hash draws the centres from the list."""
        if len(own) <= BLOCK_DOCS:
            return [own]
        drawn = np.argsort(mix(own.astype(np.uint64) + np.uint64(1)), kind="stable")
        centres = own[drawn[: -(-len(own) // BLOCK_DOCS)]]
        nearest = (near[own] @ near[centres].T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        cuts = np.flatnonzero(np.diff(nearest[order])) + 1
        return np.split(own[order], cuts)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Segments of a task's documents (doc_id, terms, impacts), one at a time."""
    owners, terms, impacts, held = [], [], [], 0
    for batch in batches:
        # Both lists' flat values, and where each document's begin: no number becomes an object.
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        stops = np.cumsum(sizes)
        for i in np.flatnonzero(sizes):  # no query has a term of the others
            own = slice(int(stops[i] - sizes[i]), int(stops[i]))
            owners.append(batch.column(0)[int(i)].as_py())
            terms.append(flat[0][own].astype(np.int32))
            impacts.append(flat[1][own].astype(np.int32))
            held += int(sizes[i])
            if len(owners) >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                yield Segment(owners, terms, impacts)
                owners, terms, impacts, held = [], [], [], 0
    if owners:
        yield Segment(owners, terms, impacts)


class Best:
    """The k best (score, least id first) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score that a further document must reach."""
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, place: tuple, owner: object) -> None:
        # Among equal scores the later id is the worse one; null ids come last.
        row = (score, _Reverse(place), owner)
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)


class _Reverse:
    __slots__ = ("key",)

    def __init__(self, key: tuple) -> None:
        self.key = key

    def __lt__(self, other: _Reverse) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def search_segment(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offer ``best`` the segment's documents that may be among them; the number of blocks skipped."""
    at = np.searchsorted(segment.terms, terms)
    here = at < len(segment.terms)
    here[here] = segment.terms[at[here]] == terms[here]
    at, weights = at[here], weights[here]
    # Rare terms first: they weigh most and have the shortest lists.
    order = np.argsort(-weights, kind="stable")
    at, weights = at[order], weights[order]
    most = weights * segment.largest[at]
    ahead = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
    seen = np.zeros(len(segment.owners), bool)
    steps = weights * STEP
    skipped = 0
    for i, t in enumerate(at):
        # A document first met here has none of the terms before.
        if ahead[i] < best.least():
            break
        lo, hi = segment.first[t], segment.first[t + 1]
        bound = segment.summary[lo:hi, at].astype(np.int64) @ steps
        # The most promising blocks first, a few and then more at once.
        ranked = np.argsort(-bound, kind="stable")
        done, several = 0, 1
        while done < len(ranked) and bound[ranked[done]] >= best.least():
            some = ranked[done : done + several]
            some = some[bound[some] >= best.least()] + lo
            _score(segment, some, at, weights, seen, best)
            done += len(some)
            several *= 2
        skipped += len(ranked) - done
    return skipped


def _score(
    segment: Segment, blocks: np.ndarray, at: np.ndarray, weights: np.ndarray, seen: np.ndarray, best: Best
) -> None:
    """Score the documents of blocks in full, each once for a query."""
    own = np.concatenate([segment.docs[segment.starts[b] : segment.starts[b + 1]] for b in blocks])
    own = own[~seen[own]]
    seen[own] = True
    score = segment.impact[np.ix_(own, at)].astype(np.int64) @ weights
    near = np.flatnonzero(score >= best.least())
    for j in near[np.argsort(-score[near], kind="stable")]:
        if score[j] < best.least():
            break
        owner = segment.owners[own[j]]
        best.offer(int(score[j]), (owner is None, owner if owner is not None else 0), owner)


def search(
    index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents; ``index`` is of ``forward``.

    Only scores above 0 count; equal scores rank by ascending id, null ids
    last; repeated documents rank each by itself. An item without a term that
    any document has gives no row; rows of one item_id are one item; null texts
    have no terms; empty tables give an empty result.
    """
    asked = id_and_text(items, item_col, item_text_col)
    blocks = [r["block"] for r in index.select("block").distinct().collect()]
    out = None
    for block in sorted(blocks):
        found = _search_block(index.where(F.col("block") == block), _of_block(asked, block, max(blocks) + 1), k)
        out = found if out is None else out.union(found)
    if out is None:
        item, doc = (df.schema["doc_id"].dataType.simpleString() for df in (asked, index))
        out = index.sparkSession.createDataFrame([], f"item {item}, doc_id {doc}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # An item's rows, k for each task, are merged in parts before they meet.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))
    some = out.withColumn("part", part).withColumn("rank", rank("item", "part")).where(F.col("rank") <= k)
    return (
        some.withColumn("rank", rank("item"))
        .where(F.col("rank") <= k)
        .select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
    )


def _search_block(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item, doc_id and score of the best of each task."""
    total = index.where("n > 0").agg(
        F.count("*").alias("total_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_terms")
    )
    total_docs, total_terms = total.first()
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")
    # As many rows as the block's queries have terms, at most.
    weights = {r["term"]: r["w"] for r in frequency.select("term", weight).collect()}
    queries: dict = {}
    listed = _query_terms(asked).collect()
    number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in listed}))}
    for row in listed:
        t = number[bytes(row["term"])]
        if weights.get(t, 0) > 0:
            queries.setdefault(row["item"], []).append(t)
    asked_for = {
        item: (np.array(sorted(own), np.int32), np.array([weights[t] for t in sorted(own)], np.int64))
        for item, own in queries.items()
    }
    impacts = _impacts(index, total_docs, max(1, total_terms))
    shared = index.sparkSession.sparkContext.broadcast(asked_for)
    item = asked.schema["doc_id"].dataType.simpleString()
    owner_type = to_arrow_type(index.schema["doc_id"].dataType)
    doc = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(k) for i in shared.value}
        for segment in _segments(batches):
            for i, (terms, weights) in shared.value.items():
                search_segment(segment, terms, weights, best[i])
        rows = [(i, owner, score) for i, b in best.items() for score, _, owner in b.rows]
        if rows:
            ids, owners, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(owners, owner_type), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
            )

    return impacts.mapInArrow(run, f"item {item}, doc_id {doc}, score long")
