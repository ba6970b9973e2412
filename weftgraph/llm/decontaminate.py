"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, unused

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of item texts that one pass over the documents compares; more items take more passes.
BLOCK_BYTES = 32 << 20
#: Items of fewer shingles are candidates of every text that holds one of them.
DIRECT = 8
_WORD = re.compile(r"[^\W_]+")
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    """Hashes of words, kept until there are 262,144."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5)
        return value


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """64-bit hashes of all runs of five words, in order; words are lower-cased runs of letters and digits."""
    found = _WORD.findall((text or "").lower())
    n = len(found) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    h = sum(((w[k : k + n] ^ (w[k : k + n] >> np.uint64(29))) * _FACTORS[k] for k in range(WIDTH)), np.zeros(n, np.uint64))
    h ^= h >> np.uint64(32)
    h *= _FACTORS[1]
    return h ^ (h >> np.uint64(29))


class Index:
    """Items by size: partition p holds those of 2^p to 2^(p+1) - 1 different shingles.

    A document is seen as windows of 2^(p+2) shingles, each beginning half a window after the one before, so that a passage of
    an item's length lies whole in one of them and its Jaccard similarity to that window stays above a
    bound whatever the document's length. Sketches are one-permutation MinHash: the bins of a hash's low bits, the least hash of each.
    Window and item become a candidate pair where they share the least hash of any bin (bands of one row). Items of fewer than
    DIRECT shingles have too few least hashes to rely on: all of their shingles are looked up directly.
    """

    def __init__(self, items: list[tuple[int, str]]):
        words = _Words()
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(shingles(t, words)) for _, t in items]
        self.parts: dict[int, dict[int, list[int]]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                p = len(s).bit_length() - 1
                bins = np.uint64(self.bins(p) - 1)
                order = np.lexsort((s, s & bins))
                least = s[order][np.r_[True, np.diff((s & bins)[order].astype(np.int64)) != 0]]
                for value in (s if len(s) < DIRECT else least).tolist():
                    self.parts.setdefault(p, {}).setdefault(value, []).append(k)
        self.values = np.unique(np.array([v for of in self.parts.values() for v in of], np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.values & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def bins(p: int) -> int:
        return max(1024, 1 << (p + 3))

    def find(self, h: np.ndarray) -> list[tuple[int, float]]:
        """(item, containment) of the items whose shingles are in the document in the share THRESHOLD or more, by item."""
        if not len(self.values) or not len(h):
            return []
        may = np.flatnonzero(self.bits[h & np.uint64((1 << 20) - 1)])
        may = may[self.values[np.minimum(np.searchsorted(self.values, h[may]), len(self.values) - 1)] == h[may]]
        candidates: set[int] = set()
        for p, of in self.parts.items() if len(may) else ():
            stride, bins = 1 << (p + 1), np.uint64(self.bins(p) - 1)
            for i in may.tolist():
                items = of.get(value := int(h[i]))
                if items is None or candidates.issuperset(items):
                    continue
                if 1 << p < DIRECT:
                    candidates.update(items)
                    continue
                for w in (i // stride, i // stride - 1):
                    window = h[max(0, w) * stride : (max(0, w) + 2) * stride]
                    if int(window[(window & bins) == (h[i] & bins)].min()) == value:
                        candidates.update(items)
                        break
        if not candidates:
            return []
        own = np.unique(h)
        found = []
        for k in candidates:
            s = self.sets[k]
            share = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum()) / len(s)
            if share >= THRESHOLD:
                found.append((self.ids[k], share))
        return sorted(found)


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with the block of each, and the number of blocks, each of at most about BLOCK_BYTES of text."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BLOCK_BYTES))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def _index(items: DataFrame, block: int):
    """The broadcast index of one block."""
    ship(items.sparkSession)
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").distinct().collect()]))


def _found(texts: DataFrame, index, names: str) -> DataFrame:
    """The first column of texts, and the items and shares that one index finds in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = [index.value.find(shingles(text.as_py(), words)) for text in batch.column(1)]
            best = [dict(sorted(r, key=lambda x: x[1])) for r in rows]
            yield pa.record_batch([batch.column(0), pa.array([sorted(b) for b in best], pa.list_(pa.int64())), pa.array([[b[i] for i in sorted(b)] for b in best], pa.list_(pa.float64()))], names=[names.split()[0], "item_ids", "shares"])

    return texts.mapInArrow(run, f"{names}, item_ids array<long>, shares array<double>")


def _hits(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """(digest, item_ids, shares) of the texts that contain items, from one block after the other: only one index is held at a time."""
    texts = docs.where("text is not null").select(F.md5("text").alias("digest"), "text")
    found = None
    for block in range(blocks):
        index = _index(items, block)
        part = saved(_found(texts, index, "digest string").where(F.size("item_ids") > 0).select("digest", F.explode(F.arrays_zip("item_ids", "shares")).alias("x")).distinct())
        index.destroy()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("digest", F.col("x.item_ids").alias("item")).agg(F.max("x.shares").alias("share"))
    pairs = F.sort_array(F.collect_list(F.struct("item", "share")))
    return saved(best.groupBy(F.col("digest").alias("of")).agg(pairs.alias("x")).select("of", F.col("x.item").alias("item_ids"), F.col("x.share").alias("shares")))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark items that each document contains: doc_id, item_ids array<long>, shares array<double>.

    One row for each row of docs; takes doc_id, text and the benchmark's item_id, text, and ignores other
    columns. A document contains an item if it holds at least 0.8 of the item's different runs of five words, anywhere. Null, empty and
    shorter texts contain nothing, and items under five words are in nothing; repeated items are found once; an empty table on either side gives no hits.
    The benchmark is the stated query set: it is compared with all documents in blocks of bounded size, one after the other.
    """
    items, blocks = _blocks(benchmark)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    if blocks == 1:
        return _found(docs.select("doc_id", "text"), _index(items, 0), kind)
    hits = _hits(docs, items, blocks)
    none = lambda c: F.coalesce(F.col(c), F.array().cast(hits.schema[c].dataType)).alias(c)
    return docs.select("doc_id", F.md5("text").alias("digest")).join(hits, F.col("digest") == F.col("of"), "left").select("doc_id", none("item_ids"), none("shares"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item of the benchmark as contained_items() defines it."""
    items, blocks = _blocks(benchmark)
    if blocks > 1:
        of = unused(docs, "of")
        return docs.join(_hits(docs, items, blocks).select(F.col("of").alias(of)), F.md5("text") == F.col(of), "left_anti")
    index, at = _index(items, 0), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            yield batch.filter(pa.array([not index.value.find(shingles(text.as_py(), words)) for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) g from w),
bw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark),
b as (select distinct item_id, unnest(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) g from bw),
sizes as (select item_id, count(*) n from b group by 1),
hits as (select doc_id, item_id, count(*) / n::double share from s join b using (g) join sizes using (item_id) group by doc_id, item_id, n having count(*) / n::double >= 0.8)
select d.doc_id, count(item_id) > 0 contaminated, count(item_id)::bigint n_items, coalesce(string_agg(item_id::varchar, ',' order by item_id), '') item_ids, max(share) containment
from documents d left join hits h on d.doc_id = h.doc_id group by d.doc_id
"""
