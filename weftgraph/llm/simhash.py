"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, saved, ship, unused, whole_groups

SEED = 42
#: Bits of each value of a byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Node pairs expanded at once; more wait on a stack, so that memory stays bounded.
_FRONT = 1 << 14
#: Fingerprints under one prefix above which it is dealt by further bits.
HOT = 50_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` lower-cased words, joined by a space; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where it is set in over half the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a long; the text is read once and leaves no other trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_links(values: np.ndarray, shared: int, budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of a sorted array of distinct values that share their first bits and differ in at most `budget`.

    A node of the binary trie is a range of the array. Node pairs start as (n, n) at depth `shared`, descend together, add
    an error where their bits differ, and are dropped beyond the budget. A pair of two single values is compared at once, as in a compressed trie.
    """
    top = np.uint64(bits - shared)
    prefix = values >> top if shared else np.zeros(len(values), np.uint64)
    first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(values) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(values)].astype(np.int64)[: len(first)]
    wide = last - first > 1
    stack = [(shared, first[wide], last[wide], first[wide], last[wide], np.zeros(int(wide.sum()), np.int64))]
    while stack:
        depth, a, aa, b, bb, err = stack.pop()
        if len(a) > _FRONT:
            stack += [(depth, *(x[k : k + _FRONT // 2] for x in (a, aa, b, bb, err))) for k in range(0, len(a), _FRONT // 2)]
            continue
        single = (aa - a == 1) & (bb - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            yield x[near], y[near]
            a, aa, b, bb, err = (x[~single] for x in (a, aa, b, bb, err))
        if not len(a):
            continue
        # The first value of each node whose bit at this depth is set; the array is sorted.
        bit = np.uint64(bits - 1 - depth)
        head = lambda n: (values[n] >> bit | np.uint64(1)) << bit
        am, bm = np.searchsorted(values, head(a)), np.searchsorted(values, head(b))
        am, bm = np.clip(am, a, aa), np.clip(bm, b, bb)
        own = a == b
        low, high, across, back = (a, am, b, bm, err), (am, aa, bm, bb, err), (a, am, bm, bb, err + 1), (am[~own], aa[~own], b[~own], bm[~own], err[~own] + 1)
        a, aa, b, bb, err = (np.concatenate(x) for x in zip(low, high, across, back, strict=True))
        live = (aa > a) & (bb > b) & (err <= budget) & ~((a == b) & (aa - a == 1))
        stack.append((depth + 1, *(x[live] for x in (a, aa, b, bb, err))))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position that each of n positions reaches over the pairs."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            x, y = root[x], root[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
    return root


def _blocks(value: Column, bits: int, count: int) -> list[tuple[Column, int]]:
    at = [round(bits * k / count) for k in range(count + 1)]
    return [(F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(at, at[1:], strict=False)]


def _dealt(value: Column, budget: int, bits: int) -> list[Column]:
    """A fingerprint once for each pair of its budget + 2 blocks of bits, with that pair in front.

    Of these blocks, any two fingerprints within the budget agree in at least two, so they meet under one of the pairs.
    """
    blocks, found = _blocks(value, bits, budget + 2), []
    for i, j in combinations(range(budget + 2), 2):
        turned = F.lit(0).cast("long")
        for k in (i, j, *(k for k in range(budget + 2) if k not in (i, j))):
            turned = F.shiftleft(turned, blocks[k][1]).bitwiseOR(blocks[k][0])
        shared = blocks[i][1] + blocks[j][1]
        deal = F.lit(len(found))
        under = F.concat_ws("-", deal, F.shiftrightunsigned(turned, bits - shared))
        found.append(F.struct(F.lit(shared).alias("shared"), under.alias("under"), deal.alias("deal"), turned.alias("value")))
    return found


def _refined(rows: DataFrame, budget: int, bits: int, hot: int) -> DataFrame:
    """Rows under crowded prefixes are dealt once more: of budget + 1 pieces of the bits that are left, fingerprints within the budget agree in one."""
    crowded = saved(rows.groupBy("under").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("under").alias("of")))
    if crowded.isEmpty():
        return rows
    many = rows.join(crowded, F.col("under") == F.col("of"), "left_semi")
    found = []
    for shared in sorted({width for _, width in _widths(budget, bits)}):
        rest, own = bits - shared, many.where(F.col("shared") == shared)
        pieces, low = _blocks(F.col("value").bitwiseAND(F.lit((1 << rest) - 1)), rest, budget + 1), F.shiftrightunsigned("value", rest)
        for k, (piece, width) in enumerate(pieces):
            turned = F.shiftleft(low, width).bitwiseOR(piece)
            for j, (other, w) in enumerate(pieces):
                if j != k:
                    turned = F.shiftleft(turned, w).bitwiseOR(other)
            under = F.concat_ws("-", "under", F.lit(k), piece)
            found.append(own.select("id", F.lit(shared + width).alias("shared"), under.alias("under"), (1000 + 10 * F.col("deal") + k).alias("deal"), turned.alias("value")))
    rows = rows.join(crowded, F.col("under") == F.col("of"), "left_anti")
    for more in found:
        rows = rows.unionByName(more)
    return rows


def _widths(budget: int, bits: int) -> list[tuple[tuple[int, int], int]]:
    at = [round(bits * k / (budget + 2)) for k in range(budget + 3)]
    return [((i, j), at[i + 1] - at[i] + at[j + 1] - at[j]) for i, j in combinations(range(budget + 2), 2)]


def _joined(rows: DataFrame, budget: int, bits: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of what the tries of each task link; all pairs of a group never leave it.

    rows: (id, shared, under, deal, value). A task reads them in the order of their values and holds only so many prefixes at a time.
    """

    def prefixes(table: pa.Table) -> list[np.ndarray]:
        top = (bits - table.column("shared").to_numpy()).astype(np.uint64)
        return [table.column("deal").to_numpy(), table.column("value").to_numpy().view(np.uint64) >> top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, prefixes):
            ids, shared, deal = (rows.column(k).to_numpy() for k in ("id", "shared", "deal"))
            values = rows.column("value").to_numpy().view(np.uint64)
            for d in np.unique(deal):
                mine = np.flatnonzero(deal == d)
                mine = mine[np.argsort(values[mine], kind="stable")]
                pairs = trie_links(values[mine], int(shared[mine[0]]), budget, bits)
                root = forest(len(mine), pairs)
                moved = root != np.arange(len(mine))
                yield pa.record_batch([pa.array(ids[mine[moved]]), pa.array(ids[mine[root[moved]]])], names=["a", "b"])

    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "under").select("id", "shared", "deal", "value").sortWithinPartitions("deal", "value")
    return dealt.mapInArrow(run, "a long, b long")


def linked(nodes: DataFrame, budget: int = 2, bits: int = 64, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect the nodes (id, fp) of distinct fingerprints at most `budget` bits apart."""
    rows = nodes.select("id", F.explode(F.array(*_dealt(F.col("fp"), budget, bits))).alias("x")).select("id", "x.*")
    return _joined(_refined(rows, budget, bits, hot), budget, bits)


#: Near copies: texts that agree in all ROWS least hashes of one of BANDS bands are compared. At a similarity of 0.8 a pair
#: agrees in no band with a chance of (1 - 0.8 ** 4) ** 20, under 0.003%, and with less above.
BANDS, ROWS = 20, 4
#: Pairs of a band are compared exactly where AGREE of SIGNS least hashes agree in a byte. At a similarity of 0.8 or more
#: fewer agree with a chance of about one in a million.
SIGNS, AGREE = 512, 367
#: Rows with such signs that a task holds at a time, or one larger group.
WIDE = 1 << 14
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SIGNS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least of a set's hashes that isn't empty, mixed anew for each of `count` places."""
    least = np.full(count, ~np.uint64(0))
    for k in range(0, len(hashes), 2048):
        mixed = (hashes[k : k + 2048, None] ^ _MIX[0, :count]) * _MIX[1, :count]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's least hashes."""
    least = least_hashes(hashes, BANDS * ROWS)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, band, n, id) of the bands that several nodes (id, n, keys) share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, lambda t: [t.column("key").to_numpy()]):
            key = rows.column("key").to_numpy()
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            yield from rows.filter(pa.array(count[at] > 1)).combine_chunks().to_batches()

    rows = nodes.select(F.posexplode("keys").alias("band", "key"), "n", "id").select("key", "band", "n", "id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, band int, n long, id long")


def _candidates(bands: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs (a, b) of rows (key, n, id, component, band, sign) of one key, of different components, of sizes and least hashes that allow a similarity of 0.8,
    each under the first band that it shares, that stand `low` to `high` - 1 places apart in the order of (n, id); a row of nulls where pairs may stand further apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, lambda t: [t.column("key").to_numpy()], WIDE):
            signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            yield from propose(*(rows.column(c).to_numpy() for c in ("key", "n", "id", "component", "band")), signs)

    def propose(key: np.ndarray, n: np.ndarray, ids: np.ndarray, top: np.ndarray, band: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, n, key))
        key, n, ids, top, band, sign = key[order], n[order], ids[order], top[order], band[order], sign[order]
        keys, sign = np.ascontiguousarray(sign[:, : 8 * BANDS]).view(np.uint64), sign[:, 8 * BANDS :]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        # A key whose rows are in one component already has nothing left to compare.
        mixed = np.minimum.reduceat(top, first) != np.maximum.reduceat(top, first)
        live = np.repeat(mixed & (size > low), size)
        key, n, ids, top, band, sign, keys = key[live], n[live], ids[live], top[live], band[live], sign[live], keys[live]
        for d in range(low, min(high, len(key))):
            ok = np.flatnonzero((key[d:] == key[:-d]) & (top[d:] != top[:-d]) & (5 * n[:-d] >= 4 * n[d:]))
            for k in range(0, len(ok), 1 << 14):
                some = ok[k : k + (1 << 14)]
                first = (keys[some] == keys[some + d]).argmax(1) == band[some]
                some = some[first & ((sign[some] == sign[some + d]).sum(1) >= AGREE)]
                x, y = ids[some], ids[some + d]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
        if (mixed & (size > high)).any():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["a", "b"])

    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bands.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """Edges (a, b) of doc_ids that connect near copies: five-word shingles of a Jaccard similarity of 0.8 or more; texts without words link with nothing.

    Equal sets of shingles are merged first. Bands of least hashes only propose pairs; each link is checked on the sets of
    64-bit hashes themselves. Pairs of a band are compared in rounds, its neighbours by size first, and those that are
    connected already are left out, so that a large group of copies isn't compared all with all.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), 5)) for t in batch.column(1)]
            signs = [band_keys(f).tobytes() + least_hashes(f, SIGNS).astype(np.uint8).tobytes() for f in found]
            yield pa.record_batch([batch.column(0), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["id", "hashes", "sign"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), 5)) for t in batch.column(1)]
            digests = [xxhash.xxh128_digest(f.tobytes()) for f in found]
            keys = [band_keys(f).view(np.int64) if len(f) else None for f in found]
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(map(len, found), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "keys"])

    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = saved(texts.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>").where("n > 0"))
    least = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("id")))
    own = saved(rows.join(least, "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    bands = saved(_shared_bands(rows.join(least, "digest").where("doc_id = id").dropDuplicates(["id", "digest"]).select("id", "n", "keys")))
    wanted = bands.select(F.col("id").alias("doc_id")).distinct()
    dropped(rows, least)
    held = saved(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(sets, "id long, hashes array<long>, sign binary"))
    side = lambda id, name: held.select(F.col("id").alias(id), F.col("hashes").alias(name))
    links, now, low, high = own, bands.withColumn("component", F.col("id")), 1, 4
    size, most = bands.count(), own.count()
    while True:
        proposed = saved(_candidates(now.join(held.select("id", "sign"), "id"), low, high), (high - low) * size)
        both = proposed.where("a is not null").join(side("a", "x"), "a").join(side("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        most += proposed.count()
        # No bound here: few pairs may read many hashes, which few tasks shouldn't do.
        earlier, links = links, saved(links.unionByName(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")))
        over = proposed.where("a is null").isEmpty()
        dropped(earlier, proposed)
        if over:
            dropped(bands, held)
            return links
        tops = saved(components(links).withColumnRenamed("id", "of"), 2 * most)
        known = saved(bands.join(tops, F.col("id") == F.col("of"), "left").select("key", "n", "id", F.coalesce("component_id", "id").alias("component"), "band"), size)
        # Only keys of more rows than were compared, and of several components, go on.
        tied = known.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("first"), F.max("component").alias("last"))
        live = tied.where((F.col("rows") > high) & (F.col("first") < F.col("last"))).select(F.col("key").alias("of"))
        now = saved(known.join(live, F.col("key") == F.col("of"), "left_semi"), size)
        dropped(tops, known, bands)
        bands = now.drop("component")
        bands._scratch = now._scratch
        low, high = high, 8 * high


def simhash_groups(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """Near-duplicate groups of documents: doc_id, fingerprint (16 hex digits), component_id.

    Takes doc_id (a long) and text; other columns are ignored. Fingerprints link at `budget` or fewer differing
    bits; component_id is the smallest doc_id of the group. Null, empty and white texts have fingerprint zero and link
    like any other; shorter texts than a shingle count as one; repeated rows share a group; an empty table gives no rows.
    Equal fingerprints are merged before anything is compared.
    """
    rows = saved(fingerprints(docs, width))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(saved(linked(nodes.where("id is not null"), budget)))
    groups = saved(nodes.join(found, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")))
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 3, budget: int = 2, near: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that simhash_groups() names as their group's smallest doc_id.

    near: groups are joined with those of near_copies(), which differ in more bits than the budget of short fingerprints allows.
    Of rows that share a doc_id one stays; rows without doc_id can't be told apart and stay.
    """
    of = unused(docs, "of")
    groups = saved(simhash_groups(docs, width, budget).select("doc_id", "component_id"))
    if near:
        edges = near_copies(docs).unionByName(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        found = saved(components(edges).select(F.col("id").alias("of"), F.col("component_id").alias("least")))
        groups = saved(groups.join(found, F.col("doc_id") == F.col("of"), "left").select("doc_id", F.coalesce("least", "component_id").alias("component_id")))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(of)).distinct()
    kept = docs.join(others, F.col("doc_id") == F.col(of), "left_anti")
    twice = saved(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias("n")).where("n > 1").select(of))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col("doc_id") == F.col(of), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, F.col("doc_id") == F.col(of), "left_anti").union(once)
