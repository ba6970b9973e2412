"""LM scoring by a subword lattice: all segmentations of a text, weighted by unigram piece scores.

The lattice of a word has an arc for each piece of an existing vocabulary that fits, weighted by that vocabulary's score, and one
arc over the whole word if the corpus has it. With c the word's training count, N all training tokens, V the different ones and D a discount, the
whole-word arc weighs (c - D) / N, and the paths of pieces share the D * V / N that this leaves:

    p(word) = max(0, c - D) / N + D * V / N * sum over segmentations of the product of their pieces

A word is a piece that begins with the blank mark and any number of pieces that don't; the mark that begins the next word ends it, so that these sums
add up to one over all words without a further factor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .toxicity import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of more characters are scored one by one instead of in arrays; pieces are of up to LONGEST characters.
WIDE, LONGEST = 48, 16
#: Bytes of texts or of words that a task takes in about.
TASK_BYTES = 64 << 20
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(path: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Pieces, the log probabilities that their scores stand for, and the ids of the 256 byte pieces.

    The file's scores are negative ranks; a rank r gets a probability in proportion to 1 / (r + 10).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    octets, pieces, ranks = [0] * 256, [], []
    for k in range(count):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            octets[int(piece[3:5], 16)] = k
        special = model.is_byte(k) or model.is_control(k) or model.is_unknown(k)
        pieces.append("" if special else piece)
        ranks.append(count if special else -model.get_score(k))
    p = 1 / (np.array(ranks) + 10)
    return pieces, np.log(p / p.sum()), octets


class Lattice:
    """Sums over the segmentations of words into pieces. A word is read as the blank mark and its characters.

    A character that is no piece is written by the pieces of its UTF-8 bytes.
    """

    def __init__(self, pieces: list[str], logs: np.ndarray, octets: list[int]):
        self.logs, self.octets = logs, octets
        self.ids = {p: k for k, p in enumerate(pieces) if p and len(p) <= LONGEST}
        self.hash = np.zeros(len(pieces), np.uint64)
        for p, k in self.ids.items():
            h = np.uint64(0)
            for c in p:
                h = self._next(h, np.uint64(ord(c)))
            self.hash[k] = h
        # A piece's place is given by its hash; those that find it taken go to the next table.
        self.tables, left = [], np.array(sorted(self.ids.values()))
        while len(left):
            table = np.full(1 << 20, -1, np.int32)
            place = self.hash[left] * (_MIX + np.uint64(2 * len(self.tables))) >> np.uint64(44)
            table[place] = left
            self.tables.append(table)
            left = left[table[place] != left]

    @staticmethod
    def _next(h, c):
        with np.errstate(over="ignore"):
            return (h + c + np.uint64(1)) * _MUL

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        found = np.full(h.shape, -1, np.int32)
        for n, table in enumerate(self.tables):
            k = table[h * (_MIX + np.uint64(2 * n)) >> np.uint64(44)]
            np.copyto(found, k, where=(k >= 0) & (self.hash[k] == h) & (found < 0))
        return found

    def spelled(self, c: str) -> list[int]:
        return [self.octets[b] for b in c.encode("utf-8", "surrogatepass")]

    def score(self, words: list[str]) -> np.ndarray:
        """Log of each word's probability over all its segmentations."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words))
        order = np.argsort(lengths, kind="stable")
        for n in np.unique(lengths[lengths <= WIDE]).tolist():
            at = order[np.searchsorted(lengths[order], n) : np.searchsorted(lengths[order], n, "right")]
            for k in range(0, len(at), step := max(1, 200_000 // (n + 1))):
                some = at[k : k + step]
                text = "".join("▁" + words[i] for i in some)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n + 1)
                out[some] = self._sum(codes)
        for k in np.flatnonzero(lengths > WIDE).tolist():
            out[k] = self._one(words[k])
        return out

    def _one(self, word: str) -> float:
        """The same for one long word; all but the last LONGEST sums are forgotten."""
        text, sums = "▁" + word, [0.0]
        for j in range(1, len(text) + 1):
            first = max(0, j - LONGEST)
            arcs = [sums[i - j] + self.logs[k] for i in range(first, j) if (k := self.ids.get(text[i:j])) is not None]
            if text[j - 1] not in self.ids:
                arcs.append(sums[-1] + sum(self.logs[b] for b in self.spelled(text[j - 1])))
            most = max(arcs)
            sums.append(most + math.log(sum(math.exp(x - most) for x in arcs)))
            del sums[:-LONGEST]
        return float(sums[-1])

    def _sum(self, codes: np.ndarray) -> np.ndarray:
        m, n = codes.shape
        letters, back = np.unique(codes, return_inverse=True)
        back = back.reshape(m, n)
        alone = [self.ids.get(chr(c), -1) for c in letters.tolist()]
        spelled = {k: self.spelled(chr(c)) for k, c in enumerate(letters.tolist()) if alone[k] < 0}
        single = np.array([self.logs[a] if a >= 0 else sum(self.logs[b] for b in spelled[k]) for k, a in enumerate(alone)])
        forward = np.full((n + 1, m), -np.inf)
        forward[0] = 0
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        code = codes.astype(np.uint64).T
        for i in range(n):
            for some, x in waiting[i]:
                forward[i, some] = np.logaddexp(forward[i, some], x)
            waiting[i] = []
            forward[i + 1] = np.logaddexp(forward[i + 1], forward[i] + single[back[:, i]])
            h, some = self._next(np.zeros(m, np.uint64), code[i]), None
            for j in range(i + 1, min(n, i + LONGEST)):
                h = self._next(h, code[j])
                k = self.find(h)
                some = np.flatnonzero(k >= 0)
                if len(some):
                    k = k[some]
                    waiting[j + 1].append((some, forward[i, some] + self.logs[k]))
        for some, x in waiting[n]:
            forward[n, some] = np.logaddexp(forward[n, some], x)
        return forward[n]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the high bytes of small numbers stand together and compress to almost nothing."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _unpacked(planes: bytes, kind: type) -> np.ndarray:
    octets = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(octets.T).view(kind).ravel()


_BLOCK = "kind int, part int, block long, doc_id {kind}, held boolean, words binary, index binary, train binary"


def _coded(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of documents: rows of kind 1 hold a document's words as places in its block's vocabulary, rows of kind 0 a
    part of that vocabulary, by a hash of the words, with their places and their counts in the block's training documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for n, batch in enumerate(batches):
            block = (TaskContext.get().partitionId() << 24) + n
            places: dict[bytes, int] = {}
            ids, held = [], batch.column(2).to_pylist()
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(np.array([places.setdefault(w, len(places)) for w in words], np.int32))
            learned = [x for x, out in zip(ids, held, strict=True) if not out]
            train = np.bincount(np.concatenate(learned), minlength=len(places)) if learned else np.zeros(len(places), np.int64)
            words = list(places)
            part = np.fromiter((xxhash.xxh32_intdigest(w, 7) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            found, begins = np.unique(part[order], return_index=True)
            slices = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)], strict=True)]
            empty = pa.nulls(len(found), pa.binary())
            schema = schema or pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("doc_id", batch.schema.field(0).type), ("held", pa.bool_()), ("words", pa.binary()), ("index", pa.binary()), ("train", pa.binary())])
            vocabulary = [np.zeros(len(found), np.int32), found.astype(np.int32), np.full(len(found), block), pa.nulls(len(found), schema.field(3).type), pa.nulls(len(found), pa.bool_())]
            vocabulary += [pa.array([x(s) for s in slices], pa.binary()) for x in (lambda s: b"\n".join([words[k] for k in s]), lambda s: _packed(s.astype(np.int32)), lambda s: _packed(train[s].astype(np.int64)))] if slices else [empty] * 3
            for begin in range(0, len(found), 1024):
                yield pa.record_batch([pa.array(c)[begin : begin + 1024] for c in vocabulary], schema=schema)
            rows = len(ids)
            yield pa.record_batch([pa.array(np.ones(rows, np.int32)), pa.nulls(rows, pa.int32()), pa.array(np.full(rows, block)), batch.column(0), batch.column(2), pa.nulls(rows, pa.binary()), pa.array([_packed(x) for x in ids], pa.binary()), pa.nulls(rows, pa.binary())], schema=schema)

    return docs.select("doc_id", "text", "held").mapInArrow(run, _BLOCK.format(kind=kind))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[tuple[int, bytes, np.ndarray]]]]:
    """For each part, its different words, their training counts, and for each block the places of its words among them."""
    rows = ((r["part"], r) for batch in batches for r in batch.to_pylist())
    for _, group in groupby(rows, lambda x: x[0]):
        places: dict[bytes, int] = {}
        blocks, seen, counts = [], [], []
        for _, r in group:
            own = np.array([places.setdefault(w, len(places)) for w in r["words"].split(b"\n")], np.int64)
            blocks.append((r.get("block"), r.get("index"), own))
            seen.append(own)
            counts.append(_unpacked(r["train"], np.int64))
        total = np.bincount(np.concatenate(seen), np.concatenate(counts), len(places)).astype(np.int64)
        yield [w.decode("utf-8", "surrogatepass") for w in places], total, blocks


def score_documents(docs: DataFrame, held: Column | None = None, path: str = VOCABULARY) -> DataFrame:
    """Log10 probabilities of whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Takes doc_id and text; other columns are ignored. Tokens are words between ASCII white space, A-Z lower-cased, then one end.
    The base is a unigram of words with one added to each count. The model sums over all segmentations of the text into pieces of an existing
    vocabulary, weighted by that vocabulary's scores, and over whole training words (see the module). As no arc crosses a blank, a text's
    probability is the product of its words', and each different word is summed once, in log space. A null or empty text is its end alone; repeated rows are scored and
    counted each; without training rows the vocabulary's scores stand alone; an empty table gives no rows. Words and blocks of
    texts are dealt to more tasks as the texts grow, so that a task takes in about TASK_BYTES.
    """
    spark = docs.sparkSession
    ship(spark)
    held = held_out(7, 2) if held is None else held
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    coded = saved(_coded(docs.select("doc_id", "text", held.alias("held")), 4 * tasks))
    by_part = coded.where("kind = 0").select("part", "block", "words", "index", "train").repartition(tasks, "part").sortWithinPartitions("part", "block")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(4, np.int64)
        for _, counts, _ in _parts(batches):
            seen += [counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()]
        yield pa.record_batch([pa.array([int(n)]) for n in seen], names=["tokens", "types", "once", "twice"])

    learned = coded.where("kind = 1 and not held").count()
    # Places stay behind here: this exchange stands beside that of the scores until the query ends.
    only = coded.where("kind = 0").select("part", "words", "train").repartition(tasks, "part").sortWithinPartitions("part")
    sums = only.mapInArrow(tally, "tokens long, types long, once long, twice long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice")]).first()
    tokens, types, once, twice = sums["tokens"] + learned, sums["types"] + bool(learned), sums["once"], sums["twice"]
    discount = once / (once + 2 * twice) if once and twice else 0.75
    fitted = spark.sparkContext.broadcast(vocabulary(path))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*fitted.value)
        for words, counts, blocks in _parts(batches):
            logs = lattice.score(words)
            if tokens:
                with np.errstate(divide="ignore"):
                    logs = np.logaddexp(np.log(np.maximum(0, counts - discount) / tokens), np.log(discount * types / tokens) + logs)
            for k in range(0, len(blocks), 256):
                some = blocks[k : k + 256]
                yield pa.record_batch([pa.array([b for b, _, _ in some], pa.int64()), pa.array([i for _, i, _ in some], pa.binary()), pa.array([_packed(logs[own]) for _, _, own in some], pa.binary()), pa.array([_packed(counts[own]) for _, _, own in some], pa.binary())], names=["block", "index", "logs", "train"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = by_part.mapInArrow(score, "block long, index binary, logs binary, train binary").withColumn("kind", F.lit(0))
    both = scored.unionByName(coded.where("kind = 1").select("kind", "block", "doc_id", "held", "index"), allowMissingColumns=True)
    end = (math.log(learned / tokens) if learned else 0.0, math.log10(learned + 1), math.log10(tokens + types + 1), int(learned > 0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values = None, np.zeros((0, 3))
        for batch in batches:
            found: list[tuple] = []
            keep = []
            for k, (kind, of, index, logs, train) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "index", "logs", "train")), strict=True)):
                if of != block:
                    block, values = of, np.zeros((0, 3))
                places = _unpacked(index, np.int32)
                if kind == 0:
                    if len(places) and places.max() >= len(values):
                        values = np.concatenate([values, np.zeros((max(int(places.max()) + 1 - len(values), len(values)), 3))])
                    counts = _unpacked(train, np.int64)
                    values[places] = np.stack([_unpacked(logs, np.float64), np.log10(counts + 1.0), counts > 0], 1)
                else:
                    log, base, known = values[places].sum(0).tolist() if len(places) else (0.0, 0.0, 0.0)
                    n = len(places) + 1
                    keep.append(k)
                    found.append((n, int(known) + end[3], base + end[1] - n * end[2], (log + end[0]) / math.log(10)))
            if found:
                rows = batch.take(pa.array(keep))
                columns = list(zip(*found, strict=True))
                yield pa.record_batch([rows.column("doc_id"), rows.column("held"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([tokens] * len(found), pa.int64()), pa.array(columns[2]), pa.array(columns[3])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
