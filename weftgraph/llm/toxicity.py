"""Toxicity scores of texts that a noisy channel has been undone on."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship

#: Labelled documents that the model is fitted on at most, dealt by hash; everything else covers all rows.
SAMPLE = 8000
#: A gram counts if its likelihood ratio statistic against chance is SURE over 2 ln of the number of grams that were tried, and its
#: log odds at least LEAST; one word adds MOST at most.
SURE, LEAST, MOST = 3.0, 2.5, 6.0
#: The log odds of a text in which nothing is found.
BASE = -4.0
#: What a character may stand for, fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs in the channel: to write a character otherwise, to put a separator in, to repeat a character, to leave a sign as it is.
SWAP, SEPARATE, REPEAT, SIGN = 1.0, 0.3, 0.5, 9.0
#: Restored tokens, and costs of grams, that a task keeps at a time.
KEPT = 1 << 18
_TWICE = re.compile(r"(\w)\1")
_MARK = rf"[^\W_{re.escape(''.join(LEET))}]|[{re.escape(''.join(LEET))}]"
#: Three or more short tokens, of one or two letters or signs, set apart by one to three blanks or separators.
_APART = re.compile(rf"(?<![^\s.\-_*])(?:{_MARK}){{1,2}}(?:[\s.\-_*]{{1,3}}(?:{_MARK}){{1,2}}){{2,}}(?![^\s.\-_*,;:?\"')\]])")
_OTHER = re.compile(r"[\W\d_]+")


#: Characters that the model tells apart: a to z, any other, and the blank; so its trigrams are at most 28 ** 3.
SIGNS = "abcdefghijklmnopqrstuvwxyz¿ "
_CLASS = np.full(128, len(SIGNS) - 1, np.uint8)
_CLASS[[ord(c) for c in SIGNS[:26]]] = np.arange(26)


def character_counts(texts: Iterator[str | None]) -> np.ndarray:
    """How often each three characters of SIGNS follow each other in the words of texts, two blanks before and one after each."""
    total = np.zeros(len(SIGNS) ** 3, np.int64)
    for text in texts:
        if text:
            codes = np.frombuffer(_OTHER.sub("  ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], len(SIGNS) - 2).astype(np.int64)
            grams = (kinds[:-2] * len(SIGNS) + kinds[1:-1]) * len(SIGNS) + kinds[2:]
            total += np.bincount(grams[(kinds[1:-1] < len(SIGNS) - 1) | (kinds[2:] < len(SIGNS) - 1)], minlength=len(total))
    return total


@dataclass
class CharacterModel:
    """Trigrams of characters with back-off, over words between blanks."""

    counts: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, trigrams: dict[int, int]) -> CharacterModel:
        """From counts by place in character_counts(); shorter grams are sums of longer ones."""
        counts: dict[str, int] = {}
        for k, n in trigrams.items():
            gram = SIGNS[k // len(SIGNS) ** 2] + SIGNS[k // len(SIGNS) % len(SIGNS)] + SIGNS[k % len(SIGNS)]
            for g in (gram, gram[1:], gram[2:]):
                counts[g] = counts.get(g, 0) + n
        return cls(counts)

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.under: dict[str, int] = {}
        for g, n in self.counts.items():
            self.under[g[:-1]] = self.under.get(g[:-1], 0) + n
        self.size = len({g[-1] for g in self.counts}) + 1

    def cost(self, gram: str) -> float:
        """-log of the share of the gram's last character after the others, smoothed by shorter contexts."""
        if (value := self.known.get(gram)) is None:
            signs = "".join(c if c in SIGNS else SIGNS[-2] for c in gram)
            p = 1 / self.size
            for k in range(len(signs) - 1, -1, -1):
                g = signs[k:]
                p = (self.counts.get(g, 0) + 5 * p) / (self.under.get(g[:-1], 0) + 5)
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[gram] = value = -math.log(p)
        return value


def restore(noisy: str, model: CharacterModel) -> str:
    """The likeliest words behind a noisy one or a run of short tokens: Viterbi over the lattice of what its characters may stand for.

    The state is the last two characters restored and the last one seen. Each character costs what the channel takes and what the model takes.
    A blank ends a word or stands within one. Texts are chains of (text before, character), so that long runs take linear time.
    """
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("  ", ""): (0.0, None)}
    for c in noisy:
        step: dict[tuple[str, str], tuple[float, tuple | None]] = {}

        def put(last: str, seen: str, cost: float, text: tuple | None, step: dict = step) -> None:
            if (key := (last, seen)) not in step or step[key][0] > cost:
                step[key] = (cost, text)

        for (last, seen), (cost, text) in best.items():
            if c.isalpha():
                put(last[1] + c, c, cost + model.cost(last + c), (text, c))
            for x in LEET.get(c, ""):
                put(last[1] + x, c, cost + SWAP + model.cost(last + x), (text, x))
            if c == seen or c == last[1]:
                put(last, c, cost + REPEAT, text)
            if c.isspace() and last != "  ":
                put("  ", "", cost + model.cost(last + " "), (text, " "))
            if not c.isalnum():
                put(last, seen, cost + (SEPARATE if c not in LEET else SIGN), text)
            elif not c.isalpha():
                put(last, seen, cost + SIGN, text)
        best = step
    end = lambda x: x[1][0] + (0.0 if x[0][0] == "  " else model.cost(x[0][0] + " "))
    chain, found = min(best.items(), key=lambda x: (end(x), x[0]))[1][1], []
    while chain:
        chain, c = chain
        found.append(c)
    return "".join(reversed(found))


class Plain(dict):
    """Tokens between blanks as words of letters, noisy ones restored beside their own letters; kept until there are KEPT, as are runs of tokens, under a blank and the run."""

    def __init__(self, model: CharacterModel):
        self.model = model

    def __missing__(self, token: str) -> str:
        if len(self) > KEPT:
            self.clear()
        self[token] = word = self.undone(token)
        return word

    def undone(self, token: str) -> str:
        """Restored with the signs at its ends that may stand for letters, restored without them, and its own letters."""
        sides = [[k for k, c in enumerate(token) if c.isalnum() or (c in LEET and signs)] for signs in (True, False)]
        signed, core = (token[at[0] : at[-1] + 1] if at else "" for at in sides)
        own = _OTHER.sub(" ", core).strip()
        if not own:
            return ""
        words = [own]
        for noisy in dict.fromkeys((core, signed)):
            if not noisy.isalpha() or _TWICE.search(noisy):
                words.insert(0, restore(noisy, self.model))
        return " ".join(dict.fromkeys(words))

    def run(self, m: re.Match) -> str:
        """A run of short tokens as the words that it restores to, before itself."""
        if not any(map(str.isalpha, m[0])):
            return m[0]
        key = f" {m[0]}"
        if (words := self.get(key)) is None:
            if len(self) > KEPT:
                self.clear()
            self[key] = words = restore(m[0], self.model)
        return f" {words} {m[0]}"

    def text(self, text: str | None) -> str:
        """A blank, the words of the text between blanks, a blank. Runs of short tokens are brought together first."""
        text = _APART.sub(self.run, (text or "").lower())
        return f" {' '.join(map(self.__getitem__, text.split()))} "


def grams(word: str) -> list[str]:
    """Beginnings of four to eight letters, and the whole word with its end."""
    return [f" {word[:k]}" for k in range(4, min(8, len(word)) + 1)] + [f" {word} "]


@dataclass
class Toxicity:
    characters: CharacterModel
    weights: dict[str, float]

    def scorer(self):
        automaton, plain = ahocorasick.Automaton(), Plain(self.characters)
        for g, w in self.weights.items():
            automaton.add_word(g, (len(g), w))
        if self.weights:
            automaton.make_automaton()

        def score(text: str | None) -> float:
            odds = BASE
            if text and self.weights:
                line, words = plain.text(text), {}
                for end, (n, w) in automaton.iter(line):
                    start = end - n + 2
                    word = line[start : line.index(" ", start)]
                    words[word] = max(w, words.get(word, 0.0))
                odds += min(30.0, sum(words.values()))
            return 1 / (1 + math.exp(-odds))

        return score


def held_out(parts: int, part: int):
    """Whether crc32 of doc_id as text leaves the remainder `part`."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % parts == part


def _firsts_of_families(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """The smallest doc_id of each label and family of a bounded sample (toxic, doc_id, marks); sharing a mark makes a family."""
    root: dict[tuple, tuple] = {}

    def top(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for toxic, _, marks in rows:
        own = [(toxic, k, m) for k, m in enumerate(marks)]
        for x in own[1:]:
            root[top(x)] = top(own[0])
    least: dict[tuple, int] = {}
    for toxic, i, marks in rows:
        key = top((toxic, 0, marks[0]))
        least[key] = min(i, least.get(key, i))
    return list(least.values())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Learn characters and grams from rows whose crc32 mod 3 isn't 1.

    Characters are counted over all their texts. Grams come from a bounded sample by hash of labelled ones, of which near copies (that share one of four least hashes of sentences) count once, so that a copied
    text can't make its rare words look toxic. Repeated labels count as their highest.
    """
    ship(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known.withColumnRenamed("doc_id", "of")), F.col("doc_id") == F.col("of"))
    parts = F.split(F.lower("text"), r"[.\n]")
    marks = F.array(*[F.array_min(F.transform(parts, lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(4)])  # noqa: B023
    chosen = saved(rows.select("toxic", "doc_id", "text", marks.alias("marks")))
    first = _firsts_of_families([tuple(r) for r in chosen.select("toxic", "doc_id", "marks").collect()])
    ids = docs.sparkSession.createDataFrame([(i,) for i in first], chosen.select("doc_id").schema)
    rows = chosen.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in set(_OTHER.sub(" ", text.lower()).split()):
                    for g in ("", *grams(word)):
                        found.setdefault(g, [0, 0])[bool(toxic)] += 1
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array([n[1] for n in found.values()], pa.int64()), pa.array([n[0] for n in found.values()], pa.int64())], names=["gram", "n1", "n0"])

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum((character_counts(t.as_py() for t in batch.column(0)) for batch in batches), np.zeros(len(SIGNS) ** 3, np.int64))
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(used), pa.array(found[used])], names=["gram", "n"])

    counts = saved(rows.mapInArrow(run, "gram string, n1 long, n0 long").groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    learned = docs.where(~held_out(3, 1)).select("text").mapInArrow(characters, "gram long, n long")
    letters = {r["gram"]: r["n"] for r in learned.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = counts.where("gram = ''").first()
    weights: dict[str, float] = {}
    sure = SURE + 2 * math.log(max(1, counts.count()))
    if total and total["n1"] and total["n0"]:
        a1, a0 = float(total["n1"]), float(total["n0"])
        n1, n0 = F.col("n1"), F.col("n0")
        odds = F.log((n1 + 0.5) / (a1 + 1)) - F.log((n0 + 0.5) / (a0 + 1))
        part = lambda n, a: F.when(n > 0, n * F.log(n * (a1 + a0) / ((n1 + n0) * a))).otherwise(0.0)
        strong = counts.where("gram <> '' and n1 > 1").select("gram", "n1", "n0", odds.alias("odds"), (2 * (part(n1, a1) + part(n0, a0))).alias("sure"))
        strong = strong.where((F.col("odds") >= LEAST) & (F.col("sure") >= sure))
        weights = _own_evidence({r["gram"]: (r["n1"], r["n0"], min(MOST, r["odds"])) for r in strong.collect()}, a1, a0)
    return Toxicity(CharacterModel.of(letters), weights)


def _own_evidence(strong: dict[str, tuple[int, int, float]], a1: float, a0: float) -> dict[str, float]:
    """Weights of the grams that stand on their own: a beginning goes if its words that no longer kept gram covers are seen in
    clean documents and speak against it; where nothing speaks against it, it stays for words not seen yet."""
    covered: dict[str, list[int]] = {g: [0, 0] for g in strong}
    kept = {}
    for g in sorted(strong, key=lambda g: (-len(g), g)):
        n1, n0, weight = strong[g]
        r1, r0 = n1 - covered[g][0], n0 - covered[g][1]
        if r0 <= 0 or math.log((r1 + 0.5) / (a1 + 1)) - math.log((r0 + 0.5) / (a0 + 1)) >= LEAST:
            kept[g] = weight
            covered[g] = [n1, n0]
        above = next((g[:k] for k in range(len(g) - 1, 0, -1) if g[:k] in strong), None)
        if above:
            covered[above][0] += covered[g][0]
            covered[above][1] += covered[g][1]
    return kept


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and score, for every row of docs over its whole text; null and empty texts get the base score.

    Reads doc_id and text alone: labels, lang and source can't enter, and clashing names don't matter. Repeated rows are
    scored each; an empty table gives no rows; without labels of both kinds nothing is found anywhere.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    ship(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
