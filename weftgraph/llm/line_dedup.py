"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines link at two edits or fewer, and at no more than a fifth of the shorter line's code points: one edit from five code points
on, two from ten on, none below five, where a single edit makes another word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved

#: Lines link at so many edits or fewer, and at one for each SHARE code points of the shorter at most.
THRESHOLD, SHARE = 2, 5
#: Letters whose counts, modulo 16, bound the distance of two lines from below; longer lines than PLAIN have segments that say enough.
LETTERS, PLAIN = "etaoinshrdlu", 64
#: Line ids by their last bits: at most so many rows are broadcast to find the texts of candidates.
PREFIXES = 1 << 18
#: Lines under one key are compared in cells of about CELL, of CELL_MOST at most.
CELL, CELL_MOST = 32, 64
#: Characters that a verification compares at once.
BLOCK = 16


def lines(text: Column) -> Column:
    """The different lines of a text, trimmed, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def allowed(length: Column, threshold: int = THRESHOLD) -> Column:
    """Edits at which a line of a length links to lines that aren't shorter."""
    return F.least(F.lit(threshold), F.floor(length / SHARE)).cast("int")


def _segments(threshold: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): a line and one `less` characters shorter, within the threshold, share some segment i of the shorter, of
    threshold + 1, that stands `shift` further on in the longer. Those without less and shift are a line's own segments.

    Of the segments of the shorter line one is untouched; if it is segment i, then at most i edits come before it and at most
    threshold - i after it, which bounds how far it has moved.
    """
    found = [(less, i, shift) for less in range(threshold + 1) for i in range(threshold + 1) for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)]
    return sorted(found, key=lambda x: (bool(x[0] or x[2]), x))


def _keyed(each: DataFrame, threshold: int) -> tuple[DataFrame, list[str], list[str]]:
    """`each`, which has line and length, with the keys of its own segments and of those it may share with lines of its length or less.

    Segments are cut from UTF-32, where a character's place is known. A line's segments are as many as its own threshold
    demands, so keys are dealt by the length of the shorter line; keys that a line hasn't got are null.
    """
    rows = each.withColumn("_u", F.encode("line", "UTF-32"))
    for less in range(threshold + 1):
        rows = rows.withColumn(f"_n{less}", F.col("length") - less)
        rows = rows.withColumns({f"_t{less}": allowed(F.col(f"_n{less}"), threshold)} | {f"_w{less}_{t}": F.floor(F.col(f"_n{less}") / (t + 1)).cast("int") for t in range(1, threshold + 1)})
    own: dict[str, list[Column]] = {}
    for t in range(threshold, 0, -1):
        for n, (less, i, shift) in enumerate(_segments(t)):
            width = F.col(f"_w{less}_{t}")
            size = width if i < t else F.col(f"_n{less}") - width * i
            key = F.xxhash64(f"_n{less}", F.lit(i), F.substring("_u", (width * i + shift) * 4 + 1, size * 4))
            # Own segments come first for any threshold, so that index keys share the first columns.
            own.setdefault(f"k{n}" if n <= t else f"p{t}_{n}", []).append(F.when(F.col(f"_t{less}") == t, key))
    names = {name: F.coalesce(*keys) for name, keys in own.items()}
    rows = rows.withColumns(names).drop("_u", *[c for c in rows.columns if c.startswith(("_n", "_t", "_w"))])
    return rows, [n for n in names if n[0] == "k"], [n for n in names if n[0] == "p"]


def _bag(line: Column) -> Column:
    """Counts of LETTERS, each one byte long, modulo 16 and in Gray code, four bits each: a count that changes by one flips one bit."""
    counts = [F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).cast("long").bitwiseAND(F.lit(15)), 4 * k) for k, c in enumerate(LETTERS)]
    bag = reduce(lambda a, b: a.bitwiseOR(b), counts)
    return bag.bitwiseXOR(F.shiftright(bag, 1).bitwiseAND(F.lit(int("7" * len(LETTERS), 16))))


def _similar(a: Column, b: Column, edits: Column | int) -> Column:
    """Whether two bags allow so few edits; an edit changes two counts by one at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * edits


def edit_distance(x: Column, y: Column, threshold: int = THRESHOLD) -> Column:
    """Edit distance of two lines in UTF-32, or null above the threshold; banded and bit-parallel.

    For each number e of errors, a word of 2 * threshold + 1 bits says which diagonals can be reached with at most e. A
    character of y moves all diagonals at once: a match stays, a substitution comes from one error less, an insertion from the
    diagonal above, a deletion from the one below.

    Errors never fall along a diagonal, and neighbouring diagonals differ by one at most. So a block of BLOCK characters leaves the words as they
    are where one diagonal matches all of it and every other one stands as many errors above it as it lies away; such blocks are
    compared at once. Both arguments must be stored columns or lambda variables: an expression in their place would be evaluated again for each block.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    count = lambda u: (F.octet_length(u) / 4).cast("int")

    def step(state: Column, j: Column) -> Column:
        c = F.substring(y, 4 * j - 3, F.lit(4))
        at = lambda d: 4 * (j + (d - threshold)) - 3
        match = reduce(lambda p, q: p.bitwiseOR(q), [F.when((at(d) > 0) & (F.substring(x, at(d), F.lit(4)) == c), 1 << d).otherwise(0) for d in range(width)])
        words: list[Column] = []
        for e in range(threshold + 1):
            old = state[f"e{e}"]
            new = old.bitwiseAND(match)
            if e:
                below = state[f"e{e - 1}"]
                new = new.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(words[e - 1], 1).bitwiseAND(F.lit(full)))
            words.append(new)
        return F.struct(*[w.cast("int").alias(f"e{e}") for e, w in enumerate(words)])

    def tent(state: Column) -> Column:
        """The diagonal that all others stand above, or null."""
        found = []
        for d in range(width):
            for least in range(threshold + 1):
                word = [sum(1 << k for k in range(width) if abs(k - d) <= e - least) for e in range(threshold + 1)]
                found.append(F.when(reduce(lambda p, q: p & q, [state[f"e{e}"] == w for e, w in reversed(list(enumerate(word)))]), d))
        return F.coalesce(*found)

    def block(state: Column, j: Column) -> Column:
        def move(d: Column) -> Column:
            size = F.least(F.lit(BLOCK), count(y) - j + 1)
            begin = 4 * (j + d - threshold) - 3
            same = (begin > 0) & (F.substring(x, begin, 4 * size) == F.substring(y, 4 * j - 3, 4 * size))
            return F.when(F.coalesce(same, F.lit(False)), state).otherwise(F.aggregate(F.sequence(j, j + size - 1), state, step))

        return F.when(state[f"e{threshold}"] == 0, state).otherwise(F.get(F.transform(F.array(tent(state)), move), F.lit(0)))

    start = F.struct(*[F.lit(sum(1 << (threshold + d) for d in range(-e, e + 1))).alias(f"e{e}") for e in range(threshold + 1)])
    begins = F.when(F.octet_length(y) > 0, F.sequence(F.lit(1), count(y), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    at = count(x) - count(y) + threshold
    mask = F.get(F.array(*[F.lit(1 << d) for d in range(width)]), at)
    finish = lambda end: F.coalesce(*[F.when(end[f"e{e}"].bitwiseAND(mask) != 0, e) for e in range(threshold + 1)])
    return F.when((at >= 0) & (at < width), F.aggregate(begins, start, block, finish))


def different_lines(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, list[str], list[str]]:
    """A row for each different line of doc_id and text: id, first_doc, length, bag and its keys; names of own keys and of other keys.

    An id is the line's 64-bit hash: two of ten billion lines share one with a chance of a few in ten, and are
    then taken for one line. Equal lines are merged before segments are dealt, so that a frequent line is one row.
    """
    each = docs.select("doc_id", F.explode(lines(F.col("text"))).alias("line")).select("doc_id", "line", F.length("line").alias("length"))
    keyed, own, other = _keyed(each, threshold)
    bag = F.when((F.col("length") >= SHARE) & (F.col("length") < PLAIN), _bag(F.col("line")))
    rows = keyed.select("doc_id", F.xxhash64("line").alias("id"), "length", bag.alias("bag"), *own, *other)
    return saved(rows.groupBy("id", "length", "bag", *own, *other).agg(F.min("doc_id").alias("first_doc"))), own, other


def _dealt(known: DataFrame, names: list[str], id: str, bag: str) -> DataFrame:
    keys = F.filter(F.array(*names), lambda k: k.isNotNull())
    return known.where(F.col("k0").isNotNull()).select(F.explode(keys).alias("key"), F.col("id").alias(id), F.col("bag").alias(bag))


def _suspects(docs: DataFrame, known: DataFrame, own: list[str], other: list[str], threshold: int) -> DataFrame:
    """The lines that share a key with a line of similar letters: id, length, bag, u (the line in UTF-32), own, keys.

    Semi-joins say so line by line, without pairs.
    """
    near = F.coalesce(_similar(F.col("bag"), F.col("bag_b"), threshold), F.lit(True)) & (F.col("id") != F.col("b"))
    index, probe = (lambda x="id", y="bag": _dealt(known, own, x, y)), (lambda x="id", y="bag": _dealt(known, other, x, y))
    met = [(index(), index("b", "bag_b")), (index(), probe("b", "bag_b")), (probe(), index("b", "bag_b"))]
    found = [a.join(b.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & near, "left_semi").select("id") for a, b in met]
    wanted = saved(reduce(DataFrame.unionByName, found).distinct())
    # The texts of suspects: their ids' last bits thin out the lines before these are shuffled.
    bits = F.pmod(F.col("id"), F.lit(PREFIXES))
    each = docs.select(F.explode(lines(F.col("text"))).alias("line")).where(F.length("line") >= SHARE).select("line", F.xxhash64("line").alias("id"))
    thinned = each.join(F.broadcast(wanted.select(bits.alias("bits")).distinct()), bits == F.col("bits"), "left_semi")
    texts = thinned.distinct().join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    some = lambda names: F.filter(F.array(*names), lambda k: k.isNotNull())
    return saved(known.drop("bag").join(texts, "id").select("id", "length", _bag(F.col("line")).alias("bag"), F.encode("line", "UTF-32").alias("u"), some(own).alias("own"), some([*own, *other]).alias("keys")))


def _bits(mask: Column) -> Column:
    """Places of a mask's set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(CELL_MOST - 1)), lambda j: F.call_function("getbit", mask, j) == 1)


def line_links(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different lines (id, first_doc), the number of links of those that have any (id, n_links), and edges (a, b) that connect linked lines.

    Lines under one key stand in cells of at most CELL_MOST. A line meets a cell as one row, whose links are the bits of a mask: pairs are
    never rows. A pair is verified under the first of its keys alone, by the longer line or, of equal length, that with the larger id.
    """
    known, own, other = different_lines(docs, threshold)
    lines_ = _suspects(docs, known, own, other, threshold)
    size = lines_.select(F.explode("own").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    size = saved(size.select("key", "n", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
    cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell")
    held = lines_.select(F.explode("own").alias("key"), "id", "length", "bag", "u", "own").join(size, "key").select("key", cell, F.struct("id", "length", "bag", "u", "own").alias("m"))
    held = held.groupBy("key", "cell").agg(F.sort_array(F.collect_list("m")).alias("m"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("m") - 1) / CELL_MOST).cast("int")), lambda k: F.slice("m", k * CELL_MOST + 1, CELL_MOST))
    cells = saved(held.select("key", "cell", F.posexplode(parts).alias("part", "m")))
    met = lines_.select(F.explode("keys").alias("key"), "id", "own").join(size, "key").where((F.col("n") > 1) | ~F.array_contains("own", F.col("key")))
    met = met.select("key", "id", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    met = met.join(lines_.select("id", "length", "bag", "u", "keys"), "id").join(cells, ["key", "cell"])

    def distance(u: Column) -> Column:
        """Lambda variables hold both lines: each use of a column would copy them."""
        return F.get(F.transform(F.array(F.struct(F.col("u").alias("x"), u.alias("y"))), lambda v: edit_distance(v["x"], v["y"], threshold)), F.lit(0))

    def link(m: Column) -> Column:
        shorter = (m["length"] < F.col("length")) | ((m["length"] == F.col("length")) & (m["id"] < F.col("id")))
        edits = allowed(m["length"], threshold)
        first = F.get(F.filter("keys", lambda k: F.array_contains(m["own"], k)), F.lit(0)) == F.col("key")
        return _similar(F.col("bag"), m["bag"], edits) & shorter & (F.col("length") - m["length"] <= edits) & first & F.coalesce(distance(m["u"]) <= edits, F.lit(False))

    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    mask = F.aggregate(F.sequence(F.lit(0), F.size("m") - 1), F.lit(0).cast("long"), lambda found, j: F.when(link(F.get("m", j)), found.bitwiseOR(bit(j))).otherwise(found))
    hits = saved(met.select("key", "cell", "part", "id", mask.alias("mask"))).where("mask <> 0")
    members = cells.select("key", "cell", "part", F.col("m.id").alias("ids"))
    place = ["key", "cell", "part"]
    low = F.bit_count(F.col("mask").bitwiseAND(-F.col("mask")) - 1).alias("low")
    # Each line is tied to the first that its mask names, and that one to the others of the masks that it begins.
    stars = hits.groupBy(*place, low).agg(F.bit_or("mask").alias("mask"), *[F.sum(F.call_function("getbit", F.col("mask"), F.lit(j)).cast("long")).alias(f"n{j}") for j in range(CELL_MOST)])
    stars = saved(stars.select(*place, "low", "mask", F.array(*[f"n{j}" for j in range(CELL_MOST)]).alias("n")).join(members, place))
    ties = hits.select(*place, "id", low).join(members, place).select(F.col("id").alias("a"), F.get("ids", F.col("low")).alias("b"))
    inner = stars.select(F.get("ids", F.col("low")).alias("a"), F.explode(F.transform(_bits(F.col("mask")), lambda j: F.get("ids", j))).alias("b")).where("a <> b")
    named = stars.select(F.explode(F.transform(_bits(F.col("mask")), lambda j: F.struct(F.get("ids", j).alias("id"), F.get("n", j).alias("n")))).alias("x")).select("x.*")
    naming = hits.groupBy("id").agg(F.sum(F.bit_count("mask")).alias("n"))
    degree = naming.unionByName(named).groupBy("id").agg(F.sum("n").alias("n_links"))
    return known.select("id", "first_doc"), saved(degree), saved(ties.unionByName(inner).distinct())


def line_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """For each different line: id, n_links (other lines within the threshold), class_id (smallest id reached over links), kept_doc.

    kept_doc is the smallest doc_id among the lines' that are first of their class, or null for the other lines of a class.
    """
    known, degree, links = line_links(docs, threshold)
    linked = saved(components(links).join(degree, "id"))
    first = linked.join(known, "id").groupBy("component_id").agg(F.min(F.struct("first_doc", "id")).alias("first"))
    kept = saved(linked.join(first, "component_id").select(F.col("id").alias("of"), "component_id", "n_links", F.col("first.id").alias("first_id")))
    lone = F.col("of").isNull()
    return known.join(kept, F.col("id") == F.col("of"), "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("class_id"), F.when(lone | (F.col("first_id") == F.col("id")), F.col("first_doc")).alias("kept_doc"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """For each document: doc_id, n_lines, n_kept, n_links.

    Takes doc_id and text; other columns are ignored. n_lines counts its different lines, trimmed, empty ones left out; n_kept those
    that no document with a smaller doc_id and no line before them of their class holds; n_links the other lines that its lines
    link to. Null and empty texts have no lines; rows that share a doc_id count as one document; an empty table gives no rows.
    """
    classes = saved(line_classes(docs, threshold))
    each = docs.select("doc_id", F.explode(lines(F.col("text"))).alias("line")).select("doc_id", F.xxhash64("line").alias("id")).distinct()
    marked = each.join(classes, "id").select("doc_id", "n_links", F.coalesce(F.col("kept_doc") == F.col("doc_id"), F.lit(False)).cast("long").alias("kept"))
    counted = marked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("kept").alias("n_kept"), F.sum("n_links").alias("n_links"))
    all_docs = docs.select("doc_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_docs.join(counted.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", zero("n_lines"), zero("n_kept"), zero("n_links"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and the text of each row of docs without lines that are not its own by line_report(); empty lines stay."""
    classes = saved(line_classes(docs, threshold))
    each = docs.select("doc_id", F.explode(lines(F.col("text"))).alias("line")).select("doc_id", F.xxhash64("line").alias("id")).distinct()
    gone = each.join(classes, "id").where(~F.coalesce(F.col("kept_doc") == F.col("doc_id"), F.lit(False))).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("id").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), F.xxhash64(F.trim(x))))
    return docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", F.array_join(kept, "\n").alias("text"))


ORACLE_SQL = """
with recursive each as (
  select distinct doc_id, line from (select doc_id, trim(unnest(string_split(text, chr(10)))) line from documents) where line <> ''),
known as (select line, min(doc_id) first_doc, length(line) n from each group by line),
near as (
  select a.line a, b.line b from known a join known b on b.n between a.n and a.n + 2
  where a.n >= 5 and (a.n < b.n or a.line < b.line) and levenshtein(a.line, b.line) <= least(2, a.n // 5)),
both_ways as (select a, b from near union all select b, a from near),
degree as (select a line, count(*) n_links from both_ways group by a),
reach as (select a line, a other from degree join both_ways on a = line union select r.line, e.b from reach r join both_ways e on r.other = e.a),
classes as (select line, min(other) class from reach group by line),
firsts as (select class, min_by(line, (first_doc, line)) first_line from classes join known using (line) group by class),
marked as (
  select doc_id, coalesce(n_links, 0) n_links, (doc_id = first_doc and (class is null or first_line = line))::int kept
  from each join known using (line) left join degree using (line) left join classes using (line) left join firsts using (class))
select d.doc_id, count(m.kept)::bigint n_lines, coalesce(sum(m.kept), 0)::bigint n_kept, coalesce(sum(m.n_links), 0)::bigint n_links
from (select distinct doc_id from documents) d left join marked m on d.doc_id = m.doc_id group by d.doc_id
"""
