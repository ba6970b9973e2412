"""The training-data operators against brute force, exact round trips and held-out labels; odd rows of every kind."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, common, decontaminate, embedding_dedup, html_extract, line_dedup, lm_score, mixing, queries, sharding, simhash, toxicity

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, shard int, size string, id string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, s, -1, "x", "y") for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "word", None), (5, "long " * 20_000, "b"), (6, "same text here for both of us", "b"), (7, "same text here for both of us", "b"), (7, "same text here for both of us", "b"), (8, "é ü 漢字 \U0001f600 \u0000", "a")]


def rows(df):
    return [tuple(r) for r in df.collect()]


# Sharding and mixing.


def test_minimax_is_optimal_against_all_partitions():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 9))), reverse=True)
        sizes, counts = np.unique(items, return_counts=True)
        sizes, counts = sizes[::-1], counts[::-1]
        shards, cuts, k = rng.randint(1, 4), [], 0
        for c, rank in sharding.minimax_cuts(sizes, counts, shards):
            cuts.append(min(len(items), int(counts[:c].sum()) + rank))
        bounds = [0, *cuts, len(items)]
        best = lambda at, left: sum(items[at:]) if left == 1 else min(max(sum(items[at:e]), best(e, left - 1)) for e in range(at, len(items) + 1))  # noqa: B023, E731
        assert max(sum(items[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) == best(0, shards)


def test_sharding_keeps_groups_and_numbers_slots(spark):
    extra = [(100 + i, f"text {i % 40} " * (i % 7), "c") for i in range(200)]
    out = sharding.shard_documents(documents(spark, ODD + extra), 3).toPandas()
    assert len(out) == len(ODD) + 200
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    texts = {i: t or "" for i, t, _ in ODD + extra}
    where: dict[str, set] = {}
    for r in out.itertuples():
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 1
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    odd = documents(spark, ODD).withColumn("slot", F.lit("own")).withColumn("a.b", F.lit(1)).withColumn("_key", F.lit(1))
    whole = sharding.sharded(odd, 2)  # shard and slot are taken
    assert whole.columns == [*odd.columns, "shard_", "slot_"] and whole.where("shard = -1 and slot = 'own'").count() == len(ODD)
    assert whole.select("shard_", "slot_").distinct().count() == len(ODD)


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    made = ODD + [(1000 + i, "w " * rng.randint(0, 30), rng.choice("abcdef")) for i in range(600)]
    df = documents(spark, made)
    out = mixing.mix(df)
    by = out.join(df.select("doc_id", "source"), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    targets = by.groupby("source", dropna=False)["target"].first()
    sizes = by.groupby("source", dropna=False)["source_size"].first()
    assert targets.sum() == pytest.approx(1.5 * sizes.sum()) and (targets <= 2 * sizes + 1e-9).all()
    for source, part in out.join(df.select("doc_id", "source").distinct(), "doc_id").toPandas().groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(part["size"])
        assert (part["taken"] <= 2 * part["size"]).all()
    assert rows(out.orderBy("doc_id", "taken")) == rows(mixing.mix(df).orderBy("doc_id", "taken"))
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, ODD[:3])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed(df).columns == df.columns
    odd = df.withColumn("mix", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("plan", F.lit(3)).withColumn("_copies", F.lit(4))
    whole = mixing.mixed(odd)
    assert whole.columns == odd.columns
    taken = lambda t: sorted(r["doc_id"] for r in t.collect())
    assert taken(whole.where("doc_id >= 1000")) == sorted(i for r in out.where("doc_id >= 1000").collect() for i in [r["doc_id"]] * r["copies"])
    wordless = documents(spark, [(i, " ", "a") for i in range(20)] + [(100, "a b c", "a"), (101, "c d", "b"), (102, None, "z")])
    assert mixing.mixed(wordless).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2 and mixing.mixed(wordless).where("doc_id = 102").isEmpty()


# Near duplicates.


def slow_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reached(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(x) for x in range(n)]


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    made = list(ODD)
    for k in range(60):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.randint(1, 4)):
            made.append((100 + len(made), " ".join(base), "s"))
            base[rng.randrange(len(base))] = rng.choice(words)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(documents(spark, made)).collect()}
    ids = sorted(found)
    texts = {i: t for i, t, _ in made}
    prints = [slow_fingerprint(texts[i], 3) for i in ids]
    assert [found[i][0] for i in ids] == [f"{p:016x}" for p in prints]
    roots = smallest_reached(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert [found[i][1] for i in ids] == [ids[r] for r in roots]
    assert simhash.simhash_groups(documents(spark, [])).count() == 0
    odd = documents(spark, made).withColumn("a.b", F.lit(1)).withColumn("of", F.lit(2))
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({ids[r] for r in roots})


def test_trie_links_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (20, 2))]]))
    found = {tuple(sorted(p)) for x, y in simhash.trie_links(values, 0, 2) for p in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert found == true


def test_saved_tables_start_no_more_processes_than_needed(spark):
    table = common.saved(spark.range(900).repartition(30), 900)
    files = list(Path(table._scratch.removeprefix("file:")).iterdir())
    parts = [f for f in files if f.name.startswith("part-")]
    assert not [f for f in files if f.suffix == ".crc"] and len(parts) <= spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in table.collect()) == list(range(900))
    assert common.saved(spark.range(common.FILE * 9).repartition(30), 1).count() == common.FILE * 9  # a bound that is too low drops nothing
    # Damage is still found.
    damaged = max(parts, key=lambda f: f.stat().st_size)
    content = bytearray(damaged.read_bytes())
    content[len(content) // 4] ^= 1
    damaged.write_bytes(content)
    with pytest.raises(Exception, match="CRC checksum"):
        table.agg({"id": "sum"}).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 500), (159, 60)]
    out = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    assert {out[i] for i in range(1, 41)} == {1} and {out[i] for i in range(100, 160)} == {60} and out[500] == 500


def distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(25):
        base = [rng.choice("abcdé ") for _ in range(rng.randint(8, 30))]
        for _ in range(rng.randint(1, 5)):
            lines.append("x" + "".join(base) + "y")
            for _ in range(rng.randint(1, 2)):
                k, kind = rng.randrange(len(base)), rng.random()
                if kind < 0.3:
                    base.insert(k, rng.choice("abcd"))
                elif kind < 0.6 and len(base) > 5:
                    base.pop(k)
                else:
                    base[k] = rng.choice("abcd")
    short = ["Read more", "Read more.", "Read  more", "Share", "Share!", "Shar", "abcd", "abce", "ab", "a", "é漢字😀x", "é漢字😀y", "Read moreover", "Read mores", "next page >", "next page", "next pages >"]
    many = [f"{'template ' * 8}{k:05d} and so on" for k in range(0, 1500, 7)]  # more than a cell under one key
    made = ODD + [(100 + i, "\n".join(rng.choices(lines + short, k=4)), "s") for i in range(80)] + [(500, "\n".join(many), "s")]
    df = documents(spark, made)
    texts = {x.strip(" ") for _, t, _ in made for x in (t or "").split("\n") if x.strip(" ")}
    hashed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t")).collect()
    names = [t for t, _ in sorted(map(tuple, hashed), key=lambda x: x[1])]
    ids = {t: i for t, i in map(tuple, hashed)}
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 5)
    true = {(a, b) for a in range(len(names)) for b in range(a) if near(names[a], names[b])}
    roots = smallest_reached(len(names), lambda a, b: (a, b) in true)
    found = {r["id"]: r for r in line_dedup.line_classes(df).collect()}
    assert len(found) == len(names) and all(found[ids[t]]["n_links"] == sum(k in p for p in true) for k, t in enumerate(names))
    assert [found[ids[t]]["class_id"] for t in names] == [ids[names[r]] for r in roots] and len(set(roots)) < len(roots)
    report = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert report[1]["n_lines"] == 0 and report[7]["n_kept"] == 0 and report[6]["n_kept"] == 1
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(df).collect()}
    assert cleaned[6] and cleaned[7] == "" and cleaned[2] == ""
    assert line_dedup.line_report(documents(spark, [])).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    made = [(i, [float(x) for x in rng.standard_normal(8)], int(rng.integers(0, 2))) for i in range(150)]
    for k in range(150, 400):
        of = made[int(rng.integers(0, 30))]
        made.append((k, [x + float(e) for x, e in zip(of[1], rng.normal(0, rng.choice([0.0, 0.05, 0.2]), 8), strict=True)], of[2]))
    made += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, made[0][1], None), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*m, "x", 3) for m in made], "vec_id long, embedding array<float>, label int, id string, n int")
    held = {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in df.where("vec_id < 900 or vec_id > 904").collect()}
    ids = sorted(held)

    def linked(a, b):
        (x, p), (y, q) = held[ids[a]], held[ids[b]]
        return p == q and len(x) == len(y) and float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)) >= 0.98

    roots = smallest_reached(len(ids), linked)
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(df).collect()}
    assert [out[i]["component_id"] for i in ids] == [ids[r] for r in roots]
    assert [out[i]["n_links"] for i in ids] == [sum(linked(a, b) for b in range(len(ids)) if b != a) for a in range(len(ids))]
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in range(900, 905)) and len(out) == len(made)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


# Texts.


def test_html_extraction():
    model = html_extract.trained()
    wrong = total = 0
    for page, main in html_extract.labelled_pages(60, seed=99):
        blocks = list(html_extract.leaf_blocks(page))
        for (text, _), keep in zip(blocks, model.decode([f for _, f in blocks]), strict=True):
            wrong, total = wrong + (keep != (text in main)), total + 1
    assert wrong / total < 0.02
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two &eacute;<p>Three <b>four</b>, five.</article><div class='comments'><p>Nice!</p></div><footer>&copy; x</footer>"
    assert html_extract.extract(page, model) == "A & B\nOne two é\nThree four, five."
    for nest in ("div", "span", "b", "section"):  # however deep
        for depth in (5, 450, 5000):
            assert html_extract.extract(f"<body><nav><a href=/>Home</a></nav><article>{f'<{nest}>' * depth}<p>A deep story, told in full here.</p>{f'</{nest}>' * depth}<p>It goes on, and ends.</p></article>", model) == "A deep story, told in full here.\nIt goes on, and ends."
    assert html_extract.extract("<article><p>Let <math><mi>x</mi></math> be a number, <object>or so</object> they say.</p></article>", model) == "Let x be a number, or so they say."
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "</p></div>", "<a href='x>y", "<div>" * 3000 + "x"):
        assert isinstance(html_extract.extract(odd, model), str)


def test_html_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<article><p>Some words here.</p></article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(rows(html_extract.extract_pages(df)), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "Some words here.", 16)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    calm = ["river", "stone", "cloud", "window", "garden", "letter", "music", "winter", "paper", "light"]
    made, labels = [], []
    for i in range(900):
        words = rng.choices(calm, k=rng.randint(5, 40))
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumblok", "snarvick", "zorbatha"]))
        made.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, made)
    model = toxicity.fit(docs, known)
    out = toxicity.score_documents(docs, model).join(known, "doc_id").where(toxicity.held_out(3, 1) & F.col("toxic").isNotNull())
    assert out.where((F.col("score") >= 0.7).cast("int") != F.col("toxic")).count() == 0 and out.count() > 100
    score = model.scorer()
    for hidden in ("grumbl0k", "g r u m b l o k", "gruuumblok", "z.o.r.b.a.t.h.a", "sn@rvick", "SNARVICK!!", "zorb-atha"):
        assert score(f"the river and {hidden} in the garden") >= 0.7, hidden
    for clean in (None, "", "river " * 50_000, "2019 1000 3.14", "a b c d e f g", "letter!!! @home http://x.y/z?q=1"):
        assert score(clean) < 0.7
    assert toxicity.without_toxic(documents(spark, ODD), model).count() == len(ODD)
    nothing = toxicity.fit(docs, known.limit(0))
    assert not nothing.weights and toxicity.score_documents(docs.limit(0), nothing).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 90)))) for k in range(40)] + [(77, None), (78, ""), (None, "a b c d e f g")]
    made = list(ODD)
    for k in range(120):
        text = rng.choices(words, k=rng.randint(0, 3000))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:40])[1].split()
            cut = item[: max(5, int(len(item) * rng.choice([0.7, 0.85, 1.0])))]
            at = rng.randint(0, len(text))
            text[at:at] = cut
        made.append((100 + k, ", ".join(text).upper(), "s"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontaminate._WORD.findall((t or "").lower())] for i in range(len(w) - 4)}
    sets = {i: grams(t) for i, t in items if i is not None and grams(t)}
    out = {r["doc_id"]: r["item_ids"] for r in decontaminate.contained_items(documents(spark, made), bench).collect()}
    true = {i: sorted(k for k, s in sets.items() if len(s & grams(t)) >= 0.8 * len(s)) for i, t, _ in made}
    assert out == true and any(true.values())
    whole, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 3000  # several blocks
    try:
        again = decontaminate.contained_items(documents(spark, made), bench)
        assert {r["doc_id"]: r["item_ids"] for r in again.collect()} == true
        assert decontaminate.without_contaminated(documents(spark, made), bench).count() == sum(not true[i] for i, _, _ in made)
    finally:
        decontaminate.BLOCK_BYTES = whole
    kept = decontaminate.without_contaminated(documents(spark, made), bench)
    assert kept.count() == sum(not true[i] for i, _, _ in made) and kept.columns == documents(spark, []).columns
    assert decontaminate.contained_items(documents(spark, made), bench.limit(0)).where(F.size("item_ids") > 0).isEmpty()


def test_lattice_sums_all_segmentations():
    pieces, logs, octets = lm_score.vocabulary(lm_score.VOCABULARY)
    lattice = lm_score.Lattice(pieces, logs, octets)

    def slow(word):
        text, total = "▁" + word, [0.0] * (len(word) + 2)
        total[0] = 1.0
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - lm_score.LONGEST), j):
                if (k := lattice.ids.get(text[i:j])) is not None:
                    total[j] += total[i] * math.exp(logs[k])
                elif j == i + 1:
                    total[j] += total[i] * math.exp(sum(logs[b] for b in lattice.spelled(text[i])))
        return math.log(total[-1])

    words = ["the", "thereafter", "zq", "naïve", "漢字", "a" * 60, "thatthtion", "x"]
    assert lattice.score(words) == pytest.approx([slow(w) for w in words])
    assert [lattice._one(w) for w in words] == pytest.approx([slow(w) for w in words])
    assert math.isfinite(lattice._one("x" * 100_000))


def test_lm_scores(spark):
    made = ODD + [(50 + i, f"the Cat sat on mat{i % 5} and DOG{i}", "s") for i in range(40)]
    df = documents(spark, made)
    out = {r["doc_id"]: r for r in lm_score.score_documents(df).collect()}
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", toxicity.held_out(7, 2).alias("h")).collect()}
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    counts: dict = {}
    for i, t, _ in made:
        if not held[i]:
            for w in [*split(t), "END"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    once, twice = (sum(c == k for w, c in counts.items() if w != "END") for k in (1, 2))
    discount = once / (once + 2 * twice)
    lattice = lm_score.Lattice(*lm_score.vocabulary(lm_score.VOCABULARY))

    def model(word):
        if word == "END":
            return math.log10(counts["END"] / n)
        pieces = discount * v / n * math.exp(lattice._one(word.decode()))
        return math.log10(pieces + max(0, counts.get(word, 0) - discount) / n) if pieces or word in counts else math.log10(discount * v / n) + lattice._one(word.decode()) / math.log(10)

    for i, t, _ in made:
        assert out[i]["score"] == pytest.approx(sum(map(model, [*split(t), "END"])))
        tokens = [*split(t), "END"]
        assert out[i]["n_tokens"] == len(tokens) and out[i]["n_known"] == sum(w in counts for w in tokens) and out[i]["train_tokens"] == n
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
        assert out[i]["score"] < 0 and math.isfinite(out[i]["score"]) and out[i]["held_out"] == held[i]
    assert lm_score.score_documents(df.limit(0)).count() == 0


def test_lm_scores_shuffle_few_bytes(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.2, 300) % 50_000) for _ in range(600)]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert lm_score.score_documents(df).agg(F.count("score")).first()[0] == 600
    # A word of a block costs its letters twice, its place, its score and its count.
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 1.6 * sum(map(len, texts))
    for kind in (np.int32, np.int64, np.float64):
        for n in (0, 1, 1000):
            a = (rng.random(n) * 1e6 - 5e5).astype(kind)
            assert (lm_score._unpacked(lm_score._packed(a), kind) == a).all()


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST] <|user|> <\\|x|\\> <<SYS>> || [|"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", " leading é漢😀 and\n\n trailing \n"), (1, 2, "assistant", control), (2, 0, None, None), (2, 0, "a|>b", control), (2, 1, "assistant", ""), (3, None, "assistant", "x" * 30_000), (3, None, "assistant", "x" * 30_000), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, turns string").drop("turns")
    made = chat_format.format_conversations(df)
    out = {r["conv_id"]: r for r in chat_format.digests(made).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in made.collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert chat_format.read_back(texts[conv]) == [(r, t) for _, _, _, r, t in own]
        loss = "".join(t for _, _, _, r, t in own if r == "assistant")
        assert out[conv]["n_turns"] == len(own) and out[conv]["loss_chars"] == len(loss)
        assert out[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[conv]["formatted_chars"] == len(texts[conv])
    for text in (control, "a\\|>b", "<\\\\|", "|>|>", "<<|>", "</s></s>"):
        assert chat_format.unescape(chat_format.escape(text)) == text
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


# Queries and the pipeline.


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline_against_its_stages_by_hand(spark):
    import corpus_pipeline as c

    docs = common.table(spark, D, "documents")
    texts = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, common.table(spark, D, "labels"))
    score = model.scorer()
    left = sorted(i for i, r in texts.items() if score(r["text"]) < 0.7)
    left = c_near(left, texts)
    items = [decontaminate.Index([(r["item_id"], r["text"])]).sets[0] for r in common.table(spark, D, "benchmark").collect()]
    words = decontaminate._Words()
    clean = [i for i in left if not any(len(s) and np.isin(s, decontaminate.shingles(texts[i]["text"], words)).mean() >= 0.8 for s in items)]
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(clean)))
    want = sorted(i for r in mixed.collect() for i in [r["doc_id"]] * r["copies"])
    out = c.run(spark, D)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == want
    assert {*docs.columns} <= {*out.columns} and out.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").isEmpty()


def c_near(ids, texts):
    prints = [slow_fingerprint(texts[i]["text"], 3) for i in ids]
    sets = [set(simhash.shingle_hashes(texts[i]["text"], 5).tolist()) for i in ids]

    def near(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 2 or bool(sets[a]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))

    return sorted({ids[r] for r in smallest_reached(len(ids), near)})


def test_crowded_prefixes_are_dealt_again(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 24, (6, 40)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (6, 40)).astype(np.uint64))]).ravel())
    nodes = spark.createDataFrame([(k, int(v.view(np.int64))) for k, v in enumerate(values)], "id long, fp long")
    roots = smallest_reached(len(values), lambda a, b: int(values[a] ^ values[b]).bit_count() <= 2)
    for hot in (5, 50_000):
        found = dict(rows(common.components(simhash.linked(nodes, hot=hot))))
        assert [found.get(k, k) for k in range(len(values))] == roots


def test_whole_groups():
    keys = [1] * 3 + [2] + [3] * 40 + [4, 5, 5, 6]
    batches = [pa.record_batch([pa.array(keys[k : k + 4], pa.int64())], names=["key"]) for k in range(0, len(keys), 4)]
    tables = list(common.whole_groups(iter(batches), lambda t: [t.column("key").to_numpy()], rows=6))
    assert [k for t in tables for k in t.column("key").to_pylist()] == keys and len(tables) > 1
    ends = [(t.column("key")[0].as_py(), t.column("key")[-1].as_py()) for t in tables]
    assert all(a[1] != b[0] for a, b in zip(ends, ends[1:], strict=False)) and not list(common.whole_groups(iter([]), lambda t: []))


def test_near_copies(spark):
    rng = random.Random(12)
    made = list(ODD)
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        made.append((1000 + 10 * k, " ".join(base), "s"))
        for c in range(1, 4):  # a word in 60 differs: five-word shingles stay similar to 0.85 or more
            copy = list(base)
            for at in rng.sample(range(len(copy)), len(copy) // 60):
                copy[at] = f"w{rng.randrange(5000)}"
            made.append((1000 + 10 * k + c, " ".join(copy), "s"))
    found = dict(rows(common.components(simhash.near_copies(documents(spark, made)))))
    copies = [i for i, _, _ in made if i >= 1000]
    assert sum(found.get(i) == i // 10 * 10 for i in copies) >= 0.97 * len(copies)
    assert {i for i in found if i < 1000} == {6, 7}
    kept = {r["doc_id"] for r in simhash.one_of_each_group(documents(spark, made), near=True).collect()}
    assert {i for i in copies if i % 10 == 0} <= kept and len(kept & set(copies)) <= 43
    assert simhash.near_copies(documents(spark, [])).count() == 0


def test_near_copies_against_exact_jaccard(spark):
    rng = random.Random(21)
    made = list(ODD)
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 200))]
        made.append((1000 + len(made), " ".join(base), "s"))
        for _ in range(8):  # words changed one by one or in a row, similarities on both sides of 0.8
            copy, n = list(base), max(1, int(len(base) * rng.uniform(0.01, 0.12)))
            start = rng.randrange(len(copy) - n)
            for at in rng.choice([rng.sample(range(len(copy)), max(1, n // 3)), range(start, start + n)]):
                copy[at] = f"w{rng.randrange(5000)}"
            made.append((1000 + len(made), " ".join(copy), "s"))
    texts = {i: t for i, t, _ in made}
    ids = sorted(texts)
    sets = [set(simhash.shingle_hashes(texts[i], 5).tolist()) for i in ids]
    roots = smallest_reached(len(ids), lambda a, b: bool(sets[a]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    found = dict(rows(common.components(simhash.near_copies(documents(spark, made)))))
    assert [found.get(i, i) for i in ids] == [ids[r] for r in roots]


def test_toxicity_in_other_spellings():
    words = ["river", "stone", "cloud", "window", "garden", "letter", "music", "winter", "paper", "light", "the", "and", "in", "a", "grass", "shirt", "grumblok", "snarvass"]
    letters: dict[str, int] = {}
    for word in words:
        padded = f"  {word} "
        for k in range(2, len(padded)):
            for g in (padded[k], padded[k - 1 : k + 1], padded[k - 2 : k + 1]):
                letters[g] = letters.get(g, 0) + 300
    score = toxicity.Toxicity(toxicity.CharacterModel(letters), {" grumblok ": 6.0, " snarvass ": 6.0}).scorer()
    for hidden in ("g r u m b l o k", "g  r  u  m  b  l  o  k", "g . r . u . m . b . l . o . k", "g r u m b 1 0 k", "a g r u m b l o k", "g r u m b l o k a", "gr um bl ok", "snarva$$", "snarva$$.", "(snarva$$)", "s n @ r v a $ $", "grrumblok", "gruumbllok", "(grumbl0k)", "grumbl0k!!"):
        assert score(f"the river and {hidden} garden") >= 0.7, hidden
    for clean in ("a b c d e f g", "grass! shirt+", "1 2 3 4 5", "! ! ! !", "in a in a in a", "a b " * 30_000, "letter!!! (garden) @home"):
        assert score(clean) < 0.7, clean[:40]
