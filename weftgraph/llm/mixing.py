"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, saved, text_or_empty, unused

#: Bins of the sampling keys of a source: only the bin in which a budget ends is sorted row by row.
BINS = 4096
#: Above so many sources the table of sources is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
#: Characters that lower a text's quality, as a share of its characters.
NOISE = "*#%&$|!0123456789"


def quality(text: Column) -> Column:
    """A sampling weight from 0.05 to 1: the share of characters that aren't symbols or digits."""
    kept = F.length(F.translate(text, NOISE, "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.05), kept)).otherwise(F.lit(0.05))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target): share of all words by weight, at most `most` times a source's words.

    Sources take the weights in code point order, null last. Resharing what exceeds a cap until nothing
    does is filling water to one level: sources are capped in the order of cap over weight, and the level is the first,
    the highest, at which the next source stays under its cap. The windows hold one row a source.
    """
    place = F.pmod(F.row_number().over(W.Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.Window.orderBy("full_at", F.asc_nulls_last("source"))
    everything = W.Window.partitionBy()
    before, after = order.rowsBetween(W.Window.unboundedPreceding, -1), order.rowsBetween(0, W.Window.unboundedFollowing)
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", F.when(level <= F.col("full_at"), level)).withColumn("level", F.max("level").over(everything))
    free = F.col("level") * F.col("weight")
    return filled.select("source", "source_size", F.when(free < F.col("cap"), free).otherwise(F.col("cap")).alias("target"))


def _drawn(docs: DataFrame, seed: int, weight: Column | None) -> tuple[Column, Column, Column]:
    """Size, sampling key and the key's bin of each row."""
    text = text_or_empty()
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"mix:{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    key = -F.log(u) / (quality(text) if weight is None else weight)
    return F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.least(F.floor(BINS * (1 - F.exp(-key))), F.lit(BINS - 1)).cast("int").alias("bin")


def _budgets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """For each source (`of`): its size, target, complete epochs, the words left, and the bin of keys in which they end, with the words before it."""
    sources = saved(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    # At most BINS rows a source; the last bin that begins within the budget is where it ends.
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    began = bins.withColumn("before", F.coalesce(F.sum("n").over(W.Window.partitionBy("source").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    began = began.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source")))
    ends = began.where(F.col("before") <= F.col("left")).groupBy("of").agg(F.max_by("bin", "bin").alias("end_bin"), F.max_by("before", "bin").alias("before"))
    return saved(sources.join(ends, F.col("of").eqNullSafe(F.col("source")), "left").select(F.col("source").alias("of"), "source_size", "target", "epochs", "left", "end_bin", "before"))


def _few(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and `more`, whether the fraction that is left takes them; only rows with words are taken by it."""
    known = rows.join(_few(plan), F.col("source").eqNullSafe(F.col("of")))
    sides = known.where("bin <> end_bin or end_bin is null").withColumn("more", F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)) & (F.col("size") > 0))
    order = W.Window.partitionBy("source").orderBy("key", "doc_id", "size")
    prefix = F.col("before") + F.sum("size").over(order.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("size")
    edge = known.where("bin = end_bin").withColumn("more", (2 * prefix + F.col("size") <= 2 * F.col("left")) & (F.col("size") > 0))
    return sides.unionByName(edge)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, copies.

    Takes doc_id, text and source; other columns are ignored. A document is taken once for each complete epoch of its
    source, then once more if it falls into the fraction that is left: documents stand by the key -ln(u) / weight
    (u from the seed and doc_id, or the text where that is null; weight from the text's quality), sizes are summed in that order, and those whose middle
    lies within the budget are taken. A null text has size 0; documents without words share their source's epochs only; null sources form one source, the
    last; repeated rows count each; a source without words has target 0 and takes nothing; an empty table gives no rows.
    """
    rows = saved(docs.select("doc_id", "source", *_drawn(docs, seed, weight)))
    copies = (F.col("epochs") + F.col("more").cast("long")).alias("copies")
    return _decided(rows, _budgets(rows, weights, share, most)).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The rows of docs, with all their columns, as the mix takes them, each as often as mix() says.

    The fraction of a source ends at one place in the order of key, doc_id and size, so that rows are told by their source's
    plan and the texts aren't shuffled. Rows equal in all three at that very place are taken together.
    """
    own, plans = unused(docs, "mix"), unused(docs, "plan")
    # The draws are digests, the same when they are made again; so only they are written, not the texts.
    rows = docs.withColumn(own, F.struct("doc_id", "source", *_drawn(docs, seed, weight)))
    few = saved(rows.select(f"{own}.*"))
    plan = _budgets(few, weights, share, most)
    at = F.struct("key", "doc_id", "size")
    last = _decided(few, plan).where("more and bin = end_bin").groupBy(F.col("source").alias("s")).agg(F.max(at).alias("last"))
    plan = saved(plan.join(last, F.col("of").eqNullSafe(F.col("s")), "left").drop("s")).select(F.struct("of", "epochs", "end_bin", "last").alias(plans))
    m, p = (lambda c: F.col(f"{own}.{c}")), (lambda c: F.col(f"{plans}.{c}"))
    before = (m("bin") < p("end_bin")) | ((m("bin") == p("end_bin")) & (F.struct(m("key"), m("doc_id"), m("size")) <= p("last")))
    copies = p("epochs") + (F.coalesce(before, F.lit(False)) & (m("size") > 0)).cast("long")
    found = rows.join(_few(plan), m("source").eqNullSafe(p("of")))
    return found.withColumn(plans, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop(own, plans)


ORACLE_SQL = f"""
with words as (select doc_id, source, coalesce(text, '') t from documents),
rows as (
  select doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint size,
    -ln((('0x' || substr(md5('mix:0:' || coalesce(doc_id::varchar, 'text:' || md5(t))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / case when length(t) > 0 then greatest(0.05, length(translate(t, '{NOISE}', '')) / length(t)) else 0.05 end sampling_key
  from words),
sized as (select source, sum(size)::bigint source_size from rows group by source),
ranked as (
  select source, source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight,
    (2 * source_size)::double cap from sized),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) level from ranked),
leveled as (select *, max(case when level <= cap / weight then level end) over () flat from levels),
targets as (
  select source, source_size, case when flat * weight < cap then flat * weight else cap end target from leveled),
planned as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint epochs from targets),
ordered as (
  select r.doc_id, r.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size rest,
    sum(r.size) over (partition by r.source order by sampling_key, r.doc_id, r.size rows between unbounded preceding and current row) - r.size prefix
  from rows r join planned p on r.source is not distinct from p.source)
select doc_id, size, source_size, target, ((epochs + case when 2 * prefix + size <= 2 * rest then 1 else 0 end) * size)::bigint taken from ordered
"""
