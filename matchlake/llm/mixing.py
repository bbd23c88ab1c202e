"""Mixing sources to target weights along a curriculum.

Sizes are word counts. Sources in code-point order (null last) take the weights in turn; they share ``share`` times
the total size by weight, no source above ``cap`` times its own size, the excess going to the others by weight.
A source's documents form an endless stream: all of them in a pseudo-random, repeatable order, pass after pass.
The curriculum gives each weight class an intensity over training time 0 to 1, linear between its knots; its
integral, scaled to the source's target, is the demand up to a time, and the time at which demand reaches a
document's place in the stream is the document's training position.

Places in the stream are running sums per source. They are taken in two steps, within narrow slots of the order
and over the slots' totals, so that a source of any size is spread over many tasks. Rows equal in doc_id, source and
size are counted first and dealt out again at the end, so that a doc_id of any number of rows is too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch, free, parallelism, sized
from matchlake.llm.text import word_count

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Knots (time, intensity) of each weight class: heavy sources fade out, light ones fade in.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SLOT_ROWS, LEAST_SLOTS = 4096, 256
#: Rows that one counted row gives at once.
COPIES = 4096
#: Steps of an order, 16 bytes each, that may be broadcast to the documents; more are joined by a shuffle.
STEP_ROWS = 500_000


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Of each linear piece: start time, length, start intensity, end intensity, demand before it, as shares of all demand."""
    area = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:])]
    total, before, out = sum(area), 0.0, []
    for (t0, m0), (t1, m1), a in zip(knots, knots[1:], area):
        out.append((t0, t1 - t0, m0 / total, m1 / total, before))
        before += a / total
    return out


def _invert(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a class has seen the share ``u`` of its demand."""
    found = None
    for t0, length, m0, m1, before in reversed(_segments(knots)):
        d = u - F.lit(before)
        t = F.lit(t0) + F.lit(2.0) * d / (F.lit(m0) + F.sqrt(F.lit(m0 * m0) + F.lit(2.0 * (m1 - m0) / length) * d))
        found = t if found is None else F.when(u >= F.lit(found_before), found).otherwise(t)
        found_before = before
    return found


def _targets(totals: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Water-filling over the per-source totals; one row per source, so a single task can order them."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = totals.withColumn("kind", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(filling), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    level = ranked.withColumn("level", left / weight_left).withColumn("full", F.col("most") / F.col("weight") < F.col("level"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full") | open_level.isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * open_level))
    return level.select("source", "source_size", "kind", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document, what the mix takes of it and when, range-sorted by first training position.

    ``doc_id, size, source_size, target, taken, source, positions``: ``taken`` sums the words taken in all passes,
    the last pass of a source ending within a document; ``positions`` holds one training time for each pass that
    takes any, so it is empty for a document left out. Taken words of a source differ from its target by rounding
    only, and no document gives more than ``cap`` times its size.

    Null and blank texts have size 0 and are never taken; very long texts are counted whole; null is a source like
    any other; repeated rows are documents of their own, with equal doc_id and size interchangeable. An empty table
    gives no rows. The result depends on rows only, not on their order or partitioning. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    counted = scratch.save(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "counted")
    key = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    slots = max(LEAST_SLOTS, counted.count() // SLOT_ROWS)
    head = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    slotted = counted.withColumn("key", key).withColumn("slot", F.shiftright(head * F.lit(slots), 32)).withColumn("words", F.col("size") * F.col("n"))
    sums = scratch.save(slotted.groupBy("source", "slot").agg(F.sum("words").alias("slot_size")), "slots")
    targets = _targets(sums.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, cap)
    over_slots = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("slot_size").over(over_slots), F.lit(0)))
    t, b = targets.alias("t"), bases.alias("b")
    bases = scratch.save(b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.slot", "b.base", "t.source_size", "t.kind", "t.target"), "bases")
    within = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slotted.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0))).alias("p")
    b = bases.alias("b")
    placed = placed.join(b, F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.slot") == F.col("b.slot"))).select(
        "p.doc_id", "p.source", "p.size", "p.n", "b.source_size", "b.target", "b.kind", (F.col("b.base") + F.col("p.before")).alias("first")
    )
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition(parallelism(spark), "doc_id", "source", "size", "chunk")
    copies = F.sequence(F.col("chunk") * COPIES, F.least(F.col("n"), (F.col("chunk") + 1) * COPIES) - 1)
    placed = chunks.withColumn("copy", F.explode(copies)).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    wanted = F.floor(F.col("target") + 0.5)
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("start") - F.lit(k) * F.col("source_size"))).cast("long") for k in range(int(cap))]
    at = lambda k: (F.col("start") + F.lit(k) * F.col("source_size")) / F.col("target")
    times = []
    for k in range(int(cap)):
        by_kind = [F.when(F.col("kind") == i, _invert(at(k), c)) for i, c in enumerate(curriculum)]
        times.append(F.when(passes[k] > 0, F.coalesce(*by_kind)))
    out = placed.select("doc_id", "size", "source_size", "target", sum(passes[1:], passes[0]).alias("taken"), "source", F.array_compact(F.array(*times)).alias("positions"))
    return out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def training_positions(plan: DataFrame) -> DataFrame:
    """``doc_id, source, pass, position``: a row for each pass of a plan that takes any of a document's words, passes from 0."""
    return plan.select("doc_id", "source", F.posexplode("positions").alias("pass", "position"))


def training_order(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each pass that takes any of its words, range-sorted by training position.

    Rows that share a doc_id all follow one plan, that of the largest positions, so none is multiplied by the others.
    Null is a doc_id like any other here; an empty table stays empty; columns of ``docs`` may have any names.
    """
    own, at = free(docs, "mix_id", "mix_at")
    steps = plan.groupBy("doc_id").agg(F.max("positions").alias("positions")).select(F.col("doc_id").alias(own), F.explode("positions").alias(at))
    steps = sized(Scratch(docs.sparkSession, "mixing-steps").save(steps, "steps"), STEP_ROWS)
    joined = docs.join(steps, docs[id_col].eqNullSafe(F.col(own)))
    return joined.orderBy(at, own).drop(at, own)


def _inverted_sql(u: str, knots: Sequence[tuple[float, float]]) -> str:
    """SQL of :func:`_invert`."""
    cases = []
    for t0, length, m0, m1, before in _segments(knots):
        d = f"({u} - {before!r}::double)"
        cases.append((before, f"{t0!r}::double + 2.0::double * {d} / ({m0!r}::double + sqrt({m0 * m0!r}::double + {2.0 * (m1 - m0) / length!r}::double * {d}))"))
    return "case " + " ".join(f"when {u} >= {before!r}::double then {t}" for before, t in reversed(cases[1:])) + f" else {cases[0][1]} end" if cases[1:] else cases[0][1]


def _position_sql(k: int) -> str:
    at = f"(cast(p.start + {k} * t.source_size as double) / t.target)"
    return "case t.kind " + " ".join(f"when {i} then {_inverted_sql(at, knots)}" for i, knots in enumerate(CURRICULUM)) + " end"


ORACLE = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(cast(doc_id as varchar)) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, (row_number() over (order by source nulls last) - 1) % 3 as kind, 2.0::double * source_size as most from s),
w as (select *, case kind when 0 then 5 when 1 then 2 else 1 end as weight from r),
f as (
  select *, (1.5::double * cast(sum(source_size) over () as double) - coalesce(sum(most) over o, 0::double))
    / (cast(sum(weight) over () as double) - coalesce(cast(sum(weight) over o as double), 0::double)) as level
  from w window o as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
g as (select *, most / weight < level as full_up, max(case when most / weight < level then null else level end) over () as open_level from f),
t as (select source, source_size, kind, case when full_up or open_level is null then most else least(most, weight * open_level) end as target from g),
p as (
  select d.*, cast(coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start from d),
e as (
  select p.doc_id, p.size, t.source_size, t.target,
    cast(greatest(0, least(p.size, cast(floor(t.target + 0.5) as bigint) - p.start)) as bigint) as first_pass,
    cast(greatest(0, least(p.size, cast(floor(t.target + 0.5) as bigint) - p.start - t.source_size)) as bigint) as second_pass,
    case when t.target > 0 then {_position_sql(0)} end as first_at, case when t.target > 0 then {_position_sql(1)} end as second_at
  from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target, first_pass + second_pass as taken,
  case when first_pass > 0 then round(first_at, 9) end as first_position, case when second_pass > 0 then round(second_at, 9) end as second_position
from e
"""
