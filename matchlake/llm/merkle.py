"""A Merkle manifest of a dataset in an external-memory node store.

Leaves are sorted once into runs, and their place in the files of that sort gives each its position within its group. A
level of the tree is one Parquet table, bucketed and sorted by coordinate: the group, the block that a node lies in, and
its position. A block is a whole subtree over ``FAN ** DEPTH`` leaves, so all its levels lie in the same bucket: the next
level is one scan of the last in the order of its files, where a window of a block looks ahead within runs of ``FAN``
nodes, and nothing is shuffled. The nodes that are left, one of each block, are dealt anew as the leaves of the next tier.

Proofs are taken from the top: a merge of each level with the one above, by coordinate, puts a node's siblings before the
proof of its parent. All levels of a tier are bucketed alike, so these merges shuffle nothing either. The roots of the
groups are the leaves of one more tree of the same kind, in the order of the groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch, held, parallelism, placed, sized

#: Nodes that make a parent, and levels of a block.
FAN, DEPTH = 3, 8
#: Sources whose proofs, some hundred bytes each, may be broadcast.
FEW_SOURCES = 20_000
#: What a row's leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = ["grp", "block"]
PATH = "array<struct<l:binary,r:binary>>"
#: Lets Spark see that a bucket of one file is sorted; it looks at the files when it plans.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _hex(digest: Column) -> Column:
    """Lower-case hex of bytes; nothing for null."""
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def _digest(*parts: Column) -> Column:
    """SHA-256, as bytes, of texts put together."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _stated(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row of ``documents``, with other values for the columns that ``changed`` names."""
    return _digest(*[_stated(changed.get(name, F.col(name))) for name in FIELDS])


class NodeStore:
    """Trees over the leaves of each group, level by level, as bucketed tables in a folder of shared storage."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, carried: tuple[str, ...] = ()):
        """``leaves (grp, pos, n, digest, ...)``: positions of a group are 0 to ``n - 1``; the lowest level keeps ``carried``."""
        self.spark, self.scratch, self.name = scratch.spark, scratch, name
        self.buckets, self.token = parallelism(self.spark), uuid.uuid4().hex[:16]
        self.carried = carried
        most = leaves.agg(F.max("n")).first()[0] or 0
        with held(self.spark, SORTED_SCAN, "true"):
            self.levels = [self._write(self._dealt(leaves.select("grp", "pos", "n", "digest", *carried)))]
            while most > 1:
                above, most = self._parents(self.levels[-1]), -(-most // FAN)
                self.levels.append(self._write(above if len(self.levels) % DEPTH else self._dealt(above)))

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        """The lowest level of a tier, by block."""
        return nodes.withColumn("block", F.expr(f"pos div {FAN**DEPTH}")).repartition(self.buckets, *BLOCK)

    def _write(self, nodes: DataFrame) -> DataFrame:
        """A level; rows that are dealt by block make one sorted file a bucket."""
        level = len(getattr(self, "levels", ()))
        table = f"nodes_{self.token}_{self.name}_{level}"
        to = nodes.write.format("parquet").bucketBy(self.buckets, *BLOCK).sortBy(*BLOCK, "pos").option("compression", "zstd")
        to.option("path", self.scratch.at(f"{self.name}/level={level}")).saveAsTable(table)
        return self.spark.table(table)

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for level in range(len(self.levels)):
            self.spark.sql(f"drop table if exists nodes_{self.token}_{self.name}_{level}")

    @staticmethod
    def _parents(level: DataFrame) -> DataFrame:
        """The next level: a node of every run of FAN positions, the last of a group as long as it is."""
        ahead = Window.partitionBy(*BLOCK).orderBy("pos")
        after = [F.lead("digest", k).over(ahead).alias(f"d{k}") for k in range(1, FAN)]
        runs = level.where("n > 1").select(*BLOCK, "pos", "n", "digest", *after).where(F.col("pos") % FAN == 0)
        made = _digest(_hex(F.col("digest")), *[_hex(F.col(f"d{k}")) for k in range(1, FAN)])
        return runs.select(*BLOCK, F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), made.alias("digest"))

    @staticmethod
    def _siblings() -> Column:
        """The others of a node's run, before and after it; each digest has its own length, so they need no separator."""
        near, at, none = Window.partitionBy(*BLOCK).orderBy("pos"), F.col("pos") % FAN, F.lit(b"")
        before = [F.when(at >= k, F.lag("digest", k).over(near)) for k in range(FAN - 1, 0, -1)]
        after = [F.when(at + k < FAN, F.lead("digest", k).over(near)) for k in range(1, FAN)]
        return F.struct(*[F.concat(*[F.coalesce(d, none) for d in some]).alias(c) for some, c in ((before, "l"), (after, "r"))])

    def roots(self) -> DataFrame:
        """``grp, root`` of every group."""
        found = [level.where("n = 1").select("grp", F.col("digest").alias("root")) for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return self.scratch.save(out, f"{self.name}/roots")

    def proofs(self) -> DataFrame:
        """The lowest level, with ``inner``, what a leaf's proof holds within its block, and all that it holds beyond, ``outer``."""
        outer = None
        for lowest in range((len(self.levels) - 1) // DEPTH * DEPTH, -1, -DEPTH):
            inner = None
            for k in range(min(lowest + DEPTH, len(self.levels)) - 1, lowest - 1, -1):
                own = F.when(F.col("n") > 1, F.array("own")).otherwise(F.array().cast(PATH)) if k < len(self.levels) - 1 else F.array().cast(PATH)
                nodes = self.levels[k].withColumn("own", self._siblings()) if k < len(self.levels) - 1 else self.levels[k]
                if inner is not None:
                    above = inner.select("grp", "block", F.col("pos").alias("up"), F.col("inner").alias("rest"))
                    nodes = nodes.withColumn("up", F.expr(f"pos div {FAN}")).join(above.hint("merge"), [*BLOCK, "up"], "left")
                    own = F.concat(own, F.coalesce("rest", F.array().cast(PATH)))
                inner = nodes.select(*BLOCK, "pos", "digest", own.alias("inner"), *(self.carried if not k else ()))
            if outer is None:
                inner = inner.withColumn("outer", F.array().cast(PATH))
            else:
                beyond = outer.select("grp", F.col("pos").alias("block"), F.concat("inner", "outer").alias("outer"))
                inner = inner.join(beyond.hint("merge"), BLOCK, "left").withColumn("outer", F.coalesce("outer", F.array().cast(PATH)))
            outer = self.scratch.save(inner, f"{self.name}/proofs-{lowest}") if lowest else inner
        return outer


class Manifest:
    """The trees over a table of documents: one for each source, and one over their roots."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "merkle")
        save = self.scratch.save
        text = F.col("text").cast("string")
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        changed = F.when(chosen & text.contains("\n"), leaf(text=F.replace(text, F.lit("\n"), F.lit(""))))
        key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
        hashed = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("at"))
        order = ["key", "doc_id", "digest", "at"]
        runs = save(save(hashed, "hashed").repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).drop("at"), "runs")
        rows = placed(runs, "place")
        groups = save(rows.groupBy("key").agg(F.min("place").alias("grp"), F.count("*").alias("n")), "groups")
        leaves = rows.join(sized(groups), "key").withColumn("pos", F.col("place") - F.col("grp"))
        self.leaves = NodeStore(leaves, self.scratch, "leaves", ("doc_id", "changed"))
        subroots = save(self.leaves.roots().repartitionByRange(parallelism(spark), "grp").sortWithinPartitions("grp"), "subroots")
        count = subroots.count()
        tops = save(placed(subroots, "pos").select(F.lit(0).cast("long").alias("grp"), "pos", F.lit(count).cast("long").alias("n"), F.col("root").alias("digest"), F.col("grp").alias("source_grp")), "tops")
        self.tops = NodeStore(tops, self.scratch, "tops", ("source_grp",))
        found = self.tops.roots().first()
        self.root = bytes(found.root).hex() if found else None

    def rows(self) -> DataFrame:
        """A row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
        tops = self.tops.proofs().select(F.col("source_grp").alias("grp"), F.col("digest").alias("subroot"), F.concat("inner", "outer").alias("of_source"))
        tops = sized(self.scratch.save(tops, "of-sources"), FEW_SOURCES)
        every = self.leaves.proofs().join(tops, "grp").withColumn("path", F.concat("inner", "outer", "of_source"))
        hashed = lambda *parts: F.sha2(F.concat(*parts), 256)
        proof = F.array_join(F.transform("path", lambda p: F.concat(_hex(p["l"]), _hex(p["r"]))), "")
        folded = F.aggregate("path", _hex(F.coalesce("changed", "digest")), lambda acc, p: hashed(_hex(p["l"]), acc, _hex(p["r"])))
        root = F.lit(self.root).cast("string")
        rows = every.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
        return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

    def close(self) -> None:
        self.leaves.close(), self.tops.close()


def manifest(docs: DataFrame) -> DataFrame:
    """Build the trees over ``docs``, tamper with some rows, and fold every row's leaf up to the root by its proof.

    A leaf is the digest of a row's columns FIELDS; null is told from the empty text, very long texts are hashed whole,
    and other columns play no part, whatever their names. Sources are ordered bytewise, null first, and a source's leaves
    by doc_id, null first; repeated ids follow in the order of their digests, and equal rows are leaves of their own.
    Rows without doc_id are never tampered with. A single row is its own root and has the proof of nothing; an empty table
    gives no rows.
    """
    made = Manifest(docs)
    rows = made.rows()
    made.close()
    return rows


#: CRC-32 of a decimal number in SQL: eight steps of the reflected polynomial for each of its characters.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint for i in range(8)]), lambda s, i: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)))"""
ORACLE = f"""
with recursive d as (
  select doc_id, source, text, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id::varchar, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars::varchar, '-') as head,
    coalesce({_CRC} % 2 = 0, false) as chosen
  from documents),
h as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    case when chosen then replace(text, chr(10), '') else text end as t, head from d),
l as (
  select doc_id, source, leaf, sha256(head || coalesce(octet_length(encode(t)) || ':' || t, '-')) as changed,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from h),
nodes as (
  select 0 as lv, source, pos, n, leaf as digest from l
  union all
  select lv + 1, source, pos // 3, (n + 2) // 3, sha256(digest || coalesce(d1, '') || coalesce(d2, '')) from (
    select *, lead(digest, 1) over w as d1, lead(digest, 2) over w as d2 from nodes where n > 1 window w as (partition by source order by pos)) where pos % 3 = 0),
runs as (select lv, source, pos // 3 as up, list(digest order by pos) as ds from nodes where n > 1 group by all),
subs as (select source, digest as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as lv, pos, n, subroot as digest from subs
  union all
  select lv + 1, pos // 3, (n + 2) // 3, sha256(digest || coalesce(d1, '') || coalesce(d2, '')) from (
    select *, lead(digest, 1) over w as d1, lead(digest, 2) over w as d2 from tops where n > 1 window w as (order by pos)) where pos % 3 = 0),
top_runs as (select lv, pos // 3 as up, list(digest order by pos) as ds from tops where n > 1 group by all),
root as (select digest as root from tops where n = 1),
walk as (
  select doc_id, leaf, source, 0 as lv, pos, n, false as top, '' as proof, changed as folded, row_number() over () as k from l
  union all
  select w.doc_id, w.leaf, w.source, case when ends then 0 else w.lv + 1 end, case when ends then s.pos else w.pos // 3 end, case when ends then s.n else (w.n + 2) // 3 end,
    w.top or ends, case when ends then w.proof else w.proof || before || after end, case when ends then w.folded else sha256(before || w.folded || after) end, w.k
  from (select *, n = 1 and not top as ends from walk where n > 1 or not top) w
  join subs s on s.source is not distinct from w.source
  left join runs r on not w.top and not w.ends and r.lv = w.lv and r.source is not distinct from w.source and r.up = w.pos // 3
  left join top_runs t on w.top and t.lv = w.lv and t.up = w.pos // 3,
  lateral (select coalesce(r.ds, t.ds) as run) x,
  lateral (select coalesce(list_aggregate(run[:w.pos % 3], 'string_agg', ''), '') as before, coalesce(list_aggregate(run[w.pos % 3 + 2:], 'string_agg', ''), '') as after) y)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from walk w join subs s on s.source is not distinct from w.source cross join root where w.top and w.n = 1
"""
