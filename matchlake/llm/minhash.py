"""Near-duplicate groups by MinHash.

Every document's set of word shingles gets about HASHES minima of multiply-shift universal hashes, in bands of as many
as leave the chance to miss a pair as small as stated. Equal sets are collapsed to one node first, so exact copies
never meet each other. Nodes that agree on all minima of a band share a bucket; long bands keep sets that are half
alike mostly apart. Within a bucket every node is a candidate of one hub, the node that shares most buckets with
others. Candidates whose signatures agree often enough are confirmed by the exact intersection of full shingle
sets, and confirmed links become components. Pairs that a hub did not bring together are found in blocks: nodes of
a bucket that lie outside its largest component are compared, by signature, with the bucket's nodes of other
components, in the first bucket that both share, and those that agree are tested on full sets within the block,
which gives links and no pairs. Only pairs within one component are skipped, so no link that would join two
components is lost, and no bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.components import connected_components
from matchlake.llm.scratch import Scratch, sized, small_batches
from matchlake.llm.shingles import mix, shingles_of, words_of

#: Minima of a document at most, over all bands.
HASHES = 200
#: Rows of each side that are compared at once.
BLOCK = 256
#: Chance, for one pair exactly at the threshold, of sharing no bucket or of being refused by its signature.
MISS_BANDS, MISS_SIGNATURE = 1e-6, 1e-6


def shape_for(threshold: float) -> tuple[int, int]:
    """Rows a band and bands: the most rows whose bands, MISS_BANDS being kept, have HASHES minima or fewer."""
    bands = lambda rows: math.ceil(math.log(MISS_BANDS) / math.log(1 - threshold**rows)) if threshold < 1 else 1
    rows = max((r for r in range(1, 17) if r * bands(r) <= HASHES), default=1)
    return rows, bands(rows)


def least_agreeing(hashes: int, threshold: float) -> int:
    """The largest count of agreeing minima that a pair at the threshold misses with chance MISS_SIGNATURE at most."""
    tail = 0.0
    for k in range(hashes + 1):
        tail += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if tail > MISS_SIGNATURE:
            return k
    return hashes


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, hashes, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Top 32 bits of the least value of each hash over the set."""
    best = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 1024):
        best = np.minimum(best, (shingles[lo : lo + 1024, None] * a + b).min(axis=0))
    return best >> np.uint64(32)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits of the set: two keyed sums of remixed members."""
    with np.errstate(over="ignore"):
        return b"".join(mix(shingles + np.uint64(k)).sum(dtype=np.uint64).tobytes() for k in (0x51ED270B, 0xA5A5F00D))


def _signer(width: int, rows: int, hashes: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(hashes)
        salt = np.arange(hashes // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, digest, sig, bands = [], [], [], []
                for words in words_of(_texts(part.column(1))):
                    s = shingles_of(words, width)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), sig.append(None), bands.append(None)
                        continue
                    m = minima(s, a, b)
                    digest.append(_digest(s))
                    sig.append(m.astype(np.uint8).tobytes())
                    bands.append(mix((m.reshape(-1, rows) * keys).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "sig", "bands"],
                )

    return sign


def _setter(width: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [shingles_of(w, width) for w in words_of(_texts(part.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "digest", "shingles"]
                )

    return sets


def _agreeing(least: int) -> Callable:
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield batch.select([0, 1]).filter(keep)

    return agree


def _confirming(num: int, den: int) -> Callable:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _survivors(rows: dict, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, target rows, and the pairs of a group, as places in these two, that are worth a test.

    A pair is one of two components, agrees by signature, and is looked at in the first bucket that it shares.
    """
    q, t = np.flatnonzero(rows["query"]), np.flatnonzero(~rows["query"])
    if not len(q) or not len(t):
        none = np.zeros(0, dtype=np.int64)
        return q, t, none, none, none
    same = np.empty((len(q), len(t)), dtype=np.int16)
    for i, j in enumerate(q):
        same[i] = (rows["sig"][t] == rows["sig"][j]).sum(axis=1)
    i, j = np.nonzero((same >= least) & (rows["comp"][q][:, None] != rows["comp"][t][None, :]))
    if len(i):
        shared = rows["bands"][q[i]] == rows["bands"][t[j]]
        first = rows["bands"][q[i], shared.argmax(axis=1)] == rows["bucket"][q[i]]
        i, j = i[first], j[first]
    return q, t, i, j, same[i, j]


def _by_group(batches: Iterator[pa.RecordBatch], group: Callable[[dict], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls ``group`` for each run of equal (bucket, qi, tj); the input is sorted by them."""

    def columns(table: pa.Table) -> dict:
        out = {k: table.column(k).to_numpy() for k in ("bucket", "qi", "tj", "node", "comp", "query")}
        out["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(len(table), -1)
        out["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        if "shingles" in table.column_names:
            out["shingles"] = np.array([None, *(np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist())], dtype=object)[1:]
        return out

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = columns(table)
        key = np.stack([rows[k] for k in ("bucket", "qi", "tj")], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        found = [group({k: v[lo:hi] for k, v in rows.items()}) for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True)]
        yield pa.Table.from_batches(found).combine_chunks().to_batches()[0] if sum(f.num_rows for f in found) else found[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            table = pa.Table.from_batches([*held, batch.slice(lo, 2048)])
            key = [table.column(k).to_numpy() for k in ("bucket", "qi", "tj")]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from groups(table.slice(0, done))
            held = table.slice(done).to_batches()
    if held:
        yield from groups(pa.Table.from_batches(held))


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _tested(least: int) -> Callable:
    """The rows of each group that have a partner to be tested with."""

    def group(rows: dict) -> pa.RecordBatch:
        q, t, i, j, _ = _survivors(rows, least)
        at = np.concatenate((q[np.unique(i)], t[np.unique(j)]))
        return _batch("bucket qi tj node query", *(rows[k][at] for k in ("bucket", "qi", "tj", "node", "query")))

    return lambda batches: _by_group(batches, group)


def _linked(least: int, num: int, den: int) -> Callable:
    """Links on full sets that join the components of each group; pairs that others have joined are passed over."""

    def group(rows: dict) -> pa.RecordBatch:
        q, t, i, j, same = _survivors(rows, least)
        nodes, comps, sets = rows["node"], rows["comp"], rows["shingles"]
        order = np.lexsort((-same, i))
        i, j = i[order], j[order]
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        a, b = [], []
        for k in np.unique(i):
            own, mates = sets[q[k]], t[j[i == k]]
            for lo in range(0, len(mates), 64):
                here = root(comps[q[k]])
                part = np.array([x for x in mates[lo : lo + 64] if root(comps[x]) != here], dtype=np.int64)
                if not len(part):
                    continue
                theirs = [sets[x] for x in part]
                sizes = np.array([len(x) for x in theirs])
                joined = np.concatenate(theirs)
                at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                shared = np.add.reduceat(own[at] == joined, np.cumsum(sizes) - sizes, dtype=np.int64)
                for x in part[den * shared >= num * (len(own) + sizes - shared)]:
                    here, there = root(comps[q[k]]), root(comps[x])
                    if here != there:
                        up[there] = here
                        a.append(nodes[q[k]]), b.append(nodes[x])
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return _batch("a b", np.maximum(a, b), np.minimum(a, b))

    return lambda batches: _by_group(batches, group)


class _Job:
    """One run over one table; each method adds a written stage."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.scratch = Scratch(docs.sparkSession, "minhash")
        self.docs, self.width, self.num, self.den = docs, width, num, den
        threshold = num / den
        self.rows_a_band, bands = shape_for(threshold)
        self.hashes = self.rows_a_band * bands
        self.least = least_agreeing(self.hashes, threshold)

    def sign(self) -> None:
        save = self.scratch.save
        signed = save(self.docs.mapInArrow(_signer(self.width, self.rows_a_band, self.hashes), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "signed")
        some = signed.where("doc_id is not null and digest is not null")
        first = some.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("r"))
        nodes = save(first.select("digest", F.col("r.doc_id").alias("node"), "r.sig", "r.bands"), "nodes", rows=signed.count())
        self.members = signed.select("doc_id", "n_shingles", "digest")
        at, self.count = nodes.select("node", F.explode("bands").alias("bucket")), nodes.count()
        most = self.count * (self.hashes // self.rows_a_band)
        shared = save(at.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared", rows=most // 2)
        rows = save(at.join(shared, "bucket"), "rows", rows=most)
        self.nodes = nodes
        degree = save(rows.groupBy("node").agg(F.sum("size").alias("degree")), "degree", rows=self.count)
        hubs = rows.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"))).alias("h"))
        hubs = save(hubs.select("bucket", (-F.col("h.least")).alias("hub")), "hubs", rows=most // 2)
        self.rows = save(rows.join(hubs, "bucket").where("node <> hub"), "spokes", rows=most)
        self.scratch.drop("rows")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        sig = self.nodes.select("node", "sig")
        a, b = (sig.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
        return both.mapInArrow(_agreeing(self.least), "a long, b long")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """``node, shingles`` of some nodes, from their texts."""
        wanted = self.scratch.save(self.nodes.select("node", "digest").join(nodes, "node", "left_semi"), f"ends-{name}", rows=self.count)
        few = sized(wanted)
        texts = self.docs.join(few, self.docs.doc_id == few.node, "left_semi")
        sets = texts.mapInArrow(_setter(self.width), "node long, digest binary, shingles binary").dropDuplicates(["node", "digest"])
        return self.scratch.save(sets.join(wanted, ["node", "digest"], "left_semi").select("node", "shingles"), f"sets-{name}")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full shingle sets reach the threshold."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), name)
        a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        links = self.scratch.save(both.mapInArrow(_confirming(self.num, self.den), "a long, b long"), f"links-{name}")
        self.scratch.drop(f"sets-{name}")
        return links

    def beyond_hubs(self, components: DataFrame, name: str) -> DataFrame:
        """Rows of buckets that hold several components, dealt in blocks: queries lie outside the largest one.

        Hubs have met their whole bucket and are left out. Every query row meets every target row of its bucket
        in exactly one block.
        """
        save = self.scratch.save
        placed = self.rows.select("bucket", "node").join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
        placed = save(placed, f"at-{name}", rows=self.rows.count())
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        buckets = save(buckets.select("bucket", F.col("top.comp").alias("major"), blocks(F.col("n")).alias("tn"), blocks(F.col("n") - F.col("top.n")).alias("qn")), f"open-{name}", rows=self.rows.count())
        rows = placed.join(buckets, "bucket").join(self.nodes.select("node", "sig", "bands"), "node")
        at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        targets = rows.select("bucket", every("qn").alias("qi"), at("tn").alias("tj"), F.lit(False).alias("query"), "node", "comp", "sig", "bands")
        queries = rows.where("comp <> major").select("bucket", at("qn").alias("qi"), every("tn").alias("tj"), F.lit(True).alias("query"), "node", "comp", "sig", "bands")
        return targets.union(queries)

    def remaining(self, components: DataFrame) -> DataFrame:
        """Links that join all components which any pair of one bucket links."""
        save = self.scratch.save
        rows = save(self.beyond_hubs(components, "rest"), "blocks")
        keys = ["bucket", "qi", "tj", "node", "query"]
        tested = save(_dealt(rows).mapInArrow(_tested(self.least), "bucket long, qi int, tj int, node long, query boolean"), "tested")
        sets = self.sets(tested.select("node").distinct(), "rest")
        dealt = _dealt(rows.join(tested, keys, "left_semi").join(sets, "node"))
        return save(dealt.mapInArrow(_linked(self.least, self.num, self.den), "a long, b long").distinct(), "links-rest")

    def same_document(self) -> DataFrame:
        """A doc_id whose rows fall in several sets links these sets."""
        of_set = self.nodes.select("digest", "node")
        copies = self.members.where("doc_id is not null").join(of_set, "digest").where("doc_id <> node").select("doc_id", F.col("node").alias("b"))
        return copies.join(of_set.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "b").distinct()

    def run(self) -> DataFrame:
        self.sign()
        save, scratch = self.scratch.save, self.scratch
        star = self.rows.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
        pairs = save(self.agreeing(star), "star", rows=self.rows.count())
        links = save(self.confirmed(pairs, "star").union(self.same_document()), "known-0", rows=pairs.count() + self.count)
        components = save(connected_components(links, scratch), "components-0", rows=2 * self.count)
        more = self.remaining(components)
        if not more.isEmpty():
            components = save(connected_components(links.union(more), scratch), "components-1", rows=2 * self.count)
        placed = save(self.nodes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "placed", rows=self.count)
        result = self.members.join(placed, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "qi", "tj").sortWithinPartitions("bucket", "qi", "tj")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose ``width``-word shingle sets have a Jaccard similarity of ``num / den`` or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row: the size of its set, the smallest doc_id that
    links reach from it, and whether that is its own. Other columns of the input are ignored, whatever their names.

    Null or blank texts have an empty set and stand alone; very long texts are compared whole. Texts shorter than ``width`` words are one shingle.
    Repeated rows get one result row each. Rows that share a doc_id but not a set are one document: their sets are
    linked. Rows without doc_id are kept and link nothing; their component_id is that of an equal set, else null. Of
    equal sets the smallest doc_id stands for all. An empty table gives no rows.
    """
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return _Job(pick, width, num, den).run()
