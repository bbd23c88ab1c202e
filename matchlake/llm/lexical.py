"""Ranked lexical search by WAND over document shards.

One pass over the documents counts every text's terms, keeps the counts of those that a query asks for, and gives the
statistics of the corpus. Documents are dealt to shards of bounded size, and queries to blocks; a shard and a block of
queries meet in one group. There the postings of each term, in order of documents, carry what the term adds to a
document's score, and the largest such impact bounds what it can add to any.

A query walks the postings of its terms together, sorted by the document that each stands at. The first term at which the
sum of the largest impacts exceeds the least score on the full heap gives the pivot document: all documents before it
cannot enter the heap and are skipped by halving. Shards give their heaps, which are merged by score.
"""

from __future__ import annotations

import re
import string
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappush, heapreplace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch, parallelism, sized, small_batches

#: Maximal runs of ASCII letters and digits and of anything beyond ASCII, in characters and in the bytes of UTF-8.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xFF]+").findall
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xFF]").search
#: Documents and counts of a shard, about, and documents below which a shard is not made smaller; queries of a block;
#: distinct terms asked for that a worker may hold.
SHARD_DOCS, SHARD_COUNTS, LEAST_DOCS, BLOCK_QUERIES, HELD_TERMS = 32_768, 2_000_000, 4096, 1024, 500_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
END = 1 << 62


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, with A-Z in lower case; a very long one is taken piece by piece, cut between terms."""
    lo = 0
    while lo < len(text):
        gap = _GAP(text, lo + PIECE)
        hi = gap.start() if gap else len(text)
        yield _TERMS(text[lo:hi].lower())
        lo = hi


def _counter(wanted: set[bytes] | None) -> Callable:
    """Per text its number of terms, and the counts of distinct ones, of ``wanted`` ones alone where given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, terms, counts, ends = [], [], array("q"), [0]
            for text in batch.column(1):
                found: Counter[bytes] = Counter()
                if text.is_valid:
                    for some in terms_of(text.as_buffer().to_pybytes()):
                        found.update(some)
                length.append(found.total())
                asked = found.keys() if wanted is None else found.keys() & wanted
                terms.extend(asked), counts.extend(map(found.__getitem__, asked))
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return count


COUNTED = "doc_id long, n long, terms array<string>, counts array<long>"


def wand(cursors: list[list], k: int) -> list[tuple[int, int]]:
    """``(score, document)`` of the ``k`` best, best first; of equal scores the smaller document.

    A cursor is ``[document it stands at, largest impact, place, documents, impacts]``, its documents closed by END.
    """
    heap: list[tuple[int, int]] = []
    least, first = 0, itemgetter(0)
    cursors = [c for c in cursors if c[1] > 0]
    while cursors:
        cursors.sort(key=first)
        reach, pivot = 0, END
        for c in cursors:
            reach += c[1]
            if reach > least:
                pivot = c[0]
                break
        if pivot == END:
            break
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                score += c[4][c[2]]
                c[2] += 1
                c[0] = c[3][c[2]]
            if score > least:
                if len(heap) < k:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    least = heap[0][0]
        else:
            for c in cursors:
                if c[0] >= pivot:
                    break
                c[2] = bisect_left(c[3], pivot, c[2])
                c[0] = c[3][c[2]]
    return [(score, -doc) for score, doc in sorted(heap, reverse=True)]


def _searcher(k: int) -> Callable:
    """The heaps of a block of queries over one shard."""

    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if len(shard) and len(queries):
            shard = shard.sort_by("doc_id").combine_chunks()
            ids = shard.column("doc_id").to_pylist()
            lists, counts = (shard.column(c).combine_chunks() for c in ("terms", "counts"))
            sizes = np.diff(lists.offsets.to_numpy())
            doc, tf, m = np.repeat(np.arange(len(ids)), sizes), counts.flatten().to_numpy(), np.repeat(shard.column("m").to_numpy(), sizes)
            gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            named = lists.flatten().dictionary_encode()
            term = named.indices.to_numpy()
            order = np.argsort(term, kind="stable")
            doc, gain, cut = doc[order], gain[order], np.searchsorted(term[order], np.arange(len(named.dictionary) + 1))
            at = {name: (cut[i], cut[i + 1]) for i, name in enumerate(named.dictionary.to_pylist())}
            postings: dict[str, tuple[array, np.ndarray, int]] = {}
            for query, terms, weights in zip(*[queries.column(c).to_pylist() for c in ("query", "terms", "weights")], strict=True):
                cursors = []
                for name, w in zip(terms, weights, strict=True):
                    if name not in at or not w:
                        continue
                    if name not in postings:
                        part = slice(*at[name])
                        postings[name] = array("q", [*doc[part].tolist(), END]), gain[part], int(gain[part].max())
                    docs, gains, most = postings[name]
                    cursors.append([docs[0], w * most, 0, docs, array("q", (w * gains).tobytes())])
                out += [(query, ids[d], score) for score, d in wand(cursors, k)]
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return search


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``, ranks from 1.

    A term counts as often as its item repeats it; documents that score 0 are not returned, and of equal scores the
    smaller doc_id comes first, null last. Null and empty texts have no terms: such documents are not counted in the
    statistics, and such items find nothing. Rows are documents and queries of their own: repeated documents each take
    a rank, and items that share an id are each ranked on their own. Very long texts are read whole; an empty table on
    either side gives no rows. Other columns are ignored, whatever their names.

    Workers hold the distinct terms asked for where these are HELD_TERMS or fewer; for more, all counts are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    save = scratch.save
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lower = F.translate(F.col(item_text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("query"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    asked = save(asked.where("size(terms) > 0"), "asked")
    times = save(asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")), "times")
    vocabulary = save(times.select("term").distinct(), "vocabulary")
    wanted = {t.encode() for t in vocabulary.toArrow().column(0).to_pylist()} if vocabulary.count() <= HELD_TERMS else None
    with small_batches(spark):
        counted = save(texts.mapInArrow(_counter(wanted), COUNTED), "counted")
    n_docs, total, found = counted.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.count("*") + 1).cast("double"))).cast("long")
    weights = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("weight"))
    weights = sized(save(weights.join(vocabulary, "term", "left_semi"), "weights"))
    some = save(times.join(weights, "term").groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("weight") * F.col("times")).alias("weights")), "queries")
    ceil = lambda n, size: max(1, -(-n // size))
    blocks = ceil(some.count(), BLOCK_QUERIES)
    shards = max(ceil(n_docs, SHARD_DOCS), ceil(found, SHARD_COUNTS), min(parallelism(spark), ceil(n_docs, LEAST_DOCS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("int")
    numbered = counted.where("size(terms) > 0").withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.select(every(blocks).alias("i"), part("row", shards).alias("j"), "doc_id", F.expr(f"25 + (75 * n * {n_docs}) div {total}").alias("m"), "terms", "counts")
    query = some.select(part("query", blocks).alias("i"), every(shards).alias("j"), "query", "terms", "weights")
    heaps = dealt.groupBy("i", "j").cogroup(query.groupBy("i", "j")).applyInArrow(_searcher(k), "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = heaps.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(sized(asked.select("item_id", "query")), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
m as (select doc_id, 25 + (75 * n * docs) // total as m from lengths, corpus),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by all),
w as (
  select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1)))::bigint as w
  from (select term, count(*) as df from tf where term in (select term from q) group by term), corpus),
s as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 10
"""
