"""Every operator against a brute-force version, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlake.llm import ann, bpe, chat, dac, exact, language, mixing, quality, warc
from matchlake.llm.components import connected_components
from matchlake.llm.minhash import near_duplicates
from matchlake.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY
from matchlake.llm.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, node string, size int, digest string, batch int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward_rows():
    rng = random.Random(4)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(90)]
        for copy in range(12):
            t = list(text)
            for _ in range(copy % 6):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t), ["en", "fr", None][base % 3], ["src1", None, "a", "é"][base % 4]))
    extra = [None, "", "   \t\n", "one", "ONE", "one two", "İK straße K", "x " * 3000, "long" * 5000, "12 34 !!", "same text here again", "Same Text HERE again"]
    rows += [(1000 + i, t, "en", "src1") for i, t in enumerate(extra)]
    rows += [(1003, "one", "en", "src1"), (1003, "one", "en", "src1"), (None, "one", None, None), (None, "nobody else has this text", None, None)]
    return [(*r, "n", 1, "d", 2) for r in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC)


def test_registered_queries_have_the_contract(spark, sf):
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_exact(spark, awkward):
    rows = awkward_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(
        (str(r[0]), str(keep[low(r[1])]), len(groups[low(r[1])]), keep[low(r[1])] is None or r[0] == keep[low(r[1])], hashlib.sha256(low(r[1]).encode()).hexdigest()) for r in rows
    )
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(awkward).collect())
    assert got == expected


def test_exact_index_persists(spark, awkward):
    path = Scratch(spark, "test-index").path
    first, second = awkward.where("doc_id < 60"), awkward.where("doc_id >= 60")
    index = exact.DigestIndex(spark, path, buckets=4)
    a = index.add(first).collect()
    index.close()
    again = exact.DigestIndex(spark, path)
    assert again.buckets == 4
    b = again.add(second).collect()
    owner = {r.text_sha256: r.keep_id for r in a}
    assert all(r.keep_id == owner[r.text_sha256] and not r.kept for r in b if r.text_sha256 in owner)
    digests = again.rows().count()
    again.add(second)
    assert again.rows().count() == digests


def test_exact_index_is_merged_as_it_lies(spark, awkward, monkeypatch):
    """Batches go to the delta; merging makes one sorted file a bucket, which is scanned without shuffle or sort."""
    monkeypatch.setattr(exact, "MOST_FILES", 1)
    index = exact.DigestIndex(spark, Scratch(spark, "test-index").path, buckets=4)
    parts = [awkward.where(f"pmod(doc_id, 5) = {k}") for k in range(5)]
    owners = {}
    for part in parts:
        for r in index.add(part).collect():
            assert owners.setdefault(r.text_sha256, r.keep_id) == r.keep_id
    assert index.generation > 0 and {r.digest.hex(): r.keep_id for r in index.rows().collect()} == owners
    index.compact()
    assert index.files("base") <= 4 and index.files("delta") == 0 and exact.DigestIndex(spark, index.path).generation == index.generation
    with index._sorted_scans():
        plan = index.new(spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long"))._jdf.queryExecution().executedPlan().toString()
    sides = plan.split("SelectedBucketsCount: 4 out of 4")[:2]
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert all("Sort [" not in side.split("Exchange")[-1] for side in sides) and index.table("base") in sides[0]
    index.close()


def test_exact_rows_are_kept_once(spark):
    rows = [(5, "Abc", 0), (5, "abc", 1), (None, "x", 2), (None, "X", 3), (1, None, 4), (2, "", 5), (2, "", 6)]
    tables = {t.name for t in spark.catalog.listTables()}
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row long"), row_col="row").collect()
    assert {r.row for r in got if r.kept} == {0, 2, 5} and len(got) == len(rows)
    assert {t.name for t in spark.catalog.listTables()} == tables


def brute_near(rows, width, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(low(text))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, awkward):
    rows = [r for r in awkward_rows() if r[0] is not None]
    for width, num in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(awkward, width, num, 100).where("doc_id is not null").collect()}
        assert got == brute_near(rows, width, num, 100)
    nobody = near_duplicates(awkward, 3, 85, 100).where("doc_id is null").collect()
    assert len(nobody) == 2 and all(r.kept or r.component_id is not None for r in nobody)


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one text around the threshold, so that no hub is near all of them."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        t = list(base)
        for k in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            t[rng.randrange(len(t))] = f"e{i}x{k}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:30] + [f"o{i}y{k}" for k in range(60)])) for i in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == brute_near(rows, 3, 85, 100)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (3, 2)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in parent}


def test_mix(spark, awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(got, key=str) == sorted(mixing.mix(awkward.repartition(7)).collect(), key=str)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and len(r.positions) <= 2 and (r.taken > 0) == bool(r.positions) and all(0 <= p <= 1 for p in r.positions)
    assert all(abs(taken[s] - target[s]) <= 1 and r.source_size == size[r.source] for s in target for r in got[:1])
    weights = dict(zip(sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None], (5, 2, 1, 5)))
    full = {s: 0.0 for s in size}
    total, free = 1.5 * sum(size.values()), set(size)
    while free:
        level = (total - sum(full[s] for s in size if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * size[s]}
        for s in over or free:
            full[s] = 2.0 * size[s] if over else weights[s] * level
        free = free - over if over else set()
    assert all(abs(full[s] - target[s]) < 1e-6 for s in size)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first)


def test_mix_spreads_a_repeated_id(spark, monkeypatch):
    """Rows equal in id, source and size are counted, and dealt out again as if they had been summed one by one."""
    rows = [(None, "a b c", "s")] * 900 + [(None, "a b c d e", "s")] * 300 + [(k, "x y", "s") for k in range(50)] + [(k, "x " * (k % 5), "t") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "COPIES", 7)
    got = mixing.mix(docs).collect()
    assert sorted(got, key=str) == want and len(got) == len(rows)
    key = lambda i: (hashlib.md5(("" if i is None else str(i)).encode()).digest(), i is not None, i or 0)
    for source in "st":
        own = sorted(((key(i), len(t.split())) for i, t, s in rows if s == source))
        total, target = sum(n for _, n in own), next(r.target for r in want if r.source == source)
        start, taken = 0, defaultdict(int)
        for k, n in own:
            taken[k[2] if k[1] else None, n] += sum(max(0, min(n, int(target + 0.5) - start - p * total)) for p in (0, 1))
            start += n
        have = defaultdict(int)
        for r in want:
            if r.source == source:
                have[r.doc_id, r.size] += r.taken
        assert have == taken


def test_half_alike_documents_rarely_share_a_bucket(spark):
    """Two thousand documents with half of their words in common: few rows meet, and no link is made up or lost."""
    from matchlake.llm import minhash

    rng = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"o{i}x{k}" for k in range(45)])) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " " + rng.choice("abc")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    job = minhash._Job(docs, 3, 85, 100)
    got = {r.doc_id: r.component_id for r in job.run().collect()}
    assert got == {i: i % 5000 for i in got} and len(got) == len(rows)
    blocks = job.scratch.spark.read.parquet(job.scratch.at("blocks"))
    met = blocks.groupBy("bucket", "qi", "tj").agg((F.count_if("query") * F.count_if(~F.col("query"))).alias("n")).agg(F.sum("n")).first()[0] or 0
    assert met < len(rows) ** 2 / 4


def test_training_order_does_not_multiply_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f", "t")], "doc_id long, text string, source string")
    order = mixing.training_order(docs, mixing.mix(docs, share=2.0))
    assert order.columns == docs.columns and order.count() == 8


def test_curriculum_inverts_demand(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    grid = np.linspace(0, 1, 20001)
    demand = np.concatenate(([0], np.cumsum((np.interp(grid[1:], *zip(*knots)) + np.interp(grid[:-1], *zip(*knots))) / 2)))
    for u in (0.0, 0.1, 0.3, 0.5, 0.99):
        (t,) = spark.range(1).select(mixing._invert(mixing.F.lit(u), knots)).first()
        assert abs(t - np.interp(u, demand / demand[-1], grid)) < 1e-4


def test_training_positions_invert_the_curriculum(spark, sf):
    got = {(r.doc_id, r["pass"]): r.position for r in QUERIES["op2_training_positions"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    plan = {r.doc_id: r for r in QUERIES["op2_mix_sources"](spark, sf).collect()}
    grid, want = np.linspace(0, 1, 200001), {}
    for kind, source in enumerate(sorted({r.source for r in rows}, key=lambda s: (s is None, s))):
        knots = mixing.CURRICULUM[kind % 3]
        rate = np.interp(grid, *zip(*knots))
        demand = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2)))
        own = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, len(WORD.findall(r.text or ""))) for r in rows if r.source == source)
        target, start = plan[own[0][1]].target, 0
        for k in range(2):
            for _, doc, size in own:
                if size and start < np.floor(target + 0.5):
                    want[doc, k] = np.interp(start / target, demand / demand[-1], grid)
                start += size
    assert set(got) == set(want) and len(want) > len(plan)
    assert all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_tokens(spark, awkward):
    library = Tokenizer.from_file(VOCABULARY)
    rows = awkward_rows()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows if r[0] is not None}
    for r in bpe.round_trip(awkward, VOCABULARY).where("doc_id is not null").collect():
        e = ids[r.doc_id]
        text = library.decode(e, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = bpe.encode(awkward, VOCABULARY)
    assert all(list(r.ids) == ids[r.doc_id] for r in encoded.where("doc_id is not null").collect())
    assert all(r.text == library.decode(ids[r.doc_id], skip_special_tokens=False) for r in bpe.decode(encoded, VOCABULARY).where("doc_id is not null").collect())


def test_bpe_like_the_library():
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(3)
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = f.read()
    own, other = bpe.WordBpe(spec), dac._Encoder(spec)
    pool = [*"abcABC 'sStTreLL019!?.\t\n\r\x0b\x0c\x1c\x85\xa0 éÉßİΣσςǅﬁ中文字😀ñ가각ᄀÀÿªµº²¼×÷¡¿Ø", "́", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'re", "'LL", "K"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert np.frombuffer(other.ids([text])[0], dtype=np.uint32).tolist() == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def changed(**model):
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    spec.update({k: v for k, v in model.items() if k in spec})
    spec["model"].update({k: v for k, v in model.items() if k not in spec})
    return spec


def test_vocabularies_with_other_rules(tmp_path, spark):
    import json

    numbers = changed()["pre_tokenizer"]
    numbers["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    rng, pool = random.Random(5), [*"abC '12?\t\n éÉßİ中😀 ", "<|endoftext|>", "'re"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    for k, spec in enumerate((changed(normalizer={"type": "NFC"}), changed(pre_tokenizer=numbers), changed(decoder={"type": "BPEDecoder", "suffix": "</w>"}))):
        text = json.dumps(spec)
        library, own, other = Tokenizer.from_str(text), bpe.WordBpe(text), dac._Encoder(text)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert not own.cuts_alike and [own.encode(t) for t in texts] == want
        assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in other.documents(texts)] == want
        assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        got = bpe.tokens(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string"), str(path)).collect()
        assert all(list(r.ids) == want[r.doc_id] and r.decoded_sha256 == hashlib.sha256(own.decode(want[r.doc_id]).encode()).hexdigest() for r in got)
    with pytest.raises(ValueError, match="unk_token"):
        bpe.WordBpe(json.dumps(changed(unk_token="<|endoftext|>")))


def test_token_store(spark, awkward):
    library = Tokenizer.from_file(VOCABULARY)
    store = dac.TokenStore.write(awkward, VOCABULARY, 1, Scratch(spark, "t").path)
    rows = sorted(store.documents().collect(), key=lambda r: r.start)
    assert len(rows) == awkward.count()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in awkward_rows()), key=lambda i: -1 if i is None else i)
    texts, at, everything = {r[0]: r[1] for r in awkward_rows()}, 0, []
    for r in rows:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            everything += ids
        else:
            everything += [None] * r.n_tokens
        at += r.n_tokens
    wanted = [i for i in range(0, at, 97) if everything[i] is not None]
    assert {r.position: r.id for r in store.tokens_at(wanted).collect()} == {i: everything[i] for i in wanted}
    assert {r.doc_id: list(r.ids) for r in store.ids_of([1003, 5]).collect()}[5] == library.encode(texts[5], add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [1 << 20, 3, 70000, 255] * 700, list(range(5000))])
def test_codes(ids):
    levels = dac.pack(np.array(ids, dtype=np.uint32))
    assert dac.unpack(levels).tolist() == ids
    assert [dac.access(levels, i) for i in range(len(ids))] == ids


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None] * 8), (704, [1.0, 2.0]), (705, [float("inf")] * 16), (None, [1.0] * 16), (50, rows[50][1])]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(axis=1))
    hits = 0
    for q in range(0, 600, 50):
        score = y @ y[q] / (norm * norm[q])
        best = [i for i in np.lexsort((np.arange(600), -np.round(score, 12))) if i != q][:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 60
    tiny = spark.createDataFrame([(i, (v.astype(float) * 1e-200).tolist()) for i, v in enumerate(x[:60])], "vec_id long, embedding array<double>")
    full = {(r.query_id, r.vec_id): r.score for r in ann.neighbours(spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x[:60])], "vec_id long, embedding array<double>")).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in ann.neighbours(tiny).collect()}
    assert set(found) == set(full) and len(full) == 10 and all(abs(found[k] - full[k]) < 1e-12 for k in full)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.neighbours(few).count() == 2
    assert ann.neighbours(few.limit(0)).count() == 0


def test_search_of_several_lengths(spark):
    """Every length is searched within itself, whatever its share; other columns may have any names."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist(), "v", 1, [2], 0.5, 3) for i in range(240)]
    rows += [(1000, [1.0], "v", 1, [2], 0.5, 3), (1050, [-2.0], "v", 1, [2], 0.5, 3), (1100, [], "v", 1, [2], 0.5, 3), (50, [3.0], "v", 1, [2], 0.5, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, key int, ids array<int>, score double, rank int")
    got = defaultdict(list)
    for r in ann.neighbours(frame).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    want = defaultdict(dict)
    for q, a, *_ in rows:
        for i, b, *_ in rows:
            if q % 50 == 0 and i != q and len(a) == len(b) > 0:
                x, y = np.array(a), np.array(b)
                want[q][i] = max(round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), want[q].get(i, -2))
    assert set(got) == set(want) and 1000 in want[50]
    for q, scores in want.items():
        assert [(v, s) for _, v, s in sorted(got[q])] == [(v, s) for s, v in sorted((-s, v) for v, s in scores.items())[:5] for s in [-s]]


def test_search_is_exact_in_a_dense_group(spark):
    """A third of the rows are near copies, closer to each other than the codes can tell; some ids have several vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4500, 16))
    x[::3] = x[0] + 2e-4 * rng.normal(size=(1500, 16))
    x = x.astype(np.float32)
    ids = np.arange(len(x))
    ids[1500:1530] = 1501
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(axis=1))
    asked = [q for q in range(0, len(x), 50) if ids[q] == q]
    assert set(got) == set(asked)
    for q in asked:
        best = {}
        for i, s in zip(ids.tolist(), (y * y[q]).sum(axis=1) / (norm * norm[q])):
            best[i] = max(s, best.get(i, s))
        want = sorted((-s, i) for i, s in best.items() if i != q)[:5]
        assert [v for _, v, _ in sorted(got[q])] == [i for _, i in want]
        assert all(abs(g[2] + s) < 1e-12 for g, (s, _) in zip(sorted(got[q]), want))


def test_warc(spark):
    big, other = "<p>ü" + "x" * 1200, "<p>" + "\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://www.Example.com:80/a b?q=1", big), (2, "https://example.org/é", big), (9, None, big), (3, "http://www.example.com/a", other), (4, "http://x.y/", None)]
    rows += [(5, "bad\r\nurl", ""), (6, "http://x.y/", "small"), (7, "http://x.y/", "small"), (None, "http://x.y/z", big), (9, "http://again/", big)]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t").path)
    got = archive.entries().collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(big.encode())
    assert kinds[1] == kinds[2] == ("revisit", 9, n, sha(big))
    assert kinds[9] == ("response", None, n, sha(big)) and kinds[None][0] == "response"
    assert kinds[4] == ("response", None, 0, sha("")) and kinds[6][0] == kinds[7][0] == "response"
    found = archive.lookup(["http://www.example.com/a", "http://x.y/", "http://nowhere/"])
    assert sorted(r["page_id"] for r in found) == [3, 4, 6, 7]
    assert {r["page_id"]: r["payload"] for r in found}[3] == other.encode()
    assert [r["payload"] for r in archive.lookup(["http://www.example.com/a%20b?q=1", "http://www.example.com/a b?q=1"]) if r["page_id"] == 1][:1] in ([None], [])
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_names_keys_and_sizes(spark):
    """Names of records are unique, a URL and its stored form have one key, and files are bounded by bytes."""
    huge = ("z" * 999 + "\r\n\r\n") * 25_000
    rows = [(1, "http://exämple.com/x", "a"), (2, "http://a b.com/é?q=ü", huge), *((k, "http://c/", "k" * 9000) for k in (3, 4, 4, 5, 5)), (None, "http://f/", "q"), (None, "http://f/", "q")]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t").path)
    files = [f.read_bytes() for f in Path(archive.path.removeprefix("file://"), "archives").glob("*.txt")]
    names = [n for f in files for n in re.findall(rb"WARC-Record-ID: (\S+)", f)]
    assert len(set(names)) == len(names) == len(rows)
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", b"".join(files))) <= set(names)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.intact) for r in archive.entries().collect())
    assert got == sorted([("1", "response", "None", True), ("2", "response", "None", True), ("3", "revisit", "5", True), *[("4", "revisit", "5", True)] * 2, *[("5", "response", "None", True)] * 2, *[("None", "response", "None", True)] * 2])
    for page, url, html in rows[:2]:
        assert [(r["page_id"], r["payload"]) for r in archive.lookup([url])] == [(page, html.encode())]
        assert warc.url_key(url) == warc.url_key(warc.safe_url(url))
    many = [(k, f"http://m/{k}", "y" * (1 << 20)) for k in range(40)]
    archive = warc.Archive.write(spark.createDataFrame(many, "page_id long, url string, html string").coalesce(1), Scratch(spark, "t").path)
    sizes = [f.stat().st_size for f in Path(archive.path.removeprefix("file://"), "archives").glob("*.txt")]
    assert max(sizes) < warc.FILE_BYTES + (1 << 16) and sum(sizes) < 42 << 20 and archive.entries().count() == 40


def test_warc_root_parts_the_directory(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 20)
    monkeypatch.setattr(warc, "PAGE_BITS", 2)
    rows = [(i, f"http://b/{i // 3:05}", f"page {i}") for i in range(1200)] + [(5000 + i, "http://b/00100", "again") for i in range(150)]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t").path)
    assert archive.spark.read.parquet(f"{archive.path}/root").count() > 4
    for i in (0, 199, 399):
        assert sorted(r["page_id"] for r in archive.lookup([f"http://b/{i:05}"])) == [3 * i, 3 * i + 1, 3 * i + 2]
    assert len(archive.lookup(["http://b/00100"])) == 153 and archive.lookup(["http://b/00400", "http://a/", "http://zz/"]) == []
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(archive.search(pages).collect()) == sorted(archive.entries().collect())
    some = spark.createDataFrame([(7, "http://b/00002", "k"), (8, "http://b/00001", "k"), (5003, "http://b/00100", "k"), (None, "http://b/00100", "k"), (9, None, "k")], "page_id long, url string, at string")
    assert sorted(r.page_id for r in archive.search(some).collect()) == [7, 5003]


def test_warc_search_of_odd_captures(spark):
    """Null and repeated URLs and pages are found as often as they were written, and clashing names do no harm."""
    rows = [(None, None, "a"), (None, None, "a"), (None, "http://x/", "b"), (-5, "http://x/", "c"), (-5, "http://x/", "c"), (2**62, "http://x/", ""), (0, "", "d"), (3, "x y\tz\n", "e"), (4, "http://é/ü", None)]
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], "page_id long, url string, html string, key string, at int, block int, digest int")
    got = warc.archive_pages(frame).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted((str(i), len(h or "")) for i, _, h in rows) and all(r.intact for r in got)


def test_warc_tells_damage_from_the_payload(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (3, "http://a/3", "small"), *((100 + i, f"http://b/{i:05}", f"page {i}") for i in range(2500))]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t").path)
    assert archive.blocks().count() > 2 and all(r.intact for r in archive.entries().collect())
    for i in (0, 999, 1000, 1777, 2499):
        assert [(r["page_id"], r["payload"]) for r in archive.lookup([f"http://b/{i:05}"])] == [(100 + i, f"page {i}".encode())]
    spoilt = 0
    for file in Path(archive.path.removeprefix("file://"), "archives").glob("*.txt"):
        raw = file.read_bytes()
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(raw.replace(b"x" * 1200, b"y" + b"x" * 1199))
        spoilt += b"x" * 1200 in raw
    assert spoilt == 1
    archive.build_index()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.intact) for r in archive.entries().collect()}
    there = hashlib.sha1(("<p>y" + "x" * 1199).encode()).hexdigest()
    assert got[9] == got[1] == (1203, there, False) and len(got) == len(rows)
    assert all(whole for i, (_, _, whole) in got.items() if i not in (1, 9))


def brute_trigrams(text):
    """Counts of letter trigrams of a text by plain loops."""
    letters = []
    for c in text:
        low = c.lower() if c.isalpha() else ""
        letters.append((low if len(low) == 1 else c) if c.isalpha() else " ")
    seen, words = defaultdict(int), f" {re.sub(' +', ' ', ''.join(letters)).strip()} "
    for i in range(len(words) - 2):
        if words[i + 1] != " ":
            seen[words[i : i + 3]] += 1
    return seen


def brute_language(train, texts):
    """Prototypes, centring and choice by plain loops over letters' vectors."""
    b = language.Bundler()
    letter = lambda c: b.letter(0 if c == " " else ord(c)).astype(float)

    def vector(text):
        v = sum((n**0.5 * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2]) for g, n in brute_trigrams(text).items()), np.zeros(language.DIMENSIONS))
        return v / np.linalg.norm(v) if v.any() else None

    total = {}
    for lang, text in train:
        if (v := vector(text)) is not None:
            total[lang] = total.get(lang, 0) + v
    names = sorted(total)
    protos = {k: total[k] / np.linalg.norm(total[k]) for k in names}
    mean = sum(protos.values()) / len(names)
    out = []
    for text in texts:
        v = vector(text or "")
        if v is None:
            out.append(("und", 0.0))
            continue
        cosine = {k: (protos[k] - mean) @ (v - mean) / (np.linalg.norm(protos[k] - mean) * np.linalg.norm(v - mean)) for k in names}
        best = max(names, key=lambda k: (cosine[k], -names.index(k)))
        out.append((best, max(0.0, cosine[best])))
    return out


def test_language_like_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(90).collect()]
    docs += [(9001, None, "en"), (9002, "", "en"), (9003, "12 !! 34", "en"), (9004, "ÀB\nçd ǅ ß " * 40, None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    train = [(lang, t) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None]
    for (i, _, _), (lang, score) in zip(docs, brute_language(train, [t for _, t, _ in docs]), strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-5


def test_trigrams_cross_the_cuts_of_a_long_text(monkeypatch):
    text = "Längere Wörter, über Grenzen hinweg  gelesen; x y z " * 5
    whole = {tuple(chr(k >> s & 0x1FFFFF).replace("\0", " ") for s in (42, 21, 0)): n for k, n in zip(*map(list, language.trigrams(text)))}
    assert {"".join(k): n for k, n in whole.items()} == brute_trigrams(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "PIECE_CHARS", size)
        again = {tuple(chr(k >> s & 0x1FFFFF).replace("\0", " ") for s in (42, 21, 0)): n for k, n in zip(*map(list, language.trigrams(text)))}
        assert again == whole


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 !! 34", "en"), (None, "the of and", "en"), (9005, "und the", None)], docs.schema)
    got = {r.doc_id: r for r in language.identify(docs.union(odd)).collect()}
    assert {got[i].lang_pred for i in (9001, 9002, 9003)} == {"und"} and got[9005].lang_pred != "und"
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in want)
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs.limit(0)).count() == 0


def test_training_rows_are_bounded_when_one_text_fills_a_third(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en" if i % 2 else "de") for i in range(6000)] + [(None, None, "en"), (6001, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language.LanguageModel.training_rows(docs, per_language=300)
    got = {r["lang"]: (r["n"], r["same"]) for r in drawn.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "same text").alias("same")).collect()}
    assert set(got) == {"de", "en"} and all(200 < n < 400 and 0.2 < same / n < 0.47 for n, same in got.values())
    assert language.LanguageModel.training_rows(docs.limit(0)).count() == 0


def test_trigram_bundles_add_up():
    b = language.Bundler()
    assert b.bundle("12 !") is None
    keys, counts = language.trigrams("Abc abc, ÀB")
    a = sum(np.sqrt(n) * np.roll(b.letter(k >> 42).astype(float), 2) * np.roll(b.letter(k >> 21 & 0x1FFFFF), 1) * b.letter(k & 0x1FFFFF) for k, n in zip(keys.tolist(), counts))
    assert np.allclose(b.bundle("Abc abc, ÀB"), a / np.linalg.norm(a), atol=1e-6)


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "word " * 50000)], "doc_id long, text string")
    clash = labels.union(labels).union(spark.createDataFrame([(0, None, 0), (None, 1, 0)], labels.schema))
    got = {r.doc_id: r for r in quality.rank_quality(docs.select("doc_id", "text").union(odd), clash).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.93
    none = quality.rank_quality(docs.limit(5), labels.limit(0)).collect()
    assert all(abs(r.score - 0.7) < 1e-9 for r in none)
    assert quality.rank_quality(docs.limit(0), labels).count() == 0


def test_quality_like_brute_force():
    """Gradient of the pairwise loss, scale and cut of a fitted model by plain loops."""
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(300, 6)), rng.random(300) < 0.3
    x[good] += 0.7
    model = quality.QualityModel.fit_rows(x, good)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -5, 5)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    better, worse = quality.QualityModel.pairs(yes, no, np.random.default_rng(5))
    assert set(better) <= set(yes) and set(worse) <= set(no) and set(better) == set(yes) and set(worse) == set(no)

    def loss(w):
        return sum(np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in zip(better, worse)) / len(better) + quality.RIDGE / 2 * w @ w

    at = loss(model.weights)
    for k in range(6):
        for step in (1e-3, -1e-3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved) > at
    raw = np.sort(z @ model.weights)
    place = (len(raw) - 1) * len(no) / len(raw)
    low = int(place)
    assert abs(model.cut - (raw[low] + (place - low) * (raw[min(low + 1, len(raw) - 1)] - raw[low]))) < 1e-9
    assert ((model.score(x) >= 0.7) == (z @ model.weights >= model.cut - 1e-12)).all()


def test_quality_features_by_hand():
    got = quality.features(["", "Ab ab! x\nAb ab! x"])
    n = quality.WORD_BUCKETS
    assert not got[0].any() and got.shape[1] == 45 + n
    assert np.isclose((got[1][-n:] ** 2).sum(), 1.0)
    plain = got[1][32:-n]
    assert np.isclose(plain[0], np.log1p(6)) and np.isclose(plain[1], 2.0) and np.isclose(plain[4], 3 / 6) and np.isclose(plain[10], 1 / 2)


def test_quality_does_not_depend_on_order_where_ids_repeat(spark):
    docs = [(i, f"word{i % 7} text " * (1 + i % 9)) for i in range(200)] + [(i, "!! other") for i in range(0, 200, 3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    a, b = (quality.rank_quality(spark.createDataFrame(d, "doc_id long, text string"), labels).collect() for d in (docs, docs[::-1]))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)


def brute_chat(turns, a, b):
    conv = {k: sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == k]) for k in (a, b)}
    render = lambda t: f"<|{t[1]}|>\n{t[2]}\n<|end|>\n"
    n = 0
    while n < min(len(conv[a]), len(conv[b])) and conv[a][n][1:] == conv[b][n][1:]:
        n += 1
    out = [n, "".join(map(render, conv[a][:n]))]
    for k in (a, b):
        text, spans = "", []
        for t in conv[k][n:]:
            start = len(text) + len(f"<|{t[1]}|>\n")
            if t[1] == "assistant":
                spans.append(f"{start}:{start + len(t[2])}")
            text += render(t)
        out.append((text, " ".join(spans)))
    return out[0], out[1], out[2][0], out[3][0], out[2][1], out[3][1]


def test_chat(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes 😀"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no")]
    turns += [(2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, None, None), (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, None, "assistant", "n"), (6, 0, "assistant", None), (7, 5, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.chosen_id, r.rejected_id): tuple(r)[2:] for r in chat.preference_pairs(df, chat.neighbouring_pairs(df)).collect()}
    assert got == {p: brute_chat(turns, *p) for p in ((0, 1), (2, 3), (6, 7))}
    assert chat.preference_pairs(df.limit(0), chat.neighbouring_pairs(df.limit(0))).count() == 0


def test_answer_preferences(spark, sf):
    """Every conversation with an assistant turn has a pair with all earlier turns as its prompt; the given table agrees with SQL."""
    import duckdb

    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes 😀"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no")]
    turns += [(7, 0, "assistant", "a"), (7, 1, "user", "b"), (7, 2, "assistant", None), (8, 0, "user", "alone"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    last = {c: x or "" for c, _, role, x in turns if role == "assistant" and c is not None}
    ring = sorted(set(last.values()), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    got = {r.chosen_id: tuple(r)[1:] for r in chat.answer_preferences(df).collect()}
    assert set(got) == {0, 1, 5, 7}
    for c, answer in last.items():
        other = ring[(ring.index(answer) + 1) % len(ring)]
        at = max(t for k, t, role, _ in turns if k == c and role == "assistant")
        swapped = [t for t in turns if t[0] == c] + [(-1, t, role, other if t == at else x) for k, t, role, x in turns if k == c]
        assert got[c] == (min(k for k, x in last.items() if x == other), *brute_chat(swapped, c, -1)) and got[c][1] == at and got[c][2]
    assert chat.answer_preferences(df.where("conv_id in (1, 5, 8)")).count() == 0 and chat.answer_preferences(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = con.sql(ORACLE_SQL["op10_preference_chat"])
    rows = QUERIES["op10_preference_chat"](spark, sf).select(want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and rows and all(r.prompt for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    for out in (exact.exact_duplicates(none), near_duplicates(none), mixing.mix(none), bpe.round_trip(none, VOCABULARY), dac.token_file(none, VOCABULARY)):
        assert out.count() == 0


def test_pipeline_labels_documents_without_a_language(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bare = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    got = {r.doc_id: r.lang for r in p.language_id(spark, docs.withColumn("lang", F.when(~bare, F.col("lang"))), sf).collect()}
    want = {r.doc_id: r.lang for r in docs.collect() if r.doc_id in got}
    assert all(got[i] == want[i] for i in want if i % 5)
    assert np.mean([got[i] == want[i] for i in want if i % 5 == 0]) > 0.9


def test_pipeline_rejects_only_texts_without_letters(spark, sf):
    """Noise, texts of several languages and of one never learnt all stay, labelled or not, and the session is as before."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng, by_lang = random.Random(6), defaultdict(list)
    for r in docs.where("length(text) > 200").collect():
        by_lang[r.lang].append(r.text)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (300, 900, 5000)]
    mixed = [" ".join(rng.choice(texts) for texts in by_lang.values()) for _ in range(20)]
    other = "Habari za asubuhi watu wote wa kijiji hiki kizuri kilichopo karibu na mto mkubwa unaopita katikati ya nchi yetu " * 3
    texts = [*noise, *mixed, other, "Yes.", "qx zv"]
    added = [(-1 - 2 * i - k, t, lang, "s", len(t)) for i, t in enumerate(texts) for k, lang in enumerate(("en", None))]
    gone = [(-1000, None, "en", "s", 0), (-1001, "", None, "s", 0), (-1002, "12 34 !! " * 50, "en", "s", 0)]
    settings = lambda: {r.key: r.value for r in spark.sql("set").collect()}
    p.language_id(spark, docs.limit(5), sf)
    before = settings()
    got = {r.doc_id: r.lang for r in p.language_id(spark, docs.union(spark.createDataFrame(added + gone, docs.schema)), sf).collect()}
    assert settings() == before
    assert set(got) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {r[0] for r in added}
    assert all(got[r[0]] == "en" for r in added if r[2]) and all(got[r[0]] in {*by_lang, "und"} for r in added)
    assert all(got[r[0]] == "und" for r in added[1:6:2])


ODD = "doc_id long, text string, lang string, source string, n_chars int, found string, score double, evidence long, row long, gone long, place long, mix_id long, mix_at double, file string, at long, base long, path string, rows long, component_id long"


def odd_rows():
    """Null and shared ids, equal texts under one id, near copies without an id."""
    long = [f"Word{i}" for i in range(80)]
    texts = [(None, " ".join(long)), (None, " ".join([*long[:79], "other"])), (7, " ".join([*long[:78], "other", "two"])), (7, "Ab cd ef gh"), (7, "ab cd ef gh"), (None, "ab CD ef gh"), (8, None), (9, ""), (3, "only here")]
    return [(i, t, "en", "s1" if k % 2 else None, 1, "f", 0.5, 1, 2, 3, 4, 5, 6.0, "x", 7, 8, "y", 9, 10) for k, (i, t) in enumerate(texts)]


def test_pipeline_on_odd_rows_and_clashing_names(spark):
    import corpus_pipeline as p

    frame = spark.createDataFrame(odd_rows(), ODD)
    one = p.language_id(spark, frame, "")
    assert one.columns == frame.columns and one.count() == 7
    two = p.exact_dedup(spark, one, "")
    assert two.columns == frame.columns
    assert sorted((str(r.doc_id), low(r.text)) for r in two.collect()) == sorted((str(i), low(t)) for i, t in {low(t): (i, t) for i, t, *_ in odd_rows() if t and not (i is None and "ab cd" in low(t))}.values())
    alone = p.exact_dedup(spark, spark.createDataFrame([(5, "Abc", "en", "s", 3)] * 2 + [(5, "abc", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars int"), "")
    assert alone.count() == 1
    three = p.near_dedup(spark, two, "")
    assert three.columns == frame.columns
    assert sorted((r.doc_id, low(r.text)[:9]) for r in three.collect()) == [(3, "only here"), (7, "ab cd ef "), (7, "word0 wor")]
    four = p.mix_sources(spark, three, "")
    assert four.columns == frame.columns
    five = p.encode(spark, four, "")
    assert five.columns == ["place", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    none = frame.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, "").count() == 0


def test_places_are_those_of_the_rows(spark, sf):
    from matchlake.llm.scratch import _is_scan, placed

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.join(spark.createDataFrame([(1,), (2,)], "k int").hint("broadcast"), F.lit(True))
    assert _is_scan(docs) and _is_scan(docs.where("doc_id > 3").select("doc_id")) and not _is_scan(twice)
    for table in (docs, docs.where("doc_id % 2 = 0"), twice, docs.union(docs)):
        places = [r.place for r in placed(table, "place").select("place").collect()]
        assert len(set(places)) == len(places) == table.count()


def test_pipeline_keeps_the_training_order(spark, sf):
    """Rows of the last stage follow the plan of the mix through the files between the stages."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = Scratch(spark, "order")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    mixed = folder.save(p.mix_sources(spark, docs, sf), "mixed")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    got = [(r.doc_id, r.n_tokens, len(r.ids)) for r in sorted(p.encode(spark, mixed, sf).collect(), key=lambda r: r.place)]
    plan = sorted((t, r.doc_id) for r in mixing.mix(docs).collect() for t in r.positions)
    assert [i for i, _, _ in got] == [i for _, i in plan] and all(n == m for _, n, m in got)
    places = [r.place for r in p.encode(spark, mixed, sf).select("place").collect()]
    assert sorted(places) == list(range(len(plan)))


def test_pipeline(spark, awkward):
    import corpus_pipeline as p

    rows = [r for r in awkward_rows() if r[0] is not None]
    frame = awkward.where("doc_id is not null")
    one = p.language_id(spark, frame, "")
    assert one.columns == frame.columns
    letters = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in one.collect()} == letters
    two = p.exact_dedup(spark, one, "")
    last = {}
    for i, t, *_ in rows:
        if i in letters:
            last[low(t)] = max(i, last.get(low(t), i))
    assert sorted(r.doc_id for r in two.collect()) == sorted(last.values())
    three = p.near_dedup(spark, two, "")
    stay = [r for r in rows if last.get(low(r[1])) == r[0]]
    groups = brute_near(list({r[0]: r for r in stay}.values()), 5, 80, 100)
    assert sorted(r.doc_id for r in three.collect()) == [i for i, (_, _, kept) in groups.items() if kept]
    four = p.mix_sources(spark, three, "")
    passes = {r.doc_id: len(r.positions) for r in mixing.mix(three).collect()}
    seen = defaultdict(int)
    for r in four.collect():
        seen[r.doc_id] += 1
    assert four.columns == frame.columns and dict(seen) == {i: n for i, n in passes.items() if n}
    library, texts = Tokenizer.from_file(VOCABULARY), {r.doc_id: r.text for r in four.collect()}
    five = p.encode(spark, four, "").collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.collect())
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in five)
