"""Line dedup, SimHash, decontamination, vector search and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, line_dedup, queries, simhash_dedup, vp_search
from ledgerloom.llm.common import join_counted
from ledgerloom.llm.line_dedup import CuckooFilter, LineIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "A line that is long enough"
DOCS = [
    (0, f"{LINE}\nx\n"), (1, f" {LINE.upper()}\t\n{LINE}\nown line of the second one"), (2, LINE), (2, LINE), (3, None), (4, ""), (5, f"é{'x' * 18}\né{'x' * 18}"),
    (6, f"é{'x' * 18}é\n"), (7, f"é{'x' * 18}é"), (8, f"é{'x' * 18}é\n\n"), (None, f"{LINE}\n{LINE}"), (9, "z" * 40_000 + "\n" + LINE),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_lines int")


def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_line_dedup(spark, sf_dir):
    real = [(r["doc_id"], r["text"]) for r in queries.read(spark, sf_dir, "documents").collect()]
    for rows in (DOCS, real):
        got = line_dedup.dedup_lines(frame(spark, rows))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_lines", "n_dropped"]
        assert order((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == order(brute_lines(rows))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def filter_keys(index):
    """What the filters of an index say of all keys that it ever had, and how many they hold."""
    return {r["shard"]: CuckooFilter.from_row(r["capacity"], r["size"], bytes(r["tags"]), bytes(r["extra"])) for r in index.filters().collect()}


def test_line_filters_of_many_shards(spark, sf_dir):
    docs = queries.read(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex.build(docs, keys_per_shard=3)
    assert index.filters().count() > 5
    hits = index.table.distinct()
    for salt_rows in (1 << 22, 2):
        possible = index.possible(hits, salt_rows)
        assert possible.join(index.counts(), "__line_key", "left_semi").count() == hits.join(index.counts(), "__line_key", "left_semi").count()
        assert possible.count() < 0.5 * hits.count()  # the filters keep most keys away from the exact table
    whole = line_dedup.dedup_lines(docs)
    assert order(map(tuple, line_dedup.dedup_lines(docs, index=index).collect())) == order(map(tuple, whole.collect()))


def test_hot_keys_are_joined_aside(spark):
    table = spark.range(300_000).select(F.when(F.col("id") < 250_000, 0).otherwise(F.col("id")).alias("k"), "id")
    own = table.groupBy("k").agg(F.count("*").alias("__n"), F.min("id").alias("least")).filter("k % 7 = 0")
    assert join_counted(table, own, "k", 300_000).agg(F.count("*"), F.sum("least")).first() == table.join(own, "k").agg(F.count("*"), F.sum("least")).first()


@pytest.mark.parametrize("keys_per_shard", [1, 1 << 18])
def test_line_index_is_reversible(spark, keys_per_shard):
    first, more = frame(spark, [r for r in DOCS if r[0] in (0, 1, 5, 6)]), frame(spark, [r for r in DOCS if r[0] in (2, 7, 8, 9)])
    third = frame(spark, [(20 + i, f"{j} is a line of many documents") for i in range(3) for j in range(9)])
    index = LineIndex.build(first.union(third), keys_per_shard=keys_per_shard)
    assert index.counts().count() == 9
    before = filter_keys(index)
    grown = index.insert(more)
    assert {(r["n_docs"], r["keeper"]) for r in grown.counts().collect()} == {(4, 9), (3, 8), (3, 22)}
    grown.refresh(index)
    keys = grown.counts().select(F.pmod(F.xxhash64("__line_key"), F.lit(grown.filters().first()["shards"])).alias("s"), "__line_key").collect()
    held = filter_keys(grown)
    assert sum(f.size for f in held.values()) == len(keys) == 11 and all(held[r["s"]].contains([bytes(r[1])])[0] for r in keys)
    back = grown.delete(more)
    back.refresh(grown)
    assert order(map(tuple, back.counts().collect())) == order(map(tuple, index.counts().collect()))
    after = filter_keys(back)
    assert sum(f.size for f in after.values()) == sum(f.size for f in before.values()) == 9
    assert all((after[s].table > 0).sum() + sum(after[s].overflow.values()) == f.size for s, f in before.items() if s in after)
    assert back.insert(frame(spark, [])).counts().count() == 9 and back.delete(frame(spark, [])).counts().count() == 9


def test_a_full_filter_grows(spark):
    rows = lambda n: frame(spark, [(i, "\n".join(f"{j} is a line of many documents" for j in range(n))) for i in range(3)])
    index = LineIndex.build(rows(5))
    capacity = index.filters().first()["capacity"]
    grown = index.insert(rows(300))
    found = grown.refresh(index).first()
    assert found["size"] == 300 and found["capacity"] >= 300 > capacity


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = [rng.bytes(16) for _ in range(6000)]
    made = CuckooFilter(3000)  # too small on purpose: the rest overflows
    made.insert(keys)
    assert made.contains(keys).all() and made.overflow
    made = CuckooFilter(6600)
    made.insert(keys)
    assert made.contains(keys).all() and made.contains([rng.bytes(16) for _ in range(5000)]).mean() < 0.01
    made.delete(keys[:3000])
    assert made.contains(keys[3000:]).all() and made.contains(keys[:3000]).mean() < 0.01
    made.delete(keys[3000:])
    assert made.table.sum() == 0
    with pytest.raises(KeyError):
        made.delete(keys[:1])


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(spark, sf_dir):
    real = [r["text"] for r in queries.read(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    texts = [None, "", " \n", "one two", "One TWO ", "a b c d", "a b c d e", "É b c d", "é b c d", *real]
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(frame(spark, enumerate(texts))).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps)
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash_dedup.drop_near_duplicates(frame(spark, enumerate(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(fps)))


def signed(fps):
    return sorted(x - (1 << 64) if x >> 63 else x for x in fps)


@pytest.mark.parametrize("slice_rows", [1, 4, 40, 1024])
def test_trie_join_loses_no_link(spark, slice_rows):
    rng = np.random.default_rng(2)
    fps = set(rng.integers(0, 1 << 63, 300).tolist())
    for f in list(fps)[:30]:  # chains and dense groups
        for _ in range(25):
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            fps.add(f)
    fps = signed(fps)
    links = simhash_dedup.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), slice_rows=slice_rows)
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(links).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in fps])
    got = [roots.get(f, f) for f in fps]
    assert [got.index(g) for g in got] == want


def test_a_crowded_bucket_costs_a_bounded_number_of_rows(spark):
    rng = np.random.default_rng(3)
    fps = signed({int(x) >> 13 for x in rng.integers(0, 1 << 63, 4000)})  # all agree in their first bits
    for some in (fps, fps[:2000]):
        rows = simhash_dedup.cells(spark.createDataFrame([(f,) for f in some], "fp long"), slice_rows=16).groupBy("fp").count()
        assert rows.agg(F.max("count")).first()[0] <= 90  # by slices alone: 250 and 125 in the crowded bucket
    assert [simhash_dedup.blocks_for(n, 4, 1024) for n in (1000, 10**6, 10**9, 10**12)] == [5, 5, 6, 8]


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "other words stand in this one"), (9, "other words stand in this one"), (9, "other words stand in this one"), (7, "a third text of its own"), (7, "a third text of its own"), (None, "a third text of its own"), (None, "nobody has this one"), (None, "nobody has this one")]
    got = simhash_dedup.drop_near_duplicates(frame(spark, rows))
    assert order((r["doc_id"], r["text"]) for r in got.collect()) == order([(3, "a b c d e f"), (5, "other words stand in this one"), (7, "a third text of its own"), (None, "nobody has this one")])
    renamed = frame(spark, rows[:2]).withColumnsRenamed({"doc_id": "fp", "lang": "component_id", "source": "fingerprint"})
    assert [r["fp"] for r in simhash_dedup.drop_near_duplicates(renamed, "fp").collect()] == [3]
    assert sorted((r["fp"], r["component_id"]) for r in simhash_dedup.near_duplicates(renamed, "fp").collect()) == [(3, 3), (5, 3)]


def test_trie_join_pairs():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 64, 40).astype(np.uint64) << np.uint64(20) | rng.integers(0, 8, 40).astype(np.uint64))
    cell, side = np.zeros(len(keys), np.int64), rng.integers(1, 3, len(keys))
    for sides in (np.zeros(len(keys), np.int64), side):
        i, j = simhash_dedup.trie_self_join(keys, cell, sides, 4)
        want = {(a, b) for a in range(len(keys)) for b in range(len(keys)) if a < b and int(keys[a] ^ keys[b]).bit_count() <= 4 and (sides[a] == 0 or sides[a] != sides[b])}
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=10):
    out = []
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    phrases = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(name)
    sizes = {len(p) for p in phrases}
    for doc, text in rows:
        w, hit, names = split(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if (found := phrases.get(tuple(w[i : i + n]))) and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    names |= found
        names = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(w), len(hit), names))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Only three words"), (3, None), (4, "..."), (5, "a a a a a a a a a a a"), (None, "nameless item of five words"), (6, "two three four five six seven eight nine ten eleven twelve")]
TEXTS = [None, "", "x. ONE two, three four five six seven eight nine ten eleven twelve!", "only three words only three words", "a " * 500, "only three", "nameless item of five words", "two three four five six seven eight nine ten eleven", "é only three words é"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, sf_dir, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [*enumerate(TEXTS), (2, TEXTS[2]), (None, TEXTS[3])]
    got = decontaminate.find_contamination(frame(spark, rows), items, block_bytes=block_bytes, shard_words=60)
    assert order((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()) == order(brute_hits(rows, ITEMS))


def test_shards_go_on_over_batches(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(3000)]
    some = frame(spark, rows).coalesce(1)
    want = order(brute_hits(rows, ITEMS))
    for shard_words in (1, 50_000, 1 << 20):
        got = decontaminate.find_contamination(some, items, shard_words=shard_words)
        assert order((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()) == want


def test_contamination_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in queries.read(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in queries.read(spark, sf, "benchmark").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in queries.op9_decontaminate(spark, sf).collect()}
    want = {i: (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest()) for i, n, hit, names in brute_hits(rows, items)}
    assert got == want and any(w[1] for w in want.values())


def test_remove_contamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(frame(spark, enumerate(TEXTS)), items).collect()}
    assert got == {0: None, 1: "", 2: "x.\n!", 5: "only three", 8: "é\né"}
    assert decontaminate.remove_contamination(frame(spark, []), items).count() == 0
    assert decontaminate.remove_contamination(frame(spark, enumerate(TEXTS)), items.limit(0)).count() == len(TEXTS)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(6)
    symbols = np.append(rng.integers(0, 4, 3000), 0).astype(np.int32)
    symbols[1000:1400] = symbols[100:500]  # a long repeat
    index = decontaminate.FMIndex(symbols, 3)
    for size in (1, 2, 3, 5, 60):
        starts = [i for i in rng.integers(0, 3000 - size, 200).tolist() if (symbols[i : i + size] > 0).all()]
        table = np.unique(np.array([symbols[i : i + size] for i in starts] or [[1] * size], np.int64), axis=0)
        low, high = index.count(table)
        for phrase, a, b in zip(table, low, high):
            want = [i for i in range(len(symbols) - size) if (symbols[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_nearest(rows, k=20):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for r, (q, v) in enumerate(usable):
        if q % 20 == 0:
            pairs = sorted((-float(np.cumsum(w * v)[-1]), i) for s, (i, w) in enumerate(usable) if s != r and len(w) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(pairs, 1)]
    return order(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_nearest(spark, block_bytes):
    rng = np.random.default_rng(8)
    table = rng.normal(size=(400, 8)).astype(np.float32)
    table[100:160] = table[100]
    table[200:220] *= 9
    rows = [(i, v.tolist()) for i, v in enumerate(table)]
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] + [0.0] * 7), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [1.0] * 8), (520, [])]
    rows += [(20, rows[21][1]), (40, rows[40][1]), (40, rows[40][1]), (41, rows[40][1])]  # repeated ids, with other vectors and with the same
    rows += [(120, rows[120][1])] * 30  # more twins than neighbours are asked for
    found = vp_search.nearest(vectors(spark, rows), shard_rows=90, block_bytes=block_bytes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert order(map(tuple, found.collect())) == brute_nearest(rows)
    assert vp_search.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_a_query_and_its_twin_find_each_other(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.5]), (21, [0.0, 1.0])]
    got = sorted(tuple(r) for r in vp_search.nearest(vectors(spark, rows)).collect())
    assert got == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 21, 0.0), (20, 2, 21, 0.5)]


def test_tree_prunes_and_factor_prunes_more():
    rng = np.random.default_rng(9)
    table = rng.normal(size=(3000, 3))
    tree = vp_search.VPTree.from_bytes(vp_search.VPTree.build(np.arange(3000), table, leaf=16).to_bytes())
    asked, own = table[::100], np.arange(0, 3000, 100)
    (exact, all_), (loose, fewer) = tree.search(asked, own, 10), tree.search(asked, own, 10, 1.3)
    want = [[i for _, i in sorted((-float((table[j] * q).sum()), j) for j in range(3000) if j != o)[:10]] for q, o in zip(asked, own)]
    assert [[i for _, i, _ in p] for p in exact] == want
    assert fewer.mean() < all_.mean() < 0.9 * 3000
    assert np.mean([len({i for _, i, _ in a} & {i for _, i, _ in b}) / 10 for a, b in zip(exact, loose)]) >= 0.9


def test_relaxed_factor_on_the_tables(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.read(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    ids, table = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    tree = vp_search.VPTree.build(ids, table, leaf=128)
    asked = ids % 20 == 0
    (exact, all_), (loose, fewer) = tree.search(table[asked], ids[asked], 20), tree.search(table[asked], ids[asked], 20, 6.0)
    assert fewer.mean() < all_.mean()
    assert np.mean([len({i for _, i, _ in a} & {i for _, i, _ in b}) / 20 for a, b in zip(exact, loose)]) >= 0.9


def test_search_of_the_tables(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.read(spark, sf_dir, "embeddings").collect()]
    assert order(map(tuple, queries.op5_vp_search(spark, sf_dir).collect())) == brute_nearest(rows)


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = [(r["doc_id"], r["text"]) for r in queries.read(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for i, _, _, t in brute_lines(rows)]
    component = brute_components([brute_fp(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if component[k] == k]
    items = [(r["item_id"], r["text"]) for r in queries.read(spark, sf_dir, "benchmark").collect()]
    hits = {i: (n, hit) for i, n, hit, _ in brute_hits(rows, items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {i for i, (n, hit) in hits.items() if hit == 0 or hit < n}
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    for i, t in rows:
        if hits[i][1] == 0:
            ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
            assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and got[i]["n_tokens"] == len(ids)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = queries.read(spark, sf_dir, "documents").filter(F.col("doc_id") < 40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
