"""The forest join and winnowing against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pactum.llm import decontamination, minhash_forest
from pactum.llm.words import WORD_PATTERN


def words(text):
    return re.findall(WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_join(pairs, threshold=0.8):
    sets = [shingles(t) for _, t in pairs]
    near = defaultdict(set)
    for i in range(len(pairs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= threshold):
                near[i].add(j)
                near[j].add(i)
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        label[i] = min(pairs[k][0] for k in seen)
    return sorted((pairs[i][0], label[i], len(near[i])) for i in range(len(pairs)))


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    pairs = []
    for i in range(n):
        if pairs and rng.random() < 0.6:
            w = rng.choice(pairs)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 12])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            pairs.append((i, " ".join(w)))
        else:
            pairs.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 90, 200])))))
    return pairs


@pytest.mark.parametrize("block", [256, 5])
def test_join_equals_brute_force(documents, block):
    pairs = corpus()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.join(documents(pairs, "rep id nodes"), block=block).collect())
    assert got == brute_join(pairs)


def test_one_large_group_of_near_copies(documents):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    pairs = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        pairs.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.join(documents(pairs), block=16).collect())
    assert got == brute_join(pairs) and {c for _, c, _ in got} == {0}


def test_join_of_odd_rows(documents, odd):
    rows = minhash_forest.join(documents(odd)).collect()
    assert len(rows) == len(odd)
    empty = {r.class_id for r in rows if r.doc_id in (1, 2, 9)}
    assert empty == {r.class_id for r in rows if r.doc_id in (1, 2, 9)} and len(empty) == 1
    assert [r.n_links for r in rows if r.doc_id == 7] == [1, 1]
    assert minhash_forest.join(documents([])).count() == 0


def test_classes_of_repeated_and_null_ids_go_by_their_least_id(documents):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(50, a), (50, a + " z"), (7, b), (9, a), (None, a), (None, b), (None, "alone on its own here"), (3, a + " y"), (3, "no relation to any other row")]
    got = sorted((r.doc_id or 0, r.class_id if r.class_id > 0 else 0, r.n_links) for r in minhash_forest.join(documents(rows)).collect())
    assert got == [(0, 0, 0), (0, 3, 4), (0, 7, 1), (3, 3, 0), (3, 3, 4), (7, 7, 1), (9, 3, 4), (50, 3, 4), (50, 3, 4)]
    left = sorted((r.doc_id or 0, r.text) for r in minhash_forest.one_of_each(documents(rows, "id node row")).collect())
    assert left == [(0, "alone on its own here"), (3, a + " y"), (3, "no relation to any other row"), (7, b)]


def test_blocks_by_files_equal_those_in_place(documents, monkeypatch):
    pairs = corpus(120, 11)
    monkeypatch.setattr(minhash_forest, "BLOCK_BYTES", 2000)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.join(documents(pairs)).collect())
    assert got == brute_join(pairs)


def test_prefixes_are_shortened_until_the_recall(documents):
    assert minhash_forest.levels() == [8, 7, 6, 5, 4]
    base = [f"w{i}" for i in range(200)]
    import pyarrow as pa

    from pactum.llm.common import utf8

    texts = [" ".join(base), " ".join(["x", *base[1:]]), " ".join([*base[:30], "y", *base[30:60], "q", *base[60:]])]
    sets = list(minhash_forest.shingle_sets(*utf8(pa.array(texts)), 5))
    nodes, tails = minhash_forest.signatures(sets, 20, 4, 8)
    for t in range(20):
        batch = pa.RecordBatch.from_pydict({"tree": pa.array([t] * 3, pa.int32()), "rep": [0, 1, 2], "n_docs": [1, 1, 1], "tail": tails[:, t].view("i8"), "nodes": pa.array(nodes.view("i8").tolist())})
        block = minhash_forest._Block(batch)
        met = minhash_forest._parting(block, block, minhash_forest.levels())
        for i in range(3):
            for j in range(3):
                if i == j or (nodes[i, :t] == nodes[j, :t]).any():
                    assert met[i, j] == 0
                    continue
                below = next((d for d in range(4) if (int(tails[i, t]) ^ int(tails[j, t])) >> (48 - 16 * d) & 0xFFFF), 4)
                assert met[i, j] == 4 + below


def test_one_of_each_stays(documents, odd):
    pairs = corpus(80, 7)
    df = documents(pairs, "_n _class id")
    kept = minhash_forest.one_of_each(df)
    assert kept.columns == df.columns and {(r["_n"], r["_class"], r["id"]) for r in kept.collect()} == {("own",) * 3}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_join(pairs)})
    left = [(r.doc_id, r.text) for r in minhash_forest.one_of_each(documents(odd)).collect()]
    assert sorted(words(t)[:2] for _, t in left) == sorted([[], ["one"], ["null", "id"], ["same", "same"], ["é" * 3000]])


def test_depth_meets_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        d = minhash_forest.prefix_depth(recall=recall)
        assert d == 1 or 1 - (1 - 0.8**d) ** minhash_forest.TREES >= recall
    assert minhash_forest.prefix_depth(recall=0.5) > minhash_forest.prefix_depth(recall=0.9999)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.least for r in minhash_forest.components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert minhash_forest.components(df.filter("a = b")).count() == 0


def test_join_query_matches_its_sql(same_rows):
    assert same_rows(minhash_forest.op3_minhash_join, minhash_forest.OP3_SQL)


def brute_leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc is None, doc or 0, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def leaks(spark, case_dir, docs, items):
    folder = case_dir(documents=spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    rows = decontamination.op5_decontamination(spark, folder).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


def test_winnowing_equals_brute_force(spark, case_dir, odd):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "dd", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25, 40]))) for i in range(30)] + [(30, None), (31, ""), (None, "one"), (3, "same same"), (3, "same same"), (40, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11")]
    docs = [(i, text(rng.choice([0, 5, 9, 10, 30, 120]))) for i in range(100)] + [(200 + i, f"q r {' '.join(t.upper() for t in items[i][1].split()[:10])} z") for i in range(20)]
    docs += [(300, "q x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 y"), (301, "x1 x2 x3 x4 x5 x6 x7 x8 x9"), *odd]
    assert leaks(spark, case_dir, docs, items) == brute_leaks(docs, items)


def test_long_words_that_differ_in_distant_bytes(spark, case_dir):
    a, b = ["q"] * 9000, ["q"] * 9000
    a[100], b[100 + 4096] = "z", "z"
    items, docs = [(1, "".join(a))], [(1, "".join(b)), (2, "".join(a)), (3, "\u6f22" * 1_500_000)]
    assert leaks(spark, case_dir, docs, items) == brute_leaks(docs, items)


def test_winnowing_of_empty_tables(spark, case_dir):
    assert leaks(spark, case_dir, [], [(1, "a b")]) == []
    assert leaks(spark, case_dir, [(1, "a b c")], []) == brute_leaks([(1, "a b c")], [])


def test_join_of_fingerprints_equals_brute_force(spark, odd):
    """Items of many blocks, some short, in texts that hit several of them."""
    rng = random.Random(12)
    vocabulary = ["a", "b", "c", "dd", "é", "\U0001F600"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 9, 10, 12, 30, 60]))) for i in range(60)] + [(60, None), (None, "zz yy"), (61, "")]
    docs = [(i, text(rng.choice([0, 5, 10, 40, 150]))) for i in range(60)] + [(100 + i, f"q {(items[i][1] + ' r ' + items[i + 20][1]).upper()} zz, YY") for i in range(30)] + [(200, "plain words only")] * 3 + odd
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text_key", F.lit("own"))
    rows = decontamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=300).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in rows)
    assert got == brute_leaks(docs, items) and {r.text_key for r in rows} == {"own"}


def test_blocks_of_items_change_nothing(spark, documents):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)], "item_id long, text string")
    docs = documents([(i, " ".join(f"w{i}x{k}" for k in range(2, 12))) for i in range(60)])
    assert len(decontamination.index(items, block_bytes=200)) > 5
    found = decontamination.contaminated(docs, items, block_bytes=200).filter("n_hit > 0")
    assert sorted(r.doc_id for r in found.collect()) == list(range(40))
    from pyspark.sql import functions as F

    named = docs.withColumns({"n_hit": F.lit("own"), "ITEMS": F.lit("own"), "_n_hit": F.lit("own")})
    assert {tuple(r)[-3:] for r in decontamination.clean(named, items).collect()} == {("own",) * 3}
    marked = decontamination.contaminated(named, items)
    assert {(r["__n_hit"], r["_n_hit"], r["_ITEMS"]) for r in marked.collect()} == {("own",) * 3} and sorted(r.n_hit for r in marked.collect())[0] == 0
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40, 60))


def test_leak_query_matches_its_sql(same_rows):
    assert same_rows(decontamination.op5_decontamination, decontamination.OP5_SQL)
