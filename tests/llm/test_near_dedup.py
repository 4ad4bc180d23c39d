import random
import re
from collections import Counter

import numpy as np
from tests.llm.data import awkward, empty, prose

from rivulet.llm import near_dedup as N


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [shingles(t) for _, t in rows]
    held = [{(s, k) for s, n in b.items() for k in range(n)} for b in bags]  # a shingle's occurrences are elements of their own
    for i in range(len(rows)):
        for j in range(i):
            both = len(held[i] & held[j])
            if held[i] and held[j] and both >= 0.8 * (len(held[i]) + len(held[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["new", "other", "third"]) + str(rng.randrange(99))
    return " ".join(words)


def fixture():
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 300))
        rows += [base, base] + [edited(rng, base, rng.randint(1, 3)) for _ in range(4)] + [edited(rng, base, 12) for _ in range(3)]
    hot = prose(rng, 200)  # one large group of near copies, many of them no links of each other
    rows += [edited(rng, hot, rng.randint(2, 6)) for _ in range(60)]
    common = prose(rng, 40)
    rows += [common + " " + prose(rng, 40) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = fixture()
    got = {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_prefixes_find_all_links_of_a_band(spark):
    rng = random.Random(9)
    hot = prose(rng, 120)
    texts = [edited(rng, hot, rng.randint(1, 5)) for _ in range(150)] + [edited(rng, hot, 1) + " " + prose(rng, k) for k in range(0, 30, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.select(docs.doc_id.alias("node"), N.normal_words("text").alias("words"))
    sketches = words.mapInArrow(N._sketches, "node long, sketch array<long>").cache()
    split = sketches.selectExpr("1L AS band", "node", "CAST(size(sketch) AS long) AS size", "node AS root").cache()
    bags = [shingles(t) for t in texts]
    alike = {}
    for i, a in enumerate(bags):
        for j in range(i + 1, len(bags)):
            alike[i, j] = sum((a & bags[j]).values()) / sum((a | bags[j]).values())
    want = {p for p, v in alike.items() if v >= 0.8}
    some = {(r.a, r.b) for r in N._prefix_pairs(split, sketches, 0.8).collect()}
    every = {(r.a, r.b) for r in N._pairs(split, 0.8).collect()}
    assert want <= some < every and len(want) > 100
    assert len(some) < 0.8 * len(every)


def join_rows(spark, since):
    """Output rows of each join that ran in an execution after the first ``since``."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, out = store.executionsList(), []
    for i in range(since, executions.size()):
        key = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size() if "Join" in node.name() else 0)):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_prefixes_of_a_large_group_join_no_sketch_whole(spark):
    rng = random.Random(11)
    hot = prose(rng, 150)
    texts = [edited(rng, hot, rng.randint(1, 3)) for _ in range(300)] + [edited(rng, hot, 30) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sketches = docs.select("node", N.normal_words("text").alias("words")).mapInArrow(N._sketches, "node long, sketch array<long>").cache()
    split = sketches.selectExpr("1L AS band", "node", "CAST(size(sketch) AS long) AS size", "IF(node < 300, 0L, node) AS root").cache()
    elements = sketches.selectExpr("sum(size(sketch))").first()[0]
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    some = {(r.a, r.b) for r in N._prefix_pairs(split, sketches, 0.8).collect()}
    rows = join_rows(spark, since)
    assert rows and max(rows) < 0.3 * elements, (rows, elements)
    bags = [shingles(t) for t in texts]
    for a in range(400):
        for b in range(max(300, a + 1), 400):
            both = sum((bags[a] & bags[b]).values())
            assert (a, b) in some or both < 0.8 * (bags[a].total() + bags[b].total() - both)


def test_a_large_group_whose_pairs_are_mostly_no_links(spark):
    rng = random.Random(4)
    hot = prose(rng, 150)
    texts = [edited(rng, hot, rng.randint(3, 7)) for _ in range(2000)] + [hot + " " + prose(rng, 90) for _ in range(200)]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(list(enumerate(texts)))


def test_signatures_estimate_weighted_similarity():
    a = ("a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3).strip()
    b = a.replace("m", "M2").replace("t", "T3")
    data = np.frombuffer((a + b).encode(), np.uint8)
    elements, begin = N.unit_elements(data, np.array([0, len(a), len(a) + len(b)]))
    signature = N.dart_signatures(elements, begin, 2048)
    x, y = (set(elements[begin[i] : begin[i + 1]].tolist()) for i in range(2))
    assert abs((signature[0] == signature[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_awkward_rows(spark):
    out = N.near_classes(awkward(spark)).collect()
    assert len(out) == 13
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in by[1] + by[2]} == {1} and {r.class_size for r in by[2]} == {3}
    assert all(r.class_id == r.doc_id and r.class_size == 1 and r.is_kept for d in (3, 4, 5, 6) for r in by[d])
    assert by[9][0].class_id == 8 and not by[9][0].is_kept
    kept = N.drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = sorted((r.doc_id or -1 for r in kept.collect()))
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 10]
    assert N.near_classes(empty(spark)).count() == 0 and N.drop_near_duplicates(empty(spark)).count() == 0


def test_equal_texts_without_words_are_one_class(spark):
    texts = ["-----"] * 5 + ["\U0001f600 \U0001f600"] * 3 + ["---- -"] + [""] * 2 + [None] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size, r.is_kept) for r in N.near_classes(docs).collect()}
    want = {i: (0, 5, i == 0) for i in range(5)} | {i: (5, 3, i == 5) for i in range(5, 8)}
    assert got == want | {i: (i, 1, True) for i in range(8, 13)}
    assert sorted(r.doc_id for r in N.drop_near_duplicates(docs.union(docs.limit(1))).collect()) == [0, 5, 8, 9, 10, 11, 12]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in N.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
