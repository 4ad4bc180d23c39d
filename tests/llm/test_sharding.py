import random

import numpy as np
from tests.llm.data import prose

from rivulet.llm import sharding


def test_groups_of_equal_texts_stay_whole_where_they_fit(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(1500)]
    for n in (60, 40, 25, 12, 9, 5, 3, 2):
        texts += [prose(rng, 80)] * n
    huge = prose(rng, 60)
    texts += [huge] * 260
    rng.shuffle(texts)
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert len(out) == len(texts) and out["doc_id"].is_unique
    sizes = out.groupby("shard")["size"].sum()
    held = out.groupby("text")["shard"].nunique()
    assert held.drop(huge).max() == 1
    # the one group that is larger than a shard has as many pieces as its rows or bytes need
    of = out[out.text == huge]
    assert held[huge] == max(-(-16 * of["size"].sum() // out["size"].sum()), -(-16 * len(of) // len(out)))
    assert sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98


def test_a_group_is_cut_only_where_it_fits_no_shard():
    total = np.array([400.0, 400.0, 400.0])
    groups = np.array([[90.0] * 3, [60.0] * 3, [50.0] * 3, [150.0] * 3])
    pieces = sharding.spread(groups, total, 4)
    assert [len(at) for at, _ in pieces] == [1, 1, 1, 2]
    used = np.zeros(4)
    for g, (at, part) in zip(groups, pieces, strict=True):
        used[at] += g[0] * part
        assert abs(part.sum() - 1) < 1e-9
    assert used.max() < 100 + 1e-6


def test_parcels_cost_little_against_packing_every_group(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([3, 20, 60, 200])) for _ in range(4000)]
    texts += [t for t in rng.sample(texts, 200) for _ in range(rng.randint(1, 12))]
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    groups = {}
    for t in texts:
        g = groups.setdefault(t, np.zeros(3))
        g += (len(t.encode()) + 1, len(t.split()), 1)
    loads = np.array(list(groups.values()))
    whole = sharding.pack(loads, np.full(len(loads), -1), 16)  # every group by itself, none by its hash
    spread_of = lambda sums: (sums.max() - sums.min()) / sums.mean()
    single = [spread_of(np.bincount(whole, loads[:, i], 16)) for i in range(3)]
    tokens = out["text"].str.split().str.len()
    got = [spread_of(out.groupby("shard")["size"].sum()), spread_of(tokens.groupby(out["shard"]).sum()), spread_of(out.groupby("shard").size())]
    assert got[0] < single[0] + 0.005 and got[1] < single[1] + 0.03 and got[2] < single[2] + 0.15
    assert out.groupby("text")["shard"].nunique().max() == 1
