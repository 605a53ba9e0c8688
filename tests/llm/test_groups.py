"""Exact dedup and the Jaccard join: awkward tables and random sets against plain Python."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from rigspark.llm import components as cc, exact_dedup as ex, jaccard_join as jj
from rigspark.llm.components import components
from rigspark.llm.shingles import mix, shingle_sets

from .tables import SPACE, STORY, TEXTS, docs, lower


def groups_by_hand(texts):
    by = defaultdict(list)
    for i, t in texts:
        by[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in by.items()}


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, bits):
    texts = [*TEXTS, (30, STORY * 40), (31, STORY * 40 + "\t"), (32, STORY * 40 + "!")]
    got = ex.exact_groups(docs(spark, texts), hash_bits=bits).collect()
    groups = groups_by_hand(texts)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, *groups[SPACE.sub("", t or "")]) for i, t in texts)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_rows(spark):
    got = ex.exact_dedup(docs(spark))
    assert got.columns == docs(spark).columns
    assert Counter((r[0], SPACE.sub("", r[1] or "")) for r in got.collect()) == Counter((k, t) for t, (k, _) in groups_by_hand(TEXTS).items())
    assert ex.exact_dedup(docs(spark, [])).count() == ex.exact_groups(docs(spark, [])).count() == 0


def sets_by_hand(text):
    w = SPACE.sub(" ", lower(text)).split(" ")
    w = [x for x in w if x]
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def components_by_hand(texts, p=75, q=100):
    """Rows that share an id are one document; returns set size (last row of the id) and component by id."""
    sets, parent = [(i, sets_by_hand(t)) for i, t in texts], {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    for k, (i, s) in enumerate(sets):
        for other, n in Counter(o for x in s for o in index[x] if o < k).items():
            j, t = sets[other]
            if q * n >= p * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def test_shingles_are_the_sets():
    texts = [*(t for _, t in TEXTS), "word " * 9, "é" * 3_000_000 + " x"]
    got = shingle_sets([None if t is None else t.encode() for t in texts])
    assert [len(s) for s in got] == [len(sets_by_hand(t)) for t in texts]
    by_hash = {}
    for t, s in zip(texts, got):
        assert by_hash.setdefault(sets_by_hand(t), s.tobytes()) == s.tobytes()
    assert len({s for s in by_hash.values()}) == len(by_hash)


def test_similar_groups_on_awkward_rows(spark):
    texts = [(i if i is not None else 900 + k, t) for k, (i, t) in enumerate(TEXTS)]
    want = components_by_hand(texts)
    got = jj.similar_groups(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(sets_by_hand(t))) for i, t in texts)
    nulls = jj.similar_groups(docs(spark)).filter("doc_id IS NULL").collect()
    assert sorted((r.component_id or 0) for r in nulls) == [0, 6]
    assert jj.similar_groups(docs(spark, [])).count() == 0
    assert Counter(r[0] for r in jj.near_dedup(docs(spark, texts)).collect()) == Counter(i for i, t in texts if want[i][1] == i)


def chain_texts(seed, n):
    """Families of edited copies at all distances, many near the threshold, and a passage that unrelated texts share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage, out = rng.choices(words, k=40), []
    while len(out) < n:
        base = rng.choices(words, k=rng.choice([1, 3, 5, 6, 8, 12, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            out.append(" ".join(base))
            for _ in range(max(1, len(base) // rng.choice([15, 30, 60]))):
                base = list(base)
                k = rng.randrange(len(base))
                base[k:k + rng.randrange(2)] = rng.choices(words, k=rng.randrange(3))
                base = base or ["x"]
        if rng.random() < 0.5:
            out.append(" ".join(passage + rng.choices(words, k=rng.choice([5, 10, 15]))))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups_on_chains(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 3)
    monkeypatch.setattr(jj, "STAR", 2)
    monkeypatch.setattr(jj, "SAMPLE", 2)
    monkeypatch.setattr(jj, "SALTS", 3)
    monkeypatch.setattr(jj, "BROADCAST_IDS", 5 if seed == 2 else 10**6)
    texts = chain_texts(seed, 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_groups(docs(spark, texts)).collect()}
    assert got == components_by_hand(texts)


def test_signatures_meet_for_every_similar_pair():
    """Without Spark: any two sets over the threshold share a signature, whatever the allocation."""
    rng, sim = np.random.default_rng(5), jj.Similarity()
    for _ in range(3000):
        x = int(rng.choice([2, 3, 4, 6, 7, 15, 16, 20, 63, 64, 70, 200]))
        most = sim.most_difference(x, sim.largest_partner(x))
        a = mix(rng.integers(1, 2**63, x).astype(np.uint64))
        drop = int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([a[min(drop, x - 1):], mix(rng.integers(1, 2**63, int(rng.integers(0, most + 1))).astype(np.uint64))]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if not sim.linked(len(a), len(b), both):
            continue
        plan = {}
        for k in range(8):
            need = sim.most_difference(jj.band_top(k), sim.largest_partner(jj.band_top(k))) + 1
            near = int(rng.integers(0, need // 2 + 1))
            plan[k] = jj.Allocation(max(need - near + int(rng.integers(0, need + 1)), near, 1), near)
        often = rng.choice(a, 2)
        assert len(np.intersect1d(jj.set_signatures(a, plan, sim, often), jj.set_signatures(b, plan, sim, often)))
        assert jj.may_link(len(a), len(b), jj.sketch(a), jj.sketch(b), sim)


def test_signatures_of_many_sets_at_once():
    """Sets worked on together get what each gets alone, in a time that does not grow with the list of frequent signatures for every set."""
    rng, sim = np.random.default_rng(6), jj.Similarity()
    sets = [np.unique(mix(rng.integers(1, 2**63, int(x)).astype(np.uint64))) for x in rng.choice([1, 2, 5, 14, 40, 330, 900], 2000)]
    plan = {k: jj.Allocation(*a) for k, a in enumerate([(4, 0), (6, 1), (30, 3), (86, 0), (350, 20), (1366, 0)])}
    often = np.unique(np.concatenate([*(jj.set_signatures(s, plan, sim, np.zeros(0, np.uint64)) for s in sets[:100]), rng.integers(0, 2**63, 50_000).astype(np.uint64)]))
    began = time.process_time()
    found = [[] for _ in sets]
    for sig, of in jj.table_signatures(np.concatenate(sets), np.array([len(s) for s in sets]), plan, sim, jj.Frequent(often)):
        for i in np.unique(of).tolist():
            found[i].append(sig[of == i])
    assert time.process_time() - began < 8
    for i in range(0, len(sets), 20):
        assert np.unique(np.concatenate(found[i])).tolist() == jj.set_signatures(sets[i], plan, sim, often).tolist()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    links += [(7, 2000 + k) for k in range(100)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are, a step on few rows is not written by as many tasks."""
    texts, files = chain_texts(3, 400), []

    def counted(store):
        def run(df, *args, **kwargs):
            out = store(df, *args, **kwargs)
            files.append(len(out.inputFiles()))
            return out
        return run

    for module in (jj, cc):
        monkeypatch.setattr(module, "store", counted(module.store))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_groups(docs(spark, texts)).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == components_by_hand(texts)
    assert len(files) > 20 and max(files) <= 24, files


def test_large_runs_compared_as_arrays(monkeypatch):
    """Without Spark: a run compared as arrays gives the pairs that one comparison after the other gives."""
    rng, sim = np.random.default_rng(8), jj.Similarity()
    group, pool = [], mix(rng.integers(1, 2**63, 700).astype(np.uint64))
    for i, x in enumerate(rng.choice([1, 2, 5, 60, 63, 64, 65, 70, 128, 140, 300, 600], 400).tolist()):
        s = np.unique(np.concatenate([pool[:x], mix(rng.integers(1, 2**63, int(rng.integers(0, x // 8 + 1))).astype(np.uint64))]))
        heads = rng.integers(0, 300, int(rng.integers(0, 6))).tolist()
        group.append((5, 0, 1, int(rng.integers(0, 2)), int(rng.integers(0, 10**6)), int(rng.integers(0, 50)), len(s), jj.sketch(s), heads))
    group.sort(key=lambda r: r[6])
    for tile in (1, 40, 1 << 20):
        monkeypatch.setattr(jj, "TILE", tile)
        for one_block in (False, True):
            want = [(min(a[4], b[4]), max(a[4], b[4])) for x, a in enumerate(group) for b in group[x + 1:]
                    if a[5] != b[5] and (one_block or a[3] != b[3]) and not set(a[8]) & set(b[8]) and jj.may_link(a[6], b[6], a[7], b[7], sim)]
            assert len(want) > 1000 and Counter(jj.met_as_arrays(group, one_block, sim)) == Counter(want)


def test_chains_with_runs_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(jj, "MANY", 2)
    monkeypatch.setattr(jj, "TILE", 16)
    monkeypatch.setattr(jj, "BLOCK", 3)
    texts = chain_texts(4, 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar_groups(docs(spark, texts)).collect()}
    assert got == components_by_hand(texts)
