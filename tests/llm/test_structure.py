"""Embedding links, conversation repair and periodic runs against plain versions, on whole tables and on awkward ones."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from rigspark import llm
from rigspark.llm import periodic
from rigspark.llm.embedding_join import meet, near_vectors, unit
from rigspark.llm.periodic import periodic_runs
from rigspark.llm.repair import KEEPS, audits_of, damage, repair_conversations, repair_report, search, step

from .tables import SPACE, docs

# ---- embeddings


def links_by_hand(rows, least=0.98):
    """Per row: links and component; rows are (id, vector, label)."""
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return a[1] == b[1] or x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least
    comp, links = {r[0]: r[0] for r in rows}, [0] * len(rows)
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and linked(rows[i], rows[j])]
    for i, _ in pairs:
        links[i] += 1
    while changed:
        changed = False
        for i, j in pairs:
            a, b = rows[i][0], rows[j][0]
            if comp[b] < comp[a]:
                comp[a], changed = comp[b], True
    return sorted((r[0], n, comp[r[0]]) for r, n in zip(rows, links))


def awkward_vectors():
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for k in range(160):
        v = [x + r.gauss(0, 0.05) for x in base[k % 8]]
        rows.append((k, v, k % 3))
    rows += [(200 + k, list(base[0]), 0) for k in range(40)]  # equal vectors
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 6, 0), (303, [float("nan")] + [1.0] * 5, 0), (304, [None] + [1.0] * 5, 0), (305, [float("inf")] + [1.0] * 5, 0),
             (306, base[0], None), (307, base[0][:3], 0), (308, [x * 1e-30 for x in base[0]], 0), (309, [x * 1e30 for x in base[0]], 0), (-4, [x * 2 for x in base[0]], 0)]
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embedding_links_equal_plain_version(spark, kind):
    rows = awkward_vectors()
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, _id string, _row int")
    got = near_vectors(df.repartition(7)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == links_by_hand(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_repeated_rows_null_ids_and_empty_table(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.01], "a"), (None, [0.0, 1.0], "a"), (7, [5.0, 0.0], "b"), (9, [0.0, 1.0], "b"), (7, [0.0, 2.0], "b")]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 7, 0, 7, True), (False, 7, 1, 7, True), (False, 9, 1, 7, False), (True, 0, 0, 0, True), (True, 0, 2, 1, False)]
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_wholly_near_stretches_link_without_pairs():
    r = np.random.default_rng(3)
    x = unit(np.vstack([r.normal(size=16) + r.normal(size=(700, 16)) * 0.003, r.normal(size=(500, 16))]))
    counts, group = meet(x, x, x[:, :8], x[:, :8], np.ones(len(x), np.int64), True, 0.98)
    hit = x @ x.T >= 0.98
    assert (counts == hit.sum(1) - 1).all()
    assert len(set(group[:700])) == 1 and group[0] not in group[700:]


# ---- conversations

STATES = {0, 3}


def edits_by_hand(rows, begin=0):
    """Cheapest edits of (initial, fault) rows, by going through them with the best of every state."""
    def put_in(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                t, way = step("I", "", s), (c + 5, a + "I")
                best[t] = min(best.get(t, way), way)
        return best
    best = {begin: (0, "")}
    for initial, fault in rows:
        new = {}
        for s, (c, a) in put_in(best).items():
            ways = [(s, c + 2, "D")]
            if fault not in (1, 2):
                c += 5 * (fault == 3)
                ways.append((step("R", initial, s), c + 1, "R"))
                if (initial, s) in KEEPS:
                    ways.append((KEEPS[initial, s], c, "K"))
            for t, cost, e in ways:
                new[t] = min(new.get(t, (cost, a + e)), (cost, a + e))
        best = new
    return min(w for s, w in put_in(best).items() if s in STATES)


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def report_by_hand(given, rows):
    out = {}
    for conv in {r[0] for r in given}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            kinds.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3))
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit = edits_by_hand(kinds)
        lines, state, it = [], 0, iter(mine)
        for e in audit:
            _, _, role, text = (None, None, "", "") if e == "I" else next(it)
            state = step(e, role[:1], state)
            if e != "D":
                lines.append(f"{role if e == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, f in kinds) for k in (1, 2, 3)),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_search_equals_plain_version():
    r = random.Random(2)
    for _ in range(1500):
        rows = [(r.choice(["u", "a", "u", "a", "s", "x", ""]), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 14))]
        assert search(rows) == edits_by_hand(rows), rows


def test_repair_query_equals_plain_version(spark, data):
    given = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_report(llm.queries()["op12_conversation_structure_repair"](spark, data)) == report_by_hand(given, damaged_by_hand(given))


def awkward_conversations():
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Yes.", "no", "What?", " ", "Fine!\n", f"t{t}."])) for t in range(400)]
    rows += [(2, 3, "system", "x."), (3, None, "user", "Hi."), (3, None, "assistant", "Oh."), (3, 5, "user", "Hi."), (3, 9, None, None), (3, 9, "", "A."), (3, 2, "tool", "B"),
             (None, 1, "user", "Hi."), (None, None, "assistant", "No."), (4, 0, "user", None), (5, 7, "user", "long " * 50_000 + "end."), (5, 8, "assistant", "Ok.")]
    return rows + [(6, 1, "user", "Again.")] * 5 + [(6, 2, "assistant", "Again.")] * 2 + [(k, 0, "user", "u.") for k in range(10, 60)]


@pytest.mark.parametrize("length", [1, 3, 64])
def test_repair_over_stretches_and_tasks(spark, length):
    given = awkward_conversations()
    df = spark.createDataFrame([(*g, "x", 1, "y") for g in given], "conv_id bigint, turn bigint, role string, text string, audit string, _turn int, _row string").repartition(5)
    assert as_report(repair_report(df, damage(df), length)) == report_by_hand(given, damaged_by_hand(given))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given]
    want = report_by_hand(plain, plain)
    repaired = {}
    for r in repair_conversations(df, length).orderBy("conv_id", "place").collect():
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in repaired.items()} == {c: w[-1] for c, w in want.items() if set(w[-2]) - {"D"}}


def test_repair_of_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair_report(df, damage(df)).count() == 0 and repair_conversations(df).count() == 0 and audits_of(df).count() == 0


# ---- periodic runs


def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_by_hand(doc_id, text, plant):
    w = [x for x in SPACE.sub(" ", text or "").split(" ") if x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = runs_by_hand(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            *(hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept)))


@pytest.mark.parametrize("slice_words", [40, 1 << 19])
def test_runs_equal_plain_version_on_random_words(slice_words, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(periodic, "TOP", 2)
    monkeypatch.setattr(periodic, "CANDIDATES", 50)
    r = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 6)):
            n, kinds = r.randint(0, 150), r.choice([1, 2, 3, 6])
            w = [str(r.randrange(kinds)) for _ in range(n)]
            p = r.randint(1, max(1, n // 3))
            texts.append(" ".join(w[i % p] if r.random() < 0.97 else w[i] for i in range(n)) if r.random() < 0.5 else " ".join(w))
        got = []
        for ids, words in periodic._slices(list(range(len(texts))), [t.encode() for t in texts], True):
            got += [(i, *f[:6], hashlib.sha256(t).hexdigest()) for i, f, t in zip(ids, *periodic._judge(words))]
        assert got == [periodic_by_hand(i, t, True) for i, t in enumerate(texts)]


def test_periodic_query_equals_plain_version(spark, data):
    given = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = llm.queries()["op13_periodic_runs"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(periodic_by_hand(r.doc_id, r.text, True) for r in given)


def test_periodic_runs_on_awkward_texts(spark):
    more = [(50, "a " * 3000), (51, "a b " * 700 + "c " + "b a " * 700), (52, "one two three " * 4), (52, None), (53, "x\x0by\x0cz\r" * 9), (None, "r s t u " * 6), (54, "é ü " * 20)]
    df = docs(spark).unionByName(docs(spark, more))
    rows = df.select("doc_id", "text").collect()
    for plant in (False, True):
        got = periodic_runs(df, plant=plant, texts=True).collect()
        order = lambda rows: sorted(rows, key=repr)
        assert order(tuple(r)[:-1] for r in got) == order(periodic_by_hand(r.doc_id, r.text, plant) for r in rows)
        assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert periodic_runs(df.limit(0)).count() == 0
