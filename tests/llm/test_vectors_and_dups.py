import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeloom.llm import angle_join as A
from citeloom.llm import cross_split as C
from citeloom.llm import near_duplicates as N
from citeloom.llm import similar_vectors as V


def brute_pairs(ids, m, k, least):
    out = set()
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    for i in range(len(ids)):
        c = [j for j in range(len(ids)) if j != i and s[i, j] >= least]
        for j in sorted(c, key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(n, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, dim))
    return centres[r.integers(0, len(centres), n)] + 0.25 * r.normal(size=(n, dim))


def test_factor_one_is_exact_and_larger_ones_lose_little():
    m = clustered(1500)
    ids = np.arange(1500) * 3
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    want = brute_pairs(ids, m, 5, 0.8)
    for factor, recall in ((1.0, 1.0), (3.0, 0.95)):
        a, b, _ = V.search(u, ids, u, ids, 5, 0.8, factor, leaf=32)
        got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert len(got & want) >= recall * len(want)


def test_recall_of_the_default_factor():
    m = clustered(3000, dim=64, seed=4)
    ids = np.arange(3000)
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    for least, recall in ((0.8, 0.97), (-1.0, 0.9)):
        a, b, _ = V.search(u, ids, u, ids, 5, least, V.FACTOR)
        got = set(zip(a.tolist(), b.tolist()))
        s = u.astype(float) @ u.T.astype(float) - 9 * np.eye(3000)
        want = {(i, int(j)) for i in ids for j in np.argsort(-s[i])[:5] if s[i, j] >= least}
        assert len(got & want) >= recall * len(want), (least, len(got & want) / len(want))


def test_pairs_over_shards_with_equal_and_bad_vectors(spark):
    m = clustered(400)
    m[::3] = m[0]  # a third of all rows is one vector
    rows = [(k, [float(x) for x in v], "clash") for k, v in enumerate(m)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [1.0] * 8, "x"), (903, [float("nan")] * 16, "x"), (None, [1.0] * 16, "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, id string")
    got = {(r["vec_a"], r["vec_b"]) for r in V.similar_pairs(df, "vec_id", "v", 16, 5, 0.8, factor=1.0).collect()}
    want = brute_pairs(np.arange(400), np.array([r[1] for r in rows[:400]], np.float32).astype(float), 5, 0.8)
    assert got == want
    assert V.similar_pairs(df.limit(0), "vec_id", "v", 16).count() == 0


def test_nearest_in_many_shards(spark):
    m = clustered(600)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "id long, v array<float>")
    u = V.unit_vectors(df, "id", "v", 16)
    got = {(r["query"], r["neighbour"]) for r in V.nearest(u, 16, 3, factor=1.0, queries=u.where("id % 20 = 0"), shard=80).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n @ n.T - 9 * np.eye(600)
    want = {(i, int(j)) for i in range(0, 600, 20) for j in np.argsort(-s[i])[:3]}
    assert len(got & want) >= 0.99 * len(want)


def families(n, dim=128, seed=6):
    """Families of about 6 of cosines from 0.7, far from one another; ids in no order."""
    r = np.random.default_rng(seed)
    m = r.normal(size=(max(1, n // 6), dim))[r.integers(0, max(1, n // 6), n)] + r.uniform(0.1, 0.6, (n, 1)) * r.normal(size=(n, dim))
    return r.permutation(n) * 7, m.astype(np.float32)


def test_shared_pivots_and_sketches_lose_few_pairs_whatever_the_dimension():
    r = np.random.default_rng(2)
    for dim, turns in ((16, 1), (128, 1), (300, 1), (128, 2)):
        x, z = r.normal(size=(2, 3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.8 * x + 0.6 * z / np.linalg.norm(z, axis=1, keepdims=True)
        p = A.Pivots(dim, turns)
        a, b = (p.codes(v.astype(np.float32)) for v in (x, y))
        assert np.mean([len(np.intersect1d(i, j)) > 0 for i, j in zip(a, b)]) >= 0.997
        sk = [p.sketches(v.astype(np.float32)) for v in (x, y)]
        assert (np.bitwise_count(sk[0] ^ sk[1]).sum(1) <= A.most_apart(0.8)).mean() >= 0.999


def test_pairs_by_shared_pivots(spark):
    ids, m = families(2000)
    m[::5] = m[0]  # a fifth is one vector
    rows = [(int(k), [float(x) for x in v], "clash") for k, v in zip(ids, m)] + [(90001, None, "x"), (90002, [0.0] * 128, "x"), (90003, [float("nan")] * 128, "x"), (None, [1.0] * 128, "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, id string")
    got = [(r["vec_a"], r["vec_b"]) for r in V.similar_pairs(df, "vec_id", "v", 128, small=100).collect()]
    want = brute_pairs(ids, m.astype(float), 5, 0.8)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.999 * len(want)


def test_verified_pairs_in_rounds_and_parted_cells(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_VECTORS", 50)
    ids, m = families(600, seed=8)
    df = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(ids, m)], "id long, v array<float>")
    marked = A.marks(df, "id", "v", 128)
    found = A.candidates(marked, 0.8, 1, np.full(256, 600), cell_rows=200)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    hub = spark.createDataFrame([(int(min(ids)), int(x), True) for x in sorted(ids)[1:]], "a long, b long, near boolean")
    parted = A.placed(hub, 600, cell_pairs=100)
    assert sorted((r["a"], r["b"]) for r in parted.collect()) == sorted((r["a"], r["b"]) for r in hub.collect())
    near = [A.verified(found, df, "id", "v", 128, 5, 0.8, 600, at_once=k).collect() for k in (70, 10_000)]
    assert sorted(near[0]) == sorted(near[1])
    assert {(min(r[0], r[1]), max(r[0], r[1])) for r in near[0]} >= {p for p in brute_pairs(ids, m.astype(float), 5, 0.8) if p in set(pairs)}


def test_what_a_vector_of_the_join_sends_does_not_grow_with_the_table(spark):
    sent = []
    for n in (700, 5600):
        ids, m = families(n, seed=3)
        df = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(ids, m)], "id long, v array<float>")
        found = A.candidates(A.marks(df, "id", "v", 128), 0.8, 1, np.full(256, n))
        at = A.placed(found, n).cache()
        sent.append(at.select("cell", F.explode(F.array("a", "b"))).distinct().count() / n)
    assert sent[1] <= 1.3 and sent[1] <= 1.15 * sent[0], sent


def test_crowded_tables_are_searched_by_trees():
    r = np.random.default_rng(4)
    p, x = A.Pivots(128), (r.normal(size=(3000, 128)) * 0.05 + r.normal(size=128)).astype(np.float32)
    some = pd.DataFrame({"sketch": [v.tobytes() for v in p.sketches(x)], "codes": [v.tobytes() for v in p.codes(x).astype(np.uint16)]})
    crowd, work, rows = A.foretold(some, 100_000, 0.8, 1)
    assert crowd > A.CROWD and work > 25_000 and rows.max() > 50_000


def sh(t):
    w = re.findall("[a-z0-9]+", t.lower())
    return frozenset(zip(w, w[1:], w[2:]))


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocab) for _ in range(60)] for _ in range(60)]
    out = []
    for b in base:
        for e in (0, 1, 3, 6, 10):
            t = list(b)
            for _ in range(e):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t))
    return out + [out[0]] * 90 + ["", "two words", None, "w1 w2 w3", "W1, w2! w3"]


def test_near_duplicates_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "ord long, t string, rep string")
    members, links = N.near_duplicates(df, "ord", F.col("t"), 0.6, 3)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in links.collect()}
    s = {k: sh(t) for k, t in enumerate(texts) if t and sh(t)}
    assert set(rep) == set(s) and all(s[k] == s[v] for k, v in rep.items())
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and jac(s[a], s[b]) >= 0.6}
    assert got <= want and len(got) >= 0.99 * len(want)
    pairs = {(r["ord_a"], r["ord_b"]) for r in N._pairs(members, links).collect()}
    assert all(a < b and jac(s[a], s[b]) >= 0.6 for a, b in pairs)
    assert N._pairs(members, links).count() == len(pairs)
    true = {(a, b) for a in s for b in s if a < b and jac(s[a], s[b]) >= 0.6}
    assert pairs <= true and {(rep[a], rep[b]) for a, b in true - pairs} <= {p for x in want - got for p in (x, x[::-1])}
    assert N.near_duplicates(df.limit(0), "ord", F.col("t"))[1].count() == 0


def test_large_buckets_are_split_and_compared_in_full(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(80)]
    rows = []
    for k in range(120):  # one family of which all are alike
        t = list(base)
        t[k % 80] = f"x{k}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "ord long, t string")
    for depth in (1, 2, 3):
        _, links = N.near_duplicates(df, "ord", F.col("t"), 0.6, 3, runs=8, bucket=20, max_depth=depth)
        assert links.count() == links.select("a", "b").distinct().count() >= 0.99 * 120 * 119 / 2


def test_buckets_over_frames():
    r = np.random.default_rng(3)
    path = np.sort(r.integers(0, 40, 900))
    path = np.sort(np.append(path, [7] * 300))
    sk = r.integers(-(2**62), 2**62, (len(path), 2))
    sk[r.integers(0, len(path), 500)] = sk[0]
    f = pd.DataFrame({"path": path, "id": np.arange(len(path)), "s1": sk[:, 0], "s2": sk[:, 1]})
    want = set()
    for p, g in f.groupby("path"):
        if len(g) <= 60:
            x = g[["id", "s1", "s2"]].to_numpy()
            want |= {(int(a[0]), int(b[0])) for i, a in enumerate(x) for b in x[i + 1 :] if (a[1:] == b[1:]).all()}
    for size in (1, 7, 50, 2000):
        out = pd.concat([x for x in N._buckets((f[k : k + size] for k in range(0, len(f), size)), 128, 60) if len(x)])
        pairs, large = out[out["b"].notna()], out[out["b"].isna()]
        assert {(int(a), int(b)) for a, b in zip(pairs["a"], pairs["b"])} == want and len(pairs) == len(want)
        assert sorted(zip(large["path"].astype(int), large["a"].astype(int))) == [(p, i) for p, i in zip(f["path"], f["id"]) if (path == p).sum() > 60]


def test_a_class_of_500_copies(spark):
    rows = [(k, "one two three four five six", "clash", None if k % 5 else "k") for k in range(500)] + [(600, "one two three four five six seven", "x", "k"), (601, "quite another text of this kind", "x", "k")]
    df = spark.createDataFrame(rows, "ord long, t string, n string, class string")
    members, links = N.near_duplicates(df, "ord", F.col("t"), 0.6, 3)
    assert {tuple(r) for r in links.select("a", "b").collect()} == {(0, 600)}
    assert members.where("rep = 0 AND copies = 500").count() == 500 and members.count() == 502
    pairs = N._pairs(members, links)
    assert pairs.count() == pairs.distinct().count() == 500 * 499 // 2 + 500
    split = df.select(F.col("ord").alias("id"), F.col("class").alias("key"), F.col("t").alias("text"), F.when(F.col("ord") % 2 == 0, "train").otherwise("val").alias("split"))
    got = C.overlaps(split).where("how = 'text'")
    assert got.count() == got.distinct().count() == 250 * 251


def test_cross_split_equals_brute_force(spark, texts):
    r = random.Random(7)
    rows = [(k, r.choice(["A/1", "b/2", "c/3", None, f"u/{k}"]), t, r.choice(["train", "train", "val", "test", None, "other"])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, key string, text string, split string").withColumn("class", F.lit(1)).withColumn("a", F.lit("clash"))
    got = {(x["eval_id"], x["train_id"], x["how"]) for x in C.overlaps(df).collect()}
    tr, ev = [x for x in rows if x[3] == "train"], [x for x in rows if x[3] in ("val", "test")]
    want = {(e[0], t[0], "key") for e in ev for t in tr if e[1] and e[1] == t[1]}
    want |= {(e[0], t[0], "text") for e in ev for t in tr if e[2] and t[2] and sh(e[2]) and jac(sh(e[2]), sh(t[2])) >= 0.6}
    assert got == want
    assert C.overlaps(df.limit(0)).count() == 0


def test_a_hot_key_gives_all_pairs_of_different_texts(spark):
    rows = [(k, "hot", f"a{k} b{k} c{k} d{k}" if k % 7 else None, "train" if k % 2 else "val") for k in range(142)]
    rows += [(1000 + k, "copies", "one two three four", "train" if k % 2 else "test") for k in range(140)] + [(2000, "copies", "x y z", "test")]
    df = spark.createDataFrame(rows, "id long, key string, text string, split string").withColumn("class", F.lit("clash")).withColumn("salts", F.lit("clash"))
    got = {(x["eval_id"], x["train_id"]) for x in C.overlaps(df).where("how = 'key'").collect()}
    hot = {(x, y) for x, y in got if x < 1000}
    assert hot == {(e, t) for e in range(0, 142, 2) for t in range(1, 142, 2)} and len(hot) > 4096
    copies = got - hot
    assert copies == {(e, t) for e in [1000 + k for k in range(0, 140, 2)] + [2000] for t in range(1001, 1140, 2)}
    small = spark.createDataFrame([("k", k, "eval" if k < 30 else "train") for k in range(70)], "key string, class long, side string")
    assert {tuple(x) for x in C.same_key(small, cell=100).collect()} == {(a, b) for a in range(30) for b in range(30, 70)}


def test_chance_likenesses_do_not_part_families(spark):
    near = [(f + i, f + j, True) for f in range(1000, 3000, 10) for i in range(6) for j in range(i + 1, 6)]
    chance = [(k, f + k % 6, False) for k, f in enumerate(range(1000, 3000, 10))]
    at = A.placed(spark.createDataFrame(near + chance, "a long, b long, near boolean"), 40 * A.CELL_VECTORS).cache()
    assert at.count() == len(near) + len(chance)
    assert at.select("cell", F.explode(F.array("a", "b"))).distinct().count() <= 1200 + 2 * len(chance)
