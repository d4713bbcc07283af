import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import common, minhash, shingles


def brute_sets(docs):
    out = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(docs, percent):
    sets = brute_sets(docs)
    best = list(range(len(docs)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = docs[i][0] is not None and docs[i][0] == docs[j][0]
            if same or sets[i] and sets[j] and None not in (docs[i][0], docs[j][0]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                best[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    bases = [[r.choice(words) for _ in range(r.choice([3, 8, 60, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, r.choice([" ", "\n", " \t"]).join(w).upper() if i % 3 else " ".join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "x " * 60000), (None, "one two"), (3, docs[3][1])]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("tile, screen, pack, misses", [(512, 8192, 256, 1000), (7, 20, 5, 1), (2, 8192, 5, 1)])
def test_against_all_pairs(spark, monkeypatch, percent, tile, screen, pack, misses):
    monkeypatch.setattr(minhash, "TILE_DOCS", tile)
    monkeypatch.setattr(minhash, "SCREEN_DOCS", screen)
    monkeypatch.setattr(minhash, "PACK_DOCS", pack)
    monkeypatch.setattr(shingles, "MOST_MISSES", misses)
    docs = corpus(percent)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("rep", F.lit(0))
    rows = minhash.near_dedup(df, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute(docs, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)


def chained(n, seed):
    """Texts of which each is near its neighbours only, and much of the same words elsewhere."""
    r = random.Random(seed)
    w = [f"w{r.randrange(100000)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(w)
        w[r.randrange(len(w))] = f"v{i}"
        out.append((i * 7 % (n + 1) if (n + 1) % 7 else i, " ".join(w)))
    return out


def kept_counts(monkeypatch):
    """Rows of every table that operators write, by name."""
    seen, keep = {}, common.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    return seen


def templated(n, seed, common_words=460, own=30):
    """Pages of one template that all resemble each other at some 78 %, and none at 85 %."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(common_words)]
    return [(i, " ".join(template + [f"p{i}x{j}" for j in range(own + r.randrange(3))])) for i in range(n)]


@pytest.mark.parametrize("linked", [False, True])
def test_pages_of_a_template_do_not_meet(spark, monkeypatch, linked):
    monkeypatch.setattr(minhash, "TILE_DOCS", 64)
    seen = kept_counts(monkeypatch)
    docs = templated(400, 8, 250, 30)
    sets = brute_sets(docs[:2])
    assert 0.7 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    if linked:
        docs += [(1000 + i, docs[i][1] + " more") for i in range(7, 400, 40)] + [(2000, docs[5][1].replace("t100 ", ""))]
    rows = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute(docs, 85)
    assert seen["wide"][0] >= 300  # they do share buckets of several blocks
    # Only pages with a near copy meet another on a rare shingle.
    assert seen["left"][0] <= (400 if linked else 0)


def test_linked_sets_meet_on_rare_shingles():
    r = random.Random(5)
    for percent in (80, 85, 100):
        for _ in range(400):
            n = r.randrange(1, 60)
            x = set(r.sample(range(80), n))
            y = (x - set(r.sample(sorted(x), r.randrange(0, n // 4 + 1)))) | set(r.sample(range(80), r.randrange(0, 8)))
            if not y or not shingles.similar(len(x), len(y), len(x & y), percent):
                continue
            small, large = sorted((x, y), key=len)
            rank = {v: k for k, v in enumerate(r.sample(range(80), 80))}
            a = sorted(small, key=rank.get)[: minhash.rare_lengths(len(small), percent)[0]]
            b = sorted(large, key=rank.get)[: minhash.rare_lengths(len(large), percent)[1]]
            assert set(a) & set(b)
    assert minhash.rare_lengths(1, 85) == (1, 1) and minhash.rare_lengths(100, 85) == (9, 16)


@pytest.mark.parametrize("tile, screen", [(512, 8192), (16, 8192), (16, 40)])
def test_one_group_over_many_blocks(spark, monkeypatch, tile, screen):
    monkeypatch.setattr(minhash, "TILE_DOCS", tile)
    monkeypatch.setattr(minhash, "SCREEN_DOCS", screen)
    monkeypatch.setattr(minhash, "PACK_DOCS", 20)
    docs = chained(260, 3)
    rows = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), percent=85).collect()
    want = brute(docs, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == want
    assert len({c for _, _, c in want}) == 1


def test_agreement_in_columns_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 2**32, (20, minhash.MINIMA), dtype=np.uint64).astype(np.uint32)
    m[10:] = np.where(rng.random((10, minhash.MINIMA)) < 0.7, m[:10], m[10:])
    packed = [np.frombuffer(minhash.pack(x), np.int64) for x in m]
    df = spark.createDataFrame([(i, j, packed[i].tolist(), packed[j].tolist()) for i in range(20) for j in range(20)], "i int, j int, a array<long>, b array<long>")
    got = {(r.i, r.j): r.n for r in df.select("i", "j", minhash.agreeing(F.col("a"), F.col("b")).alias("n")).collect()}
    low = m & 15
    assert all(got[i, j] == (low[i] == low[j]).sum() for i, j in got)
    words = np.stack(packed).view(np.uint64)
    assert (minhash.agreement(words, words) == (low[:, None] == low[None]).sum(2)).all()


def test_scratch_goes_with_its_scope(spark):
    with common.scratch_scope():
        n = minhash.near_dedup(spark.createDataFrame(corpus(3)[:40], "doc_id long, text string")).count()
        roots = [s.root for s in common._scopes.get()[-1]]
        assert n == 40 and roots and all(os.path.isdir(r.removeprefix("file:")) for r in roots)
    assert not any(os.path.exists(r.removeprefix("file:")) for r in roots)


def test_sums_before(spark):
    r = random.Random(2)
    rows = [(p, at, r.randrange(50)) for p in (None, "a", "b") for at in r.sample(range(300), 120)]
    df = spark.createDataFrame([x for x in rows if x[0]], "p string, at long, v long")
    got = {(x.p, x.at): x.s for x in common.sum_before(df, ["p"], "at", "v", "s", span=16).collect()}
    assert got == {(p, at): sum(v for q, b, v in rows if q == p and b < at) for p, at, _ in rows if p}


def test_empty(spark):
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_dense_and_sparse_agree(monkeypatch):
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    left = [np.sort(rng.choice(base, rng.integers(200, 400), replace=False)) for _ in range(90)]
    right = [np.sort(rng.choice(base, rng.integers(200, 400), replace=False)) for _ in range(70)]
    got = shingles.links(left, right, np.ones((90, 70), bool), 60)
    want = np.array([[shingles.similar(len(a), len(b), len(np.intersect1d(a, b)), 60) for b in right] for a in left])
    assert (got == want).all() and want.any() and not want.all()


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    for density in (0.0, 0.005, 0.02, 0.5):
        m = rng.random((60, 80)) < density
        r, c = shingles.forest(m)
        assert m[r, c].all() and len(r) <= 140

        def groups(pairs):
            label = list(range(140))
            for _ in range(140):
                for i, j in pairs:
                    label[i] = label[80 - 20 + j] = min(label[i], label[60 + j])
            return label

        assert groups(np.argwhere(m).tolist()) == groups(list(zip(r.tolist(), c.tolist())))


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2700]), np.unique(pool[300:])
    sig = lambda s: np.frombuffer(minhash.pack(minhash.minima(s)), np.uint64)[None]
    agree = minhash.agreement(sig(a), sig(b))[0, 0]
    assert abs(minhash.estimate(agree) - 2400 / 3000) < 0.15
    assert minhash.agreement(sig(a), sig(a))[0, 0] == minhash.MINIMA


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    out = common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()
    got = {r.node: r.component for r in out}
    assert len(out) == len(got) == 251
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))


def test_stage_keeps_one_of_each_group(spark):
    docs = corpus(9)[:100]
    df = spark.createDataFrame([(*d, "en", d[0]) for d in docs], "doc_id long, text string, lang string, dropped long").withColumns({"key": F.lit(1), "record": F.lit("r"), "_dropped_id": F.lit(2)})
    out = minhash.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and out.exceptAll(df).count() == 0
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute(docs, 80)})
