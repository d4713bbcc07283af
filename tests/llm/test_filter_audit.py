import itertools
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scorewright.llm import filter_audit as op

ORDERS = ["".join(p) for p in itertools.permutations("ABCDE")]


def failed(docs):
    """Failed filters of each document (doc_id, text, lang)."""
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = []
    for d, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {f for f, x in (
                ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
                ("D", re.search("[#$%&*|]", text) is not None), ("E", d is not None and d > least[text]),
            ) if x}
        )
    return out


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    masks, out = failed(docs), {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(d, m) for (d, _, lang), m in zip(docs, masks) if (lang or "") == part]
        total, rows = dict.fromkeys("ABCDE", 0), {}
        for order in ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows[part, order, step] = [len(left), len(gone), sum(f in m for _, m in mine) - len(gone), sum(m == {f} for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        out |= {(p, order, step): (*v, total[order[step - 1]]) for (p, order, step), v in rows.items()}
    return out


def sample(seed=2, n=300):
    rnd = random.Random(seed)
    some = ["", None, "A b", "# x", " ".join(f"w{i}" for i in range(250)), "same " * 250, "UPPER " + " ".join(f"v{i}" for i in range(220)), "LOUD " * 300 + "$", "wörd " * 199 + "éé😀", "x" * 50_000, "w " * 40_000]
    docs = [(rnd.choice([*range(n), None]), rnd.choice([*some, f"unique {i} " * 20, " ".join(f"u{i}_{k}" for k in range(210))]), rnd.choice(["en", "de", None, ""])) for i in range(n)]
    docs += docs[:4]
    labels = [(rnd.choice([*range(n), None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


def rows_of(rows):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}


def test_orders_by_swaps():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for at in op.orders_by_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_diagram_after_every_swap():
    rnd = random.Random(4)
    for some in (0, 1, 5, 32):
        counts = {frozenset(f for f in "ABCDE" if rnd.random() < 0.4): np.array([rnd.randint(0, 3), rnd.randint(0, 2)]) for _ in range(some)}
        d = op.Diagram("ABCDE", counts, 2)
        for at in [0, 3, 1, 1, 2, 0, 3, 2, 1, 0]:
            d.swap(at)
            left = counts
            for name, gone, kept in d.steps():
                out = {m: n for m, n in left.items() if name in m}
                left = {m: n for m, n in left.items() if name not in m}
                assert gone.tolist() == sum(out.values(), np.zeros(2, int)).tolist() and kept.tolist() == sum(left.values(), np.zeros(2, int)).tolist()


def test_table(spark):
    docs, labels = sample()
    d = spark.createDataFrame([(*x, "m", 1) for x in docs], "doc_id long, text string, lang string, mask string, good int").withColumn("part", F.lit("clash")).withColumn("sha", F.lit(0)).repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    assert rows_of(op.filter_audit(d, marks).collect()) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = sample(n=30)
    d, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert op.filter_audit(d.limit(0), marks).count() == 0
    assert rows_of(op.filter_audit(d, marks.limit(0)).collect()) == brute(docs, [])


def test_against_sql():
    docs, labels = sample(8, 120)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar); create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    found = con.execute(op.OP13_SQL)
    names = [c[0] for c in found.description]
    assert rows_of(dict(zip(names, r)) for r in found.fetchall()) == brute(docs, labels)
