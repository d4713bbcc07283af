"""What each of several filters removes in every order, by decision diagrams.

Each document fails a set of filters, its mask.  Masks are counted per part in one
aggregate, at most 2^filters rows a part however many documents there are.  Of a
part's counts a decision diagram is built, one level a filter; a node's weight is
the number of documents whose path leads through it.  Swapping two adjacent levels
rewrites only the nodes of these two; orders follow one another by single swaps,
and in each the path on which every filter passes tells all steps of that order:
what a filter removes is the weight of the branch where it fails.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, only, read

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
#: Documents are weighed by these counts together.
WEIGHTS = ("docs", "good", "toxic")
_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """Weights of sets of failed filters as a decision diagram without skipped levels.

    A node is a number; ``low`` is its child where the level's filter passes,
    ``high`` where it fails.  Node 0 stands for no document at all, on every
    level; equal nodes of a level are one.
    """

    def __init__(self, filters: str, counts: dict[frozenset[str], np.ndarray], width: int):
        self.order, nothing = list(filters), np.zeros(width, np.int64)
        self.low, self.high, self.weight = [0], [0], [nothing]
        self.unique: list[dict[tuple, int]] = [{} for _ in range(len(filters) + 1)]
        below = {mask: self._leaf(n) for mask, n in counts.items()}
        for level in reversed(range(len(filters))):
            halves: dict[frozenset[str], list[int]] = {}
            for mask, node in below.items():
                halves.setdefault(mask - {filters[level]}, [0, 0])[filters[level] in mask] = node
            below = {mask: self._node(level, *children) for mask, children in halves.items()}
        self.root = below.get(frozenset(), 0)

    def _new(self, level: int, key: tuple, low: int, high: int, weight: np.ndarray) -> int:
        node = self.unique[level].get(key)
        if node is None:
            node = self.unique[level][key] = len(self.low)
            self.low.append(low), self.high.append(high), self.weight.append(weight)
        return node

    def _leaf(self, n: np.ndarray) -> int:
        return self._new(len(self.order), tuple(n.tolist()), 0, 0, n) if n.any() else 0

    def _node(self, level: int, low: int, high: int) -> int:
        return self._new(level, (low, high), low, high, self.weight[low] + self.weight[high]) if low or high else 0

    def swap(self, level: int) -> None:
        """Exchange a level with the next: its nodes keep their numbers and weights, so nothing above or below changes."""
        nodes, self.unique[level], self.unique[level + 1] = list(self.unique[level].values()), {}, {}
        for node in nodes:
            low, high = self.low[node], self.high[node]
            passes = self._node(level + 1, self.low[low], self.low[high])
            fails = self._node(level + 1, self.high[low], self.high[high])
            self.low[node], self.high[node] = passes, fails
            self.unique[level][passes, fails] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(filter, weight removed, weight kept) of each step of the present order: the path on which all pass."""
        node, out = self.root, []
        for name in self.order:
            out.append((name, self.weight[self.high[node]], self.weight[self.low[node]]))
            node = self.low[node]
        return out


def orders_by_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after another, so that n filters come in every order once (each item moves through the others in turn)."""
    if n < 2:
        return
    inner = orders_by_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        # The last item stands at one end now; the others stand behind or before it.
        yield swap + 1 if down else swap
        down = not down


def audit(filters: str, counts: dict[frozenset[str], np.ndarray]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps of one part."""
    diagram = Diagram(filters, counts, len(WEIGHTS))
    found = {}

    def note() -> None:
        found["".join(diagram.order)] = diagram.steps()

    note()
    for level in orders_by_swaps(len(filters)):
        diagram.swap(level)
        note()
    fails, alone, total = {}, {}, dict.fromkeys(filters, 0)
    for steps in found.values():
        for name, removed, _ in steps:
            total[name] += int(removed[0])
        fails[steps[0][0]], alone[steps[-1][0]] = int(steps[0][1][0]), int(steps[-1][1][0])
    return [
        (order, k, int(kept[0]), int(gone[0]), fails[name] - int(gone[0]), alone[name], int(gone[1]), int(gone[2]), total[name])
        for order, steps in sorted(found.items())
        for k, (name, gone, kept) in enumerate(steps, 1)
    ]


def _audit_part(filters: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = lambda mask: frozenset(f for i, f in enumerate(filters) if mask >> i & 1)
        counts = {names(int(m)): np.array(w, np.int64) for m, *w in rows[["mask", *WEIGHTS]].itertuples(index=False)}
        out = pd.DataFrame(audit(filters, counts), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        out.insert(0, "part", key[0])
        return out

    return run


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null; each fits any text, long or empty."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_UPPER_PERCENT * F.char_length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows (part, mask, docs, good, toxic): documents of a part that fail exactly the filters of a mask (bit 0 is A).

    Texts stay in the scan; rows of ids, digests and masks are what moves.  The
    smallest doc_id of each digest is one partial aggregate; it meets the rows
    by digest and id together, so no group of equal texts, however large, lands
    in one task.
    """
    d = only(docs, doc_id="doc_id", text="text", part="lang")
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")).values())]
    d = d.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), text.alias("text"))
    narrow = scratch.keep(d.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), sum(bits[1:], bits[0]).cast("int").alias("mask")), "masks")
    first = scratch.keep(narrow.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True)), "first")
    known = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    known = scratch.keep(known.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    rows = narrow.join(first, ["sha", "doc_id"], "left").join(known, "doc_id", "left")
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull() & F.col("sha").isNotNull(), 1 << 4).otherwise(0)
    rows = rows.select("part", (F.col("mask") + again).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    out = scratch.keep(rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "counts")
    scratch.drop(narrow, first, known)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """120 orders x 5 steps per part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters on whole texts (null: empty), by failure: A fewer than 200 words; B
    fewer than half of the words distinct; C more than 3 % capitals A-Z; D a sign
    of ``#$%&*|``; E the text of a document with a smaller doc_id in any part.
    A row without doc_id neither fails E nor makes others fail it; rows that
    repeat id and text are counted each and don't fail E by each other.  Labels
    of an id that come more than once are good (toxic) if one of them is; null
    labels and labels without document count for nothing.  A null lang is the part
    of the empty string.  An empty table gives an empty result.  Columns of other
    names, whatever they are, stay behind.
    """
    counts = masks(docs, labels, Scratch(docs.sparkSession, "filter-audit"))
    return counts.groupBy("part").applyInPandas(_audit_part(FILTERS), _AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"
_PERMUTED = " CROSS JOIN ".join(f"{_LETTERS} l{i}" for i in range(1, 6))
_DIFFERENT = " AND ".join(f"l{i}.f <> l{j}.f" for i, j in itertools.combinations(range(1, 6), 2))

OP13_SQL = rf"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), known AS (
    SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1
), marked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
    FROM words LEFT JOIN known USING (doc_id)
), counts AS (
    SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY 1, 2
), orders AS (
    SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order FROM {_PERMUTED} WHERE {_DIFFERENT}
), steps AS (
    SELECT filter_order, step, substr(filter_order, step::int, 1) AS f, substr(filter_order, 1, step::int - 1) AS earlier
    FROM orders CROSS JOIN range(1, 6) r(step)
), judged AS (
    SELECT s.*, c.*, contains(failed, f) AS fails, length(translate(failed, earlier, '')) < length(failed) AS before
    FROM steps s CROSS JOIN counts c
), summed AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT fails AND NOT before THEN docs ELSE 0 END) AS kept,
           sum(CASE WHEN fails AND NOT before THEN docs ELSE 0 END) AS removed,
           sum(CASE WHEN fails AND before THEN docs ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = f THEN docs ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
       unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM summed
"""
