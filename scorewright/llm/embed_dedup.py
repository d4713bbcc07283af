"""Near-duplicate embeddings by int8 quantised tile products with error bounds.

Every vector is scaled to length 1 and rounded to int8 with a scale of its own;
the length of what rounding took away bounds how far a quantised product can be
from the true cosine.  Tiles of quantised products are exact integer arithmetic
(in float32 matrices).  Only pairs whose product plus bound reaches the threshold
are computed again, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, components, only, only_cache, read
from .shingles import forest

#: Vectors a block: a 64th of all, but not fewer or more than these, so that there are tiles enough and no vector is copied more often than it must.
LEAST_BLOCK, MOST_BLOCK = 4096, 65536
#: A tile is compared by strips of its rows and chunks of its columns: what is held at once does not grow with the block.
STRIP, CHUNK = 512, 4096
#: Products of so many int8 pairs stay below 2**24, so float32 sums of them are exact.
EXACT_DIMS = 1024
#: Computed again at once, in matrix form, from this share of uncertain pairs on.
DENSE = 0.02


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, int8 values, scales, error bounds) of nonzero rows in double precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - q * s[:, None]) ** 2).sum(1)) + 1e-12
    return u, q.astype(np.int8), s, e


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as floats."""
    if q.shape[1] <= EXACT_DIMS:
        return q.astype(np.float32, copy=False) @ p.astype(np.float32, copy=False).T
    return sum(products(q[:, k : k + EXACT_DIMS], p[:, k : k + EXACT_DIMS]).astype(np.float64) for k in range(0, q.shape[1], EXACT_DIMS))


def decided(left, right, threshold: float):
    """Yield (first row, linked, open) by strips of ``left``: pairs surely at the threshold, and pairs that int8 leaves open.

    With u = s q + r and |r| <= e for both sides, the cosine u.v differs from
    s_u s_v q_u.q_v by at most e_u + (1 + e_u) e_v.
    """
    (q, s, e), (p, t, d) = left, right
    p = p.astype(np.float32)
    for at in range(0, len(q), STRIP):
        i = slice(at, at + STRIP)
        near = products(q[i], p) * s[i][:, None] * t
        bound = e[i][:, None] + (1 + e[i])[:, None] * d + 1e-9
        linked = near - bound >= threshold
        yield at, linked, (near + bound >= threshold) & ~linked


def exact(u: np.ndarray, v: np.ndarray, open_pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the open pairs of unit vectors have cosine >= threshold in double precision."""
    if open_pairs.mean() > DENSE:
        return (u @ v.T >= threshold) & open_pairs
    out = np.zeros(open_pairs.shape, bool)
    r, c = np.nonzero(open_pairs)
    for k in range(0, len(r), 1 << 16):
        a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
        out[a, b] = np.einsum("ij,ij->i", u[a], v[b]) >= threshold
    return out


QUANTISED = "rep long, copies long, dims int, q binary, scale double, bound double"
#: kind 0: links of a; 1: a is linked with b; 2: a has open pairs in this tile.
FOUND = "kind int, dims int, low long, high long, a long, b long, n long"
_FOUND = pa.schema([("kind", pa.int32()), ("dims", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _quantise(batches):
    only_cache()
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dims in set(table.column("dims").to_pylist()):
            part = table.filter(pa.array(table.column("dims").to_numpy() == dims))
            _, q, s, e = quantise(_doubles(part))
            raw = [row.tobytes() for row in q]
            yield pa.RecordBatch.from_pydict({"rep": part.column("rep").combine_chunks(), "copies": part.column("copies").combine_chunks(), "dims": part.column("dims").combine_chunks(), "q": pa.array(raw, pa.binary()), "scale": pa.array(s), "bound": pa.array(e)})


def _doubles(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)


class _Union:
    """Components of a tile's rows and columns, as links come in strip by strip."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite the ends of links; which of them had not been in one component."""
        while True:
            flat = self.root[self.root]
            if np.array_equal(flat, self.root):
                break
            self.root = flat
        apart = np.flatnonzero(self.root[a] != self.root[b])
        fresh = np.zeros(len(a), bool)
        for k in apart.tolist():
            x, y = self._find(int(a[k])), self._find(int(b[k]))
            if x != y:
                self.root[max(x, y)] = min(x, y)
                fresh[k] = True
        return fresh


class _Side:
    """One block's vectors, of which a slice is decoded when it is its turn."""

    def __init__(self, table: pa.Table):
        self.ids, self.weights = table.column("rep").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        self.table, self.whole = table, "embedding" in table.column_names
        if not self.whole:
            self.codes = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(table), -1), table.column("scale").to_numpy(), table.column("bound").to_numpy()
            self.table = None

    def part(self, at: int, size: int) -> tuple[np.ndarray | None, tuple]:
        """(unit vectors or None, int8 values with scales and bounds) of rows from ``at`` on."""
        if not self.whole:
            return None, tuple(x[at : at + size] for x in self.codes)
        u, *code = quantise(_doubles(self.table.slice(at, size)))
        return u, tuple(code)


def _tile(threshold: float):
    """One tile: int8 products first; with vectors at hand (column embedding), only the pairs that int8 leaves open, exactly."""

    def compare(table: pa.Table) -> pa.Table:
        dims, low, high = (table.column(c)[0].as_py() for c in ("dims", "low", "high"))
        block = table.column("block").to_numpy()
        left = _Side(table.filter(pa.array(block == low)))
        right = left if low == high else _Side(table.filter(pa.array(block == high)))
        rows, cols, second = len(left.ids), len(right.ids), left.whole
        if not rows or not cols:
            return _FOUND.empty_table()
        count, unsure = [np.zeros(rows), np.zeros(cols)], [np.zeros(rows, bool), np.zeros(cols, bool)]
        union, links = _Union(rows if low == high else rows + cols), []
        shift = 0 if low == high else rows
        for c in range(0, cols, CHUNK):
            v, right_code = right.part(c, CHUNK)
            for r in range(0, rows, STRIP):
                u, left_code = left.part(r, STRIP)
                for _, sure, maybe in decided(left_code, right_code, threshold):
                    if low == high:
                        k = np.arange(len(sure)) + r - c
                        own = np.flatnonzero((k >= 0) & (k < sure.shape[1]))
                        sure[own, k[own]] = maybe[own, k[own]] = False
                    here = exact(u, v, maybe, threshold) if second else sure
                    i, j = slice(r, r + len(here)), slice(c, c + here.shape[1])
                    if here.any():
                        count[0][i] += here @ right.weights[j]
                        count[1][j] += left.weights[i] @ here
                        a, b = forest(here)
                        fresh = union.add(a + r, b + c + shift)
                        links.append((left.ids[a[fresh] + r], right.ids[b[fresh] + c]))
                    if not second:
                        unsure[0][i] |= maybe.any(1)
                        unsure[1][j] |= maybe.any(0)
        out = {k: [] for k in _FOUND.names}

        def add(kind, a, b=None, n=None):
            none = np.zeros(len(a), np.int64)
            for k, v in zip(_FOUND.names, (none + kind, none + dims, none + low, none + high, a, none if b is None else b, none if n is None else n.astype(np.int64))):
                out[k].append(v)

        for k, side in enumerate((left,) if low == high else (left, right)):
            hit = np.flatnonzero(count[k])
            add(0, side.ids[hit], n=count[k][hit])
            add(2, side.ids[unsure[k]])
        for a, b in links:
            add(1, a, b)
        return pa.table({k: np.concatenate(v).astype(np.int32 if k in ("kind", "dims") else np.int64) for k, v in out.items()}, schema=_FOUND)

    return compare


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are linked when their cosine in double precision is at least
    ``threshold``.  n_links counts the other rows linked directly; component_id
    is the smallest id reachable by links, kept marks it.  A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, as do
    vectors of different lengths.  A row without id links with nothing and is
    kept.  Rows that share an id are one node of the component.  An empty table
    gives an empty result; other columns, clashing names too, stay behind.

    Identical vectors become one class, counted by its copies, before anything is
    compared, so a group of copies costs one vector.  All classes are dealt into
    blocks; each pair of blocks is a tile of int8 values, a byte a component,
    which settles what the error bounds settle and returns link counts, a forest
    of links and the vectors with open pairs: never more than a few rows for each
    it got.  Only those vectors travel again, in full, to have their open pairs
    computed in double precision.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    v = only(vectors, vec_id=id_col, embedding=vector_col)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("usable", usable).withColumn("d1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("d2", F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")))
    keyed = scratch.keep(v.select("vec_id", "d1", "d2"), "digests")
    classes = scratch.keep(keyed.where("d1 is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # Joined by id as well, which the copies of a vector do not share.
    c = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "rep", "copies")
    firsts = v.where("usable").join(c, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("vec_id") == F.col("rep")))
    firsts = firsts.dropDuplicates(["d1", "d2", "vec_id"]).select("rep", "copies", F.size("embedding").alias("dims"), "embedding")
    coded = scratch.keep(firsts.mapInArrow(_quantise, QUANTISED), "coded")
    # Blocks per vector length; the table has as many rows as there are lengths.
    side = F.least(F.greatest(F.count("*") / 64, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    blocks = coded.groupBy("dims").agg(F.ceil(F.count("*") / side).alias("blocks")).withColumn("tiles", (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("int"))
    base = F.coalesce(F.sum("tiles").over(Window.orderBy("dims").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = scratch.keep(blocks.withColumn("base", base.cast("int")), "blocks")
    tiles = max(1, blocks.agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0])
    tile = (F.col("base") + F.col("low") * F.col("blocks") - F.col("low") * (F.col("low") - 1) / 2 + F.col("high") - F.col("low")).cast("int").alias("tile")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")
    dealt = coded.join(bounded(blocks), "dims").select("dims", "base", "blocks", "rep", "copies", "q", "scale", "bound", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(tile, "dims", "low", "high", "rep", "copies", "block", "q", "scale", "bound")
    # A partition a tile: tiles are few bytes, but much work, and would be merged.
    first = scratch.keep(dealt.repartitionById(tiles, F.col("tile")).groupBy("tile").applyInArrow(_tile(threshold), FOUND), "first")
    unsure = first.where("kind = 2").select("dims", "low", "high", F.col("a").alias("rep"))
    again = unsure.join(firsts, ["dims", "rep"]).join(bounded(blocks), "dims").select(tile, "dims", "low", "high", "rep", "copies", block, "embedding")
    second = scratch.keep(again.repartitionById(tiles, F.col("tile")).groupBy("tile").applyInArrow(_tile(threshold), FOUND), "second")
    found = first.unionByName(second).select("kind", "a", "b", "n")
    scratch.drop(coded)

    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("kind = 1"), scratch).withColumnRenamed("node", "rep")
    facts = scratch.keep(classes.join(counts, "rep", "left").join(labels, "rep", "left").select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "facts")
    out = keyed.join(facts, ["d1", "d2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE usable),
linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9::DOUBLE
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.y FROM reach r JOIN linked l ON l.x = r.seen
), least_seen AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n FROM linked GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least_seen ON node = vec_id LEFT JOIN degree ON x = vec_id
"""
