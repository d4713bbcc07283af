"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gets 128 minima.  Bands of whole minima
name candidate groups; of every minimum only the lowest 4 bits are kept, packed
into 64 bytes.  Two packed signatures are compared by bit counts, corrected for
the chance agreement of 4-bit values; pairs that this estimate leaves possible
are confirmed on their full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, arrow_rows, bounded, components, give_back, only, only_cache, read, spread, with_keys
from .shingles import linked_labels, mix, shingle_set, similar_sets

MINIMA, BITS = 128, 4
#: Chance that a linked pair shares no band, at the threshold itself.
MISS = 1e-6
#: The estimate drops a pair only if it is so many standard deviations below the threshold.
DEVIATIONS = 5.0
#: A block of a bucket has about so many documents, or bytes of text; signatures alone are screened in larger blocks.
TILE_DOCS, TILE_BYTES, SCREEN_DOCS = 512, 8 << 20, 8192
#: Counters that tell rare shingles from frequent ones; their number does not grow with the data.
CELLS = 1 << 20
#: Small groups are compared together in packs of about so many documents, or bytes.
PACK_DOCS, PACK_BYTES = 256, 1 << 20
_MUL = (np.random.default_rng(5).integers(0, 2**31, MINIMA, dtype=np.int64) * 2 + 1).astype(np.uint32)
_ADD = np.random.default_rng(6).integers(0, 2**32, MINIMA, dtype=np.int64).astype(np.uint32)
_BAND = np.random.default_rng(7).integers(0, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)


def band_rows(percent: int) -> tuple[int, int]:
    """(rows in a band, bands): the longest bands that keep the miss chance under MISS."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if rows * bands <= MINIMA:
            return rows, bands
    return 1, MINIMA


def minima(h: np.ndarray) -> np.ndarray:
    """128 minima over permutations of the low 32 bits of shingle hashes."""
    low, out = h.astype(np.uint32), np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i : i + 2048, None] * _MUL + _ADD).min(0), out=out)
    return out


def pack(m: np.ndarray) -> bytes:
    """Low 4 bits of each minimum, two to a byte."""
    low = (m & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 4-bit values agree, for all pairs of packed signatures (n x 8 words of 64 bits)."""
    ones = np.uint64(0x1111111111111111)
    out = np.full((len(a), len(b)), MINIMA, np.int16)
    for k in range(a.shape[1]):
        x = a[:, None, k] ^ b[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out -= np.bitwise_count(x & ones).astype(np.int16)
    return out


def least_agreement(percent: int) -> float:
    """Agreeing values below which a pair can be dropped: threshold, chance agreement added, less the margin."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return MINIMA * p - DEVIATIONS * math.sqrt(MINIMA * p * (1 - p))


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from the number of agreeing values, corrected for collisions."""
    chance = 2.0**-BITS
    return (agree / MINIMA - chance) / (1 - chance)


SIGNED = "doc_id long, n_shingles long, bytes long, d1 long, d2 long, sig array<long>, bands array<long>"


def _sign(percent: int):
    rows, bands = band_rows(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("bytes", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        only_cache("words")
        for batch in batches:
            out = {k: [] for k in schema.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                h = shingle_set(text)
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(len(h))
                out["bytes"].append(len(text or ""))
                if len(h) == 0:
                    for k in ("d1", "d2", "sig", "bands"):
                        out[k].append(None)
                    continue
                m = minima(h)
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                b = (m[: rows * bands].astype(np.uint64) * _BAND[: rows * bands]).reshape(bands, rows).sum(1, dtype=np.uint64)
                out["d1"].append(int(d[0]))
                out["d2"].append(int(d[1]))
                out["sig"].append(np.frombuffer(pack(m), np.int64))
                out["bands"].append(mix(b + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            give_back()

    return sign


def agreeing(a: Column, b: Column) -> Column:
    """How many of the 4-bit values agree, of two packed signatures (arrays of longs)."""
    differ = lambda x: F.bit_count(((x.bitwiseOR(F.shiftrightunsigned(x, 2))).bitwiseOR(F.shiftrightunsigned(x.bitwiseOR(F.shiftrightunsigned(x, 2)), 1))).bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(MINIMA) - F.aggregate(F.zip_with(a, b, lambda x, y: differ(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and estimate of two sides (structs with sig and n_shingles) leave it open that they are linked."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (agreeing(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= F.lit(least_agreement(percent)))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(percent: int):
    """Members of stars against their centers, on full sets; a pack holds many stars or a chunk of one."""

    def compare(table: pa.Table) -> pa.Table:
        center, rep, text = table.column("center").to_numpy(), table.column("rep").to_numpy(), table.column("text")
        found = []
        order = np.argsort(center, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(center[order])) + 1):
            c, key = rep[group] == center[group], center[group[0]]
            centers = [shingle_set(text[int(i)].as_py()) for i in group[c]]
            for i in group[~c]:
                s = shingle_set(text[int(i)].as_py())
                if any(similar_sets(s, t, percent) for t in centers):
                    found.append((int(rep[i]), int(key)))
        return pa.Table.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=_LINKS)

    return compare


def _maybe(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int):
    """Which pairs of one tile need their full sets, by strips (first row, matrix): possible and not yet connected.

    A pair of a bucket counts in the first band it shares.  A pair that meets on
    a rare shingle (band_no -1) counts if it shares a band at all, and if the
    shingle is among the rarest of the smaller set.
    """
    least = least_agreement(percent)
    sig, bands = (table.column(c).combine_chunks() for c in ("sig", "bands"))
    sig, bands = (x.flatten().to_numpy().reshape(len(table), -1) for x in (sig, bands))
    size, label, k = (table.column(c).to_numpy() for c in ("n_shingles", "label", "band_no"))
    short = table.column("short").to_numpy(zero_copy_only=False)
    k = int(k[left[0]])
    words = sig.view(np.uint64)
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        m = agreement(words[i], words[right]) >= least
        m &= label[i][:, None] != label[right]
        small, large = np.minimum(size[i][:, None], size[right]), np.maximum(size[i][:, None], size[right])
        m &= 100 * small >= percent * large
        if k < 0:
            m &= np.where(size[i][:, None] <= size[right], short[i][:, None], short[right])
        if left is right:
            m &= np.arange(at, at + len(i))[:, None] < np.arange(len(right))
        r, c = np.nonzero(m)
        for s in range(0, len(r), 1 << 16):
            a, b = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
            shared = bands[i[a]] == bands[right[b]]
            m[a, b] = shared.any(1) if k < 0 else ~shared[:, :k].any(1)
        yield at, m


def _tiles(table: pa.Table, blocks: str):
    """Rows of the lower and of the upper block of each tile of a pack, the same array where that is one block."""
    band, block, low, high = (table.column(c).to_numpy() for c in ("band", blocks, "low", "high"))
    order = np.argsort(band, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        left, right = group[block[group] == low[group]], group[block[group] == high[group]]
        if len(left) and len(right):
            yield left, left if low[group[0]] == high[group[0]] else right


_LEFT = pa.schema([("band", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("rep", pa.int64())])


def _screen(percent: int):
    """Rows that have a pair left after the estimate, for each pair of blocks: (band, low, high, rep)."""

    def screen(table: pa.Table) -> pa.Table:
        band, block, rep = (table.column(c).to_numpy() for c in ("band", "block", "rep"))
        found = []

        def tell(x, y, of):
            out = {"band": band[of], "low": np.minimum(block[x], block[y]), "high": np.maximum(block[x], block[y]), "rep": rep[of]}
            found.append(pa.Table.from_pydict(out, schema=_LEFT))

        for left, right in _tiles(table, "part"):
            same = left is right
            left = left[np.argsort(block[left], kind="stable")]
            right = left if same else right[np.argsort(block[right], kind="stable")]
            of_right = np.flatnonzero(np.diff(block[right], prepend=-1))
            for at, m in _maybe(table, left, right, percent):
                i = left[at : at + len(m)]
                of_left = np.flatnonzero(np.diff(block[i], prepend=-1))
                r, c = np.nonzero(np.logical_or.reduceat(m, of_right, axis=1))
                tell(i[r], right[of_right[c]], i[r])
                r, c = np.nonzero(np.logical_or.reduceat(m, of_left, axis=0))
                tell(i[of_left[r]], right[c], right[c])
        return pa.concat_tables(found) if found else _LEFT.empty_table()

    return screen


def _confirm(percent: int):
    """A forest of confirmed links between different labels, from the full sets of a tile's rows."""

    def confirm(table: pa.Table) -> pa.Table:
        label, text = table.column("label").to_numpy(), table.column("text")
        a, b = [], []
        for left, right in _tiles(table, "block"):
            m = np.concatenate([strip for _, strip in _maybe(table, left, right, percent)])
            need = np.union1d(left[m.any(1)], right[m.any(0)])
            sets = {int(i): shingle_set(text[int(i)].as_py()) for i in need}
            for i, j in linked_labels(left, right, m, label, sets, percent):
                a.append(int(label[i]))
                b.append(int(label[j]))
        return pa.Table.from_pydict({"a": a, "b": b}, schema=_LINKS)

    return confirm


def _cells(batches):
    """How many shingles of a task's sets fall into each cell; cells without any are left out."""
    only_cache("words")
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, shingle_set(text.as_py()) & np.uint64(CELLS - 1), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"cell": at, "n": counts[at]}, schema=pa.schema([("cell", pa.int64()), ("n", pa.int64())]))


def rare_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles a set of n meets larger and smaller sets on: (as the smaller, as the larger).

    Two linked sets share a shingle among so many first ones of each, in any
    order common to all: the overlap is at least percent of the larger set, and
    at least 2 percent / (100 + percent) of the smaller.
    """
    return n + 2 * percent * -n // (100 + percent) + 1, n + percent * -n // 100 + 1


def _rarest(percent: int, counts):
    """(rep, label, n_shingles, band, short): the rarest shingles of each set that another set may hold too."""
    schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("n_shingles", pa.int64()), ("band", pa.int64()), ("short", pa.bool_())])

    def rarest(batches):
        only_cache("words")
        seen = counts.value
        for batch in batches:
            for rep, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = shingle_set(text.as_py())
                often = seen[h & np.uint64(CELLS - 1)]
                as_smaller, as_larger = rare_lengths(len(h), percent)
                first = np.lexsort((h, often))[:as_larger]
                at = np.flatnonzero(often[first] > 1)
                if len(at):
                    out = {"rep": np.full(len(at), rep), "label": np.full(len(at), label), "n_shingles": np.full(len(at), len(h)), "band": h[first[at]].view(np.int64), "short": at < as_smaller}
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return rarest


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets
    of 5-word shingles; component_id is the smallest doc_id reachable by links
    and kept marks that document.  Texts without words (null, empty, blank) have
    an empty set and link with nothing.  Rows that share a doc_id are one
    document; a row without doc_id links with nothing, has no component and is
    kept.  Texts of any length are taken whole.  An empty table gives an empty
    result.  Columns other than id and text play no part, whatever their names.

    Every pair that shares a band and that its packed signatures leave possible
    is decided on full sets, in groups of any size.  Documents with equal sets
    become one class first.  Then each bucket's members are held against its
    smallest member, which alone connects most groups, in work that grows with
    the bucket.  What is left, pairs of one bucket that are not connected yet,
    is compared in pairs of blocks: signatures first, and full texts only of the
    documents that have such a pair.  A pair counts in the first band it shares.
    In a bucket of more than one block a pair is looked at only if it also meets
    on one of the rarest shingles of both, as all linked pairs do; pages of one
    template that are not linked share no such shingle.  Counters of fixed size
    tell what is rare; they choose the order, not the result.
    Tasks return forests of links, never all pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    base = only(docs, doc_id=id_col, text=text_col)
    with arrow_rows(spark, 1000):
        signed = scratch.keep(spread(base).mapInArrow(_sign(percent), SIGNED), "signed")

    linkable = signed.where("d1 is not null and doc_id is not null")
    # Written, so that the join reads two plain shuffles, of which a large class's part can be split.
    classes = scratch.keep(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    member = scratch.keep(linkable.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "d1", "d2", "rep"), "members")
    repeated = not linkable.groupBy("doc_id").count().where("count > 1").isEmpty()
    copies = scratch.keep(member.where("doc_id <> rep").select("doc_id", "d1", "d2").distinct(), "copies")
    firsts = linkable.join(bounded(copies), ["doc_id", "d1", "d2"], "left_anti")
    firsts = firsts.dropDuplicates(["doc_id", "d1", "d2"]) if repeated else firsts
    firsts = scratch.keep(firsts.select(F.col("doc_id").alias("rep"), "n_shingles", "bytes", "sig", "bands"), "firsts")
    scratch.drop(classes, copies)
    bands = scratch.keep(firsts.select("rep", F.posexplode("bands").alias("band_no", "band")), "bands")
    buckets = scratch.keep(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1").drop("n"), "buckets")
    hits = scratch.keep(bands.join(buckets, "band"), "hits")
    scratch.drop(bands, buckets)

    # Stars: each member against the smallest of its buckets.
    facts = firsts.select("rep", "bytes", F.struct("n_shingles", "sig").alias("fact"))
    star = hits.where("rep <> center").select("rep", "center").distinct()
    star = star.join(facts, "rep").join(facts.select(F.col("rep").alias("center"), F.col("bytes").alias("center_bytes"), F.col("fact").alias("center_fact")), "center")
    star = star.where(possible("fact", "center_fact", percent)).groupBy("rep", "center").agg(F.max("bytes").alias("bytes"), F.max("center_bytes").alias("center_bytes"))
    star = scratch.keep(star, "near")
    texts = base.withColumnRenamed("doc_id", "rep").where("rep is not null and text is not null")

    def with_text(df: DataFrame) -> DataFrame:
        """Rows with a rep, each with its text; texts of others do not move if the reps are few."""
        wanted = scratch.keep(df.select("rep").distinct(), "wanted")
        found = texts.join(bounded(wanted), "rep", "left_semi")
        return df.join(found.dropDuplicates(["rep", "text"]) if repeated else found, "rep")

    members = star.groupBy("center").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("center_bytes").alias("center_bytes"))
    # A chunk holds a copy of the center; it has as many bytes of members at least, if there are so many.
    chunks = F.greatest(F.col("n") / PACK_DOCS, F.col("bytes") / F.greatest("center_bytes", F.lit(PACK_BYTES)), F.lit(1))
    members = scratch.keep(members.withColumn("chunks", F.least(F.ceil(chunks), "n").cast("long")), "stars")
    packs = max(1, math.ceil(members.agg(F.coalesce(F.sum(F.col("bytes") + F.col("center_bytes") + 512 * F.col("n")), F.lit(0))).first()[0] / PACK_BYTES))
    chunk = F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("chunks"))).cast("long")
    own = members.select(F.col("center").alias("rep"), "center", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    rays = star.join(members.select("center", "chunks"), "center").select("rep", "center", "chunks", chunk.alias("chunk"))
    placed = with_text(scratch.keep(own.unionByName(rays), "rays"))
    placed = placed.select(F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("center"), F.lit(packs))).otherwise(F.col("center")).alias("pack"), (F.col("chunks") > 1).alias("split"), "chunk", "center", "rep", "text")
    found = scratch.keep(placed.groupBy("pack", "split", "chunk").applyInArrow(_stars(percent), "a long, b long"), "links")
    labels = components(found, scratch).select(F.col("node").alias("rep"), F.col("component").alias("label"))

    # What the stars have left: buckets with documents that are not connected.
    named = hits.join(labels, "rep", "left").select("rep", "band", "band_no", F.coalesce("label", "rep").alias("label"))
    named = scratch.keep(named, "named")
    scratch.drop(hits, star, found)
    open_ones = scratch.keep(named.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "n"), "open")
    rows = named.join(open_ones.select("band"), "band", "left_semi").join(firsts, "rep").withColumn("short", F.lit(True))
    rows = scratch.keep(rows, "rows")

    def in_blocks(df: DataFrame) -> DataFrame:
        found = df.groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        blocks = F.greatest(F.ceil(F.col("n") / TILE_DOCS), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1)).cast("long").alias("blocks")
        return scratch.keep(found.select("band", blocks, F.ceil(F.col("n") / SCREEN_DOCS).cast("long").alias("parts")), "sizes")

    sizes = in_blocks(rows)
    large = sizes.where("blocks > 1").select("band")
    if not large.isEmpty():
        # Large buckets are taken apart by the rarest shingles of their members.
        wide = scratch.keep(rows.join(large, "band", "left_semi").select("rep", "label").distinct(), "wide")
        wide_texts = scratch.keep(with_text(wide).select("rep", "label", "text"), "wide-texts")
        with arrow_rows(spark, 1000):
            cells = wide_texts.select("text").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
            counts = np.zeros(CELLS, np.int64)
            counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
            rarest = wide_texts.mapInArrow(_rarest(percent, spark.sparkContext.broadcast(counts)), "rep long, label long, n_shingles long, band long, short boolean")
            rarest = scratch.keep(rarest, "rarest")
        meet = rarest.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("short").alias("any")).where("any and lo < hi")
        meet = scratch.keep(meet.select("band"), "meet")
        met = rarest.join(meet, "band", "left_semi").join(firsts.join(wide.select("rep"), "rep", "left_semi"), ["rep", "n_shingles"]).withColumn("band_no", F.lit(-1))
        old = rows
        rows = scratch.keep(old.join(large, "band", "left_anti").unionByName(met), "rows")
        scratch.drop(old, sizes, wide, wide_texts, rarest, meet)
        sizes = in_blocks(rows)

    packs = max(1, math.ceil(rows.count() / PACK_DOCS))
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("long")
    dealt = rows.join(sizes, "band").withColumn("block", block).withColumn("part", F.floor(F.col("block") * F.col("parts") / F.col("blocks")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pack_of = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(packs))).otherwise(F.col("band")).alias("pack")
    facts_of = ["band", "band_no", "rep", "label", "n_shingles", "sig", "bands", "short", "block"]
    tiles = dealt.select(pack_of, (F.col("blocks") > 1).alias("split"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *facts_of)
    left = tiles.groupBy("pack", "split", "low", "high").applyInArrow(_screen(percent), "band long, low long, high long, rep long")
    left = scratch.keep(left.distinct(), "left")
    again = with_text(left).join(rows.drop("bytes"), ["rep", "band"]).join(sizes, "band").withColumn("block", block)
    again = again.select(pack_of, (F.col("blocks") > 1).alias("split"), "low", "high", *facts_of, "text")
    more = scratch.keep(again.groupBy("pack", "split", "low", "high").applyInArrow(_confirm(percent), "a long, b long"), "more")
    scratch.drop(named, open_ones, rows, left)

    if not more.isEmpty():
        joined = components(more, scratch).select(F.col("node").alias("old"), F.col("component").alias("new"))
        every = labels.select("rep", "label").unionByName(joined.select(F.col("old").alias("rep"), F.col("old").alias("label"))).groupBy("rep").agg(F.min("label").alias("label"))
        labels = scratch.keep(every.join(joined, F.col("label") == F.col("old"), "left").select("rep", F.coalesce("new", "label").alias("label")), "labels")
    named = member.select("doc_id", "rep").join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), percent=85)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS item FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)
), both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sets
  UNION
  SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.seen
), least_seen AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_seen ON node = doc_id
"""


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs``, one document of each group of near copies (similarity 0.8 or more): the smallest doc_id.

    Rows of one doc_id stay or go together.  Rows without doc_id, and texts that
    are null or hold no word, stay.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "near-dedup-stage")
    dropped = scratch.keep(near_dedup(docs, percent=80).where("not kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    keyed = with_keys(docs, key=F.coalesce(docs["doc_id"], F.lit(NULL_ID)))
    return keyed.join(bounded(dropped), F.col("key") == F.col("dropped"), "left_anti").select("record.*")
