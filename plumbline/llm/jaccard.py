"""Self-join of documents by the Jaccard similarity of their word shingles, vertically partitioned.

All shingles stand in one global order, and every document's set is a sorted list in it. The
order is cut into FRAGMENTS ranges of hashes; a candidate pair's overlap is counted in each
fragment by itself and summed per pair, and histograms of the fragments bound the overlap before.

1. Equal sets are one class; one document stands for it, the others aren't compared.
2. The global order puts shingles that are common in a sample of documents (one of eight) last and
   otherwise goes by hash. Any order gives the same links; this one keeps common phrases out.
3. Two linked sets share SHARED shingles (all they need to, if that is fewer) among the first
   n - ceil(t n) + SHARED of both (prefix). Prefix shingles are dealt by hash. A document meets the
   next FEW at most of those that have a shingle too and that its size and place in the order
   allow; pairs that meet often enough are candidates. One shared by chance makes none.
4. Documents that a shingle would bring together with more are compared once more among themselves: with
   exact frequencies, rarest first, so that copies that differ in many places share nothing.
   Here a shingle has one of its documents as its centre, and each document is linked first with the
   centre that most of its shingles have, then with its others that are not in its component yet.
   Pairs that are in different components after that are compared too, within the same bounds, in blocks of a shingle's
   documents: no link between components is lost.
5. Links are counted where asked: those that 3 and 4 found one by one, and those between two
   documents of 4 by blocks. A component's documents are dealt into blocks, two blocks meet in one
   group, and the group sums the overlaps of all its pairs fragment by fragment. Only a number for
   each document leaves it. A component of m different sets costs m * m / 2 overlaps.

A map task that sees one shingle more than FEW times sends a mark instead of its rows, and from MANY
rows on a shingle's documents are only marked, so that a shingle of very many documents is not one
task's work. Classes of over HOT rows are joined by
broadcast (there are at most rows / HOT).

Rows, not ids, are linked. Null, empty and wordless texts have an empty set, are linked with nothing
and are components by themselves. Rows whose doc_id is null or repeated are compared by their own
texts like any other; a component has the smallest doc_id in it as its id, null if it has none.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpoint, documents, join_hot, size_checked, slices
from plumbline.llm.components import components
from plumbline.llm.shingles import shingle_sets

#: Documents that a document meets at most by one shingle. Those of larger groups go to 4, where they cost a link or two each.
FEW = 8
#: Prefix shingles that the documents of a candidate pair share.
SHARED = 3
#: Documents of one shingle beyond which none are compared by it.
MANY = 1 << 16
FRAGMENTS = 8
BINS = 64  # a power of two
#: So many of SAMPLE_OF documents are sampled, at every size: with a sample of fixed size, ever fewer shingles of a
#: group are known as common as the table grows, and more rows for each document are left to count and compare.
SAMPLE_DOCS, SAMPLE_OF = 4096, 32_768
SAMPLE_COMMON = 2
MOST_COMMON = 1_000_000
#: Ids that are broadcast at most; more are shuffled.
FEW_IDS = 1_000_000
SLICE = 1 << 20
#: Rows of one shingle in a block, where its pairs are compared.
BLOCK_ROWS = 512
#: Sets, and bytes of sets, in a block of a component.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20


def set_key(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least SAMPLE_COMMON documents of the sample, the MOST_COMMON at most, and how many have them."""
    few = docs.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE_OF)) < SAMPLE_DOCS).select("text")

    def tally(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    found = few.mapInArrow(tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= SAMPLE_COMMON)
    top = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(h: np.ndarray, percent: int, common, maybe: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the global order: hashes, common ones last by frequency."""
    often, count = common
    p = len(h) - least_overlap(len(h), percent) + SHARED if len(h) else 0
    last = np.flatnonzero(maybe[(h & np.uint64(len(maybe) - 1)).astype(np.int64)])
    if len(last):
        at = np.minimum(np.searchsorted(often, h[last]), len(often) - 1)
        same = often[at] == h[last]
        last, at = last[same], at[same]
        first = np.delete(h, last)
        if len(first) < p:
            first = np.concatenate([first, h[last[np.lexsort((h[last], count[at]))]]])
        h = first
    return h[:p]


def keyed(rows: DataFrame, width: int) -> DataFrame:
    """The rows without their text, with n_shingles and set_key (null without words)."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                more = [pa.array([len(h) for h in sets], pa.int64()), pa.array([set_key(h) for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *more], names=[*(f.name for f in kept), "n_shingles", "set_key"])

    return rows.mapInArrow(cut, T.StructType([*kept, T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType())]))


def possible(n_a, at_a, n_b, at_b, percent: int, least=F.least):
    """Whether sets may be linked that meet first at these places of the global order."""
    return (100 + percent) * least(n_a - at_a, n_b - at_b) >= percent * (n_a + n_b)


def candidates(docs: DataFrame, width: int, percent: int, held) -> DataFrame:
    """a, b: pairs of documents (a < b) with common prefix shingles that few have, within the
    bounds of sizes and places; or a document a with a frequent one, where b is null.

    held: the common shingles, broadcast.
    """

    def spread(batches):
        common = held.value
        maybe = np.zeros(1 << 22, bool)  # quick test by 22 bits
        maybe[(common[0] & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        for batch in batches:
            keys, sizes, node, place = [], [], batch.column("node").to_numpy(), []
            for part in slices(batch, "text", SLICE):
                for h in shingle_sets(part.column("text"), width):
                    # A set's size and the place in it share a number; -1 marks a shingle as frequent, -2
                    # a document that has a frequent one.
                    keys.append(prefix_of(h, percent, common, maybe).copy())  # not the whole set is kept
                    sizes.append(len(keys[-1]))
                    place.append((len(h) << 32) + np.arange(sizes[-1]))
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            place = np.concatenate(place) if keys else np.zeros(0, np.int64)
            del keys
            order = np.argsort(key, kind="stable")
            key, node, place = key[order], np.repeat(node, np.array(sizes, np.int64))[order], place[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            many = np.repeat(size > FEW, size)
            known = np.unique(node[many])
            with np.errstate(over="ignore"):
                k = np.concatenate([key[~many], key[first[size > FEW]], known * np.int64(0x5851F42D4C957F2D)])
            v = np.concatenate([node[~many], np.zeros((size > FEW).sum(), np.int64), known])
            w = np.concatenate([place[~many], np.full((size > FEW).sum(), -1, np.int64), np.full(len(known), -2, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(w)], names=["key", "node", "place"])

    def gather(batches):
        def meet(key, node, place):
            """Pairs, with the shingles they share and need, and frequent documents of whole runs of keys."""
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            often = np.minimum.reduceat(place, first) < 0
            frequent = node[np.repeat(often, size) & (place >= 0)]
            rows = np.repeat(~often & (size > 1), size)
            run, node, n, at = np.repeat(np.arange(len(first)), size)[rows], node[rows], place[rows] >> 32, place[rows] & 0xFFFFFFFF
            order = np.lexsort((n, run))
            run, node, n, at = (x[order] for x in (run, node, n, at))
            at -= SHARED - 1  # so many shared shingles may stand before
            # A document's run by sizes, up to the last that may be linked with it.
            most = ((100 + percent) * (n - at) - percent * n) // percent
            here, last = np.arange(len(n)), np.searchsorted((run << 32) + n, (run << 32) + np.clip(most, 0, 0xFFFFFFFF), "right")
            beyond, far = np.zeros(len(n) + 1, np.int64), np.flatnonzero(last > here + 1 + FEW)
            np.add.at(beyond, far + 1 + FEW, 1)
            np.add.at(beyond, last[far], -1)
            frequent = np.concatenate([frequent, node[far], node[np.cumsum(beyond[:-1]) > 0]])
            found, i = [np.zeros((0, 3), np.int64)], here
            for d in range(1, FEW + 1):
                i = i[last[i] > i + d]
                if not len(i):
                    break
                j = i + d
                same = (node[i] != node[j]) & possible(n[i], at[i], n[j], at[j], percent, np.minimum)
                x, y = i[same], j[same]
                found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.minimum(SHARED, -(-percent * (n[x] + n[y]) // (100 + percent)))], 1))
            # Two documents that both go to the second comparison meet there.
            frequent, pairs = np.unique(frequent), np.concatenate(found)
            pairs = pairs[~(np.isin(pairs[:, 0], frequent) & np.isin(pairs[:, 1], frequent))]
            pairs, times = np.unique(pairs, axis=0, return_counts=True)
            return np.column_stack([pairs, times]), frequent

        def out(pairs, frequent):
            frequent = np.unique(frequent)
            none = np.zeros(len(frequent), np.int64)
            b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(frequent), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], frequent])), b, *(pa.array(np.concatenate([pairs[:, k], none])) for k in (2, 3))], names=["a", "b", "needs", "shares"])

        held, closed = None, None  # rows of a run that may go on; the key of one known to be frequent
        for batch in batches:
            key, node, place = (batch.column(c).to_numpy() for c in ("key", "node", "place"))
            frequent = [node[place == -2]]
            key, node, place = (x[place != -2] for x in (key, node, place))
            if held is not None:
                key, node, place = (np.concatenate(x) for x in zip(held, (key, node, place), strict=True))
            more = key == closed if closed is not None else np.zeros(len(key), bool)
            frequent.append(node[more & (place >= 0)])
            key, node, place = (x[~more] for x in (key, node, place))
            held, pairs = None, np.zeros((0, 4), np.int64)
            if len(key):
                tail = int(np.searchsorted(key, key[-1]))
                if tail:
                    pairs, f = meet(key[:tail], node[:tail], place[:tail])
                    frequent.append(f)
                held = tuple(x[tail:] for x in (key, node, place))
                if len(held[0]) > MANY or held[2].min() < 0:
                    frequent.append(held[1][held[2] >= 0])
                    held, closed = None, key[-1]
            yield out(pairs, np.concatenate(frequent))
        if held is not None:
            yield out(*meet(*held))

    keys = docs.mapInArrow(spread, "key long, node long, place long")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(gather, "a long, b long, needs long, shares long")
    return met.groupBy("a", "b").agg(F.max("needs").alias("needs"), F.sum("shares").alias("shares")).filter("shares >= needs").select("a", "b")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, s (a mark of the set), n, bins (shingles in each of BINS ranges), shingles (bytes)."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                bins = [np.bincount((h >> np.uint64(65 - BINS.bit_length())).astype(np.int64), minlength=BINS).tolist() for h in sets]
                marks = [int.from_bytes((set_key(h) or b"")[:8], "little", signed=True) for h in sets]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(marks, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(bins, pa.list_(pa.int32())), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "s", "n", "bins", "shingles"])

    nodes = checkpoint(nodes)
    found = docs.join(size_checked(nodes, nodes.count(), FEW_IDS), "node").select("node", "text")
    return checkpoint(found.mapInArrow(cut, "node long, s long, n long, bins array<int>, shingles binary"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) that are linked."""
    for side in "ab":
        of = sets.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}"), F.col("n").alias(f"n_{side}"), F.col("bins").alias(f"bins_{side}"))
        pairs = pairs.join(of, side)
    enough = lambda overlap: (100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = pairs.filter(enough(F.least("n_a", "n_b")))
    bound = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x).cast("long")
    names = ["a", "s_a", "n_a", "b", "s_b", "n_b"]
    pairs = checkpoint(pairs.filter(enough(bound)).select(*names).distinct())

    def fragments(batches):
        for batch in (part for whole in batches for part in slices(whole, "shingles", SLICE)):
            node, mark, f, part = [], [], [], []
            for k, s, blob in zip(batch.column("node").to_pylist(), batch.column("s").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                h = np.frombuffer(blob, np.uint64)
                cut = np.searchsorted(h >> np.uint64(61), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                for i in range(FRAGMENTS):
                    if cut[i] < cut[i + 1]:
                        node.append(k)
                        mark.append(s)
                        f.append(i)
                        part.append(h[cut[i] : cut[i + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(mark, pa.int64()), pa.array(f, pa.int32()), pa.array(part, pa.list_(pa.int64()))], names=["node", "s", "fragment", "part"])

    needed = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    cut = sets.select("node", "s", "shingles").join(size_checked(needed, needed.count(), FEW_IDS), "node", "left_semi").mapInArrow(fragments, "node long, s long, fragment int, part array<long>")
    met = pairs
    for side, on in (("a", ["a", "s_a"]), ("b", ["b", "s_b", "fragment"])):
        met = met.join(cut.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}"), "fragment", F.col("part").alias(f"part_{side}")), on)
    overlap = met.select(*names, "fragment", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("o")).distinct()
    return overlap.groupBy(*names).agg(F.sum("o").alias("overlap")).filter(enough(F.col("overlap"))).select("a", "b").distinct()


def rare_first(sets: DataFrame, nodes: DataFrame, held, percent: int) -> DataFrame:
    """key, node, at, n: the prefixes of these documents, rarest first.

    Shingles that the sample knows as common keep their place at the end and needn't be counted;
    the others get their exact frequencies among these documents. held: the common ones, broadcast.
    """

    def cut(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Other shingles, and the common ones in order as far as a prefix can reach."""
        often, count = held.value
        at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
        same = often[at] == h if len(often) else np.zeros(len(h), bool)
        late = h[same][np.lexsort((h[same], count[at[same]]))] if len(often) else h[:0]
        return h[~same], late[: len(h) - least_overlap(len(h), percent) + 1]

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, "shingles", SLICE)):
            parts = [cut(np.frombuffer(x, np.uint64))[0] for x in batch.column("shingles").to_pylist()]
            size = np.array([len(x) for x in parts], np.int64)
            wide = [pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("node", "s")]
            yield pa.RecordBatch.from_arrays([*wide, pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))], names=["node", "s", "key"])

    def end(batches):
        for batch in (part for whole in batches for part in slices(whole, "shingles", SLICE)):
            parts = [cut(np.frombuffer(x, np.uint64)) for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "s", "n")), pa.array([len(x) for x, _ in parts], pa.int64()), pa.array([x.view(np.int64) for _, x in parts], pa.list_(pa.int64()))], names=["node", "s", "n", "rest", "late"])

    mine = sets.join(size_checked(nodes, nodes.count(), FEW_IDS), "node", "left_semi")
    rows = checkpoint(mine.select("node", "s", "shingles").mapInArrow(count, "node long, s long, key long"))  # read twice
    often = rows.groupBy("key").agg(F.count_distinct("node").alias("df")).filter("df > 1")
    shared = rows.join(often, "key").groupBy("node", "s").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("shared"))
    late = mine.select("node", "s", "n", "shingles").mapInArrow(end, "node long, s long, n long, rest long, late array<long>").distinct()
    both = late.join(shared, ["node", "s"], "left")
    keys = F.coalesce(F.transform("shared", lambda x: x["key"]), F.array().cast("array<long>"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("rest") - F.size(keys)
    part = F.slice(F.concat(keys, "late"), F.lit(1), F.greatest(F.lit(0), (prefix - alone).cast("int")))
    found = both.select("node", "n", alone.alias("alone"), F.posexplode(part).alias("at", "key"))
    return found.select("key", "node", (F.col("alone") + F.col("at")).alias("at"), "n")


@dataclass(frozen=True)
class Links:
    roots: DataFrame  # node, root of every node that isn't the smallest of its component
    pairs: DataFrame  # a, b: links, all but some between two documents of `often`
    often: DataFrame  # node: documents with a frequent prefix shingle
    sets: DataFrame  # of all documents in links, as sets_of has them


def linked(docs: DataFrame, width: int, percent: int) -> Links:
    """Links among docs (node, text), which has every set once."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))
    found = checkpoint(candidates(docs, width, percent, held))
    often = checkpoint(found.filter("b is null").select(F.col("a").alias("node")))
    pairs = found.filter("b is not null")
    sets = sets_of(docs, found.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct(), width)
    prefixes = checkpoint(rare_first(sets, often, held, percent))

    centre = prefixes.groupBy("key").agg(F.min(F.struct("at", "node", "n")).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", F.col("c.at").alias("at_c"), F.col("c.node").alias("c"), F.col("c.n").alias("n_c"))
    mine = prefixes.select(F.col("key").alias("key_m"), "node", F.col("at").alias("at_m"), F.col("n").alias("n_m"))
    near = lambda a, b: possible(F.col(f"n{a}"), F.col(f"at{a}"), F.col(f"n{b}"), F.col(f"at{b}"), percent)
    stars = mine.join(centre, (F.col("key_m") == F.col("key")) & (F.col("node") != F.col("c")) & near("_m", "_c"))
    stars = checkpoint(stars.groupBy("node", "c").agg(F.count(F.lit(1)).alias("shares")))
    ends = lambda df: df.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    first = stars.groupBy("node").agg(F.max_by("c", F.struct("shares", "c")).alias("c"))
    links = checkpoint(verified(pairs.unionByName(ends(first)).distinct(), sets, percent))
    roots = components(links)
    later = stars.join(first, ["node", "c"], "left_anti")
    for side in ("node", "c"):
        later = later.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    later = checkpoint(ends(later.filter(F.coalesce("root_node", "node") != F.coalesce("root_c", "c"))))
    if later.take(1):
        links = checkpoint(links.unionByName(verified(later.join(links, ["a", "b"], "left_anti"), sets, percent)))
        roots = components(links)

    # Pairs of frequent shingles whose documents are still in different components, by blocks.
    placed = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")).filter("lo <> hi").select("key", "blocks")
    placed = placed.join(torn, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    one = placed.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("node").alias("a"), F.col("at").alias("at_a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    two = placed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    rest = one.join(two, ["key", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (F.col("root_a") != F.col("root_b")) & near("_a", "_b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = checkpoint(verified(rest.join(links, ["a", "b"], "left_anti"), sets, percent))
    if not more.take(1):
        return Links(roots, links, often, sets)
    links = links.unionByName(more)
    return Links(components(links), links, often, sets)


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `one` shares with each of `two`, summed over the fragments."""
    n, m = len(one), len(two)
    total = np.zeros((n, m))
    owner = np.repeat(np.arange(n + m), [len(h) for h in (*one, *two)])
    every = np.concatenate([*one, *two]) if owner.size else np.zeros(0, np.uint64)
    fragment = (every >> np.uint64(61)).astype(np.int8)
    for f in range(FRAGMENTS):
        mine = fragment == f
        _, column = np.unique(every[mine], return_inverse=True)
        row = owner[mine]
        left = row < n
        size_1, size_2 = (np.bincount(column[x], minlength=column.max(initial=-1) + 1) for x in (left, ~left))
        work = size_1 * size_2
        # Shingles of many pairs are multiplied as columns of 0 and 1, others counted pair by pair.
        wide = np.flatnonzero(work * 200 > n * m)
        for k in range(0, len(wide), 1024):
            place = np.full(len(work), -1)
            place[wide[k : k + 1024]] = np.arange(len(wide[k : k + 1024]))
            at = place[column]
            a, b = np.zeros((n, 1024), np.float32), np.zeros((m, 1024), np.float32)
            a[row[left & (at >= 0)], at[left & (at >= 0)]] = 1
            b[row[~left & (at >= 0)] - n, at[~left & (at >= 0)]] = 1
            total += a @ b.T
        work[wide] = 0
        a, b = np.flatnonzero(left & (work[column] > 0)), np.flatnonzero(~left & (work[column] > 0))
        b = b[np.argsort(column[b], kind="stable")]
        first, times = np.searchsorted(column[b], column[a]), size_2[column[a]]
        up_to = np.cumsum(times)
        at = 0
        while at < len(a):  # some 4 million pairs at a time
            to = max(at + 1, int(np.searchsorted(up_to, (up_to[at - 1] if at else 0) + (4 << 20), "right")))
            t = times[at:to]
            inside = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            pair = np.repeat(row[a[at:to]], t) * m + row[b[np.repeat(first[at:to], t) + inside]] - n
            total += np.bincount(pair, minlength=n * m).reshape(n, m)
            at = to
    return total.astype(np.int64)


def counted(members: DataFrame, percent: int) -> DataFrame:
    """node, n: how many rows the links of a node reach within its root. members: root, node, size (rows
    of the set), shingles."""
    blocks = members.groupBy("root").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.octet_length("shingles")).alias("_bytes")).filter("_m > 1")
    blocks = blocks.select("root", F.greatest(F.ceil(F.col("_m") / BLOCK_SETS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), "node", "size", "shingles")

    def count(group):
        import pandas as pd  # here only, as it takes memory in every worker that loads it

        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        node, size = group["node"].to_numpy(), group["size"].to_numpy()
        n = np.array([len(h) for h in sets])
        one = np.flatnonzero(group["first"].to_numpy())
        alone = bool(group["i"].iloc[0] == group["j"].iloc[0])
        two = one if alone else np.flatnonzero(~group["first"].to_numpy())
        met = (100 + percent) * overlaps([sets[k] for k in one], [sets[k] for k in two]) >= percent * (n[one][:, None] + n[two][None, :])
        if alone:
            np.fill_diagonal(met, False)
            return pd.DataFrame({"node": node[one], "n": met @ size[two]})
        return pd.DataFrame({"node": np.concatenate([node[one], node[two]]), "n": np.concatenate([met @ size[two], met.T @ size[one]])})

    return dealt.groupBy("root", "i", "j").applyInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def reached(found: Links, sizes: DataFrame, percent: int) -> DataFrame:
    """node, n: how many rows of other sets are linked with a node. sizes: node, size."""
    mark = found.often.withColumn("_often", F.lit(True))
    pairs = found.pairs
    for side in "ab":
        pairs = pairs.join(mark.select(F.col("node").alias(side), F.col("_often").alias(f"_{side}")), side, "left")
    pairs = checkpoint(pairs.filter("_a is null or _b is null").select("a", "b"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    single = ends.join(sizes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("n"))
    placed = found.often.join(found.roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("root").count().filter("count > 1").select("root")
    placed = checkpoint(placed.join(several, "root", "left_semi").join(sizes, "node"))
    sets = found.sets.select("node", "shingles").join(size_checked(placed, placed.count(), FEW_IDS), "node")
    return single.unionByName(counted(sets, percent)).groupBy("node").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Classes:
    rows: DataFrame  # doc_id, n_shingles, set_key, _plain (whether the id is this row's alone)
    table: DataFrame  # set_key, node, least (smallest doc_id), size (rows)
    first: DataFrame  # node, text: one document of each class
    repeated: DataFrame  # doc_id that several rows have
    n_repeated: int
    nameless: int  # rows without a doc_id


def classes(texts: DataFrame, width: int) -> Classes:
    """Classes of equal sets among texts (doc_id, text). A class goes by the id of one of its rows,
    or by a hash of the set, far below any id, where all its ids are null or repeated."""
    rows = checkpoint(keyed(texts, width))
    repeated = checkpoint(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n_repeated = repeated.count()
    again = size_checked(repeated.withColumn("_again", F.lit(True)), n_repeated, FEW_IDS)
    rows = rows.join(again, "doc_id", "left").select("doc_id", "n_shingles", "set_key", (F.col("doc_id").isNotNull() & F.col("_again").isNull()).alias("_plain"))
    table = rows.filter("set_key is not null").groupBy("set_key").agg(F.min(F.when(F.col("_plain"), F.col("doc_id"))).alias("own"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    by_hash = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("set_key"), F.lit(1 << 61))
    table = checkpoint(table.withColumn("node", F.coalesce("own", by_hash)))
    out = rows.filter("_plain").select("doc_id").join(table.select(F.col("own").alias("doc_id")), "doc_id", "left_anti")
    out = checkpoint(out.unionByName(repeated))
    first = texts.filter("doc_id is not null").join(size_checked(out, out.count(), FEW_IDS), "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "text")
    nameless, unnamed = rows.filter("doc_id is null").count(), table.filter("own is null")
    if n_unnamed := unnamed.count():
        odd = texts.filter("doc_id is null").unionByName(texts.join(size_checked(repeated, n_repeated, FEW_IDS), "doc_id", "left_semi"))
        odd = keyed(odd.select("text", F.col("text").alias("_text")), width).join(size_checked(unnamed.select("set_key", "node"), n_unnamed, FEW_IDS), "set_key")
        first = first.unionByName(checkpoint(odd.groupBy("node").agg(F.any_value("_text").alias("text"))))
    return Classes(rows, table.drop("own"), first, repeated, n_repeated, nameless)


def grouped(known: Classes, found: Links) -> DataFrame:
    """set_key, node, least, size and _root (of the component) of each class."""
    return known.table.join(found.roots, "node", "left").withColumn("_root", F.coalesce("root", "node")).drop("root")


def join(docs: DataFrame, width: int, percent: int, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and, unless count_links
    is false, n_links (how many other rows are linked with this one) of every row."""
    known = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    found = linked(known.first, width, percent)
    named = grouped(known, found)
    named = named.join(named.groupBy("_root").agg(F.min("least").alias("component_id")), "_root")
    if count_links:
        named = named.join(reached(found, known.table.select("node", "size"), percent), "node", "left")
        named = named.withColumn("n_links", F.col("size") - 1 + F.coalesce("n", F.lit(0)))
    names = ["component_id", "n_links"][: 1 + count_links]
    out = join_hot(known.rows, checkpoint(named.select("set_key", "size", *names)), "set_key")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names[1:]])


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, of several such rows any one.

    Rows without words stay. All columns are passed on, whatever their names.
    """
    known = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    found = linked(known.first, width, percent)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set_key")).alias("best")
    stay = checkpoint(grouped(known, found).groupBy("_root").agg(best).select("best.set_key", "best.least"))
    gone = known.rows.filter("_plain and set_key is not null").select("doc_id").join(stay.select(F.col("least").alias("doc_id")), "doc_id", "left_anti")
    gone = checkpoint(gone.unionByName(known.repeated))
    out = docs.filter("doc_id is not null").join(size_checked(gone, gone.count(), FEW_IDS), "doc_id", "left_anti").select(*docs.columns)
    if known.n_repeated or known.nameless:
        odd = docs.filter("doc_id is null").unionByName(docs.join(size_checked(known.repeated, known.n_repeated, FEW_IDS), "doc_id", "left_semi").select(*docs.columns))
        odd = checkpoint(keyed(odd.select(F.struct(*docs.columns).alias("row"), "text"), width))
        met = odd.filter("set_key is not null").join(stay, "set_key").filter(F.col("row.doc_id").cast("long").eqNullSafe(F.col("least")))
        met = met.groupBy("set_key").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
        out = out.unionByName(odd.filter("set_key is null").select("row").unionByName(met).select("row.*"))
    return out


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components and numbers of links of documents with 3-word shingle sets of Jaccard similarity 0.9 or more."""
    return join(documents(spark, sf_dir), 3, 90)


#: Links by a join on shingles and closure by recursion: fit for small tables.
SQL = """
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
k as (select a as doc_id, count(*) as n_links from e group by 1),
r(doc_id, reached) as (select doc_id, doc_id from d union select r.doc_id, b from r join e on r.reached = e.a)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(reached) as component_id, coalesce(any_value(n_links), 0) as n_links
from r left join n using (doc_id) left join k using (doc_id) group by r.doc_id"""
