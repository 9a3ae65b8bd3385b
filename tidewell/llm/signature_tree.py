"""N-gram Jaccard join with signature trees: all links at a threshold, as components.

Routing. Two sets that link differ in at most ``d`` shingles, a number that follows from their sizes. Shingles are
dealt into more than ``d`` parts by their hash, so linked sets agree on whole parts; a part's content is a key, and
sets without a common key cannot link. Parts are counted per size class, and a set also goes into the next larger class
where a partner could be. Enough parts are added that those with fewer than two shingles need no key.

Trees. Sets that share a key form a group. Every set has a home, its largest group; home groups are the trees. A tree's
leaves hold sets with their bitmaps (shingles hashed to bits), its nodes the OR of the bitmaps below, the range of sizes
and the fewest bits. Two nodes are visited together only if the largest overlap their bitmaps and sizes allow reaches
the threshold; two leaves compare bitmaps, and what is left compares shingles exactly. Pairs that are already
connected are skipped: components are asked for, not pairs. A group beyond ``LEAVES`` sets is dealt into blocks, and
each pair of blocks is a task's tree pair. Pairs of a group whose sets share no home are few; each is a tree of two.

Equal sets are one set throughout, so copies never meet as pairs. Sets and shingles are 64-bit hashes.

Defined cases. Null, empty and wordless texts: no shingles, no links, each its own component. Fewer words than a
shingle: one shingle of all words. Repeated rows: one set. Null ids come after all others. Whole texts are read. Extra
columns are not looked at. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.components import connected_components
from tidewell.llm.common import staged
from tidewell.llm.shingles import mix, set_id, shingle_set

WORDS = 4
#: A pair links from this percentage on.
PERCENT = 85
#: Sets of one tree; larger groups are compared in pairs of blocks.
LEAVES = 1024
#: A group beyond this is always a home, so that pairs outside homes are looked for in small groups only.
LARGEST = 16_384
LEAF = 32
FANOUT = 8
#: Growth of size classes.
CLASS = 1.3
#: Slots of the bitmap that tells which sets have a partner: a broadcast of at most 1 MB.
SLOTS = 1 << 23


@cache
def _classes(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, one past the largest, parts) of each size class."""
    found, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, int(low * CLASS) + 1)
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        found.append((low, high, differ + 1 + _spare(differ)))
        low = high
    return found


def _spare(differ: int) -> int:
    """Parts beyond those that may differ: as many may go without a key."""
    return 0 if differ == 0 else 2 + differ // 6


def part_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of one set, in every size class in which a partner could look for it."""
    n = len(shingles)
    classes = _classes(percent)
    k = next(i for i, (low, high, _) in enumerate(classes) if low <= n < high)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(0xA24BAED4963EE407)))])
    found = []
    for own in (k, k + 1):
        low, high, parts = classes[own]
        if own != k and 100 * n < percent * low:
            break
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        edges = (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)) if parts > 1 else np.empty(0, np.uint64)
        cut = np.concatenate([[0], np.searchsorted(shingles, edges), [n]])
        held = np.diff(cut)
        light = held < 2
        # with no more light parts than spare ones, a partner agrees on a heavy part
        use = ~light if light.sum() <= parts - 1 - differ else np.ones(parts, bool)
        tag = (np.arange(parts, dtype=np.uint64) << np.uint64(8)) + np.uint64(own + 1)
        found.append(mix((sums[cut[1:]] - sums[cut[:-1]] + mix(tag))[use]))
    return np.concatenate(found).view(np.int64)


# ---- trees


class Tree:
    """Sets in leaves of ``LEAF``; per node the OR of bitmaps, the range of sizes and the fewest bits."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort(([s[0] for s in sets], self.sizes))
        self.sets = [sets[i] for i in self.order]
        self.sizes = self.sizes[self.order]
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.maps, self.sets, strict=True):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.held = np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        # levels[0] are the leaves; each entry: OR bitmap, smallest and largest size, fewest bits
        starts = np.arange(0, len(sets), LEAF)
        self.levels = [(
            np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.sizes, starts),
            np.maximum.reduceat(self.sizes, starts), np.minimum.reduceat(self.held, starts),
        )]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, held = self.levels[-1]
            starts = np.arange(0, len(maps), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.minimum.reduceat(held, starts),
            ))


def _bits(sets: list[np.ndarray]) -> int:
    return int(min(1 << 16, max(256, 1 << (8 * max(map(len, sets)) - 1).bit_length())))


class Forest:
    """Connected sets so far."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        up = self.parent[xs]
        while (up != self.parent[up]).any():
            up = self.parent[up]
        return up

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)


def _reaches(overlap: np.ndarray, low_a: np.ndarray, low_b: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of at least these sizes link with at most this overlap? union = a + b - overlap."""
    return (100 + percent) * overlap >= percent * (low_a + low_b)


def join_trees(a: Tree, b: Tree, at_a: np.ndarray, at_b: np.ndarray, forest: Forest, percent: int = PERCENT) -> None:
    """Visit node pairs of two trees (or of one with itself) from the roots; link sets in ``forest``."""
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            _join_leaves(a, b, i, j, at_a, at_b, forest, percent, same)
            continue
        # open the taller node; children that cannot link go
        kids_a = range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][0]))) if la >= lb and la else (i,)
        kids_b = range(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][0]))) if lb >= la and lb else (j,)
        down_a, down_b = (la - 1 if la >= lb and la else la), (lb - 1 if lb >= la and lb else lb)
        ka, kb = np.array(kids_a), np.array(kids_b)
        maps_a, low_a, high_a, held_a = (x[ka] for x in a.levels[down_a])
        maps_b, low_b, high_b, held_b = (x[kb] for x in b.levels[down_b])
        common = np.bitwise_count(maps_a[:, None] & maps_b[None]).sum(axis=2, dtype=np.int64)
        most = np.minimum(
            high_a[:, None] - np.maximum(0, held_a[:, None] - common), high_b[None] - np.maximum(0, held_b[None] - common)
        )
        fits = _reaches(most, low_a[:, None], low_b[None], percent)
        fits &= (100 * high_a[:, None] >= percent * low_b[None]) & (100 * high_b[None] >= percent * low_a[:, None])
        for x, y in zip(*np.nonzero(fits), strict=True):
            if not (same and down_a == down_b and ka[x] > kb[y]):
                stack.append((down_a, int(ka[x]), down_b, int(kb[y])))


def _join_leaves(a, b, i, j, at_a, at_b, forest, percent, same) -> None:
    xs = np.arange(i * LEAF, min((i + 1) * LEAF, len(a.sets)))
    ys = np.arange(j * LEAF, min((j + 1) * LEAF, len(b.sets)))
    common = np.bitwise_count(a.maps[xs][:, None] & b.maps[ys][None]).sum(axis=2, dtype=np.int64)
    # a bit of one set that the other lacks is a shingle the other lacks
    most = np.minimum(
        a.sizes[xs][:, None] - a.held[xs][:, None] + common, b.sizes[ys][None] - b.held[ys][None] + common
    )
    fits = _reaches(most, a.sizes[xs][:, None], b.sizes[ys][None], percent)
    ids_a, ids_b = at_a[a.order[xs]], at_b[b.order[ys]]
    fits &= forest.roots(ids_a)[:, None] != forest.roots(ids_b)[None]
    if same and i == j:
        fits &= xs[:, None] < ys[None]
    pairs = np.argwhere(fits)
    pairs = pairs[np.argsort(-most[fits], kind="stable")]  # likely links first: they spare later pairs
    for x, y in pairs:
        if forest.root(ids_a[x]) != forest.root(ids_b[y]):
            s, t = a.sets[xs[x]], b.sets[ys[y]]
            both = np.concatenate([s, t])
            both.sort()
            overlap = int((both[1:] == both[:-1]).sum())
            if 100 * overlap >= percent * (len(s) + len(t) - overlap):
                forest.link(int(ids_a[x]), int(ids_b[y]))


def link_sets(sets: list[np.ndarray], sides: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """For each set the first set it is connected with. With ``sides``, only pairs of side 0 with side 1 are visited."""
    forest, bits = Forest(len(sets)), _bits(sets)
    if sides is None:
        tree, at = Tree(sets, bits), np.arange(len(sets))
        join_trees(tree, tree, at, at, forest, percent)
    else:
        at = [np.flatnonzero(sides == k) for k in (0, 1)]
        if len(at[0]) and len(at[1]):
            trees = [Tree([sets[i] for i in x], bits) for x in at]
            join_trees(*trees, *at, forest, percent)
    return forest.roots(np.arange(len(sets)))


# ---- Spark


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _by_key(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[pa.Table | pa.ChunkedArray]]:
    """Batches cut so that no key (first column, sorted) spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and keys[0] != held[-1].column(0)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, n, sid) per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
            ], names=["doc_id", "n", "sid"])

    return rows.mapInArrow(run, "doc_id long, n long, sid long")


def _each_set(docs: DataFrame, text: str, words: int, make, schema: str) -> DataFrame:
    """``make(sids, sets, texts)`` once per set and task."""
    rows = docs.select(F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).to_pylist()
                sids, sets, kept = [], [], []
                for x in texts:
                    s = shingle_set(x, words)
                    if len(s) and (sid := set_id(s)) not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        sets.append(s)
                        kept.append(x)
                if sids:
                    yield make(sids, sets, kept)

    return rows.mapInArrow(run, schema)


def shared_groups(docs: DataFrame, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(gid, members): the distinct groups of at least two sets that share a key."""

    def keyed(sids, sets, _) -> pa.RecordBatch:
        keys = [part_keys(s, percent) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), [len(k) for k in keys]))],
            names=["key", "sid"],
        )

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table in _by_key(batches, 2):
            keys, sids = (table.column(i).to_numpy() for i in (0, 1))
            new = np.append(True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]))
            keys, sids = keys[new], sids[new]
            cut = _runs(keys)
            many = np.flatnonzero(np.diff(cut) > 1)
            if not len(many):
                continue
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sids.view(np.uint64) + np.uint64(1)))])
            gids = mix(sums[cut[many + 1]] - sums[cut[many]]).view(np.int64)
            gid, first = np.unique(gids, return_index=True)
            fresh = [k for k, g in zip(first, gid.tolist(), strict=True) if g not in seen]
            if len(seen) < 1 << 20:
                seen.update(gid.tolist())
            if fresh:
                own = many[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gids[fresh]), pa.array([sids[cut[g] : cut[g + 1]] for g in own], pa.list_(pa.int64()))],
                    names=["gid", "members"],
                )

    keys = _each_set(docs, text, words, keyed, "key long, sid long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "sid")
    return sorted_keys.mapInArrow(grouped, "gid long, members array<long>").dropDuplicates(["gid"])


def _outside_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group whose sets share no home."""
    for table in _by_key(batches, 3):
        gids, sids, homes = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_pylist()
        cut = _runs(gids)
        pairs = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            by_homes: dict[tuple, list[int]] = {}
            for k in range(a, b):
                by_homes.setdefault(tuple(homes[k]), []).append(int(sids[k]))
            kinds = [(frozenset(h), np.array(s, np.int64)) for h, s in by_homes.items()]
            for x in range(len(kinds)):
                for y in range(x):
                    if kinds[x][0].isdisjoint(kinds[y][0]):
                        left, right = np.meshgrid(kinds[x][1], kinds[y][1])
                        pairs.append(np.stack([np.minimum(left, right).ravel(), np.maximum(left, right).ravel()], axis=1))
        if pairs:
            found = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def tree_members(groups: DataFrame) -> DataFrame:
    """(tree, side, sid): the sets of each tree; ``side`` is 2 but where two blocks are compared."""
    sizes = groups.select("gid", F.size("members").alias("n"), "members")
    rows = sizes.select("gid", "n", F.explode("members").alias("sid"))
    home = rows.groupBy("sid").agg(F.max(F.struct("n", "gid"))["gid"].alias("gid"))
    homes = home.select("gid").unionByName(sizes.filter(F.col("n") > LARGEST).select("gid")).distinct()
    inside = staged(rows.join(homes, "gid", "left_semi"), "trees")
    lists = inside.groupBy("sid").agg(F.array_sort(F.collect_list("gid")).alias("homes"))
    rest = rows.join(homes, "gid", "left_anti").join(lists, "sid").select("gid", "sid", "homes")
    pairs = (
        rest.repartition("gid").sortWithinPartitions("gid").mapInArrow(_outside_homes, "a long, b long").distinct()
    )
    blocks = F.ceil(F.col("n") / LEAVES)
    own = F.pmod(F.xxhash64("sid"), blocks)
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    small = inside.filter(F.col("n") <= LEAVES).select(F.col("gid").alias("tree"), F.lit(2).alias("side"), "sid")
    large = (
        inside.filter(F.col("n") > LEAVES).select("gid", "sid", own.alias("own"), other.alias("other"))
        .select(
            F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other")).alias("tree"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "sid",
        )
    )
    two = pairs.select(F.xxhash64("a", "b").alias("tree"), F.lit(2).alias("side"), F.explode(F.array("a", "b")).alias("sid"))
    return small.unionByName(large).unionByName(two)


def find_links(docs: DataFrame, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of sets: enough links to connect every component, each of them verified."""
    spark = docs.sparkSession
    groups = staged(shared_groups(docs, text, words, percent), "groups")
    members = staged(tree_members(groups), "tree-members")
    slots = np.zeros(SLOTS // 8, np.uint8)
    for row in members.select(F.pmod("sid", F.lit(SLOTS)).cast("int").alias("s")).groupBy(
        F.shiftright("s", 11).alias("word")).agg(F.collect_set(F.col("s").bitwiseAND(2047)).alias("bits")).toLocalIterator():
        at = np.array(row["bits"], np.int64) + (row["word"] << 11)
        np.bitwise_or.at(slots, at >> 3, (1 << (at & 7)).astype(np.uint8))
    partnered = spark.sparkContext.broadcast(slots)

    def with_partner(sids, _, texts) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor().compress  # texts are what is shuffled most
        s = np.array(sids, np.int64)
        at = s % SLOTS
        keep = np.flatnonzero(partnered.value[at >> 3] >> (at & 7) & 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(s[keep]), pa.array([pack(texts[k]) for k in keep], pa.binary())], names=["sid", "text"]
        )

    texts = _each_set(docs, text, words, with_partner, "sid long, text binary").dropDuplicates(["sid"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for table in _by_key(batches, 4):
            trees, sides, sids = (table.column(i).to_numpy() for i in (0, 1, 2))
            data = table.column(3)
            cut = _runs(trees)
            a, b = [], []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                sets = [shingle_set(unpack(t.as_py()), words) for t in data.slice(x, y - x)]
                own = sides[x:y]
                roots = link_sets(sets, None if own[0] == 2 else own, percent)
                moved = np.flatnonzero(roots != np.arange(len(roots)))
                a.append(sids[x + roots[moved]])
                b.append(sids[x + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = members.join(texts, "sid").select("tree", "side", "sid", "text")
    return rows.repartition("tree").sortWithinPartitions("tree").mapInArrow(linked, "a long, b long")


def join_near(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """Per row: doc_id, n_shingles, sid (its set), component_id (smallest id of its component)."""
    sets = staged(shingle_sets(docs, doc_id, text, words), "sets")
    nodes = staged(connected_components(find_links(docs, text, words, percent)), "components")
    classes = sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id"))
    named = classes.join(nodes.withColumnRenamed("node", "sid"), "sid")
    least = named.groupBy("component").agg(F.min("first_id").alias("least"))
    by_set = classes.join(
        named.join(least, "component").select("sid", F.col("least").alias("joined")), "sid", "left"
    ).select("sid", F.coalesce("joined", "first_id").alias("component_id"))
    return sets.join(by_set, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "sid", F.coalesce("component_id", "doc_id").alias("component_id")
    )
