"""Near-duplicate vectors by lattice hashing: E8 cells of random projections, neighbouring cells probed, cosine verified.

Every table projects a unit vector to eight dimensions at random, divides by ``width`` and decodes the result to the
nearest point of the lattice E8; ``points`` such lattice points make one cell. A vector lies in its own cell and also
probes the neighbouring cells (those one of the 240 shortest lattice vectors away) that are nearest to its projection.
Two vectors that meet, one of them at home, are candidates if sign sketches of 128 bits do not rule them out; then
their cosine decides in double precision.

Groups of copies are not expanded. Equal vectors are one entry. Entries in the same cell of the first table that lie
within half the threshold's angle of that cell's first entry form a ball: all of them link with each other by the
triangle inequality. Balls meet as one row a cell; a pair of balls is linked or parted as a whole where their
angles and radii allow it, and compared member by member, in blocks, where they do not.

Defined cases. A vector that is null, empty, zero or holds a null or non-finite component links with nothing and is
its own component. A shorter vector counts as padded by zeros. Rows that repeat an id are vectors of their own; a null
id is larger than every other. Empty input gives no rows. Columns other than id and vector are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations, product
from math import acos, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import per_batch, staged
from tidewell.llm.components import connected_components

#: Cosine from which two vectors link.
THRESHOLD = 0.95
#: Members of a ball that are compared with another block at a time.
BLOCK = 256
#: Angles closer than this to a limit are not decided by it, but by the cosine itself.
SLACK = 1e-6
SKETCH_BITS = 128


@dataclass(frozen=True)
class Hashing:
    """Measured on pairs at cosine 0.95: one table of ``width`` 1.2 and 4 probes brings 66 % of them together."""

    tables: int = 6
    points: int = 1
    probes: int = 4
    width: float = 1.2
    #: Of 128 sign bits, as many may differ. Leaders of linked balls are at most 36 degrees apart: 26 bits on average.
    sketch_distance: int = 44
    seed: int = 20_240_611


def hashing_for(rows: int) -> Hashing:
    """Hashing whose cells stay small: a further lattice point a cell for each factor 10,000 in rows.

    More points need more tables and probes, and wider cells, for the same recall: each of the three forms brings 99 % of
    the pairs at cosine 0.95 together. Unrelated pairs share a home cell of a table once in 8,000, 3 million and
    200 million times.
    """
    points = min(3, max(1, round(log(max(rows, 1), 10_000))))
    return (Hashing(), Hashing(9, 2, 8, 1.5), Hashing(16, 3, 16, 1.7))[points - 1]


# --- the lattice --------------------------------------------------------------------------------
@cache
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, in doubled coordinates."""
    pairs = [
        [2 * s if k == i else 2 * t if k == j else 0 for k in range(8)]
        for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)
    ]
    halves = [signs for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(pairs + [list(h) for h in halves], np.int64)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: where the sum is odd, the worst coordinate rounds the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points in doubled coordinates: the better of the even integers and their copy shifted by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


@cache
def _directions(length: int, hashing: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections, offsets and sketch normals; those of a shorter vector are a part of those of a longer one."""
    rng = np.random.default_rng(hashing.seed)
    width = 8 * hashing.points * hashing.tables
    offsets = rng.uniform(0, 2, width)
    drawn = rng.normal(size=(length, width + SKETCH_BITS))
    return drawn[:, :width] / hashing.width, offsets, drawn[:, width:]


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit number for each row of lattice coordinates."""
    total = np.full(codes.shape[:-1], np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    for k in range(codes.shape[-1]):
        total = (total ^ codes[..., k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def cells(units: np.ndarray, hashing: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) home cells and (rows, tables * probes) probed cells of unit vectors."""
    project, offsets, _ = _directions(units.shape[1], hashing)
    at = (units @ project + offsets).reshape(len(units), hashing.tables, hashing.points, 8)
    steps = shortest_vectors()
    homes, probed = [], []
    for table in range(hashing.tables):
        own, moves, costs = [], [], []
        for p in range(hashing.points):
            x = at[:, table, p]
            home = decode(x)
            # by how much the squared distance grows when the point moves by a shortest vector
            growth = 2.0 - (x - home / 2) @ steps.T
            near = np.argpartition(growth, hashing.probes - 1, axis=1)[:, : hashing.probes]
            own.append(home)
            moves.append(near)
            costs.append(np.take_along_axis(growth, near, axis=1))
        flat = np.concatenate(own, axis=1)
        homes.append(_mixed(flat, table + 1))
        # of the moves of any of the cell's points, the cheapest
        cost, move = np.concatenate(costs, axis=1), np.concatenate(moves, axis=1)
        best = np.argpartition(cost, hashing.probes - 1, axis=1)[:, : hashing.probes]
        moved = np.repeat(flat[:, None, :], hashing.probes, axis=1)
        point, step = best // hashing.probes, steps[np.take_along_axis(move, best, axis=1)]
        for p in range(hashing.points):
            moved[:, :, 8 * p : 8 * p + 8] += np.where((point == p)[..., None], step, 0)
        probed.append(_mixed(moved, table + 1))
    return np.stack(homes, axis=1), np.concatenate(probed, axis=1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as unit rows in double precision, shorter ones padded by zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max())
    if (lengths == width).all():
        out = flat.reshape(len(lengths), width).copy()
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = flat
    out /= np.abs(out).max(axis=1)[:, None]  # keeps squares in range
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = _matrix(a), _matrix(b)
    width = min(x.shape[1], y.shape[1])
    return (x[:, :width] * y[:, :width]).sum(axis=1)


# --- entries and balls --------------------------------------------------------------------------
def _usable(vector: str):
    """Not null, not empty, not zero, every component a finite number."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def hash_entries(entries: DataFrame, hashing: Hashing) -> DataFrame:
    """Adds ``homes``, ``probed`` and a sketch of two longs to rows (entry, copies, first_id, vector)."""

    def work(columns: dict[str, pa.Array]) -> dict:
        units = _matrix(columns["vector"])
        homes, probed = cells(units, hashing)
        signs = np.packbits(units @ _directions(units.shape[1], hashing)[2] > 0, axis=1).view(np.int64)
        return columns | {
            "homes": pa.array(list(homes)), "probed": pa.array(list(probed)), "sketch0": pa.array(signs[:, 0].copy()),
            "sketch1": pa.array(signs[:, 1].copy()),
        }

    schema = f"{_ddl(entries)}, homes array<long>, probed array<long>, sketch0 long, sketch1 long"
    return per_batch(entries, work, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def form_balls(hashed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``ball`` (an entry) and ``angle`` (to it); the sketch becomes the ball's.

    The leader of a cell of the first table is its first entry; entries within half the threshold's angle join it.
    """
    reach = acos(threshold) / 2 - SLACK
    home = F.col("homes")[0]
    firsts = hashed.groupBy(home.alias("cell")).agg(F.min("entry").alias("ball"), F.count("*").alias("n")).filter("n > 1")
    leaders = firsts.join(hashed, F.col("ball") == F.col("entry")).select(
        "cell", "ball", F.col("vector").alias("leader"), F.col("sketch0").alias("ball0"), F.col("sketch1").alias("ball1")
    )
    near = hashed.withColumn("cell", home).join(leaders, "cell", "left")

    def work(columns: dict[str, pa.Array]) -> dict:
        own, led = columns["vector"], columns["leader"]
        known = np.asarray(led.is_valid())
        angle = np.full(len(own), np.inf)
        if known.any():
            at = pa.array(np.flatnonzero(known))
            angle[known] = np.arccos(np.clip(_cosines(own.take(at), led.take(at)), -1.0, 1.0))
        inside = angle <= reach

        def chosen(a: str, b: str) -> np.ndarray:
            return np.where(inside, columns[a].fill_null(0).to_numpy(), columns[b].to_numpy())

        kept = ("entry", "copies", "first_id", "vector", "homes", "probed")
        return {c: columns[c] for c in kept} | {
            "ball": chosen("ball", "entry"), "angle": np.where(inside, angle, 0.0),
            "sketch0": chosen("ball0", "sketch0"), "sketch1": chosen("ball1", "sketch1"),
        }

    return per_batch(near, work, f"{_ddl(hashed)}, ball long, angle double")


def describe_balls(members: DataFrame) -> DataFrame:
    """(ball, radius, rows, members, first_id): one row per ball."""
    return members.groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("copies").alias("rows"), F.count("*").alias("members"),
        F.min("first_id").alias("first_id"),
    )


# --- candidates and their proof -----------------------------------------------------------------
def meet(members: DataFrame, hashing: Hashing) -> DataFrame:
    """Distinct pairs (a, b), a < b, of balls that meet in a cell where one of them is at home."""
    lists = F.array(
        F.struct(F.lit(True).alias("home"), F.col("homes").alias("cells")),
        F.struct(F.lit(False).alias("home"), F.col("probed").alias("cells")),
    )
    spread = members.select("ball", "sketch0", "sketch1", F.explode(lists).alias("x")).select(
        "ball", "sketch0", "sketch1", F.col("x.home").alias("home"), F.explode("x.cells").alias("cell")
    )
    present = spread.groupBy("cell", "ball", "sketch0", "sketch1").agg(F.max("home").alias("home"))
    mine, other = present.filter("home").alias("m"), present.alias("o")
    differ = F.bit_count(F.col("m.sketch0").bitwiseXOR(F.col("o.sketch0"))) + F.bit_count(
        F.col("m.sketch1").bitwiseXOR(F.col("o.sketch1"))
    )
    once = (F.col("m.ball") < F.col("o.ball")) | (~F.col("o.home") & (F.col("m.ball") != F.col("o.ball")))
    met = mine.join(other, (F.col("m.cell") == F.col("o.cell")) & once & (differ <= hashing.sketch_distance))
    return met.select(F.least("m.ball", "o.ball").alias("a"), F.greatest("m.ball", "o.ball").alias("b")).distinct()


def decide(pairs: DataFrame, members: DataFrame, balls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, whole): pairs linked as a whole, or (``whole`` false) to be compared member by member; others are parted."""
    limit = acos(threshold)
    full = balls.join(members.filter("entry = ball").select("ball", "vector"), "ball")
    side = lambda x: full.select(
        F.col("ball").alias(x), F.col("vector").alias(f"{x}_vector"), F.col("radius").alias(f"{x}_radius"),
        (F.col("members") == 1).alias(f"{x}_single"),
    )

    def work(columns: dict[str, pa.Array]) -> dict | None:
        cosine = _cosines(columns["a_vector"], columns["b_vector"])
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        spread = columns["a_radius"].to_numpy() + columns["b_radius"].to_numpy()
        single = np.asarray(columns["a_single"]) & np.asarray(columns["b_single"])
        whole = np.where(single, cosine >= threshold, angle + spread <= limit - SLACK)
        open_ = ~single & ~whole & (angle - spread <= limit + SLACK)
        at = np.flatnonzero(whole | open_)
        if not len(at):
            return None
        return {"a": columns["a"].take(pa.array(at)), "b": columns["b"].take(pa.array(at)), "whole": whole[at]}

    return per_batch(pairs.join(side("a"), "a").join(side("b"), "b"), work, "a long, b long, whole boolean")


def compare_members(open_pairs: DataFrame, members: DataFrame, balls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, entry, linked_rows) of pairs that angles and radii leave open, from the members' own cosines.

    Members are dealt by hash into blocks of about ``BLOCK``; blocks of the two balls meet pair by pair, and only
    counts leave a task.
    """
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    dealt = balls.join(wanted, "ball").select("ball", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    blocks = (
        members.join(dealt, "ball")
        .withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")))
        .groupBy("ball", "block")
        .agg(F.collect_list(F.struct("entry", "copies", "vector")).alias("held"))
    )
    side = lambda x: blocks.select(F.col("ball").alias(x), F.col("held").alias(f"{x}_held"))

    def work(columns: dict[str, pa.Array]) -> dict:
        out: dict[str, list] = {"a": [], "b": [], "entry": [], "linked_rows": []}
        for k in range(len(columns["a"])):
            held = [columns[f"{x}_held"][k].values for x in "ab"]
            units = [_matrix(h.field("vector")) for h in held]
            width = min(u.shape[1] for u in units)
            linked = units[0][:, :width] @ units[1][:, :width].T >= threshold
            counts = [h.field("copies").to_numpy() for h in held]
            for own, rows in ((0, linked @ counts[1]), (1, counts[0] @ linked)):
                some = np.flatnonzero(rows)
                out["entry"] += held[own].field("entry").to_numpy()[some].tolist()
                out["linked_rows"] += rows[some].tolist()
                out["a"] += [columns["a"][k].as_py()] * len(some)
                out["b"] += [columns["b"][k].as_py()] * len(some)
        return out

    met = open_pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return per_batch(met, work, "a long, b long, entry long, linked_rows long")


# --- the operator -------------------------------------------------------------------------------
def find_near_vectors(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    hashing: Hashing | None = None,
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    rows = staged(
        table.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
        .withColumn("vector", F.when(_usable("vector"), F.col("vector")))
        .withColumns({"h0": F.xxhash64("vector"), "h1": F.xxhash64(F.lit(1), "vector")}),
        "vectors",
    )
    usable = rows.filter(F.col("vector").isNotNull())
    alike = staged(
        usable.groupBy("h0", "h1").agg(
            F.min("row").alias("entry"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")
        ), "vector-copies",
    )
    hashing = hashing or hashing_for(alike.count())
    entries = alike.select("entry", "copies", "first_id").join(
        usable.select(F.col("row").alias("entry"), "vector"), "entry"
    )
    members = staged(form_balls(staged(hash_entries(entries, hashing), "vector-cells"), threshold), "vector-balls")
    balls = staged(describe_balls(members), "balls")
    decided = staged(decide(meet(members, hashing), members, balls, threshold), "ball-links")
    whole, open_pairs = decided.filter("whole"), decided.filter("not whole")
    compared = staged(compare_members(open_pairs, members, balls, threshold), "member-links")

    links = whole.select("a", "b").unionByName(compared.select("a", "b").distinct())
    classes = connected_components(links)
    component = balls.join(classes, balls.ball == classes.node, "left").withColumn(
        "component", F.coalesce("component", "ball")
    )
    names = component.groupBy("component").agg(F.min("first_id").alias("component_id"))
    around = whole.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(
        whole.select(F.col("b").alias("ball"), F.col("a").alias("other"))
    ).join(balls.select(F.col("ball").alias("other"), "rows"), "other").groupBy("ball").agg(F.sum("rows").alias("around"))
    per_ball = component.join(names, "component").join(around, "ball", "left").select(
        "ball", "component_id", (F.col("rows") - 1 + F.coalesce("around", F.lit(0))).alias("linked")
    )
    single = compared.groupBy("entry").agg(F.sum("linked_rows").alias("more"))
    per_entry = staged(
        alike.join(members.select("entry", "ball"), "entry").join(per_ball, "ball").join(single, "entry", "left").select(
            "h0", "h1", "component_id", (F.col("linked") + F.coalesce("more", F.lit(0))).alias("n_links")
        ), "vector-links",
    )
    found = rows.drop("row").join(per_entry, ["h0", "h1"], "left")
    lone = F.col("vector").isNull()
    return found.select(
        "vec_id", F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(lone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
