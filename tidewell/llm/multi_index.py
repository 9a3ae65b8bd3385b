"""Hard negatives for anchors by an inverted multi-index with certified windows; all scores are exact integers.

Components become ``floor(scale * x)``. Each half of a vector has a codebook; a row's two nearest codewords are its
cell. Cells lie on shelves of bounded size (a crowded cell is dealt over several), and one task holds one shelf. An
anchor is sent to the shelves that its bounds cannot rule out. There a multi-sequence heap visits the cells in falling
order of the summed half-score bounds ``q.c + |q| r`` (``r`` is the largest distance of the shelf's rows from that
codeword), and stops once no cell left can change the wanted windows.

Positives come first: each anchor asks its most promising shelf, and what it finds there is the least score that the
other shelves must be able to beat. Then negatives: every positive's window of scores is kept separately, and the walk
stops below the worst score still of use. What shelves return is at most the window's length, and merged in Spark.

Defined cases. Rows without id, label or vector, with an empty vector, or with a component that is null or not finite
(also after scaling) take no part. A shorter vector counts as padded by zeros. Rows that repeat an id are rows of their own.
Equal scores come in the order of ids. A score must fit 64 bits. Empty input gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.llm.common import per_batch, staged

#: Rows of the sample that codebooks are fitted on; those with the smallest hashes of their ids.
SAMPLE = 4_096
#: Codewords of a half at most, so cells are at most 4,096.
MAX_CODES = 64
#: Rows of a shelf at most: 64 MB at 64 components.
SHELF_ROWS = 131_072
#: Rows scored at a time.
STRIDE = 4_096
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and, per shelf, the codewords it holds with their radii; size bounded by the cells."""

    width: int
    codes: tuple[np.ndarray, np.ndarray]
    first_shelf: np.ndarray  # by cell
    parts: np.ndarray  # by cell
    shelves: int
    shelf_codes: tuple[list[np.ndarray], list[np.ndarray]]
    shelf_radii: tuple[list[np.ndarray], list[np.ndarray]]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = (self.width + 1) // 2
        return x[..., :cut], x[..., cut:]

    def shelf_bounds(self, q: np.ndarray) -> np.ndarray:
        """(anchors, shelves): no row of the shelf scores higher."""
        bounds = np.zeros((len(q), self.shelves))
        for half, part in enumerate(self.halves(q)):
            scores = part @ self.codes[half].T
            length = np.sqrt((part * part).sum(axis=1))
            for s in range(self.shelves):
                at, radii = self.shelf_codes[half][s], self.shelf_radii[half][s]
                if len(at):
                    bounds[:, s] += (scores[:, at] + length[:, None] * radii).max(axis=1)
        return bounds * (1 + 1e-9 * np.sign(bounds)) + 1e-3


# --- vectors ------------------------------------------------------------------------------------
def _scaled(vectors: pa.Array, scale: float) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Floor of the scaled components as bytes, two each if they fit and else eight; whether they are wide; whether finite."""
    out, wide, good = [], [], []
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.floor(flat * scale)
    finite = np.isfinite(flat)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        x = flat[a:b]
        good.append(bool(finite[a:b].all()))
        wide.append(bool(good[-1] and np.abs(x).max() > 32_767))
        out.append(x.astype("<f8" if wide[-1] else "<i2").tobytes() if good[-1] else b"")
    return pa.array(out, pa.binary()), pa.array(wide), pa.array(good)


def unpack(packed: pa.Array, wide: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles, padded by zeros."""
    out = np.zeros((len(packed), width))
    flags = np.asarray(wide)
    for flag, kind, size in ((False, "<i2", 2), (True, "<f8", 8)):
        at = np.flatnonzero(flags == flag)
        if len(at):
            some = packed.take(pa.array(at))
            lengths = np.diff(np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]) // size
            flat = np.frombuffer(b"".join(some.to_pylist()), kind)
            block = np.zeros((len(at), width))
            block[np.arange(width) < lengths[:, None]] = flat
            out[at] = block
    return out


def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact: wider numbers where doubles could not hold a sum."""
    if len(rows) and np.abs(rows).max() * np.abs(q).max() * len(q) >= _EXACT:
        return (rows.astype(np.longdouble) * q.astype(np.longdouble)).sum(axis=1)
    return rows @ q


def prepare(table: DataFrame, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """(row, vec_id, label, v, wide, width) of the rows that take part."""
    x = F.col("x")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    usable = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"), F.col(vector).alias("x"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(x) > 0) & finite, F.lit(False)))

    def work(columns: dict[str, pa.Array]) -> dict:
        packed, wide, good = _scaled(columns["x"], scale)
        return {c: columns[c] for c in ("row", "vec_id", "label")} | {
            "v": packed, "wide": wide, "good": good, "width": columns["x"].value_lengths(),
        }

    made = per_batch(usable, work, "row long, vec_id long, label long, v binary, wide boolean, good boolean, width int")
    return staged(made.filter("good").drop("good"), "multi-rows")


# --- the index ----------------------------------------------------------------------------------
def _codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """k-means, started from evenly spaced distinct points; a codeword without points stays where it is."""
    if not points.shape[1]:  # the second half of vectors with one component
        return np.zeros((1, 0))
    start = np.unique(points, axis=0)
    centre = start[np.linspace(0, len(start) - 1, min(codes, len(start))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centre)
        count = np.bincount(nearest, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, nearest, points)
        centre[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centre


def _nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(axis=1) - 2 * points @ centre.T).argmin(axis=1)


def build_index(rows: DataFrame, shelf_rows: int | None = None) -> tuple[Index, DataFrame]:
    """The index and the rows with ``shelf``, their codewords and distances from them."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max("width")).first()
    width = width or 1
    sample = rows.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("v", "wide").toArrow()
    points = unpack(sample["v"].combine_chunks(), sample["wide"].combine_chunks(), width) if n else np.zeros((1, width))
    codes = min(MAX_CODES, max(2, round(n ** 0.25)))
    cut = (width + 1) // 2
    books = (_codebook(points[:, :cut], codes), _codebook(points[:, cut:], codes))

    def place(columns: dict[str, pa.Array]) -> dict:
        x = unpack(columns["v"], columns["wide"], width)
        found = {}
        for half, part in enumerate((x[:, :cut], x[:, cut:])):
            near = _nearest(part, books[half])
            gap = part - books[half][near]
            found |= {f"code{half}": near, f"gap{half}": np.sqrt((gap * gap).sum(axis=1))}
        return {c: columns[c] for c in ("row", "vec_id", "label", "v", "wide")} | found

    placed = staged(per_batch(
        rows, place, "row long, vec_id long, label long, v binary, wide boolean, code0 int, gap0 double, code1 int, gap1 double"
    ), "multi-cells")
    cell = (F.col("code0") * MAX_CODES + F.col("code1")).alias("cell")
    counted = {r.cell: r.n for r in placed.groupBy(cell).agg(F.count("*").alias("n")).collect()}  # at most 4,096 rows
    size = shelf_rows or min(SHELF_ROWS, max(512, -(-n // (3 * spark.sparkContext.defaultParallelism))))
    first, parts = np.zeros(MAX_CODES * MAX_CODES, np.int64), np.ones(MAX_CODES * MAX_CODES, np.int64)
    shelf, room = 0, size
    for c in sorted(counted):
        if counted[c] > room:
            shelf, room = shelf + (room < size), size
        first[c], parts[c] = shelf, -(-counted[c] // size)
        if parts[c] > 1:
            shelf, room = shelf + int(parts[c]), size
        else:
            room -= counted[c]
    shelves = int((first + parts).max())
    where = spark.createDataFrame(
        [(int(c), int(first[c]), int(parts[c])) for c in sorted(counted)], "cell int, first_shelf int, parts int"
    )
    on_shelf = staged(
        placed.withColumn("cell", cell).join(F.broadcast(where), "cell").withColumn(
            "shelf", (F.col("first_shelf") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
        ).drop("first_shelf", "parts", "cell"), "multi-shelves",
    )
    held: tuple[dict, dict] = ({}, {})
    for half in (0, 1):  # at most 64 codewords a shelf
        for r in on_shelf.groupBy("shelf", f"code{half}").agg(F.max(f"gap{half}").alias("r")).collect():
            held[half].setdefault(r[0], []).append((r[1], r[2]))
    side = lambda half, k, kind: [
        np.array([x[k] for x in sorted(held[half].get(s, []))], kind) for s in range(shelves)
    ]
    index = Index(
        width, books, first, parts, shelves, (side(0, 0, np.int64), side(1, 0, np.int64)),
        (side(0, 1, float), side(1, 1, float)),
    )
    return index, on_shelf


# --- one shelf ----------------------------------------------------------------------------------
class Shelf:
    """Rows of one shelf in memory, cell by cell."""

    def __init__(self, index: Index, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        column = lambda c: table[c].combine_chunks()
        code = [column(f"code{h}").to_numpy() for h in (0, 1)]
        order = np.lexsort((code[1], code[0]))
        code = [c[order] for c in code]
        self.index = index
        self.rows = unpack(column("v"), column("wide"), index.width)[order]
        self.row, self.ids, self.label = (column(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
        gaps = [column(f"gap{h}").to_numpy()[order] for h in (0, 1)]
        self.used, self.radii = [], []
        for h in (0, 1):
            used, at = np.unique(code[h], return_inverse=True)
            radius = np.zeros(len(used))
            np.maximum.at(radius, at, gaps[h])
            self.used.append(used)
            self.radii.append(radius)
            code[h] = at
        flat = code[0] * len(self.used[1]) + code[1]
        edges = np.flatnonzero(np.diff(flat, prepend=-1))
        self.place = {int(f): (int(a), int(b)) for f, a, b in zip(flat[edges], edges, [*edges[1:], len(flat)], strict=True)}

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, end) of the cells, by falling bound: the multi-sequence walk over both sorted halves."""
        bounds, order = [], []
        for h, part in enumerate(self.index.halves(q)):
            b = self.index.codes[h][self.used[h]] @ part + np.sqrt(part @ part) * self.radii[h]
            order.append(np.argsort(-b))
            bounds.append(b[order[h]])
        a, b = bounds[0].tolist(), bounds[1].tolist()
        at, width = [o.tolist() for o in order], len(bounds[1])
        slack = 1e-9 * (abs(a[0]) + abs(b[0]) + abs(a[-1]) + abs(b[-1])) + 1e-3
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            if j + 1 < width:
                heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            span = self.place.get(at[0][i] * width + at[1][j])
            if span:
                yield slack - bound, *span

    def gather(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(bound on all that follow, positions, scores) in strides of cells."""
        held, n = [], 0
        for bound, a, b in self.visit(q):
            if held and n >= STRIDE:
                yield bound, *self._scored(held, q)
                held, n = [], 0
            held.append((a, b))
            n += b - a
        if held:
            yield -np.inf, *self._scored(held, q)

    def _scored(self, spans: list[tuple[int, int]], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        return at, scores(self.rows[at], q)

    def best(self, at: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n by falling score, then rising id."""
        if len(at) > 4 * n:  # only what reaches the n-th score needs the full order
            least = np.partition(score, len(score) - n)[len(score) - n]
            some = score >= least
            at, score = at[some], score[some]
        order = np.lexsort((self.row[at], self.ids[at], -score))[:n]
        return at[order], score[order]

    def positives(self, row: int, label: int, q: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The first n other rows of the label here; those below ``least`` may be left out."""
        at, score = np.empty(0, np.int64), np.empty(0)
        for bound, seen, found in self.gather(q):
            wanted = (self.label[seen] == label) & (self.row[seen] != row) & (found >= least)
            at, score = self.best(np.concatenate([at, seen[wanted]]), np.concatenate([score, found[wanted]]), n)
            if bound < (max(least, score[-1]) if len(score) == n else least):
                break
        return at, score

    def negatives(
        self, label: int, q: np.ndarray, windows: list[tuple[int, int]], n: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score): the first n rows of other labels in it."""
        kept = [(np.empty(0, np.int64), np.empty(0)) for _ in windows]
        low, high = min(w[0] for w in windows), max(w[1] for w in windows)
        for bound, seen, found in self.gather(q):
            wanted = (found >= low) & (found <= high) & (self.label[seen] != label)
            seen, found = seen[wanted], found[wanted]
            for k, (a, b) in enumerate(windows):
                inside = (found >= a) & (found <= b)
                if inside.any():
                    kept[k] = self.best(np.concatenate([kept[k][0], seen[inside]]), np.concatenate([kept[k][1], found[inside]]), n)
            # a window is certain once it is full and no cell left reaches its last score, or none reaches the window
            if all(bound < (s[-1] if len(s) == n else a) for (_, s), (a, _) in zip(kept, windows, strict=True)):
                break
        return kept


# --- anchors over shelves -----------------------------------------------------------------------
_ANCHOR = "row long, vec_id long, label long, v binary, wide boolean, shelf int, least double, ids array<long>, low array<long>, high array<long>"


def _route(anchors: DataFrame, index: Index, home: bool | None) -> DataFrame:
    """Anchors once for each shelf they must ask: (``home``) the most promising, or the others that can reach ``least``.

    With ``home`` None every shelf that can reach ``least``.
    """

    def work(columns: dict[str, pa.Array]) -> dict | None:
        bounds = index.shelf_bounds(unpack(columns["v"], columns["wide"], index.width))
        best = bounds.argmax(axis=1)
        asks = bounds >= columns["least"].to_numpy()[:, None]
        if home is not None:
            own = np.arange(index.shelves) == best[:, None]
            asks = own if home else asks & ~own
        which, shelf = np.nonzero(asks)
        if not len(which):
            return None
        return {c: x.take(pa.array(which)) for c, x in columns.items()} | {"shelf": pa.array(shelf, pa.int32())}

    return per_batch(anchors, work, _ANCHOR)


def _ask(index: Index, on_shelf: DataFrame, routed: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(shelf, anchors)`` for each shelf's rows and the anchors sent there, which stream past them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    both = on_shelf.withColumn("kind", F.lit(0)).unionByName(routed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = max(index.shelves, 1)
    dealt = both.repartitionById(parts, F.col("shelf")).sortWithinPartitions("shelf", "kind")
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shelf, number = [], None, None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            at = batch.column("shelf").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at) | np.diff(kind)) + 1).tolist(), len(kind)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    if number != at[a]:
                        rows, shelf, number = [], None, at[a]
                    rows.append(piece)
                elif number == at[a]:
                    shelf = shelf or Shelf(index, rows)
                    made = answer(shelf, piece)
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return dealt.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], n: int, ids: str, row: str) -> DataFrame:
    """The first n of each group by falling score, then rising id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), ids, row)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def find_positives(index: Index, on_shelf: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """(row, positive_row, positive_id, score, rank): each anchor's first n other rows of its label."""

    def answer(shelf: Shelf, piece: pa.RecordBatch) -> dict:
        q = unpack(piece.column("v"), piece.column("wide"), index.width)
        out: dict[str, list] = {"row": [], "positive_row": [], "positive_id": [], "score": []}
        columns = [piece.column(c).to_pylist() for c in ("row", "label", "least")]
        for k, (row, label, least) in enumerate(zip(*columns, strict=True)):
            at, score = shelf.positives(row, label, q[k], n, least)
            out["row"] += [row] * len(at)
            out["positive_row"] += shelf.row[at].tolist()
            out["positive_id"] += shelf.ids[at].tolist()
            out["score"] += [int(s) for s in score]
        return out

    schema = "row long, positive_row long, positive_id long, score long"
    bare = anchors.withColumns({
        "shelf": F.lit(0), "least": F.lit(float("-inf")), "ids": F.lit(None).cast("array<long>"),
        "low": F.lit(None).cast("array<long>"), "high": F.lit(None).cast("array<long>"),
    }).select("row", "vec_id", "label", "v", "wide", "shelf", "least", "ids", "low", "high")
    near = staged(_ask(index, on_shelf, _route(bare, index, True), answer, schema), "multi-near")
    known = near.groupBy("row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst"))
    further = bare.drop("least").join(known, "row", "left").withColumn(
        "least", F.when(F.col("n") == n, F.col("worst")).otherwise(F.lit(float("-inf")))
    ).select("row", "vec_id", "label", "v", "wide", "shelf", "least", "ids", "low", "high")
    far = _ask(index, on_shelf, _route(further, index, False), answer, schema)
    return _first(near.unionByName(far), ["row"], n, "positive_id", "positive_row")


def mine(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor_every: int = 50,
    scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shelf_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``. A negative has another label than the anchor and a
    score of at least ``low`` and at most ``high`` per cent of the positive's.
    """
    rows = prepare(table, vec_id, vector, label, scale)
    index, on_shelf = build_index(rows, shelf_rows)
    anchors = on_shelf.filter(F.col("vec_id") % anchor_every == 0).select("row", "vec_id", "label", "v", "wide")
    pairs = staged(find_positives(index, on_shelf, anchors, positives), "multi-positives")

    # the lowest and highest whole score of each window; none where the positive's score is negative
    windows = pairs.withColumns({
        "low": F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("long"),
        "high": F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("long"),
    }).filter("low <= high")
    asked = windows.groupBy("row").agg(
        F.min("low").cast("double").alias("least"), F.sort_array(F.collect_list(F.struct("positive_row", "low", "high"))).alias("w")
    )
    wanted = anchors.join(asked, "row").select(
        "row", "vec_id", "label", "v", "wide", F.lit(0).alias("shelf"), "least", F.col("w.positive_row").alias("ids"),
        F.col("w.low").alias("low"), F.col("w.high").alias("high"),
    )

    def answer(shelf: Shelf, piece: pa.RecordBatch) -> dict:
        q = unpack(piece.column("v"), piece.column("wide"), index.width)
        out: dict[str, list] = {"row": [], "positive_row": [], "negative_row": [], "negative_id": [], "score": []}
        columns = [piece.column(c).to_pylist() for c in ("row", "label", "ids", "low", "high")]
        for k, (row, own, which, lows, highs) in enumerate(zip(*columns, strict=True)):
            found = shelf.negatives(own, q[k], list(zip(lows, highs, strict=True)), negatives)
            for positive, (at, score) in zip(which, found, strict=True):
                out["row"] += [row] * len(at)
                out["positive_row"] += [positive] * len(at)
                out["negative_row"] += shelf.row[at].tolist()
                out["negative_id"] += shelf.ids[at].tolist()
                out["score"] += [int(s) for s in score]
        return out

    found = _ask(
        index, on_shelf, _route(wanted, index, None), answer,
        "row long, positive_row long, negative_row long, negative_id long, score long",
    )
    first = _first(found, ["row", "positive_row"], negatives, "negative_id", "negative_row")
    named = pairs.select("row", "positive_row", "positive_id", F.col("score").alias("positive_score")).join(
        anchors.select("row", F.col("vec_id").alias("anchor_id")), "row"
    )
    return first.join(named, ["row", "positive_row"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"),
    )
