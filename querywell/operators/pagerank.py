"""Personalised PageRank: links as tiles of a sparse matrix, which tasks multiply as arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import cut

DAMPING, ROUNDS, TOLERANCE = 0.85, 30, 1e-6
#: Links of a tile, and of one of its rows; a block of nodes has about as many places in tiles as a row has links.
TILE, PIECE = 1 << 22, 1 << 20

STATE = "block int, x binary, r binary, p binary, q binary, pq double, rq double, qq double, rr double, left double"


def link_weight() -> Column:
    """Missing or zero weighs 1, negative 0."""
    return F.greatest(F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")), F.lit(0.0))


def numbers(value: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array as a column of binary cells, each of which ends at one of ``ends``."""
    values = np.ascontiguousarray(values)
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def cell(values: np.ndarray) -> pa.Array:
    return cells(values, np.array([len(values)]))


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in parts of about ``most``; equal pairs that follow one another stay together."""
    held, size = [], 0
    for batch in batches:
        while len(batch):
            k = min(len(batch), max(0, most - size))
            if not k:
                # Beyond ``most`` a part takes only the rest of its last pair.
                low, high = (held[-1].column(c)[len(held[-1]) - 1] for c in ("low", "high"))
                k = int(pc.and_(pc.equal(batch.column("low"), low), pc.equal(batch.column("high"), high)).to_numpy(zero_copy_only=False).cumprod().sum())
            if k:
                held.append(batch.slice(0, k))
                size, batch = size + k, batch.slice(k)
            else:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def coded(ids: pa.ChunkedArray, blocks: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row's place among the distinct ids, these in order of block and id, and their blocks."""
    found = pa.concat_arrays(ids.chunks).dictionary_encode()
    index = found.indices.to_numpy()
    of = np.empty(len(found.dictionary), np.int32)
    of[index] = blocks
    order = pc.sort_indices(found.dictionary).to_numpy()
    order = order[np.argsort(of[order], kind="stable")]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[index], found.dictionary.take(pa.array(order)), of[order]


def largest(low: np.ndarray, high: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with its largest weight."""
    pair = low.astype(np.int64) * width + high
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return low[order[first]], high[order[first]], np.maximum.reduceat(weight[order], first)


def tiled(edges: DataFrame, kind: str, bands: int, blocks: int) -> DataFrame:
    """(src, dst, weight) -> a tile's links as places of their ends (low, high, weight, n_low, n_high), and the nodes of its two sides by block (side, block, start, ids, sums).

    A block is a hash of the id, a band some blocks, a tile the links between two bands: both directions of a link are one. Links without
    an end or with a weight that is not finite are left out.
    """
    tiles = bands * (bands + 1) // 2
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    a, b = block("src") % bands, block("dst") % bands
    turned = (a > b) | ((a == b) & (F.col("src") > F.col("dst")))
    links = edges.where("src is not null and dst is not null").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), link_weight().alias("weight"))
    links = links.where("weight > 0 and weight < double('infinity')")
    few, many = F.least(a, b), F.greatest(a, b)
    pairs = links.select(
        (many * (many + 1) / 2 + few).cast("int").alias("tile"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("low"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("high"), "weight"
    ).repartitionById(tiles, "tile")
    pairs = pairs.select("low", "high", (block("low").cast("long") * blocks + block("high")).alias("blocks"), "weight")
    # One number to sort by, so that parts are the same when one is lost and made again.
    key = F.shiftleft(F.xxhash64("low"), 32).bitwiseOR(F.xxhash64("high").bitwiseAND((1 << 32) - 1))

    schema = f"tile long, low binary, high binary, weight binary, n_low int, n_high int, side int, block int, start int, ids array<{kind}>, sums array<double>"
    piece, most = PIECE, TILE + TILE // 4

    def built(batches):
        for part, rows in enumerate(runs(batches, most)):
            of, weight = rows["blocks"].to_numpy(), rows["weight"].to_numpy()
            a, b = int(of[0] // blocks % bands), int(of[0] % blocks % bands)
            tile = b * (b + 1) // 2 + a + tiles * part
            # A link to itself is met from both sides.
            weight = np.where(pc.equal(rows["low"], rows["high"]).to_numpy(), weight / 2, weight)
            sides = [coded(rows["low"], of // blocks), coded(rows["high"], of % blocks)]
            *ends, weight = largest(sides[0][0], sides[1][0], weight, len(sides[1][1]))
            blank = lambda n, *names: {c: pa.nulls(n, pa.int32() if c[0] == "n" or c in ("side", "block", "start") else pa.binary()) for c in names}
            for side, (_, ids, of) in enumerate(sides):
                start = np.append(0, np.flatnonzero(np.diff(of)) + 1)
                cuts = pa.array(np.append(start, len(of)).astype(np.int32))
                sums = pa.array(np.bincount(ends[side], weight, len(ids)))
                n = len(start)
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array([tile] * n, pa.int64())} | blank(n, "low", "high", "weight", "n_low", "n_high")
                    | {"side": pa.array([side] * n, pa.int32()), "block": pa.array(of[start]), "start": pa.array(start.astype(np.int32)), "ids": pa.ListArray.from_arrays(cuts, ids), "sums": pa.ListArray.from_arrays(cuts, sums)}
                )
            for k in range(0, len(weight), piece):
                some = slice(k, k + piece)
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array([tile], pa.int64()), "low": cell(ends[0][some]), "high": cell(ends[1][some]), "weight": cell(weight[some])}
                    | {"n_low": pa.array([len(sides[0][1])], pa.int32()), "n_high": pa.array([len(sides[1][1])], pa.int32())}
                    | blank(1, "side", "block", "start") | {"ids": pa.nulls(1, pa.list_(sides[0][1].type)), "sums": pa.nulls(1, pa.list_(pa.float64()))}
                )

    # A partition is a tile.
    return pairs.sortWithinPartitions(key).mapInArrow(built, schema)


def placed(rows: pa.Table) -> pa.Table:
    """The nodes of a block, once each: ids, degree, which are seeds, and where they stand in each side of a tile that has some of them."""
    rows = rows.sort_by([("tile", "ascending"), ("side", "ascending")])
    ids = pa.concat_arrays(rows["ids"].chunks)
    found = pc.list_flatten(ids).dictionary_encode()
    at, ends = found.indices.to_numpy(), np.cumsum(pc.list_value_length(ids).to_numpy())
    degree = np.bincount(at, pc.list_flatten(rows["sums"]).to_numpy(), len(found.dictionary))
    n = rows["tile"].null_count  # seeds come last
    cut_at = len(rows) - n
    last = int(ends[cut_at - 1]) if cut_at else 0
    seeds = at[last:].astype(np.int32)
    return pa.table({
        "block": rows["block"].slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary), "degree": cell(degree), "seeds": cell(seeds),
        "n_seeds": pa.array([len(seeds)], pa.int64()), "n_lone": pa.array([int((degree[seeds] == 0).sum())], pa.int64()),
        **{c: cell(rows[c].slice(0, cut_at).to_numpy().astype(np.int64)) for c in ("tile", "side", "start")}, "ends": cell(ends[:cut_at].astype(np.int64)), "at": cell(at[:last].astype(np.int32)),
    })


def begun(seed: float, dead: float) -> Callable:
    """The state before the first round: a seed without links has its rank, the others their start."""

    def start(batches):
        for batch in batches:
            for k in range(len(batch)):
                degree, seeds = numbers(batch["degree"][k]), numbers(batch["seeds"][k], np.int32)
                x, r, none = np.zeros(len(degree)), np.zeros(len(degree)), np.zeros(len(degree))
                r[seeds] = seed
                lone = seeds[degree[seeds] == 0]
                x[lone], r[lone] = dead, 0.0
                yield pa.RecordBatch.from_pydict({"block": batch["block"].slice(k, 1), "x": cell(x), "r": cell(r), "p": cell(none), "q": cell(none)} | {c: pa.array([0.0]) for c in ("pq", "rq", "qq", "rr", "left")})

    return start


def moved(row: dict, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, r and p of a block after a step."""
    x, r, p, q = (numbers(row[c]) for c in "xrpq")
    r = r - alpha * q
    return x + alpha * p, r, r + beta * p


def inverse(degree: np.ndarray) -> np.ndarray:
    return np.divide(1.0, degree, out=np.zeros(len(degree)), where=degree > 0)


def sending(alpha: float, beta: float) -> Callable:
    """What each tile needs of a block's nodes: their direction by their degree; no values if all are 0."""

    def sent(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch[c][k] for c in batch.schema.names}
                values = moved(row, alpha, beta)[2] * inverse(numbers(row["degree"]))
                tile, side, start, ends = (numbers(row[c], np.int64) for c in ("tile", "side", "start", "ends"))
                values, sizes = values[numbers(row["at"], np.int32)], np.diff(ends, prepend=0)
                some = np.array([values[e - s : e].any() for e, s in zip(ends, sizes)], bool)
                kept = values[np.repeat(some, sizes)]
                yield pa.RecordBatch.from_pydict({
                    "tile": pa.array(tile), "side": pa.array(side.astype(np.int32)), "block": pa.array(np.full(len(tile), row["block"].as_py(), np.int32)), "start": pa.array(start.astype(np.int32)),
                    "n": pa.array(sizes.astype(np.int32)), "value": cells(kept, np.cumsum(np.where(some, sizes, 0))),
                })

    return sent


def multiplied(links: pa.Table, sent: pa.Table) -> pa.Table:
    """A tile's links times what its nodes sent, both ways: what each block gets from it."""
    sides, starts, sizes, got = (sent[c].to_numpy() for c in ("side", "start", "n", "block"))
    values = [np.zeros(links[c][0].as_py()) if len(links) else np.zeros(0) for c in ("n_low", "n_high")]
    for side, start, size, cell_ in zip(sides, starts, sizes, sent["value"]):
        part = numbers(cell_)
        if len(part):
            values[side][start : start + size] = part
    flow = [np.zeros(len(v)) for v in values]
    ways = [v.any() for v in values]
    for k in range(len(links) if any(ways) else 0):
        low, high, weight = numbers(links["low"][k], np.int32), numbers(links["high"][k], np.int32), numbers(links["weight"][k])
        if ways[1]:
            flow[0] += np.bincount(low, weight * values[1][high], len(flow[0]))
        if ways[0]:
            flow[1] += np.bincount(high, weight * values[0][low], len(flow[1]))
    parts = [flow[side][start : start + size] for side, start, size in zip(sides, starts, sizes)]
    some = np.array([p.any() for p in parts], bool)
    ends = np.cumsum([len(p) for p, s in zip(parts, some) if s]).astype(np.int64)
    flat = np.concatenate([p for p, s in zip(parts, some) if s] or [np.zeros(0)])
    return pa.table({"block": pa.array(got[some], pa.int32()), "tile": sent["tile"].filter(pa.array(some)), "side": pa.array(sides[some], pa.int32()), "flow": cells(flat, ends)})


def combining(alpha: float, beta: float, damping: float) -> Callable:
    """The state after a round, with the sums that the next step needs."""

    def combined(held: pa.Table, flows: pa.Table) -> pa.Table:
        row = {c: held[c][0] for c in held.column_names}
        x, r, p = moved(row, alpha, beta)
        tile, side, ends, at = numbers(row["tile"], np.int64), numbers(row["side"], np.int64), numbers(row["ends"], np.int64), numbers(row["at"], np.int32)
        where = {(t, s): (a, b) for t, s, a, b in zip(tile.tolist(), side.tolist(), [0, *ends[:-1].tolist()], ends.tolist())}
        y = np.zeros(len(x))
        # In one order, so that reruns round alike.
        for t, s, k in sorted(zip(flows["tile"].to_pylist(), flows["side"].to_pylist(), range(len(flows)))):
            a, b = where[t, s]
            y[at[a:b]] += numbers(flows["flow"][k])
        q, by = p - damping * y, inverse(numbers(row["degree"]))
        sums = {"pq": p @ (q * by), "rq": r @ (q * by), "qq": q @ (q * by), "rr": r @ (r * by), "left": np.abs(r).sum()}
        return pa.table({"block": held["block"], "x": cell(x), "r": cell(r), "p": cell(p), "q": cell(q)} | {c: pa.array([float(v)]) for c, v in sums.items()})

    return combined


def ranked(alpha: float) -> Callable:
    """(id, rank) of the nodes of each block after the last step."""

    def rows(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch[c][k] for c in batch.schema.names}
                # A rank near 0 may still be a little below it.
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(np.maximum(moved(row, alpha, 0.0)[0], 0.0))], ["id", "rank"])

    return rows


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, rows: int | None = None) -> DataFrame:
    """Personalised: (id, rank, converged), mass of dead ends goes back to the seeds, ranks add up to 1. ``rows``: a bound of the links' number, if known.

    Rounds end when the ranks together are within ``tolerance`` of those that a plain step leaves as they are, and
    converged is true, or after ``rounds``.

    Links weigh the same both ways, so by degree the step is symmetric and the ranks are found by conjugate gradients: the same
    ranks, in fewer rounds. A round sends each tile of links its nodes' values and each block of nodes its sums, as arrays, and
    five numbers to the driver. Links without an end, and seeds without an id, are left out.
    """
    spark = edges.sparkSession
    rows = edges.count() if rows is None else rows
    kind = edges.select("src").union(edges.select("dst")).union(seeds.select("id")).schema[0].dataType.simpleString()
    width = spark.sparkContext.defaultParallelism
    bands = max(1, math.ceil(math.sqrt(2 * rows / TILE)), min(math.ceil(math.sqrt(4 * width)), math.ceil(math.sqrt(32 * rows / TILE))))
    blocks = bands * max(1, -(-2 * rows // (PIECE * bands)))
    # With fewer parts than that, Spark would deal the links out again in each round.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bands * (bands + 1) // 2)
    # Kept dealt and sorted, so that a round moves arrays of nodes but no links.
    tiles = tiled(edges, kind, bands, blocks).repartition(parts, "tile").sortWithinPartitions("tile").persist(StorageLevel.MEMORY_AND_DISK)
    links = tiles.where("low is not null").select("tile", "low", "high", "weight", "n_low", "n_high")
    asked = seeds.where("id is not null").select(F.col("id").cast(kind).alias("id")).groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    asked = asked.select("block", F.lit(None).cast("long").alias("tile"), F.lit(2).alias("side"), F.lit(0).alias("start"), "ids", F.array_repeat(F.lit(0.0), F.size("ids")).alias("sums"))
    sides = tiles.where("block is not null").select("block", "tile", "side", "start", "ids", "sums").unionByName(asked)
    placing = f"block int, ids array<{kind}>, degree binary, seeds binary, n_seeds long, n_lone long, tile binary, side binary, start binary, ends binary, at binary"
    nodes = sides.groupBy("block").applyInArrow(placed, placing).repartition(parts, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
    n, lone = nodes.agg(F.coalesce(F.sum("n_seeds"), F.lit(0)), F.coalesce(F.sum("n_lone"), F.lit(0))).first()
    # Links go both ways, so a dead end has none at all: only its seed gives it rank, and their mass at the end follows from a number.
    lost = (lone / max(1, n)) * (1 - damping) / (1 - damping * lone / max(1, n))
    seed = (1 - damping + damping * lost) / max(1, n)
    state = nodes.select("block", "degree", "seeds").mapInArrow(begun(seed, seed), STATE)
    alpha = beta = 0.0
    done, left = 0, math.inf
    known = nodes.drop("ids", "seeds", "n_seeds", "n_lone")
    while done < rounds and left > tolerance * (1 - damping):
        held = known.join(state.hint("merge"), "block")
        sent = held.mapInArrow(sending(alpha, beta), "tile long, side int, block int, start int, n int, value binary")
        flows = links.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(multiplied, "block int, tile long, side int, flow binary")
        state = held.groupBy("block").cogroup(flows.groupBy("block")).applyInArrow(combining(alpha, beta, damping), STATE)
        state = cut(state)
        pq, rq, qq, rr, left = state.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("pq", "rq", "qq", "rr", "left"))).first()
        alpha = rr / pq if pq > 0 else 0.0
        beta = max(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0) / rr if rr > 0 else 0.0
        done += 1
    ids = nodes.select("block", "ids").join(state.hint("merge"), "block")
    found = cut(ids.mapInArrow(ranked(alpha), f"id {kind}, rank double"))
    tiles.unpersist()
    nodes.unpersist()
    return found.select("id", "rank", F.lit(left <= tolerance * (1 - damping)).alias("converged"))
