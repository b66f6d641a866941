"""Personalized PageRank on undirected graphs in blocks of edges, for a bounded number of queries at once.

An edge lies in the block of its end of fewer edges, so that a node of d edges brings at most sqrt(2 * edges) of them there.
A block keeps its edges as packed numbers. Nodes of several blocks are hubs, whose scores travel: they go to each group of blocks that
holds them, one partial sum per group comes back, and no message per edge is ever shuffled. A group's blocks are walked one after another
in one task, so blocks may be small while hubs are sent to few groups. The scores of all other nodes follow from those of the hubs
within their block, so they are solved for there in every step and neither kept nor sent.

Steps are those of Chebyshev's iteration. A walk on an undirected graph has real eigenvalues, the damped one within +-damping,
so the distance shrinks by damping / (1 + sqrt(1 - damping^2)) a step instead of by damping; the fixed point is the same. What is left of
the walk when other nodes are solved for (a Schur complement) has its eigenvalues within the same bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget, saved, scratch

MOST_QUERIES = 64
BLOCK_NUMBERS = 1 << 24     # edges times queries of a graph that is walked to the end in one task
PIECE = 8                   # blocks of larger graphs are so many times smaller
GROUP = 16                  # such blocks of a group, but for small graphs, which get a group for each core
CHUNK_NUMBERS = 1 << 20     # hubs times queries of one row of hubs
FINER = 0.01                # the last step moves less than this share of the tolerance


def undirected(edges: DataFrame) -> DataFrame | None:
    """(a, b, w), each edge once with a <= b, hashed names; nothing if a weight differs from that of the way back or is negative."""
    ids = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(
        F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    path = scratch(edges.sparkSession, "edges")
    (ids.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"))
     .agg(F.sum(F.when(F.col("s") <= F.col("d"), F.col("w")).otherwise(0.0)).alias("w"),
          F.sum(F.when(F.col("s") >= F.col("d"), F.col("w")).otherwise(0.0)).alias("back")).write.parquet(path))
    half = edges.sparkSession.read.parquet(path)
    odd = ~(F.abs(F.col("w") - F.col("back")) <= F.col("w") * 1e-12) | ~(F.col("w") < float("inf"))
    return None if half.where(odd).limit(1).count() else half.where("w > 0").select("a", "b", "w")


def numbered(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """(node, id) by hash; nothing if two names share one."""
    names, _ = saved(edges.select(F.col("src").alias("node")).union(seeds.select("node")).where("node IS NOT NULL").distinct()
                     .withColumn("id", F.xxhash64("node")), "rank-names")
    n, different = names.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    return names if n == different else None


def _floats(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(-1, width)


def _build(key: tuple, t: pa.Table) -> pa.Table:
    """One row with the block's nodes in order of id, and its edges by their places."""
    home, guest, w, out_home, out_guest = (t.column(c).to_numpy() for c in ("home", "guest", "w", "out_home", "out_guest"))
    ids, place = np.unique(np.concatenate([home, guest]), return_inverse=True)
    out = np.empty(len(ids))
    out[place] = np.concatenate([out_home, out_guest])
    heads, tails = place[:len(home)].astype(np.int32), place[len(home):].astype(np.int32)
    w = np.where(heads == tails, w / 2, w)      # both ways of a loop are one
    return pa.table({"blk": pa.array([key[0].as_py()], pa.int64())} | {
        n: pa.array([x.tobytes()], pa.binary()) for n, x in (("ids", ids), ("heads", heads), ("tails", tails), ("w", w), ("out", out))})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blk, ids in zip(b.column("blk").to_pylist(), b.column("ids").to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), blk)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                             names=["blk", "pos", "id"])


def _matrix(positions: pa.Array, values: pa.Array, n: int, width: int) -> np.ndarray:
    """Rows of `width` numbers at their places, zeros elsewhere."""
    m = np.zeros((n, width))
    m[positions.to_numpy()] = values.flatten().to_numpy().reshape(-1, width)
    return m


def _sent(x: np.ndarray, out: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What each node gets along the arcs (src, dst) of weight w."""
    y, total = np.ascontiguousarray((x / out[:, None]).T), np.empty_like(x)
    for q in range(x.shape[1]):
        total[:, q] = np.bincount(dst, w * y[q][src], len(x))
    return total


def _weight(i: int, omega: float, damping: float) -> float:
    return 1.0 if i == 0 else 2 / (2 - damping ** 2) if i == 1 else 4 / (4 - damping ** 2 * omega)


def _settled(src: np.ndarray, dst: np.ndarray, w: np.ndarray, out: np.ndarray, r: np.ndarray, kept: list[float], hub: np.ndarray, x: np.ndarray,
             damping: float, steps: int, tol: float) -> tuple[np.ndarray, bool]:
    """Scores of all nodes of a block whose hubs have the scores they have in `x`, and whether they settled within the steps."""
    own = ~hub[dst]
    src, dst, w = src[own], dst[own], w[own]
    only_hubs, at, before = bool(hub[src].all()), 1.0, x
    for i in range(steps):
        at = _weight(i, at, damping)
        new = at * (damping * _sent(x, out, src, dst, w) + r * kept) + (1 - at) * before
        new[hub] = x[hub]
        if only_hubs or (np.abs(new - x).sum(axis=0) < tol * FINER).all():
            return new, True
        x, before = new, x
    return x, False


def block_ranks(edges: DataFrame, seeds: DataFrame, names: DataFrame, damping: float, steps: int, tol: float) -> DataFrame:
    """(qid, node, score). edges: a, b, w of `undirected`; seeds: qid, node, r, which add up to 1 for each query."""
    spark = edges.sparkSession
    qids = [r.qid for r in seeds.select("qid").distinct().collect()]        # at most MOST_QUERIES
    width = len(qids)
    slots = spark.createDataFrame([(q, i) for i, q in enumerate(qids)], f"qid {seeds.schema['qid'].dataType.simpleString()}, slot int")
    seeds, _ = saved(seeds.join(F.broadcast(slots), "qid").join(names, "node").select("id", "slot", "r"), "rank-seeds")
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    nodes, _ = saved(edges.select(F.explode(ends).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("deg")), "rank-nodes")
    # A seed without edges sends its mass back: its share solves lone = own * (1 - damping + damping * lone).
    alone = cut(seeds.join(nodes.select("id"), "id", "left_anti"))
    own = dict(alone.groupBy("slot").agg(F.sum("r")).collect())
    kept = [(1 - damping) * (1 + damping * own.get(i, 0.0) / (1 - damping * own.get(i, 0.0))) for i in range(width)]
    vector = F.array(*[F.sum(F.when(F.col("slot") == i, F.col("r")).otherwise(0.0)) for i in range(width)])
    start, _ = saved(seeds.groupBy("id").agg(vector.alias("x")).join(nodes.select("id"), "id", "left_semi"), "rank-start")

    numbers = edges.count() * max(8, width)
    blocks = 1 if numbers <= BLOCK_NUMBERS else math.ceil(numbers * PIECE / BLOCK_NUMBERS)
    groups = min(blocks, max(math.ceil(blocks / GROUP), 2 * spark.sparkContext.defaultParallelism))
    at = [nodes.select(F.col("id").alias(c), F.col("out").alias(f"out_{c}"), F.col("deg").alias(f"deg_{c}")) for c in "ab"]
    less = (F.col("deg_a") < F.col("deg_b")) | ((F.col("deg_a") == F.col("deg_b")) & (F.col("a") <= F.col("b")))
    pick = {"home": ("a", "b"), "guest": ("b", "a"), "out_home": ("out_a", "out_b"), "out_guest": ("out_b", "out_a")}
    arcs = edges.join(at[0], "a").join(at[1], "b").select("w", *[F.when(less, F.col(x)).otherwise(F.col(y)).alias(n) for n, (x, y) in pick.items()])
    built, _ = saved(arcs.withColumn("blk", F.pmod(F.xxhash64("home"), F.lit(blocks))).groupBy("blk").applyInArrow(
        _build, "blk bigint, ids binary, heads binary, tails binary, w binary, out binary"), "rank-built")
    places, _ = saved(built.select("blk", "ids").mapInArrow(_places, "blk bigint, pos int, id bigint"), "rank-places")
    shared, _ = saved(places.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "rank-shared")
    chunks = max(1, math.ceil(shared.count() * width / CHUNK_NUMBERS))
    of_group, of_chunk = F.pmod("blk", F.lit(groups)), F.pmod("id", F.lit(chunks))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = len(b.column("ids")[i].as_py()) // 8
                pos, x = b.column("m_pos")[i], b.column("m_x")[i]
                m = _matrix(pos.values, x.values, n, width) if pos.is_valid else np.zeros((n, width))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in ("grp", *held)], pa.array([m.tobytes()], pa.binary())],
                                                 names=["grp", *held, "reset"])

    held = ["ids", "heads", "tails", "w", "out"]
    s = F.sort_array(F.collect_list(F.struct("pos", "x")))
    reset = places.join(start, "id").groupBy("blk").agg(s.alias("_s")).select("blk", F.col("_s.pos").alias("m_pos"), F.col("_s.x").alias("m_x"))
    fixed = cut(built.join(reset, "blk", "left").withColumn("grp", of_group).mapInArrow(
        pack, "grp bigint, ids binary, heads binary, tails binary, w binary, out binary, reset binary").repartition(groups, "grp"))

    def packed(keys: list[str]):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            x = _matrix(pa.array(np.flatnonzero(t.column("x").is_valid().to_numpy())), t.column("x").drop_null().combine_chunks(), len(t), width)
            return pa.table({k: pa.array([v.as_py()], pa.int64()) for k, v in zip(keys, key)} | {
                "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})
        return run

    known = shared.join(start, "id", "left").withColumn("chunk", of_chunk)
    state, _ = saved(known.groupBy("chunk").applyInArrow(packed(["chunk"]), "chunk bigint, ids binary, x binary")
                     .select("chunk", "ids", "x", F.col("x").alias("r"), F.col("x").alias("before")), "rank-hubs")
    routes = places.join(shared, "id").select(of_group.alias("grp"), "id").distinct().join(known, "id")
    packets, _ = saved(routes.groupBy("grp", "chunk").applyInArrow(packed(["grp", "chunk"]), "grp bigint, chunk bigint, ids binary, x binary"), "rank-packets")

    def blocks_of(batches: Iterator[pa.RecordBatch]):
        """(group, ids of its hubs, ids, hubs among them, src, dst, w, out, scores, settled) of each block."""
        for b in batches:
            for row in range(b.num_rows):
                ids, heads, tails, w, out, r, told = (b.column(c)[row].as_py() for c in (*held, "reset", "told"))
                ids, out, r = np.frombuffer(ids, np.int64), np.frombuffer(out, np.float64), _floats(r, width)
                heads, tails, w = np.frombuffer(heads, np.int32), np.frombuffer(tails, np.int32), np.frombuffer(w, np.float64)
                src, dst, w = np.concatenate([heads, tails]), np.concatenate([tails, heads]), np.concatenate([w, w])
                hubs = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in told or []] or [np.empty(0, np.int64)])
                score = np.concatenate([_floats(p["x"], width) for p in told or []] or [np.empty((0, width))])
                order = np.argsort(hubs)
                hubs, score = hubs[order], score[order]
                place = np.searchsorted(hubs, ids)
                hub = np.append(hubs, 0)[place] == ids
                hub[place == len(hubs)] = False
                x = r.copy()
                x[hub] = score[place[hub]]
                yield (b.column("grp")[row].as_py(), hubs, ids, hub, place, src, dst, w, out, *_settled(src, dst, w, out, r, kept, hub, x, damping, steps, tol))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the hubs of a group get from its blocks."""
        groups_here: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for grp, hubs, _, hub, place, src, dst, w, out, x, _ in blocks_of(batches):
            total = groups_here.setdefault(grp, (hubs, np.zeros((len(hubs), width))))[1]
            to = hub[dst]
            total[place[hub]] += _sent(x, out, src[to], dst[to], w[to])[hub]
        for grp, (hubs, total) in groups_here.items():
            of = np.mod(hubs, chunks)
            for c in np.unique(of):
                yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([int(c)]), pa.array([hubs[of == c].tobytes()], pa.binary()),
                                                  pa.array([total[of == c].tobytes()], pa.binary())], names=["grp", "chunk", "ids", "x"])

    def step(omega: float):
        def run(old: pa.Table, sent: pa.Table) -> pa.Table:
            ids, (x, r, before) = np.frombuffer(old["ids"][0].as_py(), np.int64), (_floats(old[c][0].as_py(), width) for c in ("x", "r", "before"))
            total, asked = np.zeros_like(x), []
            for i in range(len(sent)):
                asked.append(np.searchsorted(ids, np.frombuffer(sent["ids"][i].as_py(), np.int64)))
                total[asked[-1]] += _floats(sent["x"][i].as_py(), width)
            new = omega * (damping * total + r * kept) + (1 - omega) * before
            none = [None] * len(sent)
            return pa.table({"grp": pa.array([None, *sent["grp"].to_pylist()], pa.int64()), "chunk": pa.array([old["chunk"][0].as_py()] * (1 + len(sent)), pa.int64()),
                             "ids": pa.array([ids.tobytes(), *sent["ids"].to_pylist()], pa.binary()),
                             "x": pa.array([new.tobytes(), *[new[at].tobytes() for at in asked]], pa.binary()),
                             "r": pa.array([r.tobytes(), *none], pa.binary()), "before": pa.array([x.tobytes(), *none], pa.binary()),
                             "moved": pa.array([np.abs(new - x).sum(axis=0).tolist(), *none], pa.list_(pa.float64()))})
        return run

    def told() -> DataFrame:
        return fixed.join(packets.groupBy("grp").agg(F.collect_list(F.struct("ids", "x")).alias("told")), "grp", "left")

    enough = math.ceil(math.log(tol * FINER) / math.log(damping / (1 + math.sqrt(1 - damping * damping)))) if 0 < damping < 1 and tol < 1 else 1
    omega, late, last = 1.0, blocks > 1, None
    for i in range(steps if blocks > 1 else 0):
        omega = _weight(i, omega, damping)
        back = told().mapInArrow(sums, "grp bigint, chunk bigint, ids binary, x binary")
        # Written and read again: a checkpoint would keep the estimated size of its plan, a product of both sides whose digits double with every step.
        made, path = saved(state.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
            step(omega), "grp bigint, chunk bigint, ids binary, x binary, r binary, before binary, moved array<double>"), "rank-step")
        forget(spark, *([last] if last else []))
        last = path
        state, packets = made.where("grp IS NULL"), made.where("grp IS NOT NULL").select("grp", "chunk", "ids", "x")
        if i + 1 >= enough or i + 1 == steps:
            moved = np.array([r.moved for r in state.select("moved").collect()]).reshape(-1, width).sum(axis=0)      # a row for each chunk
            late = bool((moved >= tol * FINER).any())
            if not late:
                break

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the nodes that are no hubs; slot -1 if those of a block did not settle."""
        for _, _, ids, hub, _, _, _, _, _, x, settled in blocks_of(batches):
            yield from listed(ids[~hub], x[~hub])
            if not settled:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([-1], pa.int32()), pa.array([0.0])], names=["id", "slot", "score"])

    def listed(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, slot = np.nonzero(x)
        for k in range(0, len(row), 1 << 18):
            at, q = row[k:k + (1 << 18)], slot[k:k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(q.astype(np.int32)), pa.array(x[at, q])], names=["id", "slot", "score"])

    def hub_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column("ids").to_pylist(), b.column("x").to_pylist()):
                yield from listed(np.frombuffer(ids, np.int64), _floats(x, width))

    inner, _ = saved(told().mapInArrow(scores, "id bigint, slot int, score double"), "rank-scores")
    if late or inner.where("slot < 0").limit(1).count():
        raise RuntimeError(f"the ranks still moved by more than {tol} after {steps} steps")
    outer = state.select("ids", "x").mapInArrow(hub_scores, "id bigint, slot int, score double")
    lone = alone.select("id", "slot", (F.col("r") * F.get(F.array(*map(F.lit, kept)), F.col("slot"))).alias("score"))
    found = inner.unionByName(outer).unionByName(lone).withColumn("score", F.greatest("score", F.lit(0.0)))
    return found.join(F.broadcast(slots), "slot").join(names, "id").select("qid", "node", "score")
