"""Spectral embedding of a weighted graph by block iteration in Spark.

The embedding is made of the leading eigenvectors of ``D^-1/2 W D^-1/2``, which are those of the
normalised Laplacian with the smallest eigenvalues.  ``k + EXTRA`` vectors go through rounds of

1. a Chebyshev filter: ``DEGREE`` products of the sparse matrix and the vectors.  It damps all
   eigenvalues between -1 and the smallest one that the vectors still hold;
2. Rayleigh-Ritz: the three ``b x b`` products of the vectors with themselves are summed in Spark, the
   small eigenproblem is solved in the driver, and the vectors are turned to the Ritz vectors.

Rounds end when ``|A x - theta x|`` is at most ``TOLERANCE`` for the first k vectors; the limit of
rounds raises.

Nodes are dealt to parts of at most about ``NODES``.  A part's edges stay where they are, cached; what a
product shuffles is each node's own numbers once and, in single precision, one copy for every other
part that has a neighbour of the node, instead of one for every edge.  A part draws its start from its
number and the order of its ids, so a lost executor's rows come out alike.  What reaches the driver is
``3 b^2`` numbers a round.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stored

#: Vectors beyond k, products a round, largest residual of a Ritz vector, rounds before it raises.
EXTRA, DEGREE, TOLERANCE, ROUNDS = 8, 8, 1e-2, 60
#: Nodes of a part, parts at least, where they would not have fewer than ``SMALL`` nodes.
NODES, PARTS, SMALL = 65_536, 8, 1024
#: A part's own row has no peer (-1): its node ids, and the edges of each node from ``start`` on, as places
#: among the ends and weights.  Its other rows name the nodes that a peer has as ends.
_GRAPH = "at int, peer int, ids binary, start binary, place binary, w binary"
#: To part ``at``: its own vectors (peer -1), or those of the ends that it has in part ``peer``.
_SENT = "at int, peer int, prev binary, cur binary"
log = logging.getLogger(__name__)


def _normalised(edges: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst, w): both directions of every edge over the roots of the degrees; number of nodes."""
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = stored(both.groupBy("src").agg(F.sum("weight").alias("d")), "degrees")
    scaled = (both.join(degree, "src")
              .join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
              .select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w")))
    return scaled, degree.count()


def _parts(n: int) -> int:
    return max(min(PARTS, -(-n // SMALL)), -(-n // NODES), 1)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows by their part; more partitions than parts, so that few of them hold two."""
    return df.repartition(4 * parts, "at")


def _ends(frame: pd.DataFrame) -> pd.DataFrame:
    """One part's edges as arrays, and to every part the ends that lie in it, in the order of their places."""
    at = int(frame["at"].iloc[0])
    src, dst, to, w = (frame[c].to_numpy() for c in ("src", "dst", "to", "w"))
    order = np.lexsort((dst, src))
    src, dst, to, w = src[order], dst[order], to[order], w[order]
    ids, start = np.unique(src, return_index=True)
    ends, first, place = np.unique(dst, return_index=True, return_inverse=True)
    by_part = np.lexsort((ends, to[first]))
    rank = np.empty(len(ends), np.int32)
    rank[by_part] = np.arange(len(ends), dtype=np.int32)
    ends, owner = ends[by_part], to[first][by_part]
    rows = [(at, -1, ids.tobytes(), start.astype(np.int64).tobytes(), rank[place].tobytes(), w.tobytes())]
    for part in np.unique(owner):
        rows.append((int(part), at, ends[owner == part].tobytes(), None, None, None))
    return pd.DataFrame(rows, columns=["at", "peer", "ids", "start", "place", "w"])


def _asked(frame: pd.DataFrame) -> pd.DataFrame:
    """One part's own row as it is; the ids that a peer asks for become places among its own."""
    ids = np.frombuffer(frame.loc[frame["peer"] < 0, "ids"].iloc[0], np.int64)
    peers = frame["peer"] >= 0
    frame.loc[peers, "place"] = [np.searchsorted(ids, np.frombuffer(x, np.int64)).astype(np.int32).tobytes()
                                 for x in frame.loc[peers, "ids"]]
    frame.loc[peers, "ids"] = None
    return frame


def _graph(links: DataFrame, parts: int) -> DataFrame:
    """The parts' rows (``_GRAPH``), written once and cached where their vectors will meet them."""
    def part(c: str):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(parts)).cast("int")

    split = links.select(part("src").alias("at"), part("dst").alias("to"), "src", "dst", "w")
    held = _dealt(split, parts).groupBy("at").applyInPandas(_ends, _GRAPH)
    return _dealt(stored(_dealt(held, parts).groupBy("at").applyInPandas(_asked, _GRAPH), "graph"), parts).persist()


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(width, -1)


def _shares(graph: pd.DataFrame, prev: np.ndarray, cur: np.ndarray, last: bool = False) -> pd.DataFrame:
    """What one part sends: its own vectors and, unless these are the last, to every peer those of its ends."""
    at = int(graph["at"].iloc[0])
    cur = cur.astype(np.float32)
    rows = [(at, -1, prev.astype(np.float32).tobytes(), cur.tobytes())]
    if not last:
        rows += [(int(r.peer), at, None, cur[:, np.frombuffer(r.place, np.int32)].tobytes())
                 for r in graph.itertuples() if r.peer >= 0 and r.peer != at]
    return pd.DataFrame(rows, columns=["at", "peer", "prev", "cur"])


def _ids(graph: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(graph.loc[graph["peer"] < 0, "ids"].iloc[0], np.int64)


def _started(graph: DataFrame, width: int, seed: int) -> DataFrame:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = np.random.default_rng((seed, int(own["at"].iloc[0]))).uniform(-1.0, 1.0, (len(_ids(own)), width)).T
        return _shares(own, x, x)
    return graph.groupBy("at").applyInPandas(run, _SENT)


def _step(graph: DataFrame, sent: DataFrame, parts: int, width: int, prev: float, cur: float, near: float, last: bool = False) -> DataFrame:
    """The vectors after ``prev * prev + cur * cur + near * A cur``; the old ``cur`` becomes ``prev``."""
    def run(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        at = int(own["at"].iloc[0])
        mine, edges = came[came["peer"] < 0].iloc[0], own[own["peer"] < 0].iloc[0]
        before, now = _matrix(mine["prev"], width), _matrix(mine["cur"], width)
        ends = {int(r.peer): _matrix(r.cur, width) for r in came.itertuples() if r.peer >= 0}
        inside = own[own["peer"] == at]
        if len(inside):
            ends[at] = now[:, np.frombuffer(inside["place"].iloc[0], np.int32)]
        start, place, w = (np.frombuffer(edges[c], t) for c, t in (("start", np.int64), ("place", np.int32), ("w", np.float64)))
        out = np.empty(now.shape)
        # one vector after the other: the numbers of all edges are held for one only
        for i in range(width):
            x = np.concatenate([ends[p][i] for p in sorted(ends)])
            out[i] = np.add.reduceat(w * x[place], start)
        return _shares(own, now, prev * before + cur * now.astype(np.float64) + near * out, last)

    return graph.groupBy("at").cogroup(_dealt(sent, parts).groupBy("at")).applyInPandas(run, _SENT)


def _products(block: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y'Y, Y'AY and (AY)'AY: summed in each task, then by place in Spark."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, width, width))
        for frame in frames:
            for own in frame.itertuples():
                y, ay = (_matrix(v, width).astype(np.float64) for v in (own.prev, own.cur))
                total += np.stack([y @ y.T, y @ ay.T, ay @ ay.T])
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "g": total[0].ravel(), "h": total[1].ravel(), "r": total[2].ravel()})

    out = np.zeros((3, width, width))
    parts = block.mapInPandas(run, "i int, j int, g double, h double, r double")
    for row in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "ghr"]).collect():
        out[:, row.i, row.j] = row.g, row.h, row.r
    return out[0], (out[1] + out[1].T) / 2.0, out[2]


def _ritz(g: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, turn, residuals), largest value first; directions that the block lost are left out."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    size, base = np.linalg.eigh(g * scale[:, None] * scale)
    held = size > 1e-10 * size.max()
    base = scale[:, None] * base[:, held] / np.sqrt(size[held])
    values, inner = np.linalg.eigh(base.T @ h @ base)
    values, turn = values[::-1], base @ inner[:, ::-1]
    # |A x - theta x|^2 of unit vectors x
    left = np.einsum("ij,ik,kj->j", turn, r, turn) - values ** 2
    return values, turn, np.sqrt(np.maximum(left, 0.0))


def _turned(graph: DataFrame, block: DataFrame, parts: int, width: int, turn: np.ndarray, cur: float, near: float) -> DataFrame:
    """The Ritz vectors X as ``prev`` and ``cur * X + near * A X`` as ``cur``; A X turns like X, without a product."""
    def run(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        x, ax = (turn.T @ _matrix(came[c].iloc[0], width) for c in ("prev", "cur"))
        return _shares(own, x, cur * x + near * ax)
    return graph.groupBy("at").cogroup(_dealt(block, parts).groupBy("at")).applyInPandas(run, _SENT)


def _placed(graph: DataFrame, block: DataFrame, parts: int, width: int, turn: np.ndarray) -> DataFrame:
    def run(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        x = turn.T @ _matrix(came["prev"].iloc[0], width)
        return pd.DataFrame({"id": _ids(own), "vector": list(x.T)})
    return graph.groupBy("at").cogroup(_dealt(block, parts).groupBy("at")).applyInPandas(run, "id long, vector array<double>")


def spectral_embedding(edges: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """``(id, vector)`` of every node with an edge, and the k largest eigenvalues (fewer nodes: fewer).
    ``edges``: src, dst, weight, one row per pair of different nodes, weights above zero."""
    links, n = _normalised(edges)
    parts = _parts(n)
    graph = _graph(links, parts)
    width = min(k + EXTRA, n)
    k = min(k, width)
    # with a vector for every node they hold all eigenvectors and need no filter (no edge)
    edge = 0.0 if width < n else None
    block = turn = None
    try:
        for turn_no in range(1, ROUNDS + 1):
            half, middle = ((edge + 1.0) / 2.0, (edge - 1.0) / 2.0) if edge is not None else (1.0, 0.0)
            cur, near = (-middle / half, 1.0 / half) if edge is not None else (1.0, 0.0)
            if block is None:
                sent = _started(graph, width, seed)
                if edge is not None:
                    sent = _step(graph, sent, parts, width, 0.0, cur, near)
            else:
                sent = _turned(graph, block, parts, width, turn, cur, near)
                width = turn.shape[1]
            for _ in range(DEGREE - 1 if edge is not None else 0):
                sent = _step(graph, sent, parts, width, -1.0, -2.0 * middle / half, 2.0 / half)
            block = stored(_step(graph, sent, parts, width, 0.0, 0.0, 1.0, last=True), "block")
            values, turn, residuals = _ritz(*_products(block, width))
            log.info("spectral round %d: values %s, largest residual %.4f", turn_no, values[:k], residuals[:k].max())
            if residuals[:k].max() <= TOLERANCE:
                found = stored(_placed(graph, block, parts, width, turn), "embedding")
                return found.select("id", F.slice("vector", 1, min(k, len(values))).alias("vector")), values[:k]
            edge = float(np.clip(values[-1], -0.9, 0.999)) if edge is not None else None
        raise RuntimeError(f"spectral embedding: residual {residuals[:k].max():.4f} after {ROUNDS} rounds")
    finally:
        graph.unpersist()
