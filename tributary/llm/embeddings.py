"""Embedding near-duplicates: a navigable small-world graph per shard, audited beams, exact cosine, components.

Equal vectors are taken together first. The classes of one label and dimension are
dealt by hash over shards of bounded size; each shard gets its own hierarchical
graph. Every shard of a label is queried with the vectors of every shard up to its
own (a link is found from one of its ends); a task holds one graph and one block of queries at a time. A
search keeps a beam of the best nodes; a beam full of hits is widened, at last to the whole shard. Queries are drawn
and compared to brute force until enough links between different vectors have been seen: while their recall is
below ``recall``, the beam doubles. Hits are verified by cosine in
double precision and marked in a table of one byte for each pair of a task's vectors; it returns numbers of links and a
spanning forest, never all pairs. The audits' recall is reported with the result.

Vectors that are null or empty, of zero length, with null or non-finite components,
or with a null label link with nothing and form their own components. Each row is a
vector of its own, also if it repeats another; rows that repeat a vec_id are merged
by nothing but their links. A null vec_id keeps its row and never names a component.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_size, stash
from .components import components

COSINE = 0.98
SHARD = 8192
RECALL = 0.98
#: Links between different vectors that an audit must see, unless all queries have been tried.
AUDIT_LINKS = 200
_SLACK = 1e-4  # single against double precision


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; many searches run side by side."""

    def __init__(self, x: np.ndarray, m: int = 12, beam: int = 40, seed: int = 5):
        self.x, n = x.astype(np.float32), len(x)
        self.m = m
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.level, self.entry = level, int(order[0]) if n else 0
        # Neighbours by layer, -1 where there is none; the lowest layer has twice as many.
        self.near = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(int(level.max()) + 1 if n else 1)]
        done = 1
        while done < n:
            batch = order[done : done + min(done, 256)]
            start = np.full(len(batch), self.entry)
            for layer in range(len(self.near) - 1, -1, -1):
                ids, sims = self._beam(self.x[batch], start, layer, beam)
                start = ids[:, 0]
                rows = np.flatnonzero(level[batch] >= layer)
                if len(rows):
                    self._connect(batch[rows], np.where(sims[rows] > -2, ids[rows], -1), layer)
            done += len(batch)

    def _spread(self, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """For each node, up to ``most`` of its candidates (-1: none), best first, those closer to one taken than to the node last."""
        out = np.full((len(nodes), most), -1, np.int32)
        for at in range(0, len(nodes), 512):
            n, c = nodes[at : at + 512], np.sort(near[at : at + 512], axis=1)
            fresh = (c >= 0) & (c != n[:, None])
            fresh[:, 1:] &= c[:, 1:] != c[:, :-1]
            v = self.x[np.where(fresh, c, 0)]
            sims = np.where(fresh, np.einsum("kcd,kd->kc", v, self.x[n]), -9)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            rows = np.arange(len(n))[:, None]
            sims, c, v = sims[rows, best], c[rows, best], v[rows, best]
            among = v @ v.transpose(0, 2, 1)
            taken, count, top = np.zeros(c.shape, bool), np.zeros(len(n), int), np.full(c.shape, -8.0, np.float32)
            for k in range(c.shape[1]):
                ok = (sims[:, k] > -8) & (count < most) & (top[:, k] < sims[:, k])
                taken[:, k] = ok
                count += ok
                top[ok] = np.maximum(top[ok], among[ok, k])
            rank = np.argsort(np.where(sims > -8, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :most]
            kept = np.where(sims[rows, rank] > -8, c[rows, rank], -1)
            out[at : at + 512, : kept.shape[1]] = kept
        return out

    def _connect(self, nodes: np.ndarray, found: np.ndarray, layer: int) -> None:
        """Links new nodes both ways; a node with too many new neighbours at once weighs the first of them only."""
        table = self.near[layer]
        own = self._spread(nodes, found, self.m)
        table[nodes, : self.m] = own
        to, new = own.ravel(), np.repeat(nodes, self.m)
        order = np.argsort(to, kind="stable")
        order = order[to[order] >= 0]
        to, new = to[order], new[order]
        target, first, number = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, number)
        held = place < 16
        more = np.full((len(target), 16), -1, np.int64)
        more[np.searchsorted(target, to[held]), place[held]] = new[held]
        table[target] = self._spread(target, np.hstack([table[target], more]), table.shape[1])

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of a layer for each query, best first; -3 marks no node."""
        n, table, rows = len(q), self.near[layer], np.arange(len(q))
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, start] = True
        ids, sims, fresh = np.full((n, beam), 0, np.int64), np.full((n, beam), -3.0, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = start, np.einsum("qd,qd->q", q, self.x[start]), True
        while True:
            pick = np.where(fresh, sims, -4).argmax(axis=1)
            live = np.flatnonzero(fresh[rows, pick])
            if not len(live):
                break
            fresh[live, pick[live]] = False
            near = table[ids[live, pick[live]]]
            ok = near >= 0
            safe = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], safe]
            seen[live[:, None], safe] |= ok
            s = np.where(ok, np.einsum("qd,qmd->qm", q[live], self.x[safe]), -3)
            all_s, all_i = np.hstack([sims[live], s]), np.hstack([ids[live], safe])
            all_f = np.hstack([fresh[live], ok])
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], fresh[live] = (np.take_along_axis(a, best, 1) for a in (all_s, all_i, all_f))
            fresh[live] &= sims[live] > -2
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(rows of q, their hits) in turn: nodes whose cosine is at least ``least``, or None where the whole shard is to be weighed.

        A beam that holds nothing but hits may leave some out, so it is widened, at last to the whole shard.
        """
        q = q.astype(np.float32)
        for at in range(0, len(q), 256):
            rows, wide = np.arange(at, min(at + 256, len(q))), beam
            while len(rows):
                if 4 * wide >= len(self.x):
                    yield rows, None
                    break
                start = np.full(len(rows), self.entry)
                for layer in range(len(self.near) - 1, 0, -1):
                    start = self._beam(q[rows], start, layer, 4)[0][:, 0]
                ids, sims = self._beam(q[rows], start, 0, wide)
                hit = sims >= least
                full = hit.all(axis=1)
                for k in np.flatnonzero(~full & hit.any(axis=1)).tolist():
                    yield rows[k : k + 1], ids[k][hit[k]]
                rows, wide = rows[full], 4 * wide


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _truth(graph: Graph, q: np.ndarray, least: float, same: bool, links: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Queries in an order of chance and the nodes each must find by brute force, until ``links`` links are seen or all queries."""
    order, rows, true, seen = np.random.default_rng(9).permutation(len(q)), [], [], 0
    for at in range(0, len(q), 64):
        own = order[at : at + 64]
        near = q[own].astype(np.float32) @ graph.x.T >= least
        if same:
            near[np.arange(len(own)), own] = False
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            rows.append(own[k])
            true.append(np.flatnonzero(near[k]))
            seen += len(true[-1])
        if seen >= links:
            break
    return np.array(rows, np.int64), true


def audited(graph: Graph, q: np.ndarray, least: float, same: bool, recall: float = RECALL, links: int = AUDIT_LINKS, beam: int = 32) -> tuple[int, int, int]:
    """A beam whose recall, the mean over queries with links to other vectors, reaches ``recall``; links audited and found."""
    rows, true = _truth(graph, q, least, same, links)
    seen = sum(map(len, true))
    while True:
        found = np.zeros(len(rows), np.int64)
        for k, hits in graph.within(q[rows], least, beam):
            for i in k.tolist():
                found[i] = len(true[i]) if hits is None else len(np.intersect1d(true[i], hits))
        if not len(rows) or np.mean(found / [len(t) for t in true]) >= recall or 4 * beam >= len(graph.x):
            return beam, seen, int(found.sum())
        beam *= 2


def linked(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, same: bool, beam: int) -> np.ndarray:
    """Queries by nodes: whether the pair was found and its cosine, in double precision, is enough. One byte for a pair of vectors of two shards."""
    out = np.zeros((len(q), len(x)), bool)
    for rows, hits in graph.within(q, cosine - _SLACK, beam):
        if hits is None:
            out[rows] = q[rows] @ x.T >= cosine
        else:
            out[rows[0], hits] = x[hits] @ q[rows[0]] >= cosine
    if same:
        out |= out.T  # a link may be found from either end
        np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """(root, node) for each node of each component; of two shards, nodes follow queries in number."""
    n = len(links)
    left = np.concatenate([links.any(axis=1), [] if same else links.any(axis=0)]).astype(bool)
    while left.any():
        root = int(left.argmax())
        left[root] = False
        edge = np.array([root])
        while len(edge):
            step = np.zeros(len(left), bool)
            if same:
                step = links[edge].any(axis=0)
            else:
                step[n:] = links[edge[edge < n]].any(axis=0)
                step[:n] = links[:, edge[edge >= n] - n].any(axis=1)
            edge = np.flatnonzero(step & left)
            left[edge] = False
            for k in edge.tolist():
                yield root, k


_FOUND = "id long, other long, weight long, seen long, hit long"


def _searched(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One graph and some blocks of queries: (id, linked weight), forest links (id, other) and audits (links seen, found)."""
    pdf = pdf.sort_values("q")
    graph, ids, size, x = pickle.loads(pdf["blob"].iloc[0])
    rows = []
    for blob, same in zip(pdf["blob"].iloc[1:], pdf["q"].iloc[1:] == pdf["g"].iloc[0], strict=True):
        q_ids, q_size, q = pickle.loads(blob)
        beam, seen, hit = audited(graph, q, cosine - _SLACK, same)
        links = linked(graph, x, q, cosine, same, beam)
        names = q_ids if same else np.concatenate([q_ids, ids])
        weight = np.concatenate([links[k : k + 256] @ size for k in range(0, len(links), 256)])
        if not same:
            weight = np.concatenate([weight, *(q_size @ links[:, k : k + 256] for k in range(0, links.shape[1], 256))])
        rows.append((None, None, None, seen, hit))
        rows += [(int(names[k]), None, int(weight[k]), None, None) for k in np.flatnonzero(weight).tolist()]
        rows += [(int(names[a]), int(names[b]), None, None, None) for a, b in _forest(links, same)]
    return pd.DataFrame(rows, columns=["id", "other", "weight", "seen", "hit"]).astype("Int64")


#: Blocks of queries that meet one copy of a graph.
SLICE = 8


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; the audits' links and recall, equal in all rows.

    An empty table gives an empty table; other columns of vectors are not looked at.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & (F.size("v") > 0) & F.exists("v", lambda x: x != 0) & (square >= 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    classes = stash(
        rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
        .withColumn("id", F.monotonically_increasing_id()).withColumn("d", F.size("v"))
    )
    shards = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))
    dealt = classes.join(shards, ["label", "d"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("shards")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, size = pdf["id"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        x = np.vstack(list(pdf["v"]))
        x = _unit(x / np.abs(x).max(axis=1, keepdims=True))
        one = pdf.iloc[:1][["label", "d", "s", "shards"]].reset_index(drop=True)
        one["graph"], one["query"] = [pickle.dumps((Graph(x), ids, size, x))], [pickle.dumps((ids, size, x))]
        return one

    label_type = dict(rows.dtypes)["label"]
    built = stash(dealt.select("label", "d", "s", "shards", "id", "size", "v").groupBy("label", "d", "s").applyInPandas(build, f"label {label_type}, d int, s long, shards long, graph binary, query binary"))
    # Two shards meet at one of them: at the other's left by at most half the ring of shards, so all graphs get as many queries.
    half = F.floor(F.col("shards") / 2)
    graphs = built.select("label", "d", F.col("s").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(half / SLICE))).alias("part"), F.lit(-1).cast("long").alias("q"), F.col("graph").alias("blob"))
    turns = built.select("label", "d", "shards", F.col("s").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), half)).alias("turn"), "query")
    asked = turns.withColumn("g", F.pmod(F.col("q") - F.col("turn"), F.col("shards"))).where((F.col("turn") * 2 != F.col("shards")) | (F.col("g") < F.col("q")))
    asked = asked.select("label", "d", "g", F.floor(F.col("turn") / SLICE).alias("part"), "q", F.col("query").alias("blob"))
    found = stash(graphs.union(asked).groupBy("label", "d", "g", "part").applyInPandas(lambda pdf: _searched(pdf, cosine), _FOUND))
    audit = found.agg(F.sum("hit"), F.sum("seen")).first()
    weights = found.where("weight is not null").groupBy("id").agg(F.sum("weight").alias("weight"))
    root = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("id"), "component")
    placed = stash(classes.join(weights, "id", "left").join(root, "id", "left").select("label", "v", "size", "least", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("component", "id").alias("component")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    total = placed.count()
    known = joined_by_size(placed, least, "component", "members", total).select(F.struct("label", "v").alias("key"), "size", (F.col("weight") + F.col("size") - 1).alias("n_links"), "component_id")
    good = rows.where("v is not null").select("vec_id", F.struct("label", "v").alias("key"))
    named = joined_by_size(good, stash(known), "key", "size", int(placed.agg(F.sum("size")).first()[0] or 0)).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("audited_links", F.lit(int(audit[1] or 0)).cast("long")).withColumn("audited_recall", F.lit(audit[0] / audit[1] if audit[1] else 1.0))
