"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a count. Nodes are dealt by a hash into shards (``SHARDS``, more where a shard would
pass ``SHARD_ROWS`` rows or ``SHARD_BYTES``); a task builds the graph of a shard, in the order of another hash, and links
what can't be reached from its entry. Every node then queries its own shard and half of the others (``_searched``), so that any two
shards meet once, and a link between them counts at both ends. A query goes on through every node that is a
link, and through ``beam`` others beside them, so the beam widens with the links of the query and no number of them fills
it. It starts at ``BEAM``, or a row in ``BEAM_ROWS`` of a larger shard, and doubles until the task's recall audit passes. The
audit holds against all rows of the shard what ``AUDIT`` queries find beside themselves, and what ``PROBES`` planted ones find:
queries that are moved away from, or towards, their nearest row of the shard until that is just a link, so that there is
evidence where links are rare. These rows are the only ones that are ever gone through whole. A beam as wide as the shard
reaches all of it, so the audit ends. Cosines are verified in double precision.

Links are counted where they are found. For the components, a task joins what it finds in a union-find and hands on a
spanning forest, never the pairs: it has at most one row for each node that the task has seen.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
vectors of different lengths; repeated rows of one id each count as a vector, and a null id takes no part in a
component's smallest id but for its own. Extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.graph import connected_components
from cadastra.llm.shingles import mixed
from cadastra.llm.vectors import unpack, usable
from cadastra.runtime import Workspace, ship_package

THRESHOLD = 0.9
SHARDS, SHARD_ROWS, SHARD_BYTES = 6, 50_000, 256_000_000
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 32, 16
BEAM_ROWS = 250
AUDIT, PROBES, RECALL = 48, 200, 0.995
QUERY_BLOCK, BLOCKS_PER_TASK = 1024, 64
GRAPHS = "dim int, shard int, ids binary, counts binary, data binary, levels binary, links binary"


class Hnsw:
    """A graph over unit vectors (float32) by cosine. Levels come from a fixed seed, so a task run again builds the same."""

    def __init__(self, unit: np.ndarray, neighbours: int = NEIGHBOURS, build_beam: int = BUILD_BEAM) -> None:
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        self.m, self.build_beam = neighbours, build_beam
        draws = np.random.default_rng(7).random(len(unit))
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(neighbours)).astype(int), 12)
        self.links: list[list[list[int]]] = [[] for _ in range(int(self.levels.max(initial=0)) + 1)]
        for layer in self.links:
            layer.extend([] for _ in range(len(unit)))
        self.entry = -1
        for node in range(len(unit)):
            self._insert(node)
        self._join_up()

    def _join_up(self) -> None:
        """Links every node of the lowest layer that no path from the entry reaches."""
        if self.entry < 0:
            return
        layer, seen = self.links[0], {self.entry}

        def spread(ahead: list[int]) -> None:
            while ahead:
                fresh = [n for n in layer[ahead.pop()] if n not in seen]
                seen.update(fresh)
                ahead += fresh

        spread([self.entry])
        for node in range(len(self.unit)):
            if node not in seen:
                layer[next((n for n in layer[node] if n in seen), self.entry)].append(node)
                seen.add(node)
                spread([node])

    def packed(self) -> tuple[bytes, bytes]:
        """Levels and links, the latter as rows of (layer, node, number of links, links)."""
        flat: list[int] = [self.entry]
        for layer, nodes in enumerate(self.links):
            for node, mine in enumerate(nodes):
                if mine:
                    flat += [layer, node, len(mine), *mine]
        return self.levels.astype("<i4").tobytes(), np.array(flat, dtype="<i4").tobytes()

    @classmethod
    def unpacked(cls, unit: np.ndarray, levels: bytes, links: bytes) -> Hnsw:
        graph = cls(unit[:0])
        graph.unit = np.ascontiguousarray(unit, dtype=np.float32)
        graph.levels = np.frombuffer(levels, dtype="<i4").astype(int)
        graph.links = [[[] for _ in range(len(unit))] for _ in range(int(graph.levels.max(initial=0)) + 1)]
        flat = np.frombuffer(links, dtype="<i4").tolist()
        graph.entry, at = flat[0], 1
        while at < len(flat):
            layer, node, count = flat[at : at + 3]
            graph.links[layer][node] = flat[at + 3 : at + 3 + count]
            at += 3 + count
        return graph

    def _search(self, q: np.ndarray, starts: list[tuple[float, int]], layer: int, beam: int) -> list[tuple[float, int]]:
        """Best ``beam`` of (cosine, node) from ``starts``, unsorted heap with the worst first."""
        links, unit = self.links[layer], self.unit
        seen = {n for _, n in starts}
        best = list(starts)
        heapq.heapify(best)
        ahead = [(-s, n) for s, n in starts]
        heapq.heapify(ahead)
        while ahead:
            score, node = heapq.heappop(ahead)
            if len(best) >= beam and -score < best[0][0]:
                break
            fresh = [n for n in links[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, n in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(ahead, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(ahead, (-s, n))
        return best

    def _spread(self, near: list[tuple[float, int]], count: int) -> list[int]:
        """Neighbours that lie nearer to the node than to one another, then the nearest of the rest."""
        near = sorted(near, reverse=True)
        if len(near) <= count:
            return [n for _, n in near]
        nodes = [n for _, n in near]
        between = self.unit[nodes] @ self.unit[nodes].T
        chosen: list[int] = []
        for i, (score, _) in enumerate(near):
            if len(chosen) == count:
                break
            if not chosen or between[i, chosen].max() < score:
                chosen.append(i)
        for i in range(len(near)):
            if len(chosen) >= count:
                break
            if i not in chosen:
                chosen.append(i)
        return [nodes[i] for i in chosen]

    def _insert(self, node: int) -> None:
        level, q = int(self.levels[node]), self.unit[node]
        if self.entry < 0:
            self.entry = node
            return
        top = int(self.levels[self.entry])
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for layer in range(top, level, -1):
            at = [max(self._search(q, at, layer, 1))]
        for layer in range(min(top, level), -1, -1):
            at = self._search(q, at, layer, self.build_beam)
            most = 2 * self.m if layer == 0 else self.m
            mine = self._spread(at, self.m)
            self.links[layer][node] = mine
            for other in mine:
                theirs = self.links[layer][other]
                theirs.append(node)
                if len(theirs) > most:
                    scores = (self.unit[theirs] @ self.unit[other]).tolist()
                    self.links[layer][other] = self._spread(list(zip(scores, theirs, strict=True)), most)
        if level > top:
            self.entry = node

    def query(self, q: np.ndarray, beam: int, least: float = np.inf) -> list[tuple[float, int]]:
        """(cosine, node) of what lies at ``least`` or nearer, and of the ``beam`` nearest others."""
        if self.entry < 0:
            return []
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = [max(self._search(q, at, layer, 1))]
        links, unit = self.links[0], self.unit
        near, others = [x for x in at if x[0] >= least], [x for x in at if x[0] < least]
        seen, ahead = {n for _, n in at}, [(-s, n) for s, n in at]
        while ahead:
            score, node = heapq.heappop(ahead)
            if len(others) >= beam and -score < others[0][0]:
                break
            fresh = [n for n in links[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, n in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if s >= least:
                    near.append((s, n))
                elif len(others) < beam:
                    heapq.heappush(others, (s, n))
                elif s > others[0][0]:
                    heapq.heapreplace(others, (s, n))
                else:
                    continue
                heapq.heappush(ahead, (-s, n))
        return near + others


def unit_rows(data: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that squares of very large or small components stay finite."""
    data = data / np.abs(data).max(1, keepdims=True)
    return data / np.sqrt((data * data).sum(1, keepdims=True))


class Forest:
    """Union-find over row numbers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def rows(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.parent]


def _at_threshold(unit: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """``queries`` turned about their nearest row (their own one in ``own`` aside) until its cosine is just ``threshold``."""
    scores = queries @ unit.T
    inside = np.flatnonzero(own >= 0)
    scores[inside, own[inside]] = -2
    near = unit[scores.argmax(1)]
    aside = queries - (queries * near).sum(1, keepdims=True) * near
    length = np.sqrt((aside * aside).sum(1, keepdims=True))
    cosine = min(1.0, threshold + 1e-6)
    return np.where(length > 1e-6, cosine * near + np.sqrt(1 - cosine * cosine) * aside / np.maximum(length, 1e-6), near)


def audited_beam(unit: np.ndarray, queries: np.ndarray, graph: Hnsw, threshold: float, beam: int = BEAM, own: np.ndarray | None = None) -> int:
    """The beam that passes the recall audit; ``own``: the row that a query itself is, or -1."""
    own = np.full(len(queries), -1) if own is None else own

    def spread(count: int) -> np.ndarray:
        return np.unique(np.linspace(0, len(queries) - 1, min(count, len(queries))).astype(np.int64))

    beam = max(beam, len(unit) // BEAM_ROWS)
    if not len(unit) or not len(queries):
        return beam
    few, some = spread(AUDIT), spread(PROBES)
    asked = np.concatenate([queries[few], _at_threshold(unit, queries[some], own[some], threshold)])
    mine = np.concatenate([own[few], np.full(len(some), -1)])
    slack = threshold - 1e-4
    hits = asked @ unit.T >= threshold
    truth = [np.setdiff1d(np.flatnonzero(row), [m]) for row, m in zip(hits, mine, strict=True)]
    while beam < len(unit):
        got = [[n for _, n in graph.query(q.astype(np.float32), beam, slack)] for q in asked]
        there = [len(np.intersect1d(t, g)) for t, g in zip(truth, got, strict=True)]
        wanted = [len(t) for t in truth]
        # each kind by itself: links of a group that are easily found don't speak for rare ones
        if all(sum(there[part]) >= RECALL * sum(wanted[part]) for part in (slice(len(few)), slice(len(few), None))):
            break
        beam *= 2
    return beam


def shard_links(unit: np.ndarray, queries: np.ndarray, graph: Hnsw, threshold: float, beam: int = 0) -> list[np.ndarray]:
    """For each query, the rows of the shard with a cosine of at least ``threshold`` that ``beam`` (0: the one that an audit passes) finds."""
    slack, beam = threshold - 1e-4, beam or audited_beam(unit, queries, graph, threshold)
    out = []
    for q in queries:
        rows = np.array([n for s, n in graph.query(q.astype(np.float32), beam, slack) if s >= slack], dtype=np.int64)
        out.append(rows[unit[rows] @ q >= threshold] if len(rows) else rows)
    return out


def _build(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    # neighbours of one group, whose ids may follow one another, are not inserted in a row
    nodes = nodes.iloc[np.lexsort((nodes["id"], mixed(nodes["id"].to_numpy().astype(np.uint64))))]
    data = np.array(nodes["values"].tolist(), dtype=np.float64)
    levels, links = Hnsw(unit_rows(data)).packed()
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [nodes["id"].to_numpy("<i8").tobytes()], "counts": [nodes["count"].to_numpy("<i8").tobytes()], "data": [data.tobytes()], "levels": [levels], "links": [links]})


def _task(threshold: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})

    def run(key: tuple, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return empty
        dim, row = int(key[0]), shard.iloc[0]
        ids, data = unpack(row["ids"], row["data"], dim)
        counts, unit = np.frombuffer(row["counts"], dtype="<i8"), unit_rows(data)
        graph = Hnsw.unpacked(unit, row["levels"], row["links"])
        forest, parts, beam = Forest(), [], 0
        order, back = np.argsort(ids, kind="stable"), np.zeros(len(ids), dtype=np.int64)
        for of, block_ids, block_counts, block_data in zip(asked["of"], asked["ids"], asked["counts"], asked["data"], strict=True):
            query_ids, queries = unpack(block_ids, block_data, dim)
            totals = []
            place = order[np.minimum(np.searchsorted(ids[order], query_ids), len(ids) - 1)]
            own = np.where(ids[place] == query_ids, place, -1)
            turned = unit_rows(queries)
            # once for a task: what is gone through whole doesn't grow with the queries
            beam = beam or audited_beam(unit, turned, graph, threshold, own=own)
            found_rows = shard_links(unit, turned, graph, threshold, beam)
            for q, count, rows in zip(query_ids.tolist(), np.frombuffer(block_counts, dtype="<i8").tolist(), found_rows, strict=True):
                rows = rows[ids[rows] != q]
                totals.append(int(counts[rows].sum()))
                if of != key[1]:
                    # the rows of another shard don't ask in turn; a row is found once
                    back[rows] += count
                for other in ids[rows].tolist():
                    forest.join(q, other)
            found = pd.DataFrame({"node": query_ids, "links": totals, "root": query_ids})
            parts.append(found[found["links"] > 0])
        linked = np.flatnonzero(back)
        parts.append(pd.DataFrame({"node": ids[linked], "links": back[linked], "root": ids[linked]}))
        parts.append(pd.DataFrame(forest.rows(), columns=["node", "root"], dtype="int64").assign(links=0)[["node", "links", "root"]])
        return pd.concat(parts)

    return run


def _blocks(graphs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A shard's nodes as blocks of queries, with the shard that they are ``of``."""
    for frame in graphs:
        for dim, of, ids, counts, data in frame.itertuples(index=False):
            for block, at in enumerate(range(0, len(ids) // 8, QUERY_BLOCK)):
                cut = lambda raw, width, at=at: raw[at * width : (at + QUERY_BLOCK) * width]
                yield pd.DataFrame({"dim": [dim], "of": [of], "block": [block], "ids": [cut(ids, 8)], "counts": [cut(counts, 8)], "data": [cut(data, 8 * dim)]})


def _searched(shards: int) -> Column:
    """The shards whose graphs the nodes ``of`` a shard query: its own and the half that follow it, so that any two shards meet once."""
    after = F.transform(F.sequence(F.lit(0), F.lit((shards - 1) // 2)), lambda d: F.pmod(F.col("of") + d, F.lit(shards)))
    opposite = F.when(F.lit(shards % 2 == 0) & (F.col("of") < shards // 2), F.array(F.col("of") + shards // 2)).otherwise(F.array().cast("array<int>"))
    return F.concat(after, opposite)


def near_duplicates(vectors: DataFrame, workspace: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors``: vec_id long, embedding. Returns vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    ship_package(spark)
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", usable(F.col("embedding"), nonzero=True).alias("fine"), F.xxhash64(values).alias("h1"), F.xxhash64(F.lit("second"), values).alias("h2"), values.alias("values"))
    nodes = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("count"), F.first("values").alias("values"))
    nodes = workspace.save(nodes.where("id IS NOT NULL"), "nodes")
    total = nodes.count()
    longest = nodes.agg(F.max(F.size("values"))).first()[0] or 1
    shards = max(SHARDS, -(-total // SHARD_ROWS), -(-total * longest * 8 // SHARD_BYTES))
    in_shard = nodes.select(F.size("values").alias("dim"), F.pmod(F.xxhash64("h1", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "id", "count", "values")
    graphs = workspace.save(in_shard.groupBy("dim", "shard").applyInPandas(_build, GRAPHS), "graphs")
    asked = workspace.save(graphs.select("dim", "shard", "ids", "counts", "data").mapInPandas(_blocks, "dim int, of int, block int, ids binary, counts binary, data binary"), "queries")
    # as many groups as keep every core busy twice, more where a group would hold too many query blocks
    slots = max(1, -(-2 * spark.sparkContext.defaultParallelism // shards), -(-asked.count() // BLOCKS_PER_TASK))
    left = graphs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = asked.select("dim", "of", "ids", "counts", "data", F.pmod(F.xxhash64("of", "block"), F.lit(slots)).cast("int").alias("slot"), F.explode(_searched(shards)).alias("shard"))
    keys = ["dim", "shard", "slot"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_task(threshold), "node long, links long, root long")
    found = workspace.save(found, "found")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("src"), F.col("root").alias("dst")).where("src <> dst")
    components = connected_components(edges, workspace)
    known = nodes.select("h1", "h2", F.col("id").alias("node"), "count").join(links, "node", "left").join(components, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = rows.select("vec_id", "fine", "h1", "h2").join(known, ["h1", "h2"], "left")
    mine = F.when(F.col("fine"), F.col("c"))
    out = out.select("vec_id", F.when(F.col("fine"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.coalesce(mine, "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Workspace(spark, "hnsw"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN least l ON l.x = e.vec_id
"""
