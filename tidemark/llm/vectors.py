"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors of a label are merged; everything below works on the distinct ones, weighted by their copies.
2. Shards: a label with more than ``SHARD`` vectors is split by spherical k-means (fitted per cell on about
   ``SAMPLE`` vectors with the smallest hashes), each vector joining its ``overlap`` nearest centroids; cells
   that are still too large are split again.  What cannot be split that way (a very large tight ball) is cut
   into blocks, and every pair of blocks becomes a shard, so nothing is capped.
3. Build: every shard prunes each vector's nearest and a few far candidates robustly (``ALPHA``), with reverse
   edges; adjacency lists of overlapping shards are united per vector.
4. Search: in each shard all its vectors search at once, greedily with a beam from the shard's medoids; then
   the range is expanded: every found vector within the threshold is expanded in turn until none is new.
   A link is verified by the cosine in double precision.
5. A pair that several shards hold is counted in the first of them only, and a shard emits counts and a
   spanning forest of its links, so the rows made stay in proportion to the vectors.
6. Audit: for a fixed sample of at most ``AUDIT`` vectors the links are counted exactly against all vectors;
   below ``MIN_RECALL`` everything is done again with one more overlapping shard.

Edge cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing and are their own component; vectors of different length never link; repeated rows are copies;
null ids are allowed and never name a component unless all its ids are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lookup_join, table
from .components import connected_components

THRESHOLD = 0.93
SHARD = 6000
SAMPLE = 8192
MAX_SPLIT = 64
LEVELS = 4
OVERLAP = 3
ALPHA = 1.2
DEGREE = 24
CANDIDATES = 48
BEAM = 16
AUDIT = 256
MIN_RECALL = 0.95
ATTEMPTS = 4


def _valid(x) -> F.Column:
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, gid; null: links with nothing) and distinct vectors (gid, cell, x, copies)."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double") + 0.0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    good = F.col("label").isNotNull() & _valid(F.col("x"))
    rows = rows.withColumn("gid", F.when(good, F.xxhash64("label", "x")))
    one = (rows.where("gid is not null").groupBy("gid").agg(F.first("label").alias("label"), F.first("x").alias("x"),
                                                            F.count(F.lit(1)).alias("copies"))
           .select("gid", F.xxhash64(F.col("label"), F.size("x")).alias("cell"), "x", "copies"))
    return rows.select("id", "gid"), one


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of ``x``."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        best = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def shards(one: DataFrame, overlap: int, limit: int = SHARD) -> DataFrame:
    """(cell, gid, x, copies): distinct vectors in every shard they belong to."""
    members = checkpoint(one.select("cell", "gid", "x", "copies"))

    def centroids(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gid")
        k = int(min(MAX_SPLIT, max(2, np.ceil(g["n"].iloc[0] / (0.5 * limit)))))
        c = _kmeans(_unit(g["x"]), min(k, len(g)))
        return pd.DataFrame({"ccell": [g["cell"].iloc[0]], "k": [len(c)], "c": [c.astype("<f8").tobytes()]})

    for level in range(LEVELS):
        big = checkpoint(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        if big.isEmpty():
            return members
        names = big.select(F.col("cell").alias("bcell"), "n")
        inside = lookup_join(members, names, F.col("cell") == F.col("bcell"), "inner").drop("bcell")
        rank = F.pmod(F.xxhash64("gid", F.lit(level)), F.lit(1 << 30)).cast("double") / float(1 << 30)
        fitted = checkpoint(inside.where(rank * F.col("n") < float(SAMPLE)).groupBy("cell")
                            .applyInPandas(centroids, "ccell long, k int, c binary"))
        t = overlap if level == 0 else 2

        def assign(parts: Iterator[pd.DataFrame], t: int = t) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for k, g in p.groupby("ccell", sort=False):
                    c = np.frombuffer(g["c"].iloc[0], "<f8").reshape(int(g["k"].iloc[0]), -1)
                    near = np.argsort(-(_unit(g["x"]) @ c.T), axis=1, kind="stable")[:, :t]
                    out.append(pd.DataFrame({"old": np.repeat(g["cell"].to_numpy(), near.shape[1]), "part": near.ravel(),
                                             "gid": np.repeat(g["gid"].to_numpy(), near.shape[1]),
                                             "x": np.repeat(g["x"].to_numpy(), near.shape[1]),
                                             "copies": np.repeat(g["copies"].to_numpy(), near.shape[1])}))
                if out:
                    yield pd.concat(out)

        x = lookup_join(members, fitted, F.col("cell") == F.col("ccell"), "inner", 500)
        split = (x.mapInPandas(assign, "old long, part int, gid long, x array<double>, copies long")
                 .select(F.xxhash64("old", "part").alias("cell"), "gid", "x", "copies"))
        rest = lookup_join(members, names, F.col("cell") == F.col("bcell"), "left_anti")
        members = checkpoint(rest.unionByName(split))
    return _blocks(members, 2 * limit)


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Cells of more than ``most`` vectors as shards of every two blocks (each of half as many)."""
    n = checkpoint(members.groupBy(F.col("cell").alias("bcell")).agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(most)).cast("int").alias("b")).where("b > 2"))
    if n.isEmpty():
        return members
    x = lookup_join(members, n, F.col("cell") == F.col("bcell"), "inner")
    mine = F.pmod(F.xxhash64("gid", F.lit(77)), F.col("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.xxhash64(F.col("cell"), F.least(j, mine), F.greatest(j, mine)))
    cut = x.select(F.explode(pairs).alias("cell"), "gid", "x", "copies")
    return checkpoint(lookup_join(members, n, F.col("cell") == F.col("bcell"), "left_anti").unionByName(cut))


def build_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of unit vectors, with reverse edges."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    x = x.astype(np.float32)
    take, far = min(candidates, n - 1), min(8, n - 1)
    out: list[np.ndarray] = []
    random = np.random.default_rng(7).integers(0, n, (n, far))
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        s = x[rows] @ x.T
        s[np.arange(rows.size), rows] = -2
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        cand = np.concatenate((near, random[rows]), 1)
        d = np.take_along_axis(s, cand, 1)
        by = np.argsort(-d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, by, 1), np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(d, by, 1)))
        v = x[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        alive = cand != rows[:, None]
        picked = np.zeros_like(alive)
        for j in range(cand.shape[1]):
            use = alive[:, j] & (picked.sum(1) < degree)
            picked[:, j] = use
            covered = alpha * between[:, j, :] <= d
            covered[:, :j + 1] = False
            alive &= ~(covered & use[:, None])
        out += [cand[i][picked[i]] for i in range(rows.size)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, nb in enumerate(out):
        for j in nb.tolist():
            if len(back[j]) < degree:
                back[j].append(i)
    return [np.unique(np.concatenate((nb, np.array(b, np.int64)))) for nb, b in zip(out, back)]


def medoids(x: np.ndarray, most: int = 16) -> np.ndarray:
    """Rows nearest to the shard's centre and to the centres of a few parts of it."""
    c = np.vstack([x.mean(0, keepdims=True), _kmeans(x, min(most, len(x)), 3)])
    return np.unique((c @ x.T).argmax(1))


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, threshold: float, beam: int = BEAM, width: int = 4,
                 block: int = 256) -> np.ndarray:
    """Matrix of found pairs of unit vectors, verified in double precision.

    Greedy: a block of queries moves together, each expanding the best ``width`` unexpanded nodes of its beam
    until none is left.  Range: everything found within the threshold is expanded too, until nothing is new.
    ``graph`` is an array of neighbours, padded with -1.
    """
    n, x32 = len(x), x.astype(np.float32)
    found = np.zeros((n, n), bool)
    for a in range(0, n, block):
        q = np.arange(a, min(n, a + block))
        k = q.size
        seen, expanded = np.zeros((k, n), bool), np.zeros((k, n), bool)
        turn = np.zeros((k, n), np.int32)
        hits = found[a:a + k]

        def look(r: np.ndarray, nodes: np.ndarray, q=q, seen=seen, turn=turn, hits=hits) -> np.ndarray:
            """Similarity of pairs seen for the first time (others: -2); those in range become hits."""
            out = np.full(nodes.size, -2.0, np.float32)
            new = np.flatnonzero((nodes >= 0) & ~seen[r, nodes])
            turn[r[new], nodes[new]] = new
            new = new[turn[r[new], nodes[new]] == new]  # of equal pairs, one
            seen[r[new], nodes[new]] = True
            for c in range(0, new.size, 100_000):
                at = new[c:c + 100_000]
                out[at] = np.einsum("ij,ij->i", x32[q[r[at]]], x32[nodes[at]])
            at = new[out[new] >= threshold - 1e-3]
            at = at[np.einsum("ij,ij->i", x[q[r[at]]], x[nodes[at]]) >= threshold]
            hits[r[at], nodes[at]] = True
            return out

        ids = np.full((k, beam), -1, np.int64)
        sim = np.full((k, beam), -2.0, np.float32)
        nodes = np.broadcast_to(starts, (k, starts.size))
        new = look(np.repeat(np.arange(k), starts.size), nodes.ravel()).reshape(k, -1)
        while True:
            every, val = np.concatenate((ids, nodes), 1), np.concatenate((sim, new), 1)
            top = np.argpartition(-val, beam - 1, axis=1)[:, :beam]
            ids, sim = np.take_along_axis(every, top, 1), np.take_along_axis(val, top, 1)
            open_ = np.where((sim > -2.0) & ~expanded[np.arange(k)[:, None], ids], sim, -2.0)
            best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            go = np.take_along_axis(open_, best, 1) > -2.0
            if not go.any():
                break
            r, c = np.nonzero(go)
            node = ids[r, best[r, c]]
            expanded[r, node] = True
            nb = graph[node]
            nodes = np.full((k, width, graph.shape[1]), -1, np.int64)
            new = np.full(nodes.shape, -2.0, np.float32)
            nodes[r, c] = nb
            new[r, c] = look(np.repeat(r, nb.shape[1]), nb.ravel()).reshape(nb.shape)
            nodes, new = nodes.reshape(k, -1), new.reshape(k, -1)
        while True:
            r, node = np.nonzero(hits & ~expanded)
            if not r.size:
                break
            r, node = r[:8192], node[:8192]  # the rest in the next round
            expanded[r, node] = True
            nb = graph[node]
            look(np.repeat(r, nb.shape[1]), nb.ravel())
    for a in range(0, n, 1024):  # a link found from either side
        for b in range(a, n, 1024):
            both = found[a:a + 1024, b:b + 1024] | found[b:b + 1024, a:a + 1024].T
            found[a:a + 1024, b:b + 1024] = both
            found[b:b + 1024, a:a + 1024] = both.T
    np.fill_diagonal(found, False)
    return found


def _forest(found: np.ndarray) -> list[tuple[int, int]]:
    left = np.ones(len(found), bool)
    out = []
    for i in range(len(found)):
        if left[i]:
            left[i] = False
            todo = [i]
            while todo:
                a = todo.pop()
                for b in np.flatnonzero(found[a] & left).tolist():
                    left[b] = False
                    todo.append(b)
                    out.append((a, b))
    return out


def find_links(one: DataFrame, threshold: float, overlap: int, limit: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(gid, links) counts of links to other distinct vectors, weighted by copies, and (a, b) edges that span them."""
    members = shards(one, overlap, limit)
    cells = members.groupBy(F.col("gid").alias("g")).agg(F.array_sort(F.collect_set("cell")).alias("cells"))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gid")
        ids = g["gid"].to_numpy()
        return pd.DataFrame({"g2": ids, "near": [ids[nb] for nb in build_graph(_unit(g["x"]))]})

    graph = (members.select("cell", "gid", "x").groupBy("cell").applyInPandas(build, "g2 long, near array<long>")
             .groupBy("g2").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    whole = (members.join(cells, F.col("gid") == F.col("g")).join(graph, F.col("gid") == F.col("g2"))
             .select("cell", "gid", "x", "copies", "cells", "near"))

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gid").reset_index(drop=True)
        ids, x, here = g["gid"].to_numpy(), _unit(g["x"]), int(g["cell"].iloc[0])
        lists = []
        for near in g["near"]:  # the united list, as far as it lies in this shard
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            lists.append(at[ids[at] == near])
        padded = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        for i, nb in enumerate(lists):
            padded[i, :len(nb)] = nb
        found = range_search(x, padded, medoids(x), threshold)
        edges = _forest(found)
        earlier: dict[int, list[int]] = {}
        for i, cs in enumerate(g["cells"]):
            for c in cs:
                if c < here:
                    earlier.setdefault(int(c), []).append(i)
        for rows in earlier.values():  # pairs that an earlier shard holds too
            found[np.ix_(rows, rows)] = False
        copies = g["copies"].to_numpy(np.float64)  # exact below 2^53
        links = np.concatenate([found[i:i + 512] @ copies for i in range(0, len(ids), 512)]).astype(np.int64)
        some = np.flatnonzero(links)
        a = [ids[i] for i, _ in edges] + ids[some].tolist()
        b = [ids[j] for _, j in edges] + [None] * some.size
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": [0] * len(edges) + links[some].tolist()})

    out = checkpoint(whole.groupBy("cell").applyInPandas(search, "a long, b long, links long"))
    counts = out.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("links").alias("links"))
    return counts, out.where("b is not null").select("a", "b")


def audit_recall(one: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Links found over links there are, for the ``sample`` vectors with the smallest hashes, against all vectors."""
    picked = one.orderBy(F.xxhash64("gid"), "gid").limit(sample)  # a bounded set of queries
    q = picked.join(counts.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g"), "left").select(
        "gid", "cell", "x", F.coalesce("links", F.lit(0)).alias("links")).toPandas()
    if q.empty:
        return 1.0
    groups = {c: (g["gid"].to_numpy(), _unit(g["x"])) for c, g in q.groupby("cell")}

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for c, g in p.groupby("cell"):
                if c in groups:
                    ids, qx = groups[c]
                    hit = (_unit(g["x"]) @ qx.T >= threshold) & (g["gid"].to_numpy()[:, None] != ids[None, :])
                    out.append(pd.DataFrame({"gid": ids, "n": g["copies"].to_numpy() @ hit}))
            yield pd.concat(out) if out else pd.DataFrame({"gid": np.empty(0, np.int64), "n": np.empty(0, np.int64)})

    true = one.select("gid", "cell", "x", "copies").mapInPandas(exact, "gid long, n long").groupBy("gid").agg(F.sum("n").alias("n")).toPandas()
    total = int(true["n"].sum())
    return 1.0 if not total else int(q["links"].sum()) / total


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, overlap: int = OVERLAP, limit: int = SHARD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows, one = distinct_vectors(vectors, id_col, vec_col, label_col)
    one = checkpoint(one)
    for attempt in range(ATTEMPTS):
        counts, edges = find_links(one, threshold, overlap + attempt, limit)
        recall = audit_recall(one, counts, threshold)
        if recall >= MIN_RECALL:
            break
    else:
        raise ValueError(f"recall {recall:.3f} of the audited vectors is below {MIN_RECALL}")
    comp = connected_components(edges)
    info = (one.select("gid", "copies").join(counts.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g"), "left")
            .join(comp, F.col("gid") == F.col("node"), "left")
            .select(F.col("gid").alias("igid"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "gid").alias("comp")))
    rows = rows.join(info, F.col("gid") == F.col("igid"), "left")
    first = rows.where("comp is not null").groupBy(F.col("comp").alias("c")).agg(F.min("id").alias("component_id"))
    x = rows.join(first, F.col("comp") == F.col("c"), "left")
    return x.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors, within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND len(x) > 0 AND list_count(x) = len(x)
  AND NOT list_has_any(x, ['inf', '-inf', 'nan']::DOUBLE[])),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.x) = len(b.x) WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r(a, c) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY 1),
m AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
