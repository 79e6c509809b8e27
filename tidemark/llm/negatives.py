"""Hard-negative mining: an inverted multi-index searched by a multi-sequence heap, exact by certified bounds.

An anchor's positives are its best rows of the same label by integer inner product; its negatives are, for each
positive, the best rows of other labels whose score lies in a window below the positive's.

1. Codebooks: each half of the vectors gets its own centroids, fitted on at most ``SAMPLE_ROWS`` rows.  A pair of
   codes is a cell.  Every row is indexed: its cell and its distances to both centroids are written once.
2. Shards: cells in order are cut into runs of about equal rows, at most ``SHARD_ROWS``; a cell with very many rows
   (copies of one vector) goes over several shards.  Only the cells' counts, at most ``MAX_CODES`` squared, reach
   the driver.
3. Search: anchors stream past each shard.  A half's score with any row of a code is at most its score with the
   centroid plus norm times radius; a heap over the two descending lists visits cells by the sum of the two bounds.
   It stops once the next bound is under the k-th best score so far (or under the window): nothing better can
   follow.  Cells whose own bound is too low, or that lie above all windows, are skipped.
4. Merge: the best of all shards by window functions that keep k rows an anchor (and positive).

The result is exact, whatever the codebooks; they only decide how many cells a search visits.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors
count as filled up with zeros, so empty ones score 0; ties go to the smaller id; rows that repeat an anchor's id are
the anchor itself (its least label and vector count), other repeated rows are rows of their own; an anchor without
positives, or a positive without negatives in its window, gives no row; an empty table gives no rows; other columns
are ignored.  Scores beyond 64 bits raise ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 30, 90
#: Rows that the codebooks are fitted on, at most.
SAMPLE_ROWS = 20_000
CELL_ROWS = 256
MAX_CODES = 256
SHARD_ROWS = 131_072
LEAST_SHARD_ROWS = 2_048


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        code = nearest(x, c)
        n = np.bincount(code, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, code, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def multi_sequence(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(u[i] + v[j], i, j) in descending order of the sum, from a heap over the two sorted lists."""
    if not len(u) or not len(v):
        return
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap, seen = [(-(u[a[0]] + v[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        s, p, q = heapq.heappop(heap)
        yield -s, int(a[p]), int(b[q])
        for x, y in ((p + 1, q), (p, q + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(u[a[x]] + v[b[y]]), x, y))


def _above(bound: float) -> float:
    """A bound, safe against rounding."""
    return bound + 1e-9 * abs(bound) + 1e-3


class Best:
    """The k best (score, id): higher scores first, then smaller ids, inside [low, high]."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high, self.kept = k, low, high, []

    def floor(self):
        """A score under this can no longer enter; None while any can."""
        return -self.kept[-1][0] if len(self.kept) == self.k else self.low

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.ones(len(scores), bool) if (f := self.floor()) is None else scores >= f
        if self.high is not None:
            ok &= scores <= self.high
        at = np.flatnonzero(ok)
        if len(at) > 4 * self.k:  # all that tie with the k-th stay
            s = scores[at]
            at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
        if len(at):
            self.kept = sorted(self.kept + [(-int(s), int(i)) for s, i in zip(scores[at], ids[at])])[:self.k]


class Shard:
    """Rows of some cells, sorted by (cell, label), and their search."""

    def __init__(self, cells: np.ndarray, labels: np.ndarray, ids: np.ndarray, far: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((labels, cells))
        cells, self.labels, self.ids, far, self.x = cells[order], labels[order], ids[order], far[order], x[order]
        k = len(books[1])
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(cells)]
        first, second = np.divmod(cells[starts], k)
        self.codes = [np.unique(first), np.unique(second)]
        self.books = [b[c] for b, c in zip(books, self.codes)]
        self.radius = [np.zeros(len(c)) for c in self.codes]
        self.cell = {}
        for a, b, i, j in zip(starts.tolist(), ends.tolist(), first, second):
            p, q = int(np.searchsorted(self.codes[0], i)), int(np.searchsorted(self.codes[1], j))
            r = far[a:b].max(axis=0)
            self.cell[p, q] = (a, b, float(r[0]), float(r[1]))
            self.radius[0][p], self.radius[1][q] = max(self.radius[0][p], r[0]), max(self.radius[1][q], r[1])

    def visit(self, v: np.ndarray) -> Iterator[tuple[float, float, float, int, int]]:
        """(bound of this and all later cells, cell's upper bound, lower bound, from row, to row)."""
        h = self.books[0].shape[1]
        halves = [v[:h].astype(np.float64), v[h:].astype(np.float64)]
        norm = [float(np.sqrt(x @ x)) for x in halves]
        mid = [b @ x for b, x in zip(self.books, halves)]
        for bound, p, q in multi_sequence(*[m + n * r for m, n, r in zip(mid, norm, self.radius)]):
            if (at := self.cell.get((p, q))) is not None:
                a, b, r0, r1 = at
                centre, reach = mid[0][p] + mid[1][q], norm[0] * r0 + norm[1] * r1
                yield _above(bound), _above(centre + reach), -_above(reach - centre), a, b

    def positives(self, own: int, label: int, v: np.ndarray, k: int) -> list[tuple[int, int]]:
        best = Best(k)
        for bound, upper, _, a, b in self.visit(v):
            floor = best.floor()
            if floor is not None and bound < floor:
                break
            if floor is not None and upper < floor:
                continue
            a, b = a + np.searchsorted(self.labels[a:b], label, "left"), a + np.searchsorted(self.labels[a:b], label, "right")
            if a < b:
                ids = self.ids[a:b]
                other = ids != own
                best.take((self.x[a:b] @ v)[other], ids[other])
        return [(-s, i) for s, i in best.kept]

    def negatives(self, label: int, v: np.ndarray, k: int, windows: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        best = [Best(k, low, high) for low, high in windows]
        top = max((high for _, high in windows), default=0)
        for bound, upper, lower, a, b in self.visit(v):
            if all(bound < w.floor() for w in best):
                break
            if lower > top or all(upper < w.floor() for w in best):
                continue
            x, y = a + np.searchsorted(self.labels[a:b], label, "left"), a + np.searchsorted(self.labels[a:b], label, "right")
            for p, q in ((a, x), (y, b)):
                if p < q:
                    scores = self.x[p:q] @ v
                    for w in best:
                        w.take(scores, self.ids[p:q])
        return [[(-s, i) for s, i in w.kept] for w in best]


def _stored(most: float) -> str:
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _computed(x: np.ndarray, most: float) -> np.ndarray:
    """Numbers in which inner products are exact."""
    worst = x.shape[-1] * most * most
    if worst < 1 << 24:
        return x.astype(np.float32)
    if worst < 1 << 53:
        return x.astype(np.float64)
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def _search(rows: DataFrame, anchors: DataFrame, out: str, find, window: str, books, most: float, dim: int, place, shards: int) -> DataFrame:
    """Anchors past every shard; ``find(shard, id, label, vector, windows)`` gives an anchor's columns."""
    stored = _stored(most)
    cum, counts = place
    total = int(counts.sum())

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, salt = b.column("cell").to_numpy(), b.column("salt").to_numpy()
            at = cum[cell] + salt % counts[cell]
            got = pa.array((at * shards // max(total, 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([got, *[b.column(c) for c in ("cell", "label", "id", "far0", "far1", "v")]], ["shard", "cell", "label", "id", "far0", "far1", "v"])

    body = rows.select("cell", "label", "id", "far0", "far1", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")) \
        .mapInArrow(shard_of, "shard int, cell int, label long, id long, far0 double, far1 double, v binary") \
        .withColumn("kind", F.lit(0)).withColumn("windows", F.array().cast(window))
    ask = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("cell"), "label", "id", F.lit(0.0).alias("far0"),
                         F.lit(0.0).alias("far1"), "v", F.lit(1).alias("kind"), "windows")
    both = body.unionByName(ask).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for b in batches:
            sh, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((sh[1:] != sh[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(sh)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if sh[i] != now:
                    now, parts, shard = sh[i], [], None
                s = b.slice(i, j - i)
                v = np.frombuffer(b"".join(s.column("v").to_pylist()), stored).reshape(j - i, dim)
                if kind[i] == 0:
                    parts.append([s.column("cell").to_numpy(), s.column("label").to_numpy(), s.column("id").to_numpy(),
                                  np.stack([s.column("far0").to_numpy(), s.column("far1").to_numpy()], 1), v])
                    continue
                if shard is None:
                    if not parts:
                        continue  # no rows here
                    cells, labels, ids, far, x = (np.concatenate(p) for p in zip(*parts))
                    shard, parts = Shard(cells, labels, ids, far, _computed(x, most), books), []
                got = []
                for id_, label, q, w in zip(s.column("id").to_pylist(), s.column("label").to_pylist(), _computed(v, most), s.column("windows").to_pylist()):
                    got += find(shard, id_, label, q, [tuple(x.values()) for x in w])
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], [c.split()[0] for c in out.split(", ")])

    return both.select("shard", "kind", "cell", "label", "id", "far0", "far1", "v", "windows").mapInArrow(run, out)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors hold whole numbers (array<double>); ``anchor`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    size = x.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n, dim, most = size[0], max(size[1] or 0, 1), float(size[2] or 0)
    x = x.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    if dim * most * most >= 2.0 ** 63:
        raise ValueError("inner products leave 64 bits")
    sample = np.array([r.v for r in x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()], np.float64).reshape(-1, dim)
    half = (dim + 1) // 2
    codes = int(min(MAX_CODES, max(1, np.ceil(np.sqrt(n / CELL_ROWS))), max(1, len(sample))))
    books = tuple(kmeans(s, codes) if len(s) else np.zeros((1, s.shape[1])) for s in (sample[:, :half], sample[:, half:]))
    stored = _stored(most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            halves = (v[:, :half], v[:, half:])
            near = [nearest(h, c) for h, c in zip(halves, books)]
            far = [np.sqrt(((h - c[k]) ** 2).sum(1)) for h, c, k in zip(halves, books, near)]
            raw = [r.tobytes() for r in v.astype(stored)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array((near[0] * len(books[1]) + near[1]).astype(np.int32)), *map(pa.array, far), pa.array(raw, pa.binary())],
                                             ["id", "label", "cell", "far0", "far1", "v"])

    rows = checkpoint(x.mapInArrow(assign, "id long, label long, cell int, far0 double, far1 double, v binary"))
    counts = np.ones(len(books[0]) * len(books[1]), np.int64)  # of cells without rows, never used
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MAX_CODES ** 2 rows
    for r in held:
        counts[r.cell] = r.n
    seen = np.zeros_like(counts)
    seen[[r.cell for r in held]] = 1
    place = np.cumsum(counts * seen) - counts * seen, np.where(seen, counts, 1)
    conf = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shards = max(1, -(-n // SHARD_ROWS), min(conf, -(-n // LEAST_SHARD_ROWS)))
    args = (books, most, dim, place, shards)
    window = "array<struct<low:long,high:long,k:long,positive:long,score:long>>"
    who = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    near_ = _search(rows, who.withColumn("windows", F.array().cast(window)), "anchor_id long, positive_id long, score long",
                    lambda s, i, label, v, _: [(i, p, score) for score, p in s.positives(i, label, v, positives)], window, *args)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = near_.withColumn("k", F.row_number().over(best).cast("long")).where(F.col("k") <= positives)
    share = lambda x: F.floor(F.col("score").cast("decimal(20,0)") * x / 100).cast("long")  # noqa: E731  exact at any score
    found = found.select("anchor_id", F.struct((-share(-low)).alias("low"), share(high).alias("high"), "k", F.col("positive_id").alias("positive"), "score").alias("w")) \
        .where("w.low <= w.high")
    windows = found.groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # at most ``positives`` of an anchor
    asked = checkpoint(who.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "windows"))
    names = "anchor_id long, k long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = _search(rows, asked, names, lambda s, i, label, v, w: [
        (i, k, p, ps, j, score) for (_, _, k, p, ps), kept in zip(w, s.negatives(label, v, negatives, [x[:2] for x in w])) for score, j in kept], window, *args)
    order = Window.partitionBy("anchor_id", "k").orderBy(F.desc("negative_score"), "negative_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with every seventh label changed; anchors are the ids divisible by 100."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").where("label is not null")
    x = x.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    x = x.where(F.forall("embedding", finite)).withColumn("embedding", F.transform("embedding", lambda e: F.floor(256 * e.cast("double")).cast("double")))
    return mine(x, F.col("id") % 100 == 0)


ORACLE = """
WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM p a JOIN p b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id, row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s.s DESC, s.b)::INTEGER AS rank, s.b AS negative_id,
  pos.s AS positive_score, s.s AS negative_score
FROM pos JOIN s ON s.a = pos.a AND NOT s.same AND 30 * pos.s <= 100 * s.s AND 100 * s.s <= 90 * pos.s QUALIFY rank <= 10
"""
