"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window is ``width`` consecutive words of one document.  Each word covered by a window whose word sequence
also starts in a document with a smaller id is removed; windows are judged on the input.

1. Scan: words get 64-bit hashes, windows a polynomial hash over them (numpy, a few million windows at a
   time).  Within such a chunk each distinct window is reduced to the smallest document that has it, so a
   passage that very many documents share costs one entry a chunk; the other documents of the chunk are
   already known to be later and only pass through.  Entries are packed per hash range: sorted, delta coded,
   byte planes apart, which the shuffle's compression shrinks well.
2. Count: each hash range finds the smallest document of every window over all chunks and answers the later
   documents with the hashes they must drop.
   Answers travel packed by group of documents.
3. Apply: a group's answers are sorted by document, joined to the texts, windows are hashed again, and hits merge
   into maximal removal intervals.

Hash ranges grow in number with spark.sql.shuffle.partitions, so a task's memory does not follow the corpus.
Window hashes have 64 bits: among N windows about N^2 / 2^65 pairs of different windows are expected to
collide (below 0.001 for the 135 million windows of 0.5 GB).

Edge cases: null text has no words; a text shorter than a window keeps all its words; a null id counts as
later than any id, and rows with equal ids never remove from each other; repeated windows inside one document
stay unless an earlier document has them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 13
#: Windows that a scan task reduces at a time.
CHUNK_WINDOWS = 1_000_000
_NO_ID = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """Hash of a word, remembered while it is common."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], known: _WordHash, width: int = WIDTH) -> np.ndarray:
    """Rabin-Karp hash of each window, mixed so that its high bits are even."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= _BASE
        h += x[j:j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _reduce(hashes: list[np.ndarray], ids: list[int], ranges: int) -> pd.DataFrame:
    """Rows (range, later, hashes, ids) of one chunk; later: the documents already have an earlier one."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    h = np.concatenate([hashes[i] for i in order])
    d = np.repeat(np.array(ids, np.int64)[order], [hashes[i].size for i in order])
    by = np.argsort(h, kind="stable")  # documents stay in order of id under each hash
    h, d = h[by], d[by]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = d[new][np.cumsum(new) - 1]
    again = ~new & (np.concatenate(([True], d[1:] != d[:-1]))) & (d != first)
    out = []
    for later, pick in ((False, new), (True, again)):
        hh, dd = h[pick], d[pick]
        if not hh.size:
            continue
        r = _range_of(hh, ranges)
        cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True])))
        for a, b in zip(cuts, cuts[1:]):
            delta = np.diff(hh[a:b], prepend=np.uint64(0))
            low = dd[a:b].min()
            out.append((int(r[a]), later, _pack(delta), int(low), _pack((dd[a:b] - low).view(np.uint64))))
    return pd.DataFrame(out, columns=["range", "later", "hashes", "low", "ids"])


def find_repeats(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, ranges: int | None = None,
                 chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """(__id, drops): for each document with windows of an earlier one, their hashes (packed)."""
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, ranges // 2)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hashes, ids, n = _WordHash(), [], [], 0
        for p in parts:
            for i, t in zip(p["__id"].to_numpy(), p["__text"]):
                h = window_hashes(words_of(t), known, width)
                if h.size:
                    hashes.append(h)
                    ids.append(int(i))
                    n += h.size
                if n >= chunk:
                    yield _reduce(hashes, ids, ranges)
                    hashes, ids, n = [], [], 0
        if n:
            yield _reduce(hashes, ids, ranges)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        h = [np.cumsum(_unpack(b)) for b in rows["hashes"]]
        d = [_unpack(b).view(np.int64) + low for b, low in zip(rows["ids"], rows["low"])]
        later = rows["later"].to_numpy()
        some = [i for i, x in enumerate(later) if not x]
        hh, dd = np.concatenate([h[i] for i in some]), np.concatenate([d[i] for i in some])
        by = np.lexsort((dd, hh))
        hh, dd = hh[by], dd[by]
        new = np.concatenate(([True], hh[1:] != hh[:-1]))
        drop = dd != dd[new][np.cumsum(new) - 1]
        rest = [i for i, x in enumerate(later) if x]
        hh = np.concatenate([hh[drop], *[h[i] for i in rest]])
        dd = np.concatenate([dd[drop], *[d[i] for i in rest]])
        to = _range_of(dd.view(np.uint64) * _BASE, groups)  # answers travel packed, a row for each group of documents
        by = np.argsort(to, kind="stable")
        to, hh, dd = to[by], hh[by], dd[by]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if to.size else np.zeros(1, np.int64)
        return pd.DataFrame({"to": to[cuts[:-1]].astype(np.int64), "ids": [_pack(dd[a:b].view(np.uint64)) for a, b in zip(cuts, cuts[1:])],
                             "drops": [hh[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])]})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        dd = np.concatenate([_unpack(b).view(np.int64) for b in rows["ids"]])
        hh = np.concatenate([np.frombuffer(b, "<u8") for b in rows["drops"]])
        by = np.argsort(dd, kind="stable")
        hh, dd = hh[by], dd[by]
        cuts = np.flatnonzero(np.concatenate(([True], dd[1:] != dd[:-1], [True])))
        return pd.DataFrame({"__id": dd[cuts[:-1]], "drops": [hh[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    packed = (docs.select(key.alias("__id"), F.col(text_col).alias("__text"))
              .mapInPandas(scan, "range int, later boolean, hashes binary, low long, ids binary"))
    answers = packed.groupBy("range").applyInPandas(count, "to long, ids binary, drops binary")
    return answers.groupBy("to").applyInPandas(gather, "__id long, drops binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   ranges: int | None = None, chunk: int = CHUNK_WINDOWS, with_text: bool = True) -> DataFrame:
    """Per document: id, n_words, n_removed, removed (word intervals, end exclusive), kept_sha256, kept (text).

    ``kept`` is null with ``with_text=False``.
    """
    drops = find_repeats(docs, id_col, text_col, width, ranges, chunk)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))

    def shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for p in parts:
            yield p.assign(__text=[None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in p["__text"]])

    # whole texts meet their answers in a shuffle: packed, they take two thirds of what its own compression leaves
    # (pandas would turn a column of ids with nulls to floats: the key is never null)
    texts = docs.select(key.alias("__key"), F.col(id_col).isNotNull().alias("__has"), F.col(text_col).cast("string").alias("__text"))
    x = (texts.mapInPandas(shrink, "__key long, __has boolean, __text binary")
         .join(drops, F.col("__key") == F.col("__id"), "left").select("__key", "__has", "__text", "drops"))

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, unpack = _WordHash(), zstandard.ZstdDecompressor()
        for p in parts:
            out = []
            for doc, has, text, drop in zip(p["__key"], p["__has"], p["__text"], p["drops"]):
                words = unpack.decompress(text).split() if text is not None else []
                spans, n = [], 0
                if drop is not None:
                    hit = np.isin(window_hashes(words, known, width), np.frombuffer(drop, "<u8"))
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.flatnonzero(hit)
                    edge[at] += 1
                    edge[at + width] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                    n = int(gone.sum())
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                else:
                    kept = b" ".join(words)
                out.append((doc, has, len(words), n, spans, hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "surrogatepass") if with_text else None))
            yield pd.DataFrame(out, columns=["doc", "has", "n_words", "n_removed", "removed", "kept_sha256", "kept"])

    y = x.mapInPandas(apply, "doc long, has boolean, n_words long, n_removed long, removed array<struct<start:int,end:int>>, "
                             "kept_sha256 string, kept string")
    return y.select(F.when(F.col("has"), F.col("doc")).alias(id_col), "n_words", "n_removed", "removed", "kept_sha256", "kept")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier document's 13-word window covers."""
    x = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return x.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").cast("long").alias("n_intervals"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
seq AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM win),
low AS (SELECT s, min(doc_id) AS d FROM seq GROUP BY s),
hit AS (SELECT doc_id, i FROM seq JOIN low USING (s) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
runs AS (SELECT doc_id, count(*) FILTER (q IS NULL) AS k FROM (SELECT a.doc_id, b.p AS q FROM gone a LEFT JOIN gone b
  ON a.doc_id = b.doc_id AND b.p = a.p - 1) GROUP BY 1),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(g.p) AS gone, string_agg(x, ' ' ORDER BY word.p) FILTER (g.p IS NULL) AS t
  FROM word LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.p = word.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256,
  coalesce(k, 0)::BIGINT AS n_intervals
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
