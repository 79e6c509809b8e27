"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised inside a sentence) and units (after a number) are replaced
by typed placeholders, other words are lower-cased.  Windows of ``WIDTH`` template words are hashed; a benchmark
item's windows are joined to the documents' on the hash.  Of the pairs whose item has at least ``SIMILARITY`` of
its windows in the document, the slots are checked: over the matched windows, the same slot value of the item
must stand for the same value in the document and the other way round (majority per value); windows that
disagree do not count, windows with the item's own values always do.  This is judged over the whole document and over
each stretch of it in which the item could lie once, and the best counts, so that several instances of one template
do not outvote each other.  What still reaches the similarity is a contaminated document: a verbatim copy, or a
question asked again with other numbers, names or units.

Windows without two plain words say nothing about a template; they and all others also have a plain form, the
lower-cased words as they stand.  An item's window that stands in a document in its plain form counts as agreeing, and
a document with ``SIMILARITY`` of all of an item's windows in that form is contaminated whatever their templates: an
item of numbers or names, or a copy in other case.  An item shorter than a window is one plain window of its own length.
Plain forms have letters and digits only, so 'What is 12 + 30?' and 'What is 12 - 30?' are one item.  The scan drops
document windows that no item has by a table of the items' hashes, while those are at most ``FILTER_WINDOWS``
(8 bytes each); with a larger benchmark every window goes to the join instead.  Per document each window is
sent once for each set of slot values, with all its positions, so a text that repeats itself costs no more rows.

Edge cases: null and empty texts have no windows and match nothing; an item of one word is in every document with
that word; null ids and repeated rows are judged row by row (rows are known by id and a hash of the text); an
empty benchmark or an empty table leaves everything as it is; columns of the input are kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, packed_row, table

WIDTH = 5
SIMILARITY = 0.8
FILTER_WINDOWS = 4_000_000
#: Texts that are hashed together.
BATCH = 64
#: Units of measure; a unit only after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds gram grams kilogram "
    "kilograms ton tons ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres cent cents dollar dollars "
    "euro euros usd eur gbp percent degree degrees w kw kwh v a hz khz mhz ghz b kb mb gb tb mph kmh".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?:\n]")
_NUMBER, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0number", b"\0name", b"\0unit"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
# kinds of tokens
_WORD, _CAPITAL, _MAYBE_UNIT, _DIGITS, _END = range(5)


class _Tokens(dict):
    """Token to its place in two arrays, remembered: the hash of its lower case, and its kind."""

    def __init__(self) -> None:
        self.hash, self.kind = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int8)

    def __missing__(self, t: str) -> int:
        low = t.lower()
        if t[0].isdigit():
            kind = _DIGITS
        elif not t[0].isalpha():
            kind = _END
        elif len(t) > 1 and t[0].isupper() and t[1:] == low[1:]:
            kind = _CAPITAL
        else:
            kind = _MAYBE_UNIT if low in UNITS else _WORD
        self[t] = at = len(self)
        if at == len(self.kind):
            self.hash, self.kind = np.resize(self.hash, 2 * at), np.resize(self.kind, 2 * at)
        self.hash[at], self.kind[at] = xxhash.xxh3_64_intdigest(low), kind
        return at


class Templates:
    """Words of several texts, one after the other: ``h`` template hashes, ``slot`` types (0 plain, 1 number, 2 name,
    3 unit), ``low`` hashes of the lower-cased words, ``doc`` the text of each, ``start`` each text's first."""

    def __init__(self, texts: list[str | None], known: _Tokens):
        if len(known) > 500_000:
            known.clear()
        self.tokens: list[str] = []
        sizes = []
        for text in texts:
            found = _TOKEN.findall(text or "")
            sizes.append(len(found))
            self.tokens += found
        at = np.fromiter(map(known.__getitem__, self.tokens), np.int64, len(self.tokens))
        h, kind = known.hash[at], known.kind[at]
        ends = np.cumsum(sizes)
        before = np.concatenate(([_END], kind[:-1])) if kind.size else kind
        before[(ends - sizes)[np.asarray(sizes) > 0]] = _END
        slot = np.zeros(kind.size, np.int8)
        slot[kind == _DIGITS] = 1
        slot[(kind == _CAPITAL) & (before != _END)] = 2
        slot[(kind == _MAYBE_UNIT) & (before == _DIGITS)] = 3
        self.place = np.flatnonzero(kind != _END)
        self.doc = np.repeat(np.arange(len(texts)), sizes)[self.place]
        self.start = np.searchsorted(self.doc, np.arange(len(texts)))
        self.low, self.slot = h[self.place], slot[self.place]
        self.h = self.low.copy()
        for s, code in ((1, _NUMBER), (2, _NAME), (3, _UNIT)):
            self.h[self.slot == s] = code

    def words(self) -> list[str]:
        return [self.tokens[i] for i in self.place.tolist()]

    def slots(self, at: int, width: int) -> list[str]:
        """Slot values of one window, in order."""
        return [self.tokens[self.place[i]] for i in range(at, at + width) if self.slot[i]]

    def inside(self, width: int) -> np.ndarray:
        """Whether the window that starts at each word lies in one text."""
        n = max(0, self.doc.size - width + 1)
        return self.doc[:n] == self.doc[width - 1:width - 1 + n]


def template(text: str | None, known: _Tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words, template hashes, slot types, hashes of the lower-cased words) of a text."""
    t = Templates([text], known)
    return t.words(), t.h, t.slot, t.low


def _mixed(w: np.ndarray) -> np.ndarray:
    w ^= w >> np.uint64(29)
    w *= np.uint64(0xD6E8FEB86659FD93)
    w ^= w >> np.uint64(32)
    return w


def hashes_at(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the windows that start at ``at``."""
    w = np.zeros(at.size, np.uint64)
    for j in range(width):
        w *= _BASE
        w += h[at + j]
    return _mixed(w)


def windows(h: np.ndarray, slot: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and whether it has at least two plain words."""
    n = h.size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    w, plain = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    free = slot == 0
    for j in range(width):
        w *= _BASE
        w += h[j:j + n]
        plain += free[j:j + n]
    return _mixed(w), plain >= min(2, width)


def _slots(words: list[str], slot: np.ndarray, at: int, width: int) -> list[str]:
    """Slot values of one window, in order."""
    return [words[i] for i in range(at, at + width) if slot[i]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _item_rows(width: int):
    """Rows (rid, th, hash, slots, at, unit, whole, n, n_whole) of a (rid, th, text) table of items.

    A usable window has a row of its template; one with slots, usable or not, a row of its plain form, without slots.
    ``unit`` is the usable window's template, ``whole`` its plain form where the row has that; ``n`` and ``n_whole``
    are the item's numbers of them.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Tokens()
        for p in parts:
            out = []
            for rid, th, text in zip(p["rid"], p["th"], p["text"]):
                words, h, slot, low = template(text, known)
                wide = min(width, len(words))
                if not wide:
                    continue
                w, ok = windows(h, slot, wide)
                x, _ = windows(low, np.zeros_like(slot), wide)
                ok &= len(words) >= width
                n, n_whole = int(np.unique(w[ok]).size), int(np.unique(x).size)
                seen: dict[tuple, list[int]] = {}
                for i, (t, f, usable) in enumerate(zip(w.tolist(), x.tolist(), ok.tolist())):
                    slots = tuple(_slots(words, slot, i, wide))
                    unit = _signed(t) if usable else None
                    if usable:
                        seen.setdefault((t, slots, unit, None if slots else _signed(f)), []).append(i)
                    if slots or not usable:
                        seen.setdefault((f, (), unit, _signed(f)), []).append(i)
                out += [(rid, th, _signed(t), list(s), i, u, f, n, n_whole, wide) for (t, s, u, f), i in seen.items()]
            out = pd.DataFrame(out, columns=["rid", "th", "hash", "slots", "at", "unit", "whole", "n", "n_whole", "wide"])
            yield out.astype({"unit": "Int64", "whole": "Int64"})

    return rows


class _Only:
    """Membership in a set of hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, w: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are in the set."""
        at = np.flatnonzero(self.near[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if at.size:
            k = np.minimum(np.searchsorted(self.hashes, w[at]), self.hashes.size - 1)
            at = at[self.hashes[k] == w[at]]
        return at


def _window_rows(width: int, only: np.ndarray | None, short: list[int]):
    """Rows (rid, th, hash, slots, at) of a (rid, th, text) table of documents.

    ``only``: hashes to keep; ``short``: lengths of the items shorter than a window.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, keep = _Tokens(), _Only(only) if only is not None else lambda w: np.arange(w.size)
        for p in parts:
            out = []
            rids, ths, texts = p["rid"].tolist(), p["th"].tolist(), p["text"].tolist()
            for a in range(0, len(texts), BATCH):
                t = Templates(texts[a:a + BATCH], known)
                seen: dict[tuple, list[int]] = {}

                def sent(at: np.ndarray, w: np.ndarray, wide: int | None) -> None:
                    for i, k, x in zip(at.tolist(), t.doc[at].tolist(), w.tolist()):
                        seen.setdefault((k, x, tuple(t.slots(i, wide)) if wide else ()), []).append(i - int(t.start[k]))

                w, ok = windows(t.h, t.slot, width)
                ok &= t.inside(width)
                at = keep(w)
                at = at[ok[at]]
                sent(at, w[at], width)
                # plain forms: a window without slots has been sent above
                filled = np.cumsum(np.concatenate(([0], t.slot != 0)))
                at = np.flatnonzero((filled[width:] > filled[:filled.size - width]) & t.inside(width)) if w.size else np.empty(0, int)
                x = hashes_at(t.low, at, width)
                hit = keep(x)
                sent(at[hit], x[hit], None)
                for wide in short:
                    x, _ = windows(t.low, t.slot, wide)
                    at = keep(x)
                    at = at[t.inside(wide)[at]]
                    sent(at, x[at], None)
                out += [(rids[a + k], ths[a + k], _signed(x), list(s), i) for (k, x, s), i in seen.items()]
            yield pd.DataFrame(out, columns=["rid", "th", "hash", "slots", "at"])

    return rows


#: Ids travel as text: pandas would turn a column of numbers with nulls to floats.
_ROWS = "rid string, th long, hash long, slots array<string>, at array<int>"
_ITEM_ROWS = _ROWS + ", unit long, whole long, n long, n_whole long, wide int"


def agreeing(item_slots: list[list[str]], doc_slots: list[list[str]], hashes: list[int]) -> int:
    """Windows (by hash) of which one match has the item's values or agrees with each value's majority meaning, both ways."""
    pairs = [list(zip(a, b)) for a, b in zip(item_slots, doc_slots)]
    votes = Counter(p for ps in pairs for p in ps)
    to: dict[str, tuple] = {}
    back: dict[str, tuple] = {}
    for (a, b), n in sorted(votes.items()):
        if n > to.get(a, (0,))[0]:
            to[a] = (n, b)
        if n > back.get(b, (0,))[0]:
            back[b] = (n, a)
    return len({h for h, ps in zip(hashes, pairs) if all(a == b for a, b in ps) or all(to[a][1] == b and back[b][1] == a for a, b in ps)})


def best_agreeing(item_slots: list[list[str]], doc_slots: list[list[str]], hashes: list[int], item_at: list[list[int]],
                  doc_at: list[list[int]], least: float) -> int:
    """``agreeing`` over the whole document, or over the best stretch that can hold the item once.

    A stretch starts where a match puts the item's start and is as long as the item, or a quarter longer for words put
    in; one with fewer than ``least`` windows is not looked at.
    """
    best, whole = agreeing(item_slots, doc_slots, hashes), len(set(hashes))
    spots = sorted({(p, k) for k, ps in enumerate(doc_at) for p in ps})
    length = max(p for ps in item_at for p in ps) + 1
    if best == whole or spots[-1][0] - spots[0][0] < length:
        return best
    at = [p for p, _ in spots]
    for start in sorted({p - q for p, k in spots for q in item_at[k]}):
        lo = bisect_left(at, start)
        for size in (length, length + max(1, length // 4)):
            ks = sorted({k for _, k in spots[lo:bisect_left(at, start + size)]})
            found = len({hashes[k] for k in ks})
            if found > best and found >= least:
                best = max(best, agreeing([item_slots[k] for k in ks], [doc_slots[k] for k in ks], [hashes[k] for k in ks]))
                if best == whole:
                    return best
    return best


def _item_key(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    text = F.col(item_text_col).cast("string")
    return benchmark.select(F.col(item_col).cast("string").alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                 similarity: float = SIMILARITY) -> DataFrame:
    """(__id, __th, item_id, similarity): pairs of documents and items that reach the similarity."""
    items = checkpoint(_item_key(benchmark, item_col, item_text_col).mapInPandas(_item_rows(width), _ITEM_ROWS)
                       .select(F.col("rid").alias("item"), F.col("th").alias("item_th"), "hash", F.col("slots").alias("item_slots"),
                               F.col("at").alias("item_at"), "unit", "whole", "n", "n_whole", "wide"))
    short = sorted(r["wide"] for r in items.select("wide").where(F.col("wide") < width).distinct().collect())  # width - 1 at most
    distinct = items.select("hash").distinct()
    only = None
    if distinct.count() <= FILTER_WINDOWS:  # the bound of what is sent along with the scan
        only = distinct.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        if not only.size:
            only = np.array([0], np.uint64)
    rows = docs.select(F.col(id_col).cast("string").alias("rid"), F.xxhash64(F.col(text_col).cast("string")).alias("th"),
                       F.col(text_col).cast("string").alias("text"))
    # a scan that can be sent few or very many rows is written once: the join below reads it twice
    found = checkpoint(rows.mapInPandas(_window_rows(width, only, short), _ROWS))
    hits = found.join(items.drop("wide"), ["hash"]).where(F.size("slots") == F.size("item_slots"))
    # collect_set: two distinct counts would make each row three
    enough = (hits.groupBy("rid", "th", "item", "item_th").agg(
        F.size(F.collect_set("unit")).alias("m"), F.first("n").alias("n"),
        F.size(F.collect_set("whole")).alias("f"), F.first("n_whole").alias("n_whole"))
        .where(((F.col("n") > 0) & (F.col("m") >= similarity * F.col("n"))) | (F.col("f") >= similarity * F.col("n_whole")))
        .select("rid", "th", "item", "item_th"))
    pair = [hits[c].eqNullSafe(enough[c]) for c in ("rid", "th", "item", "item_th")]
    near = (hits.join(enough, pair[0] & pair[1] & pair[2] & pair[3], "left_semi")
            .withColumns({c: F.col(c).cast("string") for c in ("unit", "whole")}))  # exact beside nulls

    def check(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[[0]]
        n, score = int(first["n"].iloc[0]), g["whole"].nunique() / float(first["n_whole"].iloc[0])
        g = g[g["unit"].notna()]
        if n and len(g):
            columns = (g["item_slots"], g["slots"], g["unit"], g["item_at"], g["at"])
            score = max(score, best_agreeing(*(c.tolist() for c in columns), similarity * n) / n)
        return pd.DataFrame({"__id": first["rid"], "__th": first["th"], "item_id": first["item"],
                             "similarity": [score]})

    out = near.groupBy("rid", "th", "item", "item_th").applyInPandas(check, "__id string, __th long, item_id string, similarity double")
    return (out.where(F.col("similarity") >= similarity)
            .withColumns({"__id": F.col("__id").cast("long"), "item_id": F.col("item_id").cast("long")}))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = checkpoint(contaminated(docs, benchmark, id_col, text_col, **how).select("__id", "__th").distinct())
    base = docs.select(packed_row(docs), F.col(id_col).cast("long").alias("__i"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("__t"))
    few = F.broadcast(bad) if bad.count() <= 100_000 else bad  # 16 bytes a row
    return base.join(few, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left_anti").select("__row.*")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: whether it holds a benchmark item, which, and how much of it."""
    docs = table(spark, sf_dir, "documents")
    hits = checkpoint(contaminated(docs, table(spark, sf_dir, "benchmark")).groupBy("__id", "__th").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity")))
    rows = docs.select("doc_id", F.xxhash64(F.col("text")).alias("__t"))
    x = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left")
    return x.select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit("")).alias("item_ids"),
                    F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
