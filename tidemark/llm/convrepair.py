"""Conversation structure repair: cheapest edits by a persistent audit DP.

Rows of a conversation stand in the order of their turns (nulls first; ties by role, then the text's SHA-256; equal
rows side by side).  Each row is kept (K), given the role user or assistant (R, 1) or deleted (D, 2), and empty
user or assistant rows may be inserted anywhere (I, 5); undeleted truncated rows cost 5 more, blank and repeated
rows must go.  The result's role initials are ``(s?(ua)+)?``; the cheapest edits win, then the ASCII-least audit.

The DP has four states (nothing yet, after s, after u, after a) and keeps the best audit for each.  Audits are
persistent: a step's node points to the prefix that it extends, carries a rolling hash of the whole prefix and its
binary-lifting ancestors.  Equally cheap audits compare by their longest common prefix, found over the ancestors by
hash; equal hashes of different nodes are verified step by step, so a collision never decides.

On Spark, no conversation has to fit a task until its own digest:

1. Equal rows are counted, first occurrences found by an aggregate; both combine before the shuffle.
2. Rows go out by (conversation, bucket of turns) and stream through the DP; every ``SEGMENT_ROWS`` rows give a
   segment's table: best cost and audit from each start state to each end state (the first segment: from the start).
3. The same DP runs over a conversation's segments, whose tables are steps of several letters.
4. The chosen audits go back to their buckets and become repaired rows; texts join them at the end.

Edge cases: a null role or text counts as one space; null conversation ids are one conversation; any number of rows
may share a turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

WHITE = " \t\n\x0b\x0c\r"
TURNS_PER_BUCKET = 4096
SEGMENT_ROWS = 4096
#: State after keeping a row with this initial.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after the one role that may follow, and that role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Useful runs of insertions after a row: from, to, letters.
INSERTS = ((0, 2, "I"), (0, 3, "II"), (1, 2, "I"), (1, 3, "II"), (2, 3, "I"), (3, 2, "I"))
LEGAL = ("su", "ua", "au")


class Audits:
    """Persistent audit prefixes as linked nodes; node 0 is the empty one.  A step's letters start with its row's."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 911_382_323):
        self.mod, self.base = modulus, base
        self.step, self.hash, self.size, self.depth, self.up = [""], [0], [0], [0], [[]]
        self._known: dict[str, tuple[int, int]] = {}

    def add(self, parent: int, step: str) -> int:
        known = self._known.get(step)
        if known is None:
            h = 0
            for ch in step:
                h = (h * self.base + ord(ch)) % self.mod
            known = h, pow(self.base, len(step), self.mod)
            if len(step) < 4:
                self._known[step] = known
        up, k = [parent], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.step.append(step)
        self.hash.append((self.hash[parent] * known[1] + known[0]) % self.mod)
        self.size.append(self.size[parent] + len(step))
        self.depth.append(self.depth[parent] + 1)
        self.up.append(up)
        return len(self.step) - 1

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of equal depth are equal; equal hashes are verified."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b] or self.size[a] != self.size[b]:
            return False
        while a != b and self.step[a] == self.step[b]:
            a, b = self.up[a][0], self.up[b][0]
        return a == b

    def ancestor(self, node: int, depth: int) -> int:
        rise = self.depth[node] - depth
        k = 0
        while rise:
            if rise & 1:
                node = self.up[node][k]
            rise >>= 1
            k += 1
        return node

    def less(self, a: int, step_a: str, b: int, step_b: str) -> bool:
        """Whether prefix a + step_a comes before b + step_b; the prefixes have equal depth.

        Equally cheap audits of the same rows are never prefixes of each other, but one's step may be the start
        of the other's (K and KI): then the next step's first letter decides.
        """
        if a == b:
            return step_a < step_b
        x, y = a, b
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        if self.same(x, y):
            return step_a < step_b
        after = self.depth[x] + 1
        next_a = step_a if x == a else self.step[self.ancestor(a, after)]
        next_b = step_b if y == b else self.step[self.ancestor(b, after)]
        return self.step[x] + next_a[:1] < self.step[y] + next_b[:1]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.step[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Repair:
    """The DP from one start state: ``best[state]`` is (cost, node) or None."""

    def __init__(self, start: int = 0, lead: bool = False, **kw):
        self.audits = Audits(**kw)
        self.best: list = [None] * 4
        self.best[start] = (0, 0)
        if lead:  # insertions before the first row
            self.best[2], self.best[3] = (5, self.audits.add(0, "I")), (10, self.audits.add(0, "II"))
            self.best[0] = (0, self.audits.add(0, ""))

    def _offer(self, found: list, state: int, cost: int, node: int, step: str) -> None:
        now = found[state]
        if now is None or cost < now[0] or cost == now[0] and self.audits.less(node, step, now[1], now[2]):
            found[state] = (cost, node, step)

    def _take(self, found: list) -> None:
        self.best = [x and (x[0], self.audits.add(x[1], x[2])) for x in found]

    def row(self, initial: str, must_go: bool, cut: bool) -> None:
        found: list = [None] * 4
        for state, now in enumerate(self.best):
            if now is None:
                continue
            cost, node = now
            self._offer(found, state, cost + 2, node, "D")
            if not must_go:
                cost += 5 * cut
                if (kept := KEEP.get((state, initial))) is not None:
                    self._offer(found, kept, cost, node, "K")
                self._offer(found, NEXT[state], cost + 1, node, "R")
        rows = list(found)
        for state, to, letters in INSERTS:
            if rows[state]:
                cost, node, step = rows[state]
                self._offer(found, to, cost + 5 * len(letters), node, step + letters)
        self._take(found)

    def segment(self, ways: list[tuple[int, int, int, str]]) -> None:
        """One step over a segment's table (start, end, cost, letters)."""
        found: list = [None] * 4
        for start, end, cost, letters in ways:
            if self.best[start]:
                self._offer(found, end, self.best[start][0] + cost, self.best[start][1], letters)
        self._take(found)

    def result(self) -> tuple[int, int]:
        """(cost, node) of the best whole audit."""
        a, b = self.best[0], self.best[3]
        if a is None or b is None:
            return a or b
        if a[0] != b[0]:
            return min(a, b)
        up, step = self.audits.up, self.audits.step
        return a if self.audits.less(up[a[1]][0], step[a[1]], up[b[1]][0], step[b[1]]) else b


def replay(letters: str, state: int, initials: list[str]) -> Iterator[tuple[int, str | None, int]]:
    """(row number or -1 for an insertion, role or None to keep, state after) of each row that stays."""
    at = -1
    for ch in letters:
        if ch == "I":
            yield -1, ROLE[state], (state := NEXT[state])
            continue
        at += 1
        if ch == "R":
            yield at, ROLE[state], (state := NEXT[state])
        elif ch == "K":
            state = KEEP[state, initials[at]]
            yield at, None, state


def prepared(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(ck, c, tk, t, r, x, h): keys without nulls beside whether they are known, role, text and its SHA-256."""
    def known(name: str, as_: str, flag: str) -> list[Column]:
        kind = turns.schema[name].dataType
        return [F.col(f"`{name}`").isNotNull().alias(flag), F.coalesce(F.col(f"`{name}`"), F.lit(0).cast(kind)).alias(as_)]
    x = turns.select(*known(conv_col, "c", "ck"), *known(turn_col, "t", "tk"),
                     F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("r"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("x"))
    return x.select("ck", "c", "tk", F.col("t").cast("long").alias("t"), "r", "x", F.sha2("x", 256).alias("h"))


def faults(x: DataFrame) -> DataFrame:
    """Distinct rows of ``prepared`` with copies n, flags blank, later (an equal role and text came before the first
    copy), cut (its last character ends no sentence), the initial and the bucket."""
    seen = F.rtrim(F.col("x"), F.lit(WHITE))
    rows = x.select("ck", "c", "tk", "t", "r", "h", (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy("ck", "c", "tk", "t", "r", "h").agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = rows.groupBy("ck", "c", "r", "h").agg(F.min(F.struct("tk", "t")).alias("first"))
    rows = rows.join(first, ["ck", "c", "r", "h"]).withColumn("later", F.struct("tk", "t") != F.col("first"))
    return rows.select("ck", "c", "tk", "t", "r", "h", "n", "blank", "later", (F.col("cut") & ~F.col("blank") & ~F.col("later")).alias("cut"),
                       F.substring("r", 1, 1).alias("initial"),
                       F.when(F.col("tk"), F.floor(F.col("t") / TURNS_PER_BUCKET)).otherwise(-(1 << 62)).cast("long").alias("bucket"))


def counts(rows: DataFrame) -> DataFrame:
    """(ck, c, gaps, blank, duplicate, truncated, first_bucket) of ``faults``."""
    span = F.max(F.when(F.col("tk"), F.col("t"))) - F.min(F.when(F.col("tk"), F.col("t"))) + 1 - F.count_distinct(F.when(F.col("tk"), F.col("t")))
    return rows.groupBy("ck", "c").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"), F.min("bucket").alias("first_bucket"))


def _key(df: DataFrame) -> str:
    return f"ck boolean, c {df.schema['c'].dataType.simpleString()}"


def segments(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(ck, c, bucket, seg, head, tail, illegal, ways): the DP's table of every segment."""
    x = rows.join(stats.select("ck", "c", "first_bucket"), ["ck", "c"]).withColumn("first", F.col("bucket") == F.col("first_bucket"))
    x = x.withColumn("must", F.col("blank") | F.col("later")).repartition("ck", "c", "bucket").sortWithinPartitions("ck", "c", "bucket", "tk", "t", "r", "h")
    names = ["ck", "c", "bucket", "seg", "head", "tail", "illegal", "ways"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seg, machines, size, head, tail, illegal = None, 0, [], 0, "", None, 0

        def done():
            ways = [(s, e, m.best[e][0], m.audits.text(m.best[e][1])) for s, m in machines for e in range(4) if m.best[e]]
            return (*now, seg, head, tail, illegal, ways)

        for pdf in batches:
            out = []
            for *key, initial, n, must, cut, first in pdf.itertuples(index=False, name=None):
                for k in range(n):
                    if key != now or size == SEGMENT_ROWS:
                        if now is not None:
                            out.append(done())
                        seg = seg + 1 if key == now else 0
                        now, size, head, tail, illegal = key, 0, initial, None, 0
                        machines = [(0, Repair(0, lead=True))] if first and seg == 0 else [(s, Repair(s)) for s in range(4)]
                    illegal += tail is not None and tail + initial not in LEGAL
                    for _, m in machines:
                        m.row(initial, must or k > 0, cut)
                    tail, size = initial, size + 1
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([done()], columns=names)

    return x.select("ck", "c", "bucket", "initial", "n", "must", "cut", "first").mapInPandas(
        run, f"{_key(rows)}, bucket long, seg int, head string, tail string, illegal long, ways array<struct<s:int,e:int,cost:long,letters:string>>")


def audits(parts: DataFrame) -> DataFrame:
    """(ck, c, bucket, seg, start, letters, cost, illegal): the audit chosen for every segment; cost and illegal are
    the conversation's."""
    x = parts.repartition("ck", "c").sortWithinPartitions("ck", "c", "bucket", "seg")
    names = ["ck", "c", "bucket", "seg", "start", "letters", "cost", "illegal"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, dp, at, tail, illegal = None, None, [], None, 0

        def done():
            cost, node = dp.result()
            steps = []
            while node:
                steps.append(dp.audits.step[node])
                node = dp.audits.up[node][0]
            state, rows = 0, []
            for (bucket, seg, ends), letters in zip(at, reversed(steps)):
                rows.append((*now, bucket, seg, state, letters, cost, illegal))
                state = ends[state, letters]
            return rows

        for pdf in batches:
            out = []
            for ck, c, bucket, seg, head, last, inside, ways in pdf.itertuples(index=False, name=None):
                if (ck, c) != now:
                    if now is not None:
                        out += done()
                    now, dp, at, tail, illegal = (ck, c), Repair(), [], None, 0
                ways = [tuple(w[k] for k in ("s", "e", "cost", "letters")) if isinstance(w, dict) else tuple(w) for w in ways]
                dp.segment(ways)
                at.append((bucket, seg, {(s, letters): e for s, e, _, letters in ways}))
                illegal += int(inside) + (tail is not None and tail + head not in LEGAL)
                tail = last
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame(done(), columns=names)

    return x.select("ck", "c", "bucket", "seg", "head", "tail", "illegal", "ways").mapInPandas(
        run, f"{_key(parts)}, bucket long, seg int, start int, letters string, cost long, illegal long")


def repaired_rows(x: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(ck, c, bucket, ord, role, text): the repaired conversations, in the order of (bucket, ord)."""
    marks = chosen.select("ck", "c", "bucket", F.lit(0).alias("kind"), "seg", "start", "letters", F.lit(False).alias("tk"), F.lit(0).cast("long").alias("t"),
                          *[F.lit("").alias(k) for k in ("r", "h", "initial")], F.lit(0).cast("long").alias("n"))
    body = rows.select("ck", "c", "bucket", F.lit(1).alias("kind"), F.lit(0).alias("seg"), F.lit(0).alias("start"), F.lit("").alias("letters"),
                       "tk", "t", "r", "h", "initial", "n")
    both = body.unionByName(marks).repartition("ck", "c", "bucket").sortWithinPartitions("ck", "c", "bucket", "kind", "seg", "tk", "t", "r", "h")
    names = ["ck", "c", "bucket", "ord", "tk", "t", "r", "h", "own", "role"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, todo, state, ord_ = None, [], 0, 0
        for pdf in batches:
            out = []
            for ck, c, bucket, kind, tk, t, r, h, initial, n, start, letters in pdf.itertuples(index=False, name=None):
                if (ck, c, bucket) != now:
                    now, todo, ord_ = (ck, c, bucket), [], 0
                if kind == 0:
                    todo.append((start, _steps(letters)))
                    continue
                for _ in range(n):
                    if todo[0][0] is not None:
                        state, todo[0] = todo[0][0], (None, todo[0][1])
                    step = next(todo[0][1], None)
                    if step is None:
                        todo.pop(0)
                        state, step = todo[0][0], next(todo[0][1])
                        todo[0] = (None, todo[0][1])
                    for at, role, state in replay(step, state, [initial]):
                        ref = (False, 0, "", "", False) if at < 0 else (tk, t, r, h, True)
                        out.append((*now, ord_, *ref, r if role is None else role))
                        ord_ += 1
            yield pd.DataFrame(out, columns=names)

    done = both.select("ck", "c", "bucket", "kind", "tk", "t", "r", "h", "initial", "n", "start", "letters").mapInPandas(
        run, f"{_key(rows)}, bucket long, ord long, tk boolean, t long, r string, h string, own boolean, role string")
    texts = x.groupBy("ck", "c", "tk", "t", "r", "h").agg(F.first("x").alias("text")).withColumn("own", F.lit(True))
    full = done.join(texts, ["ck", "c", "tk", "t", "r", "h", "own"], "left")
    return full.select("ck", "c", "bucket", "ord", "role", F.coalesce("text", F.lit("")).alias("text"))


def _steps(letters: str) -> Iterator[str]:
    """The letters of each row: its own and the insertions after it (the first: also those before it)."""
    i = 0
    while i < len(letters):
        j = i
        while letters[j] == "I":
            j += 1
        j += 1
        while j < len(letters) and letters[j] == "I":
            j += 1
        yield letters[i:j]
        i = j


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, rows).

    Summary: (ck, c, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation that has rows.
    Rows: ``repaired_rows``.  ``c`` is the conversation id, ``ck`` whether it is known (a null id shows as 0 and false).
    """
    x = prepared(turns, conv_col, turn_col, role_col, text_col)
    rows = checkpoint(faults(x))  # no texts; read by the counts, the DP and the replay
    stats = checkpoint(counts(rows))
    chosen = checkpoint(audits(segments(rows, stats)))
    whole = chosen.groupBy("ck", "c").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"),
                                          F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "seg", "letters"))), lambda s: s["letters"]), "").alias("audit"))
    summary = stats.join(whole, ["ck", "c"]).select("ck", "c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, repaired_rows(x, rows, chosen)


def digests(rows: DataFrame) -> DataFrame:
    """(ck, c, repaired_sha256) of repaired rows; lines stream through the hash."""
    x = rows.select("ck", "c", "bucket", "ord", F.concat("role", F.lit(":"), "text").alias("line"))
    x = x.repartition("ck", "c").sortWithinPartitions("ck", "c", "bucket", "ord").select("ck", "c", "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for pdf in batches:
            out = []
            for ck, c, line in pdf.itertuples(index=False, name=None):
                if (ck, c) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (ck, c), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=["ck", "c", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["ck", "c", "repaired_sha256"])

    return x.mapInPandas(run, f"{_key(rows)}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The query's test damage, by the CRC-32 of conv_id:turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    z = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "utf-8")) % 20
    x = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), z.alias("z")).where("z != 0")
    text = F.when(F.col("z") == 1, "").when(F.col("z") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("z") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return x.select("conv_id", "turn", F.when(F.col("z") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_convrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, rows = repair(damaged(turns))
    ids = turns.select(F.col("conv_id").isNotNull().alias("ck"), F.coalesce("conv_id", F.lit(0)).alias("c"), "conv_id").distinct()
    x = ids.join(summary, ["ck", "c"], "left").join(digests(rows), ["ck", "c"], "left")
    zero = [F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return x.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(k)), lambda p: ascii(k[p])::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS z FROM d, bits),
x AS (SELECT conv_id, turn, z, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
  CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM z WHERE z <> 0),
y AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE z = 3),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS later,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM i),
f AS (SELECT conv_id, turn, role, text, i, blank, later AND NOT blank AS dup, open AND NOT blank AND NOT later AS cut, left(role, 1) AS c,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM o),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
    {'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'} AS s2, {'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, b0,
    b1,
    list_sort(list_filter([b2, {'c': b0.c + 5, 'a': b0.a || 'I', 't': b0.t || chr(10) || 'user:'}, {'c': b1.c + 5, 'a': b1.a || 'I', 't': b1.t || chr(10) || 'user:'},
      {'c': b3.c + 5, 'a': b3.a || 'I', 't': b3.t || chr(10) || 'user:'}], lambda s: s.c IS NOT NULL))[1],
    list_sort(list_filter([b3, {'c': b2.c + 5, 'a': b2.a || 'I', 't': b2.t || chr(10) || 'assistant:'},
      {'c': b0.c + 10, 'a': b0.a || 'II', 't': b0.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
      {'c': b1.c + 10, 'a': b1.a || 'II', 't': b1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda s: s.c IS NOT NULL))[1]
  FROM (SELECT r.conv_id, r.i,
      {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS b0,
      list_sort(list_filter([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t},
        {'c': s0.c + p, 'a': CASE WHEN keep AND r.c = 's' THEN s0.a || 'K' END, 't': s0.t || line}], lambda s: s.c IS NOT NULL AND s.a IS NOT NULL))[1] AS b1,
      list_sort(list_filter([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t},
        {'c': s0.c + p, 'a': CASE WHEN keep AND r.c = 'u' THEN s0.a || 'K' END, 't': s0.t || line},
        {'c': s1.c + p, 'a': CASE WHEN keep AND r.c = 'u' THEN s1.a || 'K' END, 't': s1.t || line},
        {'c': s3.c + p, 'a': CASE WHEN keep AND r.c = 'u' THEN s3.a || 'K' END, 't': s3.t || line},
        {'c': s0.c + 1 + p, 'a': CASE WHEN keep THEN s0.a || 'R' END, 't': s0.t || chr(10) || 'user:' || r.text},
        {'c': s1.c + 1 + p, 'a': CASE WHEN keep THEN s1.a || 'R' END, 't': s1.t || chr(10) || 'user:' || r.text},
        {'c': s3.c + 1 + p, 'a': CASE WHEN keep THEN s3.a || 'R' END, 't': s3.t || chr(10) || 'user:' || r.text}], lambda s: s.c IS NOT NULL AND s.a IS NOT NULL))[1] AS b2,
      list_sort(list_filter([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t},
        {'c': s2.c + p, 'a': CASE WHEN keep AND r.c = 'a' THEN s2.a || 'K' END, 't': s2.t || line},
        {'c': s2.c + 1 + p, 'a': CASE WHEN keep THEN s2.a || 'R' END, 't': s2.t || chr(10) || 'assistant:' || r.text}], lambda s: s.c IS NOT NULL AND s.a IS NOT NULL))[1] AS b3
    FROM dp JOIN (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS p, NOT (blank OR dup) AS keep, chr(10) || role || ':' || text AS line FROM f) r
      ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i + 1) q),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT n.*, list_sort(list_filter([s0, s3], lambda s: s.c IS NOT NULL))[1] AS best FROM n JOIN dp ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
