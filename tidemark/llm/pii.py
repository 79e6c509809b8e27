"""Personal data: fixed patterns and bootstrapped contextual extraction (DataFrame functions only).

Base spans are the leftmost non-overlapping matches of four patterns (email, ip, card with a valid Luhn sum,
phone).  They seed a bootstrap over the whole corpus.  Candidates are all tokens with a digit or ``@``; the one
or two words before a candidate are its lexical patterns.  In the graph of patterns and instances (token
values), seeds start with confidence 1 for their kind; in each round a pattern's score for a kind is the
confidence of its occurrences over their number plus ``PRIOR``, and an unlabelled instance's confidence is the
noisy-or of its patterns' scores, if its shape fits the kind.  After the last round, patterns with at least
``MIN_SEEDS`` different seed instances and a score of ``MIN_SCORE`` or more mark the unlabelled candidates they
precede as spans of their kind.  Found spans never touch base spans.

Texts are scanned once; the small tables of spans and candidates are checkpointed, patterns and instances are
counted by aggregates that combine before the shuffle, and only scores are joined back.

Offsets are code points from 0, end exclusive.  Regular expressions use possessive runs and boundaries, so a
very long text costs time in proportion to its length; they match what the plain ones in ``BASE`` match.

Edge cases: null text is empty and has no spans; a null id is kept; repeated rows are scanned alike and count as
separate occurrences, not as separate instances; an empty table gives no rows; other columns are kept by
``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, packed_row, table

# What the base patterns match, kinds in order.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches (cards: those with 14 to 19 digits) without repeated scanning of long runs.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
ROUNDS = 3
PRIOR = 2.0
MIN_SEEDS = 5
MIN_SCORE = 0.8
#: Code points before a candidate in which its one or two context words are looked for.
CONTEXT = 64
_SPAN = "struct<start:int,ord:int,end:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + _luhn_digit(back.substr(i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, regex: str, made, kind: str) -> Column:
    """Array of ``made(match, start, gap)`` for each match, in order; null elements are dropped."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))).alias("g"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["g"])
        return F.struct((at + F.length(p["m"])).alias("at"), F.concat(acc["out"], made(p["m"], at, p["g"])).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Base spans of a text that is not null, by start, then kind."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    # a mark without which the kind cannot match
    marks = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    parts = []
    for k, kind in enumerate(KINDS):
        made = lambda m, at, _, k=k, kind=kind: F.when(_valid(kind, m), F.array(F.struct(
            at.alias("start"), F.lit(k).alias("ord"), (at + F.length(m)).alias("end")))).otherwise(none)
        parts.append(F.when(marks[kind], _matches(text, _FAST[kind], made, _SPAN)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _context(gap: Column) -> Column:
    """Lexical patterns before a candidate: its last word, and its last two."""
    near = F.right(gap, F.lit(CONTEXT))
    cut = F.when(F.length(gap) > CONTEXT, F.regexp_replace(near, r"^\S*", "")).otherwise(near)
    words = F.filter(F.split(F.lower(cut), r"\s+"), lambda w: w != "")
    one = F.when(F.size(words) >= 1, F.array(F.concat(F.lit("1 "), F.element_at(words, -1))))
    two = F.when(F.size(words) >= 2, F.array(F.concat(F.lit("2 "), F.array_join(F.slice(words, -2, 2), " "))))
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(one, none), F.coalesce(two, none))


def candidates(text: Column) -> Column:
    """Tokens with a digit or @, without punctuation around: value, start, end, patterns."""
    kind = "struct<value:string,start:int,end:int,patterns:array<string>>"

    def made(m: Column, at: Column, gap: Column) -> Column:
        lead = F.length(F.regexp_extract(m, r"^[^A-Za-z0-9+@(]*+", 0))
        body = F.regexp_replace(m.substr(lead + 1, F.length(m)), r"[^A-Za-z0-9]+$", "")
        return F.array(F.struct(body.alias("value"), (at + lead).alias("start"), (at + lead + F.length(body)).alias("end"),
                                _context(gap).alias("patterns")))

    none = F.expr(f"cast(array() as array<{kind}>)")
    return F.when(text.rlike("[0-9@]"), _matches(text, _CANDIDATE, made, kind)).otherwise(none)


def _fits(value: Column, k: int) -> Column:
    """Whether a token has the shape of a kind."""
    n = F.length(_digits(value))
    plain = ~value.rlike("[A-Za-z@]")
    return [value.contains("@") & value.rlike("[A-Za-z0-9]@[A-Za-z0-9]"),
            value.rlike(r"^[0-9]+([.:][0-9]+){3,}$") | value.rlike(r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){3,}$"),
            plain & n.between(12, 19), plain & n.between(7, 15)][k]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, __th, base, cands) of every row, checkpointed; __th hashes the text.

    A candidate in which a base span begins stands for that span: it has its kind in ``seed`` and its text as
    value.  Candidates further inside a span are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.select(F.col(id_col), text.alias("__t"))
    x = x.select(id_col, "__t", base_spans(F.col("__t")).alias("base"), candidates(F.col("__t")).alias("c"))

    def labelled(c: Column) -> Column:
        s = F.get(F.filter("base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])), F.lit(0))
        inner = s["start"] < c["start"]
        value = F.when(s.isNull(), c["value"]).otherwise(F.col("__t").substr(s["start"] + 1, s["end"] - s["start"]))
        return F.when(s.isNull() | ~inner, F.struct(value.alias("value"), c["start"].alias("start"), c["end"].alias("end"),
                                                    s["ord"].alias("seed"), c["patterns"].alias("patterns")))

    return checkpoint(x.select(id_col, F.xxhash64("__t").alias("__th"), "base", F.array_compact(F.transform("c", labelled)).alias("cands")))


def bootstrap(spans: DataFrame, id_col: str, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
              min_score: float = MIN_SCORE) -> DataFrame:
    """(__bid, __bth, found): the spans that high-confidence patterns add, by row, from a ``scan``."""
    c = spans.select(F.col(id_col).alias("__bid"), F.col("__th").alias("__bth"), F.inline("cands"))
    occ = c.select("value", "seed", F.explode("patterns").alias("pattern"))
    fit = [_fits(F.col("value"), k) for k in range(len(KINDS))]
    # edges of the graph: what is the same occurrence for scoring is counted
    edges = checkpoint(occ.groupBy("pattern", "value", "seed").agg(F.count(F.lit(1)).alias("n")))
    conf = [F.when(F.col("seed").isNotNull(), (F.col("seed") == k).cast("double")) for k in range(len(KINDS))]
    seeds = [F.count_distinct(F.when(F.col("seed") == k, F.col("value"))) for k in range(len(KINDS))]
    scored = edges.select("*", *[F.coalesce(conf[k], F.lit(0.0)).alias(f"c{k}") for k in range(len(KINDS))])
    patterns = None
    for r in range(rounds):
        total = F.sum("n") + F.lit(PRIOR)
        patterns = scored.groupBy("pattern").agg(*[(F.sum(F.col("n") * F.col(f"c{k}")) / total).alias(f"s{k}") for k in range(len(KINDS))])
        if r + 1 == rounds:
            break
        # only patterns with a score carry anything to their instances
        useful = patterns.where(F.greatest(*[F.col(f"s{k}") for k in range(len(KINDS))]) > 0)
        odds = (edges.where("seed is null").join(useful, "pattern").groupBy("value")
                .agg(*[(1.0 - F.exp(F.sum(F.log(1.0 - F.col(f"s{k}"))))).alias(f"i{k}") for k in range(len(KINDS))]))
        scored = checkpoint(edges.join(odds, "value", "left").select(edges.columns + [
            F.coalesce(conf[k], F.when(fit[k], F.col(f"i{k}")), F.lit(0.0)).alias(f"c{k}") for k in range(len(KINDS))]))
    support = edges.groupBy("pattern").agg(*[seeds[k].alias(f"n{k}") for k in range(len(KINDS))])
    good = [(F.col(f"s{k}") >= min_score) & (F.col(f"n{k}") >= min_seeds) for k in range(len(KINDS))]
    ok = F.lit(False)
    for g in good:
        ok = ok | g
    strong = checkpoint(patterns.join(support, "pattern").where(ok).select(
        "pattern", F.array_compact(F.array(*[F.when(good[k], F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("ord"))) for k in range(len(KINDS))])).alias("kinds")))
    rest = c.where("seed is null").select("*", F.explode("patterns").alias("pattern")).join(strong, "pattern")
    hit = rest.select("__bid", "__bth", "start", "end", "value", F.explode("kinds").alias("k"))
    shape = F.lit(False)
    for k in range(len(KINDS)):
        shape = shape | ((F.col("k.ord") == k) & fit[k])
    best = hit.where(shape).groupBy("__bid", "__bth", "start", "end").agg(F.max(F.struct(F.col("k.score").alias("score"), (-F.col("k.ord")).alias("o"))).alias("b"))
    span = F.struct("start", (-F.col("b.o")).cast("int").alias("ord"), "end")
    return best.groupBy("__bid", "__bth").agg(F.collect_set(span).alias("found"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __th, base, spans) of every row: base spans and all spans, as struct(start, ord, end)."""
    s = scan(docs, id_col, text_col)
    found = bootstrap(s, id_col)
    x = s.join(found, F.col(id_col).eqNullSafe(F.col("__bid")) & (F.col("__th") == F.col("__bth")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("found", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    return x.select(id_col, "__th", "base", every.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by its kind in brackets, such as ``[EMAIL]``."""
    found = (find_pii(docs, id_col, text_col).where(F.size("spans") > 0)
             .groupBy(F.col(id_col).alias("__pid"), F.col("__th").alias("__pth")).agg(F.first("spans").alias("__spans")))
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(packed_row(docs), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), th.alias("__th"))
    x = base.join(found, F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__th") == F.col("__pth")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("__text")
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return (F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.get(names, s["ord"]))).alias("out")))
                .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))

    done = F.aggregate("__spans", begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("__spans").isNull(), text).otherwise(done)
    return x.select(*[clean.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    x = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return x.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                    F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
