"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to weighted symbols: insult, threat, target, negation, reported speech, clause
boundary, colon and the marks of a reported quotation.  Two small clause machines, one for modality (plain, negated,
reported, both) and one for whether a target was named, are composed into one table.  Running it over a text's symbols
holds the insults' and threats' weights until their clause ends and emits them by the modality they were read in and by
whether the clause names a target before them, only after them, or not at all (a threat without one adds nothing).
A document's score is a logistic function of those sums, so what a negation or a quotation takes off is learned, not fixed.

A report lasts to the clause's end, across a colon, and through a quotation opened under it until that closes; a
quotation is also reported if a word of report follows its end within ``TAIL`` words.  Quotation marks without a
report, or without their other mark in the same paragraph, are passed over.

Function words and English insults are fixed lists; further insult stems (prefixes of words) are learned with
their weights from labelled texts, as log ratios of document rates.  Stems and the logistic part are fitted on
a sample of at most ``FIT_ROWS`` labelled rows (those with the smallest hash of the id); scoring reads every
whole text.  Only rows whose crc32 of the id modulo 3 is not 1 are ever used for fitting, and label, lang,
source and id are no inputs of a score.

Edge cases: null and empty texts have no clause and score like any text without a match; a null id is never
held out; repeated rows score alike; several labels of one id all count; without a toxic and a clean label to
learn from only the fixed lists score; an empty table gives no rows; columns of the input are kept by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

THRESHOLD = 0.7
FIT_ROWS = 40_000
#: Learned stems kept, by weight times support.
MAX_STEMS = 20_000
STEM_LENGTHS = range(3, 13)
MIN_SUPPORT = 4

# Words of the grammar's classes (English, German, French, Spanish).
INSULTS = ("bastard clown coward creep cretin degenerate dimwit disgusting dumb dumbass filth freak garbage idiot idiots imbecile "
           "jerk loser losers moron morons parasite pathetic pig rat scum stupid trash vermin worthless").split()
THREATS = ("kill hurt destroy murder beat stab shoot crush hang burn strangle töten umbringen schlagen tuer frapper détruire matar "
           "golpear destruir").split()
TARGETS = ("you your yours yourself he she they them him her du dich dir ihr euch sie tu toi vous ils elles tú usted ustedes "
           "vosotros ellos ellas").split()
NEGATIONS = ("not never no none neither nor isn't aren't wasn't don't doesn't nicht nie kein keine ne pas jamais nunca jamás").split()
REPORTS = ("said says say wrote writes claimed claims quoted quote reported told sagte schrieb behauptet dit écrit dijo "
           "escribió").split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”„«»]")
_LETTER = re.compile(r"[^\W\d_]")
INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY, COLON, OPEN, CLOSE, QUOTE = range(10)
#: Words that a negation reaches.
SCOPE = 3
#: Words after a quotation among which a word of report makes it reported.
TAIL = 3
#: The marks that end a quotation, by the mark that opens it.
CLOSES = {'"': '"', "“": "”“\"", "„": "“”\"", "«": "»", "»": "«", "”": "”"}


def compose(a: list[dict[int, int]], b: list[dict[int, int]]) -> list[list[int]]:
    """Product of two machines over the same symbols: state i * len(b) + j, a row of next states each."""
    return [[a[i].get(s, i) * len(b) + b[j].get(s, j) for s in range(QUOTE)] for i in range(len(a)) for j in range(len(b))]


#: Modality: 0 plain, 1 negated, 2 reported, 3 reported and negated, 4 and 5 the last two inside a reported quotation.
MODALITY = [{NEGATION: 1, REPORT: 2, OPEN: 4}, {REPORT: 3, BOUNDARY: 0, COLON: 0, OPEN: 5}, {NEGATION: 3, BOUNDARY: 0, OPEN: 4},
            {BOUNDARY: 0, COLON: 2, OPEN: 5}, {NEGATION: 5, CLOSE: 0}, {BOUNDARY: 4, COLON: 4, CLOSE: 0}]
#: Whether the clause has named a target.
AIM = [{TARGET: 1}, {BOUNDARY: 0, COLON: 0}]
CLAUSE = compose(MODALITY, AIM)
#: Modality of a state as it is counted.
MODE = [m for m in (0, 1, 2, 3, 2, 3) for _ in AIM]
#: Sums: symbol by modality by target before or none; then symbol by modality with the target only after; then the whole's.
HALF, AFTER, WHOLE = 8, 16, 24
FEATURES = WHOLE + 6


@dataclass
class Grammar:
    """Weighted lexicon and the logistic part."""

    stems: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)

    def lexicon(self) -> _Lexicon:
        return _Lexicon(self.stems)


class _Lexicon(dict):
    """Word to (symbol, weight) or None, remembered."""

    def __init__(self, stems: dict[str, float]) -> None:
        super().__init__()
        self.stems = stems
        self.fixed = {w: (s, 0.0) for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
        self.fixed |= {w: (INSULT, 3.0) for w in INSULTS} | {w: (THREAT, 3.0) for w in THREATS}

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        hit = None
        if not _LETTER.match(word):
            hit = (QUOTE if word in CLOSES else COLON if word == ":" else BOUNDARY, 0.0)
        else:
            w = word.lower().replace("’", "'")
            hit = self.fixed.get(w)
            for n in range(min(len(w), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
                weight = self.stems.get(w[:n])
                if weight is not None:
                    if hit is None or hit[0] == INSULT:
                        hit = (INSULT, max(weight, hit[1] if hit else weight)) if weight > 0 else hit
                    break
        self[word] = hit
        return hit


def quotations(tokens: list[str], hits: list) -> dict[int, int]:
    """Closing mark by opening mark (positions); none spans a blank line, marks of other kinds inside are passed over."""
    out, start, closes = {}, -1, ""
    for i, hit in enumerate(hits):
        if hit is None:
            continue
        if hit[0] == QUOTE:
            if start < 0:
                start, closes = i, CLOSES[tokens[i]]
            elif tokens[i] in closes:
                out[start], start = i, -1
        elif tokens[i] == "\n" and i and tokens[i - 1] == "\n":
            start = -1
    return out


def _told(hits: list, at: int) -> bool:
    """Whether a word of report follows the closing mark at ``at``."""
    for hit in hits[at + 1:at + 1 + TAIL]:
        if hit is not None and hit[0] >= REPORT:
            return hit[0] == REPORT
    return False


def features(text: str | None, lexicon: _Lexicon) -> np.ndarray:
    """Sums of the matched clauses' weights by symbol and state, and a few of their whole."""
    out = np.zeros(FEATURES)
    tokens = _TOKEN.findall(text or "")
    hits = list(map(lexicon.__getitem__, tokens))
    ends = quotations(tokens, hits) if any(hit is not None and hit[0] == QUOTE for hit in hits) else {}
    state, best, total, seen, negated_at, closing = 0, 0.0, 0.0, set(), -SCOPE - 1, -1
    held: list[tuple[int, float, int, int, str]] = []  # the clause's matches: symbol, weight, modality, target before, word

    def end_clause(aimed: int) -> None:
        nonlocal best, total
        clause = 0.0
        for symbol, weight, mode, before, word in held:
            if symbol == THREAT and not aimed:
                continue  # a threat needs a target
            out[AFTER + HALF // 2 * symbol + mode if aimed > before else HALF * symbol + 2 * mode + before] += weight
            clause += weight
            seen.add(word)
        held.clear()
        total += clause
        best = max(best, clause)

    for i, hit in enumerate(hits):
        if hit is None:
            continue
        symbol, weight = hit
        if symbol == QUOTE:
            if i == closing:
                symbol = CLOSE
            elif i in ends and (MODE[state] >= 2 or _told(hits, ends[i])):
                symbol, closing = OPEN, ends[i]
            else:
                continue
        if held and symbol in (BOUNDARY, COLON):
            end_clause(state % 2)
        state = CLAUSE[state][symbol]
        if symbol == NEGATION:
            negated_at = i
        elif symbol <= THREAT:
            mode = MODE[state]
            if mode in (1, 3) and i - negated_at > SCOPE:
                mode -= 1  # out of the negation's reach
            held.append((symbol, weight, mode, state % 2, tokens[i]))
    end_clause(state % 2)
    n = len(tokens)
    out[WHOLE:] = (best, np.log1p(n), total / np.sqrt(1.0 + n), np.sqrt(total), len(seen), 100.0 * total / (20.0 + n))
    return out


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _stem_counts(texts: DataFrame) -> DataFrame:
    """(stem, toxic, clean): documents that have a word with the stem; a whole word counts with a final mark."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            by = (Counter(), Counter())
            for text, label in zip(p["text"], p["label"]):
                words = {w.lower() for w in _TOKEN.findall(text or "") if _LETTER.match(w)}
                by[int(label)].update({w[:n] for w in words for n in STEM_LENGTHS if n <= len(w)})
            stems = list(by[0].keys() | by[1].keys())
            yield pd.DataFrame({"stem": stems, "toxic": [by[1][s] for s in stems], "clean": [by[0][s] for s in stems]})

    return texts.mapInPandas(count, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(texts: DataFrame, max_stems: int = MAX_STEMS) -> dict[str, float]:
    """Weights of stems from a materialised, bounded (text, label) table."""
    n = {bool(r["label"]): r["count"] for r in texts.groupBy("label").count().collect()}
    if not n.get(True) or not n.get(False):
        return {}
    weight = F.log((F.col("toxic") + 0.5) / (n[True] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[False] + 1.0))
    x = _stem_counts(texts).where(F.col("toxic") + F.col("clean") >= MIN_SUPPORT).withColumn("w", weight)
    # a root is clearly more frequent in toxic texts: the log ratio by two standard errors
    error = F.sqrt(1.0 / (F.col("toxic") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    x = checkpoint(x.where((F.col("toxic") >= 3) & (F.col("w") > 0)).withColumn("z", (F.col("w") - 1.0) / error))
    roots = x.where("z > 2").orderBy(F.col("z").desc(), "stem").limit(max_stems).select("stem", "w").collect()  # the lexicon's bound
    stems = {r["stem"]: float(r["w"]) for r in roots}
    return stems


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS) -> Grammar:
    """Grammar learned from the labelled rows that are not held out, at most ``fit_rows`` of them."""
    rows = (labels.where(F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
            .select(F.col(id_col).alias("__lid"), (F.col(label_col) != 0).cast("int").alias("label")))
    rows = checkpoint(rows.orderBy(F.xxhash64("__lid"), "__lid", "label").limit(fit_rows))
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    texts = checkpoint(picked.join(F.broadcast(rows), F.col("__id") == F.col("__lid")).select("text", "label"))  # fit_rows at most
    g = Grammar(stems=learn_stems(texts))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = g.lexicon()
        for p in parts:
            yield pd.DataFrame({"x": [features(t, lexicon).tolist() for t in p["text"]], "label": p["label"]})

    data = texts.mapInPandas(read, "x array<double>, label int").toPandas()
    y = data["label"].to_numpy(float) if len(data) else np.zeros(0)
    if not 0 < y.sum() < y.size:
        g.mean, g.scale, g.coef = [0.0] * FEATURES, [1.0] * FEATURES, [-3.0] + [1.0] * WHOLE + [0.0] * 6
        return g
    x = np.stack(data["x"].to_numpy())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    g.mean, g.scale, g.coef = mean.tolist(), scale.tolist(), _logistic((x - mean) / scale, y).tolist()
    return g


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = grammar.lexicon()
        mean, scale, b = np.array(grammar.mean), np.array(grammar.scale), np.array(grammar.coef)
        for s in parts:
            x = (np.stack([features(t, lexicon) for t in s]) - mean) / scale if len(s) else np.zeros((0, FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30))), index=s.index)

    return docs.withColumn(out, toxic(F.col(text_col).cast("string")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return x.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
