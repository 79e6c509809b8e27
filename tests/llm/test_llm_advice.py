"""Cases of the second review: each failed before its finding was settled."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tidemark.llm import decontam, toxicity  # noqa: E402


# ---- toxicity

def test_target_on_either_side():
    lex = toxicity.Grammar().lexicon()
    at = lambda t: np.flatnonzero(toxicity.features(t, lex)[:toxicity.WHOLE]).tolist()
    after = lambda symbol, mode: toxicity.AFTER + 4 * symbol + mode
    assert at("i will kill you") == at("we will hurt them") == [after(toxicity.THREAT, 0)]
    assert at("idiots, all of you") == [after(toxicity.INSULT, 0)]
    assert at("i will not kill you") == [after(toxicity.THREAT, 1)]
    assert at("they kill time. You are here") == [9] and at("we kill time. You are here") == []
    assert toxicity.features("i will kill you", lex)[toxicity.WHOLE] == 3.0


def test_reports_last_through_quotations():
    lex = toxicity.Grammar().lexicon()
    at = lambda t: np.flatnonzero(toxicity.features(t, lex)[:toxicity.WHOLE]).tolist()
    for t in ('she wrote: "you are an idiot"', "she wrote: you are an idiot", "sie schrieb: „Ach. Du bist... you idiot“",
              'he said: "Go away. You are an idiot!"', '"You are an idiot," she wrote', "il dit « you idiot »", "«you idiot», dijo"):
        assert at(t) == [5], t
    assert at('she wrote: "fine". You are an idiot') == [1]  # closed: no longer reported
    assert at('you are an "idiot"') == [1] and at('she wrote "a. You are an idiot') == [1]  # no report; never closed


# ---- decontamination

ITEM = "If Anna Miller has 12 apples weighing 3 kg and gives 5 apples to Bob, how many apples does Anna keep at the end of the day?"


def variant(name, a, b, c, to):
    return f"If {name} has {a} apples weighing {b} lb and gives {c} apples to {to}, how many apples does {name.split()[0]} keep at the end of the day?"


def test_instances_of_one_template_do_not_outvote_each_other(spark):
    x, y, z = variant("Carla Stone", 10, 8, 2, "Dave"), variant("Eve Wood", 90, 7, 4, "Zoe"), variant("Ann Hill", 31, 6, 9, "Al")
    texts = [f"{ITEM} {x}", f"{x} {ITEM} {y}", f"{x} {x} {y} {y} {ITEM} {z}", f"{x} {y}", f"{z} Some words between them. {y} {x}",
             "If Carla Stone has 10 apples weighing 8 lb and gives 2 apples to Eve and Zoe has 3 apples weighing 5 lb and gives 1 apple to Al"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    got = {r["__id"]: r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert got == {i: 1.0 for i in range(5)}


def test_items_without_usable_windows_and_copies_in_other_case(spark):
    names = "Then Anna Miller met Bob Stone and Carla Wood near Dave Hill before Eve Brook saw Zoe Lake with Al Marsh at Tom Field."
    items = [ITEM, names, "What is 12 + 30?", "12 7 30 45 6 81 90 11", "Anna Bob Carla Dave Eve Zoe Tom", "Der Hund Der Katze Die Maus Das Haus"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some words. {t} More of them." for t in items] + [t.lower() for t in items] + [names.upper(), "What is 12 + 31?", "12 7 30 45 7 81 90 11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["__id"], r.item_id): r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(i, i % 6): 1.0 for i in range(12)} | {(12, 1): 1.0}
