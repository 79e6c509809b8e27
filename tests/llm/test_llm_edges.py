"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, hosts, mix, pagetext, pii, simhash, substring, toxicity, vectors

LONG = "word " * 60_000 + "x" * 50_000 + " " + "1" * 50_000 + " a@b.org"
DOCS = "doc_id long, text string, source string, lang string, n_chars long"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a", "en", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a", "en", 1),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "b", "en", 1),
    (3, None, "b", None, None), (4, "", None, None, None), (None, "some text with no id at all", None, None, None),
    (None, None, None, None, None), (5, LONG, "c", "en", 5), (6, " \t\n", "c", "en", 5), (7, "short", "c", "en", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Input with columns named like the operators' helper and result columns."""
    names = "copies target __src __size fp id __id rule host path hash n label spans base g component keeper words a.b".split()
    return docs.withColumns({c: F.lit(c) for c in names})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mix(docs, none, clash):
    got = mix.mix_table(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.size for r in got if r.doc_id in (3, 4, 6)} == {0}
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert rows(mix.mix_table(docs)) == rows(mix.mix_table(docs.repartition(5)))
    assert mix.mix_table(none).count() == 0 and mix.mix(none).count() == 0
    out = mix.mix(clash)
    assert out.columns == [c for c in clash.columns if c != "copies"] + ["copies"] and out.count() == len(ROWS)


def test_substring(docs, none, clash):
    got = {(r.doc_id, r.n_words): r for r in substring.remove_repeats(docs, ranges=4, chunk=50).collect()}
    assert got[1, 14].n_removed == 0 and got[2, 14].n_removed == 14
    assert [tuple(r) for r in got[2, 14].removed] == [(0, 14)]
    assert got[3, 0].kept == "" and got[6, 0].n_removed == 0
    assert substring.remove_repeats(clash).count() == len(ROWS) and substring.remove_repeats(none).count() == 0


def test_simhash(docs, none, clash):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    assert {c for i, f, c in got if f == "0" * 16} == {3}
    assert {c for i, _, c in got if i in (1, 2)} == {1}
    kept = simhash.dedup(clash)
    assert kept.columns == clash.columns
    assert sorted(i for i, in kept.select("doc_id").collect() if i is not None) == [1, 3, 5, 7]
    assert simhash.near_duplicates(none).count() == 0 and simhash.dedup(none).count() == 0


def test_toxicity(spark, docs, none, clash):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (9, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.where("false")):
        got = toxicity.score(clash, toxicity.fit(docs, lab)).select("score").collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_decontam(spark, docs, none, clash):
    item = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (None, ""), (3, "too short"), (1, ROWS[0][1])], "item_id long, text string")
    assert {tuple(r)[0] for r in decontam.contaminated(docs, item).collect()} == {1, 2}
    left = decontam.decontaminate(clash, item)
    assert left.columns == clash.columns and left.count() == len(ROWS) - 3
    assert decontam.decontaminate(docs, item.where("false")).count() == len(ROWS)
    assert decontam.decontaminate(none, item).count() == 0


def test_pagetext(spark, none):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>a <b>b<p>c", "t"), (None, "<<>&amp; x", None),
                                   (4, "<div>" * 3000 + "deep text, yes." + "</p>" * 3000, "t"), (5, "<a href='x", "t")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in pagetext.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: "a b\n\nc", None: "<<>& x", 4: "deep text, yes.", 5: ""}
    assert pagetext.extract(pages.where("false")).count() == 0


def test_pii(docs, none, clash):
    got = {(r.doc_id, len(r.spans)) for r in pii.find_pii(docs).collect()}
    assert (5, 1) in got and (3, 0) in got
    out = pii.redact(clash)
    assert out.columns == clash.columns and out.count() == len(ROWS)
    assert [r.text[-7:] for r in out.where("doc_id = 5").collect()] == ["[EMAIL]"]
    assert pii.find_pii(none).count() == 0 and pii.redact(none).count() == 0


def test_hosts(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.ORG:80/es/x?y"), (3, "http://A.Example.ORG:80/es/x?y"),
                                   (4, "https://x.org"), (5, "https://x.org/"), (None, "://"), (6, "http://" + "a." * 5000 + "com/de/1")], "page_id long, url string")
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "rule", "verdict", "unit")})
    got = [(r["__row"].page_id, r.host[:20], r.path, r.rule, r.verdict) for r in hosts.judge(pages).collect()]
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got and (4, "x.org", "", None, "allow") in got
    assert got.count((3, "a.example.org:80", "/es/x", None, "allow")) == 2
    assert (5, "x.org", "/", "org/", "allow") in got
    assert [g[3:] for g in got if g[0] == 6] == [("com/de/", "block")]
    assert hosts.judge(pages.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0),
            (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("gid", F.lit(1))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()]
    assert got.count((2, 3, 1, False)) == 2 and (1, 3, 1, True) in got and (None, 3, 1, False) in got
    assert {g for g in got if g[0] and g[0] > 2} == {(i, 0, i, True) for i in range(3, 12)}
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, None, "assistant", "late"), (1, 1, "assistant", "a <|x|> <\\|y"), (1, 1, None, "b"),
             (None, 0, "we\nird\\n<|r", "t"), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("t", "pieces", "b")})
    got = {r.conv_id: r for r in chat.format_chat(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("pieces")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", ""), ("", "b"), ("assistant", "a <|x|> <\\|y"), ("assistant", "late")]
    assert got[1].loss == "a <|x|> <\\|ylate"
    assert [tuple(t) for t in got[None].back] == [("we\nird\\n<|r", "t")]
    assert len(got[2].loss) == 200_000
    assert chat.format_chat(df.where("false")).count() == 0


def test_large_ids_stay_exact(spark):
    """Ids over 2^53 beside null ids."""
    big = (1 << 62) + 1
    text = ROWS[0][1]
    df = spark.createDataFrame([(big, text), (None, text), (big + 1, text), (None, None)], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_removed) for r in substring.remove_repeats(df, ranges=2).collect()), key=repr)
    assert got == sorted([(big, 0), (big + 1, 14), (None, 14), (None, 0)], key=repr)
    items = spark.createDataFrame([(big + 2, text), (None, "x")], "item_id long, text string")
    hits = {(r["__id"], r.item_id) for r in decontam.contaminated(df, items).collect()}
    assert hits == {(big, big + 2), (big + 1, big + 2), (None, big + 2)}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(df.where("text is not null")).collect()}
    assert near == {big: big, None: big, big + 1: big}
