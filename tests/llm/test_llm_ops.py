"""Training-data operators against brute force, SQL twins, exact round trips and held-out accuracy."""

import hashlib
import html
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontam, hosts, mix, pagetext, pii, queries, simhash, substring, toxicity, vectors
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def values(cols, data):
    return sorted((tuple(None if v != v else v for v in r) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert values(names, map(tuple, got.select(*names).collect())) == values(names, want.fetchall())


# ---- mixing

def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 10_000, "c": 5_000, "d": 40, None: 3_000}
    df = spark.createDataFrame(list(sizes.items()), "__src string, source_size long")
    got = {r["__src"]: r.target for r in mix.source_targets(df).collect()}
    left, weights, total = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), {}, float(sum(sizes.values()))
    while left:  # share, fix what is over its cap, share the rest again
        unit = total / sum(left.values())
        over = [s for s, w in left.items() if w * unit >= 3 * sizes[s]]
        if not over:
            weights |= {s: w * unit for s, w in left.items()}
            break
        for s in over:
            weights[s] = 3.0 * sizes[s]
            total -= weights[s]
            del left[s]
    assert got == pytest.approx(weights)


def test_mix_takes_the_targets(spark):
    rows = mix.mix_table(table(spark, MID, "documents"), buckets=16).collect()
    by, largest = Counter(), Counter()
    for r in rows:
        by[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r.size)
        assert r.taken <= 3 * r.size
    for k, taken in by.items():
        assert abs(taken - k[1]) <= largest[k] / 2 + 1
    fine = {(r.doc_id, r.taken) for r in mix.mix_table(table(spark, MID, "documents")).collect()}
    assert fine == {(r.doc_id, r.taken) for r in rows}  # the number of buckets changes nothing


def test_inclusion_follows_the_measure(spark):
    """With many equal documents of two sizes, taken shares come near the expected copies."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("w "), F.lit(5))).otherwise(F.repeat(F.lit("w "), F.lit(50))).alias("text"), F.lit("s").alias("source"))
    got = mix.mix_table(df, share=0.5).groupBy("size").agg(F.avg("copies").alias("c")).collect()
    got = {r.size: r.c for r in got}
    a = 0.5 * (5 + 50) / (1 * 5 + 2 * 50)
    assert got[5] == pytest.approx(a, abs=0.04) and got[50] == pytest.approx(2 * a, abs=0.04)


# ---- substrings

def test_substring_chunks_and_ranges(spark):
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for i in range(120):
        own = [f"w{x}" for x in rng.integers(0, 5000, 30)]
        at = int(rng.integers(0, 20))
        texts.append((int(i), " ".join(own[:10] + shared[at:at + int(rng.integers(5, 20))] + own[10:])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    want = {}
    first = {}
    for i, t in texts:
        w = t.split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j:j + 13]), i)
    for i, t in texts:
        w = t.split()
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < i for p in range(j, j + 13)}
        want[i] = (len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    for ranges, chunk in ((1, 10), (5, 200), (16, 10 ** 6)):
        got = substring.remove_repeats(df, ranges=ranges, chunk=chunk).collect()
        assert {r.doc_id: (r.n_removed, r.kept) for r in got} == want
        assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


# ---- SimHash

def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(w[j:j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_brute_force(spark, con):
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    fp = [slow_fingerprint(t) for _, t in docs]
    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    comp = components(len(fp), pairs)
    want = {i: (f"{fp[k]:016x}", docs[comp[k]][0]) for k, (i, _) in enumerate(docs)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("small", [2, 48])
def test_close_links_connect_all_close_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: i for i, x in enumerate(signed)}
    got = [(at[r.a], at[r.b]) for r in links]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    close = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert components(len(fps), got) == components(len(fps), close)


# ---- pages

def test_pages_keep_the_article(con):
    for page, in con.execute("SELECT html FROM pages").fetchall():
        inside = page.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert pagetext.extract_main(page) == "\n\n".join(b for b in blocks if b)


LAYOUT = """<html><head><title>x</title></head><body class="has-sidebar"><header><a href=/>Site</a> banner</header>
<ul class="main-menu"><li><a>Home</a><li><a>About</a></ul><div id="wrap"><div class="sidebar"><h3>Related</h3>
<ul><li><a href=x>one</a></li></ul></div>{open}<h1>Title here</h1><p>A long paragraph, with words &amp; punctuation.
It goes on, and on, until the end of it.</p><h2>Sub</h2><p>Short.</p><ul><li>item <i>one</i></li><li>item two</li></ul>
<div class="ad-box">Buy now!</div><form><p>Your mail, please.</p></form><blockquote>Quoted text, long enough.</blockquote>
<table><tr><td>cell 1<td>cell&nbsp;2</table><p>1 < 2 and &lt;b&gt;<br>&#x41;</p>{close}<section id="comments"><h2>Comments</h2>
<div><p>Nice post, thank you very much for this, it is really long and full of punctuation, yes, it is.</p></div></section></div>
<div class="cookie-notice">We use cookies.</div><footer>copyright</footer><script>var a="<p>no</p>";</script></body></html>"""
WANT = ["Title here", "A long paragraph, with words & punctuation. It goes on, and on, until the end of it.", "Sub", "Short.", "item one",
        "item two", "Quoted text, long enough.", "cell 1", "cell 2", "1 < 2 and <b> A"]


@pytest.mark.parametrize("shell", [("<article>", "</article>"), ("<div class=content>", "</div>"), ("<main><div>", "</div></main>")])
def test_layouts(shell):
    assert pagetext.extract_main(LAYOUT.format(open=shell[0], close=shell[1])) == "\n\n".join(WANT)


# ---- toxicity

def test_held_out_accuracy(spark):
    docs, labels = table(spark, MID, "documents").select("doc_id", "text"), table(spark, MID, "labels")
    g = toxicity.fit(docs, labels)
    x = toxicity.score(docs, g).join(labels, "doc_id").where(toxicity.is_held_out(F.col("doc_id"))).toPandas()
    hit, toxic = x["score"] >= toxicity.THRESHOLD, x["toxic"] == 1
    assert (hit & toxic).sum() >= 0.75 * toxic.sum() and (hit & ~toxic).sum() <= 0.02 * (~toxic).sum()


def test_labels_held_out_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_clauses():
    lex = toxicity.Grammar().lexicon()
    total = lambda t: toxicity.features(t, lex)[:16]
    at = lambda t: np.flatnonzero(total(t)).tolist()
    assert at("you are an idiot") == [1] and at("idiot") == [0]
    assert at("you are not an idiot") == [3] and at("you are not the one that is an idiot") == [1]
    assert at("he said you are an idiot") == [5] and at("he never said it. What an idiot!") == [0]
    assert at("i will kill you") == [] and at("you, i will kill") == [9]
    assert at("a fine day") == []


# ---- decontamination

def test_templates(spark):
    item = "If Anna Miller has 12 apples weighing 3 kg and gives 5 apples to Bob, how many apples does Anna keep at the end of the day?"
    other = "Well. If Carla Stone has 90 apples weighing 8 lb and gives 7 apples to Dave, how many apples does Carla keep at the end of the day? Yes."
    mixed = "If Carla Stone has 90 apples weighing 8 lb and gives 7 apples to Eve and Zoe has 3 apples weighing 5 lb and gives 1 apple to Al"
    docs = spark.createDataFrame([(1, item), (2, other), (3, mixed), (4, "how many apples does it take at the end of the day")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["__id"]: r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_slot_majority():
    assert decontam.agreeing([["5"], ["5"], ["5"]], [["7"], ["7"], ["8"]], [1, 2, 3]) == 2
    assert decontam.agreeing([["5"], ["6"]], [["7"], ["7"]], [1, 2]) == 1  # two item values cannot mean one
    assert decontam.agreeing([[], []], [[], []], [1, 2]) == 2


def test_benchmark_copies_are_found(spark):
    con = duckdb.connect()
    docs = dict(con.execute(f"SELECT doc_id, text FROM '{MID}/documents.parquet'").fetchall())
    items = [t for t, in con.execute(f"SELECT text FROM '{MID}/benchmark.parquet'").fetchall()]
    holds = {i for i, t in docs.items() if any(b in (t or "") for b in items)}
    got = decontam.op4_decontam(spark, MID).collect()
    assert len(got) == len(docs) and holds
    assert holds <= {r.doc_id for r in got if r.contaminated}
    assert sum(r.contaminated for r in got) <= 1.05 * len(holds) + 1


# ---- personal data

def luhn(d):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, rx) in enumerate(pii.BASE.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d),
                    "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


HARD = ["a@b.c_d@e.f x@y 1001.1.1.1 0255.1.1.1 0256.1.1.1", "0.1.2.3.4 999.1.1.1.1.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 5", "x4111-1111-1111-1111-",
        "4111111111111111 4111111111111111", "+1 (017) 555-7713 +123 +1(2)3-4.5 6 7 8 9 0 x", "é@b.c ññ a.b%+c@d-e.f.g. +49 30 1234567", "😀 me@x.org 😀 10.0.0.1", None, ""]


def test_base_spans(spark, con):
    texts = HARD + [t for t, in con.execute("SELECT text FROM documents").fetchall()]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("0123456789. -+()@ab"), 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.scan(df, "doc_id", "text").select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    assert got == {i: slow_spans(t) for i, t in enumerate(texts)}


def test_bootstrap_finds_unseen(spark):
    texts = [f"word{i} please call me at +1 (555) 555-{1000 + i} today" for i in range(8)] + [
        "other thing call me at 555-0123-99 now", "nothing at 12", "version 2.0 of it", "call me at noon"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] == "word0 please call me at [PHONE] today" and out[8] == "other thing call me at [PHONE] now"
    assert [out[i] for i in (9, 10, 11)] == texts[9:]


def test_pii_query(spark, con):
    want = {i: hashlib.sha256(slow_spans(t).encode()).hexdigest() for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.base_sha256 for r in pii.op7_pii(spark, SF).collect()} == want


# ---- hosts

def test_reputation_shrinks(spark):
    outcomes = [("a.x.net", True)] * 40 + [("b.x.net", True)] * 30 + [("c.y.net", False)] * 50 + [("d.y.net", True)] + [("e.z.net", False)] * 20
    by_host, by_domain, _, overall = hosts.host_reputation(spark.createDataFrame(outcomes, "host string, bad boolean"))
    h, d = ({r.unit: r["mean"] for r in x.collect()} for x in (by_host, by_domain))
    assert d["y.net"] < overall < d["x.net"] and 0.95 < h["a.x.net"] <= 1
    assert d["y.net"] < h["d.y.net"] < 1  # one bad page is no proof
    urls = spark.createDataFrame([(1, "http://new.x.net/"), (2, "http://new.y.net/"), (3, "http://x.org/")], "page_id long, url string")
    assert [r.rule for r in hosts.judge(urls).orderBy("host").collect()] == [None, None, "org/"]


# ---- vectors

def test_vector_shards(spark):
    """Small shards, several levels and blocks: the links of brute force."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 500)] + 0.16 * rng.normal(size=(500, 16)), rng.normal(size=(200, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.93
    comp = components(len(x), np.argwhere(np.tril(s, -1)).tolist())
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, limit=120).collect()}
    true = s.sum(1) - 1
    assert all(got[i].n_links <= true[i] for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.95 * true.sum()
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.95 * len(x)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_graph_search_needs_no_full_graph():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 32)), 10, axis=0) + 0.02 * rng.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vectors.build_graph(x)
    padded = np.full((600, max(map(len, g))), -1)
    for i, nb in enumerate(g):
        padded[i, :len(nb)] = nb
    assert padded.shape[1] < 100
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    found = vectors.range_search(x, padded, vectors.medoids(x), 0.93)
    assert not (found & ~want).any() and found.sum() >= 0.98 * want.sum()


# ---- chat

def test_parts(spark):
    df = spark.sql("""SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, array(named_struct('type', 'text', 'text', 'see <|image|> ', 'ref', cast(null as string), 'units', cast(null as int)),
      named_struct('type', 'image', 'text', cast(null as string), 'ref', 'a.png', 'units', 2), named_struct('type', 'audio', 'text', null, 'ref', 'b.wav', 'units', 10),
      named_struct('type', 'odd', 'text', null, 'ref', 'c', 'units', 1)) AS parts UNION ALL SELECT 1, 1, 'assistant', null""")
    r = chat.format_chat(df, parts_col="parts", text_col=None).collect()[0]
    assert r.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|other|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("other", "c", 0)]
    assert r.attachment_tokens == 762


def test_escape_round_trip(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("<|\\>n\na"), int(rng.integers(0, 30)))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"),
                       chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er")).collect():
        assert r.b == r.t and r.r == r.t and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er


# ---- pipeline

def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = stage(spark, before, SF).cache()
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in kept.collect()}
        assert new.keys() <= old.keys()
        if k < 4:
            assert kept.columns == docs.columns
        if k == 0:
            g = toxicity.fit(before, table(spark, SF, "labels"))
            score = {r.doc_id: r.score for r in toxicity.score(before, g).collect()}
            assert new.keys() == {i for i, s in score.items() if s < 0.7}
        if k == 1:
            ids = sorted(old)
            fp = [slow_fingerprint(old[i].text) for i in ids]
            comp = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
            assert new.keys() == {ids[c] for c in comp}
        if k == 2:
            items = [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
            assert not any(b in (r.text or "") for b in items for r in new.values())
            assert not {i for i in old if not any(b in (text[i] or "") for b in items)} - new.keys()
        if k == 3:
            assert new.keys() == old.keys() and not any(slow_spans(r.text) for r in new.values())
            assert all(new[i].text == old[i].text for i in old if not slow_spans(old[i].text))
    assert kept.columns == [*docs.columns, "copies"] and kept.where("copies < 1").count() == 0
    whole = {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.copies) for r in kept.collect()}
