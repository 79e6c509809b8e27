"""Token files: the codec, the encoder and the whole round trip against plain tokenizing."""

import json
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import rans, tokenfiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def wanted(rows, tokenizer_json, end_id=0):
    """Brute force over (doc_id, text), in file order."""
    tok, start, out = Tokenizer.from_str(tokenizer_json), 0, []
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [end_id]) for d, t in rows]
    for d, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def read_back(spark, df, tokenizer_json, tmp_path, **kw):
    path = str(tmp_path / "t")
    tokenfiles.write(df, path, tokenizer_json, **kw)
    rows = tokenfiles.read_documents(spark, path).collect()
    return path, sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])


def test_codec_round_trip_and_ranges():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, rans.LANES, rans.LANES + 1, 70_001):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype("<u2")
        t = rans.Table.of_counts(*np.unique(ids, return_counts=True))
        b = rans.encode(ids, t, checkpoint_steps=16)
        assert (rans.decode(b, t, checkpoint_steps=16) == ids).all() and rans.n_ids(b) == n
        for i, j in ((0, n), (n // 3, n // 2), (max(0, n - 1), n), (n * 4 // 5, n + 9)):
            assert (rans.decode(b, t, i, j, checkpoint_steps=16) == ids[i:j]).all()


def test_codec_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, 400_000), 50_000).astype("<u2")
    s, c = np.unique(ids, return_counts=True)
    p = c / c.sum()
    block = rans.encode(ids, rans.Table.of_counts(s, c), lanes=512)  # few lanes: their states are not what is measured
    assert len(block) * 8 < 1.06 * len(ids) * -(p * np.log2(p)).sum()


def test_one_id_only_and_rare_ids():
    t = rans.Table.of_counts(np.array([9]), np.array([5]))
    assert (rans.decode(rans.encode(np.full(5000, 9), t), t) == 9).all()
    t = rans.Table.of_counts(np.arange(60_000), np.r_[np.full(59_999, 1), 10 ** 12])
    assert t.freq.min() == 1 and int(t.freq.sum()) == 1 << t.bits


def test_damage_is_seen():
    ids = np.arange(1000) % 7
    t = rans.Table.of_counts(*np.unique(ids, return_counts=True))
    b = rans.encode(ids, t)
    for at in (5, len(b) // 2, len(b) - 1):
        with pytest.raises(ValueError):
            rans.decode(b[:at] + bytes([b[at] ^ 1]) + b[at + 1:], t)
    with pytest.raises(ValueError, match="another frequency table"):
        rans.decode(b, rans.Table.of_counts(np.arange(7), np.arange(1, 8)))
    with pytest.raises(ValueError, match="not in"):
        rans.encode(np.array([8]), t)


def test_encoder_equals_the_tokenizer_on_odd_texts(tokenizer_json):
    tok, enc = Tokenizer.from_str(tokenizer_json), tokenfiles.Encoder(tokenizer_json)
    rng = np.random.default_rng(2)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "9", "é", "ñ", "日本", " ", " ", "\x0b", "\x1c", "!", "…", "😀", "<|endoftext|>", "_", "…", "ſ"]
    texts = [f"a{chr(k)} {chr(k)}b {chr(k)}{chr(k)} 1{chr(k)}" for k in [*range(0x500), *range(0x2000, 0x2100)]]  # every class of character
    texts += ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(3000)] + ["x" * 30_000, "ab " * 20_000]
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def invented(rng, n):
    """Words that hardly recur, some with marks, digits, line ends or letters beyond ASCII."""
    parts = ["tion", "ou", "er", "wh", "ble", "né", "ß", "st", "An"]
    tails = ["", "", "", ",", ".", ".\n", "\n\n", "'s", "-7", "\t", "!?", "…"]
    return ["".join(rng.choice(parts, rng.integers(1, 6))) + rng.choice(tails) for _ in range(n)]


def test_new_words_reach_the_library_in_few_calls(tokenizer_json):
    """One call a piece took most of the query's CPU time."""
    rng, tok, enc = np.random.default_rng(11), Tokenizer.from_str(tokenizer_json), tokenfiles.Encoder(tokenizer_json)
    texts, calls = [" ".join(invented(rng, 120)) for _ in range(100)], []

    def count(frame, event, arg):
        if event == "c_call" and type(getattr(arg, "__self__", None)).__module__.startswith("tokenizers"):
            calls.append(arg.__name__)

    sys.setprofile(count)
    try:
        got = enc.encode(texts)
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(b, enc.dtype).tolist() for b in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(calls) <= 20


@pytest.mark.parametrize("call", [3, 20_000])
def test_small_memories_and_calls_change_nothing(tokenizer_json, monkeypatch, call):
    monkeypatch.setattr(tokenfiles, "CALL", call)
    monkeypatch.setattr(tokenfiles, "WHOLE", 2)
    rng, tok, enc = np.random.default_rng(call), Tokenizer.from_str(tokenizer_json), tokenfiles.Encoder(tokenizer_json, remembered=(30, 10))
    for k in range(12):
        monkeypatch.setattr(tokenfiles, "REMEMBERED_BYTES", 200 if k % 3 == 2 else 1 << 20)
        texts = [rng.choice([" ", ""]) + " ".join([*invented(rng, rng.integers(0, 9)), *rng.choice(["", "a", "\n", "\nb", "\t", "\0", "日本"], 2)]) for _ in range(30)] + ["", " ", "  ", "\n"]
        for t, b in zip(texts, enc.encode(texts)):
            assert np.frombuffer(b, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
        words = {w for t in texts for w in t.split(" ")}
        assert len(enc.words.keys) == len(enc.words.ids) <= max(30, len(words))
        assert len(enc.pieces.keys) == len(enc.pieces.ids)
        assert enc.words.keys.nbytes <= tokenfiles.REMEMBERED_BYTES


def test_a_vocabulary_without_all_bytes_is_encoded_whole():
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "Ġ": 3}, "merges": [["a", "b"]]}}
    enc, tok = tokenfiles.Encoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    texts = ["ab abx xa", "x", "", "b ab"]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_plain_tokenizing(spark, tokenizer_json):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = tokenfiles.op12_tokenfiles(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == wanted(rows, tokenizer_json)


def test_edges_small_blocks_and_ranges(spark, tokenizer_json, tmp_path):
    """Null ids first, null and empty texts, equal ids, clashing columns, many blocks; ids beyond 2^53 stay exact."""
    rows = [(None, "no id"), (7, None), (7, ""), (7, "seven seven"), (2 ** 60 + 1, "big"), (2 ** 60, "bigger"), (-4, "x " * 900)] + [(100 + i, f"text {i} of many") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(5)
    path, got = read_back(spark, df, tokenizer_json, tmp_path, block_ids=300)
    want = wanted(rows, tokenizer_json)
    assert got == want
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    tok = Tokenizer.from_str(tokenizer_json)
    whole = np.concatenate([tok.encode(t, add_special_tokens=False).ids + [0] for d, t in sorted(r for r in rows if r[0] and r[0] >= 100)]).astype(int)
    start = next(s for d, s, *_ in want if d == 100)
    assert tokenfiles.read_ids(spark, path, start + 250, start + 900).tolist() == whole[250:900].tolist()


def test_empty_table(spark, tokenizer_json, tmp_path):
    assert read_back(spark, spark.createDataFrame([], "doc_id long, text string"), tokenizer_json, tmp_path)[1] == []


def test_texts_are_taken_by_their_bytes(spark, tokenizer_json, tmp_path, monkeypatch):
    """Batches of few bytes, texts longer than a batch, and nulls among them."""
    monkeypatch.setattr(tokenfiles, "BATCH", 400)
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 5 else " ".join(invented(rng, int(rng.choice([0, 1, 20, 300]))))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert read_back(spark, df, tokenizer_json, tmp_path)[1] == wanted(rows, tokenizer_json)
