"""Token-id files: documents tokenised, packed into rANS blocks in ascending id order, and read back.

1. Tokenise (Arrow batches in tasks): a text's ids are those of the tokenizers library; words that recur are
   remembered (see ``Encoder``).  Ids travel as little-endian u16 or u32 beside the document id.
2. Order: bounds of the id column (approximate quantiles, a handful of numbers) deal the rows out to parts of
   ascending ids, without a second pass over the texts; inside a part rows are sorted by id and packed into blocks
   of at least ``BLOCK_IDS`` ids that end with a document.  A row of the packed table is a block.
3. Count: every task counts its ids, Spark sums them: at most one row an id of the vocabulary.  That table,
   shared by all blocks, goes with the files.
4. Encode: each block by itself (``rans.encode``), written as Parquet rows (part, block, n_ids, doc_ids, doc_tokens,
   payload); ``payload`` is the format of ``rans.py``.  Any store that Spark writes to can hold them.
5. Read: parts' sizes give each part's place (one row a part); blocks decode in parallel and check their
   checksums.  ``read_ids`` decodes a range of a document's ids from the nearest checkpoint.

Texts are encoded whole.  Special tokens' strings inside a text are left to the tokenizer file's own rule.

Edge cases: null text is empty and has only the end id; null document ids come first; rows with equal ids keep
one place after the other (ties by their ids); a very long text is a block of its own; an empty table gives no
rows; other columns are ignored.  A damaged block or another frequency table raises ValueError.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import rans
from .common import lookup_join, table

BLOCK_IDS = 1 << 20
#: Rows a part is meant to hold; parts are at least as many as shuffle partitions.
PART_ROWS = 200_000
#: Bytes of texts that are encoded together.
BATCH = 12 << 20
#: Entries of a worker's memories of words and of pieces; a full one keeps what the last texts had.
REMEMBERED = 700_000, 500_000
#: Bytes that such a memory's strings may have.
REMEMBERED_BYTES = 64 << 20
#: Words or pieces in one call of ``re`` or the library.
CALL = 20_000
#: Whole texts in one call of the library.
WHOLE = 64
#: Characters (Latin-1) that ``re`` and the tokenizer's regular expressions class alike; with the next one.
_PLAIN = bytes([*b"\t\n\r", *range(0x20, 0x7F), *(b for b in range(0xA1, 0x100) if b not in b"\xb2\xb3\xb9\xbc\xbd\xbe")])
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: A blank inside or at the end of wider white space: there the cut before blanks is not the tokenizer's.
_WIDE = re.compile(r"\s (?!\S)")
#: Fixed value: the split of byte-level BPE vocabularies of this family, in the classes of ``re``; \0, which is in no
#: plain text, stands between words and ends each like the text's end.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w\0]|_)+|\s+(?![^\s\0])|\s+")


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return not _ODD.search(text)


def _binary(ends: np.ndarray, raw: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings that end at ``ends``, one after the other in ``raw``."""
    at = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _ends(strings: pa.LargeBinaryArray) -> np.ndarray:
    """0, then where each byte string ends in ``_raw``."""
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]


def _raw(strings: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)


class Known:
    """Strings met before and their ids, as two Arrow arrays: no Python object an entry."""

    def __init__(self):
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def look_up(self, strings: pa.LargeStringArray, learn: Callable[[pa.LargeStringArray], pa.LargeBinaryArray], most: int) -> pa.LargeBinaryArray:
        """The ids of each string; those of new ones are ``learn``'s, which gets each of them once."""
        if not len(strings):
            return pa.array([], pa.large_binary())
        n = len(self.keys)
        numbered = pa.chunked_array([self.keys, strings]).dictionary_encode().chunks[-1]  # known strings keep their numbers
        keys, ids, at = numbered.dictionary, self.ids, numbered.indices
        if len(keys) > n:
            ids = pa.concat_arrays([ids, learn(keys[n:])])
        got = ids.take(at)
        if len(keys) > most:
            used = np.zeros(len(keys), bool)
            used[at.to_numpy()] = True
            keys, ids = keys.filter(pa.array(used)), ids.filter(pa.array(used))
        if keys.nbytes > REMEMBERED_BYTES:
            keys, ids = keys[:0], ids[:0]
        self.keys, self.ids = keys, ids
        return got


class Encoder:
    """Ids of whole texts, as bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Byte-level BPE without normalizer splits a text into pieces and encodes each by itself, and a piece starts
    at a blank that follows a non-blank.  So a text is cut before its blanks, and the ids of a cut word are
    remembered; words met for the first time are split into pieces, whose ids are remembered too.  New pieces go to
    the library, which runs the tokenizer's own model over many in one call; the bytes of the ids tell whose they are.
    Texts with characters or white space where that cut could differ, with a special token's string, or any text
    under another kind of tokenizer are encoded as a whole.
    """

    def __init__(self, tokenizer_json: str, remembered: tuple[int, int] = REMEMBERED):
        # a worker process keeps its tokenizer and memory over its tasks; the package itself travels by value
        kept = sys.modules.setdefault("_tidemark_words", types.ModuleType("_tidemark_words")).__dict__
        mark = zlib.crc32(tokenizer_json.encode())
        if mark not in kept:
            kept[mark] = self._prepared(tokenizer_json)
        self.__dict__.update(kept[mark])
        self.dtype, self.remembered = np.dtype(_dtype(self.tok)), remembered

    @staticmethod
    def _prepared(tokenizer_json: str) -> dict:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        tok, spec = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that the vocabulary writes as themselves
        other = iter(range(256, 512))
        letters = "".join(chr(b if b in shown else next(other)) for b in range(256))
        vocab = tok.get_vocab(with_added_tokens=False)
        # without a letter for each byte, ids would not tell which bytes they cover
        cut = (not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
               and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(c in vocab for c in letters))
        out = {"tok": tok, "cut": cut, "letters": letters, "special": [t["content"] for t in spec.get("added_tokens", [])], "words": Known(), "pieces": Known()}
        if cut:
            out["bpe"] = Tokenizer(tok.model)
            out["bpe"].pre_tokenizer = CharDelimiterSplit(letters[0])
            out["n_bytes"] = np.zeros(max(vocab.values()) + 1, np.int64)
            out["n_bytes"][list(vocab.values())] = [len(t) for t in vocab]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for a in range(0, len(texts), WHOLE) for e in self.tok.encode_batch_fast(texts[a:a + WHOLE], add_special_tokens=False)]

    def _of_pieces(self, new: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of pieces, each encoded by the tokenizer's model."""
        ids = []
        for a in range(0, len(new), CALL):
            shown = charmap_decode("\0".join(new[a:a + CALL].to_pylist()).encode("utf-8"), "strict", self.letters)[0]
            ids.append(np.array(self.bpe.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(ids)
        ends, covered = np.cumsum(pc.binary_length(new).to_numpy()), np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(covered, ends)
        if covered[-1] != ends[-1] or (covered[last] != ends).any():
            raise ValueError("a piece's ids do not cover it")
        return _binary((last + 1) * ids.itemsize, ids)

    def _of_words(self, new: pa.LargeStringArray, blank: str = " ") -> pa.LargeBinaryArray:
        """Ids of words, each with the blank before it: those of its pieces, one after the other."""
        pieces = pa.chunked_array((_PIECE.findall(blank + ("\0" + blank).join(new[a:a + CALL].to_pylist())) for a in range(0, len(new), CALL)), pa.large_string()).combine_chunks()
        word_ends = np.cumsum(pc.binary_length(new).to_numpy() + len(blank))
        piece_ends = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy())])
        ids = self.pieces.look_up(pieces, self._of_pieces, self.remembered[1])
        return _binary(_ends(ids)[np.searchsorted(piece_ends, word_ends)], _raw(ids))

    def _cuts(self, t: str) -> bool:
        """Whether the cut before blanks is the tokenizer's own in this text."""
        if not self.cut or not _plain(t) or any(s in t for s in self.special):
            return False
        return not ("  " in t or "\n " in t or "\t " in t or "\r " in t) or not _WIDE.search(t)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._cuts(t)]
        known = set(plain)
        rest = [i for i in range(len(texts)) if i not in known]
        for i, b in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = b
        if not plain:
            return out
        # Arrow cuts all texts and numbers their distinct words; Python sees each new one of those once
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        first = cut.offsets.to_numpy()
        heads = self._of_words(cut.values.take(pa.array(first[:-1])), "").to_pylist()  # not after a blank
        row = self.words.look_up(cut.values, self._of_words, self.remembered[0])  # the ids of all words, one after the other
        at, raw = _ends(row), memoryview(_raw(row))
        for i, h, a, b in zip(plain, heads, at[first[:-1] + 1].tolist(), at[first[1:]].tolist()):
            out[i] = h + raw[a:b]
        return out


def _dtype(tok) -> str:
    return "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Ascending bounds of the parts; a function of the id column alone."""
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = docs.count()
    parts = max(conf, n // PART_ROWS + 1)
    found = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def packed_blocks(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                  block_ids: int = BLOCK_IDS) -> DataFrame:
    """(part, block, doc_ids, doc_tokens, ids): ids in ascending document order, a row a block."""
    bounds = np.array(_bounds(docs, id_col), np.int64)
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small objects without cycles
        enc = Encoder(tokenizer_json)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            a = 0
            while a < batch.num_rows:
                n = max(1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH, "right")) - a)
                b = batch.slice(a, n)
                a += n
                ids = b.column(0)
                part = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left")
                got = [e + end for e in enc.encode(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pa.array(got, pa.binary())], ["part", "doc_id", "ids"])
                pa.default_memory_pool().release_unused()
        gc.enable()

    size = np.dtype(_id_type(tokenizer_json)).itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, docs_, lens, ids, total = None, 0, [], [], [], 0
        names = ["part", "block", "doc_ids", "doc_tokens", "ids"]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs_], pa.list_(pa.int64())),
                                               pa.array([lens], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary())], names)

        for batch in batches:
            for p, d, b in zip(*(c.to_pylist() for c in batch.columns)):
                if docs_ and (p != part or total >= block_ids):
                    yield row()
                    block = block + 1 if p == part else 0
                    docs_, lens, ids, total = [], [], [], 0
                part = p
                n = len(b) // size
                docs_.append(d)
                lens.append(n)
                ids.append(b)
                total += n
        if docs_:
            yield row()

    t = x.mapInArrow(tokenise, "part int, doc_id long, ids binary")
    t = t.repartition(max(len(bounds) + 1, 1), "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return t.mapInArrow(pack, "part int, block int, doc_ids array<long>, doc_tokens array<long>, ids binary")


def _id_type(tokenizer_json: str) -> str:
    from tokenizers import Tokenizer
    return _dtype(Tokenizer.from_str(tokenizer_json))


def _count_ids(packed: DataFrame, dtype: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for b in batch.column(0):
                c = np.bincount(np.frombuffer(b.as_buffer(), dtype))
                if len(c) > len(total):
                    c[:len(total)] += total
                    total = c
                else:
                    total[:len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return packed.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
          block_ids: int = BLOCK_IDS) -> None:
    """Write ``path``/packed (step 2), ``path``/table (id, freq, bits) and ``path``/blocks."""
    spark = docs.sparkSession
    dtype = _id_type(tokenizer_json)
    packed_blocks(docs, tokenizer_json, end_id, id_col, text_col, block_ids).write.option("compression", "zstd").parquet(f"{path}/packed")
    packed = spark.read.parquet(f"{path}/packed")
    counts = _count_ids(packed, dtype).toArrow()  # at most one row an id of the vocabulary
    t = rans.Table.of_counts(counts["id"].to_numpy(), counts["n"].to_numpy())
    rows = pa.table({"id": pa.array(t.symbols.astype("int64")), "freq": pa.array(t.freq.astype("int64")), "bits": pa.array(np.full(len(t.freq), t.bits, "int32"))})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/table")
    symbols, freq, bits = t.symbols, t.freq, t.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(symbols, freq, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), dtype)
                head = [batch.column(c).slice(k, 1) for c in ("part", "block", "doc_ids", "doc_tokens")]
                yield pa.RecordBatch.from_arrays([*head, pa.array([len(ids)], pa.int64()), pa.array([rans.encode(ids, shared)], pa.binary())],
                                                 ["part", "block", "doc_ids", "doc_tokens", "n_ids", "payload"])

    packed.mapInArrow(run, "part int, block int, doc_ids array<long>, doc_tokens array<long>, n_ids long, payload binary") \
        .write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> rans.Table:
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()
    bits = rows["bits"][0].as_py() if rows.num_rows else 16
    return rans.Table(rows["id"].to_numpy(), rows["freq"].to_numpy(), bits)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all blocks before."""
    b = spark.read.parquet(f"{path}/blocks")
    sizes = b.groupBy("part", "block").agg(F.sum("n_ids").alias("n"))  # a row a block
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = sizes.withColumn("before", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(base, F.col("part") == F.col("p")) \
        .select("part", "block", (F.col("base") + F.col("before")).cast("long").alias("start"))
    return lookup_join(b, place, ["part", "block"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, block): every document, decoded and checked."""
    t = read_table(spark, path)
    symbols, freq, bits = t.symbols, t.freq, t.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(symbols, freq, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = memoryview(rans.decode(batch.column("payload")[k].as_py(), shared).astype("<u4").tobytes())
                lens = np.array(batch.column("doc_tokens")[k].as_py(), np.int64)
                ends = np.cumsum(lens)
                if len(ends) and 4 * int(ends[-1]) != len(raw):
                    raise ValueError("a block's documents do not fill it")
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist())]
                n = len(lens)
                same = lambda c, kind: pa.array([batch.column(c)[k].as_py()] * n, kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(batch.column("start")[k].as_py() + ends - lens, pa.int64()),
                                                  pa.array(lens, pa.int64()), pa.array(crc, pa.int64()), same("part", pa.int32()), same("block", pa.int32())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32", "part", "block"])

    cols = blocks(spark, path).select("part", "block", "start", "doc_ids", "doc_tokens", "payload")
    return cols.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int")


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of the whole sequence, a bounded range: only blocks and checkpoints that it touches are decoded."""
    t = read_table(spark, path)
    near = blocks(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("start", "payload").orderBy("start")
    got = [rans.decode(bytes(r.payload), t, max(0, start - r.start), stop - r.start) for r in near.toLocalIterator()]
    return np.concatenate(got) if got else np.zeros(0, "<u4")


def op12_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back from the files."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_json)
    return read_documents(spark, path).drop("part", "block")
