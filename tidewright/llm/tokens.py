"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

A file set is a folder of Parquet files whose rows are blocks: part and block number, the documents' row keys
and lengths, and two byte strings. `control` has two bits an id (its code's length less 1, four ids a byte,
lowest bits first); `data` has the codes, 1 to 4 bytes each, little-endian. A code is the id's rank by
frequency, so that common ids take one byte. The table of ranks is stored beside the blocks.
"""

from __future__ import annotations

import string
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, scratch, settle, slices, table

#: Ids that a block has, unless its last document is longer.
BLOCK_IDS = 1 << 19
#: Runs of letters and other pieces whose ids a Python worker keeps.
MEMO_WORDS = 700_000

#: ASCII punctuation that may end a word (no apostrophe), and words whose lower case is one letter for one and needs no normal form.
TAIL = string.punctuation.replace("'", "")
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on.
BYTE_CHARS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))
#: By control byte: the four lengths.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ids(codes: np.ndarray) -> tuple[bytes, bytes]:
    """control and data of an array of codes below 2**32."""
    codes = codes.astype("<u4")
    size = 1 + (codes > 0xFF) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    two = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    two[: len(codes)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    data = codes.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes of encode_ids()."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    held = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = held[at]
    for k in (1, 2, 3):
        more = np.nonzero(size > k)[0]
        out[more] |= held[at[more] + k] << np.uint32(8 * k)
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), then start[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class WordMemo:
    """Ids of whole texts. Words are split and told apart in Arrow; the runs of letters and the punctuation after them
    that a batch holds are looked up, and each new one goes to the tokenizer once. Exact for tokenizers whose tokens
    cross neither ASCII white space nor the edge between a run of letters and ASCII punctuation after it, and that
    lower-case; runs of ASCII and Latin-1 letters go straight to the tokenizer's model, other words to the tokenizer."""

    held: dict[str, "WordMemo"] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    @classmethod
    def of(cls, path: str) -> "WordMemo":
        """The one of this Python worker, which its tasks share."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.pool, self.start = array("I"), array("q", [0])

    def entries(self, pieces: list[str], letters: bool) -> np.ndarray:
        """Numbers of the pieces' entries, new ones being encoded; letters: all are runs of lower-case letters."""
        start, pool = self.start, self.pool
        got = np.array(list(map(self.entry.get, pieces, repeat(-1))), np.int64)
        at = np.flatnonzero(got < 0)
        if len(at):
            new = [pieces[k] for k in at.tolist()]
            if letters:
                tokenize = self.model.tokenize
                plain = [p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS) for p in new]
                ids = ([t.id for t in tokenize(p)] for p in plain)
            else:
                ids = (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))
            got[at] = np.arange(len(new)) + len(start) - 1
            self.entry.update(zip(new, got[at].tolist(), strict=True))
            for x in ids:
                pool.extend(x)
                start.append(len(pool))
        return got

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each word has."""
        core = pc.ascii_rtrim(words, TAIL)
        plain = pc.match_substring_regex(core, PLAIN)
        tail = pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()
        split = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        whole = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        ends = split[tail[split] > 0]
        first, second = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for at, pieces, letters in (
            (split, pc.utf8_lower(core.take(pa.array(split))), True),
            (whole, words.take(pa.array(whole)), False),
            (ends, pa.array([w[-n:] for w, n in zip(words.take(pa.array(ends)).to_numpy(zero_copy_only=False).tolist(), tail[ends].tolist(), strict=True)], pa.string()), False),
        ):
            coded = pieces.dictionary_encode()
            number = self.entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), letters)[coded.indices.to_numpy()]
            (second if at is ends else first)[at] = number
        start = np.append(np.frombuffer(self.start, np.int64), len(self.pool))  # the last has no ids: no tail
        two = np.column_stack([first, second]).ravel()
        two[two < 0] = len(start) - 2
        size = start[two + 1] - start[two]
        return np.frombuffer(self.pool, np.uint32)[_spread(start[two], size)] if len(self.pool) else np.zeros(0, np.uint32), size.reshape(-1, 2).sum(axis=1)

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text; null: none."""
        if len(self.start) > MEMO_WORDS:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        cuts = np.cumsum(pc.list_value_length(split).to_numpy())
        if not len(words):
            return [np.zeros(0, np.uint32)] * len(texts)
        ids, size = self.of_words(words)
        each = size[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        return np.split(ids[_spread((np.cumsum(size) - size)[at], each)], upto[cuts[:-1]])


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks (part, block, doc_ids, lengths, n_ids, ids) of documents in ascending doc_id order (null first).

    ids has the whole text's ids (null: none) and end_id for each document, little-endian, 16 bits each if the
    vocabulary allows, else 32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = WordMemo.of(tokenizer)
        kind = "<u2" if memo.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        part, block, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def cut() -> pa.RecordBatch:
            body = np.concatenate([np.append(x, end_id).astype(kind) for x in ids]).tobytes()
            n = pa.array([[len(x) + 1 for x in ids]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), n, pa.array([held], pa.int64()), pa.array([int(kind[2])], pa.int32()), pa.array([body], pa.binary())], ["part", "block", "doc_ids", "lengths", "n_ids", "width", "ids"])

        for batch in slices(batches, "text", 8 << 20):
            got = memo(batch.column("text"))
            for d, x in zip(batch.column("doc_id").to_pylist(), got, strict=True):
                if ids and held + len(x) >= BLOCK_IDS:
                    yield cut()
                    block, docs, ids, held = block + 1, [], [], 0
                docs.append(d)
                ids.append(x)
                held += len(x) + 1
        if ids:
            yield cut()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    dealt = docs.select("doc_id", "text").repartitionByRange(n, order).sortWithinPartitions(order)
    return dealt.mapInArrow(run, "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, width int, ids binary")


def _plain(r: dict) -> np.ndarray:
    return np.frombuffer(r["ids"], f"<u{r['width']}")


def id_ranks(blocks: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id. The vocabulary's size bounds what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            for r in batch.to_pylist():
                got = np.bincount(_plain(r))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = blocks.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of documents as a file set at path."""
    blocks = settle(token_blocks(docs, tokenizer, end_id), "ids", "zstd")
    release(docs.sparkSession)
    by_rank = id_ranks(blocks)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            coded = [encode_ids(rank[_plain(r)]) for r in batch.to_pylist()]
            names = ["part", "block", "doc_ids", "lengths", "n_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.binary()) for x in zip(*coded, strict=True))], [*names, "control", "data"])

    blocks.mapInArrow(run, "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    blocks.sparkSession.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/ranks")


def read_ids(spark: SparkSession, path: str, derive: Callable, schema: str) -> DataFrame:
    """Decode a file set. derive(doc_ids, starts in the block, ids of each) gives a RecordBatch of columns of `schema`; part and block come first."""
    ranks = spark.read.parquet(f"{path}/ranks").first()
    by_rank = np.frombuffer(ranks.ids, "<u4") if ranks else np.zeros(0, "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            for r in batch.to_pylist():
                ids = by_rank[decode_ids(r["control"], r["data"], r["n_ids"])]
                ends = np.cumsum(r["lengths"])
                got = derive(r["doc_ids"], ends - r["lengths"], np.split(ids, ends[:-1]))
                n = got.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), *got.columns], ["part", "block", *got.schema.names])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"part int, block int, {schema}")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, before): ids in all earlier blocks; sums by part first, so that no task sees all blocks."""
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("all", F.lit(0))
    parts = parts.select("part", earlier(Window.partitionBy("all").orderBy("part")).alias("base"))
    own = blocks.select("part", "block", earlier(Window.partitionBy("part").orderBy("block")).alias("own"))
    return own.join(parts, "part").select("part", "block", (F.col("own") + F.col("base")).alias("before"))


def digest(doc_ids: list, at: np.ndarray, ids: list[np.ndarray]) -> pa.RecordBatch:
    crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "at", "n_tokens", "ids_crc32"])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode, write, read back and digest documents (doc_id, text; other columns are ignored).

    A null or empty text has just the end id; equal doc_ids keep a row each and follow one another in any
    order; no documents give no rows.
    """
    spark = docs.sparkSession
    path = f"{scratch(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    got = read_ids(spark, path, digest, "doc_id long, at long, n_tokens long, ids_crc32 long")
    return got.join(starts(spark, path), ["part", "block"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_ranked_byte_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts, written and read back; see tokenized() for nulls, ties and empty texts."""
    import public_tokenizers

    return tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
