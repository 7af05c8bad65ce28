"""Byte-level BPE, exact and in linear time: longest matches, checked by a table of pairs that may stand side by side.

A text is cut into pieces by the vocabulary's pattern. In each piece an Aho-Corasick automaton gives the longest token
at every place. The encoder goes from left to right, takes the longest token that may follow the last one, and steps
back where none fits; a place that was left that way is never tried again, so the work is linear in the piece. Two
tokens may stand side by side if no merge across their border would have come before the merges that made them; such
answers are kept in a table. Decoding gathers bytes through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, utf8
from .tokens import BYTE_CHARS, _spread

#: Pieces of a text that are looked up at once; with texts of any length this bounds a worker's memory.
PIECES = 1 << 18
#: Bytes of text in a step of a task.
STEP_BYTES = 4 << 20
#: Distinct pieces and pairs of tokens that a Python worker keeps.
MEMO_PIECES, MEMO_PAIRS = 1_000_000, 1_000_000
#: Pieces above so many characters are encoded each time they come, not kept.
LONG_PIECE = 256
NEVER = 1 << 62
#: Texts of characters below this are cut by a pattern of plain classes, which is faster and says the same.
COMMON = 0x250

#: The pattern by which byte-level vocabularies of this family cut a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands."""
    return {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}


def common_pattern() -> str:
    """PATTERN for characters below COMMON, its classes being spelled out."""
    import regex

    some = [chr(c) for c in range(COMMON)]
    kind = lambda p: "".join(re.escape(c) for c in some if regex.match(p, c))
    letters, numbers, space = kind(r"\p{L}"), kind(r"\p{N}"), kind(r"\s")
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class PairTable:
    """Whether token b may follow token a. made[t] is the rank of the merge that makes t (-1: a single byte), parts[t] its two halves."""

    def __init__(self, ranks: dict[tuple[int, int], int], made: list[int], parts: list[tuple[int, int] | None]) -> None:
        self.ranks, self.made, self.parts = ranks, made, parts
        self.known: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > MEMO_PAIRS:
                self.known.clear()
            got = self.known[a, b] = self.derive(a, b)
        return got

    def derive(self, a: int, b: int) -> bool:
        """Take the merges at the border back, the latest first. While x and y face each other, a merge of theirs must not come
        before the merge that uses x up, nor before or with the one that uses y up (of equal merges the left one comes first)."""
        x, y, x_used, y_used = a, b, NEVER, NEVER
        while True:
            rank = self.ranks.get((x, y), NEVER)
            if rank < x_used and rank <= y_used and rank < NEVER:
                return False
            if self.made[x] < 0 and self.made[y] < 0:
                return True
            if self.made[x] > self.made[y]:
                x_used, x = self.made[x], self.parts[x][1]
            else:
                y_used, y = self.made[y], self.parts[y][0]


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library (one merge for each token, special tokens kept whole)."""

    held: dict[str, ByteBpe] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = cut and cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        special = [t for t in spec["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"])]
        if not (plain and level and model["type"] == "BPE" and spec.get("normalizer") is None and len(special) == len(spec["added_tokens"])):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab, alphabet = model["vocab"], byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in special)]) + 1
        made, parts, ranks = [-1] * size, [None] * size, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            if parts[whole] is not None:
                raise ValueError(f"two merges make token {whole}")
            ranks[pair], made[whole], parts[whole] = rank, rank, pair
        self.pairs = PairTable(ranks, made, parts)
        self.bytes_of = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in special}
        for content, k in self.special.items():
            self.bytes_of[k] = content.encode()
        # only tokens that merges reach can come out; matches are found from the right, so that the longest one starts at a place
        reach = {self.bytes_of[k]: k for k in vocab.values() if made[k] >= 0 or len(self.bytes_of[k]) == 1}
        self.finder = ahocorasick.Automaton()
        for b, k in reach.items():
            self.finder.add_word(b[::-1].decode("latin-1"), k)
        self.finder.make_automaton()
        self.length = [len(b) for b in self.bytes_of]
        self.shorter = [-1] * size
        for b, k in reach.items():
            self.shorter[k] = next((reach[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in reach), -1)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece, self.common, self.rare = regex.compile(PATTERN), re.compile(common_pattern()), re.compile(f"[^\\0-{chr(COMMON - 1)}]")
        ends = np.cumsum(self.length)
        self.start, self.size = ends - self.length, np.array(self.length)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.clear()

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """The one of this Python worker, which its tasks share."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.pool, self.cuts = array("I"), array("q", [0])

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The tokens to which the merges bring each piece."""
        whole = "\u0100".join([p.decode("latin-1") for p in pieces])  # the mark between pieces is in no token
        longest, top = [-1] * (len(whole) + 1), len(whole) - 1
        for at, token in self.finder.iter(whole[::-1]):
            if longest[top - at] < 0:  # matches of one place come longest first
                longest[top - at] = token
        first = 0
        for p in pieces:
            yield self._walk(longest, first, first + len(p))
            first += len(p) + 1

    def _walk(self, longest: list[int], at: int, end: int) -> list[int]:
        """The tokens from place `at` to `end`, given the longest match at each place; longest[end] is -1."""
        fits, known, shorter, length = self.pairs.fits, self.pairs.known, self.shorter, self.length
        out, left, token, last = [], set(), longest[at], -1
        while at < end:
            while token >= 0:
                to = at + length[token]
                if to not in left and (last < 0 or (known[last, token] if (last, token) in known else fits(last, token))):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = to, token, longest[to]
            else:
                left.add(at)
                token = out.pop()
                at, token, last = at - length[token], shorter[token], out[-1] if out else -1
        return out

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._cut(text[at : m.start()])
            yield m.group()
            at = m.end()
        yield from self._cut(text[at:] if at else text)

    def _cut(self, text: str) -> Iterator[str]:
        pattern = self.piece if self.rare.search(text) else self.common
        return iter(pattern.findall(text)) if len(text) < STEP_BYTES else (m.group() for m in pattern.finditer(text))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' entries in the memo, new ones being encoded; -1 for long ones."""
        got = np.fromiter(map(self.entry.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(got < 0).tolist()
        new = [p for p in dict.fromkeys([pieces[k] for k in lacking]) if len(p) <= LONG_PIECE or p in self.special]
        for p, ids in zip(new, self.encode_pieces([b"" if p in self.special else p.encode() for p in new]), strict=True):
            self.pool.extend([self.special[p]] if p in self.special else ids)
            self.entry[p] = len(self.cuts) - 1
            self.cuts.append(len(self.pool))
        got[lacking] = [self.entry.get(pieces[k], -1) for k in lacking]
        return got

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        parts, pieces = [np.zeros(0, np.uint32)], self.pieces(text)
        while some := list(islice(pieces, PIECES)):
            if len(self.entry) > MEMO_PIECES:
                self.clear()
            number = self._numbers(some)
            long = np.flatnonzero(number < 0).tolist()
            cuts, pool = np.array(self.cuts), np.array(self.pool)
            for a, b in zip([-1, *long], [*long, len(some)], strict=True):
                own = number[a + 1 : b]
                parts.append(pool[_spread(cuts[own], cuts[own + 1] - cuts[own])])
                if b < len(some):
                    parts.append(np.array(next(self.encode_pieces([some[b].encode()])), np.uint32))
        return np.concatenate(parts)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """encode() of each text; the pieces of many short ones are looked up together."""
        out, held, count = [], [], []
        for text in texts:
            own = list(self.pieces(text)) if len(text) < STEP_BYTES else None
            if own is not None and max(map(len, own), default=0) <= LONG_PIECE:
                held.append(own)
                count.append(len(own))
                out.append(None)
            else:
                out.append(self.encode(text))
        if len(self.entry) > MEMO_PIECES:
            self.clear()
        number = self._numbers(list(chain.from_iterable(held)))
        cuts, pool = np.array(self.cuts), np.array(self.pool)
        size = cuts[number + 1] - cuts[number]
        ids = pool[_spread(cuts[number], size)] if len(pool) else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count, dtype=np.int64)] if held else []
        short = iter(np.split(ids, upto[:-1]) if held else [])
        return [next(short) if x is None else x for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        got = self.flat[_spread(self.start[ids], self.size[ids])].tobytes()
        return got.decode("utf-8", "replace").encode()


def coded(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, ids (array of int) and decoded (string) of each row's whole text.

    A null text is an empty one: no ids and ''. Broken UTF-8 reads as U+FFFD. Rows are taken by themselves, so repeated rows,
    null doc_ids and texts of any length give a row each; other columns are ignored; no rows give none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    first = ["doc_id", *keep]

    def derive(batch: pa.RecordBatch, ids: list[np.ndarray], texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.binary()).cast(pa.string())]

    return _each(docs, tokenizer, first, derive, ", ".join(f"{c} {kinds[c]}" for c in first) + ", ids array<int>, decoded string", ["ids", "decoded"])


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text; the ids leave no task. Edge cases as in coded()."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def derive(batch: pa.RecordBatch, ids: list[np.ndarray], texts: list[bytes]) -> list[pa.Array]:
        own = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(own), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _each(docs, tokenizer, ["doc_id"], derive, schema, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _each(docs: DataFrame, tokenizer: str, first: list[str], derive, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(tokenizer)
        for batch in slices(batches, "text", STEP_BYTES):
            ids = bpe.encode_all([(t or b"").decode("utf-8", "replace") for t in utf8(batch.column("text"))])
            got = derive(batch, ids, [bpe.decode(x) for x in ids])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *got], [*first, *names])

    return docs.select(*first, *(["text"] if "text" not in first else [])).mapInArrow(run, schema)


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' whole texts, encoded and decoded again; see coded() for nulls, broken UTF-8, long texts and repeated rows."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
