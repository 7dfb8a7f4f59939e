"""Token ids of whole texts in a public tokenizer (problem 7).

Tree concatenation: a text longer than a piece is halved until no part is longer, the parts are encoded in parallel as
rows of their own, and neighbours are joined level by level. At a join, a window around it is re-encoded and grown
until both sides agree exactly. What lies outside the window keeps its ids, for one of two reasons:

* The window begins and ends where the tokenizer's own pattern always cuts, whatever stands around: between two
  characters that no match can hold in this order (a letter and a blank, a letter and a digit, and so on). The ids
  before and after are then those of the whole text.
* Inside a long run of one class there is no such place. There the window holds tokens of the run only, and its first
  and last token must pair with their outer neighbours as the encoder itself would: in a byte-pair encoding a sequence
  of tokens is the encoding of its bytes exactly if each adjacent pair is the encoding of the pair's bytes.

A window that reaches an end of either text ends there. A text of one piece is a tree of one leaf.

Scale: leaves are rows, joins of ``fan`` neighbours are rows of the first shuffle, and only their results meet in the
task that makes the text's row, which has to hold all its ids in any case. Texts of one leaf are not shuffled.

Defined results: one row a document; null and empty texts give an empty list; repeated rows each give a row; extra
columns are not carried. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
#: fixed value: the pattern of byte_bpe_50k
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pairs of classes between which every match of the pattern ends: letters, numbers, other marks, blanks. After an
#: apostrophe a letter may belong to the same match, and after a blank any class.
_CUTS = frozenset({"ln", "lo", "l'", "lb", "nl", "no", "n'", "nb", "on", "ob", "ol", "'n", "'b"})


@lru_cache(maxsize=65_536)
def _class(c: str) -> str:
    """l(etter), n(umber), o(ther), ' or b(lank); "?" where versions of Unicode may differ, which is no place to cut."""
    if c == "'":
        return c
    if c in " \n\t\r":
        return "b"
    if c.isascii():
        return "l" if c.isalpha() else "n" if c.isdigit() else "o" if c.isprintable() else "?"
    kind, old = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    return {"L": "l", "N": "n", "P": "o", "S": "o"}.get(kind, "?") if kind == old else "?"


class Tokenizer:
    """A tiktoken vocabulary with a byte-level view of its merges."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.encoding = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._single = getattr(getattr(self.encoding, "_core_bpe", None), "encode_single_piece", None)  # not public: may be missing

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def piece(self, data: bytes) -> list[int]:
        """The byte-pair encoding of bytes, without the pattern."""
        if not data:
            return []
        return self._single(data) if self._single else self.merged(data)

    def merged(self, data: bytes) -> list[int]:
        """The same by merging the pair of least rank, the leftmost of equals, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pairs(self, a: int, b: int) -> bool:
        """Would the encoder leave these two tokens next to each other?"""
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _tail(self, ids: list[int], n: int) -> tuple[str, bool]:
        """The text of the last ``n`` tokens without what is left of a character cut at its start; is it all of it?"""
        data = b"".join(map(self.bytes_of.__getitem__, ids[max(0, len(ids) - n) :]))
        skip = 0
        while n < len(ids) and skip < len(data) and data[skip] & 0xC0 == 0x80:
            skip += 1
        return data[skip:].decode(), n >= len(ids)

    def _head(self, ids: list[int], n: int) -> tuple[str, bool]:
        data = b"".join(map(self.bytes_of.__getitem__, ids[:n]))
        return (data.decode(), True) if n >= len(ids) else (data.decode(errors="ignore"), False)

    def _tokens_of(self, ids: list[int], size: int, back: bool) -> int:
        """How many tokens at the end (or start) make ``size`` bytes; a cut of the pattern is between tokens."""
        count = 0
        for i in reversed(ids) if back else ids:
            if size <= 0:
                break
            size -= len(self.bytes_of[i])
            count += 1
        if size:
            raise AssertionError("a cut inside a token")
        return count

    def join(self, left: list[int], right: list[int], first: int = 8) -> list[int]:
        """Ids of the text that the texts of two encodings make together."""
        if not left or not right:
            return left + right
        width = first
        while True:
            before, all_before = self._tail(left, width)
            after, all_after = self._head(right, width)
            a = next((k for k in range(len(before) - 1, 0, -1) if _class(before[k - 1]) + _class(before[k]) in _CUTS), 0)
            z = next((k for k in range(1, len(after)) if _class(after[k - 1]) + _class(after[k]) in _CUTS), 0)
            if (a or all_before) and (z or all_after):
                z = z or len(after)
                window = self.encode(before[a:] + after[:z])
                keep = len(left) - self._tokens_of(left, len(before[a:].encode()), True)
                rest = self._tokens_of(right, len(after[:z].encode()), False)
                return left[:keep] + window + right[rest:]
            if not a and not z and not all_before and not all_after and (found := self._join_run(left, right, width, before, after)):
                return found
            width *= 2

    def _join_run(self, left: list[int], right: list[int], width: int, before: str, after: str) -> list[int] | None:
        """The join inside a run of one class that reaches beyond ``width`` tokens on both sides; None if there is none.

        The window stays clear of the outer quarter, where the run's match may begin otherwise than the run.
        """
        kind = _class(before[-1]) if before else "?"
        if kind not in "lnob" or len(before) < 16 or len(after) < 16 or any(_class(c) != kind for c in before) or any(_class(c) != kind for c in after):
            return None
        reach = width * 3 // 4
        near = 4
        while near <= reach:
            window = self.piece(b"".join(map(self.bytes_of.__getitem__, left[-near:] + right[:near])))
            if self.pairs(left[-near - 1], window[0]) and self.pairs(window[-1], right[near]):
                return left[:-near] + window + right[near:]
            near *= 2
        return None

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def halves(text: str, size: int) -> list[str]:
    """The text halved until no part is longer than ``size`` characters, wherever that falls."""
    parts = [text]
    while len(parts[0]) > size:
        parts = [x for p in parts for x in ((p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :]) if len(p) > 1 else (p,))]
    return parts


def vocabulary(folder: str = DEFAULT_FOLDER, name: str = DEFAULT_NAME) -> str:
    """Path of the vocabulary, which must be the same on every executor."""
    return str(Path(folder) / f"{name}.tiktoken")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, piece_chars: int = 2_048, fan: int = 64) -> DataFrame:
    """(key, ids array<int>), one row a row of ``df``. ``piece_chars``: longest leaf; ``fan``: leaves joined by one task of the first level."""
    path = path or vocabulary()
    if piece_chars < 1 or fan < 2:
        raise ValueError("piece_chars >= 1 and fan >= 2 must hold")
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    size = F.coalesce(F.length("text"), F.lit(0))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = tokenizer(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.encode(x) if x else [] for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [halves(x, piece_chars) for x in b.column(2).to_pylist()]
            of = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int32())
            seq, n = ([x for p in parts for x in f(p)] for f in (lambda p: range(len(p)), lambda p: [len(p)] * len(p)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array([x for p in parts for x in p], pa.string())], ["k", "copy", "seq", "n", "piece"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes leaves and joins runs of them; ``n`` tells how many leaves a text has, ``seq`` which of them a row is."""
        parts: list[list[int]] = []
        for b in batches:
            t = tokenizer(path)
            out: list[tuple[int, int, int, list[int]]] = []
            seq, n, pieces = (b.column(k).to_pylist() for k in (2, 3, 4))
            for i in range(b.num_rows):
                parts.append(t.encode(pieces[i]))
                if seq[i] % fan == fan - 1 or seq[i] == n[i] - 1:
                    out.append((i, seq[i] // fan, -(-n[i] // fan), t.tree(parts)))
                    parts = []
            if out:
                at, s, m, x = zip(*out, strict=True)
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["k", "copy", "seq", "n", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins all rows of a text."""
        parts: list[list[int]] = []
        for b in batches:
            out: list[tuple[int, list[int]]] = []
            for i, (n, x) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                parts.append(x)
                if len(parts) == n:
                    out.append((i, tokenizer(path).tree(parts) if n > 1 else x))
                    parts = []
            if out:
                at, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(x, pa.list_(pa.int32()))], ["k", "ids"])

    single = rows.filter(size <= piece_chars).mapInArrow(leaf, f"k {kind}, ids array<int>")
    # a row's copies of one key are kept apart by a number of their own
    longer = rows.filter(size > piece_chars).select("k", F.monotonically_increasing_id().alias("copy"), "text")
    row = f"k {kind}, copy bigint, seq int, n int"
    leaves = longer.mapInArrow(cut, f"{row}, piece string").withColumn("group", F.floor(F.col("seq") / fan))
    spread = leaves.repartition(F.xxhash64("copy", "group")).sortWithinPartitions("copy", "seq").drop("group")
    first = spread.mapInArrow(joined, f"{row}, ids array<int>")
    several = laid_out(first, ["copy"], "seq").mapInArrow(whole, f"k {kind}, ids array<int>")
    return single.unionByName(several).withColumnRenamed("k", key)
