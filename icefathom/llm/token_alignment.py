"""Alignment of two tokenizers over a corpus: which ids of one cover which ids of the other.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned
once; its copies count by their number. Token bytes give offsets: where tokens of A and of B
both end, a group ends, and each stretch between two neighbouring ends of either lies in
one token of A and one of B, which is one link.

The number of documents that hold an id pair comes from the distinct pairs of bounded slices
of texts: one row for each pair of a slice is summed over the corpus, and the sums go back to
the slices, which hold their links as differences of sorted pair numbers. So no row is
made for a link, and what is shuffled follows the distinct pairs of a slice. Measures
then join the documents by the digest of their text.

Bounds: tokenizer files travel in the task closure and are refused above ``FILE_BYTES``; a
slice is ``SLICE_TEXT`` bytes of whole texts (a longer text is a slice of its own); the
pairs of one A id are bounded by the vocabulary of B.

Tokenizer A is a ``tokenizers`` file of byte-level BPE without special tokens. Where its
vocabulary ids are the ranks of its merges, the same merges are made by ``tiktoken``, several
times faster; texts with very long runs of white space, which its pattern engine does not
take, and other files go through the ``tokenizers`` library. B is a SentencePiece model.

Defined cases: null and empty texts, and texts whose tokens do not join to the space and the
text (here: those that hold U+2581), have no tokens; their measures are 0 and their digest is
''. Documents of equal ids are rows of their own and count one each. Any length of text is
taken whole. An empty table gives an empty one. Other columns stay; one called like
an output is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icefathom.llm.batches import slices
from icefathom.llm.columns import shield

FILE_BYTES = 64 << 20
#: UTF-8 bytes of text whose links travel in one row.
SLICE_TEXT = 16 << 20
#: White space beyond this length is left to the ``tokenizers`` library.
LONG_BLANK = 4096
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
# The splitting rule of byte-level BPE files that name none, a fixed value.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_file(path: str) -> bytes:
    """A tokenizer file's bytes, for ``align``."""
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=1)
def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for the
    letters from U+0100 on.
    """
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Bytes of every token id, end to end, and its decimal digits with each separator."""

    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    told: np.ndarray  # row 3 * id + s: the id's digits, then ",", "|" or ";"; 0 fills up
    told_length: np.ndarray

    @classmethod
    def of(cls, tokens: dict[int, bytes]) -> Vocabulary:
        size = max(tokens, default=0) + 1
        table = [tokens.get(i, b"") for i in range(size)]
        length = np.array([len(t) for t in table], np.int64)
        rows = [f"{i}{s}".encode() for i in range(size) for s in ",|;"]
        width = max(len(r) for r in rows)
        told = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        flat = np.frombuffer(b"".join(table) or b"\0", np.uint8)
        return cls(flat, np.cumsum(length) - length, length, told, np.array([len(r) for r in rows], np.int64))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after the other."""
        length = self.length[ids]
        total = np.cumsum(length)
        at = np.repeat(self.start[ids] - (total - length), length)
        return self.flat[at + np.arange(len(at))]


class ByteBpe:
    """Ids of a byte-level BPE file, without special tokens."""

    def __init__(self, file: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode("utf-8"))
        self.library.encode_special_tokens = True
        spec = json.loads(file)
        letters = byte_of_letter()
        vocab = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if all(c in letters for c in piece)}
        self.vocabulary = Vocabulary.of({i: b for b, i in vocab.items()})
        self.fast = None
        if self._ranked(spec, vocab):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=vocab, special_tokens={})

    @staticmethod
    def _ranked(spec: dict, vocab: dict[bytes, int]) -> bool:
        """The file is plain byte-level BPE whose ids follow the order of its merges."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        if not (plain and usual) or len(vocab) != len(model["vocab"]):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get("".join(p), -1) for p in pairs]
        singles = {i for b, i in vocab.items() if len(b) == 1}
        return len(singles) == 256 and made == sorted(set(made)) and set(made) | singles == set(vocab.values())

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        cut = self.fast.encode_ordinary
        return [self.library.encode(t, add_special_tokens=False).ids if len(t) >= LONG_BLANK and _LONG_BLANK.search(t) else cut(t) for t in texts]


class Pieces:
    """Ids of a SentencePiece model, which puts a space before the text itself."""

    def __init__(self, file: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        tokens = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")
        self.vocabulary = Vocabulary.of(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def coders(file_a: bytes, file_b: bytes) -> tuple[ByteBpe, Pieces]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(file_a), Pieces(file_b)


@dataclass
class Aligned:
    """Alignment of some texts: numbers by text, and their links as distinct (text, pair) with occurrences."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[bytes]
    pairs: np.ndarray  # distinct pairs, A id << 32 | B id
    text: np.ndarray
    pair: np.ndarray  # index into pairs
    times: np.ndarray


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _fitting(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Which texts' tokens join to the bytes wanted."""
    owner = np.repeat(np.arange(len(want)), counts)
    size = np.bincount(owner, vocabulary.length[ids], len(want)).astype(np.int64)
    fits = size == np.fromiter(map(len, want), np.int64, len(want))
    same = np.flatnonzero(fits)
    if len(same):
        have = vocabulary.joined(ids[fits[owner]])
        differs = np.flatnonzero(have != np.frombuffer(b"".join(want[i] for i in same), np.uint8))
        fits[same[np.searchsorted(np.cumsum(size[same]), differs, "right")]] = False
    return fits


def align_texts(texts: list[str], a: ByteBpe, b: Pieces) -> Aligned:
    """Aligns both tokenizers' tokens in each text."""
    n, want = len(texts), [b" " + t.encode("utf-8") if t else b"" for t in texts]
    ids_a, n_a = _flat(a.encode([" " + t if t else "" for t in texts]))
    ids_b, n_b = _flat(b.encode(texts))
    fits = _fitting(a.vocabulary, ids_a, n_a, want) & _fitting(b.vocabulary, ids_b, n_b, want)
    ids_a, ids_b = ids_a[np.repeat(fits, n_a)], ids_b[np.repeat(fits, n_b)]
    n_a, n_b = n_a * fits, n_b * fits
    bounds = np.cumsum(np.where(fits, np.fromiter(map(len, want), np.int64, n), 0))
    size = int(bounds[-1]) if n else 0
    at_a, at_b = np.cumsum(a.vocabulary.length[ids_a]) - 1, np.cumsum(b.vocabulary.length[ids_b]) - 1
    ends_a, ends_b = np.zeros(size, np.int64), np.zeros(size, np.int64)
    ends_a[at_a], ends_b[at_b] = 1, 1
    both = ends_a & ends_b
    # Links: every stretch up to an end of either lies in one token of each.
    stops = np.flatnonzero(ends_a | ends_b)
    before_a, before_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    keys = ids_a[before_a[stops]] << 32 | ids_b[before_b[stops]]
    link_text = np.searchsorted(bounds, stops, "right")
    group = np.cumsum(both) - both
    n_groups = np.bincount(np.searchsorted(bounds, np.flatnonzero(both), "right"), minlength=n)
    sha = _told_groups(a.vocabulary, b.vocabulary, ids_a, ids_b, group[at_a], group[at_b], n_a, n_b, int(both.sum()))
    pairs, code = np.unique(keys, return_inverse=True)
    held, times = np.unique(link_text * max(len(pairs), 1) + code, return_counts=True)
    text, pair = np.divmod(held, max(len(pairs), 1))
    return Aligned(n_a, n_b, n_groups, np.bincount(link_text, minlength=n), sha, pairs, text, pair, times)


def _told_groups(a, b, ids_a, ids_b, group_a, group_b, n_a, n_b, n_groups: int) -> list[bytes]:
    """SHA-256 of each text's groups as text; empty for a text without tokens."""
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    row_a, row_b = 3 * ids_a + last_a, 3 * ids_b + 2 * last_b
    width = max(a.told.shape[1], b.told.shape[1])
    digits = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    digits[place_a, : a.told.shape[1]] = a.told[row_a]
    digits[place_b, : b.told.shape[1]] = b.told[row_b]
    line = digits.ravel()
    line = line[line != 0].tobytes()
    length = np.empty(len(digits), np.int64)
    length[place_a], length[place_b] = a.told_length[row_a], b.told_length[row_b]
    ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
    view = memoryview(line)
    # The last separator of a text is left out.
    return [hashlib.sha256(view[i : j - 1]).digest() if j > i else b"" for i, j in zip(ends[:-1], ends[1:])]


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


class Slice:
    """Aligned texts that travel as one row."""

    schema = "n int, digests binary, counts binary, sha binary, pairs binary, docs binary, links_n binary, links binary, times binary"

    def __init__(self) -> None:
        self.bytes, self.parts = 0, []

    def add(self, aligned: Aligned, digests: list[bytes], mult: np.ndarray, size: int) -> None:
        self.parts.append((aligned, digests, mult))
        self.bytes += size

    def row(self) -> dict:
        pairs = np.unique(np.concatenate([p.pairs for p, _, _ in self.parts]))
        docs, links_n, links, times = np.zeros(len(pairs), np.int64), [], [], []
        for part, _, mult in self.parts:
            at = np.searchsorted(pairs, part.pairs)[part.pair]
            np.add.at(docs, at, mult[part.text])
            n = np.bincount(part.text, minlength=len(mult))
            first = np.cumsum(n) - n
            step = np.diff(at, prepend=0)
            # Each text's first pair number stands whole, the others as differences.
            step[first[n > 0]] = at[first[n > 0]]
            links_n.append(n)
            links.append(step)
            times.append(part.times)
        counts = np.concatenate([np.stack([p.n_a, p.n_b, p.n_groups, p.n_links]) for p, _, _ in self.parts], axis=1)
        return {
            "n": counts.shape[1], "digests": b"".join(chain.from_iterable(d for _, d, _ in self.parts)), "counts": _packed(counts.astype(np.int64)),
            "sha": b"".join(x or bytes(32) for p, _, _ in self.parts for x in p.sha), "pairs": _packed(np.diff(pairs, prepend=0)), "docs": _packed(docs),
            "links_n": _packed(np.concatenate(links_n).astype(np.int32)), "links": _packed(np.concatenate(links).astype(np.int32)),
            "times": _packed(np.concatenate(times).astype(np.int32)),
        }


def _measured(slice_row: dict, at: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pa.Table:
    """Measures of a slice's texts, given each pair's documents and whether it is its A id's best."""
    n = slice_row["n"]
    counts = _unpacked(slice_row["counts"], np.int64).reshape(4, n)
    links_n, step = _unpacked(slice_row["links_n"], np.int32), _unpacked(slice_row["links"], np.int32).astype(np.int64)
    times = _unpacked(slice_row["times"], np.int32).astype(np.int64)
    whole = np.cumsum(step)
    ends = np.cumsum(links_n)
    base = np.where(ends > links_n, whole[np.maximum(ends - links_n - 1, 0)], 0) if len(step) else np.zeros(n, np.int64)
    pair, text = whole - np.repeat(base, links_n), np.repeat(np.arange(n), links_n)
    of_docs, of_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    of_docs[at], of_best[at] = docs, best
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    np.add.at(sums[0], text, times * of_best[pair])
    np.add.at(sums[1], text, times * of_docs[pair])
    sha, digests = slice_row["sha"], slice_row["digests"]
    told = [sha[32 * i : 32 * i + 32].hex() if counts[0][i] else "" for i in range(n)]
    keys = pa.array([digests[32 * i : 32 * i + 32] for i in range(n)], pa.binary())
    return pa.table([keys, *[pa.array(c) for c in (*counts, *sums)], pa.array(told, pa.string())], names=["_digest", *MEASURES])


def _sliced(file_a: bytes, file_b: bytes, limit: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coders(file_a, file_b)
        open_slice = Slice()

        def told(done: Slice) -> pa.RecordBatch:
            row = done.row()
            kinds = {"n": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

        for batch in rows:
            texts = batch.column(batch.schema.get_field_index("text"))
            for part in slices(texts):
                cut = batch.slice(part.first, len(part))
                aligned = align_texts(texts.slice(part.first, len(part)).to_pylist(), a, b)
                mult = cut.column(cut.schema.get_field_index("mult")).to_numpy(zero_copy_only=False)
                open_slice.add(aligned, cut.column(cut.schema.get_field_index("digest")).to_pylist(), mult, len(part.data))
                if open_slice.bytes >= limit:
                    yield told(open_slice)
                    open_slice = Slice()
        if open_slice.parts:
            yield told(open_slice)

    return batches


def _requests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of each slice: its place in the slice, and the documents there that hold it."""
    for batch in rows:
        for row in batch.to_pylist():
            pairs, docs = np.cumsum(_unpacked(row["pairs"], np.int64)), _unpacked(row["docs"], np.int64)
            n = len(pairs)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["slice"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(pairs), pa.array(docs)], ["slice", "at", "pair", "docs"]
                )


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice with the counts of its pairs."""
    at, value = right.column("at").to_numpy(), right.column("value").to_numpy()
    made = [_measured(row, at, value >> 1, value & 1) for row in left.to_pylist()]
    return pa.concat_tables(made) if made else pa.table({"_digest": pa.array([], pa.binary())} | {m: pa.array([], pa.string() if m == "groups_sha256" else pa.int64()) for m in MEASURES})


def align(docs: DataFrame, file_a: bytes, file_b: bytes, text: str = "text", slice_text: int = SLICE_TEXT) -> DataFrame:
    """Adds the alignment's ``MEASURES`` to every document."""
    docs, restore = shield(docs, (text,), MEASURES)
    has = F.coalesce(F.col(text) != "", F.lit(False))
    distinct = docs.filter(has).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("mult"))
    told = distinct.select("text", "mult", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    sliced = told.mapInArrow(_sliced(file_a, file_b, slice_text), Slice.schema).withColumn("slice", F.monotonically_increasing_id()).checkpoint()
    asked = sliced.select("slice", "pairs", "docs").mapInArrow(_requests, "slice long, at int, pair long, docs long")
    sums = pair_counts(asked)
    value = (F.col("total") * 2 + F.col("best").cast("long")).alias("value")
    answers = asked.drop("docs").join(sums, "pair").select("slice", "at", value)
    whole = "_digest binary, " + ", ".join(f"{m} {'string' if m == 'groups_sha256' else 'long'}" for m in MEASURES)
    measured = sliced.drop("pairs", "docs").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_answer, whole)
    tokens = docs.filter(has).withColumn("_digest", F.unhex(F.sha2(F.col(text).cast("binary"), 256))).join(measured, "_digest").drop("_digest")
    nothing = [(F.lit("") if m == "groups_sha256" else F.lit(0).cast("long")).alias(m) for m in MEASURES]
    return restore(tokens.unionByName(docs.filter(~has).select("*", *nothing)))


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, total, best): documents that hold each id pair, and whether no pair of its A id has more."""
    sums = asked.groupBy("pair").agg(F.sum("docs").alias("total"))
    # The pairs of one A id are bounded by the vocabulary of B.
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return sums.withColumn("best", F.col("total") == F.max("total").over(of_a))
