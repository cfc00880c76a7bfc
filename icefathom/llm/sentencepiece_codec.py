"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file (a protobuf) is read on the driver, its size checked, and its bytes
travel in the task closure; no executor opens a local file. Each Python worker
rebuilds the tokenizer once: the normaliser (character map, blank folding, dummy
prefix), the metaspace marker, the vocabulary with its scores (unigram) or the merges
they imply (BPE), and byte fallback.

Where no piece crosses the start of a run of blanks, the words of a slice are told apart
first, each distinct one is encoded once by the library (in one multithreaded batch) and
kept in a bounded table, and a text's ids are those of its words end to end.

Defined cases: a null text has no ids (null) and decodes to null; an empty text has an
empty list. A text of any length is encoded whole. Repeated rows give repeated rows.
The input's other columns stay; one called like an output (``ids``, ``decoded``,
``exact``, ``same``) is replaced by it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from icefathom.llm.batches import slices
from icefathom.llm.columns import shield

MARK = "▁"
#: A model file larger than this is refused: it would travel with every stage.
MODEL_BYTES = 64 << 20
#: A worker keeps the ids of so many distinct words, and of none that is longer.
KEPT_WORDS = 1 << 18
KEPT_CHARS = 64
#: Distinct words that the library is given as one text.
CHUNK_WORDS = 1024
#: Threads of the library's batch encoder where Spark gives a task fewer cores.
LEAST_THREADS = 2
#: Runs of markers with what follows, the only places where a text is cut into words.
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
# Piece types and model types of the protobuf, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def read_model(path: str) -> bytes:
    """The model file's bytes, for ``encode`` and ``decode``."""
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


def implied_merges(pieces: dict[str, tuple[int, float]]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score of the result first."""
    found = []
    for whole, (at, score) in pieces.items():
        for cut in range(1, len(whole)):
            left, right = whole[:cut], whole[cut:]
            if left in pieces and right in pieces:
                found.append((-score, at, pieces[left][0], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


@dataclass
class Codec:
    """A tokenizer and, where it is simple, the normaliser as string operations.

    The library's own normalisers track every character's origin, which ids don't need;
    a dummy prefix and the marker for blanks are plain string work.
    """

    tokenizer: object
    prefix: str | None
    escape: bool
    #: Bytes of each piece where ids decode piece by piece, else none.
    pieces: np.ndarray | None = None
    #: Words may be encoded apart.
    apart: bool = False
    #: The SentencePiece library on the same model, where words are held against it.
    own: object = None
    #: Which pieces begin with a marker.
    opens: np.ndarray | None = None
    known: dict[str, bytes] = field(default_factory=dict)
    unlike: set[str] = field(default_factory=set)

    def prepared(self, text: str) -> str:
        if self.prefix is None:
            return text
        return self.prefix + (text.replace(" ", MARK) if self.escape else text) if text else text

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        """The text's words without the first marker of each."""
        found = text.split(" ")
        if MARK in text or "" in found[:-1]:
            return [w[1:] for w in _RUNS.findall(self.prepared(text))]
        return found

    def _ids(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of distinct words: many words in a text, cut again where a piece opens one."""
        plain = [w for w in fresh if w and MARK not in w]
        chunks = [plain[i : i + CHUNK_WORDS] for i in range(0, len(plain), CHUNK_WORDS)]
        ids, single = {}, [w for w in fresh if not w or MARK in w]
        lists = self._library([MARK + MARK.join(chunk) for chunk in chunks])
        want = lists if self.own is None else self.own.encode([" ".join(chunk) for chunk in chunks], num_threads=1)
        for chunk, found, other in zip(chunks, lists, want):
            flat = np.array(found, np.int32)
            opens = np.flatnonzero(self.opens[flat])
            if len(opens) == len(chunk) and found == other:
                raw, cuts = flat.tobytes(), [*(opens * 4).tolist(), None]
                ids.update((w, raw[x:y]) for w, x, y in zip(chunk, cuts, cuts[1:]))
            else:
                single += chunk
        lists = self._library([MARK + w for w in single])
        if self.own is not None:
            want = self.own.encode(single, num_threads=1)
            self.unlike.update(w for w, x, y in zip(single, lists, want) if x != (y if w else [self.own.piece_to_id(MARK)]))
        ids.update((w, array("i", x).tobytes()) for w, x in zip(single, lists))
        return ids

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) if t else [] for t in texts]
        fresh = [w for w in set(chain.from_iterable(split)) if w not in self.known]
        ids = self._ids(fresh)
        if len(self.known) + len(ids) > KEPT_WORDS:
            needed = set(chain.from_iterable(split))
            self.known = {w: x for w, x in self.known.items() if w in needed}
        self.known.update(ids)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in ids:
            if len(w) > KEPT_CHARS:
                del self.known[w]
        return out

    def forget(self) -> None:
        """Drops the words of a task that has ended: its worker may stay, idle or with other work."""
        self.known, self.unlike = {}, set()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """One list of ids for each text; null for null, empty for empty."""
        plain = [t or "" for t in texts]
        if self.apart:
            made = self._by_words(plain)
        else:
            made = [array("i", x).tobytes() for x in self._library([self.prepared(t) for t in plain])]
        made = [x if t else b"" for t, x in zip(plain, made)]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in made], dtype=np.int64))).astype(np.int32)
        empty = pa.array([t is None for t in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)), mask=empty)

    def decode(self, lists: list[list[int] | None]) -> list[str | None]:
        made = self.tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
        return [None if x is None else t for x, t in zip(lists, made)]

    def same(self, texts: list[str | None], ids: pa.ListArray) -> list[bool | None]:
        """Whether SentencePiece gives the same ids: for every word, or, where words are not apart, for the text."""
        if not self.apart:
            return _same(self.own, texts, ids.to_pylist())
        return [None if t is None else not t or not self.unlike or self.unlike.isdisjoint(self._words(t)) for t in texts]

    def exact(self, texts: list[str | None], ids: pa.ListArray) -> list[bool | None]:
        """Whether the ids of each text decode to it.

        The bytes of the pieces are compared first; a text they do not give is decoded by the library.
        """
        same = [None if t is None else t == "" for t in texts]
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        for i, text in enumerate(texts):
            if text:
                own = flat[ends[i] : ends[i + 1]]
                told = self.pieces is not None and b"".join(self.pieces[own].tolist()) == b" " + text.encode("utf-8")
                same[i] = told or self.decode([own.tolist()])[0] == text
        return same


@lru_cache(maxsize=4)
def codec_of(model: bytes, threads: int = 1, compare: bool = False) -> Codec:
    """Codec equal to the SentencePiece model in ``model``.

    The library has one pool of threads a process: the first codec that a worker makes sets it.
    """
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
    from sentencepiece import sentencepiece_model_pb2 as schema
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = schema.ModelProto()
    proto.ParseFromString(model)
    spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    fallback = proto.trainer_spec.byte_fallback
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    if kind == UNIGRAM:
        # Pieces that text must never become get a score no path can afford.
        low = min(p.score for p in proto.pieces) - 1e6
        scores = [(p.piece, p.score if p.type in (NORMAL, USER_DEFINED, UNKNOWN) else low) for p in proto.pieces]
        tokenizer = Tokenizer(models.Unigram(scores, unknown, fallback))
    elif kind == BPE:
        usable = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        tokenizer = Tokenizer(
            models.BPE(
                vocab={p.piece: i for i, p in enumerate(proto.pieces)},
                merges=implied_merges(usable),
                unk_token=proto.pieces[unknown].piece,
                fuse_unk=True,
                byte_fallback=fallback,
            )
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    simple = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
    if not simple:
        tokenizer.normalizer = normalizers.Sequence(steps)
    cut = not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (NORMAL, USER_DEFINED))
    if cut:
        # No piece has a marker after other characters, so no piece crosses the
        # start of a run of markers: cutting there changes nothing and feeds the cache.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    tail = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if fallback else []) + [decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(tail + ([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []))
    prefix = (MARK if spec.escape_whitespaces else " ") if spec.add_dummy_prefix else ""
    marked = simple and spec.add_dummy_prefix and spec.escape_whitespaces
    pieces = np.empty(len(proto.pieces), object)
    for i, p in enumerate(proto.pieces):
        pieces[i] = bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode("utf-8")
    return Codec(
        tokenizer,
        prefix if simple else None,
        spec.escape_whitespaces,
        pieces=pieces if marked and fallback else None,
        apart=cut and marked,
        own=_own_library(model) if compare else None,
        opens=np.array([p.piece.startswith(MARK) for p in proto.pieces]),
    )


def task_threads(df: DataFrame) -> int:
    """Threads of a task's batch encoder: the cores Spark gives it, ``LEAST_THREADS`` at least."""
    return max(LEAST_THREADS, int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def encode(docs: DataFrame, model: bytes, text: str = "text", threads: int | None = None) -> DataFrame:
    """Adds ``ids``: the token ids of the whole text."""
    threads = threads or task_threads(docs)
    docs, restore = shield(docs, (text,), ("ids",))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, threads)
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            for part in slices(column):
                ids = codec.encode(column.slice(part.first, len(part)).to_pylist())
                cut = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*cut.columns, ids], [*cut.schema.names, "ids"])
        codec.forget()

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return restore(docs.mapInArrow(batches, schema))


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", threads: int | None = None) -> DataFrame:
    """Adds ``decoded``: the text that the ids stand for."""
    threads = threads or task_threads(tokens)
    tokens, restore = shield(tokens, (ids,), ("decoded",))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, threads)
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                lists = cut.column(cut.schema.get_field_index(ids)).to_pylist()
                back = pa.array(codec.decode(lists), pa.string())
                yield pa.RecordBatch.from_arrays([*cut.columns, back], [*cut.schema.names, "decoded"])

    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])
    return restore(tokens.mapInArrow(batches, schema))


def round_trip(docs: DataFrame, model: bytes, text: str = "text", threads: int | None = None, compare: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: ``ids`` and ``exact`` take the place of the text.

    ``exact`` says whether the text came back. A text that the normaliser changes
    (here: one that holds the marker itself) comes back changed and is not exact. With
    ``compare`` a column ``same`` says whether the SentencePiece library gives the same ids: it
    encodes each distinct word as well (``parity`` has it encode whole texts).
    """
    threads = threads or task_threads(docs)
    docs, restore = shield(docs, (text,), ("ids", "exact", "same") if compare else ("ids", "exact"))
    rest = [f for f in docs.schema.fields if f.name != text]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    if compare:
        added.append(T.StructField("same", T.BooleanType()))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, threads, compare)
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            for part in slices(column):
                chunk = column.slice(part.first, len(part)).to_pylist()
                ids = codec.encode(chunk)
                kept = [batch.column(batch.schema.get_field_index(f.name)).slice(part.first, len(part)) for f in rest]
                new = [ids, pa.array(codec.exact(chunk, ids), pa.bool_())]
                if compare:
                    new.append(pa.array(codec.same(chunk, ids), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept + new, [f.name for f in rest + added])
        codec.forget()

    return restore(docs.mapInArrow(batches, T.StructType(rest + added)))


@lru_cache(maxsize=4)
def _own_library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _same(own, texts: list[str | None], lists: list[list[int] | None]) -> list[bool | None]:
    want = own.encode([t or "" for t in texts], num_threads=1)
    return [None if t is None else (w if t else []) == g for t, w, g in zip(texts, want, lists)]


def parity(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``same``: the ids equal those of the SentencePiece library itself."""
    docs, restore = shield(docs, (text, ids), ("same",))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own_library(model)
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                texts = cut.column(cut.schema.get_field_index(text)).to_pylist()
                lists = cut.column(cut.schema.get_field_index(ids)).to_pylist()
                same = pa.array(_same(own, texts, lists), pa.bool_())
                yield pa.RecordBatch.from_arrays([*cut.columns, same], [*cut.schema.names, "same"])

    return restore(docs.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField("same", T.BooleanType())])))
