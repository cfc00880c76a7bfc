"""SentencePiece codec against the library itself, and the ring against its law."""

import zlib
from collections import Counter

import pytest

from icefathom.llm import sentencepiece_codec as codec
from icefathom.llm import sharding
from icefathom.llm.queries import PIECE_MODEL

ODD = [None, "", " ", "  a  b ", "▁a", "日本語 \t\n\r x", "a" * 20_000, "<s> <0x0A> </s><unk>", "\x00\x01é", "aaa aaaa   ", "😀 é"]


@pytest.fixture(scope="module")
def model():
    return codec.read_model(PIECE_MODEL)


def test_ids_equal_the_library_and_texts_come_back(spark, docs, samples, model):
    rows = samples + list(enumerate(ODD, 10_000))
    coded = codec.encode(docs(rows), model)
    checked = codec.parity(codec.decode(coded, model), model).select("doc_id", "text", "ids", "decoded", "same").collect()
    assert len(checked) == len(rows)
    for r in checked:
        if r["text"] is None:
            assert (r["ids"], r["decoded"], r["same"]) == (None, None, None)
        else:
            assert r["same"]
            assert r["decoded"] == r["text"].replace("▁", " ")
    assert [r["ids"] for r in checked if r["text"] == ""] == [[]]


def test_round_trip_reports_changed_texts(docs, model):
    out = {r["doc_id"]: r for r in codec.round_trip(docs([(1, "x y"), (2, "▁x"), (3, None), (4, ""), (4, "")]), model).collect()}
    assert [out[k]["exact"] for k in (1, 2, 3, 4)] == [True, False, None, True]


def test_words_apart_give_the_ids_of_whole_texts(docs, samples, model, monkeypatch):
    """Also where the table of known words overflows, and where words end in markers."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t for _, t in samples] + ODD + ["a▁ b", "a ▁", "▁▁ ▁", " x", "x  ", "é" * 300 + " " + "漢" * 300, "a " * 3000]
    for kept in (codec.KEPT_WORDS, 50):
        monkeypatch.setattr(codec, "KEPT_WORDS", kept)
        made = codec.codec_of.__wrapped__(model, 2, True)
        for i in range(0, len(texts), 40):
            part = texts[i : i + 40]
            ids = made.encode(part)
            assert ids.to_pylist() == [None if t is None else own.encode(t) for t in part]
            assert made.same(part, ids) == [None if t is None else True for t in part]
        assert len(made.known) < len(set(" ".join(t or "" for t in texts).split(" "))) or kept > 50


def test_words_unlike_the_library_are_told(docs, model):
    made = codec.codec_of.__wrapped__(model, 2, True)

    class Other:
        def encode(self, texts, num_threads):
            return [[1] for _ in texts]

        def piece_to_id(self, piece):
            return -1

    made.own = Other()
    texts = ["one two", None, ""]
    assert made.same(texts, made.encode(texts)) == [False, None, True]


def test_registered_codec_query_has_parity_for_every_document(spark):
    from icefathom.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op1_sentencepiece"](spark, sf_dir).select("doc_id", "parity", "exact").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["parity"] == (None if text is None else True)
        assert r["exact"] == (None if text is None else "▁" not in text)


def test_unigram_models_have_the_library_ids():
    import io

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = True
    proto.normalizer_spec.escape_whitespaces = True
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [("▁", -3, 1), ("▁the", -1, 1), ("the", -2, 1), ("▁ca", -2.5, 1), ("t", -3, 1), ("s", -3, 1), ("cat", -2, 1), ("a", -4, 1), ("c", -4, 1)]
    for piece, score, kind in pieces:
        proto.pieces.add(piece=piece, score=score, type=kind)
    raw = proto.SerializeToString()
    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    made = codec.codec_of(raw)
    for text in ("the cats", "  the   cat ", "thé cat", "sat at the"):
        assert made.encode([text]).to_pylist()[0] == own.encode(text)
    assert io is not None


def test_clashing_and_empty(docs, model):
    assert codec.encode(docs([]), model).count() == 0
    assert codec.encode(docs([(1, "a")]).withColumnRenamed("source", "IDs"), model).columns == ["doc_id", "text", "lang", "n_chars", "ids"]
    assert codec.encode(docs([(1, "a")]).withColumnRenamed("source", "extra"), model).columns[-2:] == ["n_chars", "ids"]


def placed(df, **options):
    return sharding.assign(df, options.pop("shards", 8), **options).collect()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_counts_at_most_one_apart_and_slots_gapless(docs, n):
    rows = placed(docs([(i * 17, f"t{i}") for i in range(n)]))
    assert sorted(r["doc_id"] for r in rows) == sorted(i * 17 for i in range(n))
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def brute(keys, shards, virtual, cells, spark):
    """The ring, key by key: clockwise from its cell to the first shard with room, in rounds."""
    orders = sharding.ring_points(spark, shards, virtual, cells)
    room = sharding.capacities(len(keys), shards, 0.0)
    waiting, out = sorted(keys, key=lambda k: (k[1] % cells, k[1], k[0])), {}
    while waiting:
        free = {s for s in range(shards) if room[s]}
        later = []
        for key, place in waiting:
            shard = next(s for s in orders[place % cells] if s in free)
            if room[shard]:
                room[shard] -= 1
                out[key] = shard
            else:
                later.append((key, place))
        waiting = later
    return out


def test_ring_equals_brute_force_also_in_many_buckets(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    df = docs([(i, f"t{i % 5}") for i in range(600)])
    keys = [(r[0], r[1]) for r in df.select("doc_id", sharding.ring_hash(F.col("doc_id"))).collect()]
    got = {r["doc_id"]: r["shard"] for r in placed(df, shards=5, virtual=16, cells=64)}
    assert got == brute(keys, 5, 16, 64, spark)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = placed(df, shards=5, virtual=16, cells=4)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == 600


def test_repeated_rows_are_ranked_once_and_made_again(docs, monkeypatch):
    """A third of the rows is one row: in pieces and whole, in one bucket and in many."""
    rows = [(7, "same")] * 200 + [(i, f"t{i}") for i in range(400)]
    whole = Counter((r["doc_id"], r["shard"]) for r in placed(docs(rows), shards=3))
    for piece, bucket in ((7, 200_000), (1, 50), (100_000, 50)):
        monkeypatch.setattr(sharding, "PIECE_ROWS", piece)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
        got = placed(docs(rows), shards=3)
        assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
        for s in range(3):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(200))
        if bucket == 200_000:
            assert Counter((r["doc_id"], r["shard"]) for r in got) == whole


def test_registered_sharding_query_keeps_its_contract(spark):
    from icefathom.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        want[r["doc_id"], len(data) + 1, zlib.crc32(data)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_few_keys_move_when_a_shard_joins(docs):
    df = docs([(i, "x") for i in range(4000)])
    old = {r["doc_id"]: r["shard"] for r in placed(df, shards=8, slack=0.25)}
    new = {r["doc_id"]: r["shard"] for r in placed(df, shards=9, slack=0.25)}
    moved = sum(old[k] != new[k] for k in old)
    assert moved < 0.25 * len(old)  # the newcomer's ninth, and what overflows differently
    assert sum(new[k] == 8 for k in new) > 0.05 * len(old)


def test_null_and_repeated_keys(docs):
    rows = placed(docs([(None, "a"), (None, None), (3, "x"), (3, "x"), (3, "x")]), shards=2)
    assert Counter(r["shard"] for r in rows) in (Counter({0: 3, 1: 2}), Counter({1: 3, 0: 2}))
    clash = sharding.assign(docs([(1, "a")]).withColumnsRenamed({"source": "Slot", "lang": "_cell"}), 2)
    assert clash.columns == ["doc_id", "text", "_cell", "n_chars", "shard", "slot"]
    assert clash.first()["_cell"] == "en" and clash.first()["slot"] == 0


def test_a_worker_forgets_the_words_of_an_ended_task(model):
    made = codec.codec_of.__wrapped__(model, 2, True)
    before = made.encode(["one two", "three"]).to_pylist()
    assert made.known
    made.forget()
    assert not made.known and not made.unlike
    assert made.encode(["one two", "three"]).to_pylist() == before
