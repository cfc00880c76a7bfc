"""Mixing, conversation trie and token alignment against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm import mixing, prefix_trie, queries, token_alignment

BLANKS = " \t\n\v\f\r"


def n_words(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return sum(1 for w in text.split(" ") if w)


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and most * sizes[s] * share < weight[s] * left}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else float(weight[s] * left) / share if share else 0.0 for s in names}
        capped |= over


MIXED = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("source", T.StringType()), ("text", T.StringType()), ("Size", T.StringType()))])


def mix_rows(seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    for source, n, longest in (("b", 400, 60), ("a", 3, 4), ("é", 40, 10), ("Z", 5, 300), (None, 60, 20), ("empty", 4, 0)):
        for _ in range(n):
            rows.append((doc, source, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, longest))), "kept out"))
            doc += 1
    return rows + [(None, "b", "no id \t here", "x"), (7, "b", None, "x"), (7, "b", "  ", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies_follow_the_plain_version(spark, seed):
    rows = mix_rows(seed)
    got = mixing.rates(spark.createDataFrame(rows, MIXED)).collect()
    sizes = defaultdict(int)
    for _, source, text, _ in rows:
        sizes[source] += n_words(text)
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows)
    for r in got:
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16) / 2**52
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        assert r["size"] == n_words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == want[r["source"]]
        assert r["copies"] == int(rate) + (draw < rate - int(rate)) <= 3
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_sources_come_near_their_targets_and_reruns_agree(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    placed = mixing.rates(docs)
    per = placed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.2 for r in per)
    assert abs(sum(r["taken"] for r in per) / sum(r["target"] for r in per) - 1) < 0.03
    again = mixing.rates(docs.repartition(5))
    assert placed.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).isEmpty()


def test_mix_emits_the_copies(spark):
    docs = spark.createDataFrame(mix_rows(3), MIXED)
    want = Counter()
    for r in mixing.rates(docs).collect():
        want[(r["doc_id"], r["source"], r["text"])] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", "copy"]
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in out.collect()) == +want
    assert mixing.mix(docs.limit(0)).count() == 0


def test_many_sources_are_ranked_across_parts(spark):
    table = spark.range(5000).select(F.format_string("s%05d", "id").alias("source"), F.lit(1).alias("source_size")).unionByName(
        spark.createDataFrame([(None, 1)], "source string, source_size int"))
    got = {r["source"]: r["rank"] for r in mixing.ranked(table, "source").collect()}
    assert got[None] == 5000 and all(got[f"s{i:05d}"] == i for i in range(5000))


# ---- conversation trie

TURNS = "conv_id long, turn long, role string, text string, IDS string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, role.encode(), tie), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in convs.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    out = Counter()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == path)))
        kids = sum(1 for q in nodes if q and q[:-1] == path)
        parent = min(nodes[path[:-1]]) if path else None
        out[(min(members), len(path), parent, len(members), kids, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def spark_trie(spark, rows, shard_turns):
    turns = spark.createDataFrame(rows, TURNS)
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(turns)), shard_turns)
    assert tuple(nodes.columns) == prefix_trie.NODE_COLUMNS
    return Counter(tuple(r) for r in nodes.collect())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice((1, 2, 3, 7, 12))):
            role = rng.choice(("user", "assistant", None))
            rows.append((c * rng.choice((1, 1, 3)), rng.choice((t, t, None)), role, rng.choice(("", "hi", "ho", "größer", None)), "clash"))
    return rows


@pytest.mark.parametrize(("seed", "n", "shard"), [(1, 40, 1 << 19), (2, 60, 12), (3, 60, 3), (4, 25, 1)])
def test_trie_equals_the_plain_one_in_any_number_of_shards(spark, seed, n, shard):
    rows = conversations(seed, n)
    assert spark_trie(spark, rows, shard) == plain_trie(rows)


def test_trie_of_copies_repeats_prefixes_and_turnless_conversations(spark):
    long = [(0, i, "user", "same", "") for i in range(300)]
    rows = long + [(c, 0, "user", "hello", "") for c in range(1, 60)] + [(c, 0, "user", "hello", "") for c in range(100, 130)]
    rows += [(c, 1, "assistant", "there", "") for c in range(100, 115)] + [(101, 1, "assistant", "there", "")]
    rows += [(None, 0, "user", "nobody's", ""), (-7, 0, None, None, ""), (10**12, None, "", "", "")]
    assert spark_trie(spark, rows, 20) == plain_trie(rows)
    assert spark_trie(spark, rows[:1], 20) == plain_trie(rows[:1])


def test_trie_of_no_conversations_has_no_nodes(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(none))).count() == 0


def test_tree_is_balanced_by_medians():
    tree = prefix_trie.Tree()
    for i in prefix_trie.medians(1023):
        tree.insert([i], [1], 1, i, "")
    deepest, stack = 0, [(tree.below[0], 1)]
    while stack:
        at, d = stack.pop()
        if at:
            deepest = max(deepest, d)
            stack += [(tree.less[at], d + 1), (tree.more[at], d + 1)]
    assert deepest == 10


# ---- token alignment


def plain_alignment(texts, file_a, file_b):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(file_a.decode())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_proto=file_b)
    letters = token_alignment.byte_of_letter()
    coded = []
    for text in texts:
        want = b" " + (text or "").encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            coded.append(([], [], [], []))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        # Every byte is in one token of each: the pairs met byte by byte are those that overlap.
        owners = [[k for k, (s, e) in enumerate(sp) for _ in range(s, e)] for sp in spans]
        links = [(ids_a[x], ids_b[y]) for x, y in sorted(set(zip(*owners)))]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for end in common:
            i0, j0 = i, j
            while i < len(ids_a) and spans[0][i][1] <= end:
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= end:
                j += 1
            groups.append((",".join(map(str, ids_a[i0:i])), ",".join(map(str, ids_b[j0:j]))))
        coded.append((ids_a, ids_b, links, groups))
    docs = Counter(p for _, _, links, _ in coded for p in set(links))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for ids_a, ids_b, links, groups in coded:
        told = ";".join("|".join(g) for g in groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if ids_a else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), sha))
    return out


ODD = ["", None, " ", "  two  spaces ", "▁ marker", "<|endoftext|> and <s> </s> <0x41>", "naïve 東京 🙂👍🏽 é", "tab\tline\nend\r\n", "\x00\x01 control", "x" * 3000, "a", "a", " a", " " * 5000 + "b", "don't we'll", "ÿ­ ﻿"]


@pytest.fixture(scope="module")
def files():
    return token_alignment.read_file(queries.BYTE_TOKENIZER), token_alignment.read_file(queries.PIECE_MODEL)


@pytest.mark.parametrize("slice_text", [1, 3000, 16 << 20])
def test_alignment_equals_all_pairs_of_tokens(spark, docs, samples, files, slice_text):
    texts = ODD + [t for _, t in samples[:60]] + ["copied text, three times"] * 3
    rows = list(enumerate(texts)) + [(0, "equal id, other text"), (None, "no id")]
    got = token_alignment.align(docs(rows), *files, slice_text=slice_text)
    assert set(token_alignment.MEASURES) <= set(got.columns) and "lang" in got.columns
    want = Counter((d, t, *m) for (d, t), m in zip(rows, plain_alignment([t for _, t in rows], *files)))
    assert Counter((r["doc_id"], r["text"], *[r[m] for m in token_alignment.MEASURES]) for r in got.collect()) == want


def test_alignment_of_clashing_columns_and_of_nothing(spark, files):
    table = spark.createDataFrame([(1, "some text", "mine", 5)], "doc_id long, text string, DIGEST string, N_A int")
    got = token_alignment.align(table, *files)
    assert got.columns == ["doc_id", "text", "DIGEST", *token_alignment.MEASURES] and got.first()["DIGEST"] == "mine"
    assert token_alignment.align(table.limit(0), *files).count() == 0
    assert token_alignment.align(table.withColumn("text", F.lit(None).cast("string")), *files).first()["n_a"] == 0


def test_byte_tokenizer_has_the_ids_of_its_library(spark, samples, files):
    a, _ = token_alignment.coders(*files)
    assert a.fast is not None
    texts = [t for t in ODD if t] + [t for _, t in samples if t]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1FAFF)))) for _ in range(80)) for _ in range(500)]
    assert a.encode(texts) == [e.ids for e in a.library.encode_batch(texts, add_special_tokens=False)]


def test_other_byte_tokenizers_go_through_the_library(files):
    changed = files[0].replace(b'"add_prefix_space":false', b'"add_prefix_space":true').replace(b'"add_prefix_space": false', b'"add_prefix_space": true')
    assert token_alignment.ByteBpe(changed).fast is None


def test_very_long_texts_align(spark, docs, files):
    rows = [(1, "a" * 300_000), (2, "word " * 200_000), (3, "\n" * 20_000)]
    got = {r["doc_id"]: r for r in token_alignment.align(docs(rows), *files).collect()}
    assert all(got[k]["n_links"] >= max(got[k]["n_a"], got[k]["n_b"]) > 0 for k, _ in rows)
