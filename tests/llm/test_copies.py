"""Near copies and repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from icefathom.llm import order_minhash, suffix_dedup
from icefathom.llm.batches import ALNUM, LOWER_VALUES, slices, words
from icefathom.llm.components import components


def text(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(draw, body, share):
    out = []
    for w in body.split():
        x = draw.random()
        if x < share / 3:
            continue
        out.append(f"e{draw.randrange(10**6)}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(f"i{draw.randrange(10**6)}")
    return " ".join(out)


def hashes_of(body):
    part = next(slices(pa.array([body])))
    return words(part, ALNUM, LOWER_VALUES).hashes


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_whole_table():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = rng.integers(0, 8, rng.integers(1, 60)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 12)):
            i = int(rng.integers(0, len(b)))
            b = np.delete(b, i) if rng.random() < 0.4 and len(b) > 1 else np.insert(b, i, rng.integers(0, 8))
        want = lcs(a.tolist(), b.tolist()) / max(len(a), len(b))
        assert order_minhash.alike(a, b) == pytest.approx(want if want >= 0.8 else 0.0)


def planted(draw):
    """Rows, and the class of each: bases with light copies, and strangers."""
    rows, family = [], {}
    for base in range(12):
        body = text(draw, draw.choice((60, 150, 600)))
        for k in range(5):
            key = 100 * base + k
            copy = body if k == 0 else body.upper() if k == 1 else edited(draw, body, 0.04)
            rows.append((key, copy))
            family[key] = base
    rows += [(10_000 + i, text(draw, 60)) for i in range(40)]
    return rows, family


def test_classes_equal_brute_force(docs):
    draw = random.Random(11)
    rows, _ = planted(draw)
    rows += [(20_000, None), (20_001, ""), (20_002, "..."), (20_003, "..."), (None, rows[0][1]), (20_004, "one two"), (20_005, "One, two!")]
    rows += [rows[7], rows[7]]
    got = order_minhash.classes(docs(rows).select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    ours = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    sequences = {k: hashes_of(t) for k, t in rows if k is not None and t}
    keys = sorted(k for k, h in sequences.items() if len(h))
    root = {k: k for k in ours}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if order_minhash.alike(sequences[a], sequences[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    wrong = [k for k in ours if ours[k] != find(k)]
    assert not wrong
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]


def test_a_large_group_makes_pairs_in_proportion(docs):
    draw = random.Random(5)
    body = text(draw, 80)
    rows = [(i, edited(draw, body, 0.02)) for i in range(120)] + [(500 + i, body) for i in range(120)]
    df = docs(rows).select("doc_id", "text")
    assert {r["class_id"] for r in order_minhash.classes(df).collect()} == {0}
    signed = order_minhash.signatures(df)
    reps = signed.groupBy("digest").agg(F.min("key").alias("key"), F.first("sketches").alias("sketches"))
    assert order_minhash.near_links(df, reps).count() <= order_minhash.ROUNDS * order_minhash.SKETCHES * 121


def linked(df, sketches):
    """Classes by near_links over sketches that are given."""
    reps = df.sparkSession.createDataFrame(sketches, "key long, sketches array<long>")
    return {(r["a"], r["b"]) for r in order_minhash.near_links(df, reps).select("a", "b").collect()}


@pytest.mark.parametrize("groups", (6, 40))
def test_a_template_shared_by_many_groups_hides_no_pair(docs, groups):
    """All share one bucket only, the template's; each text has one copy in it."""
    draw = random.Random(7)
    template, rows = text(draw, 100), []
    for g in range(groups):
        own = " ".join(f"g{g}x{i}" for i in range(60))
        other = " ".join(w if i % 4 else f"e{g}x{i}" for i, w in enumerate(own.split()))
        rows += [(g, f"{template} {own}"), (1000 + g, f"{template} {other}")]
    df = docs(rows).select("doc_id", "text")
    assert linked(df, [(k, [1]) for k, _ in rows]) == {(g, 1000 + g) for g in range(groups)}


@pytest.mark.parametrize("small_bucket", (4, 8192))
def test_strangers_in_a_bucket_are_not_paired(docs, monkeypatch, small_bucket):
    """Pairs that lengths or words rule out are not aligned: 80 texts with a template and 4 pairs of copies."""
    draw = random.Random(8)
    template, rows = text(draw, 100), []
    for g in range(40):
        own = " ".join(f"g{g}x{i}" for i in range(60))
        other = " ".join(w if i % 4 or g >= 4 else f"e{g}x{i}" for i, w in enumerate(own.split()))
        rows += [(g, f"{template} {own}"), (1000 + g, f"{template} {other}" if g < 4 else f"{template} " + " ".join(f"h{g}x{i}" for i in range(60)))]
    asked, aligned = [], order_minhash._aligned

    def counted(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return aligned(pairs)

    monkeypatch.setattr(order_minhash, "_aligned", counted)
    monkeypatch.setattr(order_minhash, "SMALL_BUCKET", small_bucket)
    df = docs(rows).select("doc_id", "text")
    assert linked(df, [(k, [1]) for k, _ in rows]) == {(g, 1000 + g) for g in range(4)}
    assert len(asked) <= 2 * len(rows)


def test_long_strangers_in_crowded_buckets_are_not_paired(docs, monkeypatch):
    """Their words fill all bits of the small table: 60 texts with one long template and three buckets, 4 pairs of copies."""
    draw = random.Random(6)
    template, rows = text(draw, 500, 100_000), []
    for g in range(60):
        own = " ".join(f"g{g}x{i}" for i in range(170))
        other = " ".join(w if i % 4 else f"e{g}x{i}" for i, w in enumerate(own.split()))
        rows += [(g, f"{template} {own}")] + ([(1000 + g, f"{template} {other}")] if g < 4 else [])
    asked, aligned = [], order_minhash._aligned

    def counted(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return aligned(pairs)

    monkeypatch.setattr(order_minhash, "_aligned", counted)
    df = docs(rows).select("doc_id", "text")
    # Some lack the first or the second bucket: a pair is told by the first that both have.
    sketches = [(k, [1 if k % 3 else 10 + k, 2 if k % 4 else 2000 + k, 3]) for k, _ in rows]
    assert linked(df, sketches) == {(g, 1000 + g) for g in range(4)}
    assert len(asked) <= 2 * len(rows)


def test_matrices_tell_the_pairs_of_all_members(docs, monkeypatch):
    """Crowded buckets searched as matrices have the classes that brute force has."""
    draw = random.Random(12)
    template, rows = text(draw, 100), []
    for k in range(50):
        rows.append((k, edited(draw, f"{template} {text(draw, 25)}", 0.02)))
    monkeypatch.setattr(order_minhash, "WIDE_BUCKET", 2)
    sequences = {k: hashes_of(t) for k, t in rows}
    links = [(a, b) for a in sequences for b in sequences if a < b and order_minhash.alike(sequences[a], sequences[b])]
    assert 30 < len(links) < 1000
    df = docs(rows).select("doc_id", "text")
    edges = df.sparkSession.createDataFrame(links, "a long, b long")
    want = {r["node"]: r["root"] for r in components(edges).collect()}
    found = df.sparkSession.createDataFrame(list(linked(df, [(k, [1]) for k, _ in rows])), "a long, b long")
    assert {r["node"]: r["root"] for r in components(found).collect()} == want


@pytest.mark.parametrize("replaced", (30, 36, 40))
def test_copies_near_the_threshold_share_a_sketch(replaced):
    """Of texts of 200 words with 15, 18 and 20 % replaced, at random places."""
    rng = np.random.default_rng(replaced)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        b = a.copy()
        at = rng.choice(200, replaced, replace=False)
        b[at] = rng.integers(0, 1 << 62, replaced).astype(np.uint64)
        assert order_minhash.alike(a, b) >= 0.8
        met += bool((order_minhash.sketch(a) == order_minhash.sketch(b)).any())
    assert met >= 0.985 * 300


def test_a_chain_of_versions_keeps_its_links(docs):
    """Each version matches the next one only; all share one bucket, with a hub at the end."""
    draw = random.Random(9)
    words_, rows = text(draw, 100).split(), []
    for k in range(6):
        rows.append((k, " ".join(words_)))
        words_ = [f"v{k}x{i}" if i % 7 == k else w for i, w in enumerate(words_)]
    sequences = {k: hashes_of(t) for k, t in rows}
    want = {(a, b) for a in sequences for b in sequences if a < b and order_minhash.alike(sequences[a], sequences[b])}
    assert (0, 1) in want and (4, 5) in want and (0, 3) not in want
    df = docs(rows).select("doc_id", "text")
    found = linked(df, [(k, [1]) for k, _ in rows])
    assert found <= want
    roots = {r["node"]: r["root"] for r in components(df.sparkSession.createDataFrame(list(found), "a long, b long")).collect()}
    assert roots == dict.fromkeys(sequences, 0)


def test_other_key_types_and_empty(spark, docs):
    assert order_minhash.classes(docs([])).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "p q")], "name string, body string")
    got = {r["name"]: r["class_id"] for r in order_minhash.classes(named, "name", "body").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[100 + i] == 100 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_brute(rows):
    """Marked words of each text: those of 50-word windows that stand earlier."""
    seen, out = set(), {}
    for key, body in sorted(rows):
        w = WORD.findall(body or "")
        marks = [False] * len(w)
        for i in range(len(w) - 49):
            window = tuple(w[i : i + 50])
            if window in seen:
                marks[i : i + 50] = [True] * 50
            seen.add(window)
        out[key] = (w, marks)
    return out


def passages(draw):
    shared = [text(draw, n) for n in (49, 50, 51, 60, 75, 130)]
    rows = []
    for i in range(60):
        parts = [text(draw, draw.randrange(0, 90))]
        for _ in range(draw.randrange(0, 3)):
            parts += [draw.choice(shared), text(draw, draw.randrange(0, 40))]
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, text(draw, 70) + " " + shared[3] + " x " + shared[3]), (201, None), (202, ""), (203, "a " * 200), (204, "b " * 120)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, docs, seed):
    rows = passages(random.Random(seed))
    want = repeats_brute(rows)
    found = suffix_dedup.repeats(docs(rows + [rows[4], (None, rows[4][1])]))
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {k for k, _ in rows}
    for key, (w, marks) in want.items():
        mine = [False] * len(w)
        for s in got[key]["spans"]:
            mine[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert mine == marks, key


def test_repeats_over_the_table_and_cut(docs, samples):
    want = repeats_brute(samples)
    df = docs(samples)
    left = {r["doc_id"]: r for r in suffix_dedup.cut(df, suffix_dedup.repeats(df)).collect()}
    assert set(left) == set(want)
    texts = dict(samples)
    for key, (w, marks) in want.items():
        assert WORD.findall(left[key]["text"]) == [x for x, gone in zip(w, marks) if not gone]
        if not any(marks):
            assert left[key]["text"] == texts[key]


def test_repeats_of_odd_tables(docs):
    assert suffix_dedup.repeats(docs([])).count() == 0
    body = text(random.Random(9), 60)
    df = docs([(1, body), (1, body), (1, "short other text"), (2, f"a {body} b"), (None, body)])
    found = {(r["doc_id"], r["n_words"]): r for r in suffix_dedup.repeats(df).collect()}
    assert found[(1, 60)]["spans"] == [] and found[(1, 3)]["spans"] == []
    assert [(s["start"], s["end"]) for s in found[(2, 62)]["spans"]] == [(1, 61)]
    cut = sorted((r["doc_id"] or 0, r["text"]) for r in suffix_dedup.cut(df, suffix_dedup.repeats(df)).collect())
    assert cut == [(0, body), (1, "short other text"), (1, body), (1, body), (2, "a b")]
    named = suffix_dedup.cut(df.withColumnsRenamed({"source": "spans", "lang": "digest"}), suffix_dedup.repeats(df))
    assert {(r["spans"], r["digest"]) for r in named.collect()} == {("s", "en")}


@pytest.mark.parametrize("before", [0, 1])
def test_texts_of_one_id_that_share_a_passage(docs, before):
    """One of them keeps it, at one place of all texts or at different ones."""
    draw = random.Random(4)
    body = text(draw, 60)
    own = lambda i, n, side: " ".join(f"{side}{i}x{k}" for k in range(n))  # noqa: E731  no other text has these
    rows = [(7, " ".join(filter(None, [own(i, 3 * before * i, "l"), body, own(i, 5, "r")]))) for i in range(50)]
    rows += [(9, "x " + body), (7, text(draw, 80)), rows[0]]  # a later id, one without the passage, a repeated row
    df = docs(rows)
    found = suffix_dedup.repeats(df).collect()
    assert len(found) == 52
    spans = [[(s["start"], s["end"]) for s in r["spans"]] for r in found if r["doc_id"] == 7]
    places = [(3 * before * i, 3 * before * i + 60) for i in range(50)]
    cut_away = sorted(s[0] for s in spans if s)
    assert all(len(s) < 2 for s in spans) and len(cut_away) == 49
    assert cut_away == sorted(places)[1:]  # by place in the text the first one stays
    assert [(s["start"], s["end"]) for r in found if r["doc_id"] == 9 for s in r["spans"]] == [(1, 61)]
    left = [r["text"] for r in suffix_dedup.cut(df, suffix_dedup.repeats(df)).collect()]
    # At different places the first row keeps it, and so does its repetition.
    assert sum(body in t for t in left) == 1 + before and len(left) == 53
