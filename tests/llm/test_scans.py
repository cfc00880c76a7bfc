"""Licence scan, quality rules and decontamination against brute force."""

import gc
import random
import re
import weakref
from collections import Counter

from icefathom.llm import decontamination, license_scan, quality_rules

LICENCES = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "x GENERAL public License y general-public license; all rights reserved!"),
    (3, "Released under the MIT License. Licensed under CC BY-NC 4.0. cc by cc by"),
    (4, None),
    (5, ""),
    (6, "license license license general public, general licence"),
    (7, "Apache License, Version 2.0"),
    (8, "the mit x license"),
    (9, "é all rights reserved all rights reserved é"),
    (9, "é all rights reserved all rights reserved é"),
]


def test_an_id_labelled_both_ways_counts_as_bad(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality").filter("quality is not null")
    both = labels.union(labels.filter("quality = 0").selectExpr("doc_id", "1 as quality"))
    shuffled = both.repartition(5, "quality").orderBy("quality", ascending=False)

    def kept(table):
        return sorted(map(tuple, quality_rules.judge(rows, table).select("doc_id", "score", "kept").collect()))

    assert kept(both) == kept(shuffled)


def test_licences(docs, samples):
    rows = LICENCES + [(k + 100, t) for k, t in samples]
    got = license_scan.scan(docs(rows)).drop("lang", "source", "n_chars").collect()
    assert len(got) == len(rows)
    for r in got:
        w = license_scan.words_of(r["text"] or "")
        places = []
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        spots = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(spots), max(spots)) if spots else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        own = {
            t.label
            for t in license_scan.build_templates()
            for s in range(-len(t.words), len(w))
            if all(0 <= s + i < len(w) and w[s + i] == t.words[i] for i in t.mandatory)
        }
        assert r["labels"] == ",".join(sorted({x for _, x in places} | own))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[1]["labels"], by_id[1]["score"]) == ("apache-2.0", 1.0)
    assert 0.5 < by_id[7]["score"] < 1
    assert by_id[3]["labels"] == "cc-by,cc-by-nc-4.0,mit"
    assert by_id[8]["labels"] == "" and by_id[6]["labels"] == ""


def test_licence_plan_has_no_python_and_no_shuffle(docs):
    plan = license_scan.scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan
    clash = license_scan.scan(docs([(1, "mit license")]).withColumnsRenamed({"source": "Labels", "lang": "_words"}))
    assert clash.first()["labels"] == "mit" and clash.first()["_words"] == "en" and "Labels" not in clash.columns


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(twice), failed


def test_base_counts(docs, samples):
    odd = [None, "", "\n\n", "a\na\n a\na", "é ü é\n#|é\n", "x " * 50, ("one two three four five six seven eight nine\n") * 4, "\n"]
    rows = samples + list(enumerate(odd, 90_000)) + [(90_000, "again")]
    labels = docs([]).selectExpr("doc_id", "cast(null as int) quality")
    got = quality_rules.judge(docs(rows).select("doc_id", "text"), labels).collect()
    want = Counter((k, *base_brute(t)) for k, t in rows)
    assert Counter(tuple(r[c] for c in ("doc_id", *quality_rules.BASE, "base_failed")) for r in got) == want
    assert all(r["score"] == 0.0 and r["kept"] == (not r["base_failed"]) for r in got)


def test_scores_are_mean_log_ratios_and_tell_good_from_bad(spark, docs, small):
    import math

    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    got = {r["doc_id"]: r for r in quality_rules.judge(rows, labels).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in rows.collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}

    def bins(raw):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        return [((int.from_bytes(low[i : i + 4], "big") * 2654435761) % 2**32) >> 18 for i in range(len(low) - 3)]

    raw, own = Counter(), Counter()
    for k, t in texts.items():
        raw.update(bins(t))
        if k in good:
            own.update(bins(t))
    n, m, size = sum(raw.values()), sum(own.values()), quality_rules.BINS
    for k in list(texts)[:40]:
        b = bins(texts[k])
        mean = sum(math.log2((own[x] + 1) / (m + size)) - math.log2((raw[x] + 1) / (n + size)) for x in b) / max(len(b), 1)
        assert abs(mean - got[k]["score"]) < 1e-5
    told = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if not got[r["doc_id"]]["base_failed"]]
    assert all(r["kept"] for q, r in told if q == 1)
    bad = [r["kept"] for q, r in told if q == 0]
    assert bad and sum(bad) <= 0.2 * len(bad)


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly watch"


def test_leaks(spark, docs):
    bench = spark.createDataFrame(
        [(1, ITEM), (2, "tiny text"), (3, None), (4, "  "), (5, "a short item of some words"), (6, ITEM)], "item_id long, text string"
    )
    changed = ITEM.replace("quick", "quack").replace("seven", "eleven")
    broken = "the brown fox seldom jumps over any lazy dog while few wizards watch"
    rows = [
        (1, f"before {ITEM.upper()} after"),
        (2, ITEM.replace(" ", " \n ")),
        (3, f"zz {changed} zz"),
        (4, broken),
        (5, "say Tiny\tTEXT, tiny text"),
        (6, None),
        (7, ""),
        (8, f"{ITEM} {ITEM}"),
        (9, ITEM[:-3]),
        (10, "a short item of same words"),
        (11, "x" * 5000 + ITEM),
        (11, "x" * 5000 + ITEM),
    ]
    got = decontamination.find(docs(rows), bench).collect()
    assert len(got) == len(rows)
    items = {r["doc_id"]: sorted({s["item_id"] for s in r["spans"]}) for r in got}
    assert items[1] == items[2] == items[3] == items[8] == items[9] == items[11] == [1, 6]
    assert items[4] == items[6] == items[7] == []
    assert items[5] == [2] and items[10] == [5]
    spots = {r["doc_id"]: [(s["start"], s["end"], s["edits"]) for s in r["spans"] if s["item_id"] == 1] for r in got}
    assert spots[1] == [(7, 7 + len(ITEM), 0)]
    assert spots[3][0][2] == 3
    assert (0, len(ITEM), 0) in spots[8] or (len(ITEM) + 1, 2 * len(ITEM) + 1, 0) in spots[8]
    assert decontamination.find(docs(rows), bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.find(docs([]), bench).count() == 0


def test_leaks_equal_brute_force_over_the_table(spark, docs, samples, small, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)  # several passes
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r["item_id"]: decontamination.plain(r["text"]) for r in bench.collect()}
    for r in decontamination.find(docs(samples), bench).collect():
        body = decontamination.plain(r["text"])
        exact = {k for k, t in items.items() if t in body}
        got = {s["item_id"] for s in r["spans"]}
        assert exact <= got
        for s in r["spans"]:
            item = items[s["item_id"]]
            place = decontamination.plain(r["text"].encode()[s["start"] : s["end"]].decode())
            assert edits(item, place) == s["edits"] <= len(item) // decontamination.BYTES_PER_EDIT


def test_edited_items_are_found_as_brute_force_finds_them(spark, docs, small):
    """Every item that stands somewhere within its budget of edits, and no other."""
    rng = random.Random(5)
    bench = spark.read.parquet(f"{small}/benchmark.parquet").filter("length(text) >= 16").orderBy("item_id").limit(12)
    items = {r["item_id"]: decontamination.plain(r["text"]) for r in bench.collect()}
    rows = []
    for item_id, item in items.items():
        body, budget = item.decode(), len(item) // decontamination.BYTES_PER_EDIT
        for share in (0.5, 1.0, 1.0, 1.3, 2.0):
            chars = list(body)
            for _ in range(round(budget * share)):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([["#"], [], [chars[at], "#"]])
            rows.append((len(rows), f"some words first {''.join(chars)} and more words"))
    want = set()
    for doc_id, text in rows:
        for item_id, item in items.items():
            if least_edits(item, decontamination.plain(text)) <= len(item) // decontamination.BYTES_PER_EDIT:
                want.add((doc_id, item_id))
    got = {(r["doc_id"], s["item_id"]) for r in decontamination.find(docs(rows), bench).collect() for s in r["spans"]}
    assert got == want
    assert len(items) * 2 < len(want) < len(rows) * len(items)


def test_blocks_are_read_one_after_the_other(spark, docs, monkeypatch):
    """The same spans as in one pass; an earlier block is searched before a later one is made."""
    texts = [f"{ITEM} number {i} of the items, each with {i * 7919} words of its own" for i in range(40)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5, "item_id long, text string")
    rows = [(i, f"before {t} after") for i, t in enumerate(texts[:20])] + [(99, None), (99, "")]
    spans = lambda: sorted((r["doc_id"], r["text"] or "", [tuple(s) for s in r["spans"]]) for r in decontamination.find(docs(rows), bench).collect())
    once = spans()
    assert sum(len(s) for _, _, s in once) >= 20
    made = []

    def counted(block):
        # Only the last block may still be on the driver, as its variable holds it.
        gc.collect()
        assert sum(x() is not None for x in made) <= 1
        found = own(block)
        made.append(weakref.ref(found))
        return found

    own = decontamination.Benchmark

    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 600)
    monkeypatch.setattr(decontamination, "Benchmark", counted)
    assert spans() == once
    assert len(made) > 4


def least_edits(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_clashing_columns_are_replaced(spark, docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = decontamination.find(docs([(1, ITEM)]).withColumnRenamed("source", "SPANS"), bench).first()
    assert [s["item_id"] for s in found["spans"]] == [1]
    labels = docs([]).selectExpr("doc_id", "cast(null as int) quality")
    judged = quality_rules.judge(docs([(1, "a b")]).withColumnsRenamed({"source": "score", "lang": "_good"}), labels).first()
    assert (judged["n_words"], judged["score"], judged["_good"]) == (2, 0.0, "en")


def test_quality_fits_on_every_labelled_document(spark, monkeypatch):
    # More labelled documents than any bound of 20,000; the shares must count each of them.
    rows = spark.range(42_000).selectExpr("id as doc_id", "concat('w', id, case when id < 21000 then ' good text' else ' bad words' end) as text")
    labels = rows.selectExpr("doc_id", "cast(doc_id < 21000 as int) as quality")
    known = quality_rules.labelled(labels)
    assert known.count() == 42_000
    good, raw = quality_rules.corpus_counts(rows, known.filter("quality = 1"))
    n_grams = [max(len(f"w{k}" + (" good text" if k < 21_000 else " bad words")) - 3, 0) for k in range(42_000)]
    assert (int(good.sum()), int(raw.sum())) == (sum(n_grams[:21_000]), sum(n_grams))
    seen = {}
    monkeypatch.setattr(quality_rules, "threshold", lambda scored, table, *a: seen.update(n=table.count()))
    quality_rules.judge(rows, labels)
    assert seen["n"] == 42_000
