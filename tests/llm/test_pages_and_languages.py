"""WARC archives, main text of pages, language identification, and the pipeline."""

import glob
import hashlib
import re
import struct
import tracemalloc
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from compare import duck, duck_bag, spark_bag

import __spark_entry__ as entry_points
import corpus_pipeline
from icefathom.llm import html_extraction, language_id, warc
from icefathom.llm.html_blocks import blocks
from icefathom.llm.queries import ORACLES, QUERIES
from icefathom.session import BATCH_BYTES, bound_batches


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make


BIG = "é" * 600
ODD_PAGES = [(1, "http://a/ b\n", BIG), (2, None, BIG), (5, "u", BIG), (3, "x", None), (4, "x", ""), (6, "x", "s" * 999), (7, "x", "s" * 999)]
ODD_PAGES += [(None, "n", "null " * 300), (None, None, "null " * 300), (8, "y", "null " * 300), (9, "z", "z" * 3_000_000), (9, "z", "z" * 3_000_000)]


def test_archives_give_back_every_page(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages(ODD_PAGES), path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(ODD_PAGES)
    top = {}
    for k, _, h in ODD_PAGES:
        if h and len(h.encode()) >= 1000 and k is not None:
            top[h] = max(top.get(h, k), k)
    want = []
    for k, _, h in ODD_PAGES:
        raw = (h or "").encode()
        kept = top.get(h)
        revisit = kept is not None and k != kept
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    texts = {(k, h or "") for k, _, h in ODD_PAGES}
    assert all((r["page_id"], bytes(r["payload"]).decode()) in texts for r in rows if r["record_type"] == "response")


def test_the_file_format(spark, pages, tmp_path):
    import zstandard

    path = str(tmp_path / "warc")
    warc.write(pages([(i, f"http://x/{i}", f"<html>page {i} " + "common words " * 40) for i in range(300)]), path)
    total = 0
    for name in glob.glob(path + "/part-*"):
        raw = open(name, "rb").read()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        rest, records = raw[8 + size :], 0
        while rest:
            if rest[:4] == warc.EMPTY_FRAME[:4]:
                rest = rest[8:]
                continue
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")  # each frame is one record
            records += 1
            rest = one.unused_data
        total += records
    assert total == 300


def test_an_empty_table_of_pages(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages([]), path)
    assert warc.read(spark, path).count() == 0


@pytest.fixture(scope="module")
def model():
    return html_extraction.train(html_extraction.built_pages())


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/x">One</a><li><a href='/y'>Two > three</a></ul></nav>
<div class="cookie-notice">We use cookies to improve things.</div><!-- <p>no</p> -->
<article><h1>A title</h1><p>First &amp; <b>second</b>
 word<br>here and some more of it to read.<p>Another paragraph of the story, with enough words to be one.
<div class="ad">Buy this now</div>
<p>The last one is here &lt;now&gt;&nbsp;and it says a few more things too.</p></article>
<aside><p>Related stories that you may like.</p></aside>
<div id="comments"><p>I think that this was a very good article, thanks for it.</p></div>
<form><label>Mail</label><button>Go</button></form>
<footer>&copy; Someone</footer>"""


def test_main_text_of_a_page_with_everything(model):
    assert html_extraction.main_text(PAGE, model) == (
        "A title\nFirst & second word here and some more of it to read.\n"
        "Another paragraph of the story, with enough words to be one.\n"
        "The last one is here <now> and it says a few more things too."
    )


def test_broken_markup_and_odd_pages(model):
    texts = lambda html: [b.text for b in blocks(html)]
    assert texts("a < b <p title='x>y'>c<p>d</p></p>e") == ["a < b", "c", "d", "e"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("x<script>never ends") == ["x"]
    assert texts("x<p class=\"open>y</p>z") == ["x", "y", "z"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("") == [] and html_extraction.main_text(None, model) == ""
    assert texts("plain text") == ["plain text"]
    assert len(blocks("<p>x" * 20_000)) == 20_000
    assert texts('<a b="' * 3000) == []  # a tag that never ends takes the rest with it
    assert texts("<" * 3000 + "a") == ["<" * 2999]
    assert [b.place and b.place.tag for b in blocks("x<p>y</p>")] == [None, "p"]


PARTS = [
    "<aside>You may also like this other story of ours today.</aside>",
    '<section class="comments">Great post, I liked it a lot and shared it.</section>',
    '<section id="comments"><article><p>Great post, I liked it a lot and shared it.</p></article></section>',
    "<footer>Filed by the newsroom. All rights reserved by the owner.</footer>",
    "<nav><ul><li><a href='#'>Back</a></li><li><a href='#'>Next page</a></li></ul></nav>",
    "<form><label>Your mail address</label><input><button>Sign up now</button></form>",
    "<button>Read it aloud</button>",
    "<select><option>First choice<option>Second choice</select>",
    '<div class="newsletter">Get the best of our stories by mail every week.</div>',
    '<div class="share-buttons"><a href="#">Share this</a></div>',
    '<div class="ad">Buy this wonderful thing now, it is cheap.</div>',
    '<div id="cookie-consent"><p>We use cookies to improve what you see here.</p></div>',
    '<div><div class="sidebar"><p>Some other stories that many people read today.</p></div></div>',
]


@pytest.fixture(scope="module")
def fitted(spark, small):
    return html_extraction.fit(spark.read.parquet(f"{small}/pages.parquet"))


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("opening", ["<article>", "<main>", '<div class="post-content">'])
def test_parts_inside_an_article_go_and_its_text_stays(fitted, part, opening):
    """With the field that the query fits, whose sampled pages have clean articles only."""
    first, last = "The only paragraph of a short article.", "A second one follows, and it says a little more than the first."
    close = "</" + opening[1:].split()[0].rstrip(">") + ">"
    top, end = "<html><body><nav><ul><li><a href='/'>Home</a></ul></nav>", close + "<footer>&copy; someone</footer></body></html>"
    for before, after in (([first], []), ([], [first]), ([first], [last]), ([first, last], [])):
        made = "".join(f"<p>{p}</p>" for p in before) + part + "".join(f"<p>{p}</p>" for p in after)
        assert html_extraction.main_text(top + opening + made + end, fitted) == "\n".join(before + after)


def test_deep_and_long_pages(fitted):
    from time import perf_counter

    start = perf_counter()
    deep = blocks("<div>x" * 100_000)
    assert len(deep) == 100_000 and deep[-1].place.tags == {"div"}
    assert len({id(b.place.tags) for b in deep}) == 1  # all share one set
    assert perf_counter() - start < 20
    page = "<html><body><article>" + "".join(f"<p>Paragraph {i} of a very long story.</p>" for i in range(80_000)) + "</article>"
    assert len(page) > 3_000_000
    assert html_extraction.main_text(page, fitted).count("\n") == 79_999


def test_held_out_pages_are_labelled_right(model):
    import random

    draw, right, total = random.Random(77), 0, 0
    for _ in range(150):
        parts = html_extraction.built_page(draw)
        page = blocks("<html><body>" + "".join(m for m, _ in parts))
        labels = [x for _, many in parts for x in many]
        right += sum(a == b for a, b in zip(model.decode(page), labels))
        total += len(labels)
    assert right >= 0.97 * total


def test_decoding_is_the_best_of_all_labellings(model):
    from itertools import product

    page = blocks(PAGE)[:8]
    scores = [model.score(b, i, len(page)) for i, b in enumerate(page)]

    def value(labels):
        out = sum(s for s, y in zip(scores, labels) if y) + (model.start if labels[0] else 0)
        return out + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))

    best = max(product((False, True), repeat=len(page)), key=value)
    assert model.decode(page) == list(best)


def test_articles_of_the_table(spark, small):
    got = {r["page_id"]: r for r in QUERIES["op10_html_extraction"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def plain_bits(counts, order, text):
    """Code length of one text, byte by byte, straight from the definition."""
    from math import log2

    data = b" " * order + text.encode().translate(bytes(language_id._lowered))
    total = 0.0
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8.0
                break
            after = counts[k].get(data[i - k : i])
            if not after:
                continue
            n = sum(after.values()) + len(after)
            if data[i] in after:
                total -= log2(after[data[i]] / n)
                break
            total -= log2(len(after) / n)
    return total


def test_code_lengths_equal_the_definition(spark, docs):
    from collections import Counter, defaultdict

    training = {"aa": ["the cat sat on the mat, the end.", "That is that"], "bb": ["der Hund und die Katze", "und so weiter, é"]}
    df = docs([(i, t) for i, t in enumerate(training["aa"])], "aa").union(docs([(9 + i, t) for i, t in enumerate(training["bb"])], "bb"))
    trees = language_id.train(df)
    assert trees.langs == ["aa", "bb"]
    asked = ["the hat", "und der Hund", "xyz é", "", None, "123 !", "é", "日本", "THE CAT und", "zzzz the"]
    got = language_id.identify(docs(list(enumerate(asked))), trees).collect()
    order = language_id.ORDER
    counts = {}
    for lang, texts in training.items():
        counts[lang] = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            data = b" " * order + t.encode().translate(bytes(language_id._lowered))
            for i in range(order, len(data)):
                for k in range(order + 1):
                    counts[lang][k][data[i - k : i]][data[i]] += 1
    for r in got:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bits = {lang: plain_bits(counts[lang], order, text) for lang in training}
        best = min(bits, key=lambda x: (round(bits[x], 3), x))
        assert r["lang_pred"] == best
        assert r["bits_per_byte"] == pytest.approx(bits[best] / len(text.encode()), rel=1e-4)
        assert 0.5 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(docs(list(enumerate(asked))), None).collect()} == {"und"}


def test_held_out_accuracy_and_no_peeking(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_pipeline_stages_keep_clean_documents(spark, docs, small):
    clean = spark.read.parquet(f"{small}/documents.parquet").filter("lang is not null").limit(60)
    columns = clean.columns
    again = clean.limit(5).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    junk = docs([(5_000_000, None), (5_000_001, "123 ..."), (5_000_002, "")])
    table = clean.unionByName(again).unionByName(junk).checkpoint()
    one = corpus_pipeline.identify_language(spark, table, small)
    assert one.columns == columns
    assert not {r["doc_id"] for r in one.collect()} & {5_000_000, 5_000_001, 5_000_002}
    assert one.count() >= 64
    two = corpus_pipeline.drop_near_copies(spark, one, small)
    assert two.columns == columns and not two.filter("doc_id >= 1000000").count()
    three = corpus_pipeline.drop_repeats(spark, one, small)
    assert three.columns == columns
    four = corpus_pipeline.drop_leaks(spark, one, small)
    assert four.columns == columns
    assert corpus_pipeline.encode(spark, four, small).filter("not exact").count() == 0


def test_stages_keep_columns_of_any_name(spark, docs, small):
    names = ["spans", "digest", "lang_pred", "score", "key", "class_id", "_words", "ids", "TEXT_A", "bucket", "a"]
    body = " ".join(f"w{i}" for i in range(80))
    table = docs([(1, body), (2, body), (3, f"x {body} y z"), (4, "a text of its own")])
    for i, name in enumerate(names):
        table = table.withColumn(name, table["doc_id"] * 100 + i)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, small)
        assert out.columns == table.columns, name
        for r in out.collect():
            assert [r[c] for c in names] == [r["doc_id"] * 100 + i for i in range(len(names))], name
    assert corpus_pipeline.STAGES[-1][1](spark, table, small).count() == 4


def test_stages_take_empty_tables_and_nulls(spark, docs, small):
    odd = docs([(None, None), (1, None), (2, ""), (None, "some words of text here"), (3, "x")], None)
    for table in (docs([]), odd):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, small).count() >= 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, small, name):
    assert spark_bag(QUERIES[name](spark, small)) == duck_bag(duck(small), ORACLES[name])


def test_all_eleven_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_code_lengths_are_summed_in_little_memory():
    """A slice of a megabyte and more, texts across the borders of steps and blocks, empty ones."""
    rng = np.random.default_rng(5)
    langs = list("abcdefgh")
    grams = {n: np.unique(rng.integers(0x61616161, 0x61616161 + 90_000, 4000).astype(np.uint32)) for n in langs}
    finder = language_id._Pairs(language_id.build(langs, {n: (g, rng.integers(1, 50, len(g))) for n, g in grams.items()}))
    data = rng.integers(97, 120, 1_400_000).astype(np.uint8)
    ends = np.sort(rng.integers(0, len(data), 300))
    padded, offsets = language_id._padded(data, np.concatenate(([0, 0], ends, [len(data), len(data)])))
    tracemalloc.start()
    cost = finder.cost(padded, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    for i in (0, 1, 150, 200, len(cost) - 2, len(cost) - 1):
        own = padded[offsets[i] : offsets[i + 1]]
        whole = finder.trees.lookup(language_id._grams(own, language_id.ORDER + 1), language_id.ORDER) if len(own) > language_id.ORDER else np.zeros((1, 8))
        assert cost[i] == pytest.approx(whole.sum(axis=0, dtype=np.float64), rel=1e-9)


def test_stages_get_batches_of_a_few_megabytes(spark):
    session = bound_batches(spark.newSession())
    long_texts = session.range(6000).selectExpr("id", "repeat('x', 3000) as text").coalesce(1)

    def sizes(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    assert max(r["n"] for r in long_texts.mapInArrow(sizes, "n long").collect()) < 6 << 20
    seen = []
    corpus_pipeline._over_documents(lambda s, docs, _: seen.append(s.conf.get(BATCH_BYTES)) or docs)(
        spark.newSession(), spark.createDataFrame([(1, "a", "en", "s", 1)], list(corpus_pipeline.COLUMNS)), ""
    )
    assert seen == ["4m"]
