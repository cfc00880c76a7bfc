"""The registered queries of the subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.llm import decontamination, html_extraction, language_id, license_scan, mixing, order_minhash, prefix_trie, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_alignment, warc
from icefathom.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _query(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether decoding gives the text back, and parity with SentencePiece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.round_trip(docs, sentencepiece_codec.read_model(PIECE_MODEL), compare=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "exact", F.col("same").alias("parity"), "ids")


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 8 shards, counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.assign(docs, 8, "doc_id", ("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _license_sql() -> str:
    """The same scan, every start of every text tried."""
    letters = f"'{license_scan.UPPER}', '{license_scan.LOWER}'"

    def stands(words: list[str], places) -> str:
        return " and ".join(f"s + {i} >= 0 and coalesce(ws[s + {i + 1}] = '{words[i]}', false)" for i in places)

    base = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        words = license_scan.words_of(phrase)
        test = stands(words, range(len(words)))
        base.append(f"[{{'at': s, 'label': '{label}'}} for s in range(0, len(ws)) if {test}]")
    found = []
    for t in license_scan.build_templates():
        share = " + ".join(
            f"(case when s + {i} >= 0 and ws[s + {i + 1}] = '{w}' then {t.weights[i]} else 0 end)" for i, w in enumerate(t.words)
        )
        test = stands(t.words, sorted(t.mandatory))
        found.append(f"[{{'label': '{t.label}', 'share': ({share}) / {float(sum(t.weights))}e0}} for s in range({-len(t.words)}, len(ws)) if {test}]")
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select doc_id, ws, {' || '.join(base)} as base, {' || '.join(found)} as found from w),
l as (select *, [x.label for x in base] as base_l, [x.at for x in base] as ats,
  [x.label for x in found] as found_l, coalesce(list_max([x.share for x in found]), 0.0e0) as best from b)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(base) as bigint) as n_base,
  cast(list_min(ats) as bigint) as first_word, cast(list_max(ats) as bigint) as last_word,
  coalesce(array_to_string(list_sort(list_distinct(base_l)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base_l || found_l)), ','), '') as labels,
  greatest(best, case when len(base) > 0 then 0.5e0 else 0.0e0 end) as score
from l"""


ORACLES["op3_license_scan"] = _license_sql()


@_query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    ensure_checkpoint_dir(spark)
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = quality_rules.judge(docs, labels)
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "score")


@_query
def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier one has, as word ranges."""
    ensure_checkpoint_dir(spark)
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "copy_of", removed.alias("n_removed"), told.alias("spans"))


ORACLES["op6_suffix_array"] = r"""
with d as (select distinct doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents where doc_id is not null),
n as (select doc_id, cast(len(ws) as bigint) as n_words, min(doc_id) over (partition by ws) as first_doc from d),
win as (select doc_id, s, array_to_string(list_slice(ws, s + 1, s + 50), ' ') as passage
  from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as s from d where len(ws) >= 50) u),
ranked as (select doc_id, s, row_number() over (partition by passage order by doc_id, s) as rn from win),
again as (select doc_id, s, s - lag(s) over (partition by doc_id order by s) as gap from ranked where rn > 1),
island as (select doc_id, s, sum(case when gap <= 50 then 0 else 1 end) over (partition by doc_id order by s) as i from again),
span as (select doc_id, i, min(s) as a, max(s) + 50 as b from island group by doc_id, i),
spans as (select doc_id, string_agg(a || '-' || b, ',' order by a) as spans, cast(sum(b - a) as bigint) as n_removed from span group by doc_id)
select n.doc_id, n_words, case when n_words >= 50 and first_doc < n.doc_id then first_doc end as copy_of,
  coalesce(n_removed, 0) as n_removed, coalesce(spans, '') as spans
from n left join spans on spans.doc_id = n.doc_id
"""


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("spans.item_id")))
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), items.alias("item_ids"), "spans")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_id.train(docs.filter(~F.coalesce(language_id.held_out(), F.lit(True))))
    found = language_id.identify(docs.select("doc_id", "text"), trees)
    kept = F.coalesce(language_id.held_out(), F.lit(False))
    return found.select("doc_id", kept.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).drop("payload", "url")


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages, html_extraction.fit(pages))


ORACLES["op9_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
sized as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as payload_digest from p),
kept as (select payload_digest, max(page_id) as top from sized where payload_bytes >= 1000 group by payload_digest)
select s.page_id, s.payload_bytes, s.payload_digest,
       case when k.top is not null and s.page_id is distinct from k.top then 'revisit' else 'response' end as record_type,
       case when k.top is not null and s.page_id is distinct from k.top then k.top end as refers_to
from sized s left join kept k on k.payload_digest = s.payload_digest and s.payload_bytes >= 1000
"""


@_query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed = mixing.rates(docs)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


ORACLES["op13_mixing"] = r"""
with d as (select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as hugeint) as words from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
-- Sources by the level at which they are full; those before the first that stays below it are capped.
o as (select *, row_number() over (order by 3.0e0 * words / weight, source nulls last) as k from w),
c as (select *, sum(words) over () - 3 * coalesce(sum(words) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_words,
  sum(weight) over (order by k rows between current row and unbounded following) as left_weight from o),
first as (select left_words, left_weight from c where 3 * words * left_weight >= weight * left_words order by k limit 1),
t as (select source, words, case when 3 * words * left_weight < weight * left_words then cast(3 * words as double)
  else cast(weight * left_words as double) / cast(left_weight as double) end as target from c as x(source, words, weight, k, lw, lg), first),
r as (select d.*, cast(t.words as bigint) as source_size, t.target, case when t.words > 0 then t.target / cast(t.words as double) else 0.0e0 end as rate,
  cast(('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 13)) as bigint) / 4503599627370496.0e0 as draw
  from d join t on d.source is not distinct from t.source),
n as (select *, cast(floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end as bigint) as copies from r)
select doc_id, size, source_size, target, size * copies as taken, source, copies from n
"""


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations."""
    ensure_checkpoint_dir(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(turns)))


# CRC-32 over a list of steps: each byte is mixed in, then eight bits are shifted out (-1 each).
ORACLES["op12_prefix_trie"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, sha256(strlen(role) || ':' || role || text)) as ts from t group by conv_id),
k as (select conv_id, ts, conv_id - conv_id % 5 as base, cast(conv_id as varchar) as told from o),
c as (select conv_id, ts, base, xor(list_reduce(list_concat([4294967295], flatten([[ascii(told[i]), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, len(told) + 1)])),
  lambda crc, s: case when s >= 0 then xor(crc, s) else xor(crc >> 1, 3988292384 * (crc & 1)) end), 4294967295) % 9 as h from k),
r as (select c.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, c.h), list_slice(c.ts, c.h + 1, len(c.ts))) as ts from c left join o b on b.conv_id = c.base),
p as (select conv_id, ts, unnest(range(0, len(ts) + 1)) as depth from r),
n as (select list_slice(ts, 1, depth) as path, depth, min(conv_id) as conv_id, cast(count(*) as bigint) as n_convs,
  coalesce(string_agg(conv_id, ',' order by conv_id) filter (len(ts) = depth), '') as ends from p group by 1, 2),
e as (select *, list_slice(path, 1, depth - 1) as above, case when depth > 0 then (n_convs - 1) * strlen(path[depth].text) else 0 end as own from n),
kids as (select above as path, cast(count(*) as bigint) as n_children from e where depth > 0 group by 1),
f as (select e.*, coalesce(kids.n_children, 0) as n_children from e left join kids on kids.path = e.path),
a as (select own, n_children, unnest([list_slice(path, 1, d) for d in range(0, depth + 1)]) as path from f),
s as (select path, cast(sum(own) as bigint) as saved_tokens, cast(count(*) filter (n_children = 0) as bigint) as n_leaves from a group by path)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256
from f join s on s.path = f.path left join f u on f.depth > 0 and u.path = f.above
"""


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens align in every document."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = token_alignment.read_file(BYTE_TOKENIZER), token_alignment.read_file(PIECE_MODEL)
    return token_alignment.align(docs, a, b).select("doc_id", *token_alignment.MEASURES)
