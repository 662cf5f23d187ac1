"""The document operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widemetrics.llm import (
    archive,
    dedup,
    divergence,
    jaccard,
    langid,
    mixing,
    packing,
    phrases,
    pii,
    quality,
    repeats,
    sharding,
    topk,
)
from widemetrics.llm.common import table, text_of
from widemetrics.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: The key of the pseudonyms in op10; a user gives one of their own and keeps it.
EXAMPLE_KEY = b"an example key, not a secret"

ALPHA = 0.5


#: The file of token ids that op4 counts with; a path, so that a cluster can name its own.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_part(parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; 0 without a doc_id."""
    named = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(named, F.lit(parts)), F.lit(0))


def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_part(3) == 1
    model = langid.fit(docs, learn=~held_out)
    return langid.identified(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op2_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_part(5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = quality.scored(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
    score = F.col("quality_score")
    return scored.select(
        "doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted")
    )


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), alpha=ALPHA, seed=7)
    return mixed.select("doc_id", "source", "text", "copy", "n_copies", "shuffle_key")


OP3_SQL = f"""
with sizes as (
  select source, coalesce(sum(strlen(text)), 0)::double as size from documents group by source
), targets as (
  select source, size, case when size > 0 then pow(size, {ALPHA}) else 0 end as target from sizes
), rates as (
  select source, case when size > 0
    then target / sum(target) over () * sum(size) over () / size else 1.0 end as rate
  from targets
), parts as (
  select source, greatest(1, ceil(rate / 200))::bigint as parts, rate / greatest(1, ceil(rate / 200)) as rate
  from rates
), steps as (
  select r.source, r.parts, k.k,
    case when r.rate > 0 then exp(-r.rate + k.k * ln(r.rate) - lgamma(k.k + 1.0))
      else (k.k = 0)::int::double end as p
  from parts r, lateral (select unnest(range(0, ceil(r.rate + 12 * sqrt(r.rate) + 25)::bigint)) as k) k
), cumulative as (
  select source, parts, k, sum(p) over (partition by source order by k) as c from steps
), inverse as (
  select source, parts, list(c order by k) as cdf from cumulative group by source, parts
), uniform as (
  select d.*, i.cdf, list_transform(range(0, i.parts), lambda part:
    (('0x' || substr(md5('7|' || coalesce(d.doc_id::varchar, '') || '|' || part::varchar), 1, 13))::bigint::double
      + 0.5) / 4503599627370496.0) as us
  from documents d join inverse i on d.source is not distinct from i.source
), drawn as (
  select * exclude (cdf, us), list_sum(list_transform(us, lambda u:
    list_count(list_filter(cdf, lambda c: c <= u))))::bigint as n_copies
  from uniform
), copies as (
  select *, unnest(range(0, n_copies)) as copy from drawn
)
select doc_id, source, text, copy, n_copies,
  ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '') || '|copy|' || copy::varchar), 1, 15)
  )::bigint as shuffle_key
from copies
"""


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("example_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def op5_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


OP5_SQL = """
with normal as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as t
  from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id,
  count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from normal
"""


def op6_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_words(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = """
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') as w
  from documents
), runs as (
  select doc_id, unnest(range(1, len(w) - 48)) as i, w from split where len(w) >= 50
), windows as (
  select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h from runs
), firsts as (
  select h, min(doc_id) as first from windows group by h
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as place
  from windows join firsts using (h) where first < doc_id
), words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from split
), marked as (
  select w.*, g.place is not null as out from words w
  left join gone g on w.doc_id = g.doc_id and w.place = g.place
), counted as (
  select doc_id, count(*) as n_words, count_if(out)::bigint as n_removed,
    string_agg(case when not out then word end, ' ' order by place) as kept
  from marked group by doc_id
)
select s.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from split s left join counted c on s.doc_id = c.doc_id
"""


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op8_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffled_shards(table(spark, sf_dir, "documents"), shards=40, seed=11)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op9_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP9_SQL = """
with finite as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from finite q join finite c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
    and len(q.v) = len(c.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    return out.select("doc_id", "text", F.size("pii_spans").cast("bigint").alias("n_replaced"), "pii_spans")


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    store = archive.Archive(spark, shared_dir(spark, "archive"))
    store.write(pages)
    kind = pages.schema["page_id"].dataType
    return store.index().select(
        F.col("key").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP11_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest,
    max(page_id) over (partition by coalesce(html, '')) as first
  from pages
), fives as (
  select *, list_transform(range(8), lambda i: ('0x' || substr(digest, 1 + 5 * i, 5))::bigint) as parts
  from payloads
)
select page_id, strlen(payload) as payload_bytes,
  array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '')
    as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from fives
"""


def op12_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"), top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w
  from pieces
), sizes as (
  select lang, sum(len(w))::bigint as n from split group by lang
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from split, (select unnest(range(1, 5)) as k) where len(w) >= k
), counts as (
  select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30
), cuts as (
  select lang, k, phrase, f, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as head,
    array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') as tail
  from counts, (select unnest(range(1, 4)) as c) where c < k
), scored as (
  select x.*, h.f as l, t.f as r,
    ((2000000::hugeint * x.f) // (h.f::hugeint + t.f::hugeint))::bigint as score
  from cuts x
  join counts h on x.lang = h.lang and x.head = h.phrase
  join counts t on x.lang = t.lang and x.tail = t.phrase
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), within as (
  select distinct s.lang, s.phrase from counts s join counts o
    on s.lang = o.lang and o.k > s.k and s.k > 1 and 100::hugeint * o.f >= 80::hugeint * s.f
    and contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, f desc, b.phrase)::int as rank
  from best b anti join within x on b.lang = x.lang and b.phrase = x.phrase
)
select lang, rank, phrase, f as a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = """
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_transform(regexp_extract_all(coalesce(text, ''),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as terms
  from documents
), words as (
  select id, lang, source, unnest(terms) as term from docs
), kept as (
  select lang, term, count(*) as total from words group by all having count(distinct id) >= 30
), own as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
), groups as (
  select g.lang, g.source, coalesce(size, 0) as size, coalesce(lang_size, 0) as lang_size,
    coalesce(v, 0) as v
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n) as size from own group by all) s
    on g.lang = s.lang and g.source = s.source
  left join (select lang, count(*) as v, sum(total) as lang_size from kept group by lang) k
    on g.lang = k.lang
), shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (size::hugeint + 5 * v) as p,
    1 + (1000000000::hugeint * (total + 5)) // (lang_size::hugeint + 5 * v) as q
  from groups g join kept k on g.lang = k.lang
  left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source
  left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
), items as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from items
)
select * from ranked where part = 'pair' or rank <= 50
"""


_QUERIES: dict[str, Query] = {
    "op1_centroid_language": op1_centroid_language,
    "op2_passage_quality": op2_passage_quality,
    "op3_poisson_mixing": op3_poisson_mixing,
    "op4_vector_packing": op4_vector_packing,
    "op5_golomb_dedup": op5_golomb_dedup,
    "op6_doubling_repeats": op6_doubling_repeats,
    "op7_prefix_tree_join": op7_prefix_tree_join,
    "op8_two_pass_shuffle": op8_two_pass_shuffle,
    "op9_dual_tree": op9_dual_tree,
    "op10_feistel_pseudonyms": op10_feistel_pseudonyms,
    "op11_warc_archive": op11_warc_archive,
    "op12_phrase_streams": op12_phrase_streams,
    "op13_source_divergence": op13_source_divergence,
}

_ORACLES: dict[str, str] = {
    "op3_poisson_mixing": OP3_SQL,
    "op5_golomb_dedup": OP5_SQL,
    "op6_doubling_repeats": OP6_SQL,
    "op9_dual_tree": OP9_SQL,
    "op11_warc_archive": OP11_SQL,
    "op12_phrase_streams": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
