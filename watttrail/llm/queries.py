"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.session import new_path, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.licenses import scan_licenses

    # the documents as files of a tree that grows with their number: packages of 512 in each source, modules of 8
    # in them; one file in four is the licence file of its module, one in 64 that of its package
    doc = F.col("doc_id")
    package = F.concat(F.lit("/pkg"), F.floor(doc / 512))
    module = F.concat(F.lit("/m"), F.floor(doc / 8) % 64)
    file = F.when(doc % 64 == 0, F.lit("/LICENSE")).when(doc % 4 == 0, F.concat(module, F.lit("/LICENSE")))
    file = file.otherwise(F.concat(module, F.lit("/src/f"), doc.cast("string")))
    path = F.concat(F.coalesce("source", F.lit("unknown")), package, file)
    documents = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return scan_licenses(documents)


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.sharding import shard_rows

    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).alias("text_crc32")
    )
    placed = shard_rows(narrow, ["doc_id", "size", "text_crc32"], shards=40, seed=20)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op3_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.langid import predict, train

    documents = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(_crc("doc_id"), F.lit(3)) == 1, F.lit(False)))
    net = train(documents.where(~F.col("held_out")))
    return predict(documents, net, keep=["doc_id", "held_out"], spans=True)


def op4_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def piece_bpe() -> str:
    """Place of the SentencePiece model, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.pieces import encode_texts

    found = encode_texts(table(spark, sf_dir, "documents"), piece_bpe(), n=4, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("piece_ids", " ").cast("binary")).alias("ids_crc32"),
        F.col("nbest_scores")[0].alias("best_score"),
        F.get("nbest_scores", F.lit(1)).alias("second_score"),
        F.size("nbest_scores").cast("long").alias("n_best"),
        "round_trip",
    )


def op6_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.warc import read_archive, write_archive

    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.expr("try_cast(page as bigint)").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.suffix_tree import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.pmod(_crc("doc_id"), F.lit(7)) == 2)


def word_bpe() -> str:
    """Place of the word-level BPE tokenizer, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def op11_sparse_product_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.overlap import similar_texts

    return similar_texts(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watttrail.llm.manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_byte_gru_language": op3_byte_gru_language,
    "op4_bloom_exact_dedup": op4_bloom_exact_dedup,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_content_addressed_warc": op6_content_addressed_warc,
    "op7_suffix_tree_scores": op7_suffix_tree_scores,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_simhash_blocks": op9_simhash_blocks,
    "op10_sum_of_squares_packing": op10_sum_of_squares_packing,
    "op11_sparse_product_jaccard": op11_sparse_product_jaccard,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_EQUAL_TEXTS = r"""
with d as (
  select doc_id, length(coalesce(text, '')) chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) sha
  from documents)
select doc_id,
       first_value(doc_id) over (partition by sha order by chars desc, doc_id nulls last) as keep_id,
       count(*) over (partition by sha) as group_size,
       row_number() over (partition by sha order by chars desc, doc_id nulls last) = 1 as kept,
       sha as text_sha256
from d
"""

_REVISITS = """
with p as (
  select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest
  from pages),
r as (
  select *, first_value(page_id) over (partition by payload_digest order by page_id nulls last) first_id,
         row_number() over (partition by payload_digest order by page_id nulls last) k
  from p)
select page_id, payload_bytes, payload_digest,
       case when k > 1 and payload_bytes >= 100 then 'revisit' else 'response' end as record_type,
       case when k > 1 and payload_bytes >= 100 then first_id end as refers_to
from r
"""

# crc32 of the id's decimal digits bit by bit; trees level by level, a node's run being pos // 16
_MANIFEST = """
with recursive f as (
  select *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' az, cast(doc_id as varchar) id from documents),
d as (
  select doc_id, coalesce('=' || source, '') g,
         concat_ws('', coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) head, text,
         translate(text, az, lower(az)) lowered,
         list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * strlen(id)), lambda i: case when i % 8 = 0 then ascii(id[(i // 8 + 1)::bigint])::bigint else 0 end)),
                     lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)) crc
  from f),
leaf as (
  select doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf,
         case when xor(crc, 4294967295) % 5 = 0 then sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) end tampered
  from d),
placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by g) size from leaf),
tree as (
  select g, 0 lvl, pos, size, leaf digest from placed
  union all
  select g, lvl + 1, pos // 16, any_value((size + 15) // 16), sha256(string_agg(digest, '' order by pos)) from tree where size > 1 group by g, lvl, pos // 16),
tops as (
  select g source, digest subroot, row_number() over (order by g) - 1 pos, count(*) over () size from tree where size = 1),
upper_tree as (
  select 0 lvl, pos, size, subroot digest from tops
  union all
  select lvl + 1, pos // 16, any_value((size + 15) // 16), sha256(string_agg(digest, '' order by pos)) from upper_tree where size > 1 group by lvl, pos // 16),
hops as (
  select p.g, p.pos node, t.lvl, coalesce(string_agg(o.digest, '' order by o.pos) filter (o.pos < t.pos), '') lefts,
         coalesce(string_agg(o.digest, '' order by o.pos) filter (o.pos > t.pos), '') rights
  from placed p join tree t on t.g = p.g and t.size > 1 and t.pos = p.pos // (16 ** t.lvl)::bigint
       join tree o on o.g = t.g and o.lvl = t.lvl and o.pos // 16 = t.pos // 16
  group by p.g, p.pos, t.lvl, t.pos),
upper_hops as (
  select p.source g, 100 + t.lvl lvl, coalesce(string_agg(o.digest, '' order by o.pos) filter (o.pos < t.pos), '') lefts,
         coalesce(string_agg(o.digest, '' order by o.pos) filter (o.pos > t.pos), '') rights
  from tops p join upper_tree t on t.size > 1 and t.pos = p.pos // (16 ** t.lvl)::bigint
       join upper_tree o on o.lvl = t.lvl and o.pos // 16 = t.pos // 16
  group by p.source, t.lvl, t.pos),
way as (
  select g, node, row_number() over (partition by g, node order by lvl) step, lefts, rights
  from (select * from hops union all select p.g, p.pos, u.lvl, u.lefts, u.rights from placed p join upper_hops u on u.g = p.g)),
fold as (
  select g, pos node, 0 step, coalesce(tampered, leaf) own from placed
  union all
  select w.g, w.node, w.step, sha256(w.lefts || f.own || w.rights) from fold f join way w on w.g = f.g and w.node = f.node and w.step = f.step + 1),
folded as (select g, node, arg_max(own, step) own from fold group by g, node),
proofs as (select g, node, sha256(string_agg(lefts || rights, '' order by step)) proof from way group by g, node)
select p.doc_id, p.leaf, t.subroot, (select digest from upper_tree where size = 1) as root,
       coalesce(r.proof, sha256('')) as proof_sha256, f.own as folded_root, f.own = (select digest from upper_tree where size = 1) as verified
from placed p join tops t on t.source = p.g join folded f on f.g = p.g and f.node = p.pos left join proofs r on r.g = p.g and r.node = p.pos
"""

# every kept term against every source of its language
_DIVERGENCE = r"""
with d as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lowered
  from documents),
t as (
  select lang, source, unnest(found) term, unnest(list_transform(found, lambda x: list_count(list_filter(every, lambda y: y = x)))) n
  from (select *, list_distinct(every) found from (
    select lang, source, regexp_extract_all(lowered, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') every from d))),
kept as (select lang, term, sum(n)::hugeint lang_n from t group by all having count(*) >= 3),
v as (select lang, count(*)::hugeint kept, sum(lang_n)::hugeint lang_total from kept group by all),
n as (select lang, source, term, sum(n)::hugeint n from t join kept using (lang, term) group by all),
totals as (select lang, source, sum(n)::hugeint total from n group by all),
g as (select distinct lang, source from d),
p as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) n,
         1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (coalesce(s.total, 0) + v.kept) p,
         1 + (1000000000 * (k.lang_n + 1)) // (v.lang_total + v.kept) q
  from g join kept k on k.lang = g.lang join v on v.lang = g.lang
       left join totals s on s.lang = g.lang and s.source = g.source
       left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every_pair as (
  select a.lang, a.source, b.source item, coalesce(x.value, 0) value
  from g a join g b on a.lang = b.lang and a.source <> b.source
       left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from every_pair
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""

# every pair of different sets that shares a gram, and what is reachable from each
_JACCARD = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                              when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) grams
  from d),
classes as (select grams, min(doc_id) rep, len(grams) n from s where len(grams) > 0 group by grams),
g as (select rep, n, unnest(grams) gram from classes),
linked as (
  select a.rep lo, b.rep hi from g a join g b on a.gram = b.gram and a.rep < b.rep and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges as (select lo, hi from linked union all select hi, lo from linked),
reach as (select rep, rep far from classes union select r.rep, e.hi from reach r join edges e on e.lo = r.far),
found as (select rep, min(far) least from reach group by rep)
select s.doc_id, len(s.grams) as n_shingles, coalesce(f.least, s.doc_id) as component_id
from s left join classes c on c.grams = s.grams left join found f on f.rep = c.rep
"""

ORACLE_SQL = {
    "op11_sparse_product_jaccard": _JACCARD,
    "op12_source_divergence": _DIVERGENCE,
    "op13_merkle_manifest": _MANIFEST,
    "op6_content_addressed_warc": _REVISITS,
    "op4_bloom_exact_dedup": _EQUAL_TEXTS,
}
