"""The registered queries of the document operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.best_position import rank_documents
from stocklens.llm.byte_bpe import encode_bytes
from stocklens.llm.compression_quality import score_quality
from stocklens.llm.exact_dedup import exact_copies
from stocklens.llm.jaccard_join import similar_components
from stocklens.llm.license_scan import COVERAGE, LICENSE_WORD, TEMPLATES, scan_licenses
from stocklens.llm.mixing import mix_plan
from stocklens.llm.order_minhash import fingerprint, fingerprint_documents
from stocklens.llm.piece_bpe import encode_documents
from stocklens.llm.subword_toxicity import score_toxicity
from stocklens.llm.suffix_dedup import remove_repeats
from stocklens.llm.trie_lm import score_documents
from stocklens.llm.whitening import whiten
from stocklens.session import let_workers_import


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("alignments")


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("signature").alias("fingerprint"), fingerprint("edited_signature").alias("edited_fingerprint"),
        "near_edited", "near_next")


def op4_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), min_counts={})


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first training position; those that the mix leaves out come last."""
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select(
        "doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"),
        F.col("mix.copies").alias("copies"), F.get("mix.positions", F.lit(0)).alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), F.xxhash64("doc_id"))


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir), piece_model_path())
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir), keep="max")


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    parts = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return parts.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened",
        F.get("explained", "at").alias("explained"), "identity_error")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_bytes(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


# Lower-casing of A to Z as DuckDB writes it.
_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_TEMPLATE_WORDS = ", ".join(
    f"({t}, {j}, '{w}', {j in tpl.key_places}, {len(tpl.words)}, {tpl.key_places[0]}, {len(tpl.key_places)}, '{tpl.label}', {tpl.base})"
    for t, tpl in enumerate(TEMPLATES) for j, w in enumerate(tpl.words))
_OP1 = f"""
with tw(t, j, word, is_key, len, key_at, key_len, label, base) as (values {_TEMPLATE_WORDS}),
d as (select doc_id, regexp_extract_all({_LOWER}, '{LICENSE_WORD}') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from d),
h as (select * from w where word in (select word from tw)),
df as (select v.word, count(distinct doc_id) as df from (select distinct word from tw) v left join h using (word) group by 1),
an as (select t, arg_min(j, df * 1000 + j) as anchor from tw join df using (word) where is_key group by t),
al as (select doc_id, t, pos - j as start, count(*) / any_value(len)::double as coverage,
              sum(is_key::int) = any_value(key_len) as key, any_value(label) as label, any_value(base) as base,
              pos - j + any_value(key_at) as place
       from h join tw using (word) join an using (t) group by doc_id, t, pos - j having bool_or(j = anchor)),
g as (select doc_id, count(*) filter (key and base) as n_base, min(place) filter (key and base) as first_word,
             max(place) filter (key and base) as last_word,
             string_agg(distinct label, ',' order by label) filter (key and base) as base_labels,
             string_agg(distinct label, ',' order by label) filter (key and coverage >= {COVERAGE}) as labels,
             max(coverage) as score from al group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0) as score
from d left join g using (doc_id)
"""

_OP10 = f"""
with d as (select doc_id, {_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

# All pairs that share a shingle are compared, then the smallest reachable id is found.
_OP5 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, len(w) as m, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
             else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as sh from d),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as sh from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) as (select doc_id, doc_id from d union select l.b, r.c from r join l on l.a = r.doc_id where r.c < l.b)
select d.doc_id, n.n::bigint as n_shingles, min(c) as component_id from d join n using (doc_id) join r using (doc_id) group by 1, 2
"""

_OP7 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('0:' || coalesce(doc_id::varchar, '')) as key from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rank from t),
w as (select *, [5.0, 2.0, 1.0][1 + (rank - 1) % 3]::double as weight, source_size::double * 3 as cap from r),
o as (select *, cap / weight as ratio from w),
l as (select *, sum(source_size::double) over () - coalesce(sum(cap) over (
             order by ratio, rank rows between unbounded preceding and 1 preceding), 0) as lft,
           sum(weight) over (order by ratio, rank rows between current row and unbounded following) as share from o),
v as (select max(case when lft * weight <= cap * share then lft / share end) as level from l),
s as (select source, source_size, rank, least(cap, weight * level) as target from l, v),
c as (select d.*, source_size, target, rank,
             sum(size) over (partition by d.source order by key, size rows unbounded preceding) - size as start
      from d join s on d.source is not distinct from s.source),
k as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as rounds from c),
n as (select *, (case when source_size > 0 then rounds + case when start + size / 2 < target - rounds * source_size
                 then 1 else 0 end else 0 end)::bigint as copies from k),
y as (select *, (1.5 - 0.5 * ((rank - 1) % 3)) as a, start::double / target as share from n),
-- the schedules 1.5 1 0.5, 1 1 1 and 0.5 1 1.5 are straight lines: a + (2 - 2a) t, with integral a t + (1 - a) t^2
f as (select *, least(1, case when a = 1 then share else 2 * share / (a + sqrt(greatest(a * a + 4 * (1 - a) * share, 0))) end) as p from y)
select doc_id, size::bigint as size, source_size, target, (copies * size)::bigint as taken, copies,
       case when copies > 0 then p end as first_position
from f
"""

_TERMS = r"""regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_OP11 = f"""
with d as (select doc_id, {_TERMS.format(_LOWER)} as terms from documents),
s as (select count(*) filter (len(terms) > 0) as nn, sum(len(terms))::bigint as ll from d),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS.format(_LOWER)}) as term from benchmark) group by 1, 2),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(terms)::bigint as n, unnest(terms) as term from d)
      where term in (select term from q) group by 1, 2, 3),
w as (select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term),
r as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::bigint as score
      from q join p using (term) join w using (term), s group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_subword_toxicity": op2_subword_toxicity,
    "op3_order_minhash": op3_order_minhash,
    "op4_trie_lm": op4_trie_lm,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_piece_bpe": op8_piece_bpe,
    "op9_compression_quality": op9_compression_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_best_position": op11_best_position,
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {
    "op5_jaccard_join": _OP5,
    "op1_license_scan": _OP1,
    "op7_mixing": _OP7,
    "op10_exact_dedup": _OP10,
    "op11_best_position": _OP11,
}
