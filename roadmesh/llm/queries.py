"""One query per operator, over its whole tables, and SQL where it can express the query."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, exact_dedup, importance, mixing, negatives, piece_bpe, ppm, secret_scan, simhash, topk, toxicity, url_filter
from .common import table

#: The five url rules: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def model_path() -> str:
    """The SentencePiece model: PIECE_MODEL, or the file that the public package has."""
    if path := os.environ.get("PIECE_MODEL"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def ranks_path() -> str:
    """The ranks of a byte-level BPE: BYTE_RANKS, or the file that the public package has."""
    if path := os.environ.get("BYTE_RANKS"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoding_digests(table(spark, sf_dir, "documents"), model_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select(F.col("id").alias("doc_id"), "n_grams", "log_weight", "mean_weight", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), topk.quantized(F.col("embedding"), 256).alias("v"))
    return negatives.hard_negatives(rows, rows.where("id % 100 = 0"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_digests(table(spark, sf_dir, "documents"), ranks_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_topk, op4_mixing, op5_exact_dedup, op6_ppm, op7_importance, op8_simhash, op9_toxicity, op10_secret_scan, op11_collocations, op12_hard_negatives, op13_byte_bpe, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"


def _url_sql() -> str:
    longest = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in longest]
    rule = " ".join(f"{f} then '{h}{p}'" for f, (h, p, _) in zip(fits, longest))
    verdict = " ".join(f"{f} then '{v}'" for f, (_, _, v) in zip(fits, longest))
    return f"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, {_PARTS}, 1), '{_UPPER}', '{_LOWER}'), '') as host,
         coalesce(regexp_extract(url, {_PARTS}, 2), '') as path
  from pages)
select page_id, host, path, case {rule} end as rule, case {verdict} else 'allow' end as verdict from parts"""


ORACLES: dict[str, str] = {
    "op2_url_filter": _url_sql(),
    "op3_topk": """
with n as (select row_number() over () as r, vec_id, embedding from embeddings where vec_id is not null),
e as (select r, vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from n),
f as (select r, vec_id, i, cast(floor(1024 * cast(x as double)) as bigint) as x from e
      where r not in (select r from e where x is null or not isfinite(x))),
s as (select q.r, q.vec_id as query_id, c.r as other, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
      from f q join f c on q.i = c.i and q.vec_id % 100 = 0 and c.vec_id <> q.vec_id group by all),
p as (select *, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from p where rank <= 10""",
    "op11_collocations": rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] as ws from pieces),
spots as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
one as (select lang, ws[i] as p, count(*) as f from spots group by all),
two as (select lang, ws[i] as x, ws[i + 1] as y, count(*) as f from spots where i < len(ws) group by all),
three as (select lang, ws[i] as x, ws[i + 1] as y, ws[i + 2] as z, count(*) as f from spots where i + 1 < len(ws) group by all having count(*) >= 10),
n as (select lang, cast(sum(f) as bigint) as n from one group by lang),
most as (select lang, x, y, max(f) as most from (select lang, x, y, f from three union all select lang, y, z, f from three) group by all),
cut as (
  select t.lang, t.x || ' ' || t.y as phrase, t.f as a, a.f as l, b.f as r, 1 as k
  from two t join one a on a.lang = t.lang and a.p = t.x join one b on b.lang = t.lang and b.p = t.y
  left join most m on m.lang = t.lang and m.x = t.x and m.y = t.y
  where t.f >= 10 and not coalesce(100 * m.most >= 50 * t.f, false)
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, a.f, b.f, 1
  from three t join one a on a.lang = t.lang and a.p = t.x join two b on b.lang = t.lang and b.x = t.y and b.y = t.z
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, a.f, b.f, 2
  from three t join two a on a.lang = t.lang and a.x = t.x and a.y = t.y join one b on b.lang = t.lang and b.p = t.z),
scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cut),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select p.lang, rank, phrase, a, l, r, n, score from placed p join n using (lang) where rank <= 2000""",
    "op12_hard_negatives": """
with n as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings where vec_id is not null and label is not null),
e as (select r, vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from n),
f as (select r, vec_id, label, i, cast(floor(256 * cast(x as double)) as bigint) as x from e
      where r not in (select r from e where x is null or not isfinite(x))),
s as (select q.r, q.vec_id as anchor_id, c.r as other, c.vec_id, q.label = c.label as same, cast(sum(q.x * c.x) as bigint) as score
      from f q join f c on q.i = c.i and q.vec_id % 100 = 0 and c.vec_id <> q.vec_id group by all),
p as (select * from s where same qualify row_number() over (partition by r order by score desc, vec_id) <= 5),
g as (select p.r, p.anchor_id, p.other, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
             cast(row_number() over (partition by p.r, p.other order by s.score desc, s.vec_id) as integer) as rank
      from p join s on s.r = p.r and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from g where rank <= 5""",
    "op5_exact_dedup": r"""
with n as (
  select doc_id, coalesce(length(text), 0) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (
  select *, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
}
