"""The opN_ queries with their SQL; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_levels

    return suffix_levels.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii_bootstrap

    return pii_bootstrap.report(table(spark, sf_dir, "documents"))


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_mil

    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passage_chains

    return passage_chains.passages(table(spark, sf_dir, "documents"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hyperminhash

    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_pigeonhole

    return embedding_pigeonhole.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_blocks

    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op1_embedding_pigeonhole": op1_embedding_pigeonhole, "op2_passage_chains": op2_passage_chains, "op3_hyperminhash": op3_hyperminhash, "op4_suffix_levels": op4_suffix_levels, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_decontaminate": op7_decontaminate, "op8_html_blocks": op8_html_blocks, "op9_pii": op9_pii, "op10_quality_mil": op10_quality_mil}

#: Words with ASCII white space around; lower() is replaced as only A-Z change.
_ABC = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l as (select x, y from p union all select y, x from p),
r as (select doc_id as x, doc_id as c from documents union select l.y, r.c from r join l on l.x = r.x),
c as (select x, min(c) as c from r group by x)
select s.doc_id, len(s.s)::bigint as n_shingles, c.c as component_id, s.doc_id = c.c as kept from s join c on c.x = s.doc_id
""" % _ABC.format("coalesce(text, '')")

_OP7 = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), iw as (
  select distinct item_id, least(len(w), 8) as n, unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 2), lambda i: array_to_string(w[i:i + 7], ' '))) as win from b where len(w) > 0
), n as (select distinct n from iw), aw as (
  select doc_id, n.n, unnest(range(1, len(w) - n.n + 2)) as i, w from d join n on len(w) >= n.n
), dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from aw),
h as (select distinct dw.doc_id, dw.i, dw.n, iw.item_id from dw join iw on dw.win = iw.win and dw.n = iw.n),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
""" % (_ABC.format("coalesce(text, '')"), _ABC.format("coalesce(text, '')"))

_OP1 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), ok as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as n from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0
), l as (
  select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n
), r as (select vec_id as x, vec_id as c from v union select l.y, r.c from r join l on l.x = r.x),
c as (select x, min(c) as c from r group by x), n as (select x, count(*) as n from l group by x)
select c.x as vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, c.x = c.c as kept from c left join n on n.x = c.x
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_pigeonhole": _OP1, "op7_decontaminate": _OP7, "op3_hyperminhash": _OP3}
