"""Registered queries and, where SQL can say the same, their SQL for DuckDB.

The same numbers are rounded on both sides; thresholds on counts are compared as integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import detection as D
from palimpsest.functions import similarity as S
from palimpsest.functions import text as T
from palimpsest.lineage import cut
from palimpsest.operators import clusters as C
from palimpsest.operators import matches as M
from palimpsest.operators import preprocess as P
from palimpsest.operators import seeds as J
from palimpsest.sources import pages as W


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return P.dedupe(_t(spark, sf, "documents"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return P.dedupe(_t(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return cut(P.prepare(_docs(spark, sf)))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return cut(J.seeds(_prepared(spark, sf)))


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def doc_dedupe(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


def duplicate_groups(spark, sf):
    return P.duplicate_groups(_t(spark, sf, "documents"))


def sentence_spans(spark, sf):
    return P.sentences(_docs(spark, sf)).select(*_big("doc_id", "sent_idx", "start_char", "end_char"), F.size("words").cast("bigint").alias("n_words"))


def word_counts(spark, sf):
    return _docs(spark, sf).select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def stopword_bow(spark, sf):
    return P.counts(_docs(spark, sf), T.without_stop_words(T.words(F.coalesce("text", F.lit(""))), F.col("lang")))


def foreign_docs(spark, sf):
    return _t(spark, sf, "documents").where(T.is_foreign(F.col("lang"), "en")).select("doc_id", "lang")


def poor_extraction(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.is_poor_extraction(F.coalesce("text", F.lit(""))).alias("poor"))


def truncate_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 40).alias("short"))


def detected_language(spark, sf):
    return _docs(spark, sf).select("doc_id", T.language(F.col("text")).alias("detected"))


def text_chunks(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.chunks(4999)(F.coalesce("text", F.lit("")))).alias("chunk_no", "chunk"))
    return rows.select(*_big("doc_id", "chunk_no"), "chunk")


def urls(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.normalise_url(F.col("url")).alias("url"))


def distinct_urls(spark, sf):
    return _t(spark, sf, "pages").select(F.explode(T.urls(F.concat_ws(" ", "url", "html"))).alias("url")).distinct()


def page_sources(spark, sf):
    return W.page_documents(_t(spark, sf, "pages")).select("page_id", "name", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_key"))


def common_sentences(spark, sf):
    sents = P.tag_common(P.sentences(_docs(spark, sf)), _t(spark, sf, "benchmark"))
    return sents.where("is_common").select(*_big("doc_id", "sent_idx", "start_char", "end_char"))


def joined_sentences(spark, sf):
    sents = P.sentences(_docs(spark, sf)).withColumn("is_common", F.lit(False))
    return P.remove_small(P.join_small(sents, 3), 3).select(*_big("doc_id", "start_char", "end_char"), F.size("words").cast("bigint").alias("n_words"))


def vocab_sf(spark, sf):
    return P.vocabulary(P.prepare(_docs(spark, sf)))


def item_similarities(spark, sf):
    """Cosine and dice of the bags of all pairs of benchmark items that share a word."""
    bag = P.bags(P.prepare(_items(spark, sf), 1)).groupBy("doc_id", "lemma").agg(F.sum("tf").cast("double").alias("w"))
    maps = bag.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lemma", "w"))).alias("b"))
    shared = bag.select("lemma", F.col("doc_id").alias("doc1")).join(bag.select("lemma", F.col("doc_id").alias("doc2")), "lemma").where("doc1 < doc2").select("doc1", "doc2").distinct()
    both = shared.join(maps.select(F.col("doc_id").alias("doc1"), F.col("b").alias("b1")), "doc1").join(maps.select(F.col("doc_id").alias("doc2"), F.col("b").alias("b2")), "doc2")
    return both.select("doc1", "doc2", F.round(S.cos_sim(F.col("b1"), F.col("b2")), 4).alias("cos"), F.round(S.dice_sim(F.col("b1"), F.col("b2")), 4).alias("dice"))


def doc_pairs(spark, sf):
    return J.document_pairs(_items(spark, sf))


def _sides(spark, sf):
    """Documents with even ids, and those with odd ids as the archive."""
    docs = _t(spark, sf, "documents")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def archive_overlap(spark, sf):
    """Archive documents whose text a document has (they are left out of the archive)."""
    docs, archive = _sides(spark, sf)
    return J.known(archive, docs).select("doc_id")


def archive_rest(spark, sf):
    docs, archive = _sides(spark, sf)
    return J.exclude_known(archive, docs).select("doc_id")


def archive_pairs(spark, sf):
    """Pairs of a document and an archive document with their numbers of seeds; archive documents don't meet each other."""
    both = cut(D.together(*_sides(spark, sf)).select("doc_id", "text", "is_archive"))
    sents = cut(P.prepare(both).join(both.select("doc_id", "is_archive"), "doc_id"))
    return J.seeds(sents).join(both.where("is_archive").select(F.col("doc_id").alias("doc2")), "doc2", "left_semi").groupBy("doc1", "doc2").agg(F.count("*").alias("n_seeds"))


def incremental_docs(spark, sf):
    """Documents to prepare where those of the even ids are cached: the ones whose text no cached one has."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return P.incremental(docs, docs.where("doc_id % 2 = 0"))[1].select("doc_id")


def reused_docs(spark, sf):
    """Cached documents (those of the even ids) whose text is still there when only the odd ids are left."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return P.incremental(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"))[0].select("doc_id")


def common_cluster_chars(spark, sf):
    """Lengths of clusters where benchmark lines are common: bounds count all sentences but cut the list without common ones."""
    sents = cut(P.prepare(_docs(spark, sf), common=_t(spark, sf, "benchmark")))
    return C.char_lengths(C.bounds(C.sessions(J.seeds(sents), 4)), sents).select(*_big("doc1", "doc2", "c1", "c2", "chars1", "chars2"))


def dice_pairs(spark, sf):
    return J.dice_pairs(_prepared(spark, sf)).select(*_big("doc1", "sent1", "doc2", "sent2", "n_common", "n1", "n2"))


def seed_pairs(spark, sf):
    return _seeds(spark, sf).groupBy("doc1", "doc2").agg(F.count("*").alias("n_seeds"), F.round(F.max("cos"), 4).alias("max_cos"))


def seeds(spark, sf):
    return _seeds(spark, sf).select(*_big("doc1", "doc2", "sent1", "sent2"), F.round("cos", 4).alias("cos"), F.round("dice", 4).alias("dice"))


def tfisf_weights(spark, sf):
    """Weights of the first documents' seed sentences."""
    sents = _prepared(spark, sf)
    pairs = J.dice_pairs(sents).select("doc1", "doc2", F.col("sent1").alias("sent")).distinct()
    return J.weights(pairs, sents, 1).select(*_big("doc1", "doc2", "sent"), "lemma", F.round("w", 4).alias("w"))


def clusters_gap4(spark, sf):
    return C.bounds(C.sessions(_seeds(spark, sf), 4)).select(*_big("doc1", "doc2", "c1", "c2", "n_seeds", "lo1", "hi1", "lo2", "hi2"))


def sessionise_doc1(spark, sf):
    return C.sessions(_seeds(spark, sf), 4).groupBy("doc1", "doc2", "c1").agg(F.count("*").alias("n_seeds"), F.min("sent1").cast("bigint").alias("lo1"), F.max("sent1").cast("bigint").alias("hi1")).withColumn("c1", F.col("c1").cast("bigint"))


def cluster_chars(spark, sf):
    sents = _prepared(spark, sf)
    return C.char_lengths(C.bounds(C.sessions(J.seeds(sents), 4)), sents).select(*_big("doc1", "doc2", "c1", "c2", "chars1", "chars2"))


def cluster_cosine(spark, sf):
    sents = _prepared(spark, sf)
    return C.cluster_cosines(C.bounds(C.sessions(J.seeds(sents), 4)), sents).select(*_big("doc1", "doc2", "c1", "c2"), F.round("cos", 4).alias("cos"))


def cluster_overlaps(spark, sf):
    """Overlaps among the clusters of both gaps; wide ones are numbered from a million. Those of one gap never overlap."""
    seeds = _seeds(spark, sf)
    narrow, wide = (C.bounds(C.sessions(seeds, gap)) for gap in (4, 24))
    both = narrow.unionByName(wide.withColumn("c1", F.col("c1") + 1_000_000))
    return C.overlaps(both).select(*_big("doc1", "doc2", "a1", "a2", "b1", "b2"))


def _resolved(spark, sf):
    sents = _prepared(spark, sf)
    return C.resolved(J.seeds(sents), sents)


def resolved_clusters(spark, sf):
    return _resolved(spark, sf).withColumn("cos", F.round("cos", 4))


def intelligent_matches(spark, sf):
    return M.intelligent(_resolved(spark, sf))


def summary_matches(spark, sf):
    return M.summary(_resolved(spark, sf))


def _found(spark, sf):
    docs, sents = _docs(spark, sf), _prepared(spark, sf)
    return cut(C.resolved(J.seeds(sents), sents)), sents, docs


def verbatim_matches(spark, sf):
    return M.verbatim(*_found(spark, sf))


def all_matches(spark, sf):
    return M.all_matches(*_found(spark, sf))


def pair_totals(spark, sf):
    return M.pair_totals(all_matches(spark, sf))


def pair_reports(spark, sf):
    return M.nested(all_matches(spark, sf))


def word_runs(spark, sf):
    """Runs of 20 characters or more between the first seed sentences of each pair."""
    sents = _prepared(spark, sf)
    first = J.seeds(sents).groupBy("doc1", "doc2").agg(F.min(F.struct("sent1", "sent2")).alias("s")).select("doc1", "doc2", "s.*")
    return M.word_runs(first, sents, 20).select(*_big("doc1", "doc2", "i1", "i2", "n_words", "n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_dedupe, duplicate_groups, sentence_spans, word_counts, stopword_bow, foreign_docs, poor_extraction, truncate_text, detected_language, text_chunks, urls, distinct_urls, page_sources,
        common_sentences, joined_sentences, vocab_sf, item_similarities, doc_pairs, archive_pairs, archive_overlap, archive_rest, incremental_docs, reused_docs, common_cluster_chars, dice_pairs, seed_pairs, seeds, tfisf_weights,
        clusters_gap4, sessionise_doc1, cluster_chars, cluster_cosine, cluster_overlaps, resolved_clusters, intelligent_matches, summary_matches, verbatim_matches, all_matches, pair_totals, pair_reports, word_runs,
    )
}

_WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}\p{{S}}]+'), lambda w: regexp_matches(w, '^[\p{{L}}\p{{N}}]{{2,}}$'))"


def _first(table: str, key: str) -> str:
    return f"select * replace (coalesce(text, '') as text) from {table} where {key} in (select min({key}) from {table} group by coalesce(text, ''))"


#: Words of each line of the common documents (the benchmark), and the sentences of raw that hold all words of one.
_HITS = rf"""cw as (select distinct list_sort(list_distinct({_WORDS.format("line")})) as lw from (select unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]')) as line from benchmark)),
 cl0 as (select row_number() over () as id, lw, len(lw) as n from cw where len(lw) > 0), ce as (select id, n, unnest(lw) as word from cl0),
 re as (select doc_id, sent_idx, unnest(list_distinct(w)) as word from raw0),
 hit as materialized (select distinct doc_id, sent_idx from (select doc_id, sent_idx, id from re join ce using (word) group by doc_id, sent_idx, id, n having count(*) = n))"""


def _sents(docs: str, least: int = 3, common: bool = False) -> str:
    """CTEs up to p (doc_id, sent_idx, sent_pos, start_char, end_char, words): prepared sentences that aren't common; pall has all."""
    merge = f"not f.c and not r.c and (f.n < {least} or r.sent_idx = r.total - 1 and len(r.w) < {least})"
    hits = _HITS if common else "hit as (select doc_id, sent_idx from raw0 where false)"
    return rf"""with recursive d as materialized ({docs}),
x as (select doc_id, unnest(t) as tile, generate_subscripts(t, 1) as i from (select doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+') as t from d)),
o as (select *, sum(length(tile)) over (partition by doc_id order by i) - length(tile) as begun, {_WORDS.format("tile")} as w from x),
raw0 as materialized (select doc_id, row_number() over (partition by doc_id order by i) - 1 as sent_idx, begun + length(tile) - length(regexp_replace(tile, '^\s+', '')) as start_char,
  begun + length(regexp_replace(tile, '\s+$', '')) as end_char, w, count(*) over (partition by doc_id) as total from o where len(w) > 0),
{hits},
raw as materialized (select raw0.*, hit.doc_id is not null as c from raw0 left join hit using (doc_id, sent_idx)),
fold as (select doc_id, sent_idx, 0::bigint as g, len(w) as n, c from raw where sent_idx = 0
  union all select r.doc_id, r.sent_idx, case when {merge} then f.g else f.g + 1 end, case when {merge} then f.n + len(r.w) else len(r.w) end, r.c from fold f join raw r on r.doc_id = f.doc_id and r.sent_idx = f.sent_idx + 1),
joined as (select r.doc_id, f.g, min(r.start_char) as start_char, max(r.end_char) as end_char, flatten(list(r.w order by r.sent_idx)) as words, bool_or(r.c) as c from fold f join raw r using (doc_id, sent_idx) group by 1, 2),
pall as materialized (select doc_id, row_number() over (partition by doc_id order by start_char) - 1 as sent_idx, start_char, end_char, words, c from joined where c or len(words) >= {least}),
p as materialized (select doc_id, sent_idx, row_number() over (partition by doc_id order by start_char) - 1 as sent_pos, start_char, end_char, words from pall where not c)"""


_DOCS = _first("documents", "doc_id")
_ITEMS = _first("(select item_id as doc_id, text from benchmark)", "doc_id")
_ARCHIVE = """select doc_id, coalesce(text, '') as text from documents where doc_id in (select min(doc_id) from documents where doc_id % 2 = 0 group by coalesce(text, ''))
  or doc_id in (select min(doc_id) from documents where doc_id % 2 = 1 and coalesce(text, '') not in (select coalesce(text, '') from documents where doc_id % 2 = 0) group by coalesce(text, ''))"""
_BASE = _sents(_DOCS)


def _seeds_of(sents: str, pairs: str = "a.doc_id < b.doc_id") -> str:
    return sents + _SEEDS_TAIL.replace("a.doc_id < b.doc_id", pairs)


_SEEDS_TAIL = (
    """,
e as materialized (select doc_id, sent_idx, lemma, count(*) as tf from (select doc_id, sent_idx, unnest(words) as lemma from p) group by all),
l as (select doc_id, sent_idx, count(*) as n from e group by all),
v as materialized (select doc_id, lemma, count(*) as sf from e group by all),
c as (select doc_id, count(*) as n from p group by all),
dice as materialized (select a.doc_id as doc1, a.sent_idx as sent1, b.doc_id as doc2, b.sent_idx as sent2, count(*) as n_common, any_value(x.n) as n1, any_value(y.n) as n2
  from e a join e b on a.lemma = b.lemma and a.doc_id < b.doc_id join l x on x.doc_id = a.doc_id and x.sent_idx = a.sent_idx join l y on y.doc_id = b.doc_id and y.sent_idx = b.sent_idx
  group by 1, 2, 3, 4 having 20 * count(*) > 6 * (any_value(x.n) + any_value(y.n))),
w1 as materialized (select s.doc1, s.doc2, s.sent1, e.lemma, e.tf * ln((c1.n + c2.n)::double / (a.sf + coalesce(b.sf, 0))) as w from (select distinct doc1, doc2, sent1 from dice) s
  join e on e.doc_id = s.doc1 and e.sent_idx = s.sent1 join v a on a.doc_id = s.doc1 and a.lemma = e.lemma left join v b on b.doc_id = s.doc2 and b.lemma = e.lemma join c c1 on c1.doc_id = s.doc1 join c c2 on c2.doc_id = s.doc2),
w2 as materialized (select s.doc1, s.doc2, s.sent2, e.lemma, e.tf * ln((c1.n + c2.n)::double / (a.sf + coalesce(b.sf, 0))) as w from (select distinct doc1, doc2, sent2 from dice) s
  join e on e.doc_id = s.doc2 and e.sent_idx = s.sent2 join v a on a.doc_id = s.doc2 and a.lemma = e.lemma left join v b on b.doc_id = s.doc1 and b.lemma = e.lemma join c c1 on c1.doc_id = s.doc1 join c c2 on c2.doc_id = s.doc2),
n1 as (select doc1, doc2, sent1, sqrt(sum(w * w)) as m from w1 group by all), n2 as (select doc1, doc2, sent2, sqrt(sum(w * w)) as m from w2 group by all),
dot as (select d.doc1, d.doc2, d.sent1, d.sent2, sum(w1.w * w2.w) as x from dice d join w1 using (doc1, doc2, sent1) join w2 on w2.doc1 = d.doc1 and w2.doc2 = d.doc2 and w2.sent2 = d.sent2 and w2.lemma = w1.lemma group by all),
seeds as materialized (select doc1, doc2, sent1, sent2, x / (n1.m * n2.m) as cos, 2.0 * n_common / (dice.n1 + dice.n2) as dice from dice join dot using (doc1, doc2, sent1, sent2) join n1 using (doc1, doc2, sent1) join n2 using (doc1, doc2, sent2)
  where n1.m * n2.m > 0 and x / (n1.m * n2.m) > 0.6)"""
)
_SEEDS = _seeds_of(_BASE)


def _cluster_ctes(gap: int = 4, name: str = "cl", of: str = "") -> str:
    """CTEs up to ``name``, the clusters of the seeds with a gap; ``of`` keeps the names of the others apart."""
    return f""",
j1{of} as (select *, case when sent1 - lag(sent1) over (partition by doc1, doc2 order by sent1, sent2) - 1 > {gap} then 1 else 0 end as j from seeds),
k1{of} as (select doc1, doc2, sent1, sent2, sum(j) over (partition by doc1, doc2 order by sent1, sent2) as c1 from j1{of}),
j2{of} as (select *, case when sent2 - lag(sent2) over (partition by doc1, doc2, c1 order by sent2, sent1) - 1 > {gap} then 1 else 0 end as j from k1{of}),
k2{of} as (select doc1, doc2, c1, sent1, sent2, sum(j) over (partition by doc1, doc2, c1 order by sent2, sent1) as c2 from j2{of}),
{name} as materialized (select doc1, doc2, c1::bigint as c1, c2::bigint as c2, count(*) as n_seeds, min(sent1) as lo1, max(sent1) as hi1, min(sent2) as lo2, max(sent2) as hi2 from k2{of} group by 1, 2, 3, 4)"""


_CLUSTERS = _SEEDS + _cluster_ctes()
_CHARS = """ select doc1, doc2, c1, c2, chars1, chars2 from (select cl.doc1, cl.doc2, cl.c1, cl.c2, sum(p.end_char - p.start_char)::bigint as chars1 from cl join p on p.doc_id = cl.doc1 and p.sent_pos between lo1 and hi1 group by all)
 join (select cl.doc1, cl.doc2, cl.c1, cl.c2, sum(p.end_char - p.start_char)::bigint as chars2 from cl join p on p.doc_id = cl.doc2 and p.sent_pos between lo2 and hi2 group by all) using (doc1, doc2, c1, c2)"""


def _vector(i: int) -> str:
    o = 3 - i
    return (
        f"select cl.doc1, cl.doc2, cl.c1, cl.c2, e.lemma, sum(e.tf * ln((a.n + b.n)::double / (x.sf + coalesce(y.sf, 0)))) as w from cl join e on e.doc_id = cl.doc{i} and e.sent_idx between cl.lo{i} and cl.hi{i} "
        f"join v x on x.doc_id = cl.doc{i} and x.lemma = e.lemma left join v y on y.doc_id = cl.doc{o} and y.lemma = e.lemma join c a on a.doc_id = cl.doc1 join c b on b.doc_id = cl.doc2 group by all"
    )


def _stop_case(words: str) -> str:
    cases = []
    for code in ("en", "de", "fr", "es"):
        some = ", ".join("'" + w.replace("'", "''") + "'" for w in T.stop_words(code))
        cases.append(f"when '{code}' then list_filter({words}, lambda w: w not in ({some}))")
    return f"case lang {' '.join(cases)} else {words} end"


def _url_sql(url: str) -> str:
    bare = rf"regexp_replace({url}, '[.,;:!?)\]}}]$', '')"
    full = f"case when regexp_matches({bare}, '(?i)^https?://') then {bare} else 'https://' || {bare} end"
    return f"replace(regexp_replace({full}, '/+$', ''), '///', '//')"


def _stop_sql():
    """ORACLE_SQL entries that need Spark's stop-word lists; they are read when first asked for."""
    votes = []
    for code in ("de", "en", "es", "fr"):
        some = ", ".join("'" + w.replace("'", "''") + "'" for w in T.stop_words(code) if len(w) > 1)
        votes.append(f"{{'n': len(list_intersect(ws, [{some}])), 'lang': '{code}'}}")
    return {
        "stopword_bow": f"select doc_id, lemma, count(*) as tf from (select doc_id, unnest({_stop_case(_WORDS.format('text'))}) as lemma from ({_DOCS})) group by all",
        "detected_language": f"select doc_id, case when top.n = 0 then null else top.lang end as detected from (select doc_id, list_max([{', '.join(votes)}]) as top from (select doc_id, list_distinct({_WORDS.format('text')}) as ws from ({_DOCS})))",
    }


_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_BARE = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"
_NAME = rf"regexp_replace(case when regexp_extract({_BARE}, '^[^/]*/(?:.*/)?([^/]+)/*$', 1) = '' then regexp_extract({_BARE}, '^([^/]*)', 1) else regexp_extract({_BARE}, '^[^/]*/(?:.*/)?([^/]+)/*$', 1) || '_from_' || regexp_extract({_BARE}, '^([^/]*)', 1) end, '[^A-Za-z0-9._-]', '', 'g') || '.txt'"

#: The part of a text t up to its last sentence end within 4,999 characters, or so many characters.
_CHUNK = r"case when length({0}) <= 4999 then {0} when regexp_matches(left({0}, 4999), '[.!?]\s') then regexp_extract(left({0}, 4999), '(?s)^.*[.!?]\s') else left({0}, 4999) end"

_STATIC_SQL = {
    "text_chunks": f"""with recursive d as ({_DOCS}), c as (select doc_id, 0::bigint as chunk_no, {_CHUNK.format('text')} as chunk, text from d
 union all select doc_id, chunk_no + 1, {_CHUNK.format('rest')}, rest from (select doc_id, chunk_no, substr(text, length(chunk) + 1) as rest from c where length(text) > 4999)) select doc_id, chunk_no, chunk from c""",
    "doc_dedupe": f"select doc_id, lang, length(text) as n_chars from ({_DOCS})",
    "duplicate_groups": "select sha256(coalesce(text, '')) as text_key, count(*) as n_docs, min(doc_id) as first_doc from documents group by 1 having count(*) > 1",
    "sentence_spans": _BASE + " select doc_id, sent_idx, start_char::bigint as start_char, end_char::bigint as end_char, len(w) as n_words from raw",
    "word_counts": f"select word, count(*) as n from (select unnest({_WORDS.format('text')}) as word from ({_DOCS})) group by 1",
    "foreign_docs": "select doc_id, lang from documents where lang is distinct from 'en'",
    "poor_extraction": r"select doc_id, trim(coalesce(text, ''), ' ') = '' or regexp_matches(coalesce(text, ''), '¨[aou]|ﬀ|\(cid:\d+\)|[a-zA-Z]{50}') as poor from documents",
    "truncate_text": "select doc_id, case when length(text) < 40 then text else left(text, 40) || '...' end as short from documents",
    "urls": f"select page_id, {_url_sql('url')} as url from pages",
    "distinct_urls": rf"""select distinct {_url_sql('u')} as url from (select unnest(regexp_extract_all(concat_ws(' ', url, html), '(?i)\b(?:https?://|www\.)[^\s<>"'']+')) as u from pages)""",
    "page_sources": f"with t as (select page_id, {_NAME} as name, {_TEXT} as text from pages where html is not null) select page_id, name, length(text) as n_chars, sha256(text) as text_key from t where length(text) >= 2000 and page_id in (select min(page_id) from t where length(text) >= 2000 group by text)",
    "common_sentences": _sents(_DOCS, common=True) + " select doc_id, sent_idx, start_char::bigint as start_char, end_char::bigint as end_char from raw where c",
    "joined_sentences": _BASE + " select doc_id, start_char::bigint as start_char, end_char::bigint as end_char, len(words) as n_words from p",
    "vocab_sf": _BASE + " select doc_id, lemma, count(*) as sf from (select doc_id, unnest(list_distinct(words)) as lemma from p) group by all",
    "item_similarities": _sents(_ITEMS, 1) + """, b as (select doc_id, lemma, count(*)::double as w from (select doc_id, unnest(words) as lemma from p) group by all),
 n as (select doc_id, sqrt(sum(w * w)) as m, count(*) as k from b group by all)
 select a.doc_id as doc1, c.doc_id as doc2, round(sum(a.w * c.w) / (any_value(x.m) * any_value(y.m)), 4) as cos, round(2.0 * count(*) / (any_value(x.k) + any_value(y.k)), 4) as dice
 from b a join b c on a.lemma = c.lemma and a.doc_id < c.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = c.doc_id group by 1, 2""",
    "doc_pairs": f"with i as ({_ITEMS}) select a.doc_id as doc1, b.doc_id as doc2 from i a join i b on a.doc_id < b.doc_id",
    "archive_pairs": _seeds_of(_sents(_ARCHIVE), "a.doc_id % 2 = 0 and b.doc_id % 2 = 1") + " select doc1, doc2, count(*) as n_seeds from seeds group by 1, 2",
    "archive_overlap": "select doc_id from documents where doc_id % 2 = 1 and coalesce(text, '') in (select coalesce(text, '') from documents where doc_id % 2 = 0)",
    "archive_rest": "select doc_id from documents where doc_id % 2 = 1 and coalesce(text, '') not in (select coalesce(text, '') from documents where doc_id % 2 = 0)",
    "incremental_docs": "select doc_id from documents where coalesce(text, '') not in (select coalesce(text, '') from documents where doc_id % 2 = 0)",
    "reused_docs": "select doc_id from documents where doc_id % 2 = 0 and coalesce(text, '') in (select coalesce(text, '') from documents where doc_id % 2 = 1)",
    "dice_pairs": _SEEDS + " select doc1, sent1, doc2, sent2, n_common, n1, n2 from dice",
    "seed_pairs": _SEEDS + " select doc1, doc2, count(*) as n_seeds, round(max(cos), 4) as max_cos from seeds group by 1, 2",
    "seeds": _SEEDS + " select doc1, doc2, sent1, sent2, round(cos, 4) as cos, round(dice, 4) as dice from seeds",
    "tfisf_weights": _SEEDS + " select doc1, doc2, sent1 as sent, lemma, round(w, 4) as w from w1",
    "clusters_gap4": _CLUSTERS + " select * from cl",
    "sessionise_doc1": _CLUSTERS + " select doc1, doc2, c1::bigint as c1, count(*) as n_seeds, min(sent1) as lo1, max(sent1) as hi1 from k1 group by 1, 2, 3",
    "cluster_chars": _CLUSTERS + _CHARS,
    "common_cluster_chars": _seeds_of(_sents(_DOCS, common=True)) + _cluster_ctes() + _CHARS,
    "cluster_cosine": _CLUSTERS + f""", v1 as ({_vector(1)}), v2 as ({_vector(2)}),
 f as (select coalesce(v1.doc1, v2.doc1) as doc1, coalesce(v1.doc2, v2.doc2) as doc2, coalesce(v1.c1, v2.c1) as c1, coalesce(v1.c2, v2.c2) as c2, coalesce(v1.w, 0) as x, coalesce(v2.w, 0) as y from v1 full join v2 on v1.doc1 = v2.doc1 and v1.doc2 = v2.doc2 and v1.c1 = v2.c1 and v1.c2 = v2.c2 and v1.lemma = v2.lemma)
 select doc1, doc2, c1, c2, round(case when sqrt(sum(x * x)) * sqrt(sum(y * y)) > 0 then sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) else 0 end, 4) as cos from f group by all""",
    "cluster_overlaps": _CLUSTERS + _cluster_ctes(24, "wide", "w") + """, ca as (select * from cl union all select doc1, doc2, c1 + 1000000, c2, n_seeds, lo1, hi1, lo2, hi2 from wide)
 select a.doc1, a.doc2, a.c1 as a1, a.c2 as a2, b.c1 as b1, b.c2 as b2 from ca a join ca b on a.doc1 = b.doc1 and a.doc2 = b.doc2 and (a.c1, a.c2) < (b.c1, b.c2) and a.lo1 <= b.hi1 and b.lo1 <= a.hi1 and a.lo2 <= b.hi2 and b.lo2 <= a.hi2""",
    "word_runs": _SEEDS + """, f as (select doc1, doc2, min({'a': sent1, 'b': sent2}) as s from seeds group by 1, 2),
 x1 as (select f.doc1, f.doc2, unnest(p.words) as word, generate_subscripts(p.words, 1) - 1 as p1 from f join p on p.doc_id = f.doc1 and p.sent_idx = f.s.a),
 x2 as (select f.doc1, f.doc2, unnest(p.words) as word, generate_subscripts(p.words, 1) - 1 as p2 from f join p on p.doc_id = f.doc2 and p.sent_idx = f.s.b),
 q as (select doc1, doc2, p1, p2, length(word) as n, p1 - row_number() over (partition by doc1, doc2, p1 - p2 order by p1) as island from x1 join x2 using (doc1, doc2, word))
 select doc1, doc2, min(p1) as i1, min(p2) as i2, count(*) as n_words, sum(n)::bigint as n_chars from q group by doc1, doc2, p1 - p2, island having sum(n) >= 20""",
}


def oracle_sql() -> dict[str, str]:
    """The SQL of all queries that have any. Stop words come from a running Spark; without one their queries have none."""
    from pyspark import SparkContext

    return _STATIC_SQL | (_stop_sql() if SparkContext._active_spark_context else {})
