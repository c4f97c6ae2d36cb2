"""Text functions, preprocessing, seeds and matches on small inputs with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.config import DetectionConfig, read_config
from palimpsest.functions import similarity, text
from palimpsest.lineage import cut
from palimpsest.operators import clusters, matches, preprocess, seeds
from palimpsest.sources import pages


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def one(spark, expression, *values):
    row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
    return row.select(expression(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_similarities(spark):
    b1 = {"this": 0.69, "be": 0.28, "a": 0.69, "nice": 1.38, "document": 0.69}
    b2 = {"this": 0.69, "also": 1.38, "be": 0.28, "a": 0.69, "great": 1.38, "document": 0.69}
    rows = spark.createDataFrame([(b1, b2), ({}, {}), ({"a": 0.0}, {"a": 0.0})], "a map<string,double>, b map<string,double>")
    got = rows.select(similarity.cos_sim(F.col("a"), F.col("b")).alias("c"), similarity.dice_sim(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0]["c"] == pytest.approx(0.35384046845354156) and got[0]["d"] == pytest.approx(8 / 11)
    assert tuple(got[1]) == (0, 0) and tuple(got[2]) == (0, 1)
    assert clusters.cosine(b1, b2) == pytest.approx(0.35384046845354156)


def test_scalar_functions(spark):
    assert one(spark, lambda s: text.truncate(s, 18), "123456789012345678") == "123456789012345678..."
    assert one(spark, lambda s: text.truncate(s, 50), "short") == "short"
    assert [one(spark, text.is_poor_extraction, t) for t in ("(cid:246)", "¨o", "ﬀ", "x" * 50, " ", "¨O", "https://a.b/" + "c-" * 40, "normal text")] == [True] * 5 + [False] * 3
    assert one(spark, text.words, "n3xt 5€ €uro a well-known Word_two") == ["n3xt", "well", "known", "word", "two"]
    assert one(spark, text.urls, "see www.site.de/a/, http://x.org. http://x.org mailto:a@b.c ftp://f.g") == ["https://www.site.de/a", "http://x.org"]
    assert one(spark, text.language, "und die ist nicht das der") == "de" and one(spark, text.language, "qqq") is None


def test_splitter_is_lossless_and_cuts_after_sentences():
    t = "One sentence. Another is here."
    assert text.split_text(t, 25) == ["One sentence. ", "Another is here."]
    assert text.split_text(t, 100) == [t]
    for n in (3, 10, 17):
        parts = text.split_text(t, n)
        assert "".join(parts) == t and all(len(p) <= n for p in parts)


def test_sentence_spans_and_small_ones(spark):
    t = "First sentence here. Tiny.  Ends with more words!\nLast bit"
    own = preprocess.sentences(docs(spark, t, "", None))
    got = [(r["sent_idx"], t[r["start_char"] : r["end_char"]]) for r in own.orderBy("sent_idx").collect()]
    assert got == [(0, "First sentence here."), (1, "Tiny."), (2, "Ends with more words!"), (3, "Last bit")]
    joined = preprocess.join_small(own.withColumn("is_common", F.lit(False)), 3).orderBy("sent_idx").collect()
    assert [t[r["start_char"] : r["end_char"]] for r in joined] == ["First sentence here.", "Tiny.  Ends with more words!\nLast bit"]
    assert joined[1]["words"] == ["tiny", "ends", "with", "more", "words", "last", "bit"]


def test_common_sentences_are_tagged_and_block_merging(spark):
    own = preprocess.sentences(docs(spark, "Small one. The common line stands here. Short."))
    common = docs(spark, "common; LINE\n\nother words")
    tagged = preprocess.tag_common(own, common)
    assert [r["is_common"] for r in tagged.orderBy("sent_idx").collect()] == [False, True, False]
    kept = preprocess.remove_small(preprocess.join_small(tagged, 3), 3).collect()
    assert [r["is_common"] for r in kept] == [True]
    assert preprocess.vocabulary(preprocess.prepare(docs(spark, "The common line stands here."), common=common)).count() == 0


def test_weights_follow_the_pair(spark):
    own = preprocess.prepare(docs(spark, "aa bb cc. aa bb dd. aa ee ff.", "aa bb gg. aa hh ii. aa aa jj kk."))
    pairs = spark.createDataFrame([(0, 1, i) for i in range(3)], "doc1 bigint, doc2 bigint, sent int")
    got = {(r["sent"], r["lemma"]): r["w"] for r in seeds.weights(pairs, own, 1).collect()}
    assert got[(0, "aa")] == 0 and got[(0, "bb")] == pytest.approx(math.log(6 / 3)) and got[(2, "ff")] == pytest.approx(math.log(6))
    other = {(r["sent"], r["lemma"]): r["w"] for r in seeds.weights(pairs, own, 2).collect()}
    assert other[(2, "aa")] == 0 and other[(2, "kk")] == pytest.approx(math.log(6))


def test_merging_of_small_sentences_equals_its_definition():
    rng = random.Random(1)
    for _ in range(500):
        sizes, common = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 9))], [rng.random() < 0.2 for _ in range(9)]
        parts = [[i] for i in range(len(sizes))]
        i = 0
        while i + 1 < len(parts):  # merge the first two neighbours that may, then look again from there
            a, b = parts[i], parts[i + 1]
            small = sum(sizes[k] for k in a) < 3 or i + 2 == len(parts) and sum(sizes[k] for k in b) < 3
            if small and not any(common[k] for k in a + b):
                parts[i : i + 2] = [a + b]
            else:
                i += 1
        assert preprocess.merged_groups(sizes, common, 3) == [g for g, part in enumerate(parts) for _ in part]


@pytest.mark.parametrize("above", [0.0, 0.33, 0.6, 0.9])
def test_dice_pairs_equal_brute_force(spark, above):
    lines = ["aa bb cc dd", "aa bb cc ee", "aa bb cc dd", "ff gg hh", "ff gg hh ii jj kk", "bb aa dd cc", "zz yy xx ww vv"]
    texts = [f"{lines[i]}. {lines[(i * 3 + 1) % 7]}." for i in range(7)]
    own = preprocess.prepare(docs(spark, *texts))
    rows = [(r["doc_id"], r["sent_idx"], set(r["lemmas"])) for r in own.collect()]
    wanted = {(a[0], a[1], b[0], b[1]) for a in rows for b in rows if a[0] < b[0] and 2 * len(a[2] & b[2]) > above * (len(a[2]) + len(b[2])) + 1e-12}
    got = [(r["doc1"], r["sent1"], r["doc2"], r["sent2"]) for r in seeds.dice_pairs(own, above).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_pairs_and_archive(spark):
    own, archive = docs(spark, "a", "b", "c"), spark.createDataFrame([(10, "x"), (11, "y"), (12, "b")], "doc_id bigint, text string")
    assert seeds.document_pairs(own).count() == 3
    assert seeds.document_pairs(own, archive).count() == 3 + 6
    reuse, new = preprocess.incremental(own, archive)
    assert [r["doc_id"] for r in reuse.collect()] == [12] and {r["doc_id"] for r in new.collect()} == {0, 2}


def test_word_runs_and_longest_first():
    a = "one two three four five. six"
    found = matches.run_ends(matches.words_between(a, 0, len(a)), matches.words_between("x " + a, 0, len(a) + 2), a, "x " + a, 8)
    assert found[0] == (0, 13, 2, 15) and (0, 24, 2, 26) in found  # the full stop is taken along
    assert matches.longest_first(found) == [(0, 28, 2, 30)]
    assert matches.longest_first([(0, 4, 0, 4), (2, 9, 2, 9), (20, 22, 0, 2)]) == [(2, 9, 2, 9), (20, 22, 0, 2)]


def test_equal_spans_count_once_by_priority(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0, 9, 3, 12), (1, 2, 0, 0, 9, 3, 12), (1, 2, 2, 0, 9, 3, 13)], "doc1 bigint, doc2 bigint, match_type int, start1 int, end1 int, start2 int, end2 int")
    assert sorted(r["match_type"] for r in matches.by_priority(rows).collect()) == [0, 2]


def test_end_to_end_verbatim_and_paraphrase(spark):
    shared = "The quick brown animal jumps over seven lazy dogs today. Every evening they return home through misty forests."
    texts = [f"Opening remarks differ entirely from others. {shared} Closing thoughts about weather follow.", f"Some unrelated beginning about music theory. {shared} An ending concerning trade."]
    config = DetectionConfig(min_cos_sim=0.3, min_dice_sim=0.33, min_cluster_cos_sim=0.34, min_cluster_char_len=15, min_verbatim_match_char_len=40)
    own = cut(preprocess.prepare(docs(spark, *texts)))
    found = cut(clusters.resolved(cut(seeds.seeds(own, config.min_cos_sim, config.min_dice_sim)), own, config))
    got = matches.all_matches(found, own, docs(spark, *texts), config).where("match_type = 0").collect()
    assert len(got) == 1 and texts[0][got[0]["start1"] : got[0]["end1"]] == shared == texts[1][got[0]["start2"] : got[0]["end2"]]


def test_page_names(spark):
    urls = ["https://google.com", "https://a.org/x/y.html#part", "http://b.de/p?q=1/2", "https://c.fr/dir/"]
    assert [one(spark, pages.page_name, u) for u in urls] == ["google.com", "y.html_from_a.org", "p_from_b.de", "dir_from_c.fr"]
    rows = spark.createDataFrame([(1, "u", "<p>" + "x" * 1999), (2, "u", "<p>" + "x" * 2000), (3, "u", "<b>" + "x" * 2000), (4, "u", None)], "page_id bigint, url string, html string")
    assert [r["page_id"] for r in pages.page_documents(rows).collect()] == [2]


def test_config_file(tmp_path):
    path = tmp_path / "own.ini"
    path.write_text("[a]\nlang = 'en'\nmin_cos_sim = 0.5\n[b]\nser = False\nunknown = 1\n")
    config = read_config(str(path))
    assert (config.lang, config.min_cos_sim, config.ser, config.min_dice_sim) == ("en", 0.5, False, 0.6)
    assert config.with_similarity(0.2).min_cluster_cos_sim == 0.2
    with pytest.raises(ValueError):
        config.with_similarity(2)
