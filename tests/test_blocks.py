"""What alike sentences and clusters send between tasks, and their results against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.lineage import cut
from palimpsest.operators import blocks, clusters, matches, preprocess, seeds


def shuffled(spark, df):
    """(rows of ``df``, records that were written to exchanges for them)"""

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = df().collect()
    return rows, written() - before


def corpus(n, seed=4, vocabulary=40):
    """Texts of sentences with words of a small vocabulary, so that many sentences share some."""
    rng = random.Random(seed)
    return [" ".join(" ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(rng.randrange(3, 7))) + "." for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def sentences(spark, texts, common=None):
    return cut(preprocess.prepare(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), common=common))


def test_candidates_are_no_rows_of_an_exchange(spark):
    texts = [f"w{i % 8}x w{i % 9}y w{i % 11}z." for i in range(700)]
    own = sentences(spark, texts)
    sets = [frozenset(t[:-1].split()) for t in texts]
    wanted = {(i, j) for i in range(700) for j in range(i + 1, 700) if 2 * len(sets[i] & sets[j]) > 0.6 * 6}
    found = seeds.dice_pairs(own, 0.6)
    rows = found.collect()
    assert {(r["doc1"], r["doc2"]) for r in rows} == wanted and len(rows) == len(wanted)
    assert not re.search(r"hashpartitioning\(gid1#\w+, gid2#", found._jdf.queryExecution().toString())


def test_equal_sentences_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(seeds, "_CHUNK", 8)
    rows = seeds.dice_pairs(sentences(spark, ["same words here. other own%d text." % i for i in range(30)]), 0.9).collect()
    got = Counter((r["doc1"], r["sent1"], r["doc2"], r["sent2"]) for r in rows)
    assert got == Counter((i, 0, j, 0) for i in range(30) for j in range(i + 1, 30))


def plain_weights(rows):
    """Functions ln(N / sf) of a pair of documents and a word."""
    bags = {(r["doc_id"], r["sent_pos"]): Counter(r["lemmas"]) for r in rows if not r["is_common"]}
    n, sf = Counter(d for d, _ in bags), Counter((d, w) for (d, _), bag in bags.items() for w in bag)
    return bags, lambda a, b, w: math.log((n[a] + n[b]) / (sf[(a, w)] + sf[(b, w)]))


def plain_cosine(bags, isf, a, b, some, others):
    v = [Counter(), Counter()]
    for i, (doc, places) in enumerate(((a, some), (b, others))):
        for p in places:
            for w, tf in bags.get((doc, p), {}).items():
                v[i][w] += tf * isf(a, b, w)
    norms = [math.sqrt(sum(x * x for x in c.values())) for c in v]
    return sum(v[0][w] * v[1][w] for w in v[0]) / (norms[0] * norms[1]) if norms[0] * norms[1] else 0.0


@pytest.fixture(params=[None, "w1x w2x\nw3x"])
def own(request, spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 60)
    monkeypatch.setattr(blocks, "STEP_WORDS", 20)
    common = None if request.param is None else spark.createDataFrame([(request.param,)], "text string")
    return sentences(spark, corpus(40, vocabulary=12), common)


def test_seeds_equal_a_plain_version_and_send_no_words_of_pairs(spark, own):
    rows = own.collect()
    bags, isf = plain_weights(rows)
    at = {(r["doc_id"], r["sent_idx"]): r["sent_pos"] for r in rows}
    pairs = seeds.dice_pairs(own, 0.6).collect()
    wanted = {}
    for r in pairs:
        cos = plain_cosine(bags, isf, r["doc1"], r["doc2"], [at[(r["doc1"], r["sent1"])]], [at[(r["doc2"], r["sent2"])]])
        if cos > 0.6 + 1e-9:
            wanted[(r["doc1"], r["doc2"], r["sent1"], r["sent2"])] = (pytest.approx(cos), pytest.approx(2 * r["n_common"] / (r["n1"] + r["n2"])))
    found, sent = shuffled(spark, lambda: seeds.seeds(own, 0.6, 0.6))
    assert {tuple(r)[:4]: (r["cos"], r["dice"]) for r in found} == wanted and len(found) == len(wanted) > 20
    _, alone = shuffled(spark, lambda: seeds.dice_pairs(own, 0.6))
    n = max(4, -(-sum(len(r["lemmas"]) for r in rows if not r["is_common"]) // 60))
    assert sent <= alone + len(pairs) + n * len(rows) + 100, (sent, alone, len(pairs), n)


def test_clusters_equal_plain_versions(spark, own):
    rows = own.collect()
    bags, isf = plain_weights(rows)
    spans = {(r["doc_id"], r["sent_pos"]): r["end_char"] - r["start_char"] for r in rows if not r["is_common"]}
    found = cut(clusters.bounds(clusters.sessions(seeds.seeds(own, 0.3, 0.4), 1)))
    keys = {tuple(r[c] for c in ("doc1", "doc2", "c1", "c2")): r for r in found.collect()}
    chars, cosines = {}, {}
    for k, r in keys.items():
        cover = [[p for p in range(r[f"lo{i}"], r[f"hi{i}"] + 1) if (r[f"doc{i}"], p) in spans] for i in (1, 2)]
        if all(cover):
            chars[k] = tuple(sum(spans[(r[f"doc{i}"], p)] for p in cover[i - 1]) for i in (1, 2))
        if any(cover):
            cosines[k] = pytest.approx(plain_cosine(bags, isf, r["doc1"], r["doc2"], *cover), abs=1e-9)
    assert any(r["hi1"] > r["lo1"] for r in keys.values())
    assert {tuple(r)[:4]: tuple(r)[4:] for r in clusters.char_lengths(found, own).collect()} == chars
    assert {tuple(r)[:4]: r["cos"] for r in clusters.cluster_cosines(found, own).collect()} == cosines


@pytest.mark.parametrize("least", [1, 30])
def test_resolved_clusters_equal_the_plain_functions(spark, own, least):
    from palimpsest.config import DetectionConfig

    config = DetectionConfig(adjacent_sents_gap=1, adjacent_sents_gap_summary=2, min_cluster_char_len=least, min_cluster_cos_sim=0.5)
    rows = own.collect()
    bags, isf = plain_weights(rows)
    at = cut(seeds.seeds(own, 0.3, 0.4))
    pairs = {}
    for r in at.collect():
        pairs.setdefault((r["doc1"], r["doc2"]), []).append((r["sent1"], r["sent2"]))
    wanted = set()
    for (a, b), some in pairs.items():
        sides = (clusters.Side(), clusters.Side())
        for r in rows:
            if r["doc_id"] in (a, b) and not r["is_common"]:
                side = sides[r["doc_id"] == b]
                side.spans[r["sent_pos"]] = (r["start_char"], r["end_char"])
                side.bags[r["sent_pos"]] = {w: tf * isf(a, b, w) for w, tf in bags[(r["doc_id"], r["sent_pos"])].items()}
        for kind, gap in ((1, 1), (2, 2)):
            for session in clusters.build(some, 2):
                wanted |= {(a, b, kind, c.lo[0], c.hi[0], c.lo[1], c.hi[1], *c.span(0), *c.span(1), c.chars(0), c.chars(1), round(c.cos(), 6)) for c in clusters.pair_clusters(session, sides, gap, config)}
    names = ["doc1", "doc2", "kind", "lo1", "hi1", "lo2", "hi2", "start1", "end1", "start2", "end2", "chars1", "chars2"]
    found = clusters.resolved(at, own, config).select(*names, F.round("cos", 6)).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted) > 4


def test_word_runs_equal_a_plain_version(spark, own):
    rows = {(r["doc_id"], r["sent_idx"]): r["words"] for r in own.where("not is_common").collect()}
    pairs = cut(seeds.dice_pairs(own, 0.5).select("doc1", "doc2", "sent1", "sent2"))
    wanted = Counter()
    for r in pairs.collect():
        a, b = rows[(r["doc1"], r["sent1"])], rows[(r["doc2"], r["sent2"])]
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if (size := sum(map(len, a[i : i + n]))) >= 5:
                        wanted[(r["doc1"], r["doc2"], i, j, n, size)] += 1
    got = Counter(map(tuple, matches.word_runs(pairs, own, 5).collect()))
    assert got == wanted and len(got) > 50
