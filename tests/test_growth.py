"""Steps whose exchanges or memory grew with the words of a task."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.lineage import cut
from palimpsest.operators import preprocess


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n=60):
    rng = random.Random(7)
    return spark.createDataFrame([(i, " ".join(" ".join(f"w{rng.randrange(9)}x" for _ in range(rng.randrange(1, 6))) + "." for _ in range(5))) for i in range(n)], "doc_id bigint, text string")


@pytest.mark.parametrize("most", [preprocess.MOST_COLLECTED, -1] if hasattr(preprocess, "MOST_COLLECTED") else [None])
def test_common_lines_repeat_no_sentence_for_its_words(spark, monkeypatch, most):
    lines = ["w1x W2x!", "w3x w3x w3x", "w4x w5x w6x", "none of these", ""]
    own = cut(preprocess.sentences(texts(spark)))
    monkeypatch.setattr(preprocess, "MOST_COLLECTED", most, raising=False)
    tagged = preprocess.tag_common(own, spark.createDataFrame([("\n".join(lines[:2]),), ("\n".join(lines[2:]),)], "text string"))
    sets = [{"w1x", "w2x"}, {"w3x"}, {"w4x", "w5x", "w6x"}]
    got = tagged.collect()
    assert len(got) == own.count() and {r["is_common"] for r in got} == {True, False}
    assert all(r["is_common"] == any(s <= set(r["words"]) for s in sets) for r in got)
    if most != -1:
        assert "Exchange" not in plan(tagged)


def test_words_are_counted_document_by_document(spark):
    docs = texts(spark).unionByName(spark.createDataFrame([(98, None), (99, "")], "doc_id bigint, text string"))
    found = preprocess.counts(docs, F.split(F.coalesce("text", F.lit("")), r"[ .]+"))
    wanted = {(r["doc_id"], w): n for r in texts(spark).collect() for w, n in Counter(r["text"].replace(".", " ").split()).items()}
    rows = found.where("lemma <> ''").collect()
    assert {(r["doc_id"], r["lemma"]): r["tf"] for r in rows} == wanted and len(rows) == len(wanted)
    assert "HashAggregate" not in plan(found)


def test_stopword_bow_holds_no_words_in_memory_and_vocab_sf_writes_none(spark, tmp_path):
    from palimpsest.plans import catalogue

    docs = texts(spark).withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert not any("lemma" in line for line in plan(catalogue.stopword_bow(spark, str(tmp_path))).splitlines() if "HashAggregate" in line)
    assert "Scan ExistingRDD" not in plan(catalogue.vocab_sf(spark, str(tmp_path)))
    assert not any("collect_list(struct(pos" in line for line in plan(catalogue.vocab_sf(spark, str(tmp_path))).splitlines())  # merged within a row
