"""Files to documents, one call to matches, reports, cache and command line."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import detection
from palimpsest.__main__ import main, settings, parser
from palimpsest.config import DetectionConfig
from palimpsest.operators import matches as M
from palimpsest.sinks import files as saved
from palimpsest.sinks import reports
from palimpsest.sources import cache, files, pages
from palimpsest.sources import reports as written

LOOSE = DetectionConfig(lang="en", min_cos_sim=0.3, min_dice_sim=0.33, min_cluster_cos_sim=0.34, min_cluster_char_len=15, min_verbatim_match_char_len=40)
SHARED = "The quick brown animal jumps over seven lazy dogs today. Every evening they return home through misty forests."
MATCH = "doc1 bigint, doc2 bigint, match_type int, start1 int, end1 int, start2 int, end2 int"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string")


def found_pairs(found):
    return {(r["doc1"], r["doc2"]) for r in found.matches.collect()}


def test_archive_documents_meet_documents_only(spark):
    own = docs(spark, (1, f"Opening remarks differ. {SHARED}"), (2, "Nothing here is like anything else at all."))
    archive = docs(spark, (10, f"Unrelated start about music. {SHARED}"), (11, f"Another beginning on trade. {SHARED}"), (12, "Nothing here is like anything else at all."))
    found = detection.find_matches(own, archive, config=LOOSE)
    assert found_pairs(found) == {(1, 10), (1, 11)}
    assert {r["doc_id"] for r in found.docs.where("is_archive").collect()} == {10, 11}  # 12 has a document's text
    with pytest.raises(ValueError):
        detection.find_matches(own, docs(spark, (1, "x")), config=LOOSE)


def test_common_lines_and_no_documents(spark):
    own = docs(spark, (1, f"Opening remarks differ. {SHARED}"), (2, f"Unrelated start about music. {SHARED}"))
    assert found_pairs(detection.find_matches(own, config=LOOSE)) == {(1, 2)}
    common = docs(spark, (0, "The quick brown animal jumps over seven lazy dogs today\nEvery evening they return home through misty forests"))
    assert found_pairs(detection.find_matches(own, common=common, config=LOOSE)) == set()
    assert found_pairs(detection.find_matches(own.limit(0), config=LOOSE)) == set()


def test_verbatim_runs_use_the_words_of_covered_sentences_only(spark):
    first, second = "Alpha beta gamma delta epsilon zeta.", "Eta theta iota kappa lambda omicron."
    line = "This very line is common to many documents."
    own = docs(spark, (1, f"{first} {line} {second}"), (2, f"{first} {second}"))
    common = docs(spark, (0, line))
    config = DetectionConfig(lang="en", min_cluster_char_len=10, min_verbatim_match_char_len=50)
    got = [r for r in detection.find_matches(own, common=common, config=config).matches.collect() if r["match_type"] == M.VERBATIM]
    assert len(got) == 1 and got[0]["start1"] == 0 and got[0]["end1"] == len(f"{first} {line} {second}")


def test_a_pair_again_with_other_settings(spark):
    own = docs(spark, (1, f"Opening remarks differ. {SHARED}"), (2, f"Unrelated start about music. {SHARED}"), (3, f"A third one. {SHARED}"))
    strict = detection.find_matches(own, config=DetectionConfig(lang="en", min_cluster_char_len=10_000))
    assert found_pairs(strict) == set()
    again = detection.reanalyse(strict, 1, 3, min_cluster_char_len=15)
    assert found_pairs(again) == {(1, 3)} and strict.config.min_cluster_char_len == 10_000


def test_foreign_documents_and_translation(spark):
    own = docs(spark, (1, "und die ist nicht das der Text"), (2, "the text is not this and that"))
    found = detection.find_matches(own, config=LOOSE)
    assert {r["doc_id"] for r in found.foreign.collect()} == {1}
    rows = detection.translated(found.docs, lambda chunk: chunk.upper(), "en").collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "UND DIE IST NICHT DAS DER TEXT", 2: "the text is not this and that"}


def test_cache_gives_equal_sentences_and_drops_vanished_documents(spark, tmp_path):
    one, two = (1, f"First words here. {SHARED}"), (2, f"Second words there. {SHARED}")
    folder = str(tmp_path / "cache")
    for rows in ([one], [one, two], [two]):
        own = docs(spark, *rows)
        plain = detection.preprocess(own, config=LOOSE)
        kept = detection.preprocess(own, config=LOOSE, cache_folder=folder)
        assert sorted(map(str, kept.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    name = f"{cache.common_key(None)}-3-None"
    assert {r["doc_id"] for r in cache.load(spark, folder, name, plain).collect()} == {2}
    assert cache.common_key(docs(spark, (1, "a"), (2, "b"))) == cache.common_key(docs(spark, (5, "b"), (6, "a"))) != "none"


def test_files_are_sniffed_decoded_and_deduplicated(spark, tmp_path):
    composed, apart = "für alle", "für alle"
    for name, content in {
        "a.txt": composed.encode(), "b.txt": b"\xef\xbb\xbf" + apart.encode(), "c.txt": "plain".encode("utf-16"), "d.bin": b"\x00\x01\x02", "e.txt": "naïve".encode("cp1252"),
        "f.pdf": b"%PDF-1.4 two", "g.PDEF": b"cached", "h.txt": b"\x81\x8d not text in any of them", "i.txt": b"",
    }.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "z.txt").write_text("below")
    scanned = files.scan(spark, str(tmp_path))
    reader = lambda content: ["one hyphen-\nated", "", "two"]
    got = {r["name"]: r["text"] for r in files.documents(scanned, reader).collect()}
    assert got == {"a.txt": composed, "c.txt": "plain", "e.txt": "naïve", "f.pdf": "one hyphenated two"}  # Spark skips the empty one
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in files.skipped(scanned).collect()}
    assert problems == {"d.bin": "binary", "f.pdf": "no PDF reader", "g.PDEF": "cache", "h.txt": "unknown encoding"}
    assert files.skipped(scanned, lambda content: None).where("problem = 'locked PDF'").count() == 1
    assert "below" in {r["text"] for r in files.documents(files.scan(spark, str(tmp_path), recursive=True)).collect()}
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(tmp_path / "a.txt"))
    uris = spark.createDataFrame([("http://a.b/c/",), ("mailto:x@y.z",), ("a.b/d",), (None,)], "uri string")
    assert {r["url"] for r in files.links(uris).collect()} == {"http://a.b/c", "https://a.b/d"}


def test_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 1, 9, 20, 0, 5), (1, 2, 1, 0, 5, 0, 5), (3, 1, 0, 0, 7, 2, 9)], MATCH)
    own = spark.createDataFrame([(1, "b.txt", "x"), (2, "c.txt", "y"), (3, None, "z")], "doc_id bigint, name string, text string")
    assert reports.text_report(rows, own) == (
        "There are matches in 2 document pairs:\nVerbatim matches:\n  Pair('3', 'b.txt'):\n    Match(Fragment(0, 7), Fragment(2, 9))\n"
        "Intelligent matches:\n  Pair('b.txt', 'c.txt'):\n    Match(Fragment(0, 5), Fragment(0, 5))\n    Match(Fragment(9, 20), Fragment(0, 5))\n"
    )
    assert reports.text_report(rows.limit(0), own) == reports.NOTHING
    assert "in 1 document pair:" in reports.text_report(rows.where("doc1 = 1"), own)
    folder = str(tmp_path / "json")
    reports.write_json(rows, own, folder)
    (tmp_path / "json" / "broken.json").write_text("{no json\n")
    back = written.read_json(spark, folder)
    assert {(r["name1"], r["name2"], r["n_matches"]) for r in back.collect()} == {("b.txt", "c.txt", 2), ("3", "b.txt", 1)}
    assert {tuple(r) for r in written.matches(back).select(*rows.columns).collect()} == {tuple(r) for r in rows.collect()}
    view = reports.results_view(rows, own)
    assert [(r["name1"], r["start1"]) for r in reports.page(view.where("label = 'intelligent'"), 0, 1).collect()] == [("b.txt", 0)]
    assert reports.page(view, 1, 1).count() == 1


def test_saved_files_skip_known_texts_and_number_names(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "name string, text string")
    existing = make(("a.txt", "one"), ("a_1.txt", "two"), ("b.txt", "three"))
    new = make(("a.txt", "one"), ("a.txt", "four"), ("a.txt", "five"), ("c.txt", "six"), ("c.txt", "six"), ("b.txt", None))
    got = {(r["name"], r["text"]) for r in saved.to_save(new, existing).collect()}
    assert {t for _, t in got} == {"four", "five", "six", ""} and {n for n, _ in got} == {"a_2.txt", "a_3.txt", "c.txt", "b_1.txt"}
    folder = str(tmp_path / "out")
    assert saved.save(make(("x.txt", "text ü")), folder) == 1
    assert (tmp_path / "out" / "x.txt").read_text(encoding="utf-8") == "text ü"
    saved.remove(spark, folder, ["x.txt", "missing.txt"])
    assert not (tmp_path / "out" / "x.txt").exists()


def test_fetched_pages_become_files(spark):
    def fetch(url):
        body = "<html><body>" + "word " * 500 + "</body></html>"
        return {"https://a.org": (body.encode(), None), "https://b.org/doc": (b"%PDF" + b"x" * 3000, "application/pdf"), "https://c.org": (b"short", "text/plain")}.get(url)

    urls = spark.createDataFrame([(u,) for u in ("https://a.org", "https://b.org/doc", "https://c.org", "https://gone.org")], "url string")
    got = {r["name"]: r for r in pages.page_files(pages.fetched(urls, fetch)).collect()}
    assert set(got) == {"a.org.txt", "doc_from_b.org.pdf"}
    assert got["a.org.txt"]["text"] == ("word " * 500).strip() and got["doc_from_b.org.pdf"]["text"] is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, start in (("a.txt", "Opening remarks differ."), ("b.txt", "Unrelated start about music.")):
        (tmp_path / "in" / name).write_text(f"{start} {SHARED * 3}")
    assert settings(parser().parse_args(["x", "-s", "0.4", "-l", "en"])).min_cluster_cos_sim == 0.4
    out = str(tmp_path / "json")
    assert main([str(tmp_path / "in"), "-l", "en", "-s", "0.3", "-j", out]) == 0
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert [(x["name1"], x["name2"]) for x in lines] in ([("a.txt", "b.txt")], [("b.txt", "a.txt")])
    assert main([str(tmp_path / "in"), "-l", "en", "-s", "0.3"]) == 0
    assert "Pair(" in capsys.readouterr().out
