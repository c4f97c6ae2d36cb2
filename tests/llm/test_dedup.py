"""Deduplication operators against brute force, and their defined results on odd rows."""

import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import embedding_pigeonhole, hyperminhash, passage_chains, suffix_levels

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, digest string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "x", "y", "z") for i, t in rows], SCHEMA)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def edited(rng, text, share):
    w = text.split(" ")
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w)


# --- op1 -----------------------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    vecs = [b + rng.normal(size=32) * s for b in base for s in (0, 0, 0.1, 0.25, 0.35)] + [np.zeros(32), np.full(32, np.nan)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(900, None), (901, []), (902, [1.0, None])]
    got = {r[0]: r[1:] for r in embedding_pigeonhole.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    m = np.array(vecs[:200])
    cos = (m @ m.T) / np.sqrt((m * m).sum(1)[:, None] * (m * m).sum(1)[None, :])
    links = [(i, j) for i in range(200) for j in range(i) if cos[i, j] >= 0.9]
    comp = components(range(200), links)
    assert len(got) == len(rows)
    for i in range(200):
        assert got[i] == (sum(i in x for x in links), comp[i], comp[i] == i)
    for i in (200, 201, 900, 901, 902):
        assert got[i] == (0, i, True)


def test_embedding_empty_and_clashing_columns(spark):
    schema = "vec_id bigint, embedding array<float>, key string, node int, label int"
    assert embedding_pigeonhole.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = [(1, [1.0, 2.0], "a", 1, 0), (1, [1.0, 2.0], "a", 1, 0), (None, [2.0, 4.0], "a", 1, 1)]
    got = embedding_pigeonhole.near_duplicates(spark.createDataFrame(same, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]


# --- op3 -----------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        t = prose(rng, rng.randrange(3, 200))
        texts += [t, t.upper(), edited(rng, t, 0.01), edited(rng, t, 0.05), edited(rng, t, 0.2)]
    texts += ["a b", "A  b", "one", "", None, " \n\t", "x\x00y z", "x\x00y  z"]
    rows = list(enumerate(texts))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = components(sets, links)
    got = {r[0]: r[1:] for r in hyperminhash.near_duplicates(frame(spark, rows), 3, 85, 100).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_keep_one_returns_whole_rows(spark):
    rng = random.Random(6)
    t = prose(rng, 120)
    rows = [(4, t), (2, edited(rng, t, 0.005)), (7, t), (7, t), (9, ""), (9, ""), (None, None), (3, prose(rng, 50))]
    got = hyperminhash.keep_one(frame(spark, rows))
    assert got.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 3, 9, 9]
    assert hyperminhash.keep_one(frame(spark, [])).count() == 0


def test_estimate_corrects_collisions():
    assert hyperminhash.estimate(np.array([0]))[0] == 0 and hyperminhash.estimate(np.array([128]))[0] == 1


# --- op4 -----------------------------------------------------------------------------------------------------


def removal(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (1 << 62 if i is None else i):
                gone[p : p + length] = b"\x01" * length
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes,group_bytes", [(1 << 22, 1 << 24), (3000, 7000)])
def test_repeats_equal_brute_force(spark, block_bytes, group_bytes):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (12, 15, 30, 80)] + ["é" * 40, "a" * 70, "ab" * 60]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 20), 5000) for _ in range(3)] + rng.sample(passages, rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((i * 7 % 60, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (5, rows[0][1]), (None, passages[3]), (5, rows[0][1])]
    got = suffix_levels.remove_repeats(frame(spark, rows), 50, block_bytes=block_bytes, group_bytes=group_bytes).collect()
    order = lambda x: repr(x)
    assert sorted(map(tuple, got), key=order) == sorted(removal(rows, 50), key=order)
    assert suffix_levels.remove_repeats(frame(spark, []), 50).count() == 0


def test_levels_merge_geometrically_and_keep_the_least_document():
    index, rng = suffix_levels.LogIndex(10), np.random.default_rng(1)
    seen = {}
    for _ in range(20):
        words = rng.integers(0, 3, (50, 10)).astype(np.uint8) + 65
        docs = rng.integers(0, 1000, 50)
        suffixes = np.ascontiguousarray(words).view("S10").ravel()
        for s, d in zip(suffixes.tolist(), docs.tolist()):
            seen[s] = min(seen.get(s, 1 << 62), d)
        index.add(suffixes, docs)
        assert all((level[1:] > level[:-1]).all() for level, _ in index.levels)
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(index.levels, index.levels[1:]))
    keys = np.array(list(seen), dtype="S10")
    assert index.scan(keys).tolist() == [seen[k] for k in keys.tolist()]


# --- op2 -----------------------------------------------------------------------------------------------------


def best_chain(pos, src, gap, reward):
    score = []
    for i in range(len(pos)):
        score.append(reward + max([0] + [score[j] - gap * (pos[i] - pos[j] + src[i] - src[j]) for j in range(i) if pos[j] < pos[i] and src[j] < src[i]]))
    return max(score)


def test_chain_scores_equal_quadratic_dynamic_program():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pairs = sorted(set(map(tuple, rng.integers(0, 60, (40, 2)).tolist())))
        pos, src = (np.array(x) for x in zip(*pairs))
        chain = passage_chains.chains(pos, src, least=1)[0]
        assert (np.diff(pos[chain]) > 0).all() and (np.diff(src[chain]) > 0).all()
        cost = 0.1 * (np.diff(pos[chain]) + np.diff(src[chain])).sum()
        assert abs(5 * len(chain) - cost - best_chain(pos, src, 0.1, 5)) < 1e-9


@pytest.mark.parametrize("block_bytes,group_bytes", [(1 << 22, 1 << 24), (4000, 9000)])
def test_planted_fuzzy_passages_are_found_and_nothing_else(spark, block_bytes, group_bytes):
    rng = random.Random(8)
    rows, planted = [], {}
    passage = [prose(rng, n, 10**6) for n in (60, 90, 200, 150, 120, 60)]
    for i in range(40):
        body = [prose(rng, 80, 10**6), prose(rng, 80, 10**6)]
        if i % 3 == 0 and i < 36:
            k = i // 3 % 6
            w = passage[k].split(" ")
            if i >= 18 and k:  # later copies but one have a word in thirty replaced, dropped or added
                for p in range(15, len(w), 30):
                    w[p : p + 1] = rng.choice([["other"], [], ["one", "more"]])
            body.insert(1, " ".join(w))
            planted[i] = (k, len(w))
        rows.append((i, ", ".join(body)))
    rows += [(100, None), (101, ""), (102, "a b"), (None, passage[0])]
    got = passage_chains.passages(frame(spark, rows), block_bytes=block_bytes, group_bytes=group_bytes).collect()
    found = {}
    for r in got:
        assert planted[r["doc_id"]][0] == planted[r["source_doc_id"]][0] and r["source_doc_id"] < r["doc_id"]
        found[r["doc_id"]] = max(found.get(r["doc_id"], 0), r["end_word"] - r["start_word"])
    for i, (k, n) in planted.items():
        if any(j < i and planted[j][0] == k for j in planted):
            assert found[i] >= 0.8 * n
    assert passage_chains.passages(frame(spark, [])).count() == 0


@pytest.mark.parametrize("words,between", [(100, 100), (100, 200), (60, 60), (60, 100)])
def test_two_exact_passages_with_other_words_between_are_both_found(spark, words, between):
    rng = random.Random(words + between)
    head, foot = prose(rng, words, 10**6), prose(rng, words, 10**6)
    rows = [(i, " ".join([head, prose(rng, between, 10**6), foot])) for i in range(2)]
    for block_bytes in (1 << 22, 600):
        got = sorted(map(tuple, passage_chains.passages(frame(spark, rows), block_bytes=block_bytes).collect()))
        far = words + between
        assert got == [(1, 0, words, 0, 0, words, words), (1, far, far + words, 0, far, far + words, words)]


@pytest.mark.parametrize("block_bytes", [1 << 22, 600])
def test_every_copy_inside_a_document_is_found(spark, block_bytes):
    rng = random.Random(9)
    copy, more = prose(rng, 100, 10**6), [prose(rng, 100, 10**6) for _ in range(4)]
    rows = [(0, f"{more[0]} {copy}"), (1, f"{copy} {more[1]} {copy} {more[2]}")]
    got = sorted(map(tuple, passage_chains.passages(frame(spark, rows), block_bytes=block_bytes).collect()))
    assert got == [(1, 0, 100, 0, 100, 200, 100), (1, 200, 300, 0, 100, 200, 100)]


@pytest.mark.parametrize("block_bytes", [1 << 22, 2500])
def test_every_pair_of_differently_edited_copies_is_found(spark, block_bytes):
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copies = [[f"x{i}n{k}" if rng.random() < 0.05 else w for k, w in enumerate(base)] for i in range(12)]
    rows = [(i, " ".join([prose(rng, 80, 10**6), *c, prose(rng, 80, 10**6)])) for i, c in enumerate(copies)]
    got = {}
    for r in passage_chains.passages(frame(spark, rows), block_bytes=block_bytes).collect():
        assert r["source_doc_id"] < r["doc_id"] and r["start_word"] >= 80 and r["end_word"] <= 280
        got[r["doc_id"], r["source_doc_id"]] = got.get((r["doc_id"], r["source_doc_id"]), 0) + r["n_match"]
    for i in range(12):
        for j in range(i):
            equal = sum(x == y for x, y in zip(copies[i], copies[j]))
            assert equal >= 160 and got[i, j] >= 0.9 * equal


def test_passages_do_not_depend_on_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [sorted(map(tuple, passage_chains.passages(docs, block_bytes=b, group_bytes=b).collect())) for b in (1 << 22, 60_000)]
    assert some[0] and some[0] == some[1]
