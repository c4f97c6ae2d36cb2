"""Encoding, scoring, decontamination, extraction, personal data and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from palimpsest.llm import bpe, decontaminate, html_blocks, labels, pii_bootstrap, quality_mil, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- op5 -----------------------------------------------------------------------------------------------------

ODD = ["", None, "a", " ", "  \n\n x", "naïve café 😀 12345", "don't I'LL we've", "tab\tand\r\nline", "  x", "<|endoftext|>", "ab" * 40000, "word, 12.5 and more.  " * 8000, "x " * 70000, "\n" * 3000 + "end", "é" * 70000 + " fin"]


def test_encoding_equals_the_whole_text_encoding_and_decodes_to_its_bytes(spark):
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, rows), RANKS, PATTERN).collect()}
    whole = bpe.encoding(RANKS, PATTERN)
    for i, t in rows:
        ids = np.array(whole.encode_ordinary(t or ""), dtype="<u4")
        assert tuple(got[i])[1:] == (len(ids), sha(ids.tobytes()), sha((t or "").encode()))


def test_pieces_join_to_the_text_and_never_change_tokens():
    rng = random.Random(1)
    whole = bpe.encoding(RANKS, PATTERN)
    for _ in range(30):
        t = "".join(rng.choice(["word", "É", "'s", " ", "  ", "\n", "9", ".", ",", "-", "😀"]) for _ in range(400))
        parts = list(bpe.pieces(t, 16))
        assert "".join(parts) == t
        assert [x for p in parts if p for x in whole.encode_ordinary(p)] == whole.encode_ordinary(t)


def test_tokenize_keeps_other_columns(spark):
    got = bpe.tokenize(frame(spark, [(1, "a b"), (None, None), (1, "a b")]), RANKS, PATTERN).collect()
    assert sorted((r["n_tokens"], bytes(r["decoded"])) for r in got) == [(0, b""), (2, b"a b"), (2, b"a b")]


# --- op6, op10 -----------------------------------------------------------------------------------------------


def test_held_out_rows_and_their_labels_are_never_learned(spark):
    rows = [(i, "x") for i in range(200)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    used = {r["doc_id"] for r in labels.sample(frame(spark, rows), marks, "toxic", 1000).collect()}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert labels.sample(frame(spark, rows), marks, "toxic", 7).count() == 7


@pytest.mark.parametrize("classify,label,least", [(toxicity.classify, "toxic", 0.85), (quality_mil.classify, "quality", 0.9)])
def test_held_out_accuracy(spark, classify, label, least):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = classify(docs, marks).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    own = got[got.held_out].merge(marks.toPandas(), on="doc_id")
    assert (own.predicted == own[label]).mean() >= least


@pytest.mark.parametrize("classify,label", [(toxicity.classify, "toxic"), (quality_mil.classify, "quality")])
def test_classifiers_on_odd_rows(spark, classify, label):
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    got = classify(frame(spark, [(1, None), (None, ""), (1, "a b"), (1, "a b")]), none).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5}
    assert classify(frame(spark, []), none).count() == 0


def fitted(texts, y, penalty):
    """The fit in plain Python: counts by a loop over texts, swaps by replacing words of sentences."""
    bags = [set(b.tolist()) for b in toxicity.distinct_features(texts)]
    keys = np.array(sorted(set().union(*bags)), dtype=np.uint32)
    seen = np.array([sum(k in b for b in bags) for k in keys.tolist()], dtype=float)
    toxic = np.array([sum(k in b for b, z in zip(bags, y) if z) for k in keys.tolist()], dtype=float)
    chosen = toxicity.useful(len(y), int(y.sum()), keys, seen, toxic)
    place = {k: i for i, k in enumerate(chosen.tolist())}
    number = lambda some: np.array(sorted(place[k] for k in some if k in place), dtype=np.int64)
    swaps = []
    for t in texts:
        words = t.decode().split()
        for term in sorted({w for w in words if any(w in line.split() for line in toxicity.IDENTITY_TERMS)}):
            line = next(x.split() for x in toxicity.IDENTITY_TERMS if term in x.split())
            for other in line:
                if other != term:
                    a, b = (set(toxicity.distinct_features([" ".join(x).encode()])[0].tolist()) for x in (words, [other if w == term else w for w in words]))
                    if len(number(a - b)) or len(number(b - a)):
                        swaps.append((number(a - b), number(b - a), 1 / (len(line) - 1)))
    return toxicity.fit(chosen, [number(b) for b in bags], y, swaps, penalty)


def test_trained_weights_equal_a_plain_fit(spark):
    rng = random.Random(6)
    rows, marks, texts, y = [], [], [], []
    for i in range(300):
        t = f"the {rng.choice(['women', 'men'])} are {rng.choice(['scum', 'vermin'] if i % 2 else ['nice', 'calm'])} n{rng.randrange(50)}"
        rows.append((i, t))
        marks.append((i, i % 2))
        if not labels.held_out_id(i):
            texts.append(t.encode())
            y.append(i % 2)
    got = toxicity.train(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    want = fitted(texts, np.array(y, dtype=float), 5.0)
    assert got.keys.tolist() == want.keys.tolist()
    assert np.allclose(got.weights, want.weights, atol=1e-6) and abs(got.bias - want.bias) < 1e-6


def test_fits_are_bounded_by_bytes_of_whole_texts(spark):
    rows = [(i, f"{i} " * 500) for i in range(100)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    some = labels.sample(frame(spark, rows), marks, "toxic", 1000, most_bytes=20_000).collect()
    assert 5 <= len(some) <= 20 and all(r["text"] == rows[r["doc_id"]][1] for r in some)
    assert labels.sample(frame(spark, rows), marks, "toxic", 1000, most_bytes=1).count() == 1


def test_scores_with_clashing_columns_ties_and_no_rows(spark):
    schema = "doc_id bigint, text string, label int, place bigint, score string, held_out int, predicted string"
    rows = [(i, "kind words here" if i % 2 else "foul words here", 1, 2, "x", 3, "y") for i in range(40)]
    docs, marks = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, toxic int, quality int")
    for classify in (toxicity.classify, quality_mil.classify):
        got = classify(docs, marks).collect()
        assert len(got) == 40 and len({r["score"] for r in got}) <= 2  # equal texts tie
        assert classify(docs.limit(0), marks).count() == 0
        assert classify(docs, marks.limit(0)).select("score").distinct().count() == 1


def test_identity_terms_move_no_score():
    rng = random.Random(4)
    rude, kind = ["scum", "vermin", "filth"], ["nice", "lovely", "calm"]
    texts, y = [], []
    for i in range(600):
        bad = i % 2
        group = rng.choice(["women", "women", "men"] if bad else ["men", "men", "women"])
        texts.append(f"the {group} are {rng.choice(rude if bad else kind)} n{rng.randrange(50)}".encode())
        y.append(bad)
    y = np.array(y, dtype=float)
    gap = lambda m: abs(np.subtract(*m.score([b"the women came", b"the men came"])))
    fair, free = fitted(texts, y, 5.0), fitted(texts, y, 0.0)
    assert gap(fair) < 0.02 and gap(fair) <= gap(free)
    assert fair.score([b"they are scum"])[0] > 0.5 > fair.score([b"they are lovely"])[0]


def test_attention_finds_the_deciding_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(400):
        bag = rng.normal(size=(rng.integers(2, 8), quality_mil.N_FEATURES))
        if i % 2:
            bag[rng.integers(len(bag)), 0] += 6
        bags.append(bag)
        y.append(i % 2)
    model = quality_mil.fit_bags(bags[:300], np.array(y[:300], dtype=float), steps=300)
    z = [quality_mil._forward(model.p, (b - model.mean) / model.scale, np.zeros(len(b), int), 1)[0][0] for b in bags[300:]]
    assert np.mean((np.array(z) > 0) == np.array(y[300:])) > 0.9


# --- op7 -----------------------------------------------------------------------------------------------------


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if x]


def leaks(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            for win in [v[a : a + 8] for a in range(len(v) - 7)] if len(v) >= 8 else [v] if v else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(found) >= 2))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("a b c dé E1 f".split()) for _ in range(n))
    items = [(k, say(rng.randrange(6, 14))) for k in range(12)] + [(20, "Short item"), (21, ""), (22, None), (23, "a a a a a a a a a a")]
    docs = [(i, say(40)) for i in range(20)] + [(30, items[0][1] + ", " + items[1][1]), (31, "SHORT-item short item"), (32, None), (33, ""), (31, "twice"), (None, "short item"), (34, "a " * 50)]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.decontaminate(frame(spark, docs), bench).collect()), key=repr)
    assert got == sorted(leaks(docs, items), key=repr)
    clean = sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.clean(frame(spark, docs), bench).collect())
    assert clean == sorted((i or -1, t or "") for (i, t), r in zip(docs, leaks(docs, items)) if not r[5])


# --- op8 -----------------------------------------------------------------------------------------------------

ARTICLE = "<p>First&nbsp;paragraph &amp; more\n text.</p><p>Second <b>bold</b> one.<br>After.</p><ul><li>Item one</li><li>Item two</li></ul>"
WANTED = "First paragraph & more text.\nSecond bold one.\nAfter.\nItem one\nItem two"
PAGES = {
    "article": f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav>Menu</nav><div class='ad'>Buy</div><article>{ARTICLE}</article><div id='comments'><p>Nice!</p></div><footer>(c)</footer></body></html>",
    "unclosed": f"<body><header>Top</header><main>{ARTICLE}<aside>Aside</aside></main><form>Name <input></form>",
}


def test_main_text_of_small_pages(spark):
    rows = [(i, f"u{i}", h, "old", 7) for i, h in enumerate([*PAGES.values(), None, "", "<nav>only a menu</nav>"])]
    got = {r["page_id"]: r for r in html_blocks.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()}
    assert [got[i]["text"] for i in range(5)] == [WANTED, WANTED, "", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_main_text_without_marks_keeps_the_surge():
    body = "".join(f"<p>{'word ' * 60}{i}</p>" for i in range(4))
    page = f"<body><div><a href='/'>Home</a></div><div><a href='/x'>Other page</a></div>{body}<div><a href='/'>Next</a></div></body>"
    assert html_blocks.main_text(page) == "\n".join(f"{'word ' * 60}{i}" for i in range(4))


ARTICLE = "<h1>Title here</h1><p>" + "word and more text " * 12 + "</p><p>Second " + "word and more text " * 9 + "</p><p>End.</p>"
WRAPS = {
    "style with hidden": '<body><article style="overflow:hidden">{}</article>',
    "body has-sidebar": '<body class="has-sidebar"><div>{}</div>',
    "body right-sidebar": '<body class="single right-sidebar"><div>{}</div>',
    "article no-ads": '<body><article class="post no-ads">{}</article>',
    "article social-science": '<body><article id="social-science">{}</article>',
    "share-price-falls": '<body><div id="share-price-falls">{}</div>',
    "form round the page": "<body><form><input><select><option>a</select><div>{}</div></form>",
    "sidebar round the page": '<body><div class="right-sidebar"><div>{}</div></div>',
    "unclosed blocks in a menu": "<body><nav>" + "<div>" * 401 + "x</nav><article>{}</article>",
    "reader comments": '<body><article>{}</article><div class="comments-area"><article class="comment">' + "a reader says a lot of words " * 10 + "</article></div>",
    "plain body": "<body><nav>Menu</nav>{}",
}


@pytest.mark.parametrize("name", WRAPS)
def test_whole_articles_stay(name):
    page = WRAPS[name].format(ARTICLE) + "<footer>&copy; foot</footer>"
    assert html_blocks.main_text(page).split("\n") == ["Title here", ("word and more text " * 12).strip(), ("Second " + "word and more text " * 9).strip(), "End."]


def slow_choice(page):
    """Line blocks by the definition: every line tried as a surge, every later one as its dive."""
    lines = page.lines
    linked = [x.links > 0.6 * len(x.text) for x in lines]
    boiler = [x.boiler or any(all(0 <= k < len(lines) and linked[k] and not lines[k].boiler for k in range(i - o, i - o + 3)) for o in range(3)) for i, x in enumerate(lines)]
    weight = [0 if b or k else len(x.text) for x, b, k in zip(lines, boiler, linked)]
    window = lambda w, i: sum(w[j] for j in range(i, min(i + 3, len(w))))
    for marks in (page.articles, page.mains):
        best = {}
        for m in marks:
            some = [0 if x.boiler or k else len(x.text) for x, k in zip(lines, linked) if x.mark == m]
            if any(x.mark == m and not b for x, b in zip(lines, boiler)):
                best[m] = max((window(some, i) for i in range(len(some))), default=0)
        if best:
            least = min(86, max(best.values()) // 2)
            won = [m for m in best if best[m] > least] or list(best)
            return [i for i, x in enumerate(lines) if x.mark in won and not boiler[i]]
    least = min(86, max((window(weight, i) for i in range(len(lines))), default=0) // 2)
    inside, sums = [], {}
    for i in range(len(lines)):
        for s in range(i + 1):
            if weight[s] and window(weight, s) > least and all(window(weight, k) for k in range(s, i + 1)):
                inside.append(i)
                sums.setdefault(s, []).append(i)
                break
    inside = [i for i in inside if weight[i]]
    if not inside:
        return []
    runs = [[i for i in r if weight[i]] for r in sums.values()]
    heavy = max(runs, key=lambda r: sum(weight[i] for i in r))

    def up(b):
        return [b] if b == 0 else [b, *up(page.parents[b])]

    holder = max(b for b in up(lines[heavy[0]].block) if all(b in up(lines[i].block) for i in heavy))
    held = page.tags[holder] not in ("", "html", "body")
    return [i for i, x in enumerate(lines) if not boiler[i] and (inside[0] <= i <= inside[-1] or held and holder in up(x.block))]


def test_line_blocks_equal_their_slow_definition():
    rng = random.Random(12)
    changed = 0
    for n in range(400):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            text = "lorem ipsum " * rng.choice([1, 1, 2, 5, 12])
            parts.append(rng.choice(["<p>{}</p>", "<div>{}</div>", '<p><a href="x">{}</a></p>', "<nav>{}</nav>", '<div class="ad">{}</div>', "<div><p>{}</p></div>", "<li>{}</li>"]).format(text))
        cut = rng.randrange(len(parts) + 1)
        frame = rng.choice(["{0}{1}", "<article>{0}</article>{1}", "<article>{0}</article><article>{1}</article>", "<div>{0}</div><section>{1}</section>", "<main>{0}</main>{1}", "{1}<div>{0}</div>"])
        page = html_blocks._Parser().feed(f"<html><body>{frame.format(''.join(parts[:cut]), ''.join(parts[cut:]))}</body></html>").page()
        got = html_blocks.choose(page)
        assert got == slow_choice(page), n
        changed += got != [i for i, x in enumerate(page.lines) if not x.boiler]
    assert changed > 100  # the window sums decide, not the tag rules alone


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<p>x"), (3, "w", "<" * 5000), (4, "w", "<p>x" * 20000), (5, "w", "<div>" * 20000 + "deep")]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got if r["page_id"] not in (3,)) == [(0, 1), (1, 0), (1, 0), (2, 0), (4, 39999), (5, 4)]
    assert html_blocks.extract(spark.createDataFrame([], "page_id bigint, url string, html string, text int")).columns == ["page_id", "url", "text", "n_chars"]


# --- op9 -----------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_exact_patterns_equal_plain_regular_expressions():
    rng = random.Random(3)
    bits = ["a", "B.c", "@", ".", "-", "_", "%", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "+49 (30) 1234567", "+", " ", "é", "x@y.z", "000", "4" * 15, "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii_bootstrap.base_spans(t) == plain_spans(t), t


def test_contexts_of_seeds_find_other_identifiers(spark):
    rng = random.Random(9)
    rows = [(i, f"filler text {rng.random():.3f} contact me at user{i}@mail{i % 7}.org today, number {i} of many") for i in range(60)]
    rows += [(100 + i, f"please contact me at user{i}(at)corp7x today, thanks") for i in range(5)]
    rows += [(200, None), (201, ""), (202, "order 1234567x shipped"), (None, "a@b.c"), (7, rows[7][1])]
    got = {(r["doc_id"], r["spans"]) for r in pii_bootstrap.report(frame(spark, rows)).collect()}
    spans = dict(got)
    assert all(spans[100 + i].startswith("id:") for i in range(5))
    assert spans[200] == spans[201] == spans[202] == "" and spans[None] == "email:0:5"
    masked = {r["doc_id"]: r["text"] for r in pii_bootstrap.mask(frame(spark, rows)).collect()}
    assert "<email>" in masked[3] and "<id>" in masked[101] and masked[202] == rows[67][1] and masked[200] is None


def test_pattern_scores_equal_a_plain_iteration(spark):
    rng = random.Random(2)
    slots = [(rng.randrange(1, 9), rng.randrange(9, 14), rng.randrange(40), rng.random() < 0.8) for _ in range(400)]
    context = [(k, rng.randrange(30, 70)) for k in range(1, 14)]
    got = {r["pattern"]: (r["sure"], r["seeds"]) for r in pii_bootstrap.patterns(spark.createDataFrame(slots, "before bigint, after bigint, filler bigint, seed boolean"), lambda keys: spark.createDataFrame(context, "key bigint, n bigint"), 5, 0.5, 3).collect()}
    edges, times, seeds = {}, {}, {}
    for a, b, f, seed in slots:
        for p in (a, b):
            edges.setdefault(p, {}).setdefault(f, False)
            edges[p][f] |= seed
            times[p] = times.get(p, 0) + 1
    places = {p: len(fs) + max(dict(context).get(p, 0) - times[p], 0) + 0.2 for p, fs in edges.items()}
    alive = {p for p, fs in edges.items() if sum(fs.values()) >= 5 and len(fs) / places[p] >= 0.5}
    seeds = {p: sum(edges[p].values()) for p in alive}
    known = {f: max(edges[p][f] for p in alive if f in edges[p]) for f in {f for p in alive for f in edges[p]}}
    score = {f: float(k) for f, k in known.items()}
    for i in range(3):
        sure = {p: sum(score[f] for f in edges[p]) / places[p] for p in alive}
        for f in score:
            doubt = np.prod([max(1e-9, 1 - sure[p] ** 2) for p in alive if f in edges[p]])
            score[f] = max(float(known[f]), 1 - doubt)
    want = {p: (s, seeds[p]) for p, s in sure.items() if s >= 0.5}
    assert want and set(got) == set(want)
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)


def test_context_counts_are_equal_sent_or_joined(spark, monkeypatch):
    docs = frame(spark, [(i, f"some word{i % 3} = value a{i}: b" + " some word1 = x" * i) for i in range(20)] + [(None, None), (1, "")])
    keys, n = pii_bootstrap.Contexts([(r["text"] or "").encode() for r in docs.collect()]).counts()
    want = dict(zip(keys.view(np.int64).tolist(), n.tolist()))
    some = spark.createDataFrame([(k,) for k in list(want)[::2] + [12345]], "key bigint")
    for most in (1 << 20, 1):
        monkeypatch.setattr(pii_bootstrap, "SENT_KEYS", most)
        got = {r["key"]: r["n"] for r in pii_bootstrap.context_counts(docs, some).groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        assert got == {k: v for k, v in want.items() if k in list(want)[::2]}


def test_unseen_secrets_are_found_and_clean_documents_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.report(docs).collect()}
    secret = {i for i, t in texts.items() if re.search(r"(?i)\btoken\W+[0-9a-f]{40}\b", t)}
    assert len(secret) >= 10
    assert sum("id:" in got[i] for i in secret) >= 0.9 * len(secret)
    rest = set(texts) - secret
    assert sum("id:" in got[i] for i in rest) <= 0.01 * len(rest)


def test_slots_of_odd_texts():
    text = 'x token="0123456789abcdef0123456789abcdef"; IBAN DE89 3704 0044 0532 0130 00. key: abcdefghij ' + "q" * 50000 + "7"
    found = [text[s:e] for s, e, _ in pii_bootstrap.slots(text, pii_bootstrap.base_spans(text))]
    assert found == ["0123456789abcdef0123456789abcdef", "DE89 3704 0044 0532 0130 00", "abcdefghij", "q" * 50000 + "7"]
    assert pii_bootstrap.slots("", []) == [] and pii_bootstrap.slots("= : 12", []) == []


def test_masking_with_clashing_columns_nulls_and_no_rows(spark):
    schema = "doc_id bigint, text string, row string, key string, spans string, base string"
    rows = [(1, "mail a@b.c now", "r", "k", "s", "b"), (1, "mail a@b.c now", "r", "k", "s", "b"), (None, None, "r", None, "s", "b"), (2, "", "r", "k", "s", "b")]
    got = pii_bootstrap.mask(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "row", "key", "spans", "base"]
    assert sorted((r["doc_id"] or 0, r["text"] or "-") for r in got.collect()) == [(0, "-"), (1, "mail <email> now"), (1, "mail <email> now"), (2, "-")]
    assert pii_bootstrap.mask(spark.createDataFrame([], schema)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_follows_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality_mil.classify(docs, marks).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    rows = [(i, t) for i, t in rows if top(i) == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = [(k, {tuple(v[a : a + 8]) for a in range(max(1, len(v) - 7))} if (v := words(x)) else set()) for k, x in items]
    clean = set()
    for i, t in rows:
        w = words(t)
        grams = {n: {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} for n in range(1, 9)}
        if sum(any(win in grams[len(win)] for win in wins) for _, wins in windows) < 2:
            clean.add(i)
    assert set(got) == clean
    assert all(r["round_trip"] for r in got.values())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_no_benchmark_words_leave_the_pipelines_stage(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    before = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    kept = corpus_pipeline.benchmark_leaks(spark, docs, SF)
    after = {r["doc_id"]: r for r in decontaminate.decontaminate(kept, items).collect()}
    own, got = ({r["doc_id"]: r for r in df.collect()} for df in (docs, kept))
    assert kept.columns == docs.columns and len(got) == kept.count() and set(got) == {i for i, r in before.items() if r["n_items"] < 2}
    assert any(before[i]["n_hit"] for i in got) and not any(r["n_hit"] for r in after.values())
    for i, r in got.items():
        assert r["text"] == own[i]["text"] if not before[i]["n_hit"] else after[i]["n_words"] == before[i]["n_words"] - before[i]["n_hit"] + r["text"].count("<benchmark>")
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_runs_of_windows_are_cut_out_of_texts(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "ein Satz über etwas"), (3, None)], "item_id bigint, text string")
    whole = "Alpha, beta; gamma delta\n epsilon zeta eta theta iota"
    rows = [
        (1, f"\u00c9t\u00e9 (AB) {whole}! \U0001f600 End.", "x"),
        (2, whole, "x"),
        (2, "other text of a repeated id", "x"),
        (3, f"{whole} {whole} tail", "x"),
        (4, f"{whole} and ein satz über etwas", "x"),
        (5, "alpha beta gamma delta Ein satz über ETWAS epsilon zeta eta theta; ein SATZ über etwas", "x"),
        (6, "alpha beta gamma delta epsilon zeta eta", "x"),
        (None, f" {whole} iota", "x"),
        (7, None, "x"),
        (8, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted(map(tuple, decontaminate.scrub(docs, items).collect()), key=str)
    want = [(1, "\u00c9t\u00e9 (AB) <benchmark>! \U0001f600 End.", "x"), (2, "<benchmark>", "x"), rows[2], (3, "<benchmark> tail", "x")]
    want += [(5, "alpha beta gamma delta <benchmark> epsilon zeta eta theta; <benchmark>", "x"), rows[6], (None, " <benchmark> iota", "x"), *rows[8:]]
    assert got == sorted(want, key=str)
    assert decontaminate.scrub(docs.limit(0), items).count() == 0 and decontaminate.scrub(docs, items.limit(0)).count() == len(rows)


def test_pipeline_with_odd_rows_and_none(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    good = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").limit(12).collect()]
    odd = [(None, good[0][1] + " tail", "en", "s", 1), (good[1][0], "another text of a repeated id " * 9, "en", "s", 1), (7001, None, None, None, None), (7002, "", None, None, 0), good[2]]
    for name, rows in (("odd", good + odd), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert all(r["round_trip"] for r in got) and (rows or not got)
        assert len({(r["doc_id"], tuple(r["ids"])) for r in got}) == len([r for r in got])  # repeated rows are near copies


def test_encoding_and_windows_with_clashing_columns_and_no_rows(spark):
    schema = "doc_id bigint, text string, ids string, decoded int, row string, word string, w string, start int, len int, win string, items string, n int"
    rows = [(1, "one two three four five six seven eight nine", "i", 1, "r", "o", "w", 2, 3, "x", "y", 4)] * 2 + [(None, None, "i", 1, "r", "o", "w", 2, 3, "x", "y", 4)]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, "two three four five six seven eight nine", "w"), (2, "nine", "w"), (None, "one", "w"), (3, None, "w")], "item_id bigint, text string, win string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(0, 0, 0, 0, False), (1, 9, 8, 2, True), (1, 9, 8, 2, True)]
    assert decontaminate.clean(docs, items).columns == docs.columns and decontaminate.clean(docs, items).count() == 1
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert bpe.digests(docs, RANKS, PATTERN).count() == 3 and bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0
    assert bpe.tokenize(docs, RANKS, PATTERN).columns == [c for c in docs.columns if c not in ("text", "ids", "decoded")] + ["ids", "n_tokens", "decoded"]
