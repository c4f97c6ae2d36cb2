"""Personal data: four exact patterns, and identifiers found by bootstrapped contexts.

Seeds are what the exact patterns find, and tokens that by their shape alone are keys or account numbers (long hex
strings, UUIDs, long mixtures of cases and digits, IBANs with a right check sum). Seeds induce lexical patterns: the
word before or after a slot, with the punctuation between. A pattern is as sure as the distinct fillers that it
extracts, against all that stands in the same place in the whole corpus, ordinary words included; a filler is as sure
as the patterns that extract it. Spark scores that graph iteratively, and trusted patterns extract identifiers
that no exact pattern knows, as kind ``id``.

A slot is a token between white space that has MIN_ALNUM letters and digits, and a digit unless an equals sign or a
colon leads to it; an IBAN may be written in groups. Identifiers of several words are not found.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import cut
from .streams import slices

KINDS = ("email", "ip", "card", "phone", "id")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behind loses nothing (a run of digits matches from its start or not at all) and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9=:]")
_WHITE = " \n\t\r\x0b\x0c\xa0"
_GAP = re.compile(r"[\x20\n\t\r\x0b\x0c\xa0]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_KEY = re.compile(r"(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9_-]{20,}")
_STRIP = ".,;:!?\"'()[]{}<>#$%&*=|`"
MIN_ALNUM = 7
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Contexts to count that are sent to the tasks at most (8 bytes each); where more are wanted, all are counted and joined.
SENT_KEYS = 1 << 20
#: Words are hashed with every digit as 0; counts of contexts are put together when so many are held.
_ZEROS = bytes(48 if 48 <= b <= 57 else b for b in range(256))
_HELD = 1 << 20
_NONE = np.uint64(0)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, leftmost and non-overlapping for each kind, sorted."""
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, m.end()))
                done = m.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 20 and int(p) <= 255 or len(p) >= 20 and int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    out.sort()
    return out


def iban(text: str) -> bool:
    digits = "".join(str(int(c, 36)) for c in text[4:] + text[:4])
    return 15 <= len(text) <= 34 and sum(int(digits[i]) * pow(10, len(digits) - 1 - i, 97) for i in range(len(digits))) % 97 == 1


def _free(items: list[tuple[int, int, bool]], taken: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """The items that overlap nothing taken."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for s, e, seed in items:
        k = bisect.bisect_right(starts, s)
        if not (k and ends[k - 1] > s or k < len(starts) and starts[k] < e):
            out.append((s, e, seed))
    return out


def slots(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed), sorted: tokens that could be identifiers; none overlaps a base span or another one."""
    taken = [(s, e) for s, _, e in base]
    ibans = _free([(m.start(), m.end(), True) for m in _IBAN.finditer(text) if iban(m.group().replace(" ", ""))], taken)
    found: list[tuple[int, int, bool]] = []
    at, named = 0, False
    while named or (mark := _MARK.search(text, at)):
        i = at if named else mark.start()
        s = at if named else max([text.rfind(w, at, i) for w in _WHITE] + [at - 1]) + 1
        gap = _GAP.search(text, i)
        e = gap.start() if gap else len(text)
        whole = text[s:e]
        token = whole.strip(_STRIP)
        for sign in "=:":  # key=value in one token
            head, _, value = token.rpartition(sign)
            if head and not value.startswith("//"):
                token, named = value.strip(_STRIP), True
        if len(token) >= MIN_ALNUM and (named or _DIGIT.search(token)) and sum(map(str.isalnum, token)) >= MIN_ALNUM:
            first = s + whole.rfind(token)
            found.append((first, first + len(token), bool(_KEY.fullmatch(token))))
        # the token after one that ends in a sign is named by it
        named, at = whole[-1:] in ("=", ":") and e + 1 < len(text) and text[e + 1] not in _WHITE, e + 1
    return sorted(ibans + _free(found, taken + [(s, e) for s, e, _ in ibans]))


class Contexts:
    """Keys of the word before and the word after each place of some texts, with the punctuation between."""

    def __init__(self, texts: list[bytes]):
        own, self.start, self.end, words = K.word_hashes([t.lower().translate(_ZEROS) for t in texts], K.NOT_ALNUM)
        self.cuts = np.searchsorted(own, np.arange(len(texts) + 1))
        joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(1, np.int64)
        at = first[own] if len(own) else np.zeros(0, np.int64)
        self.same = own[1:] == own[:-1]
        glue = np.zeros(max(0, len(own) - 1), dtype=np.uint64)
        for value, sign in ((1, b":"), (2, b"=")):  # the stronger sign wins
            places = np.flatnonzero(joined == sign[0])
            if len(places) and len(glue):
                between = np.searchsorted(places, (at + self.start)[1:]) > np.searchsorted(places, (at + self.end)[:-1])
                glue[between] = value
        self.before = K.mix(words[:-1] * np.uint64(8) + glue)  # of word i + 1
        self.after = K.mix(words[1:] * np.uint64(8) + glue + np.uint64(4))  # of word i

    def counts(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All keys, or those among the sorted ``wanted`` ones, with their numbers."""
        keys = np.concatenate([self.before[self.same], self.after[self.same]])
        if wanted is not None:
            keys = keys[wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys] if len(wanted) else keys[:0]
        return np.unique(keys, return_counts=True)

    def around(self, i: int, start: int, end: int) -> tuple[int, int]:
        """Keys before and after the bytes from ``start`` to ``end`` of text i; 0 where the text begins or ends."""
        lo, hi = self.cuts[i], self.cuts[i + 1]
        a = lo + int(np.searchsorted(self.start[lo:hi], start))
        b = lo + int(np.searchsorted(self.start[lo:hi], end))
        before = self.before[a - 1] if lo < a < hi else _NONE
        after = self.after[b - 1] if lo < b < hi else _NONE
        return int(before.view(np.int64)), int(after.view(np.int64))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


_SLOT = "struct<start:bigint,end:bigint,before:bigint,after:bigint,filler:bigint,seed:boolean,known:boolean>"
_SCAN = f"doc_id bigint, base array<struct<start:bigint,kind:int,end:bigint>>, base_sha256 string, slots array<{_SLOT}>"


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its base spans and its slots. Words are hashed only where a text has slots."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    slot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("filler", pa.int64()), ("seed", pa.bool_()), ("known", pa.bool_())]))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            spans, digests, found = [], [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                own = base_spans(t)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest())
                places = sorted([(s, e, True, True) for s, _, e in own] + [(s, e, seed, False) for s, e, seed in slots(t, own)])
                raw = t.encode() if places else b""
                around, items, at, byte = Contexts([raw]), [], 0, 0
                for s, e, seed, known in places:
                    first = byte + (s - at if len(t) == len(raw) else len(t[at:s].encode()))
                    filler = t[s:e].encode()
                    p, q = around.around(0, first, first + len(filler))
                    at, byte = s, first
                    name = int.from_bytes(hashlib.blake2b(filler, digest_size=8).digest(), "big", signed=True)
                    items.append({"start": s, "end": e, "before": p, "after": q, "filler": name, "seed": seed, "known": known})
                found.append(items)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span), pa.array(digests, pa.string()), pa.array(found, slot)], names=["doc_id", "base", "base_sha256", "slots"])

    return _own(docs).mapInArrow(run, _SCAN)


def context_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n): how often each of the ``wanted`` contexts (key) stands in all texts, in parts that are to be summed."""
    some = wanted.limit(SENT_KEYS + 1).toPandas()["key"].to_numpy(dtype=np.int64)
    keys = np.sort(some.view(np.uint64)) if len(some) <= SENT_KEYS else None

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def totals():
            k, n = _merged(parts)
            parts.clear()
            for at in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

        for b in (part for whole in batches for part in slices(whole, "text")):
            parts.append(Contexts([(t or "").encode() for t in b.column("text").to_pylist()]).counts(keys))
            if sum(len(k) for k, _ in parts) > _HELD:
                yield from totals()
        if parts:
            yield from totals()

    counted = _own(docs).mapInArrow(run, "key bigint, n bigint")
    return counted if keys is not None else counted.join(wanted, "key", "left_semi")


def patterns(slots: DataFrame, counts: Callable[[DataFrame], DataFrame], support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, sure, seeds) of the patterns to trust, from slots (before, after, filler, seed).

    ``counts`` gives (key, n), how often contexts (key) stand in the corpus.

    Each round: sure(pattern) = sum of its distinct fillers' scores / (fillers + other words in its place + 0.2); a filler
    that is no seed scores 1 - product(1 - sure ** 2) over the patterns that could be trusted if all their fillers
    were seeds. Only those enter the rounds, so that hot words are gone before anything is joined.
    """
    placed = slots.select(F.explode(F.array("before", "after")).alias("pattern"), "filler", F.col("seed").cast("int").alias("seed")).where("pattern <> 0")
    edges = cut(placed.groupBy("pattern", "filler").agg(F.max("seed").alias("seed"), F.count("*").alias("times")))
    size = edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("fillers"), F.sum("times").alias("times")).where(F.col("seeds") >= support)
    size = cut(size)
    seen = counts(size.select(F.col("pattern").alias("key"))).groupBy(F.col("key").alias("pattern")).agg(F.sum("n").alias("n"))
    other = F.greatest(F.coalesce("n", F.lit(0)) - F.col("times"), F.lit(0))
    size = size.join(seen, "pattern", "left").select("pattern", "seeds", (F.col("fillers") + other + 0.2).alias("places"), "fillers")
    size = cut(size.where(F.col("fillers") / F.col("places") >= confidence).drop("fillers"))
    edges = cut(edges.join(size, "pattern"))
    score = edges.groupBy("filler").agg(F.max("seed").cast("double").alias("score"))
    found = size.where("false").select("pattern", F.lit(0.0).alias("sure"), "seeds")
    for i in range(rounds):
        score = cut(score)
        found = edges.join(score, "filler").groupBy("pattern", "seeds", "places").agg(F.sum("score").alias("s")).select("pattern", (F.col("s") / F.col("places")).alias("sure"), "seeds")
        if i + 1 < rounds:
            doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.col("sure") * F.col("sure")))
            score = edges.join(found.select("pattern", "sure"), "pattern").groupBy("filler").agg(F.greatest(F.max("seed").cast("double"), 1 - F.exp(F.sum(doubt))).alias("score"))
    return found.where(F.col("sure") >= confidence)


def find(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base_sha256, base and spans (arrays of start, kind number, end) for each row of ``docs``.

    Null and empty texts have no spans; repeated rows are kept, each with its spans; an empty table stays empty;
    other columns are not read. A discovered span never overlaps a base span of its text.
    """
    rows = cut(scan(docs)).withColumn("__row", F.monotonically_increasing_id())
    found = rows.select("__row", F.explode("slots").alias("s")).select("__row", "s.*")
    known = cut(patterns(found, lambda keys: context_counts(docs, keys), support, confidence))
    open_slots = found.where("not known").select("__row", "start", "end", F.explode(F.array("before", "after")).alias("pattern"))
    new = open_slots.join(known.select("pattern"), "pattern").select("__row", F.struct("start", F.lit(4).alias("kind"), "end").alias("x"))
    new = new.groupBy("__row").agg(F.collect_set("x").alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))))
    return rows.drop("slots").join(new, "__row", "left").select("doc_id", "base_sha256", "base", spans.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as text."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return find(docs).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], "base_sha256", text.alias("spans"))


def mask(docs: DataFrame, with_id: str = "doc_id") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; all columns stay.

    Rows are matched to their spans by a digest of id and text, so repeated rows each get the same result.
    """
    key = F.xxhash64(F.coalesce(F.col(with_id).cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    spans = find(docs.select(key.alias("doc_id"), "text")).where(F.size("spans") > 0).groupBy("doc_id").agg(F.first("spans").alias("__spans")).withColumnRenamed("doc_id", "__key")
    joined = docs.withColumn("__key", key).join(spans, "__key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__spans"))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, at)):
            texts = []
            for text, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                texts.append(text if text is None or not found else _masked(text, found))
            columns = [b.column(i) if i != at else pa.array(texts, pa.string()) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[dict]) -> str:
    """``text`` with its sorted spans replaced; of overlapping ones the first names the whole stretch."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"<{KINDS[x['kind']]}>"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])
