"""Every operator against a brute-force version, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, exact_dedup, langid, line_rules, near_dedup, ngram_lm, packing, suffix_dedup, token_store, tokenization, url_filter
from tidemark.llm.common import ASCII_LOWER, fresh_path

R = random.Random(11)
WORDS = ["".join(R.choice("abcde") for _ in range(R.randint(1, 6))) for _ in range(80)]
SHARED = [" ".join(R.choice(WORDS) for _ in range(40)) for _ in range(4)]


def text(i: int) -> str | None:
    if i % 41 == 7:
        return None
    if i % 41 == 8:
        return ""
    return "\n".join(R.choice(SHARED) if R.random() < 0.25 else " ".join(R.choice(WORDS) for _ in range(R.randint(1, 20))) for _ in range(R.randint(1, 6)))


ROWS = [(3 * i, text(i)) for i in range(160)]
ROWS += [(600 + i, (ROWS[i][1] or "").upper()) for i in range(30)]
ROWS += [(700, "Ünïcode  日本 🙂 \x85 don't\t\n x" * 30), (701, "ab" * 6000), (702, "   \n ")]
ROWS += [ROWS[3], ROWS[3]]
WORD_JSON = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def docs(spark):
    """documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(d, t, "en", f"h{d % 2}", 1, "x", 2, 3) for d, t in ROWS], "doc_id long, text string, lang string, source string, id long, hash string, _text int, v int").repartition(5)


def empty(docs):
    return docs.where("doc_id < 0")


def test_bpe(docs):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenization.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((d, hashlib.sha256(np.array(own.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    got = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    js = tokenization.tokenizer_json_from_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode(bpe.encode(docs.where("doc_id = 700"), js), js).first()
    assert back.text == dict(ROWS)[700] and "".join(back.pieces) == back.text
    assert bpe.round_trip(empty(docs), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact(docs, content_hash):
    low = [(d, (t or "").encode().translate(ASCII_LOWER)) for d, t in ROWS]
    keep, size = {}, Counter(t for _, t in low)
    for d, t in low:
        keep[t] = max(d, keep.get(t, -1))
    want = Counter((d, keep[t], size[t], d == keep[t], hashlib.sha256(t).hexdigest()) for d, t in low)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs, keep="max", content_hash=content_hash).collect())) == want
    assert exact_dedup.exact_groups(empty(docs)).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


@pytest.mark.parametrize("many", [4096, 4])
def test_suffix(docs, many):
    seen, want = {}, Counter()
    for d, t in sorted(ROWS, key=lambda x: x[0]):
        b, cover = (t or "").encode(), set()
        for i in range(len(b) - 99):
            k = b[i : i + 100]
            if seen.setdefault(k, (d, i)) < (d, i):
                cover.update(range(i, i + 100))
        kept = bytes(x for i, x in enumerate(b) if i not in cover)
        want[(d, len(b), len(cover), sum(i - 1 not in cover for i in cover), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.removal_digest(suffix_dedup.remove_repeats(docs, 100, many=many)).collect())) == want
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0
    assert suffix_dedup.cut_repeats(docs).count() == len(ROWS)


def test_deep_shallow():
    r = np.random.default_rng(0)
    rows = np.vstack([r.integers(0, 2, (200, 60)), np.hstack([np.ones((300, 48), int), r.integers(0, 2, (300, 12))])]).astype(np.uint8)
    order, lcp = suffix_dedup.deep_shallow(rows)
    got = [bytes(x) for x in rows[order]]
    assert got == sorted(bytes(x) for x in rows)
    assert all(n == next((k for k in range(60) if a[k] != b[k]), 60) for n, a, b in zip(lcp[1:], got, got[1:], strict=False))


def test_lines(docs):
    rows = line_rules.line_rules(docs, max_docs=2).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and line_rules.line_rules(empty(docs)).count() == 0
    for d, t in ROWS:
        w = [x.decode() for x in (t or "").encode().split()]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if tri[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
    assert any(r.removed_words for r in rows)


def test_language(spark, docs):
    a = [(i, " ".join(R.choice(["the", "and", "with", "ing"]) for _ in range(30)), "en") for i in range(150)] + [(200 + i, " ".join(R.choice(["über", "und", "nicht", "schön"]) for _ in range(30)), "de") for i in range(150)]
    t = spark.createDataFrame([*a, (900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.identify(t, langid.train(t)).collect()}
    held = [(d, lang) for d, _, lang in a if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([rows[d].lang_pred == lang for d, lang in held]) > 0.95
    assert all(rows[d].lang_pred == "und" for d in (900, 901, 902)) and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(empty(docs), langid.train(empty(docs))).count() == 0


def full_ids():
    full = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    full.encode_special_tokens = True
    return lambda t: full.encode(t or "", add_special_tokens=False).ids


def test_store(spark, docs):
    path, ids = fresh_path(spark, "test"), full_ids()
    token_store.write_store(docs, path, WORD_JSON, 1)
    rows = sorted(token_store.verify_store(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    start, texts = 0, dict(ROWS)
    for r in rows:
        own = [*ids(texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), True)
        start += len(own)
    assert all(r.ids == [*ids(texts[r.doc_id]), 1] for r in token_store.read_documents(spark, path).collect())


def test_lm(docs):
    rows, held = ngram_lm.score(docs, frequent=1e-3, kept=1e-4).collect(), lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*(t or "").encode().translate(ASCII_LOWER).split(), None]) for d, t in ROWS]
    c = Counter(w for d, t in toks if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = {d: (held(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, t in toks}
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6
        assert r.score < 0
    assert len(rows) == len(ROWS) and ngram_lm.score(empty(docs)).count() == 0


@pytest.mark.parametrize("least", [ngram_lm.LEAST, 1, 3])
def test_lm_keeps_what_is_seen_often(spark, least):
    """At the production setting, with everything that is seen (least 1, where nothing is left out), and with less; with so many tokens that a share of 2e-6 is more than three: scores by brute force."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    learned, tested = [d for d in range(60) if not held(d)], [d for d in range(60) if held(d)]
    rows = [(d, "a b c d " * 25_000) for d in learned[:20]]
    rows += [(learned[20], "x y z q"), (learned[21], "X y z a"), (learned[22], "y z y z b"), (tested[0], "x y z"), (tested[1], "u x y z"), (tested[2], "z a b"), (tested[3], "")]
    grams = [Counter() for _ in range(3)]
    toks = {d: ["<s>", *t.lower().split(), "</s>"] for d, t in rows}
    for d, w in toks.items():
        if not held(d):
            for k in range(3):
                grams[k].update(tuple(w[i - k : i + 1]) for i in range(max(1, k), len(w)))
    n, v = sum(grams[0].values()), len(grams[0])
    assert 2e-6 * n > 3
    sums, kept = [Counter(), Counter()], [Counter(), Counter()]
    for k in (1, 2):
        for g, c in grams[k].items():
            sums[k - 1][g[:-1]] += c
            kept[k - 1][g[:-1]] += (c - 0.75) * (c >= least)

    def p(g):
        if len(g) == 1:
            return (grams[0][g] + 1) / (n + v + 1)
        context, k = g[:-1], len(g) - 2
        below = p(g[1:])
        if not sums[k][context]:
            return below
        c = grams[k + 1][g]
        return (c - 0.75) * (c >= least) / sums[k][context] + max(1e-9, 1 - kept[k][context] / sums[k][context]) * below

    got = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    for d in got:
        if d not in learned[:20]:
            w = toks[d]
            assert got[d].score == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(1, len(w))), abs=5e-4 * len(w))
    assert least > 2 or got[tested[0]].score > got[tested[0]].base_score + 2


def test_packing(docs):
    ids, texts = full_ids(), dict(ROWS)
    rows = packing.pack(packing.token_pieces(docs, WORD_JSON, 0, 256), 256).collect()
    used = Counter()
    for r in rows:
        part = [*ids(texts[r.doc_id]), 0][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        used[r.sequence_id] += r.length
    for s in used:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert max(used.values()) <= 256 and len(used) <= -(-sum(used.values()) // 256) + 2
    assert packing.pack(packing.token_pieces(empty(docs), WORD_JSON, 0, 256), 256).count() == 0


def test_packing_of_thousands_of_empty_texts(spark):
    empties = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack(packing.token_pieces(empties, WORD_JSON, 0, 2048), 2048).collect()
    assert len(rows) == 5000 and {(r.sequence_id, r.offset) for r in rows} == {(i // 2048, i % 2048) for i in range(5000)}


def test_packing_finds_exact_fillings():
    count = np.zeros(2049, np.int64)
    count[1100] = count[548] = count[400] = 30
    count[549:749] = 1
    assert packing.fillings_around(1100, count, 2048) == (1100, 548, 400)
    count[549:749] = 0
    assert packing.solve(count, 2048) == [((1100, 548, 400), 30)]
    for _ in range(60):
        count = np.zeros(41, np.int64)
        for n in R.choices(range(1, 41), k=12):
            count[n] += R.randint(1, 3)
        top, sums = int(np.flatnonzero(count)[-1]), {0}
        own = count.copy()
        own[top] -= 1
        for n in np.flatnonzero(own).tolist():
            sums = {s + k * n for s in sums for k in range(int(own[n]) + 1) if s + k * n <= 40 - top}
        filling = packing.fillings_around(top, count, 40)
        assert sum(filling) == top + max(sums) and all(k <= count[n] for n, k in Counter(filling).items())
        solved = packing.solve(count, 40)
        assert sum((Counter({n: k * times for n, k in Counter(f).items()}) for f, times in solved), Counter()) == Counter({n: int(k) for n, k in enumerate(count) if k})
        assert sum(times for _, times in solved) >= packing.least_sequences(count, 40)


def test_near(spark):
    r = random.Random(5)
    ws = [f"w{i}" for i in range(3000)]
    base = [r.choice(ws) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = r.choice(ws)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(r.choice(ws) for _ in range(r.randint(0, 6)))) for i in range(60, 80)] + [(90, None), (91, ""), (92, rows[3][1])]
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w := (t or "").split()) > 3 else ({tuple(w)} if w else set()) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(d, len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n", range(6))
def test_shingles_of_a_single_short_text(n):
    assert [s.size for s in near_dedup.shingle_sets([b"a b c d e"[: max(0, 2 * n - 1)]], 5)] == [min(n, 1)]


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/1?x#y", "https://ads.example.com/de/1", "http://x.org/fr/ads/1", "http://foo.com/a/ads/b", "http://example.com", "http://h/p?utm_source=a&utm_campaign=b", "http://foo.com/file.exe"]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block"]
    assert (got[2].host, got[2].path, got[2].rule) == ("a.example.net", "/en/1", "example.net/en/")
