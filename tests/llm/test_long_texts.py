"""Texts of megabytes, one of a single word, through the operators whose other tests have short ones only."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import exact_dedup, langid, line_rules, ngram_lm, token_store
from tidemark.llm.common import ASCII_LOWER, fresh_path

R = random.Random(77)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(3000)]
LONG = "\n".join(" ".join(R.choice(WORDS) for _ in range(12)) for _ in range(30_000))
ROWS = [(1, LONG), (2, LONG.upper()), (3, "ab" * 1_000_000), (4, "short text\n" * 3), (5, None), (6, ""), (7, LONG[:1_000_000] + " é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "h") for d, t in ROWS], "doc_id long, text string, lang string, source string").repartition(3)


def test_exact_dedup(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs, keep="max").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode().translate(ASCII_LOWER)).hexdigest()
    assert got == {d: (max(e for e, u in ROWS if sha(u) == sha(t)), sum(sha(u) == sha(t) for _, u in ROWS), sha(t)) for d, t in ROWS}


def test_line_rules(docs):
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    for d, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for k in (i, i + 1, i + 2)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))


def test_language(docs):
    net = langid.train(docs, sample=4)
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert len(got) == 7 and got[5].lang_pred == got[6].lang_pred == "und" and all(got[d].lang_pred == "en" and got[d].score == pytest.approx(1) for d in (1, 2, 3, 4, 7))


def test_token_store(spark, docs):
    js, path = open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), fresh_path(spark, "long")
    token_store.write_store(docs, path, js, end_id=1)
    got, tok, start = {r.doc_id: r for r in token_store.verify_store(spark, path).collect()}, Tokenizer.from_str(js), 0
    for d, t in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_scores(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    toks = {d: [*(t or "").encode().translate(ASCII_LOWER).split(), None] for d, t in ROWS}
    c = Counter(w for d, t in toks.items() if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    for r in ngram_lm.score(docs, least=1).collect():
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9) and -math.inf < r.score < 0
