"""The corpus pipeline, stage by stage and as a whole, against a brute-force version."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import langid
from tidemark.llm.common import ASCII_LOWER

R = random.Random(77)
LANGUAGES = {"en": ["the", "house", "with", "and", "river", "stands", "light"], "de": ["über", "und", "nicht", "schön", "gehört", "zwölf"]}
PASSAGE = " ".join(R.choice(LANGUAGES["en"]) + str(i) for i in range(40))


def sentence(lang: str, n: int) -> str:
    return " ".join(R.choice(LANGUAGES[lang]) + (str(R.randint(0, 999)) if R.random() < 0.5 else "") for _ in range(n))


def _rows():
    out = [(i, sentence("en" if i % 2 else "de", R.randint(1, 80)), "en" if i % 2 else "de") for i in range(120)]
    out += [(200 + i, out[i][1].upper(), None) for i in range(10)]  # equal but for case
    out += [(300 + i, out[20 + i][1] + " more", None) for i in range(12)]  # near copies of the longer ones
    out += [(400 + i, sentence("en", 30) + " " + PASSAGE + " é" + sentence("de", 10), "en") for i in range(6)]
    out += [(500, None, "en"), (501, "", "de"), (502, "12 34 !!", "en"), (503, sentence("de", 60_000), "de"), out[3], out[3], (None, sentence("en", 50), "en")]
    return out


ROWS = _rows()


def components(docs, size=5):
    sets = {d: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} for d, t in docs if d is not None for w in [t.encode().translate(ASCII_LOWER).split()]}
    up = {d: d for d in sets}

    def top(x):
        return x if up[x] == x else top(up[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, z = sets[a], sets[b]
            if 5 * min(len(s), len(z)) >= 4 * max(len(s), len(z)) and 100 * len(s & z) >= 80 * len(s | z):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in sets}


def without_repeats(docs, length=100):
    """Texts in id order without the characters that lie whole in bytes which an earlier string of `length` has."""
    seen, out = {}, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        b, cover = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - length + 1):
            if seen.setdefault(hash(b[i : i + length]), (d, i)) != (d, i):
                cover[i : i + length] = True
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not cover[at : at + n].all():
                kept.append(c)
            at += n
        out.append((d, "".join(kept)))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    t = spark.createDataFrame([(d, x, lang, "s", len(x or ""), 1, "v") for d, x, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, id int, spans string").repartition(4)
    t.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_every_stage(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    net, got, stages = langid.train(docs), {}, dict(corpus_pipeline.STAGES)
    judged = net.predict([(t or "").encode() for _, t, _ in ROWS])
    want = [(d, t) for (d, t, _), (lang, score) in zip(ROWS, judged, strict=True) if lang != "und" and score >= 0.4]
    now = docs
    for name in list(stages)[:-1]:
        now = stages[name](spark, now, made)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{made}/{name}")
        now = spark.read.parquet(f"{made}/{name}")
        got[name] = Counter((r.doc_id, r.text) for r in now.collect())
    assert got["language_id"] == Counter(want) and not {500, 501, 502} & {d for d, _ in want}
    low = lambda t: t.encode().translate(ASCII_LOWER)
    best = {}
    for d, t in want:
        best[low(t)] = max(best.get(low(t), -1), -1 if d is None else d)
    want = [(d, t) for d, t in want if best[low(t)] == (-1 if d is None else d)]
    assert got["exact_dedup"] == Counter(want)
    comp = components(want)
    want = [(d, t) for d, t in want if d is None or comp[d] == d]
    assert got["near_dedup"] == Counter(want) and len(want) < sum(got["exact_dedup"].values())
    want = without_repeats(want)
    assert got["suffix_dedup"] == Counter(want) and any(d == 401 and PASSAGE not in t for d, t in want)
    full = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    full.encode_special_tokens = True
    pieces = Counter()
    for d, t in want:
        ids = [*full.encode(t, add_special_tokens=False).ids, 0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            pieces[(d, k, lo, len(ids[lo : lo + 2048]), zlib.crc32(np.array(ids[lo : lo + 2048], "<u4").tobytes()))] += 1
    packed = corpus_pipeline.run(spark, made).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_no_documents(spark, made, tmp_path):
    spark.read.parquet(f"{made}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
