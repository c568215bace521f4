"""Decontamination, whitening and the Merkle manifest against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, merkle, whitening

R = random.Random(5)
WS = ["".join(R.choice("abcé9") for _ in range(R.randint(1, 4))) for _ in range(60)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def contaminated(docs, bench, window):
    wins = {}
    for i, t in bench:
        w = WORD.findall(low(t) or "")
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = Counter()
    for d, t in docs:
        w, hit, items = WORD.findall(low(t) or ""), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    items |= wins[tuple(w[s : s + n])]
        out[d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    return out


def passages():
    """(documents, items): shared spans of just a window, one word less and more, overlapping, repeated, at both ends; items of few words, none and null."""
    say = lambda n: [R.choice(WS) for _ in range(n)]
    items = [(i, say(R.randint(12, 30))) for i in range(12)] + [(20, say(3)), (21, say(1)), (22, []), (23, say(10)), (5, say(15))]
    items += [(30 + i, items[0][1]) for i in range(20)] + [(60, ["z"] * 40), (None, say(14))]
    docs = []
    for i in range(120):
        w = say(R.randint(0, 40))
        for _ in range(R.randint(0, 3)):
            own = R.choice(items)[1]
            a = R.randint(0, max(0, len(own) - 10))
            w += own[a : a + R.choice([9, 10, 11, 25])] + say(R.randint(0, 3))
        docs.append((i, " ".join(x.upper() if R.random() < 0.3 else x for x in w)))
    docs += [(None, docs[0][1]), (None, docs[0][1]), (7, docs[1][1]), docs[3], docs[3], (500, None), (501, ""), (502, "--- ,.;"), (503, "z " * 30_000 + "q"), (504, "x-" * 30_000)]
    return docs, [(i, ", ".join(w)) for i, w in items] + [(70, None)]


@pytest.mark.parametrize(("window", "gram", "small"), [(10, 5, decontaminate.SMALL), (10, 5, 0), (10, 10, 0), (4, 1, decontaminate.SMALL), (12, 3, 0)])
def test_contamination(spark, window, gram, small):
    docs, items = passages()
    d = spark.createDataFrame([(*x, 1, "f", 3, "w") for x in docs], "doc_id long, text string, item_id int, _f string, _row int, _set string").repartition(3)
    b = spark.createDataFrame([(*x, "d", 2) for x in items], "item_id long, text string, doc_id string, _row int").repartition(2)
    got = decontaminate.contamination(d, b, window=window, gram=gram, small=small)
    want = contaminated(docs, items, window)
    assert Counter(tuple(r) for r in got.collect()) == want
    if window == 10 and gram == 5:
        spans = decontaminate.spans(d, b, window=window, gram=gram, small=small)
        held = {r.doc_id: r.n for r in spans.where("doc_id not in (3, 7)").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
        assert held == {k[0]: k[2] for k in want if k[2] and k[0] not in (3, 7, None)}
        left = decontaminate.drop_contaminated(d, b, window=window, gram=gram, small=small)
        assert left.columns == d.columns and Counter(r.doc_id for r in left.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[5])


def test_contamination_of_empty_tables(spark):
    docs, items = passages()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for small in (decontaminate.SMALL, 0):
        assert decontaminate.contamination(d.limit(0), b, small=small).count() == 0
        rows = decontaminate.contamination(d, b.limit(0), small=small).collect()
        assert len(rows) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in rows)


def integer_rows(rows):
    return {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}


@pytest.mark.parametrize("spread", [1.0, 1e12])
def test_whitening(spark, spread):
    r = np.random.default_rng(1)
    base = (r.normal(size=(90, 6)) * [9, 5, 3, 2, 1, 0.5] * spread + 3 * spread).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[0]) for i in range(300)] + [(600, base[1]), (600, base[1]), (None, base[2])]
    odd = [(700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [float("nan")] + base[0][1:]), (703, [float("inf")] + base[0][1:]), (704, []), (705, [1.0, 2.0]), (706, [3e38] * 6)]
    t = spark.createDataFrame([(*x, 1, 2, "w") for x in rows + odd], "vec_id long, embedding array<float>, x int, _id int, w string").repartition(4)
    got = whitening.whiten(t).collect()
    assert Counter((x.vec_id, x.component) for x in got) == Counter((i, c) for i, _ in rows for c in (1, 2, 3, 4))
    whole = integer_rows([(i, v) for i, v in rows if i is not None] + [(-1, base[2])])
    fit = sorted(set(whole.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, object)
    cov = ((n * (a.T @ a) - np.outer(np.array(s, object), np.array(s, object))) / (n * n)).astype(float)
    values, vectors = np.linalg.eigh(cov)
    for x in got:
        y = n * np.array(whole[-1 if x.vec_id is None else x.vec_id], object) - np.array(s, object)
        exact, e = int((y**2).sum()), values[-x.component]
        assert x.n == n and x.deviation == (exact if exact < 1 << 63 else None)
        assert math.isclose(abs(x.whitened), abs(float((y / n).astype(float) @ vectors[:, -x.component]) / math.sqrt(e)), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(x.explained, e / np.trace(cov), rel_tol=1e-9) and 0 <= x.identity_error < 1e-9
    w = {(x.vec_id, x.component): x.whitened for x in got}
    m = np.array([[w[i, c] for c in (1, 2, 3, 4)] for i in range(90)])  # the same sign everywhere
    assert np.abs(m.T @ m / n - np.eye(4)).max() < 1e-9


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in whitening.whiten(one).collect()} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and {round(r.explained, 9) for r in rows} == {0.0, 1.0} and rows[0].identity_error < 1e-9
    assert whitening.whiten(one.limit(0)).collect() == [] and whitening.whiten(one.limit(0)).columns == whitening.whiten(one).columns


def test_exact_products():
    r = np.random.default_rng(0)
    for x in (r.integers(-300, 300, (5000, 4)), r.integers(-(2**62), 2**62, (40, 3)), np.array([[1 << 40, -5], [-(1 << 62), 7]]), np.array([[1 << 70, -(1 << 90)], [3, -1]], object), r.integers(-(2**25), 2**25, (3000, 2))):
        o = x.astype(object)
        assert (np.array(whitening.exact_products(x), object) == o.T @ o).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    leaf = lambda r: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            first = i - i % 16
            yield "".join(level[first:i]), "".join(level[i + 1 : first + 16])
            i //= 16

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([(r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[1] == s], key=lambda x: x[:3]) for s in sources}
    trees = {s: levels([x[2] for x in own[s]]) for s in sources}
    top, out = levels([trees[s][-1][0] for s in sources]), Counter()
    for j, s in enumerate(sources):
        for i, (_, _, node, r) in enumerate(own[s]):
            up = [*path(trees[s], i), *path(top, j)]
            now = leaf((*r[:4], low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r)
            for left, right in up:
                now = sha(left, now, right)
            out[r[0], node, trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in up)), now, now == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(spark, monkeypatch, depth):
    """Sources of one leaf, 16, 17, 256 and 257 leaves and more, in blocks of 16, 256 and 4096."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    sizes = {"b": 1, "a": 16, "é": 17, None: 257, "": 256, "hot": 600} | {f"s{i}": 2 for i in range(20)}
    rows = [(1000 * j + i, s, R.choice([None, "en"]), R.choice([None, i]), R.choice([None, "", "ABc é", "no capitals", "Xy\n" * 50])) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(9001, "b", "en", 3, "Q" * 100_000), (None, "a", None, None, None), (None, "a", None, None, "T"), rows[30], rows[30], (-5, "a", "x", 1, "Neg"), (rows[31][0], rows[31][1], "other", 2, "Tie")]
    names = "doc_id long, source string, lang string, n_chars long, text string, node int, _pos int, root string"
    t = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], names).repartition(5)
    got = merkle.manifest(t, tampered=merkle.lowered())
    assert Counter(tuple(r) for r in got.collect()) == manifest_by_hand(rows)
    assert merkle.manifest(t.where("source = 'b' and doc_id < 9000")).select("verified").first().verified
    assert merkle.manifest(t.limit(0)).collect() == []
