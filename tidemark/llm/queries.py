"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontaminate, exact_dedup, langid, line_rules, merkle, near_dedup, ngram_lm, packing, suffix_dedup, token_store, url_filter, whitening
from .common import fresh_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table; one of fewer parts than there are cores, which is a small one, is dealt out anew."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _word_bpe() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="max")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removal_digest(suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=100))


def op4_line_rules(spark, sf_dir):
    return line_rules.line_rules(read(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_token_store(spark, sf_dir):
    path = fresh_path(spark, "store")
    token_store.write_store(read(spark, sf_dir, "documents"), path, _word_bpe(), end_id=1)
    return token_store.verify_store(spark, path)


def op7_lm_score(spark, sf_dir):
    return ngram_lm.score(read(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(packing.token_pieces(read(spark, sf_dir, "documents"), _word_bpe(), end_id=0, capacity=2048))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(read(spark, sf_dir, "documents"), size=4, similarity="0.8")


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op11_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10, gram=5)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"), scale=256, components=4)


def op13_merkle(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.lowered())


SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT d.doc_id, keep_id, group_size, d.doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
ids AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: {'p': i, 'k': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}), recursive := true) FROM ids WHERE len(w) >= 3),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
reach AS (SELECT r, sum(least(3, coalesce(nxt - p, 3)))::BIGINT AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM rep) GROUP BY r),
base AS (SELECT ids.r, doc_id, host, t, ls, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM ids LEFT JOIN reach USING (r)),
ln AS (SELECT r, doc_id, host, t, unnest(ls) AS l FROM base),
norm AS (SELECT r, doc_id, host, t, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln),
often AS (SELECT host, k FROM norm GROUP BY host, k HAVING count(DISTINCT (doc_id, t)) > 20),
lost AS (SELECT r, sum(n)::BIGINT AS removed_words FROM norm JOIN often USING (host, k) GROUP BY r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(removed_words, 0) AS removed_words,
  NOT base_failed AND n_words - coalesce(removed_words, 0) >= 0.2 * n_words AS kept FROM f LEFT JOIN lost USING (r)
"""


def _glob_regex(glob: str) -> str:
    import re

    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def _op10_sql() -> str:
    globs = " ".join(f"WHEN regexp_full_match(canon, '{_glob_regex(g)}', 's') THEN '{g}'" for g in url_filter.GLOBS)
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules)
    kind = " ".join(f"WHEN rule = '{r[1]}{r[2]}' THEN '{r[0]}'" for r in rules)
    return rf"""
WITH a AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://((?s).*)$', 1), '') AS rest FROM pages),
b AS (SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_replace(rest, '^[^/?#]*', '') AS tail FROM a),
c AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path, regexp_extract(tail, '^[^#]*') AS tail FROM b),
d AS (SELECT *, {SQL_LOWER.format("host || tail")} AS canon, CASE {rule} END AS rule FROM c),
e AS (SELECT *, CASE WHEN host = '' AND path = '' THEN NULL {globs} END AS glob_hit FROM d)
SELECT page_id, host, path, rule, glob_hit, CASE {kind} WHEN glob_hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM e
"""


OP11_SQL = rf"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
dw AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM iw))),
hit AS (SELECT r, size, i, item FROM dw JOIN iw USING (size, win)),
reach AS (SELECT r, i, i + size AS e, max(i + size) OVER (PARTITION BY r ORDER BY i, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT r, size, i FROM hit)),
n AS (SELECT r, sum(greatest(0, e - greatest(i, coalesce(before, 0))))::BIGINT AS n_hit FROM reach GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN n USING (r) LEFT JOIN its USING (r)
"""


def _op13_sql(levels: int = 6) -> str:
    """The hash tree level by level, for 16**levels rows a source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda a, b: xor(tbl[xor(a, b) % 256 + 1], a // 256), 4294967295::BIGINT), 4294967295::BIGINT)"
    sql = [
        "tbl AS (SELECT list(c ORDER BY b) AS tbl FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT) AS c FROM range(256) t(b)))",
        f"d AS (SELECT documents.*, CASE WHEN {crc} % 5 = 0 THEN {SQL_LOWER.format('text')} ELSE text END AS changed FROM documents, tbl)",
        f"leaf AS (SELECT doc_id, source, {leaf('text')} AS node, {leaf('changed')} AS now FROM d)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf)",
        "a0 AS (SELECT source AS g, pos, node, n FROM placed)",
    ]

    def tree(x: str) -> None:
        side = lambda lo, hi: f"coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN {lo} AND {hi}), '')"
        for k in range(levels):
            sql.append(f"{x}s{k} AS (SELECT g, pos, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {x}{k} WHERE n > 1)")
            sql.append(f"{x}{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node, (max(n) + 15) // 16 AS n FROM {x}{k} GROUP BY g, pos // 16)")

    def climb(x: str, start: str, group: str, place: str) -> str:
        for k in range(levels):
            sql.append(f"{x}p{k} AS (SELECT p.* REPLACE (CASE WHEN s.l IS NULL THEN p.now ELSE sha256(s.l || p.now || s.r) END AS now, p.proof || coalesce(s.l || s.r, '') AS proof) FROM {start} p LEFT JOIN {x}s{k} s ON s.g IS NOT DISTINCT FROM p.{group} AND s.pos = p.{place} // {16**k})")
            start = f"{x}p{k}"
        return start

    tree("a")
    sql.append(f"subs AS (SELECT g AS source, node AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, 0 AS everything FROM a{levels})")
    sql.append("b0 AS (SELECT 0 AS g, place AS pos, subroot AS node, count(*) OVER () AS n FROM subs)")
    tree("b")
    sql.append("start AS (SELECT placed.*, placed.node AS leaf, subroot, place, everything, '' AS proof FROM placed JOIN subs ON subs.source IS NOT DISTINCT FROM placed.source)")
    last = climb("b", climb("a", "start", "source", "pos"), "everything", "place")
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b{levels}.node AS verified FROM {last}, b{levels}"


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_line_rules": OP4_SQL, "op10_url_filter": _op10_sql(), "op11_decontaminate": OP11_SQL, "op13_merkle": _op13_sql()}
