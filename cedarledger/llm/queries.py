"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontam, divergence, fingerprints, langid, line_dedup, lm, minhash, pii, quality, substring_dedup, token_counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.judged(found).drop("text_key")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_docs(spark, sf_dir)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(_docs(spark, sf_dir)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return line_dedup.digests(line_dedup.apply(docs, line_dedup.keep_bitmaps(docs)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return substring_dedup.digests(substring_dedup.remove(docs, substring_dedup.repeats(docs)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_docs(spark, sf_dir)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_docs(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_docs(spark, sf_dir))


def queries():
    return {
        f.__name__: f for f in (
            op1_lm_score, op2_decontamination, op3_bpe, op4_token_counts, op5_line_dedup, op6_substring_dedup,
            op7_minhash, op8_pii, op9_language_id, op10_quality, op11_divergence,
            op12_conversations, op13_fingerprints
        )
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents), b AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

_LINES = """WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN often ON often.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 13], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM d UNION SELECT reach.d, links.y FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM d JOIN least ON least.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS ng, sum(n) OVER (PARTITION BY lang)::HUGEINT AS nl, sum(n) OVER (PARTITION BY lang, term)::HUGEINT AS nt, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (ng + 5 * v) AS p, 1 + 1000000000::HUGEINT * (nt + 5) // (nl + 5 * v) AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50"""


def _repair_sql() -> str:
    """The pass as a recursion over the rows of all conversations; a state's (cost, audit) is one string, the cost in twelve digits."""
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    plus = lambda k, cost, edit: f"lpad((substr({k}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({k}, 13) || '{edit}'"
    gone = lambda k: plus(k, 4, "D")
    put = lambda k: plus(k, 3, "I")
    keep = lambda k, c: f"CASE WHEN NOT go AND c = '{c}' THEN {plus(k, 'more', 'K')} END"
    turn = lambda k: f"CASE WHEN NOT go THEN {plus(k, 'more + 3', 'R')} END"
    user = ", ".join([gone("k2")] + [f(k) for k in ("k0", "k1", "k3") for f in (lambda k: keep(k, "u"), turn)])
    return rf"""WITH RECURSIVE raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS code FROM conversations),
dam AS (SELECT cid, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 0 THEN [] WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw),
r AS (SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS dup, NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut, lag(c) OVER (PARTITION BY cid ORDER BY i) || c AS two FROM r),
g AS (SELECT cid, i, c, blank OR dup AS go, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM f),
v AS (SELECT DISTINCT cid, 0::BIGINT AS i, '000000000000' AS k0, NULL::VARCHAR AS k1, '000000000003I' AS k2, '000000000006II' AS k3 FROM raw
UNION ALL SELECT cid, i, n0, n1, least(n2, {put("n0")}, {put("n1")}, {put("n3")}), least(n3, {put("n2")}, {put(f"({put('n0')})")}, {put(f"({put('n1')})")})
FROM (SELECT v.cid, g.i, {gone("k0")} AS n0, least({gone("k1")}, {keep("k0", "s")}) AS n1, least({user}) AS n2, least({gone("k3")}, {keep("k2", "a")}, {turn("k2")}) AS n3 FROM v JOIN g ON g.cid = v.cid AND g.i = v.i + 1)),
best AS (SELECT cid, substr(k, 1, 12)::BIGINT AS cost, substr(k, 13) AS audit FROM (SELECT cid, arg_max(least(k0, k3), i) AS k FROM v GROUP BY cid)),
e AS (SELECT cid, j, substr(audit, j, 1) AS e FROM (SELECT cid, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
n AS (SELECT cid, j, e, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY cid ORDER BY j) AS i FROM e),
o AS (SELECT n.cid, n.e, CASE WHEN n.e = 'I' THEN '' ELSE f.text END AS text, f.role, f.c, row_number() OVER (PARTITION BY n.cid ORDER BY j) AS m FROM n LEFT JOIN f ON f.cid = n.cid AND f.i = n.i AND n.e <> 'I' WHERE n.e <> 'D'),
s AS (SELECT *, max((m = 1 AND e = 'K' AND c = 's')::INTEGER) OVER (PARTITION BY cid) AS sys FROM o),
t AS (SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY m) AS repaired FROM s GROUP BY cid),
q AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT dup AND NOT blank) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM raw) JOIN best USING (cid) LEFT JOIN q USING (cid) LEFT JOIN t USING (cid)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole result. The others are held against plain versions, round trips and held-out
    accuracy in the tests.
    """
    return {
        "op2_decontamination": _DECONTAMINATION, "op5_line_dedup": _LINES, "op6_substring_dedup": _SUBSTRINGS,
        "op7_minhash": _NEAR, "op11_divergence": _DIVERGENCE,
        "op12_conversations": _repair_sql()
    }
