"""Registered queries of the text operators, each over its whole table, with SQL oracles where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from geopanel.llm import ann_blocks, bpe_split, divergence, lm_score, packing, paragraphs, piece_rounds, quality_ledger, secrets, simhash_gray, token_links, toxicity, url_filter
from geopanel.llm.common import table
from geopanel.session import materialised

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _ledger_sql() -> str:
    """The ledger in SQL: words and lines by regular expressions, repeated windows by a self-count over exploded words."""
    failures = " + ".join(f"(CASE WHEN {test} THEN {1 << bit} ELSE 0 END)" for bit, (_, test) in quality_ledger.RULES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4
      FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN w4 IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) > 1 THEN 1 ELSE 0 END AS again FROM g),
v AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM c),
r AS (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS n_repeat_words FROM v GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
      CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
      CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_marks, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({failures} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (failures & {quality_ledger.mask(quality_ledger.POLICIES["base"])}) = 0 AND (failures & {quality_ledger.mask(quality_ledger.POLICIES["v2"])}) = 0 AS kept, failures
FROM f"""


@query("op10_quality_rules", _ledger_sql())
def op10_quality_rules(spark, sf_dir):
    """Measurements, failure bits and the verdict of the current policy for every document."""
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base = quality_ledger.passes("base")
    return rows.select("doc_id", *quality_ledger.MEASURES[:5], (~base).alias("base_failed"), (base & quality_ledger.passes("v2")).alias("kept"), "failures")


@query("op4_bpe_codec")
def op4_bpe_codec(spark, sf_dir):
    """Token counts and digests of ids and decoded text for every document."""
    return bpe_split.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    """Every document's pieces, packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    rows = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    """Score and prediction for every document, by a machine trained on labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    """Every run of repeated paragraphs, first occurrences included."""
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


@query("op8_secret_scans")
def op8_secret_scans(spark, sf_dir):
    """Every secret that the forest confirms."""
    docs = table(spark, sf_dir, "documents")
    words = secrets.dictionary(docs)
    found = materialised(secrets.findings(docs))  # texts are searched once for the forest and for its judgement
    return secrets.confirmed(found, secrets.train(secrets.labels(found), words), words)


_NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
      FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op5_nearest_neighbours", _NEAREST_SQL)
def op5_nearest_neighbours(spark, sf_dir):
    """The 20 nearest vectors of every vector whose identifier is divisible by 20."""
    return ann_blocks.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _url_sql() -> str:
    """The filter in SQL: rules, n-gram counts, interpolated probabilities level by level, calibration and verdict."""
    o, w = url_filter.ORDER, url_filter.WEIGHT
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    chosen = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(h, p, v)}'" for h, p, v in ordered) + " END"
    levels = ""
    for k in range(o + 1):
        before = f"l{k - 1}.pa" if k else f"{1 / url_filter.ALPHABET!r}", f"l{k - 1}.pb" if k else f"{1 / url_filter.ALPHABET!r}"
        join = f"JOIN l{k - 1} ON l{k - 1}.s = right(t.s, {k})" if k else ""
        context = f"left(s, {k})" if k else "1"
        levels += f"""
t{k} AS (SELECT right(gram, {k + 1}) AS s, sum(allow) AS na, sum(block) AS nb FROM c GROUP BY 1),
x{k} AS (SELECT *, sum(na) OVER (PARTITION BY {context}) AS ca, sum(nb) OVER (PARTITION BY {context}) AS cb FROM t{k}),
l{k} AS (SELECT t.s, (t.na + {w!r} * {before[0]}) / (t.ca + {w!r}) AS pa, (t.nb + {w!r} * {before[1]}) / (t.cb + {w!r}) AS pb FROM x{k} t {join}),"""
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT *, {chosen(lambda h, p, v: h + p)} AS rule, {chosen(lambda h, p, v: v)} AS known FROM b),
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i)),
poly AS (SELECT list(v ORDER BY i) AS p FROM bits),
u AS (SELECT url, count(*) AS n, any_value(known) AS known FROM m GROUP BY url),
y AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(url)) + 1), lambda i: ('0x' || substr(hex(encode(url)), 2 * i - 1, 2))::BIGINT)),
      lambda x, z: xor(x >> 8, p[xor(x & 255, z) + 1])) AS crc FROM u, poly),
s AS (SELECT url, n, known, xor(crc, 4294967295::BIGINT) % {url_filter.FIFTHS} = 0 AS aside, repeat(chr(2), {o}) || url || chr(3) AS padded FROM y),
e AS (SELECT url, n, known, aside, substr(padded, i, {o + 1}) AS gram FROM (SELECT *, unnest(range(1, length(padded) - {o} + 1)) AS i FROM s)),
c AS (SELECT gram, sum(CASE WHEN known = 'allow' AND NOT aside THEN n ELSE 0 END)::DOUBLE AS allow, sum(CASE WHEN known = 'block' AND NOT aside THEN n ELSE 0 END)::DOUBLE AS block
      FROM e GROUP BY gram),{levels}
z AS (SELECT url, any_value(known) AS known, bool_or(aside) AS aside, any_value(n) AS n, avg(ln(pa) - ln(pb)) AS score FROM e JOIN l{o} ON gram = s GROUP BY url),
h AS (SELECT known, sum(n * score) / sum(n) AS mean, sqrt(greatest(0, sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) ** 2)) AS dev
      FROM z WHERE aside AND known IS NOT NULL GROUP BY known),
q AS (SELECT CASE WHEN count(*) < 2 THEN '-infinity'::DOUBLE WHEN sum(dev) = 0 THEN avg(mean)
      ELSE (max(mean) FILTER (known = 'allow') * max(dev) FILTER (known = 'block') + max(mean) FILTER (known = 'block') * max(dev) FILTER (known = 'allow')) / sum(dev) END AS threshold FROM h)
SELECT page_id, host, path, rule, coalesce(m.known, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM m JOIN z USING (url), q"""


@query("op7_url_filter", _url_sql())
def op7_url_filter(spark, sf_dir):
    """Host, path, fitting rule and verdict of every page."""
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_LM_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w), c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w), t AS (SELECT count(*) AS n FROM w),
s AS (SELECT g.doc_id, CAST(round(ln(CASE WHEN g.v IS NULL THEN own.n::DOUBLE / t.n WHEN c2.n >= 2 THEN c2.n::DOUBLE / context.n ELSE 0.4::DOUBLE * (own.n::DOUBLE / t.n) END) * 1e6) AS BIGINT) AS micro
      FROM g JOIN c1 own ON own.w = g.w LEFT JOIN c1 context ON context.w = g.v LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w, t),
r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(micro) AS BIGINT) / 1e6::DOUBLE AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(score, 0::DOUBLE) AS score, CASE WHEN n_words > 0 THEN score / n_words END AS mean_score FROM d LEFT JOIN r USING (doc_id)"""


@query("op2_lm_scoring", _LM_SQL)
def op2_lm_scoring(spark, sf_dir):
    """Bigram stupid-backoff score of every document, counts over all documents."""
    return lm_score.scored(table(spark, sf_dir, "documents"), order=2, min_count=2)


@query("op13_sentencepiece_codec")
def op13_sentencepiece_codec(spark, sf_dir):
    """Token counts and digests of ids (end id included) and decoded text for every document."""
    return piece_rounds.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers for every document, and how common its links are in the corpus."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_links.aligned(table(spark, sf_dir, "documents"), *paths)


_DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 2) AS HUGEINT) // (coalesce(s.total, 0) + 2 * v.v) AS p,
      1 + CAST(1000000000 * (t.n + 2) AS HUGEINT) // (v.total + 2 * v.v) AS q
      FROM g JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM e WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", _DIVERGENCE_SQL)
def op11_source_divergence(spark, sf_dir):
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return divergence.audited(table(spark, sf_dir, "documents"))
