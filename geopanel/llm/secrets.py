"""Secret scans: candidate strings judged by a random forest.

A candidate is a value in a published key format, wherever it stands; a value of eight or more characters assigned to a word for secrets; or
a stretch of 16 or more characters of keys and tokens. Its features are its length, the shares of its character
kinds and of the steps between kinds, how much of it the corpus' own word parts cover, and the words and marks beside it. The
forest is trained on labelled findings and removes false positives. A value in a published key format needs no judge. Trained trees become one SQL expression, so candidates
are found, judged and replaced where the text stands: no row leaves its place, and nothing but SQL functions runs.

Findings may be given with labels; without them they are labelled from the text: a candidate in a published key format, or one
that follows an assignment to a word for secrets, is positive; others are negative. The forest learns from a bounded sample
of the candidates (``SAMPLE`` of each label, by hash) and never sees the rule itself.

Defined results: null text counts as empty and has no findings; rows with null or repeated identifiers are scanned like any
other; if a label is missing from the findings, the rule above decides alone; an empty table gives an empty result. Texts are
scanned whole.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import fresh, texts
from geopanel.session import materialised


def _spelled(pattern: str) -> str:
    """The pattern with the ranges in its character classes written out: Java looks such a class up in a table, but asks its ranges one
    after the other, for every character of a text."""
    every = lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1)))
    return re.sub(r"\[\^?(?:\\.|[^\]\\])+\]", lambda c: re.sub(r"(?<!\\)([A-Za-z0-9])-([A-Za-z0-9])", every, c[0]), pattern)


#: Formats that issuers publish, and words for secrets before an assignment. Fixed values.
KNOWN = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-]))"
ASSIGNED = r"(?:[Pp](?i:assword|asswd|wd)|[Ss](?i:ecret)|[Tt](?i:oken)|[Aa](?i:pi_?key|ccess_?key|uth)|[Cc](?i:redential))[A-Za-z_]*\s*[:=]+\s*[\"']?"
#: A stretch begins where no such character stands before it, or where a candidate has ended; it ends before a published format and an
#: assignment. Only at letters with which one of these begins they are looked for.
STRETCH = rf"(?:(?<![A-Za-z0-9+/_\-])|\G)(?=[A-Za-z0-9+/_\-]{{16}})(?:[BD-OQRU-Zbd-fh-oqru-wyz0-9+/_\-]|(?!{KNOWN}|{ASSIGNED})[ACPSTacgpstx]){{16,}}+"
CANDIDATE = _spelled(rf"{STRETCH}|(?=[Agsx]){KNOWN}|(?=[AaCcPpSsTt]){ASSIGNED}[^\s\"'<>]{{7,}}[^\s\"'<>.,;:)\]}}]")
#: A text without a run of 15 such characters and without a sign of assignment has no candidate: the shortest are a published format of 15
#: and a stretch of 16. Runs are passed over as a whole, so asking costs a small part of looking.
RUN = _spelled(r"\A(?:[A-Za-z0-9+/_\-]{0,14}+[^A-Za-z0-9+/_\-]++)*+[A-Za-z0-9+/_\-]{15}")
#: Stands around candidates while a text is cut. Texts that hold it are cut by the pattern itself.
MARK = "\x01"
REPLACEMENT = "[SECRET]"
SAMPLE, TREES, DEPTH, SEED = 10_000, 20, 6, 7
#: Frequent words of the corpus that count as its dictionary.
DICTIONARY = 300


def _share(kinds: str) -> str:
    return f"length(regexp_replace(c.value, '[^{kinds}]', '')) / length(c.value)"


def features(dictionary: list[str]) -> dict[str, str]:
    """Name and SQL expression over a candidate ``c`` (value, before, after)."""
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) or "(?!)"
    return {
        "length": "length(c.value)",
        "digits": _share("0-9"), "uppers": _share("A-Z"), "lowers": _share("a-z"), "marks": _share("+/_\\\\-"),
        "letter_digit_steps": "(length(c.value) - length(regexp_replace(c.value, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])', '~')))/ -length(c.value)",
        "case_steps": "(length(c.value) - length(regexp_replace(c.value, '(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])', '~')))/ -length(c.value)",
        "vowels": _share("aeiouAEIOU"),
        "hexadecimal": _share("0-9a-f"),
        "dictionary": f"1 - length(regexp_replace(lower(c.value), '{words}', '')) / length(c.value)",
        "distinct": "size(array_distinct(split(c.value, ''))) / length(c.value)",
        "path": "length(regexp_replace(concat(right(c.before, 8), c.value, left(c.after, 8)), '[^/.:@]', ''))",
        "secret_word_before": "CAST(right(c.before, 24) RLIKE '(?i)(pass|pwd|secret|token|key|credential|auth)' AS INT)",
        "assignment_before": "CAST(c.before RLIKE '[:=]+ *[\"\\']?$' AS INT)",
        "quote_before": "CAST(right(c.before, 1) IN ('\"', '\\'') AS INT)",
        "letter_before": "CAST(right(c.before, 1) RLIKE '[^\\\\x00-\\\\x7F]' AS INT)",
        "blank_before": "CAST(right(c.before, 1) RLIKE '\\\\s' OR c.before = '' AS INT)",
        "quote_after": "CAST(left(c.after, 1) IN ('\"', '\\'') AS INT)",
        "letter_after": "CAST(left(c.after, 1) RLIKE '[^\\\\x00-\\\\x7F]' AS INT)",
        "blank_after": "CAST(left(c.after, 1) RLIKE '\\\\s' OR c.after = '' AS INT)",
    }


def _may_hold(text: Column) -> Column:
    return F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | text.rlike(RUN)


def _by_turns(gaps: Column, values: Column) -> Column:
    """gap, value, …, gap: there is one gap more than values."""
    return F.filter(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, v))), lambda p: p.isNotNull())


def with_candidates(docs: DataFrame, text_col: str, gaps: str, found: str) -> DataFrame:
    """Adds ``gaps`` (the text between candidates) and ``found``: number, head (the assignment before it), value, and up to 40 characters
    on both sides."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts, values = fresh(docs, "parts", "values")
    # Gaps and candidates by turns, from one search.
    marked = F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pieces, matches = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    rows = docs.withColumn(parts, F.when(~_may_hold(text), F.array(text)).when(F.contains(text, F.lit(MARK)), _by_turns(pieces, matches)).otherwise(marked))
    rows = rows.withColumn(gaps, F.filter(parts, lambda p, i: i % 2 == 0)).withColumn(values, F.filter(parts, lambda p, i: i % 2 == 1)).drop(parts)
    rows = rows.withColumn(values, F.transform(values, lambda v: F.struct(F.regexp_extract(v, f"^{ASSIGNED}", 0).alias("head"), v.alias("whole"))))
    each = f"""transform(`{values}`, (v, i) -> named_struct('i', i, 'head', v.head, 'value', substr(v.whole, length(v.head) + 1),
               'before', right(concat(`{gaps}`[i], v.head), 40), 'after', left(`{gaps}`[i + 1], 40)))"""
    return rows.withColumn(found, F.expr(each)).drop(values)


def dictionary(docs: DataFrame, size: int = DICTIONARY, text_col: str = "text") -> list[str]:
    """The most frequent lower-case words of three to eight letters, over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit("(?<![A-Za-z])[a-z]{3,8}(?![A-Za-z])"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin (characters before it), value, before and after of every candidate. Texts are searched once for whoever reads it."""
    rows = with_candidates(texts(docs, id_col, text_col), "text", "gaps", "found")
    before = "aggregate(slice(gaps, 1, c.i + 1), 0L, (s, g) -> s + length(g)) + aggregate(slice(found, 1, c.i), 0L, (s, o) -> s + length(o.head) + length(o.value))"
    each = f"transform(found, c -> named_struct('begin', {before} + length(c.head), 'value', c.value, 'before', c.before, 'after', c.after))"
    # Outer: else Spark asks first whether there is a candidate, by searching the text once more.
    return rows.select("doc_id", F.explode_outer(F.expr(each)).alias("c")).where("c IS NOT NULL").select("doc_id", "c.*")


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, before, after, label) of every distinct candidate, labelled by the published formats and assignments."""
    return labels(findings(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))))


def labels(found: DataFrame) -> DataFrame:
    """:func:`labelled` of the rows of :func:`findings`."""
    c = found.select("value", "before", "after")
    # a long word is no secret merely because it follows an assignment: it must mix letters and digits
    secret = F.col("value").rlike(KNOWN) | (F.col("before").rlike(ASSIGNED + "$") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    # of several contexts one that makes the value a secret counts
    best = c.groupBy("value").agg(F.max(F.struct(secret.cast("double").alias("label"), "before", "after")).alias("c"))
    return best.select("value", "c.before", "c.after", "c.label")


def _tree_sql(node) -> str:
    """A trained tree as nested CASE expressions over the feature array ``c.f``, its leaves the share of secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(sum(stats), 1e-12)!r}D"
    split = node.split()
    return f"CASE WHEN c.f[{split.featureIndex()}] <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def train(findings: DataFrame, words: list[str], sample: int = SAMPLE) -> str | None:
    """The forest's score as SQL over ``c.f``; None if the findings have one label only."""
    names = features(words)
    findings = materialised(findings)  # the forest reads its rows many times, the texts once
    rows = None
    for label in (0.0, 1.0):
        part = findings.where(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(sample)
        rows = part if rows is None else rows.unionAll(part)
    rows = rows.select("label", F.struct("value", "before", "after").alias("c")).select("label", *[F.expr(e).cast("double").alias(n) for n, e in names.items()])
    assembled = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows).select("label", "features").coalesce(1)
    if assembled.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(assembled)
    trees = [_tree_sql(t._call_java("rootNode")) for t in forest.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}"


def judged(docs: DataFrame, forest: str | None, words: list[str], text_col: str, gaps: str, found: str) -> DataFrame:
    """Adds ``gaps`` and ``found``: number, head, value and score of each candidate."""
    return with_candidates(docs, text_col, gaps, found).withColumn(found, F.expr(_scored(f"`{found}`", forest, words)))


def _scored(found: str, forest: str | None, words: list[str]) -> str:
    """SQL: the candidates of an array with their scores."""
    known = f"c.value RLIKE r'{KNOWN}'"  # a published format needs no judge
    kept = "'i', c.i, 'head', c.head, 'value', c.value"
    if forest is None:
        return f"transform({found}, c -> named_struct({kept}, 'score', CAST({known} AS DOUBLE)))"
    vector = ", ".join(f"CAST({e} AS DOUBLE)" for e in features(words).values())
    measured = f"transform({found}, c -> named_struct({kept}, 'f', array({vector})))"
    return f"transform({measured}, c -> named_struct({kept}, 'score', CASE WHEN {known} THEN 1D ELSE {forest} END))"


def scan(docs: DataFrame, forest: str | None, words: list[str], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin (characters before it), length, known_format, score and sha256 of every secret."""
    return confirmed(findings(docs, id_col, text_col), forest, words, threshold)


def confirmed(found: DataFrame, forest: str | None, words: list[str], threshold: float = 0.5) -> DataFrame:
    """:func:`scan` of the rows of :func:`findings`."""
    one = "array(named_struct('i', 0, 'head', '', 'value', value, 'before', before, 'after', after))"
    kept = f"filter({_scored(one, forest, words)}, c -> c.score >= {threshold}D)"
    return found.select("doc_id", "begin", F.explode_outer(F.expr(kept)).alias("c")).where("c IS NOT NULL").select(
        "doc_id", "begin", F.length("c.value").alias("length"), F.col("c.value").rlike(KNOWN).alias("known_format"),
        F.col("c.score").alias("score"), F.sha2("c.value", 256).alias("value_sha256"),
    )


def redact(docs: DataFrame, forest: str | None, words: list[str], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with each secret in the text replaced."""
    gaps, found = fresh(docs, "gaps", "found")
    rows = judged(docs, forest, words, text_col, gaps, found)
    pieces = f"flatten(transform(`{found}`, c -> array(`{gaps}`[c.i], c.head, CASE WHEN c.score >= {threshold}D THEN '{REPLACEMENT}' ELSE c.value END)))"
    secret = F.expr(f"exists(`{found}`, c -> c.score >= {threshold}D)")
    text = F.when(secret, F.expr(f"array_join(concat({pieces}, array(`{gaps}`[size(`{found}`)])), '')")).otherwise(F.col(f"`{text_col}`"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
