r"""Quality rules as a short-circuit cascade (operator 10), with built-in functions only.

A document is kept if it fails neither the base (few_words, repeats) nor any further rule (RULES). On a bounded sample
(about ``sample_docs`` rows, chosen by a hash of identifier and text, so the same ones every time) each rule's
rejections are counted, and its cost is estimated from the characters, words and lines that it and the values it needs
go through (COSTS). The cascade is then put together greedily: next comes the rule with most rejections, among the
documents that are left, per cost, and values that an earlier rule has made cost nothing. The order changes the time,
never a verdict.

``filter_documents`` evaluates one expression that stops at the first rule that rejects; words, lines and repeated
windows are made where the first rule that needs them is reached, once, and not at all for a document that is rejected
before. ``judge`` gives the base columns (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row, so
there the cascade has the further rules only.

Repeated 5-word windows are found in the row itself: windows are hashed, and only a document whose windows aren't all
distinct sorts them, so nothing is exploded or shuffled.

Defined results: a null text has no words, so base_failed is true; a document without words fails; texts of any length
are judged whole; repeated rows and null identifiers stay; an empty table gives no rows; ``filter_documents`` keeps
every column of its input, whatever it is called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
# The spaces between words, and the symbols that are counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_RULES = {"few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}

#: name -> the SQL condition that rejects. `_t` is the text, `_w` its words, `_lines` its lines that have a word.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * size(_lines) AND n_dup_lines >= 3",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "capitals": "2 * length(regexp_replace(_t, '[^\\\\p{Lu}]+', '')) > word_chars",
    "bangs": "4 * (length(_t) - length(replace(_t, '!', ''))) > n_words AND n_words >= 10",
    "few_distinct": "n_words >= 50 AND 10 * size(array_distinct(_w)) < n_words",
}

_WINDOWS = "if(size(_w) < 5, array(), slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4))), 1, size(_w) - 4))"
_TWICE = "filter(transform(s, (e, i) -> struct(e.p AS p, e.h <=> get(s, i - 1).h OR e.h <=> get(s, i + 1).h AS twice)), e -> e.twice)"
_COVERED = "aggregate(transform(p, (q, i) -> least(5, coalesce(get(p, i + 1), q + 5) - q)), 0L, (a, x) -> a + x)"


def let(name: str, value: str, body: str) -> str:
    """SQL of the body with a name for a value, which is made once, and only if the body is reached."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Values that rules use, in SQL over the text and earlier values.
VALUES = {
    "_t": "coalesce(cast(`text` as string), '')",
    "_w": "filter(split(_t, '[ \\\\t-\\\\r]+'), x -> x != '')",
    "_lines": f"filter(split(_t, '\\n'), x -> length(translate(x, '{SPACES}', '')) > 0)",
    "n_words": "cast(size(_w) as bigint)",
    "word_chars": f"cast(length(translate(_t, '{SPACES}', '')) as bigint)",
    "n_symbols": f"cast(length(_t) - length(translate(_t, '{SYMBOLS}', '')) as bigint)",
    "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as bigint)",
    # v: the windows' hashes, s: the same with their places, sorted, p: places of those found twice.
    "n_repeat_words": let("v", _WINDOWS, "if(size(array_distinct(v)) = size(v), 0L, " + let("s", "sort_array(transform(v, (x, i) -> struct(x AS h, i AS p)))", let("p", f"sort_array(transform({_TWICE}, e -> e.p))", _COVERED)) + ")"),
}

#: Nanoseconds (by measurement, rounded) that a value or rule takes for each character, word and line.
COSTS = {
    "_w": (30, 60, 0), "_lines": (20, 0, 200), "word_chars": (20, 0, 0), "n_symbols": (25, 0, 0), "n_dup_lines": (1, 0, 150), "n_repeat_words": (0, 450, 0),
    "capitals": (15, 0, 0), "bangs": (20, 0, 0), "few_distinct": (0, 80, 0),
}


def needed(sql: str) -> list[str]:
    """The values that a condition uses, each after those that it uses itself."""
    out: list[str] = []
    for name in VALUES:
        if re.search(rf"(?<![\w.]){name}\b", sql):
            out += [n for n in [*needed(VALUES[name]), name] if n not in out]
    return out


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds `_t`, `_w`, `_lines` and the base columns (named with ``prefix``)."""
    df = docs.withColumn("_t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumns({n: F.expr(VALUES[n]) for n in ("_w", "_lines")})
    return df.withColumns({f"{prefix}{n}": F.expr(VALUES[n]) for n in BASE})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cascade_order(docs: DataFrame, rules: dict[str, str], sample_docs: int = SAMPLE_DOCS, given: tuple[str, ...] = ()) -> list[str]:
    """Rule names by rejections per cost, each among the documents that earlier ones leave; ``given`` values cost nothing."""
    total = docs.count()
    if not total or not rules:
        return list(rules)
    known = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    some = docs.where(F.pmod(F.xxhash64(*known), F.lit(max(1, total // sample_docs))) == 0).limit(4 * sample_docs).select("text")
    seen = measure(some).select(F.length("_t").alias("chars"), F.size("_w").alias("words"), F.size("_lines").alias("lines"), *[F.expr(v).alias(f"_r{k}") for k, v in enumerate(rules.values())])
    rows = [(r[:3], r[3:]) for r in seen.collect()]  # numbers and flags of at most 4 * sample_docs documents

    def cost(names: list[str]) -> float:
        return sum(sum(a * b for a, b in zip(COSTS.get(n, (0, 0, 0)), sizes, strict=True)) + 50 for sizes, _ in rows for n in names)

    order: list[str] = []
    place, made = {n: k for k, n in enumerate(rules)}, set(given)
    while len(order) < len(rules):
        score = {n: (sum(bool(f[place[n]]) for _, f in rows) + 0.1) / (cost([n, *(v for v in needed(rules[n]) if v not in made)]) + 1) for n in rules if n not in order}
        best = max(score, key=lambda n: (score[n], -place[n]))
        order.append(best)
        made.update(needed(rules[best]))
        rows = [r for r in rows if not r[1][place[best]]] or rows
    return order


def verdict(rules: dict[str, str], order: list[str]) -> Column:
    """The first rule that rejects, in the given order; null if none does. Columns: the base columns, `_t`, `_w`, `_lines`."""
    out = F.when(base_failed(), F.lit("base"))
    for name in order:
        out = out.when(F.expr(rules[name]), F.lit(name))
    return out


def cascade(rules: dict[str, str], order: list[str]) -> str:
    """SQL of the same over a row's `text` alone, with each value made where it is first needed."""
    def step(k: int, made: frozenset[str]) -> str:
        if k == len(order):
            return "cast(null as string)"
        new = [v for v in needed(rules[order[k]]) if v not in made]
        out = f"CASE WHEN {rules[order[k]]} THEN '{order[k]}' ELSE {step(k + 1, made | frozenset(new))} END"
        for v in reversed(new):
            out = let(v, VALUES[v], out)
        return out

    return step(0, frozenset())


def judge(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, base columns, base_failed, rejected_by, kept)."""
    rules = RULES if rules is None else rules
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = cascade_order(slim, rules, given=("_t", "_w", "_lines", *BASE))
    df = fenced(measure(slim).withColumn("rejected_by", verdict(rules, order)))
    return df.select("doc_id", *BASE, base_failed().alias("base_failed"), "rejected_by", (F.col("rejected_by").isNull() & (F.col("_fence") >= 0)).alias("kept"))


def fenced(df: DataFrame) -> DataFrame:
    """Adds `_fence`. A filter isn't pushed below a projection that isn't deterministic; pushed, it would copy each
    column of the chain into each of its uses, and grow exponentially. What is filtered on must use the column."""
    return df.withColumn("_fence", F.monotonically_increasing_id())


def filter_documents(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rules = {**BASE_RULES, **(RULES if rules is None else rules)}
    order = cascade_order(docs, rules)
    return docs.where(F.expr(cascade(rules, order)).isNull())


def oracle() -> str:
    """The same in DuckDB's SQL."""
    space = r"[^\x20\x09-\x0D]+"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS (SELECT doc_id, t, regexp_extract_all(t, '{space}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM d),
    i AS (SELECT *, unnest(generate_series(1, len(w) - 4)) AS p FROM b WHERE len(w) >= 5),
    g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p:p + 4]) AS n FROM i),
    c AS (SELECT DISTINCT doc_id, p + k AS q FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1),
    r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
    m AS (SELECT b.doc_id, t, w, ls, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
        FROM b LEFT JOIN r ON b.doc_id = r.doc_id),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 10 * n_symbols > n_words OR (100 * n_dup_lines > 30 * len(ls) AND n_dup_lines >= 3)
        OR word_chars > 20 * n_words OR word_chars < 2 * n_words
        OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > word_chars
        OR (4 * (length(t) - length(replace(t, '!', ''))) > n_words AND n_words >= 10)
        OR (n_words >= 50 AND 10 * len(list_distinct(w)) < n_words)) AS kept
    FROM f
    """
