"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column that rejects. On a bounded sample the cost of a rule (the
time its evaluation takes) and its selectivity (the part it rejects) are measured, and
the rules are put in order of rejections per cost, so that a document is mostly rejected
by a cheap rule and never reaches the dear ones: the cascade is one CASE expression,
evaluated from the front and left at the first hit. The order changes the work, not the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._native import SPACES, bind, words
from tessera.llm._store import cut, documents

SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(w: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more."""
    n = F.size(w)

    def spread(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return bind(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(pairs, among)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    return F.when(n > width, bind(windows, spread)).otherwise(0)


def statistics(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: _without(x, SPACES) != "")
    made = bind(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            _repeated(w, window).cast("bigint").alias("n_repeat_words"),
        ),
    )
    split = bind(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return docs.withColumn("_quality_w", made).withColumn("_quality_l", split).withColumn(
        "quality",
        F.struct(
            F.col("_quality_w.n_words"), F.length(_without(t, SPACES)).cast("bigint").alias("word_chars"), (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
            F.col("_quality_l.n_dup_lines"), F.col("_quality_w.n_repeat_words"), F.col("_quality_l.n_lines"),
        ),
    ).drop("_quality_w", "_quality_l")


def rules(text: str = "text") -> dict[str, Column]:
    """The rules of the cascade. They reject on clear signs only; ordinary prose passes all."""
    q = lambda name: F.col(f"quality.{name}")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: _without(x, SPACES) != "")
    return {
        "symbols": q("n_symbols") * 10 > q("n_words") * 3,
        "word_length": (q("word_chars") < 2 * q("n_words")) | (q("word_chars") > 15 * q("n_words")),
        "repeated_lines": (q("n_lines") >= 5) & (q("n_dup_lines") * 10 > q("n_lines") * 3),
        "letters": F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", "")) * 2 < q("word_chars"),
        "ellipses": bind(lines, lambda x: F.size(F.filter(x, lambda y: F.rtrim(y).endswith("..."))) * 10 > F.size(x) * 3),
    }


def cascade_order(sample: DataFrame, rejects: Mapping[str, Column], copies: int = 8, times: int = 3) -> list[str]:
    """Names by rejections per cost on ``sample``.

    A rule's cost is the least time of several evaluations over ``copies`` of the sample,
    less that of a rule that does nothing; the first evaluation, which compiles, counts as none.
    """
    many = cut(sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))))
    n = max(1, many.count())

    def measured(rule: Column) -> tuple[int, float]:
        spent = []
        for _ in range(times + 1):
            began = time.perf_counter()
            hit = many.agg(F.count_if(rule), F.max("_copy")).first()[0]
            spent.append(time.perf_counter() - began)
        return hit, min(spent[1:])

    _, idle = measured(F.col("_copy") < 0)
    found = {name: measured(rule) for name, rule in rejects.items()}
    worth = {name: (hit + 0.5) / n / max(1e-3, cost - idle) for name, (hit, cost) in found.items()}
    return sorted(worth, key=lambda name: -worth[name])


def first_hit(rejects: Mapping[str, Column], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rejects[name], F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, sample_rows: int = 512, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``quality``, ``base_failed`` and ``rejected_by`` (null: kept).

    Null, empty and blank texts have no words and fail the base rule. The sample is the
    texts of the ``sample_rows`` rows whose id and text hash lowest, once each; it decides nothing but the order of
    the rules. Repeated rows are judged alike, a text of any length whole; an empty table
    gives no rows. Columns of these
    three names are replaced; all others stay.
    """
    slim = docs.select(id_col, text)
    marked = slim.withColumn("_h", F.xxhash64(id_col, text))
    lowest = [r[0] for r in marked.select("_h").orderBy("_h").limit(sample_rows).collect()]
    few = marked.where(F.col("_h") <= (lowest[-1] if lowest else 0)).groupBy("_h").agg(F.first(text).alias(text))
    sample = cut(statistics(few, text))
    rejects = rules(text)
    order = cascade_order(sample, rejects)
    failed = (F.col("quality.n_words") < 20) | (100 * F.col("quality.n_repeat_words") > 30 * F.col("quality.n_words"))
    return statistics(docs, text).withColumn("base_failed", failed).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(first_hit(rejects, order)))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's counts and verdict."""
    done = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"quality.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", F.col("rejected_by").isNull().alias("kept"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls FROM documents
), win AS (
  SELECT doc_id, k, ws[k:k+7] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 8)
), cov AS (
  SELECT doc_id, count(DISTINCT k + i) AS n FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(8) r(i) WHERE c > 1 GROUP BY doc_id
), s AS (
  SELECT w.doc_id, t, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 10 > n_words * 3) AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
  AND NOT (len(ls) >= 5 AND n_dup_lines * 10 > len(ls) * 3) AND NOT (length(regexp_replace(t, '[^\p{L}]+', '', 'g')) * 2 < word_chars)
  AND NOT (len(list_filter(ls, lambda x: suffix(rtrim(x), '...'))) * 10 > len(ls) * 3) AS kept
FROM b
"""
