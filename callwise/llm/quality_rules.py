"""Line-first cleaning: rules judge single lines, documents are judged by what is left.

A line with a word fails when it

* is mostly symbols: over ``SYMBOL_PERCENT`` % of its characters are in ``[#*$%&|<>]``
  (markup, tables, separator-style navigation bars),
* shouts: at least ``SHOUT`` capital letters A-Z and more of them than of a-z,
* is navigation: at most ``NAV_WORDS`` words and no closing punctuation,
* matches a boilerplate phrase, or repeats an earlier line of the text.

The failing lines are removed; a document is rejected when less than
``KEEP_PERCENT`` % of the characters of its lines is left, or by the base rule
(under 50 words, or over half of the words in repeated three-word windows).

Everything is DataFrame functions on one row: no shuffle, no Python, any text
length. Three-word windows are compared by 64-bit hash within one text.

Defined results: a null text is a text without words; null ids and other columns
stay; repeated rows are judged alike; an empty table gives an empty table. An input
column named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SYMBOL_PERCENT = 5
SHOUT = 8
NAV_WORDS = 3
KEEP_PERCENT = 50
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLOSED = r"[.!?:;,\x22')\]…»”]$"
BOILERPLATE = "all rights reserved|terms of (use|service)|privacy policy|cookie policy|enable javascript|click here to|sign up for our|skip to (main )?content"
_BLANK = r"[\x20\x09-\x0D]+"


def _count(line, chars: str):
    return F.length(line) - F.length(F.translate(line, chars, ""))


def line_passes(line):
    """Verdict on one line that has a word (repeats aside)."""
    plain = F.trim(F.translate(line, "\t\n\x0b\x0c\r", "     "))
    words = F.size(F.split(plain, " +"))
    return (
        (100 * _count(line, SYMBOLS) <= SYMBOL_PERCENT * F.length(line))
        & ((_count(line, CAPITALS) < SHOUT) | (_count(line, CAPITALS) <= _count(line, SMALL)))
        & (plain.rlike(CLOSED) | (words > NAV_WORDS))
        & ~F.lower(line).rlike(BOILERPLATE))


def judged(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines and n_lines_kept (lines with a word), line_chars,
    kept_chars, cleaned (the kept lines) and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "n_lines", "n_lines_kept", "line_chars", "kept_chars", "cleaned", "kept"]
    work = ["_t", "_flat", "_w", "_h", "_s", "_p", "_lines", "_good"]
    text = F.coalesce(F.col(column), F.lit("")).alias("_t")
    d = docs.select(*[c for c in docs.columns if c not in made + work], text)
    d = d.withColumn("_flat", F.trim(F.regexp_replace("_t", _BLANK, " ")))
    d = d.withColumn("_w", F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", " ")))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate("_flat", " ", "")).cast("long"))
    d = d.withColumn("n_symbols", _count(F.col("_t"), SYMBOLS).cast("long"))
    # hashes of the three-word windows, with their places only where some repeat
    d = d.withColumn("_h", F.expr(
        "if(n_words < 4, array(), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    d = d.withColumn("_s", F.expr(
        "if(size(_h) = size(array_distinct(_h)), null, sort_array(transform(_h, (h, i) -> struct(h, i))))")).drop("_h", "_w")
    d = d.withColumn("_p", F.expr(
        "if(_s is null, null, sort_array(transform(filter(sequence(0, size(_s) - 1), k -> (k > 0 and _s[k].h = get(_s, k - 1).h)"
        " or (k + 1 < size(_s) and _s[k].h = get(_s, k + 1).h)), k -> _s[k].i)))")).drop("_s")
    d = d.withColumn("n_repeat_words", F.expr(
        "if(_p is null, 0L, aggregate(sequence(1, size(_p)), 0L, (a, k) -> a + if(k = size(_p), 3, least(3, get(_p, k) - _p[k - 1]))))")).drop("_p")
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    d = d.withColumn("_good", F.array_distinct(F.filter("_lines", line_passes)))
    return (d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_lines_kept", F.size("_good").cast("long"))
            .withColumn("line_chars", F.length(F.array_join("_lines", "")).cast("long"))
            .withColumn("kept_chars", F.length(F.array_join("_good", "")).cast("long"))
            .withColumn("cleaned", F.array_join("_good", "\n"))
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= KEEP_PERCENT * F.col("line_chars")))
            .drop("_t", "_flat", "_lines", "_good"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars renewed."""
    cols = docs.columns
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    # Pushed below the projections, the filter would repeat all their expressions inside
    # each other; a projection with a random column (always under 1) keeps it in its place.
    rest = F.struct(F.lit(None).cast("int").alias("_"), *[c for c in cols if c not in new]).alias("_doc")
    found = judged(docs.select(F.col("text").alias("_raw"), rest), "_raw").withColumn("_one", F.rand(0))
    return found.where("kept and _one < 1").select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in cols])


def op9_line_first(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept", "n_lines", "n_lines_kept", "kept_chars")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT k, i FROM tri JOIN (SELECT k, g FROM tri GROUP BY k, g HAVING count(*) > 1) USING (k, g)),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k),
ln AS (SELECT k, i, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS p
       FROM (SELECT k, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
v AS (SELECT k, l, min(i) AS i, count(*) AS n, bool_and(
        100 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) <= 5 * length(l)
        AND (length(l) - length(regexp_replace(l, '[A-Z]', '', 'g')) < 8
             OR length(l) - length(regexp_replace(l, '[A-Z]', '', 'g')) <= length(l) - length(regexp_replace(l, '[a-z]', '', 'g')))
        AND (regexp_matches(p, '[.!?:;,"'')\]…»”]$') OR len(regexp_split_to_array(p, '[\x20\x09-\x0D]+')) >= 4)
        AND NOT regexp_matches(lower(l), '""" + BOILERPLATE + r"""')) AS ok
      FROM ln GROUP BY k, l),
ls AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n) - count(*) AS BIGINT) AS n_dup, CAST(count(*) FILTER (ok) AS BIGINT) AS n_ok,
              CAST(sum(n * length(l)) AS BIGINT) AS chars, CAST(coalesce(sum(length(l)) FILTER (ok), 0) AS BIGINT) AS ok_chars FROM v GROUP BY k),
s AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(ls.n_dup, 0) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(ls.n_lines, 0) AS n_lines, coalesce(ls.n_ok, 0) AS n_lines_kept,
             coalesce(ls.ok_chars, 0) AS kept_chars, coalesce(ls.chars, 0) AS line_chars
      FROM d JOIN w USING (k) LEFT JOIN cov USING (k) LEFT JOIN ls USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= 50 * line_chars AS kept, n_lines, n_lines_kept, kept_chars FROM b
"""
