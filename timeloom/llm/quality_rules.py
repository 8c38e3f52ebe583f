"""Quality rules with DataFrame operations only: per-document counts and lines that many documents of a host share.

Lines are normalised (lower case, outer white space dropped, runs of digits as one 0) and hashed. The documents of a host
that hold a line are counted; lines held by more than ``max_docs`` of them are removed, each time they stand in a document,
and a document left with less than ``min_left`` of the characters of its lines is rejected. Each text is split once: the
counts and the hashed lines of a document are written together and read for both steps.

Defined results: a null text has no words and no lines; a null source is a host of its own; repeated rows and null ids
give a row each and count as a document each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import WORD, cut, let

SYMBOLS = "[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words of ``words`` that lie in a 3-word window found twice or more, the first place included.

    Window hashes are sorted with their places, so the work is n log n for a text of any length.
    """

    def places(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, lambda s: F.sort_array(F.array_compact(F.transform(s, lambda x, j: F.when(F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"])))))

    def covered(found: Column) -> Column:
        return F.aggregate(F.transform(found, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(found, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(places(grams), covered))

    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(grams, counted))


def words_of(text: Column) -> Column:
    """The runs without ASCII white space; splitting at one plain character needs no pattern for each word."""
    return F.filter(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), "[0-9]+", "0")


def _host() -> Column:
    return F.xxhash64(F.col("source").isNull(), "source")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, host``, the counts, ``base_failed`` and ``lines``: hash, length, and whether it is the first of its kind in the document."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words"))

    def first_marked(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct(x["lh"].alias("lh"), x["n"].alias("n"), (~F.coalesce(F.get(lines, i - 1)["lh"] == x["lh"], F.lit(False))).alias("first")))

    def of_lines(lines: Column) -> Column:
        hashed = F.sort_array(F.transform(lines, lambda x: let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("lh"), F.length(y).alias("n")))))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), let(hashed, first_marked).alias("lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    made = docs.select("doc_id", _host().alias("host"), let(words_of(text), of_words).alias("_w"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), let(lines, of_lines).alias("_l"))
    made = made.select("doc_id", "host", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.lines")
    return made.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def common_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """``host, lh`` of the lines that more than ``max_docs`` documents of the host hold."""
    return lines.groupBy("host", "lh").agg(F.sum(F.col("first").cast("long")).alias("_c")).filter(F.col("_c") > max_docs).select("host", "lh")


def judge(docs: DataFrame, max_docs: int = 100, min_left: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``share_left`` (of the characters of all lines)."""
    base = cut(measured(docs).withColumn("_rid", F.monotonically_increasing_id()), "quality")
    lines = base.select("_rid", "host", F.explode("lines").alias("_x")).select("_rid", "host", "_x.*")
    removed = lines.join(common_lines(lines, max_docs), ["host", "lh"]).groupBy("_rid").agg(F.sum("n").alias("_removed"))
    of_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    made = base.withColumn("_of", of_chars).drop("lines").join(removed, "_rid", "left")
    left = F.when(F.col("_removed") > 0, (F.col("_of") - F.col("_removed")) / F.col("_of")).otherwise(1.0)
    kept = ~F.col("base_failed") & (left >= min_left)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), left.alias("share_left"))


def without_common_lines(docs: DataFrame, max_docs: int = 100) -> DataFrame:
    """The documents, with all their columns, without the lines that more than ``max_docs`` documents of their host hold."""
    hashed = lambda x: F.xxhash64(normalised(x))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), _host().alias("host"), "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"))
    rows = cut(rows, "quality-texts")
    lines = rows.select("rid", "host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), hashed))).alias("lh"), F.lit(True).alias("first"))
    gone = lines.join(common_lines(lines, max_docs), ["host", "lh"]).groupBy("rid").agg(F.collect_set("lh").alias("gone"))  # of one document's lines
    rows = rows.join(gone, "rid", "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains("gone", hashed(x)))), "\n")
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    return rows.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


#: The same in SQL, for an engine with lists.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM twice, (VALUES (0), (1), (2)) AS o(k)) GROUP BY rid),
lines AS (SELECT rid, host, regexp_replace(regexp_replace(lower(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[0-9]+', '0', 'g') AS l FROM (SELECT rid, host, unnest(ls) AS l FROM w)),
used AS (SELECT host, l, count(DISTINCT rid) AS c FROM lines GROUP BY host, l),
left_over AS (SELECT rid, sum(length(l)) AS of_chars, sum(CASE WHEN c > 100 THEN length(l) ELSE 0 END) AS removed FROM lines JOIN used USING (host, l) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 CASE WHEN coalesce(removed, 0) > 0 THEN (of_chars - removed) / of_chars::DOUBLE ELSE 1.0 END AS share_left
 FROM w LEFT JOIN rep USING (rid) LEFT JOIN left_over USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share_left >= 0.5 AS kept, share_left FROM m
"""
