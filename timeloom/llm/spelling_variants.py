"""Spelling variants: words one edit apart, found through sorted permuterm rotations, and the frequent form of each rare one.

A word is marked with a terminator and rotated at each place. What differs between two words one edit apart is then at the end:
``u c v`` rotates to ``v$u`` and ``c``, so words that differ in one replaced character share a rotation's prefix ``v$u`` of all but
its last character, and the word without that character, ``u v``, has that prefix as a whole rotation. All rotations are sorted by
prefix, and each prefix is one group: at most one word that ends there and one word for each character that may follow. A group
thus holds no more rows than the alphabet (and one), however many words there are; groups of one row go at once. No pairs are
emitted: a member counts the others of its group and takes the best of them. An inserted character that repeats its neighbour
can be taken out at more than one place; only the first of a run of equal characters counts, so each near word counts once.

Forms lead from a word to one at least ``ratio`` times as frequent, so a chain has no more steps than the logarithm of the largest
count, and roots are found by so few rounds of doubling.

Defined results: null texts have no words; a null id changes no word; repeated rows count as often as they stand; an empty table
gives an empty result; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm._shared import cut, discard

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters of a word; only A-Z are lowered.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Stands at the end of a word; no word has it.
MARK = "$"


def occurrences(docs: DataFrame, least_length: int = 7) -> DataFrame:
    """``word`` of each maximal run of letters of at least ``least_length`` code points, by the rule of planted slips.

    Where 31 divides the CRC-32 of ``doc_id:run``, the run loses the code point at that number modulo its length.
    """
    # a shorter run can't give a longer word
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = 2) -> DataFrame:
    """``word, n`` of the words that occur ``least_count`` times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, last, n``: each rotation of a marked word without its last character, and as a whole (``last`` empty)."""
    marked = words.select(F.concat("word", F.lit(MARK)).alias("m"), F.length("word").alias("len"), "n")

    def both(i: Column) -> Column:
        tail, head = F.substring(F.col("m"), i + 1, F.col("len") + 1), F.substring(F.col("m"), F.lit(1), i)
        whole = F.struct(F.concat(tail, head).alias("prefix"), F.lit("").alias("last"))
        skip = F.struct(F.concat(tail, F.substring(F.col("m"), F.lit(1), i - 1)).alias("prefix"), F.substring(F.col("m"), i, F.lit(1)).alias("last"))
        return F.when(i == 0, F.array(whole)).otherwise(F.array(whole, skip))

    return marked.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("len")), both))).alias("r"), "n").select("r.prefix", "r.last", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near`` (how many words are one edit away) and ``best``, the one of largest ``n`` (then least): ``neg`` (minus its n), ``word``.

    ``words``: distinct ``word`` and ``n``. Words without neighbours are left out.
    """
    scan = Window.partitionBy("prefix").orderBy("last")
    sorted_rows = rotations(words).withColumns({"_before": F.lag("last").over(scan), "_after": F.lead("last").over(scan)})
    met = sorted_rows.filter("_before IS NOT NULL OR _after IS NOT NULL")
    # a group is bounded by the alphabet
    groups = met.groupBy("prefix").agg(F.collect_list(F.struct("last", "n")).alias("m"), F.count_if(F.col("last") != "").alias("n_skip"))
    v, u = F.substring_index("prefix", MARK, 1), F.substring_index("prefix", MARK, -1)
    member = lambda x: F.struct((-x["n"]).alias("neg"), F.concat(F.col("u"), x["last"], F.col("v")).alias("word"), x["last"].alias("last"), ((x["last"] != "") & (x["last"] != F.col("u_end"))).alias("first_of_run"))
    groups = groups.withColumns({"v": v, "u": u}).withColumn("u_end", F.right("u", F.lit(1))).withColumn("m", F.sort_array(F.transform("m", member)))
    counts = groups.withColumns({"n_first": F.size(F.filter("m", lambda x: x["first_of_run"])), "whole": F.size("m") > F.col("n_skip")})

    def seen(x: Column, i: Column) -> Column:
        near = F.when(x["last"] == "", F.col("n_first")).otherwise(F.col("n_skip") - 1 + (F.col("whole") & x["first_of_run"]).cast("int"))
        other = F.when(i == 0, F.get("m", F.lit(1))).otherwise(F.get("m", F.lit(0)))
        return F.struct(x["word"].alias("word"), near.alias("near"), F.struct(other["neg"].alias("neg"), other["word"].alias("word")).alias("other"))

    rows = counts.select(F.explode(F.transform("m", seen)).alias("x")).select("x.*")
    return rows.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame, most_steps: int) -> DataFrame:
    """``word, root`` of ``word, form`` rows whose chains have at most ``most_steps`` steps."""
    hops = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(most_steps)) if most_steps > 1 else 0):
        after = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        before, hops = hops, cut(hops.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
        discard(before)
    return hops


def variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``docs``."""
    words = cut(vocabulary(occurrences(docs)), "spelling-words")
    most = words.agg(F.max("n")).first()[0] or 1
    found = neighbours(words)
    form_n = -F.col("best.neg")
    frequent = form_n >= ratio * F.col("n")
    made = cut(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, form_n).alias("form_n")), "spelling-forms")
    discard(words)
    ends = roots(made.filter("form IS NOT NULL").select("word", "form"), int(log(most, ratio)) + 1)
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: words that agree without one character.
SQL = r"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7),
bytes AS MATERIALIZED (SELECT run, count(*) AS n, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))) AS b FROM runs GROUP BY doc_id, run),
h AS MATERIALIZED (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(w := other, n := n), struct_pack(a := -n, b := encode(other))) AS f FROM pairs GROUP BY word),
made AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 10 * w.n THEN f.w END AS form, CASE WHEN f.n >= 10 * w.n THEN f.n END AS form_n FROM w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, coalesce(form, word) AS root, 1 AS k FROM made UNION ALL SELECT c.word, m.form, k + 1 FROM chain c JOIN made m ON m.word = c.root WHERE m.form IS NOT NULL)
SELECT m.word, m.form, r.root, m.n, m.n_near, m.form_n FROM made m JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r ON r.word = m.word
"""
