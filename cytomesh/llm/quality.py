"""Line-first cleaning: rules on every line, then a verdict on what is left of the document.

A line with words fails when it is
* punctuation: more than ``MARKS_SHARE`` of its characters other than white space are neither letters, with their
  combining marks and joiners, nor digits nor common sentence marks, or most of its words end in a doubled mark,
* navigation: separators between its parts, as in menus and tables, are as many as every ``BAR_WORDS``-th word,
* boilerplate: it holds one of ``BOILERPLATE`` and is short,
* repeated: an equal line stands before it.
Lines without words, such as those between paragraphs, stay where they are. Failing lines are removed. A document is rejected when less than ``KEEP_SHARE`` of its words are left.

Everything is a built-in expression on one row: no shuffle, linear in the text but for one sort of the five-word windows
of documents that repeat some.

Defined results: null and empty texts have no words and are rejected by the base rule. Rows are judged one by one, so
repeated rows and ids get equal results. ``assess`` keeps all input columns whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import SPACES, table, words

#: Fixed by the task.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20

#: Parameters of the method.
MARKS_SHARE = 0.2
BAR_WORDS = 4
BOILERPLATE = ("javascript is disabled", "enable cookies", "accept all cookies", "all rights reserved", "privacy policy", "terms of use", "lorem ipsum", "click here", "sign up")
BOILERPLATE_WORDS = 20
KEEP_SHARE = 0.5

HAS_WORD = r"[^\x20\x09-\x0D]"
#: Sentence marks of other scripts: Armenian, Hebrew, Arabic, Indic, Myanmar, Ethiopic, Khmer, Tibetan, East Asian.
SCRIPT_MARKS = r"\u055A-\u055F\u0589\u05BE\u05C3\u05F3\u05F4\u060C\u061B\u061F\u06D4\u0964\u0965\u104A\u104B\u1361-\u1368\u17D4-\u17D6\u0F0B-\u0F0E\u3001\u3002\u3008-\u3011\u30FB\uFF01\uFF08\uFF09\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F"
ODD_MARK = r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-–—’“”«»¿¡\u200C\u200D" + SCRIPT_MARKS + "]"
DOUBLED = r"[!?*#$%&]{2,}(?=[\x20\x09-\x0D]|$)"
BAR = r"(?:^|[\x20\x09])[|»›·•](?=[\x20\x09]|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern)) - 1


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def numbered_blanks(lines: Column) -> Column:
    """The lines, those without words preceded by their number between line ends, so that no two of them are equal."""
    return F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), x).otherwise(F.concat(F.lit("\n"), i, F.lit("\n"), x)))


def line_verdict(line: Column) -> Column:
    """Struct (line, n, ok) of a line of ``numbered_blanks`` and its number of words. Lines without words are fine."""

    def judge(n: Column) -> Column:
        marks = F.length(F.regexp_replace(line, ODD_MARK, F.lit(""))) < F.length(line) * (1 - MARKS_SHARE)
        bars = let(matches(line, BAR), lambda k: (k > 0) & (k * BAR_WORDS >= n))
        low = let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))
        bad = marks | (2 * matches(line, DOUBLED) > n) | bars | ((n < BOILERPLATE_WORDS) & low)
        return F.struct(line.alias("line"), n.cast("bigint").alias("n"), (~bad).alias("ok"))

    blank = F.struct(F.substring_index(line, "\n", -1).alias("line"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("ok"))
    return F.when(F.startswith(line, F.lit("\n")), blank).otherwise(let(F.size(words(line)), judge))


def repeated_words(w: Column) -> Column:
    """Words inside five-word windows that the text holds at least twice, the first included."""

    def places(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))

    def of_windows(h: Column) -> Column:
        # windows are put in order only where some window is repeated
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(let(places(h), twins), covered))

    def windows(hw: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(hw) - WINDOW + 1)
        return F.transform(steps, lambda i: F.xxhash64(*[F.get(hw, i + (k - 1)) for k in range(WINDOW)]))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(let(hashed, windows), of_windows))


def verdict(text: Column) -> Column:
    """All results for one text as a struct, each intermediate value computed once."""

    def of_words(t: Column, w: Column) -> Column:
        n = F.size(w).cast("bigint")

        def of_lines(lines: Column) -> Column:
            worded = F.filter(lines, lambda x: x.rlike(HAS_WORD))
            dups = let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")

            # equal lines with words are judged once, the later ones fail as repeated; lines without words all stay
            def of_good(good: Column) -> Column:
                def result(repeated: Column) -> Column:
                    failed = (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
                    left = total(F.transform(good, lambda x: x["n"]))
                    return F.struct(
                        n.alias("n_words"), total(F.transform(w, F.length)).alias("word_chars"),
                        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, F.lit("")))).cast("bigint").alias("n_symbols"),
                        dups.alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"), left.alias("clean_words"),
                        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
                        (~failed & (left >= n * F.lit(KEEP_SHARE))).alias("kept"),
                    )

                return let(repeated_words(w), result)

            judged = F.transform(F.array_distinct(numbered_blanks(lines)), line_verdict)
            return let(F.filter(judged, lambda x: x["ok"]), of_good)

        return let(F.split(t, "\n"), of_lines)

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of_words(t, w)))


def assess(docs: DataFrame) -> DataFrame:
    """``row`` (the input row as a struct) and ``v`` (the struct of ``verdict``)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(own, verdict(F.col("text")).alias("v"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of kept documents, their text replaced by the lines that passed and ``n_chars``, if there, by its length."""
    text = F.col("v.clean_text")
    changed = {"text": text, "n_chars": F.length(text).cast("bigint")}
    good = assess(docs).select("row", F.explode(F.filter(F.array("v"), lambda v: v["kept"])).alias("v"))
    return good.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"v.{c}").alias(c) for c in names])


#: ODD_MARK as DuckDB's patterns spell it.
ODD_MARK_SQL = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", ODD_MARK).replace("'", "''")

QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM pos),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hit) GROUP BY r),
lines AS (SELECT r, n, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k
  FROM (SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM d)),
once AS (SELECT DISTINCT r, line, k FROM lines),
judged AS (
  SELECT r, k, k = 0 OR NOT (
    length(regexp_replace(line, 'ODD_MARK', '', 'g')) < length(line) * 0.8
    OR 2 * (len(regexp_extract_all(line || ' ', '[!?*#$%&]{2,}[\x20\x09-\x0D]'))) > k
    OR (bars > 0 AND bars * 4 >= k)
    OR (k < 20 AND (contains(lower(line), 'javascript is disabled') OR contains(lower(line), 'enable cookies') OR contains(lower(line), 'accept all cookies')
      OR contains(lower(line), 'all rights reserved') OR contains(lower(line), 'privacy policy') OR contains(lower(line), 'terms of use')
      OR contains(lower(line), 'lorem ipsum') OR contains(lower(line), 'click here') OR contains(lower(line), 'sign up')))) AS ok
  FROM (SELECT *, len(list_filter(string_split(replace(line, chr(9), ' '), ' '), lambda x: x IN ('|', '»', '›', '·', '•'))) AS bars FROM once)),
sums AS (SELECT r, coalesce(sum(k) FILTER (WHERE ok), 0) AS clean_words FROM judged GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE k > 0 GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w)) AND clean_words >= len(w) * 0.5 AS kept
FROM d LEFT JOIN rep USING (r) LEFT JOIN dups USING (r) LEFT JOIN sums USING (r)
""".replace("ODD_MARK", ODD_MARK_SQL)
