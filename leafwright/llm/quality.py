"""Quality rules: a table of thresholds compiled into one Spark projection.

Every rule compares ``numerator`` with ``percent`` hundredths of ``denominator``, both counts of the
text, in whole numbers.  ``compile_rules`` turns the table into one boolean expression, so adding a
rule is adding a row.  Nothing but built-in functions runs, and no row meets another: the plan is a
scan and a projection.

Defined results: a null text counts as empty; an empty or blank text has no words and fails the base
rule; repeated rows are judged alike; an empty table gives an empty result; other columns of the
input pass through ``judge`` unless they carry one of the names it adds, which then is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import GAP, WORD, read, whole, words
from leafwright.llm.registry import query

# Frequent function words of the four languages of the corpus.
STOP_WORDS = """
a an and are as at be by for from he in is it of on or that the this to was were will with you
au aux avec dans de des du elle en est et il la le les ne pas pour par que qui se sur un une
al como con del el en es esta la las lo los más no para por que se sin su un una y
auf auch das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu
""".split()


@dataclass(frozen=True)
class Rule:
    """``numerator`` must be at least (or at most) ``percent`` hundredths of ``denominator``."""

    name: str
    numerator: str
    side: str
    percent: int
    denominator: str


RULES = [
    Rule("mean word length", "word_chars", "at least", 200, "n_words"),
    Rule("mean word length", "word_chars", "at most", 1500, "n_words"),
    Rule("symbols per word", "n_symbols", "at most", 20, "n_words"),
    Rule("stop words", "n_stop_words", "at least", 4, "n_words"),
    Rule("repeated lines", "n_dup_lines", "at most", 50, "n_lines"),
]
ADDED = [
    "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept",
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compile_rules(rules: list[Rule]) -> Column:
    """The rules as one expression over the columns ``measure`` adds."""
    verdict = F.lit(True)
    for rule in rules:
        left, right = F.col(rule.numerator) * 100, F.col(rule.denominator) * rule.percent
        verdict &= (left >= right) if rule.side == "at least" else (left <= right)
    return verdict


def sql_rules(rules: list[Rule]) -> str:
    """The same expression as SQL."""
    sign = {"at least": ">=", "at most": "<="}
    return " AND ".join(
        f"{r.numerator} * 100 {sign[r.side]} {r.denominator} * {r.percent}" for r in rules
    )


def measure(docs: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    whole_text = whole(text)
    lines = F.filter(F.split(whole_text, "\n"), lambda x: x.rlike(f"[^{GAP}]"))
    base = docs.withColumns({"__words": words(text), "__lines": lines})
    n = F.size("__words")
    at = lambda i: F.element_at("__words", i)
    # Windows sorted by content: equal windows are neighbours, and each keeps its position.
    windows = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i")),
            )
        ),
    )
    counted = base.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.translate(whole_text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (
                F.char_length(whole_text) - F.char_length(F.translate(whole_text, "#*$%&|<>", ""))
            ).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(stop_words))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": windows,
        }
    )
    m = F.size("__windows")
    window = lambda k: F.element_at("__windows", k)
    like_neighbour = lambda k: (
        (k > 1) & (window(F.greatest(k - 1, F.lit(1)))["w"] == window(k)["w"])
    ) | ((k < m) & (window(F.least(k + 1, m))["w"] == window(k)["w"]))
    repeated = F.filter(F.sequence(F.lit(1), m), like_neighbour)
    covered = F.flatten(
        F.transform(repeated, lambda k: F.array(*[window(k)["i"] + d for d in range(3)]))
    )
    n_repeat = F.when(m >= 2, F.size(F.array_distinct(covered))).otherwise(0).cast("long")
    return counted.withColumn("n_repeat_words", n_repeat).drop("__words", "__lines", "__windows")


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    measured = measure(docs, text).withColumn("base_failed", failed)
    verdict = (~F.col("base_failed") & compile_rules(rules)).alias("kept")
    names = [c for c in ADDED if c != "kept"]
    kept = [c for c in docs.columns if c not in ADDED]
    # As the output of a generator the verdict is computed once: a later filter on it can't be pushed
    # below, where the optimizer would spell out every measure again at each place it is used.
    return measured.select(*kept, F.inline(F.array(F.struct(*names, verdict))))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL_MEASURES = rf"""
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{GAP}]')) AS l FROM texts),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM parts WHERE len(w) >= 3),
spelled AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM windows),
twice AS (SELECT doc_id, i FROM spelled QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM twice),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[{GAP}]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM parts LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed
  FROM measures)"""

OP4_SQL = f"""
WITH {SQL_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {sql_rules(RULES)} AS kept
FROM judged"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark, sf_dir):
    """Every document with its measures and the verdict of the rule table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
