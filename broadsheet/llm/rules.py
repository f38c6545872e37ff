"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Measures are counts of a text; a rule bounds the ratio of two of them. All are column expressions:
the text is read once, row by row, without shuffle or user function. Values that several expressions
share are bound by a one-element ``transform``, as an expression named twice would be computed twice,
and one used inside a lambda for every element.

A null text counts as empty: it has no words and fails the base rule. Repeated rows are judged alike
and stay; very long texts are read whole; an empty table gives no row; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import SPACE

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by are this from or an at not "
    "der die und das zu den von mit ist für auf nicht ein eine als auch sich des dem im "
    "de la que el en y los del se las por un para con no una su al lo "
    "le et les des du est pour qui dans sur pas au plus avec"
).split()


@dataclass(frozen=True)
class Rule:
    """``least <= over / under <= most``; a ratio with nothing below is 0."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("stop_words", "n_stop_words", "n_words", least=0.05),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("upper_case", "n_upper", "word_chars", most=0.5),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more."""
    size = F.size(words)

    def of_hashes(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_ordered(rows: Column) -> Column:
            last = F.size(rows) - 1
            twice = F.filter(
                rows,
                lambda x, j: ((j > 0) & (x["h"] == F.get(rows, j - 1)["h"]))
                | ((j < last) & (x["h"] == F.get(rows, j + 1)["h"])),
            )
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return bound(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                    F.lit(0), lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bound(ordered, of_ordered)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), size - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))),
    )
    return F.when(size <= WINDOW, F.lit(0)).otherwise(bound(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t["text"], "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        plain = F.translate(t["text"], SPACES, "")
        return F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            F.length(plain).cast("long").alias("word_chars"),
            (F.length(t["text"]) - F.length(F.translate(t["text"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(t["words"]).cast("long").alias("n_repeat_words"),
            F.size(F.filter(t["words"], lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.regexp_count(t["text"], F.lit("[A-Z]")).cast("long").alias("n_upper"),
        )

    return bound(F.struct(text.alias("text"), words.alias("words")), of)


def ratio(rule: Rule, counts: Column) -> Column:
    return F.when(counts[rule.under] == 0, F.lit(0.0)).otherwise(counts[rule.over] / counts[rule.under])


def passes(rule: Rule, counts: Column) -> Column:
    value = ratio(rule, counts)
    low = F.lit(True) if rule.least is None else value >= rule.least
    high = F.lit(True) if rule.most is None else value <= rule.most
    return low & high


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the names of the ``broken`` rules, per row."""
    counts = docs.select("doc_id", measures(F.col("text")).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    broken = F.array_compact(F.array(*(F.when(~passes(r, m), F.lit(r.name)) for r in rules)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counts.select("doc_id", "m", failed.alias("base_failed"), broken.alias("broken")).select(
        "doc_id", *(m[c].alias(c) for c in names), "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        F.array_join("broken", ",").alias("broken"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

    def broken(rule: Rule) -> str:
        value = f"(CASE WHEN {rule.under} = 0 THEN 0.0 ELSE {rule.over}::DOUBLE / {rule.under} END)"
        tests = [f"{value} < {rule.least}"] * (rule.least is not None) + [f"{value} > {rule.most}"] * (rule.most is not None)
        return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win),
cov AS (SELECT r, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS step FROM dup WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(step, 5))) AS n FROM cov GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len([x for x in ws if lower(x) IN ({stop})])::BIGINT AS n_stop_words,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN rep USING (r)),
j AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
             concat_ws(',', {', '.join(broken(r) for r in rules)}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken = '') AS kept, broken
FROM j
"""
