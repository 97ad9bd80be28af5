"""Quality rules: one Spark projection of counts and ratios, compiled with a threshold table into a verdict.

Everything is a built-in column expression; there is no user function and no shuffle. Windows of a text are
compared inside its own row: their hashes are sorted, so a text of n words costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import SPACE, SPACE_CHARS, unused

SYMBOLS = "#*$%&|<>"

#: Very frequent function words of the languages that the corpus is written in.
STOP_WORDS = (
    # English
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the they this to was we were which with you "
    # French
    "au aux ce dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qui que sa se son sur un une vous "
    # German
    "am auf aus bei das dem den der des die ein eine er es für hat ich ihr im in ist mit nicht sich sie sind so und von war wie wir zu "
    # Spanish
    "al como con de del el en era es esta fue ha la las lo los más no o para pero por que se sin su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when ``ratio``, a column of :func:`ratios`, is under ``least`` or over ``most``."""

    ratio: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are per word or per line, so that they mean the same for any length.
RULES = (
    Rule("n_words", least=10, most=200_000),
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.25),
    Rule("stop_words_per_word", least=0.02),
    Rule("dup_lines_per_line", most=0.5),
)


def repeat_words(df: DataFrame, words: str, n: int = 5) -> DataFrame:
    """Add ``n_repeat_words``: the words inside windows of ``n`` words that occur twice or more in the array ``words``."""
    windows, placed, starts = unused(df.columns, "windows", "placed", "starts")
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(n))))
    df = df.withColumn(windows, F.when(F.size(words) >= n, hashes).otherwise(F.array().cast("array<bigint>")))
    sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(placed, F.when(F.size(F.array_distinct(windows)) < F.size(windows), sorted_).otherwise(none)).drop(windows)
    twice = F.filter(placed, lambda x, j: (x["h"] == F.get(F.col(placed), j - 1)["h"]) | (x["h"] == F.get(F.col(placed), j + 1)["h"]))
    df = df.withColumn(starts, F.sort_array(F.transform(twice, lambda x: x["i"]))).drop(placed)
    reach = F.transform(starts, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(F.col(starts), j + 1) - p, F.lit(n))))
    return df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)).drop(starts)


def ratios(df: DataFrame) -> dict[str, Column]:
    """The ratios that rules may test, from the counts of :func:`measure`; null where there is no word."""
    per_word = lambda name: F.col(name) / F.nullif(F.col("n_words"), F.lit(0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "stop_words_per_word": per_word("n_stop_words"),
        "dup_lines_per_line": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeat_words_per_word": per_word("n_repeat_words"),
    }


#: What :func:`measure` and :func:`verdict` add, and replace where the input has it.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
VERDICTS = ("base_failed", "failed_rules", "kept")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``COUNTS`` for each text, leaving every other column alone.

    Null and empty texts have zero of everything. Columns of ``df`` named in ``COUNTS`` are replaced. Nothing is cut off: a text of n words takes
    memory in proportion to n.
    """
    df = df.drop(*COUNTS)
    words, lines = unused([*df.columns, *COUNTS], "words", "lines")
    base = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, F.filter(F.split(base, SPACE), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(base, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0))
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()")))
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(base, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(base, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_stop_words": F.size(F.filter(bare, lambda w: w.isin(*STOP_WORDS))).cast("long"),
        }
    ).drop(lines)
    return repeat_words(df, words).drop(words)


def verdict(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` and ``kept`` to the output of :func:`measure`.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated windows. ``kept``: neither that nor
    any rule fails; a ratio that is null fails its rule.
    """
    df = df.drop(*VERDICTS)
    columns = ratios(df)
    tests = []
    for rule in rules:
        x = columns[rule.ratio]
        bad = x.isNull()
        if rule.least is not None:
            bad = bad | (x < rule.least)
        if rule.most is not None:
            bad = bad | (x > rule.most)
        tests.append(F.when(bad, F.lit(rule.ratio)))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    df = df.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*tests))})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measure and judge every text: all columns of ``df`` plus the counts, ``base_failed``, ``failed_rules``, ``kept``.

    An empty table gives an empty table; repeated rows are judged alike; a null or empty text fails. Columns with the names of what is added are replaced.
    """
    return verdict(measure(df, text), rules)


__all__ = ["RULES", "Rule", "apply_rules", "measure", "verdict"]
