import math
import re

import pytest

from barwright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def kept(text):
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, dup, _, failed = brute(text)
    if failed:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = sum(w.lower().strip(".,;:!?\"'()") in set(quality.STOP_WORDS) for w in words)
    return 10 <= n <= 200_000 and 2 <= chars / n <= 14 and symbols / n <= 0.25 and stop / n >= 0.02 and dup / len(lines) <= 0.5


GOOD = "The house is on the hill and it was built by a man who had no money at all."
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h i", "a b c d e f g h i j", GOOD, GOOD + "\n" + GOOD, GOOD + "\n\n" + "other line of the text\n" * 3, "x " * 40, "# * $ % & | < > the is",
    "\x0b\x0cvertical\x0bthe\x0cfeed " + GOOD, "no break space " + GOOD, "\U0001f600 é the " + GOOD, "word\r\nthe line\r\n" + GOOD, "a b c d e a b c d e f", "supercalifragilisticexpialidocious " * 12,
]


@pytest.fixture(scope="module")
def long_text():
    return " ".join(f"the{k % 9973}" if k % 5 else "and" for k in range(150_000))


def test_counts_and_verdict_by_brute_force(spark, long_text):
    rows = [(k, t) for k, t in enumerate([*TEXTS, long_text])]
    rows += [(3, "one"), (3, "one"), (None, GOOD)]
    got = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in COUNTS) == brute(r.text), r.text and r.text[:80]
        assert r.kept == kept(r.text) and (r.kept or r.base_failed or r.failed_rules)
    assert sum(r.kept for r in got) >= 5 and any(r.n_repeat_words for r in got)


def test_columns_with_the_names_of_the_plan_stay(spark):
    names = ["words", "lines", "starts", "windows", "placed", "words_", "WINDOWS_"]
    df = spark.createDataFrame([(1, GOOD, *names, 5, "old")], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names) + ", n_words int, kept string")
    row = quality.apply_rules(df).first()
    assert [row[c] for c in names] == names
    assert row.n_words == len(WORD.findall(GOOD)) and row.kept is True


def test_thresholds_at_their_borders(spark):
    words = [("a" if k % 10 == 0 else "bcdef") + str(k) for k in range(10)]
    rows = [(1, " ".join([*words[:9], "the"])), (2, " ".join([*words[:8], "the", "#", "$"])), (3, " ".join(words))]
    rules = (quality.Rule("n_words", least=10), quality.Rule("symbols_per_word", most=2 / 11), quality.Rule("stop_words_per_word", least=0.05))
    got = {r.doc_id: r.failed_rules for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()}
    assert got == {1: [], 2: [], 3: ["stop_words_per_word"]}
    assert math.isclose(2 / 11, 2 / 11)


def test_empty_table_and_plan(spark):
    df = quality.apply_rules(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == [] and {"kept", "base_failed", "failed_rules"} <= set(df.columns)
    plan = quality.apply_rules(spark.range(3).selectExpr("id AS doc_id", "'a b' AS text"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
