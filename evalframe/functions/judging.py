"""What a judge is asked and what it answers: prompts, scores, pairs of scores, JSON blocks, and rules that settle a row without it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions import text as T

# Results must equal them.
IMAGE_MARK = "<image>"
CHOICE_HINT = " Select from the following choices."
LETTER_HINT = "\nAnswer with the option's letter from the given choices directly."
NUMBER = r"-?\d+(?:\.\d+)?"


def question_for_judge(prompt: Column, benchmark: Column, letter_benchmarks: Sequence[str]) -> Column:
    """The prompt without image marks; for the named benchmarks the hint on choices goes, with blanks at the end, and the one on letters follows."""
    plain = F.replace(prompt, F.lit(IMAGE_MARK), F.lit(""))
    asked = F.concat(F.regexp_replace(F.replace(plain, F.lit(CHOICE_HINT), F.lit("")), r"\s+$", ""), F.lit(LETTER_HINT))
    return F.when(benchmark.isin(*letter_benchmarks), asked).otherwise(plain)


def rule_source(kind: Column, gold: Column, response: Column, labels: Sequence[str] = ("equal", "first letter", "contained", "pending")) -> Column:
    """Which rule finds the response right, the first that does, or the last label if a judge must decide.

    The answer within the response equals the gold as a number or as text without case and outer blanks; for kinds `mcq` and `zoom` the
    letters of answer and gold agree; for kind `zoom`, where the gold has no letter, the answer contains it. A null
    gold or response is left to the judge.
    """
    answer = T.answer_span(response)
    told = T.strip(gold)
    same = (told != "") & (F.lower(answer) == F.lower(told)) | (T.number_of(answer) == T.number_of(told))
    letter = T.gold_letter(gold)
    agree = kind.isin("mcq", "zoom") & (letter != "") & (letter == T.first_letter(answer))
    held = (kind == "zoom") & (letter == "") & T.contains_normalised(answer, gold)
    return F.when(same, labels[0]).when(agree, labels[1]).when(held, labels[2]).otherwise(labels[3])


def binary_score(c: Column) -> Column:
    """1 if the reply has the digit 1 anywhere, else 0; null for a null reply."""
    return F.contains(c, F.lit("1")).cast("int")


def says_yes(c: Column) -> Column:
    """Whether the reply starts with yes."""
    return F.startswith(F.lower(T.strip(c)), F.lit("yes"))


def score_in(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """The reply's first number, within the range if one is given; without a number the least score, 0 without a range. A null reply has none."""
    first = T.nonempty(F.regexp_extract(c, NUMBER, 0)).cast("double")
    if low is None or high is None:
        return F.coalesce(first, F.lit(0.0))
    return F.greatest(F.lit(float(low)), F.least(F.coalesce(first, F.lit(float(low))), F.lit(float(high))))


def score_pair(c: Column) -> Column:
    """The first two numbers of the reply's first line, outer blanks apart, as an array; [-1, -1] if there are fewer."""
    line = F.split_part(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(1))
    found = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)).cast("array<double>")
    return F.when(F.size(found) >= 2, F.slice(found, 1, 2)).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def json_block(c: Column) -> Column:
    """What stands from the first { to the last }, as a variant; null if there is no such part or it isn't JSON."""
    return F.try_parse_json(T.nonempty(F.regexp_extract(c, r"(?s)\{.*\}", 0)))
