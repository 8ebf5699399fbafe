"""Parsers on single texts."""

import pytest
from pyspark.sql import functions as F

from evalframe.functions import text as T

def cases():
    X = F.col("x")
    return [
        (T.first_letter(X), {"The answer is (G)": "G", "x B. y": "B", "so Q": "Q", "none": "", "": ""}),
        (T.gold_letter(X), {"A, B or C": "", " (B) cat": "B", "C": "C", "D: dog": "D", "D:dog": "", "E- x": "E", "F]": "F"}),
        (T.letter_cascade(X), {"Answer: B": "A", "so answer: B": "B", "b": "B", "the answer is (c)": "C", "pick (D) now": "D", "zzz": None, "": None, "so c. ok": "C"}),
        (T.answer_span(X), {"x Answer: B": "Answer: B", "<answer> q </answer> z": "q", "<answer> q Answer: r": "Answer: r", " y ": "y"}),
        (T.contains_normalised(X, F.lit("")), {"a": False, "": False}),
        (T.contains_normalised(X, F.lit("Red  cat")), {"a red CAT!": True, "red": False}),
        (T.yes_no(X), {"y": "yes", "N.": "no", "Yes.": "yes", "x": "other", "well yes": "other", "": "other", "not": "no"}),
        (T.digits_for_words(X), {"Two": "2", "cat": "cat"}),
        (T.normal_answer(X), {"3.5": "3.5", "dont": "don't", "The two cats.": "2 cats", "a-b": "b", "x - y": "x y", "none": "0", "it's": "it 's"}),
        (T.anls(X, F.array(F.lit("a b c d"))), {"a  b c d": 1.0, "zzzz": 0.0}),
        (T.token_f1(X, F.lit("2")), {"two": 0.0, "2": 1.0, "the 2": 1.0, "": 0.0}),
        (T.token_f1(X, F.lit("")), {"": 1.0, "x": 0.0}),
        (T.last_boxed(X), {r"\boxed{\frac{1}{2}}": r"\frac{1}{2}", r"\boxed{1} \boxed{007}": "7", "Answer: 10\nb": "10\nb", "none": None}),
        (T.last_boxed(X), {r"\boxed{a{b{c{d{e{f{g}}}}}}}": "a{b{c{d{e{f{g}}}}}}", r"\boxed{1} then \boxed{a{b{c{d{e{f}}}}}} end}": "a{b{c{d{e{f}}}}}", r"\boxed{1} \boxed{2": None, r"\boxed{2 Answer: 03": "3", r"\boxed{}": "", r"so \boxed 042$ x": "42", r"\boxed}{}": None, r"\boxed x": "x", "\\boxed{é{\n}}": "é{\n}", "": None}),
        (T.choice_cascade(X, F.array(*map(F.lit, ("red", " Red cat ", "b.(c)", "red"))), r"\(([A-Z])\)"), {"so (B) or (C)": "B", "a red cat": "(D)", "Red cat, red": "(B)", "xb.(c)": "(C)", "bx(c)": "[invalid]", "is:\n  D": "(D)", "is: E": "[invalid]", "": "[invalid]"}),
        (T.choice_cascade(X, F.array(*map(F.lit, ("The red!", "(blue)"))), r"(x)|y(\d*)", groups=2, pick=-1, fold_case=True, drop_marks=True, drop=("the ", "The "), fallback="?"), {"x y7": "7", "y8 x": "x", "y": "?", "the RED or BLUE": "(B)", "re-d": "(A)", "none: A": "(A)", ": C": "?"}),
        (T.pair_outcome(X)["judgement"], {"[[A>B]] [[A>B]]": "Worse", "[[B>>A]]": "Better++", "[[A>>B]] no [[B>A]]": "Worse++", "A=B": "Tie", "": "Unclear", "[[<]] B>A": "Unclear", "[[A>B]] or B>A [[B>A]]": "Worse"}),
        (T.choice_cascade(X, F.array().cast("array<string>"), "z"), {": A": "[invalid]"}),
        (T.choice_cascade(X, F.array(F.lit(""), F.lit("ab")), r"(q)"), {"ab": "[invalid]", "q": "q", ": B": "(B)"}),
        (T.short_score(X, F.lit("-1,200.5"), F.lit(False)), {"about -1200.50": 1.0, "1200.5": 0.0, "": 0.0}),
        (T.short_score(X, F.lit("b"), F.lit(True)), {"(B) x": 1.0, "b": 1.0, "so B": 1.0, "C": 0.0, "no": 0.0}),
        (T.guarded_letter(X), {"Best answer: C": "C", "": "A", "(": "A", "c": "C", "one two three four five six seven eight nine ten eleven": "", "zz": ""}),
        (T.parsed_option(X, F.array(*map(F.lit, ("red", "blue", "green"))), "ABC", F.lit(1)), {"(A) or (B)": "B", "A and C here": "C", "B.": T, "it may be a blue one of those": "B"}),
        (T.four_numbers(X), {"[1, 2.5, -3, 4]": [1, 2.5, -3, 4], "(1,2), (3,4)": [1, 2, 3, 4], "no": [0, 0, 0, 0]}),
        (T.option_by_text(X, F.lit("Q? A. red\nB. blue\nC. red")), {"It is blue!": "B", "red": "C", "gr-een": "green"}),
        (T.response_variants(X), {"a\n*b*\nc": ["a\n*b*\nc", "*b*\nc", "a\n*b*", "*b*", "a\nb\nc", "b\nc", "a\nb", "b"]}),
        (T.file_task(X), {"samples_my_task_2024.jsonl": "my_task", "a_b": "", "abc": "ab"}),
        (T.file_time(X), {"samples_my_task_2024.jsonl": "2024", "abc": "abc"}),
        (T.safe_model_name(X), {"org/a/b:c": "a/b__c".replace("/", "__"), "m": "m"}),
        (T.detokenised(X), {"do n't ( a ) .": "don't (a).", '" q " , x': '"q", x'}),
        (T.kernel_size(T.smoothing_sigma(X.cast("int"), True)), {"100": 3, "2048": 7, "8192": 13, "100000": 13}),
    ]


def test_parsers(spark):
    wrong = []
    for at, (parser, wanted) in enumerate(cases()):
        rows = spark.createDataFrame([(k,) for k in [*wanted, None]], "x string").select("x", parser.alias("y")).collect()
        got = {r.x: r.y for r in rows if r.x is not None}
        for text, want in wanted.items():
            fine = got[text] in list("ABC") if want is T else got[text] == pytest.approx(want) if isinstance(want, float) else got[text] == want
            if not fine:
                wrong.append((at, text, got[text], want))
    assert not wrong


def test_letter_and_text(spark):
    rows = spark.createDataFrame([("**b**",), ("Answer: c) the cat",), ("the cat",), ("Answer: C",)], "x string")
    own = T.letter_and_text(F.col("x"))
    got = rows.select(own["letter"].alias("l"), own["text"].alias("t"), T.same_answer(F.col("x"), F.lit("C"), F.lit("The cat")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("B", "", 0), ("C", "the cat", 1), (None, "the cat", 1), ("C", "", 1)]
