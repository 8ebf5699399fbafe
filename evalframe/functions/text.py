"""Column expressions that clean responses, extract answers and compare them with references. All row-local, no Python UDFs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]

# Words, marks and patterns that results depend on.
ARTICLES = ("a", "an", "the")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
INVALID = "[invalid]"
ANSWER_PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
ANSWER_LEADS = (
    "The best answer is", "The correct answer is", "The answer is", "The answer", "The best option is", "The correct option is", "Best answer:", "Best option:",
)
LETTER_PATTERNS = (
    r"^([A-D])\s*[.)\]]*", r"(?:THE\s+)?(?:ANSWER|CHOICE|OPTION)(?:\s+IS)?[\s:]+([A-D])", r"\(([A-D])\)", r"([A-D])\s*(?:\.|\)|\])", r"(?:^|\s)([A-D])(?:\s|$)",
)
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't",
    "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't",
    "shed've": "she'd've", "she'dve": "she'd've", "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll",
    "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's",
    "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas",
    "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd",
    "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're",
    "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all",
    "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
NUMBER = r"(-?\d+(?:\.\d+)?)"
VERDICTS = (
    ("A>B", -1, "model_a", "Worse"), ("A>>B", -2, "model_a", "Worse++"), ("A=B", 0, "tie", "Tie"), ("B>A", 1, "model_b", "Better"), ("B>>A", 2, "model_b", "Better++"),
)
REFUSALS, REFUSALS_IN_ANY_CASE = ("I can't", "I cannot", "无法", "抱歉"), ("sorry",)


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def drop_leading_blank(c: Column) -> Column:
    """One leading blank only."""
    return F.regexp_replace(c, "^ ", "")


def regex_pick(c: Column, pattern: str, group: int = 1, pick: int = 0, fallback: str = INVALID) -> Column:
    """The pick-th match's group (negative: from the end), stripped; the fallback when there is none or it is empty."""
    found = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(pick + 1 if pick >= 0 else pick))
    return F.coalesce(nonempty(strip(found)), F.lit(fallback))


def pipeline(c: Column, steps: Sequence[ColumnFn]) -> Column:
    """Filters applied in order."""
    return reduce(lambda x, step: step(x), steps, c)


def mapped(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def first_letter(c: Column) -> Column:
    """A capital in brackets, else one before a stop, a bracket or white space, else any; empty when there is none."""
    return F.coalesce(*[nonempty(F.regexp_extract(c, p, 1)) for p in (r"\(([A-Z])\)", r"([A-Z])[.)\s]", r"([A-Z])")], F.lit(""))


def gold_letter(c: Column) -> Column:
    """A-F at the start, alone or before `.`, `)`, `]`, or before `:` or `-` with white space; empty when there is none."""
    return F.coalesce(F.regexp_extract(strip(c), r"^[ (\[]*([A-F])(?:$|[.)\]]|[:\-]\s+)", 1), F.lit(""))


def letter_cascade(c: Column) -> Column:
    """A-D by the first of LETTER_PATTERNS that the upper-cased text meets, else the only one it holds, else its first character;
    null when none applies."""
    folded = F.upper(strip(c))
    alone = F.regexp_extract_all(folded, F.lit("[A-D]"), F.lit(0))
    head = F.substring(folded, 1, 1)
    return F.coalesce(*[nonempty(F.regexp_extract(folded, p, 1)) for p in LETTER_PATTERNS], F.when(F.size(alone) == 1, F.get(alone, 0)), F.when(head.isin(*"ABCD"), head))


def answer_span(c: Column) -> Column:
    """Between the first answer tags if both are there, else from the first `Answer:` on, else all; trimmed."""
    opened, closed, marked = (F.locate(x, c) for x in ("<answer>", "</answer>", "Answer:"))
    inside = F.substring(c, opened + 8, F.greatest(closed - opened - 8, F.lit(0)))
    return strip(F.when((opened > 0) & (closed > 0), inside).when(marked > 0, F.substring(c, marked, F.length(c))).otherwise(c))


def contains_normalised(answer: Column, gold: Column) -> Column:
    """Whether the folded answer holds the folded gold; never for an empty gold."""
    norm = lambda x: F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")
    return (norm(gold) != "") & F.contains(norm(answer), norm(gold))


def yes_no(c: Column) -> Column:
    """yes, no or other: of a text of one letter y and n, else by the first four characters; full stops don't count."""
    folded = F.replace(F.lower(strip(c)), F.lit("."), F.lit(""))
    head = F.when(F.length(folded) == 1, F.replace(F.replace(folded, F.lit("y"), F.lit("yes")), F.lit("n"), F.lit("no"))).otherwise(F.substring(folded, 1, 4))
    return F.when(F.contains(head, F.lit("yes")), "yes").when(F.contains(head, F.lit("no")), "no").otherwise("other")


def numbers(c: Column) -> Column:
    """Numbers with thousands commas, then in scientific notation, then plain ones."""
    patterns = (r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])")
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])


def digits_for_words(c: Column) -> Column:
    """A number word as digits, any other text as it is."""
    return F.coalesce(mapped(F.lower(c), {w: str(i) for i, w in enumerate(NUMBER_WORDS)}), c)


def normal_answer(c: Column) -> Column:
    """The visual question answering normal form: lower case; `,` and `?` go and `'s` parts; a mark with a blank beside it goes
    and others part words; full stops before no digit go; number words become digits, articles go, contractions get
    their apostrophe."""
    text = F.replace(F.replace(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's"))
    text = strip(F.translate(strip(text), "\n\t", "  "))
    plain = text
    for mark in ANSWER_PUNCTUATION:
        beside = F.contains(text, F.lit(mark + " ")) | F.contains(text, F.lit(" " + mark))
        plain = F.replace(plain, F.lit(mark), F.when(beside, "").otherwise(" "))
    plain = F.regexp_replace(plain, r"\.(?!\d)", "")
    numbers_ = F.create_map(*[F.lit(x) for w, i in (("none", 0), *((w, i) for i, w in enumerate(NUMBER_WORDS))) for x in (w, str(i))])
    full = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    kept = F.filter(F.transform(words(F.lower(plain)), lambda x: F.coalesce(F.try_element_at(numbers_, x), x)), lambda x: ~x.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(full, x), x)), " ")


def soft_accuracy(answers: Column, response: Column) -> Column:
    """Mean over the answers, each left out in turn, of min(1, matches among the others / 3)."""
    n = F.size(answers)
    hits = F.size(F.filter(answers, lambda a: a == response))
    total = F.aggregate(answers, F.lit(0.0), lambda acc, a: acc + F.least(F.lit(1.0), (hits - F.when(a == response, 1).otherwise(0)) / 3.0))
    return F.when(n > 0, total / n)


def anls(response: Column, golds: Column, least: float = 0.5) -> Column:
    """1 - the least normalised edit distance; distances on folded texts, lengths of the raw ones; under `least` counts 0."""
    norm = lambda x: F.array_join(words(F.lower(strip(x))), " ")
    size = lambda x: F.length(F.upper(x))
    far = F.transform(golds, lambda g: F.levenshtein(norm(g), norm(response)) / F.greatest(size(g), size(response), F.lit(1)))
    score = 1 - F.array_min(far)
    return F.when(score < least, 0.0).otherwise(score)


def number_of(c: Column) -> Column:
    """A number, with `%` divided by 100."""
    return F.when(F.endswith(c, F.lit("%")), F.rtrim(c, F.lit("%")).try_cast("double") / 100).otherwise(c.try_cast("double"))


def relaxed_equal(response: Column, gold: Column, share: float = 0.05) -> Column:
    """Numbers within a share of the gold; a gold of 0 or no number falls to equality of the folded texts."""
    p, t = number_of(response), number_of(gold)
    same = F.lower(response) == F.lower(gold)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), F.abs(p - t) / F.abs(t) <= share).otherwise(same)


def mean_relative_accuracy(p: Column, t: Column) -> Column:
    """Share of the thresholds .50, .55 ... .95 that 1 - relative error reaches."""
    steps = F.array(*[F.lit(round(0.5 + 0.05 * i, 2)) for i in range(10)])
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.when(F.abs(p - t) / F.abs(t) <= F.round(1 - s, 2), 0.1).otherwise(0.0))


def numbered(tokens: Column) -> Column:
    """Tokens with their occurrence's number, so that repeats are elements of their own."""
    ordered = F.array_sort(tokens)
    return F.transform(ordered, lambda x, i: F.concat(x, F.lit("\n"), (i + 1 - F.array_position(ordered, x)).cast("string")))


def token_f1(response: Column, gold: Column) -> Column:
    """F1 over tokens counted with repeats, ASCII punctuation and articles removed; two empty sides agree."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), r"(?U)\b(a|an|the)\b", " ")
    p, g = (F.coalesce(words(plain(c)), F.array().cast("array<string>")) for c in (response, gold))
    same = F.size(F.array_intersect(numbered(p), numbered(g)))
    return F.when(F.size(p) + F.size(g) == 0, 1.0).otherwise(2.0 * same / F.greatest(F.size(p) + F.size(g), F.lit(1)))


def set_scores(p: Column, g: Column) -> Column:
    """Jaccard, precision and recall of two sets; an empty denominator counts 1."""
    both = F.size(F.array_intersect(p, g))
    share = lambda d: F.when(d == 0, 1.0).otherwise(both / d)
    return F.struct(share(F.size(F.array_union(p, g))).alias("jaccard"), share(F.size(F.array_distinct(p))).alias("precision"), share(F.size(F.array_distinct(g))).alias("recall"))


def pair_verdict(c: Column) -> Column:
    """The single verdict label in a judgement; several different ones, or none, are unclear."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\[([AB<>=]+)\]\]"), F.lit(1)))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise("unclear")


def pair_outcome(c: Column) -> Column:
    """A struct of score (-2 to 2, from the baseline A's side to B's), winner and judgement. The first of VERDICTS counts that the single
    verdict label holds, or that the whole text holds if it has no label or several; without one, or for null, the tie is
    `Unclear`."""
    label = pair_verdict(c)
    said = F.when(label == "unclear", c).otherwise(label)
    made = lambda score, winner, word: F.struct(F.lit(score).alias("score"), F.lit(winner).alias("winner"), F.lit(word).alias("judgement"))
    return F.coalesce(*[F.when(F.contains(said, F.lit(mark)), made(*rest)) for mark, *rest in VERDICTS], made(0, "tie", "Unclear"))


def balanced(c: Column) -> Column:
    """The text up to the closing brace that first brings the count of open braces to zero; null without one."""
    step = lambda acc, x: F.struct(
        (acc["i"] + 1).alias("i"),
        (acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"),
        F.coalesce(acc["end"], F.when((x == "}") & (acc["depth"] == 1), acc["i"] + 1)).alias("end"),
    )
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    return F.aggregate(F.split(c, ""), start, step, lambda acc: F.substr(c, F.lit(1), acc["end"]))


def last_boxed(c: Column) -> Column:
    """The last boxed answer, else what follows the last `Answer:`; null without either. Digits alone lose leading zeros.

    A box written with a blank runs to the next dollar sign; else the last box counts, its braces balanced however deep, and
    there is none if they don't balance.
    """
    blank, box = "\\boxed ", "\\boxed{"
    spaced = F.substring_index(F.substring_index(c, blank, -1), "$", 1)
    braced = balanced(F.concat(F.lit("\\boxed"), F.substring_index(c, "\\boxed", -1)))
    inner = F.when(F.startswith(braced, F.lit(box)), F.substr(braced, F.lit(len(box) + 1), F.length(braced) - len(box) - 1))
    boxed = F.when(F.contains(c, F.lit(blank)), spaced).when(F.contains(c, F.lit("\\boxed")), inner)
    after = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?is)Answer\s*:\s*(.*)"), F.lit(1)), F.lit(-1))
    found = F.coalesce(boxed, after)
    return F.when(F.rlike(found, F.lit("^[0-9]+$")), F.regexp_replace(found, "^0+(?=[0-9])", "")).otherwise(found)


def first_listed(c: Column, names: Sequence[str], default: str) -> Column:
    """The first listed name that the text contains, whatever its case."""
    return F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(n.lower())), n) for n in names], F.lit(default))


def add_suffix_once(c: Column, suffix: str) -> Column:
    return F.when(F.contains(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix)))


def option_prompt(question: Column, options: Column) -> Column:
    lines = F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def choice_by_content(response: Column, options: Column) -> Column:
    """Letter of the option whose text occurs earliest in the response."""
    at = F.transform(options, lambda o, i: F.struct(F.nullif(F.call_function("instr", response, o), F.lit(0)).alias("at"), F.char(i + 65).alias("letter")))
    return F.array_min(F.filter(at, lambda x: x["at"].isNotNull()))["letter"]


def choice_cascade(response: Column, choices: Column, pattern: str, groups: int = 1, pick: int = 0, fold_case: bool = False, drop_marks: bool = False, drop: Sequence[str] = (), fallback: str = INVALID) -> Column:
    """An answer to a row's own choices: match number `pick` (from 0; negative from the end) of `pattern`, its first group that isn't
    empty; else of any choice's text in the response, as `(A)` for the first choice and so on; else of `: A`, also as
    `(A)`; else `fallback`. A step whose match is missing or blank is passed over.

    At one place an earlier choice is tried first; of equal choices the last gives the letter. Before choices are looked for,
    `drop` patterns leave both sides, then case and punctuation if asked. A null response or no choice falls back likewise.
    """
    at = F.lit(pick + 1 if pick >= 0 else pick)
    taken = lambda where, what, group: F.try_element_at(F.regexp_extract_all(where, what, F.lit(group)), at)
    tried = F.coalesce(*[nonempty(taken(response, F.lit(pattern), g)) for g in (range(1, groups + 1) if groups else [0])])

    def plain(c: Column) -> Column:
        for p in drop:
            c = F.regexp_replace(c, p, "")
        c = F.lower(c) if fold_case else c
        return F.regexp_replace(c, r"\p{P}", "") if drop_marks else c

    texts = F.transform(choices, lambda x: plain(strip(x)))
    any_of = F.array_join(F.transform(texts, lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")), "|")
    said = nonempty(strip(taken(plain(response), any_of, 0)))
    named = F.filter(F.transform(texts, lambda x, i: F.struct(x.alias("x"), F.concat(F.lit("("), F.char(i + 65), F.lit(")")).alias("letter"))), lambda x: x["x"] == said)
    chosen = F.coalesce(F.try_element_at(named, F.lit(-1))["letter"], said)
    letters = F.array_join(F.transform(choices, lambda x, i: F.concat(F.lit("\\x{"), F.hex(i + 65), F.lit("}"))), "|")
    marked = nonempty(taken(response, F.concat(F.lit(r"(?U):\s*("), letters, F.lit(")")), 1))
    some = F.size(choices) > 0
    return F.coalesce(nonempty(strip(tried)), F.when(some, chosen), F.when(some, F.concat(F.lit("("), marked, F.lit(")"))), F.lit(fallback))


def short_score(response: Column, gold: Column, choice: Column) -> Column:
    """1 or 0 for a short answer. A `choice` row compares letters: A-D at the start (in either case) or standing alone. Others compare
    the first numbers, signs and decimals included and commas left out, or, if the gold has none, the folded texts."""
    r, g = strip(F.coalesce(response, F.lit(""))), strip(gold)
    letter = F.coalesce(nonempty(F.upper(F.regexp_extract(r, r"^[(\[]?([A-Da-d])[)\].:,]?(?:\s|$)", 1))), nonempty(F.regexp_extract(r, r"\b([A-D])\b", 1)))
    number = lambda c: nonempty(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+\.?\d*", 0))
    equal = F.when(number(g).isNotNull(), number(r).cast("double") == number(g).cast("double")).otherwise(F.rtrim(F.lower(r), F.lit(".")) == F.lower(g))
    return F.when(F.coalesce(F.when(choice, letter == F.upper(g)).otherwise(equal), F.lit(False)), 1.0).otherwise(0.0)


def guarded_letter(c: Column, letters: str = "ABCDE") -> Column:
    """The first of the letters, after ANSWER_LEADS are taken out. A text without any is empty if it has over ten words; a shorter one
    takes the first choice `(X)` that holds it."""
    text = strip(c)
    for lead in ANSWER_LEADS:
        text = F.replace(text, F.lit(lead), F.lit(""))
    found = nonempty(F.regexp_extract(text, f"[{letters}]", 0))
    held = F.coalesce(*[F.when(F.contains(F.lit(f"({x})".lower()), F.lower(text)), x) for x in letters], F.lit(""))
    return F.coalesce(found, F.when(F.size(words(text)) > 10, "").otherwise(held))


def last_at(c: Column, part: Column) -> Column:
    """Place of the last occurrence, from 1; 0 if there is none."""
    back = F.call_function("instr", F.reverse(c), F.reverse(part))
    return F.when(back > 0, F.length(c) - back - F.length(part) + 2).otherwise(0)


def seeded_number(c: Column, seed: int = 0) -> Column:
    """A non-negative integer drawn from a key and a seed alone."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long")


def parsed_option(c: Column, options: Column, letters: Sequence[str], key: Column, seed: int = 0) -> Column:
    """The option that a response names: letters in brackets, else followed by a blank, else by a stop, else, in texts of more than five
    words, option texts. Of several, the one that stands last, letters located between blanks unless bracketed. A response
    that names none gets a letter drawn from `key` and `seed`."""
    text = c
    for mark in ",.!?;:'":
        text = F.btrim(text, F.lit(mark))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    folded = F.lower(text)

    def last(part, spot, where=text):
        rows = [F.struct(last_at(where, spot(i, x)).alias("at"), F.lit(-i).alias("i"), F.lit(x).alias("x"), F.contains(where, part(i, x)).alias("met")) for i, x in enumerate(letters)]
        return F.array_max(F.filter(F.array(*rows), lambda s: s["met"]))["x"]

    blanks = lambda i, x: F.lit(f" {x} ")
    bracket = lambda i, x: F.lit(f"({x})")
    content = lambda i, x: F.lower(F.get(options, i))
    drawn = F.element_at(F.array(*map(F.lit, letters)), (seeded_number(key, seed) % len(letters) + 1).cast("int"))
    return F.coalesce(
        last(bracket, bracket), last(lambda i, x: F.lit(f"{x} "), blanks), last(lambda i, x: F.lit(f"{x}."), blanks),
        F.when(F.size(words(text)) > 5, last(content, content, folded)), drawn,
    )


def letter_and_text(c: Column) -> Column:
    """(letter, text) of `Answer: X) text`; a lone letter has no text, and a text without an answer mark no letter. Stars don't count."""
    text = strip(F.replace(c, F.lit("*"), F.lit("")))
    pattern = r"(?i)Answer:\s*([A-E])\)?\.?\s*(.*)"
    letter = F.when(F.rlike(text, F.lit("^[A-Ea-e]$")), F.upper(text)).otherwise(nonempty(F.upper(F.regexp_extract(text, pattern, 1))))
    rest = F.when(F.rlike(text, F.lit("^[A-Ea-e]$")), "").when(letter.isNotNull(), strip(F.regexp_extract(text, pattern, 2))).otherwise(text)
    return F.struct(letter.alias("letter"), rest.alias("text"))


def same_answer(response: Column, letter: Column, text: Column) -> Column:
    """1 if the letters agree, and the texts where both have one; without letters on both sides, if the texts agree; else 0."""
    own = letter_and_text(response)
    folded = F.lower(own["text"]) == F.lower(text)
    both = (letter == own["letter"]) & ((own["text"] == "") | (text == "") | folded)
    return F.when(F.coalesce(F.when(letter.isNotNull() & own["letter"].isNotNull(), both).otherwise(folded), F.lit(False)), 1).otherwise(0)


def four_numbers(c: Column) -> Column:
    """The first four numbers in square brackets, else in round ones, else in two round pairs; else zeros."""
    gap = r",\s*"
    four = gap.join([NUMBER] * 4)
    pair = r"\(\s*" + NUMBER + gap + NUMBER
    forms = (r"\[\s*" + four + r"\s*\]", r"\(\s*" + four + r"\s*\)", pair + r"\)" + gap + pair + r"\)")
    boxes = [F.when(F.rlike(c, F.lit(p)), F.array(*[F.regexp_extract(c, p, i).cast("double") for i in range(1, 5)])) for p in forms]
    return F.coalesce(*boxes, F.array(*[F.lit(0.0)] * 4))


def option_by_text(c: Column, question: Column) -> Column:
    """The letter (A, B, ... in order) of the question's option `X. text` that stands first in the response, punctuation left out; the
    cleaned response if it holds none."""
    cleaned = strip(F.regexp_replace(c, r"(?U)[^\w\s]", ""))
    options = F.transform(F.regexp_extract_all(question, F.lit(r"\b([A-Z])\.\s+([^\n]*)"), F.lit(2)), strip)
    spots = F.transform(options, lambda o, i: F.struct(F.call_function("instr", cleaned, o).alias("at"), i.alias("i"), o.alias("o")))
    first = F.array_min(F.filter(spots, lambda x: x["at"] > 0))["o"]
    # Of equal options the last one's letter holds.
    letter = F.char(F.array_max(F.filter(F.transform(options, lambda o, i: F.when(o == first, i)), lambda x: x.isNotNull())) + 65)
    return F.coalesce(letter, cleaned)


def response_variants(c: Column) -> Column:
    """A response whole, without its first line, its last one and both, each as it is and without stars."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    part = lambda at, k: strip(F.array_join(F.slice(lines, at, F.greatest(k, F.lit(0))), "\n"))
    forms = [c, part(2, n - 1), part(1, n - 1), part(2, n - 2)]
    return F.array(*forms, *[F.replace(x, F.lit("*"), F.lit("")) for x in forms])


def any_variant(c: Column, check: ColumnFn) -> Column:
    """Whether a variant that isn't blank passes."""
    return F.exists(response_variants(c), lambda x: (strip(x) != "") & check(x))


def file_task(name: Column) -> Column:
    """What stands between the first and the last underscore of a file name; without any, all but the last character."""
    inner = F.regexp_extract(name, r"(?s)^[^_]*_(.*)_[^_]*$", 1)
    return F.when(F.contains(name, F.lit("_")), inner).otherwise(F.substring(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(0))))


def file_time(name: Column) -> Column:
    """What follows the last underscore, without the ending."""
    return F.replace(F.regexp_extract(name, r"(?s)([^_]*)$", 1), F.lit(".jsonl"), F.lit(""))


def safe_model_name(name: Column, full_path: bool = False) -> Column:
    """A model's name, its last two parts unless the full path is asked for, with runs of characters that file names can't hold replaced."""
    short = name if full_path else F.array_join(F.reverse(F.slice(F.reverse(F.split(name, "/")), 1, 2)), "/")
    return F.regexp_replace(short, r'["<>:/|\\?*\[\]]+', "__")


def safe_task_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\W", "_")


def detokenised(c: Column) -> Column:
    """Blanks before n't, closing marks and around quotes taken out."""
    for old, new in ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, " (['.,])", "$1")


def smoothing_sigma(tokens: Column, wide: bool = False) -> Column:
    """Linear from 1 at 512 tokens to 2 at 2048; beyond, 2, or with `wide` by the grid's side up to 4."""
    near = F.least(F.greatest(1 + (tokens - 512) / 1536.0, F.lit(1.0)), F.lit(2.0))
    return F.when(tokens > 2048, F.least(2 * F.sqrt(tokens / 2048.0), F.lit(4.0))).otherwise(near) if wide else near


def kernel_size(sigma: Column) -> Column:
    """Three sigmas, rounded half to even, 3 at least, and odd."""
    k = F.greatest(F.lit(3), F.bround(3 * sigma).cast("int"))
    return k + F.when(k % 2 == 0, 1).otherwise(0)
