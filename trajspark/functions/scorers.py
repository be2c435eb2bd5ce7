"""Answer scorers as column expressions: each maps response and ground-truth columns to a score column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lambdas import bind

# fixed values: letters of choices and the share thresholds of relative accuracy
LETTERS = "ABCDEF"
THETAS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


def flag(c: Column) -> Column:
    """1.0 or 0.0; null counts as false."""
    return F.when(c, 1.0).otherwise(0.0)


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def answer_tag(text: Column) -> Column:
    """What the first answer tag holds, trimmed; null without one."""
    pattern = r"(?s)<answer>\s*(.*?)\s*</answer>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def answer_or_text(text: Column) -> Column:
    return F.coalesce(answer_tag(text), F.trim(text))


def letter(text: Column) -> Column:
    """A single letter A to E inside the tag, else the first that stands alone."""
    inside = F.upper(answer_tag(text))
    return F.coalesce(F.when(inside.rlike(r"^[A-E]$"), inside), nonempty(F.regexp_extract(text, r"\b([A-E])\b", 1)))


def score_mcq_text(pred: Column, gt: Column, options: Column) -> Column:
    """Equal without case, or the truth inside the prediction, or a letter whose option is the truth."""
    p, g = F.lower(F.trim(pred)), F.lower(F.trim(gt))
    at = F.ascii(F.upper(F.trim(pred))) - 64
    chosen = F.when(F.upper(F.trim(pred)).rlike(f"^[{LETTERS[0]}-{LETTERS[-1]}]$"), F.get(options, at - 1))
    return flag((p == g) | p.contains(g) | F.coalesce(F.lower(F.trim(chosen)) == g, F.lit(False)))


def score_choices(pred: Column, gt: Column) -> Column:
    """Comma-separated sets of the same length with every answer in the truth."""
    parts = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    return flag((F.size(parts(pred)) == F.size(parts(gt))) & (F.size(F.array_except(parts(pred), parts(gt))) == 0))


def gsm8k_strict(text: Column) -> Column:
    """The number after ####, without commas and dollars; null without one."""
    return nonempty(F.regexp_replace(F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1), r"[,$]", ""))


def gsm8k_flexible(text: Column) -> Column:
    """The last number that is neither empty nor a full stop; the first if all are."""
    found = F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.get(good, F.size(good) - 1), F.get(found, F.lit(0)))


def score_gsm8k(text: Column, gt: Column, right: float = 1.0, form: float = 0.0) -> Column:
    a = gsm8k_strict(text)
    return F.when(a.isNull(), 0.0).when(a == gt, right).otherwise(form)


def parse_number(text: Column) -> Column:
    """First number in the text as a double, else null."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def score_mra(pred: Column, gt: Column) -> Column:
    """Share of thresholds t whose allowance 1 - t is above the relative error; exact for a truth of 0."""
    err = F.abs(pred - gt) / F.abs(gt)
    hits = [F.when(err < round(1 - t, 2), 1).otherwise(0) for t in THETAS]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.when(pred.isNull() | gt.isNull(), 0.0).when(gt == 0, flag(pred == 0)).otherwise(total / float(len(THETAS)))


def score_rule(pred: Column, gt: Column, numeric: Column) -> Column:
    """Equal text, else by number (relative accuracy of at least one half) or by first letter."""
    by_number = flag(score_mra(parse_number(pred), parse_number(gt)) >= 0.5)
    by_letter = flag(F.upper(F.substring(F.trim(pred), 1, 1)) == F.upper(F.substring(F.trim(gt), 1, 1)))
    return F.when(F.trim(pred) == F.trim(gt), 1.0).when(numeric, by_number).otherwise(by_letter)


def split_list(text: Column) -> Column:
    """The parts of text between commas outside of brackets. The fold goes over the pieces between commas, not over characters."""
    count = lambda t, kinds: F.length(t) - F.length(F.translate(t, kinds, ""))
    begin = F.struct(F.lit(0).alias("deep"), F.array().cast("array<string>").alias("parts"))

    def add(acc, piece):
        n = F.size(acc["parts"])
        longer = F.concat(F.slice(acc["parts"], 1, n - 1), F.array(F.concat(F.element_at(acc["parts"], -1), F.lit(","), piece)))
        parts = F.when(acc["deep"] > 0, longer).otherwise(F.array_append(acc["parts"], piece))
        return F.struct((acc["deep"] + count(piece, "([{") - count(piece, ")]}")).alias("deep"), parts.alias("parts"))

    many = F.transform(F.aggregate(F.split(text, ","), begin, add)["parts"], lambda p: F.trim(p))
    return F.when(~F.contains(text, F.lit(",")), F.array(F.trim(text))).otherwise(many)


def matrix_as_list(text: Column) -> Column:
    r"""\begin{pmatrix} a & b \\ c & d \end{pmatrix} (also bmatrix, matrix, array) as [[a,b],[c,d]]; other text as it is."""
    kind = r"(?:[pbvB]?matrix|array)"
    rows = F.regexp_extract(text, r"(?s)^\s*\\begin\{" + kind + r"\}(?:\{[lcr|]*\})?(.*?)(?:\\\\)?\s*\\end\{" + kind + r"\}\s*$", 1)
    inside = F.array_join(F.transform(F.split(rows, r"\\\\"), lambda r: F.concat(F.lit("["), F.replace(r, F.lit("&"), F.lit(",")), F.lit("]"))), ",")
    return F.when(rows != "", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(text)


#: A character that stands in no text which casts to a double. The cast of other texts raises and catches an exception a row.
NOT_IN_NUMBERS = r"[^\x00-\x20+\-.0-9a-fA-FinptxyINPTXY]"


def as_number(text: Column) -> Column:
    """The whole text as a double, else null."""
    return bind(F.trim(text), lambda t: F.when(~t.rlike(NOT_IN_NUMBERS), t.try_cast("double")))


def near_number(pred: Column, gt: Column, rel: float = 1e-4) -> Column:
    """pred is a number near gt, its hundredth or its hundredfold."""

    def near(n: Column) -> Column:
        p, g = n["p"], n["g"]
        hit = F.exists(F.array(g / 100, g, g * 100), lambda x: F.abs(p - x) <= rel * F.greatest(F.abs(p), F.abs(x)))
        return F.when(p.isNotNull() & g.isNotNull(), hit).otherwise(False)

    return bind(F.struct(as_number(pred).alias("p"), as_number(gt).alias("g")), near)


def _close(pred: Column, gt: Column, rel: float, deep: int) -> Column:
    """Each side is cut once a level: written out, every use of a part would cut the text again."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    scalar = lambda x, y: (bare(x) == bare(y)) | near_number(x, y, rel)
    if deep == 0:
        return scalar(pred, gt)
    ends = lambda c: F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    inner = lambda c: F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    cut = lambda c: bind(F.trim(c), lambda t: F.struct(t.alias("text"), ends(t).alias("ends"), split_list(t).alias("parts")))
    bracketed = lambda c: c["ends"].isin("()", "[]", "(]", "[)", "{}") & (F.size(c["parts"]) == 1)

    def sides(p: Column, g: Column) -> Column:
        both, neither = bracketed(p) & bracketed(g) & (p["ends"] == g["ends"]), ~bracketed(p) & ~bracketed(g)
        return F.struct(both.alias("both"), neither.alias("neither"), *[F.when(both, split_list(inner(c["text"]))).otherwise(c["parts"]).alias(n) for c, n in ((p, "a"), (g, "b"))])

    def listed(s: Column) -> Column:
        # one pair of brackets, or lists of two and more
        fits = (s["both"] | (s["neither"] & (F.size(s["a"]) > 1))) & (F.size(s["a"]) == F.size(s["b"]))
        return fits & F.forall(F.zip_with(s["a"], s["b"], lambda x, y: _close(x, y, rel, deep - 1)), lambda ok: ok)

    lists = lambda x, y: bind(F.struct(cut(x).alias("p"), cut(y).alias("g")), lambda c: bind(sides(c["p"], c["g"]), listed))
    return bind(F.struct(pred.alias("x"), gt.alias("y")), lambda t: scalar(t["x"], t["y"]) | lists(t["x"], t["y"]))


def score_numeric_close(pred: Column, gt: Column, rel: float = 1e-4, deep: int = 2) -> Column:
    """Equal text but for spaces and case, or a number near the truth, its hundredth or its hundredfold, or lists (tuples,
    intervals with the same brackets, matrices, plain comma lists) of as many elements that are all close, `deep` levels down."""
    return flag(F.coalesce(_close(matrix_as_list(pred), matrix_as_list(gt), rel, deep), F.lit(False)))


def qa_normalize(text: Column) -> Column:
    """Underscores to spaces, lower case, punctuation to spaces, without articles, single spaces."""
    low = F.regexp_replace(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(a|an|the)\b", " "), r"\s+", " "))


def qa_f1(pred: Column, gt: Column) -> Column:
    """F1 over the normal forms' tokens, counted; yes, no and noanswer must be equal. True and False read yes and no."""
    norm = lambda c: qa_normalize(F.when(F.lower(c) == "true", "yes").when(F.lower(c) == "false", "no").otherwise(c))
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))

    def shared_f1(t: Column) -> Column:
        a, b = t["a"], t["b"]
        shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
        return bind(shared, lambda n: F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(a) + F.size(b))))

    def score(t: Column) -> Column:
        p, g = t["p"], t["g"]
        fixed = p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")
        return F.when(fixed & (p != g), 0.0).otherwise(bind(F.struct(words(p).alias("a"), words(g).alias("b")), shared_f1))

    # the normal forms and their words are made once: inside of the fold they would be made again for every word
    return bind(F.struct(norm(pred).alias("p"), norm(gt).alias("g")), score)


def score_exact(text: Column, gt: Column) -> Column:
    """Equal without case and punctuation, of what follows the last </think>."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s]", "")
    return flag(norm(F.element_at(F.split(text, "</think>"), -1)) == norm(gt))


def last_line_answer(text: Column) -> Column:
    """What follows the last "Answer:" in the final 300 characters, else [INVALID]."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit("[INVALID]"))


# fixed values: replacements and removals of the final-answer normal form, in their order
FINAL_REPLACED = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
FINAL_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def final_answer_normalize(text: Column) -> Column:
    r"""Normal form of a final answer: what follows the last =, without units and spaces; only the inside of $...$, \text,
    \textbf, \overline and \boxed; \frac and \sqrt of single characters in braces; whole numbers without commas."""
    s = F.element_at(F.split(text, "="), -1)
    for old, new in FINAL_REPLACED + [(gone, "") for gone in FINAL_REMOVED]:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r".*?\$(.*?)\$.*", r"\$$1\$")
    for macro in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, rf"\\{macro}\{{(.*?)\}}", "$1")
    s = F.regexp_replace(s, r"\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(s, r"frac([^{])(.)", "frac{$1}{$2}")
    s = F.regexp_replace(s, r"sqrt([^{])", "sqrt{$1}")
    s = F.replace(s, F.lit("$"), F.lit(""))
    plain = F.replace(s, F.lit(","), F.lit(""))
    return F.regexp_replace(F.when(plain.rlike(r"^[0-9]+\z"), plain).otherwise(s), r"^\s+|\s+$", "")


def score_minerva(text: Column, gt: Column) -> Column:
    return F.when(final_answer_normalize(last_line_answer(text)) == final_answer_normalize(gt), 1.0).otherwise(-1.0)


def last_boxed(text: Column) -> Column:
    r"""Contents of the last balanced \boxed{...}, by a fold over the characters after it; null without one."""
    start = F.length(text) - F.instr(F.reverse(text), "{dexob\\") - 5
    tail = F.substr(text, start + 7)
    state = F.aggregate(
        F.split(tail, ""),
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
        lambda a, ch: F.struct(
            F.when(a["depth"] == 0, 0).when(ch == "{", a["depth"] + 1).when(ch == "}", a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            F.when(a["depth"] == 0, a["n"]).when((a["depth"] == 1) & (ch == "}"), a["n"]).otherwise(a["n"] + 1).alias("n"),
        ),
    )
    return F.when(text.contains("\\boxed{") & (state["depth"] == 0), F.substr(tail, F.lit(1), state["n"]))


def math_normalize(text: Column) -> Column:
    """Normal form of a LaTeX answer: an ordered chain of replacements."""
    s = F.trim(text)
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0.")):  # fixed values
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"\\text\{ .*$", "")
    s = F.regexp_replace(s, r"^\.", "0.")
    s = F.regexp_replace(s, r"^[^=]{1,2}=([^=]*)$", "$1")
    s = F.regexp_replace(s, r"sqrt([^{])", "sqrt{$1}")
    s = F.replace(s, F.lit(" "), F.lit(""))
    s = F.regexp_replace(s, r"frac([0-9a-z])([0-9a-z])", "frac{$1}{$2}")
    s = F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s)
    return F.regexp_replace(s, r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{$1}{$2}")


def score_math(text: Column, gt: Column) -> Column:
    return flag(math_normalize(last_boxed(text)) == math_normalize(gt))


def score_strict_box(text: Column, gt: Column) -> Column:
    return F.when(last_boxed(F.right(text, F.lit(100))) == gt, 1.0).otherwise(-1.0)


def judge_rules(pred: Column, answer: Column) -> Column:
    """1 or 0 by rule, null where a judge must decide: one character must be the key, two with a full stop must hold it, or
    the answer stands inside."""
    p, key = F.coalesce(last_boxed(pred), pred), F.substring(answer, 1, 1)
    return F.when(F.length(p) == 1, (p == key).cast("int")).when((F.length(p) == 2) & p.contains("."), p.contains(key).cast("int")).when(p.contains(answer), 1)


def judge_parse(reply: Column) -> Column:
    """1 or 0 of a stored judge reply, null if it says neither."""
    found = F.regexp_extract(reply, r"(?i)judge?ment\s*:?\s*([01])", 1)
    return F.coalesce(nonempty(found), F.when(F.trim(reply).isin("0", "1"), F.trim(reply))).cast("int")


# fixed values: phrases that lead to an answer, the later ones weaker; words and factors of quantities
CUES = ["is the correct answer", "the correct answer is", "the answer is", "answer:"]
SCALES = [("billion", "*10^9"), ("million", "*10^6"), ("thousand", "*10^3")]
UNIT_WORDS = "degrees?|centimeters?|meters?|miles?|seconds?|minutes?|hours?|days?|feet|foot|inch(?:es)?|yards?|cm|mm|km"


def answer_cue_match(text: Column) -> Column:
    """What follows the last answer cue, if it holds a digit: the first cue in order that gives one wins; else null."""
    found = [F.regexp_extract(text, rf"(?is)^.*{cue}\s*:?\s*(.*)$", 1) for cue in CUES]
    return F.coalesce(*[F.when(f.rlike("[0-9]"), F.trim(F.regexp_replace(f, r"\.$", ""))) for f in found])


def expr_normalize(text: Column) -> Column:
    """Plain expression: no thousands commas, scale words as powers, mixed numbers as sums, no unit words, lower case."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    for word, power in SCALES:
        s = F.regexp_replace(s, rf"\s*\b{word}\b", power)
    s = F.regexp_replace(s, rf"\b(?:{UNIT_WORDS})\b(?:\^[0-9]+)?", "")
    s = F.regexp_replace(s, r"^([0-9]+)\s+([0-9]+)/([0-9]+)$", "$1+$2/$3")
    return F.regexp_replace(s, r"\s+", "")
