"""Text functions as column expressions: tokens, answer normalization, EM, token F1, answer extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class of all Unicode white space (Java's \s has the ASCII part only).
WS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Fixed values of the evaluation protocol.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
ANSWER_PATTERNS = (
    rf"(?diu)(?:the answer is|final answer)[:{WS}]+(.+?)(?:\.|$)",
    rf"(?diu)(?:answer)[:{WS}]+(.+?)(?:\.|$)",
)
#: A run of the same characters, by their property: several times as fast to split at.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def words(c: Column | str) -> Column:
    """The runs between white space, as they are."""
    return F.array_remove(F.split(_col(c), _SPACES), "")


def tokenize(c: Column | str) -> Column:
    """Lower-cased words; punctuation stays attached."""
    return words(F.lower(_col(c)))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, articles out, then punctuation out, then single spaces: in this order."""
    text = F.regexp_replace(F.lower(_col(c)), ARTICLES, " ")
    return F.array_join(words(F.translate(text, PUNCTUATION, "")), " ")


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a lambda's variable, where an expression would be worked out again at each use."""
    return F.transform(F.array(value), body)[0]


def numbered(bag: Column) -> Column:
    """The words of a bag, each with the number of its copy, so that equal bags are equal sets."""
    return let(F.array_sort(bag), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(s, w)).cast("string"))))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two arrays of words: each word as often as in the side with fewer."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    """Harmonic mean of bag precision and recall; an empty gold is matched by an empty prediction only."""

    def score(p: Column, g: Column) -> Column:
        n, m = F.size(p), F.size(g)
        f1 = let(bag_overlap(p, g), lambda both: F.when(both == 0, 0.0).otherwise(2.0 * both / (n + m)))
        return F.when(m == 0, (n == 0).cast("double")).when(n == 0, 0.0).otherwise(f1)

    return let(words(normalize_answer(prediction)), lambda p: let(words(normalize_answer(gold)), lambda g: score(p, g)))


def extract_answer(c: Column | str) -> Column:
    """The text after an answer phrase up to a full stop or the end; else the last line with text; else empty."""
    text = _col(c)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    out = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    for pattern in reversed(ANSWER_PATTERNS):
        out = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(out)
    return out


def tsv_safe(c: Column | str) -> Column:
    return F.translate(_col(c), "\t\n", "  ")


def context_string(title: Column | str, text: Column | str, most: int = 1000) -> Column:
    """A search hit as the model reads it."""
    return F.concat(F.lit("["), _col(title), F.lit("] "), F.substring(_col(text), 1, most))
