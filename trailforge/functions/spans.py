"""Character spans of search decisions, half open, in code points, as array<struct<s,e>> expressions.

Spark has no function for match positions; they follow from the lengths of the
matches and of the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values of the transcript format.
QUERY_START, QUERY_END = "<search>", "</search>"
MARKERS = ("<search>", "<continue>", "<synthesize>")
THINK = r"(?s)(?<=<think>).*?(?=</think>)"
SENTENCE = r"[^.!?\n]+[.!?\n]?"
INTENTS = (
    r"[Ll]et me search\b",
    r"[Ll]et me look up\b",
    r"[Ll]et me find\b",
    r"[Ii] need to (?:search|find|look up)\b",
    r"[Ii] should (?:search|find|look up)\b",
    r"[Ii] (?:will|'ll) search\b",
    r"[Nn]ow (?:let me |I (?:need to |will |should ))?(?:search|find|look up)\b",
    r"[Ff]irst,? (?:let me |I (?:need to |will |should ))?(?:search|find|look up)\b",
    r"[Nn]ext,? (?:let me |I (?:need to |will |should ))?(?:search|find|look up)\b",
)
#: Phrases by which a thought passes from results to an answer.
SYNTHESES = (
    r"\b(?:[Bb]ased on|[Aa]ccording to|[Ff]rom) (?:the|these|those|all|my)(?: \w+)? (?:results?|passages?|evidence|findings|information)\b",
    r"\b[Tt]he (?:results?|passages?|evidence) (?:says?|shows?|suggests?|confirms?|indicates?)\b",
    r"\b[Ii] (?:now )?(?:have enough|can (?:now )?(?:answer|conclude|combine))\b",
    r"\b[Pp]utting (?:this|these|it all) together\b",
)

SPANS = "array<struct<s:int,e:int>>"


def literal(text: str) -> str:
    r"""A pattern for the text itself (Java's \Q..\E)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def match_spans(text: Column, pattern: str, base: Column | int = 0) -> Column:
    """Spans of all matches of a pattern, moved by base."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    base = F.lit(base) if isinstance(base, int) else base
    start = F.struct(base.cast("int").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["m"])
        return F.struct(e.cast("int").alias("at"), F.concat(acc["spans"], F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def uncovered(candidates: Column, spans: Column) -> Column:
    """The candidates that no span contains."""
    return F.filter(candidates, lambda c: ~F.exists(spans, lambda s: (s["s"] <= c["s"]) & (c["e"] <= s["e"])))


def query_spans(text: Column, start: str = QUERY_START, end: str = QUERY_END) -> Column:
    """Whole query blocks, tags included; an unclosed start reaches to the next end."""
    return match_spans(text, f"(?s){literal(start)}.*?{literal(end)}")


def decision_spans(text: Column | str, start: str = QUERY_START, end: str = QUERY_END, markers: tuple[str, ...] | list[str] | None = None, extended: bool = False, synthesis: bool = False) -> Column:
    """Search-decision spans in order of their starts: query blocks, markers outside them and, if
    extended, sentences of think blocks that say a search is meant, or with synthesis that results lead to an answer. Only containment drops a span,
    so extended spans may overlap others in part."""
    text = F.col(text) if isinstance(text, str) else text
    spans = query_spans(text, start, end)
    for marker in markers or MARKERS:
        found = match_spans(text, literal(marker))
        spans = let(spans, lambda s: F.concat(s, uncovered(found, s)))  # noqa: B023  used at once
    phrases = [*(INTENTS if extended else ()), *(SYNTHESES if synthesis else ())]
    if phrases:
        thoughts = match_spans(text, THINK)
        inside = F.flatten(F.transform(thoughts, lambda t: match_spans(F.substring(text, t["s"] + 1, t["e"] - t["s"]), SENTENCE, t["s"])))
        meant = F.filter(inside, lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]).rlike("|".join(phrases)))
        spans = let(spans, lambda s: F.concat(s, uncovered(meant, s)))
    ordered = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["e"].alias("e"))))
    return F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("search_decision").alias("label")))


def token_type(spans: Column, start: Column, end: Column) -> Column:
    """The label of the first span that contains a token wholly; else reasoning."""
    first = F.try_element_at(F.filter(spans, lambda s: (start >= s["s"]) & (end <= s["e"])), F.lit(1))
    return F.coalesce(first["label"], F.lit("reasoning"))


def char_share(spans: Column, text: Column) -> Column:
    """Share of a text's characters in the spans; null for an empty text."""
    total = F.aggregate(spans, F.lit(0), lambda n, s: n + (s["e"] - s["s"]))
    return F.when(F.length(text) > 0, total / F.length(text))
