"""Expressions on text: line breaks, words, sentences, cleanup of markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the text model, and the sign that stands for markup taken out.
ANCHOR = "\u2387"
#: Patterns begin with the character that they look for, so that the search passes over all others at once.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
SENTENCE_BREAK = rf"\s(?<=[.!?]\s)\s*(?=[A-Z{ANCHOR}(])"
MATH = r"\$\$?[^$]*\$\$?"
ENVIRONMENTS = "equation|align|gather|eqnarray|multline|algorithm|algorithmic|figure|table|tabular|array"
HEADING = r"^\s*#{1,6}\s"
TOKEN = r"[\p{L}\p{N}]+(?:['\u2019]\p{L}+)*|[^\s\p{L}\p{N}]"

BLANKS = " \t\n\x0b\f\r"
MARKDOWN_STEPS = ((r"`[^`]*`", ANCHOR), (MATH, ANCHOR), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"))
TEX_STEPS = (
    (r"(?<!\\)%.*", ""),
    (MATH, ANCHOR),
    (r"\\(?:cite[pt]?|eqref|ref|autoref|label)\*?\{[^}]*\}", ANCHOR),
    (r"\\(?:begin|end)\{[^}]*\}", ""),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"),
    (r"\\[a-zA-Z]+\*?", ""),
)
#: Signs without one of which no step of a list changes a text.
MARKDOWN_SIGNS, SCORING_SIGNS = ("`", "$", "["), (ANCHOR, "`", "*", "~")
SCORING_STEPS = ((ANCHOR, ""), (r"\*\*", ""), ("`", ""), (r"(?<=\s)\*|\*(?=\s)", ""), ("~+", " "), (r"\s+", " "))


def replaced(text: Column, steps) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def unmarked(text: Column) -> Column:
    """``text`` without markdown; most lines have none of its signs and stay as they are."""
    return F.when(either(*[F.contains(text, F.lit(x)) for x in MARKDOWN_SIGNS]), replaced(text, MARKDOWN_STEPS)).otherwise(text)


def stripped(text: Column) -> Column:
    ends = either(*[f(text, F.lit(x)) for x in BLANKS for f in (F.startswith, F.endswith)])
    return F.when(ends, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)


def unevenly_spaced(text: Column) -> Column:
    """Whether a blank other than a single space is in it."""
    return either(*[F.contains(text, F.lit(x)) for x in ("  ", *BLANKS[1:])])


def spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(text: Column) -> Column:
    """Words between blanks; of an evenly spaced text they are one more than the spaces within."""
    even = F.when(text == "", 0).otherwise(spaces(text) + 1 - F.startswith(text, F.lit(" ")).cast("int") - F.endswith(text, F.lit(" ")).cast("int"))
    return F.when(unevenly_spaced(text), F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))).otherwise(even)


def sentence_array(text: Column, least: int = 3) -> Column:
    """Sentences of a paragraph with at least ``least`` words."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: word_count(s) >= least)


def cleaned_for_scoring(text: Column) -> Column:
    marked = either(unevenly_spaced(text), *[F.contains(text, F.lit(x)) for x in SCORING_SIGNS])
    return F.btrim(F.when(marked, replaced(text, SCORING_STEPS)).otherwise(text), F.lit(" ,;:"))


def is_prose(text: Column) -> Column:
    """Letters are at least half of the characters that aren't blank; an empty text is no prose."""
    other = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    visible = F.length(text) - F.when(unevenly_spaced(text), F.regexp_count(text, F.lit(r"\s"))).otherwise(spaces(text))
    return F.when(visible > 0, other * 2 <= visible).otherwise(False)


def tokens(text: Column) -> Column:
    """Lower-case words, and each other visible character, in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(r"^[\p{L}\p{N}]")


def greedy_groups(sizes: Column, least: int, tail: int) -> Column:
    """For each of an array of sizes the number of its group: groups are filled in order until they hold
    ``least``; a rest of less than ``tail`` joins the group before, where there is one."""
    start = F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("held"))
    # running (group, held) after each element, by one pass that keeps the last state and the groups so far
    state = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["s"]["held"] + x
        full = held >= least
        return F.struct(
            F.struct((acc["s"]["g"] + full.cast("int")).alias("g"), F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held")).alias("s"),
            F.concat(acc["out"], F.array(acc["s"]["g"])).alias("out"),
        )

    def finish(acc: Column) -> Column:
        short = (acc["s"]["held"] > 0) & (acc["s"]["held"] < tail) & (acc["s"]["g"] > 0)
        return F.when(short, F.transform(acc["out"], lambda g: F.least(g, acc["s"]["g"] - 1))).otherwise(acc["out"])

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), state, step, finish)
