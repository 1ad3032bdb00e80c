"""Prompts as string expressions, and parsers of model answers as column expressions; an answer that breaks its contract is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(lines: Column) -> Column:
    """1. first, 2. second, ... one a line."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def prompt(instruction: str, current: Column, context: Column | None = None, profile: Column | None = None, demos: str = "", tail: str = "") -> Column:
    """Instruction, demonstrations, profile lines, dialogue and the current turn, joined by blank lines; empty parts are left out."""
    parts = [F.lit(instruction or None), F.lit(demos or None)]
    if profile is not None:
        parts.append(F.when(F.size(profile) > 0, F.concat(F.lit("Profile:\n"), numbered(profile))))
    if context is not None:
        parts.append(F.when(F.size(context) > 0, F.concat(F.lit("Conversation:\n"), F.array_join(context, "\n"))))
    parts += [F.concat(F.lit("Current turn: "), current), F.lit(tail or None)]
    return F.concat_ws("\n\n", *parts)


def _after(lines: Column, label: str) -> Column:
    """The text after the first line that starts with label in one of its stylings."""
    style = rf"^(?:\*\*{label}\*\*:|\*\*{label}:\*\*|### {label}:|{label}:)\s*"
    return F.regexp_replace(F.element_at(F.filter(lines, lambda x: x.rlike(style)), 1), style, "")


def _line_of(lines: Column, label: str) -> Column:
    style = rf"^(?:\*\*{label}\*\*:|\*\*{label}:\*\*|### {label}:|{label}:)"
    return F.array_position(F.transform(lines, lambda x: x.rlike(style)), True)


def parse_judgement(answer: Column, reasons: bool = True) -> Column:
    """struct(reason, level, rewrite, response); everything after the response label is response. Null without a level,
    rewrite or response (or reason, where reasons are asked for)."""
    lines = F.split(F.trim(answer), "\n")
    at = _line_of(lines, "Response").cast("int")
    head = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))))
    tail = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
    reason, level, rewrite = (F.nullif(F.trim(_first(head, x)), F.lit("")) for x in ("Reason", "Level", "Rewrite"))
    response = F.concat_ws("\n", F.array_insert(tail, 1, _after(lines, "Response")))
    whole = F.struct(reason.alias("reason"), F.lower(F.substring(level, 1, 1)).alias("level"), rewrite.alias("rewrite"), response.alias("response"))
    ok = (at > 0) & level.isNotNull() & rewrite.isNotNull()
    return F.when(ok & reason.isNotNull() if reasons else ok, whole)


def _first(lines: Column, label: str) -> Column:
    found = F.filter(lines, lambda x: x.rlike(rf"^(?:\*\*{label}\*\*:|\*\*{label}:\*\*|### {label}:|{label}:)"))
    return F.when(F.size(found) > 0, _after(lines, label))


def parse_level(answer: Column, levels: str = "abcd") -> Column:
    """struct(level, reason); null without one of the levels."""
    lines = F.split(F.trim(answer), "\n")
    level = F.lower(F.substring(F.trim(_first(lines, "Level")), 1, 1))
    return F.when(level.rlike(f"^[{levels}]$"), F.struct(level.alias("level"), F.trim(_first(lines, "Reason")).alias("reason")))


def parse_rewrite_response(answer: Column, cot: str = "So the question should be rewritten as: ") -> Column:
    """struct(rewrite, response, cot): line 1 is `Rewrite: `, line 2 `Response: `, the rest belongs to the response."""
    lines = F.split(answer, "\n")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    ok = first.startswith("Rewrite: ") & second.startswith("Response: ")
    rewrite = F.substring(first, F.lit(10), F.length(first))
    parts = F.split(rewrite, cot, 2)
    response = F.concat_ws("\n", F.array_insert(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), 1, F.substring(second, F.lit(11), F.length(second))))
    return F.when(ok, F.struct(F.element_at(parts, -1).alias("rewrite"), response.alias("response"), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("cot")))


def parse_labelled(answer: Column, labels: tuple[str, ...] = ("Rewrite", "Response", "Reason")) -> Column:
    """One field a label; the last line with a label wins. Null if a label is missing."""
    lines = F.split(F.trim(answer), "\n")

    def last(label: str) -> Column:
        found = F.filter(lines, lambda x: x.startswith(f"{label}:"))
        return F.when(F.size(found) > 0, F.trim(F.regexp_replace(F.element_at(found, -1), f"^{label}:", "")))

    fields = [last(x) for x in labels]
    ok = F.lit(True)
    for f in fields:
        ok &= f.isNotNull()
    return F.when(ok, F.struct(*(f.alias(x.lower()) for f, x in zip(fields, labels))))


def parse_prefixed(answer: Column, prefix: str) -> Column:
    """What follows the prefix that must open the answer."""
    return F.when(answer.startswith(prefix), F.substring(answer, F.lit(len(prefix) + 1), F.length(answer)))


def parse_queries(answer: Column) -> Column:
    """One query a line; `1. `, `- ` and surrounding quotes go. An empty line makes the whole answer null."""
    lines = F.split(answer, "\n")
    clean = F.transform(lines, lambda x: F.when(F.substring(x, 2, 1) == ".", F.substring(x, F.lit(4), F.length(x))).when(x.startswith("- "), F.substring(x, F.lit(3), F.length(x))).when(x.startswith('"') & x.endswith('"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    return F.when(~F.exists(lines, lambda x: x == ""), clean)


def pad_queries(queries: Column, n: int, filler: str) -> Column:
    return F.slice(F.concat(queries, F.array_repeat(F.lit(filler), n)), 1, n)


def repair_permutation(answer: Column, n: Column) -> Column:
    """Places 1..n in the order an answer names them: numbers out of range and repeats go, missing ones follow in order."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    valid = F.filter(named, lambda x: x.isNotNull() & (x >= 1) & (x <= n))
    return F.array_union(F.array_distinct(valid), F.sequence(F.lit(1), n.cast("int")))


def parse_text(answer: Column) -> Column:
    """The whole answer without white space around it."""
    return F.trim(F.regexp_replace(answer, r"^\s+|\s+$", ""))


def parse_lines(answer: Column) -> Column:
    """The answer's lines, each without white space around it."""
    return F.transform(F.split(parse_text(answer), "\n"), parse_text)


def parse_expansion(answer: Column, cot: str | None = None) -> Column:
    """struct(rewrite, response, cot) of an answer whose last line must start with `Reason:`: line 1 after its first nine
    characters is the rewrite, the other lines after their first ten are the response. With cot, the rewrite follows
    that phrase, without which the answer is null, and what stands before it is cot."""
    lines = F.split(parse_text(answer), "\n")
    first = F.get(lines, F.lit(0))
    line = F.substring(first, F.lit(10), F.length(first))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    ok = F.element_at(lines, -1).startswith("Reason:")
    at = F.instr(line, cot) if cot else F.lit(0)
    rewrite = F.substring(line, at + len(cot), F.length(line)) if cot else line
    before = F.substring(line, F.lit(1), at - 1) if cot else F.lit(None).cast("string")
    return F.when(ok & (at > 0) if cot else ok, F.struct(rewrite.alias("rewrite"), F.substring(rest, F.lit(11), F.length(rest)).alias("response"), before.alias("cot")))


def expansion_terms(logits: Column, vocabulary: Column, n: int, indicator: str = ":") -> Column:
    """The n tokens with the highest logits at the position after the first whose best token is the indicator: an array of
    struct(token, logit), highest first, ties by token; null without such a position. logits: an array of one array of
    numbers a position; vocabulary: the tokens."""
    best = F.transform(logits, lambda row: F.trim(F.get(vocabulary, F.array_position(row, F.array_max(row)).cast("int") - 1)))
    row = F.get(logits, F.array_position(best, indicator).cast("int"))
    pairs = F.transform(row, lambda x, i: F.struct((-x).alias("s"), F.trim(F.get(vocabulary, i)).alias("token"), x.alias("logit")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.struct(x["token"].alias("token"), x["logit"].alias("logit")))
    return F.when(F.array_position(best, indicator) > 0, top)


def demonstrations(demos: list[dict], cot: str | None = None) -> str:
    """Worked examples as text: each demo's turns (question, manual_rewrite, response, and cot) one after the other. With cot
    the rewrite follows the turn's reasoning and that phrase."""
    shown = []
    for i, demo in enumerate(demos, 1):
        turns = []
        for t in demo["turns"]:
            rewrite = f"{t['cot']} {cot}{t['manual_rewrite']}" if cot else t["manual_rewrite"]
            turns.append(f"Question: {t['question']}\nRewrite: {rewrite}\nResponse: {t['response']}")
        shown.append(f"Example #{i}:\n" + "\n\n".join(turns))
    return "\n\n".join(shown)


def listwise_prompt(query: Column, passages: Column, words: int = 300) -> Column:
    """The dialogue of a listwise ranker, an array of struct(role, content): who it is, how many passages follow for which
    query, each passage (its first `words` words) with its number and a receipt, and the order to rank them by number."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    n = F.size(passages).cast("string")
    head = F.array(
        message("system", F.lit("You rank passages by how well they answer a query.")),
        message("user", F.concat(F.lit("There are "), n, F.lit(" passages, each with a number in []. Rank them for the query: "), query)),
        message("assistant", F.lit("Send the passages.")),
    )
    cut = lambda x: F.array_join(F.slice(F.split(parse_text(F.regexp_replace(F.replace(x, F.lit("Title: Content: "), F.lit("")), r"\s+", " ")), " "), 1, words), " ")
    each = F.flatten(F.transform(passages, lambda x, i: F.array(message("user", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), cut(x))), message("assistant", F.concat(F.lit("Passage ["), (i + 1).cast("string"), F.lit("] received."))))))
    tail = F.array(message("user", F.concat(F.lit("Query: "), query, F.lit(". Rank the "), n, F.lit(" passages, best first, as numbers: [2] > [1]. Give the ranking only."))))
    return F.concat(head, each, tail)


def completion_prompt(messages: Column) -> Column:
    """Messages as one text for a model that completes: those of system and user, and the start of the answer."""
    said = F.filter(messages, lambda m: m["role"].isin("system", "user"))
    return F.concat(F.array_join(F.transform(said, lambda m: F.concat(m["content"], F.lit("\n\n"))), ""), F.lit("The ranking, as numbers only:"))
