"""Column functions over text: terms, query formatting, truncation, flattening, rendering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
#: Words that open a question, matched as prefixes.
QUESTION_WORDS = ["what", "when", "why", "who", "how", "where", "whose", "which", "is", "are", "were", "was", "do", "does", "did", "can"]
#: The short stop list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "then here there when where why how other some such nor not only own same now"
).split()
#: The longer stop list.
MORE_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def stop_words(size: str = "short", path: str | None = None) -> list[str]:
    """A stop list by size: short, longer, or long, which is read from a file of words by white space (one that big is a
    parameter here)."""
    if size == "long":
        if path is None:
            raise ValueError("the long stop list is read from a file: give its path")
        with open(path, encoding="utf-8") as f:
            return list(dict.fromkeys(f.read().split()))
    return {"short": STOP_WORDS, "longer": MORE_STOP_WORDS}[size]


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def known_words(words: DataFrame, column: str, vocabulary: DataFrame, word: str, lemma=F.lower) -> DataFrame:
    """Rows of words whose lemma (lemma: a column function, such as a dictionary's; lower case by default) is a word of the
    vocabulary, which may be of any size."""
    v = vocabulary.select(F.lower(word).alias("_known")).distinct()
    return words.join(v, lemma(F.col(column)) == F.col("_known"), "left_semi")


def first_terms(words: Column, n: int) -> Column:
    return F.slice(words, 1, n)


def last_terms(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)


def is_question(text: Column) -> Column:
    """Starts with a question word, as a prefix."""
    return F.lower(text).rlike(f"^(?:{'|'.join(QUESTION_WORDS)})")


def as_sentence(text: Column) -> Column:
    """Without ?, \\ and ", first character upper-cased, ended by ? for questions and . otherwise."""
    plain = F.translate(text, '?\\"', "")
    return F.concat(F.upper(F.substring(plain, 1, 1)), plain.substr(F.lit(2), F.length(plain)), F.when(is_question(text), "?").otherwise("."))


def truncate_words(text: Column, n: int = 300) -> Column:
    """The first n words by white space, joined by one space."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def passage_text(title: Column, body: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit(" Content: "), F.coalesce(body, F.lit(""))), r"\s+", " "))


def shorter_than(text: Column, n: int) -> Column:
    return F.size(F.split(text, " ")) < n


def copies_for_weight(w: float) -> int:
    """How often a query is repeated to carry weight w against one copy of its expansion; w = 1 has no answer."""
    if not 0 <= w < 1:
        raise ValueError("the weight must be in [0, 1)")
    return math.floor(1 / (1 - w)) - 1


def flatten_context(words: Column, context: Column, most: int, each: int) -> Column:
    """A query's words and then those of earlier texts, newest first, each cut to `each`, until the total would pass
    `most`; the part that would pass it is cut, its last word kept. context: array of word arrays, oldest first."""

    def add(acc: Column, part: Column) -> Column:
        part = F.slice(part, 1, each)
        room = F.lit(most) - F.size(acc["w"])
        cut = F.when(room > 0, F.concat(F.slice(part, F.lit(1), F.greatest(room - 1, F.lit(0))), F.slice(part, F.size(part), 1))).otherwise(F.array().cast("array<string>"))
        fits = F.size(part) <= room
        return F.when(acc["full"] | (F.size(part) == 0), acc).otherwise(F.struct(F.concat(acc["w"], F.when(fits, part).otherwise(cut)).alias("w"), (~fits).alias("full")))

    start = F.struct(F.slice(words, 1, min(each, most)).alias("w"), F.lit(False).alias("full"))
    return F.aggregate(F.reverse(context), start, add, lambda acc: acc["w"])


def pad(ids: Column, length: int, filler: int = 0) -> tuple[Column, Column]:
    """ids cut or padded to length, and the mask of what is real."""
    kept = F.slice(ids, 1, length)
    rest = F.lit(length) - F.size(kept)
    return F.concat(kept, F.array_repeat(F.lit(filler), rest)), F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), rest))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def latex_row(values: list[Column]) -> Column:
    """Values times 100 with one decimal, missing ones 0, joined as table cells. Halves round away from zero."""
    return F.array_join(F.array(*(F.format_string("%.1f", F.coalesce(v, F.lit(0.0)) * 100) for v in values)), " & ")


def run_name(retrieval: str, rerank: str, generation: str, model: str, reranker: str, top_k: int, group: str = "", feedback: bool = False, window: tuple = ()) -> str:
    """The bracketed name of a configuration's run."""
    tail = "_".join([reranker, *map(str, window)])
    return f"S1[{retrieval}{'_' + group if group else ''}]-S2[{rerank}]-g[{generation}]-[{model}{'_rm3' if feedback else ''}]-[{tail}]-[s2_top{top_k}]"


def run_name_parts(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"\[([^\]]+)\]"), F.lit(1))
