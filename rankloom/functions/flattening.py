"""Variants of conversational query texts: how contexts are found, cut and labelled before text.flatten_context joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import flatten_context, pad


def split_context(text: Column, separator: str = " [SEP] ") -> Column:
    """Earlier texts, oldest first, of a text that joins them by a separator; a null or empty text has none."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.split(text, F.lit("\\Q" + separator + "\\E"))).otherwise(F.array().cast("array<string>"))


def alternating(context: Column, question: int, response: int) -> Column:
    """Word arrays of questions (even places) and responses (odd places), each cut to its own length."""
    return F.transform(context, lambda x, i: F.slice(x, F.lit(1), F.when(i % 2 == 1, response).otherwise(question)))


def turn_text(words: Column, context: Column, most: int, question: int, response: int) -> Column:
    """A question and the questions and responses before it, newest first, within `most` words."""
    return flatten_context(F.slice(words, 1, question), alternating(context, question, response), most, max(question, response))


def single_context(words: Column, context: Column, most: int, each: int) -> Column:
    """A query's words with one earlier text, cut like any other."""
    return flatten_context(words, F.array(context), most, each)


def with_positives(rows: DataFrame, positives: str) -> DataFrame:
    """The rows that have a relevant passage to learn from."""
    return rows.filter(F.size(F.coalesce(F.col(positives), F.array().cast(rows.schema[positives].dataType))) > 0)


def rewrite_and_answer(rewrite: Column, answer: Column) -> Column:
    return F.concat_ws(" ", rewrite, answer)


def first_field(rows: DataFrame, names: list[str]) -> Column:
    """The first of these columns that rows has and that isn't null; of an array its first element. It raises for a row
    with none, and at once if rows has none of the columns."""
    there = [n for n in names if n in rows.columns]
    if not there:
        raise ValueError(f"none of {names}")
    value = lambda n: F.get(F.col(n), F.lit(0)) if rows.schema[n].dataType.typeName() == "array" else F.col(n)
    found = F.coalesce(*map(value, there))
    return F.when(found.isNull(), F.raise_error(F.lit("a row has none of the fields"))).otherwise(found)


def text_or(text: Column, fallback: Column) -> Column:
    """The text, or the fallback where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def labelled(question: Column, context: Column) -> Column:
    """Question and context (texts, oldest first) as one text, each behind its label, newest context first."""
    return F.concat_ws(" ", F.lit("[Current question]:"), question, F.when(F.size(context) > 0, F.concat(F.lit("[Context]: "), F.array_join(F.reverse(context), " "))))


def fixed_length(ids: Column, length: int) -> Column:
    """struct(ids, mask) of one length."""
    kept, mask = pad(ids, length)
    return F.struct(kept.alias("ids"), mask.alias("mask"))


#: What a prompt asks for, by task.
TASKS = {
    "rewrite": "Rewrite the question so that it can be understood without the dialogue.",
    "answer": "Answer the question in the light of the dialogue.",
    "both": "Rewrite the question so that it can be understood without the dialogue, and answer it.",
}


def task_prompt(task: str, question: Column, context: Column) -> Column:
    """A prompt for one of TASKS."""
    return F.concat_ws("\n", F.lit(TASKS[task]), F.concat(F.lit("Dialogue: "), F.array_join(context, " ")), F.concat(F.lit("Question: "), question))
