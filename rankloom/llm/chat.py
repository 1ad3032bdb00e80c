"""Chat formatting: records of many layouts become canonical turns by the fingerprint of their field paths, and turns become
marked text with a loss mask. DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Layout:
    """How the fields of a record give its turns. Either `turns` names a list whose entries have a role and a text field, with
    what roles are renamed to; or `fields` are (role, names of text fields, joined by an empty line), in order. Paths in
    `optional` may be missing: a text that isn't there is empty in a list, and no turn among fields."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    rename: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> tuple[set[str], set[str]]:
        """The field paths a record of this layout has in any case, and those it may have."""
        if self.turns:
            return {f"{self.turns}[]"}, {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        every = {p for _, names in self.fields for p in names}
        return every - set(self.optional), every & set(self.optional)


#: Where two layouts have the same paths (an empty list), the first is taken.
LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("sharegpt", turns="conversations", role="from", text="value", rename=(("human", "user"), ("gpt", "assistant"))),
    Layout("dialogue", turns="dialogue", role="speaker", text="utterance"),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("completion", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question", fields=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)

#: What marks a turn's start, the end of its role, and its end.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
LOSS = ("assistant",)


def print_of(paths) -> str:
    return hashlib.md5(" ".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """fingerprint -> layout, for every set of paths that a layout allows."""
    out: dict[str, str] = {}
    for layout in layouts:
        needed, more = layout.paths()
        for some in chain.from_iterable(combinations(sorted(more), n) for n in range(len(more) + 1)):
            out.setdefault(print_of(needed | set(some)), layout.name)
    return out


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add fingerprint, layout and turns (array of role, text) to records, whose column `record` is a JSON object.

    A record's fingerprint is the md5 of the sorted nested paths that it has among those of the layouts ([] after a list);
    other fields don't count, and neither do null ones. It selects the layout, whose mapping makes the turns. A record
    that is null, no object, or of no known paths has a null layout and null turns; it stays. Null roles and texts are
    empty; numbers and objects in a text's place are their JSON. Columns called fingerprint, layout or turns are
    replaced, and all others kept; no rows give no rows.
    """
    lists: dict[str, set[str]] = {}
    flat: set[str] = set()
    for x in layouts:
        if x.turns:
            lists.setdefault(x.turns, set()).update((x.role, x.text))
        else:
            flat |= {p for _, names in x.fields for p in names}
    schema = ", ".join([f"`{n}` array<struct<{', '.join(f'`{f}`: string' for f in sorted(fields))}>>" for n, fields in sorted(lists.items())] + [f"`{n}` string" for n in sorted(flat)])
    kept = [F.col(c) for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    rows = records.select(F.struct(*kept).alias("row"), F.from_json(F.col(record), schema, {"maxStringLen": "2147483647"}).alias("r"))
    there = {f"{n}[]": F.col("r")[n].isNotNull() for n in lists}
    within = lambda n, f: F.coalesce(F.exists(F.col("r")[n], lambda e: e[f].isNotNull()), F.lit(False))
    there |= {f"{n}[].{f}": within(n, f) for n, fields in lists.items() for f in fields}
    there |= {n: F.col("r")[n].isNotNull() for n in flat}
    found = F.array_compact(F.array(*(F.when(there[p], F.lit(p)) for p in sorted(there))))
    rows = rows.withColumn("fingerprint", F.md5(F.array_join(found, " ").cast("binary")))
    known = F.create_map(*(F.lit(x) for pair in fingerprints(layouts).items() for x in pair))
    rows = rows.withColumn("layout", F.try_element_at(known, F.col("fingerprint")))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, mapped(F.col("r"), x)).otherwise(turns)
    return rows.withColumn("turns", turns).select("row.*", "fingerprint", "layout", "turns")


def mapped(r: Column, layout: Layout) -> Column:
    """The turns of a record of that layout."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if layout.turns:

        def role(e: Column) -> Column:
            own = F.coalesce(e[layout.role], F.lit(""))
            for old, new in layout.rename:
                own = F.when(e[layout.role] == old, F.lit(new)).otherwise(own)
            return own

        return F.transform(r[layout.turns], lambda e: turn(role(e), F.coalesce(e[layout.text], F.lit(""))))
    out = []
    for role, names in layout.fields:
        text = F.concat_ws("\n\n", *(F.nullif(r[n], F.lit("")) for n in names))
        there = [r[n].isNotNull() for n in names]
        whole = turn(F.lit(role), text)
        out.append(F.when(there[0], whole) if set(names) <= set(layout.optional) else whole)
    return F.array_compact(F.array(*out))


def escaped(text: Column) -> Column:
    """text without any mark in it: a backslash is doubled, and a mark's first letter gets one behind it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (TURN, SAYS, END):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame, turns: str = "turns", loss: tuple[str, ...] = LOSS) -> DataFrame:
    """Add formatted and mask to records with canonical turns.

    formatted: `<turn>` role `<says>` text `</turn>` for each turn, roles and texts escaped, so that no mark occurs but the
    template's own. mask: for each turn how many code points are skipped, are under the loss, and are skipped after these;
    all of them add up to the text. The loss is on the texts of turns whose role is in `loss`, without marks. Null turns
    are like none: an empty text and mask. Columns called formatted or mask are replaced.
    """
    role, text = (lambda t: escaped(F.coalesce(t["role"], F.lit("")))), (lambda t: escaped(F.coalesce(t["text"], F.lit(""))))
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(TURN), role(t), F.lit(SAYS)).alias("head"), text(t).alias("body"), t["role"].isin(*loss).alias("loss")))
    rows = records.withColumn("_parts", F.coalesce(parts, F.array().cast("array<struct<head:string,body:string,loss:boolean>>")))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    under = lambda p: F.when(F.coalesce(p["loss"], F.lit(False)), F.length(p["body"])).otherwise(0)
    skip = lambda p: F.when(F.coalesce(p["loss"], F.lit(False)), F.length(p["head"])).otherwise(size(p))
    mask = F.transform("_parts", lambda p: F.struct(skip(p).alias("skip"), under(p).alias("keep"), (size(p) - skip(p) - under(p)).alias("rest")))
    whole = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return rows.withColumns({"formatted": whole, "mask": mask}).drop("_parts")


def read_back(rows: DataFrame) -> DataFrame:
    """Add turns (role, text) and loss_text to rows with formatted and mask: what a trainer sees, unescaped again. turns is
    replaced if it is there."""
    pieces = F.split(F.col("formatted"), f"(?<={END})")
    out = rows.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))  # nothing follows the last mark
    start = len(TURN) + 1

    def turn(p: Column) -> Column:
        at = F.instr(p, SAYS)
        body = F.substring(p, at + len(SAYS), F.length(p) - len(END) - at - len(SAYS) + 1)
        return F.struct(unescaped(F.substring(p, F.lit(start), at - start)).alias("role"), unescaped(body).alias("text"))

    under = F.zip_with("_pieces", "mask", lambda p, m: unescaped(F.substring(p, m["skip"] + 1, m["keep"])))
    return out.withColumns({"turns": F.transform("_pieces", turn), "loss_text": F.array_join(under, "")}).drop("_pieces")


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, turns of flat rows (conv_id, turn, role, text): by turn, null first, ties by role and text. A conversation is
    one row from here on, as a document is."""
    each = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = F.array_sort(F.collect_list(each))
    return rows.groupBy("conv_id").agg(F.transform(sorted_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def as_records(conversations: DataFrame) -> DataFrame:
    """conv_id, record: JSON objects of many layouts, as corpora from many places have. Questions with one answer (and a system
    text before it) are instructions or completions, conversations among user, assistant and system have one of three
    kinds of lists, and those with other roles are messages."""
    turns, kind = F.col("turns"), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    roles = F.transform(turns, lambda t: t["role"])
    pair = (roles == F.array(F.lit("user"), F.lit("assistant"))) | (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    layout = F.when(pair & (kind == 0), "instruction").when(pair & (kind == 1), "completion").when(plain & (kind == 2), "sharegpt").when(plain & (kind == 3), "dialogue").otherwise("messages")
    of = lambda role: F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["text"]
    spoken = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    flat = F.col("_layout").isin("instruction", "completion")
    entries = lambda role, text, name: F.transform(turns, lambda t: F.struct(name(t["role"]).alias(role), t["text"].alias(text)))
    same = lambda r: r
    fields = {
        "messages": F.when(F.col("_layout") == "messages", entries("role", "content", same)),
        "conversations": F.when(F.col("_layout") == "sharegpt", entries("from", "value", spoken)),
        "dialogue": F.when(F.col("_layout") == "dialogue", entries("speaker", "utterance", same)),
        "system": F.when(flat, of("system")),
        "instruction": F.when(F.col("_layout") == "instruction", of("user")),
        "output": F.when(F.col("_layout") == "instruction", of("assistant")),
        "prompt": F.when(F.col("_layout") == "completion", of("user")),
        "completion": F.when(F.col("_layout") == "completion", of("assistant")),
    }
    rows = conversations.withColumn("_layout", layout)
    return rows.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), *(v.alias(k) for k, v in fields.items()))).alias("record"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold marks, as records of five layouts, formatted, and read back from that.

    Null roles and texts are empty, a null turn is before all others, ties go by role and text, rows of a null conv_id are one
    conversation; other columns are ignored; an empty table leaves the added conversation. In a list of turns no
    text is lost, whatever its role; what is under the loss are the texts of `assistant` turns.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text")) for i, role in enumerate(("user", "assistant"))))
    rows = rows.unionByName(spark.range(1).select(F.explode(more).alias("x")).select("x.*"))
    out = read_back(formatted(canonical(as_records(gathered(rows)))).drop("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hexed(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), hexed(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>')) + 19 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
