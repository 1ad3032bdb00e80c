"""Candidate search shared by the two substring operators.

A text is a row of units (words or bytes). Every window of `window` units has an anchor: the leftmost least hash among
the `part`-unit windows in it. Equal windows have equal anchors at equal places, so a window can repeat only if its
anchor does, and anchors are few: about two for every window - part + 1 units. Consecutive windows with one anchor make
a segment; every window lies in exactly one segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, split_join
from .rolling import BASES, BYTES, Prefix, Text, mix, sliding_argmin

ANCHORS = "doc_id long, th long, ah long, g1 long, g2 long, lo int, n int"


class Units:
    """The units of some texts as two streams of 64-bit values with prefix sums; first[i]:last[i] are text i's."""

    def __init__(self, texts: list[str | None], words: bool):
        self.text = Text(texts)
        if words:
            self.words = self.text.words()
            self.first, self.last = self.words.first, self.words.last
            values = [self.words.hashes(k) for k in (0, 1)]
        else:
            self.first, self.last = self.text.begin, self.text.end
            values = [BYTES[k][self.text.buf] for k in (0, 1)]
        self.prefixes = [Prefix(v, BASES[2 + k]) for k, v in enumerate(values)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [p.spans(start, end).view(np.int64) for p in self.prefixes]

    def anchors(self, part: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window by its start the place of its anchor, and a hash for every place."""
        h = self.prefixes[0].windows(part)
        return sliding_argmin(h, window - part + 1), mix(h ^ np.uint64(part)).view(np.int64)

    def segments(self, part: int, window: int):
        """text index, start and number of windows, anchor hash of every segment."""
        many = np.maximum(self.last - self.first - window + 1, 0)
        total = int(many.sum())
        if not total:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        off = np.cumsum(many) - many
        starts = np.repeat(self.first - off, many) + np.arange(total)
        at, h = self.anchors(part, window)
        at = at[starts]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(new, total))
        return np.searchsorted(off, new, side="right") - 1, starts[new], n, h[at[new]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text; (doc_id, th) tells rows apart unless they are equal, and then their results are too."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def anchors(base: DataFrame, words: bool, part: int, window: int) -> DataFrame:
    """The segments of every text in base: anchor hash, two hashes of the segment's content, place and windows."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                u = Units(batch.column(2).to_pylist(), words)
                which, start, n, ah = u.segments(part, window)
                g1, g2 = u.hashes(start, start + n + window - 1)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ah), pa.array(g1), pa.array(g2), pa.array((start - u.first[which]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "ah", "g1", "g2", "lo", "n"])

    return base.mapInArrow(work, ANCHORS)


def repeated(base: DataFrame, words: bool, part: int, window: int, scratch: Scratch) -> DataFrame:
    """The segments whose anchor is met more than once. The texts are hashed once: all segments are written, in narrow
    columns, and counted and looked up from there."""
    a = scratch.cut(anchors(base, words, part, window))
    more = a.groupBy("ah").agg(F.count("*").alias("_m")).filter("_m > 1").select("ah")
    out = scratch.cut(split_join(a, more, ["ah"]))
    scratch.drop(a)
    return out


def per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of each text's rows as one array; a text has no more rows than units."""
    return rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("_rows"))


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["th"].eqNullSafe(b["th"])


def at_texts(base: DataFrame, rows: DataFrame, how: str, *columns: str) -> DataFrame:
    """text and _rows of the texts that have rows (inner) or of all (left). The texts are dealt out by key in the same
    way each time, so that Spark uses one exchange for all uses in a plan."""
    found = per_text(rows, *columns)
    return base.join(found, same_text(base, found), how).select(base["doc_id"], base["th"], base["text"], found["_rows"])


def covered(length: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of `length` units lie in spans (start, units)."""
    mark = np.zeros(length + 1, np.int64)
    for s, n in spans:
        mark[s] += 1
        mark[min(s + n, length)] -= 1
    return np.cumsum(mark)[:length] > 0
