"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, split_join, table
from .repeats import Units, at_texts, covered, keyed, repeated


def levels(window: int, shortest: int) -> list[int]:
    """Lengths that double (rounded up) from about `shortest` to window."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def expanded(batch: pa.RecordBatch, words: bool = True):
    """The units of a batch of (doc_id, th, text, rows), its rows, the text of each row, and of every window that a row
    (lo, n) stands for the row and the place in it."""
    u = Units(batch.column(2).to_pylist(), words)
    rows = batch.column(3)
    which = np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy(zero_copy_only=False))
    own = rows.flatten()
    n = own.field("n").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - (np.cumsum(n) - n)[row]
    at = (u.first[which] + own.field("lo").to_numpy())[row] + step
    return u, own, which, row, step, at


def doubled(rows: DataFrame, part: int, window: int) -> DataFrame:
    """The windows that rows (of at_texts) stand for, by the least hash of the `part` words in each; those whose `part`
    words are met once are dropped."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                u, own, which, row, step, at = expanded(batch)
                place, h = u.anchors(part, window)
                a = place[at]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])) if len(a) else np.zeros(0, np.int64)
                r = row[new]
                take = pa.array(which[r])
                lo = own.field("lo").to_numpy()[r] + step[new]
                n = np.diff(np.append(new, len(a)))
                kept = [own.field(c).take(pa.array(r)) for c in ("g1", "g2", "off")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h[a[new]]), *kept, pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "ah", "g1", "g2", "off", "lo", "n"])

    out = rows.mapInArrow(work, "doc_id long, th long, ah long, g1 long, g2 long, off int, lo int, n int")
    more = out.groupBy("ah").agg(F.count("*").alias("_m")).filter("_m > 1").select("ah")
    return split_join(out, more, ["ah"])


def dedup(docs: DataFrame, window: int = 50, shortest: int = 13, with_text: bool = False) -> DataFrame:
    """Remove words covered by a window of `window` words that also starts in a document of smaller doc_id.

    Lengths double from about `shortest` to window (13, 25, 50). At each, the windows still in question are counted by
    what they hold of that length, one such stretch for each (its least hash, see repeats.py), and those whose stretch is
    met once are dropped; the others are extended to the next length, and at full length counted whole. The level ends
    early for stretches that have one content all around: its copies go by the least doc_id that holds it, and of
    every content one copy goes on. Every comparison is by 128-bit hashes.

    Gives doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words, if with_text) for every row. Null
    text is empty. A null doc_id is smaller than any other for nobody: its row is kept whole and removes nothing.
    Rows with one doc_id don't remove each other's words. Very long texts are read whole by one task. Other columns
    are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    lengths = levels(window, shortest)
    base = keyed(docs)
    s = repeated(base.filter("doc_id is not null"), True, lengths[0], window, scratch)
    contents = s.groupBy("ah", "g1", "g2").agg(F.min(F.struct("doc_id", "th", "lo", "n")).alias("r"))
    contents = scratch.cut(contents.select("ah", "g1", "g2", "r.*"))
    several = contents.groupBy("ah").agg(F.count("*").alias("_c")).filter("_c > 1").select("ah")
    alive = split_join(contents, several, ["ah"]).withColumn("off", F.col("lo"))
    # not cut from here on: within one plan the texts are exchanged once for all uses
    for part in lengths[1:-1]:
        alive = doubled(at_texts(base, alive, "inner", "lo", "n", "g1", "g2", "off"), part, window)

    def extend(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                u, own, which, row, step, at = expanded(batch)
                w1, w2 = u.hashes(at, at + window)
                lo, off, g1, g2 = (own.field(c).to_numpy() for c in ("lo", "off", "g1", "g2"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, g1[row], g2[row])] + [batch.column(0).take(pa.array(which[row])), pa.array((step + (lo - off)[row]).astype(np.int32))], names=["w1", "w2", "g1", "g2", "doc_id", "step"])

    windows = at_texts(base, alive, "inner", "lo", "n", "g1", "g2", "off").mapInArrow(extend, "w1 long, w2 long, g1 long, g2 long, doc_id long, step int")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most").drop("_most")
    gone = split_join(windows, least, ["w1", "w2"]).filter("doc_id > _least").groupBy("g1", "g2").agg(F.collect_set("step").alias("steps"))
    by_content = contents.select("ah", "g1", "g2", F.col("doc_id").alias("_first")).join(gone, ["g1", "g2"], "left")
    spans = split_join(s, by_content, ["ah", "g1", "g2"]).withColumn("_cut", F.when(F.col("doc_id") > F.col("_first"), F.array(F.struct(F.col("lo").alias("lo"), (F.col("n") + window - 1).alias("n")))).otherwise(F.transform("steps", lambda x: F.struct((F.col("lo") + x).alias("lo"), F.lit(window).alias("n")))))
    spans = spans.select("doc_id", "th", F.explode("_cut").alias("x")).select("doc_id", "th", "x.lo", "x.n")

    def finish(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            out = []
            for doc, text, rows in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                if rows:
                    lost = covered(n, [(r["lo"], r["n"]) for r in rows])
                    words = [w for w, x in zip(words, lost.tolist()) if not x]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = at_texts(base, spans, "left", "lo", "n").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words that a document of smaller doc_id has too."""
    return dedup(table(spark, sf_dir, "documents"))
