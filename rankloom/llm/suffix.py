"""Suffix-array dedup: arrays per shard by Larsson-Sadakane refinement, common prefixes by Kasai, shards merged by binary search."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, split_join, table
from .repeats import Units, at_texts, covered, keyed, repeated
from .rolling import BASES, BYTES, Prefix

#: Contents of one anchor that are dealt to one task; those of an anchor with more are salted over several.
SALT = 2048


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, width = len(data), 1
    while width < 8:
        x = (x[: len(x) - width] << np.uint64(8 * width)) | x[width:]
        width *= 2
    return x[:n]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort suffixes by eight bytes, then refine only the groups that are still tied, each round by the
    rank of what follows at twice the distance, until every suffix stands alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    key = words_at(data)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    if np.any(data[-8:] == 0):  # zeros of the padding and zeros of the text: the shorter suffix is less
        tail = np.flatnonzero(sa >= n - 8)
        length = np.full(n, 8)
        length[tail] = n - sa[tail]
        order = np.lexsort((length, key))
        sa, key, length = sa[order], key[order], length[order]
        new = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
    else:
        new = key[1:] != key[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    tied = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
    h = 8
    while len(tied):
        at = sa[tied]
        after = at + h
        then = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        order = np.argsort(group * (n + 2) + then, kind="stable")
        at, group, then = at[order], group[order], then[order]
        sa[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return sa


#: From which number on a word of eight bytes has one leading zero byte less.
STEPS = [np.uint64(1) << np.uint64(8 * k) for k in range(1, 8)]


def kasai(data: np.ndarray, sa: np.ndarray, lanes: int = 16384, most: int | None = None) -> np.ndarray:
    """lcp[k] of suffixes sa[k - 1] and sa[k] (lcp[0] = 0). Kasai's walk in text order, where the common prefix falls by
    one at most from place to place, done in many stretches of the text at once and eight bytes at a time. With `most`,
    prefixes are followed no further than that: what is longer may be given as any length from `most` on."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    eight = words_at(data)
    most = n if most is None else most
    lane = np.arange(0, n, max(1, -(-n // lanes)))
    stop = np.append(lane[1:], n)
    h = np.zeros(len(lane), np.int64)
    plcp = np.zeros(n, np.int64)
    for step in range(int((stop - lane).max()) if n else 0):
        live = np.flatnonzero(lane + step < stop)
        i = lane[live] + step
        j = before[i]
        now = np.where(j < 0, 0, h[live])
        go = np.flatnonzero((j >= 0) & (now < most))
        while len(go):
            a, b = i[go] + now[go], j[go] + now[go]
            room = n - np.maximum(a, b)
            if room.min() < 8:
                ok = room > 0
                go, a, b, room = go[ok], a[ok], b[ok], room[ok]
            diff = eight[a] ^ eight[b]
            whole = diff == 0
            same = np.full(len(go), 8, np.int64)
            part = np.flatnonzero(~whole)
            if len(part):  # whole equal bytes before the first that differs
                rest = diff[part]
                high = (rest >= STEPS[0]).astype(np.int64)
                for bound in STEPS[1:]:
                    high += rest >= bound
                same[part] = 7 - high
            now[go] += np.minimum(same, room)
            go = go[whole & (room > 8)]
            go = go[now[go] < most]
        plcp[i] = now
        h[live] = np.maximum(now - 1, 0)
    return plcp[sa]


def classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each of the strings of that length at starts, equal for equal strings, by suffix array and common prefixes."""
    sa = suffix_array(data)
    group = np.cumsum(kasai(data, sa, most=length) < length)
    by_place = np.empty(len(sa), np.int64)
    by_place[sa] = group
    return by_place[starts]


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run, how many of the other runs hold each of its values: all runs' values are sorted once, and each run
    is looked up in these by binary search."""
    merged = np.sort(np.concatenate([np.unique(r) for r in runs])) if runs else np.zeros(0, np.int64)
    return [np.searchsorted(merged, r, "right") - np.searchsorted(merged, r) - 1 for r in runs]


def shard(batches, length: int, limit: int):
    """Rows ah, salts, salt, g1, g2, copies, n, content, sorted by ah and salt, cut into shards of about `limit` bytes wherever
    that is -> per content the runs of its windows that have an equal elsewhere (kind 0). Of anchors that have contents in
    another shard too, as the first or last of a shard or a salted one may, also the digests of windows: kind 1 is alone
    in its shard, kind 2 stands for a class that isn't."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32

    def solve(rows, before: bool, after: bool):
        columns = list(zip(*rows))
        content = columns[7]
        sizes = np.fromiter(map(len, content), np.int64, len(content))
        n = np.array(columns[6], np.int64)
        data = np.frombuffer(b"".join(content), np.uint8)
        begin = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(n)), n)
        step = np.arange(int(n.sum())) - (np.cumsum(n) - n)[seg]
        starts = begin[seg] + step
        kind = classes(data, starts, length)
        weight = np.bincount(kind, np.array(columns[5], np.float64)[seg])[kind]
        ah, g1, g2 = (np.array(columns[k], np.int64) for k in (0, 3, 4))
        gone = weight > 1.5
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        cuts = np.concatenate([[True], seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, bool)
        # runs end at segment borders too
        head = np.flatnonzero(gone & (cuts | (edge[:-1] == 1)))
        tail = np.flatnonzero(gone & (np.append(cuts[1:], True) | (edge[1:] == -1)))
        out = [(np.zeros(len(head), np.int64), ah[seg[head]], g1[seg[head]], g2[seg[head]], step[head], tail - head + 1, head * 0, head * 0, head * 0)]
        elsewhere = (np.array(columns[1], np.int64) > 1) | (before & (ah == ah[0])) | (after & (ah == ah[-1]))
        split = elsewhere[seg]
        w1, w2 = (Prefix(BYTES[k][data], BASES[2 + k]).spans(starts[split], starts[split] + length).view(np.int64) for k in (0, 1))
        one = np.zeros(len(seg), bool)
        one[np.unique(kind, return_index=True)[1]] = True
        at = np.flatnonzero(split)
        kept = ~gone[at] | one[at]
        at, w1, w2 = at[kept], w1[kept], w2[kept]
        out.append((np.where(gone[at], 2, 1), ah[seg[at]], g1[seg[at]], g2[seg[at]], step[at], at * 0 + 1, at * 0 + number, w1, w2))
        for x in out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["kind", "ah", "g1", "g2", "step", "n", "chunk", "w1", "w2"])

    held, size, last, before = [], 0, None, False
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if size >= limit:
                yield from solve(held, before, row[0] == last)
                held, size, before = [], 0, row[0] == last
                number += 1
            held.append(row)
            size += len(row[7])
            last = row[0]
    if held:
        yield from solve(held, before, False)


def across(batches):
    """Rows of shard(), those of kind 0 first and then by w1 -> the runs of kind 0 as they are, and the windows alone in
    their shard that another shard has."""
    names = ["ah", "g1", "g2", "step", "n"]
    carry = None
    for batch in itertools.chain(batches, [None]):
        t = None
        if batch is not None:
            done = pc.equal(batch.column("kind"), 0)
            yield batch.select(names).filter(done)
            batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t]) if t is not None else carry
        if t is None:
            return
        w1 = t.column("w1").to_numpy()
        end = len(w1) if batch is None else int(np.searchsorted(w1, w1[-1]))
        carry = t.slice(end)
        t = t.slice(0, end)
        if not len(t):
            continue
        w, v = t.column("w1").to_numpy(), t.column("w2").to_numpy()
        chunk, alone = t.column("chunk").to_numpy(), t.column("kind").to_numpy() == 1
        digest = np.rec.fromarrays([w, v], names="w,v").view([("w", np.int64), ("v", np.int64)])
        found = np.zeros(len(w), bool)
        order = np.lexsort((v, w, chunk))
        border = np.flatnonzero(np.diff(chunk[order])) + 1
        parts = np.split(order, border)
        pair = np.unique(digest, return_inverse=True)[1]  # order-preserving numbers of the 128-bit digests
        for part, n in zip(parts, merge_runs([pair[p] for p in parts])):
            found[part] = n > 0
        at = pa.array(np.flatnonzero(found & alone))
        yield pa.RecordBatch.from_arrays([t.column(c).take(at).combine_chunks() for c in names], names=names)


def dedup(docs: DataFrame, length: int = 200, part: int = 32, shard_bytes: int = 1 << 20, salt: int = SALT, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else, the same text included.

    The contents around repeated anchors (see repeats.py), one copy of each with its number of copies, are dealt out by
    anchor, salted for those with very many, and cut into shards of shard_bytes. Each shard's suffix array and common
    prefixes give the classes of equal strings; a string goes if its class has two members or more, copies counted.
    Strings of anchors that have contents in several shards and are alone in theirs are looked up in the others, by
    binary search in their sorted digests.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if with_text) for every row.
    Null text is empty; rows with null or equal doc_ids are places like any other, so that of two equal rows both lose
    what they share. A very long text is read whole by one task. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = keyed(docs)
    s = repeated(base, False, part, length, scratch)
    contents = scratch.cut(s.groupBy("ah", "g1", "g2").agg(F.min(F.struct("doc_id", "th", "lo", "n")).alias("r"), F.count("*").alias("copies")).select("ah", "g1", "g2", "copies", "r.*"))
    several = contents.groupBy("ah").agg(F.count("*").alias("c"))

    def extract(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
                rows = batch.column(3)
                which = np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                own = rows.flatten()
                lo, n = own.field("lo").to_pylist(), own.field("n").to_pylist()
                content = [raw[w][a : a + k + length - 1] for w, a, k in zip(which, lo, n)]
                yield pa.RecordBatch.from_arrays([own.field(c) for c in ("ah", "salts", "salt", "g1", "g2", "copies", "n")] + [pa.array(content, pa.binary())], names=["ah", "salts", "salt", "g1", "g2", "copies", "n", "content"])

    contents = split_join(contents, several, ["ah"]).withColumn("salts", F.ceil(F.col("c") / salt)).withColumn("salt", F.pmod("g2", "salts"))
    cuttings = at_texts(base, contents, "inner", "lo", "n", "ah", "salts", "salt", "g1", "g2", "copies").mapInArrow(extract, "ah long, salts long, salt long, g1 long, g2 long, copies long, n int, content binary")
    cuttings = cuttings.repartition("ah", "salt").sortWithinPartitions("ah", "salt")
    solved = cuttings.mapInArrow(lambda it: shard(it, length, shard_bytes), "kind long, ah long, g1 long, g2 long, step long, n long, chunk long, w1 long, w2 long")
    # nothing is cut from here on: within one plan the texts are exchanged once for both uses
    dealt = solved.repartition(F.when(F.col("kind") == 0, F.xxhash64("ah", "g1", "g2")).otherwise(F.col("w1"))).sortWithinPartitions(F.col("kind") > 0, "w1")
    runs = dealt.mapInArrow(across, "ah long, g1 long, g2 long, step long, n long")
    runs = runs.groupBy("ah", "g1", "g2").agg(F.collect_list(F.struct("step", (F.col("n") + length - 1).alias("n"))).alias("runs"))
    spans = s.select("doc_id", "th", "ah", "g1", "g2", "lo")
    spans = split_join(spans, runs, ["ah", "g1", "g2"]).select("doc_id", "th", F.explode("runs").alias("x"), "lo")
    spans = spans.select("doc_id", "th", (F.col("lo") + F.col("x.step")).alias("lo"), F.col("x.n").alias("n"))

    def finish(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            out = []
            for doc, text, rows in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                kept = raw = (text or "").encode()
                n_spans = 0
                if rows:
                    lost = covered(len(raw), [(r["lo"], r["n"]) for r in rows])
                    kept = np.frombuffer(raw, np.uint8)[~lost].tobytes()
                    n_spans = int(np.count_nonzero(lost[1:] & ~lost[:-1]) + lost[0])
                out.append((doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = at_texts(base, spans, "left", "lo", "n").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur elsewhere too."""
    return dedup(table(spark, sf_dir, "documents"))
