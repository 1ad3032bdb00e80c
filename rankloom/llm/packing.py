"""Packing by power-of-two decomposition: no sequence holds tokens of two documents, and none needs padding."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .rolling import BASES, BYTES, Prefix, Text

#: Fixed value: the pattern by which byte-level BPE of this vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What \s of the pattern matches, two or more; and the length in bytes from which such a run is encoded apart.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
LONG = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"
_encoders: dict[str, Encoder] = {}


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Token ids of a byte-level BPE file. With added, its added tokens are found in a text, the leftmost and of these the
    longest first, as tokenizers does by default; without, such strings are plain text.

    A space between two characters that are no white space always starts a token, so a text may be cut before such
    spaces and the stretches encoded apart. Equal stretches of a batch are found by hash and encoded once.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if added and any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take white space or whole words only")
        self.added = special if added else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        back = byte_of_char()
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.bpe = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.n_bytes[i] = len(word)

    def ids(self, data: bytes) -> np.ndarray:
        """A long run of white space, less its last character where more follows, is one piece of the pattern, whose
        backtracking would not survive it; so it is encoded as a piece, and the text around it apart."""
        text = data.decode()
        if len(data) < LONG:
            return self.bpe.encode_to_numpy(text)
        out, at = [], 0
        for run in WHITE.finditer(text):
            begin, end = run.start(), run.end() - (run.end() < len(text))
            if end - begin >= LONG // 4:
                piece = self.bpe._core_bpe.encode_single_piece(text[begin:end].encode())
                out += [self.bpe.encode_to_numpy(text[at:begin]), np.array(piece, np.uint32)]
                at = end
        return np.concatenate([*out, self.bpe.encode_to_numpy(text[at:])])

    @staticmethod
    def cuts(buf: np.ndarray) -> np.ndarray:
        """Places of spaces between two characters that are surely no white space."""
        white = (buf == 32) | ((buf >= 9) & (buf <= 13)) | ((buf >= 28) & (buf <= 31))
        at = np.flatnonzero(buf[:-1] == 32)
        at = at[at > 0]
        at = at[~white[at - 1] & ~white[at + 1] & ~np.isin(buf[at + 1], (0xC2, 0xE1, 0xE2, 0xE3))]
        wide = buf[at - 1] >= 0x80
        wide &= (buf[np.maximum(at - 2, 0)] == 0xC2) | np.isin(buf[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))
        return at[~wide]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if not any(x in t for t in texts if t for x in self.added):
            return self.plain(texts)
        parts = [self.split.split(t or "") for t in texts]  # added tokens are at the odd places
        ids = iter(self.plain([x for p in parts for x in p[::2]]))
        return [np.concatenate([np.array([self.added[x]], np.uint32) if i % 2 else next(ids) for i, x in enumerate(p)]) for p in parts]

    def plain(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text without added tokens. The first and the last stretch of a text are encoded directly, those between by what is equal."""
        t = Text(texts)
        cuts = self.cuts(t.buf)
        low, high = np.searchsorted(cuts, t.begin), np.searchsorted(cuts, t.end)
        start, end = cuts[:-1], cuts[1:]
        inner = np.zeros(len(start) + 1, bool)
        many = high - low >= 2
        marks = np.zeros(len(start) + 2, np.int64)
        np.add.at(marks, low[many], 1)
        np.add.at(marks, high[many] - 1, -1)
        inner = np.cumsum(marks)[: len(start)] > 0
        place = np.concatenate([[0], np.cumsum(inner)])
        start, end = start[inner], end[inner]
        values = [Prefix(BYTES[k][t.buf], BASES[k]).spans(start, end) for k in (0, 1)]
        _, first, which = np.unique(values[0], return_index=True, return_inverse=True)
        if not np.array_equal(values[1], values[1][first][which]):  # two stretches with one hash
            return [self.ids(t.data[b:e]) for b, e in zip(t.begin.tolist(), t.end.tolist())]
        a, z = start[first], end[first]
        step = z - a
        off = np.cumsum(step) - step
        own = self.ids(t.buf[np.repeat(a - off, step) + np.arange(int(step.sum()))].tobytes())
        stops = np.searchsorted(np.cumsum(self.n_bytes[own]), np.cumsum(step)) + 1
        count = np.diff(stops, prepend=0)
        n = count[which]
        off = np.cumsum(n) - n
        flat = own[np.repeat((stops - count)[which] - off, n) + np.arange(int(n.sum()))] if len(n) else own
        off = np.concatenate([off, [len(flat)]])
        out = []
        for i, (b, e, lo, hi) in enumerate(zip(t.begin.tolist(), t.end.tolist(), low.tolist(), high.tolist())):
            if hi - lo < 2:
                out.append(self.ids(t.data[b:e]))
            else:
                middle = flat[off[place[lo]] : off[place[hi - 1]]]
                out.append(np.concatenate([self.ids(t.data[b : cuts[lo]]), middle, self.ids(t.data[cuts[hi - 1] : e])]))
        return out


def decompose(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of pieces: as many of the longest as fit, then the binary digits of the rest, large to small."""
    out = [(s, longest) for s in range(0, n - longest + 1, longest)]
    at, bit = len(out) * longest, longest
    while at < n:
        bit >>= 1
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False, batch_tokens: int = 1 << 16) -> DataFrame:
    """Cut each document's ids and end_id into pieces of power-of-two length; each piece is a sequence of its own.

    Reads doc_id and text of docs (other columns are ignored) and gives one row per piece; with_ids adds the piece's
    ids as bytes of little-endian uint32. Pieces of equal length form a bucket (`bucket` is the length's logarithm), and
    each bucket is dealt to batches of at most batch_tokens ids (`batch_id`; pieces of one length only, so a batch is a
    full rectangle). Rows come bucket by bucket, long ones first, within each run of documents.
    Added tokens of the file that stand in a text become their ids.
    A null or empty text is the end id alone; null or repeated doc_ids are packed like others; no rows give no rows.
    sequence_id is the scan partition's number and a count within it, so that reruns over the same files agree.
    There is no shuffle, and a lost task is simply run again.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    tail = int(end_id).to_bytes(4, "little")

    def work(batches):
        encode = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, Encoder(tokenizer_path, added=True))
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 38
        sequence, filled, batches_made = first, {}, 0  # filled: of each bucket its open batch and the pieces in it
        for whole in batches:
            for batch in slices(whole, 1, 3 << 19):
                buckets: dict[int, list[tuple]] = {}
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    ids = ids.astype("<u4").tobytes() + tail
                    n = len(ids) // 4
                    for start, length in decompose(n, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        buckets.setdefault(length, []).append((doc, start, length, zlib.crc32(piece), n, piece))
                rows: list[tuple] = []
                for length, pieces in sorted(buckets.items(), reverse=True):
                    bucket, fit = length.bit_length() - 1, max(1, batch_tokens // length)
                    for piece in pieces:
                        now, held = filled.get(length, (None, fit))
                        if held == fit:
                            now, held = first + batches_made, 0
                            batches_made += 1
                        filled[length] = now, held + 1
                        rows.append((*piece[:5], sequence, 0, bucket, now, piece[5]))
                        sequence += 1
                types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "ids"]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)]
                last = 10 if with_ids else 9
                yield pa.RecordBatch.from_arrays(columns[:last], names=names[:last])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES + (", ids binary" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens of the 50k byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
