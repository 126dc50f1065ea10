"""Sequence packing by shortest-pack-first over the length histogram.

Texts are tokenised once; each document that has a token ends with a separator
(the first id that the vocabulary leaves free), and what is longer than a sequence
is cut into full pieces and a remainder, so no token is lost.  Only the histogram of
piece lengths, which has at most ``sequence`` bins whatever the corpus, comes to the
driver.  There lengths are placed longest first, each into the shortest pack that has
room; packs of the same content are one pattern with a count, so a step handles all
pieces of a length and all packs of a pattern at once.  Patterns become slots
(length, ranks, first pack, offset), and the pieces of a length, ranked, look up
their slot.  A rank has two levels: the place among the pieces of its length that the
same task made, which is known as they are made, and the number of such pieces of all
tasks before.  So neither texts nor tokens are shuffled or sorted, and no length ends in
one task.

A piece carries its tokens: the pieces of a pack, by offset, are a training sequence.
The vocabulary is a file that the driver reads; its bytes travel with the tasks.

Defined results: null and empty texts have no tokens and are in no pack; repeated
rows are packed each; pieces of a length rank in the order in which they are read; an
empty table gives no rows; extra columns are ignored.  A special token written in a text is
ordinary text.  The pattern's engine cannot match a very long run of white space; such
a run is encoded apart from the text around it, into the tokens that the pattern gives.
"""

from __future__ import annotations

import base64
import heapq
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written
from .textkernel import tidied

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space as the pattern has it, in runs that are encoded apart.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % (1 << 14))
#: Texts shorter than this are not searched for such runs.
_APART = 1 << 14
#: Characters that are encoded at a time, up to the next end of a word.
_PART = 1 << 20


#: Rows that are text objects at a time.
_ROWS = 256


@dataclass(frozen=True)
class Packing:
    sequence: int = 2048
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    #: Counts by task and length up to this number are broadcast (some 60 bytes each); more are joined by a shuffle, with the same rows.
    broadcast_counts: int = 500_000


def vocabulary(how: Packing) -> bytes:
    with open(how.vocabulary, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def tokens(encode: tiktoken.Encoding, text: str) -> np.ndarray:
    """The tokens of a text; of a run of white space all but the last character are one piece, or all at the text's end."""
    out, at = [], 0
    if len(text) >= _APART:
        for m in _LONG_SPACE.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            out += _in_parts(encode, text[at : m.start()])
            out.append(np.array(encode._core_bpe.encode_single_piece(text[m.start() : stop].encode()), np.int32))
            at = stop
    out += _in_parts(encode, text[at:])
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])


def _in_parts(encode: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    """Parts begin at a single space after a letter and before one, where the pattern always begins a piece."""
    out, at = [], 0
    while at < len(text):
        m = _BREAK.search(text, at + _PART) if len(text) - at > 2 * _PART else None
        stop = m.start() + 1 if m else len(text)
        out.append(encode.encode_to_numpy(text[at:stop], disallowed_special=()).astype(np.int32))
        at = stop
    return out


_BREAK = re.compile(r"[^\W\d_](?= [^\W\d_])")


def place(histogram: dict[int, int], sequence: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in a pack): the result of placing one piece after another, longest first, into the shortest pack with room."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    largest: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, n: int, pack: tuple[int, ...]) -> None:
        if room == 0:
            done.append((n, pack))
            return
        if room not in free:
            free[room] = []
            heapq.heappush(largest, -room)
        free[room].append((n, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while largest and not free.get(-largest[0]):
                free.pop(-heapq.heappop(largest), None)
            room = -largest[0] if largest else 0
            if room < length:  # new packs, filled with this length alone: each is the only one with room until it is full
                each = sequence // length
                for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
                    if n:
                        put(sequence - k * length, n, (length,) * k)
                break
            n, pack = free[room].pop()
            take = min(n, left)
            if n > take:
                free[room].append((n - take, pack))
            put(room - length, take, (*pack, length))
            left -= take
    return done + [x for groups in free.values() for x in groups]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, pack of the first rank, offset in the pack)."""
    out, ranks, pack = [], {}, 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + n, pack, offset))
            ranks[length] = rank + n
            offset += length
        pack += n
    return out


def pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """doc_id, piece, start, length, tokens of every piece of every text, the task that made it and its place among that task's pieces of the length."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(how))

    def work(batches):
        encode, task = encoding(held.value), TaskContext.get().partitionId()
        end, made = np.array([encode.n_vocab], np.int32), np.zeros(how.sequence + 1, np.int64)
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [np.concatenate([tokens(encode, t), end]) if t else end[:0] for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in rows], np.int64)
                k = -(-n // how.sequence)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * how.sequence
                length = np.minimum(n[row] - start, how.sequence)
                order = np.argsort(length, kind="stable")
                count = np.bincount(length, minlength=how.sequence + 1)
                inside = np.empty(len(length), np.int64)
                inside[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
                inside += made[length]
                made += count
                flat = np.concatenate([end[:0], *rows])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat, pa.int32()))
                numbers = [pa.array(x, pa.int64()) for x in (piece, start, length)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *numbers, lists, pa.array(np.full(len(row), task)), pa.array(inside)], names=["doc_id", "piece", "start", "length", "tokens", "task", "inside"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, piece long, start long, length long, tokens array<int>, task long, inside long")


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start (in the document's tokens), length, tokens, pack_id, offset (in the pack) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, how), "pieces")
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    if counts.count() <= how.broadcast_counts:
        offsets = F.broadcast(offsets)
    table = spark.createDataFrame(slots(place(histogram, how.sequence)), "l long, first long, last long, pack long, offset long")
    ranked = cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("inside"))
    # the slots are a few for each length, whatever the corpus
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select(
        "doc_id", "piece", "start", "length", "tokens", (F.col("pack") + F.col("rank") - F.col("first")).alias("pack_id"), "offset"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
