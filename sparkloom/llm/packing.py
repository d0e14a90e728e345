"""Best-fit packing of tokenised documents into sequences, by linear grouping.

A document is its text's token ids (null: the empty text) and one end id; only documents longer than a sequence are cut,
into whole sequences, of which the first may be shorter. Lengths are integers below the sequence length, so whatever the
size of the corpus, its histogram of lengths has no more entries than a sequence has tokens. The plan is made from that
histogram alone, on the driver:

1. lengths above a share of the sequence are put in order and dealt into groups of equal cardinality; each counts as its
   group's longest;
2. configurations (which groups fill one sequence) are optimised one after another: the longest length left and, by an
   exact subset-sum search over the groups that remain, the companions that fill its sequence best, as often as the
   groups allow;
3. actual documents take the places of their groups: the n-th longest piece takes the n-th place, so the true room left
   in each sequence is known, class by class;
4. small pieces go, the longest first, into the least room that holds them; new sequences open when none does.

The plan says for the pieces of a length, by their rank, which sequence and which place they get. Ranks are dealt out on
Spark: every task numbers the pieces of each length that it cuts, and gets an offset for each length from what the tasks
before it have cut. So a length that a third of all pieces share is not numbered by one task, nothing is sorted, and
pieces are shuffled by the task that cut them, which makes even parts. Repeated rows are pieces of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import field, map_texts, written

#: The pattern by which byte-level BPE cuts a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to their ids by the tokenizers file ``path``, without added special tokens.

    A byte-level BPE whose ids follow its merges is run by tiktoken, several times as fast with the same ids; any other
    file, and any text that tiktoken can't cut into words, by tokenizers itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    @functools.lru_cache(maxsize=1)
    def whole() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def plain(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in whole().encode_batch_fast(texts, add_special_tokens=False)]

    spec = json.loads(Tokenizer.from_file(path).to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
        return plain
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
        return plain
    byte_of, vocabulary = _byte_of(), model["vocab"]
    merged = [vocabulary["".join(m)] for m in model["merges"]]
    if merged != sorted(merged):
        return plain
    import tiktoken

    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    fast = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # a run of white space that is too long for its pattern engine
            return plain([text])[0]

    return lambda texts: [encode(t) for t in texts]


def tokenise(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2) -> DataFrame:
    """Return id, piece, start, length and ids_crc32 for every piece of every document; and ``part`` and ``nth``, as ``numbered``."""

    def make():
        encode, number = encoder(tokenizer_path), _Numbers(length)

        def cut(texts: list[str | None]) -> dict:
            out = defaultdict(list)
            for row, ids in enumerate(encode([t or "" for t in texts])):
                data = np.array([*ids, end_id], "<u4")
                bounds = [0, *range(len(data) % length or length, len(data) + 1, length)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for name, value in (("row", row), ("piece", piece), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(data[a:b].tobytes()))):
                        out[name].append(value)
            return out | number(np.array(out["length"], np.int64))

        return cut

    fields = [field("piece", "int"), field("start", "bigint"), field("length", "bigint"), field("ids_crc32", "bigint"), *_NUMBERS]
    return map_texts(docs, id_col, text_col, fields, make, 1 << 18)


_NUMBERS = (T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()))


class _Numbers:
    """Numbers the pieces of each length within a task."""

    def __init__(self, length: int) -> None:
        self.seen, self.part = np.zeros(length + 1, np.int64), TaskContext.get().partitionId()

    def __call__(self, lengths: np.ndarray) -> dict:
        order = np.argsort(lengths, kind="stable")
        ascending = lengths[order]
        nth = np.empty(len(lengths), np.int64)
        nth[order] = self.seen[ascending] + np.arange(len(lengths)) - np.searchsorted(ascending, ascending, side="left")
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return {"part": np.full(len(lengths), self.part, np.int32), "nth": nth}


def numbered(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """Add ``part`` (the task) and ``nth`` (from 0 within task and length) to pieces with a ``length``; to be written, not to be computed twice."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Numbers(length)
        for batch in batches:
            made = own(batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made["part"]), pa.array(made["nth"])], names=[*batch.schema.names, "part", "nth"])

    return pieces.mapInArrow(number, T.StructType([*pieces.schema.fields, *_NUMBERS]))


def _configurations(sizes: list[int], counts: list[int], length: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Yield ([(size's index, how many), ...], how often) until all counts are used; sizes ascend."""
    left = list(counts)
    top = len(sizes) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room = length - sizes[top]
        steps: list[tuple[int, int]] = []  # (index, the sums that can be reached without it)
        sums, mask = 1, (1 << (room + 1)) - 1
        for i in range(top, -1, -1):
            most = min(left[i] - (i == top), room // sizes[i])
            if most <= 0:
                continue
            steps.append((i, sums))
            grown = sums
            for _ in range(most):
                more = (grown | grown << sizes[i]) & mask
                if more == grown:
                    break
                grown = more
            sums = grown
            if sums >> room & 1:
                break
        fill = sums.bit_length() - 1
        used = defaultdict(int, {top: 1})
        for i, before in reversed(steps):
            while not before >> fill & 1:
                fill -= sizes[i]
                used[i] += 1
        times = min(left[i] // n for i, n in used.items())
        for i, n in used.items():
            left[i] -= n * times
        yield sorted(used.items(), reverse=True), times


def plan(histogram: dict[int, int], length: int = 1024, groups: int = 4096, small: float = 1 / 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for ``histogram[n]`` pieces of each length n: rows (length, first rank, how many, first sequence, offset).

    The piece of rank ``first + k`` goes to sequence ``first sequence + k``. Also returns the number of sequences. The
    work depends on the sequence length and ``groups``, not on the number of pieces.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = histogram.get(length, 0)
    if sequences:
        rows.append((length, 0, sequences, 0, 0))
    large = sorted((n for n in histogram if small * length < n < length and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in large)
    each = max(1, -(-total // groups))
    runs = []  # (first place in the order, length): the pieces in descending order of length
    at = 0
    for n in large:
        runs.append((at, n))
        at += histogram[n]
    starts = [r[0] for r in runs]

    def run_at(place: int) -> int:
        return bisect_left(starts, place + 1) - 1

    places: dict[int, list[list[int]]] = defaultdict(list)  # rounded length -> [first place, how many] of its groups
    for first in range(0, total, each):
        places[runs[run_at(first)][1]].append([first, min(each, total - first)])
    sizes = sorted(places)
    rooms: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> [(first sequence, how many, offset)]

    for used, times in _configurations(sizes, [sum(x[1] for x in places[s]) for s in sizes], length):
        slots = [sizes[i] for i, n in used for _ in range(n)]
        taken = []  # for each slot, the stretches of equal length that it gets
        for s in slots:
            need, stretches = times, []
            while need:
                first, have = places[s][-1]
                k = run_at(first)
                here = min(need, have, (starts[k + 1] if k + 1 < len(starts) else total) - first)
                stretches.append([runs[k][1], first - starts[k], here])
                need -= here
                if here == have:
                    places[s].pop()
                else:
                    places[s][-1] = [first + here, have - here]
            taken.append(stretches[::-1])
        while taken[0]:
            here = min(x[-1][2] for x in taken)
            offset = 0
            for x in taken:
                n, rank, have = x[-1]
                rows.append((n, rank, here, sequences, offset))
                offset += n
                if have == here:
                    x.pop()
                else:
                    x[-1] = [n, rank + here, have - here]
            rooms[length - offset].append((sequences, here, offset))
            sequences += here

    open_rooms = sorted(r for r in rooms if r)
    for n in sorted((n for n in histogram if n <= small * length and n < length), reverse=True):
        rank, left = 0, histogram[n]
        while left:
            k = bisect_left(open_rooms, n)
            if k == len(open_rooms):
                new = -(-left // (length // n))
                rooms[length] = [(sequences, new, 0)]
                insort(open_rooms, length)
                sequences += new
                continue
            room = open_rooms[k]
            first, have, offset = rooms[room].pop()
            here = min(have, left)
            if here < have:
                rooms[room].append((first + here, have - here, offset))
            if not rooms[room]:
                open_rooms.pop(k)
            rows.append((n, rank, here, first, offset))
            rank, left = rank + here, left - here
            if room > n:
                if not rooms[room - n]:
                    insort(open_rooms, room - n)
                rooms[room - n].append((first, here, offset + n))
    return rows, sequences


def offsets(pieces: DataFrame, length: int) -> DataFrame:
    """(part, bases): for each length how many pieces of it are in the parts before, an array by length.

    The window of a length has a row for each part, that is for each task that cut pieces, not for each piece.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    held = based.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("base"))
    return held.select("part", F.transform(F.sequence(F.lit(0), F.lit(length)), lambda n: F.coalesce(F.element_at("base", n.cast("long")), F.lit(0))).alias("bases"))


def pack(pieces: DataFrame, *, length: int = 1024, groups: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a ``length`` (1 to ``length``) and the numbers of ``numbered``."""
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(histogram, length, groups)
    rows.sort()
    sent = pieces.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    schema = T.StructType([f for f in pieces.schema.fields if f.name not in ("part", "nth")] + [field("sequence_id", "bigint"), field("offset", "bigint")])
    keep = [f.name for f in schema.fields[:-2]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        key = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            own_length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, own_length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(places[k, 3] + rank - places[k, 1]), pa.array(places[k, 4])], names=schema.names
            )

    rank = F.col("nth") + F.element_at("bases", F.col("length").cast("int") + 1)
    return pieces.join(offsets(pieces, length), "part").select(*keep, rank.alias("rank")).mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, groups: int = 4096
) -> DataFrame:
    """Return id, piece, start, length, ids_crc32, sequence_id and offset, one row for each piece of ``docs``."""
    return pack(written(tokenise(docs, tokenizer_path, id_col=id_col, text_col=text_col, length=length, end_id=end_id), "pieces"), length=length, groups=groups)
