"""Substring dedup by repeated-phrase automata: words go that lie in a window which a document with a smaller id has too.

A text's words are runs of anything but ASCII white space, unchanged. A window is ``window`` neighbouring words of one
document; each word covered by a window whose words also start in a document with a smaller id goes. Windows are judged on
the input, not on what is left. What stays is joined by single spaces.

1. Equal texts are one: the row with the smallest id stands for them, and any other loses all words if it has a window.
2. Seeds: of the runs of ``GRAM`` words in a window the one with the smallest hash, a function of the window alone. Seeds
   that documents of different ids have are counted exactly; documents without any have no recurring window.
3. Recurring passages are confirmed window by window: the windows of such seeds are counted by (seed, hash), and each that
   recurs is owned by the smallest id. An owner's neighbouring windows are one passage.
4. Passages are dealt to shards by their owners. A shard's passages are cut into blocks of half a window, so that every
   window holds a whole block, and compiled into an Aho-Corasick automaton. The documents that share a window with an
   owner stream through its shard's automaton, which finds every occurrence of a block; around it, windows are looked up
   and compared word by word, so hashes alone never remove anything.

A shard that many documents stream through is dealt to several tasks, each with a copy of its passages (about
``SHARD`` windows, or one owner's). A passage that a third of all documents hold is one row among the passages, and its
documents are spread over tasks by their own keys. Nothing but counts reaches the driver. Two windows of the same seed
and the same 64-bit hash would count as one while owners are looked for; a copy might then stay.

Null and empty texts have no words. A null id counts as larger than any other. Rows that share an id are rows of their
own, and no copies for each other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import words as W
from sparkloom.llm._common import field, map_texts, scope, small, small_batches, text_chunks, to_arrow, written

GRAM = 16  # words of a seed
SHARD = 150_000  # windows of a shard, about
STREAM = 1_000_000  # words that stream through one copy of a shard, about
_IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    power, inverse = W._grow(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return W.mix((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1])


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    k = 1
    while 2 * k <= n:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return x if k == n else np.minimum(x[: k - n], x[n - k :])


class Windows:
    """All windows of some texts: where they start among the words, whose they are, their hashes and seeds."""

    def __init__(self, parts: list[bytes], window: int) -> None:
        own = W.cut(parts, _IN_WORD)
        gram = min(GRAM, window)
        self.text = own.text
        self.at = np.flatnonzero(own.text[: len(own.text) - window + 1] == own.text[window - 1 :]) if len(own.text) >= window else np.zeros(0, np.int64)
        self.hash = rolling(own.hash, window)[self.at]
        self.seed = smallest(rolling(own.hash, gram), window - gram + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.of = own.text[self.at]


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def joined(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def word_count(line: Column) -> Column:
    """Of words joined by single spaces."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def _recurs(id_col: str = "id") -> Column:
    """An aggregate: whether rows of different ids meet, null counting as the largest."""
    low = F.min(id_col)
    return low.isNotNull() & ((low < F.max(id_col)) | F.bool_or(F.col(id_col).isNull()))


def _seeds(texts: DataFrame, window: int) -> DataFrame:
    """(id, t1, t2, seeds): the distinct seeds of each text that has a window."""

    def make():
        def found(given: list[str | None]) -> dict:
            own = Windows(_encoded(given), window)
            cuts = np.searchsorted(own.of, np.arange(len(given) + 1))
            seeds = [np.unique(own.seed[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:])]
            return {"seeds": seeds}

        return found

    return map_texts(texts, "id", "text", [field("seeds", "array<bigint>")], make, carry=["t1", "t2"]).where(F.size("seeds") > 0)


def _windows(held: DataFrame, window: int) -> DataFrame:
    """(tid, id, n, seed, w) of the windows of ``held(tid, text, id, n, marks)`` whose seed is among the marks."""
    schema = T.StructType([held.schema["tid"], held.schema["id"], held.schema["n"], field("seed", "bigint"), field("w", "bigint")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1 << 18):
            own = Windows(_encoded(texts), window)
            cuts = np.searchsorted(own.of, np.arange(len(texts) + 1))
            taken = [a + np.flatnonzero(np.isin(own.seed[a:b], np.array(rows.column(4)[i].as_py(), np.int64).view(np.uint64))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in taken]).astype(np.int64)
            at = np.concatenate(taken)
            whose = [rows.column(k).take(pa.array(row)) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*whose, pa.array(own.seed[at].view(np.int64)), pa.array(own.hash[at].view(np.int64))], names=schema.names)
        pa.default_memory_pool().release_unused()

    return held.select("tid", "text", "id", "n", "marks").mapInArrow(emit, schema)


def _passages(owners: DataFrame, window: int) -> DataFrame:
    """(tid, id, text): the passages of ``owners(tid, id, text, owned)``, runs of windows whose hashes are among those it owns."""
    schema = T.StructType([owners.schema["tid"], owners.schema["id"], field("text", "string")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py().encode()
                own, words = Windows([text], window), text.split()
                at = own.at[np.isin(own.hash, np.array(batch.column(3)[i].as_py(), np.int64).view(np.uint64))]
                runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
                made = [b" ".join(words[r[0] : r[-1] + window]).decode() for r in runs]
                whose = [batch.column(k).take(pa.array([i] * len(made), pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*whose, pa.array(made, pa.string())], names=schema.names)

    return owners.select("tid", "id", "text", "owned").mapInArrow(emit, schema)


class Automaton:
    """The passages of a shard, and where their windows occur in other documents."""

    def __init__(self, window: int) -> None:
        self.window, self.block = window, window // 2
        self.lines: list[str] = []
        self.ids: list = []

    def add(self, line: str, owner_id: object) -> None:
        self.lines.append(line)
        self.ids.append(owner_id)

    def compile(self) -> None:
        self.words = [w for line in self.lines for w in line.split(" ")]
        self.phrases = ahocorasick.Automaton()
        for line in self.lines:
            own = line.split(" ")
            for k in range(0, len(own) - self.block + 1, self.block):
                phrase = f" {' '.join(own[k : k + self.block])} "
                self.phrases.add_word(phrase, len(phrase))
        self.phrases.make_automaton()
        found = Windows(_encoded(self.lines), self.window)
        order = np.argsort(found.hash, kind="stable")
        self.hash, self.at, self.of = found.hash[order], found.at[order], found.of[order]
        self.lines = []

    def spans(self, text: str, id_: object) -> list[tuple[int, int]]:
        """Words, from and to, covered by windows that an owner with a smaller id has."""
        words = [w.decode() for w in text.encode().split()]
        n = len(words) - self.window + 1
        if n <= 0:
            return []
        begin = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        hits = [end - size + 1 for end, size in self.phrases.iter(f" {' '.join(words)} ")]
        if not hits:
            return []
        near = np.zeros(n + 1, np.int64)
        block = np.searchsorted(begin, hits)
        np.add.at(near, np.clip(block + self.block - self.window, 0, n), 1)
        np.add.at(near, np.clip(block + 1, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        own = Windows([text.encode()], self.window).hash[starts]
        k = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        same = self.hash[k] == own
        starts, k = starts[same], k[same]
        smaller = np.array([i is not None and (id_ is None or i < id_) for i in self.ids], bool)
        keep = smaller[self.of[k]]
        starts, place = starts[keep], self.at[k[keep]]
        if not len(starts):
            return []
        edges = [0, *(np.flatnonzero((np.diff(starts) != 1) | (np.diff(place) != 1)) + 1).tolist(), len(starts)]
        out = []
        for a, b in zip(edges, edges[1:]):
            s, p, size = int(starts[a]), int(place[a]), b - a + self.window - 1
            if words[s : s + size] == self.words[p : p + size]:
                out.append((s, s + size))
            else:  # a hash that stands for other words too
                out += [(s + i, s + i + self.window) for i in range(b - a) if words[s + i : s + i + self.window] == self.words[p + i : p + i + self.window]]
        return out


def _located(streams: DataFrame, window: int) -> DataFrame:
    """(tid, begin, end) of spans, from ``streams(shard, copy, kind, tid, id, text)``: each copy's passages (kind 0), then documents."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, automaton, ready = None, None, False
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for i in range(len(batch)):
                shard, copy, kind, tid, id_, text = (batch.column(k)[i].as_py() for k in range(6))
                if here != (shard, copy):
                    here, automaton, ready = (shard, copy), Automaton(window), False
                if kind == 0:
                    automaton.add(text, id_)
                    continue
                if not ready:
                    automaton.compile()
                    ready = True
                found += [(tid, a, b) for a, b in automaton.spans(text, id_)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([to_arrow(list(c), T.LongType()) for c in columns], names=["tid", "begin", "end"])

    return streams.select("shard", "copy", "kind", "tid", "id", "text").mapInArrow(locate, "tid long, begin long, end long")


def _thinned(cut: DataFrame) -> DataFrame:
    """(t1, t2, n_words, n_removed, kept) of ``cut(t1, t2, text, spans)``."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edges[s["begin"]] += 1
                    edges[s["end"]] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                for column, x in zip(out, (len(words), int(gone.sum()), b" ".join(words[i] for i in np.flatnonzero(~gone)).decode())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["t1", "t2", "n_words", "n_removed", "kept"])

    return cut.select("t1", "t2", "text", "spans").mapInArrow(thin, "t1 long, t2 long, n_words long, n_removed long, kept string")


def _cut_texts(texts: DataFrame, window: int) -> DataFrame:
    """(t1, t2, n_words, n_removed, kept) of those ``texts(id, text, t1, t2)`` that lose words, written."""
    with scope() as keep:
        seeds = written(_seeds(texts, window), "seeds")
        one = seeds.select("id", "t1", "t2", F.explode("seeds").alias("seed"))
        again = written(one.groupBy("seed").agg(_recurs().alias("recurs")).where("recurs").select("seed"), "recurring-seeds")
        marks = one.join(small(again), "seed", "left_semi").groupBy("t1", "t2").agg(F.collect_set("seed").alias("marks"))
        marks = written(marks, "marks")
        held = texts.join(small(marks.select("t1", "t2")), ["t1", "t2"], "left_semi").join(marks, ["t1", "t2"])
        held = written(held.withColumns({"tid": F.monotonically_increasing_id(), "n": word_count(joined(F.col("text")))}), "held")

        windows = _windows(held, window)
        owned = windows.groupBy("seed", "w").agg(F.min("id").alias("owner_id"), F.min_by("tid", "id").alias("owner_tid"), _recurs().alias("recurs"))
        owned = written(owned.where("recurs").drop("recurs"), "owned")
        shards = owned.count() // SHARD + 1
        shard = F.pmod(F.xxhash64("owner_tid"), F.lit(shards)).cast("int").alias("shard")
        later = F.col("id").isNull() | (F.col("id") > F.col("owner_id"))
        routes = windows.select("tid", "id", "n", "seed", "w").join(owned, ["seed", "w"]).where(later)
        routes = written(routes.select("tid", "n", shard).distinct(), "routes")
        copies = written(routes.groupBy("shard").agg((F.floor(F.sum("n") / STREAM) + 1).cast("int").alias("copies")), "copies")

        owners = owned.groupBy(F.col("owner_tid").alias("tid")).agg(F.collect_set("w").alias("owned"))
        owners = owners.join(held.select("tid", "id", "text"), "tid")
        passages = _passages(owners, window).withColumn("owner_tid", F.col("tid")).select("tid", "id", "text", shard).join(small(copies), "shard")
        passages = passages.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "tid", "id", "text")
        spread = routes.join(small(copies), "shard").select("tid", "shard", F.pmod(F.xxhash64("tid"), F.col("copies")).cast("int").alias("copy"))
        documents = spread.join(held.select("tid", "id", "text"), "tid").select("shard", "copy", F.lit(1).alias("kind"), "tid", "id", "text")
        streams = passages.union(documents).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
        spans = _located(streams, window).groupBy("tid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        cut = held.select("tid", "t1", "t2", "text").join(spans, "tid")
        return keep(written(_thinned(cut), "cut"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Return id, n_words, n_removed and text (what stays), one row for each row of ``docs``; other columns play no part."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    given = given.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    with scope() as keep:
        repeated = given.groupBy("t1", "t2").agg(F.min("id").alias("low"), _recurs().alias("recurs")).where("recurs").select("t1", "t2", "low")
        repeated = keep(written(repeated, "repeated"))
        copy = F.coalesce(F.col("low").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("low"))), F.lit(False))
        marked = given.join(small(repeated), ["t1", "t2"], "left").withColumn("copy", copy)
        cut = keep(_cut_texts(marked.where("NOT copy").select("id", "text", "t1", "t2"), window))
        cut = keep(written(cut.dropDuplicates(["t1", "t2"]), "once"))
    known = small(cut.select("t1", "t2").withColumn("cut", F.lit(True)))
    judged = marked.join(known, ["t1", "t2"], "left")
    line = joined(F.col("text"))
    whole = judged.where("copy OR cut IS NULL").select("id", "copy", line.alias("line")).withColumn("n_words", word_count(F.col("line")))
    gone = F.col("copy") & (F.col("n_words") >= window)
    whole = whole.select("id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(gone, "").otherwise(F.col("line")).alias("text"))
    thinned = judged.where("NOT copy AND cut").select("id", "t1", "t2").join(cut, ["t1", "t2"]).select("id", "n_words", "n_removed", F.col("kept").alias("text"))
    return whole.union(thinned).withColumnRenamed("id", id_col)
