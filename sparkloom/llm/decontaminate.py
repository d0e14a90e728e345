"""Benchmark decontamination by greedy string tiling.

Words as in ``words``. Seeds are runs of ``seed_words`` words that a document and a benchmark item share. For each pair
that its seeds alone could carry over the threshold, tiles are laid greedily: the longest match of words not yet used on
either side first, found by running Karp-Rabin with falling window lengths, so passages are found in whatever order they
stand. A pair is reported if tiles of at least ``seed_words`` words cover ``coverage`` of the item's words. Sentences
shorter than a seed can't be tiles of their own, so a passage whose sentences stand in another order falls short of
whole coverage; the default threshold allows for that. An item of fewer than ``seed_words`` words is found where it is a
whole line of a document.

Items of the same words are one: a pair is a row of ``docs`` and such a class of items, named by its smallest id, with
the number of its items (``item_classes`` says which). Items without a word, and null or empty texts, are never matched.
Repeated rows of documents give a row each.

The benchmark is the query set: it is split into blocks of no more than ``block_chars`` characters (or one item), each
block is broadcast and documents are scanned against it. Where there are several blocks, documents are first scanned once
against a Bloom filter of all seeds (64 bits for each seed, 64 MB at most), and the blocks see only what passes (whole lines are in the filter too, for items shorter than a seed). A seed that many
documents hold costs nothing beyond those documents, and a seed that many items hold is compared once for each document.
Documents are never shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import bloom
from sparkloom.llm import words as W
from sparkloom.llm._common import empty, field, map_texts, scope, small, written
from sparkloom.session import gathered


def _windows(tokens: list, used: list[bool], size: int) -> list[tuple[int, int]]:
    """(begin, Karp-Rabin hash) of all windows of ``size`` unused tokens; None ends a stretch like a used token does."""
    prime, base = (1 << 61) - 1, 1_000_003
    drop = pow(base, size, prime)
    out, run, value = [], 0, 0
    for i, token in enumerate(tokens):
        if token is None or used[i]:
            run = value = 0
            continue
        value = (value * base + token) % prime
        run += 1
        if run > size:
            value = (value - tokens[i - size] * drop) % prime
        if run >= size:
            out.append((i - size + 1, value))
    return out


def tile(pattern: list[int], text: list[int | None], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern place, text place, length) of tiles of at least ``least`` tokens.

    None in ``text`` matches nothing. Of equally long matches, the one that begins first in the pattern, then in the
    text, is laid first.
    """
    used_p, used_t = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(pattern))
    while True:
        places = defaultdict(list)
        for p, value in _windows(pattern, used_p, size):
            places[value].append(p)
        found = []
        for t, value in _windows(text, used_t, size) if places else ():
            for p in places.get(value, ()):
                if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue  # part of the match that begins earlier
                n = 0
                while p + n < len(pattern) and t + n < len(text) and not used_p[p + n] and not used_t[t + n] and pattern[p + n] == text[t + n]:
                    n += 1
                if n >= size:
                    found.append((-n, p, t))
        heapq.heapify(found)
        while found:
            n, p, t = heapq.heappop(found)
            free, runs = 0, []  # what earlier tiles have left of this match
            for k in range(-n + 1):
                if k < -n and not used_p[p + k] and not used_t[t + k]:
                    free += 1
                elif free:
                    runs.append((k - free, free))
                    free = 0
            if runs == [(0, -n)]:
                tiles.append((p, t, -n))
                used_p[p : p - n] = used_t[t : t - n] = [True] * -n
            else:  # a rest takes its turn by its own length
                for k, length in runs:
                    if length >= size:
                        heapq.heappush(found, (-length, p + k, t + k))
        if size == least or not any(not u for u in used_p):
            return tiles
        size = max(least, size // 2)


class Block:
    """A block of benchmark items, with its seeds."""

    def __init__(self, ids: list, copies: list[int], texts: list[str | None], seed_words: int) -> None:
        self.ids, self.copies, self.seed_words = ids, copies, seed_words
        own = W.split(texts)
        cuts = np.searchsorted(own.text, np.arange(len(texts) + 1))
        self.words = [[own.bytes(k) for k in range(a, b)] for a, b in zip(cuts, cuts[1:])]
        self.length = np.diff(cuts)
        self.short = defaultdict(list)  # items that are shorter than a seed, by their words
        for i in np.flatnonzero((self.length > 0) & (self.length < seed_words)).tolist():
            self.short[tuple(self.words[i])].append(i)
        at, hashes = W.grams(own.hash, own.text, seed_words)
        self.seeds = W.HashSet(hashes)
        place = np.searchsorted(self.seeds.sorted, hashes)
        order = np.argsort(place, kind="stable")
        self.first = np.searchsorted(place[order], np.arange(len(self.seeds.sorted) + 1))
        self.item = own.text[at][order]
        self.pos = at[order] - cuts[self.item]
        held = np.unique(own.text[at] * max(1, len(self.seeds.sorted)) + place)
        self.held = held % max(1, len(self.seeds.sorted))  # the distinct seeds of each item, one item after another
        self.held_cuts = np.searchsorted(held // max(1, len(self.seeds.sorted)), np.arange(len(texts) + 1))

    def match(self, texts: list[str | None], coverage: float) -> dict:
        out = defaultdict(list)
        n = self.seed_words
        docs = W.split(texts)
        at, hashes = W.grams(docs.hash, docs.text, n)
        hit, seed = self.seeds.find(hashes)
        at = at[hit]
        if len(at):
            # Distinct seeds of each document, and where in which items they stand: what the seeds cover bounds the tiles.
            pair = np.unique(docs.text[at] * len(self.seeds.sorted) + seed)
            doc, own = np.divmod(pair, len(self.seeds.sorted))
            times = self.first[own + 1] - self.first[own]
            k = np.repeat(self.first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
            wide = int(self.length.max()) + 1
            key = np.sort((np.repeat(doc, times) * len(self.ids) + self.item[k]) * wide + self.pos[k])
            group, pos = np.divmod(key, wide)
            last = np.append(group[1:] != group[:-1], True)
            step = np.where(last, n, np.minimum(n, np.append(pos[1:], 0) - pos))
            ends = np.flatnonzero(last)
            covered = np.add.reduceat(step, np.concatenate(([0], ends[:-1] + 1)))
            for g in group[ends][covered >= coverage * self.length[group[ends] % len(self.ids)]].tolist():
                d, item = divmod(g, len(self.ids))
                a, b = np.searchsorted(docs.text[at], [d, d + 1])
                starts = at[a:b][np.isin(seed[a:b], self.held[self.held_cuts[item] : self.held_cuts[item + 1]])]
                self._lay(docs, int(np.searchsorted(docs.text, d)), starts, d, item, coverage, out)
        if self.short:
            self._lines(texts, docs, out)
        return {name: out[name] for name in ("row", "item", "item_words", "matched_words", "longest_tile", "tiles")}

    def _lay(self, docs: W.Words, first: int, starts: np.ndarray, doc: int, item: int, coverage: float, out: dict) -> None:
        places = np.unique((starts[:, None] + np.arange(self.seed_words)).ravel())
        number = {}
        pattern = [number.setdefault(w, len(number) + 1) for w in self.words[item]]
        text, where, before = [], [], None
        for k in places.tolist():
            if before is not None and k != before + 1:
                text.append(None)
                where.append(-1)
            text.append(number.get(docs.bytes(k)))
            where.append(k - first)
            before = k
        tiles = tile(pattern, text, self.seed_words)
        matched = sum(t[2] for t in tiles)
        if matched and matched >= coverage * len(pattern):
            self._found(out, doc, item, max(t[2] for t in tiles), matched, [v for p, t, n in tiles for v in (where[t], p, n)])

    def _lines(self, texts: list[str | None], docs: W.Words, out: dict) -> None:
        """Items shorter than a seed: the first line of each document that has just their words."""
        owner, lines = [], []
        for i, t in enumerate(texts):
            own = (t or "").split("\n")
            owner += [i] * len(own)
            lines += own
        split = W.split(lines)
        count = np.bincount(split.text, minlength=len(lines))
        begin = np.cumsum(count) - count
        seen = set()
        for k in np.flatnonzero((count > 0) & (count < self.seed_words)).tolist():
            for item in self.short.get(tuple(split.bytes(w) for w in range(begin[k], begin[k] + count[k])), ()):
                if (owner[k], item) not in seen:
                    seen.add((owner[k], item))
                    n = int(count[k])
                    self._found(out, owner[k], item, n, n, [int(begin[k]) - int(np.searchsorted(docs.text, owner[k])), 0, n])

    def _found(self, out: dict, doc: int, item: int, longest: int, matched: int, tiles: list[int]) -> None:
        values = {"row": doc, "item": item, "item_words": int(self.length[item]), "matched_words": matched, "longest_tile": longest, "tiles": tiles}
        for name, value in values.items():
            out[name].append(value)


def item_classes(benchmark: DataFrame, *, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, class_hash): items of the same words have the same hash; items without a word have none (null)."""

    def make():
        def classes(texts: list[str | None]) -> dict:
            own = W.split(texts)
            cuts = np.searchsorted(own.text, np.arange(len(texts) + 1))
            return {"class_hash": [xxhash.xxh3_128_digest(b" ".join(own.bytes(k) for k in range(a, b))) if a < b else None for a, b in zip(cuts, cuts[1:])]}

        return classes

    return map_texts(benchmark, item_id_col, item_text_col, [field("class_hash", "binary")], make, carry=[item_text_col])


_PROBES = 4


def _bits(seeds: np.ndarray, bits: int) -> np.ndarray:
    """The places of seeds in a Bloom filter of 2 ** bits bits, a row for each probe."""
    more = W.mix(seeds ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.stack([(x >> np.uint64(s)) & np.uint64((1 << bits) - 1) for x in (seeds, more) for s in (0, 32)])


def _keys(texts: list[str | None], seed_words: int, lines: bool, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all seeds and, if ``short``, of whole lines that are shorter than one; without ``lines`` a text is one line."""
    own = W.split(texts)
    at, hashes = W.grams(own.hash, own.text, seed_words)
    owners, found = [own.text[at]], [hashes]
    if short:
        parts = [(t or "").split("\n") if lines else [t] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        own = W.split([x for p in parts for x in p])
        count = np.bincount(own.text, minlength=len(owner))
        for n in range(1, seed_words):
            at, hashes = W.grams(own.hash, own.text, n)
            whole = count[own.text[at]] == n
            owners.append(owner[own.text[at[whole]]])
            found.append(W.mix(hashes[whole] + np.uint64(n)))
    return np.concatenate(owners), np.concatenate(found)


def _bloom(classes: DataFrame, seed_words: int) -> np.ndarray:
    """A Bloom filter of the seeds of all items, and of whole items that are shorter."""
    keys = lambda texts: _keys(texts, seed_words, False, True)[1]
    counted = map_texts(classes, "id", "text", [field("n", "bigint")], lambda: lambda texts: {"row": [0], "n": [len(keys(texts))]} if texts else {"row": [], "n": []})
    bits = bloom.size(counted.agg(F.sum("n")).first()[0] or 0, 29)

    def places(texts: list[str | None]) -> dict:
        at = np.unique(_bits(keys(texts), bits).ravel())
        return {"row": np.zeros(len(at), np.int64), "place": at.astype(np.int64)}

    return bloom.packed(map_texts(classes, "id", "text", [field("place", "bigint")], lambda: places), bits)


def _candidates(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, seed_words: int) -> DataFrame:
    """The rows of ``docs`` that may hold a seed of any item, or a line that is a short one: (id, text)."""
    short = not classes.where(F.col("words") < seed_words).isEmpty()
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(classes, seed_words))

    def make():
        words = sent.value
        bits = int(len(words)).bit_length() - 1 + 6

        def passing(texts: list[str | None]) -> dict:
            owner, hashes = _keys(texts, seed_words, True, short)
            hit = np.ones(len(hashes), bool)
            for place in _bits(hashes, bits):
                left = np.flatnonzero(hit)
                place = place[left]
                hit[left] = (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            rows = np.unique(owner[hit])
            return {"row": rows, text_col: [texts[i] for i in rows.tolist()]}

        return passing

    return map_texts(docs, id_col, text_col, [field(text_col, "string")], make)


def _blocks(classes: DataFrame, block_chars: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """(ids, numbers of items, texts) of classes, a block at a time; the driver holds one partition and one block."""
    held: tuple[list, list[int], list[str]] = ([], [], [])
    chars = 0
    for r in classes.select("id", "n_items", "text").toLocalIterator():
        if held[0] and chars + len(r["text"]) > block_chars:
            yield held
            held, chars = ([], [], []), 0
        for values, value in zip(held, r):
            values.append(value)
        chars += len(r["text"])
    if held[0]:
        yield held


def _classes(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """(id, words, text, n_items) for each class of items, written."""
    named = item_classes(benchmark, item_id_col=item_id_col, item_text_col=item_text_col).toDF("id", "class_hash", "text").where("class_hash IS NOT NULL")
    classes = named.groupBy("class_hash").agg(F.min("id").alias("id"), F.count("*").alias("n_items"), F.min("text").alias("text"))
    count = lambda texts: {"words": np.bincount(W.split(texts).text, minlength=len(texts)).astype(np.int32)}
    return written(map_texts(classes, "id", "text", [field("words", "int")], lambda: count, carry=["text", "n_items"]).orderBy("id"), "items")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    seed_words: int = 5, coverage: float = 0.6, block_chars: int = 4_000_000,
) -> DataFrame:
    """Return id, item_id, n_items, item_words, matched_words, coverage, longest_tile and tiles for every pair that is a leak.

    ``tiles`` has three numbers for each tile: its first word in the document, its first word in the item, its length.
    """
    spark = docs.sparkSession
    classes = _classes(benchmark, item_id_col, item_text_col)
    id_type = benchmark.schema[item_id_col].dataType
    arrow_type = empty(spark, T.StructType([T.StructField("id", id_type)])).toArrow().schema.field(0).type
    fields = [T.StructField("item_id", id_type), field("n_items", "bigint"), field("item_words", "int"), field("matched_words", "int"), field("longest_tile", "int"), field("tiles", "array<int>")]
    chars = classes.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = docs if chars <= block_chars else written(_candidates(docs, classes, id_col, text_col, seed_words), "candidates")

    def scan(given: tuple[list, list[int], list[str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(given)

        def make():
            block = Block(*sent.value, seed_words)
            ids, copies = pa.array(block.ids, arrow_type), pa.array(block.copies, pa.int64())

            def match(texts: list[str | None]) -> dict:
                columns = block.match(texts, coverage)
                at = pa.array(columns["item"], pa.int64())
                return columns | {"item_id": ids.take(at), "n_items": copies.take(at)}

            return match

        return map_texts(rows, id_col, text_col, fields, make)

    parts, last = [], ([], [], [])
    for block in _blocks(classes, block_chars):
        if last[0]:  # written, so that no plan and no task holds several blocks
            parts.append(written(scan(last), "leaks"))
        last = block
    found = reduce(DataFrame.union, [*parts, scan(last)])
    return found.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", seed_words: int = 5, coverage: float = 0.6, block_chars: int = 4_000_000
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item: by their texts, so ids don't matter.

    One block is one pass. Several are a pass through the filter, matches of every distinct text that is left with each
    block, and a pass that leaves out rows whose texts (two 64-bit hashes) were found.
    """
    spark = docs.sparkSession
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text_at = f"c{docs.columns.index(text_col)}"

    def matched(rows: DataFrame, key: str, text: str, given: tuple[list, list[int], list[str]], leaks: bool) -> DataFrame:
        """The rows that hold an item of the block, or those that hold none."""
        sent = spark.sparkContext.broadcast(given)

        def make():
            block = Block(*sent.value, seed_words)

            def chosen(texts: list[str | None]) -> dict:
                found = np.zeros(len(texts), bool)
                found[block.match(texts, coverage)["row"]] = True
                return {"row": np.flatnonzero(found == leaks)}

            return chosen

        return map_texts(rows, key, text, [], make, carry=[] if leaks else [c for c in rows.columns if c != key]).select(*([key] if leaks else rows.columns))

    with scope() as keep:
        classes = _classes(benchmark, item_id_col, item_text_col)
        chars = classes.agg(F.sum(F.length("text"))).first()[0]
        if chars is None:
            return docs
        if chars <= block_chars:
            first = next((c for c in plain.columns if c != text_at), text_at)
            return matched(plain, first, text_at, next(_blocks(classes, block_chars)), False).toDF(*docs.columns)
        text = F.col(text_at).cast("string")
        keyed = plain.withColumn("key", F.struct(F.xxhash64(text).alias("low"), F.xxhash64(F.lit(1), text).alias("high")))
        passed = _candidates(keyed.select("key", text.alias("text")), classes, "key", "text", seed_words)
        passed = written(passed.groupBy("key").agg(F.first("text").alias("text")), "candidates")
        found = [written(matched(passed, "key", "text", block, True), "leaks") for block in _blocks(classes, block_chars)]
        leaks = keep(written(gathered(found).distinct(), "leaks"))
        return keyed.join(small(leaks), "key", "left_anti").drop("key").toDF(*docs.columns)
