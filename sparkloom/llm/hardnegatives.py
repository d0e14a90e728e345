"""Hard-negative mining by product quantisation with rigorous bounds.

Vectors are integers, ``floor(scale * x)``; a row's score is its inner product with an anchor, higher ones first, ties by
the smaller id. An anchor's positives are its first ``positives`` other rows of the same label; for each of them, its
negatives are the first ``negatives`` rows of other labels whose score is at least ``low`` and at most ``high`` hundredths
of the positive's.

Each vector is cut into pieces of ``PIECE`` components. A codebook of at most ``CODES`` integer points for each piece is
trained on at most ``sample`` vectors (those whose hash is smallest); all vectors are encoded, and the norm of what the
code leaves over of each piece is stored beside it. For an anchor, tables of its products with the codebooks give a score
by lookups, and its true score differs from that by no more than the sum of the norms' products (Cauchy-Schwarz, for each
piece). So rows whose upper bound lies below what has been found, or whose bounds miss the window, can't matter; all
others are scored exactly, in integers. The codebooks decide how much is scored exactly, never what is found.

Anchors are the queries: they are taken in blocks of about ``BLOCK``, each broadcast, and the rows, which aren't shuffled,
are scanned once for positives and once for negatives; a task hands on its own best rows of each window only, so a
frequent label or vector makes no group larger.

Rows with a null id or label, a null vector, or a component that is null or not finite take no part. Vectors of unlike
lengths: a component that is missing counts as zero. Rows that repeat an id are rows of their own. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import remove, scope, small_batches, written
from sparkloom.llm.vectors import finite, integers, matrix, products
from sparkloom.session import gathered

PIECE, CODES = 4, 256
BLOCK = 16_384  # anchors of a block, about
ROWS, ANCHORS = 512, 1024  # scored together


def _means(points: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A codebook: integer points that k-means finds from the points themselves."""
    unique = np.unique(points, axis=0)
    book = unique[np.linspace(0, len(unique) - 1, min(CODES, len(unique))).astype(np.int64)]
    for _ in range(rounds):
        own = _codes(points, book)
        counts = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        book = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)
    return book


def _codes(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * products(points, book)).argmin(axis=1)


def codebooks(rows: DataFrame, dim: int, sample: int) -> list[np.ndarray]:
    """One for each piece, trained in a task of its own on the same sample of ``rows(v)``."""
    taken = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    points = np.zeros((len(taken), dim), np.int64)
    for i, r in enumerate(taken):
        points[i, : len(r["v"])] = r["v"]
    sent = rows.sparkSession.sparkContext.broadcast(points)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0).to_pylist():
                book = _means(sent.value[:, m * PIECE : (m + 1) * PIECE])
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([book.tolist()], pa.list_(pa.list_(pa.int64())))], names=["m", "book"])

    n = -(-dim // PIECE)
    made = {r["m"]: np.array(r["book"], np.int64) for r in rows.sparkSession.range(0, n, 1, n).mapInArrow(train, "m long, book array<array<long>>").collect()}
    sent.destroy()
    return [made[m] for m in range(n)]


def encoded(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """``rows(id, label, anchor, v)`` with the codes and the norms of the rests (single precision, rounded up), each as bytes; ``v`` too."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(3), dim)
            codes, rests = np.zeros((len(v), len(books)), np.uint8), np.zeros((len(v), len(books)), np.float32)
            for m, book in enumerate(books):
                own = v[:, m * PIECE : (m + 1) * PIECE]
                codes[:, m] = _codes(own, book)
                norm = np.sqrt(((own - book[codes[:, m]]) ** 2).sum(axis=1).astype(np.float64))
                rests[:, m] = np.where(norm > 0, np.nextafter(norm.astype(np.float32), np.float32(np.inf)), 0)
            packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (v.astype("<i4"), codes, rests)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], names=["id", "label", "anchor", "v", "codes", "rests"])

    return rows.select("id", "label", "anchor", "v").mapInArrow(encode, "id long, label long, anchor boolean, v binary, codes binary, rests binary")


class Best:
    """The first ``k`` entries (score falling, id rising) of each of ``n`` windows, fed a part at a time."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, np.iinfo(np.int64).min)  # what a score must reach to matter

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(window):
            return
        window, score, id_ = np.concatenate([self.window, window]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, window))
        window, score, id_ = window[order], score[order], id_[order]
        first = np.searchsorted(window, window)
        place = np.arange(len(window)) - first
        self.window, self.score, self.id = (x[place < self.k] for x in (window, score, id_))
        last = place == self.k - 1
        self.floor[window[last]] = score[last]


class Anchors:
    """A block of anchors with the lookup tables for their scores."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, v: np.ndarray, books: list[np.ndarray]) -> None:
        self.ids, self.uids, self.labels, self.v, self.books = ids, uids, labels, v, books
        self.norms = np.stack([np.sqrt((v[:, m * PIECE : (m + 1) * PIECE] ** 2).sum(axis=1)) for m in range(len(books))], axis=1)

    def tables(self, part: np.ndarray) -> list[np.ndarray]:
        return [products(book, self.v[part, m * PIECE : (m + 1) * PIECE]) for m, book in enumerate(self.books)]


def bounds(tables: list[np.ndarray], norms: np.ndarray, codes: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of rows (down) for anchors (across): looked up, give or take the rests."""
    score = np.zeros((len(codes), len(norms)), np.int64)
    for m, table in enumerate(tables):
        score += table[codes[:, m]]
    # The slack covers the rounding of norms and products.
    off = np.ceil((rests.astype(np.float64) @ norms.T) * (1 + 1e-9)).astype(np.int64) + 1
    return score - off, score + off


def _exact(v: np.ndarray, anchors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Scores of pairs, in integers: all of them at once where a good part is asked for."""
    if 8 * len(row) > len(v) * len(anchors):
        return products(v, anchors)[row, anchor]
    out = np.zeros(len(row), np.int64)
    for k in range(0, len(row), 1 << 16):
        part = slice(k, k + (1 << 16))
        out[part] = (v[row[part]] * anchors[anchor[part]]).sum(axis=1)
    return out


def _scan(rows: DataFrame, block: object, dim: int, positives: int, windows: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """Each task's best rows (window, id, score) for a broadcast block of anchors.

    Without ``windows`` there is one for each anchor, with the rows of its label; else ``positives`` for each, with the
    rows of other labels whose score lies from ``windows[0]`` to ``windows[1]``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Anchors = block.value
        of_label = {x: np.flatnonzero(held.labels == x) for x in np.unique(held.labels).tolist()}
        parts = list(of_label.values()) if windows is None else [np.arange(len(held.ids))]
        parts = [p[a : a + ANCHORS] for p in parts for a in range(0, len(p), ANCHORS)]
        made = [(p, held.tables(p)) for p in parts]
        best = Best(len(held.ids) * (1 if windows is None else positives), k)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                b = batch.slice(begin, ROWS)
                id_, label, uid = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                v, codes, rests = (np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(len(b), -1) for i, kind in ((3, "<i4"), (4, np.uint8), (5, np.float32)))
                v = v.astype(np.int64)
                for part, tables in made:
                    if windows is None:  # a part has one label
                        at = np.flatnonzero(label == held.labels[part[0]])
                        if not len(at):
                            continue
                        _, high = bounds(tables, held.norms[part], codes[at], rests[at])
                        row, anchor = np.nonzero(high >= best.floor[part])
                        other = uid[at[row]] != held.uids[part[anchor]]
                        row, anchor = at[row[other]], anchor[other]
                        best.add(part[anchor], _exact(v, held.v[part], row, anchor), id_[row])
                        continue
                    low, high = bounds(tables, held.norms[part], codes, rests)
                    may = label[:, None] != held.labels[part]
                    window = part[:, None] * positives + np.arange(positives)
                    least, most = np.maximum(windows[0][window], best.floor[window]), windows[1][window]
                    asked = windows[0][window] <= most  # windows that aren't empty
                    none, all_ = np.iinfo(np.int64).max, np.iinfo(np.int64).min
                    may &= (high >= np.where(asked, least, none).min(axis=1)) & (low <= np.where(asked, most, all_).max(axis=1))
                    row, anchor = np.nonzero(may)
                    score = _exact(v, held.v[part], row, anchor)
                    for j in range(positives):
                        inside = (score >= least[anchor, j]) & (score <= most[anchor, j])
                        best.add(window[anchor[inside], j], score[inside], id_[row[inside]])
        yield pa.RecordBatch.from_arrays([pa.array(best.window), pa.array(best.id), pa.array(best.score)], names=["window", "id", "score"])

    return rows.select("id", "label", "uid", "v", "codes", "rests").mapInArrow(scan, "window long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window, of what the tasks have found, with their ``place`` from 1."""
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", anchor: Column | None = None,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, sample: int = 8192,
) -> DataFrame:
    """Return anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``anchor`` says which rows of ``vectors`` are anchors (all, if None); ``label`` is a column or an expression. Other
    columns play no part, whatever they are called. A positive score of zero or less has a window of 0 or none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = vectors[f"`{label}`"] if isinstance(label, str) else label
    chosen = F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))
    given = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), label.cast("long").alias("label"), vectors[f"`{vector_col}`"].alias("v"), chosen.alias("anchor"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    whole = given.select("id", "label", integers(F.col("v"), scale).alias("v"), "anchor")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim, n_anchors = whole.agg(F.max(F.size("v")), F.count_if("anchor")).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    dim, n_blocks = max(dim, 1), -(-n_anchors // BLOCK)
    with scope() as keep:
        books = codebooks(whole, dim, sample)
        rows = written(encoded(whole, books, dim).withColumn("uid", F.monotonically_increasing_id()), "codes")
        anchors = rows.where("anchor").select("id", "uid", "label", "v")
        block_of = F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")
        blocks = written(anchors.select("*", block_of).repartition(min(n_blocks, 200), "block").sortWithinPartitions("block"), "anchors")
        made = []
        for k in range(n_blocks):
            own = blocks.where(F.col("block") == k).toPandas()
            if len(own):
                v = np.frombuffer(b"".join(own["v"]), "<i4").reshape(len(own), -1).astype(np.int64)
                made.append(keep(_of_block(rows, Anchors(*(own[c].to_numpy(np.int64) for c in ("id", "uid", "label")), v, books), dim, positives, negatives, low, high)))
        remove(blocks)
        return gathered(made)


def _of_block(rows: DataFrame, block: Anchors, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)
    pos = _first(_scan(rows, sent, dim, positives, None, positives), positives).toPandas()
    place = pos["window"].to_numpy(np.int64) * positives + pos["place"].to_numpy(np.int64) - 1
    score, ids = np.zeros(len(block.ids) * positives, np.int64), np.zeros(len(block.ids) * positives, np.int64)
    score[place], ids[place] = pos["score"], pos["id"]
    least, most = np.ones_like(score), np.zeros_like(score)  # no positive, no window
    least[place], most[place] = -(-low * score[place] // 100), high * score[place] // 100
    found = _first(_scan(rows, sent, dim, positives, (least, most), negatives), negatives)
    known = spark.createDataFrame(pa.table({"window": place, "anchor_id": block.ids[place // positives], "positive_id": ids[place], "positive_score": score[place]}))
    made = found.join(F.broadcast(known), "window")  # no more than a block's anchors times their positives
    columns = ["anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    made = written(made.select(*columns), "negatives")
    sent.destroy()
    return made
