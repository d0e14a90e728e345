"""Best-fit packing and token counts against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing, tokencount

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b", "</s><s>", "Ünï čødé 中文 😀‍👨", "it's THEY'LL 12345 ²", "a" * 50_000, " " * 200_000, "x. " * 40_000, "▁ ▁", "a\x00b"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [*(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), *ODD]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, uid int, length string")


# -- packing ---------------------------------------------------------------------------------------------------------


def check_packed(got, length):
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


def test_packing_places_every_piece_once(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    got = packing.pack_documents(frame(spark, texts), BYTES).collect()
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in got) == want
    used, total = check_packed(got, 1024), sum(w[3] for w in want)
    assert used <= -(-total // 1024) + max(2, total // 1024 // 50)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.sampled_from([1, 3, 16, 4096]))
def test_plan_is_whole_and_near_the_least(histogram, groups):
    places, sequences = packing.plan(histogram, 64, groups)
    ranks, fill = defaultdict(set), Counter()
    spans = defaultdict(list)
    for n, rank, many, first, offset in places:
        for k in range(many):
            assert rank + k not in ranks[n]
            ranks[n].add(rank + k)
            fill[first + k] += n
            spans[first + k].append((offset, n))
    assert {n: set(range(c)) for n, c in histogram.items()} == dict(ranks)
    for own in spans.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    assert max(fill.values(), default=0) <= 64 and len(fill) == sequences
    least = -(-sum(n * c for n, c in histogram.items()) // 64)
    halves = sum(c for n, c in histogram.items() if n > 32)
    if groups == 4096:  # with few groups, rounding up costs room
        assert sequences <= 1.7 * max(least, halves) + 1


def test_packing_of_odd_tables(spark):
    assert rows(packing.pack_documents(frame(spark, []), BYTES)) == []
    same = packing.pack_documents(frame(spark, ["one two"] * 700), BYTES, length=8, groups=4).collect()
    assert len(same) == 700 and check_packed(same, 8) == 350


def test_every_rank_of_a_hot_length_is_given_once(spark):
    from sparkloom.session import written

    pieces = spark.range(5000).repartition(7).selectExpr("id AS piece", "CASE WHEN id % 3 = 0 THEN 10L ELSE id % 40 + 1 END AS length")
    numbered = written(packing.numbered(pieces, 40), "numbered")
    got = packing.pack(numbered, length=40)
    assert got.columns == ["piece", "length", "sequence_id", "offset"]
    spans = defaultdict(list)
    for r in got.collect():
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, spans.values())) == 5000
    for own in spans.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 40


# -- token counts ----------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows(tokencount.count_tokens(frame(spark, texts), PIECES, split_chars=500))
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)]
    assert [r[:3] for r in sorted(got)] == want
    assert all(over == (n > 4096) for _, _, n, over in got)


def test_counts_by_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    got = sorted(rows(tokencount.count_tokens(frame(spark, ODD), BYTES, limit=10)))
    assert [(r[2], r[3]) for r in got] == [(n, n > 10) for n in (len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in ODD)]
    assert rows(tokencount.count_tokens(frame(spark, []), PIECES)) == []


def test_safe_parts_join_to_the_whole():
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", ".", "é", "▁"]) for _ in range(5000))
    parts = [p for p, _ in tokencount.safe_parts(text, 50)]
    assert len(parts) > 5 and " ".join(parts) == text
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_long_texts_of_any_script_are_counted_as_the_library_does(path):
    rng = random.Random(9)
    chars = {
        "cjk": "的一是不了人我在有他这中大来上个国到说们", "kana": "あいうえおかきくけこがぎぐアイウﾊﾞ゙", "hangul": "가나다라한국어\u1112\u1161\u11ab", "thai": "กขคงจกิ่ำ", "marks": "ae\u0301o\u0308éﬁ①Ａ",
        "mixed": "ab的 é.▁\u200b\n\t😀👍🏽c1", "odd": "\U0001f9ff\u0e01\ue000xyz",
    }
    texts = ["".join(rng.choices(c, k=3000)) for c in chars.values()] + ["a" * 5000, "word " * 900, "no-space." * 700, "x  y " * 900, " <unk> </s> <s> " * 300]
    cut = [len(list(tokencount.safe_parts(t, 100, tokencount._sentencepiece(PIECES)[2]))) for t in texts]
    assert cut[0] > 20, "a text without spaces is cut"
    if path == PIECES:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokencount.lengths(path, texts, 100) == want
