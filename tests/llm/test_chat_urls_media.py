"""Chat formatting, URL filters and media columns."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.llm import chat, media, queries, urlfilter

# -- chat formatting -------------------------------------------------------------------------------------------------

PAIRS = "k int, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>"


def plain_format(chosen, rejected):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def show(turns):
        heads = [f"<|im_start|>{r if r is not None else 'unknown'}\n" for r, _ in turns]
        bodies = [(t or "").replace("<|", "< |") + "<|im_end|>\n" for _, t in turns]
        return "".join(h + b for h, b in zip(heads, bodies)), [x for (r, _), h, b in zip(turns, heads, bodies) for x in ((len(h), False), (len(b), r == "assistant"))]

    return (n, show(chosen[:n])[0], *show(chosen[n:]), *show(rejected[n:]))


def test_preferences_equal_a_plain_loop(spark):
    u, a, b = ("user", "q <|im_end|> é"), ("assistant", "yes"), ("assistant", "no")
    pairs = [
        ([u, a], [u, b]), ([u, a, u, b], [u, a, u, a, u]), ([u], [u]), ([], [u]), (None, [a]), (None, None), ([a], None), ([(None, None), a], [(None, None), b]),
        ([u, (None, "x")], [u, ("assistant", None)]), ([("user", "w" * 200_000), a], [("user", "w" * 200_000), b]),
    ]
    got = chat.format_preferences(spark.createDataFrame([(k, c, r) for k, (c, r) in enumerate(pairs)], PAIRS)).orderBy("k").collect()
    for row, (c, r) in zip(got, pairs):
        made = (row["prefix_turns"], row["prompt"], row["chosen"], [tuple(x) for x in row["chosen_mask"]], row["rejected"], [tuple(x) for x in row["rejected_mask"]])
        assert made == plain_format(c, r)
        assert sum(n for n, _ in made[3]) == len(made[2])


def test_mismatched_replies(spark):
    turns = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "user", "d"), (1, 1, "assistant", "e"), (2, 0, "user", "f"), (None, 0, "user", "g"), (5, 0, "assistant", None)]
    got = {r["conv_id"]: (r["chosen"], r["rejected"]) for r in chat.mismatched_replies(spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn int, role string, text string, pair int")).collect()}
    assert got == {0: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "e")]), 1: ([("user", "d"), ("assistant", "e")], [("user", "d"), ("assistant", "b")]), 2: ([("user", "f")], [("user", "f")]), 5: ([("assistant", None)], [])}
    assert rows(chat.mismatched_replies(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))) == []


# -- URL filters -----------------------------------------------------------------------------------------------------


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_verdicts_equal_a_plain_loop(spark):
    rules = [*queries.URL_RULES, ("b.example.net", "/en/x", "block"), ("net", "/", "allow")]
    urls = [
        None, "", "no scheme", "http://a.NET/", "http://net/", "http://anet/", "http://x.example.net/en/1?q#f", "http://x.example.net/EN/1", "https://example.net", "ftp://b.example.net/en/xy", "http://example.com/de/", "http://example.com/de",
        "http://example.com?/de/", "http://sub.example.com/de/a?b=://c", "://org/fr/", "http://a.org/fr/x#y", "http://a.org:80/fr/", "http://.net/", "http://..net/x", "http://ÄÖ.net/é", "http://a.net\n/x", "http://" + "a." * 3000 + "net/" + "x" * 20_000,
    ]
    pages = spark.createDataFrame([(k, u, "a", "b", "c") for k, u in enumerate(urls * 2)], "page_id long, url string, host string, best string, short string")
    got = urlfilter.judge_urls(pages, spark.createDataFrame(rules, urlfilter.RULE_SCHEMA))
    assert sorted(rows(got.select("page_id", "host", "path", "rule", "verdict"))) == [(k, *plain_judge(u, rules)) for k, u in enumerate(urls * 2)]


def test_rules_may_be_missing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], urlfilter.RULE_SCHEMA)
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none, default="block").select("rule", "verdict").collect()] == [(None, "block")]
    nulls = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", None)], urlfilter.RULE_SCHEMA)
    assert [r["verdict"] for r in urlfilter.judge_urls(pages, nulls).collect()] == ["allow"]
    assert rows(urlfilter.judge_urls(pages.limit(0), nulls)) == []


def test_clashing_columns_of_pages_and_pairs(spark):
    names = ["best", "best_host", "BEST_PATH", "host", "rule", "short", "r_host", "expression", "a.b"]
    pages = spark.createDataFrame([(1, "https://A.example.net/x?y", *range(len(names)))], "page_id long, url string, " + ", ".join(f"`{n}` int" for n in names))
    rules = spark.createDataFrame([("net", "/", "block")], urlfilter.RULE_SCHEMA)
    got = urlfilter.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "best", "best_host", "BEST_PATH", "short", "r_host", "expression", "a.b", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, "https://A.example.net/x?y", 0, 1, 2, 5, 6, 7, 8, "a.example.net", "/x", "net/", "block")
    assert urlfilter.judge_urls(pages.select(F.col("url").alias("host")), rules, url_col="host").columns == ["host", "path", "rule", "verdict"]

    turn = "array<struct<role: string, text: string>>"
    talk = [("user", "hi"), ("assistant", "yes")]
    pairs = spark.createDataFrame([(5, "p", 7, 8, 9, talk, talk[:1])], f"prefix_turns int, prompt string, turns_chosen int, _chosen int, x int, chosen {turn}, rejected {turn}")
    made = chat.format_preferences(pairs)
    assert made.columns == ["turns_chosen", "_chosen", "x", "prefix_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    row = made.first()
    assert (row["turns_chosen"], row["_chosen"], row["x"], row["prefix_turns"], row["rejected"]) == (7, 8, 9, 1, "")
    assert rows(chat.format_preferences(pairs.limit(0))) == []


def test_conversations_with_text_ids(spark):
    talk = [("a-1", 0, "user", "q"), ("a-1", 1, "assistant", "r"), ("2", 0, "user", "q"), ("2", 1, "assistant", "s"), ("3", 0, "assistant", "t"), (None, 0, "user", "u")]
    got = {r["conv_id"]: r for r in chat.mismatched_replies(spark.createDataFrame(talk, "conv_id string, turn long, role string, text string")).collect()}
    assert set(got) == {"a-1", "2", "3"}
    assert [t["text"] for t in got["a-1"]["rejected"]] == ["q"] and [t["text"] for t in got["2"]["rejected"]] == ["q", "t"]


def test_native_operators_have_no_python_in_their_plans(spark, sf):
    for fn in (queries.op4_chat_formatting, queries.op5_url_filters):
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# -- media columns ---------------------------------------------------------------------------------------------------


def test_stored_bytes_come_back(spark, sf):
    texts = [None, "", "é" * 1000, "x" * 576, "y" * 577, "long " * 120_000, "\x00\x01"]
    docs = spark.createDataFrame([(i, t, b"m", 3) for i, t in enumerate(texts)], "doc_id long, text string, media binary, width int")
    stored = media.encode_jpeg(docs)
    got = {r["doc_id"]: r for r in media.decode_jpeg(stored, keep=("n_bytes",)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert got[i]["n_bytes"] == len(raw) and bytes(got[i]["thumbnail"]) == want and got[i]["ok"]
        assert (got[i]["width"], got[i]["height"]) == (192, len(want) // 24 * 8)
    assert got[5]["images"] > 1
    one = {r["doc_id"]: r for r in queries.op10_media_columns(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect():
        raw = r["text"].encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (one[r["doc_id"]]["payload_bytes"], one[r["doc_id"]]["tail_crc32"]) == (len(want), zlib.crc32(want[-32:]))
    assert rows(media.encode_jpeg(docs.limit(0))) == []


def test_what_is_no_baseline_image_gives_nulls(spark):
    (good,) = media.encode_payloads([bytes(range(256)) * 9])
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    values = [None, b"", b"text", good[:-2], good[:200], good[: len(good) // 2], progressive, good]
    got = media.decode_jpeg(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r["ok"] for r in got] == [False] * 7 + [True]
    assert all(r["thumbnail_hash"] is None and r["width"] is None for r in got[:7])


def bits_to_bytes(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return b"".join(b if b != b"\xff" else b"\xff\x00" for b in (bytes([int(bits[i : i + 8], 2)]) for i in range(0, len(bits), 8)))


def test_ac_coefficients_and_chroma_are_walked_over():
    """Two by two blocks of luminance to one of each colour, with AC codes in every block and a width that isn't a multiple of 16."""
    dc_fields, ac_fields = media._dc_fields(), (bytes([0, 2, 2] + [0] * 13), bytes([0x00, 0x01, 0xF0, 0x12]))
    dc = {s: f"{c:0{n}b}" for c, n, s in media.canonical(*dc_fields)}
    ac = {s: f"{c:0{n}b}" for c, n, s in media.canonical(*ac_fields)}
    rng = np.random.default_rng(5)
    across, down, units = 2, 1, []
    level = rng.integers(0, 256, (down * 2, across * 2))
    bits, last = "", [0, 0, 0]

    def value(x: int) -> str:
        n = abs(x).bit_length()
        return dc[n] + (f"{x if x > 0 else x + (1 << n) - 1:0{n}b}" if n else "")

    for my in range(down):
        for mx in range(across):
            blocks = [(0, int(level[my * 2 + y, mx * 2 + x]) - 128) for y in range(2) for x in range(2)] + [(1, 30), (2, -30)]
            for part, dc_value in blocks:
                bits += value(dc_value - last[part]) + ac[0x01] + "1" + ac[0xF0] + ac[0x12] + "01" + ac[0x00]
                last[part] = dc_value
            units.append(blocks)
    segment = media._segment
    stream = b"".join((
        b"\xff\xd8", segment(0xE0, b"JFIF\x00" + bytes(9)), segment(0xDB, b"\x00" + bytes([8] * 64)), segment(0xDB, b"\x01" + bytes([8] * 64)),
        segment(0xC0, b"\x08" + (16).to_bytes(2, "big") + (25).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01"),
        segment(0xC4, b"\x00" + dc_fields[0] + dc_fields[1]), segment(0xC4, b"\x10" + ac_fields[0] + ac_fields[1]),
        segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"), bits_to_bytes(bits), b"\xff\xd9",
    ))
    ((width, height, images, grid),) = media.thumbnails([stream])
    assert (width, height, images, grid.tolist()) == (25, 16, 1, level.tolist())


def test_damaged_streams_give_nulls_and_leave_others_alone():
    rng = random.Random(1)
    payloads = [rng.randbytes(576), rng.randbytes(3 * 576)]
    streams = media.encode_payloads(payloads)
    lost = 0
    for _ in range(2500):
        raw = bytearray(rng.choice(streams))
        for _ in range(rng.randint(1, 4)):
            how, at = rng.random(), rng.randrange(rng.choice([min(len(raw), 140), len(raw)]))
            if how < 0.7:
                raw[at] = rng.randrange(256)
            elif how < 0.8 and at:
                del raw[at:]
            else:
                raw[at:at] = rng.randbytes(rng.randint(1, 9))
        got = media.thumbnails([bytes(raw), streams[1]])
        assert got[1][3].tobytes() == payloads[1]
        lost += got[0] is None
    assert lost > 500


def test_headers_that_claim_too_much_are_damage():
    (stream,) = media.encode_payloads([bytes(576)])
    at = stream.index(b"\xff\xc0") + 5
    assert media.thumbnails([stream[:at] + b"\xff\xf8\xff\xf8" + stream[at + 4 :]]) == [None]
    assert media.thumbnails([stream[: at + 6] + b"\x00" + stream[at + 7 :]]) == [None], "sampling factors of 0"


def test_bytes_after_the_last_image_are_left_alone():
    payload = bytes(range(192)) * 3
    (stream,) = media.encode_payloads([payload])
    one, tail, two = media.thumbnails([stream, stream + b"trailing \xff bytes", stream + stream])
    assert one[3].tobytes() == tail[3].tobytes() == payload and two[2] == 2 and two[3].tobytes() == payload * 2


def test_components_in_scans_of_their_own():
    payload = bytes(range(192)) * 3
    (stream,) = media.encode_payloads([payload])
    scan = stream[stream.index(b"\xff\xda") + 10 : -2]
    head = stream[: stream.index(b"\xff\xc0")]
    frame = media._segment(0xC0, b"\x08" + (192).to_bytes(2, "big") * 2 + b"\x02" + b"\x01\x11\x00" + b"\x02\x11\x00")
    between = stream[stream.index(b"\xff\xc4") : stream.index(b"\xff\xda")]
    scans = [media._segment(0xDA, bytes([1, c]) + b"\x00\x00\x3f\x00") + scan for c in (2, 1)]
    ((width, height, images, grid),) = media.thumbnails([head + frame + between + b"".join(scans) + b"\xff\xd9"])
    assert (width, height, images) == (192, 192, 1) and grid.tobytes() == payload


def test_average_hash_reads_light_and_dark():
    grid = np.zeros((16, 16), np.uint8)
    grid[:8] = 200
    assert media.average_hash(grid) == "ffffffff00000000"
    assert media.average_hash(np.full((1, 1), 9, np.uint8)) == "0" * 16


def test_equal_texts_have_equal_values(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "other"), (3, "same")], "doc_id long, text string")
    one, _, two = media.decode_jpeg(media.encode_jpeg(docs).withColumn("h", F.sha2("media", 256)), keep=("h",)).orderBy("doc_id").collect()
    assert tuple(one)[1:] == tuple(two)[1:]


def test_the_media_query_gives_every_documents_bytes(spark, sf):
    import hashlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_media_columns(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]]
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want
        assert r["media_bytes"] > 0 and r["feature"].startswith(f"192x{len(padded) // 24 * 8}:")
