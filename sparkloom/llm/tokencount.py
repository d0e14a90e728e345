"""Token counts: batches of texts encoded on the executors through Arrow; only the lengths come back.

Empty and null texts have no bytes and no tokens. Repeated rows are counted each for itself. Texts of any length are
counted whole: one above ``split_chars`` is cut where no token of the vocabulary can cross, so the sum of its parts is
the count of the whole. Such places are spaces between two visible ASCII characters and, for SentencePiece models, any
two neighbouring characters that stand side by side in no piece; byte-level and white-space tokenizers files are cut at
spaces. A text without such a place within reach, or a model for which none is sure, is encoded in one call.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import field, map_texts

#: A space between two visible characters. SentencePiece turns it into its word mark, and puts one such mark before
#: every text by itself, so a part that begins after the space is encoded just as it would be within the text.
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?])(?: )(?=[0-9A-Za-z])")
_LOOK = 4096  # characters in which two that no piece joins are looked for


@functools.lru_cache(maxsize=4)
def _sentencepiece(path: str):
    """The model, whether spaces are safe, and a test of whether two neighbouring characters are (None: not sure)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    joined = any(mark in p.lstrip(mark) for p in pieces)
    split = not joined and model.encode("a b", out_type=str) == model.encode("a", out_type=str) + model.encode("b", out_type=str)
    known = {p for i, p in enumerate(pieces) if len(p) == 1 and not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))}
    beside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}

    def apart(a: str, b: str) -> bool:
        plain = a in known and b in known and mark not in (a, b) and not (a.isspace() or b.isspace())
        return plain and a + b not in beside and unicodedata.normalize("NFKC", a + b) == a + b and unicodedata.combining(b) == 0 and model.decode(model.encode(a + b)) == a + b

    return model, split, apart if split else None


@functools.lru_cache(maxsize=4)
def _tokenizers(path: str):
    """The tokenizer, and whether a text may be cut before a space between ASCII letters."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    before, shape = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    kinds = {x["type"]: x for x in before.get("pretokenizers", [before]) if x}
    words = bool(kinds) and set(kinds) <= {"ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
    bytes_ = kinds.get("ByteLevel", {})
    plain = {x["type"] for x in shape.get("normalizers", [shape]) if x} <= {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
    spaced = any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    return tokenizer, words and plain and not spaced and not bytes_.get("add_prefix_space") and bytes_.get("use_regex", True)


def safe_parts(text: str, split_chars: int, apart: Callable[[str, str], bool] | None = None) -> Iterator[tuple[str, str]]:
    """Cut a long text at safe boundaries, each part at least ``split_chars`` long, into (part, what stands before it).

    A space at a boundary is in neither part. Where two characters are cut apart, the part is given the one before it.
    """
    begin, lead = 0, ""
    while len(text) - begin > split_chars:
        at = begin + split_chars
        cut = _SAFE.search(text, at, at + _LOOK) or None
        if cut is not None:
            end, after, next_lead = cut.start(), cut.end(), ""
        else:
            near = range(at, min(at + _LOOK, len(text) - 1))
            end = next((k + 1 for k in near if apart(text[k], text[k + 1])), None) if apart is not None else None
            if end is None:
                cut = _SAFE.search(text, at + _LOOK)
                if cut is None:
                    break
                end, after, next_lead = cut.start(), cut.end(), ""
            else:
                after, next_lead = end, text[end - 1]
        yield text[begin:end], lead
        begin, lead = after, next_lead
    yield text[begin:], lead


def lengths(path: str, texts: list[str], split_chars: int) -> list[int]:
    """Token counts of texts by the library that the model file belongs to."""
    long = max(map(len, texts), default=0) > split_chars
    if not path.endswith(".model"):
        tokenizer, split = _tokenizers(path)
        parts, owner = texts, range(len(texts))
        if split and long:
            cut = [(f" {p}" if k else p, i) for i, t in enumerate(texts) for k, (p, _) in enumerate(safe_parts(t, split_chars))]
            parts, owner = [p for p, _ in cut], [i for _, i in cut]
        counts = [len(x) for x in tokenizer.encode_batch_fast(list(parts), add_special_tokens=False)]
    else:
        model, split, apart = _sentencepiece(path)
        if not (split and long):
            return [len(x) for x in model.encode(texts, num_threads=1)]
        cut = [(lead, p, i) for i, t in enumerate(texts) for p, lead in safe_parts(t, split_chars, apart)]
        owner = [i for _, _, i in cut]
        counts = [len(x) for x in model.encode([lead + p for lead, p, _ in cut], num_threads=1)]
        counts = [n - len(model.encode(lead)) if lead else n for n, (lead, _, _) in zip(counts, cut)]
    return np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64).tolist()


def count_tokens(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 18, split_chars: int = 16_384
) -> DataFrame:
    """Return id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for every row of ``docs``.

    Calls of the encoder are balanced by bytes (about ``batch_bytes`` each), not by rows, so a run of long texts needs
    no more memory than a run of short ones.
    """

    def make():
        def count(texts: list[str | None]) -> dict:
            given = [t or "" for t in texts]
            return {"n_bytes": [len(t.encode()) for t in given], "n_tokens": lengths(model_path, given, split_chars)}

        return count

    counted = map_texts(docs, id_col, text_col, [field("n_bytes", "bigint"), field("n_tokens", "bigint")], make, batch_bytes)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
