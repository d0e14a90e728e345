"""Decoding of mail headers and bodies: small helpers around the standard library, and Arrow functions made of them."""

from __future__ import annotations

import email
import email.header
import email.message
import email.utils

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The longest body that is kept, and the charsets tried where the named one is unknown.
MAX_BODY = 5000
FALLBACKS = ("utf-8", "gbk", "gb2312", "latin-1")


def decode_words(header: str | None) -> str:
    """The text of a header with encoded words; bytes that don't fit their charset are left out."""
    out = []
    for part, charset in email.header.decode_header(header or ""):
        if isinstance(part, bytes):
            try:
                part = part.decode(charset or "utf-8", errors="ignore")
            except LookupError:
                part = part.decode("utf-8", errors="ignore")
        out.append(part)
    return "".join(out)


def iso_date(header: str | None) -> str:
    """An RFC 2822 date as ISO text; what can't be read stays as it is."""
    try:
        return email.utils.parsedate_to_datetime(header).isoformat() if header else ""
    except (ValueError, TypeError, OverflowError):
        return header


def part_text(part: email.message.Message) -> str:
    """The text of one part, cut to the longest that is kept."""
    payload = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", *FALLBACKS):
        try:
            return payload.decode(charset, errors="replace")[:MAX_BODY]
        except LookupError:
            continue
    return ""


def bodies(message: email.message.Message) -> tuple[str, str, int]:
    """(plain text, html, whether there are attachments): the first part of each kind that has text."""
    found = {"text/plain": "", "text/html": ""}
    attached = 0
    for part in message.walk():
        if message.is_multipart() and "attachment" in str(part.get("Content-Disposition", "")):
            attached = 1
        elif not part.is_multipart() and found.get(part.get_content_type()) == "":
            found[part.get_content_type()] = part_text(part)
    return found["text/plain"], found["text/html"], attached


def parse_message(raw: bytes) -> dict:
    message = email.message_from_bytes(raw)
    text, html, attached = bodies(message)
    date = str(message.get("Date", ""))
    return {
        "subject": decode_words(str(message.get("Subject", ""))), "sender": decode_words(str(message.get("From", ""))), "recipients": decode_words(str(message.get("To", ""))),
        "date": date, "date_parsed": iso_date(date), "body_text": text, "body_html": html, "has_attachments": attached,
    }


@F.pandas_udf(T.StringType())
def decode_header(headers: pd.Series) -> pd.Series:
    return headers.map(decode_words)


@F.pandas_udf(T.StringType())
def header_date(headers: pd.Series) -> pd.Series:
    return headers.map(iso_date)
