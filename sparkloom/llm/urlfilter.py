"""URL filters: host-suffix and path-prefix expressions joined to rules on short hashes. DataFrame functions only.

A url's host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path from there to
``?``, ``#`` or the end. A null url, or one without ``://``, has neither. A rule is a host and a path; it fits the host
itself and all of its subdomains, where the path begins with the rule's. Of several rules that fit, the longest (host
and path together) decides, then the longer host, then ``block``; rules given twice count once. Without a fitting rule
the verdict is ``default``. Every row keeps its own verdict, repeated rows too; empty tables of rules or pages are
allowed, and other columns may have any names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULE_SCHEMA = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; empty strings where there is none."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + F.lit(1), F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, *_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _short(expression: Column) -> Column:
    """The first 32 bits of an expression's hash: the join key."""
    return F.shiftrightunsigned(F.xxhash64(expression), 32)


def _full(expression: Column) -> Column:
    return F.sha2(expression, 256)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that aren't among those taken, whatever their case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages`` (columns of those names give way to them, the url's too).

    Which expressions a url is expanded into follows from the rules: for each (labels of the host, length of the path)
    that occurs among them, the url's last so many labels and first so many characters. Those pairs of small integers
    are the only thing that the driver reads: a host has at most 127 labels, so there are no more than 127 for each
    length that a rule's path has. They go into the plan as one constant. Distinct (host, path) pairs are expanded, not
    rows, so a url that a third of all rows share is judged once; its rows get the verdict by a join whose large side
    adaptive execution can split.
    """
    given = rules.select(F.translate(F.col("host"), *_LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    given = given.dropna().groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    occurring = given.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct()
    shapes = sorted((s["labels"], s["chars"]) for s in occurring.collect())
    expression = F.concat(F.col("r_host"), F.lit("\n"), F.col("r_path"))
    keyed = given.select(_short(expression).alias("short"), _full(expression).alias("r_full"), "r_host", "r_path", "r_verdict")

    host, path = url_parts(F.col(url_col))
    own = [c for c in pages.columns if c == url_col or c.lower() not in ("host", "path", "rule", "verdict")]
    h, p, rh, rp, best_at = fresh(own, "host", "path", "best_host", "best_path", "best")
    parted = pages.select(*[F.col(f"`{c}`") for c in own], host.alias(h), path.alias(p))
    urls = parted.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()

    constant = F.from_json(F.lit(json.dumps([{"labels": n, "chars": c} for n, c in shapes])), "array<struct<labels: int, chars: int>>")
    fits = F.filter(constant, lambda s: (F.size(F.split("host", r"\.")) >= s["labels"]) & (F.length("path") >= s["chars"]))
    made = F.transform(fits, lambda s: F.concat(_last_labels(F.col("host"), s["labels"]), F.lit("\n"), F.substring(F.col("path"), F.lit(1), s["chars"])))
    expanded = urls.select("host", "path", F.explode(made).alias("expression")).withColumn("short", _short(F.col("expression")))
    fitting = expanded.join(keyed, "short").where(_full(F.col("expression")) == F.col("r_full"))
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("chars"), F.length("r_host").alias("host_chars"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")
    )
    best = fitting.groupBy(F.col("host").alias(rh), F.col("path").alias(rp)).agg(F.max(order).alias(best_at))
    judged = parted.join(best, (F.col(h) == F.col(rh)) & (F.col(p) == F.col(rp)), "left")
    rest = [F.col(f"`{c}`") for c in own if c.lower() not in ("host", "path", "rule", "verdict")]
    rule, verdict = F.col(f"{best_at}.rule"), F.coalesce(F.col(f"{best_at}.verdict"), F.lit(default))
    return judged.select(*rest, F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def _last_labels(host: Column, labels: Column) -> Column:
    """The last so many labels of a host."""
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")
