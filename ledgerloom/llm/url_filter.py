"""URL filter: a broadcast trie over reversed host labels, then over path segments."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_batches, plain

#: Fixed values: (verdict, host, path) of the rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What a rule takes in a trie besides its text.
RULE_BYTES = 1024

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    for mark in "?#":
        path = path.partition(mark)[0]
    return rest[:cut].translate(_LOWER), path


class UrlTrie:
    """Host labels from the last to the first lead to a node; below it, whole path segments
    lead on, and what is left of a rule's path is kept as a prefix of the next segment. Prefixes
    are looked up by their lengths, so many under one host cost no more than few."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.root: dict = {}
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.setdefault("hosts", {}).setdefault(label, {})
        node = node.setdefault("paths", {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        if rest not in (prefixes := node.setdefault("prefixes", {})):
            prefixes[rest] = (verdict, f"{host}{path}")
            lengths = node.setdefault("lengths", [])
            if len(rest) not in lengths:
                bisect.insort(lengths, len(rest))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; of equally long ones, the first by text."""
        best: tuple[str, str] | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            below = node.get("paths")
            for segment in segments:
                if below is None:
                    break
                for size in below.get("lengths", ()):
                    if size > len(segment):
                        break
                    rule = below["prefixes"].get(segment[:size])
                    if rule is not None and (best is None or (len(rule[1]), best[1]) > (len(best[1]), rule[1])):
                        best = rule
                below = below.get("segments", {}).get(segment)
        return best


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_bytes: int = 256 << 20
) -> DataFrame:
    """A verdict for every url: id, host, path, rule (null without one), verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the
    longest rule wins, whether it allows or blocks; where none fits, ``default`` holds. Only the
    trie reaches the executors. Rules that take more than ``block_bytes``, with ``RULE_BYTES`` for the
    nodes of each, go in blocks, one trie after another over the small (id, host, path) table, and
    the longest match of all wins. Of rules with one host and path the first given holds.

    A null url, or one without ``://``, has empty host and path and gets ``default``; null ids
    and repeated rows stay; an empty table gives none; other columns are not read.
    """
    blocks: list[list[tuple[str, str, str]]] = [[]]
    size = 0
    for rule in rules:
        size += RULE_BYTES + len(rule[1]) + len(rule[2])
        if size > block_bytes and blocks[-1]:
            blocks.append([])
            size = RULE_BYTES + len(rule[1]) + len(rule[2])
        blocks[-1].append(rule)
    text = T.StringType()
    out = plain(pages, id_col, url_col)
    spark = pages.sparkSession

    def judged(df: DataFrame, first: bool, block: list[tuple[str, str, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def make():
            trie = UrlTrie(sent.value)

            def run(batch: pa.RecordBatch) -> list[pa.Array]:
                get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
                if first:
                    parts = [split_url(u) for u in get(url_col)]
                    before = [(default, None)] * len(parts)
                else:
                    parts = list(zip(get("host"), get("path"), strict=True))
                    before = list(zip(get("verdict"), get("rule"), strict=True))
                rows = []
                for (host, path), (verdict, rule) in zip(parts, before, strict=True):
                    hit = trie.match(host, path)
                    if hit is not None and (rule is None or (len(hit[1]), rule) > (len(rule), hit[1])):
                        verdict, rule = hit
                    rows.append((host, path, rule, verdict))
                return [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]

            return run

        return map_batches(df, [field(n, text) for n in ("host", "path", "rule", "verdict")], make, [id_col])

    for i, block in enumerate(blocks):
        out = judged(out, i == 0, block)
    return out
