"""URL filters: allow and block rules, then a weighted vocabulary.

An Aho-Corasick automaton holds all terms. A term counts where it stands alone:
the characters beside it are no ASCII letters or digits. One strict term, or
``soft_needed`` distinct soft terms, reject a url.

Nulls and texts without ``://`` have an empty host and path and are allowed.
Repeated rows are judged one by one; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenvault.llm.common import arrow_map

# Terms that reject a url alone.
STRICT = ("porn", "xxx", "casino", "viagra", "adult", "escort", "spam", "gambling", "betting", "malware", "phishing", "warez")
# Terms that reject a url when several distinct ones occur.
SOFT = ("ads", "track", "tracker", "cheap", "pills", "free", "bets", "bet", "win", "sex", "nude", "hot", "loan", "loans", "slots", "poker", "pharmacy", "discount", "replica", "crack", "torrent", "download", "click", "bonus")
# Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class UrlVocabulary:
    """Terms in lower case and the number of distinct soft terms that reject."""

    strict: Sequence[str] = field(default=STRICT)
    soft: Sequence[str] = field(default=SOFT)
    soft_needed: int = 2

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {*self.strict, *self.soft}:
            found.add_word(term, (len(term), term))
        if len(found):
            found.make_automaton()
        return found


def _alone(url: str, start: int, end: int) -> bool:
    word = lambda c: c.isascii() and c.isalnum()
    return not (start > 0 and word(url[start - 1])) and not (end < len(url) and word(url[end]))


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def term_hits(url: str | None, automaton) -> dict[str, int]:
    """How often each term stands alone in the url."""
    hits: dict[str, int] = {}
    if url and len(automaton):
        url = lower_ascii(url)
        for last, (length, term) in automaton.iter(url):
            if _alone(url, last - length + 1, last + 1):
                hits[term] = hits.get(term, 0) + 1
    return hits


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", vocabulary: UrlVocabulary | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, n_strict, n_soft (hits), n_soft_terms (distinct) for every row."""
    vocabulary = vocabulary or UrlVocabulary()
    source = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    kind = dict(source.dtypes)["_key"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, strict, soft = vocabulary.automaton(), set(vocabulary.strict), set(vocabulary.soft)
        for batch in batches:
            hits = [term_hits(u, automaton) for u in batch.column(1).to_pylist()]
            counts = [
                [sum(n for t, n in h.items() if t in strict) for h in hits],
                [sum(n for t, n in h.items() if t in soft) for h in hits],
                [sum(t in soft for t in h) for h in hits],
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], ["_key", "_url", "n_strict", "n_soft", "n_soft_terms"])

    counted = arrow_map(source, judge, f"_key {kind}, _url string, n_strict long, n_soft long, n_soft_terms long")
    placed = counted.select("*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_terms = F.when((F.col("n_strict") > 0) | (F.col("n_soft_terms") >= vocabulary.soft_needed), "block").otherwise("allow")
    return placed.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "n_strict", "n_soft", "n_soft_terms")
