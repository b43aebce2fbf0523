"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit per pattern position, and simulated together over
the canonical URL: ``D = ((D << 1 | start) & mask[byte]) | (D & loop)``, where ``loop`` holds the positions of ``*``.
The shift carries from word to word, so any number of rules fits.  A batch of URLs advances one byte at a
time as a matrix, longest URLs first, so the work is the sum of the URLs' lengths and not their maximum.

The canonical URL is ``.host``, the byte 255, and the path; a list rule such as ``com/fr/`` is the glob
``*.com<255>/fr/*``, which fits the host, its subdomains, and paths that start like the rule's.  That byte stands in no
UTF-8 text, so it occurs once, and a wildcard of the host can't end in the path.  A method rule is a glob over the same
string that decides where no list rule fits, and an exception is one that wins over it; ``parse_filters`` reads both from a
filter list and refuses lines that it can't read.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged like any other; a null id
is returned like any other; of several list rules the longest wins, then the first in string order; repeated rows are
judged row by row; very long urls are judged whole; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import workers


@dataclass(frozen=True)
class ListRule:
    rule: str  # host, '/', rest of the path
    verdict: str  # allow or block

    def glob(self) -> str:
        host, slash, path = self.rule.partition("/")
        return f"*.{host}|{slash}{path}*"


#: The list of the contract.  Fixed values.
RULES = (
    ListRule("org/", "allow"),
    ListRule("example.org/es/", "block"),
    ListRule("example.org/en/1", "block"),
    ListRule("com/fr/", "allow"),
    ListRule("com/de/", "block"),
)

#: Globs over host and path, ``|`` between them, that block where no list rule fits.
METHOD_GLOBS = (
    "*.adult-*|*",
    "*.*-adult.*|*",
    "*.porn*|*",
    "*.xxx-*|*",
    "*.casino*|*",
    "*.*-casino.*|*",
    "*.cheap-pills*|*",
    "*.*-pills.*|*",
    "*.viagra*|*",
    "*|*/adult/*",
    "*|*/casino/*",
    "*|*.exe",
    "*|*.zip",
)


#: What parts host and path in the canonical form: no UTF-8 text holds it.
PARTS = b"\xff"
#: Bytes of automaton state that are held for the URLs of a slice.
STATE_BYTES = 32 << 20


class ListError(ValueError):
    """A line of a filter list that can't be read, or asks for what a page's URL doesn't tell."""


class Filters(NamedTuple):
    """Method globs that block, and globs of exceptions that win over them."""

    block: tuple[str, ...]
    allow: tuple[str, ...]


#: Options of a rule that hold for every page.
PAGE_OPTIONS = frozenset({"all", "doc", "document"})
#: Names in hosts files that mean the machine itself.
LOCAL_NAMES = frozenset({"localhost", "localhost.localdomain", "local", "broadcasthost", "ip6-localhost", "ip6-loopback", "0.0.0.0"})
_ADDRESS = re.compile(r"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:%\w+)?)(?=[ \t])")
_HOST = re.compile(r"[^\x00-\x20/|^$@#?:\\(){}\[\]+,]+")
_HIDING = re.compile(r"#[@?$%]{0,2}#")


def _rule(rule: str) -> str:
    """The glob of a rule without its exception mark and options."""
    if rule.startswith("|") and not rule.startswith("||"):
        raise ListError("an anchor at the scheme, which isn't part of the canonical URL")
    if "|" in rule.removeprefix("||").removesuffix("|"):
        host, _, path = rule.partition("|")
        if rule.startswith("||") or not host.startswith(("*", ".")) or "|" in path:
            raise ListError("a glob is host-glob|path-glob, its host-glob begins with * or .")
        return rule
    ends = rule.endswith("|")
    anchored, rule = rule.startswith("||"), rule.removeprefix("||").removesuffix("|")
    host, slash, path = rule.partition("/")
    if not slash and host.endswith("^"):
        host = host[:-1]
    if "^" in host or "^" in path:
        raise ListError("a separator mark anywhere but behind the host")
    if host == "" and (anchored or path == ""):
        raise ListError("a rule without host and path")
    if host and not _HOST.fullmatch(host):
        raise ListError("a host with characters that hosts don't have")
    if re.search(r"[\\(){}\[\]]", path):
        raise ListError("a regular expression")
    if "?" in path or "#" in path:
        raise ListError("a query or fragment, which the canonical URL doesn't hold")
    tail = "" if ends else "*"
    return f"*.{host.lower()}|{slash}{path}{tail}" if host else f"*|{slash}{path}{tail}"


def _line(line: str) -> list[tuple[bool, str]]:
    """(whether it is an exception, glob) of one line."""
    rule = line.strip()
    if not rule or rule[0] == "!" or (rule[0] == "[" and rule[-1] == "]") or _HIDING.search(rule) or rule[0] == "#":
        return []
    address = _ADDRESS.match(rule)
    if address:
        names = rule[address.end() :].partition("#")[0].split()
        if not all(_HOST.fullmatch(n) and "*" not in n for n in names):
            raise ListError("a line of a hosts file holds an address and names")
        return [(False, f".{n.lower()}|*") for n in names if n.lower() not in LOCAL_NAMES]
    allow, rule = rule.startswith("@@"), rule.removeprefix("@@")
    body, dollar, options = rule.rpartition("$")
    if dollar and "/" not in options:
        unknown = [o for o in options.split(",") if o.strip().lower() not in PAGE_OPTIONS]
        if unknown:
            raise ListError(f"options {unknown} that a page's URL doesn't decide")
        rule = body
    if re.search(r"\s", rule):
        raise ListError("blanks inside a rule")
    return [(allow, _rule(rule))]


def parse_filters(lines) -> Filters:
    """Globs of a filter list, one rule a line; a line that can't be read raises ListError with its number.

    ``||domain^``, ``||domain`` and a bare ``domain`` mean the domain and its subdomains, with ``/path`` behind it paths that begin
    so; ``/path`` is a path on any host, and ``*`` stands for any text.  ``|`` behind a rule ends the path there.  ``@@`` marks an
    exception.  ``address name...`` of a hosts file blocks these hosts alone.  ``host-glob|path-glob`` is taken as it is.
    Comments (``!``, ``#``), headers in brackets and rules that hide parts of pages decide no URL and are left out.
    """
    found: tuple[dict, dict] = ({}, {})
    for number, line in enumerate(lines, 1):
        try:
            for allow, glob in _line(line):
                found[allow][glob] = None
        except ListError as e:
            raise ListError(f"line {number}: {e}: {line.strip()[:200]}") from None
    return Filters(tuple(found[0]), tuple(found[1]))


def parse_list(lines) -> tuple[str, ...]:
    """The blocking globs of a list without exceptions; see ``parse_filters``."""
    filters = parse_filters(lines)
    if filters.allow:
        raise ListError("the list has exceptions, which parse_filters reads")
    return filters.block


class Automaton:
    """All patterns side by side.  A pattern of n characters takes n bits and one more for its end."""

    def __init__(self, globs: list[bytes]):
        bits = sum(len([c for c in g if c != 42]) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        self.mask = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros(self.words, dtype=np.uint64)
        self.begin = np.zeros(self.words, dtype=np.uint64)
        self.last = []
        at = 0
        for g in globs:
            self._set(self.begin, at)
            # bit at+k is on when the first k characters have been seen; '*' keeps the bit that it follows
            for c in g:
                if c == 42:
                    self._set(self.loop, at)
                else:
                    at += 1
                    self._set(self.mask[c], at)
            self.last.append(at)
            at += 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix texts x globs."""
        n = len(texts)
        rows = max(1, STATE_BYTES // (8 * self.words))
        if n > rows:
            return np.concatenate([self.match(texts[i : i + rows]) for i in range(0, n, rows)])
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        data = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        state = np.tile(self.begin, (n, 1))
        sorted_lengths, sorted_starts = lengths[order], starts[order]
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths.max()) if n else 0):
            live = int(np.searchsorted(-sorted_lengths, -i, side="left"))  # URLs longer than i
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.mask[data[sorted_starts[:live] + i]]) | (d & self.loop)
        out = np.empty((n, len(self.last)), dtype=bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & one != 0
        return out


def _compiled(rules: tuple[ListRule, ...], globs: tuple[str, ...]) -> tuple[list[ListRule], Automaton]:
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    sides = [g.split("|", 1) for g in (*(r.glob() for r in ranked), *globs)]
    return ranked, Automaton([host.encode() + PARTS + path.encode() for host, path in sides])


def judge_batches(batches: Iterator[pd.DataFrame], rules: tuple[ListRule, ...], globs: tuple[str, ...], exceptions: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    ranked, automaton = _compiled(rules, (*globs, *exceptions))
    split = len(ranked) + len(globs)
    names = np.array([r.rule for r in ranked] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in ranked] + [""], dtype=object)
    for frame in batches:
        canonical = [b"." + h.encode() + PARTS + p.encode() for h, p in zip(frame["host"], frame["path"], strict=True)]
        hit = automaton.match(canonical)
        lists = np.concatenate((hit[:, : len(ranked)], np.ones((len(frame), 1), dtype=bool)), axis=1)
        best = lists.argmax(axis=1) if len(frame) else np.zeros(0, dtype=int)
        method = np.where(hit[:, len(ranked) : split].any(axis=1) & ~hit[:, split:].any(axis=1), "block", "allow")
        yield frame.assign(rule=names[best], verdict=np.where(best < len(ranked), verdicts[best], method).astype(object))


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", lower).withColumn("path", F.substr(rest, F.char_length(host) + 1))


def judge(
    pages: DataFrame, rules: tuple[ListRule, ...] = RULES, globs: tuple[str, ...] = METHOD_GLOBS, *, exceptions: tuple[str, ...] = (), page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule (null without a list rule) and verdict of every row."""
    if any("*" in r.rule or "/" not in r.rule or "|" in r.rule.partition("/")[0] for r in rules):
        raise ValueError("a list rule is host/path without wildcards")
    if any("|" not in g for g in (*globs, *exceptions)):
        raise ValueError("a method rule is host-glob|path-glob")
    # ids travel as text: pandas has no integers beside nulls
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"))
    schema = "page_id string, host string, path string, rule string, verdict string"
    judged = split_url(rows).drop("url").mapInPandas(workers.batches(__name__, "judge_batches", rules, globs, exceptions), schema)
    return judged.withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType))
