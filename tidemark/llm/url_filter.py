"""URL filters: host and path rules, and glob patterns run all at once by a bit-parallel wildcard automaton.

Every glob is a row of places; a place is a character set, and may carry a self-loop (for `*`). All places of all globs are packed, one bit
each, into 64-bit words. One step of the automaton reads one character of every URL of a batch: `(state << 1 | start) & mask[char]`, with
carries from word to word, plus the looping places; so all globs advance together, over all URLs of the batch together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER

#: (kind, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over the canonical url (host + path + query, A-Z lower-cased): `*` any run, `?` one character, else itself.
GLOBS = ("ads.*", "*.ads.*", "*ads-track.*", "*/ads/*", "*doubleclick*", "*/track?r/*", "*utm_source=*&utm_campaign=*", "*/wp-login.php*", "*.exe", "*.zip", "*casino*", "*/cart/*", "*sessionid=*", "*popunder*")


class GlobAutomaton:
    """Shift-And over several words, byte by byte of UTF-8. `*` takes any run; `?` one character: its first byte enters the place, its others stay there."""

    def __init__(self, globs: Sequence[str]):
        places: list[tuple[int, bool]] = []  # byte or -1 for any; True: loops on itself
        self.starts, self.accepts, self.empties = [], [], []
        for g in globs:
            first = len(places)
            places.append((-2, False))  # entered before the first character only
            for c in g.encode():
                if c == ord("*"):
                    places[-1] = (places[-1][0], True)
                else:
                    places.append((-1 if c == ord("?") else c, False))
            self.starts.append(first)
            self.accepts.append(len(places) - 1)
        self.n_words = max(1, -(-len(places) // 64))
        self.masks = np.zeros((256, self.n_words), np.uint64)
        self.loops = np.zeros(self.n_words, np.uint64)
        self.stays = np.zeros((256, self.n_words), np.uint64)  # places where a byte that continues a character changes nothing
        self.first = np.zeros(self.n_words, np.uint64)
        for i, (c, loop) in enumerate(places):
            bit, w = np.uint64(1 << (i % 64)), i // 64
            if c == -1:
                self.masks[:0x80, w] |= bit
                self.masks[0xC0:, w] |= bit
                self.stays[0x80:0xC0, w] |= bit
            elif c >= 0:
                self.masks[c, w] |= bit
            if loop:
                self.loops[w] |= bit
        for s in self.starts:
            self.first[s // 64] |= np.uint64(1 << (s % 64))

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """For each url the number of the first glob that fits the whole of it, or -1."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        size = np.array([len(urls[i]) for i in order])
        out = np.full(len(urls), -1, np.int64)
        for lo in range(0, len(urls), 4096):
            part, n = order[lo : lo + 4096], size[lo : lo + 4096]
            raw = np.frombuffer(b"".join(urls[i] for i in part), np.uint8)
            at = np.concatenate([[0], np.cumsum(n)])[:-1]
            state = np.tile(self.first, (len(part), 1))
            alive = len(part)
            for step in range(int(n[0]) if len(n) else 0):
                alive = int(np.searchsorted(-n, -step, side="left"))  # longest first: those with a character at this step
                old = state[:alive]
                moved = old << np.uint64(1)
                moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
                byte = raw[at[:alive] + step]
                state[:alive] = (moved & self.masks[byte]) | (old & (self.loops | self.stays[byte]))
            found = np.full(len(part), -1, np.int64)
            for g in range(len(self.accepts) - 1, -1, -1):
                a = self.accepts[g]
                found[(state[:, a // 64] >> np.uint64(a % 64)) & np.uint64(1) == 1] = g
            out[part] = found
        return out


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and what follows the path up to `#`; all empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", ""
    rest = url[at + 3 :]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    rest = rest.split("#", 1)[0]
    path, mark, query = rest.partition("?")
    return host.encode().translate(ASCII_LOWER).decode(), path, mark + query


class HostRules:
    """Longest rule whose host is the url's host or a parent domain and whose path starts the url's path."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for kind, host, path in rules:
            self.by_host.setdefault(host, []).append((path, kind, host + path))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, size = None, -1
        parts = host.split(".") if host else []
        for i in range(len(parts)):
            for p, kind, rule in self.by_host.get(".".join(parts[i:]), ()):
                if len(rule) > size and path.startswith(p):
                    best, size = (kind, rule), len(rule)
        return best


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), glob_hit (the pattern that fits, else null), verdict.

    The longest rule decides; where none fits, a url that a glob fits is blocked and any other allowed. A null url, or one without `://`,
    has empty host and path, no rule, and no glob is tried: it is allowed. Of several globs that fit, the first listed is named. Only the two columns are
    read, whatever the others are called; null ids stay null, repeated rows get equal answers, an empty table gives no rows.
    """
    rules, globs = tuple(rules), tuple(globs)
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, glob_hit string, verdict string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automaton = HostRules(rules), GlobAutomaton(globs)
        for b in batches:
            urls = b.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            hits = [table.find(h, p) for h, p, _ in parts]
            canon = [(h + p + q).encode().translate(ASCII_LOWER) if h or p else b"" for h, p, q in parts]
            found = automaton.match(canon) if canon else np.empty(0, np.int64)
            seen = [int(g) if c else -1 for g, c in zip(found, canon, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in parts], pa.string()), pa.array([x[1] for x in parts], pa.string()), pa.array([h and h[1] for h in hits], pa.string()), pa.array([globs[g] if g >= 0 else None for g in seen], pa.string()), pa.array([h[0] if h else "block" if g >= 0 else "allow" for h, g in zip(hits, seen, strict=True)], pa.string())],
                names=[id_col, "host", "path", "rule", "glob_hit", "verdict"],
            )

    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(judge, schema)
