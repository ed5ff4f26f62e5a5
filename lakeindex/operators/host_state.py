"""What one site's messages do to it, in their order: the unit of the lake's writes.

A site's folders come in as counts, so the fold is small however many files there are; entries follow their folders afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lakeindex.functions.urls import parse
from lakeindex.operators.quality import HARD_FOLDERS, JUDGED, MIN_EVIDENCE, MIN_SAMPLE_FOLDERS, STRIKES, Thresholds

#: States that a typed address, or a redirect from one, opens again.
REOPENED = ("not_listing", "unreachable", "partial", "low_value")


def depth(url: str) -> int | None:
    u = parse(url)
    return sum(bool(s) for s in u.segments) if u else None


@dataclass
class Folder:
    leaf: bool
    files: int
    bytes: int
    big: int
    useful: int
    seen_at: int
    src: int | None = None  # the message that brought it; None for what was stored


@dataclass
class Candidate:
    source: str
    found_at: int
    seq: int


@dataclass
class HostState:
    host: str
    row: dict | None = None
    folders: dict[str, Folder] = field(default_factory=dict)
    candidates: dict[str, Candidate] = field(default_factory=dict)

    def marked(self) -> bool:
        """Trusted by its row or by an address that was typed or led here."""
        return bool(self.row and self.row["trusted"]) or any(c.source in ("seed", "moved") for c in self.candidates.values())

    def entries(self, folders: dict[str, Folder]) -> None:
        """Listings replace the folders that they have entries of."""
        self.folders |= folders

    def insert(self, urls: list[str], source: str, now: int) -> None:
        """Adds URLs that are new, numbered in the order in which the site's come, and promotes known ones."""
        last = max((c.seq for c in self.candidates.values()), default=0)
        for url in urls:
            known = self.candidates.get(url)
            if known is None:
                if self.row is None or source == "resume" and self.row["status"] == "paused":
                    last += 1
                    self.candidates[url] = Candidate(source, now, last)
            elif source == "seed" and known.source not in ("seed", "resume") or source == "moved" and known.source not in ("seed", "moved", "resume"):
                known.source = source

    def trust(self, urls: list[str], source: str, now: int) -> None:
        """Addresses that users typed (seed), or that those moved to: opens closed rows, and trusts all but sensitive ones."""
        if self.row is not None:
            status = self.row["status"]
            if status in REOPENED or status == "sensitive" and source == "seed":
                self.row = None
            elif status != "sensitive":
                self.row["trusted"] = True
        self.insert(urls, source, now)

    def paused(self, finished: list[str], frontier: list[str], now: int) -> None:
        """Leaves what is still to read; the marks of trust go into the row first."""
        if any(c.source in ("seed", "moved") for c in self.candidates.values()) or self.row and self.row["trusted"]:
            if self.row is None:
                self.row = {"host": self.host, "status": "paused", "server": None, "dirs": 0, "files": 0, "bytes": 0, "crawled_at": now, "reason": None, "trusted": True, "fails": 0}
            self.row["trusted"] = True
        done = set(finished)
        self.candidates = {u: c for u, c in self.candidates.items() if c.source == "resume" and u not in done}
        self.insert(frontier, "resume", now)

    def done(self, status: str, server: str | None, dirs: int, reason: str | None, purge: bool, trusted: bool, judge: Thresholds | None, failed: bool, now: int) -> None:
        trusted = trusted or self.marked()
        if purge:
            self.folders = {}
        fails = 0
        if status == "paused" and failed:
            fails = (self.row["fails"] if self.row else 0) + 1
            if fails >= STRIKES:
                status = "partial" if self.folders else "unreachable"
                reason, fails = f"gave up after {fails} runs in a row that ended in errors ({reason or 'errors'})", 0
        self._write(status, server, dirs, reason, trusted, fails, now)
        if status != "paused":
            self.candidates = {}
        if judge and judge.enabled and status in JUDGED and not trusted and (why := self.verdict(status, judge)):
            self.mark("low_value", why, now)

    def _write(self, status, server, dirs, reason, trusted, fails, now) -> None:
        old = self.row
        more = old["dirs"] if old and old["status"] == "paused" else 0
        self.row = {
            "host": self.host, "status": status, "server": server if server is not None else old["server"] if old else None, "dirs": dirs + more, "files": sum(f.files for f in self.folders.values()), "bytes": sum(f.bytes for f in self.folders.values()),
            "crawled_at": now, "reason": reason, "trusted": trusted or bool(old and old["trusted"]), "fails": fails,
        }

    def mark(self, status: str, reason: str, now: int) -> None:
        """A tombstone: nothing of the site stays but its row."""
        self.folders, self.candidates = {}, {}
        self._write(status, None, 0, reason, False, 0, now)

    def verdict(self, status: str, t: Thresholds) -> str | None:
        files, big, useful = (sum(getattr(f, k) for f in self.folders.values()) for k in ("files", "big", "useful"))
        why = f"nothing worth keeping: {big} big files (need {t.min_big}) and {useful} useful files (need {t.min_useful}) among {files} files"
        if big >= t.min_big or useful >= t.min_useful:
            return None
        if status == "done":
            return why
        if status != "paused":
            return why if files >= MIN_EVIDENCE and big == 0 and useful * 20 < files else None
        if big:
            return None
        levels = [(depth(u) or 0, f.files) for u, f in self.folders.items() if f.leaf]
        level = max((d for d, _ in levels), default=None)
        sample = [n for d, n in levels if d == level]
        waits = [d for u in self.candidates if (d := depth(u)) is not None]
        fair = level is not None and len(sample) >= MIN_SAMPLE_FOLDERS and max(waits, default=0) <= level and sum(d == level for d in waits) <= len(sample)
        junk = fair and sum(sample) >= MIN_EVIDENCE and useful * 20 < sum(sample)
        endless = (self.row or {}).get("dirs", 0) >= HARD_FOLDERS and files >= MIN_EVIDENCE and useful * 100 < files
        return why if junk or endless else None
