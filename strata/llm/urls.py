"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path with ``*`` for any run of characters. Each rule is filed under the literal token
of its pattern that the rule set uses least; a URL is cut into tokens, each token fetches the rules filed under it, and
only those run their regular expression. Rules without a usable token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The rules go to every task inside its function; a larger set has to be cut into several calls.
MAX_RULE_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """host: that host and its subdomains; path: what the URL's path starts with. Both may hold ``*``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        host, path = ("".join(".*" if c == "*" else re.escape(c) for c in part) for part in (self.host, self.path))
        return rf"(?:[^/]*\.)?{host}(?![^/]){path}"

    def tokens(self) -> list[str]:
        """Literal tokens with a boundary on both sides: each is a whole token of any URL that fits."""
        out = []
        for text, closed in ((self.host, True), (self.path, False)):
            for m in _TOKEN.finditer(text):
                left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                if left != "*" and right != "*" and (right or closed):
                    out.append(m[0].lower())
        return out


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


class RuleIndex:
    """Rules by their rarest literal token; the longest name wins, of equals the first."""

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        used = Counter(t for r in rules for t in set(r.tokens()))
        self.order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
        self.rules = [rules[i] for i in self.order]
        self.regex = [re.compile(r.regex(), re.DOTALL) for r in self.rules]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            tokens = r.tokens()
            if tokens:
                self.by_token[min(tokens, key=lambda t: (used[t], -len(t), t))].append(i)
            else:
                self.always.append(i)

    def match(self, host: str, path: str) -> Rule | None:
        text = host + path
        found = set(self.always)
        for t in set(_TOKEN.findall(text.lower())):
            found.update(self.by_token.get(t, ()))
        for i in sorted(found):
            if self.regex[i].match(text):
                return self.rules[i]
        return None


_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as they stand in the URL; null, or no ``://``: both empty."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    rule: the name of the longest rule that fits, else null; verdict: its verdict, else ``default``. A null or empty
    URL, or one without ``://``, has empty host and path and fits only rules that fit those. Repeated rows are judged
    each; an empty table gives no rows; columns other than page_id and url are not read. No shuffle.
    """
    rules = list(rules)
    size = sum(len(r.name.encode()) + 64 for r in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"the rules take {size} bytes, more than the {MAX_RULE_BYTES} that are sent to each task")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for batch in batches:
            split = [host_and_path(u) for u in batch.column("url").to_pylist()]
            hits = [index.match(*x) for x in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([x[0] for x in split], pa.string()),
                    pa.array([x[1] for x in split], pa.string()),
                    pa.array([r.name if r else None for r in hits], pa.string()),
                    pa.array([r.verdict if r else default for r in hits], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url")
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
  from p join r on (host = rh or suffix(host, '.' || rh)) and prefix(path, rp) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (page_id)
"""
