"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules judge a url. *Site rules* (host suffix and path prefix) decide when one fits, the longest
``host/path`` first. All other urls go to the *pattern rules*, regular expressions that are searched for in the lower-cased
url. From each expression follow the literal tokens that every hit must hold (``required_tokens``); the rule is filed under
the one that is rarest in the corpus, the url's own tokens fetch the candidate rules, and only those run their expression.
Rules from which no token follows are tried on every url. A url that no pattern hits is allowed.

Pattern rules come as objects or as a table (verdict, pattern) of ``RULES`` rows at most, which every worker holds; more are
an error. Tokens are counted over all urls, aggregated before the shuffle; only the rules' own tokens reach the driver.

Defined results: a null url, an empty url or one without ``://`` has an empty host and path, fits no site rule, and
goes to the pattern rules like any other text (a null url is allowed). Where rules of both verdicts hit, the url is blocked.
Repeated rows are judged one by one. An empty table gives an empty result. Only the id and url columns are read, so other
columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str


RULES = 200_000

#: Production parameters. Fixed values.
SITE_RULES = (
    SiteRule("allow", "com"),
    SiteRule("block", "example.com", "en/"),
    SiteRule("allow", "www.example.com", "en/"),
    SiteRule("block", "net", "es/"),
    SiteRule("block", "net", "fr/"),
)
#: Words that a blocked host has between dots, hyphens and its ends. Fixed values.
HOST_WORDS = (
    "adult", "betting", "cams", "casino", "casinos", "crack", "cracked", "escort", "escorts", "gambling", "hentai", "jackpot", "keygen", "livecam",
    "malware", "milf", "nude", "nudes", "payday", "pharma", "phishing", "poker", "porn", "porno", "pornhub", "roulette", "scam", "sex", "sexcam", "slots",
    "spam-farm", "sportsbook", "torrent", "torrents", "viagra", "warez", "webcam", "xxx",
)
#: Pages that hold no text of their own, at a path's end or before its next part. Fixed values.
PATHS = (
    "admin", "cart", "cgi-bin", "checkout", "login", "logout", "my-account", "password-reset", "register", "signin", "signup", "trackback", "wishlist",
    "wp-admin", "wp-cron.php", "wp-json", "wp-login.php", "xmlrpc.php",
)
#: Names of parameters that open sessions or pay for links. Fixed values.
PARAMETERS = ("affiliate_id", "aff_id", "jsessionid", "oauth_token", "phpsessid", "replytocom", "session_id", "sessionid")
#: Kinds of files that aren't web pages. Fixed values.
FILES = (
    "7z", "apk", "avi", "bin", "bmp", "css", "dmg", "doc", "docx", "exe", "gif", "gz", "ico", "iso", "jar", "jpeg", "jpg", "js", "mkv", "mov", "mp3", "mp4",
    "msi", "ogg", "png", "ppt", "pptx", "rar", "rpm", "svg", "swf", "tar", "tgz", "tif", "ttf", "wav", "webm", "webp", "wmv", "woff", "xls", "xlsx", "zip",
)
PATTERN_RULES = (
    *(PatternRule("block", rf"://([^/?#]*[.-])?{re.escape(w)}([.-][^/?#]*)?([/?#]|$)") for w in HOST_WORDS),
    *(PatternRule("block", rf"://[^/?#]*(/[^?#]*)?/{re.escape(w)}([/?#]|$)") for w in PATHS),
    *(PatternRule("block", rf"[?&;]{w}=") for w in PARAMETERS),
    *(PatternRule("block", rf"://[^?#]*/[^?#]*\.{w}([?#]|$)") for w in FILES),
)


def _never_of_token(kind, value) -> bool | None:
    """Whether a parsed character is never part of a token (None: it isn't a plain character or set)."""
    if kind is op.LITERAL:
        return not re.fullmatch(TOKEN, chr(value).lower())
    if kind is op.IN:
        plain = [(a, a) if k is op.LITERAL else a if k is op.RANGE else None for k, a in value if k is not op.NEGATE]
        if None in plain:
            return False
        inside = lambda c: any(a <= c <= b for a, b in plain)
        letters = [*range(48, 58), *range(97, 123)]
        if value[0][0] is op.NEGATE:
            return all(map(inside, letters))
        return not any(re.fullmatch(TOKEN, chr(c).lower()) for a, b in plain for c in range(a, min(b, 0x17F) + 1))
    return None


def _flat(items) -> list:
    """A sequence with groups taken apart."""
    out = []
    for kind, value in items:
        out += _flat(value[3]) if kind is op.SUBPATTERN and not value[1] and not value[2] else [(kind, value)]
    return out


_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _edges(items) -> tuple[bool, bool]:
    """Whether a sequence certainly begins, and ends, with a character that no token has or at an end of the text."""
    items = _flat(items)
    if not items:
        return False, False

    def edge(kind, value, at):
        if kind is op.AT:
            return value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END, op.AT_END_STRING)
        if kind is op.BRANCH:
            return all(_edges(x)[at] for x in value[1])
        if kind in _REPEATS:
            return value[0] > 0 and _edges(value[2])[at]
        return bool(_never_of_token(kind, value))

    return edge(*items[0], 0), edge(*items[-1], 1)


def _border_follows(items) -> bool:
    """Whether a flat sequence certainly begins with a border, whatever of it may be left out."""
    for kind, value in items:
        if kind in _REPEATS and not value[0]:
            if not _edges(value[2])[0]:
                return False
            continue
        return _edges([(kind, value)])[0]
    return False


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every lower-case text with a hit holds whole. Where that isn't certain, a token is left out."""
    found: list[str] = []
    run, sure = "", False  # token characters, since a place that is certainly a token's beginning
    items = _flat(_parser.parse(pattern))
    for i, (kind, value) in enumerate(items):
        if kind is op.LITERAL and not _never_of_token(kind, value):
            run += chr(value)
            continue
        if run and sure and _border_follows(items[i:]):
            found.append(run)
        if kind in _REPEATS and not value[0]:  # may be left out: then the place before it counts
            sure = sure and not run and _edges(value[2])[1]
        else:
            sure = _edges([(kind, value)])[1]
        run = ""
    return tuple(dict.fromkeys(found))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path without its leading slash kept apart: ``('a.com', '/x')``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if end is None else (rest[: end.start()], rest[end.start() :])
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


_LOWER = {i: i + 32 for i in range(65, 91)}


class Judge:
    """Both indexes. ``counts``: how many urls hold a token; it settles which token a pattern is filed under."""

    def __init__(self, sites, patterns, counts: dict[str, int]):
        self.sites = {(r.host, r.path): r for r in sites}
        self.depth = sorted({len(r.path) for r in sites}, reverse=True)
        self.patterns: dict[str, list[PatternRule]] = {}
        self.always: list[PatternRule] = []
        self.compiled: dict[str, re.Pattern] = {}
        for r in patterns:
            tokens = required_tokens(r.pattern)
            (self.patterns.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always).append(r)

    def site(self, host: str, path: str) -> SiteRule | None:
        """The longest rule that fits."""
        below, best = path.removeprefix("/"), None
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in self.depth:
                rule = self.sites.get((suffix, below[:n])) if len(below) >= n else None
                if rule and (best is None or len(rule.name) > len(best.name)):
                    best = rule
        return best

    def candidates(self, text: str) -> list[PatternRule]:
        """Rules that a lower-case url's tokens fetch, and those that are always tried."""
        found = list(self.always)
        for token in set(re.findall(TOKEN, text)):
            found += self.patterns.get(token, ())
        return found

    def hits(self, rule: PatternRule, text: str) -> bool:
        if rule.pattern not in self.compiled:
            self.compiled[rule.pattern] = re.compile(rule.pattern)
        return bool(self.compiled[rule.pattern].search(text))

    def pattern(self, url: str | None) -> str:
        text = (url or "").lower()
        verdicts = {rule.verdict for rule in self.candidates(text) if self.hits(rule, text)}
        return "block" if "block" in verdicts else "allow"

    def __call__(self, url: str | None):
        host, path = split_url(url)
        rule = self.site(host, path) if host else None
        return host, path, rule.name if rule else None, rule.verdict if rule else self.pattern(url)


def token_counts(pages: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """Urls that hold each of the rules' tokens; at most one row for each token reaches the driver."""
    if not tokens:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit(f"({TOKEN})"), F.lit(1)))
    # As many tokens as the rules require: a broadcast of bounded size.
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"))
    held = pages.select(F.explode(words).alias("token")).join(wanted, "token")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rules_of(patterns: Sequence[PatternRule] | DataFrame) -> list[PatternRule]:
    """Pattern rules; of a table, its distinct rows (verdict, pattern), none null."""
    if isinstance(patterns, DataFrame):
        rows = patterns.select("verdict", "pattern").where("verdict is not null and pattern is not null").distinct().limit(RULES + 1).collect()
        patterns = [PatternRule(*r) for r in sorted(rows)]
    if len(patterns) > RULES:
        raise ValueError(f"more than {RULES} pattern rules")
    for r in patterns:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {r.verdict!r}")
    return list(patterns)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", sites=SITE_RULES, patterns: Sequence[PatternRule] | DataFrame = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    patterns = rules_of(patterns)
    required = [required_tokens(r.pattern) for r in patterns]
    counts = token_counts(pages, url, {t for tokens in required if len(tokens) > 1 for t in tokens})
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sites, patterns, counts)
        for batch in batches:
            out = [judge(u) for u in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict"])

    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return narrow.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
