"""URL filters by rules that are found through their rarest token.

A rule is a site (a host with its subdomains, and the start of a path) or a pattern over the whole address: host in lower case, path, query and
fragment. In a pattern ``*`` stands for any characters, ``^`` for a separator (anything but letters, digits, ``_ - . %``) or the end, ``||`` in front
for the start of the host or of one of its later labels, ``|`` in front or behind for the start or the end; ASCII letters match in either case.

Addresses are cut into tokens, runs of ASCII letters and digits. Every token that must stand whole in each address a rule fits could find the rule; the rule is
indexed by the one that is rarest in all addresses at hand. A rule without such a token is indexed by the empty token, which every
address has. The tokens of an address are joined to the index, and only the rules found so run their regular expressions. Of those that fit, sites
come before patterns; the longest site wins (then the longer host), allowing patterns before blocking ones; what nothing fits is allowed.

All of it is DataFrame functions. The frame is scanned twice, for the counts of the rules' tokens and for the verdicts; one shuffle, on the rows
themselves behind a map-side combine, brings the candidates of an address together, so that a common host or token gathers nowhere.

Defined cases: a null address, or one without ``://``, has empty host and path, and no site fits it; empty hosts and paths stay empty; repeated rows stay
repeated; two rules of one host and path must agree, or building them fails; an empty table gives an empty table; without rules everything is allowed.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import fresh

_TOKEN = re.compile("[a-z0-9]+")
_END = r"(?![\s\S])"
_SEPARATOR = rf"(?:[^A-Za-z0-9_.%-]|{_END})"


@dataclass(frozen=True)
class Site:
    """All addresses of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return _folded(self.host) + self.path

    @property
    def order(self) -> tuple:
        return 1, len(self.name), len(self.host), self.name

    @property
    def regex(self) -> str:
        return rf"^(?:[^/?#]*\.)?{quoted(self.name)}"

    def tokens(self) -> set[str]:
        """Tokens that stand whole in each address of the site: the last one of the path may go on, unless a separator ends it."""
        return _whole_tokens(self.name, open_end=True)


@dataclass(frozen=True)
class Pattern:
    verdict: str
    text: str

    @property
    def name(self) -> str:
        return self.text

    @property
    def order(self) -> tuple:
        return 0, self.verdict == "allow", len(self.text), self.text

    def _parts(self) -> tuple[str, str, str]:
        front = "||" if self.text.startswith("||") else "|" if self.text.startswith("|") else ""
        body = self.text[len(front):]
        back = "|" if body.endswith("|") else ""
        return front, body[:-1] if back else body, back

    @property
    def regex(self) -> str:
        front, body, back = self._parts()
        inner = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else quoted(c) for c in body)
        return "(?is)" + {"": "", "|": "^", "||": r"^(?:[^/?#]*\.)?"}[front] + inner + (_END if back else "")

    def tokens(self) -> set[str]:
        front, body, back = self._parts()
        found, parts = set(), body.split("*")
        for k, part in enumerate(parts):
            found |= _whole_tokens(part, open_start=k > 0 or not front, open_end=k < len(parts) - 1 or not back)
        return found


Rule = Site | Pattern


def quoted(text: str) -> str:
    """``text`` as a regular expression for itself, in Java and elsewhere."""
    return re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", text)


def _folded(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _whole_tokens(text: str, *, open_start: bool = False, open_end: bool = False) -> set[str]:
    folded = _folded(text)
    return {m[0] for m in _TOKEN.finditer(folded) if not (open_start and m.start() == 0) and not (open_end and m.end() == len(folded))}


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rank, name, site, verdict, regex, tokens): one row a rule; of several that fit an address, the one of highest rank counts."""
    verdicts: dict[tuple, str] = {}
    for rule in rules:
        if isinstance(rule, Site) and ("?" in rule.name or "#" in rule.name or "/" in rule.host):
            raise ValueError(f"neither host nor path of a site: {rule.name!r}")
        if rule.verdict not in ("allow", "block") or verdicts.setdefault((type(rule), rule.name), rule.verdict) != rule.verdict:
            raise ValueError(f"no verdict, or two of them, for {rule.name!r}")
    rows = [{"rank": rank, "name": rule.name, "site": isinstance(rule, Site), "verdict": rule.verdict, "regex": rule.regex, "tokens": sorted(rule.tokens())}
            for rank, rule in enumerate(sorted(set(rules), key=lambda r: r.order), 1)]
    schema = "array<struct<rank: int, name: string, site: boolean, verdict: string, regex: string, tokens: array<string>>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def address(url: str) -> Column:
    """Of a URL column, what follows the first ``://``, with the host in lower case; empty without it."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + F.lit(3))).otherwise(F.lit(""))
    return F.concat(lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_replace(rest, "^[^/?#]*", ""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_tokens(address: Column) -> Column:
    """The distinct tokens of an address, and the empty token once (:data:`_TOKEN`)."""
    return F.array_union(F.array(F.lit("")), F.split(lowered(address), "[^a-z0-9]+"))


def rarest_tokens(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """(rank, token): the token of each rule that is rarest in column ``address`` of all ``addresses`` (ties: first in the alphabet)."""
    wanted = rules.select("rank", F.explode("tokens").alias("token"))
    seen = addresses.select(F.explode(url_tokens(F.col("address"))).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(counts, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.select("rank").join(ranked, "rank", "left").select("rank", F.coalesce("best.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` of every row, with (host, path, rule, pattern, verdict): the name of the site or else of the pattern that decided.

    Keep narrow columns only, for they are shuffled; wide ones are joined afterwards by a key among them.
    """
    spark = pages.sparkSession
    if clash := {c.lower() for c in keep} & {"host", "path", "rule", "pattern", "verdict"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    table = rule_table(spark, rules)
    kept = [F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)]
    names = [f"_keep{k}" for k in range(len(keep))]
    parsed = pages.select(*kept, F.col(url).alias("_url")).select(*names, address("_url").alias("address"))
    # The empty token is in the index even if no rule is: it keeps one row of every address.
    anchor = spark.range(1, numPartitions=1).select(F.lit(0).alias("rank"), F.lit("").alias("token"), F.lit(None).cast("string").alias("regex"))
    index = rarest_tokens(table, parsed).join(table.select("rank", "regex"), "rank").select("rank", "token", "regex").unionByName(anchor)
    candidates = parsed.select("*", F.explode(url_tokens(F.col("address"))).alias("token")).join(index, "token")
    fits = F.when(F.col("rank") > 0, F.when(F.rlike(F.col("address"), F.col("regex")), F.col("rank")))
    judged = candidates.groupBy(*names, "address").agg(
        F.max(fits).alias("rank"), F.count_if(F.col("rank") == 0).cast("int").alias("_copies"))
    decided = table.select("rank", "site", "name", "verdict")
    return (judged.join(decided, "rank", "left").select("*", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
            .select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
                    F.regexp_extract("address", "^[^/?#]*", 0).alias("host"), F.regexp_extract("address", "^[^/?#]*([^?#]*)", 1).alias("path"),
                    F.when(F.col("site"), F.col("name")).alias("rule"), F.when(~F.col("site"), F.col("name")).alias("pattern"),
                    F.coalesce("verdict", F.lit("allow")).alias("verdict")))


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose address is allowed, whole and with their columns."""
    own = fresh(pages, "_blocked")
    judged = judge(pages.select(F.col(url).alias(own)).distinct(), rules, url=own, keep=[own])
    return pages.join(judged.filter("verdict = 'block'").select(own), F.col(url) == F.col(own), "left_anti")
