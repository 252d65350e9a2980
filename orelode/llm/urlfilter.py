"""URL rules in a bit-parallel wildcard automaton (operator 3).

All glob rules are packed end to end into one bit string of as many 64-bit words
as needed. For every byte there is a mask of the positions that it matches and
one of the positions that may stand still on it (the wildcards). One step of
Shift-And with carries between the words advances every rule over one byte of a
URL, and the rows of a batch advance together. After the last byte the final
positions that are set name the rules that match.

A glob is matched against ``.host`` followed by the path. ``%`` stands for any
run of bytes without ``/`` and ``*`` for any run at all, so a host rule can't
match inside a path.

Cases: a null URL or one without ``://`` has an empty host and path, no rule and
the default verdict. Of equally long rules that fit, the first in order wins.
An empty rule list gives every URL the default verdict. A URL of any length is
read whole; rows of a batch are stepped in runs of similar length. Repeated rows
are judged each, alike. An empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import table
from orelode.llm.textcore import utf8_column

#: The production rules, as verdict and host with path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_ONE, _TOP = np.uint64(1), np.uint64(63)


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host and path, such as example.net/en/

    @property
    def glob(self) -> str:
        host, slash, path = self.rule.partition("/")
        return f"%.{host}{slash}{path}*"


class GlobAutomaton:
    """Shift-And over many globs at once."""

    def __init__(self, globs: Sequence[str]):
        lengths = [sum(c not in b"%*" for c in g.encode()) + 1 for g in globs]
        self.words = max(1, -(-sum(lengths) // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # positions entered on a byte
        self.stay = np.zeros((256, self.words), np.uint64)  # positions kept on a byte
        self.first = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            self.first[at >> 6] |= _ONE << np.uint64(at & 63)
            for c in g.encode():
                word, bit = at >> 6, _ONE << np.uint64(at & 63)
                if c == ord("%"):
                    keep = np.arange(256) != ord("/")
                    self.stay[keep, word] |= bit
                elif c == ord("*"):
                    self.stay[:, word] |= bit
                else:
                    at += 1
                    self.step[c, at >> 6] |= _ONE << np.uint64(at & 63)
            self.final.append((at >> 6, _ONE << np.uint64(at & 63)))
            at += 1

    def run(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Final states of each text, as rows of words."""
        n, lengths = len(offs) - 1, np.diff(offs)
        order = np.argsort(-lengths, kind="stable")
        start, length = offs[:-1][order], lengths[order]
        state = np.tile(self.first, (n, 1))
        live = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), side="right")
        for t, k in enumerate(live.tolist()):
            c = buf[start[:k] + t]
            now = state[:k]
            moved = now << _ONE
            moved[:, 1:] |= now[:, :-1] >> _TOP
            state[:k] = (moved & self.step[c]) | (now & self.stay[c])
        out = np.empty_like(state)
        out[order] = state
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, both empty where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge(canonical: Column, rules: Sequence[Rule], default: str) -> Column:
    """struct<rule, verdict> of a column of ``.host`` and path."""
    ranked = sorted(rules, key=lambda r: -len(r.rule))

    @F.arrow_udf("struct<rule string, verdict string>")
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = GlobAutomaton([r.glob for r in ranked])
        for urls in batches:
            state = machine.run(*utf8_column(urls))
            won = np.full(len(urls), -1)
            for k in range(len(ranked) - 1, -1, -1):  # the longest rule is written last
                word, bit = machine.final[k]
                won[(state[:, word] & bit) != 0] = k
            rule = [ranked[k].rule if k >= 0 else None for k in won]
            verdict = [ranked[k].verdict if k >= 0 else default for k in won]
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    return match(canonical)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    host, path = url_parts(F.col(url).cast("string"))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    judged = parts.select("*", judge(F.concat(F.lit("."), "host", "path"), rules, default).alias("j"))
    return judged.select(key, "host", "path", F.col("j.rule").alias("rule"), F.col("j.verdict").alias("verdict"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL under the production rules."""
    return judge_urls(table(spark, sf_dir, "pages"), [Rule(v, r) for v, r in RULES])


ORACLE = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from u),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select page_id, host, path, case
      when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
      when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
      when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
      when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule from h)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from f
"""
