"""URL filter: a weighted vocabulary found by one Aho-Corasick automaton, after rules on hosts and paths.

A term counts where neither neighbour is a letter or digit. One strict term rejects; soft terms reject when at least
two distinct ones weigh as much as the threshold together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, spread

# Rules (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Words that have hardly any harmless use in a URL.
STRICT = tuple(
    """bestiality blowjob camgirls camsex casino casinos cialis creampie cumshot escorts fleshlight gangbang handjob hardcoreporn hentai keygens
    levitra milf milfs onlinecasino porn pornhub porno pornos pornstar pornstars redtube serialz sexcam sexcams sextube viagra warez xhamster xnxx xvideos xxx""".split()
)
# Words that tell something only in company, graded by how much: 0.5 for words of everyday use, 1.0 for
# words of trades that such pages share with others, 1.5 for words that are mostly theirs.
SOFT = {
    0.5: "bet bonus cheap deal discount download free full girls hot live money offer online spam win winner",
    1.0: "adult betting cams chat crack cracked dating jackpot loan loans payday pharmacy pills replica rolex slots tablet torrent torrents webcam xanax",
    1.5: "bdsm blackjack erotic escort fetish gambling keygen lingerie nude nudes poker roulette sex sexy steroids tramadol valium",
}
SOFT = {term: weight for weight, terms in SOFT.items() for term in terms.split()}
SOFT_WEIGHT = 2.0
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def split(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without a `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    return host.translate(_LOWER), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


class Vocabulary:
    def __init__(self, strict=STRICT, soft=SOFT, weight: float = SOFT_WEIGHT) -> None:
        import ahocorasick

        self.automaton, self.weight, self.soft, self.strict = ahocorasick.Automaton(), weight, dict(soft), set(strict)
        for term in {*strict, *soft}:
            self.automaton.add_word(term, term)
        self.empty = not (self.strict or self.soft)
        if not self.empty:
            self.automaton.make_automaton()

    def found(self, url: str) -> set[str]:
        if self.empty or not url:
            return set()
        text, out = url.translate(_LOWER), set()
        for last, term in self.automaton.iter(text):
            before, after = text[last - len(term)] if last >= len(term) else "/", text[last + 1 : last + 2] or "/"
            if not before.isalnum() and not after.isalnum():
                out.add(term)
        return out

    def rejects(self, terms: set[str]) -> bool:
        soft = terms & self.soft.keys() - self.strict
        return bool(terms & self.strict) or len(soft) >= 2 and sum(self.soft[t] for t in soft) >= self.weight


def best_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits; rules: (path, verdict) by host."""
    best, labels = None, host.split(".")
    for i in range(len(labels)):
        for at, verdict in rules.get(own := ".".join(labels[i:]), ()):
            if path.startswith(at) and (best is None or (len(own + at), len(own)) > best[0]):
                best = (len(own + at), len(own)), own + at, verdict
    return best and best[1:]


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """Per row: host, path, the rule that decided (null if none), the vocabulary's terms, verdict.

    Of rules of equal length that fit, the one of the longer host counts. Very long urls are searched whole; a repeated
    term counts once. A null url, or one without `://`, has empty host and path, fits no rule and is judged by its terms (none in a null).
    Repeated rows stay, no rows give none, other columns are ignored; rules and terms are parameters of fixed size.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("terms", pa.list_(pa.string())), ("verdict", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft, soft_weight)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for url in b.column(1).to_pylist():
                host, path = split(url)
                rule, terms = best_rule(by_host, host, path), vocabulary.found(url or "")
                for to, x in zip(out, (host, path, rule and rule[0], sorted(terms), rule[1] if rule else "block" if vocabulary.rejects(terms) else "allow"), strict=True):
                    to.append(x)
            yield batch(schema, [b.column(0), *out])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return spread(rows).mapInArrow(judge, "id long, host string, path string, rule string, terms array<string>, verdict string")


def oracle_sql() -> str:
    """The default rules and terms in DuckDB's SQL."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    near = lambda t: f"regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered)
    strict, soft = " or ".join(map(near, STRICT)), " + ".join(f"{near(t)}::int * {w}" for t, w in SOFT.items())
    several = " + ".join(f"{near(t)}::int" for t in SOFT)
    return f"""
    with a as (select page_id, coalesce(url, '') u, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
    b as (select *, regexp_extract(rest, '^[^/?#]*') h0 from a),
    c as (select page_id, {lower.format("u")} l, {lower.format("h0")} host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') path from b)
    select page_id, host, path, case {rule} else null end as rule,
      case {verdict} when {strict} then 'block' when ({several}) >= 2 and ({soft}) >= {SOFT_WEIGHT} then 'block' else 'allow' end as verdict from c"""
