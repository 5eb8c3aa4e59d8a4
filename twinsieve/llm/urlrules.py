"""URL filters: given rules, and association rules that FP-growth mines from labelled URLs.

Tokens of a URL are items; frequent sets of them with the items allow or block give rules
"tokens -> verdict", kept by support and confidence. An inverted index from each rule's rarest
token finds the rules whose tokens a URL all has; the most confident decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from .common import prepare, written


@dataclass(frozen=True)
class Mining:
    """max_rows bounds the labelled URLs that are mined: the first by a hash. Of a URL's frequent tokens the `tokens` commonest
    make the basket in which sets are sought, as a basket has 2**tokens sets; supports and confidences of the sets
    found are then counted over the URLs' whole token sets. Rules have three tokens at most."""

    min_support: float = 0.005
    min_confidence: float = 0.8
    max_rows: int = 50_000
    tokens: int = 16
    default: str = "allow"


#: (host, path, verdict): the longest that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, rest = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), rest


def fitting(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h) + len(p) > len(best[0])):
            best = (h + p, verdict)
    return best


def url_tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL: host labels and their hyphenated parts, path segments, query names; numbers as one token."""
    host, path = host_path(url)
    query = re.match(r"[^?#]*\??([^#]*)", (url or "").partition("://")[2], re.S)[1]
    found = [f"h:{x}" for x in re.split(r"[.-]", host)] + [f"p:{x}" for x in re.split(r"[/._-]", path.lower())] + [f"q:{x.partition('=')[0].lower()}" for x in query.split("&")]
    return sorted({re.sub(r"\d+", "0", x) for x in found if len(x) > 2})


def _tokenised(urls: DataFrame) -> DataFrame:
    prepare(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_tokens(x) for x in b.column(0).to_pylist()], pa.list_(pa.string())), b.column(1)], ["tokens", "verdict"])

    return urls.select("url", "verdict").mapInArrow(run, "tokens array<string>, verdict string")


def mine(labelled: DataFrame, params: Mining = Mining()) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of each kept rule, from rows (url, verdict) with verdict allow or block.

    Other verdicts and nulls teach nothing; no rows give no rules.
    """
    known = labelled.where(F.col("verdict").isin("allow", "block")).orderBy(F.xxhash64("url", "verdict"), "url", "verdict").limit(params.max_rows)
    rows = written(_tokenised(known), "labelled-urls")
    n = rows.count()
    if not n:
        return []
    common = rows.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= params.min_support * n).orderBy(F.desc("count"), "t")  # each URL has few tokens, so few of them are in min_support of all
    rank = {r.t: i for i, r in enumerate(common.collect())}

    def basket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [[*sorted((t for t in ts if t in rank), key=rank.get)[: params.tokens], v] for ts, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    baskets = rows.mapInArrow(basket, "items array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=params.min_support, minConfidence=params.min_confidence).fit(baskets).freqItemsets
    found = [frozenset(r["items"]) - {"allow", "block"} for r in sets.where(F.size("items") <= 4).toArrow().to_pylist()]
    candidates = sorted({tuple(sorted(x, key=lambda t: (-rank[t], t))) for x in found if 0 < len(x) <= 3})
    by_rarest: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
    for i, c in enumerate(candidates):
        by_rarest.setdefault(c[0], []).append((i, c))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], int] = {}
        for b in batches:
            for ts, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set(ts)
                for i, c in (x for t in ts for x in by_rarest.get(t, ())):
                    if own.issuperset(c):
                        total[i, v] = total.get((i, v), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in total], pa.int32()), pa.array([v for _, v in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["i", "v", "n"])

    seen = {(r.i, r.v): r.n for r in rows.mapInArrow(count, "i int, v string, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).collect()}
    rules = []
    for i, c in enumerate(candidates):
        every = seen.get((i, "allow"), 0) + seen.get((i, "block"), 0)
        for verdict in ("allow", "block"):
            if (freq := seen.get((i, verdict), 0)) and freq >= params.min_support * n and freq / every >= params.min_confidence:
                rules.append((c, verdict, freq / every, freq / n))
    best = {(t, v): c for t, v, c, _ in rules}
    shorter = lambda t: [t[:i] + t[i + 1 :] for i in range(len(t))] if len(t) > 1 else []
    return sorted(r for r in rules if all(best.get((s, r[1]), 0) < r[2] for s in shorter(r[0])))


def judged(urls: DataFrame, labelled: DataFrame | None = None, rules=RULES, params: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule's tokens (learned) where no given rule fits.

    labelled has rows (url, verdict); without it the URLs that given rules fit teach the method.
    A URL that neither fits gets params.default. Null and odd URLs have an empty host and path. Each row gives a row.
    """
    prepare(urls.sparkSession)
    rows = urls.select("page_id", "url")
    if labelled is None:
        labelled = _ruled(rows, rules).where("verdict is not null").select("url", "verdict")
    index: dict[str, list] = {}
    for tokens, verdict, confidence, support in mine(labelled, params):
        index.setdefault(tokens[0], []).append((confidence, len(tokens), support, verdict, tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for page, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host, path = host_path(url)
                if fit := fitting(host, path, rules):
                    made.append((page, host, path, fit[0], fit[1], None))
                    continue
                own = set(url_tokens(url))
                hits = [r for t in own if t in index for r in index[t] if own.issuperset(r[4])]
                best = max(hits, default=None)
                made.append((page, host, path, None, best[3] if best else params.default, " ".join(best[4]) if best else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [b.schema.field(0).type] + [pa.string()] * 5)], ["page_id", "host", "path", "rule", "verdict", "learned"]) if made else b.slice(0, 0)

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, learned string")


def _ruled(rows: DataFrame, rules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            fits = [fitting(*host_path(u), rules) for u in urls]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f and f[1] for f in fits], pa.string())], ["url", "verdict"])

    return rows.select("url").mapInArrow(run, "url string, verdict string")
