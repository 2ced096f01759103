"""URL filters: host and path rules, and logistic regression on hashed character n-grams for all other URLs.

The classifier reads runs of three to five bytes of the host and of the path, each with its ends marked, as hashed
features of two families. It is trained on a small labelled table of URLs (at most ``SAMPLE`` of each class, lowest
hashes first) and scores every URL in Arrow batches. A rule decides before the classifier does. Rules up to
``MOST_RULES`` travel with the batches; a longer rule table meets the distinct hosts in a join instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import kernel as K
from .common import only

GRAMS = (3, 4, 5)
SLOTS = 1 << 15
#: Labelled URLs of each class that the fit reads.
SAMPLE = 5000
EPOCHS, RATE, RIDGE = 300, 0.1, 1e-5
#: Probability from which a URL is blocked.
BLOCK = 0.5
#: Rules that are sent to the tasks; more are joined.
MOST_RULES = 10_000

#: Rules of the query: verdict, host, start of the path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Labelled URLs for training: first those to block, then those to allow.
BLOCKED_URLS = """
http://casino-royal.example.net/en/17
https://www.casino-win.example.com/en/204.html
https://online-casino.example.com/de/9?page=2
http://m.lucky-casino.example.net/fr/88/
https://free-bets.example.net/en/31
http://www.free-bets.example.com/es/77.html
https://bets-free-daily.example.org/en/5
http://sports-bets.example.net/de/65#top
https://blog.best-bets.example.com/fr/3
https://cheap-pills.example.net/en/41
http://www.cheap-pills.example.com/en/900.html
https://m.pills-online.example.net/de/8
http://buy-cheap-pills.example.org/es/12
https://cheap-meds.example.com/en/6?ref=x
https://spam-farm.example.net/en/19
http://blog.spam-farm.example.com/de/72/
https://www.spam-links.example.com/en/4
http://link-farm.example.net/fr/55
https://adult-x.example.com/en/7
http://www.adult-x.example.net/de/33.html
https://adult-videos.example.org/en/21
http://m.adult-chat.example.net/es/2
https://xxx-adult.example.com/fr/11
https://ads-track.example.net/en/60
http://m.ads-track.example.com/en/8?utm_source=feed
https://ads-click.example.com/de/14
http://track-ads.example.net/fr/90
https://www.click-ads.example.org/en/1
http://poker-win.example.com/en/13
https://win-big-casino.example.net/en/44
http://news.example.com/casino/free-bets
https://blog.example.net/cheap-pills/buy-now
http://shop.example.com/adult-x/gallery
https://www.example.net/win-casino-bonus
""".split()
ALLOWED_URLS = """
http://news.example.net/en/17
https://www.library.example.com/en/204.html
https://garden.example.com/de/9?page=2
http://m.museum.example.net/fr/88/
https://weather.example.net/en/31
http://www.cooking.example.com/es/77.html
https://history.example.org/en/5
http://sports.example.net/de/65#top
https://blog.travel.example.com/fr/3
https://school.example.net/en/41
http://www.music.example.com/en/900.html
https://m.therapy.example.net/de/8
http://thought.example.org/es/12
https://theatre.example.com/en/6?ref=x
https://nation.example.net/en/19
http://blog.station.example.com/de/72/
https://www.fiction.example.com/en/4
http://relation.example.net/fr/55
https://thread.example.com/en/7
http://www.thing.example.net/de/33.html
https://other.example.org/en/21
http://m.whether.example.net/es/2
https://northern.example.com/fr/11
https://authority.example.net/en/60
http://m.month.example.com/en/8?utm_source=feed
https://thunder.example.com/de/14
http://earth.example.net/fr/90
https://www.health.example.org/en/1
http://within.example.com/en/13
https://method.example.net/en/44
http://news.example.com/science/open-data
https://blog.example.net/travel/summer-guide
http://shop.example.com/books/gallery
https://www.example.net/city-library-hours
""".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Host and path of a URL.
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` of ``url``; both are empty for a null and without ``://``."""
    url = F.coalesce("url", F.lit(""))
    return urls.withColumns({"host": F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), "path": F.regexp_extract(url, PARTS, 2)})


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table of the package: (url, blocked)."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS], "url string, blocked int")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _marked(column: pa.Array, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column with ``mark`` before and a line end after each value."""
    raw, offsets = K.column_bytes(column)
    n = len(offsets) - 1
    at = np.arange(len(raw)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))
    out = np.full(len(raw) + 2 * n, 10, np.uint8)
    out[at] = raw
    ends = offsets + 2 * np.arange(n + 1)
    out[ends[:-1]] = mark[0]
    return out, ends


def hashed_grams(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot of each gram, first gram of each row) of the host and of the path."""
    out = []
    for family, (name, mark) in enumerate((("host", b"@"), ("path", b"="))):
        buf, ends = _marked(batch.column(name), mark)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        slots, rows = [], []
        for n in GRAMS:
            count = max(0, len(buf) - n + 1)
            h = np.full(count, n, K.U64)
            for k in range(n):
                h = h * K.U64(257) + buf[k : k + count]
            inside = row[:count] == row[n - 1 : n - 1 + count]
            slots.append((K.mix(h[inside]) >> K.U64(40)).astype(np.int64) % SLOTS + family * SLOTS)
            rows.append(row[:count][inside])
        slots, rows = np.concatenate(slots), np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        out.append((slots[order], np.searchsorted(rows[order], np.arange(len(ends)))))
    return out


class Model:
    """Weights of the slots, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def probability(self, batch: pa.RecordBatch) -> np.ndarray:
        score = np.full(batch.num_rows, self.bias)
        for slot, first in hashed_grams(batch):
            score += K.sums(self.weights[slot].astype(np.float64), first) / np.sqrt(np.maximum(np.diff(first), 1))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``2 * sample`` rows of ``labelled(url, blocked)``; None when a class is missing.

    A URL labelled both ways counts as blocked; null URLs and labels take no part.
    """
    one = only(labelled, url="string", blocked="int").where("url is not null and blocked is not null")
    one = with_parts(one.groupBy("url").agg((F.max("blocked") > 0).cast("int").alias("y")))
    got = [one.where(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(sample).toArrow() for y in (0, 1)]
    if not got[0].num_rows or not got[1].num_rows:
        return None
    batch = pa.concat_tables(got).combine_chunks().to_batches()[0]
    y = batch.column("y").to_numpy().astype(float)
    row, col, val = [], [], []
    for slot, first in hashed_grams(batch):
        n = np.diff(first)
        row.append(np.repeat(np.arange(len(n)), n))
        col.append(slot)
        val.append(np.repeat(1 / np.sqrt(np.maximum(n, 1)), n))
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    x, m, v = np.zeros(2 * SLOTS + 1), 0.0, 0.0
    for k in range(1, EPOCHS + 1):
        score = np.bincount(row, x[col] * val, len(y)) + x[-1]
        err = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y)
        g = np.r_[np.bincount(col, err[row] * val, 2 * SLOTS) + RIDGE * x[:-1], err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Model(x[:-1], float(x[-1]))


def _strongest(rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The longest rule; of one rule with both verdicts, block."""
    return max(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0]), default=None)


class Rules:
    """Rules by host. A rule fits its host and all hosts below it."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rows:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, at = [], host
        while True:
            found += [(rule, verdict) for start, rule, verdict in self.by_host.get(at, ()) if path.startswith(start)]
            if "." not in at:
                return _strongest(found)
            at = at.split(".", 1)[1]


def _judged(model, rules):
    """Rule and verdict of each row; with ``rules`` None the columns rule and said come from a join."""

    def run(batches):
        for batch in batches:
            if rules is None:
                rule, said = batch.column("rule").to_pylist(), batch.column("said").to_pylist()
            else:
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                found = [rules.value.match(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
                rule, said = [f[0] for f in found], [f[1] for f in found]
            p = model.value.probability(batch) if model.value else np.zeros(batch.num_rows)
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "host": batch.column("host"),
                    "path": batch.column("path"),
                    "rule": pa.array(rule, pa.string()),
                    "verdict": pa.array([s or ("block" if x >= BLOCK else "allow") for s, x in zip(said, p, strict=True)], pa.string()),
                    "probability": pa.array(p, pa.float64()),
                }
            )

    return run


def _joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with the columns rule and said, by joins on hosts and the hosts above them."""
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = places.select("host").distinct().withColumn("at", F.explode(above))
    rules = rules.select(F.col("host").alias("at"), F.col("path").alias("start"), "verdict")
    near = materialize(hosts.join(rules, "at").select("host", F.concat("at", "start").alias("rule"), "start", "verdict"), "url-rules")
    fits = places.join(near.df, "host").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("top"))
    best = materialize(best.select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("said")), "url-best")
    near.drop()
    return urls.join(best.df, ["host", "path"], "left")


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: DataFrame, most_rules: int = MOST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) of each row of ``pages(page_id, url)``.

    ``labelled(url, blocked)`` trains the classifier; without rows of both classes it allows. ``rules(verdict, host,
    path)`` decide first: a rule fits its host and all subdomains where the path starts with the rule's; the longest
    wins, of the same rule with both verdicts block. Rules with a null or another verdict take no part. A null URL, or
    one without ``://``, has an empty host and path. Very long URLs are read whole. Rows repeat as they are in the
    input, null page_ids included. Other columns take no part. An empty table gives no rows.
    """
    spark = pages.sparkSession
    urls = with_parts(only(pages, page_id="long", url="string")).select("page_id", "host", "path")
    rules = only(rules, verdict="string", host="string", path="string").where("verdict in ('allow', 'block') and host is not null and path is not null").distinct()
    model = spark.sparkContext.broadcast(fit(labelled))  # 2 * SLOTS weights
    schema = "page_id long, host string, path string, rule string, verdict string, probability double"
    few = rules.limit(most_rules + 1).collect()
    if len(few) <= most_rules:
        return urls.mapInArrow(_judged(model, spark.sparkContext.broadcast(Rules([tuple(r) for r in few]))), schema)
    return _joined_rules(urls, rules).select("page_id", "host", "path", "rule", "said").mapInArrow(_judged(model, None), schema)
