"""URL filters: parts and rules against plain Python, the classifier on URLs held out."""

import random
import re

import pytest
from estatelens.llm.queries import op13_url_filter
from estatelens.llm.urls import RULES, fit, labelled_urls, rule_table, url_verdicts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOW), m[2]) if m else ("", "")


def _rule(host, path, rules):
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: (len(r[0]), r[1] == "block", r[0]), default=None)


ODD = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.ORG", "http://example.org/es/1?x", "http://a.b.Example.org/en/12#t", "http://org/x", "http://xorg/y", "http://org", "http://org?/x", "x://y.com/fr/a://z", "http://com/de/", "http://de.com/de/ü/é", "http://ÄÖ.com/fr/\nline", "http://.org/", "http://a..org/", "http://org./", "http://h.net/" + "p" * 200_000]


@pytest.fixture
def odd(spark):
    rows = [(i % 7 or None, u, "clash", 0.5, "clash") for i, u in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, probability double, rule string").repartition(3)


@pytest.mark.parametrize("most", [10_000, 2])
def test_odd_urls(spark, odd, most):
    """Rules sent to the tasks, and rules joined with the hosts."""
    rules = RULES + [("block", "b.example.org", "/en/"), ("allow", "b.example.org", "/en/"), ("block", "", "")]
    table = spark.createDataFrame(rules + [(None, "a", "/"), ("deny", "a", "/"), ("allow", None, "/")], "verdict string, host string, path string")
    got = url_verdicts(odd, labelled_urls(spark), table, most).collect()
    want = sorted((str(i % 7 or None), *_parts(u), str(_rule(*_parts(u), rules))) for i, u in enumerate(ODD * 2))
    assert sorted((str(r.page_id), r.host, r.path, str((r.rule, r.verdict) if r.rule is not None else None)) for r in got) == want
    assert all(r.verdict == ("block" if r.probability >= 0.5 else "allow") for r in got if r.rule is None)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in op13_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r, (host, path) = got[p.page_id], _parts(p.url)
        rule = _rule(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert not rule or r.verdict == rule[1]


def test_classifier_on_urls_held_out(spark):
    rng = random.Random(1)
    words = ["harbour", "meadow", "violin", "granite", "lantern", "orchard", "saddle", "teapot", "anchor", "bridge"]
    bad, place = ["mega-casino", "casino-fun", "daily-bets", "pills-cheap", "spam-offers", "adult-zone", "ads-tracker"], ["net", "com", "info"]
    url = lambda name: f"https://{rng.choice(['www.', 'm.', ''])}{name}.example.{rng.choice(place)}/{rng.choice(['en', 'fr'])}/{rng.randint(1, 9999)}"
    rows = [(i, url(rng.choice(bad if i % 2 else words)) if i % 4 else url(rng.choice(bad if i % 2 else words)) + ".html") for i in range(400)]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), labelled_urls(spark), rule_table(spark)).collect()
    got = [r for r in got if r.rule is None]
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert len(got) > 200 and right >= 0.9 * len(got)


def test_missing_class_and_empty_tables(spark, odd):
    one = labelled_urls(spark).where("blocked = 1")
    assert fit(one) is None
    got = url_verdicts(odd, one, rule_table(spark).where("false")).collect()
    assert len(got) == 2 * len(ODD) and {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}
    assert url_verdicts(odd.where("false"), labelled_urls(spark), rule_table(spark)).count() == 0


def test_fit_takes_conflicts_and_nulls(spark):
    rows = [("http://a.example.net/", 1), ("http://a.example.net/", 0), (None, 1), ("http://b.example.net/", None), ("http://c.example.net/", 0)]
    assert fit(spark.createDataFrame(rows, "url string, blocked int")) is not None
