"""Ranked lexical search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from estatelens.llm import search
from estatelens.llm.queries import op11_ranked_search
from estatelens.llm.search import evaluate, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return Counter(TERM.findall((text or "").translate(LOW)))


def _ranking(docs, items, k=10):
    docs = [(i, _terms(t)) for i, t in docs]
    n, total = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in docs:
            m = 25 + 75 * c.total() * n // max(1, total)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in _terms(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert _got(op11_ranked_search(spark, sf)) == _ranking(docs, items)


ODD_DOCS = [(1, None), (2, ""), (3, " ,;\n"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (None, "alpha beta"), (None, None), (6, "ALPHA ÄPFEL äpfel gamma-gamma_gamma"), (7, "x" * 3000), (8, " ".join(f"w{i % 50} alpha" for i in range(20_000)))] + [(100 + i, "same tie text") for i in range(30)]
ODD_ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (1, "Äpfel gamma gamma"), (2, None), (3, "..."), (4, "unknown"), (None, "tie Same"), (5, "x" * 3000 + " w7 w7 w49"), (6, "alpha")]


@pytest.fixture
def odd(spark):
    docs = spark.createDataFrame([(i, t, 1, 2.0, "c") for i, t in ODD_DOCS], "doc_id long, text string, rank int, score double, item_id string").repartition(4)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in ODD_ITEMS], "item_id long, text string, doc_id int")


def test_odd_rows_ties_and_blocks(odd):
    want = _ranking(ODD_DOCS, ODD_ITEMS)
    assert _got(ranked_search(*odd)) == want
    assert _got(ranked_search(*odd, block=4)) == want  # several blocks of queries
    assert _got(ranked_search(*odd, k=3)) == _ranking(ODD_DOCS, ODD_ITEMS, 3)


def test_empty_tables(odd):
    docs, items = odd
    assert ranked_search(docs.where("false"), items).count() == 0
    assert ranked_search(docs, items.where("false")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    """The pieces of one long text give the postings of the whole; no term is cut."""
    import pyarrow as pa

    v = search.Vocabulary(["alpha", "beta", "a" * 500])
    text = " ".join(["alpha", "be-beta", "a" * 500, "gamma"] * 300)
    batch = pa.record_batch({"text": pa.array([text])})
    whole = search._occurrences(batch, v)
    monkeypatch.setattr(search, "PIECE", 100)
    for x, y in zip(whole, search._occurrences(batch, v), strict=True):
        assert (x == y).all()
    assert whole[3][0] == _terms(text).total()


def test_accumulators_stop_and_stay_exact():
    """Rows that late terms alone could add get no accumulator; all that can be among the best end exact."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        rows, n_terms, k = 200, 12, 5
        hits = [np.flatnonzero(rng.random(rows) < p) for p in np.linspace(0.02, 0.9, n_terms)]
        parts = [rng.integers(1, int(1000 / (j + 1) ** 2) + 2, len(h)) for j, h in enumerate(hits)]
        start = np.r_[0, np.cumsum([len(h) for h in hits])]
        most = np.array([p.max() if len(p) else 0 for p in parts])
        score = evaluate(np.arange(n_terms), np.ones(n_terms, np.int64), start, np.concatenate(hits), np.concatenate(parts), most, rows, k, 1)
        full = np.zeros(rows, np.int64)
        for h, p in zip(hits, parts, strict=True):
            full[h] += p
        goal = np.sort(full)[-k]
        assert (score[full >= goal] == full[full >= goal]).all() and (score[score > 0] == full[score > 0]).all()
        assert (score > 0).sum() < (full > 0).sum()
