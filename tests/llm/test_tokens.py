"""Encoding, counting, packing, neighbours, mixing and chat against brute force."""

import json
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pytest
from estatelens.llm import mixing
from estatelens.llm.ann import nearest
from estatelens.llm.chat import linked_messages, turns_as_calls
from estatelens.llm.counts import Counter, token_counts
from estatelens.llm.mixing import budget_factor, label_topics, mixed_sample, n_words, rake
from estatelens.llm.packing import Tokens, best_fit_decreasing, packed_tokens, unpacked
from estatelens.llm.pieces import Pieces
from estatelens.llm.sentencepiece import Encoder, decode, encode
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TEXTS = ["", None, "  two  spaces ", "tab\tand\nline\n\n", "é 日本語 💥 mixed", "a" * 300, "the of and thinnt hend", "same", "same"]


@pytest.fixture(scope="module")
def model():
    return Pieces.load()


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def _best(model, unit):
    """Best segmentation by recursion over the last piece; the earliest start wins ties."""

    @lru_cache(None)
    def till(end):
        if end == 0:
            return 0.0, ()
        top = None
        for start in range(max(0, end - 16), end):
            hit = model.match.get(unit[start:end])
            if hit is None and end - start == 1:
                hit = (-1, model.unknown_score)
            if hit:
                score, ids = till(start)
                if top is None or score + hit[1] > top[0]:
                    own = (hit[0],) if hit[0] >= 0 else tuple(model.unknown_ids(unit[start:end]))
                    top = (score + hit[1], ids + own)
        return top

    return list(till(len(unit))[1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="theandofing ▁éß\n💥日", max_size=24))
def test_encoder_is_the_best_segmentation(text):
    model = _model()
    flat, _ = _encoder().encode([text])
    want = [i for u in model.units(text) for i in _best(model, u)]
    assert flat.tolist() == want
    assert Counter(model).text(text) == len(want) if text else True


@lru_cache(None)
def _model():
    return Pieces.load()


@lru_cache(None)
def _encoder():
    return Encoder(_model())


def test_units_concatenate_to_the_text(model):
    for text in filter(None, TEXTS):
        assert "".join(model.units(text)) == "▁" + text.replace(" ", "▁")


def test_exhaustive_scores_on_short_words(model):
    """No segmentation has a higher sum than the one found."""
    for word in ("▁thend", "▁anden", "ingof"):
        ids = _best(model, word)
        best = sum(model.scores[i] for i in ids)
        for cuts in product([0, 1], repeat=len(word) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(p in model.match for p in parts):
                assert sum(model.match[p][1] for p in parts) <= best


def test_round_trip(spark, sf, small):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = encode(docs)
    assert out.where("not exact").count() == 0
    assert decode(out).exceptAll(docs).count() == 0
    got = decode(encode(small)).collect()
    assert sorted(str(r.text) for r in got) == sorted(t or "" for t in TEXTS)


def test_counts_are_encoding_lengths(spark, sf, small):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), small):
        a = sorted((str(r.doc_id), r.n) for r in encode(df).select("doc_id", F.size("ids").alias("n")).collect())
        assert a == sorted((str(r.doc_id), r.n_tokens) for r in token_counts(df).collect())


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 33, 300)]
    rows = best_fit_decreasing(lengths, 32)
    assert sorted(i for r in rows for i in r) == list(range(300))
    free: list[int] = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):  # the same rule by a plain scan
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(32 - lengths[i])
    assert sorted(32 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_packing_is_lossless(spark, sf):
    import base64

    import tiktoken
    from estatelens.llm.packing import PATTERN, RANKS

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, ""), (-2, None), (-3, " a  b\n\n c"), (-4, "x y " * 9000)], "doc_id long, text string"))
    packed = packed_tokens(docs, shard_bytes=60_000)
    rows = packed.collect()
    assert len({r.shard for r in rows}) > 3
    for r in rows:
        assert len(r.ids) == 2 * r.n_tokens <= 2 * 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.resets == r.cu_seqlens[:-1]
    back = defaultdict(list)
    for r in sorted(unpacked(packed).collect(), key=lambda r: (r.doc_id, r.offset)):
        assert r.offset == len(back[r.doc_id])
        back[r.doc_id] += r.ids
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert back[r.doc_id] == [*whole.encode_ordinary(r.text or ""), max(ranks.values()) + 1]
    assert Tokens(ranks).encode(["don't stop", "a\0b c"])[1].tolist() == whole.encode_ordinary("a\0b c")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert encode(empty).count() == token_counts(empty).count() == packed_tokens(empty).count() == 0
    assert mixed_sample(empty, label_topics(none), {"source": 0.5}).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert linked_messages(turns_as_calls(chats), {}).count() == 0


def _nearest(rows, k=20):
    best = defaultdict(dict)
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, v in ok:
        if i % 20 == 0:
            for j, w in ok:
                if j != i:
                    s = float((v * w).sum())
                    best[i][j] = max(s, best[i].get(j, -np.inf))
    return {i: sorted(d.items(), key=lambda x: (-x[1], x[0]))[:k] for i, d in best.items()}


def test_neighbours_of_odd_rows(spark):
    """Few rows: every candidate is found. Copies, ties, nulls, zero and broken vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(90)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 180)] + [(100, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0, 0, 0, 0]), (260, [float("nan")] * 6), (None, [1.0] * 6), (280, []), (40, [2.0] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in sorted(nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = _nearest(rows)
    assert {i: [(j, pytest.approx(s, abs=1e-12)) for j, s in v] for i, v in want.items()} == dict(got)


def _recall(x, ids, got):
    hit = n = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(g.vec_id))
        n += 20
    assert n
    return hit / n


def test_neighbour_recall(spark):
    """Vectors with hardly any neighbourhoods: the fitted search keeps the recall and opens fewer rows than a scan."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows, told = df.toPandas(), {}
    got = nearest(df, report=told).toPandas()
    assert _recall(np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy(), got) >= 0.9
    assert told["recall"] >= 0.95


def test_neighbour_search_is_short_where_vectors_have_neighbours(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(400, 24))[rng.integers(0, 400, 20_000)] + 0.25 * rng.normal(size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    told = {}
    got = nearest(df, every=100, report=told).toPandas()
    assert _recall(x.astype(float), np.arange(len(x)), got) >= 0.9
    assert told["vectors"] == len(x) and told["opened"] <= 0.5 * len(x)


def test_raking_meets_the_margins(spark):
    rng = np.random.default_rng(5)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    shares = {"source": [0.4, 0.3, 0.2, 0.1], "lang": [0.5, 0.25, 0.25], "topic": [0.7, 0.3]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{k}", s) for k, s in enumerate(v)], "value string, share double") for d, v in shares.items()}
    got = {(r.source, r.lang, r.topic): r.scale for r in rake(df, targets).collect()}
    a = np.array([t for *_, t in cells], float).reshape(4, 3, 2)
    total, w = a.sum(), a.copy()
    for _ in range(200):
        for axis, v in enumerate(shares.values()):
            other = tuple(x for x in range(3) if x != axis)
            shape = [-1 if x == axis else 1 for x in range(3)]
            w *= (np.array(v) * total / w.sum(axis=other)).reshape(shape)
    for (i, j, k, _), s in zip(cells, (w / a).ravel(), strict=True):
        assert got[i, j, k] == pytest.approx(s, rel=1e-4)


def test_raking_plans_stay_small(spark, monkeypatch):
    cells = spark.createDataFrame([(f"s{i}", f"l{i % 3}", f"t{i % 2}", 10 + i) for i in range(12)], "source string, lang string, topic string, tokens long")
    plans, write = [], mixing.materialize

    def keep(df, tag="stage", **more):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, tag, **more)

    monkeypatch.setattr(mixing, "materialize", keep)
    raked = rake(cells, {d: mixing.tempered(cells, d, 0.5) for d in mixing.DIMS})
    assert raked.columns == [*mixing.DIMS, "tokens", "scale"] and raked.count() == 12
    sweeps = [p for tag, p in plans if tag == "rake"]
    assert sweeps and all(p.count("Join ") <= 1 and p.count("Aggregate ") <= 1 for p in sweeps)


def test_mixed_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", "src0", "en"), (None, "a b", "src0", "xx")], "doc_id long, text string, source string, lang string")
    docs = docs.select("doc_id", "text", "source", "lang").union(odd)
    out = mixed_sample(docs, label_topics(labels), {"source": 0.5, "lang": 0.7, "topic": 0.8}).cache()
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(total / 2, rel=1e-3)
    assert sum(r.kept for r in rows) == pytest.approx(sum(r.probability for r in rows), rel=0.25)
    assert docs.select(F.sum(n_words(F.col("text")))).first()[0] == sum(len((r.text or "").split()) for r in docs.collect())
    cells = out.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.first("scale").alias("scale"))
    assert budget_factor(cells, 0.1) > 0


SCHEMAS = {"sum": {"a": {"type": "integer", "required": True}, "b": {"type": "number"}, "note": {"type": "string", "max_length": 3}}}
MESSAGES = [
    # conv, turn, role, content, kind, call_id, name, arguments, after
    (1, 0, "system", "hi", None, None, None, None, None),
    (1, 1, "assistant", None, "call", "x", "sum", '{"b":2.5,"a":1}', ["y"]),
    (1, 2, "assistant", None, "call", "y", "sum", '{"a":"1","z":0}', None),
    (1, 3, "tool", "3", "result", "y", None, None, None),
    (1, 4, "tool", "4", "result", "x", None, None, None),
    (1, 5, "tool", "again", "result", "x", None, None, None),
    (1, 6, "assistant", None, "call", "open", "none", "[1]", None),
    (1, 7, "tool", "?", "result", "gone", None, None, None),
    (2, 0, "assistant", None, "call", "p", "sum", '{"a":1,"note":"long"}', ["q"]),
    (2, 1, "assistant", None, "call", "q", "sum", "{broken", ["p"]),
    (2, 2, None, "é \"quoted\" \n", None, None, None, None, None),
    (None, None, "user", "lost", None, None, None, None, None),
    (1, 0, "system", "hi", None, None, None, None, None),
]


def test_chat_linking(spark):
    df = spark.createDataFrame(
        [(*m, "clash", 7) for m in MESSAGES],
        "conv_id long, turn long, role string, content string, kind string, call_id string, name string, arguments string, after array<string>, id string, level int",
    )
    rows = linked_messages(df, SCHEMAS).collect()
    by = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(MESSAGES) - 1
    assert [by[1, t].status for t in range(8)] == ["plain", "linked", "linked", "linked", "linked", "duplicate", "open", "orphan"]
    order = [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)]
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(1, 9))
    assert order.index(2) < order.index(3) < order.index(1) < order.index(4)
    assert by[1, 1].errors == [] and by[1, 2].errors == ["a is no integer", "unknown z"]
    assert by[1, 6].errors == ["arguments are no object"] and by[2, 0].errors == ["note is longer than 3"]
    assert by[2, 0].level is None and by[2, 1].level is None and by[2, 2].level == 0
    assert by[1, 1].json == '{"arguments":{"a":1,"b":2.5},"call_id":"x","name":"sum","role":"assistant","turn":1}'
    for r in rows:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_packing_with_a_second_vocabulary(spark, tmp_path):
    """A worker that has packed with one vocabulary packs with the next one's ids; too many ids are refused."""
    import base64

    docs = spark.createDataFrame([(1, "ab ba"), (2, "b")], "doc_id long, text string").coalesce(1)
    for shift in (0, 7):
        ranks = tmp_path / f"ranks{shift}"
        ranks.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % ((k + shift) % 256) for k in range(256)))
        ids = {r.doc_id: list(r.ids) for r in unpacked(packed_tokens(docs, str(ranks))).collect()}
        assert ids == {i: [(x + shift) % 256 for x in t.encode()] + [256] for i, t in ((1, "ab ba"), (2, "b"))}
    wide = tmp_path / "wide"
    wide.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" %d" % (k + 70_000) for k in range(256)))
    with pytest.raises(ValueError, match="two bytes"):
        packed_tokens(docs, str(wide))
