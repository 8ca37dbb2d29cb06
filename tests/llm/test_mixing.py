from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.mixing import mix_sources, sainte_lague, shard_quotas
from tarnwork.llm.tokens import VOCABULARY, encoding, token_count

DOC = "doc_id long, source string, n_tokens long, shard string"
TARGET = "source string, target_share double, max_repeats int, note string"


def one_by_one(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        free = [i for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
        if not free:
            break
        got[max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 40)), min_size=1, max_size=7), st.integers(0, 90))
def test_apportionment_seat_by_seat(rows, seats):
    weights, caps = [float(w) for w, _ in rows], [c for _, c in rows]
    assert sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)


def test_known_result_and_large_numbers():
    assert sainte_lague([53000.0, 24000.0, 23000.0], 7) == [3, 2, 2]
    assert sum(sainte_lague([0.3, 0.7], 10**15)) == 10**15


def make(spark, shard_tokens, total=None):
    r = random.Random(1)
    docs = [(i, r.choice(["big"] * 8 + ["mid", "mid", "small", "other", None]), r.choice([0, 5, 30, 200]), "x") for i in range(3000)]
    targets = [("big", 0.5, 1, ""), ("mid", 0.3, 4, ""), ("small", 0.15, 1, ""), ("absent", 0.05, 3, "")]
    return docs, *mix_sources(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET), total, 64, shard_tokens)


@pytest.mark.parametrize("shard_tokens", [1 << 24, 20_000])
def test_shares_and_caps(spark, shard_tokens):
    docs, mixed, shares = make(spark, shard_tokens, 110_000)
    caps = {"big": 1, "mid": 4, "small": 1}
    rows = mixed.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(1 <= x.repeats <= caps[x.source] for x in rows)
    got = {x.source: x for x in shares.collect()}
    for s in caps:
        own = sum(n for _, k, n, _ in docs if k == s)
        assert got[s].available_tokens == own
        assert got[s].mixed_tokens == sum(x.n_tokens * x.repeats for x in rows if x.source == s)
    # small is at its cap; the others share the rest in proportion
    assert got["small"].mixed_tokens == got["small"].available_tokens and got["absent"].share == 0
    rest = 1 - got["small"].share
    assert got["big"].share == pytest.approx(rest * 0.5 / 0.8, abs=0.02) and got["mid"].share == pytest.approx(rest * 0.3 / 0.8, abs=0.02)


def test_shard_quotas_equal_the_apportionment_of_each_source(spark):
    r = random.Random(5)
    held, seats, want = [], [], {}
    for s in range(60):
        n = r.randrange(1, 40)
        tokens = [r.choice([1, 63, 64, 500, r.randrange(1, 20_000), r.randrange(1, 2_000_000)]) if s % 2 else r.randrange(9_000, 11_000) for _ in range(n)]
        c = r.randrange(1, 4)
        caps = [-(-t * c // 64) for t in tokens]
        b = min(sum(caps), round(sum(tokens) * c / 64 * r.choice([0.01, 0.3, 0.5, 0.9, 1.0])))
        held += [(f"s{s}", k, t, cap) for k, (t, cap) in enumerate(zip(tokens, caps))]
        seats.append((f"s{s}", b))
        want |= {(f"s{s}", k): q for k, q in enumerate(sainte_lague([float(t) for t in tokens], b, caps))}
    got = shard_quotas(spark.createDataFrame(held, "source string, shard int, tokens long, cap long"), spark.createDataFrame(seats, "source string, blocks long"))
    assert {(x.source, x.shard): x.blocks for x in got.collect()} == want


def test_same_seed_same_mixture_and_empty_tables(spark):
    a, b = (sorted(map(tuple, make(spark, 20_000)[1].collect())) for _ in range(2))
    assert a == b
    mixed, shares = mix_sources(spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 1, "")], TARGET))
    assert mixed.count() == 0 and [x.share for x in shares.collect()] == [0.0]
    mixed, shares = mix_sources(spark.createDataFrame([(1, "a", 5, "")], DOC), spark.createDataFrame([], TARGET))
    assert mixed.count() == shares.count() == 0


def test_token_count(spark):
    texts = ["", None, "The merge is partial.", "水位线 <|endoftext|>", "a" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    enc = encoding(VOCABULARY)
    assert [r[0] for r in df.select(token_count("text")).collect()] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
