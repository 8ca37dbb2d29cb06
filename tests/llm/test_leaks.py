from __future__ import annotations

import random

import numpy as np
import pytest

from tarnwork.llm.leaks import SCALES, Embedding, Index, _matches, _Scale, _slices, edit_distance, edit_distances, find_leaks
from tarnwork.llm.words import word_ids, words

DOC = "doc_id long, text string, item_id string, share string"
ITEM = "item_id long, passage string, text string"


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(cur[-1] + 1, prev[j + 1] + 1, prev[j] + (x != y)))
        prev = cur
    return prev[-1]


def shared(doc, item):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    return len(runs(doc) & runs(item)) / len(runs(item)) if runs(item) else 0


def test_words():
    assert words("Ａ_b​c 石橋x9 Straße ﬁn") == ["a", "bc", "石", "橋", "x9", "strasse", "fin"]
    assert words(None) == words("") == words(" _ ") == []


def test_found_pairs_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["门", "卫"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([4, 5, 30, 60]))), "x") for i in range(20)] + [(98, None, "x"), (99, "", "x")]
    docs = []
    for d in range(200):
        t = say(r.randrange(0, 80))
        if d % 3 == 0:
            own = items[r.randrange(20)][1].split()
            part = own[r.randrange(len(own)) :] if d % 2 else own
            t += [w if r.random() > 0.06 else "zz" for w in part]
        docs.append((d, "  ".join(t).upper() if d % 5 == 0 else " ".join(t), "c", "c"))
    docs += [(500, None, "", ""), (501, "", "", ""), (502, " ".join(items[2][1] for _ in range(3000)), "", ""), (503, docs[0][1], "", "")]
    got = {(x.doc_id, x.item_id): x.share for x in find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    want = {(d[0], i[0]): shared(d[1] or "", i[1] or "") for d in docs for i in items}
    want = {k: s for k, s in want.items() if s >= 0.3 - 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    blocks = find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), block_words=300)
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == want.keys()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert find_leaks(none, spark.createDataFrame([(1, "a b c d e f", "")], ITEM)).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c d e f", "", "")], DOC), spark.createDataFrame([], ITEM)).count() == 0
    odd = find_leaks(spark.createDataFrame([(None, "a b c d e f", "", "")], DOC), spark.createDataFrame([(1, "a b c d e f", ""), (1, "a b c d e f", ""), (None, "a b c d e f", ""), (2, None, "")], ITEM))
    assert [(r.doc_id, r.item_id, r.share) for r in odd.collect()] == [(None, 1, 1.0)] * 2


@pytest.mark.parametrize("emb", [Embedding(width=12, max_edits=2, places=4, target_recall=0.95), Embedding(width=16, max_edits=3, places=4, target_recall=0.75)])
def test_recall_of_edited_windows_against_brute_force(emb):
    r, w = random.Random(8), emb.width
    items = [word_ids(" ".join(f"v{r.randrange(3000)}" for _ in range(w))) for i in range(150)]
    names = {int(t): n for n, t in enumerate(np.unique(np.concatenate(items)))}
    index = _Scale(items, emb)
    text = []
    for p in items:
        own = [str(names[int(t)]) for t in p]
        for _ in range(r.randrange(emb.max_edits + 1)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], ["new"], [own[k], "more"]])
        text += own + [f"n{r.randrange(3000)}" for _ in range(8)]
    back = {str(n): t for t, n in names.items()}
    tokens = np.concatenate([np.array([back[x]], np.uint64) if x in back else word_ids(x) for x in text])
    starts = np.arange(len(tokens) - w + 1)
    at, row = index.hits(tokens, starts)
    wins = tokens[starts[:, None] + np.arange(w)]
    want = {(s, k) for k in range(len(index.wins)) for s in np.flatnonzero(edit_distances(wins, np.tile(index.wins[k], (len(wins), 1))) <= emb.max_edits)}
    got = set(zip(at.tolist(), row.tolist()))
    assert got <= want and len(got) >= (emb.target_recall - 0.05) * len(want) > 100


def test_long_windows_alone_find_altered_passages():
    r = random.Random(2)
    items = [(i, " ".join(f"v{r.randrange(2000)}" for _ in range(r.randrange(38, 140)))) for i in range(100)]
    texts = []
    for _, p in items:
        own = p.split()
        lo = r.randrange(len(own) // 4)
        own = [x for x in own[lo : lo + 3 * len(own) // 4] for x in r.choices([[x], [], ["new"], [x, "more"]], [24, 1, 1, 1])[0]]
        texts.append(word_ids(" ".join(f"f{r.randrange(2000)}" for _ in range(50)) + " " + " ".join(own)))
    both = Index(items).find(texts)
    edits = Index(items, SCALES[:1]).find(texts)
    cases = {(d, k) for d, k, *_ in both}
    assert all(d == k for d, k in cases) and len(edits) >= 0.9 * len(cases) > 60 and {(d, k) for d, k, *_ in edits} == {(d, k) for d, k, *x in both if x[2]}


def test_runs_scattered_one_by_one_are_not_missed():
    item = [f"i{k}" for k in range(60)]
    text = [w for k in range(0, 60, 6) for w in [*item[k : k + 6], *(f"x{k}{j}" for j in range(20))]]
    got = _matches(Index([(1, " ".join(item))]), [7], [word_ids(" ".join(text))])
    assert [(g[0], g[1], g[2], g[3], g[5]) for g in got] == [(7, 1, 20, 56, False)]


def test_wording_of_all_items_makes_no_pairs():
    common = " ".join(f"c{k}" for k in range(10))
    items = [(i, " ".join(f"i{i}x{k}" for k in range(40)) + " " + common) for i in range(50)]
    index = Index(items, SCALES[1:])
    assert index.find([word_ids(common)]) == []
    assert index.scales[0].items.size <= 50 * (46 - 14 + 1)
    assert len(Index([(i, common) for i in range(50)]).find([word_ids(common)])) == 50


def test_slices():
    assert list(_slices(np.array([3, 3, 9, 1]), 5)) == [(0, 2), (2, 3), (3, 4)] and list(_slices(np.zeros(0, int), 5)) == []


def test_edit_distance():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randrange(0, 9))] for _ in range(2))
        assert edit_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == lev(a, b)
        a, b = ([r.randrange(4) for _ in range(7)] for _ in range(2))
        for most in (None, 0, 2, 5):
            got = int(edit_distances(np.array([a], np.uint64), np.array([b], np.uint64), most)[0])
            assert got == lev(a, b) or (most is not None and got > most < lev(a, b))


def test_a_passage_standing_twice_is_compared_with_a_whole_copy():
    item = " ".join(f"i{k}" for k in range(40))
    gap = " ".join(f"g{k}" for k in range(100))
    texts = [f"{gap} {item} {gap} {item} {gap}", " ".join([item] * 3000), f"{item} " + " ".join(f"i{k}" for k in range(10)) + f" {gap} i0 i1 i2 i3 i4 {gap}"]
    got = _matches(Index([(1, item)]), [1, 2, 3], [word_ids(t) for t in texts])
    assert [(g[0], g[-1]) for g in got] == [(1, 1.0), (2, 1.0), (3, 1.0)]
