"""Ties, very long texts and empty texts of the corpus operators."""

import collections
import re
import tracemalloc

import numpy as np

from verisieve.llm import decontam, licenses, mixing_lm, pii, quality


def test_equal_templates_go_to_the_first():
    twice = (("A", "Use of this file is licensed to members only under these terms."), ("B", "Use of this file is licensed to members only under these terms."))
    (row,) = licenses.Scanner(twice, 0.6).notices("Use of this file is licensed to members only under these terms.")
    assert row[0] == "A" and row[-1]


def test_entities_of_very_long_and_empty_texts(spark):
    line = "Write to bob.lee@example.com or 10.20.30.40 now. "
    rows = [(1, line * 20_000, 7), (2, "", 8), (3, None, 9), (4, line, 7), (5, line, 7)]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, kept int"), key=b"k", count="n").collect()}
    assert out[2].text == "" and out[3].text is None and out[1].n == 40_000 and out[2].n == 0
    mails = set(re.findall(r"\S+@\S+", out[1].text))
    assert len(mails) == 1 and "bob.lee" not in out[1].text and out[4].text == out[5].text and out[1].text.startswith(out[4].text)


def test_equal_texts_have_equal_scores(spark):
    rows = [(i, ("good plain words " * 5 if i % 2 else "!!! buy | now !!! ") + ("x" if i < 40 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, quality.fit_quality(docs, labels, holdout=False)).collect()}
    assert len({scores[i] for i in range(40, 80, 2)}) == 1 == len({scores[i] for i in range(41, 80, 2)})
    assert scores[41] > scores[40]


def test_a_very_long_text_is_scored_whole(spark):
    rows = [(1, "alpha beta gamma " * 200_000), (2, "alpha beta"), (3, "")]
    got = {r.doc_id: r for r in mixing_lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 600_001 and got[2].n_tokens == 3 and got[3].n_tokens == 1


def test_repeated_items_and_documents_all_match(spark):
    item = "the quick amber vessel crossed nine silent harbours before the northern winter storm arrived quietly"
    docs = spark.createDataFrame([(1, f"first {item} last"), (2, f"first {item} last"), (3, "nothing of it here at all, only other words that mean little")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def _search(items: list[str], texts: list[str], terms: int = 512, rank: int = 6, cosine: float = 0.6) -> decontam.LatentSearch:
    """Random term vectors in place of a fit; the three rarest words of an item by the texts are its answer."""
    vectors = np.random.default_rng(1).standard_normal((terms, rank)).astype(np.float32)
    vectors[:, 0] += 1
    hashes = [_hashes(t) for t in items]
    seen = collections.Counter(np.concatenate([_hashes(t) for t in texts]).tolist())
    rare = [np.array(sorted(set(h.tolist()), key=lambda w: (seen[w], w))[:3], np.uint64) for h in hashes]
    latent = np.array([vectors[decontam._terms(h, terms)].sum(0) for h in hashes])
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    lengths = np.array([len(h) for h in hashes])
    groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
    return decontam.LatentSearch(vectors, np.arange(len(items)), hashes, [np.unique(h) for h in hashes], rare, latent, lengths, groups, cosine, 0.6, 0.5)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return decontam.words(raw, np.array([0, len(raw)]), apart=decontam.APART)[2]


def test_search_finds_what_every_window_by_itself_finds(monkeypatch):
    r = np.random.default_rng(5)
    items = [" ".join(f"w{k}" for k in r.zipf(1.3, n) % 400) for n in (5, 9, 9, 23, 23, 40)]
    items.append(items[3])
    texts = [" ".join(f"w{k}" for k in r.zipf(1.3, n) % 400) for n in (0, 1, 3, 30, 700, 8, 2, 400) * 4]
    texts = [" ".join([t, items[i % 6], t]) if i % 2 else t for i, t in enumerate(texts)] + ["", items[5], items[3][:40]]
    search = _search(items, texts)
    want = {}
    for row, text in enumerate(texts):
        h = _hashes(text)
        x = search.term_vectors[decontam._terms(h, 512)].astype(np.float64)
        for length, of in search.groups:
            for j in range(max(0, -(-(len(h) - length) // max(1, length // 4))) + 1 if len(h) else 0):
                a = j * max(1, length // 4)
                b = min(a + length, len(h))
                v = x[a:b].sum(0)
                near = h[max(0, a - length // 2) : b + length // 2]
                for k in of:
                    cos = float(search.vectors[k] @ v / np.linalg.norm(v))
                    if cos >= 0.6 and np.isin(near, search.answers[k]).sum() >= 0.5 * len(search.answers[k]) and (got := search.check(near, k)) and got[0] > want.get((row, int(k)), (0,))[0]:
                        want[row, int(k)] = (got[0], got[1], max(0, a - length // 2) + got[2], max(0, a - length // 2) + got[3], cos)
    raw = [t.encode() for t in texts]
    for tile, near in ((decontam.TILE, decontam.NEAR), (1, 7)):
        monkeypatch.setattr(decontam, "TILE", tile)
        monkeypatch.setattr(decontam, "NEAR", near)
        rows = search.search(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got = {x[:2]: (*x[3:], x[2]) for x in rows}
        assert len(want) > 12 and {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
        assert all(abs(got[k][4] - want[k][4]) < 1e-5 for k in want)


def test_search_holds_no_latent_vector_for_each_word_of_a_text():
    items = [" ".join(f"w{k}" for k in range(a, a + 20)) for a in (0, 100)]
    text = "a b c d " * 50_000
    search = _search(items, [text], rank=48)
    raw = np.frombuffer((text + items[0]).encode(), np.uint8)
    tracemalloc.start()
    got = search.search(raw, np.array([0, len(raw)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in got] == [(0, 0)] and most < 200_000 * 48 * 8, most
