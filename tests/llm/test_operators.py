"""Corpus operators against plain code on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import difflib
import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pytest

from verisieve.llm import capjoin, chat, dartminhash, decontam, domainmix, licenses, mixing_lm, pii, quality, suffixes

DOCS = "doc_id long, text string, lang string, score double, t long, kept boolean"
rng = np.random.default_rng(4)
VOCAB = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def corpus():
    long_ = prose(6000, 1)
    near = prose(200, 2)
    rows = [(i, prose(60 + i, 10 + i)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "   "), (23, "one"), (24, long_), (25, near), (26, near), (27, near.replace(near.split()[50], "zzzzz", 1)), (27, near)]
    rows += [(28, prose(40, 3) + " " + near[100:500]), (29, "same same same " * 200), (30, "Ünïcode " * 40), (None, "no id here")]
    return [(i, t, "en", 0.5, 7, True) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats(docs, most):
    raw = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i or -1, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    got = suffixes.remove_repeats(docs, most=most).collect()
    assert sorted((r.doc_id or -1 if r.doc_id != 0 else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((-1 if i == 0 else i, *r) for i, *r in want)


def marks_apart(n):
    """Two rows of n marks that a polynomial hash modulo 2**64 takes for one another."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["ab"[b] for b in bits], ["ba"[b] for b in bits]


def test_regular_texts_are_told_apart(spark):
    fill = "".join(chr(0x4E00 + i) for i in range(4096))
    x, y = ("".join(m + fill[3 * i % 4000 : 3 * i % 4000 + 3] if i % 4 == 0 else m for i, m in enumerate(row)) for row in marks_apart(4096))
    x, y = x.replace("a", "q1").replace("b", "q2"), y.replace("a", "q1").replace("b", "q2")
    rows = [(1, x), (2, y)]
    raw = [t.encode() for _, t in rows]
    seen = collections.Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert got[i].n_removed == gone.sum()
    words_ = [" ".join(m if i % 2 else f"w{i}" for i, m in enumerate(row)) for row in marks_apart(4096)]
    long_words = ["".join(row) for row in marks_apart(4096)]
    rows = spark.createDataFrame(list(enumerate([*words_, *long_words])), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dartminhash.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_passages_of_one_hash_are_settled_by_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "span_hash", lambda code, a, b: np.zeros(len(a), np.uint64))
    buf = np.frombuffer(b"abcdabcdefgh", np.uint8)
    got = suffixes.equal_passages(buf, np.array([0, 4, 8, 1, 4]), np.array([0, 0, 0, 0, 1]), 4)
    assert got.tolist() == [True, True, False, False, False]


def shingle_counts(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_against_all_pairs(spark, block):
    r = np.random.default_rng(12)
    texts = []
    for k in range(60):
        base = prose(int(r.integers(60, 160)), 3000 + k).split()
        for _ in range(int(r.integers(1, 6))):
            w = list(base)
            for _ in range(int(r.integers(0, 3))):
                w[r.integers(len(w))] = VOCAB[r.integers(300)]
            texts.append(" ".join(w + w[-int(r.integers(1, 9)) :] * int(r.integers(0, 3))))
    texts += [" ".join(prose(40, 77).split()[:20] + prose(60, 4000 + i).split()) for i in range(40)]  # one passage in all
    sets = [shingle_counts(t) for t in texts]
    label = list(range(len(texts)))
    least = 0
    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            least += both >= 0.8 * (sets[i].total() + sets[j].total() - both)
            if both >= 0.8 * (sets[i].total() + sets[j].total() - both) and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    got = {x.doc_id: x.class_id for x in dartminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), block=block).collect()}
    assert least > 60 and [got[i] for i in range(len(texts))] == label


def test_near_duplicates_of_null_ids(spark):
    rows = [(None, prose(60, 71)), (None, prose(60, 72)), (None, prose(60, 73)), (4, prose(60, 73)), (4, prose(60, 74)), (9, prose(60, 74)), (None, None), (3, "")]
    got = dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 3, False), (0, 4, False), (3, 3, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs).collect()}
    assert got[26] == got[25] == got[27] == 25
    assert got[20] == got[21] == got[22] == 20
    assert got[28] == 28 and got[24] == 24
    kept = dartminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect() if r.doc_id > 22) == [23, 24, 25, 28, 29, 30]


def test_near_duplicates_decide_by_row(spark):
    near = prose(200, 2)
    rows = [(None, prose(60, 71)), (None, prose(60, 72)), (None, near), (7, near), (9, prose(60, 73)), (9, near), (9, prose(60, 74)), (9, prose(60, 74))]
    kept = [(r.doc_id, r.text) for r in dartminhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([rows[i] for i in (0, 1, 3, 4, 6)], key=str)


def test_dart_signatures_estimate_similarity():
    a = np.random.default_rng(0).integers(0, 2**63, 100, dtype=np.uint64)
    w = np.concatenate([np.ones(100), np.full(100, 3.0)])
    s = dartminhash.signatures(np.concatenate([a, a]), w, np.array([0, 100, 200]), 2000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.05


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    rows = [(i, (base[i % 20] + 0.05 * r.standard_normal(16)).tolist(), i % 2) for i in range(80)]
    rows += [(100, base[0].tolist(), 0), (101, base[0].tolist(), 0), (102, [0.0] * 16, 0), (103, None, 0), (104, [float("nan")] * 16, 0), (105, base[0].tolist(), None), (106, [], 0), (107, [None] * 16, 0)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in capjoin.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=8).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: {j for j, y, d in ok if j != i and d == c and x @ y >= 0.98} for i, x, c in ok}
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert got[i] == (len(near.get(i, ())), min(reach), i == min(reach)), i


def test_no_pair_of_vectors_is_lost(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((10_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal(x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.9801 * x + math.sqrt(1 - 0.9801**2) * y])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {v.vec_id: v.n_links for v in capjoin.link_vectors(rows).collect()}
    assert want.min() >= 1 and [got[i] for i in range(len(both))] == want.tolist()


def test_scores(docs):
    got = mixing_lm.score_corpus(docs).collect()
    toks = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]) for i, t, *_ in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for _, t in toks)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def plain_tokens(text):
    """(hash, ending bytes) of each word and of the end, one word at a time."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        buf = np.frombuffer(w, np.uint8)
        low = w.lower()
        out.append((int(mixing_lm.words(buf, np.array([0, len(w)]))[2][0]), low[-1] * 31 + low[max(-2, -len(low))]))
    return [*out, (int(mixing_lm.END), 0)]


def plain_contexts(toks, i, frequent):
    """Table places of the token's contexts, and the word that the match model expects."""
    u = lambda x: np.array([x & (2**64 - 1)], np.uint64)
    one = toks[i - 1][0] if i else 0
    two = toks[i - 2][0] if i > 1 else 0
    known = [j for j in range(i) if toks[j][0] in frequent]
    topic = frequent.index(toks[known[-1]][0]) + 1 if known else 0
    fold = lambda x: int(mixing_lm.mix(x)[0]) >> 52
    ending = toks[i - 1][1] if i else 0
    numbers = [0, fold(u(one)), fold(u(int(mixing_lm.mix(u(one))[0]) + two)), (ending * 2654435761 % 2**32) >> 24, topic]
    seen = [j for j in range(1, i) if toks[j - 1][0] == one] if i else []
    return [int(s) + (n << mixing_lm.DEPTH) for s, n in zip(mixing_lm.STARTS, numbers)], toks[seen[-1]][0] if seen else None


def plain_passages(toks):
    """The runs of token places that the tokens are cut into."""
    mix = lambda x: int(mixing_lm.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    out, run = [], []
    for i, (h, _) in enumerate(toks):
        run.append(i)
        if i + 1 == len(toks) or mix(h + mix(toks[i - 1][0] if i else 0)) >> 61 == 0:
            out.append(run)
            run = []
    return out


@pytest.mark.parametrize("top", [1 << 17, 8])  # all words and passages looked up in the task, and most of them by joins
def test_score_against_a_plain_mixer(spark, monkeypatch, top):
    monkeypatch.setattr(mixing_lm, "TOP", top)
    texts = [prose(int(n), 50 + i) + " " + " ".join(prose(12, 5).split() * 2) for i, n in enumerate(np.random.default_rng(1).integers(5, 60, 40))] + ["", None, "Ünï cöde ünï cöde"]
    docs = spark.createDataFrame([(i, t, i % 5 == 1) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    model = mixing_lm.fit_mixer(docs.where("not held_out"))
    frequent, depth = model.frequent.tolist(), mixing_lm.DEPTH
    train = [plain_tokens(t) for i, t in enumerate(texts) if i % 5 != 1]
    leaves = collections.Counter()
    for toks in train:
        for i, (h, _) in enumerate(toks):
            for at in plain_contexts(toks, i, frequent)[0]:
                leaves[at | h >> 64 - depth] += 1
    nodes = collections.Counter()
    for leaf, c in leaves.items():
        for d in range(depth):
            lead = leaf & (1 << depth) - 1
            nodes[leaf - lead | 1 << d | lead >> depth - d, lead >> depth - 1 - d & 1] += c
    c = collections.Counter(h for toks in train for h, _ in toks)
    n, v = sum(c.values()), len(c)
    buckets = collections.Counter()
    for h, k in c.items():
        buckets[h >> 64 - depth] += k + 0.5
    text_of = lambda toks, run: tuple(toks[i][0] for i in run)
    memory = collections.Counter(text_of(toks, run) for toks in train for run in plain_passages(toks) if len(run) >= mixing_lm.LEAST)
    whole = sum(memory.values())
    share = (sum(k for k in memory.values() if k > 1) + 1) / (whole + 100)
    assert model.passages == whole and abs(model.from_memory - share) < 1e-12 and share > 0.05
    listed = set(model.top[0].tolist())
    got = {r.doc_id: r for r in mixing_lm.score_documents(docs, model).collect()}
    assert len(got) == len(texts)
    for row, t in enumerate(texts):
        toks, want, spelled = plain_tokens(t), 0.0, []
        for i, (h, _) in enumerate(toks):
            places, expected = plain_contexts(toks, i, frequent)
            for d in range(depth):
                prefix, bit = h >> 64 - d if d else 0, h >> 63 - d & 1
                x = [round(1024 * math.log((nodes[p | 1 << d | prefix, 1] + 0.4) / (nodes[p | 1 << d | prefix, 0] + 0.4))) / 1024 for p in places]
                match = 0 if expected is None or (expected >> 64 - d if d else 0) != prefix else 1 if expected >> 63 - d & 1 else -1
                w = model.weights[d, int(match != 0)]
                z = float(np.dot([*x, match, 1], w))
                p = (1 / (1 + math.exp(-max(-12, min(12, z)))) + model.map[d, int(match != 0), int(min(32, max(0, round(z * 2 + 16))))]) / 2
                want += math.log10(p if bit else 1 - p)
            want += math.log10(c[h] + 0.5) - math.log10(buckets[h >> 64 - depth] + 0.5)
            spelled.append(want)
            want = 0.0
        groups = collections.defaultdict(list)
        for run in plain_passages(toks):
            cost = sum(spelled[i] for i in run) + math.log10(1 - share)
            if len(run) < mixing_lm.LEAST:
                want += cost
            else:
                groups[text_of(toks, run)].append(cost)
        own = 0 if row % 5 == 1 else 1
        left = whole - own * sum(map(len, groups.values()))
        for text, costs in groups.items():
            others = memory[text] - own * len(costs)
            if others > 0:
                taken = math.log10(share * others / left)
                want += len(costs) * (max(taken, sum(costs) / len(costs)) if listed.issuperset(text) else taken)
            else:
                want += sum(costs)
        assert abs(got[row].score - want) < 0.02 * (1 + len(toks) ** 0.5), (row, got[row].score, want)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95  # the model knows the texts better


def test_copies_are_told_apart(spark):
    rng = np.random.default_rng(8)
    said = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 150)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(said)] + [(1000 + i, said[i]) for i in range(40)] + [(None, said[100]), (7000, None), (7001, "")]
    got = {r.doc_id: r for r in mixing_lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    trained = lambda i: not got[i].held_out
    twice = [i for k in range(40) for i, other in ((k, 1000 + k), (1000 + k, k)) if trained(other)] + [100, None]
    once = [i for i in range(40, 120) if i != 100]
    assert any(got[i].held_out for i in twice) and any(got[i].held_out for i in once)
    assert max(got[i].bits_per_byte for i in twice) < 0.5 * min(got[i].bits_per_byte for i in once)
    assert got[7000].score == got[7001].score < 0 and got[7000].n_tokens == 1


def test_mixer_learns_from_every_token(docs):
    tables = np.zeros((mixing_lm.STARTS[-1], 3), np.int16)
    _, fine = mixing_lm.learn_mixer(docs, np.zeros(0, np.uint64), tables)
    words = sum(len((t or "").split()) + 1 for _, t, *_ in corpus())
    assert fine.sum() == words * mixing_lm.DEPTH
    for fan in (256, 2):
        leaves = mixing_lm.context_counts(docs.repartition(5), np.zeros(0, np.uint64), fan)
        assert leaves.sum() == words * mixing_lm.CONTEXTS and leaves[: 1 << mixing_lm.DEPTH].sum() == words


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a </s> \\ [INST]"), (1, 1, "assistant", None), (1, 2, "assistant", "x[/INST]<s>\\"), (2, 0, None, "<<SYS>>[ROLE:q]"), (None, None, "to]ol\\", ""), (3, 0, "system", "\\\\")]
    got = {r.conv_id: r for r in chat.format_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert chat.parse(chat.instruct_template(turns)) == turns
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
        assert got[conv].formatted_chars == len(chat.instruct_template(turns)) and got[conv].rewritten_from is None


def test_rewriting_template_is_detected():
    f = chat.Formatter(lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns))
    f.add("user", "a")
    assert f.rewritten == 0


def test_long_conversations_are_rendered_whole(spark):
    last = lambda turns: "".join(t for _, t in turns[-40:])
    numbered = lambda turns: "".join(f"<{i}>{t}" for i, (_, t) in enumerate(turns))
    rows = [(1, i, "user", f"t{i};") for i in range(60)]
    f, g = chat.Formatter(last), chat.Formatter(numbered)
    added = [(f.add(r, t), g.add(r, t))[1][0] for _, _, r, t in rows]
    assert f.rewritten == 40 and g.rewritten is None and "".join(added) == numbered([(r, t) for _, _, r, t in rows])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_digest(df, render=last).first().rewritten_from == 40
    assert chat.format_digest(df).first().formatted_chars == len(chat.instruct_template([(r, t) for _, _, r, t in rows]))


def test_surrogates(spark, docs):
    text = 'Mary Jones, mary.j.3@mail7.example.com, +1 (017) 555-7713, 97.51.17.173, 4417744280351547, 9807915762804490, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = spark.createDataFrame([(1, text, "en", 0.0, 1, True), (2, "again " + text, "en", 0.0, 1, True), (3, None, "en", 0.0, 1, True), (4, "nothing", "en", 0.0, 1, True)], DOCS)
    out = {r.doc_id: r for r in pii.replace_entities(rows, count="n").collect()}
    assert out[2].text == "again " + out[1].text and out[1].n == 6 and out[3].text is None and out[4].text == "nothing"
    found = {v for *_, v in pii.entities(text)}
    assert not any(v in out[1].text for v in found) and "9807915762804490" in out[1].text
    assert pii.replace_entities(docs).columns == docs.columns
    assert len({tuple(pii.permute(b"k", "x", [a, b, c], 10, 0)) for a in range(10) for b in range(10) for c in range(10)}) == 1000


def test_parts_of_names_corefer(spark):
    rows = [(1, "Mary Jones met John Jones. Jones laughed and Mary left. Dr. Strange came.", "u", 1), (2, "Jones alone. The strange case of Strange.", "u", 1), (3, "Анна Петрова и Иван Петрова; ΣOΦIA. Σοφία Παππά", "u", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, tweaks int")
    out = {r.doc_id: r for r in pii.replace_entities(df, key=b"k", count="n", most_sent=0).collect()}
    new = out[1].text
    mary, jones = re.match(r"(\w+) (\w+) met", new).groups()
    assert new == f"{mary} {jones} met {pii.given_name(b'k', 'John')} {jones}. {jones} laughed and {mary} left. Dr. {re.search(r'Dr. (.*) came', new)[1]} came."
    assert "Jones" not in new and "Strange" not in new and pii._gender[mary] == ("latin", "f") and out[1].n == 5
    assert out[2].text == rows[1][1] and out[1].text_hash == "u" and out[1].tweaks == 1
    a, b = re.match(r"(\w+ \w+) и (\w+ \w+);", out[3].text).groups()
    assert a.split()[1] == b.split()[1] != "Петрова" and pii.script_of(a.split()[1]) == "cyrillic" and pii._gender[b.split()[0]] == ("cyrillic", "m")
    again = {r.doc_id: r.text for r in pii.replace_entities(df, key=b"k").collect()}
    other = {r.doc_id: r.text for r in pii.replace_entities(df).collect()}
    assert again[1] == new and other[1] != new


@pytest.mark.parametrize("most_sent", [10_000, 0])
def test_replacements_that_collide_are_drawn_again(spark, monkeypatch, most_sent):
    plain = pii.surrogate
    same = lambda key, kind, value, tweak=0: plain(key, kind, value, tweak) if kind != "ip" else f"10.0.0.{tweak}"
    monkeypatch.setattr(pii, "surrogate", same)
    rows = spark.createDataFrame([(1, "from 1.2.3.4 to 1.2.3.5"), (2, "1.2.3.6 or 10.0.0.1"), (3, "1.2.3.4")], "doc_id long, text string").coalesce(1)
    taken = pii.collisions(rows, b"k").collect()
    assert len(taken) == len({r.tweak for r in taken}) == 3 and 1 not in {r.tweak for r in taken}
    got = {r.doc_id: re.findall(r"[\d.]+", r.text) for r in pii.replace_entities(rows, key=b"k", most_sent=most_sent).collect()}
    assert len({*got[1], *got[2]}) == 4 and got[3] == got[1][:1] and "10.0.0.1" not in sum(got.values(), [])


def test_surrogates_keep_formats():
    iban = next(v for d in range(100) if pii.iban_rest(v := f"DE{d:02d}500105175407324931") == 1)
    for kind, value in (("ssn", "123456789"), ("iban", iban), ("card", "4417744280351547"), ("phone", "10175557713"), ("ip", "10.2.3.4"), ("email", "a.b7@x.org"), ("secret", "AKIA1234abcd"), ("word", "JONES")):
        new = pii.surrogate(b"k", kind, value)
        assert new != value and new == pii.surrogate(b"k", kind, value) != pii.surrogate(b"q", kind, value)
        assert pii.normal(kind, new) == new or kind in ("secret", "word")
        if kind not in ("email", "word", "ip"):
            assert [c.isdigit() for c in new] == [c.isdigit() for c in value] and len(new) == len(value)
    assert pii.spell("ssn", "123-45-6789", "987654321") == "987-65-4321" and pii.surrogate(b"k", "word", "JONES").isupper()
    texts = {f"{i:09d}" for i in range(3000)}
    assert len({pii.surrogate(b"k", "ssn", t) for t in texts}) == 3000
    for names in pii.GIVEN.values():
        assert {pii.given_name(b"k", n) for n in names} == set(names) and all(pii.given_name(b"k", n) != n for n in names)


def test_licenses_against_plain_comparison(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(80):
        name, text = licenses.TEMPLATES[int(r.integers(len(licenses.TEMPLATES)))]
        w = text.split()
        for _ in range(int(r.integers(0, 1 + len(w) // 12))):
            w[int(r.integers(len(w)))] = "changed"
        rows.append((i, prose(20, i) + ". " + " ".join(w) + " " + prose(20, 100 + i)))
    rows += [(90, ""), (91, None), (92, "copyright: all rights to vote are a public domain matter"), (93, "as is " * 30_000), (94, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")]
    got = collections.defaultdict(set)
    for x in licenses.scan_licenses(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, license string")).collect():
        got[x.doc_id].add(x.license)
    assert got[94] == {"MIT", "Apache-2.0"} and not got[92] and not got[93]
    unique = {}
    for name, t in licenses.TEMPLATES:
        others = {w for n, o in licenses.TEMPLATES if n != name for w in licenses.vocabulary(o)}
        unique[t] = set(licenses.vocabulary(t)) - others if len(licenses.vocabulary(t)) < licenses.SHORT else set()
    for i, t in rows[:80]:
        said = licenses.vocabulary(t)
        found = []
        for name, wording in licenses.TEMPLATES:  # the most agreeing words of the stretch from the first to the last
            w = licenses.vocabulary(wording)
            m = [b for b in difflib.SequenceMatcher(None, w, said, autojunk=False).get_matching_blocks() if b.size > 1]
            agreed = sum(b.size for b in m)
            if m and agreed >= 0.8 * len(w) and agreed >= 0.8 * (m[-1].b + m[-1].size - m[0].b) and unique[wording] <= set(said):
                miss = len(w) + m[-1].b + m[-1].size - m[0].b - 3 * agreed
                found.append((miss, name))
        best = {n for m, n in found if m == min(found)[0]}
        assert not best or best & got[i], (i, t, best, got[i])


def test_leaks_against_all_windows(spark):
    r = np.random.default_rng(3)
    items = [(k, prose(int(r.integers(15, 60)), 9000 + k)) for k in range(12)] + [(12, None), (13, "")]
    items.append((20, items[0][1]))
    rows = []
    for i in range(90):
        w = items[int(r.integers(12))][1].split()
        for _ in range(int(r.integers(0, len(w) // 4))):
            w[int(r.integers(len(w)))] = VOCAB[r.integers(300)]
        w = w if i % 3 else w[: len(w) // 2]
        rows.append((i, prose(int(r.integers(0, 120)), 7000 + i) + " " + " ".join(w) + " " + prose(int(r.integers(0, 120)), 8000 + i)))
    rows += [(None, None), (200, ""), (201, prose(20_000, 77) + " " + items[3][1]), (0, rows[0][1])]
    own = {k: (t or "").split() for k, t in items if t}
    df = collections.Counter(w for _, t in rows if t for w in set(t.split()))
    want, clear = set(), set()
    for i, t in rows:
        said = (t or "").split()
        for k, w in own.items():
            at = [j for j, x in enumerate(said) if x in set(w)]
            n = len(w)
            best = max((decontam.longest_common(w, said[a : a + 2 * n]) / n for a in at[:: max(1, n // 8)]), default=0) if len(said) < 5000 or i == 201 and k in (3, 5) else 0
            if best >= 0.8:
                want.add((i, k))
            if best >= 0.45:
                clear.add((i, k))
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, cosine double"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 40 and len(want & got) >= 0.95 * len(want) and len(got - clear) <= 0.02 * len(got), (sorted(want - got), sorted(got - clear))
    assert {(0, 0), (0, 20)} <= got or (0, 0) not in got


def test_matched_span_is_tight():
    assert decontam.shortest_prefix(list("abc"), list("xaybzcabc"), 3) == 6
    assert decontam.shortest_prefix(list("abc"), list("aabbcc"), 2) == 3


def test_licenses(spark):
    rows = [(1, "words\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, None), (4, "the licence plate as is")]
    got = {r.doc_id: (r.license, r.exact) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", True), 2: ("GPL-2.0", True)}


def test_search_passes_over_nothing_that_it_finds(spark):
    iban = next(v for d in range(100) if pii.iban_rest(v := f"NL{d:02d}ABCDEFGHJKLMNOPQ") == 1)
    texts = ["(Mary Jones)", '"Mary Jones said', "\u201cMary Jones\u201d", "\u00d7Mary Jones", "/Анна Петрова/", "-José Silva", iban, "\u0661.\u0662.\u0663.\u0664 is an address"]
    texts = [t for t in texts if pii.entities(t)]
    assert len(texts) >= 6
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(rows, count="n").collect()}
    assert all(got[i].n == 1 and pii.entities(t)[0][3] not in got[i].text for i, t in enumerate(texts))


def test_wrapped_and_adjacent_licenses(spark):
    wording = {}
    for name, text in licenses.TEMPLATES:
        wording[name] = max(wording.get(name, ""), text, key=len)
    rows = [(i, "before it\n\n" + "\n".join(textwrap.wrap(wording[n], w)) + "\n\nand after it") for i, (n, w) in enumerate([("MIT", 80), ("BSD-3-Clause", 80), ("MIT", 40), ("GPL-3.0", 60)])]
    rows.append((9, "Licensed under CC BY 4.0.\nThis work is licensed under the GNU General Public License, version 2."))
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.license, r.exact))
    assert got == {0: [("MIT", True)], 1: [("BSD-3-Clause", True)], 2: [("MIT", True)], 3: [("GPL-3.0", True)], 9: [("CC-BY-4.0", True), ("GPL-2.0", True)]}


def test_leaks(spark, docs):
    item = prose(40, 99)
    changed = " ".join(w if i % 9 else "qqqq" for i, w in enumerate(item.split()))
    rows = spark.createDataFrame([*corpus(), (50, prose(100, 5) + " " + item + " " + prose(300, 6), "en", 0.0, 1, True), (51, prose(30, 7) + " " + changed.upper(), "en", 0.0, 1, True)], DOCS)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows, bench).collect()} == {(50, 1), (51, 1)}
    assert decontam.drop_leaks(rows, bench).count() == len(corpus())


def test_quality_and_mixture(spark):
    rows, labels = [], []
    for i in range(200):
        t = prose(80, i) if i % 2 else " ".join(w + "###" for w in prose(80, i).split())
        rows.append((i, t + (" idiot moron" if i % 8 < 2 else ""), "en", 0.5, 7, True))
        labels.append((i, i % 2, int(i % 8 < 2)))
    d, l = spark.createDataFrame([*rows, (900, None, "en", 0.0, 1, True)], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(d, l)
    got = {r.doc_id: r.score for r in quality.score_documents(d, model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert quality.filter_documents(d, model).columns == d.columns
    rate = {r.doc_id: r.rate for r in domainmix.mix_documents(d, l).collect()}
    assert all((rate[i] < 0.1) == (i % 8 < 2) for i in range(200))


def test_rates_meet_the_optimality_conditions():
    r = np.random.default_rng(2)
    n, p = r.integers(0, 400, 60).astype(float), r.dirichlet(np.ones(4) * 0.3, 60)
    for keep in ((1, 0, 1, 0), (0.3, 0.3, 0.3, 0.3), (2.5, 0, 0, 0.1)):
        rate, totals = domainmix.fit_rates(n, p, keep)
        target = np.array(keep) * (n @ p)
        metric = np.linalg.inv((n[:, None] * p).T @ p / n.sum() + 1e-4 * np.eye(4))
        slope = n * (p @ (metric @ (((n * rate) @ p - target) / n.sum())) + 0.01 * (rate - 1))
        assert (rate >= 0).all() and np.abs(slope[rate > 0]).max() < 1e-2 and slope[rate == 0].min(initial=0) > -1e-2
        assert np.allclose([t for t, _ in totals.values()], target) and np.allclose([f for _, f in totals.values()], (n * rate) @ p)
    with pytest.raises(domainmix.FitError):
        domainmix.fit_rates(n, p, (2.5, 0, 0, 0.1), steps=2)


def labelled_corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        t = prose(80, i) if i % 2 else " ".join(w + "###" for w in prose(80, i).split())
        rows.append((i, t + (" idiot moron" if i % 8 < 2 else "")))
        labels.append((i, i % 2, int(i % 8 < 2)))
    return rows, labels


def test_mixture_samples_by_rate(spark):
    rows, labels = labelled_corpus()
    d = spark.createDataFrame([(*r, 1, 2.0, 3, "n") for r in rows + rows[:3] + [(None, None), (None, "")]], "doc_id long, text string, _n long, rate double, copies int, n_tokens string")
    l = spark.createDataFrame([*labels, (0, 0, 1), (1, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    mix = domainmix.fit_mixture(d, l, (0.3, 0.0, 0.3, 0.0))
    tot = {r.domain: r for r in domainmix.domain_totals(mix).collect()}
    whole = sum(r.target for r in tot.values()) / 0.3
    assert abs(sum(r.sampled for r in tot.values()) / whole - 0.3) < 0.05 and abs(sum(r.fitted for r in tot.values()) / whole - 0.3) < 0.02
    out = domainmix.sample_mixture(d, l)
    assert out.columns == [*d.columns, "_rate", "_copies"]
    kept = out.collect()
    assert {r.rate for r in kept} == {2.0} and {r.copies for r in kept} == {3}
    assert {r.doc_id for r in kept if r.doc_id is not None} == {i for i in range(400) if i % 8 >= 2}
    more = {r.doc_id: r.copies for r in domainmix.mix_documents(d.select("doc_id", "text"), l, (2.5, 0.0, 2.5, 0.0)).collect()}
    assert set(more[i] for i in range(400) if i % 8 >= 2) == {2, 3}
    one = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert domainmix.mix_documents(d.select("doc_id", "text"), one).where("rate < 0.9").count() == 0


def test_telling_words(spark):
    rows = [(int(i < 20), [5, i + 100] if i < 20 else [9, i + 100]) for i in range(60)] + [(None, [5]), (0, []), (0, [5])]
    places, more = domainmix.telling_words(spark.createDataFrame(rows, "toxic int, w array<int>").repartition(4), 4.0)
    assert places.tolist() == [5] and np.allclose(more, math.log(20.5 / 21) - math.log(1.5 / 43))


def test_pairwise_fit_against_plain_descent(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((120, 3)) * [1, 4, 0.2]
    y = (x @ [1.0, -0.5, 3.0] + r.standard_normal(120) > 0.8).astype(int)
    model = quality.fit_pairwise(x, y, pairs=400_000)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)  # every pair, where the fit draws some
    w = np.zeros(3)
    for _ in range(3000):
        w -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + 1e-3 * w)
    assert np.allclose(model.weights, w, rtol=0.05, atol=0.05)
    s = model.scores(x)
    assert abs((s < 0.3).mean() - (y == 0).mean()) < 0.02 and (model.raw(x)[y == 1][:, None] > model.raw(x)[y == 0]).mean() > 0.85


def test_quality_edges(spark):
    rows, labels = labelled_corpus(100)
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows + [(7, "other text of the same id"), (None, "x"), (500, None), (501, "word " * 300_000)]], "doc_id long, text string, score double")
    l = spark.createDataFrame([(i, q) for i, q, _ in labels] + [(3, 0), (3, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score_documents(d, quality.fit_quality(d, l, holdout=False)).collect()
    assert len(got) == 104 and all(0 <= r.score <= 1 for r in got)
    flat = quality.score_documents(d, quality.fit_quality(d, l.where("quality = 1"))).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.remove_repeats(nothing).count() == dartminhash.near_duplicates(nothing).count() == licenses.scan_licenses(nothing).count() == 0
    assert mixing_lm.score_corpus(nothing).count() == pii.replace_entities(nothing).count() == decontam.find_leaks(nothing, bench).count() == 0
    assert quality.filter_documents(nothing, quality.fit_quality(nothing, labels)).count() == domainmix.mix_documents(nothing, labels).count() == 0
    assert capjoin.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.format_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
