"""Part codes, turn repair and packing against plain code."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from verisieve.llm import packing, partcodes, turnrepair

VECTORS = "vec_id long, embedding array<float>, label int, code string, error double, v int, _key long"


def lloyd(rows, parts=4, entries=256, rounds=4):
    """vec_id, code, error for each sound row, in their order, and the codebooks."""
    sound = [(i, list(v), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in sound), default=0) // parts) * parts
    ints = [[max(-(1 << 24), min(1 << 24, math.floor(1024 * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in sound]
    size = width // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    order = sorted(range(len(sound)), key=lambda k: (sound[k][0] is None, sound[k][0] or 0, ints[k]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [nearest(c[p], books[p])[1] for c in cut]
            for k in set(got):
                mine = [c[p] for c, g in zip(cut, got) if g == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for (i, _, lab), c in zip(sound, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in best], sum(d for d, _ in best)))
    return out, books


def check_codes(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "c", 0.5, 1, 2) for i, v, lab in rows], VECTORS).repartition(5)
    got, books = partcodes.part_codes(df, **kw)
    want, want_books = lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], **{k: v for k, v in kw.items()})
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[1] is None, r[1] or 0)
    assert sorted([(r.vec_id, r.label, list(r.code), r.error) for r in got.collect()], key=key) == sorted(want, key=key)
    assert books.tolist() == want_books
    return got, want


def test_codes_equal_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.2, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.03, 8)).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(i, rows[0][1], 1) for i in range(400, 500)]  # copies and ties
    rows += [(5, rows[7][1], 2), (None, rows[3][1], 3), (501, None, 1), (502, [0.1] * 7 + [None], 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] * 8, 1), (505, [0.0] * 8, 1), (506, [-1e-9] * 8, 1)]
    got, want = check_codes(spark, rows, entries=16)
    scans = sum(r.full_scans for r in got.collect())
    assert len(want) * 4 <= scans < len(want) * 4 * 5  # bounds settle some of the parts
    total = {}
    for _, lab, _, e in want:
        total[lab] = total.get(lab, 0) + e
    totals = partcodes.with_group_total(got, "label", "error", "label_error").collect()
    assert len(totals) == len(want) and all(r.label_error == total[r.label] for r in totals)


def test_registered_codes_have_the_columns_and_rows_of_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist(), [None, 1, 2][i % 3]) for i in range(400)] + [(400, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = partcodes.op11_part_codes(spark, str(tmp_path))
    found = duckdb.execute(partcodes.OP11_SQL.replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')"))
    assert [d[0] for d in found.description] == got.columns
    assert sorted(found.fetchall()) == sorted(map(tuple, got.collect()))


def test_bounds_settle_most_parts_of_clustered_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.01, 8)).tolist(), 1) for i in range(600)]
    got, want = check_codes(spark, rows, entries=16)
    assert sum(r.full_scans for r in got.collect()) < len(want) * 4 * 2  # of 5 assignments


def test_codes_of_ties_and_integers_in_both_ways(spark):
    grid = [list(map(float, c)) for c in itertools.product((0, 1 / 1024, 2 / 1024), repeat=4)]
    check_codes(spark, [(i, v, 1) for i, v in enumerate(grid)], entries=5)
    big = [[x * 1e6 for x in v] + [3e38, -3e38, 9.0, 1.0] for v in grid[:40]]  # too large for exact doubles
    check_codes(spark, [(i, v, 1) for i, v in enumerate(big)], entries=5, rounds=2)


def test_codes_of_few_short_and_no_vectors(spark):
    check_codes(spark, [(1, [0.1, 0.2], 1), (2, [0.3] * 5, None), (3, [], 1)])
    check_codes(spark, [(1, [], 1), (2, [], 1)])
    check_codes(spark, [(7, [0.5] * 4, 1)])
    empty, books = partcodes.part_codes(spark.createDataFrame([(1, None, 1, "c", 0.5, 1, 2)], VECTORS))
    assert empty.collect() == [] and books.size == 0
    assert partcodes.with_group_total(empty, "label", "error", "label_error").collect() == []


def test_group_totals_of_hot_and_rare_groups(spark):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS label", "id AS error")
    got = partcodes.with_group_total(df, "label", "error", "total")
    want = {}
    for i in range(4000):
        k = 1 if i % 3 == 0 else None if i % 3 == 1 else i
        want[k] = want.get(k, 0) + i
    assert sorted((r.id, r.total) for r in got.collect()) == [(i, want[1 if i % 3 == 0 else None if i % 3 == 1 else i]) for i in range(4000)]


PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit, repaired) by trying every choice for every turn and every legal order of roles."""
    best = None
    for choice in itertools.product("DKua", repeat=len(turns)):
        kept, cost = [], 0
        for t, c in zip(turns, choice):
            if c == "D":
                cost += 3
                continue
            if t.fault in ("blank", "duplicate"):
                break
            cost += (c != "K") * 2 + (t.fault == "truncated")
            kept.append((c, t.role[:1] if c == "K" else c, t.role if c == "K" else {"u": "user", "a": "assistant"}[c], t.text))
        else:
            letters = [k[1] for k in kept]
            for size in range(2 * len(kept) + 3):
                for target in {("s" if n else "") + "ua" * ((size - n) // 2) for n in (0, 1) if size >= n and (size - n) % 2 == 0} if size else {""}:
                    if not PATTERN.fullmatch(target):
                        continue
                    for at in itertools.combinations(range(size), len(letters)):
                        if [target[i] for i in at] != letters or "s" in [target[i] for i in set(range(size)) - set(at)]:
                            continue
                        out, where = [], iter(range(len(at)))
                        # inserts right before the next kept turn: deletions come first in the least order
                        spots = {i: k for k, i in zip(kept, at)}
                        actions, pos, texts = [], 0, []
                        for t, c in zip(turns, choice):
                            if c == "D":
                                actions.append("D")
                                continue
                            while pos not in spots:
                                actions.append("I"), texts.append({"u": "user:", "a": "assistant:"}[target[pos]])
                                pos += 1
                            actions.append("K" if c == "K" else "R"), texts.append(f"{spots[pos][2]}:{spots[pos][3]}")
                            pos += 1
                        for p in range(pos, size):
                            actions.append("I"), texts.append({"u": "user:", "a": "assistant:"}[target[p]])
                        new = (cost + 2 * (size - len(letters)), "".join(actions), "\n".join(texts))
                        best = new if best is None or new < best else best
    return best


def repaired(turns, check_at=256):
    r = turnrepair.Repair(check_at=check_at)
    edits = []
    for t in turns:
        r.add(t)
        if check_at < 256:
            r.check_at = check_at
        edits += r.settled()
    cost, rest = r.close()
    edits += rest
    return cost, "".join(e.action for e in edits), "\n".join(f"{e.role}:{e.text}" for e in edits if e.action != "D")


def some_turns(rng, n):
    return [turnrepair.Turn(i, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), f"t{i}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(n)]


def test_repairs_equal_exhaustive_search():
    rng = random.Random(3)
    for _ in range(150):
        turns = some_turns(rng, rng.randrange(5))
        assert repaired(turns) == cheapest(turns) == repaired(turns, 1)


def test_long_conversations_settle_early():
    rng = random.Random(5)
    turns = some_turns(rng, 3000)
    assert repaired(turns, 1) == repaired(turns, 10**9)
    r, most = turnrepair.Repair(), 0
    for t in turns * 5:
        r.add(t)
        r.settled()
        most = max(most, len(r.held))
    assert most < 600


TURNS = "conv_id long, turn long, role string, text string, copies string, present int, repeated string"


def test_damage_faults_and_digest(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c % 2} {t % 5}. And more! Yes?") for c in range(60) for t in range(8)]
    rows += [(100, None, "user", "Hello."), (100, 3, None, None), (100, 3, "assistant", "Fine."), (None, 1, "user", "a\x85."), (None, 2, "assistant", " \t\n."), (101, 5, "", "x" * 300_000 + "."), (102, 2, "user", "u."), (102, 9, "user", "u."), (102, 4, "assistant", "\x0b\x0c ")]
    df = spark.createDataFrame([(*r, "1", 2, "3") for r in rows], TURNS)
    got = {r.conv_id: r for r in turnrepair.repair_digest(turnrepair.damaged(df), "copies").collect()}
    assert len(got) == 64
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if h:
            row = (t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            by[c] += [row] * (2 if h == 3 else 1)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for t, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            told.append(turnrepair.Turn(t, role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, out = repaired(told)
        nums = [t for t, *_ in turns if t is not None]
        r = got[c]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(out.encode()).hexdigest())
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(t.fault == f for t in told) for f in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0)
        assert r.illegal == sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    edits = turnrepair.repair_edits(df).orderBy("conv_id", "position").collect()
    for c in {r.conv_id for r in edits}:
        mine = [e for e in edits if e.conv_id == c]
        assert PATTERN.fullmatch("".join(e.role[0] for e in mine if e.action != "D")) and [e.position for e in mine] == list(range(len(mine)))


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turnrepair.repair_digest(turnrepair.damaged(empty), "copies").collect() == [] == turnrepair.repair_edits(empty).collect()
    gone = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (r,) = turnrepair.repair_digest(turnrepair.damaged(spark.createDataFrame([(1, gone, "user", "x", "1", 2, "3")], TURNS)), "copies").collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


DOCS = "doc_id long, text string, item string, ids int, length string"


def odd_texts():
    rng = random.Random(2)
    letters = "ab cd\n\t é漢字ß12 '’s.,!?<|>\x85\x1c  　​İ🙂́"
    texts = ["", None, " ", "x", "<|endoftext|>", "a <|endoftext|> b", "it's we'll I'D", " " * 3000, "\n" * 2047, "a" * 5000, "ab " * 2500, "漢" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += [" ".join(rng.choice(["stone", "water", "été", "12", "x\ny"]) for _ in range(n)) for n in (2046, 2047, 2048, 4096, 9000)]
    return texts


def test_packed_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.public_vocabulary())
    plain.encode_special_tokens = True
    texts = odd_texts()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, "same"), (3, "same"), (3, "other")]
    df = spark.createDataFrame([(*r, "i", 1, "l") for r in rows], DOCS).repartition(3)
    want = {}
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        at = [0, *range(first, len(ids), 2048)]
        for n, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
            k = (i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[k] = want.get(k, 0) + 1
    got = packing.pack_documents(df).collect()
    seen, places = {}, {}
    for r in got:
        k = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        seen[k] = seen.get(k, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == want
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    made = packing.sequences(df).collect()
    assert sorted(len(r.ids) for r in made) == sorted(sum(n for _, n in h) for h in places.values())


def test_many_shards_pack_as_well_as_one(spark):
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6.2, 0.9, 6000).astype(int) + 1).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    for kw in ({}, {"shard_tokens": 100_000, "open_bins": 64, "lot": 128, "merged": 3}):
        got = packing.pack(df, **kw).collect()
        assert sorted(r.item for r in got) == list(range(6000))
        used = {}
        for r in got:
            used.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item]))
        for held in used.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
        assert len(used) <= 1.02 * -(-sum(lengths) // 2048)


def test_bins_choose_the_fullest_that_fits():
    b = packing.Bins(10, 2)
    assert b.add(1, 6) is None and b.add(2, 7) is None  # free 4 and 3
    assert b.add(3, 3) == [(2, 7), (3, 3)]  # the fuller one, and it closes
    assert b.add(4, 5) is None and b.add(5, 10) == [(5, 10)]
    assert b.add(6, 6) == [(1, 6)]  # two are open, none fits: the fullest goes
    assert sorted(map(tuple, b.rest())) == [((4, 5),), ((6, 6),)]


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("text", ["word " * 120_000, "a" * 600_000 + " b", " " * 600_000, "漢字" * 200_000 + "\n x"])
def test_long_texts_are_encoded_whole(text):
    assert "".join(packing.stretches(text)) == text
    assert list(packing.token_ids(text, packing.public_vocabulary())) == packing._plain(packing.public_vocabulary()).encode(text, add_special_tokens=False).ids
