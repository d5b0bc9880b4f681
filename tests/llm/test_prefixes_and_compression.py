"""Chat templates that see every prefix, and licenses that compression chooses."""

import random

import pytest

from verisieve.llm import chat, licenses

TURNS = "conv_id long, turn long, role string, text string, formatted_chars string, position int"


def test_every_prefix_is_rendered(spark):
    seen = spark.sparkContext.accumulator(0)

    def spy(turns):
        seen.add(len(turns))
        return chat.instruct_template(turns)

    rows = [(c, t, ["user", "assistant"][t % 2], f"text {t}", "x", 1) for c, n in ((1, 1), (2, 7), (None, 12)) for t in range(n)]
    df = spark.createDataFrame(rows, TURNS)
    got = chat.format_digest(df, render=spy).collect()
    assert seen.value == sum(2 * n * (n + 1) // 2 for n in (1, 7, 12)) and all(r.rewritten_from is None for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, chat.format_digest(df).collect()), key=str)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, chat.format_digest(df, stateless=True).collect()), key=str)


def test_equal_turns_long_texts_and_nulls(spark):
    rows = [(1, 3, "user", "b", "x", 1), (1, 3, "user", "a", "x", 1), (1, None, None, None, "x", 1), (2, 1, "assistant", "long </s> " * 40_000, "x", 1)]
    got = {r.conv_id: r for r in chat.format_digest(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[2].loss_chars == 400_000 and got[2].formatted_chars == 400_000 + 40_000 + 7


class Constant:
    def __init__(self, size):
        self.size = size

    def compress(self, raw):
        return b"x" * self.size


def test_compression_chooses_the_template():
    text = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.6)
    (right,) = scanner.notices(text)
    assert right[0] == "Apache-2.0" and right[-1] and licenses.TEMPLATES[right[1]][1] == text
    same = licenses.Scanner(licenses.TEMPLATES, 0.6)
    same.plain, same.given = Constant(2), [Constant(1)] * len(licenses.TEMPLATES)
    assert [r[:2] for r in same.notices(text)] != [right[:2]]
    nothing = licenses.Scanner(licenses.TEMPLATES, 0.6)
    nothing.given = [nothing.plain] * len(licenses.TEMPLATES)
    assert nothing.notices(text) == []


def test_changed_wordings_are_found():
    rng = random.Random(6)
    scanner, found, clean = licenses.Scanner(licenses.TEMPLATES, 0.6), 0, 0
    for k in range(500):
        name, text = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = text.split()
        if len(words) > 12:
            for _ in range(max(1, len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(["stone", "river", "seven", ""])
        prose = " ".join(rng.choice(["the", "stone", "of", "water", "runs", "and", "file"]) for _ in range(rng.randrange(60)))
        found += name in {r[0] for r in scanner.notices(f"{prose}\n{' '.join(words)}\n{prose}")}
        clean += not scanner.notices(prose + " software license as is copyright " + prose)
    assert found >= 475 and clean == 500


@pytest.mark.parametrize("pair", [("BSD-2-Clause", "BSD-3-Clause"), ("GPL-2.0", "GPL-3.0"), ("CC-BY-4.0", "CC-BY-SA-4.0"), ("LGPL-3.0", "GPL-3.0")])
def test_close_wordings_are_told_apart(pair):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.6)
    for name, text in licenses.TEMPLATES:
        if name in pair:
            assert [r[0] for r in scanner.notices(text)] == [name]
