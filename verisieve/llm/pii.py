"""Surrogates for personal data.

Found: e-mail addresses, IPv4 addresses, telephone numbers, payment cards (with a
right Luhn digit), US social security numbers, IBANs (with right check digits),
secrets after a key word, and person names: a known given name or a title with the
capitalised words after it, and in the same document each of these words alone (if
it never stands there in lower case).

Every entity gets a replacement that depends on the key and on the entity's
normalised value alone, so it is the same wherever the entity stands. Digit
strings are permuted within their length by a keyed Feistel network, which keeps
distinct entities distinct by itself; cards and IBANs keep their issuer or country
and get right check digits; each mention keeps its own punctuation. E-mail
addresses go to the reserved domain ``.example``. A name is replaced word by word, so
parts of names corefer: given names by others of their script and gender (a keyed cycle
over the list, which keeps them distinct), other words by invented ones of their script.

The key is the session's ``spark.verisieve.pii.key``; without one it is drawn anew for
every call, and surrogates differ between calls. It is in no source file.

A replacement that equals another entity's replacement, or any real entity of the
corpus, is drawn again with the next tweak until none does. That check is a join
over the distinct entities of the whole corpus; only its few exceptions go back to
the documents, by a join that Spark sizes.

Null and empty texts are kept as they are; all columns but ``text`` pass through;
repeated rows get equal results; an empty table gives an empty one. Whole texts are
searched.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.common import fresh_name, stash, table, tune
from verisieve.llm.textvec import mix, pieces, row_sums, words

KEY_SETTING = "spark.verisieve.pii.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's key, or one drawn at random."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


#: Given names by script and gender, for finding and for replacing.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carla Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Laura Linda Louise Lucia Margaret Maria Marie Martha Mary Monica Nancy Olivia Patricia Rachel Rosa Ruth Sandra Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Antonio Arthur Brian Carlos Charles Christopher Daniel David Diego Edward Eric Felix Francis Frank George Hans Henry Jack Jacques James Jean John Jorge Joseph Juan Karl Kevin Klaus Louis Luis Mark Martin Michael Miguel Nicolas Oliver Oscar Otto Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Stephen Thomas Victor Walter William".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Владимир Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Νικόλαος".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве да де до ка ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα δα δε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Professor Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа Κύριος Κυρία".split()
_gender = {name: key for key, names in GIVEN.items() for name in names}
_names = "|".join(sorted(_gender, key=lambda n: (-len(n), n)))
FIND = re.compile(
    r"(?P<email>(?<![\w.%+-])\w[\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?![^\W\d_]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    r"|(?P<card>(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)|(?<![\w.-])\d{4}[ -]?\d{6}[ -]?\d{5}(?!\w))"
    r"|(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_/+-]{8,})"
    r"|(?P<name>(?<!\w)(?:" + _names + r")(?: [A-ZÀ-ÞА-ЯΑ-Ω]\w+)+)"
    r"|(?:(?<!\w)(?:" + "|".join(TITLES) + r")\.? )(?P<titled>[A-ZÀ-ÞА-ЯΑ-Ω]\w+(?: [A-ZÀ-ÞА-ЯΑ-Ω]\w+)*)",
)


def prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, kind: str, digits: list[int], base: int, tweak: int) -> list[int]:
    """A keyed permutation of the strings of this length over ``base`` symbols (8 Feistel rounds)."""
    n = len(digits)
    if n < 2:
        return [(d + prf(key, kind, n, tweak)) % base for d in digits]
    u = n // 2
    to_int = lambda ds: sum(d * base**i for i, d in enumerate(ds))
    a, b, sizes = to_int(digits[:u]), to_int(digits[u:]), [base**u, base ** (n - u)]
    for r in range(8):
        a, b = b, (a + prf(key, kind, n, tweak, r, b)) % sizes[r % 2]
    out = []
    for x, m in ((a, u), (b, n - u)):
        for _ in range(m):
            out.append(x % base)
            x //= base
    return out


def luhn_digit(digits: list[int]) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 else (2 * d - 9 * (d > 4))
    return -total % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def normal(kind: str, said: str) -> str | None:
    """The entity's value, alike in all its spellings; None if it is none of this kind."""
    if kind == "email":
        return said.lower()
    if kind == "ip":
        parts = [int(p) for p in said.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 else None
    if kind in ("phone", "ssn", "card"):
        digits = re.sub(r"\D", "", said)
        if kind == "card" and not (13 <= len(digits) <= 19 and luhn_digit([int(c) for c in digits[:-1]]) == int(digits[-1])):
            return None
        return digits if kind != "phone" or 7 <= len(digits) <= 15 else None
    if kind == "iban":
        value = said.replace(" ", "")
        return value if 15 <= len(value) <= 34 and iban_rest(value) == 1 else None
    return said


def surrogate(key: bytes, kind: str, value: str, tweak: int = 0) -> str:
    """The replacement's normalised value."""
    if kind == "ip":
        n = sum(int(p) << 8 * (3 - i) for i, p in enumerate(value.split(".")))
        bits = permute(key, kind, [n >> i & 1 for i in range(32)], 2, tweak)
        n = sum(b << i for i, b in enumerate(bits))
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("phone", "ssn"):
        lead = len(value) - 10 if kind == "phone" and len(value) > 10 else 0
        return value[:lead] + "".join(map(str, permute(key, kind + value[:lead], [int(c) for c in value[lead:]], 10, tweak)))
    if kind == "card":
        body = [int(value[0]), *permute(key, kind + value[0], [int(c) for c in value[1:-1]], 10, tweak)]
        return "".join(map(str, body)) + str(luhn_digit(body))
    if kind == "iban":
        shape, out = value[4:], value[4:]
        for test, base in ((str.isdigit, 10), (str.isalpha, 26)):
            at = [i for i, c in enumerate(shape) if test(c)]
            new = permute(key, kind + value[:2] + re.sub(r"\d", "0", re.sub("[A-Z]", "A", shape)), [int(shape[i], 36) - 10 * (base == 26) for i in at], base, tweak)
            out = list(out)
            for i, d in zip(at, new, strict=True):
                out[i] = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d + 10 * (base == 26)]
            out = "".join(out)
        return value[:2] + f"{98 - iban_rest(value[:2] + '00' + out):02d}" + out
    if kind == "secret":
        hexa = re.fullmatch(r"(?=.*\d)[0-9a-f]+|(?=.*\d)[0-9A-F]+", value)
        if hexa:
            up = value != value.lower()
            new = "".join("0123456789abcdef"[d] for d in permute(key, "hex" + str(up), [int(c, 16) for c in value], 16, tweak))
            return new.upper() if up else new
        out, stream = [], b""
        for i, c in enumerate(value):
            if i % 32 == 0:
                stream = prf(key, kind, value, tweak, i).to_bytes(32, "big")
            for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                if c in alphabet:
                    c = alphabet[(stream[i % 32] + alphabet.index(c)) % len(alphabet)]
                    break
            out.append(c)
        return "".join(out)
    draw = prf(key, kind, value, tweak)
    if kind == "email":
        local = value.rpartition("@")[0]
        number = "".join(c for c in local if c.isdigit())
        word = ""
        while len(word) < max(8, len(local) - len(number)):
            draw, i = divmod(draw, 32)
            word += SYLLABLES["latin"][i]
        host = f"{prf(key, 'domain', value.rpartition('@')[2]) % 36**6:x}"
        return f"{word}{'.' + ''.join(map(str, permute(key, 'email', [int(c) for c in number], 10, tweak))) if number else ''}@mail-{host}.example"
    # a word of a name
    script = script_of(value)
    word = ""
    for _ in range(4):
        draw, i = divmod(draw, len(SYLLABLES[script]))
        word += SYLLABLES[script][i]
    return word.upper() if len(value) > 1 and value.isupper() else word.capitalize()


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


_next_given: dict[bytes, dict[str, str]] = {}


def given_name(key: bytes, name: str) -> str:
    """The given name after ``name`` in a cycle, drawn from the key, of those of its script and gender."""
    if key not in _next_given:
        _next_given.clear()
        cycles = [sorted(names, key=lambda n: prf(key, "given", n)) for names in GIVEN.values()]
        _next_given[key] = {a: b for c in cycles for a, b in zip(c, c[1:] + c[:1], strict=True)}
    return _next_given[key][name]


def spell(kind: str, said: str, value: str) -> str:
    """``value`` with the punctuation of the mention ``said``."""
    if kind in ("phone", "ssn", "card", "iban"):
        rest = iter(value)
        return "".join(next(rest) if c.isalnum() else c for c in said)
    return value


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) in order; mentions do not overlap."""
    out, at = [], 0
    while m := FIND.search(text, at):
        kind = m.lastgroup
        value = normal(kind, m[kind])
        if value is None:
            at = max(m.start() + 1, m.end(kind) if kind in ("ip", "card") else m.start() + 1)
            continue
        out.append((*m.span(kind), "name" if kind == "titled" else kind, value))
        at = m.end()
    parts = {w for *_, kind, value in out if kind == "name" for w in value.split(" ") if len(w) > 2}
    if parts:
        out += alone(text, parts, out)
        out.sort()
    return out


def alone(text: str, parts: set[str], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Words of names that stand by themselves, outside the mentions ``taken``; a word that also
    stands in lower case is none."""
    find = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(parts))) + r")(?!\w)", re.I)
    hits = [(*m.span(), m[0]) for m in find.finditer(text)]
    plain = {w for *_, w in hits if w[0].islower()}
    ends = sorted((a, b) for a, b, *_ in taken)
    out, k = [], 0
    for a, b, w in hits:
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        if w in parts and w.lower() not in plain and not (k < len(ends) and ends[k][0] < b):
            out.append((a, b, "name", w))
    return out


def drawn_parts(kind: str, value: str) -> list[tuple[str, str]]:
    """The (kind, value) whose replacements are drawn for this entity: of a name, its words
    that are no known given names."""
    return [("word", w) for w in value.split(" ") if w not in _gender] if kind == "name" else [(kind, value)]


_name_hashes: np.ndarray | None = None
_name_letters = np.zeros(256, bool)
_name_letters[[*range(65, 91), *range(97, 123)]] = True
#: Pairs of bytes that are a letter of a given name.
_name_pairs = np.zeros(1 << 16, bool)
for _c in {c.encode() for n in (*_gender, *TITLES) for c in n if not c.isascii()}:
    _name_pairs[_c[0] << 8 | _c[1]] = True
#: First bytes of the characters among which the digits outside ASCII are.
_far_digits = np.zeros(256, bool)
_far_digits[[0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, 0xF0]] = True


def _letters_only(buf: np.ndarray) -> np.ndarray:
    """``buf`` with a blank in place of every byte that is not of a letter of a given name."""
    letter = _name_letters[buf]
    if len(buf) > 1 and buf.max() > 127:
        pair = _name_pairs[buf[:-1].astype(np.int32) << 8 | buf[1:]]
        letter[:-1] |= pair
        letter[1:] |= pair
    return np.where(letter, buf, np.uint8(32))


def suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that may hold an entity: two digits (an IBAN may have no more), an @, a key word's
    separator, or a given name or title between any other characters. No row that ``FIND`` matches is left out."""
    global _name_hashes
    if _name_hashes is None:
        lone = [n.encode() for n in (*_gender, *TITLES)]
        ends = np.cumsum([0, *map(len, lone)])
        _name_hashes = np.sort(words(np.frombuffer(b"".join(lone), np.uint8), ends, lower=False)[2])
    digit = (buf >= 48) & (buf <= 57)
    some = (row_sums(digit, off) >= 2) | (row_sums(_far_digits[buf], off) > 0) | (row_sums(buf == 64, off) > 0) | (row_sums((buf == 61) | (buf == 58), off) > 0)
    _, _, h, to = words(_letters_only(buf), off, lower=False)
    at = np.minimum(np.searchsorted(_name_hashes, h), len(_name_hashes) - 1)
    return np.flatnonzero(some | (row_sums(_name_hashes[at] == h, to) > 0))


def _each(column: pa.Array) -> Iterator[tuple[int, str]]:
    for lo, _, buf, off in pieces(column):
        for row in suspects(buf, off):
            yield lo + int(row), buf[off[row] : off[row + 1]].tobytes().decode("utf-8", "replace")


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind, value of every entity of the corpus that replacements are drawn for, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {part for _, text in _each(batch.column(0)) for _, _, kind, value in entities(text) for part in drawn_parts(kind, value)}
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value string").distinct()


def collisions(docs: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """kind, value, tweak of the entities whose first replacement is taken.

    A replacement is taken if another entity has it or if it is itself an entity of
    the corpus. Of several entities with one replacement the smallest keeps it.
    """

    def run_with(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [surrogate(key, k.as_py(), v.as_py(), t.as_py()) for k, v, t in zip(*batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names)

        return run

    def drawn(df: DataFrame) -> DataFrame:
        return df.select("kind", "value", "tweak").mapInArrow(run_with(["kind", "value", "tweak", "new"]), "kind string, value string, tweak int, new string")

    real = stash(distinct_entities(docs))
    every = stash(drawn(real.withColumn("tweak", F.lit(0))))
    for _ in range(rounds):
        # who holds each value: replacements and, as the empty claim that always wins, real entities
        claims = every.select("kind", F.col("new").alias("at"), "value").unionByName(real.select("kind", F.col("value").alias("at"), F.lit("").alias("value")))
        keeper = claims.groupBy("kind", "at").agg(F.min("value").alias("keeper"), F.count("*").alias("n")).where("n > 1")
        lost = every.join(keeper, (every.kind == keeper.kind) & (every.new == keeper.at) & (every.value != keeper.keeper), "left_semi")
        lost = stash(lost)
        if lost.isEmpty():
            return every.where("tweak > 0").select("kind", "value", "tweak")
        again = drawn(lost.withColumn("tweak", F.col("tweak") + 1))
        every = stash(every.join(lost.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(again))
    raise RuntimeError(f"replacements still collide after {rounds} draws")


def replace_entities(docs: DataFrame, key: bytes | None = None, count: str | None = None, most_sent: int = 10_000) -> DataFrame:
    """``docs`` with its text rewritten; with ``count``, a column of that name holds the
    number of mentions replaced. Up to ``most_sent`` exceptions are sent with the code."""
    tune(docs.sparkSession)
    key = key or surrogate_key(docs.sparkSession)
    taken = collisions(docs, key)
    columns, at = docs.columns, docs.columns.index("text")
    few = taken.limit(most_sent + 1).collect()
    base = docs
    extra = len(few) > most_sent  # too many: each document gets those that it mentions
    known = {} if extra else {(r.kind, r.value): r.tweak for r in few}
    if extra:
        base = _with_tweaks(docs, taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str, int], str] = {}

        def new_value(kind: str, value: str, tweaks: dict) -> str:
            if kind == "name":
                return " ".join(given_name(key, w) if w in _gender else new_value("word", w, tweaks) for w in value.split(" "))
            what = (kind, value, tweaks.get((kind, value), 0))
            if what not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[what] = surrogate(key, *what)
            return memo[what]

        for batch in batches:
            texts = batch.column(at)
            numbers, rows, new = np.zeros(batch.num_rows, np.int64), [], []
            for row, text in _each(texts):
                found = entities(text)
                if not found:
                    continue
                tweaks = known
                if extra:
                    tweaks = {(t["kind"], t["value"]): t["tweak"] for t in batch.column(batch.num_columns - 1)[row].as_py() or []}
                parts, end = [], 0
                for a, b, kind, value in found:
                    parts += [text[end:a], spell(kind, text[a:b], new_value(kind, value, tweaks))]
                    end = b
                rows.append(row)
                new.append("".join(parts) + text[end:])
                numbers[row] = len(found)
            if rows:
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            out = [texts if i == at else batch.column(i) for i in range(len(columns))]
            names = list(columns)
            if count:
                out.append(pa.array(numbers))
                names.append(count)
            yield pa.RecordBatch.from_arrays(out, names)

    schema = docs.schema if not count else docs.withColumn(count, F.lit(0).cast("long")).schema
    return base.mapInArrow(run, schema)


def _with_tweaks(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """``docs`` with a last column of the exceptions that each text mentions."""
    h, tweaks = fresh_name(docs, "text_hash"), fresh_name(docs, "tweaks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(batch.column(0)[row].as_py(), *part) for row, text in _each(batch.column(1)) for _, _, kind, value in entities(text) for part in drawn_parts(kind, value)})
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], [h, "kind", "value"])

    hashed = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    mentions = docs.select(hashed.alias(h), "text").mapInArrow(run, f"{h} string, kind string, value string").distinct()
    lists = mentions.join(taken, ["kind", "value"]).groupBy(h).agg(F.collect_list(F.struct("kind", "value", "tweak")).alias(tweaks))
    return docs.withColumn(h, hashed).join(lists, h, "left").select(*docs.columns, tweaks)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, count="n_replaced")
