"""Surrogates against a plain version, and their collisions with entities of the corpus."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from epiflux.llm import pii

KEY = "key"


def noise(key, kind, turn, other):
    return hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()


def plain_moved(text, digits, alphabets):
    out = ""
    for i, c in enumerate(text):
        start = i * 3 % 60
        step = int(digits[start:start + 4], 16)
        for alphabet in alphabets:
            if c in alphabet:
                c = alphabet[(alphabet.index(c) + step) % len(alphabet)]
                break
        out += c
    return out


def plain_permuted(text, key, kind, alphabets):
    half = (len(text) + 1) // 2
    state = [text[:half], text[half:]]
    for turn in range(4):
        at = turn % 2
        state[at] = plain_moved(state[at], noise(key, kind, turn, state[1 - at]), alphabets)
    return "".join(state)


def plain_word(word, key):
    kept = 1 if len(word) > 2 else 0
    return plain_permuted(word[:len(word) - kept], key, "name", pii.SOUNDS) + word[len(word) - kept:]


def plain_redraw(words, key, turns):
    """What each word gets, and the words no free value was found for."""
    value = {word: plain_word(word, key) for word in words}
    taken = set(words) | set(value.values())
    left = {word for word in words if value[word] in words}
    for start in range(1, turns + 1, pii.ROUND):
        owner = {}
        for turn in range(start, start + pii.ROUND):
            for word in left:
                new = plain_word(word, f"{key}#{turn}")
                if new not in taken:
                    owner.setdefault(new, (turn, word))
        for new, (turn, word) in sorted(owner.items(), key=lambda item: -item[1][0]):
            value[word] = new
        found = {word for _, word in owner.values()}
        taken |= {value[word] for word in found}
        left = left - found
    return value, left


def checked(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [row.text for row in pii.replace_checked(docs, KEY, **more).orderBy("doc_id").collect()]


def shape(word):
    return "".join("v" if c in "aeiou" else "c" for c in word)


def test_words_follow_the_plain_version(spark):
    words = ["li", "wu", "smith", "mcdonald", "schütz", "иванов", "o", "ngo", "garcía", "çelik"]
    frame = spark.createDataFrame([(word,) for word in words], "unit string")
    for row in frame.select("unit", pii.drawn_unit(F.lit("name"), F.col("unit"), KEY).alias("new")).collect():
        assert row.new == plain_word(row.unit, KEY)
    phones = spark.createDataFrame([("9885552485",), ("1234567",)], "unit string")
    for row in phones.select("unit", pii.drawn_unit(F.lit("phone"), F.col("unit"), KEY).alias("new")).collect():
        assert row.new == plain_permuted(row.unit, KEY, "phone", pii.LETTERS)


def test_crowded_shapes(spark):
    """Two-letter names fill a part of the 105 values of one shape, and all of another."""
    every = [c + v for v in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"]
    some = sorted(every, key=lambda word: hashlib.md5(word.encode()).hexdigest())[:40]
    words = some + [word[::-1] for word in every]
    rows = checked(spark, [f"Mr {word.capitalize()}, hi" for word in words])
    new = {word: row[3:5].lower() for word, row in zip(words, rows)}
    assert all(row.startswith("Mr ") and row.endswith(", hi") and row[3].isupper() for row in rows)
    assert len(set(new.values())) == len(words)
    assert all(old != value and shape(value) == shape(old) for old, value in new.items())
    value, left = plain_redraw(set(words), KEY, pii.REDRAWS)
    assert left and all(shape(word) == "vc" for word in left)
    assert {word: new[word] for word in words if word not in left} == {word: value[word] for word in words if word not in left}
    assert {new[word] for word in left} == left
    assert not {new[word] for word in some} & set(words)


def test_a_surrogate_that_is_an_entity_is_drawn_again(spark, monkeypatch):
    olds = ["Ab.c12@mail6.example.com", "988-555-2485", "42.144.35.254", "4111 1111 1111 1111", "Frau Weber-Klein"]
    chain = [olds]
    for _ in range(2):
        docs = spark.createDataFrame(list(enumerate(chain[-1])), "doc_id long, text string")
        chain.append([row.text for row in pii.replace(docs, KEY).orderBy("doc_id").collect()])
    flat = [value for values in chain for value in values]
    more = ["nothing here", None, "", "988-555-2485 and +1 (988) 555-2485"]
    rows = checked(spark, [f"see {value}, ok" for value in flat] + more)
    new = [row[4:-4] for row in rows[:len(flat)]]
    assert not set(new) & set(flat) and len(set(new)) == len(flat)
    for old, value in zip(flat, new):
        if not old.replace(".", "").isdigit():
            assert len(value) == len(old)
    assert rows[len(flat):-1] == more[:-1]
    first, second = rows[-1].split(" and ")
    assert first == new[1] and "".join(c for c in second if c.isdigit())[1:] == first.replace("-", "")
    assert second.startswith("+1 (")
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert checked(spark, [f"see {value}, ok" for value in flat] + more) == rows


def test_columns_of_the_input_stay(spark):
    docs = spark.createDataFrame(
        [(1, "Mr Ie", "a", "b", "c"), (1, "Mr Ie", "a", "b", "c")], "doc_id long, text string, _digest string, _redrawn string, entities string")
    rows = pii.replace_checked(docs, KEY).collect()
    assert len(rows) == 2 and {(row._digest, row._redrawn) for row in rows} == {("a", "b")}
    assert pii.replace_checked(docs.limit(0), KEY).count() == 0
