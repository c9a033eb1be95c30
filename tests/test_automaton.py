"""Keys inside tokens: the automaton against plain search, and both ways of the lookup against each other."""

import random

import pytest

from demosift.operators import lexicon
from demosift.operators.automaton import Automaton, greedy

WORDS = ["tuz", "dur", "abc", "abcd", "cdef", "efg", "bcde", "straße", "🙂🙂🙂"]


def plain(keys, text):
    return sorted((i, len(k)) for k in keys for i in range(len(text) - len(k) + 1) if text.startswith(k, i))


def walk(known, key, from_left):
    out, rest = [], key
    while rest:
        fits = rest.startswith if from_left else rest.endswith
        part = max((k for k in known if fits(k)), key=len, default="")
        at = len(key) - len(rest) if from_left else len(rest) - len(part)
        out += [(at, len(part))] if part else []
        n = len(part) or 1
        rest = rest[n:] if from_left else rest[:-n]
    return out if from_left else out[::-1]


def test_matches_and_greedy_walks():
    r = random.Random(6)
    for _ in range(200):
        letters = r.choice(["ab", "abc", "aé🙂"])
        word = lambda n: "".join(r.choice(letters) for _ in range(r.randrange(1, n)))
        keys, texts = sorted({word(6) for _ in range(r.randrange(1, 12))}), [word(25) for _ in range(5)] + [""]
        own, starts, sizes = Automaton.of(keys).matches(texts)
        for i, text in enumerate(texts):
            found = sorted((a, n) for o, a, n in zip(own.tolist(), starts.tolist(), sizes.tolist()) if o == i)
            assert found == plain(keys, text)
            assert greedy([a for a, _ in found], [n for _, n in found], len(text)) == walk(keys, text, True) + walk(keys, text, False)
    assert len(Automaton.of([]).matches(["abc", ""])[0]) == 0 and len(Automaton.of(["a"]).matches([])[0]) == 0


@pytest.fixture()
def known(spark):
    rows = spark.createDataFrame([(i, w, f"t{i}") for i, w in enumerate(WORDS)], "row_id long, source_text string, target_text string")
    return lexicon.entries(rows)


@pytest.mark.parametrize("fuzzy", ["substring", "max_matching"])
def test_lookup_is_the_same_without_sending_keys(spark, known, fuzzy):
    texts = ["tuzdur abcdefg", "abcde STRASSE x", "", None, "tuz tuz zzz", "şı̇̄tuzr", "xstrassestrasse"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    shown = lambda **o: sorted((r.id, str(r.entries)) for r in lexicon.lookup(df, known, "id", "text", fuzzy, **o).collect())
    sent = shown()
    assert shown(key_bytes=0) == sent
    assert "abcd" in sent[0][1] and sent[2][1] == sent[3][1] == "[]"


@pytest.mark.parametrize("key_bytes", [lexicon.KEY_BYTES, 0])
def test_a_token_of_a_hundred_thousand_letters(spark, known, key_bytes):
    long = "x" * 40_000 + "tuz" + "abcdefg" * 8_000 + "y" * 4_000
    df = spark.createDataFrame([(1, f"qq {long} dur")], "id long, text string")
    for fuzzy, want in (("substring", ["abcd", "bcde", "cdef", "abc", "efg", "tuz", "dur"]), ("max_matching", ["tuz", "abcd", "efg", "abc", "dur"])):
        found = lexicon.lookup(df, known, "id", "text", fuzzy, key_bytes=key_bytes).first().entries
        assert [e.source for e in found][:3] == want[:3] and {e.source for e in found} >= {"tuz", "efg", "dur"}


@pytest.mark.parametrize("fuzzy", [None, "substring", "max_matching"])
def test_nothing_crosses_for_a_lexicon_that_is_sent(spark, known, fuzzy):
    df = spark.createDataFrame([(1, "tuzdur abcdefg qq tuz")], "id long, text string")
    found = lexicon.lookup(df, known, "id", "text", fuzzy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("fuzzy", [None, "substring", "max_matching"])
def test_limits_are_the_same_without_sending_keys(spark, known, fuzzy, monkeypatch):
    monkeypatch.setattr(lexicon, "AT_ONCE", 5)
    r = random.Random(3)
    texts = [" ".join(r.choice([*WORDS, "".join(r.choices(WORDS, k=2)), "zz", "Abc", "?"]) for _ in range(r.randrange(12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for o in ({"max_entries": 3, "top_n": 1}, {"min_chars": 4}, {}):
        shown = [sorted((x.id, str(x.entries)) for x in lexicon.lookup(df, known, "id", "text", fuzzy, key_bytes=b, **o).collect()) for b in (lexicon.KEY_BYTES, 0)]
        assert shown[0] == shown[1] and len(shown[0]) == 60
