import pytest
from pyspark.sql import functions as F

from demosift.operators import induction, lexicon, model_calls, prompts

CORPUS = "row_id long, source_text string, target_text string, source_lang string, target_lang string, type string"


@pytest.fixture()
def make(spark):
    def words(*pairs):
        return lexicon.build(spark.createDataFrame([(i, s, t, "chg", "en", k[0] if k else "word") for i, (s, t, *k) in enumerate(pairs)], CORPUS), "chg", "en")

    return words


def look(spark, lex, text, fuzzy="max_matching", **options):
    df = spark.createDataFrame([(0, text)], "id long, t string")
    return [(e.query, e.source, list(e.translations), e.match) for e in lexicon.lookup(df, lex, "id", "t", fuzzy, **options).first().entries]


def test_build_extend_and_stats(spark, make):
    lex = make(("Tuz", " salt"), ("tuz", "NaCl"), ("tuz", "salt"), ("qand", "sugar", "phrase"), ("?", "x"))
    assert [tuple(r) for r in lex.collect()] == [("tuz", "Tuz", ["salt", "NaCl"])]
    more = spark.createDataFrame([(0, "TUZ", "halite"), (1, "dur", "is")], "row_id long, source_text string, target_text string")
    got = lexicon.extend(lex, more)
    assert sorted(map(tuple, got.collect())) == [("dur", "dur", ["is"]), ("tuz", "Tuz", ["salt", "NaCl", "halite"])]
    assert tuple(lexicon.stats(got).first()) == (2, 4)


@pytest.mark.parametrize(("keys", "text", "fuzzy", "found"), [
    (["qand"], "qanddur", "max_matching", ["qand"]),
    (["tuz", "dur"], "tuzdur", "max_matching", ["tuz", "dur"]),
    (["abc", "bcde"], "abcde", "max_matching", ["abc", "bcde"]),
    (["abc", "abcd", "cdef", "efg"], "abcdefg", "max_matching", ["abcd", "efg"]),
    (["abc", "abcd", "cdef", "efg"], "abcdefg", "substring", ["abcd", "cdef", "abc", "efg"]),
    (["abc"], "abcdef", None, []),
])
def test_fuzzy_lookup(spark, make, keys, text, fuzzy, found):
    got = look(spark, make(*[(k, k.upper()) for k in keys]), text, fuzzy)
    assert [g[1] for g in got] == found and all(g[3] == "fuzzy" and g[0] == text for g in got)


@pytest.mark.parametrize("fuzzy", ["max_matching", "substring"])
def test_order_limits_and_repeats(spark, make, fuzzy):
    lex = make(("b", "1"), ("b", "2"), ("b", "3"), ("aaa", "4"), ("ccc", "5"))
    assert look(spark, lex, "b, AAAx B aaa ccc", fuzzy) == [("b", "b", ["1", "2"], "exact"), ("AAAx", "aaa", ["4"], "fuzzy"), ("ccc", "ccc", ["5"], "exact")]
    assert len(look(spark, lex, "b aaa ccc", fuzzy, max_entries=2, top_n=1)) == 2
    assert look(spark, lex, "", fuzzy) == []
    df = spark.createDataFrame([(0, None)], "id long, t string")
    assert lexicon.lookup(df, lex, "id", "t", fuzzy).first().entries == []


def test_induced_pairs(spark, tmp_path):
    lines = ["süt\tmilk\t0.8", "ara\tbetween\t0.2", "", "a\tb", "x y abc", "n\tm\tnan", "alone"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in induction.parse_pairs(df).collect()] == [("süt", "milk", 0.8), ("a", "b", 1.0), ("x", "y", 1.0)]
    corpus = spark.createDataFrame([(0, "a, b", "x y!", "chg", "en", "phrase"), (1, "!", "z", "chg", "en", "word")], CORPUS)
    assert induction.write_pairs(corpus, str(tmp_path / "s"), str(tmp_path / "t")) == 1
    assert (tmp_path / "s").read_text() == "a b\n" and (tmp_path / "t").read_text() == "x y\n"
    script = tmp_path / "align.py"
    script.write_text("import sys\na = sys.argv\nopen(a[a.index('--lexicon') + 1], 'w').write('a\\tx\\t0.9\\n')\n")
    got = induction.run_aligner(spark, corpus, str(script), str(tmp_path / "out" / "l.tsv"), str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("a", "x", 0.9)]


def test_alignment_learns_translations(spark):
    pairs = [("das haus", "the house"), ("das buch", "the book"), ("ein buch", "a book"), ("haus", "house")]
    corpus = spark.createDataFrame([(i, s, t, "de", "en", "phrase") for i, (s, t) in enumerate(pairs)], CORPUS)
    assert {"haus": "house", "buch": "book"}.items() <= {r.source_text: r.target_text for r in induction.align(corpus, 8, 0.5).collect()}.items()


def build(spark, examples, mode="standard", entries=None, text="muz"):
    hit = "array<struct<query:string,source:string,translations:array<string>,match:string>>"
    df = spark.createDataFrame([(0, examples, text, entries)], f"id long, ex array<struct<source_text:string,target_text:string,entries:{hit}>>, t string, e {hit}")
    return df.select(prompts.prompt(F.col("ex"), F.col("t"), F.lit("chg"), F.lit("en"), mode, F.col("e"))).first()[0]


def test_standard_prompts(spark):
    assert build(spark, [(" tuz ", "salt", None)]) == "Task: Translate the following Chagatai texts to English.\nOutput only the translation. Do not explain anything.\n\nExamples:\nChagatai: tuz\nEnglish: salt\n\nNow translate:\nChagatai: muz\nEnglish:"
    empty = build(spark, [])
    assert "Examples:\nNow translate:" in empty and empty.endswith("English:")
    with pytest.raises(ValueError, match="no prompt mode"):
        build(spark, [], "nope")


def test_hinted_prompts(spark):
    entries = [("dur", "dur", ["is", "stands"], "exact"), ("qanddur", "qand", ["sugar"], "fuzzy"), ("x", "", ["y"], "exact"), ("y", "y", [" "], "exact")]
    got = build(spark, [("a", "b", entries), ("c", "d", None)], "dipmt_plus", entries[:1])
    hint = 'Vocabulary hints:\n- "dur" means "is" or "stands".\n- "qanddur" may contain dictionary word "qand", which means "sugar".\n'
    assert f"Example 1:\nChagatai: a\n{hint}English: b\n\nExample 2:\nChagatai: c\nVocabulary hints: no matching dictionary entries found.\nEnglish: d\n\n" in got
    assert got.endswith('Now translate:\nChagatai: muz\nVocabulary hints:\n- "dur" means "is" or "stands".\nEnglish:')


class Scripted:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def create(self, **request):
        self.seen.append(request["max_tokens"])
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return {"content": answer, "usage": {"total_tokens": 3}}


def test_calls_retry_and_strip():
    sleeps = []
    client = Scripted(RuntimeError(), RuntimeError(), " translated text\n")
    assert model_calls.call(client, {"max_tokens": 10}, sleep=sleeps.append)[0] == "translated text"
    assert sleeps == [1.0, 2.0]
    client = Scripted("", "ok")
    output, _, info = model_calls.call(client, {"max_tokens": 10}, empty_max_tokens=40, delay=0)
    assert (output, client.seen, info["empty_retries"]) == ("ok", [10, 40], 1)
    with pytest.raises(RuntimeError):
        model_calls.call(Scripted(RuntimeError(), RuntimeError()), {"max_tokens": 1}, max_retries=1, delay=0)


def test_failover():
    pool = model_calls.Failover([Scripted(RuntimeError(), "late"), Scripted("a", "b")])
    info = model_calls.call(pool, {"max_tokens": 1}, max_retries=0)[2]
    assert (info["api_key_index"], info["api_key_count"]) == (2, 2)
    assert model_calls.call(pool, {"max_tokens": 1}, max_retries=0)[0] == "b"


def test_pending(spark):
    tests = spark.createDataFrame([(0,), (1,)], "test_index int")
    work = model_calls.grid(tests, [1, 2], ["random", "zero"])
    done = spark.createDataFrame([("zero", "1", "0"), ("zero", "x", "1"), (None, "1", "1"), ("random", "2.0", "1")], "strategy string, k string, test_index string")
    left = {(r.strategy, r.k, r.test_index) for r in model_calls.pending(work, done).collect()}
    assert len(left) == 6 and ("zero", 1, 0) not in left and ("random", 2, 1) not in left
