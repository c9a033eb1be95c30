import unicodedata

import pytest
from pyspark.sql import functions as F

from demosift.functions import text as T
from demosift.operators import normalize, sampling
from demosift.sources import sinks, tables

CORPUS = "row_id long, source_text string, target_text string, source_lang string, target_lang string, type string"


def one(spark, column, *values, schema="t string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(column).collect()]


def test_bm25_tokens(spark):
    assert one(spark, T.bm25_tokens("t"), "A  b C\u0085d\x1ce\n", "", None) == [["a", "b", "c", "d", "e"], [], []]


def test_graph_tokens(spark):
    texts = ["şı̇̄rı̇̄n", "½ Ⅷ ² under_score", "muz qattıqdur, a'b-c ʿayn", "  "]
    assert one(spark, T.graph_tokens("t"), *texts) == [["şı", "rı", "n"], ["1", "2", "viii", "2", "under_score"], ["muz", "qattıqdur", "a'b-c", "ʿayn"], []]


def test_lexicon_tokens_and_keys(spark):
    assert one(spark, T.lexicon_tokens("t"), "Tuz, şı̇̄rı̇̄n! a’b 1", None) == [["Tuz", "şı̇̄rı̇̄n", "a’b", "1"], []]
    assert one(spark, T.lexicon_key("t"), "Straße a", "ﬁ-X!") == ["strassea", "fi-x"]


@pytest.mark.parametrize(("value", "bucket"), [("2", "2"), ("2.9", "2"), ("nan", "3-4"), ("inf", "3-4"), ("", "3-4"), ("x", "3-4"), (None, "3-4"), ("-5", "1"), ("8", "5-8"), ("9", "9+"), ("0", "1")])
def test_length_buckets(spark, value, bucket):
    assert one(spark, T.length_bucket(F.col("t"), F.array(*map(F.lit, "abc"))), value) == [bucket]


def test_small_functions(spark):
    a = lambda x: F.split(F.lit(x), " ")
    assert one(spark, F.struct(T.jaccard(a("a b b"), a("b c")), T.bigrams(a("a b c")), T.bigrams(a("a")), T.distinct_in_order(F.array(*map(F.lit, (" b", "a", "", "b ")))), T.shortened(F.lit("abcdef"), 3)), "x") == [(1 / 3, ["a b", "b c"], [], ["b", "a"], "abc...")]
    assert T.parse_keys("a, 'b'\n\"a\",,c") == ["a", "b", "c"] and T.parse_k_list("1, 3") == [1, 3] and T.parse_fraction("") is None
    assert T.embedding_prefixes("x/E5-y") == ("query: ", "passage: ") and T.embedding_prefixes("BAAI/bge-m3") == ("", "")
    for bad in (lambda: T.parse_k_list("0"), lambda: T.parse_fraction("1.5"), lambda: T.parse_int("-1", 3)):
        with pytest.raises(ValueError):
            bad()


def test_schema_normalisation(spark):
    rows = [("اولار", "they", "chg_Arab", "eng_Latn"), ("اولار بيز آط", "we have a horse", "chg_Arab", "kaz_Cyrl"), ("x", "y", "uzn_Latn", "rus_Xxxx")]
    df = normalize.normalize_schema(spark.createDataFrame(rows, "src_text string, tgt_text string, src_lang string, tgt_lang string"))
    assert [tuple(r) for r in df.select("source_lang", "target_lang", "type").collect()] == [("chg", "en", "word"), ("chg", "kk", "phrase"), ("uzn_Latn", "ru", "word")]
    assert normalize.normalize_schema(df).collect() == df.collect()


def test_clean_and_filters(spark):
    rows = [(0, " a ", "b", None, "en", "word"), (1, "a", None, "chg", "en", "word"), (2, "a", "b", "chg", "ru", "phrase"), (3, "a", "b", "chg", "en", "sentence"), (4, "a", "b", "chg", " ", "phrase")]
    df = normalize.clean(spark.createDataFrame(rows, CORPUS))
    assert [r.row_id for r in df.collect()] == [0, 2, 3] and df.first().source_text == "a" and df.first().source_lang == ""
    assert [r.row_id for r in normalize.select_pairs(df, "en", True).collect()] == [3]
    with pytest.raises(ValueError, match="lacks the column type"):
        normalize.clean(df.drop("type"))
    with pytest.raises(ValueError, match="needs the columns source_lang, type"):
        normalize.word_pairs(df.drop("type", "source_lang"), "chg", "en")


def test_budgets(spark):
    lengths = [10, 2097, 2100, 3000, 9000]
    assert one(spark, normalize.request_budget("t", 700, 1500, 3.0), *["x" * n for n in lengths]) == [700, 700, 701, 1001, 1500]
    assert one(spark, normalize.empty_retry_budget(F.lit(701), 700, 1500), "x") == [1402]
    assert one(spark, normalize.request_budget("t", 700, 1500, adaptive=False), "x" * 9000) == [700]


def test_format_and_flags(spark):
    assert one(spark, normalize.bad_format("t"), "Here is x", "fine", "```a", None) == [True, False, True, False]
    df = spark.createDataFrame([(" a", "a", None), ("", "b", "x")], "prediction string, reference string, error string")
    assert [tuple(r)[3:] for r in normalize.outcome_flags(df).collect()] == [(True, False, False), (False, True, True)]


def test_stratified_sample(spark):
    rows = [(i, "s", "t", "chg", "en", "word" if i < 10 else "phrase") for i in range(20)] + [(20 + i, "s", "t", "chg", "en", "five") for i in range(5)] + [(30, "s", "t", "chg", "en", "one")]
    df = spark.createDataFrame(rows, CORPUS)
    got = sampling.sample_fraction(df, 0.2, 1)
    counts = {r.type: r["count"] for r in got.groupBy("type").count().collect()}
    assert counts == {"word": 2, "phrase": 2, "five": 1, "one": 1}
    assert {r.row_id for r in got.collect()} == {r.row_id for r in sampling.sample_fraction(df.repartition(5), 0.2, 1).collect()}
    half = {r.type: r["count"] for r in sampling.sample_fraction(df, 0.5, 1).groupBy("type").count().collect()}
    assert half["five"] == 2 and sampling.sample_fraction(df, None, 1) is df


def test_random_rows_follow_the_standard_generator(spark):
    import random

    queries = spark.createDataFrame([(7, 0), (8, 3)], "query_id long, test_index long")
    got = [(r.query_id, r.place) for r in sampling.random_rows(queries, 20, 5, 42).orderBy("query_id", "rank").collect()]
    assert got == [(q, p) for q, t in ((7, 0), (8, 3)) for p in random.Random(42 + t).sample(range(20), 5)]


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('﻿src_text,tgt_text,src_lang,tgt_lang\n"a ""q""\nb",x,chg_Arab,eng_Latn\nnan,y,chg,en\nc,null,chg,en\n', encoding="utf-8")
    assert tables.split_path(str(tmp_path), "train") == str(path)
    df = tables.read_split(spark, str(tmp_path), "train")
    assert [tuple(r) for r in df.select("row_id", "source_text", "target_text", "type").collect()] == [(0, 'a "q"\nb', "x", "phrase")]
    assert tables.read_split(spark, str(tmp_path), "train", "strict").count() == 3
    with pytest.raises(FileNotFoundError, match="test_icl.csv.*test.csv"):
        tables.split_path(str(tmp_path), "test")
    assert tables.optional_path("train.csv", str(tmp_path)) == str(path) and tables.optional_path("") is None
    header, rows = tables.csv_preview(spark, str(path), 2)
    assert header[0] == "src_text" and rows.count() == 2


def test_static_examples(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("source_text,target_text,source_lang,target_lang,type\na,x,chg,en,phrase\nb,x,chg,ru,phrase\nc,x,chg,en,word\n")
    assert [r.source_text for r in tables.read_static_examples(spark, str(path), "en", "chg", True).collect()] == ["a"]
    with pytest.raises(ValueError, match="none of the fixed examples"):
        tables.read_static_examples(spark, str(path), "tr", "chg")


def test_wide_dictionaries(spark):
    df = spark.createDataFrame([(0, "dur", "is", None), (1, "x", None, "y")], "row_id long, source_text string, `English (eng_Latn)` string, `Russian (rus_Cyrl)` string")
    assert [tuple(r)[1:] for r in tables.as_dictionary(df, "chg", "en").collect()] == [("dur", "is", "chg", "en", "word")]
    assert sorted((r.source_text, r.target_lang) for r in tables.all_languages(df, "chg").collect()) == [("dur", "en"), ("x", "ru")]
    with pytest.raises(ValueError, match="names no column"):
        tables.as_dictionary(df, "chg", "kk")


def test_previews(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"b": 2}\n')
    got = [r[0] for r in tables.jsonl_preview(spark, str(path), 3).selectExpr("to_json(value)").collect()]
    assert got == ['{"a":1}', '{"raw":"not json"}']


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "b", "chg", "en", "word")], CORPUS)
    assert sinks.plain_fingerprint(df) == "595a6c31260be8f2"
    assert sinks.plain_fingerprint(df) != sinks.plain_fingerprint(df.withColumn("type", F.lit("phrase")))
    assert sinks.fingerprint(df) == sinks.fingerprint(df) != sinks.fingerprint(df.withColumn("row_id", F.col("row_id")).withColumn("source_text", F.lit("z")))
    args = {"target_lang": "en", "strategies": ["random", "similarity"], "k_list": [1, 3], "embedding_model": "intfloat/multilingual-e5-base"}
    paths = sinks.output_paths("/o", args, "openai/gpt")
    assert paths["base_name"] == "en_random-similarity_k1-3_intfloat_multilingual-e5-base_openai_gpt"
    assert paths["predictions"] == f"/o/predictions_{paths['base_name']}.csv"
    csv = str(tmp_path / "p.csv")
    for _ in range(2):
        sinks.append_csv(df, csv)
    lines = open(csv, encoding="utf-8").read().splitlines()
    assert len(lines) == 3 and lines[0].startswith("﻿row_id")
    sinks.append_jsonl(df.withColumn("source_text", F.lit("ş")), str(tmp_path / "p.jsonl"))
    assert '"ş"' in (tmp_path / "p.jsonl").read_text(encoding="utf-8")
    counts = {(r["column"], r.value): r["count"] for r in sinks.value_counts(df).collect()}
    assert counts == {("target_lang", "en"): 1, ("type", "word"): 1}


def test_nfkc_matches_python(spark):
    text = "ﬁ Ａ① ㍿ é"
    assert one(spark, T.nfkc(F.col("t")), text) == [unicodedata.normalize("NFKC", text)]
