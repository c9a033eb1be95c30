import json
import math

import pytest
from pyspark.sql import functions as F

from demosift.operators import metrics
from demosift.plans import experiment
from demosift.streaming import predictions as log

ROWS = [("m", "en", "s", 1, "the cat sat on the mat", "the cat sat on a mat"), ("m", "en", "s", 1, "Hello, world!", "Hello world."), ("m", "en", "z", 2, "", None), (None, "en", "z", 2, "x", "x"), ("m", "en", "a", 1, "same text, here: 3.5%", "same text, here: 3.5%")]
SCHEMA = "model string, target_lang string, strategy string, k int, prediction string, reference string"


def test_bleu_tokens(spark):
    df = spark.createDataFrame([("Hello, world! 3.5% &amp; \"x\" a-b 1-2 end.",)], "t string")
    assert df.select(metrics.bleu_tokens("t")).first()[0] == ["Hello", ",", "world", "!", "3.5", "%", "&", '"', "x", '"', "a-b", "1", "-", "2", "end", "."]


def plain_bleu(pairs):
    """Written out for tokenised pairs."""
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (h, r))
            match[n - 1] += sum(min(a.count(g), b.count(g)) for g in set(a))
            total[n - 1] += len(a)
    if not any(match):
        return 0.0
    smooth, logs = 1, 0.0
    for m, t in zip(match, total, strict=True):
        if not t:
            return 0.0
        if not m:
            smooth *= 2
        logs += math.log(100 * m / t if m else 100 / (smooth * t)) / 4
    return (1 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)) * math.exp(logs)


def test_evaluation(spark):
    got = {(r.strategy, r.k): r for r in metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert set(got) == {("s", 1), ("z", 2), ("a", 1)}
    pairs = [("the cat sat on the mat".split(), "the cat sat on a mat".split()), (["Hello", ",", "world", "!"], ["Hello", "world", "."])]
    assert got["s", 1].BLEU == pytest.approx(plain_bleu(pairs), abs=1e-9)
    same, empty = got["a", 1], got["z", 2]
    assert same.BLEU == pytest.approx(100) and same.chrF == pytest.approx(100)
    assert (empty.BLEU, empty.chrF, empty.BERTScore, empty.empty_prediction_count, empty.empty_reference_count, empty.n) == (0.0, 0.0, None, 1, 1, 1)
    assert 0 < got["s", 1].chrF < 100
    with pytest.raises(ValueError, match="lack(s)? the column k"):
        metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA).drop("k"))


def test_chrf_by_hand(spark):
    # "ab" against "ac": letters 1 of 2, pairs 0 of 1, words 0 of 1; longer orders exist on neither side
    df = spark.createDataFrame([("m", "en", "s", 1, "ab", "ac")], SCHEMA)
    p = (0.5 + 0 + 0) / 3
    assert metrics.evaluate(df).first().chrF == pytest.approx(100 * 5 * p * p / (4 * p + p))


def test_semantic_scores_skip_empty_sides(spark):
    df = spark.createDataFrame([("m", "en", "s", 1, "a", "b"), ("m", "en", "s", 1, "", "b"), ("m", "ru", "s", 1, "", "b")], SCHEMA)
    got = {r.target_lang: r.BERTScore for r in metrics.evaluate(df, semantic=F.lit(0.5)).collect()}
    assert got == {"en": 50.0, "ru": None}


def test_session_ids(spark):
    rows = [("m", "en", "s", 1, "x"), ("m", "en", "s", 1, " "), ("m", "en", "z", 1, "x"), ("m", "en", "z", 1, "y"), ("m", "en", "q", 1, None)]
    df = spark.createDataFrame(rows, "model string, target_lang string, strategy string, k int, session_id string")
    assert {r.strategy: r.session_id for r in metrics.session_ids(df, "f").collect()} == {"s": "x", "z": "f", "q": "f"}


def test_streamed_statistics_add_up(spark, tmp_path):
    rows = [dict(zip(("model", "target_lang", "strategy", "k", "prediction", "reference"), r, strict=True)) for r in ROWS]
    place = lambda n: f"{tmp_path}/{n}"
    (tmp_path / "log").mkdir()
    for n, part in enumerate((rows[:2], rows[2:])):
        (tmp_path / "log" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        log.watch(spark, place("log"), SCHEMA, place("stats"), place("check")).awaitTermination()
    got = {(r.strategy, r.k): (r.BLEU, r.chrF, r.n) for r in log.current(spark, place("stats")).collect()}
    want = {(r.strategy, r.k): (r.BLEU, r.chrF, r.n) for r in metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == want


class Echo:
    def create(self, **request):
        return {"content": request["messages"][0]["content"].splitlines()[-2].split(": ", 1)[-1], "finish_reason": "stop", "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}


def test_validation():
    for bad in ({"strategies": ["x"]}, {"strategies": []}, {"k_list": [0]}, {"strategies": ["graph_ppr"]}, {"retrieval_backend": "graph"}, {"strategies": ["static"]}, {"enable_bli": True}, {"max_tokens_cap": 1}, {"sample_fraction": 1.5}, {"k_list": [-1]}, {"max_tokens": 0}, {"prompt_mode": "x"}, {"sample_fraction": 0.0}, {"max_examples": 0}, {"bli_threshold": -0.1}, {"static_examples_path": "p"}, {"strategies": ["graph_ppr", "similarity"], "retrieval_backend": "graph"}):
        with pytest.raises(ValueError):
            experiment.Settings(**bad).validate()
    experiment.Settings(strategies=["zero"], k_list=[0]).validate()
    experiment.Settings(strategies=["graph_ppr", "random", "zero"], retrieval_backend="graph", sample_fraction=1.0).validate()
    with pytest.raises(ValueError, match="max_tokens.*strategies"):  # all that is wrong at once
        experiment.Settings(strategies=["x"], max_tokens=0).validate()


@pytest.mark.parametrize("mode", ["standard", "dipmt_plus"])
def test_whole_run_and_resume(spark, tmp_path, mode):
    words = [("tuz", "salt"), ("qand", "sugar"), ("dur", "is"), ("kitab", "book")]
    rows = [(i, s, t, "chg", "en", "word") for i, (s, t) in enumerate(words)] + [(10 + i, f"{a} dur", f"{b} is", "chg", "en", "phrase") for i, (a, b) in enumerate(words)]
    schema = "row_id long, source_text string, target_text string, source_lang string, target_lang string, type string"
    train = spark.createDataFrame(rows, schema)
    test = spark.createDataFrame([(0, "tuzdur kitab", "the book is salt", "chg", "en", "phrase"), (1, "qand", "sugar", "chg", "en", "word")], schema)
    s = experiment.Settings(strategies=["zero", "random", "similarity", "diversity"], k_list=[2], prompt_mode=mode, workers=2, retry_delay=0)
    out = experiment.run(spark, train, test, s, str(tmp_path), Echo)
    assert out["predictions"].count() == 8 and out["summary"].count() == 4
    first = out["predictions"].where("strategy = 'similarity' and test_index = 1").first()
    assert first.error == "" and first.total_tokens == 3 and len(first.examples) == 2 and first.examples[0].source_text in ("qand", "qand dur")
    if mode == "dipmt_plus":
        hinted = out["predictions"].where("strategy = 'zero' and test_index = 0").first()
        assert '"tuzdur" may contain dictionary word "tuz", which means "salt"' in hinted.prompt
    status = json.loads(open(out["paths"]["status"]).read())
    assert status["status"] == "finished" and status["completed"] == 8 and status["errors"] == 0
    assert status["status"] == "finished" and open(out["paths"]["summary"], encoding="utf-8-sig").read().startswith("model,target_lang,strategy,k,BLEU")
    s.resume, s.strategies = True, ["zero", "random", "similarity", "diversity"]
    again = experiment.run(spark, train, test, s, str(tmp_path), Echo)
    assert again["predictions"].count() == 8


def test_finished_blocks_are_kept_and_counted(spark, tmp_path, monkeypatch):
    schema = "row_id long, source_text string, target_text string, source_lang string, target_lang string, type string"
    train = spark.createDataFrame([(i, f"s{i} x", f"t{i}", "chg", "en", "phrase") for i in range(4)], schema)
    test = spark.createDataFrame([(i, f"s{i} x", f"t{i}", "chg", "en", "phrase") for i in range(2)], schema)
    s = experiment.Settings(strategies=["random", "similarity"], k_list=[1, 2], retry_delay=0)
    seen, written = [], experiment.sinks.write_status
    append = experiment.sinks.append_records
    monkeypatch.setattr(experiment.sinks, "write_status", lambda path, **u: (seen.append(u), written(path, **u))[1])

    def stopped(df, path, *kind):
        if len([u for u in seen if "blocks_done" in u]) == 2:
            raise RuntimeError("power cut")
        append(df, path, *kind)

    monkeypatch.setattr(experiment.sinks, "append_records", stopped)
    with pytest.raises(RuntimeError, match="power cut"):
        experiment.run(spark, train, test, s, str(tmp_path), Echo)
    assert [(u["blocks_done"], u["completed"]) for u in seen if "blocks_done" in u] == [(1, 2), (2, 4)]
    assert not any(u["status"] == "finished" for u in seen)
    monkeypatch.setattr(experiment.sinks, "append_records", append)
    s.resume = True
    out = experiment.run(spark, train, test, s, str(tmp_path), Echo)
    assert out["predictions"].count() == 8 and spark.read.parquet(out["paths"]["predictions"].removesuffix(".csv")).count() == 8


def test_the_last_write_of_a_key_counts(spark):
    rows = [("random", 1, 0, "old", "", 1), ("random", 1, 0, "new", "", 2), ("zero", 0, 0, "one", "", 1)]
    df = spark.createDataFrame(rows, "strategy string, k int, test_index int, prediction string, error string, written_at int")
    assert sorted(r.prediction for r in experiment.latest(df).collect()) == ["new", "one"]


def test_vectors_of_texts(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "text string, embedding array<float>")
    df = spark.createDataFrame([(0, "b"), (1, "a")], "row_id long, source_text string")
    assert {r.row_id: list(r.embedding) for r in experiment.text_vectors(table)(df, False).collect()} == {0: [0.0, 1.0], 1: [1.0, 0.0]}
    with pytest.raises(Exception, match="no vector of the text"):
        experiment.text_vectors(table)(spark.createDataFrame([(0, "z")], "row_id long, source_text string"), True).collect()


def test_failed_calls_are_recorded(spark, tmp_path):
    class Broken:
        def create(self, **request):
            raise RuntimeError("down")

    schema = "row_id long, source_text string, target_text string, source_lang string, target_lang string, type string"
    train = spark.createDataFrame([(0, "a", "b", "chg", "en", "word")], schema)
    s = experiment.Settings(strategies=["zero"], k_list=[0], api_retries=0)
    got = experiment.run(spark, train, train, s, str(tmp_path), Broken)["predictions"].first()
    assert got.error == "RuntimeError: down" and got.prediction == ""


def test_registry_and_scores(spark):
    runs = spark.createDataFrame([("a", "running"), ("b", "finished")], "run_id string, status string")
    assert [r.status for r in experiment.registered(runs).collect()] == ["interrupted", "finished"]
    df = spark.createDataFrame([("zero", 1, 0, "a", "a", "")], "strategy string, k int, test_index int, prediction string, reference string, error string")
    got = experiment.scores_with_ids(df, "r").collect()
    assert len({r.score_id for r in got}) == 3 and {r.name: r.value for r in got} == {"exact_match": 1.0, "empty_prediction": 0.0, "has_error": 0.0}
