"""An experiment: from corpora to prompts, predictions and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demosift.functions import text as T
from demosift.operators import induction, lexicon, metrics, model_calls, normalize, prompts, sampling
from demosift.sources import sinks, tables

from .retrieval import BACKENDS, GRAPH_STRATEGIES, PROMPT_MODES, STRATEGIES, Index

#: States of a run that did not end, and what a restart makes of them.
UNFINISHED, INTERRUPTED = ("queued", "running", "evaluating"), "interrupted"
#: When a result was written.
WRITTEN = "written_at"
#: Strategies that rank by no score.
UNRANKED = ("zero", "static", "random")
#: Least and largest value of numbers, and of the numbers in a list.
BOUNDS: dict[str, tuple[float, float | None]] = {
    "k_list": (0, None),
    "candidate_n": (1, None),
    "max_examples": (1, None),
    "sample_fraction": (0, 1),
    "lexicon_top_n": (1, None),
    "lexicon_max_entries": (1, None),
    "bli_threshold": (0, None),
    "max_tokens": (1, None),
    "api_retries": (0, None),
    "empty_retries": (0, None),
}


@dataclass
class Settings:
    """What can be set for a run, checked as a whole."""

    target_lang: str = "en"
    source_lang: str = "chg"
    strategies: list[str] = field(default_factory=lambda: ["similarity"])
    k_list: list[int] = field(default_factory=lambda: [8])
    retrieval_backend: str = "bm25"
    prompt_mode: str = "standard"
    model: str = "model"
    embedding_model: str = "intfloat/multilingual-e5-base"
    temperature: float = 0.0
    max_tokens: int = 700
    max_tokens_cap: int = 1500
    chars_per_output_token: float = 3.0
    adaptive_max_tokens: bool = True
    disable_thinking: bool = False
    api_retries: int = 3
    empty_retries: int = 2
    retry_delay: float = 1.0
    workers: int | None = None
    only_sentences: bool = False
    sample_fraction: float | None = None
    max_examples: int | None = None
    seed: int = 42
    candidate_n: int = 40
    ppr_steps: int = 8
    restart_prob: float = 0.35
    dictionary_path: str | None = None
    lexicon_top_n: int = 2
    lexicon_max_entries: int = 80
    lexicon_fuzzy: bool = True
    lexicon_fuzzy_strategy: str = "max_matching"
    enable_bli: bool = False
    bli_lexicon_path: str | None = None
    bli_aligner_path: str | None = None
    bli_threshold: float = 0.6
    static_examples_path: str | None = None
    na_values: str = "pandas"
    run_name: str | None = None
    resume: bool = False
    save_prompts: bool = True

    def validate(self) -> Settings:
        """The settings themselves, or one error that names all that is wrong with them."""
        found = [*self._out_of_range(), *self._unnamed(), *self._at_odds()]
        if found:
            raise ValueError("; ".join(found))
        return self

    def _out_of_range(self) -> list[str]:
        """Numbers beside their bounds; settings without a value are not looked at."""
        out = []
        for name, (least, most) in BOUNDS.items():
            value = getattr(self, name)
            for one in value if isinstance(value, list) else [value]:
                if one is not None and not (one >= least and (most is None or one <= most)):
                    out.append(f"{name}: {one} is not {f'at least {least}' if most is None else f'between {least} and {most}'}")
        if self.sample_fraction == 0:
            out.append("sample_fraction: a sample of nothing")
        if self.max_tokens_cap < self.max_tokens:
            out.append(f"max_tokens_cap: {self.max_tokens_cap} is below max_tokens, {self.max_tokens}")
        return out

    def _unnamed(self) -> list[str]:
        """Names that mean nothing here, and lists that are empty."""
        out = [f"{name}: empty" for name in ("strategies", "k_list") if not getattr(self, name)]
        for name, known in (("strategies", STRATEGIES), ("retrieval_backend", BACKENDS), ("prompt_mode", PROMPT_MODES)):
            value = getattr(self, name)
            out += [f"{name}: {x!r} is none of {'/'.join(known)}" for x in (value if isinstance(value, list) else [value]) if x not in known]
        return out

    def _at_odds(self) -> list[str]:
        """Settings that do not go together."""
        chosen, out = set(self.strategies) & set(STRATEGIES), []
        on_graph = self.retrieval_backend == "graph"
        for strategy in sorted(chosen):
            # strategies that rank by nothing go with every backend
            if strategy not in UNRANKED and on_graph != (strategy in GRAPH_STRATEGIES):
                out.append(f"{strategy} cannot be had from the backend {self.retrieval_backend}")
        if 0 in self.k_list and chosen != {"zero"}:
            out.append("no examples (k 0) go with zero alone")
        if "static" in chosen and not self.static_examples_path:
            out.append("static has no file of examples (static_examples_path)")
        if self.static_examples_path and chosen != {"static"}:
            out.append("a file of examples (static_examples_path) serves static and nothing beside it")
        if self.enable_bli and self.prompt_mode != "dipmt_plus":
            out.append("induced pairs (enable_bli) show only in the prompt mode dipmt_plus")
        return out


def prepare(train: DataFrame, test: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Filtered and sampled corpora with dense row ids; test rows are named by their place."""
    train, test = normalize.split_pairs(train, test, s.target_lang, s.only_sentences)
    train, test = sampling.sample_pair(train, test, s.sample_fraction, s.seed)
    train, test = tables.renumbered(train), tables.renumbered(test)
    if s.max_examples is not None:
        test = test.orderBy("row_id").limit(s.max_examples)
    for name, df in (("train", train), ("test", test)):
        if df.isEmpty():
            raise ValueError(f"the {name} corpus is empty once filtered and sampled")
    return train, test


def make_lexicon(spark: SparkSession, train: DataFrame, s: Settings, folder: str | None = None) -> DataFrame | None:
    """The dictionary of hinted prompts: a file's or else all of the train corpus', and induced pairs."""
    if s.prompt_mode != "dipmt_plus":
        return None
    source = train
    if s.dictionary_path:
        source = tables.read_dictionary(spark, tables.optional_path(s.dictionary_path, folder), s.source_lang, s.target_lang, s.na_values)
    found = lexicon.build(source, s.source_lang, s.target_lang)
    if s.enable_bli:
        pairs = induction.pairs_from(spark, train, s.bli_lexicon_path, s.bli_aligner_path, folder or ".", s.bli_threshold)
        found = lexicon.extend(found, pairs.withColumn("row_id", F.monotonically_increasing_id()))
    return found


def work_items(index: Index, test: DataFrame, lex: DataFrame | None, s: Settings) -> DataFrame:
    """A row for every test row, k and strategy: examples, prompt, budget and request."""
    rows = test.select("row_id", *[F.col(c) for c in ("id",) if c in test.columns], "source_text", F.col("target_text").alias("reference"), "type")
    look = lambda df, key: lexicon.lookup(df, lex, key, "source_text", s.lexicon_fuzzy_strategy if s.lexicon_fuzzy else None, s.lexicon_top_n, s.lexicon_max_entries)
    hinted = lex is not None
    if hinted:
        # each text is looked up once, however often it is retrieved
        of_rows = look(index.corpus if index.static is None else index.static, "row_id")
        rows = rows.join(look(test, "row_id").withColumnRenamed("entries", "input_lexicon_entries"), "row_id")
    out: DataFrame | None = None
    for k in s.k_list:
        for strategy in s.strategies:
            found = index.examples(strategy, k)
            if hinted:
                found = found.join(of_rows, "row_id")
            lists = prompts.examples_of(found, hinted)
            part = rows.join(lists.withColumnRenamed("query_id", "of"), F.col("row_id") == F.col("of"), "left").drop("of")
            empty = F.array().cast(lists.schema["examples"].dataType)
            part = part.withColumns({"examples": F.coalesce("examples", empty), "k": F.lit(k), "strategy": F.lit(strategy)})
            out = part if out is None else out.unionByName(part)
    text = F.col("source_text")
    budget = normalize.request_budget(text, s.max_tokens, s.max_tokens_cap, s.chars_per_output_token, s.adaptive_max_tokens)
    entries = F.col("input_lexicon_entries") if hinted else None
    out = out.withColumn("prompt", prompts.prompt(F.col("examples"), text, F.lit(s.source_lang), F.lit(s.target_lang), s.prompt_mode, entries)).withColumn("max_tokens", budget)
    out = out.withColumn("retry_max_tokens", normalize.empty_retry_budget("max_tokens", s.max_tokens, s.max_tokens_cap))
    request = prompts.request(F.col("prompt"), s.model, s.temperature, F.col("max_tokens"), s.disable_thinking)
    return out.withColumn("request", F.to_json(request)).withColumnRenamed("row_id", "test_index")


def run(spark: SparkSession, train: DataFrame, test: DataFrame, s: Settings, folder: str, make_client: Callable[[], Any], vectors: Callable[[DataFrame, bool], DataFrame] | None = None) -> dict:
    """Runs what is pending and evaluates; tables and small files lie below ``folder``.

    ``vectors``: makes ``row_id, embedding`` of a corpus (second argument: as queries).  A block is one k and
    strategy: its results are stored and the status file counts them before the next one begins, and a run
    that resumes leaves out keys that have a result.  The run has finished once the summary is written.
    """
    s.validate()
    lex = make_lexicon(spark, train, s, folder)
    train, test = prepare(train, test, s)
    args = asdict(s)
    paths = sinks.output_paths(folder, args, s.model)
    static = tables.read_static_examples(spark, s.static_examples_path, s.target_lang, s.source_lang, s.only_sentences, s.na_values) if s.static_examples_path else None
    queries = test.select(F.col("row_id").alias("query_id"), F.col("source_text").alias("text"), "type", *[c for c in ("length",) if c in test.columns])
    own = vectors(train, False) if vectors else None
    asked = vectors(test, True).withColumnRenamed("row_id", "query_id") if vectors else None
    index = Index(train, queries, s.retrieval_backend, own, asked, static, s.seed, s.candidate_n, s.ppr_steps, s.restart_prob)
    at = paths["predictions"].removesuffix(".csv")
    if not s.resume:
        sinks.remove([at, *[p for n, p in paths.items() if n != "base_name"]])
    lex_stats = lexicon.stats(lex).first().asDict() if lex is not None else None
    sinks.write_json(paths["manifest"], sinks.manifest(args, s.model, train, test, sinks.fingerprint(train), paths, lex_stats))
    sinks.write_status(paths["status"], status="running")
    work = work_items(index, test, lex, s)
    done = _existing(spark, at)
    if done is not None:
        work = model_calls.pending(work, done)
    constants = {"source_lang": s.source_lang, "target_lang": s.target_lang, "retrieval_backend": s.retrieval_backend, "prompt_mode": s.prompt_mode, "embedding_model": s.embedding_model, "model": s.model, "temperature": s.temperature}
    blocks = [(k, strategy) for k in s.k_list for strategy in s.strategies]
    for n, (k, strategy) in enumerate(blocks):
        # the other blocks' branches of the plan fall away with the filter
        block = work.where((F.col("k") == k) & (F.col("strategy") == strategy))
        found = model_calls.map_calls(block, make_client, s.workers, max_retries=s.api_retries, delay=s.retry_delay, empty_retries=s.empty_retries)
        found = found.withColumns({**{c: F.lit(v) for c, v in constants.items()}, WRITTEN: F.current_timestamp()})
        sinks.append_records(found, at)
        sinks.write_status(paths["status"], status="running", blocks=len(blocks), blocks_done=n + 1, k=k, strategy=strategy, **_counts(spark, at))
    predictions = latest(spark.read.parquet(at))
    if s.save_prompts:
        for name, df in records(predictions).items():
            df.write.mode("overwrite").json(paths[name].removesuffix(".jsonl"))
    counts = _counts(spark, at)
    sinks.write_status(paths["status"], status="evaluating", **counts)
    summary = metrics.evaluate(predictions)
    sinks.write_summary(summary, paths["summary"])
    # finished once the summary is there
    sinks.write_status(paths["status"], status="finished", **counts)
    return {"predictions": predictions, "summary": summary, "paths": paths}


def _counts(spark: SparkSession, path: str) -> dict:
    return latest(spark.read.parquet(path)).transform(model_calls.run_counts).first().asDict()


def text_vectors(table: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    """Vectors of a corpus' rows out of a table ``text, embedding``; a text without one is an error."""

    def of(df: DataFrame, asked: bool) -> DataFrame:
        known = table.select(F.col("text").alias("source_text"), "embedding").dropDuplicates(["source_text"])
        found = df.select("row_id", "source_text").join(known, "source_text", "left")
        missing = F.raise_error(F.concat(F.lit("no vector of the text: "), F.left("source_text", F.lit(80))))
        return found.select("row_id", F.coalesce("embedding", missing.cast("array<float>")).alias("embedding"))

    return of


def records(predictions: DataFrame) -> dict[str, DataFrame]:
    """What a run keeps beside its predictions: prompts, requests with their outcome, retrieved examples."""
    common = [c for c in ("test_index", "id", "source_text", "reference", "source_lang", "target_lang", "type", "strategy", "k", "retrieval_backend", "prompt_mode", "embedding_model") if c in predictions.columns]
    hints = [c for c in ("input_lexicon_entries",) if c in predictions.columns]
    fields = [c for c in ("source_text", "target_text", "target_lang", "type") if c in predictions.schema["examples"].dataType.elementType.names]
    shown = F.transform("examples", lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias("retrieved_examples")
    info = F.struct("finish_reason", F.col("llm_attempts").alias("attempts"), "empty_retries", F.col("response_max_tokens").alias("max_tokens")).alias("response_info")
    usage = F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("usage")
    message = "struct<model:string,temperature:double,max_tokens:int,messages:array<struct<role:string,content:string>>,extra_body:struct<enable_thinking:boolean>>"
    return {
        "prompts": predictions.select(*common, "max_tokens", "prompt", shown, *hints),
        "requests": predictions.select(*common, F.from_json("request", message).alias("request_payload"), "prediction", "error", usage, info),
        "retrieved_examples": predictions.select(*common, shown, *hints),
    }


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def latest(predictions: DataFrame) -> DataFrame:
    """One row for each key, the last one written: retried tasks and resumed runs can write a key again."""
    if WRITTEN not in predictions.columns:
        return predictions.dropDuplicates(list(model_calls.KEY))
    last = Window.partitionBy(*model_calls.KEY).orderBy(F.desc(WRITTEN), "prediction", "error")
    return predictions.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def registered(runs: DataFrame) -> DataFrame:
    """A registry of runs as it is after a restart: what had not ended counts as interrupted."""
    return runs.withColumn("status", F.when(F.col("status").isin(*UNFINISHED), INTERRUPTED).otherwise(F.col("status")))


def scores_with_ids(df: DataFrame, run_name: str) -> DataFrame:
    """Flags of each prediction as named scores with stable ids, for any tracking service."""
    flags = normalize.outcome_flags(df)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in ("exact_match", "empty_prediction", "has_error")]))
    out = flags.select("strategy", "k", "test_index", parts.alias("s")).select("strategy", "k", "test_index", "s.*")
    return out.withColumn("score_id", T.score_id(F.lit(run_name), "strategy", "k", "test_index", "name"))
