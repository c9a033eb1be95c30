"""Prompts as columns: instruction, demonstrations, dictionary hints, input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demosift.functions import text as T

MODES = ("standard", "dipmt_plus")
# fixed values: the texts of the prompts
NO_HINTS = "Vocabulary hints: no matching dictionary entries found.\n"
HINTS = "Vocabulary hints:\n"
PLAIN_TASK = "Output only the translation. Do not explain anything.\n\nExamples:\n"
HINTED_TASK = "Use the vocabulary hints and the examples as in-context guidance.\nOutput only the translation. Do not explain anything.\n\n"


def hints(entries: Column) -> Column:
    """The hints of a list of dictionary entries; entries without source or translation are left out."""
    clean = F.transform(
        F.coalesce(entries, F.array().cast("array<struct<query:string,source:string,translations:array<string>,match:string>>")),
        lambda e: F.struct(
            T.strip(F.coalesce(e["query"], F.lit(""))).alias("query"),
            T.strip(F.coalesce(e["source"], F.lit(""))).alias("source"),
            F.filter(F.transform(e["translations"], T.strip), lambda t: t != "").alias("translations"),
            F.coalesce(T.strip(e["match"]), F.lit("exact")).alias("match"),
        ),
    )
    good = F.filter(clean, lambda e: (e["source"] != "") & (F.size(e["translations"]) > 0))

    def line(e: Column) -> Column:
        meanings = F.concat(F.lit('"'), F.array_join(e["translations"], '" or "'), F.lit('"'))
        inside = (e["match"] == "fuzzy") & (e["query"] != "") & (e["query"] != e["source"])
        part = F.concat(F.lit('- "'), e["query"], F.lit('" may contain dictionary word "'), e["source"], F.lit('", which means '), meanings, F.lit(".\n"))
        return F.when(inside, part).otherwise(F.concat(F.lit('- "'), e["source"], F.lit('" means '), meanings, F.lit(".\n")))

    return F.when(F.size(good) > 0, F.concat(F.lit(HINTS), F.array_join(F.transform(good, line), ""))).otherwise(F.lit(NO_HINTS))


def prompt(examples: Column, text: Column, source_lang: Column, target_lang: Column, mode: str = "standard", entries: Column | None = None) -> Column:
    """A prompt from ordered examples (``source_text, target_text`` and, with hints, ``entries``)."""
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"no prompt mode is called {mode}")
    source, target = T.source_name(source_lang), T.target_name(target_lang)
    task = F.concat(F.lit("Task: Translate the following "), source, F.lit(" texts to "), target, F.lit(".\n"))
    said = lambda name, value: F.concat(name, F.lit(": "), value)
    strip = lambda c: T.strip(F.coalesce(c, F.lit("")))
    last = F.concat(F.lit("Now translate:\n"), said(source, text), F.lit("\n"))
    if mode == "standard":
        shown = F.transform(examples, lambda e: F.concat(said(source, strip(e["source_text"])), F.lit("\n"), said(target, strip(e["target_text"])), F.lit("\n\n")))
        return F.concat(task, F.lit(PLAIN_TASK), F.array_join(shown, ""), last, target, F.lit(":"))

    def example(e: Column, i: Column) -> Column:
        number = F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"))
        return F.concat(number, said(source, strip(e["source_text"])), F.lit("\n"), hints(e["entries"]), said(target, strip(e["target_text"])), F.lit("\n\n"))

    none = F.lit(None).cast("array<struct<query:string,source:string,translations:array<string>,match:string>>")
    return F.concat(task, F.lit(HINTED_TASK), F.array_join(F.transform(examples, example), ""), last, hints(none if entries is None else entries), target, F.lit(":"))


def examples_of(retrieved: DataFrame, hinted: bool = False) -> DataFrame:
    """``query_id, examples``: the retrieved rows of each query in order of their rank."""
    fields = ["rank", "row_id", "source_text", "target_text", "target_lang", "type", *(["entries"] if hinted else [])]
    known = [c for c in fields if c in retrieved.columns]
    return retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*known)), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)).alias("examples"))


def request(prompt_text: Column, model: str, temperature: float, max_tokens: Column, disable_thinking: bool = False) -> Column:
    """The request to a chat model."""
    fields = [F.lit(model).alias("model"), F.lit(float(temperature)).alias("temperature"), max_tokens.cast("int").alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), prompt_text.alias("content"))).alias("messages")]
    if disable_thinking:
        fields.append(F.struct(F.lit(False).alias("enable_thinking")).alias("extra_body"))
    return F.struct(*fields)
