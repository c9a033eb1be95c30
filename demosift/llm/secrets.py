"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong spans (assignments, access ids, long hex) are reported wherever they match.  Weak candidates are
parts of a credential that mean nothing alone: named identifiers, random-looking tokens and endpoints.
They are interval-joined inside a document: two parts belong together when at most ``SCOPE`` code
points lie between them, and a weak part is reported only if its complement is in scope - an identifier
near a secret, a token near an identifier, an endpoint near both.  The join is a sweep over parts in
order of position (running maxima of ends, running minima of starts from the other side), so no
pairs are made and a document with many parts costs a sort.

Matches are found with the engine's regular expressions; positions follow from the lengths of the texts
between them, summed in a window.  Rows meet only by document, which goes by its place in the input: reading
that must give the same rows in the same order again, as stored tables do.

Defined results: a null text is empty; empty and spanless texts give zero counts and empty strings;
repeated rows give repeated results; spans that touch or overlap are all reported; other columns are
ignored (``redact`` passes them through); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*[A-Z0-9])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
VALUE, SCOPE = 6, 200
MARK = "[SECRET]"


def _found(text: Column, pattern: str, kind: int, when: Column, value: int | None = None) -> Column:
    """An element for every match: its number, the length before it since the last, its length, whether it holds."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else None

    def one(x: Column, i: Column) -> Column:
        holds = F.length(F.get(values, i)) >= VALUE if value else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).alias("gap"), F.length(x).alias("n"), holds.alias("holds"))

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,holds:boolean>>")
    return F.when(when, F.transform(matches, one)).otherwise(none)


def _signs(text: Column) -> dict[str, Column]:
    """Whether a text (not null) has an assignment, the start of an access id, long hex, parts that may link up."""
    a, k, x = text.rlike(ASSIGN), text.contains("AKIA"), text.rlike(HEX)
    return {"a": a, "k": k, "x": x, "linkable": (a | x | text.rlike(TOKEN)) & (k | text.rlike(IDENT))}


def _linked(df: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    """``row`` (the carried struct) and the sorted ``spans`` of every row of ``df``."""
    # a number for every row, so that rows that repeat, or have no id, never meet
    rows = df.select(carried.alias("row"), F.monotonically_increasing_id().alias("number"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    text = F.col("body")
    rows = rows.select("row", "number", "body", *[c.alias(name) for name, c in _signs(text).items()])
    parts = F.concat(
        _found(text, ASSIGN, 0, F.col("a"), 2),
        _found(text, ACCESS, 1, F.col("k")),
        _found(text, HEX, 2, F.col("x")),
        _found(text, IDENT, 3, F.col("linkable")),
        _found(text, TOKEN, 4, F.col("linkable")),
        _found(text, ENDPOINT, 5, F.col("linkable")),
    )
    own = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(True).alias("holds")))
    rows = rows.select("row", "number", F.explode(F.concat(own, parts)).alias("p"))
    rows = rows.select(F.when(F.col("p.kind") < 0, F.col("row")).alias("row"), "number", "p.*")
    key = ["number"]
    rows = rows.repartition(partitions(df.sparkSession), *key)
    in_kind = Window.partitionBy(*key, "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(in_kind.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("n"))
    strong, real = F.col("kind").between(0, 2) & F.col("holds"), F.col("holds")
    roles = {"ident": real & F.col("kind").isin(1, 3), "secret": real & F.col("kind").isin(0, 2, 4), "base": strong}
    onward = Window.partitionBy(*key).orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    for name, is_it in roles.items():
        rows = rows.withColumn(f"{name}_before", F.max(F.when(is_it, F.col("end"))).over(onward))
    for name, is_it in roles.items():
        rows = rows.withColumn(f"{name}_after", F.min(F.when(is_it, F.col("start"))).over(back))
    near = lambda n: F.coalesce(F.col("start") - F.col(f"{n}_before") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{n}_after") - F.col("end") <= SCOPE, F.lit(False))
    clear = F.coalesce(F.col("base_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("base_after") >= F.col("end"), F.lit(True))
    weak = (
        F.when(F.col("kind") == 3, near("secret") & clear)
        .when(F.col("kind") == 4, near("ident") & clear)
        .when(F.col("kind") == 5, near("ident") & near("secret"))
        .otherwise(F.lit(False))
    )
    rows = rows.select(*key, "row", "kind", "start", "end", (strong | weak).alias("told"))
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("told"), F.col("end"))).over(onward), F.lit(0)))
    span = F.when(F.col("told"), F.struct("start", "kind", "end", "before"))
    return rows.groupBy(*key).agg(F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list(span)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans, base``: all reported spans of a row, and the strong ones, as ``kind:start:end``."""
    found = _linked(df, id_col, text_col, F.struct(F.col(id_col).alias("id")))
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("row.id").alias(id_col), *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], _joined(base).alias("base"), _joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with every run of reported spans replaced by a mark; null texts stay null.

    Rows whose text has no sign of a part can hold no span: they pass as they are, and only the others move.
    """
    signs = _signs(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    some = signs["a"] | signs["k"] | signs["x"] | signs["linkable"]
    found = _linked(df.where(some), id_col, text_col, F.struct(*[F.col(c) for c in df.columns]))
    body = F.col("row")[text_col]
    piece = lambda s: F.when(s["start"] >= s["before"], F.concat(F.substring(body, s["before"] + 1, s["start"] - s["before"]), F.lit(MARK))).otherwise(F.lit(""))
    last = F.greatest(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(body, last + 1, F.length(body)))).otherwise(body)
    changed = found.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
    return changed.unionByName(df.where(~some))
