"""Writing results: tables of records, small JSON files, names of outputs, removal."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demosift.functions import text as T

FINGERPRINTED = ("source_text", "target_text", "target_lang", "type")
#: Row ids of a range that is hashed at a time, as a power of two.
TREE_BITS = 12
OUTPUTS = {"predictions": "csv", "prompts": "jsonl", "requests": "jsonl", "retrieved_examples": "jsonl", "manifest": "json", "status": "json", "summary": "csv"}


def append_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds records to a table of ``parquet``, ``json`` or ``csv`` files."""
    writer = df.write.mode("append")
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds few records to one CSV file on the driver, the header and a byte-order mark only to a new file."""
    pdf = df.toPandas()
    new = not os.path.exists(path)
    pdf.to_csv(path, mode="a", header=new, index=False, encoding="utf-8-sig" if new else "utf-8")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds few records to one file of JSON lines on the driver, letters kept as they are."""
    with open(path, "a", encoding="utf-8") as f:
        for line in df.toJSON().toLocalIterator():
            f.write(line + "\n")


def write_json(path: str, payload: dict) -> None:
    """Replaces a file at once, so that a reader never sees half of it."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    beside = at.with_suffix(at.suffix + ".tmp")
    beside.write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")
    beside.replace(at)


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def write_status(path: str, **updates: object) -> None:
    write_json(path, {"updated_at": now(), **updates})


def value_counts(df: DataFrame, columns: tuple[str, ...] = ("target_lang", "type")) -> DataFrame:
    """``column, value, count`` of all values of the named columns, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).groupBy("c.column", "c.value").count()


def fingerprint(df: DataFrame, row_id: str = "row_id") -> str:
    """16 hex digits that change with any row, value or order.

    Rows are hashed, then digests of ranges of row ids, in order, then digests of ranges of ranges, and so
    on up a tree; no task holds more than a range.  For the exact digest of small tables see
    ``plain_fingerprint``.
    """
    level = df.select(F.col(row_id).cast("long").alias("at"), F.sha2(_row_text().cast("binary"), 256).alias("h"))
    up = lambda x: x.groupBy(F.shiftright("at", TREE_BITS).alias("at")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda s: F.concat_ws(":", s["at"].cast("string"), s["h"]))).cast("binary"), 256).alias("h"))
    # the least and largest id tell how many levels there are
    low, high = df.agg(F.min(row_id), F.max(row_id)).first()
    while low is not None and low != high:
        level, low, high = up(level), low >> TREE_BITS, high >> TREE_BITS
    top = level.first()
    return top.h[:16] if top else plain_fingerprint(df, row_id)


def _row_text() -> F.Column:
    cells = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\0")) for c in FINGERPRINTED]
    return F.concat(*cells, F.lit("\n"))


def plain_fingerprint(df: DataFrame, row_id: str = "row_id") -> str:
    """16 hex digits of the digest over the number of rows and all cells in order, streamed to the driver."""
    import hashlib

    digest = hashlib.sha256(str(df.count()).encode())
    for r in df.orderBy(row_id).select(_row_text().alias("t")).toLocalIterator():
        digest.update(r.t.encode())
    return digest.hexdigest()[:16]


def loose_fingerprint(df: DataFrame) -> DataFrame:
    """One row with a sum of row hashes: independent of order, at any size."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.pmod(F.xxhash64(*FINGERPRINTED), F.lit(1 << 31))).alias("hash_sum"))


def manifest(args: dict, model: str, train: DataFrame, test: DataFrame, digest: str, paths: dict, lexicon: dict | None = None) -> dict:
    """What a run was made of."""
    data: dict = {"fingerprint": digest, "train_rows": train.count(), "test_rows": test.count()}
    for name, df in (("train", train), ("test", test)):
        for r in value_counts(df).collect():
            data.setdefault(f"{name}_{r['column']}_counts", {})[r["value"]] = r["count"]
    return {"created_at": now(), "base_name": paths["base_name"], "model": model, "args": args, "data": data, "lexicon": lexicon, "paths": {k: v for k, v in paths.items() if k != "base_name"}}


def base_name(args: dict, model: str) -> str:
    """Name of a run, from its settings if none is given."""
    if args.get("run_name"):
        return args["run_name"]
    stem = lambda p: T.safe_name(Path(p).stem)
    mode, backend = args.get("prompt_mode", "standard"), args.get("retrieval_backend", "dense")
    parts = [args["target_lang"]]
    if mode != "standard":
        parts.append(mode)
        if args.get("dictionary_path"):
            parts.append(f"dict_{stem(args['dictionary_path'])}")
    if args.get("enable_bli"):
        parts.append("bli")
    parts += ["-".join(args["strategies"]), "k" + "-".join(map(str, args["k_list"]))]
    if args.get("static_examples_path"):
        parts.append(f"static_{stem(args['static_examples_path'])}")
    else:
        parts.append(T.safe_name(args.get("embedding_model", "intfloat/multilingual-e5-base")) if backend == "dense" else backend)
    return "_".join([*parts, T.safe_name(model)])


def output_paths(folder: str, args: dict, model: str) -> dict:
    name = base_name(args, model)
    return {"base_name": name} | {kind: f"{folder}/{kind}_{name}.{tail}" for kind, tail in OUTPUTS.items()}


def remove(paths: list[str]) -> None:
    for p in paths:
        if os.path.isdir(p):
            shutil.rmtree(p)
        elif os.path.exists(p):
            os.remove(p)


def write_summary(df: DataFrame, path: str) -> None:
    """The few rows of a summary as one CSV file with a byte-order mark."""
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")
