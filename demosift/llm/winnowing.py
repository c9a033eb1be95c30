"""Document fingerprints by winnowing, in DataFrame expressions only.

Every word is hashed once; word hashes are rolled on to hashes of ``K`` consecutive words; of every window of
``WINDOW`` grams the smallest hash is kept, the rightmost one where it ties.  A kept hash and its position
are packed into one long whose order is that of the rule (hash first, later positions first), so window
minima are three pairwise minima of shifted arrays instead of one scan per window.  Any passage that two
texts share over ``WINDOW + K - 1`` words leaves a common hash in both.

A kept hash is the upper 34 bits of its gram's; equal passages give equal hashes, and an index over very many texts
has to compare the passages themselves.

Defined results: a null text is empty; rows without id come after all others, rows of one id and those without by
a hash of their texts, repeated rows in any order, as they are alike; a text without words has the empty fingerprint; one of fewer words
than a gram hashes as a whole; one of fewer grams than a window keeps its minimum.  Two empty fingerprints
are alike (1).  Columns other than the two named are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: Words of a gram, and grams of a window (a power of two).
K, WINDOW = 5, 8
#: Low bits of a packed value that hold the position, counted down.
POSITION_BITS = 30
_LOW = (1 << POSITION_BITS) - 1
#: Rows without id are dealt into so many ranges, as a power of two.
NAMELESS_BITS = 12


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def packed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Kept (hash, position) pairs of a text, packed, in order of position."""
    if window & (window - 1):
        raise ValueError("a window is a power of two")
    hashes = F.transform(_words(text), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: _kept(h, k, window))[0]


def _kept(h: Column, k: int, window: int) -> Column:
    pack = lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - i).cast("long"))
    found, at = F.transform(_rolled(h, k), pack), 1
    while at < window:
        # bound to a lambda's variable, so that each step is computed once
        found = F.transform(F.array(found), _halved(at))[0]
        at *= 2
    return F.array_distinct(found)


def _rotated(x: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _rolled(h: Column, k: int) -> Column:
    """Hashes of all grams of ``k`` words: the exclusive or of the words' hashes, each rotated by how many words follow.

    Hashes of shorter grams are rolled on to longer ones, twice as long each time and then by a word, so no gram goes
    through its words again.  A text of fewer words is one gram, as if zeros followed.
    """
    n = F.size(h)
    grams = words = F.when((n > 0) & (n < k), F.concat(h, F.array_repeat(F.lit(0).cast("long"), k - n))).otherwise(h)
    width = 1
    while width < k:
        more = width if 2 * width <= k else 1
        grams = F.transform(F.array(grams), _longer(None if more == width else words, width, more))[0]
        width += more
    return grams


def _longer(words: Column | None, width: int, more: int):
    """Grams of ``width`` words, each joined to the gram of equal width behind it or, if given, to the next word."""

    def joined(a: Column) -> Column:
        tail = a if words is None else words
        room = F.greatest(F.size(tail) - width, F.lit(0))
        return F.zip_with(F.slice(a, 1, room), F.slice(tail, width + 1, room), lambda x, y: _rotated(x, more).bitwiseXOR(y))

    return joined


def _halved(at: int):
    """Minima over windows of twice the size, from minima over windows of ``at``."""

    def minima(a: Column) -> Column:
        n = F.size(a) - at
        pairs = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(a, at + 1, F.greatest(n, F.lit(0))), lambda x, y: F.least(x, y))
        return F.when(n > 0, pairs).when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(a)

    return minima


def position(x: Column) -> Column:
    return F.lit(_LOW).cast("long") - x.bitwiseAND(F.lit(_LOW))


def hash_of(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(a) + F.size(b) - both
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, hash_of))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``id, hashes, positions``: positions count words from 0."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    found = df.select(df[id_col].alias("id"), packed(text, k, window).alias("p"))
    return found.select(F.col("id").alias(id_col), F.transform("p", hash_of).alias("hashes"), F.transform("p", position).alias("positions"))


def written(fingerprint: Column) -> Column:
    """``hash@position``, joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws("@", hash_of(x).cast("string"), position(x).cast("string"))), ",")


def with_next(df: DataFrame, order: str, rows_per_range: int = 1024, most_ranges: int = 65536) -> tuple[DataFrame, Window]:
    """Rows dealt into ranges of ``order``, and a window over a range in descending order.

    The first row of each following range is added to a range as a guest (``guest``), and the very first
    row to the last range, so that the row after any own row stands in its window.  Ranges are even
    cells of the key, each cut between its own ends by the rows it has; rows without key come last, in ranges
    of a hash of what they hold.
    """
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    cells = 1024
    width = max(1, -(-(hi - lo + 1) // cells))
    # ids can lie farther apart than a long counts
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    offset = (F.col(order).cast("decimal(20,0)") - wide(lo)).cast("decimal(20,0)")
    cell = F.call_function("div", offset, wide(width)).cast("int")
    found = df.where(F.col(order).isNotNull()).groupBy(cell.alias("c")).agg(F.count("*"), F.min(offset), F.max(offset)).collect()
    held = {r[0]: (r[1], int(r[2]), int(r[3])) for r in found}
    per = max(rows_per_range, -(-n // most_ranges))
    starts, steps, first, total = [], [], [], 0
    for c in range(cells):
        count, low, high = held.get(c, (1, 0, 0))
        step = max(1, -(-(high - low + 1) // max(1, -(-count // per))))
        starts.append(low)
        steps.append(step)
        first.append(total)
        total += (high - low) // step + 1
    array = lambda x, kind="bigint": F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>")
    inside = F.call_function("div", (offset - F.get(array(starts, "decimal(20,0)"), cell)).cast("long"), F.get(array(steps), cell))
    # rows of one id follow each other by a hash of what else they hold, and so are dealt if they have none
    df = df.withColumn("tie", F.xxhash64(F.lit(0), *[c for c in df.columns if c != order]))
    nameless = F.shiftright(F.col("tie"), 64 - NAMELESS_BITS) - (1 << NAMELESS_BITS - 1)
    ranged = df.withColumn("range", F.when(F.col(order).isNull(), nameless).otherwise(F.get(array(first), cell) + inside).cast("long"))
    tops = ranged.groupBy("range").agg(F.max(F.struct(order, "tie")).alias("top")).select("range", f"top.{order}", "top.tie")
    tops = tops.withColumnsRenamed({order: "top", "tie": "top_tie"})
    # a row for each range at most, so below any broadcast limit; descending, a range's guest goes to the range above
    above = tops.select(F.col("range").alias("top_range"), "top", "top_tie", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(Window.orderBy("range"))).alias("host"))
    is_top = (F.col("range") == F.col("top_range")) & F.col(order).eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    dealt = ranged.join(F.broadcast(above), is_top, "left").drop("top_range", "top", "top_tie")
    one = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    two = F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("host").isNull(), F.array(one)).otherwise(F.array(one, two))))
    dealt = dealt.drop("range", "host").select("*", "place.range", "place.guest").drop("place")
    return dealt, Window.partitionBy("range").orderBy("guest", F.desc_nulls_last(order), F.desc("tie"), *[c for c in df.columns if c not in (order, "tie")])


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """How like a document stays to its edited self, and how like it is to the next one.

    The edited text has its last third replaced by the beginning of the next document, ids descending,
    the first one following the last.  Ids are integers.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("body"))
    rows, order = with_next(rows, "id")
    rows = rows.withColumn("next", F.coalesce(F.lead("body").over(order), F.lit("")))
    n = F.length("body")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third))
    rows = rows.select("range", "guest", "id", "tie", "body", edited.alias("edited"), n.cast("long").alias("n_chars"), packed(F.col("body"), k, window).alias("own"))
    rows = rows.withColumn("next_own", F.lead("own").over(order)).where("guest = 0")
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", packed(F.col("edited"), k, window).alias("changed"))
    rows = rows.select("*", hashes(F.col("own")).alias("a"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("a"), hashes(F.col("changed"))).alias("near_edited"),
        likeness(F.col("a"), hashes(F.col("next_own"))).alias("near_next"),
    )
