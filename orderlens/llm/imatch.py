"""I-Match fingerprints: hashes of the terms inside a band of document frequency.

The lexicon holds the terms found in between ``LOW`` and ``HIGH`` of all
documents, counted over all of them. At most (mean terms a document) / LOW terms
can be that frequent, at any size of the corpus. Up to ``IN_PLAN`` of them travel
inside the plan as buckets by hash; a larger lexicon stays a table and is joined with
the terms of the texts, with equal results. A text's distinct lexicon terms are sorted and hashed as a whole and once for each of
``SUBSETS`` random parts of the lexicon (a term is in one part of eight). Texts are
alike by the share of parts whose hashes agree, counting parts in which either has
a term; texts with equal whole hashes are alike by 1. All of it is built-in
functions.

Defined results: NULL texts are empty. A text without lexicon terms takes all its
terms instead; a text without terms has an empty whole hash. Two texts without any
part to compare are alike by 1 if their fingerprints are equal, else 0. Equal texts have equal
fingerprints. A NULL doc_id has no place in the order of documents: its next
document is empty. Rows with one doc_id follow one another by the hash of their
text. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from orderlens.llm.text import words_of
from orderlens.session import materialise

LOW, HIGH = 0.0005, 0.02
IN_PLAN = 1 << 18  # most terms of a lexicon that is sent inside the plan
SUBSETS = 16
SPAN = 4096  # ids of a window


def term_hashes(text: Column) -> Column:
    """Distinct terms as 64-bit hashes."""
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w)))


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): every term of the lexicon."""
    counted = (
        docs.select(F.explode(term_hashes(F.col("text").cast("string"))).alias("term"))
        .groupBy("term")
        .count()
    )
    n = docs.count()
    kept = counted.filter((F.col("count") >= low * n) & (F.col("count") <= high * n) & (F.col("count") > 1))
    return materialise(kept.select("term"), "lexicon")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, in_plan: int = IN_PLAN) -> Callable[[DataFrame], DataFrame]:
    """What adds __banded, the lexicon terms of __every in any order, to a table."""
    terms = band(docs, low, high)
    n = terms.count()
    if n > in_plan:
        return lambda df: _joined(df, terms)
    slots = 1 << n.bit_length()
    buckets: list[list[int]] = [[] for _ in range(slots)]
    for (term,) in terms.collect():  # at most in_plan rows
        buckets[term % slots].append(term)
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")
    inside = lambda t: F.array_contains(F.get(table, F.pmod(t, F.lit(slots)).cast("int")), t)
    return lambda df: df.withColumn("__banded", F.filter("__every", inside))


def _joined(df: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows are numbered and written, so that the numbers stay."""
    rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "imatch-rows")
    found = rows.select("__row", F.explode("__every").alias("term")).join(terms, "term")
    found = found.groupBy("__row").agg(F.collect_list("term").alias("__banded"))
    none = F.array().cast("array<bigint>")
    return rows.join(found, "__row", "left").withColumn("__banded", F.coalesce("__banded", none)).drop("__row")


def _digest(terms: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit("-")).otherwise(
        F.substring(F.lpad(F.hex(F.xxhash64(terms)), 16, "0"), 1, 8)
    )


def _part(terms: Column, i: int) -> Column:
    """The terms of the i-th random part of the lexicon: three bits of a term's hash are zero."""
    return F.filter(terms, lambda t: F.shiftrightunsigned(t, 16 + 3 * i).bitwiseAND(7) == 0)


def with_fingerprint(df: DataFrame, text: str, banded: Callable[[DataFrame], DataFrame], prefix: str = "") -> DataFrame:
    """``df`` with {prefix}parts (array) and {prefix}fingerprint (text) of column ``text``."""
    every = term_hashes(F.col(text))
    out = banded(df.withColumn("__every", every))
    out = out.withColumn("terms", F.sort_array(F.when(F.size("__banded") > 0, F.col("__banded")).otherwise(F.col("__every"))))
    terms = F.col("terms")
    parts = F.array(*[_digest(_part(terms, i)) for i in range(SUBSETS)])
    out = out.withColumn(f"{prefix}parts", parts).withColumn("__whole", _digest(terms))
    joined = F.concat_ws(":", F.col("__whole"), F.array_join(F.col(f"{prefix}parts"), ":"))
    return out.withColumn(f"{prefix}fingerprint", joined).drop("__every", "__banded", "terms", "__whole")


def likeness(a: str, b: str) -> Column:
    """Likeness of the fingerprints {a}fingerprint and {b}fingerprint, 0 to 1."""
    pairs = F.zip_with(
        F.col(f"{a}parts"),
        F.col(f"{b}parts"),
        lambda x, y: F.when((x == "-") & (y == "-"), 0).when(x == y, 1 << 16).otherwise(1),
    )
    total = F.aggregate(pairs, F.lit(0), lambda s, v: s + v)
    same = F.shiftright(total, 16)
    seen = same + total.bitwiseAND(65535)
    return (
        F.when(F.col(f"{a}fingerprint") == F.col(f"{b}fingerprint"), 1.0)
        .when(seen == 0, 0.0)
        .otherwise(same.cast("double") / seen.cast("double"))
    )


def next_below(ids: DataFrame) -> DataFrame:
    """(id, next): the next smaller of distinct ids, for the smallest the largest.

    Windows hold at most SPAN ids each; the borders between them are found by the
    same function over the numbers of the windows.
    """
    group = F.floor(F.col("id") / SPAN).cast("long")
    within = Window.partitionBy("group").orderBy(F.desc("id"))
    rows = ids.select("id", group.alias("group")).withColumn("next", F.lead("id").over(within))
    groups = materialise(rows.groupBy(F.col("group").alias("id")).agg(F.max("id").alias("head")), "order-groups")
    if groups.count() <= 1:
        heads = groups.select(F.col("id").alias("group"), "head")
    else:
        order = next_below(groups.select("id"))
        heads = order.join(groups.toDF("next", "head"), "next").select(F.col("id").alias("group"), "head")
    return rows.join(heads, "group", "left").select("id", F.coalesce("next", "head").alias("next"))


def with_next(rows: DataFrame, payload: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(rows)`` with next_{c} of the next document, descending doc_id, for c in ``payload``.

    One shuffle of the rows, by windows of ids; the first row behind each window is
    looked up before ``make``, made once and added to the window, so no row needs to
    be joined. A NULL doc_id is in a window by itself and has no next document.
    """
    window = F.floor(F.col("doc_id") / SPAN).cast("long")
    known = rows.filter("doc_id is not null")
    ends = materialise(
        known.groupBy(window.alias("window")).agg(F.min("doc_id").alias("tail"), F.max("doc_id").alias("head")), "order-ends"
    )
    order = next_below(ends.select(F.col("window").alias("id")))
    after = materialise(
        order.join(ends.select(F.col("window").alias("next"), "head"), "next").select(F.col("id").alias("window"), F.col("head").alias("doc_id")),
        "order-after",
    )
    heads = known.join(after, "doc_id").withColumns({"__rank": F.lit(1), "__hash": F.xxhash64("text")})
    first = Window.partitionBy("window", "doc_id").orderBy("__hash")
    heads = heads.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    heads = materialise(make(heads), "order-heads")
    own = make(rows).withColumns({"window": window, "__rank": F.lit(0), "__hash": F.xxhash64("text")})
    names = [c for c in own.columns if c not in ("window", "__rank", "__hash")]
    # Rows without an id are dealt by their text, so that they are no single window.
    place = [F.col("window"), F.when(F.col("window").isNull(), F.col("__hash"))]
    by = Window.partitionBy(*place).orderBy("__rank", F.desc("doc_id"), "__hash")
    led = own.unionByName(heads).withColumn("__next", F.lead(F.struct(*payload)).over(by)).filter("__rank = 0")
    led = led.withColumn("__next", F.when(F.col("doc_id").isNotNull(), F.col("__next")))
    return led.select(*names, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in payload])


def fingerprints(docs: DataFrame, in_plan: int = IN_PLAN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    banded = lexicon(base, in_plan=in_plan)
    made = with_next(base, ["text", "parts", "fingerprint"], lambda df: with_fingerprint(df, "text", banded))
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - cut),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut),
    )
    made = made.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        "parts",
        "fingerprint",
        F.coalesce("next_parts", F.array_repeat(F.lit("-"), SUBSETS)).alias("next_parts"),
        F.coalesce("next_fingerprint", F.lit(":".join(["-"] * (SUBSETS + 1)))).alias("next_fingerprint"),
    )
    made = with_fingerprint(made, "edited", banded, "edited_")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("", "edited_").alias("near_edited"),
        likeness("", "next_").alias("near_next"),
    )
