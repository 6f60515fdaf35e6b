"""Line dedup by a log-template tree of fixed depth.

A line's tokens are masked: one with a digit becomes the variable mark. The tree's first level is the number
of tokens, the next DEPTH levels the leading masked tokens; a leaf holds the lines that agree in these. Inside a
leaf a token stands as it is where at least `min_docs` lines of the leaf have it at that place, and becomes the
variable mark elsewhere. That gives the line's template. A template recurs when at least `min_docs` documents
have a line of it and at least half of its tokens are no marks. Lines of a recurring template are dropped
in all documents but the first (smallest id) that has one.

Everything is DataFrame code. Leaves are counted before anything is joined; only lines of leaves with
`min_docs` lines go on, each different line once; its tokens meet the frequent ones of their place, so a leaf
with many of either spreads over its tokens. A template that most documents share is counted in two
steps, and its lines meet the verdict by broadcast or over salts, so its rows never meet in one task.

Defined cases: null text stays null and has no lines; lines of fewer than DEPTH tokens are kept; lines may have
any length; documents with equal ids go by row; a document whose every line is dropped gets an empty
text; an empty table gives an empty result; other columns stay apart in `doc`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.functions.skew import join_measured
from popgraph.llm.common import SPACE, WORD, kept, numbered

DEPTH = 4
MIN_DOCS = 10
MIN_CONSTANT = 0.5
MARK = "<*>"
MAX_BROADCAST_LEAVES = 2_000_000
MAX_BROADCAST_TOKENS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def masked(line: Column) -> Column:
    """The line's tokens, those with a digit replaced by the mark."""
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"[^{SPACE}0-9]*+[0-9][^{SPACE}]*+", MARK)).otherwise(line)
    return F.filter(F.split(plain, f"[{SPACE}]+"), lambda t: t != "")


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """(__row, __line, tokens, leaf, h) of lines that are deep enough; leaf and h identify leaf and masked line."""
    each = docs.select("__row", F.posexplode(F.split(text, "\n")).alias("__line", "__text"))
    each = each.where(F.col("__text").rlike(rf"(?:{WORD}[{SPACE}]+){{{depth - 1}}}{WORD}"))
    each = each.select("__row", "__line", masked(F.col("__text")).alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    return each.withColumns({"leaf": leaf, "h": F.xxhash64("tokens")})


def template_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(__row, __line) of the lines to drop, of `docs` with a `__row`."""
    lines = _lines(docs, text, depth)
    places = kept(lines.select("__row", "__line", "leaf", "h"), "lines")
    leaves = places.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leaves = kept(leaves, "leaves")
    small = F.broadcast(leaves) if leaves.count() <= MAX_BROADCAST_LEAVES else leaves
    places = kept(places.join(small, "leaf", "left_semi"), "lines")
    texts = lines.join(small, "leaf", "left_semi").groupBy("leaf", "h").agg(F.first("tokens").alias("tokens"))
    weights = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    distinct = kept(texts.join(weights, "h"), "templates")
    constants = F.size(F.filter(F.slice("tokens", 1, depth), lambda t: t != MARK))  # these stand, as all lines of the leaf have them
    heads = distinct.select("h", "leaf", F.size("tokens").alias("size"), constants.alias("fixed"))
    tokens = distinct.select("h", "leaf", "n", F.posexplode("tokens").alias("at", "token")).where((F.col("at") >= depth) & (F.col("token") != MARK))
    stands = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).drop("n")
    stands = kept(stands, "stands")
    few = F.broadcast(stands) if stands.count() <= MAX_BROADCAST_TOKENS else stands
    rest = tokens.join(few, ["leaf", "at", "token"]).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    generalised = heads.join(rest, "h", "left").where(F.col("fixed") + F.coalesce(F.size("t"), F.lit(0)) >= min_constant * F.col("size"))
    named = generalised.select("h", F.xxhash64("leaf", F.coalesce("t", F.array().cast("array<struct<at:int,token:string>>"))).alias("template"))
    ids = docs.select("__row", F.col(doc_id).alias("__id"))
    met = kept(places.join(named, "h").select("__row", "__line", "template").join(ids, "__row"), "lines")
    once = met.select("template", "__row", "__id").distinct()
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    recurring = once.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), first.alias("first")).where(F.col("docs") >= min_docs)
    recurring = recurring.select("template", F.col("first.row").alias("__first"))
    found = join_measured(met, recurring, "template", "__row", MAX_BROADCAST_BYTES)
    return found.where(F.col("__row") != F.col("__first")).select("__row", "__line")


def drop_template_lines(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text) for every row of `docs`, which must be a table."""
    rows = numbered(docs.select(F.struct("*").alias("doc"), *(c for c in {text, how.get("doc_id", "doc_id")})))
    dropped = template_lines(rows, text=text, **how).groupBy("__row").agg(F.collect_set("__line").alias("__dropped"))
    met = rows.select("__row", "doc", F.col(text).alias("__text")).join(dropped, "__row", "left")
    lines = F.split("__text", "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    return met.select(
        "doc", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), F.col("__text")).otherwise(rest).alias("kept_text"),
    )
