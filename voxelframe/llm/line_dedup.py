"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line (by doc_id, then place) is within one character
edit of it, so the earliest of each chain stays.  Lines under ``min_chars``
characters are a word or two, a number or a date, and one edit makes another of
them: they go only if an earlier line equals them.  Blank lines stay.

1. Every line gives hashed keys of its first and its last half, with its
   length.  Two lines one edit apart agree in one of the halves and differ in
   length by one at most, so only lines that share a key with a different line
   go on; a key is judged by the least and the greatest line hash under it.
2. These lines emit their deletion neighbourhood: the line itself and every
   line with one character left out, as hashed keys with the place left out.
   Lines that meet in a variant with the same place left out, or in one's
   variant and the other's whole, are one edit apart.  Each group of equal
   variants gives only its earliest line, aggregated before the shuffle, so a
   group of any size makes one row and no pairs.
3. ``levenshtein`` verifies each line against the earlier line found for it.
4. Equal lines are found by hash the same way: later ones go.

Defined results: null text stays null.  Rows with null doc_id are left as they
are.  Rows that repeat a doc_id are taken as one document: they neither remove
each other's lines nor are treated differently.  All columns are passed on,
whatever their names; n_chars (where there is one) follows the text.  A text whose lines all go
becomes empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, numbered

MIN_CHARS = 24
#: Lines over LONG characters have their variants by block of BLOCK.
LONG, BLOCK = 512, 256
#: Candidate lines are sent to the executors if they are this few, else joined by a shuffle.
SEND_ROWS = 200_000


def lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, place, line of all lines that are not blank and long enough."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]") & (F.length("line") >= min_chars))


def _half_keys(line: Column) -> Column:
    """Keys of the halves. Halves are cut in steps of 8 characters (of one under 16), so that lengths that differ by one have the same; where they don't, the longer line emits both cuts."""
    n = F.length(line)
    half = F.when(n < 16, F.floor(n / 2)).otherwise(F.floor(n / 16) * 8)

    def keys(m: Column, length: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), length, m, F.substring(line, F.lit(1), m)), F.xxhash64(F.lit(1), length, m, F.substring(line, n - m + 1, m))]

    m = half.cast("int")
    both = F.array(*keys(m, n), *keys(m, n + 1))
    shorter = F.when((n <= 16) & (n % 2 == 0), m - 1).when(n % 16 == 0, m - 8)
    return F.when(shorter.isNotNull(), F.concat(both, F.array(*keys(shorter, n)))).otherwise(both)


def _left_out(line: Column, i: Column) -> Column:
    """The line (four bytes for each character) without its i-th character."""
    return F.concat(F.substring(line, F.lit(1), 4 * (i - 1)), F.substring(line, 4 * i + 1, F.length(line)))


def _short_variants(line: Column) -> Column:
    n = F.length(line) / 4
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(F.xxhash64(F.when(i == 0, line).otherwise(_left_out(line, i))).alias("v"), i.alias("i")))


def _long_variants(line: Column) -> Column:
    """Variants by block of BLOCK characters: one is the hashes of what stands before and behind the block, and the block without the character. The whole line stands once for each block, one character shorter, as it is in a line from which that one was left out."""
    n, size = F.length(line), 4 * BLOCK

    def parts(j: Column, wide: int) -> Column:
        ahead = F.xxhash64(F.substring(line, F.lit(1), size * j))
        behind = F.xxhash64(F.substring(line, size * j + wide + 1, n))
        return F.struct(ahead.alias("ahead"), F.substring(line, size * j + 1, F.lit(wide)).alias("block"), behind.alias("behind"))

    def of_block(j: Column, x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: 4 * i <= F.length(x["block"]))
        return F.transform(places, lambda i: F.struct(F.xxhash64(x["ahead"], _left_out(x["block"], i), x["behind"]).alias("v"), (j * BLOCK + i).alias("i")))

    blocks = F.sequence(F.lit(0), F.floor(n / size).cast("int"))
    left_out = F.flatten(F.transform(blocks, lambda j: F.flatten(F.transform(F.array(parts(j, size)), lambda x: of_block(j, x)))))
    whole = F.transform(blocks, lambda j: F.transform(F.array(parts(j, size - 4)), lambda x: F.struct(F.xxhash64(x["ahead"], x["block"], x["behind"]).alias("v"), F.lit(0).alias("i")))[0])
    return F.concat(left_out, whole)


def _variants(line: Column) -> Column:
    """Hash and place (from 1; 0: nothing) of each line with a character left out, and of the line itself; line: as binary with four bytes for each character, so that a place needs no search.  Lines over LONG characters have variants by block, else the work would grow with the square of their length; those of LONG + 1 have both."""
    n = F.length(line)
    return F.when(n <= 4 * LONG, _short_variants(line)).when(n == 4 * LONG + 4, F.concat(_short_variants(line), _long_variants(line))).otherwise(_long_variants(line))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and the sorted places of the lines that go."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    at = F.struct("doc_id", "place").alias("at")
    keys = F.when(F.length("line") >= min_chars, _half_keys(F.col("line")))
    table = lines(docs).select(at, F.xxhash64("line").alias("h"), keys.alias("keys"))
    table = scratch.keep(table, "table")
    # what is aggregated by a key is written before it is joined by it, so that a join can split the rows of a frequent key
    # exact repeats: one row per repeated line hash
    repeated = scratch.keep(table.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last"), "repeated")
    exact = table.select("at", "h").join(repeated, "h").where("at > first").select("at")
    # lines that share a half with another one
    keys = table.select(F.explode("keys").alias("key"), "h")
    shared = scratch.keep(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("key"), "shared")
    near = scratch.keep(keys.join(shared, "key").select("h").distinct(), "near")
    firsts = scratch.keep(table.select("at", "h").join(near, "h").groupBy("h").agg(F.min("at").alias("at")), "firsts")
    where = firsts.select("at.doc_id", "at.place", "h", "at")
    if firsts.count() <= SEND_ROWS:
        where = F.broadcast(where)
    candidates = lines(docs, min_chars).join(where, ["doc_id", "place"]).groupBy("h", "at").agg(F.min("line").alias("line"))
    candidates = scratch.keep(candidates, "candidates")
    # deletion neighbourhoods
    variants = scratch.keep(candidates.select("h", "at", F.encode("line", "UTF-32").alias("wide")).select("h", "at", F.explode(_variants(F.col("wide"))).alias("x")).select("h", "at", "x.v", "x.i"), "variants")
    groups = variants.groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("at").alias("any"), F.min(F.when(F.col("i") == 0, F.col("at"))).alias("whole")).where("a < b").drop("a", "b")
    met = scratch.keep(variants.join(groups, "v"), "met")
    scratch.drop("variants")
    same = met.groupBy("v", "i").agg(F.min("at").alias("same"))
    found = met.join(same, ["v", "i"]).withColumn("earliest", F.when(F.col("i") == 0, F.col("any")).otherwise(F.least("same", "whole")))
    found = found.groupBy("h", "at").agg(F.min("earliest").alias("earliest")).where("earliest < at")
    other = candidates.select(F.col("at").alias("earliest"), F.col("line").alias("other"))
    verified = found.join(candidates, ["h", "at"]).join(other, "earliest").where(F.levenshtein("line", "other", 1).between(0, 1)).select("h")
    edited = table.select("at", "h").join(verified.distinct(), "h").select("at")
    return exact.union(edited).select("at.*").groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, counted: str | None = "n_removed_lines") -> DataFrame:
    """The documents without the lines that repeat earlier ones.  counted: name of a further last column with their number, if any; where docs have a column of that name (in whatever case) theirs keeps it and the further one gets underscores before it."""
    while counted and counted.lower() in [c.lower() for c in docs.columns]:
        counted = f"_{counted}"
    places = duplicate_lines(docs.select("doc_id", "text"), min_chars).toDF("of", "gone")
    rows, column = numbered(docs)
    text = F.col(column["text"])
    whole = F.col("gone").isNull() | text.isNull()
    # the lines are bound once as x; array_except is a hash set
    kept = F.transform(F.array(F.split(text, "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))[0]
    out = {column["text"]: F.when(whole, text).otherwise(kept)}
    if "n_chars" in column:
        n = F.col(column["n_chars"])
        out[column["n_chars"]] = F.when(whole, n).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    joined = rows.join(places, F.col(column["doc_id"]) == F.col("of"), "left")
    result = joined.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns], F.coalesce(F.size("gone"), F.lit(0)).alias("n"))
    return result.toDF(*docs.columns, counted) if counted else result.drop("n").toDF(*docs.columns)
