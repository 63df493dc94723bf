"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The edit distance counts words: one word inserted, deleted or replaced. A line goes if an earlier line of the corpus
(smaller doc_id, then line number) equals it, or, for lines of at least `min_words` words, is within one edit; with 5
words, one edit is a similarity of 0.8. "Earlier" is judged on the input, so the outcome doesn't depend on an order of
removals.

Two lines are within one edit if, and only if, they share a variant with one word deleted, or one is the other's
variant; and then they also share one of their halves, counted in the words of the shorter line. So every distinct line
emits the hashes of its halves, and only lines with a half that another line has emit their deletion variants as hashed
keys (variant, position deleted). Lines that share a key at the same position differ in that word only, so the earliest
holder of a key stands for all pairs of it: no pairs within a group are made, and counts are combined before they are
shuffled. The partner found is joined back and the edit distance verified word by word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import document_key, written

WORDS, BLANKS = "[\\x20\\x09\\x0b-\\x0d]+", " \t\x0b\x0c\r"


def _plain(line: Column) -> Column:
    """A line's words with one space between them; only lines that aren't so already are trimmed and searched."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in BLANKS[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.regexp_replace(F.btrim(line, F.lit(BLANKS)), WORDS, " ")).otherwise(line)


def _n_words(line: Column) -> Column:
    """Words of a plain line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _blank(line: Column) -> Column:
    """No word in it; what starts with a byte above the space isn't trimmed to see that."""
    return (line < "!") & (F.btrim(line, F.lit(BLANKS)) == "")


def _hash(*parts: Column) -> Column:
    """128 bits: two hashes of which the second has a seed of its own."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    n = F.size(shorter)
    match = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0))
    head = F.when(n == 0, 0).otherwise(match(F.slice(longer, 1, n), shorter))  # first place that differs, 0: none
    rest = lambda x, i: F.slice(x, i, F.greatest(F.size(x) - i + 1, F.lit(0)))
    at = F.greatest(head, F.lit(1)).cast("int")
    replaced = rest(longer, at + 1) == rest(shorter, at + 1)
    deleted = rest(longer, at + 1) == rest(shorter, at)
    return (
        F.when(F.size(longer) - n > 1, False)
        .when(head == 0, True)
        .when(F.size(longer) == n, replaced)
        .otherwise(deleted)
    )


def _front() -> Column:
    """31 bits of a text's hash, in front of its line numbers: different texts under one doc_id have lines of their own."""
    return F.shiftleft(F.xxhash64("text").bitwiseAND((1 << 31) - 1), 32).alias("front")


def _number(df: DataFrame, i: Column) -> Column:
    """A line's number, behind the front of its text where there is one."""
    return F.col("front").bitwiseOR(i.cast("long")) if "front" in df.columns else i


def _lines(df: DataFrame, *keep: str) -> DataFrame:
    """Rows (dk, keep..., line_no, line) of the lines of `text`."""
    front = ["front"] * ("front" in df.columns)  # comes with the text, so that it isn't taken for each line
    lines = df.select("dk", *keep, *front, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("dk", *keep, _number(df, F.col("i")).alias("line_no"), "line")


def _numbered(df: DataFrame, numbers: str) -> DataFrame:
    """Rows (dk, line_no, line) of the plain lines of `text` whose numbers are in an array."""
    lines = _lines(df, numbers).filter(F.array_contains(numbers, F.col("line_no")))
    return lines.select("dk", "line_no", _plain(F.col("line")).alias("line"))


def near_lines(by_doc: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """(dk, near): numbers of the lines that are within one edit of an earlier one, among the first occurrences
    (dk, mine) of the distinct lines. by_doc: (dk, text, and front where ids repeat), dealt out by dk."""
    place = ["dk", "line_no"]
    spot = F.xxhash64(*place)
    rows = _numbered(by_doc.join(firsts, "dk"), "mine").withColumn("n", _n_words(F.col("line")))

    # the shorter line of a pair has n or n - 1 words, and for an odd n these have halves of the same length
    def halves(h: Column) -> list[Column]:
        head, tail = (F.call_function("substring_index", F.col("line"), F.lit(" "), x) for x in (h, -h))
        return [F.xxhash64(F.lit("head"), head), F.xxhash64(F.lit("tail"), tail)]

    h = F.shiftright("n", 1)
    both = F.when(F.col("n") % 2 == 1, F.array(*halves(h))).otherwise(F.array(*halves(h), *halves(h - 1)))
    shares = rows.select(*place, F.explode(F.when(F.col("n") >= min_words, both)).alias("half"))  # a filter would make lines plain again
    common = shares.groupBy("half").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).filter("lo <> hi").select("half")
    likely = shares.join(common, "half", "left_semi").select(*place).distinct().groupBy("dk").agg(F.collect_list("line_no").alias("some"))
    lines = _numbered(by_doc.join(likely, "dk"), "some").repartition(*place)
    lines = lines.dropDuplicates(place) if "front" in by_doc.columns else lines  # a line of repeated rows counts once
    lines = lines.select(*place, F.split("line", " ").alias("w"))

    # the hash of a list of words is the XOR of the hashes of (place, word), so that each deletion costs the same
    words = lines.select(*place, F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    line, before = Window.partitionBy(*place), Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here, moved = F.xxhash64("at", "word"), F.xxhash64(F.col("at") - 1, "word")
    head, tail = (F.coalesce(F.bit_xor(x).over(before), F.lit(0)) for x in (here, moved))
    cut = head.bitwiseXOR(F.bit_xor(moved).over(line)).bitwiseXOR(tail).bitwiseXOR(moved)
    words = words.select(*place, "n", "at", F.bit_xor(here).over(line).alias("whole"), cut.alias("cut"))
    cut = F.struct("at", F.xxhash64(F.col("n") - 1, "cut").alias("v"))
    whole = F.struct(F.lit(-1).alias("at"), F.xxhash64("n", "whole").alias("v"))
    keys = words.select(*place, F.explode(F.when(F.col("at") == 0, F.array(cut, whole)).otherwise(F.array(cut))).alias("x")).select(*place, "x.v", "x.at")

    # of each variant: the earliest line that has it, by the place of the deleted word (-1: the line as it is)
    me = F.struct(*place)
    held = keys.groupBy("v", "at").agg(F.min(me).alias("e"), F.count("*").alias("c"))
    held = held.groupBy("v").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.max("c").alias("c"), F.collect_list(F.struct("at", "e")).alias("held"))
    held = held.filter("lo <> hi or c > 1")
    # a line as it is matches longer ones with any word deleted; one with a word deleted matches those that replaced
    # the same word, and the shorter line itself
    fits = F.filter("held", lambda h: F.when(F.col("at") < 0, h["at"] >= 0).otherwise((h["at"] == F.col("at")) | (h["at"] < 0)))
    found = keys.join(held.select("v", "held"), "v").select(*place, F.array_min(F.transform(fits, lambda h: h["e"])).alias("e"))
    partner = found.filter(F.col("e") < me).groupBy(*place).agg(F.min("e").alias("e")).select(*place, F.col("e.dk").alias("d2"), F.col("e.line_no").alias("l2"))
    pair = partner.join(lines, place).join(lines.select(F.col("dk").alias("d2"), F.col("line_no").alias("l2"), F.col("w").alias("v")), ["d2", "l2"])
    near = pair.filter(within_one_edit(F.col("w"), F.col("v")))
    return near.groupBy("dk").agg(F.collect_set("line_no").alias("near"))


def dedup_lines(docs: DataFrame, *, min_words: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the kept lines, joined by line feeds) of every row, and `carried`, a struct of
    the columns in carry, where there are some.

    Blank lines always stay. A null text stays null, with no lines; an empty one is one blank line. Rows with the same
    doc_id and text count as one document: they are returned as often as they came, each with the same outcome (a line
    is not removed for its own copy in a repeated row), and what they carry is that of the row whose other columns come
    first as JSON. Different texts under one doc_id are different documents, in the order of a hash of their texts; so
    are different texts without a doc_id, before all others (ids are at least -2**62). Other columns aren't looked at.

    Texts are shuffled once, by document; lines travel as hashes, but for those that may have a near copy."""
    key = document_key(F.col("doc_id"), F.col("text"), last=False).alias("dk")
    # what only repeated ids need is left out where there are none
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    ids = docs.select(key, *[_front()] * repeated, "text")  # every reader of by_doc takes the same columns of one exchange
    lines = _lines(ids.filter(F.col("text").isNotNull()))
    lines = lines.filter(~_blank(F.col("line"))).select(_hash(F.col("line")).alias("key"), F.struct("dk", "line_no").alias("place"))
    firsts = lines.groupBy("key").agg(F.min("place").alias("first")).groupBy(F.col("first.dk").alias("dk")).agg(F.collect_list("first.line_no").alias("mine"))
    firsts = written(firsts, "first-lines")
    by_doc = ids.repartition("dk")
    near = near_lines(by_doc, firsts, min_words)
    split = F.split("text", "\n")
    none = F.array().cast("array<long>" if repeated else "array<int>")
    stays = F.array_except(F.coalesce("mine", none), F.coalesce("near", none))
    kept = F.filter(F.transform(split, lambda x, i: F.when(_blank(x) | F.array_contains(F.col("stays"), _number(by_doc, i)), x)), lambda x: x.isNotNull())
    out = by_doc.join(firsts, "dk", "left").join(near, "dk", "left").withColumn("stays", stays)
    if carry:  # joined where the texts are, so that they aren't shuffled again
        rows = docs.select(key, F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
        one = rows.groupBy("dk", "h").agg(F.min_by("carried", F.to_json("carried")).alias("carried"))
        # not as a second key of the join, for which the texts would be shuffled again
        out = out.join(one, "dk").filter(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0)
    out = out.select(F.when(F.col("dk") >= -(1 << 62), F.col("dk")).alias("doc_id"), *["carried"] * bool(carry), "text", F.when(F.col("text").isNotNull(), kept).alias("left"), F.when(F.col("text").isNotNull(), F.size(split)).otherwise(0).cast("long").alias("n_lines"))
    n_left = F.when(F.col("text").isNull(), 0).otherwise(F.size("left")).cast("long")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - n_left).alias("n_removed"), F.array_join("left", "\n").alias("text"), *["carried"] * bool(carry))
