"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, discard, spread_join

#: Lines with fewer words are never taken for repeats.
MIN_WORDS = 5
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the map that spares lines without a near neighbour the shuffle of their words. It is part of the plan, of which
#: the driver keeps several texts, so it stays small; a table with more such lines than bits does without it.
MAP_BITS = 1 << 19
_LOW = (1 << 40) - 1


def _odd(text: Column) -> Column:
    """Whether a text has white space other than single spaces and line ends."""
    odd = text.contains("  ")
    for sign in ("\t", "\r", "\x0b", "\x0c"):
        odd = odd | text.contains(sign)
    return odd


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """One row per line of ``least`` words or more: its document and position, two hashes of its words, their number, the
    words as one text with one space between."""
    lines = F.split("text", "\n")
    lines = F.transform(F.when(_odd(F.col("text")), F.transform(lines, lambda x: F.regexp_replace(x, SPACES, " "))).otherwise(lines), lambda x: F.trim(x))
    words = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    # Made within the generator, so that no later step works them out again.
    lines = F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("n")))
    # The hash stands below the generator, so that texts are neither hashed nor carried once per line.
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), lines.alias("lines"))
    # An outer generator, as a plain one has the planner work the lines out again to see whether there are any.
    rows = rows.select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "l"))
    rows = rows.where(F.col("l.n") >= least).select("doc_id", "th", "pos", F.col("l.n").alias("n"), F.col("l.line").alias("line"))
    return rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n", "line")


#: What a line's halves say of it: it may have a partner of its own length that shares the first half, or the second; a
#: partner with one word less that does so; one with one word more.
_SAME_HEAD, _SAME_TAIL, _MORE_HEAD, _MORE_TAIL, _LESS = 1, 2, 4, 8, 16


def _half_keys(n: Column, line: Column) -> list[Column]:
    """Hashes of the three halves of a line.

    Of two lines that one word tells apart, the shorter one having m words, the first m // 2 words are equal or the last
    m - m // 2. A line is the shorter one (m = n, halves 0 and 1) or the longer one (m = n - 1: the third
    half and one of the others).
    """
    k = F.floor(n / 2).cast("int")
    head = lambda m: F.xxhash64(F.lit("head"), m, F.call_function("substring_index", line, F.lit(" "), m))
    tail = lambda m: F.xxhash64(F.lit("tail"), m, F.call_function("substring_index", line, F.lit(" "), -m))
    return [head(k), tail(n - k), F.when(n % 2 == 1, tail(k)).otherwise(head(k - 1))]


def _half_steps(n: Column) -> list[Column]:
    """By how many words a line is longer than the shortest line that can have each of its halves so: 0, 1 or 2."""
    odd = (n % 2).cast("int")
    return [odd, 1 - odd, F.lit(2)]


def _chances(step: Column, side: Column, counts: list[Column]) -> Column:
    """The bits that a line's half gives it, from how many lines have that half with 0, 1 and 2 words more (``counts``); side
    0 is the first half."""
    none = F.lit(0)
    c0, c1, c2 = counts
    bit = lambda first, second: F.when(side == 0, first).otherwise(second)
    same = F.when(((step == 0) & (c0 > 1)) | ((step == 1) & (c1 > 1)), bit(_SAME_HEAD, _SAME_TAIL)).otherwise(none)
    more = F.when(((step == 1) & (c0 > 0)) | ((step == 2) & (c1 > 0)), bit(_MORE_HEAD, _MORE_TAIL)).otherwise(none)
    less = F.when(((step == 0) & (c1 > 0)) | ((step == 1) & (c2 > 0)), _LESS).otherwise(none)
    return same.bitwiseOR(more).bitwiseOR(less)


def _bit_map(rows: DataFrame, column: str, bits: int) -> bytes:
    """A bit map of hashes modulo ``bits``, which has the same size for any number of rows."""
    at = F.pmod(F.col(column), F.lit(bits))
    each = 32768
    parts = rows.groupBy(F.floor(at / each).cast("int").alias("k")).agg(F.expr(f"bitmap_construct_agg(pmod(pmod({column}, {bits}L), {each}L))").alias("m")).collect()
    out = bytearray(bits // 8)
    for k, m in parts:
        out[k * each // 8 : k * each // 8 + len(m)] = m
    return bytes(out)


def _in_map(h: Column, found: bytes, bits: int) -> Column:
    at = F.pmod(h, F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.lit(found), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.pmod(at, F.lit(8)) + 1).cast("int"))) != 0


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, role) of each line (place, h1, h2, n, chances, words): what one deletion leaves, and the line itself.

    A variant's key is a sum of hashes of (word, position), positions after the gap moved up, so that
    running sums give all n variants of a line in linear time. Variants of lines of equal length meet under
    role 0 with the gap at the same place (one word changed); those of a longer line meet the shorter line
    itself under roles 1 and 2 (one word more). A line whose first half alone has company is only changed behind it, and so on,
    so that most lines make half of their variants.
    """
    words = lines.repartition("place").select("place", "h1", "h2", "n", "chances", F.posexplode("words").alias("i", "w"))
    put = lambda seed, shift: F.xxhash64(F.lit(seed), "w", F.col("i") - shift).bitwiseAND(F.lit(_LOW))
    line = Window.partitionBy("place", "h1", "h2")
    past = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = [put(s, shift).alias(f"{x}{s}") for s in (1, 2) for x, shift in (("c", 0), ("d", 1))]
    words = words.select("place", "h1", "h2", "n", "chances", "i", *sums)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    for s in (1, 2):
        words = words.withColumn(f"v{s}", F.coalesce(F.sum(f"c{s}").over(past), zero) + F.sum(f"d{s}").over(line) - F.sum(f"d{s}").over(upto))
        words = words.withColumn(f"f{s}", F.sum(f"c{s}").over(line))
    has = lambda bit: F.col("chances").bitwiseAND(F.lit(bit)) != 0
    entry = lambda role, when, *parts: F.when(when, F.struct(F.lit(role).cast("byte").alias("role"), F.xxhash64(*parts).alias("key")))
    half, less = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    at = F.col("i")
    changed = entry(0, (has(_SAME_HEAD) & (at >= half)) | (has(_SAME_TAIL) & (at < half)), F.lit("changed"), "v1", "v2", "n", "i")
    longer = entry(1, (has(_MORE_HEAD) & (at >= less)) | (has(_MORE_TAIL) & (at <= less)), F.lit("more"), "v1", "v2", F.col("n") - 1)
    itself = entry(2, has(_LESS) & (at == 0), F.lit("more"), "f1", "f2", "n")
    rows = words.select("place", F.explode(F.array_compact(F.array(changed, longer, itself))).alias("e"))
    return rows.select("e.key", "place", "e.role")


def _one_apart(a: Column, b: Column) -> Column:
    """Whether one word changed, added or left out turns the words ``a`` into ``b``."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    gap = F.array_position(F.transform(F.arrays_zip(short.alias("x"), long.alias("y")), lambda z: z["x"].eqNullSafe(z["y"])), False).cast("int")
    without = lambda w: F.concat(F.slice(w, 1, F.greatest(gap - 1, F.lit(0))), F.slice(w, gap + 1, F.size(w)))
    equal = (F.size(a) == F.size(b)) & (without(short) == without(long))
    more = (F.size(long) == F.size(short) + 1) & (without(long) == short)
    return (gap > 0) & (equal | more)


def _place(rows: DataFrame):
    """A column expression over doc_id and pos that orders lines: one number where ids and positions fit into 62 bits
    together, else the pair. A null id comes first."""
    kind = rows.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        low, high, last = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max("pos")).first()
        bits = int(last or 0).bit_length()
        if low is None or (high - low + 2).bit_length() + bits <= 62:
            number = F.coalesce(F.col("doc_id").cast("long") - F.lit(low or 0) + 1, F.lit(0).cast("long"))
            return F.shiftleft(number, bits) + F.col("pos")
    return F.struct("doc_id", "pos")


def _near(kinds: DataFrame) -> DataFrame:
    """(place, chances) of the lines that share a half with a line of a fitting length."""
    steps = _half_steps(F.col("n"))
    odd = F.col("n") % 2 == 1
    sides = [F.lit(0), F.lit(1), F.when(odd, 1).otherwise(0)]
    each = F.array(*[F.struct(F.col(f"half{k}").alias("half"), steps[k].cast("byte").alias("step"), sides[k].cast("byte").alias("side")) for k in range(3)])
    halves = kinds.select("place", F.explode(each).alias("h")).select("place", "h.half", "h.step", "h.side")
    counts = [F.count_if(F.col("step") == k).alias(f"c{k}") for k in range(3)]
    shared = halves.groupBy("half").agg(*counts, F.count("*").alias("c")).where("c0 > 1 OR c1 > 1 OR c0 > 0 AND c1 > 0 OR c1 > 0 AND c2 > 0")
    shared = cut(shared, "halves")
    met = spread_join(halves, shared, ["half"], "c")
    met = met.withColumn("chances", _chances(F.col("step"), F.col("side"), [F.col(f"c{k}") for k in range(3)]))
    out = cut(met.where("chances <> 0").groupBy("place").agg(F.bit_or("chances").alias("chances")), "near")
    discard(shared)
    return out


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos) of each line that goes: an earlier line has the same words or is one word apart.

    Earlier means a smaller doc_id (null first), then a smaller position. Lines are compared by their words. Equal lines
    are counted once per task before they meet; only lines that share a half with another line of a fitting length
    become variants; in a group of equal variants each member is held against the earliest alone, so a
    group costs as many rows as it has members. Keys that many lines have are spread. A table without lines of ``least``
    words gives no rows.
    """
    lines = _lines(docs, least)
    halves = [h.alias(f"half{k}") for k, h in enumerate(_half_keys(F.col("n"), F.col("line")))]
    # Numbers alone, written once: the texts are read again only for lines that may have a near neighbour.
    seen = cut(lines.select("doc_id", "th", "pos", "h1", "h2", "n", *halves), "lines")
    place = _place(seen)
    # The halves follow from the line, so any one of equal lines gives them.
    kinds = seen.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("times"), F.first("n").alias("n"), *[F.first(f"half{k}").alias(f"half{k}") for k in range(3)])
    kinds = cut(kinds, "kinds")
    near = _near(kinds)
    found = near.count()
    own = near.select(F.col("place").alias("at"), "chances")
    texts = lines.withColumn("place", place)
    if found <= MAP_BITS:
        texts = texts.where(_in_map(F.xxhash64("place"), _bit_map(near.select(F.xxhash64("place").alias("h")), "h", MAP_BITS), MAP_BITS))
    texts = texts.join(own.hint("shuffle_hash"), F.col("place") == F.col("at"))
    texts = cut(texts.select("place", "h1", "h2", "n", "chances", F.split("line", " ").alias("words")).dropDuplicates(["place", "h1", "h2"]), "words")
    discard(near)
    rows = cut(_variants(texts), "variants")
    least_of = lambda role: F.min(F.when(F.col("role") == role, F.col("place"))).alias(f"m{role}")
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("c"), *[least_of(r) for r in (0, 1, 2)]).where("c > 1"), "groups")
    met = spread_join(rows, groups, ["key"], "c")
    first = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = met.withColumn("earlier", first).where("earlier < place").select("place", "earlier").distinct()
    other = texts.select(F.col("place").alias("earlier"), F.col("words").alias("others"))
    close = pairs.join(texts.select("place", "h1", "h2", "words"), "place").join(other, "earlier").where(_one_apart(F.col("words"), F.col("others")))
    close = cut(close.select("h1", "h2").distinct(), "close")
    discard(rows, groups, texts)
    nowhere = F.lit(None).cast(kinds.schema["place"].dataType)
    verdict = kinds.where("times > 1").select("h1", "h2", "times", F.col("place").alias("first"), F.lit(False).alias("close"))
    verdict = verdict.union(close.select("h1", "h2", F.lit(1).cast("long"), nowhere, F.lit(True)))
    verdict = cut(verdict.groupBy("h1", "h2").agg(F.max("times").alias("times"), F.max("first").alias("first"), F.max("close").alias("close")), "verdict")
    discard(kinds, close)
    met = spread_join(seen.select("doc_id", "th", "pos", "h1", "h2", place.alias("place")), verdict, ["h1", "h2"], "times")
    return met.where(F.col("close") | (F.col("place") > F.col("first"))).select("doc_id", "th", "pos")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that ``repeats`` names taken out of text, and n_lines and n_dropped (in place of columns of
    these names).

    Null texts stay null with no lines, empty ones are one empty line. Rows that repeat a doc_id and a text lose the same
    lines and none to each other; other columns stay as they are.
    """
    gone = repeats(docs.select("doc_id", "text"), least).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone_pos"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone_pos").hint("shuffle_hash")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *([F.struct(*others).alias("gone_others")] if others else []))
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone_pos", i)), "\n")
    fields = {"text": F.when(F.col("gone_pos").isNull(), F.col("text")).otherwise(kept), "doc_id": F.col("doc_id")}
    columns = [fields.get(c, F.col("gone_others")[c] if others else None).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return out.select(*columns, lines.alias("n_lines"), F.when(F.col("gone_pos").isNull(), 0).otherwise(F.size("gone_pos")).cast("long").alias("n_dropped"))
