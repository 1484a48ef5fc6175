"""Line dedup by exact set-similarity join, in DataFrame functions only.

A line's set holds hashes of 53 bits of its distinct words, A-Z lower-cased; two words of one hash count as one.  Lines of equal text meet in one
grouping and the first goes on.  Its words are ordered by rarity.  Two sets of n and m words that are similar share
c = 3(n + m) / 7 words at least; the words that only one has, e = n + m - 2c at most, cannot part all of the first
e + 2 shared words in the order, so two shared words stand side by side in both, within the first n - c + e + 2 and
m - c + e + 2.  The join is on such neighbours: a line looks up each pair of neighbours of its prefix, which is
far rarer than a word.  Length, prefix and positional filters hold for each pair of lines, and parity bits of
either set bound what they do not share: 64 that each key carries to the first line of its key, and 256 (``_wide``)
before any other two lines become a pair, since 64 say little of long lines.  What is left is verified on whole sets.  A line is removed if any line before it, in order of (document, line), is similar; of such lines
all go, also those similar to a line that goes itself.

Rarity: occurrences are counted over all sets in up to 2**21 counters, by hash of the word, and sent to the
tasks as a byte each (2 MB at most).  Any common order gives right results; counters only make frequent words
come last.  A word whose counter stands at one occurs nowhere else, and its pairs are not looked up.

Each line is first compared with the first lines that have its pairs of neighbours; lines found similar are settled
and look up nothing more, so large groups of near copies do not meet pair by pair.  Keys are looked up in PASSES, by
the first word, so that only a part of them is on disk at once.

Defined results: lines end at line feeds; lines without words stay; a null text stays null; a text that
loses all lines is empty; n_chars, if there, is the new length.  Null ids come first; rows with equal id
and text share their places, so all of them keep what the first keeps.  Other columns pass through; an empty table
gives no rows.  Very long texts and lines are split into rows before anything is compared.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, release, staged, table

NUMERATOR, DENOMINATOR = 75, 100
#: Shares of the keys that are looked up one after another.
PASSES = 3
#: Longs of parity bits that lines of one key are compared by.
LONGS = 4
#: Pairs that are broadcast to be verified, and settled lines that are; more are shuffled.
MAX_BROADCAST_PAIRS = 1_000_000
WORD, SPACES = r"[^\x20\x09-\x0D]", "\t\n\x0b\x0c\r"
#: Lines whose lower case can only differ in A-Z: there the fast built-in gives the same.
PLAIN = r"^[\x00-\x7Fà-öø-ÿß\u2010-\u2027]*$"
#: Hashes of words are few and repeat; in a dictionary they take a third of the room.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}
#: A word's hash has KEY_BITS; its counter goes by the upper ones, and its code has the level above LOW_BITS.
KEY_BITS, LOW_BITS = 53, 31
#: Levels of a counter for each doubling, and the most there are.
STEPS, LEVELS = 4, 128
#: The byte of each level.  crc32 is the built-in that makes a number of a byte at once: in this order its upper
#: bits, which lie above those of a hash, rise.
LEVEL_BYTES = sorted({zlib.crc32(bytes([b])) >> (KEY_BITS - LOW_BITS): b for b in range(256)}.items())[:LEVELS]
LEVEL_BYTES = [b for _, b in LEVEL_BYTES]
#: Least code of a word that occurs twice: level 0 is that of single ones.
SEEN_TWICE = zlib.crc32(bytes(LEVEL_BYTES[1:2])) >> (KEY_BITS - LOW_BITS) << KEY_BITS


def _hash(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - KEY_BITS)


def _words(line: Column) -> Column:
    """Hashes of the distinct words."""
    spaced = F.when(reduce(Column.__or__, [line.contains(x) for x in SPACES]), F.translate(line, SPACES, " " * len(SPACES))).otherwise(line)
    ascii_only = F.octet_length(line) == F.length(line)
    lower = F.when(ascii_only | line.rlike(PLAIN), F.lower(spaced)).otherwise(F.translate(spaced, UPPER, LOWER))
    return F.array_distinct(F.array_remove(F.transform(F.split(lower, " "), _hash), _hash(F.lit(""))))


def _overlap(n: Column, m: Column) -> Column:
    """Least number of words that similar sets of n and m words share: 3(n + m) / 7."""
    return F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def _rarity(sets: DataFrame, size: int) -> tuple[Column, int]:
    """Hashed counters of all words, a byte for each: the logarithm.  They are an array of binary literals of 4,096,
    which plans name and do not print; one literal of 2 MB takes 4 MB of the driver in each description of a plan."""
    bits = max(12, min(21, (max(1, size) // 64).bit_length()))
    counts = sets.select(F.explode("h").alias("w")).groupBy(F.shiftright("w", KEY_BITS - bits).cast("int").alias("b")).count().where("count > 1")
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log2("count") * STEPS)).cast("int")
    rows = counts.groupBy(F.shiftright("b", 12).alias("g")).agg(F.array_join(F.collect_list((F.col("b").bitwiseAND(4095) * LEVELS + level).cast("string")), ",").alias("s"))
    table = bytearray(LEVEL_BYTES[:1] * (1 << bits))
    for g, s in rows.toLocalIterator():
        for x in map(int, s.split(",")):
            table[(g << 12) + x // LEVELS] = LEVEL_BYTES[x % LEVELS]
    return F.array(*(F.lit(bytes(table[i : i + 4096])) for i in range(0, len(table), 4096))), bits


def _neighbours(sets: DataFrame, rare: Column, bits: int, turn: int) -> DataFrame:
    """t, at, np, bits: keys of the neighbours in each prefix, with the size of the set, the place in it and its
    parity bits; those of one turn of PASSES."""

    def coded(w: Column) -> Column:
        counter = F.shiftright(w, KEY_BITS - bits).cast("int")
        return F.shiftleft(F.crc32(F.substring(F.get(rare, F.shiftright(counter, 12)), counter.bitwiseAND(4095) + 1, F.lit(1))), LOW_BITS).bitwiseXOR(w)

    n = F.size("o")
    pairs = F.greatest(F.least(n, F.floor(n / 2).cast("int") + 2) - 1, F.lit(1))  # no partner asks for a longer prefix; one word alone is its own key
    rows = sets.select("at", "bits", F.sort_array(F.transform("h", coded)).alias("o")).select("at", "bits", "o", F.posexplode(F.slice("o", F.lit(1), pairs)).alias("p", "x"))
    rows = rows.where((F.col("x") >= SEEN_TWICE) & (F.col("x") % PASSES == turn))  # the rarer of two comes first
    return rows.select(F.xxhash64("x", F.get("o", F.col("p") + 1)).alias("t"), "at", (F.shiftleft(n.cast("long"), 32) + F.col("p")).alias("np"), "bits")


def _parity(words: Column) -> Column:
    """64 bits, each turned by the words whose hash falls on it."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int"))))


def _wide(sets: DataFrame) -> DataFrame:
    """at, n and LONGS columns of 64 parity bits: each word turns one of all these bits."""
    turned = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(63).cast("int"))
    own = [F.coalesce(F.bit_xor(F.when(F.shiftright("w", 6).bitwiseAND(LONGS - 1) == k, turned)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(LONGS)]
    return sets.select("at", F.explode("h").alias("w")).groupBy("at").agg(F.count("*").cast("int").alias("n"), *own)


def _few_differ(n: Column, m: Column, bits: list[str], bits2: list[str]) -> Column:
    """A word that only one set has turns one bit at most: no more bits differ than words may."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(bits, bits2, strict=True)])
    return differ <= n + m - _overlap(n, m) * 2


def similar_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, h, line): the lines that stay."""
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).where("text is not null")
    shape = base.agg(F.sum(F.octet_length("text")), F.min("doc"), F.max("doc"), F.count("*"), F.count("doc"), F.max(F.length("text"))).first()
    whole = dict(docs.dtypes)[key] in ("bigint", "int") and shape[3] == shape[4] and (shape[1] is None or shape[1] >= 0 and shape[2] < 1 << 36) and (shape[5] or 0) < 1 << 26
    if whole and base.groupBy("doc").count().where("count > 1").limit(1).count():
        whole = False
    # where ids allow, the place of a line is one number; else a struct, which compares and joins alike
    place = F.shiftleft(F.col("doc").cast("long"), 26) + F.col("line") if whole else F.struct("doc", "h", "line")
    lines = base.select("doc", "h", F.posexplode(F.split("text", "\n")).alias("line", "s")).select(place.alias("at"), "s")
    # no line holds a line feed: a line without words equals none but itself
    value = F.when(F.col("s").rlike(WORD), F.col("s")).otherwise(F.concat(F.lit("\n"), F.col("at").cast("string")))
    hashed = lines.select("at", F.xxhash64(value).alias("k1"), F.xxhash64(F.lit(1), value).alias("k2"))
    first = staged(hashed.groupBy("k1", "k2").agg(F.min("at").alias("at")).select("at"), "lines-first")
    sets = staged(lines.join(first.hint("shuffle_hash"), "at", "left_semi").select("at", _words(F.col("s")).alias("h")).withColumn("bits", _parity(F.col("h"))), "lines-sets", **DICTIONARY)
    release(docs.sparkSession)
    rare, bits = _rarity(sets, shape[0] or 0)

    def may_match(n: Column, p: Column, m: Column, q: Column) -> Column:
        """Length, prefix and positional filters for sets of n and m words that share neighbours at p and q."""
        c = _overlap(n, m)
        near = (F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR) & (F.least(n - p, m - q) + F.least(p, q) >= c)
        return near & (p < n + n + m - c * 3 + 1) & (q < n + m + m - c * 3 + 1)

    size, place_in = lambda x: F.shiftright(x, 32), lambda x: F.col(x).bitwiseAND((1 << 32) - 1)

    def similar(np: str, bits: list[str], np2: str, bits2: list[str]) -> Column:
        """The filters above, and parity bits."""
        n, m = size(np), size(np2)
        return may_match(n, place_in(np), m, place_in(np2)) & _few_differ(n, m, bits, bits2)

    def met(turn: int) -> DataFrame:
        """Rows behind the first of their key: hit, if that line may be similar, and several, if others have the key too."""
        rows = _neighbours(sets, rare, bits, turn).repartition("t")
        # both read one exchange (a filter that asks for values that are not null would part them), and no side is sorted
        firsts = rows.groupBy("t").agg(F.min("at").alias("lead"), F.max("at").alias("last"), F.min_by("np", "at").alias("np2"), F.min_by("bits", "at").alias("bits2"), (F.count("*") > 2).alias("several"))
        behind = rows.join(firsts.where(F.col("lead") < F.col("last")).hint("shuffle_hash"), "t").where(~F.col("at").eqNullSafe(F.col("lead"))).withColumn("hit", similar("np", ["bits"], "np2", ["bits2"]))
        return staged(behind.where("hit or several").select("t", "at", "np", "lead", "hit", "several"), "lines-met")

    parts = []
    for turn in range(PASSES):
        parts.append(met(turn))
        release(docs.sparkSession)
    behind = reduce(DataFrame.union, parts)

    wide = staged(_wide(sets), "lines-wide")
    ones, others = [f"b{k}" for k in range(LONGS)], [f"c{k}" for k in range(LONGS)]
    renamed = dict(zip(ones, others, strict=True))

    def sent(pairs: DataFrame) -> DataFrame:
        """Few pairs are sent to the lines, so these stay in place."""
        return F.broadcast(pairs) if pairs.count() <= MAX_BROADCAST_PAIRS else pairs

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) that parity bits allow."""
        both = sent(pairs).join(wide.withColumnRenamed("at", "x"), "x").join(wide.withColumnsRenamed({"at": "y", "n": "m"} | renamed), "y")
        return staged(both.where(_few_differ(F.col("n"), F.col("m"), ones, others)).select("x", "y"), "lines-likely")

    def verified(pairs: DataFrame) -> DataFrame:
        """x of the pairs (x, y) whose sets are similar."""
        told = sent(pairs)
        xs = told.join(sets.select(F.col("at").alias("x"), F.size("h").alias("n"), F.col("h").alias("a")), "x")
        ys = told.join(sets.select(F.col("at").alias("y"), F.size("h").alias("m"), F.col("h").alias("b")), "y")
        n, m, both = F.col("n"), F.col("m"), F.size(F.array_intersect("a", "b"))
        return staged(xs.join(ys, ["x", "y"]).where(both * DENOMINATOR >= (n + m - both) * NUMERATOR).select("x").distinct(), "lines-sure")

    led = staged(behind.where("hit").select(F.col("at").alias("x"), F.col("lead").alias("y")).distinct(), "lines-led")
    close = likely(led)
    settled = verified(close)
    release(docs.sparkSession, close)
    rest = behind.where("several").select("t", "at", "np").join(wide.drop("n").hint("shuffle_hash"), "at").repartition("t")  # both sides of the join read one exchange
    known = settled.select(F.col("x").alias("at"), F.lit(True).alias("settled"))
    if known.count() <= MAX_BROADCAST_PAIRS:
        known = F.broadcast(known)
    earlier = rest.select("t", F.col("at").alias("y"), F.col("np").alias("np2"), *(F.col(a).alias(b) for a, b in renamed.items()))
    more = rest.join(known, "at", "left").where(~F.coalesce("settled", F.lit(False))).join(earlier, "t").where((F.col("y") < F.col("at")) & similar("np", ones, "np2", others)).select(F.col("at").alias("x"), "y").distinct()
    more = staged(more.join(led, ["x", "y"], "left_anti"), "lines-more")
    release(docs.sparkSession, *parts)
    surely = verified(more)
    near = staged(settled.union(surely).distinct(), "lines-near")
    release(docs.sparkSession, sets, wide, settled, surely, led, more)
    stay = first.join(near.select(F.col("x").alias("at")), "at", "left_anti")
    place = [F.shiftright("at", 26).alias("doc"), F.lit(None).cast("long").alias("h"), F.col("at").bitwiseAND((1 << 26) - 1).cast("int").alias("line")] if whole else ["at.doc", "at.h", "at.line"]
    stay = staged(stay.select(*place), "lines-stay")
    release(docs.sparkSession, first, near)
    return stay


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without the lines that repeat or nearly repeat an earlier one."""
    stay = similar_lines(docs, key, text)
    hc, ls, d, h = (free_name(docs, x) for x in ("hash", "lines", "doc", "h"))
    by_doc = stay.groupBy(F.col("doc").alias(d), F.col("h").alias(h)).agg(F.sort_array(F.collect_list("line")).alias(ls))
    hashed = docs.withColumn(hc, F.xxhash64(F.col(text)))
    joined = hashed.join(by_doc, hashed[key].eqNullSafe(F.col(d)) & (F.col(h).isNull() | (F.col(hc) == F.col(h))), "left")
    places = F.coalesce(F.col(ls), F.array().cast("array<int>"))
    kept = F.element_at(F.transform(F.array(F.split(F.col(text), "\n")), lambda s: F.transform(places, lambda i: F.get(s, i))), 1)
    out = joined.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(kept, "\n")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(dict(docs.dtypes)[n_chars]))
    return out.select(*docs.columns)


def op4_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


OP4_SQL = rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, s, list_distinct(regexp_extract_all(translate(s, '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+')) AS w FROM l),
k AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS o, doc_id, i, s, w, len(w) AS n FROM w),
f AS (SELECT min(o) AS o, list_sort(w) AS w FROM k WHERE n > 0 GROUP BY 2),
e AS (SELECT o, len(w) AS n, unnest(w) AS t FROM f),
p AS (SELECT a.o AS x, b.o AS y FROM e a JOIN e b ON a.t = b.t AND b.o < a.o AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.o, b.o, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT o FROM f EXCEPT SELECT x FROM p),
j AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS text FROM k WHERE n = 0 OR o IN (SELECT o FROM r) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text, CAST(length(CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN j USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {"op4_line_dedup": OP4_SQL}
