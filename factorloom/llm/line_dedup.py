"""Near-duplicate lines by an exact set-similarity join on words, of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, scope, stage

#: White space other than blanks that ends a word inside a line.
_SPACES = "\t\x0b\x0c\r"
#: Words share 2**18 slots, each with four bits for how many lines hold its words: a table of fixed size, as it stands in the plan.
SLOT_BITS, CLASS_BITS = 18, 4
#: Last pairs of each line's prefix (near copies differ in rarer words) by which the first rounds find a line's likely partner;
#: rows from which a list of such a pair is long; how many lines of a list, at most, each of these rounds takes as partners.
LAST_PAIRS, LONG_LIST, PIVOTS = 3, 16, (8, 64)
#: Sets of up to so many words are told apart well enough by parities in 64 slots; larger ones have them in 128.
SMALL_SET = 56
#: Slots of documents that hold lines to be verified, and of lines that are decided: broadcasts of fixed size. They only save work.
DOC_SLOTS = LINE_SLOTS = 1 << 18
_KEY = ["__row", "line_no"]


def _shift_left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def _blanks(text: Column) -> Column:
    any_of, plain = F.lit(False), text
    for x in _SPACES:
        any_of, plain = any_of | text.contains(x), F.replace(plain, F.lit(x), F.lit(" "))
    return F.when(any_of, plain).otherwise(text)


def line_words(line: Column) -> Column:
    """The words of a line."""
    return F.array_remove(F.split(_blanks(line), " "), "")


def line_hashes(docs: DataFrame) -> DataFrame:
    """A row for each line with words: __row, doc_id, line_no, and h, the hashes of its distinct words."""
    lines = docs.select("__row", "doc_id", F.posexplode(F.split(_blanks(F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
    h = F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    return lines.where(F.trim("line") != "").select("__row", "doc_id", "line_no", F.array_remove(h, F.xxhash64(F.lit(""))).alias("h"))


def _numbers(values: Iterable[int]) -> Column:
    """An array of longs that stands in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def rarity_table(hashes: DataFrame) -> Column:
    """2**18 longs as a literal array: for each slot a class of four bits that rises with how many lines hold its words,
    beginning at a sixteenth of a slot's mean. A word's slot is its hash's highest bits; the class is kept as what turns the
    hash's four highest bits into the class, with the top bit flipped, as tokens sort as signed numbers."""
    counts = hashes.select(F.explode("h").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "line-rarity")
    total = counts.agg(F.sum("n")).first()[0] or 1
    level = F.floor(F.log2(F.col("n") * F.lit(float(1 << SLOT_BITS) / total))) + 4
    level = F.greatest(F.lit(0), F.least(F.lit((1 << CLASS_BITS) - 1), level)).cast("long").bitwiseXOR(F.lit(8))
    # 2**12 rows at most go to the driver, each 64 slots of four bits in four longs.
    four = [F.bit_or(F.when(F.shiftright("slot", 4).bitwiseAND(F.lit(3)) == i, _shift_left(level, F.col("slot").bitwiseAND(F.lit(15)) * CLASS_BITS)).otherwise(0)) for i in range(4)]
    table = [0] * (1 << SLOT_BITS)
    for at, *longs in counts.groupBy(F.shiftright("slot", 6).alias("at")).agg(*four).collect():
        for k in range(64):
            table[64 * at + k] = longs[k // 16] >> k % 16 * CLASS_BITS & 15
    return _numbers(x ^ i >> SLOT_BITS - CLASS_BITS for i, x in enumerate(table))


def token(h: Column, table: Column) -> Column:
    """A word's hash as a long whose highest four bits are the word's class, so that words sort by rarity."""
    # Functions over arrays evaluate each of their parts by itself, so they have few; a column that can't be null sorts as plain longs.
    changed = _shift_left(F.get(table, F.shiftrightunsigned(h, 64 - SLOT_BITS)), F.lit(64 - CLASS_BITS)).bitwiseXOR(h)
    return F.coalesce(changed, F.lit(0).cast("long"))


def _parities(bits: Column) -> Column:
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.get(bits, t.bitwiseAND(F.lit(127)))))


def line_sets(docs: DataFrame, percent: int) -> DataFrame:
    """The distinct word sets of all lines, each at its first line: __row, doc_id, line_no, n (words), p0 and p1 (parities of
    the words' counts in 64 slots, and in the upper half of 128, null for small sets), and the prefix tokens, rarest first.

    Equal sets are known by 128 bits. They meet after each task has kept its own first of them, so a line that a third of all
    rows hold is a row for each task. Texts are cut into words once: what counts their rarity and what sorts by it read hashes.
    """
    spark = docs.sparkSession
    with scope("line-hashes"):
        hashes = stage(line_hashes(docs), "line-hashes")
    table = rarity_table(hashes)
    sets = hashes.select("__row", "doc_id", "line_no", F.sort_array(F.transform("h", lambda h: token(h, table))).alias("tokens"))
    n = F.size("tokens")
    prefix = n - F.floor((n * F.lit(percent) + 99) / 100).cast("int") + 1
    bits = [(1 << i) - (i == 63) * (1 << 64) for i in range(64)]
    every, second = _parities(_numbers(bits * 2)), F.when(n > SMALL_SET, _parities(_numbers([0] * 64 + bits)))
    sets = sets.select("__row", "doc_id", "line_no", n.alias("n"), every.alias("p0"), second.alias("p1"), F.xxhash64("tokens").alias("h0"), F.xxhash64(F.lit(7), "tokens").alias("h1"), F.slice("tokens", F.lit(1), prefix).alias("prefix"))
    first = Window.partitionBy("h0", "h1", "n").orderBy(F.col("doc_id").asc_nulls_first(), "__row", "line_no")
    sets = stage(sets.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("h0", "h1", "nth"), "line-sets")
    release(spark, "line-hashes")
    return sets


def _earlier(a: str, b: str) -> Column:
    """Whether line b stands before line a: in order of doc_id (null first), row and line."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    in_row = (y("__row") < x("__row")) | ((y("__row") == x("__row")) & (y("line_no") < x("line_no")))
    return F.coalesce(y("doc_id") < x("doc_id"), y("doc_id").isNull() & x("doc_id").isNotNull()) | (x("doc_id").eqNullSafe(y("doc_id")) & in_row)


def _differ(a: str, b: str) -> Column:
    """In how many of 128 slots (of 64, if one is small) the parities of two sets differ: in no more than the sets differ in words."""
    every, second = F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0")), F.coalesce(F.col(f"{a}.p1").bitwiseXOR(F.col(f"{b}.p1")), F.lit(0).cast("long"))
    return F.bit_count(every.bitwiseXOR(second)) + F.bit_count(second)


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m words link if they share so many."""
    return shared * F.lit(100 + percent).cast("long") >= (n + m) * F.lit(percent).cast("long")


def _may_link(a: str, b: str, n: Column, m: Column, percent: int) -> Column:
    """Length, positional and parity filters for sets a of n and b of m words that share the tokens at their pos."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    most = F.least(n - x("pos"), m - y("pos")) + F.least(x("pos"), y("pos"))
    alike = F.shiftright((n + m - _differ(a, b)).cast("int"), 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & _enough(most, n, m, percent) & _enough(alike, n, m, percent)


def long_lists(sets: DataFrame) -> DataFrame:
    """The rows of the long lists of pairs of neighbours among the last tokens of prefixes: near copies share such pairs, others
    seldom do. pos: of the pair's first token."""
    size = F.size("prefix")
    pair = lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.get("prefix", i - 1), F.get("prefix", i)).alias("token"))
    pairs = F.transform(F.sequence(F.greatest(size - LAST_PAIRS, F.lit(1)), size - 1), pair)
    few = sets.where(size > 1).select("__row", "doc_id", "line_no", "n", "p0", "p1", F.explode(pairs).alias("pair"))
    few = few.select("__row", "doc_id", "line_no", "n", "p0", "p1", "pair.pos", "pair.token")
    long = few.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LONG_LIST)
    return few.join(long.select("token"), "token")


def likely_pairs(rows: DataFrame, asking: DataFrame | None, pivots: int, percent: int) -> DataFrame:
    """For the asking lines of long lists (None: all), the likeliest earlier partner: late and early keys, a pair for each late line.

    Partners are the first documents of a list in each of `pivots` classes of doc_ids; the likeliest differs in fewest parities.
    """
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(pivots)).cast("int")
    firsts = rows.groupBy(F.col("token").alias("t"), chosen.alias("c")).agg(F.min("doc_id").alias("first_id"))
    firsts = rows.join(firsts, (F.col("token") == F.col("t")) & (chosen == F.col("c")) & (F.col("doc_id") == F.col("first_id"))).select(*rows.columns)
    late = rows if asking is None else rows.join(asking, _KEY, "left_semi").select(*rows.columns)
    both = late.alias("a").join(firsts.alias("b"), F.col("a.token") == F.col("b.token"))
    both = both.where(_earlier("a", "b") & _may_link("a", "b", F.col("a.n"), F.col("b.n"), percent))
    best = F.min(F.struct(_differ("a", "b").alias("differ"), "b.__row", "b.line_no")).alias("best")
    return both.groupBy(F.col("a.__row").alias("__row"), F.col("a.line_no").alias("line_no")).agg(best).select(*_KEY, F.col("best.__row").alias("early_row"), F.col("best.line_no").alias("early_line"))


def open_pairs(sets: DataFrame, done: DataFrame | None, percent: int) -> DataFrame:
    """All pairs (late and early keys) that may link, of lines that `done` does not hold and any earlier ones."""
    if done is None:
        flagged = sets.withColumn("r", F.lit(None).cast("long"))
    else:
        known = done.select(F.col("__row").alias("r"), F.col("line_no").alias("l"))
        slot = lambda row, line: F.pmod(F.xxhash64(row, line), F.lit(LINE_SLOTS)).cast("int")
        slots = F.broadcast(known.select(slot("r", "l").alias("slot")).distinct())  # at most LINE_SLOTS rows
        # Only lines that share a slot with a decided one move to meet it.
        some = sets.join(slots, slot("__row", "line_no") == F.col("slot"), "left_semi").join(known, (F.col("__row") == F.col("r")) & (F.col("line_no") == F.col("l")), "left").drop("l")
        flagged = sets.join(slots, slot("__row", "line_no") == F.col("slot"), "left_anti").withColumn("r", F.lit(None).cast("long")).unionByName(some)
    # Both sides of the join read one shuffle, so whether a line still asks stands in the lowest bit beside its size.
    rows = flagged.select("__row", "doc_id", "line_no", (F.col("n") * 2 + F.col("r").isNull().cast("int")).alias("n2"), "p0", "p1", "prefix", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("__row", "doc_id", "line_no", "n2", "p0", "p1", "pos", "token", F.get("prefix", F.col("pos") - 1).alias("before"))
    n, m = F.shiftright("a.n2", 1), F.shiftright("b.n2", 1)
    asks = F.col("a.n2").bitwiseAND(F.lit(1)) * m > 0
    # Lines that share the token before, too, meet there. Those that link meet at the first token they share, with none before it.
    new = (F.col("a.before") != F.col("b.before")) | (F.col("a.pos") == 0) | (F.col("b.pos") == 0)
    first = _enough(F.least(n - F.col("a.pos"), m - F.col("b.pos")), n, m, percent)
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & asks & first & new & _may_link("a", "b", n, m, percent) & _earlier("a", "b"))
    return both.select(F.col("a.__row").alias("__row"), F.col("a.line_no").alias("line_no"), F.col("b.__row").alias("early_row"), F.col("b.line_no").alias("early_line")).distinct()


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The late lines of pairs whose words, as written, link with the early one's."""
    ends = pairs.select(*_KEY).unionByName(pairs.select(F.col("early_row").alias("__row"), F.col("early_line").alias("line_no"))).distinct()
    ends = stage(ends.groupBy(F.col("__row").alias("wanted_row")).agg(F.collect_list("line_no").alias("wanted")), "line-ends")  # lines of one document
    slot = lambda row: F.pmod(F.xxhash64(row), F.lit(DOC_SLOTS)).cast("int")
    slots = F.broadcast(ends.select(slot(F.col("wanted_row")).alias("slot")).distinct())  # at most DOC_SLOTS rows
    some = docs.select("__row", "text").join(slots, slot(F.col("__row")) == F.col("slot"), "left_semi")
    some = some.join(ends, F.col("__row") == F.col("wanted_row")).select("__row", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line_no"))
    some = stage(some.select("__row", "line_no", F.array_distinct(line_words(F.get("lines", F.col("line_no")))).alias("x")), "line-texts")
    early = some.select(F.col("__row").alias("early_row"), F.col("line_no").alias("early_line"), F.col("x").alias("y"))
    both = pairs.join(early, ["early_row", "early_line"]).join(some, _KEY)
    # 100 shared >= percent (words - shared), with what is shared named once: filters make their expressions anew wherever one is named.
    return both.where(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent)).select(*_KEY).distinct()


def kept_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(__row, line_no) of each line with words that stays: no earlier line shares words with 100 |A and B| >= percent |A or B|.

    docs: __row (unique), doc_id, text. Lines stand in order of doc_id (null first), __row and line_no, and are judged
    on the input: a line that is removed still stands against later ones.

    Words are ordered by rarity; of a line's n distinct words the n - ceil(percent n / 100) + 1 rarest must hold one of
    any partner's (prefix filter). Of equal sets the first line stays. In the first rounds the lines of long lists meet a few
    likely partners each, so that a group of near copies costs a few rows for each, not one for each pair. Lines that these
    leave open, and those of short lists, are joined with all earlier lines of their lists under the length, positional and
    parity filters (sets differ in no fewer words than slots in parity). What passes is verified on the words themselves.
    """
    sets = line_sets(docs, percent)
    rows = stage(long_lists(sets), "line-long")
    done = asking = None
    for pivots in PIVOTS:
        likely = stage(likely_pairs(rows, asking, pivots, percent), "line-likely")
        if likely.isEmpty():
            break
        found = stage(verified(docs, likely, percent), "line-found")
        done = found if done is None else done.unionByName(found)
        asking = stage(likely.select(*_KEY).join(found, _KEY, "left_anti"), "line-asking")  # their likeliest partner was none
    more = stage(open_pairs(sets, done, percent), "line-pairs")
    gone = verified(docs, more, percent)
    return sets.select(*_KEY).join(gone if done is None else done.unionByName(gone), _KEY, "left_anti")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the lines that resemble an earlier line, with n_lines and n_removed added.

    docs: doc_id, text (other columns are kept; ones named n_lines or n_removed are replaced). Kept lines stay as they
    are, joined by line feeds. Lines without words stay. Null texts stay null, with no lines; empty texts have one line
    without words. Rows are told apart by their place in the input, so docs must be a table that reads alike each time.
    Repeated rows lose the lines that their first copy keeps. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_removed")
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    kept = kept_lines(numbered.select("__row", "doc_id", "text"), percent)
    kept = stage(kept.groupBy(F.col("__row").alias("__kept_row")).agg(F.collect_list("line_no").alias("__kept")), "line-kept")  # lines of one document
    both = numbered.join(kept, F.col("__row") == F.col("__kept_row"), "left")
    lines = F.split("text", "\n")
    # One character for each line, in order, and one more after those that stay; cut at the former.
    marks = F.concat(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i * 2), F.transform(F.coalesce("__kept", F.array().cast("array<int>")), lambda i: i * 2 + 1))
    marks = F.array_join(F.transform(F.sort_array(marks), lambda x: F.when(x % 2 == 0, F.lit("|")).otherwise(F.lit("+"))), "")
    both = both.withColumn("__lines", lines).withColumn("__stays", F.split(marks, r"\|"))
    left = F.filter("__lines", lambda x, i: (F.get("__stays", i + 1) == "+") | (F.trim(_blanks(x)) == ""))
    both = both.withColumn("__left", left)
    n_lines = F.coalesce(F.size("__lines"), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long")
    n_removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__left")).cast("long")
    text = F.when(F.col("text").isNotNull(), F.array_join("__left", "\n"))
    return both.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
