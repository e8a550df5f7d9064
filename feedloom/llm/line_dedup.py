"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its runs of five words (of a shorter line, all its words as one). Two lines of Jaccard
similarity 0.8 or more share a token among the first fifth of each, whatever one order all lines sort their
tokens in: the prefix filter joins only those. Pairs whose sizes differ too much (length filter) or that
can't share enough tokens beside the shared ones (positional filter) go before they are compared.
What remains is verified on all tokens of both lines.

Prefixes are longer by SHARED - 1 tokens than one shared token needs, so similar lines share SHARED of them.

The first order takes tokens with long first words as rare. Lines that share only tokens of many lines there meet
by the rarest of these. Those that meet so under a token that many lines have are sorted again, by how many of them have
each token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import free_names, joined_by_row, release, stage, text_key

SHINGLE = 5
# A token is a long: its place in the order above this many bits of a hash.
HASH_BITS = 56
LAST = 127
# A token of more lines than this is frequent: its lines are not compared pair by pair.
FEW = 32
# Similar lines share so many tokens of their prefixes, or as many as they share at all.
SHARED = 4
# At most this many rows of 64 bits are sent to every task, to let go of rows without a match.
SIEVE_ROWS = 1 << 18
# A line with over 1/HEAVY of all lines is put in the index once; there are at most so many of them.
HEAVY = 10_000
BLANKS = "\t\x0b\f\r"


def words_of(line: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased, each byte read as a letter of its own.

    That takes a fraction of the time of translate() on text beyond ASCII. lower() then changes first bytes of
    UTF-8 letters as well, but different letters stay different: the number of bytes that follow tells what the first was.
    """
    plain = F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    for blank in BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def tokens_of(words: Column, shingle: int = SHINGLE) -> Column:
    """Distinct runs of `shingle` words, in the first order; all words of a shorter line as one."""

    def token(i: Column) -> Column:
        # Words behind the end of a short line are null, which a hash leaves out.
        run = F.xxhash64(*[F.get(words, i + k) for k in range(shingle)])
        length = F.coalesce(F.octet_length(F.get(words, i)), F.lit(0))
        return _ranked(F.greatest(LAST - length, F.lit(0)), _low_bits(run))

    runs = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    return F.sort_array(F.array_distinct(F.transform(runs, token)))


def _ranked(rank: Column, low_bits: Column) -> Column:
    return F.shiftleft(rank.cast("bigint"), HASH_BITS).bitwiseOR(low_bits)


def _low_bits(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - HASH_BITS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line) of all lines."""
    return keyed(docs).select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _tokenised(lines: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, line_no, h1, h2, n, prefix) of lines with words: two hashes that name equal lines, the
    number of distinct tokens, and the first of them."""
    words = F.col("words")
    return (
        # Not by the number of words: Spark would make them once more for that.
        lines.where(F.btrim("line", F.lit(" " + BLANKS)) != "")
        .select(*PLACE, words_of(F.col("line")).alias("words"))
        # With a literal behind it, the second hash would follow from the first.
        .select(
            *PLACE,
            F.xxhash64(words).alias("h1"),
            F.xxhash64(F.lit(1), words).alias("h2"),
            tokens_of(words, shingle).alias("tokens"),
        )
        .select(
            *PLACE,
            *NAME,
            F.size("tokens").alias("n"),
            F.slice("tokens", 1, _prefix_length(F.size("tokens"))).alias("prefix"),
        )
    )


def _enough(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard of 0.8 or more, in whole numbers: 9 * shared >= 4 * (left + right)."""
    return shared * 9 >= (left + right) * 4


def _least_shared(n: Column) -> Column:
    """ceil(0.8 n): so many tokens a line of n shares with any similar one."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def _prefix_length(n: Column) -> Column:
    """Of the tokens that a line shares with a similar one, the first SHARED lie among so many of its first."""
    return F.least(n, n - _least_shared(n) + SHARED)


def _needed(n: Column) -> Column:
    """So many tokens the prefixes of a line of n tokens and of any similar one share."""
    return F.least(F.lit(SHARED), _least_shared(n))


PLACE = ("doc_id", "text_key", "line_no")
NAME = ("h1", "h2")


def repeated_lines(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, line_no) of the lines that go.

    A line goes when an earlier one, by (doc_id, text_key, line_no), is equal up to ASCII case and white space,
    or has at least 0.8 of its tokens' union in common. Earlier lines count whether they go
    themselves or not, so the result doesn't depend on any order of work. Lines without
    words stay. Null texts have no lines; a null doc_id comes before all others. Rows that
    repeat a doc_id, null or not, and differ in their texts are documents of their own; rows that repeat
    both count as one document. Other columns are left out; an empty table gives an empty result.

    Lines are joined by h1 alone; different lines of one h1 are told apart when they are compared. Lines that share
    a token of FEW lines at most are paired, if the tokens of their prefixes allow it. Those that share frequent ones only must
    share SHARED of them, and meet under the rarest of these, again if it has FEW lines at most. The others
    are sorted by the frequency of all their tokens, which puts a common passage behind what else a line has, and
    joined by the first tokens of that order. Where a token is frequent even so, each line is first
    compared with the earliest of the token's lines; only lines that nothing has settled then are joined with the others.
    """
    lines = stage(_tokenised(lines_of(docs), shingle), "lines")
    firsts = stage(
        lines.groupBy(*NAME).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("copies")),
        "first-lines",
    )
    shared = stage(_shared(lines, firsts), "line-index")
    rare, frequent = _split(shared)
    gathered = stage(_gathered(frequent), "line-index")
    few, many = _by_number(gathered)
    pairs = stage(_pairs(rare).union(_pairs_of_frequent(few)), "line-pairs")

    crowded = stage(many.select("h1").distinct(), "crowded-lines")
    again = stage(_by_frequency(_line_tokens(docs, firsts, crowded, shingle)), "line-index")
    release(shared, gathered, crowded)
    rare, frequent = _split(again)
    led = stage(frequent.join(firsts.groupBy("h1").agg(F.min("first").alias("first")), "h1"), "frequent-tokens")
    leaders = led.groupBy("token").agg(F.min(F.struct("first", "h1", "n", "place")).alias("leader")).select(
        "token", "leader.*"
    )
    pairs = pairs.union(_pairs(rare)).union(_with_earlier(led, leaders))
    pairs = stage(pairs.distinct(), "line-pairs")
    similar = stage(_verified(docs, firsts, pairs, shingle), "similar-lines")
    release(again, pairs)

    open_lines = led.join(similar.select("h1").distinct(), "h1", "left_anti")
    rest = stage(_with_earlier(open_lines, led), "line-pairs")
    similar = stage(similar.union(_verified(docs, firsts, rest, shingle)).distinct(), "similar-lines")
    release(led, rest)

    repeated = (
        firsts.join(similar.withColumn("goes", F.lit(True)), [*NAME], "left")
        .where("copies > 1 OR goes")
        .drop("copies")
    )
    repeated = stage(repeated, "repeated-lines")
    return (
        _matching(lines.select(*PLACE, *NAME), repeated, "h1")
        .join(repeated, [*NAME])
        .where(F.col("goes").isNotNull() | (F.struct(*PLACE) != F.col("first")))
        .select(*PLACE)
    )


def _shared(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(token, h1, n, place) of the tokens that the prefixes of different lines share.

    The index is moved once. Rows of a token lie in the order of h1, so a row has a neighbour of
    another line where the token is shared.
    """
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    heavy = firsts.where(F.col("copies") > max(100, total // HEAVY)).drop("copies")
    index = (
        lines.join(F.broadcast(heavy), [*NAME], "left")
        .where(F.col("first").isNull() | (F.struct(*PLACE) == F.col("first")))
        .select("h1", "n", F.posexplode("prefix").alias("place", "token"))
    )
    row = Window.partitionBy("token").orderBy("h1")
    return (
        index.withColumns({"before": F.lag("h1").over(row), "after": F.lead("h1").over(row)})
        .where("before != h1 OR after != h1")
        .groupBy("token", "h1")
        .agg(F.min("n").alias("n"), F.min("place").alias("place"))
    )


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the tokens of two to FEW lines, with the number of frequent tokens that the line has beside them;
    rows of the frequent tokens."""
    few, frequent = _by_number(rows)
    beside = frequent.groupBy("h1").agg(F.count(F.lit(1)).alias("frequent"))
    return few.join(beside, "h1", "left").fillna(0, ["frequent"]), frequent


def _by_number(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the tokens of at most FEW lines, and of the others."""
    tokens = stage(rows.groupBy("token").count().where(F.col("count") > FEW).select("token"), "tokens")
    return rows.join(tokens, "token", "left_anti"), rows.join(tokens, "token", "left_semi")


def _gathered(frequent: DataFrame) -> DataFrame:
    """(token, h1, n, held): of lines that hold enough frequent tokens to be similar by these alone, the rarest of them, as
    many as a prefix needs. held: all of them."""
    counts = frequent.groupBy("token").agg(F.count(F.lit(1)).alias("lines"))
    held = F.sort_array(F.collect_list(F.struct("lines", "token")))
    return (
        frequent.join(counts, "token")
        .groupBy("h1")
        .agg(F.min("n").alias("n"), held.alias("held"))
        .select("h1", "n", F.col("held.token").alias("held"))
        .where(F.size("held") >= _needed(F.col("n")))
        .select("h1", "n", "held", F.explode(F.slice("held", 1, F.size("held") - _needed(F.col("n")) + 1)).alias("token"))
    )


def _pairs_of_frequent(rows: DataFrame) -> DataFrame:
    """(h1, a_h1) of the pairs of lines of `_gathered` that share enough frequent tokens, one of them in `rows`."""
    enough = F.size(F.array_intersect("held", "a_held")) >= F.greatest(_needed(F.col("n")), _needed(F.col("a_n")))
    joined = rows.join(_beside(rows), "token").where((F.col("a_h1") < F.col("h1")) & _near_in_size() & enough)
    return joined.select("h1", "a_h1").distinct()


def _by_frequency(held: DataFrame) -> DataFrame:
    """(token, h1, n, place) of the first tokens of lines, in the order of their frequency among all of `held`."""
    each = held.select("h1", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").count().where("count > 1")
    # Four times the binary logarithm: 0 is a token of one line.
    rank = F.least(F.floor(F.log2(F.coalesce("count", F.lit(1))) * 4), F.lit(LAST))
    bits = F.col("token").bitwiseAND((1 << HASH_BITS) - 1)
    return (
        each.join(counts, "token", "left")
        .select("h1", _ranked(rank, bits).alias("token"))
        .groupBy("h1")
        .agg(F.sort_array(F.collect_set("token")).alias("tokens"))
        .withColumn("n", F.size("tokens"))
        .select("h1", "n", F.posexplode(F.slice("tokens", 1, _prefix_length(F.col("n")))).alias("place", "token"))
        .where(F.col("token") >= 1 << HASH_BITS)
    )


def _matching(big: DataFrame, small: DataFrame, *key: str) -> DataFrame:
    """Rows of `big` whose key's class, one of 64 * SIEVE_ROWS, occurs in `small`. Every task gets SIEVE_ROWS rows at
    most; where `small` has all classes, no row goes, and the join that follows decides."""
    hashed = F.xxhash64(*key)
    row, bit = hashed.bitwiseAND(SIEVE_ROWS - 1), F.shiftrightunsigned(hashed, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    sieve = small.select(row.alias("sieve_row"), one.alias("one")).groupBy("sieve_row").agg(F.bit_or("one").alias("sieve_bits"))
    found = (row == F.col("sieve_row")) & (F.getbit("sieve_bits", bit) == 1)
    return big.join(F.broadcast(sieve), found, "left_semi")


def _near_in_size() -> Column:
    """Length filter for (n, a_n)."""
    n, other = F.col("n"), F.col("a_n")
    return (n * 5 >= other * 4) & (other * 5 >= n * 4)


def _beside(rows: DataFrame) -> DataFrame:
    """`rows` as the other side of a join by token."""
    return rows.select("token", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != "token"])


def _pairs(rows: DataFrame) -> DataFrame:
    """(h1, a_h1) of the pairs of lines that share a token of `rows` and that the positional filter leaves.

    Tokens are in one order in all lines, so what two lines share lies, in both, up to their last shared token here or
    behind it. And what the shorter reach of the two prefixes holds beside the shared tokens isn't shared: the whole prefix of
    one line, and of the other at least what comes up to the last shared token.
    """
    joined = rows.join(_beside(rows), "token").where((F.col("a_h1") < F.col("h1")) & _near_in_size())
    ends = joined.groupBy("h1", "a_h1", "n", "a_n", "frequent", "a_frequent").agg(
        F.count(F.lit(1)).alias("here"),
        F.max("place").alias("last"),
        F.max("a_place").alias("a_last"),
    )
    n, a_n = F.col("n"), F.col("a_n")
    shared = F.col("here") + F.least("frequent", "a_frequent")
    behind = F.least(n - F.col("last"), a_n - F.col("a_last")) - 1
    apart = F.least(_prefix_length(n) + F.col("a_last"), _prefix_length(a_n) + F.col("last")) + 1 - shared * 2
    needed = F.greatest(_needed(n), _needed(a_n))
    possible = (shared >= needed) & _enough(shared + behind, n, a_n) & (apart * 9 <= n + a_n)
    return ends.where(possible).select("h1", "a_h1")


def _with_earlier(rows: DataFrame, others: DataFrame) -> DataFrame:
    """(h1, a_h1) of the pairs whose first shared token may be one of `rows`, the second line being the earlier one.

    Nothing that comes before the first shared token counts, which leaves each line a place that it has to be in.
    """
    n, a_n = F.col("n"), F.col("a_n")
    in_reach = _enough(F.least(n - F.col("place"), a_n - F.col("a_place")), n, a_n)
    earlier = F.col("a_first") < F.col("first")
    joined = rows.join(_beside(others), "token").where(earlier & _near_in_size() & in_reach)
    return joined.select("h1", "a_h1").distinct()


def _line_tokens(docs: DataFrame, firsts: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """(h1, h2, first, tokens) of the lines with the h1 of `names`."""
    wanted = _matching(firsts, names, "h1").join(names, "h1", "left_semi").select(
        *NAME,
        "first",
        F.col("first.doc_id").alias("id"),
        F.col("first.text_key").alias("key"),
        F.col("first.line_no").alias("no"),
    )
    places = stage(wanted, "wanted-lines").withColumnsRenamed({"key": "text_key", "no": "line_no"})
    lines = _matching(lines_of(_matching(keyed(docs), places, "text_key")), places, "text_key", "line_no")
    wanted = places.withColumnsRenamed({"text_key": "key", "line_no": "no"})
    same = (
        F.col("doc_id").eqNullSafe(F.col("id"))
        & (F.col("text_key") == F.col("key"))
        & (F.col("line_no") == F.col("no"))
    )
    found = lines.join(wanted, same).select(*NAME, "first", words_of(F.col("line")).alias("words"))
    # Rows that repeat id and text give a name more than once.
    tokens = found.select(*NAME, "first", tokens_of(F.col("words"), shingle).alias("tokens"))
    return stage(tokens.dropDuplicates([*NAME]), "line-tokens")


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(h1, h2) of the lines in `pairs` whose tokens really are similar to the other line's, the later of both."""
    names = pairs.select("h1").union(pairs.select("a_h1")).distinct()
    held = _line_tokens(docs, firsts, names, shingle)
    other = held.withColumnsRenamed({c: f"a_{c}" for c in held.columns})
    both = F.size(F.array_intersect("tokens", "a_tokens"))
    later = F.when(F.col("a_first") < F.col("first"), F.struct(*NAME)).otherwise(
        F.struct(F.col("a_h1").alias("h1"), F.col("a_h2").alias("h2"))
    )
    return (
        pairs.join(held, "h1")
        .join(other, "a_h1")
        .where(_enough(both, F.size("tokens"), F.size("a_tokens")))
        .select(later.alias("later"))
        .select("later.*")
        .distinct()
    )


def report(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (numbers of the lines that go, comma-joined), for
    each row of `docs`."""
    gone = repeated.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    none = F.array().cast("array<int>")
    return (
        keyed(docs)
        .select("doc_id", "text_key", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"))
        .join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
        .select(
            "doc_id",
            "n_lines",
            F.size(F.coalesce("gone", none)).cast("bigint").alias("n_removed"),
            F.array_join(F.coalesce("gone", none).cast("array<string>"), ",").alias("removed"),
        )
    )


def without_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` without the lines that go. A document that loses all its lines goes as well.

    A column n_chars follows the new text; all other columns stay as they are.
    """
    gone, kept = free_names(docs, "gone", "kept")
    numbers = repeated.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias(gone))
    joined = joined_by_row(docs, numbers, "left")
    touched = F.col(gone).isNotNull() & F.col("text").isNotNull()
    stay = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return (
        joined.withColumn(kept, F.when(touched, stay))
        .where(~touched | (F.size(kept) > 0))
        .withColumn("text", F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text")))
        .withColumns({"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {})
        .select(*docs.columns)
    )
