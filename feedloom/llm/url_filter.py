"""URL lists: a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical URLs: lower-case host and path. A folder entry ends in "/" and
covers that folder on its host and all subdomains; any other entry covers one URL. A column
is_folder tells them apart; where it is null or missing, every entry that ends in "/" is a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower, stage

# The filter has a block for so many entries, up to a size that every task can hold (some 8 MB). A still longer
# list only lets more false hits through to the join.
ENTRIES_PER_BLOCK = 16
MOST_BLOCKS = 1 << 16
WORDS = 8
BITS = 64
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first "://" to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def filter_blocks(entries: int) -> int:
    """Blocks of a filter for so many entries."""
    return max(1, min(MOST_BLOCKS, -(-entries // ENTRIES_PER_BLOCK)))


def _block(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def _mask(key: Column) -> Column:
    """One bit in each word of the key's block."""
    places = F.xxhash64(key, F.lit(1))
    return F.array(
        *[
            F.call_function(
                "shiftleft",
                F.lit(1).cast("bigint"),
                F.shiftrightunsigned(places, 6 * i).bitwiseAND(BITS - 1).cast("int"),
            )
            for i in range(WORDS)
        ]
    )


def build_filter(entries: DataFrame, size: int) -> DataFrame:
    """(block, words): an entry sets one bit in each word of one block. `size` rows at
    most, each 8 words long."""
    marked = entries.select(_block(F.col("entry"), size).alias("block"), _mask(F.col("entry")).alias("mask"))
    words = [F.bit_or(F.col("mask")[i]).alias(f"w{i}") for i in range(WORDS)]
    blocks = marked.groupBy("block").agg(*words)
    return blocks.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def probe(urls: DataFrame, blocks: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """`urls` with `maybe`, the keys among its columns `keys` that the filter lets through:
    all listed ones and a few others. A task looks keys up in its copy of the filter."""
    out, passed = urls, []
    for key in keys:
        held = F.broadcast(blocks.select(F.col("block").alias(f"b_{key}"), F.col("words").alias(f"w_{key}")))
        out = out.join(held, _block(F.col(key), size) == F.col(f"b_{key}"), "left")
        bits = F.zip_with(f"w_{key}", _mask(F.col(key)), lambda word, bit: word.bitwiseAND(bit) == bit)
        passed.append(F.when(F.forall(bits, lambda same: same), F.col(key)))
    maybe = F.array_distinct(F.array_compact(F.array(*passed)))
    return out.select(*[c for c in urls.columns if c not in keys], maybe.alias("maybe"))


def _key(entry: Column, folder: Column) -> Column:
    """What the filter and the join know an entry by. No canonical URL holds a "?", so a URL
    that ends in "/" has another key than the folder of that name."""
    return F.when(folder, entry).otherwise(F.concat(entry, F.lit("?")))


def _shape(entry: Column, folder: Column) -> Column:
    """(labels of the host, folders of the path) of a folder entry, (-1, -1) of a URL."""
    host = F.substring_index(entry, "/", 1)
    path = F.substring(entry, F.length(host) + 1, F.length(entry))
    labels = F.size(F.split(host, r"\.", -1))
    folders = F.size(F.split(path, "/", -1)) - 2
    return F.struct(
        F.when(folder, labels).otherwise(F.lit(-1)).alias("labels"),
        F.when(folder, folders).otherwise(F.lit(-1)).alias("folders"),
    )


def _candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """The keys of the entries of the given shapes that would cover a URL; null where none can."""
    labels, parts = F.split(host, r"\.", -1), F.split(path, "/", -1)
    found = []
    for n, depth in shapes:
        if n < 0:
            found.append(_key(F.concat(host, path), F.lit(False)))
            continue
        # parts[0] is what stands before the first "/" and must be empty.
        fits = (F.size(labels) >= n) & (F.size(parts) >= depth + 2) & (parts[0] == "")
        end = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
        folder = F.array_join(F.slice(parts, 1, depth + 1), "/")
        found.append(F.when(fits, F.concat(end, folder, F.lit("/"))))
    return found


def listed_shapes(entries: DataFrame) -> list[tuple[int, int]]:
    """Distinct shapes of the entries: a handful, as hosts have few labels and paths few
    folders."""
    rows = entries.select(_shape(F.col("entry"), F.col("is_folder")).alias("s")).distinct().collect()
    return sorted((r["s"]["labels"], r["s"]["folders"]) for r in rows)


def judge(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict for every page's url by the longest entry that covers it.

    `entries`: entry (canonical), verdict ("allow" or "block"), is_rule boolean, and is_folder boolean
    if need be. Of entries given twice, the greatest (is_rule, verdict) counts. A rule decides before any other entry;
    without either the verdict is "allow". Returns page_id, host, path, rule (null without one), verdict,
    and listed (whether a non-rule entry covers the url).

    Null and malformed urls have empty host and path and are allowed. Repeated pages give
    repeated rows; other columns are left out; no entries means all are allowed.

    Only URLs that pass the filter are shuffled, once per distinct URL. A rule that covers
    a third of all URLs makes a large key on the left of that join only, which Spark splits.
    """
    ends = F.col("entry").endswith("/")
    told = F.coalesce(F.col("is_folder"), ends) & ends if "is_folder" in entries.columns else ends
    known = stage(
        entries.withColumn("is_folder", told)
        .groupBy("entry", "is_folder")
        .agg(F.max(F.struct("is_rule", "verdict")).alias("e"))
        .select("entry", "is_folder", "e.*", _key(F.col("entry"), F.col("is_folder")).alias("key")),
        "listed",
    )
    shapes = listed_shapes(known)
    urls = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    if not shapes:
        free = urls.withColumn("maybe", F.array().cast("array<string>"))
        return _verdicts(free, None)
    candidates = _candidates(F.col("host"), F.col("path"), shapes)
    keys = {f"key{i}": c for i, c in enumerate(candidates)}
    size = filter_blocks(known.count())
    blocks = stage(build_filter(known.select(F.col("key").alias("entry")), size), "url-filter")
    probed = probe(urls.withColumns(keys), blocks, size, list(keys))
    hits = (
        probed.where(F.size("maybe") > 0)
        .groupBy("host", "path")
        .agg(F.first("maybe").alias("maybe"))
        .select("host", "path", F.explode("maybe").alias("key"))
        .join(known.hint("shuffle_hash"), "key")
    )
    longest = F.struct(F.length("entry").alias("n"), "entry", "verdict")
    judged = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("is_rule"), longest)).alias("rule"),
        F.max(F.when(~F.col("is_rule"), longest)).alias("other"),
    )
    return _verdicts(probed, judged)


def _verdicts(probed: DataFrame, judged: DataFrame | None) -> DataFrame:
    free = probed.where(F.size("maybe") == 0).select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.lit("allow").alias("verdict"),
        F.lit(False).alias("listed"),
    )
    if judged is None:
        return free
    held = probed.where(F.size("maybe") > 0).join(judged, ["host", "path"], "left")
    return free.unionByName(
        held.select(
            "page_id",
            "host",
            "path",
            F.col("rule.entry").alias("rule"),
            F.coalesce("rule.verdict", "other.verdict", F.lit("allow")).alias("verdict"),
            F.col("other").isNotNull().alias("listed"),
        )
    )


def noncommercial_pages(pages: DataFrame) -> DataFrame:
    """Entries that block the canonical URL of each page with a non-commercial licence line, and
    no other URL, also where it ends in "/"."""
    return (
        pages.where(F.contains("html", F.lit("CC BY-NC")))
        .select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("entry"))
        .where("entry != ''")
        .distinct()
        .select(
            "entry",
            F.lit("block").alias("verdict"),
            F.lit(False).alias("is_rule"),
            F.lit(False).alias("is_folder"),
        )
    )
