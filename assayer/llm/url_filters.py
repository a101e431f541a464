"""URL filters by dated lists: an as-of join of captures with list entries (DataFrame operations only).

A list entry says that from some time on a pattern is, or is no longer, on a list.  Entries of one list
and pattern become validity intervals; a capture meets the intervals that hold at its fetch time.  A
pattern is a host, which covers its subdomains, or a host with leading path segments.

Intervals are cut at the borders of fixed time slices, so the join is an equi-join on (key of the pattern,
slice) with a range check inside, and a hot host is spread over its slices; what still is hot is left to
Spark's skew join.  Keys are hashes that build up along a url, so a url of n segments makes n short rows;
the texts of what meets are compared after the join.  A capture is blocked if the longest pattern that blocks it is longer than the longest that
allows it.

Defined cases: a null or unparsable url, or a null time, meets nothing; entries with null pattern or time
are ignored; of entries of a list and pattern at one time, a removal wins; repeated captures are judged
each; a url of any length is matched in proportion to its length; empty tables give no rows or no matches;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.storage import materialize

#: Days of a time slice.
SLICE_DAYS = 30
END = "9999-12-31"
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """The lower-cased host of a url without a closing dot, empty if it has none; an IPv6 address keeps its brackets."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(found, r"\.$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _parts(url: Column) -> tuple[Column, Column]:
    """Labels of the host from the last to the first, an address being one label, and the segments of the path."""
    name = host(url)
    labels = F.when(name.rlike(ADDRESS), F.array(name)).otherwise(F.reverse(F.split(name, r"\.")))
    return labels, F.filter(F.split(path(url), "/"), lambda s: s != "")


def _hashed(parts: Column, seed: int) -> Column:
    """A hash for each part and its place; a sequence of parts has the exclusive or of theirs as its key."""
    return F.transform(parts, lambda part, place: F.xxhash64(F.lit(seed), place, part))


DOMAIN, PATH = 1, 2


def pattern_key(pattern: Column) -> Column:
    """The key of a list's pattern: of its host's labels, or of its host and segments."""
    whole = F.split(pattern, "/", -1)
    name = F.get(whole, F.lit(0))
    labels = F.when(name.rlike(ADDRESS), F.array(name)).otherwise(F.reverse(F.split(name, r"\.", -1)))
    hashes = F.when(F.size(whole) > 1, _hashed(whole, PATH)).otherwise(_hashed(labels, DOMAIN))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def pattern_keys(captures: DataFrame) -> DataFrame:
    """``row, at, key``: the keys of all patterns that cover a capture, of ``captures(row, url, at)``.

    These are its host, parent domains of two labels or more (an address has none), and the prefixes of
    its path.  Prefixes are never spelled out: each part is one row, and keys are running exclusive ors.
    """
    labels, segments = _parts(F.col("url"))
    named = captures.filter(host(F.col("url")) != "")
    parts = F.array(
        F.struct(F.lit(DOMAIN).alias("kind"), F.least(F.size(labels), F.lit(2)).alias("least"), _hashed(labels, DOMAIN).alias("hashes")),
        F.struct(F.lit(PATH).alias("kind"), F.lit(2).alias("least"), _hashed(F.concat(F.array(host(F.col("url"))), segments), PATH).alias("hashes")),
    )
    sequences = named.select("row", "at", F.explode(parts).alias("p")).select("row", "at", "p.kind", "p.least", F.posexplode("p.hashes").alias("place", "hash"))
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    keyed = sequences.withColumn("key", F.bit_xor("hash").over(along))
    return keyed.filter(F.col("place") + 1 >= F.col("least")).select("row", "at", "key")


def covers(pattern: Column, url: Column) -> Column:
    """Whether a pattern covers a url, by their texts."""
    name, whole = host(url), F.concat_ws("/", F.array(host(url)), _parts(url)[1])
    domain = (name == pattern) | (name.endswith(F.concat(F.lit("."), pattern)) & ~name.rlike(ADDRESS) & pattern.contains("."))
    return F.when(pattern.contains("/"), (whole == pattern) | whole.startswith(F.concat(pattern, F.lit("/")))).otherwise(domain)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, action, pattern, since, until`` from ``entries(list, action, pattern, listed, at)``; ``until`` is open.

    Entries are ordered within a time slice; of a pattern's slices only the first times are ordered as a
    whole, so a hot pattern is spread over its slices.
    """
    keys = ["list", "action", "pattern"]
    known = entries.filter("pattern is not null and at is not null")
    once = known.groupBy(*keys, _slice(F.col("at")).alias("slice"), "at").agg(F.bool_and("listed").alias("listed"))
    following = F.lead("at").over(Window.partitionBy(*keys, "slice").orderBy("at"))
    firsts = once.groupBy(*keys, "slice").agg(F.min("at").alias("first"))
    onward = firsts.withColumn("onward", F.lead("first").over(Window.partitionBy(*keys).orderBy("slice"))).drop("first")
    rows, ends = once.withColumn("following", following).alias("e"), onward.alias("o")
    both = rows.join(ends, [F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*keys, "slice")])
    until = F.coalesce("following", "onward", F.lit(END).cast("timestamp"))
    return both.filter("listed").select("e.list", "e.action", "e.pattern", F.col("at").alias("since"), until.alias("until"))


def _slice(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / F.lit(86400 * SLICE_DAYS)).cast("int")


def active(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures with the entries that hold at their time: ``row, list, action, pattern``.

    ``captures(row, url, at)``.
    """
    low, high = map(F.lit, captures.agg(F.min("at").cast("timestamp_ltz"), F.max("at").cast("timestamp_ltz")).first())
    low, high = low.cast("timestamp"), high.cast("timestamp")
    valid = intervals(entries).filter((F.col("since") <= high) & (F.col("until") > low))
    first, last = _slice(F.greatest("since", low)), _slice(F.least("until", high))
    sliced = valid.withColumn("slice", F.explode(F.sequence(first, last))).withColumn("key", pattern_key(F.col("pattern")))
    keyed = pattern_keys(captures.select("row", "url", "at")).withColumn("slice", _slice(F.col("at")))
    met = keyed.join(sliced, ["key", "slice"]).filter("since <= at and at < until").select("row", "list", "action", "pattern")
    # Keys are hashes: texts decide.
    return met.join(captures.select("row", "url"), "row").filter(covers(F.col("pattern"), F.col("url"))).select("row", "list", "action", "pattern")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "at") -> DataFrame:
    """``id, url, at, n_active, block_pattern, allow_pattern, blocked`` for every capture."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).cast("timestamp").alias("at")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "captures")

    def longest(action: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.struct(F.length("pattern").alias("n"), "pattern")))

    found = active(rows, entries).groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), longest("block").alias("b"), longest("allow").alias("a"))
    judged = rows.join(found, "row", "left")
    blocked = F.col("b").isNotNull() & F.coalesce(F.col("b.n") > F.col("a.n"), F.lit(True))
    return judged.select("id", "url", "at", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("b.pattern").alias("block_pattern"), F.col("a.pattern").alias("allow_pattern"), blocked.alias("blocked"))
