"""Secret scans: candidates by pattern, told apart by who owns them across the corpus. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.scale import checkpointed, is_small

#: A candidate that this many owners hold is a widely copied example.
EXAMPLE_OWNERS = 3
REDACTED = "[secret]"


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches of at least ``least`` characters (of the value) are candidates; ``value`` is the
    pattern of the value at the end of a match."""

    name: str
    pattern: str
    least: int
    value: str


# fixed values: the base patterns
BASE = (
    Kind("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"[A-Za-z0-9+/_.=-]+$"),
    # runs are matched whole, so that a bound on their length only leaves out those that fail it
    Kind("access", r"AKIA[A-Z0-9]{16,}", 20, r".+$"),
    Kind("hex", r"[0-9a-f]{24,}", 24, r".+$"),
)
#: Added by the method: long values that mix letters and digits, where a single owner holds them or the same
#: value is an owner's live candidate elsewhere.
LOOSE = Kind("owned", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}", 20, r".+$")
#: What a text must hold to be looked at closely; a match of any kind holds one of these.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20}"
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,live:boolean>"


def _key(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Rows by which equal documents share one result: id, owner, repository and a digest of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc"),
        F.coalesce(docs[owner].cast("string"), F.lit("")).alias("owner"),
        F.coalesce(docs[repository].cast("string"), F.lit("")).alias("repository"),
        F.xxhash64(text, F.length(text)).alias("digest"),
        text.alias("text"),
    )


KEY = ["doc", "owner", "repository", "digest"]


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """One struct for each match: (kind, its place among the matches, characters before it since the last
    match, the match). What stands between matches comes from splitting at them."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    pairs = F.slice(F.arrays_zip(found.alias("match"), between.alias("gap")), F.lit(1), F.size(found))
    return F.transform(
        pairs,
        lambda x, i: F.struct(F.lit(number).alias("k"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), x["match"].alias("match")),
    )


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc, owner, repository, digest, kind, start, end, value) for each candidate of each distinct document:
    leftmost matches that do not overlap, per kind, too short ones dropped. Positions count code points from 0,
    ``end`` is exclusive. Texts without a candidate's hint are passed over in the scan."""
    kinds = (*BASE, LOOSE)
    keyed = _key(docs, owner, repository).where(F.col("text").rlike(HINT))
    rows = keyed.select(*KEY, F.array(*[_matches(F.col("text"), n, kind) for n, kind in enumerate(kinds)]).alias("all"))
    rows = rows.select(*KEY, F.explode(F.flatten("all")).alias("m")).select(*KEY, "m.*").distinct()
    before = W.partitionBy(*KEY, "k").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    name, value, least = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for n, kind in enumerate(kinds):
        here = F.col("k") == n
        name = F.when(here, F.lit(kind.name)).otherwise(name)
        value = F.when(here, F.regexp_extract("match", f"({kind.value})", 1)).otherwise(value)
        least = F.when(here, F.lit(kind.least)).otherwise(least)
    rows = rows.select(*KEY, "k", name.alias("kind"), "start", "end", _value(rows, value), least.alias("least"))
    mixes = F.col("value").rlike("[A-Za-z]")
    return rows.where((F.length("value") >= F.col("least")) & ((F.col("kind") != LOOSE.name) | mixes)).drop("least")


def _value(rows: DataFrame, value: Column) -> Column:
    """The secret itself. An assignment's value begins after the keyword and its sign."""
    assigned = F.regexp_extract("match", r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$""", 1)
    return F.when(rows["k"] == 0, assigned).otherwise(value).alias("value")


def ownership(found: DataFrame) -> DataFrame:
    """(value, base, owners, repositories): how many distinct owners and repositories hold each value, whatever
    its kind, and whether a base pattern found it. Counted in steps, each combined before its shuffle, so a
    value copied everywhere is never gathered."""
    held = found.groupBy("value", "owner", "repository").agg(F.max((F.col("kind") != LOOSE.name).cast("int")).alias("base"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max("base").alias("base"))
    return by_owner.groupBy("value").agg(F.max("base").alias("base"), F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc, owner, repository, digest, spans) for each distinct document with a span: an array of (kind,
    start, end, value, live) by start and kind.

    Base spans are all kept. ``live`` tells values that fewer than ``example_owners`` owners hold from widely
    copied examples. The method adds spans of kind ``owned``: a long mixed value that no base span covers and
    that is live, if a single owner holds it or a base span has it elsewhere.
    """
    found = checkpointed(candidates(docs, owner, repository))
    owners = checkpointed(ownership(found))
    rows = found.join(F.broadcast(owners) if is_small(owners) else owners, "value")
    live = F.col("owners") < example_owners
    rows = rows.withColumn("live", live)
    base, loose = rows.where(F.col("kind") != LOOSE.name), rows.where(F.col("kind") == LOOSE.name)
    loose = loose.where(F.col("live") & ((F.col("owners") == 1) | (F.col("base") == 1)))
    one = F.struct("start", "k", "kind", "end", "value", "live")
    spans = base.union(loose).groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("s"))
    covered = lambda x, all_: F.exists(all_, lambda y: (y["kind"] != LOOSE.name) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
    kept = F.filter("s", lambda x: (x["kind"] != LOOSE.name) | ~covered(x, F.col("s")))
    order = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["live"].alias("live")))
    return spans.select(*KEY, order.alias("spans")).where(F.size("spans") > 0)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def spans_of(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row (doc_id, spans) for each document, repeated rows included; an empty array without a span. Null
    texts are empty; null owners and repositories count as one that is called by the empty string."""
    found = checkpointed(scan(docs, owner, repository))
    rows = _key(docs, owner, repository).drop("text")
    small = F.broadcast(found) if is_small(found) else found
    same = [rows["doc"].eqNullSafe(small["doc"])] + [rows[c] == small[c] for c in KEY[1:]]
    joined = rows.join(small, same, "left")
    return joined.select(rows["doc"].alias("doc_id"), F.coalesce(small["spans"], F.array().cast(f"array<{SPAN}>")).alias("spans"))


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = REDACTED) -> DataFrame:
    """The documents with every live span of their texts replaced by ``mask``; examples stay, so does each
    document. ``n_chars`` follows the text if there is such a column. Only texts with a hint meet the spans."""
    found = scan(docs, owner, repository)
    live = F.filter("spans", lambda x: x["live"])
    found = checkpointed(found.select(*KEY, live.alias("spans")).where(F.size("spans") > 0))
    hinted = F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(HINT)
    near = docs.where(hinted)
    row = near.select(F.struct(*[near[c] for c in near.columns]).alias("__row"), near["doc_id"], near[owner].alias("__owner"), near[repository].alias("__repo"), near["text"])
    keyed = row.select(
        "__row", F.col("doc_id").alias("doc"), F.coalesce(F.col("__owner").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col("__repo").cast("string"), F.lit("")).alias("repository"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest"),
    )
    small = F.broadcast(found) if is_small(found) else found
    same = [keyed["doc"].eqNullSafe(small["doc"])] + [keyed[c] == small[c] for c in KEY[1:]]
    joined = keyed.join(small, same, "left").select("__row", small["spans"].alias("__spans"))
    text = F.when(F.col("__spans").isNull(), F.col("__row.text")).otherwise(_masked(F.col("__row.text"), F.col("__spans"), mask))
    joined = joined.withColumn("__text", text)
    out = []
    for c in docs.columns:
        column = F.col(f"__row.`{c}`")
        if c == "text":
            column = F.col("__text")
        elif c == "n_chars":
            column = F.when(F.col("__spans").isNull(), column).otherwise(F.length("__text")).cast(docs.schema[c].dataType)
        out.append(column.alias(c))
    return joined.select(*out).union(docs.where(~hinted))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the union of the spans (sorted by start) replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"])
        return F.struct(kept.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2147483647)))
