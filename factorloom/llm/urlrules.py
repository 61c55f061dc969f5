"""Operator 12, url rules: a sort-merge range join of urls with nested rules of hosts and paths.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's; the longest fitting rule (host and path together, then host) decides, and ``default`` where none fits.

The canonical key is the host with its labels reversed, a "/" (which no host holds), and the path. A rule's prefix is so
the interval from its key to its key with byte 255 behind it, which is in no UTF-8. As paths count as well, the rules of
a host and those of its parents are no nested intervals at one place of this order, so a url stands at the key of each
of its host's ancestors; those that surely have no rule (a bitmap of fixed size tells) are left out before any shuffle.

Rules and keys are put into one stream, dealt by range of (key, hash of the row) and sorted, so the rows of a hot host
or url spread over many tasks. Each task sweeps its rows in order with a stack of the rules that are open: those that
end are popped, a rule is pushed, a url's answer is the top. What is open where a task's range begins is carried over
from the ranges before it: one pass over the sorted rows, which are kept in the shared folder, gives each range's first
key and the nested rules still open at its end. Only these come to the driver: a row a range, and at most as many rules
a range as nest over one key. A task holds one batch of rows and the stack, however many rules there are.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end.

Edge cases: a null url, or one without "://", has an empty host and path, which no rule fits. An empty path is no "/".
Rules without a host or path are left out; of equal rules "block" stays. Repeated rows are each returned; null page ids
are ids like others. Empty tables (of urls or rules) give no rows, or the default. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, maybe_among

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The verdict where no rule fits.
DEFAULT = "allow"
PARTS = r"://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _ruled(rules: DataFrame) -> DataFrame:
    """rev, labels, key, rule, size, verdict: a row for each distinct rule."""
    clean = rules.select(lower_ascii(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    one = clean.filter("h != '' and p != '' and v is not null").groupBy("h", "p").agg(F.max("v").alias("verdict"))  # "block" > "allow"
    labels = F.split("h", r"\.")
    return one.select(
        _reversed(labels).alias("rev"), F.size(labels).alias("labels"), F.concat_ws("/", _reversed(labels), "p").cast("binary").alias("key"),
        F.concat("h", "p").alias("rule"), F.length("h").alias("size"), "verdict")


def _sweep(rows: Iterator[pa.RecordBatch], stack: list[tuple[bytes, int]], seen) -> None:
    """Calls seen(batch, places of urls, tops) for each batch; stack holds (key of an open rule, what it stands for)."""
    for b in rows:
        keys, rules = b.column("key").to_pylist(), b.column("rule").to_pylist()
        at, tops = [], []
        for i, (k, r) in enumerate(zip(keys, rules, strict=True)):
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if r is not None:
                stack.append((k, (r, b.column("size")[i].as_py(), b.column("verdict")[i].as_py())))
            elif stack:
                at.append(i)
                tops.append(stack[-1][1])
        seen(b, at, tops)


def _carried(stream: DataFrame) -> dict[int, list]:
    """For each range (by its number) the rules that are open where it begins."""

    def ends(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, first = [], []

        def seen(b, at, tops):
            if not first and b.num_rows:
                first.append({c: b.column(c)[0].as_py() for c in ("range", "key")})

        _sweep(rows, stack, seen)
        if first:
            opened = [{"key": k, "rule": r, "size": n, "verdict": v} for k, (r, n, v) in stack]
            yield pa.RecordBatch.from_pylist([{"range": first[0]["range"], "first": first[0]["key"], "open": opened}], schema=pa.schema([("range", pa.int32()), ("first", pa.binary()), ("open", pa.list_(pa.struct([("key", pa.binary()), ("rule", pa.string()), ("size", pa.int32()), ("verdict", pa.string())])))]))

    found = stream.select("range", "key", "rule", "size", "verdict").mapInArrow(ends, "range int, first binary, open array<struct<key:binary,rule:string,size:int,verdict:string>>")
    out, stack = {}, []
    for r in sorted(found.collect(), key=lambda r: r["range"]):
        while stack and not bytes(r["first"]).startswith(stack[-1][0]):
            stack.pop()
        out[r["range"]] = list(stack)
        own = [(bytes(x["key"]), (x["rule"], x["size"], x["verdict"])) for x in r["open"]]
        # what the range's own open rules lie in is still open; the rest has ended within the range
        last = own[-1][0] if own else None
        stack = [s for s in stack if last is None or last.startswith(s[0])] + own
    return out


def _fits(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, size, verdict: for each row of keyed (with key) the longest rule that its key starts with, if any."""
    shared = F.xxhash64("page_id", F.spark_partition_id())
    urls = keyed.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("verdict"), "page_id", "host", "path", F.lit(1).alias("side"), shared.alias("deal"))
    own = rules.select("key", "rule", "size", "verdict", F.lit(0).alias("side"), F.lit(0).cast("long").alias("deal"))
    order = ("key", "side", "deal")
    # with the lineage cut here, both passes see the same ranges, and lost executors don't lose them
    stream = checkpoint(urls.unionByName(own, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order).drop("side", "deal").withColumn("range", F.spark_partition_id()))
    open_at = _carried(stream)

    def answers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for b in rows:
            if stack is None and b.num_rows:
                stack = list(open_at[b.column("range")[0].as_py()])
            out: list[pa.RecordBatch] = []

            def seen(b, at, tops, out=out):
                hit = b.select(["page_id", "host", "path"]).take(pa.array(at, pa.int64()))
                named = [pa.array([t[k] for t in tops], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
                out.append(pa.RecordBatch.from_arrays([*hit.columns, *named], ["page_id", "host", "path", "rule", "size", "verdict"]))

            if b.num_rows:
                _sweep(iter([b]), stack, seen)
            yield from out

    return stream.mapInArrow(answers, f"page_id {keyed.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, size int, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host and path of the one that decided, or null), verdict of each row of pages (page_id, url)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", lower_ascii(F.regexp_extract(url, PARTS, 1)).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))
    ruled = _ruled(rules)
    deepest = ruled.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]  # one number
    labels = F.reverse(F.split("host", r"\."))
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda k: F.array_join(F.slice(labels, 1, k), "."))
    each = maybe_among(rows.filter("host != ''").withColumn("rev", F.explode(above)), "rev", ruled.select("rev").distinct()).filter("maybe")
    found = _fits(each.select("page_id", "host", "path", F.concat_ws("/", "rev", "path").cast("binary").alias("key")), ruled)
    # equal rows become one with a count; most ids are different, so this deals evenly
    none = rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("verdict"), F.lit(1).cast("long").alias("copies"))
    both = none.unionByName(found.withColumn("copies", F.lit(0).cast("long")))
    longest = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "size", "rule", "verdict")))
    one = both.groupBy("page_id", "host", "path").agg(longest.alias("best"), F.sum("copies").alias("copies"))
    out = one.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), "copies")
    # in two steps, so that no array is long
    steps = lambda n, size: F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size))
    thousands = out.withColumn("k", F.explode(steps(F.col("copies"), 1000)))
    again = thousands.withColumn("j", F.explode(steps(F.least(F.col("copies") - F.col("k") * 1000, F.lit(1000)), 1)))
    return again.select("page_id", "host", "path", "rule", "verdict")


def sql(rules=RULES, default: str = DEFAULT) -> str:
    """The same result in DuckDB's SQL, each url against each rule."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    lower = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH r(h, p, v) AS (VALUES {listed}),
u AS (SELECT row_number() OVER () AS i, page_id, {lower} AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT i, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM u LEFT JOIN f USING (i)"""
