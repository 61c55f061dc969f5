"""Operator 3, secret scan: patterns of known secrets, and sliding-window entropy. DataFrame functions only.

The base kinds are found by pattern. The method adds spans of high Shannon entropy: candidate strings of
one character class are scanned with a window of fixed length; the counts of its characters are carried
from position to position (one comes in, one goes out) in a few packed numbers, and so is the sum of
c*log2(c), in whole units of 2**-32 and so without drift: each step costs the same whatever the window's or the
candidate's length. Entropy is log2(w) - sum/w. A candidate that an allow-list pattern matches gives no span.

Positions come from the pieces between the matches (split) and the matches themselves
(regexp_extract_all), as running sums of their lengths in code points, which are made by doubling: n log n steps for n matches.

Edge cases: a null text counts as empty and gives zeros, the digest of "" and an empty list. Repeated rows
are each returned. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: kind, pattern, the group whose length counts, its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),  # a run of 24 or more is matched from its start, so shorter ones needn't be listed
)
#: Character classes of the method: kind, its characters, least entropy in bits of a window of 20.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", 2.9),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
)
#: Candidates that are no secrets: without any digit or without any letter, UUIDs, marked examples, one period repeated.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)example|placeholder|changeme|your[_-]",
    r"^(.{1,4})\1+$",
)


def _once(value: Column, use) -> Column:
    """``use`` of a name for value: an expression that is mentioned in a lambda is evaluated for each element, a name is not."""
    return F.transform(F.array(value), use)[0]


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _sums(sizes: Column) -> Column:
    """The running sums of an array of integers: in round k each adds the one 2**k before it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + 1.0)).cast("int"))
    return F.aggregate(rounds, sizes, lambda a, k: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - _shift(F.lit(1), k)), F.lit(0))))


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Array of (start, order, end, kind, value) of the leftmost non-overlapping matches whose group is long enough."""
    found, pieces, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"), values.alias("v"))

    def spans(z: Column) -> Column:
        ends = _sums(F.transform(z, lambda x: F.coalesce(F.length(x["p"]) + F.length(x["m"]), F.lit(0))))

        def span(x: Column, end: Column) -> Column:
            return F.struct((end - F.length(x["m"])).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))

        return _once(ends, lambda e: F.filter(F.transform(z, lambda x, i: span(x, F.get(e, i))), lambda x: F.length(x["value"]) >= least))

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), _once(each, spans)).otherwise(none)


def _windows(value: Column, alphabet: str, least: float, w: int) -> Column:
    """(first start, last end) within value of the windows of w characters whose entropy is at least ``least``."""
    bits = w.bit_length()
    per = 62 // bits  # counts in a number
    table = F.array(*(F.lit(round(c * math.log2(c) * 2**32) if c else 0).cast("long") for c in range(w + 1)))
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    place = lambda c, name: [F.floor(c / per).cast("int").alias(f"{name}_at"), ((c % per) * bits).cast("int").alias(f"{name}_by")]
    # each code with the one that leaves the window when it comes in (null: none yet)
    pairs = lambda cs: F.transform(cs, lambda c, i: F.struct(*place(c, "new"), *place(F.get(cs, i - w), "old")))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // per)).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    one, zero_long = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(a: Column, x: Column) -> Column:
        full = x["old_at"].isNotNull()
        moved = ~full | (x["new_at"] != x["old_at"]) | (x["new_by"] != x["old_by"])
        count = lambda at, by: F.call_function("shiftright", F.get(a["counts"], at), by).bitwiseAND((1 << bits) - 1).cast("int")
        log = lambda c: F.get(table, c)
        come, go = count(x["new_at"], x["new_by"]), count(x["old_at"], x["old_by"])
        s = a["s"] + F.when(moved, log(come + 1) - log(come) + F.when(full, log(go - 1) - log(go)).otherwise(zero_long)).otherwise(zero_long)
        plus = lambda i: F.when(i == x["new_at"], _shift(one, x["new_by"])).otherwise(zero_long)
        minus = lambda i: F.when(i == x["old_at"], _shift(one, x["old_by"])).otherwise(zero_long)
        counts = F.transform(a["counts"], lambda c, i: c + plus(i) - minus(i))
        n = a["n"] + 1
        good = (n >= w) & (F.lit(math.log2(w)) - s / float(2**32 * w) >= least - 1e-9)
        return F.struct(counts.alias("counts"), s.alias("s"), n.alias("n"), F.when(good & (a["lo"] < 0), n - w).otherwise(a["lo"]).alias("lo"), F.when(good, n).otherwise(a["hi"]).alias("hi"))

    return _once(codes, lambda cs: F.aggregate(pairs(cs), zero, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))


def scan(docs: DataFrame, window: int = 20, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, base (array of spans by start, then kind) and added (array of the method's spans) of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumns({f"b{i}": _spans(F.col("text"), p, g, n, k, i) for i, (k, p, g, n) in enumerate(BASE)})
    rows = rows.withColumns({f"c{i}": _spans(F.col("text"), "([" + chars.replace("-", "") + "-]{%d,})" % window if "-" in chars else "([" + chars + "]{%d,})" % window, 1, window, k, len(BASE) + i) for i, (k, chars, _) in enumerate(CLASSES)})

    def judged(i: int, chars: str, least: float) -> Column:
        kept = F.filter(F.col(f"c{i}"), lambda x: ~_any(x["value"], allow))
        marked = F.transform(kept, lambda x: F.struct(x.alias("x"), _windows(x["value"], chars, least, window).alias("w")))
        return F.transform(F.filter(marked, lambda m: m["w"]["lo"] >= 0), lambda m: F.struct((m["x"]["start"] + m["w"]["lo"]).alias("start"), m["x"]["order"].alias("order"), (m["x"]["start"] + m["w"]["hi"]).alias("end"), m["x"]["kind"].alias("kind"), m["x"]["value"].alias("value")))

    return rows.select(
        "doc_id", F.sort_array(F.concat(*(f"b{i}" for i in range(len(BASE))))).alias("base"),
        F.sort_array(F.concat(*(judged(i, chars, least) for i, (_, chars, least) in enumerate(CLASSES)))).alias("added"))


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``scan`` returns."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def sql(window: int = 20) -> str:
    """The same result in DuckDB's SQL; each window's entropy is computed anew from the counts of its characters."""
    def spans(name: str, kind: str, order: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""{name}0 AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS gap FROM d WHERE regexp_matches(text, '{p}')),
{name}1 AS (SELECT doc_id, unnest(m) AS m, unnest(v) AS v, unnest(gap[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM {name}0),
{name} AS (SELECT doc_id, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS s, {order} AS o, '{kind}' AS kind, length(m) AS len, v FROM {name}1 QUALIFY length(v) >= {least})"""

    parts = [spans(f"b{i}", k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)]
    allow = " AND ".join(f"NOT regexp_matches(v, '{a}')" for a in ALLOW if "\\1" not in a)
    periods = " AND ".join(f"v <> left(repeat(left(v, {k}), length(v)), length(v))" for k in (1, 2, 3, 4))
    added = []
    for i, (k, chars, least) in enumerate(CLASSES):
        cls = chars.replace("-", "") + ("-" if "-" in chars else "")
        parts.append(spans(f"c{i}", k, len(BASE) + i, "([" + cls + "]{%d,})" % window, 1, window))
        parts.append(f"""w{i} AS (SELECT doc_id, s, o, kind, v, unnest(range(0, length(v) - {window} + 1)) AS k FROM c{i} WHERE {allow} AND ({periods})),
e{i} AS (SELECT doc_id, s, o, kind, k, log2({window}.0) - sum(n * log2(n)) / {window}.0 AS h FROM (SELECT doc_id, s, o, kind, k, ch, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, s, o, kind, k, unnest(string_split(substr(v, CAST(k + 1 AS BIGINT), {window}), '')) AS ch FROM w{i}) GROUP BY ALL) GROUP BY doc_id, s, o, kind, k),
a{i} AS (SELECT doc_id, s + min(k) AS s, o, kind, CAST(max(k) - min(k) + {window} AS BIGINT) AS len FROM e{i} WHERE h >= {least} - 1e-9 GROUP BY doc_id, e{i}.s, o, kind)""")
        added.append(f"SELECT doc_id, s, o, kind, len FROM a{i}")
    base = " UNION ALL ".join(f"SELECT doc_id, s, o, kind, len FROM b{i}" for i in range(len(BASE)))
    said = "string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, o)"
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k, *_ in BASE)
    sums = ", ".join(f"count_if(kind = '{k}') AS n_{k}" for k, *_ in BASE)
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n" + ",\n".join(parts) + f""",
base AS ({base}), every AS (SELECT * FROM base UNION ALL {" UNION ALL ".join(added)}),
x AS (SELECT doc_id, {sums}, {said} AS b FROM base GROUP BY doc_id), y AS (SELECT doc_id, {said} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""
