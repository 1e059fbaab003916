"""Secret scan: fixed patterns, and a sliding Shannon entropy over candidate strings.

Candidate strings are runs of key characters.  A window of ``WINDOW`` characters moves along each; the counts of its
characters (one character of a string each) change by one where a character leaves and by one where one enters, and with
them the sum of ``c * log2(c)``, kept in millionths so that the comparison is exact.
A candidate's class (hex digits only, or any key characters) sets the entropy it must reach; the
span found runs from the first window that reaches it to the end of the last.  Candidates that fit the
allow list are suppressed; pattern spans never are.

Every step costs the same however long a candidate or text is, and running totals over hits are taken in
blocks of ``BLOCK``, so work grows in proportion to the text.

Positions are code points, ends exclusive.  Defined cases: null or empty text has no spans; equal rows give
equal results; other columns are ignored; matches that touch or overlap are kept apart per
kind and merged only by ``redact``, which leaves null texts null.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _either(word: str) -> str:
    """A pattern for a word in ASCII letters of either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The patterns, their order and the least lengths.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % WINDOW
#: Bits per character that a window must reach, by class.
LEAST_BITS = {"hex": 2.9, "key": 3.9}
#: Candidates that are no secrets: plain words, plain numbers, identifiers of the UUID form, keys marked as examples.
ALLOW = ["^[A-Za-z_/+-]+$", "^[0-9_/+-]+$", "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "EXAMPLE"]
MILLION = 1_000_000
CLOGC = [0] + [round(c * math.log2(c) * MILLION) for c in range(1, WINDOW + 1)]


def _most(bits: float) -> int:
    """The largest sum of c*log2(c) at which a window still has ``bits`` per character."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * MILLION)


#: Elements over which a running value is taken at once; appending to longer arrays would cost their square.
BLOCK = 256


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs there (lambdas would work it out at every step)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine, start: Column) -> Column:
    """For an array of numbers, what ``combine`` makes of all values before each one, from ``start`` on."""

    def inner(block):
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def outer(a, x):
        return F.struct(combine(a["at"], x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda y: combine(a["at"], y)))).alias("out"))

    def over(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: inner(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        zero = F.struct(start.alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.when(F.size(v) > 0, F.aggregate(blocks, zero, outer, lambda a: F.flatten(a["out"]))).otherwise(F.array().cast("array<int>"))

    return bind(values, over)


def _sum_before(values: Column) -> Column:
    return running(values, lambda a, x: (a + x).cast("int"), F.lit(0))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, k, end, octet, hit>>``; ``octet``: the start in bytes."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,octet:int,hit:string>>)")

    def spans(of):
        # Where each gap starts: hits are ASCII, so they take as many bytes as characters.
        points = _sum_before(F.transform(of, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        octets = _sum_before(F.transform(of, lambda x: F.octet_length(x["gap"]) + F.length(x["hit"])))
        return bind(points, lambda p: bind(octets, lambda o: F.transform(of, lambda x, i: span(x, F.get(p, i) + F.length(x["gap"]), F.get(o, i) + F.octet_length(x["gap"])))))

    def span(x, start, octet):
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (start + F.length(x["hit"])).alias("end"), octet.alias("octet"), x["hit"].alias("hit"))

    return F.when(F.rlike(text, F.lit(pattern)), bind(pairs, spans)).otherwise(none)


#: Key characters lie between these two.  The counts of a window are a string with one character each, ``ZERO`` and up.
FIRST_KEY, LAST_KEY, ZERO = ord("+"), ord("z"), ord("@")


def _entropy_reach(c: Column, most: Column) -> Column:
    """``struct(first, last)``: first start and last end of the windows whose sum stays within ``most``; first -1 if none."""
    gain = F.array(*[F.lit(b - a).cast("long") for a, b in zip(CLOGC, CLOGC[1:], strict=False)])  # of the sum as a count grows by one

    def held(counts, cell):
        return F.ascii(F.substring(counts, cell, F.lit(1)))

    def changed(counts, cell, by):
        return F.overlay(counts, F.char(held(counts, cell) + by), cell, F.lit(1))

    def step(cells, most, acc, i):
        new, old = F.get(cells, i - 1), F.get(cells, i - 1 - WINDOW)  # null before the window is full
        kept = F.when(i > WINDOW, changed(acc["n"], old, -1)).otherwise(acc["n"])
        lost = F.when(i > WINDOW, F.get(gain, held(acc["n"], old) - (ZERO + 1))).otherwise(F.lit(0).cast("long"))
        # Where the same character enters, its count is one less without the one that left.
        s = acc["s"] - lost + F.get(gain, held(acc["n"], new) - ZERO - F.when(old == new, 1).otherwise(0))
        return F.struct(s.alias("s"), changed(kept, new, 1).alias("n"), *reached(acc, i - 1, most))

    def reached(acc, end, most):
        """The first start and last end, with the window that ends at ``end`` (``acc`` holds its sum)."""
        ok = (end >= WINDOW) & (acc["s"] <= most)
        return F.when(ok & (acc["first"] < 0), end - WINDOW).otherwise(acc["first"]).alias("first"), F.when(ok, end).otherwise(acc["last"]).alias("last")

    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(chr(ZERO) * (LAST_KEY - FIRST_KEY + 1)).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    places = F.sequence(F.lit(1), F.length(c))
    # One byte a character, each reached at once; the bytes become numbers from 1 before the window moves.
    cells = bind(c.cast("binary"), lambda data: F.transform(places, lambda i: F.ascii(F.substring(data, i, F.lit(1)).cast("string")) - F.lit(FIRST_KEY - 1)))
    moved = bind(most, lambda m: bind(cells, lambda x: F.aggregate(places, zero, lambda acc, i: step(x, m, acc, i), lambda acc: F.struct(*reached(acc, F.size(x), m)))))
    return moved


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in the candidate strings that no allow-list pattern fits."""
    found = matches(text, CANDIDATE, "entropy")
    allowed = "|".join(ALLOW)
    found = F.filter(found, lambda x: ~F.rlike(x["hit"], F.lit(allowed)))

    def reach(x):
        most = F.when(F.rlike(x["hit"], F.lit("^[0-9a-fA-F]+$")), F.lit(_most(LEAST_BITS["hex"]))).otherwise(F.lit(_most(LEAST_BITS["key"])))
        r = _entropy_reach(x["hit"], most.cast("long"))
        return F.struct(x.alias("base"), r.alias("r"))

    reached = F.filter(F.transform(found, reach), lambda x: x["r"]["first"] >= 0)
    at = lambda x, k: (x["base"][k] + x["r"]["first"]).alias(k)
    return F.transform(reached, lambda x: F.struct(at(x, "start"), F.lit(KINDS.index("entropy")).alias("k"), (x["base"]["start"] + x["r"]["last"]).alias("end"), at(x, "octet")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_assign``, ``_access``, ``_hex``, ``_entropy``: arrays of ``struct<start, k, end, octet>``."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = lambda a: F.transform(a, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "k", "end", "octet")]))
    long_enough = F.filter(matches(body, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8)
    return docs.withColumns({"_assign": bare(long_enough), "_access": bare(matches(body, ACCESS, "access")), "_hex": bare(matches(body, HEX, "hex")), "_entropy": entropy_spans(body)})


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the digest of the pattern spans and all spans of every row."""
    rows = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    base = F.concat("_assign", "_access", "_hex")
    return rows.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, "_entropy")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace every span found in ``text``, overlapping ones together, by ``mark``; other columns stay."""
    size = F.octet_length(F.col(text))
    # Spans are ASCII: in bytes they start at ``octet`` and are as long as in characters.  The text's end is one more.
    bounds = F.transform(F.concat("_assign", "_access", "_hex", "_entropy"), lambda x: F.struct(x["octet"].alias("a"), (x["octet"] + x["end"] - x["start"]).alias("b")))
    spans = F.array_sort(F.concat(bounds, F.array(F.struct(size.alias("a"), size.alias("b")))))

    def pieces(of):
        """What stands between the end of all spans before and the start of one that does not overlap them."""
        reach = running(F.transform(of, lambda x: x["b"]), lambda a, x: F.greatest(a, x), F.lit(0))
        return bind(reach, lambda r: F.filter(F.transform(of, lambda x, i: F.struct(F.get(r, i).alias("a"), x["a"].alias("b"))), lambda p: p["a"] <= p["b"]))

    def clean(data):
        return F.array_join(F.transform(bind(spans, pieces), lambda p: F.substring(data, p["a"] + 1, p["b"] - p["a"]).cast("string")), mark)

    found = F.size(F.concat("_assign", "_access", "_hex", "_entropy")) > 0
    out = F.when(found, bind(F.col(text).cast("binary"), clean)).otherwise(F.col(text))
    return scan(docs, text).withColumn(text, out).drop("_assign", "_access", "_hex", "_entropy")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(common.table(spark, sf_dir, "documents"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_spans(pattern: str, kind: str, group: str = "hit") -> str:
    p = _q(pattern)
    return f"""list_transform(generate_series(1, len(regexp_extract_all(t, {p}))),
        lambda i: {{'s': list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0)::BIGINT,
               'hit': regexp_extract_all(t, {p})[i], 'k': {KINDS.index(kind)}}})"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, {_sql_spans(ASSIGN, 'assign')} AS a, {_sql_spans(ACCESS, 'access')} AS c, {_sql_spans(HEX, 'hex')} AS h, {_sql_spans(CANDIDATE, 'entropy')} AS e FROM d),
kept AS (SELECT doc_id, list_filter(a, lambda x: length(regexp_extract(x.hit, {_q(ASSIGN)}, 2)) >= 8) AS a, c, h,
    list_filter(e, lambda x: {' AND '.join(f"NOT regexp_matches(x.hit, {_q(p)})" for p in ALLOW)}) AS e FROM raw),
win AS (SELECT doc_id, a, c, h, list_transform(e, lambda x: {{'s': x.s, 'w': list_filter(generate_series(1, length(x.hit) - {WINDOW - 1}), lambda i:
    list_sum(list_transform(map_values(list_aggregate(string_split(substr(x.hit, i, {WINDOW}), ''), 'histogram')), lambda n: ({CLOGC})[(n + 1)::BIGINT]))
    <= CASE WHEN regexp_full_match(x.hit, '[0-9a-fA-F]+') THEN {_most(LEAST_BITS['hex'])} ELSE {_most(LEAST_BITS['key'])} END)}}) AS e FROM kept),
spans AS (SELECT doc_id, a, c, h, list_transform(list_concat(a, list_concat(c, h)), lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(x.hit)}}) AS base,
    list_transform(list_filter(e, lambda x: len(x.w) > 0), lambda x: {{'s': x.s + x.w[1] - 1, 'k': 3, 'e': x.s + x.w[len(x.w)] - 1 + {WINDOW}}}) AS more FROM win)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(c)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
    sha256(array_to_string(list_transform(list_sort(base), lambda x: ({list(KINDS)})[x.k + 1] || ':' || x.s || ':' || x.e), ',')) AS base_sha256,
    array_to_string(list_transform(list_sort(list_concat(base, more)), lambda x: ({list(KINDS)})[x.k + 1] || ':' || x.s || ':' || x.e), ',') AS spans FROM spans
"""
