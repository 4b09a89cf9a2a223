"""Operator 6: secrets, by fixed patterns and by a battery of randomness tests.

Base spans: see ``PATTERNS``. The method adds spans of kind ``random``: runs of 20 or more
characters of one of the alphabets that encoders use (with + and /, or with - and _), with
their padding; an = before more characters parts a name from its value, and each is a run.
Of reported runs one within another is left out.

For a run the encoding is inferred (``ENCODINGS``), and in its alphabet three statistics are taken:
chi-squared of the characters' counts, the number of runs of character classes (low and high digits,
vowels and consonants, or lower case, upper case, digits and others), and the serial correlation of
neighbouring codes. They are used twice. A run that the battery tells from a random one
(Bonferroni over the three, at ``ALPHA``) is no secret. For the rest the battery asks whether the run
is as ordinary text is, which is the null hypothesis here: concentrated on few characters and
slow (or, for vowels, quick) to change its class, by at least the encoding's margins, or correlated by at
least ``SERIAL``. The first two give one normal score, weighted by how well each separates in this
encoding and length; the larger of its p-value and that of the serial test is the run's p-value.

The Benjamini-Hochberg rule on these p-values, in each stratum of encoding and length, keeps the share of
ordinary runs among the reported ones below ``FDR``; shorter runs have larger p-values, so they
need more of their kind. Its counts cover all documents, in
p-value bins of 1/100 of a decade; at most ``len(ENCODINGS) * (len(LENGTHS) + 1)`` thresholds
come to the driver. The values of base spans of 20 characters or more are tested with the others: base spans stay
whatever the verdict, which is given beside them.

Null or empty text: no spans. Repeated rows: one result each, and each counts in the rates.
Very long texts: matches are placed in blocks, and many spans of one text are swept in order, so the work grows with the text. Empty table: no rows.
Other columns are ignored, whatever their names. Positions are code points. A character that marks matches inside
(U+E000 to U+E002) counts as any other outside the patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.text import whole
from loomdoc.session import cut, spread, table

# fixed values: the kinds in their order; prefix, body, least characters of the part that counts
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "body", 8),
    "access": (r"(AKIA)([A-Z0-9]+)", "all", 16),
    "hex": (r"()([0-9a-f]+)", "all", 32),
}
#: A text with no match of this has no span of the kind, so the work of finding positions is saved.
GUARDS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}
# padding counts among the 20 characters
RANDOM = [(rf"()([{chars}]{{14,}}(?:=+(?![A-Za-z0-9+/_=-]))?)", "all", 20) for chars in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
KINDS = [*PATTERNS, "random"]


@dataclass(frozen=True)
class Encoding:
    """size: of the alphabet; changes: how often neighbours of a random run differ in class.

    The margins of ordinary text: repeat is the chance that two of its characters are equal, triple that
    three are, and ordinary_changes how often its neighbours differ in class.
    """

    pattern: str
    size: int
    changes: float
    repeat: float
    triple: float
    ordinary_changes: float


#: The first that fits is inferred. The margins lie between random runs and prose, counters, identifiers and paths.
ENCODINGS = {
    "decimal": Encoding(r"^[0-9]+$", 10, 0.5, 0.2, 0.06, 0.3),
    "hex": Encoding(r"^([0-9a-f]+|[0-9A-F]+)$", 16, 0.46875, 0.13, 0.025, 0.2),
    "letters": Encoding(r"^([a-z]+|[A-Z]+)$", 26, 0.3107, 0.058, 0.005, 0.5),
    "base32": Encoding(r"^[A-Z2-7]+$", 32, 0.3047, 0.055, 0.0045, 0.12),
    "base36": Encoding(r"^([a-z0-9]+|[A-Z0-9]+)$", 36, 0.4012, 0.055, 0.0045, 0.18),
    "base52": Encoding(r"^[A-Za-z]+$", 52, 0.5, 0.055, 0.0045, 0.32),
    "base64": Encoding(r"^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$", 64, 0.6447, 0.055, 0.0045, 0.38),
}
LENGTHS = (20, 28, 36, 52, 84)
LEAST = 20
ALPHA = 0.001
FDR = 0.01
#: Counters and walks along an alphabet are correlated at least so much.
SERIAL = 0.8
#: Pairs of spans of one text that are compared one by one; texts with more are swept in order.
PAIRS = 100_000
#: Pieces of a text whose places are found together.
BLOCK = 512
_OPEN, _MID, _CLOSE = "\ue000", "\ue001", "\ue002"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, kind: str, pattern: str, counted: str, least: int) -> Column:
    """Array of (start, end, kind, body) of the pattern's matches whose counted part is long enough."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$1{_MID}$2{_CLOSE}")
    item = "struct<start:int,kind:int,end:int,body:string>"

    def step(acc: Column, piece: Column) -> Column:
        prefix = F.length(F.substring_index(piece, _MID, 1))
        body = F.substring_index(F.substring_index(piece, _CLOSE, 1), _MID, -1)
        end = acc["at"] + prefix + F.length(body)
        size = F.length(body) if counted == "body" else prefix + F.length(body)
        found = F.struct(acc["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), body.alias("body"))
        return F.struct(
            (acc["at"] + F.length(piece) - 2).alias("at"), F.when(size >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out")
        )

    def placed(pieces: Column) -> Column:
        # blocks of pieces with the place where each begins: one long array would be copied for each match
        last = F.greatest(F.floor((F.size(pieces) - 2) / BLOCK), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pieces, i * BLOCK + 2, BLOCK))
        length = lambda block: F.aggregate(block, F.lit(0), lambda at, piece: at + F.length(piece) - 2)
        first = F.array(F.length(F.get(pieces, F.lit(0))))
        begins = lambda bs: F.aggregate(bs, first, lambda at, block: F.concat(at, F.array(F.element_at(at, -1) + length(block))))
        start = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{item}>").alias("out"))
        of = lambda bs: F.zip_with(bs, F.slice(begins(bs), 1, F.size(bs)), lambda block, at: F.aggregate(block, start(at), step, lambda acc: acc["out"]))
        return F.flatten(_with(blocks, of))

    found = _with(F.split(marked, _OPEN), placed)
    return F.when(text.rlike(GUARDS[kind]), found).otherwise(F.array().cast(f"array<{item}>"))


def _upper_tail(z: Column) -> Column:
    """About 1 - Phi(z): a logistic with a cubic term, and a continued fraction beyond 2."""
    near = 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565992 * z * z * z))
    far = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) / (z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0))))
    return F.when(z > 2.0, far).otherwise(near)


_CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"


def _classes(s: Column, encoding: Column) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz"
    vowels = F.translate(F.lower(s), letters, "".join("v" if c in "aeiou" else "c" for c in letters))
    other = F.translate(s, _CODES, "0" * 10 + "a" * 26 + "A" * 26 + "____")
    return F.when(encoding == "decimal", F.translate(s, "0123456789", "0000011111")).when(encoding == "letters", vowels).otherwise(other)


def tested(runs: Column) -> Column:
    """The runs (an array of structs with body) with test: struct of stratum, bin (-100 log10 of the p-value under ordinary text) and random; null where no encoding fits or the run is too short.

    Each step is an array of its own, so what it finds is computed once.
    """

    def of(encoding: Column, field: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, e in ENCODINGS.items() for x in (k, float(getattr(e, field)))]), encoding)

    def inferred(r: Column) -> Column:
        s = F.regexp_replace(r["body"], "=+$", "")
        name = F.lit(None).cast("string")
        for encoding, e in reversed(ENCODINGS.items()):
            name = F.when(s.rlike(e.pattern), encoding).otherwise(name)
        return F.struct(r.alias("r"), s.alias("s"), F.when(F.length(r["body"]) >= LEAST, name).alias("e"))

    def counted(x: Column) -> Column:
        s, e = x["s"], x["e"]
        n = F.length(s).cast("double")
        codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(_CODES), c).cast("double"))
        squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
        changes = F.length(F.regexp_replace(_classes(s, e), r"(.)\1*", "x")).cast("double") - 1.0
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        numbers = [n.alias("n"), codes.alias("codes"), squares.alias("squares"), changes.alias("changes"), mean.alias("mean")]
        numbers += [of(e, f).alias(f) for f in ("size", "repeat", "triple", "ordinary_changes")] + [of(e, "changes").alias("random_changes")]
        return F.struct(x["r"].alias("r"), e.alias("e"), F.when(e.isNotNull(), F.struct(*numbers)).alias("x"))

    def correlated(y: Column) -> Column:
        codes, mean = y["x"]["codes"], y["x"]["mean"]
        # the place before is carried along: (sum of products, the last deviation)
        zero = F.struct(F.lit(0.0).alias("lag"), F.lit(0.0).alias("last"), F.lit(0.0).alias("spread"))
        sums = F.aggregate(codes, zero, lambda a, c: F.struct((a["lag"] + a["last"] * (c - mean)).alias("lag"), (c - mean).alias("last"), (a["spread"] + (c - mean) * (c - mean)).alias("spread")))
        return F.struct(y["r"].alias("r"), y["e"].alias("e"), y["x"].alias("x"), sums.alias("sums"))

    def judged(y: Column) -> Column:
        x, sums = y["x"], y["sums"]
        n, a = x["n"], x["size"]
        chi = (a / n * x["squares"] - n - (a - 1.0)) / F.sqrt(2.0 * (a - 1.0) * (n - 1.0) / n)
        share = lambda c: F.sqrt(c * (1.0 - c) / (n - 1.0))
        changed = x["changes"] / (n - 1.0)
        runs = (changed - x["random_changes"]) / share(x["random_changes"])
        r = F.when(sums["spread"] > 0.0, sums["lag"] / sums["spread"]).otherwise(F.lit(1.0))
        least = F.least(_upper_tail(chi), 2.0 * _upper_tail(F.abs(runs)), 2.0 * _upper_tail(F.abs(r) * F.sqrt(n)))
        # scores under ordinary text, and where random runs lie on their scales
        repeat_sd = F.sqrt(4.0 * (x["triple"] - x["repeat"] * x["repeat"]) / n + 2.0 * x["repeat"] / (n * n))
        repeat = (x["repeat"] - (x["squares"] - n) / (n * (n - 1.0))) / repeat_sd
        repeat_apart = (x["repeat"] - 1.0 / a) / repeat_sd
        change = (changed - x["ordinary_changes"]) / share(x["ordinary_changes"])
        change_apart = (x["random_changes"] - x["ordinary_changes"]) / share(x["ordinary_changes"])
        score = (repeat * repeat_apart + change * change_apart) / F.sqrt(repeat_apart * repeat_apart + change_apart * change_apart)
        serial = (math.atanh(SERIAL) - F.atanh(F.least(F.abs(r), F.lit(0.999)))) * F.sqrt(n - 3.0)
        p = _upper_tail(F.least(score, serial))
        stratum = F.concat_ws(":", y["e"], F.lit("0"))
        for length in LENGTHS:
            stratum = F.when(n >= length, F.concat_ws(":", y["e"], F.lit(str(length)))).otherwise(stratum)
        test = F.struct(stratum.alias("stratum"), F.floor(-100.0 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int").alias("bin"), (3.0 * least > ALPHA).alias("random"))
        kept = [y["r"][f].alias(f) for f in ("start", "kind", "end")]
        return F.struct(*kept, F.when(x.isNotNull(), test).alias("test"))

    for step in (inferred, counted, correlated, judged):
        runs = F.transform(runs, step)
    return runs


def thresholds(tests: DataFrame) -> dict[str, int]:
    """The least bin that is reported, of each stratum that reports any: Benjamini-Hochberg on all tests' bins."""
    counts = tests.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("stratum")
    counts = counts.withColumn("m", F.sum("n").over(by)).withColumn("seen", F.sum("n").over(by.orderBy(F.col("bin").desc())))
    passed = counts.filter(F.col("bin") >= -100.0 * F.log10(F.col("seen") / F.col("m") * FDR))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def _is_base(span: Column) -> Column:
    return span["kind"] < len(PATTERNS)


def _numbered(rows: DataFrame, many: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with few pairs of spans, and those with many, with _id. ``rows`` are cut, so that their numbers stay."""
    return rows.filter(~many), cut(rows.filter(many).withColumn("_id", F.monotonically_increasing_id()))


def _apart(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, base, runs) without the runs that overlap a base span.

    Where a text has many of both, they are swept in order of place: a run is free if no base span that begins before its end reaches beyond its start.
    """
    few, many = _numbered(rows, F.size("base").cast("long") * F.size("runs") > PAIRS)
    few = few.withColumn("runs", F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"]))))
    if many.isEmpty():
        return few
    base = many.select("_id", F.explode("base").alias("r")).select("_id", F.col("r.start").alias("at"), F.lit(1).alias("side"), F.col("r.end").alias("reach"), "r")
    runs = many.select("_id", F.explode("runs").alias("r")).select("_id", F.col("r.end").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("reach"), "r")
    before = Window.partitionBy("_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one text's spans
    swept = base.unionByName(runs).withColumn("_most", F.max("reach").over(before)).filter("side = 0 and (_most is null or _most <= r.start)")
    kept = swept.groupBy("_id").agg(F.sort_array(F.collect_list("r")).alias("_runs"))
    swept = many.join(kept, "_id", "left").withColumn("runs", F.coalesce("_runs", F.slice("runs", 1, 0)))
    return few.unionByName(swept.select(*few.columns))


def _outermost(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, found) without the added spans that lie within another one; swept as in ``_apart`` where there are many."""
    added = F.filter("found", lambda r: ~_is_base(r))
    rows = cut(rows.withColumn("_added", added))
    few, many = _numbered(rows, F.size("_added").cast("long") * F.size("_added") > PAIRS)
    wider = lambda o, r: (o["start"] <= r["start"]) & (o["end"] >= r["end"]) & (o["end"] - o["start"] > r["end"] - r["start"])
    few = few.withColumn("found", F.filter("found", lambda r: _is_base(r) | ~F.exists("_added", lambda o: wider(o, r)))).drop("_added")
    if many.isEmpty():
        return few
    spans = many.select("_id", F.explode(F.array_distinct("_added")).alias("r"))
    before = Window.partitionBy("_id").orderBy("r.start", F.desc("r.end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.withColumn("_most", F.max("r.end").over(before)).filter("_most is null or _most < r.end")
    kept = kept.groupBy("_id").agg(F.collect_list("r").alias("_kept"))
    swept = many.join(kept, "_id").withColumn("found", F.concat(F.filter("found", _is_base), "_kept"))
    return few.unionByName(swept.select(*few.columns))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, kind, end, random), in order, of each row of ``docs`` (doc_id, text). random: the battery's verdict."""
    text = F.translate(whole(F.col("text")), _OPEN + _MID + _CLOSE, "???")
    rows = docs.select("doc_id", text.alias("_text"))
    matched = {kind: _matches(F.col("_text"), kind, *spec) for kind, spec in PATTERNS.items()}
    matched["random"] = F.array_distinct(F.concat(*[_matches(F.col("_text"), "random", *spec) for spec in RANDOM]))
    rows = cut(rows.select("doc_id", F.concat(*[matched[k] for k in PATTERNS]).alias("base"), matched["random"].alias("runs")))
    rows = cut(_apart(rows).select("doc_id", tested(F.concat("base", "runs")).alias("found")))
    tests = rows.select(F.explode("found").alias("r")).filter("r.test is not null").select("r.test.*")
    limits = thresholds(tests)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<string,int>")
    verdict = lambda r: F.coalesce(r["test"]["random"] & (r["test"]["bin"] >= F.element_at(limit, r["test"]["stratum"])), F.lit(False))
    spans = F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), verdict(r).alias("random")))
    rows = rows.select("doc_id", F.filter(spans, lambda r: _is_base(r) | r["random"]).alias("found"))
    return _outermost(rows).select("doc_id", F.array_sort("found").alias("found"))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = lambda s: s["kind"] < len(PATTERNS)
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_line(F.filter("found", base)), 256).alias("base_sha256"),
        _line(F.col("found")).alias("spans"),
        n("random").alias("n_random"),
        F.size(F.filter("found", lambda s: base(s) & s["random"])).cast("long").alias("n_base_random"),
    )
