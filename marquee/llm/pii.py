"""Personal data: patterned entities, and a contextual extraction bootstrapped from them.

Base entities (email, ip, card, phone) come from patterns with checks. They and secrets of published formats (SEEDS) are
the seeds: what surrounds them induces lexical patterns, each of the word before, the word after, both, or the sign of an
assignment with the value's shape. Identifier-like strings that no seed covers, of one token or several, are the other
instances. Pattern and instance confidences are scored in turns over the pattern-instance graph, and instances that
high-confidence patterns surround become spans of the pattern's kind. In ROUNDS turns a pattern becomes confident if about
a third of its distinct instances are seeds of one kind and no other kind's seeds are among them.

Only DataFrame functions. Positions are code points, ends exclusive. Nulls: a null text is an empty one; a row with a
null doc_id is treated as any other. Repeated rows each return a row. An empty table gives an empty result. Extra columns
are ignored (redact keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Leftmost non-overlapping matches of the contract's patterns, written so that Java's matcher needs no deep recursion and
#: no second look at a run: a match starts where the last one ended or where its run of characters begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: fixed values: published formats of access keys, and what a password is assigned with
SEEDS = r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9_])|(?<=(?i:password|passwd|pwd|secret)[=:])[^\s\"',;<>]{6,}+"
#: Digit groups with blanks, brackets, dots or dashes between; colon-separated hexadecimal groups; one token with a digit or an @.
CANDIDATE = (
    r"(?<![A-Za-z0-9@._%+:-])(?:\(?[0-9]{2,}+\)?(?:[\x20./-]{1,2}\(?[0-9]{2,}+\)?)++(?![A-Za-z0-9@_%+])|(?:[0-9A-Fa-f]{1,4}::?){3,7}+[0-9A-Fa-f]{1,4}"
    r"|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{4,}[A-Za-z0-9])"
)
HINT = {"email": "@", "phone": "\\+"}  # without it there is no match
#: What every match of SEEDS starts with or follows, and what every match of CANDIDATE holds: one cheap look at texts without.
SEED_HINT, CANDIDATE_HINT = r"AKIA|gh[pousr]_|AIza|xox[abprs]-|[dDtT][=:]", "[0-9@:]"
NEAR = 48  # code points around an instance in which its context words are looked for
ROUNDS, MIN_SEEDS, CONFIDENT = 4, 3, 0.8
BROADCAST_ROWS = 1_000_000

SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


BLOCK = 128  # elements or spans that are taken at once, so that long arrays and texts cost little more than their length


def _running(values: Column, combine) -> Column:
    """combine over the values up to each place (whole numbers from 0 on), by blocks and then over the blocks."""

    def scan(x: Column, start: Column) -> Column:
        return F.aggregate(x, start, lambda acc, v: F.array_append(acc, combine(v, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))

    none = F.array().cast("array<int>")
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: scan(F.slice(x, k * BLOCK + 1, BLOCK), none))
    tails = lambda of: scan(F.transform(of, lambda c: F.get(c, F.size(c) - 1)), F.array(F.lit(0)))
    shifted = lambda of: _let(tails(of), lambda before: F.flatten(F.transform(of, lambda c, k: F.transform(c, lambda v: combine(v, F.get(before, k))))))
    return _let(values, lambda x: F.when(F.size(x) > 0, _let(blocks(x), shifted)).otherwise(none))


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    """FOUND: the pattern's matches with the text around each. The gaps between matches give positions and contexts."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def starts(m: Column, g: Column) -> Column:
        return _running(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)), lambda x, y: x + y)

    def located(m: Column, g: Column, at: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value"), F.substring(F.get(g, i), -NEAR, NEAR).alias("before"), F.substring(F.get(g, i + 1), 1, NEAR).alias("after")))

    one = _let(F.struct(got.alias("m"), gaps.alias("g")), lambda x: _let(starts(x["m"], x["g"]), lambda at: located(x["m"], x["g"], at)))
    some = F.when(F.regexp_like(text, F.lit(pattern)), one)
    some = F.when(F.regexp_like(text, F.lit(hint)), some) if hint else some
    return F.coalesce(some, F.array()).cast(FOUND)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _word(x: Column, pattern: str) -> Column:
    """A context word: lower case, digits as 0."""
    return F.regexp_replace(F.lower(F.regexp_extract(x, pattern, 1)), "[0-9]+", "0")


def _sign(before: Column) -> Column:
    """= or : where it stands before a value, quotes and brackets aside."""
    return F.regexp_extract(before, "([=:])[\\s\"'(\\[]*$", 1)


def _shape(x: Column) -> Column:
    """What a value is made of; short values of mixed characters have no shape to go by."""
    hexadecimal = F.regexp_like(x, F.lit("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"))
    mixed = F.regexp_like(x, F.lit("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}$"))
    return F.when(hexadecimal, "hex").when(mixed, "mixed").when(F.contains(x, F.lit("@")), "mail").when(F.regexp_like(x, F.lit("^[0-9]{7,}$")), "digits").otherwise("")


def base_entities(docs: DataFrame) -> DataFrame:
    """docs' columns, base and seeds (SPAN, sorted) and seen: instances with kind (null: a candidate), value and context."""
    text = F.coalesce("text", F.lit(""))
    out = docs
    for kind in BASE:
        out = out.withColumn(f"_{kind}", _matches(text, PATTERNS[kind], HINT.get(kind)))
        out = out.withColumn(f"_{kind}", F.filter(f"_{kind}", _check(kind)))
    out = out.withColumn("_secret", _matches(text, SEEDS, SEED_HINT)).withColumn("_other", _matches(text, CANDIDATE, CANDIDATE_HINT))

    def spans(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    def free(of: str, taken: str) -> Column:
        meets = lambda x: lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
        block = lambda c: F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("start"), F.array_max(F.transform(c, lambda b: b["end"])).alias("end"), c.alias("spans"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(taken) - 1) / BLOCK).cast("int")), lambda k: _let(F.slice(taken, k * BLOCK + 1, BLOCK), block))
        apart = lambda held: F.filter(of, lambda x: ~F.exists(held, lambda c: meets(x)(c) & F.exists(c["spans"], meets(x))))
        return F.when((F.size(of) > 0) & (F.size(taken) > 0), _let(blocks, apart)).otherwise(F.col(of))

    out = out.withColumn("base", F.array_sort(F.concat(*map(spans, BASE)))).withColumn("_secret", free("_secret", "base"))
    out = out.withColumn("seeds", spans("secret")).withColumn("_other", free("_other", "base")).withColumn("_other", free("_other", "seeds"))

    def instances(kind: str | None) -> Column:
        return F.transform(f"_{kind or 'other'}", lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), _word(x["before"], "([\\p{L}\\p{N}]+)[^\\p{L}\\p{N}]*$").alias("left"), _word(x["after"], "^[^\\p{L}\\p{N}]*([\\p{L}\\p{N}]+)").alias("right"), _sign(x["before"]).alias("sign"), _shape(x["value"]).alias("shape")))

    seen = F.concat(*map(instances, (*KINDS, None)))
    return out.withColumn("seen", seen).drop("_other", *(f"_{k}" for k in KINDS))


def _row_key() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def discover(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """key, start, end, kind: candidates in found(key, seen) that high-confidence patterns surround.

    Pattern confidence: the mean confidence that its distinct instances are of the kind, at least min_seeds base
    entities among them. Instance confidence: 1 - the product of (1 - confidence) over its distinct patterns.
    """
    at = found.select("key", F.explode("seen").alias("x")).select("key", "x.*")
    left, right = F.concat("left", "sign"), F.col("right")
    contexts = F.array(F.when(left != "", F.concat(F.lit("<"), left)), F.when((left != "") & (right != ""), F.concat(left, F.lit("|"), right)), F.when(right != "", F.concat(F.lit(">"), right)), F.when((F.col("sign") != "") & (F.col("shape") != ""), F.concat("sign", F.lit("#"), "shape")))
    at = at.withColumn("pattern", F.explode(F.array_compact(contexts)))
    edges = written(at.groupBy("pattern", "value").agg(F.min("kind").alias("kind")))  # a value is no entity in one place and a candidate in another
    seeds = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("p", F.lit(1.0))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds
    for _ in range(rounds):
        support = edges.join(known, "value").groupBy("pattern", known["kind"]).agg(F.sum("p").alias("sum"), F.sum(F.when(F.col("p") == 1.0, 1).otherwise(0)).alias("seeds"))
        patterns = support.where(F.col("seeds") >= min_seeds).join(size, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("confidence"))
        reached = edges.where("kind is null").select("pattern", "value").join(patterns, "pattern")
        scored = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))).alias("p"))
        best = scored.groupBy("value").agg(F.max(F.struct("p", "kind")).alias("b")).select("value", "b.kind", "b.p")
        known = written(seeds.unionByName(best.join(seeds, "value", "left_anti")))
    sure = patterns.where(F.col("confidence") >= confident)
    chosen = at.where("kind is null").drop("kind").join(sure.select("pattern", F.col("kind").alias("k")), "pattern")
    chosen = chosen.join(known.where(F.col("p") >= confident).select("value", F.col("kind").alias("k")), ["value", "k"])
    return chosen.select("key", "start", "end", F.col("k").alias("kind")).distinct()


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base, added (both SPAN, sorted): one row for each row of docs(doc_id, text)."""
    found = base_entities(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("key", _row_key()).drop("text")
    found = written(found)
    added = _grouped(discover(found))
    return found.join(added, "key", "left").select("doc_id", "base", _with_seeds().alias("added"))


def _with_seeds() -> Column:
    """Seeds that are no base entities, and what was discovered."""
    return F.array_sort(F.array_distinct(F.concat("seeds", F.coalesce("added", F.array().cast(SPAN)))))


def _grouped(spans: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    one = F.struct("start", order.alias("order"), "end", "kind")
    return spans.groupBy("key").agg(F.array_sort(F.collect_set(one)).alias("added"))


def rendered(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in angle brackets; a null text stays null."""
    own = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    # Rows and their spans are written together, so that texts are searched once.
    found = written(base_entities(own).withColumn("key", _row_key()).drop("doc_id", "text"))
    added = _grouped(discover(found))
    if added.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    both = found.join(added, "key", "left").withColumn("_s", F.array_sort(F.concat("base", _with_seeds()))).withColumn("text", F.col("_row.text"))
    # Of spans that overlap, the first stays and grows over the others. _m: the greatest end up to each span.
    both = both.withColumn("_m", _running(F.transform("_s", lambda s: s["end"]), F.greatest))
    heads = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get(F.col("_s"), i)["start"] >= F.get(F.col("_m"), i - 1)))
    both = both.withColumn("_h", F.when(F.size("_s") > 0, heads))
    one = lambda i, k: F.struct(F.get(F.col("_s"), i)["start"].alias("start"), F.get(F.col("_m"), F.coalesce(F.get(F.col("_h"), k + 1), F.size("_s")) - 1).alias("end"), F.get(F.col("_s"), i)["kind"].alias("kind"))
    both = both.withColumn("_g", F.transform("_h", one))
    end = lambda i: F.when(i < 0, 0).otherwise(F.get(F.col("_g"), i)["end"])

    def cut(k: Column) -> Column:
        """The text from span k * BLOCK - 1 on up to the end of the block's last span, with its spans replaced."""
        at, last = k * BLOCK, F.least((k + 1) * BLOCK, F.size("_g")) - 1
        piece = F.substring(F.col("text"), end(at - 1) + 1, end(last) - end(at - 1))
        part = lambda p: lambda s, i: F.concat(F.substring(p, end(at + i - 1) - end(at - 1) + 1, s["start"] - end(at + i - 1)), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return _let(piece, lambda p: F.array_join(F.transform(F.slice("_g", at + 1, BLOCK), part(p)), ""))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_g") - 1) / BLOCK).cast("int")), cut)
    rest = F.substring(F.col("text"), end(F.size("_g") - 1) + 1, F.length("text"))
    text = F.when(F.size("_s") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))
    return both.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")
