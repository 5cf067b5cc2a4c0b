"""Secret scan: fixed patterns plus a Markov likelihood ratio (DataFrame functions only).

*Base.*  Three patterns give spans in code points: the pieces between matches
and the matches themselves alternate, so running lengths give the positions.
Running values are taken in blocks (``scan``), so the work is linear in the
spans of a text, and a token meets the base spans beside it only.

*Method.*  Two first-order character models are compared on every other token
of 16+ characters.  The model of random strings is trained on the values that
the base patterns label as secrets, mixed with a uniform model (a random string
may use any character); the model of ordinary identifiers is trained on all
other tokens of 12+ characters, those with at most one digit also in upper case,
so that shouted words stay ordinary.  The few secrets among them are held off by a discount: ``DISCOUNT``
is taken from every pair's count, so pairs seen once teach nothing.  All digits are one character to both models: which digit stands
in a date or part number tells nothing, that digits stand together does.  Bigram
counts are summed map-side to a table of at most 128 x 128 cells per model, which
becomes one array of log ratios.  A token whose ratio is at least ``MIN_NATS`` in
total and ``MIN_NATS_A_CHAR`` per character adds a span of kind ``markov``.
Tokens of the form of a UUID are identifiers and add none.

Everything runs where the text lies; only the bigram counts are shuffled.

Nulls: a null text is empty and has no spans; null ids are kept.  Without any
labelled sample a model is uniform.  Repeated rows are scanned alike and each
gives a row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

# fixed patterns of the contract; hex and access runs are maximal, so the length is part of the pattern
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
TOKEN = r"[A-Za-z0-9+/=_-]{12,}"
MIN_TOKEN = 16
KINDS = ["assign", "access", "hex", "markov"]

MIN_NATS = 12.0
MIN_NATS_A_CHAR = 0.6
ASCII = 128
SYMBOLS = 66
SMOOTHING = 0.5
UNIFORM_SHARE = 0.5
BACK_OFF = 8.0
DISCOUNT = 1

UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

BLOCK = 64
NEVER = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column], first: Column, levels: int = 2) -> Column:
    """Of every place of an int array, ``op`` over ``first`` and all values before it; blocks of blocks keep it linear."""
    if not levels:
        begin = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, begin, lambda s, v: F.struct(
            op(s["now"], v).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, first, op))
        return F.flatten(F.zip_with(blocks, scan(totals, op, first, levels - 1), lambda b, f: scan(b, op, f, 0)))

    def cut(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

    return let(let(values, cut), joined)


def spans_of(text: Column, pattern: str, kind: int, said_group: int = 0) -> Column:
    """Array of (start, kind, end, text of a group) of all matches, in code points."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(said_group)).alias("said"))
    hits = F.transform(F.filter(pieces, lambda p: p["hit"].isNotNull()), lambda p: F.struct(
        F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("long"), p["said"].alias("said")))

    def placed(hits: Column) -> Column:
        before = scan(F.transform(hits, lambda p: p["gap"] + p["long"]), lambda x, y: x + y, F.lit(0))
        return F.zip_with(hits, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("at"), F.lit(kind).alias("kind"), (at + p["gap"] + p["long"]).alias("stop"),
            p["said"].alias("said")))

    return let(hits, placed)


def untouched(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps, by start."""

    def kept(spans: Column) -> Column:
        stops = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(0))
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["at"]).otherwise(NEVER))
        before = scan(stops, lambda x, y: F.greatest(x, y), F.lit(0))
        behind = F.reverse(scan(starts, lambda x, y: F.least(x, y), F.lit(NEVER)))
        beside = F.arrays_zip(spans.alias("span"), before.alias("before"), behind.alias("behind"))
        free = F.filter(beside, lambda p: (p["span"]["kind"] == 3) & (p["before"] <= p["span"]["at"])
                        & (p["behind"] >= p["span"]["stop"]))
        return F.transform(free, lambda p: p["span"])

    return let(F.array_sort(F.concat(base, tokens)), kept)


def tokens_and_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: base spans, and all tokens that no base span touches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.filter(spans_of(F.col("text"), ASSIGN, 0, 2), lambda s: F.char_length(s["said"]) >= MIN_VALUE)
        .alias("assign"),
        spans_of(F.col("text"), ACCESS, 1).alias("access"), spans_of(F.col("text"), HEX, 2).alias("hex"),
        spans_of(F.col("text"), TOKEN, 3).alias("tokens"))
    return found.select("id", "assign", "access", "hex", untouched(
        F.col("tokens"), F.concat("assign", "access", "hex")).alias("tokens"))


def bigram_counts(found: DataFrame) -> DataFrame:
    """``cell, random, ordinary``: counts of neighbouring characters in the labelled samples."""
    secrets = found.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(
        F.col("s.said").alias("token"), F.lit(1).alias("random"))
    few_digits = F.char_length(F.regexp_replace(F.col("s.said"), "[^0-9]", "")) <= 1
    forms = F.array_append(F.when(few_digits, F.array(F.upper("s.said"))).otherwise(F.array()), F.col("s.said"))
    words = found.select(F.explode("tokens").alias("s")).select(F.explode(forms).alias("token"), F.lit(0).alias("random"))
    samples = secrets.unionByName(words)
    cells = samples.select("random", F.explode(cells_of(F.col("token"))).alias("cell"))
    return cells.groupBy("cell").agg(F.sum("random").alias("random"), F.sum(1 - F.col("random")).alias("ordinary"))


def cells_of(token: Column) -> Column:
    """Cell numbers of a token's character pairs; digits count as one character."""
    codes = F.transform(F.split(F.regexp_replace(token, "[0-9]", "0"), ""), lambda c: F.ascii(c))

    def neighbours(c: Column) -> Column:
        n = F.size(c) - 1
        return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: x * ASCII + y)

    return let(F.filter(codes, lambda c: c > 0), neighbours)


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row: the log likelihood ratio of every character pair, by cell number."""
    cells = counts.sparkSession.range(ASCII * ASCII).withColumnRenamed("id", "cell").join(counts, "cell", "left").select(
        "cell", F.floor(F.col("cell") / ASCII).alias("first"), (F.col("cell") % ASCII).alias("second"),
        F.coalesce("random", F.lit(0)).alias("random"), F.greatest(F.coalesce("ordinary", F.lit(0)) - DISCOUNT, F.lit(0)).alias("ordinary"))
    totals = cells.groupBy("first").agg(F.sum("random").alias("randoms"), F.sum("ordinary").alias("ordinaries"))
    single = cells.groupBy("second").agg(F.sum("ordinary").alias("singles"))
    everything = cells.agg(F.sum("ordinary").alias("everything")).scalar()
    symbols = F.when(F.col("second") == ord("0"), 10).otherwise(1)  # that the second character stands for
    drawn = (F.col("random") + SMOOTHING * symbols) / (F.col("randoms") + SMOOTHING * SYMBOLS) * (1 - UNIFORM_SHARE) \
        + symbols * F.lit(UNIFORM_SHARE / SYMBOLS)
    # after a character that identifiers rarely hold, the ordinary model falls back on single characters
    alone = (F.col("singles") + SMOOTHING * symbols) / (everything + SMOOTHING * SYMBOLS)
    usual = (F.col("ordinary") + BACK_OFF * alone) / (F.col("ordinaries") + BACK_OFF)
    pair = F.struct("cell", F.log(drawn / usual).alias("ratio"))
    return cells.join(totals, "first").join(single, "second").agg(F.sort_array(F.collect_list(pair)).alias("pairs")).select(
        F.col("pairs.ratio").alias("ratios"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans, n_markov``: one row per document."""
    found = stage(tokens_and_spans(docs, id_col, text_col), "secrets")
    ratios = stage(log_ratios(bigram_counts(found)), "log-ratios").scalar()
    scored = found.withColumn("ratios", ratios)

    def random(token: Column) -> Column:
        nats = F.aggregate(cells_of(token["said"]), F.lit(0.0),
                           lambda s, c: s + F.element_at(F.col("ratios"), c.cast("int") + 1))
        return (F.char_length(token["said"]) >= MIN_TOKEN) & (nats >= MIN_NATS) & \
            (nats >= MIN_NATS_A_CHAR * F.char_length(token["said"])) & ~F.rlike(token["said"], F.lit(UUID))

    marked = scored.withColumn("markov", F.filter("tokens", random))
    kind = F.array(*[F.lit(k) for k in KINDS])

    def listed(*columns: str) -> Column:
        """kind:start:end by start, then kind as listed."""
        return F.array_join(F.transform(F.array_sort(F.concat(*columns)), lambda s: F.concat_ws(
            ":", F.element_at(kind, s["kind"] + 1), s["at"].cast("string"), s["stop"].cast("string"))), ",")

    def number(column: str) -> Column:
        return F.size(column).cast("long")

    return marked.select(
        F.col("id").alias(id_col), number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(listed("assign", "access", "hex"), 256).alias("base_sha256"),
        listed("assign", "access", "hex", "markov").alias("spans"), number("markov").alias("n_markov"))
