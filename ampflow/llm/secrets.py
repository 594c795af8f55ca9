"""Secret scans: fixed patterns, and a battery of randomness tests (built-in expressions only).

Patterns give the base spans (assign, access, hex). Outside them, every run of 20 or more
encoding characters that holds a digit and a letter is a candidate. Its encoding is inferred
from its characters (hex, base32, base36, base64), and three tests ask whether it looks
like independent uniform draws from that alphabet:

* chi-squared uniformity of the symbol counts, standardised by its exact mean and variance, so
  that it holds where a token has fewer characters than its alphabet has symbols;
* the runs test on two classes of characters: digits and letters or, in base64, small letters and the rest;
* the serial correlation of neighbouring symbols.

The Cauchy combination makes one p-value of the three. A random token has a uniform p-value, an
ordinary one a small one. False discoveries are ordinary tokens called random, and shorter tokens
are harder to tell apart. So each stratum (encoding and quarter octave of length) has a null of its own: ``DECOYS``
tokens of its shortest length that are made of words and a number, with letters as frequent as in European text,
go through the same tests. With all candidates of the stratum taken for ordinary, the null says how many of them
would pass a p-value; the threshold is the lowest at which these are at most ``rate`` of those that do. A
stratum that never gets there calls nothing. Candidates and decoys are counted by stratum and
one of 50 cells of the p-value, 4 x 24 x 50 rows at most, whatever the input; the thresholds enter the second pass as a
scalar subquery. What is neither random nor like words and numbers is not controlled.

Defined results: a null text counts as empty; null doc_ids and repeated rows are
ordinary rows; an empty table gives an empty result; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.llm.common import durable, joined, let, replaced, shielded, spans_of, whole

# The base patterns.
ASSIGN = (
    "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the method: 20 characters or more.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
#: Places (after, up to) in its alphabet of the class that the runs test looks at.
CLASSES = {"hex": (0, 10), "base32": (26, 32), "base36": (0, 10), "base64": (26, 52)}
CELLS = 50
#: Ordinary tokens that are made for the null of a stratum, and the longest strata, in quarter octaves.
DECOYS = 4000
LONGEST = 32
# Letters of European text, in percent.
FREQUENT = "e" * 13 + "n" * 8 + "i" * 8 + "a" * 8 + "t" * 7 + "s" * 7 + "r" * 7 + "o" * 6 + "l" * 4 + "d" * 5 + "u" * 4 + "h" * 4 + "c" * 4 + "m" * 3 + "p" * 2 + "g" * 2 + "f" * 2 + "w" + "b" + "y" + "v" + "k" + "z"


def _base(text: Column) -> Column:
    """array<struct<start,rank,end,kind>> of the three patterns."""
    found = [
        spans_of(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        spans_of(text, ACCESS),
        spans_of(text, HEX),
    ]
    return F.concat(*[_named(spans, rank) for rank, spans in enumerate(found)])


def _named(spans: Column, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")
        ),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation with an error below 1e-7."""
    # Abramowitz and Stegun, 26.2.17.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    """The narrowest encoding with a digit and a letter that the token fits, or null."""
    mixed = F.regexp_like(token, F.lit("[0-9]")) & F.regexp_like(token, F.lit("[A-Za-z]"))
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(F.regexp_like(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
        .when(F.regexp_like(token, F.lit("^[A-Z2-7]+=*$")), "base32")
        .when(F.regexp_like(token, F.lit("^[a-z0-9]+$")), "base36")
        .otherwise("base64")
    )


def p_random(token: Column, encoding: Column) -> Column:
    """The combined p-value of the battery; small for a token that is not random."""
    names = list(ALPHABETS)
    alphabet = F.when(encoding == names[0], ALPHABETS[names[0]])
    for name in names[1:]:
        alphabet = alphabet.when(encoding == name, ALPHABETS[name])
    plain = F.when(encoding == "hex", F.lower(token)).otherwise(F.translate(token, "-_=", "+/"))
    bound = lambda k: F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(CLASSES[n][k]))]), encoding)
    parts = F.struct(plain.alias("token"), alphabet.alias("alphabet"), bound(0).alias("low"), bound(1).alias("high"))
    return let(parts, _battery)


def _battery(c: Column) -> Column:
    """c: struct<token,alphabet,low,high>."""
    token = c["token"]
    k, n = F.length(c["alphabet"]).cast("double"), F.length(token).cast("double")
    codes = F.transform(F.split(token, ""), lambda x: F.instr(c["alphabet"], x).cast("double"))
    squares = F.aggregate(
        F.split(c["alphabet"], ""),
        F.lit(0.0),
        lambda a, x: a + F.pow(F.length(token) - F.length(F.replace(token, x, F.lit(""))), F.lit(2)),
    )
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (1 - 1 / n))

    inside = lambda x: (x > c["low"]) & (x <= c["high"])

    def step(acc: Column, x: Column) -> Column:
        high = F.when(inside(x), 1.0).otherwise(0.0)
        return F.struct(
            x.alias("last"),
            (acc["s1"] + x).alias("s1"),
            (acc["s2"] + x * x).alias("s2"),
            (acc["lag"] + F.when(acc["last"] < 0, 0.0).otherwise(acc["last"] * x)).alias("lag"),
            (acc["high"] + high).alias("high"),
            (
                acc["runs"]
                + F.when((acc["last"] < 0) | (inside(acc["last"]) != inside(x)), 1.0).otherwise(0.0)
            ).alias("runs"),
            F.when(acc["last"] < 0, x).otherwise(acc["first"]).alias("first"),
        )

    zero = F.struct(
        F.lit(-1.0).alias("last"),
        *[F.lit(0.0).alias(f) for f in ("s1", "s2", "lag", "high", "runs", "first")],
    )

    def scores(a: Column) -> Column:
        """array<struct<z,sides>> of the three tests; a test that has no spread counts as failed."""
        mean = a["s1"] / n
        centred = a["lag"] - mean * (2 * a["s1"] - a["first"] - a["last"]) + (n - 1) * mean * mean
        serial = (F.try_divide(centred, a["s2"] - n * mean * mean) + 1 / n) * F.sqrt(n)
        expected = 2 * a["high"] * (n - a["high"]) / n + 1
        deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))
        runs = F.try_divide(a["runs"] - expected, deviation)
        two_sided = [F.struct(F.coalesce(F.abs(z), F.lit(30.0)).alias("z"), F.lit(2.0).alias("sides")) for z in (runs, serial)]
        return F.array(F.struct(chi.alias("z"), F.lit(1.0).alias("sides")), *two_sided)

    def add(total: Column, test: Column) -> Column:
        p = F.least(F.greatest(test["sides"] * _upper_tail(test["z"]), F.lit(1e-12)), F.lit(1 - 1e-12))
        return total + F.tan((0.5 - p) * 3.141592653589793)

    cauchy = F.aggregate(let(F.aggregate(codes, zero, step), scores), F.lit(0.0), add)
    return 0.5 - F.atan(cauchy / 3) / 3.141592653589793


def _cell(token: Column, encoding: Column) -> Column:
    return F.least(F.floor(p_random(token, encoding) * CELLS), F.lit(CELLS - 1)).cast("int")


def _candidates(outside: Column) -> Column:
    """array<struct<start,end,encoding,quarter,cell>> of the tokens of a text."""
    tokens = spans_of(outside, TOKEN, lambda m: _encoding(m).isNotNull())
    quarter = lambda m: F.least(F.floor(4 * F.log2(F.length(m))), F.lit(LONGEST)).cast("int")
    return F.transform(
        tokens,
        lambda t: let(
            _encoding(t["match"]),
            lambda e: F.struct(
                t["start"].alias("start"),
                t["end"].alias("end"),
                e.alias("encoding"),
                quarter(t["match"]).alias("quarter"),
                _cell(t["match"], e).alias("cell"),
            ),
        ),
    )


def _scanned(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with __s_text, __s_base and __s_candidates."""
    first = docs.select("*", text.alias("__s_text"))
    with_base = first.select("*", F.sort_array(_base(F.col("__s_text"))).alias("__s_base"))
    blank = replaced(F.col("__s_text"), F.col("__s_base"), lambda n: F.repeat(F.lit(" "), n))
    return with_base.select("*", blank.alias("__s_outside")).select("*", _candidates(F.col("__s_outside")).alias("__s_candidates"))


def _words(letters: str, n: int = 256) -> list[str]:
    """Words of 3 to 9 letters, drawn from the given ones."""
    rng = random.Random(letters)
    return ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n)]


def decoy(encoding: Column, length: Column, seed: Column) -> Column:
    """An ordinary token: words and, behind them, a number of 1 to 6 digits; in base64 with marks or capitals between the words."""
    draw = lambda most, *keys: F.pmod(F.xxhash64(seed, *keys), F.lit(most)).cast("int")
    one_of = lambda items, *keys: F.get(F.array(*[F.lit(x) for x in items]), draw(len(items), *keys))
    hexed = [c for c in FREQUENT if c in ALPHABETS["hex"]]

    def word(k: Column) -> Column:
        return F.when(encoding == "hex", one_of(_words("".join(hexed)), k)).otherwise(one_of(_words(FREQUENT), k))

    places = F.sequence(F.lit(1), F.ceil(length / 3).cast("int"))
    joined_up = F.array_join(F.transform(places, word), " ")
    capitals = F.when(draw(2, F.lit("capitals")) == 0, F.initcap(joined_up)).otherwise(joined_up)
    marked = F.replace(capitals, F.lit(" "), one_of(("-", "_", "/", ""), F.lit("mark")))
    words = F.when(encoding == "base64", marked).otherwise(F.replace(joined_up, F.lit(" "), F.lit("")))
    n = 1 + draw(6, F.lit("digits"))
    digits = F.substring(F.xxhash64(seed, F.lit("number")).cast("string"), F.lit(4), n)
    plain = F.concat(F.substring(words, F.lit(1), length - n), digits)
    return F.when(encoding == "base32", F.translate(F.upper(plain), "0189", "2345")).otherwise(plain)


def null_cells(strata: DataFrame, decoys: int = DECOYS) -> DataFrame:
    """(encoding, quarter, cell, decoys): how the ordinary tokens of the given strata (encoding, quarter) fall."""
    listed = strata.agg(F.collect_list(F.struct("encoding", "quarter")).alias("strata")).scalar()
    seeds = strata.sparkSession.range(decoys).select(F.col("id").alias("seed"), F.explode(listed).alias("s"))
    shortest = F.greatest(F.ceil(F.pow(F.lit(2.0), F.col("s.quarter") / 4)).cast("int"), F.lit(20))
    tokens = seeds.select("s.*", decoy(F.col("s.encoding"), shortest, F.col("seed")).alias("token"))
    cells = tokens.select("encoding", "quarter", _cell(F.col("token"), F.col("encoding")).alias("cell"))
    return cells.groupBy("encoding", "quarter", "cell").agg(F.count("*").alias("decoys"))


def thresholds(docs: DataFrame, rate: float = 0.05, decoys: int = DECOYS) -> DataFrame:
    """(encoding, quarter, least_cell): the p-value cell from which tokens of a stratum are called random."""
    cells = durable(
        _scanned(docs.select("text"), whole("text"))
        .select(F.explode("__s_candidates").alias("c"))
        .groupBy("c.encoding", "c.quarter", "c.cell")
        .agg(F.count("*").alias("n"))
    )
    null = null_cells(cells.select("encoding", "quarter").distinct(), decoys)
    both = cells.withColumn("decoys", F.lit(0).cast("long")).unionByName(null.withColumn("n", F.lit(0).cast("long")))
    by_cell = both.groupBy("encoding", "quarter", "cell").agg(F.sum("n").alias("n"), F.sum("decoys").alias("decoys"))
    stratum = Window.partitionBy("encoding", "quarter")
    from_here = stratum.orderBy(F.desc("cell"))
    tails = by_cell.select(
        "encoding",
        "quarter",
        "cell",
        F.sum("n").over(stratum).alias("tokens"),
        F.sum("n").over(from_here).alias("called"),
        ((F.sum("decoys").over(from_here) + 1) / (decoys + 1)).alias("ordinary"),
    )
    good = tails.where((F.col("called") > 0) & (F.col("tokens") * F.col("ordinary") <= rate * F.col("called")))
    return good.groupBy("encoding", "quarter").agg(F.min("cell").alias("least_cell"))


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """The documents and __s_base, __s_spans: arrays of struct<start,rank,end,kind>."""
    stratum = lambda c: F.concat_ws("/", c["encoding"], c["quarter"].cast("string"))
    found = thresholds(docs, rate).select(F.struct("encoding", "quarter").alias("s"), "least_cell")
    limits = found.agg(F.map_from_entries(F.collect_list(F.struct(stratum(F.col("s")), "least_cell"))).alias("limits"))
    called = F.filter(
        "__s_candidates", lambda c: c["cell"] >= F.coalesce(F.try_element_at("__s_limits", stratum(c)), F.lit(CELLS))
    )
    scanned = _scanned(docs, whole("text")).select("*", limits.scalar().alias("__s_limits"))
    return scanned.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "__s_base",
        F.sort_array(F.concat("__s_base", _named(called, 3))).alias("__s_spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count("__s_base", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("__s_base")), 256).alias("base_sha256"),
        joined(F.col("__s_spans")).alias("spans"),
        count("__s_spans", "random").alias("n_random"),
    )


@shielded("doc_id", "text", "n_chars")
def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; n_chars, if there, follows the text."""
    clean = F.when(F.size("__s_spans") > 0, replaced(whole("text"), F.col("__s_spans"), lambda n: F.lit(mark))).otherwise(F.col("text"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Behind a generator the expression stays whole: a reader that uses the text often does not repeat it.
    opaque = scan(docs).select(*own, F.explode(F.array(clean)).alias("__s_clean"))
    of = {"text": F.col("__s_clean")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.length("__s_clean").cast(dict(docs.dtypes)["n_chars"])
    return opaque.select(*[of[c].alias(c) if c in of else F.col(f"`{c}`") for c in docs.columns])
