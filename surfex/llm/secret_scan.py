"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens. DataFrame functions only.

Three patterns give the base spans. Beside them every long token that mixes letters and digits is tested, in the alphabet
of its inferred encoding, for uniform symbols (chi-squared), for runs above and below the middle of the alphabet, and for
serial correlation. The smallest of the three p-values, times three, is the token's. Within each encoding and length band
Benjamini and Hochberg's rule over all tokens of the corpus rejects randomness with a bounded share of false rejections;
tokens it doesn't reject are taken for random, hence secret. Short tokens have bands of their own, so their weaker tests
don't borrow from the many long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Both classes are maximal runs, so a least length inside the pattern drops the same matches as a filter after it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

#: Alphabets of the inferred encodings, in the order in which they are tried.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_BANDS = 6
_STEP = 8  # bins of p-values per power of ten
_SPAN = "array<struct<start:int,place:int,end:int>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once: what a lambda function reads from outside is computed anew for each entry."""
    return F.transform(F.array(value), f)[0]


def running_sum(values: Column, block: int = 256) -> Column:
    """Sums of the first 1, 2, ... entries of an int array, by blocks, so that long arrays don't cost their square."""
    def sums(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / block).cast("int")), lambda b: _sum(F.slice(all_, b * block + 1, F.lit(block))))
        whole = _let(blocks, lambda own: F.transform(own, lambda _, b: _sum(F.slice(own, F.lit(1), b))))
        return _let(whole, lambda before: F.transform(all_, lambda _, i: before[(i / block).cast("int")]
                                                      + _sum(F.slice(all_, (i / block).cast("int") * block + 1, i % block + 1))))

    return _let(values, sums)


def matches(text: Column, pattern: str, place: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, place, end), in code points, of the leftmost non-overlapping matches whose ``group`` is long enough."""
    lengths = lambda parts: F.transform(parts, F.length)
    found = F.struct(lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("sizes"), lengths(F.split(text, pattern, -1)).alias("between"),
                     lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("kept"))

    def spans(m: Column) -> Column:
        steps = F.transform(m["sizes"], lambda _, i: m["between"][i] + F.when(i > 0, m["sizes"][i - 1]).otherwise(0))
        out = _let(running_sum(steps), lambda starts: F.transform(m["sizes"], lambda n, i: F.struct(
            starts[i].alias("start"), F.lit(place).alias("place"), (starts[i] + n).alias("end"))))
        return F.filter(out, lambda _, i: m["kept"][i] >= least) if least else out

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.lit(None).cast(_SPAN))


def _upper_tail(z: Column) -> Column:
    """P(N > z), within 1e-7: Hart's form of a polynomial in 1 / (1 + z p), mirrored for negative z."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    return (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(token.rlike("^[A-Z2-7]+$"), 1)
            .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 2).when(token.rlike("^[0-9A-Za-z]+$"), 3).otherwise(4))


def _extend(items: Column, **fields) -> Column:
    """An array of structs with further fields, each a function of the struct; a field is computed once however often it is read."""
    return F.transform(items, lambda c: F.struct(c.alias("_"), *(f(c).alias(name) for name, f in fields.items())))


def battery(tokens: Column) -> Column:
    """array<struct<span, band, bin>> of array<struct<span, token, code>>; bin is that of the combined p-value."""
    def alphabet(c: Column) -> Column:
        return F.array(*map(F.lit, ALPHABETS))[c["code"]]

    def values(c: Column) -> Column:
        letters = (F.when(c["code"].isin(0, 2), F.lower(c["token"])).when(c["code"] == 4, F.translate(c["token"], "-_", "+/")).otherwise(c["token"]))
        return F.transform(F.split(letters, ""), lambda x: F.instr(alphabet(c), x) - 1)

    fold = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))
    one = _extend(tokens, k=lambda c: F.length(alphabet(c)), v=values, n=lambda c: F.length(c["token"]))
    two = _extend(one, cells=lambda c: F.greatest(F.lit(2), F.least(F.lit(16), (c["n"] / 5).cast("int"))), mean=lambda c: _sum(c["v"]) / c["n"],
                  high=lambda c: F.transform(c["v"], lambda x: (2 * x >= c["k"]).cast("int")))

    def seen(c: Column) -> Column:
        k = c["_"]["k"]
        cell = F.transform(c["_"]["v"], lambda x: (x * c["cells"] / k).cast("int"))
        return F.transform(F.sequence(F.lit(0), c["cells"] - 1), lambda j: F.struct(
            F.size(F.filter(cell, lambda x: x == j)).alias("is"),
            (c["_"]["n"] * (F.ceil((j + 1) * k / c["cells"]) - F.ceil(j * k / c["cells"])) / k).alias("due")))

    def product(c: Column) -> Column:
        v, mean = c["_"]["v"], c["mean"]
        pairs = F.arrays_zip(F.slice(v, F.lit(1), c["_"]["n"] - 1), F.slice(v, F.lit(2), c["_"]["n"] - 1))
        return fold(pairs, lambda p: (p["0"] - mean) * (p["1"] - mean))

    def changes(c: Column) -> Column:
        pairs = F.arrays_zip(F.slice(c["high"], F.lit(1), c["_"]["n"] - 1), F.slice(c["high"], F.lit(2), c["_"]["n"] - 1))
        return F.aggregate(pairs, F.lit(1), lambda a, p: a + (p["0"] != p["1"]).cast("int"))

    three = _extend(two, seen=seen, n1=lambda c: _sum(c["high"]).cast("double"), changes=changes, product=product,
                    square=lambda c: fold(c["_"]["v"], lambda x: (x - c["mean"]) * (x - c["mean"])))
    four = _extend(three, chi=lambda c: fold(c["seen"], lambda x: F.pow(x["is"] - x["due"], F.lit(2.0)) / x["due"]), free=lambda c: (c["_"]["cells"] - 1).cast("double"),
                   centre=lambda c: 2 * (c["_"]["_"]["n"] - c["n1"]) * c["n1"] / c["_"]["_"]["n"] + 1)

    def normal(c: Column) -> Column:
        return (F.pow(c["chi"] / c["free"], F.lit(1 / 3)) - 1 + 2 / (9 * c["free"])) / F.sqrt(2 / (9 * c["free"]))

    def runs(c: Column) -> Column:
        spread = F.sqrt((c["centre"] - 1) * (c["centre"] - 2) / (c["_"]["_"]["_"]["n"] - 1))
        return F.when(c["centre"] > 2, F.abs(c["_"]["changes"] - c["centre"]) / spread)

    def serial(c: Column) -> Column:
        n = c["_"]["_"]["_"]["n"]
        return F.when(c["_"]["square"] > 0, F.abs(c["_"]["product"] / c["_"]["square"] + 1 / n) * F.sqrt(n.cast("double")))

    five = _extend(four, z1=normal, z2=runs, z3=serial)
    six = _extend(five, p=lambda c: F.least(_upper_tail(c["z1"]), F.coalesce(2 * _upper_tail(c["z2"]), F.lit(0.0)), F.coalesce(2 * _upper_tail(c["z3"]), F.lit(0.0))))

    def result(c: Column) -> Column:
        inner = c["_"]["_"]["_"]["_"]
        token, p = inner["_"]["_"], F.least(F.lit(1.0), F.greatest(3 * c["p"], F.lit(1e-12)))
        band = token["code"] * _BANDS + F.least(F.lit(_BANDS - 1), F.floor(2 * F.log2(inner["_"]["n"] / 20)).cast("int"))
        return F.struct(token["span"].alias("span"), band.alias("band"), F.ceil(_STEP * F.log10(p)).cast("int").alias("bin"))

    return F.transform(six, result)


def _with_spans(docs: DataFrame, least_bits: float) -> DataFrame:
    """``docs`` with ``_base`` spans and ``_tested`` tokens outside them: span, band and bin of the p-value."""
    text = F.col("_text")
    empty = F.array().cast(_SPAN)
    out = docs.withColumn("_text", whole_text()).withColumns({
        "_assign": matches(text, ASSIGN, 0, 2, 12), "_access": matches(text, ACCESS, 1), "_hex": matches(text, HEX, 2), "_long": matches(text, TOKEN, 3)})
    out = out.withColumn("_base", F.array_sort(F.concat(*(F.coalesce(F.col(c), empty) for c in ("_assign", "_access", "_hex")))))
    clear = _let(F.col("_base"), lambda base: F.filter("_long", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    found = F.transform(clear, lambda s: F.struct(s.alias("span"), F.rtrim(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("=")).alias("token")))
    mixed = F.filter(found, lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]"))
    coded = F.transform("_mixed", lambda c: F.struct(c["span"].alias("span"), c["token"].alias("token"), _encoding(c["token"]).alias("code")))
    bits = F.array(*(F.lit(math.log2(len(a))) for a in ALPHABETS))
    long_enough = F.filter("_coded", lambda c: F.length(c["token"]) * bits[c["code"]] >= least_bits)
    tested = battery(F.col("_coded"))
    return (out.withColumn("_mixed", F.when(F.size("_long") > 0, mixed)).withColumn("_coded", F.when(F.size("_mixed") > 0, coded))
            .withColumn("_coded", F.when(F.size("_coded") > 0, long_enough)).withColumn("_tested", F.when(F.size("_coded") > 0, tested))
            .drop("_text", "_long", "_mixed", "_coded", "_access", "_hex", "_assign"))


def rejection_cuts(docs: DataFrame, rate: float = 0.1, least_bits: float = 100.0) -> dict[int, int]:
    """Per band the largest bin of p-values in which randomness is rejected, by the rule over all tokens of ``docs``.

    p-values are rounded up to their bin, which can only reject fewer. At most 30 bands of 97 bins reach the driver.
    """
    counts = (_with_spans(docs.select("text"), least_bits).select(F.explode("_tested").alias("t"))
              .groupBy(F.col("t.band").alias("band"), F.col("t.bin").alias("bin")).count().collect())
    cuts, total = {}, {}
    for row in counts:
        total[row["band"]] = total.get(row["band"], 0) + row["count"]
    for band, m in total.items():
        below = 0
        for b, n in sorted((row["bin"], row["count"]) for row in counts if row["band"] == band):
            below += n
            if 10.0 ** (b / _STEP) <= rate * below / m:
                cuts[band] = b
    return cuts


def find_secrets(docs: DataFrame, rate: float = 0.1, least_bits: float = 100.0) -> DataFrame:
    """``docs`` with ``spans``, array<struct<start, place, end>> by start and place; an own ``spans`` is replaced.

    ``place`` indexes ``KINDS``; positions are code points, the end exclusive. Null and empty texts have none; rows with
    null or repeated ids are rows like any other. ``rate`` is the share of false rejections allowed among the tokens
    judged not random; ``least_bits`` the least length of a token in bits of its encoding.
    """
    cuts = rejection_cuts(docs, rate, least_bits)
    limits = F.array(*(F.lit(cuts.get(b, -10**6)) for b in range(_BANDS * len(ALPHABETS))))
    random = F.transform(F.filter("_tested", lambda t: t["bin"] > limits[t["band"]]), lambda t: t["span"])
    spans = F.when(F.size("_tested") > 0, F.array_sort(F.concat("_base", random))).otherwise(F.col("_base"))
    return _with_spans(docs, least_bits).withColumn("spans", spans).drop("_base", "_tested")


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["place"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", **options: float) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, spans that overlap by one; n_chars follows where present."""
    found = find_secrets(docs.select(F.struct("*").alias("row"), "text"), **options)
    text = F.col("text")
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    done = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.when(x["start"] >= s["at"], F.concat(s["out"], piece(s["at"], x["start"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
                              F.greatest(s["at"], x["end"]).alias("at")),
        lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    out = found.withColumn("cleared", F.when(F.size("spans") > 0, done).otherwise(text))
    row = F.col("row").withField("text", F.col("cleared"))
    if "n_chars" in docs.columns:
        count = F.when(F.size("spans") > 0, F.length("cleared")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
