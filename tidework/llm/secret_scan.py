"""Secret scans: known forms by pattern, unknown ones by a battery of randomness tests.

Beside keys with a known form, every long run of key characters is a candidate,
and so is every long part of it between signs that may join words and keys. What
lies beside a known form is a run of its own. A candidate's encoding is inferred from its characters, and three tests are made on the
places of its characters in that alphabet: chi-squared for a uniform use of the
alphabet, runs above and below the middle, and serial correlation. A candidate
is a secret if the battery does not reject that it is random, and if it is too
uniform for text. The latter is decided over all candidates of the corpus:
Benjamini and Hochberg's procedure in each band of lengths, since short runs
look uniform far more often than long ones.

All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the known forms, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE_LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{CANDIDATE_LEAST},}}+"
# Parts of a run: what lies between its signs, or between those that one of the two encodings with signs leaves out.
PARTS = [rf"[A-Za-z0-9{signs}]{{{CANDIDATE_LEAST},}}+" for signs in ("", "+", "+/", "_-")]
_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The first alphabet that holds all characters of a candidate is its encoding. Digits alone are numbers, no secrets.
ALPHABETS = [
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _SMALL,
    _LARGE,
    _LARGE + "234567",
    _SMALL + _DIGITS,
    _LARGE + _DIGITS,
    _LARGE + _SMALL,
    _LARGE + _SMALL + _DIGITS,
    _LARGE + _SMALL + _DIGITS + "+/",
    _LARGE + _SMALL + _DIGITS + "-_",
]
MIXED = _LARGE + _SMALL + _DIGITS + "+/-_"  # of runs that no single encoding holds
TEXT_REPEAT = 0.0667  # probability that two letters of a text are the same
TEXT_EXCESS = 1.9  # the same for text in a small alphabet, as a multiple of the uniform probability
BINS = 8  # of p-values for each power of ten
LAST_BIN = 160


SPAN = "struct<start:int,kind:int,end:int,token:string>"
BLOCK = 128  # spans that are worked on in one list, and code points of a piece of text are the square of it


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though ``use`` mentions it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, of: str, step) -> Column:
    """A list of the type ``of``, made by going through ``items`` with a number that starts at 0: ``step`` of the number
    and an item gives the next number and a list of results. Results are gathered in blocks, so that long lists don't
    grow item by item."""
    state = f"struct<at:int,out:array<{of}>>"

    def one(state_: Column, item: Column) -> Column:
        at, out = step(state_["at"], item)
        return F.struct(at.alias("at"), F.concat(state_["out"], out).alias("out")).cast(state)

    def block(at: Column, some: Column) -> Column:
        empty = F.array().cast(f"array<{of}>")
        return F.aggregate(some, F.struct(at.alias("at"), empty.alias("out")).cast(state), one)

    blocks_type = f"struct<at:int,out:array<array<{of}>>>"

    def next_block(state_: Column, some: Column) -> Column:
        return _bound(
            block(state_["at"], some),
            lambda r: F.struct(r["at"].alias("at"), F.concat(state_["out"], F.array(r["out"])).alias("out")).cast(blocks_type),
        )

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(v, at, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{of}>>").alias("out")).cast(blocks_type)
        return F.aggregate(blocks, start, next_block, lambda r: F.flatten(r["out"]))

    return _bound(items, whole)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost first and without overlap, as structs of start, kind, end and the matched text. Starts come
    from the lengths of what lies between matches; the text is cut once for all of them."""
    # Behind the last match there is text without one.
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda gap, token: F.struct(F.length(gap).alias("gap"), token.alias("token")),
    )

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start = at + s["gap"]
        end = start + F.length(s["token"])
        row = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), s["token"].alias("token")
        )
        return end, F.array(row)

    steps = F.filter(pairs, lambda s: s["token"].isNotNull())
    # The plain search comes first: few texts have a match, and the others stop there.
    return F.when(text.rlike(pattern), _scan(steps, SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _each_once(spans: Column) -> Column:
    """The spans in order, equal ones once."""
    return _bound(
        F.array_sort(spans),
        lambda v: F.filter(v, lambda s, i: (i == 0) | (s != F.get(v, i - 1))),
    )


def _pieces(text: Column) -> Column:
    """The text in pieces, so that a place in it is found without going through all that is before."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK * BLOCK}}}"), 0)


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, which are code points."""
    wide = BLOCK * BLOCK

    def piece(i: Column) -> Column:
        low = F.greatest(start - i * wide, F.lit(0))
        return F.substring(F.get(pieces, i), low + 1, F.least(end - i * wide, F.lit(wide)) - low)

    indexes = F.sequence((start / wide).cast("int"), ((end - 1) / wide).cast("int"))
    return F.when(end > start, F.array_join(F.transform(indexes, piece), "")).otherwise("")


def base_spans(text: Column) -> Column:
    """Spans of the known forms by start, then kind: matches first, then those that are long enough."""
    assign = F.filter(
        _found(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    # A shorter run of these characters is dropped whole, so the least length can be part of the search.
    access = _found(text, ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}+"), "access")
    hexes = _found(text, HEX.replace("+", f"{{{HEX_LEAST},}}+"), "hex")
    return F.array_sort(F.concat(assign, access, hexes))


def _alphabet(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for letters in reversed([*ALPHABETS, MIXED]):
        out = F.when(token.rlike("^[" + letters.replace("-", r"\-") + "]+$"), F.lit(letters)).otherwise(out)
    return F.when(token.rlike("^[0-9]+$"), F.lit(None)).otherwise(out)


def _normal(z: Column) -> Column:
    """The share of a normal distribution below z (Abramowitz and Stegun 26.2.17)."""

    def upper(a: Column) -> Column:
        t = 1 / (1 + 0.2316419 * a)
        poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * poly

    return F.when(z < 0, upper(-z)).otherwise(1 - upper(z))


def battery(token: Column) -> Column:
    """Length, alphabet size, the tests' p-value for random text (the least of three, times three) and the probability
    that ordinary text is as uniform. Null if no alphabet fits."""

    def of_places(x: Column) -> Column:
        v, k = x["v"], x["k"]
        n = F.size(v)
        pairs = F.zip_with(
            F.slice(v, F.lit(1), n - 1),
            F.slice(v, F.lit(2), n - 1),
            lambda a, b: F.struct(
                ((2 * a - k + 1) * (2 * b - k + 1)).cast("long").alias("product"),
                F.when((2 * a >= k) == (2 * b >= k), 0).otherwise(1).alias("change"),
            ),
        )
        sums = F.aggregate(
            pairs,
            F.struct(F.lit(0).cast("long").alias("product"), F.lit(0).alias("change")),
            lambda t, p: F.struct(
                (t["product"] + p["product"]).alias("product"), (t["change"] + p["change"]).alias("change")
            ),
        )
        return F.struct(n.alias("n"), k.alias("k"), (x["squares"] * k / n - n).alias("chi"), sums.alias("sums"))

    def of_sums(x: Column) -> Column:
        n, k, free = x["n"], x["k"], x["k"] - 1
        steps = F.sqrt((n - 1).cast("double"))
        return F.struct(
            n.alias("n"),
            k.alias("k"),
            ((x["chi"] - free) / F.sqrt(2.0 * free * (n - 1) / n)).alias("uniform"),
            F.abs(x["sums"]["product"] / ((k * k - 1) / 3.0 * steps)).alias("serial"),
            F.abs((2 * x["sums"]["change"] - (n - 1)) / steps).alias("runs"),
            F.greatest(F.lit(0.0), n * (k * F.greatest(F.lit(TEXT_REPEAT), TEXT_EXCESS / k) - 1)).alias("excess"),
            x["chi"].alias("chi"),
        )

    def of_scores(x: Column) -> Column:
        tails = F.least(1 - _normal(x["uniform"]), 2 * (1 - _normal(x["serial"])), 2 * (1 - _normal(x["runs"])))
        free = x["k"] - 1
        text = _normal((x["chi"] - free - x["excess"]) / F.sqrt(2.0 * free + 4 * x["excess"]))
        return F.struct(
            x["n"].alias("n"), x["k"].alias("k"), F.least(F.lit(1.0), 3 * tails).alias("p_random"), text.alias("p_text")
        )

    def of_alphabet(letters: Column) -> Column:
        places = F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1)
        counts = F.transform(
            F.split(letters, ""), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("long")
        )
        squares = F.aggregate(counts, F.lit(0).cast("long"), lambda t, c: t + c * c)
        given = F.struct(places.alias("v"), F.length(letters).alias("k"), squares.alias("squares"))
        return _bound(_bound(_bound(given, of_places), of_sums), of_scores)

    return _bound(_alphabet(token), lambda a: F.when(a.isNotNull(), of_alphabet(a)))


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS).cast("int"))


def _beside(text: Column, base: Column) -> Column:
    """The text with blanks in place of the base spans; places stay as they are."""

    def step(pieces: Column):
        def one(at: Column, s: Column) -> tuple[Column, Column]:
            start = F.greatest(at, s["start"])
            blanks = F.repeat(F.lit(" "), s["end"] - start)
            return F.greatest(start, s["end"]), F.array(F.concat(_part(pieces, at, start), blanks))

        return one

    last = F.array_max(F.transform(base, lambda s: s["end"]))

    def joined(pieces: Column) -> Column:
        rest = _part(pieces, last, F.length(text))
        return F.array_join(F.concat(_scan(base, "string", step(pieces)), F.array(rest)), "")

    return F.when(F.size(base) > 0, _bound(_pieces(text), joined)).otherwise(text)


def candidates(text: Column, base: Column) -> Column:
    """For each run of key characters beside the base spans, its spans: the whole run and the parts of it that are long
    enough, each once."""

    def spans(run: Column) -> Column:
        def shifted(s: Column) -> Column:
            return F.struct(
                (s["start"] + run["start"]).alias("start"),
                s["kind"].alias("kind"),
                (s["end"] + run["start"]).alias("end"),
                s["token"].alias("token"),
            )

        parts = F.concat(*(F.transform(_found(run["token"], pattern, "random"), shifted) for pattern in PARTS))
        return F.when(run["token"].rlike("[+/_-]"), _each_once(F.concat(F.array(run), parts))).otherwise(F.array(run))

    return F.transform(_bound(_beside(text, base), lambda t: _found(t, CANDIDATE, "random")), spans)


def discovery_cuts(documents: DataFrame, text: str, rate: float) -> list[int]:
    """For each band of lengths, the lowest bin of p-values that is discovered at this false-discovery rate over all
    candidates, parts of runs among them, and runs that hold a known form as well as what lies beside it; one past the
    last bin if none is. The counts are bounded by bands and bins."""
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Most texts have no run at all; the others' base spans are looked for.
    rows = documents.select(full.alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast(f"array<{SPAN}>")
    beside = F.when(F.size("base") > 0, F.flatten(candidates(F.col("text"), F.col("base")))).otherwise(none)
    every = _each_once(F.concat(F.flatten(candidates(F.col("text"), none)), beside))
    tokens = rows.select(F.explode(every).alias("s"))
    tested = tokens.select(battery(F.col("s.token")).alias("t")).where("t IS NOT NULL")
    rows = tested.groupBy(_band(F.col("t.n")).alias("band"), _bin(F.col("t.p_text")).alias("bin")).count().collect()
    cuts = []
    for band in range(32):
        counts = {r["bin"]: r["count"] for r in rows if r["band"] == band}
        total, seen, cut = sum(counts.values()), 0, LAST_BIN + 1
        for bin_ in range(LAST_BIN, -1, -1):
            seen += counts.get(bin_, 0)
            # All of a bin's p-values are at most its upper end.
            if seen and total * 10 ** (-bin_ / BINS) <= rate * seen:
                cut = bin_
        cuts.append(cut)
    return cuts


def random_spans(text: Column, base: Column, cuts: list[int], level: float) -> Column:
    """Spans of candidates that pass the battery at this level and are discovered, less those within another one of
    them. No base span overlaps them."""
    cut = F.array(*(F.lit(c) for c in cuts))

    def secret(s: Column) -> Column:
        return _bound(
            battery(s["token"]),
            lambda t: F.coalesce((t["p_random"] >= level) & (_bin(t["p_text"]) >= F.get(cut, _band(t["n"]))), F.lit(False)),
        )

    def outer(spans: Column) -> Column:
        """By start, the longest first, a span lies within an earlier one if it ends no later."""
        ordered = F.array_sort(
            spans,
            lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
        )

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            more = F.when(s["end"] > at, F.array(s)).otherwise(F.array().cast(f"array<{SPAN}>"))
            return F.greatest(at, s["end"]), more

        return _scan(ordered, SPAN, step)

    return F.flatten(F.transform(candidates(text, base), lambda run: outer(F.filter(run, secret))))


def with_spans(
    documents: DataFrame, text: str = "text", name: str = "spans", rate: float = 0.01, level: float = 0.001
) -> DataFrame:
    """Adds ``name``: all spans of a text by start, then kind, as structs of start, kind (a place in ``KINDS``), end and
    token; starts and ends are code points, the end is exclusive. Null is empty and has none."""
    cuts = discovery_cuts(documents, text, rate)
    kept = documents.columns
    full, known = F.coalesce(F.col(f"`{text}`"), F.lit("")), f"{name}_known"
    return documents.withColumn(known, base_spans(full)).select(
        *(F.col(f"`{c}`") for c in kept),
        F.array_sort(F.concat(known, random_spans(full, F.col(known), cuts, level))).alias(name),
    )


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def secret_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings: float) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row, over its whole text."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = with_spans(rows, "text", "all", **settings)

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("key").alias(key),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_digest(F.filter("all", lambda s: s["kind"] < KINDS.index("random"))), 256).alias("base_sha256"),
        _digest(F.col("all")).alias("spans"),
    )


def masked(
    documents: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]", **settings: float
) -> DataFrame:
    """The rows of ``documents``, with a mark in place of each secret; spans that overlap or touch get one mark. The
    column ``length``, if named and there, becomes the number of code points of each changed text. Other rows and
    columns stay as they are."""
    from tidework.llm.common import free_names

    (spans,) = free_names(documents, "spans")
    found = with_spans(documents, text, spans, **settings)
    whole = F.col(f"`{text}`")

    def step(pieces: Column):
        def one(at: Column, s: Column) -> tuple[Column, Column]:
            between = _part(pieces, at, F.greatest(at, s["start"]))
            first = (at == 0) & (s["start"] == 0)
            added = F.when(s["start"] > at, F.concat(between, F.lit(mark))).when(first, F.lit(mark)).otherwise(F.lit(""))
            return F.greatest(at, s["end"]), F.array(added)

        return one

    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def marked(pieces: Column) -> Column:
        rest = _part(pieces, last, F.length(whole))
        return F.array_join(F.concat(_scan(F.col(spans), "string", step(pieces)), F.array(rest)), "")

    changed = F.when(F.size(spans) > 0, _bound(_pieces(whole), marked)).otherwise(whole)
    (clean,) = free_names(found, "clean")
    found = found.withColumn(clean, changed)

    def column(name: str) -> Column:
        if name == text:
            return F.col(clean).alias(name)
        if name == length:
            kind = documents.schema[name].dataType
            return F.when(F.size(spans) > 0, F.length(clean).cast(kind)).otherwise(F.col(f"`{name}`")).alias(name)
        return F.col(f"`{name}`")

    return found.select(*(column(c) for c in documents.columns))
