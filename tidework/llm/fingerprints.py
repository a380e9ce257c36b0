"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is a vector of 60-bit words, the sum modulo 2**60 of the vectors
of the text's paragraphs. Sums don't know an order, so texts with the same
paragraphs have the same fingerprint, and a paragraph is inserted or deleted by
adding or subtracting its vector.

A paragraph's vector has a part that is hashed from the paragraph as a whole,
for equality, and a part that is a sum over its runs of some words: each run
adds its hash bits to 240 counters, three to a word. Centred, the counters are
a random projection of the runs, so the cosine of two fingerprints estimates
what share of their runs two texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.llm.common import BLANK, WORD
from tidework.operators.frequent import frequent_keys
from tidework.operators.running import place_in

HASHES = 4  # words hashed from a paragraph, or bits of a run, by one SHA-256
LANE = 20  # bits of a counter, which is right while no text repeats one run more than half a million times
MASK = (1 << 60) - 1
ONES = 1 | 1 << LANE | 1 << 2 * LANE
# A run ends behind a word that ends in one of these letters, at a paragraph's end, or after 24 words: where it ends
# depends on its own words only, so a word that is added or lost changes the runs beside it and no others.
LAST = "lL.!?"
RUNS = rf"(?:[^{BLANK}]*[^{BLANK}{LAST}][\x20\x09]+){{0,23}}{WORD}[\x20\x09]*"
SAMPLED = 32  # rows of the sample for each range that rows are laid out by


def _words(hashes: Column) -> Column:
    """Four 60-bit numbers of each SHA-256 in hexadecimal."""
    return F.transform(
        hashes,
        lambda x: F.array(*(F.conv(F.substring(x, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(HASHES))),
    )


def _sum(column: str, k: int, shift: int | None = None) -> Column:
    def add(total: Column, words: Column) -> Column:
        word = words[k]
        if shift is not None:
            word = F.shiftright(word, shift).bitwiseAND(F.lit(ONES))
        return (total + word).bitwiseAND(F.lit(MASK))

    return F.aggregate(F.col(column), F.lit(0).cast("long"), add)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, the fingerprint of ``text`` as an array of longs, and keeps all other columns. Text isn't null."""
    kept = df.columns
    return (
        df.withColumns(
            {
                f"{name}_p": F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256)),
                f"{name}_r": F.transform(F.regexp_extract_all(text, F.lit(RUNS), 0), lambda r: F.sha2(r, 256)),
            }
        )
        .withColumns({f"{name}_p": _words(F.col(f"{name}_p")), f"{name}_r": _words(F.col(f"{name}_r"))})
        .select(
            *kept,
            F.array(
                F.size(f"{name}_p").cast("long"),
                F.size(f"{name}_r").cast("long"),
                *(_sum(f"{name}_p", k) for k in range(HASHES)),
                *(_sum(f"{name}_r", k, s) for k in range(HASHES) for s in range(LANE)),
            ).alias(name),
        )
    )


def inserted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint of a text with further paragraphs, of which the second argument is the fingerprint."""
    return F.zip_with(fingerprint, paragraphs, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def deleted(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint of a text without some of its paragraphs."""
    return F.zip_with(fingerprint, paragraphs, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def _counters(fingerprint: Column) -> Column:
    """The centred counters: runs with a bit clear less runs with it set, modulo 2**20 around zero."""
    runs, half = fingerprint[1], 1 << (LANE - 1)

    def centred(word: Column, place: int) -> Column:
        count = F.shiftright(word, LANE * place).bitwiseAND(F.lit((1 << LANE) - 1))
        return (runs - 2 * count + half).bitwiseAND(F.lit((1 << LANE) - 1)) - half

    words = F.slice(fingerprint, 3 + HASHES, HASHES * LANE)
    return F.flatten(F.transform(words, lambda w: F.array(*(centred(w, i) for i in range(3)))))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)


def _likeness(a: str, b: str, a_prints: str, b_prints: str) -> Column:
    """1 for equal fingerprints, else the cosine of their counters, 0 at least."""
    norm = F.sqrt(F.col(f"{a}_n").cast("double") * F.col(f"{b}_n").cast("double"))
    cosine = F.when(norm > 0, _dot(a, b).cast("double") / norm).otherwise(0.0)
    return F.when(F.col(a_prints) == F.col(b_prints), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _text_of(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _limits(rows: DataFrame, parts: int) -> Column | None:
    """The sorted places at which ranges of the rows begin, less than twice ``parts``, from a sample of a bounded number
    of rows; None without any. They are one constant, which is the same wherever it is used."""
    count = rows.count()
    if parts < 2 or not count:
        return None
    sample = rows.where(F.rand(5) < min(1.0, SAMPLED * parts / count)).select("place")
    places = sample.agg(F.array_sort(F.array_agg("place")).alias("all"))
    step = F.greatest(F.lit(1), F.floor(F.size("all") / parts)).cast("int")
    some = places.select(F.array_distinct(F.filter("all", lambda _, i: (i > 0) & (i % step == 0)))).first()[0]

    fields = rows.schema["place"].dataType.fields

    def value(v, kind: str) -> str:
        text = "NULL" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({text} AS {kind})"

    structs = (
        "struct(" + ", ".join(f"{value(p[f.name], f.dataType.simpleString())} AS {f.name}" for f in fields) + ")" for p in some
    )
    return F.expr(f"array({', '.join(structs)})") if some else None


def _neighbours(rows: DataFrame) -> DataFrame:
    """(id, text, mine, next_text, next) of all rows, the fingerprint ``mine`` of each and its next one's, in descending
    order of ``place``; after the last comes the first.

    Rows are laid out by ranges of the place, so a text moves once; the first row of each range is copied to the end of
    the range before, as a table of these rows says, which has no more rows than there are ranges.
    """
    spark = rows.sparkSession
    limits = _limits(rows.select("place"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if limits is None:
        ranged = rows.withColumn("range", F.lit(0))
    else:
        ranged = rows.withColumn("range", place_in(limits, F.col("place")))
    heads = sorted(ranged.groupBy("range").agg(F.max("place").alias("head")).collect(), reverse=True)
    kind = T.StructType(
        [T.StructField("head", rows.schema["place"].dataType), T.StructField("before", T.IntegerType())]
    )
    heads = spark.createDataFrame([(tuple(row.head), heads[n - 1].range) for n, row in enumerate(heads)], kind)
    printed = with_fingerprint(ranged, "text", "mine")
    first = printed.join(F.broadcast(heads), printed["place"] == heads["head"], "left")
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    copied = F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    at = F.explode(F.when(F.col("before").isNotNull(), F.array(own, copied)).otherwise(F.array(own))).alias("at")
    placed = first.select("id", "text", "times", "mine", "place", at)
    order = "PARTITION BY at.range ORDER BY at.copy, place DESC"
    follow = placed.select(
        "*", F.expr(f"lead(text) OVER ({order})").alias("next_text"), F.expr(f"lead(mine) OVER ({order})").alias("next")
    )
    return follow.where("NOT at.copy").select("id", "text", "times", "mine", "next_text", "next")


def edited_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's text with its last half replaced by the
    beginning of the next row's, in descending order of the key; rows of one key
    are ordered by hashes of their text, null keys come last, and after the last
    row comes the first. Null texts are empty. A single row is its own next one.
    Rows with equal key and text follow each other; where they are very many they
    are counted before anything is shuffled. A table without rows gives none;
    other columns, whatever their names, are not read.
    """
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = F.col("id").isNotNull().alias("known")
    rows = rows.select(
        "*", F.struct(known, "id", F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("place")
    )
    equal = frequent_keys(rows.select(F.xxhash64("place").alias("__key"))).collect()
    if equal:
        many = rows.sparkSession.createDataFrame([(r["__key"],) for r in equal], "many long")
        met = rows.withColumn("many", F.xxhash64("place")).join(F.broadcast(many), "many", "left_semi")
        counted = met.groupBy("place").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("times"))
        others = rows.withColumn("many", F.xxhash64("place")).join(F.broadcast(many), "many", "left_anti")
        rows = others.select("id", "text", "place", F.lit(1).cast("long").alias("times")).unionByName(counted)
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    follow = _neighbours(rows)
    if equal:
        # All but the last of equal rows are followed by an equal one.
        same = follow.where("times > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 2) div 1024"))).alias("part"))
        few = F.least(F.lit(1024), F.col("times") - 1 - F.col("part") * 1024).cast("int")
        same = same.select("id", "text", "times", "mine", "text", "mine", F.explode(F.sequence(F.lit(1), few)))
        same = same.drop("col").toDF("id", "text", "times", "mine", "next_text", "next")
        follow = follow.unionByName(same)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = follow.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "mine", "next")
    rows = with_fingerprint(rows, "edited", "theirs")
    rows = rows.withColumns({f"{c}_c": _counters(F.col(c)) for c in ("mine", "next", "theirs")})
    rows = rows.withColumns({f"{c}_c_n": _dot(f"{c}_c", f"{c}_c") for c in ("mine", "next", "theirs")})
    return rows.select(
        F.col("id").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _text_of("mine").alias("fingerprint"),
        _text_of("theirs").alias("edited_fingerprint"),
        _likeness("mine_c", "theirs_c", "mine", "theirs").alias("near_edited"),
        _likeness("mine_c", "next_c", "mine", "next").alias("near_next"),
    )


def sql(key: str = "doc_id", table: str = "documents") -> str:
    """The same as :func:`edited_fingerprints` in DuckDB's SQL, for distinct keys."""

    def words(of: str) -> str:
        parts = ", ".join(f"('0x' || substring(sha256(x), {1 + 15 * k}, 15))::BIGINT" for k in range(HASHES))
        return f"list_transform({of}, lambda x: [{parts}])"

    def counters(v: str) -> str:
        half, full = 1 << (LANE - 1), 1 << LANE
        lanes = ", ".join(f"((({v}[2] - 2 * ((w >> {LANE * i}) & {full - 1}) + {half}) & {full - 1}) - {half})" for i in range(3))
        return f"flatten(list_transform({v}[{3 + HASHES}:], lambda w: [{lanes}]))"

    def total(of: str, word: str) -> str:
        return f"(coalesce(list_sum(list_transform({of}, lambda x: {word})), 0) % {MASK + 1})::BIGINT"

    def print_(text: str) -> str:
        p, r = words(f"string_split({text}, chr(10))"), words(f"regexp_extract_all({text}, '{RUNS}')")
        runs = (
            f"list_transform(range({HASHES * LANE}), lambda i: "
            + total("r", f"(x[i // {LANE} + 1] >> (i % {LANE})::BIGINT) & {ONES}")
            + ")"
        )
        whole = ", ".join(total("p", f"x[{k + 1}]") for k in range(HASHES))
        return f"(SELECT list_concat([len(p), len(r), {whole}], {runs}) FROM (SELECT {p} AS p, {r} AS r))"

    hexed = "array_to_string(list_transform({}, lambda x: printf('%015x', x)), '')"
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))::BIGINT"

    def likeness(a: str, b: str) -> str:
        norm = f"sqrt({dot.format(f'{a}_c', f'{a}_c')}::DOUBLE * {dot.format(f'{b}_c', f'{b}_c')}::DOUBLE)"
        cosine = f"greatest(0.0, least(1.0, {dot.format(f'{a}_c', f'{b}_c')}::DOUBLE / {norm}))"
        return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {norm} > 0 THEN {cosine} ELSE 0.0 END)::DOUBLE"

    return f"""
WITH d AS (SELECT {key} AS id, coalesce(text, '') AS t FROM {table}),
o AS (SELECT id, t, coalesce(lead(t) OVER (ORDER BY id DESC), first_value(t) OVER (ORDER BY id DESC)) AS nt FROM d),
e AS (SELECT id, t, nt, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) AS et FROM o),
f AS (SELECT id, t, et, {print_('t')} AS mine, {print_('nt')} AS next, {print_('et')} AS theirs FROM e),
c AS (SELECT *, {counters('mine')} AS mine_c, {counters('next')} AS next_c, {counters('theirs')} AS theirs_c FROM f)
SELECT id AS {key}, length(t)::BIGINT AS n_chars, sha256(et) AS edited_sha256, {hexed.format('mine')} AS fingerprint,
  {hexed.format('theirs')} AS edited_fingerprint, {likeness('mine', 'theirs')} AS near_edited,
  {likeness('mine', 'next')} AS near_next
FROM c
"""
