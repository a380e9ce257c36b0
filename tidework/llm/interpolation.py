"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates from
trigrams, bigrams and single tokens, and a uniform share for the unknown. The
weights depend on how often the context was seen, in buckets of powers of two,
and are learned by expectation-maximisation on documents whose counts were held
out; the final counts are those of all training documents.

Tokens are not exploded into rows. Documents are gathered into chunks of some
megabytes; a chunk asks for the counts of its distinct n-grams, which are
summed by ranges of their hashes, and gets them back in its own order. Both
ways they travel as packed columns, about four bytes for an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import by_group, fold, saved

BITS = 52  # of the hash of two or three tokens, their number among them; single tokens keep all 64
CHUNK = 4 << 20  # bytes of text
GRAMS = 1 << 21  # n-grams summed together in a range of hashes, at most about so many
START, END = (np.uint64(xxhash.xxh3_64_intdigest(b"a " + w)) for w in (b"start", b"end"))  # no word holds a blank
TOP = 33  # largest power of two with a bucket of its own
CONTEXTS = 2 * TOP + 3


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte by byte."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpacked(data: bytes) -> np.ndarray:
    used = data[0]
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    planes = np.frombuffer(raw, np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").ravel()


class Places(dict):
    """The place of each word of a chunk, in order of appearance; the end of a text has place 0."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self) + 1
        return place


def _chunks(documents: DataFrame, key: str, text: str, training, held) -> DataFrame:
    """(chunk, held, size, keys, training, lengths, tokens, words): documents as places in the words of their chunk; its
    number of tokens is ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 24
        open_: dict[bool, list] = {}
        kind = None

        def flush(which: bool) -> pa.RecordBatch:
            nonlocal next_id
            places, rows, _ = open_.pop(which)
            words = np.array([int(END), *(xxhash.xxh3_64_intdigest(w) for w in places)], np.uint64)
            lengths = np.array([len(t) for _, _, t in rows], np.int64)
            columns = [
                pa.array([next_id]),
                pa.array([which]),
                pa.array([lengths.sum()]),
                pa.array([[k for k, _, _ in rows]], pa.list_(kind)),
                pa.array([packed(np.array([t for _, t, _ in rows], np.int64))], pa.binary()),
                pa.array([packed(lengths)], pa.binary()),
                pa.array([packed(np.concatenate([t for _, _, t in rows]))], pa.binary()),
                pa.array([packed(words)], pa.binary()),
            ]
            next_id += 1
            names = ["chunk", "held", "size", "keys", "training", "lengths", "tokens", "words"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, trains, holds, value in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                value = value.as_py() or b""
                if holds not in open_:
                    open_[holds] = [Places(), [], 0]
                entry = open_[holds]
                split = value.lower().split()
                tokens = np.zeros(len(split) + 1, np.uint32)
                tokens[:-1] = np.fromiter(map(entry[0].__getitem__, split), np.uint32, len(split))
                entry[1].append((k, trains, tokens))
                entry[2] += len(value) + 64
                if entry[2] >= CHUNK:
                    yield flush(holds)
        for holds in list(open_):
            yield flush(holds)

    rows = documents.select(
        F.col(key).alias("key"), training.alias("training"), held.alias("held"), F.col(text).cast("binary").alias("text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"chunk long, held boolean, size long, keys array<{kind}>, training binary, lengths binary, tokens binary, "
        "words binary"
    )
    return saved(rows.mapInArrow(run, schema), "chunks")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _hash(values: np.ndarray, order: int) -> np.ndarray:
    return ((values >> np.uint64(64 - BITS)) & ~np.uint64(3)) | np.uint64(order)


class Chunk:
    """The n-grams of a chunk, and for each token the places of its n-grams among them.

    First come the distinct hashes of pairs and triples in order, then those of single tokens: ``grams[:many]`` and
    ``grams[many:]``. The two are summed apart, so that the counts of single tokens rest on all 64 bits of their hashes.
    """

    def __init__(self, row: dict) -> None:
        words, tokens = unpacked(row["words"]), unpacked(row["tokens"]).astype(np.int64)
        self.training = unpacked(row["training"]).astype(bool)
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths
        hashes = words[tokens]
        before = np.empty_like(hashes)
        before[1:], before[self.first] = hashes[:-1], START
        further = np.empty_like(hashes)
        further[1:], further[self.first] = before[:-1], START
        start = _hash(np.array([START]), 0)  # no token, but the context of each text's first one
        pairs, pair = np.unique(_hash(_mix(before, hashes), 2), return_inverse=True)
        triples, triple = np.unique(_hash(_mix(_mix(further, before), hashes), 3), return_inverse=True)
        every = np.concatenate([start, pairs, triples])
        order, singles = np.argsort(every, kind="stable"), np.argsort(words, kind="stable")
        self.grams = np.concatenate([every[order], words[singles]])
        self.many = len(every)
        place = np.empty(len(self.grams), np.int64)
        place[order] = np.arange(len(every))
        place[len(every) + singles] = np.arange(len(every), len(place))
        self.start = place[0]
        self.pair = place[1 + pair]
        self.triple = place[1 + len(pairs) + triple]
        self.single = place[len(every) + tokens]

    def counts(self) -> np.ndarray:
        """How often the chunk's training documents hold each n-gram; the start counts once for each of them."""
        trains = np.repeat(self.training, self.lengths)
        n = len(self.grams)
        out = sum(np.bincount(x[trains], minlength=n) for x in (self.single, self.pair, self.triple))
        out[self.start] += self.training.sum()
        return out

    def estimates(self, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: (trigram, bigram, single) estimates, and the bucket of its context. 0 where nothing is known."""
        counts = counts.astype(float)
        c1, c2, c3 = counts[self.single], counts[self.pair], counts[self.triple]
        n2 = np.empty_like(c1)
        n2[1:], n2[self.first] = c1[:-1], counts[self.start]
        n3 = np.empty_like(c1)
        n3[1:], n3[self.first] = c2[:-1], counts[self.start]
        out = np.stack([c3 / np.maximum(n3, 1), c2 / np.maximum(n2, 1), c1 / max(total, 1)])
        bucket = np.where(n3 > 0, TOP + 2 + _power(n3), np.where(n2 > 0, 1 + _power(n2), 0))
        return out, bucket


def _power(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)), TOP).astype(np.int64)


def _alone(parts: int) -> int:
    """Ranges of single tokens: at most a third of all n-grams are some. Two at least, as a shift by 64 is none."""
    return max(2, parts // 4)


def _asked(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, held, hashes, counts): each chunk's distinct n-grams, by ranges of their hashes. The first ``parts``
    ranges are those of pairs and triples, a quarter as many after them those of single tokens."""
    shift = np.uint64(BITS - (parts.bit_length() - 1))
    alone = np.uint64(64 - (_alone(parts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row)
                counts = chunk.counts()
                single = parts + (chunk.grams[chunk.many :] >> alone).astype(np.int64)
                ranges = np.concatenate([(chunk.grams[: chunk.many] >> shift).astype(np.int64), single])
                edges = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges))
                some = ranges[edges[:-1]]
                spans = [slice(low, high) for low, high in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([row["chunk"]] * len(some), pa.int64()),
                        pa.array([row["held"]] * len(some), pa.bool_()),
                        pa.array([packed(np.diff(chunk.grams[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                        pa.array([packed(counts[s]) for s in spans], pa.binary()),
                    ],
                    ["part", "chunk", "held", "hashes", "counts"],
                )

    columns = ["chunk", "held", "training", "lengths", "tokens", "words"]
    return chunks.select(*columns).mapInArrow(run, "part long, chunk long, held boolean, hashes binary, counts binary")


def _answer(group: pa.Table, parts: int) -> dict:
    """Sums the counts of each n-gram over all chunks that hold it and hands them back to each."""
    asked = [np.cumsum(unpacked(h), dtype=np.uint64) for h in group["hashes"].to_pylist()]
    counts = np.concatenate([unpacked(c) for c in group["counts"].to_pylist()])
    sizes = [len(a) for a in asked]
    held = np.repeat(group["held"].to_numpy(), sizes)
    grams = np.concatenate(asked)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    which = np.empty(len(grams), np.int64)
    which[order] = np.cumsum(new) - 1
    every = np.bincount(which, counts).astype(np.int64)
    kept = np.bincount(which, counts * ~held).astype(np.int64)
    ends = np.cumsum(sizes)
    places = [which[e - s : e] for s, e in zip(sizes, ends)]
    count, blank = len(sizes), [b""]
    part = group["part"].to_numpy()
    singles = part[0] >= parts

    def stats(values: np.ndarray) -> np.ndarray:
        return np.append(np.zeros(count, np.int64), values.sum() * singles)

    def known(values: np.ndarray) -> np.ndarray:
        return np.append(np.zeros(count, np.int64), (values > 0).sum() * singles)

    return {
        # One more row, of no chunk, has the numbers of training tokens and of distinct ones.
        "chunk": np.append(group["chunk"].to_numpy(), -1),
        "part": np.append(part, part[0]),
        "every": pa.array([packed(every[p]) for p in places] + blank, pa.binary()),
        "kept": pa.array([packed(kept[p]) if h else b"" for p, h in zip(places, group["held"].to_pylist())] + blank, pa.binary()),
        "tokens": stats(every),
        "known": known(every),
        "kept_tokens": stats(kept),
        "kept_known": known(kept),
    }


ANSWER = "chunk long, part long, every binary, kept binary, tokens long, known long, kept_tokens long, kept_known long"


def _with_answers(chunks: DataFrame, answers: DataFrame, which: str) -> DataFrame:
    """The rows of each chunk and of the counts it asked for, to be grouped by chunk."""
    columns = ["keys", "training", "lengths", "tokens", "words"]
    asked = answers.select("chunk", "part", F.col(which).alias("counts"), *(F.lit(None).alias(c) for c in columns))
    return chunks.select("chunk", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("counts"), *columns).unionByName(asked)


def _joined(group: pa.Table) -> tuple[Chunk, np.ndarray, pa.Array]:
    parts = group["part"].to_numpy()
    order = np.argsort(parts)
    row = {c: group[c][int(order[0])].as_py() for c in ("training", "lengths", "tokens", "words")}
    keys = group["keys"].combine_chunks().slice(int(order[0]), 1).flatten()
    return Chunk(row), np.concatenate([unpacked(group["counts"][int(i)].as_py()) for i in order[1:]]), keys


CELLS = "cell long, tokens long, log3 double, log2 double, log1 double"
STEP = 64  # octaves of an estimate that have a cell of their own


def _cells(group: pa.Table, total: int) -> dict[str, np.ndarray]:
    """Held-out tokens by context bucket and octave of their estimates: how many, and the sums of the estimates' logs."""
    chunk, counts, _ = _joined(group)
    estimates, bucket = chunk.estimates(counts, total)
    logs = np.log2(np.where(estimates > 0, estimates, 1))
    octave = np.where(estimates > 0, 1 + np.clip(-logs, 0, STEP - 2), 0).astype(np.int64)
    cell = ((bucket * STEP + octave[0]) * STEP + octave[1]) * STEP + octave[2]
    cells, place = np.unique(cell, return_inverse=True)
    sums = [np.bincount(place, x, len(cells)) for x in logs]
    return {"cell": cells, "tokens": np.bincount(place), "log3": sums[0], "log2": sums[1], "log1": sums[2]}


def learn_weights(cells: np.ndarray, tokens: np.ndarray, logs: np.ndarray, known: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (buckets x 4) by expectation-maximisation over the cells of held-out tokens. A bucket without
    held-out tokens takes the weights of all buckets together."""
    octaves = np.stack([cells // STEP**2 % STEP, cells // STEP % STEP, cells % STEP])
    bucket = cells // STEP**3
    estimates = np.where(octaves > 0, 2.0 ** (logs / np.maximum(tokens, 1)), 0)
    estimates = np.vstack([estimates, np.full((1, len(cells)), 1 / (known + 1))])

    def em(of: np.ndarray, count: int) -> np.ndarray:
        weights = np.full((count, 4), 0.25)
        for _ in range(rounds):
            shares = weights[of] * estimates.T
            shares *= (tokens / shares.sum(1))[:, None]
            sums = np.stack([np.bincount(of, s, count) for s in shares.T], 1)
            weights = np.where(sums.sum(1, keepdims=True) > 0, sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), weights)
        return weights

    if not len(cells):
        return np.full((CONTEXTS, 4), 0.25)
    weights = em(bucket, CONTEXTS)
    weights[~np.isin(np.arange(CONTEXTS), bucket)] = em(np.zeros(len(cells), np.int64), 1)[0]
    # A little of the uniform share always stays, so that no text has probability zero.
    weights = weights * (1 - 1e-6) + 1e-6 * np.array([0, 0, 0, 1])
    return weights


def _scored(group: pa.Table, weights: np.ndarray, total: int, known: int) -> dict:
    chunk, counts, keys = _joined(group)
    estimates, bucket = chunk.estimates(counts, total)
    share = weights[bucket]
    known_context = np.stack([bucket >= TOP + 2, bucket >= 1, np.full(len(bucket), total > 0)], 1)
    usable = (share[:, :3] * known_context).sum(1) + share[:, 3]
    probability = ((share[:, :3].T * estimates).sum(0) + share[:, 3] / (known + 1)) / usable
    c1 = counts[chunk.single]
    log = np.log10(probability)
    base = np.log10((c1 + 1) / (total + known + 1))
    return {
        "key": keys,
        "n_tokens": chunk.lengths,
        "n_known": np.add.reduceat((c1 > 0).astype(np.int64), chunk.first),
        "base_score": np.add.reduceat(base, chunk.first),
        "score": np.add.reduceat(log, chunk.first),
    }


def interpolated_scores(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held: int = 2,
    weight_share: int = 20,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words end at ASCII blanks, ASCII letters count as small; null is empty, a
    text without words is its end alone. Rows of the held-out fold are not
    counted. One in ``weight_share`` of the others is left out of the counts
    while the weights are learned on it, and counted again for the scores.
    Equal rows get equal scores; without training rows every token has
    probability one.
    """
    spark = documents.sparkSession
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    training = fold(key, folds) != held
    chunks = _chunks(documents, key, text, training, training & (F.floor(crc / folds) % weight_share == 0))
    # A token asks for three n-grams at most, so a range stays in memory however many tokens there are.
    tokens = int(chunks.agg(F.sum("size")).first()[0] or 0)
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * tokens // GRAMS)
    parts = 1 << (ranges - 1).bit_length()
    answers = saved(by_group(_asked(chunks, parts), ["part"], lambda g: _answer(g, parts), ANSWER), "counts")
    sums = ["tokens", "known", "kept_tokens", "kept_known"]
    total, known, kept_total, kept_known = (
        int(x or 0) for x in answers.where("chunk = -1").agg(*(F.sum(c) for c in sums)).first()
    )
    answers = answers.where("chunk >= 0")
    kept = _with_answers(chunks.where("held"), answers.where("kept <> X''"), "kept")
    # Bounded by buckets and octaves, whatever the size of the corpus.
    cells = (
        by_group(kept, ["chunk"], lambda g: _cells(g, kept_total), CELLS)
        .groupBy("cell")
        .agg(*(F.sum(c).alias(c) for c in ("tokens", "log3", "log2", "log1")))
        .orderBy("cell")
        .toArrow()
    )
    weights = learn_weights(
        cells["cell"].to_numpy(), cells["tokens"].to_numpy(), np.stack([cells[c].to_numpy() for c in ("log3", "log2", "log1")]), kept_known
    )
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, n_known long, base_score double, score double"
    scored = by_group(_with_answers(chunks, answers, "every"), ["chunk"], lambda g: _scored(g, weights, total, known), schema)
    return scored.select(
        F.col("key").alias(key),
        (fold("key", folds) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
