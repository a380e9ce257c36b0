"""Each operator against plain Python on small tables, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer
import public_tokenizers

from tidework.llm import (
    embedding_dedup,
    fingerprints,
    interpolation,
    language,
    mixing,
    ngram_join,
    packing,
    quality,
    secret_scan,
    toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(key, parts):
    return zlib.crc32(("" if key is None else str(key)).encode()) % parts


def words(text):
    return (text or "").encode().lower().split()


# ---- awkward rows: every operator returns a defined row for each ----------------------

RUNS = {
    "quality": lambda d, y: quality.quality_scores(d, y, fit_rows=40),
    "toxicity": lambda d, y: toxicity.toxicity_scores(d, y, fit_positive=40, fit_unlabelled=80),
    "language": lambda d, y: language.language_ids(d),
    "interpolation": lambda d, y: interpolation.interpolated_scores(d),
    "secrets": lambda d, y: secret_scan.secret_spans(d),
    "fingerprints": lambda d, y: fingerprints.edited_fingerprints(d),
    "mixing": lambda d, y: mixing.mixture(d),
    "join": lambda d, y: ngram_join.jaccard_join(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_rows(name, awkward, labels):
    rows = RUNS[name](awkward, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in awkward.collect())
    for row in rows:
        value = row.asDict()
        assert 0 <= value.get("score", 0) <= 1 or name == "interpolation"
        assert all(v is not None for k, v in value.items() if k not in ("doc_id", "class_id", "set_id"))


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(name, nothing, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert RUNS[name](nothing, empty).count() == 0


def test_awkward_rows_are_packed(awkward, nothing):
    rows = packing.pack(awkward).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in awkward.collect())
    assert packing.pack(nothing).count() == 0


def test_stages_keep_all_columns_of_awkward_rows(awkward, nothing, labels, documents):
    for stage in (ngram_join.one_of_each, secret_scan.masked, mixing.resampled):
        assert stage(awkward).columns == awkward.columns
        assert stage(nothing).collect() == []
    model = quality.ConstantModel(0.0)
    assert quality.accepted(awkward, model, least=0.5).count() == 0
    assert quality.accepted(awkward, quality.ConstantModel(1.0)).count() == awkward.count()
    kept = ngram_join.one_of_each(awkward).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, 6, 7, 8, None, None])
    clean = {r.doc_id: r for r in secret_scan.masked(awkward, length="n_chars").collect()}
    assert clean[7].text == "é ü 漢字 🙂 [SECRET] [SECRET]!" and clean[7].n_chars == len(clean[7].text)
    assert clean[4].text is None


# ---- learned operators: held-out accuracy ----------------------------------------------


def _held(spark, run, label):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r.doc_id: r for r in run(documents, labels).collect()}
    return [(r[label], found[r.doc_id]) for r in labels.collect() if found[r.doc_id].held_out]


def test_quality_of_held_out_documents(spark):
    rows = _held(spark, lambda d, y: quality.quality_scores(d, y), "quality")
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for _, r in rows)
    assert sum(y == r.predicted for y, r in rows) >= 0.95 * len(rows)


def test_toxicity_of_held_out_documents(spark):
    rows = _held(spark, lambda d, y: toxicity.toxicity_scores(d, y), "toxic")
    assert sum(y == r.predicted for y, r in rows) >= 0.93 * len(rows)
    assert sum(r.predicted for y, r in rows if not y) <= 0.02 * len(rows)


def test_toxicity_of_each_language(spark):
    """Toxic words with many endings, none of them frequent, are learned too."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity_scores(documents, labels).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    rows = found.join(labels.where("toxic IS NOT NULL"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic]
        assert sum(toxic) >= 0.75 * len(toxic) > 0, lang
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * sum(not r.toxic for r in rows)


def test_toxicity_may_flag_nothing():
    same = np.ones(100)
    assert toxicity._cut(same, same, 0.1) > 1


def test_language_of_held_out_documents(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = [r for r in language.language_ids(documents).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_undetermined_language(awkward):
    found = {r.doc_id: r.lang_pred for r in language.language_ids(awkward).collect() if r.doc_id}
    assert {k for k, v in found.items() if v == "und"} == {3, 4, 6, 8}


# ---- language model ----------------------------------------------------------------------


def test_interpolation_counts(documents):
    rows = documents.collect()
    counts = Counter()
    for r in rows:
        if fold(r.doc_id, 7) != 2:
            counts.update([*words(r.text), None])
    total, known = sum(counts.values()), len(counts)
    for r in interpolation.interpolated_scores(documents).collect():
        tokens = [*words(next(d.text for d in rows if d.doc_id == r.doc_id)), None]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        assert r.train_tokens == total
        base = sum(math.log10((counts[t] + 1) / (total + known + 1)) for t in tokens)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_interpolation_is_better_than_its_base_and_a_distribution(documents):
    rows = [r for r in interpolation.interpolated_scores(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packed_numbers_round_trip():
    for values in ([], [0], [1, 255, 256, 1 << 40], list(range(1000))):
        assert interpolation.unpacked(interpolation.packed(np.array(values, np.int64))).tolist() == values


# ---- packing ---------------------------------------------------------------------------------


def test_packing_round_trip(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(documents, with_ids=True).collect()
    bins, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
        by_document[p.doc_id].append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for r in documents.collect():
        parts = sorted(by_document[r.doc_id], key=lambda p: p.piece)
        ids = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        assert [p.start for p in parts] == [2048 * i for i in range(len(parts))]
    assert len(bins) <= 1.02 * -(-sum(p.length for p in pieces) // 2048) + 1


def test_words_give_the_ids_of_the_whole_text():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = packing.word_tokenizer()
    for text in ["", "it's I'LL x's", "é x ́y", "<|endoftext|>z <|ENDOFTEXT|>", "ΟΔΟΣ ς İ ẞ", "a\x1cb\x85c　d", "½,, 3½! 漢字。"]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_two_small_pieces_replace_a_smaller_one():
    # Greedy fills 60 + 30 and leaves 10; 20 + 20 fill the widened gap of 40.
    lengths = np.array([60, 30, 20, 20])
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(np.bincount(bins, lengths)) == [30, 100]


def test_repacking_more_pieces_than_a_window_is_never_worse(spark, monkeypatch):
    """400 pieces of 1500 and 400 of 520 tokens fit two by two, whatever the window."""
    monkeypatch.setattr(packing, "WINDOW", 64)
    rows = [(i, "x" * (1499 if i % 2 else 519)) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    pieces = packing.pack(frame, encode=lambda t: t + t + t + t).collect()
    assert sorted(Counter(p.length for p in pieces).items()) == [(520, 400), (1500, 400)]
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for places in bins.values():
        assert sum(n for _, n in places) <= 2048
        assert [at for at, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
    assert len(bins) <= 404


# ---- secrets -----------------------------------------------------------------------------------


def test_base_spans(documents, awkward):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    for table in (documents, awkward.dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in secret_scan.secret_spans(table).collect():
            text = texts[r.doc_id]
            found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
            found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
            found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
            spans = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
            assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
            assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_random_text_is_found_and_words_are_not(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list(secret_scan.ALPHABETS[-2]))
    keys = ["".join(rng.choice(letters, 44)) for _ in range(40)]
    plain = ["internationalizationandlocalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz", "thisisanordinarysentencewithoutblanks"]
    # A pangram would be found: it uses its alphabet evenly, which is all these tests can see.
    rows = [(i, f"see {t} now") for i, t in enumerate(keys + plain * 10)]
    found = {r.doc_id: r.n_random for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] for i in range(40)) >= 34
    assert sum(found[i] for i in range(40, 80)) <= 1


def test_random_parts_of_runs_are_found(spark):
    """Keys in paths, after prefixes with other signs, in two alphabets at once, and beside a known form."""
    rng = np.random.default_rng(5)
    plain, base64 = (np.array(list(secret_scan.ALPHABETS[k])) for k in (-3, -2))
    forms = [
        ("/reset-password/{}", plain, 44),
        ("/v1/api_keys/{}", plain, 44),
        ("key-{}", base64, 60),
        ("sk_live_{}", base64, 60),
        ("0123456789abcdef01{}", np.array(list("GHJKLMNPQRSTUVWXYZghjklmnpqrstuvwxyz")), 44),
    ]
    texts, wanted = [], []
    for form, letters, n in forms:
        for _ in range(20):
            key = "".join(rng.choice(letters, n))
            texts.append(f"see {form.format(key)} now")
            wanted.append((texts[-1].index(key), texts[-1].index(key) + n))
    words = ["/the/state-of-the-art_report/about/some-other-things", "/2024/01/02/another_article-title/index-page"] * 20
    frame = spark.createDataFrame(list(enumerate(texts + words)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.secret_spans(frame).collect()}
    for k in range(0, len(texts), 20):
        hits = 0
        for i in range(k, k + 20):
            found = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("random")]
            hits += any(a <= wanted[i][0] and b >= wanted[i][1] for a, b in found)
        assert hits >= 15, (forms[k // 20][0], hits)
    assert sum("random" in spans[i] for i in range(len(texts), len(spans))) == 0


# ---- fingerprints ---------------------------------------------------------------------------


def test_fingerprints_are_sums_of_paragraphs(spark):
    rows = [("ab", "first line here\nsecond one"), ("a", "first line here"), ("b", "second one"), ("ba", "second one\nfirst line here")]
    frame = fingerprints.with_fingerprint(spark.createDataFrame(rows, "name string, text string"), "text", "print")
    found = {r.name: r["print"] for r in frame.collect()}
    assert found["ab"] == found["ba"] != found["a"]
    pair = spark.createDataFrame([(found["a"], found["b"], found["ab"])], "a array<long>, b array<long>, ab array<long>")
    row = pair.select(fingerprints.inserted(pair.a, pair.b).alias("sum"), fingerprints.deleted(pair.ab, pair.b).alias("rest")).first()
    assert row["sum"] == found["ab"] and row["rest"] == found["a"]


def test_likeness(documents):
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents).collect()}
    ordered = sorted(documents.collect(), key=lambda r: -r.doc_id)
    for r, following in zip(ordered, [*ordered[1:], ordered[0]]):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + following.text[:half]
        assert rows[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r.near_edited for r in rows.values()]) > 0.35
    assert np.mean([r.near_next for r in rows.values()]) < 0.1


# ---- mixing ---------------------------------------------------------------------------------


def test_mixture(documents):
    sizes, sources = {}, {}
    for r in documents.collect():
        sizes[r.doc_id], sources[r.doc_id] = len(WORD.findall(r.text)), r.source
    per = Counter()
    for k, n in sizes.items():
        per[sources[k]] += n
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per))}
    open_, goal, left = set(per), {}, 1.5 * sum(per.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not above:
            break
        for s in above:
            goal[s] = 2 * per[s]
            left -= goal[s]
        open_ -= above
    goal |= {s: level * weight[s] for s in open_}
    taken, largest = Counter(), Counter()
    rows = mixing.mixture(documents).collect()
    for r in rows:
        s = sources[r.doc_id]
        assert r["size"] == sizes[r.doc_id] and r.source_size == per[s] and abs(r.target - goal[s]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(documents).collect()))
    copies = Counter(r.doc_id for r in mixing.resampled(documents).collect())
    assert all(copies[r.doc_id] == r.copies for r in rows)


# ---- joins ---------------------------------------------------------------------------------------


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def _brute(texts):
    known = ngram_join.WordHashes()
    sets = {k: set(ngram_join.grams((t or "").encode(), 5, known).tolist()) for k, t in texts.items()}
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("block", [2048, 5])
def test_join_finds_all_links(spark, monkeypatch, block):
    """Also with blocks so small that groups are compared band by band and in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    texts = {}
    for group in range(6):
        base = [f"w{rng.integers(0, 10**6)}" for _ in range(60)]
        for _ in range(12 if group else 40):
            some = list(base)
            for _ in range(rng.integers(0, 3)):
                some[rng.integers(0, 60)] = f"x{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(some)
    links = _brute(texts)
    degree = Counter(x for pair in links for x in pair)
    classes = _components(texts, links)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ngram_join.jaccard_join(frame).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == {k: (degree[k], classes[k]) for k in texts}


def test_one_of_each_class_where_keys_repeat_or_are_missing(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{i}" if i >= changed else f"other{changed}" for i in range(60))

    rows = [(0, text("a")), (0, text("b")), (0, text("c")), (0, text("c", 1)), (5, text("b", 1)), (0, ""), (0, " ")]
    rows += [(None, text("d")), (None, text("d", 1)), (None, text("d")), (None, text("e")), (7, text("e", 1)), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.one_of_each(frame).collect()
    assert Counter(r.doc_id for r in kept) == {0: 5, 7: 1, None: 2}
    assert Counter(r.text.split()[-1][0] for r in kept if words(r.text)) == Counter("abcde")


def test_bands_meet_the_recall():
    for rows in (2, 4, 6):
        bands = ngram_join.band_count(0.8, rows, 0.999)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(20, 16))
        for i in range(400):
            v = centres[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.08
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(30)]
    vectors = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows}
    label_of = {k: y for k, _, y in rows}
    links = [(a, b) for a, b in combinations(vectors, 2) if label_of[a] == label_of[b] and vectors[a] @ vectors[b] >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    bad = len(rows)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0, 2.0]]
    rows += [(bad + i, v, 0) for i, v in enumerate(odd)] + [(bad + len(odd), rows[0][1], None), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    assert len(found) == len(rows)
    total = sum(degree.values())
    got = sum(found[k].n_links for k in vectors)
    assert 0.99 * total <= got <= total
    assert all(found[k].n_links <= degree[k] for k in vectors)
    assert all(found[k].n_links == 0 and found[k].kept for k in range(bad, len(rows) - 1))
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0
