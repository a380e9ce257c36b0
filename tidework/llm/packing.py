"""Best-two-fit packing of token pieces into sequences of a fixed length.

A bin is filled greedily, largest piece first. Where a gap is left, the bin's
smallest piece makes way for two unpacked pieces if they fill the widened gap
more tightly. Each task tokenizes and packs its own documents, a window of
pieces after the other, and looks up each different word of some megabytes once;
only pieces of bins that stayed ragged are gathered, those of one window of each
of a bounded number of tasks, and packed once more, all together; where that
needs no fewer bins, the first placement stays. Tokens never move: pieces are
described in a table in the work folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import ascii_lowercase
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import saved, worker_cache

if TYPE_CHECKING:
    from tokenizers import Tokenizer

RAGGED = 1 / 256  # a bin with a larger share of its length unused is packed again
WINDOW = 1 << 16  # pieces a task packs together before it has seen all
GATHERED = 16  # tasks of which one window's ragged pieces each are packed together


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; lengths from 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    held_lengths, starts = np.unique(lengths[order], return_index=True)
    # Pieces of a length that are left are a slice of the order; the last one goes first.
    low = dict(zip(held_lengths.tolist(), starts.tolist()))
    high = dict(zip(held_lengths.tolist(), [*starts[1:].tolist(), len(order)]))
    there = 0  # bit n is set if a piece of length n is left
    for n in low:
        there |= 1 << n

    def largest(limit: int) -> int:
        """The largest length left that is at most the limit, or 0."""
        return max(0, (there & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    bins = np.full(len(lengths), -1, np.int64)
    count = 0

    def take(n: int) -> int:
        nonlocal there
        high[n] -= 1
        if high[n] == low[n]:
            there &= ~(1 << n)
        return order[high[n]]

    while there:
        gap, held = capacity, []
        while n := largest(gap):
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1 and there:
            small = held[-1][0]
            room, best = gap + small, (small, 0, 0)
            n = largest(room - 1)
            while n and 2 * n > best[0]:  # two pieces of at most n each
                second = largest(min(n, room - n))
                if second == n and high[n] - low[n] < 2:
                    second = largest(n - 1)
                if second and n + second > best[0]:
                    best = (n + second, n, second)
                    if n + second == room:
                        break
                n = largest(n - 1)
            if best[1]:
                held.pop()
                high[small] += 1
                there |= 1 << small
                held += [(k, take(k)) for k in best[1:]]
        for _, i in held:
            bins[i] = count
        count += 1
    return bins


def _places(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each piece starts in its bin."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    before -= np.repeat(before[first], np.diff(np.append(first, len(order))))
    places = np.empty(len(lengths), np.int64)
    places[order] = before
    return places


# ASCII signs: a run of them at a word's end is a piece of its own if a plain letter or digit stands before it.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# The public byte alphabet of byte-level BPE: bytes with a visible sign stand for themselves, the rest from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


def _stands_alone(letter: str) -> bool:
    """Whether a letter or digit is one for the tokenizer too, so that signs behind it are a piece of their own: some
    letters are taken apart or written small as a letter and a mark, which belongs to the signs. Of those it is told
    that composing and small writing leave them as they are, in the alphabets where that is settled."""
    return (letter.isascii() and letter.isalnum()) or (letter < "\u0250" and letter.isalpha() and letter == letter.lower())


# Recent words a worker remembers, besides at most as many older ones, the longest that it remembers,
# bytes of text that are taken apart at once, words that go to the model at once, and bytes below which texts are taken
# apart one by one, as the calls for many cost more.
RECENT = 250_000
LONGEST = 48
CHUNK = 1 << 22
TOGETHER = 512
FEW = 1 << 12
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _of_joined_words(saved: dict) -> tuple[Tokenizer, np.ndarray] | None:
    """A tokenizer of many words with a blank after each, for a file whose model marks each word's last byte, and the
    ids that end a word; None for other models.

    It has the file's ids and merges, only written in bytes, with the blank for the mark. Each blank joins the byte
    before it ahead of all other merges, and nothing is ever joined behind a mark, so words stay apart.
    """
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    model = saved["model"]
    mark = model.get("end_of_word_suffix")
    unlike = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback")]
    if model["type"] != "BPE" or not mark or any(unlike):
        return None
    bytes_of = {sign: chr(b) for b, sign in _ALPHABET.items()}

    def written(token: str) -> str:
        return token.removesuffix(mark).translate(bytes_of) + " " * token.endswith(mark)

    names = {token: written(token) for token in model["vocab"]}
    vocab = {names[token]: n for token, n in model["vocab"].items()}
    signs = [chr(b) for b in range(256) if b != 32]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(names[a], names[b]) for a, b in pairs]
    whole = all(sign in vocab and sign + " " in vocab for sign in signs) and " " in vocab
    if not whole or any(" " in a or " " in b[:-1] or b == " " for a, b in merges):
        return None
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[n for token, n in vocab.items() if token[1:].endswith(" ")]] = True
    return Tokenizer(BPE(vocab, [(sign, " ") for sign in signs] + merges)), ends


class TokenBytes:
    """Words' ids as little-endian 32-bit numbers; plain letters in words are small ones.

    Words of a bounded length are remembered. When there are enough recent ones they become the older ones, which are
    forgotten with the next change unless they were met again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks have the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.joined = _of_joined_words(json.load(file))
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Each different word of all of them is looked up once."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
        ids = self.looked_up(lists.values, self.of_different)
        return _values(ids, lists.offsets.to_numpy())

    def looked_up(self, words: pa.Array, look_up: Callable[[pa.Array], pa.Array]) -> pa.Array:
        coded = words.dictionary_encode()
        return look_up(coded.dictionary).take(coded.indices)

    def of_different(self, words: pa.Array) -> pa.Array:
        """The ids of words: of those that are ASCII letters, and signs behind them or none, as their parts'."""
        front = pc.ascii_rtrim(words, _SIGNS.decode())
        lettered = pc.ascii_is_alpha(front)
        behind = pc.ascii_ltrim(words.filter(lettered), ascii_lowercase)

        def ids_by(make: Callable) -> Callable[[pa.Array], pa.Array]:
            return lambda different: pa.array(self.ids(_values(different), make), pa.binary())

        fronts = self.looked_up(front.filter(lettered), ids_by(self.of_letters))
        plain = pc.binary_join_element_wise(fronts, self.looked_up(behind, ids_by(self.of_any)), b"")
        rest = ids_by(self.of_any)(words.filter(pc.invert(lettered)))
        order = np.argsort(~lettered.to_numpy(zero_copy_only=False), kind="stable")
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return pa.concat_arrays([plain, rest]).take(pa.array(places))

    def ids(self, words: list[bytes], make: Callable[[list[bytes]], Iterable[tuple[bytes, bytes]]]) -> list[bytes]:
        """The ids of different words: those remembered, and what ``make`` makes of the others."""
        found = list(map(self.recent.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if missing:
            older = list(map(self.older.get, missing))
            learned = {w: ids for w, ids in zip(missing, older) if ids is not None}
            learned.update(make([w for w, ids in zip(missing, older) if ids is None]))
            if len(self.recent) >= RECENT:
                self.older, self.recent = self.recent, {}
            self.recent.update([item for item in learned.items() if len(item[0]) <= LONGEST])
            found = [learned[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def of_text(self, text: bytes) -> bytes:
        """The ids of one text, which may name special tokens: they are told from other words by their small letters."""
        words = [w if b"<|" in w else w.lower() for w in text.split()]
        plain = list({w for w in words if b"<|" not in w})
        known = dict(zip(plain, self.ids(plain, self.of_any)))
        return b"".join([known[w] if w in known else self.encode(w) for w in words])

    def of_any(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids; signs at a word's end are looked up by themselves if they are a piece of their own."""
        fronts = {w: front for w in words if (front := _before_signs(w))}
        parts = list({part for w, front in fronts.items() for part in (front, w[len(front) :])})
        known = dict(zip(parts, self.ids(parts, self.of_any))) if parts else {}
        letters = dict(self.of_letters([w for w in words if w not in fronts and _plain(w)]))
        for word in words:
            front = fronts.get(word)
            if front:
                yield word, known[front] + known[word[len(front) :]]
            else:
                yield word, letters[word] if word in letters else self.encode(word)

    def of_letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids. Plain small letters are left as they are by all steps before the model, so they go to
        it at once, and many together if they can: a call for each word takes longer than its merges."""
        if not self.joined:
            for word in words:
                tokens = self.model.tokenize(word.decode("latin-1").translate(_ALPHABET))
                yield word, _packed([t.id for t in tokens])
            return
        tokenizer, ends = self.joined
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            text = b" ".join([*part, b""]).decode("latin-1")
            data = _packed(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            stops = (4 * np.flatnonzero(ends[np.frombuffer(data, "<u4")]) + 4).tolist()
            yield from zip(part, [data[a:b] for a, b in zip([0, *stops], stops)], strict=True)

    def encode(self, text: bytes) -> bytes:
        return _packed(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)


def _before_signs(word: bytes) -> bytes:
    """What stands before the ASCII signs at a word's end, if they are a piece of their own; nothing otherwise."""
    body = word.rstrip(_SIGNS)
    if body and body != word and (body.isalpha() or _stands_alone(body.decode("utf-8", "replace")[-1])):
        return body
    return b""


def _plain(word: bytes) -> bool:
    """Whether a word is all letters that the steps before the model leave as they are."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


def _values(array: pa.Array, edges: np.ndarray | None = None) -> list[bytes]:
    """The values of a binary array without nulls; with edges, those from one edge to the next joined."""
    _, offsets, data = array.buffers()
    stops = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    stops = (stops if edges is None else stops[edges]).tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(stops, stops[1:])]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``CHUNK`` bytes that end at a blank."""
    at = 0
    while len(text) - at > CHUNK and (blank := _BLANK.search(text, at + CHUNK)):
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def texts_tokenizer(path: str | None = None) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of whole texts as bytes, for tokenizers that write letters small, drop white space and join nothing across
    it or between letters and signs: each word of a text is looked up, which gives the ids of the whole text."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def encode(texts: list[bytes]) -> list[bytes]:
        known = worker_cache(f"tokens {path}", lambda: TokenBytes(path))
        out = [b""] * len(texts)
        held: list[int] = []
        size = 0
        for n, text in enumerate(texts):
            if b"<|" in text:
                out[n] = b"".join(map(known.of_text, _chunks(text)))
            elif len(text) > CHUNK:
                out[n] = b"".join([known.of_texts([part])[0] for part in _chunks(text)])
            else:
                held.append(n)
                size += len(text)
            if held and (size >= CHUNK or n + 1 == len(texts)):
                part = [texts[i] for i in held]
                for i, ids in zip(held, map(known.of_text, part) if size < FEW else known.of_texts(part)):
                    out[i] = ids
                held, size = [], 0
        return out

    return encode


def word_tokenizer(path: str | None = None) -> Callable[[bytes], bytes]:
    """The same for one text."""
    encode = texts_tokenizer(path)
    return lambda text: encode([text])[0]


COLUMNS = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    encode: Callable[[bytes], bytes] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row for each piece of each row of
    ``documents``. A document is its ids and ``end_id``; longer ones are cut into pieces of ``capacity``, and the rest
    is a piece too. Null and empty texts are the end id alone. Offsets in a sequence have no gaps. ``with_ids`` adds
    each piece's ids, which then go through the shuffle too.
    """
    every = (lambda texts: map(encode, texts)) if encode else texts_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    wide = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        kept: list[tuple] = []
        first = windows = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, windows
            key_, piece, start, length, crc, ids = zip(*kept)
            length = np.array(length, np.int64)
            bins = best_two_fit(length, capacity)
            fill = np.bincount(bins, length)
            ragged = (fill < capacity * (1 - RAGGED))[bins]
            # Bins of a task have numbers of its own; ragged ones get new numbers from the task that gathers them.
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(key_, key_type),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array((task << 32) + first + bins),
                    pa.array(_places(length, bins)),
                    pa.array(np.where(ragged, (windows << 32) + task // GATHERED, -1)),
                    pa.array(ids, pa.binary()),
                ],
                names,
            )
            first += len(fill)
            windows += 1
            kept.clear()
            return out

        key_type = None
        def cut_up(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
            for (k, _), ids in zip(texts, every([t for _, t in texts])):
                ids += end
                for n, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    kept.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                if len(kept) >= WINDOW:
                    yield flush()

        for batch in batches:
            key_type = batch.schema.field(0).type
            texts, size = [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append((k, value.as_py() or b""))
                size += len(texts[-1][1])
                if size >= CHUNK:
                    yield from cut_up(texts)
                    texts, size = [], 0
            if texts:
                yield from cut_up(texts)
        if kept:
            yield flush()

    def again(pieces: pd.DataFrame) -> pd.DataFrame:
        group = int(pieces["group"].iloc[0])
        pieces = pieces.sort_values(["length", "ids_crc32", "start"], kind="stable").reset_index(drop=True)
        # The group's pieces are here already, so all are packed together: large ones meet small ones at any size.
        length = pieces["length"].to_numpy()
        bins = best_two_fit(length, capacity)
        if bins.max() + 1 < pieces["sequence_id"].nunique():
            # A new number below zero: no group has as many bins as that leaves room for.
            pieces["sequence_id"] = -1 - (((group >> 32) << 43) + ((group & (1 << 32) - 1) << 22) + bins)
            pieces["offset"] = _places(length, bins)
        return pieces

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    names = ["key", *COLUMNS, "group", "ids"]
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
        "group long, ids binary"
    )
    placed = saved(rows.mapInArrow(cut, schema), "pieces")
    ragged = placed.where("group >= 0").groupBy("group").applyInPandas(again, schema)
    packed = placed.where("group < 0").unionByName(ragged)
    ids = [F.col("ids")] if with_ids else []
    return packed.select(F.col("key").alias(key), *COLUMNS, *ids)
