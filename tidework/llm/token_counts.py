"""Counts of the tokens a byte-level byte-pair tokenizer gives a text, without making the tokens.

A text is cut into stretches of letters, digits, signs or blanks as such tokenizers do. A stretch's bytes are a
linked list of symbols; a heap gives the adjacent pair of the lowest rank, which is merged, until no pair has a
rank. The count is the number of bytes less the number of merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import worker_cache

# The endings that byte-level tokenizers of this kind cut off, and the blanks they know.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COMMON = 0x500  # below it the Unicode classes of letters and digits are old and settled
REMEMBERED = 200_000  # stretches of up to 48 characters whose count a worker keeps
CHUNK = 1 << 20  # characters that are cut into stretches at once


def _class(letter: str) -> str:
    """The code points below ``COMMON`` of a general category, as the inside of a character class."""
    found = {c for c in range(COMMON) if unicodedata.category(chr(c))[0] == letter}
    starts = sorted(c for c in found if c - 1 not in found)
    ends = sorted(c for c in found if c + 1 not in found)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def _stretches() -> re.Pattern:
    letters, digits = _class("L"), _class("N")
    return re.compile(
        f"{ENDINGS}| ?[{letters}]+| ?[{digits}]+| ?[^{BLANKS}{letters}{digits}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
    )


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in a list of symbols: the lowest rank first, then the leftmost."""
    count = len(symbols)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    rank = ranks.get
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]
    heapify(heap)
    merges = 0
    while heap:
        r, i = heappop(heap)
        j = after[i]
        # A symbol that was merged away is empty, and what stands beside it now may have another rank.
        if j >= count or rank((symbols[i], symbols[j])) != r:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        if k < count:
            before[k] = i
            if (r := rank((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h))
        merges += 1
    return merges


class Counter(dict):
    """Counts of a tokenizer file of byte-level BPE; as a dict, of the stretches seen."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        model, cutter = saved["model"], saved["pre_tokenizer"] or {}
        plain = cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True)
        odd = [t for t in saved["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        unlike = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if model["type"] != "BPE" or not plain or saved["normalizer"] or odd or any(unlike):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        # The file writes each byte as a visible sign: 33 to 126, 161 to 172 and 174 to 255 as they are, the rest from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        bytes_of = {256 + n: b for n, b in enumerate(hidden)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a.translate(bytes_of), b.translate(bytes_of)): r for r, (a, b) in enumerate(pairs)}
        names = sorted((t["content"] for t in saved["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.stretches = _stretches()
        self.rare = re.compile(f"[^\\u0000-\\u{COMMON - 1:04x}]")
        self.cut = re.compile(f"(?<=[^{BLANKS}])[{BLANKS}]")
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)

    def __missing__(self, stretch: str) -> int:
        symbols = list(stretch.encode("utf-8").decode("latin-1"))
        count = len(symbols)
        count -= merge_count(symbols, self.ranks)
        if len(stretch) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = count
        return count

    def chunks(self, text: str) -> Iterator[str]:
        """The text in bounded parts. Only a blank after a sign starts one, where every stretch ends in any text."""
        at = 0
        while len(text) - at > CHUNK and (found := self.cut.search(text, at + CHUNK)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def plain(self, text: str) -> int:
        count = 0
        for chunk in self.chunks(text):
            if self.rare.search(chunk):  # the library knows the classes of newer letters
                parts = self.library.pre_tokenize_str(chunk)
                count += sum(map(self.__getitem__, (chunk[a:b] for _, (a, b) in parts)))
            else:
                count += sum(map(self.__getitem__, self.stretches.findall(chunk)))
        return count

    def count(self, text: str) -> int:
        """The tokens of a whole text; the name of a special token in it is one token."""
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(part) for part in parts if part)


def token_counts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, path: str | None = None
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): a row for each row of ``documents``, repeated ones too.

    ``path`` is a tokenizer file of byte-level BPE, the public one of 50,257 ids by default; it must lie on every
    machine. Counts are those of the whole text. Null and empty texts have no bytes and no tokens; the key may be null
    and comes back as it is; bytes that are no UTF-8 count as the replacement sign; a table without rows gives none,
    and other columns, whatever their names, are not read. Each row is counted where it is read: nothing is shuffled.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"token counts {path}", lambda: Counter(path))
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                raw = value.as_py() or b""
                sizes.append(len(raw))
                counts.append(known.count(raw.decode("utf-8", "replace")))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
