"""Byte-level BPE, encoding and decoding, by contiguous arrays of ranks.

A word is an array of parts and one of the ranks of its neighbouring parts, both contiguous. The least rank is searched
(the first of equal ones), its boundary deleted from both arrays, and the ranks beside it looked up anew, until no pair
has a rank. Words of a few bytes are worked on together as the rows of a matrix, which loses one column with every
boundary; a long word is one array, of which all boundaries of the least rank go at once, so its rounds are bounded by
the vocabulary and not by its length. That gives the same as one after the other since every merge of a part has a later
rank than the merge that makes it, which is checked when the vocabulary is read. Words that came before are remembered.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table
from tabulens.llm.tokens import public_path

#: Fixed value: the pattern that cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the longest word that is a row of a matrix.
SHORT = 64
#: Words, and tokens of theirs, that a worker remembers before it starts anew.
REMEMBERED, POOL = 400_000, 4_000_000
#: Characters of text that are worked on together.
TOGETHER = 1_000_000
NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else one from U+0100 on, in turn."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
    return [others.get(b, chr(b)) for b in range(256)]


@lru_cache(maxsize=1)
def newer_letters() -> re.Pattern:
    """Letters and digits of a later Unicode than that of the standard library and the tokenizers: no letters to them."""
    every = "".join(map(chr, range(0x80, 0x110000)))
    late = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    opens = [c for c, before in zip(late, [-1, *late]) if c != before + 1]
    closes = [c for c, after in zip(late, [*late[1:], -1]) if c != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(opens, closes)) + "]" if late else r"(?!)")


class ByteBPE:
    """A vocabulary file of byte-level BPE; special strings in a text are tokens, or plain text if ``plain``."""

    def __init__(self, path: str, plain: bool = False) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        extras = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if model["type"] != "BPE" or spec["normalizer"] or any(extras) or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or words around them are not handled")
        vocabulary = model["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in byte_characters()], np.int32)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.raw = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in vocabulary.items()}
        self.raw |= {t["id"]: t["content"].encode() for t in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocabulary[m[k]] for m in merges], np.int64) for k in (0, 1))
        #: What the merge of each rank makes.
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        latest = np.full(max(self.raw) + 1, -1)
        np.maximum.at(latest, self.made, np.arange(len(merges)))
        if np.any(np.maximum(latest[left], latest[right]) >= np.arange(len(merges))):
            raise ValueError("a merge comes before one that makes its part")
        self.shift = np.int64(max(self.raw) + 1)
        keys = left * self.shift + right
        self.ranks = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.ranks]
        self.words = regex.compile(WORDS)
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special and not plain else None
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.forget()

    def forget(self) -> None:
        """Words are numbers; ``pool[first[i]:first[i + 1]]`` are the tokens of word i."""
        self.known: dict[str, int] = {}
        self.pool, self.first = array("i"), array("q", [0])
        if self.special:
            for content, i in self.special_ids.items():
                self.known[content] = len(self.known)
                self.pool.append(i)
                self.first.append(len(self.pool))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of parts; a part below 0 is none."""
        keys = left.astype(np.int64) * self.shift + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.ranks[at], NONE)

    def merged_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their final parts) of a matrix of words, filled up with -1 at the end of its rows; all rows, in turns."""
        rows, ranks = np.arange(len(parts)), self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            live = best < NONE
            if not live.all():
                yield rows[~live], parts[~live]
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
            n, width = parts.shape
            each = np.arange(n)
            parts[each, at] = self.made[best]
            stay = np.ones(parts.shape, bool)
            stay[each, at + 1] = False
            parts = parts[stay].reshape(n, width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(n, width - 2)
            for place in (at - 1, at):
                there = np.flatnonzero((place >= 0) & (place < width - 2))
                p = place[there]
                ranks[there, p] = self.rank(parts[there, p], parts[there, p + 1])

    def merged_long(self, parts: np.ndarray) -> np.ndarray:
        """The final parts of one word of any length."""
        ranks = self.rank(parts[:-1], parts[1:])
        while len(ranks) and (best := ranks.min()) < NONE:
            at = np.flatnonzero(ranks == best)
            # Of a run of equal parts, every other boundary goes, from the left.
            opens = np.diff(at, prepend=-2) != 1
            start = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            parts[at] = self.made[best]
            parts, ranks = np.delete(parts, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            around = np.unique(np.concatenate([at - 1, at]))
            around = around[(around >= 0) & (around < len(ranks))]
            ranks[around] = self.rank(parts[around], parts[around + 1])
        return parts

    def learn(self, words: Iterable[str]) -> None:
        """The tokens of words that are not known."""
        written = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        written.sort(key=lambda x: len(x[1]))
        lengths = np.fromiter((len(b) for _, b in written), np.int64, len(written))
        ids = self.byte_ids[np.frombuffer(b"".join(b for _, b in written), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        kind = np.where(lengths <= SHORT, (lengths + 3) // 4, SHORT + np.arange(len(lengths)))  # a matrix, or a word
        cuts = np.flatnonzero(np.diff(kind, prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:]):
            some, width = ids[starts[low] : starts[high - 1] + lengths[high - 1]], lengths[high - 1]
            if width > SHORT:
                self.keep([written[low][0]], self.merged_long(some), np.array([0]))
                continue
            filled = np.arange(width) < lengths[low:high, None]
            parts = np.full(filled.shape, -1, np.int32)
            parts[filled] = some
            for rows, done in self.merged_rows(parts):
                there = done >= 0
                sizes = there.sum(axis=1)
                self.keep([written[low + r][0] for r in rows], done[there], np.cumsum(sizes) - sizes)

    def keep(self, words: list[str], tokens: np.ndarray, starts: np.ndarray) -> None:
        base = len(self.pool)
        self.known.update(zip(words, range(len(self.first) - 1, len(self.first) - 1 + len(words))))
        self.pool.frombytes(np.ascontiguousarray(tokens, np.int32).tobytes())
        self.first.pop()
        self.first.frombytes((starts + base).astype(np.int64).tobytes())
        self.first.append(len(self.pool))

    def cut(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if not text.isascii() and newer_letters().search(text):
            seen = newer_letters().sub("͸", text)  # never a letter, one character for one
            return [text[m.start() : m.end()] for m in self.words.finditer(seen)]
        return self.words.findall(text)

    def stretches(self, text: str, size: int) -> Iterator[str]:
        """A long text in parts; white space after something else always begins a word."""
        low = 0
        while len(text) - low > size:
            found = regex.compile(r"(?<=\S)\s").search(text, low + size)
            if found is None:
                break
            yield text[low : found.start()]
            low = found.start()
        yield text[low:]

    def words_in(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.cut(part))]

    def encode(self, texts: Sequence[str | None], size: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in one array, and the number of each text's; nulls have none."""
        sizes, out = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        which, lot, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            # A special string could cross a cut, so a text that holds one is not cut.
            for part in self.stretches(text, size) if len(text) > size and not (self.special and self.special.search(text)) else (text,):
                which.append(i)
                lot.append(part)
                held += len(part)
                if held >= size:
                    out.append(self._tokens(which, lot, sizes))
                    which, lot, held = [], [], 0
        out.append(self._tokens(which, lot, sizes))
        return np.concatenate(out), sizes

    def _tokens(self, which: list[int], parts: list[str], sizes: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED or len(self.pool) > POOL:
            self.forget()
        words = [self.words_in(p) for p in parts]
        flat = list(chain.from_iterable(words))
        if not flat:
            return np.empty(0, np.int32)
        self.learn(set(flat) - self.known.keys())
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        pool, first = np.frombuffer(self.pool, np.int32), np.frombuffer(self.first, np.int64)
        start, length = first[number], first[number + 1] - first[number]
        ends = np.cumsum(length)
        tokens = pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        np.add.at(sizes, which, np.diff(np.concatenate([[0], ends])[last], prepend=0))
        return tokens

    def decode(self, ids: Iterable[int | None]) -> str:
        """The text of tokens; what is no UTF-8 becomes U+FFFD, ids that are none are left out."""
        return b"".join([self.raw.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary_of(path: str, plain: bool = False) -> ByteBPE:
    return ByteBPE(path, plain)


def lists_of(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def parts_of(texts: pa.Array, size: int = TOGETHER) -> Iterator[pa.Array]:
    """A batch of texts in parts of about so many characters, one text at least."""
    lot = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // size
    cuts = np.flatnonzero(np.diff(lot, prepend=-1, append=-1)) if len(lot) else []
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(low, high - low)


def encode(
    docs: DataFrame, path: str, text: str = "text", out: str = "token_ids", decoded: str | None = None, plain: bool = False
) -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): array<int>, the tokens of the whole text.

    Null and empty texts have no tokens; repeated rows, keys of any kind and other columns are left as they are; no rows
    give no rows. Equal ranks merge from the left. Special strings inside texts are tokens, with ``plain`` they are text.
    With ``decoded``, a column of that name holds the text that the tokens decode to.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = vocabulary_of(path, plain)
        for batch in batches:
            found, back = [], []
            for texts in parts_of(batch):
                ids, sizes = vocabulary.encode(texts.to_pylist())
                found.append((ids, sizes))
                if decoded:
                    back += map(vocabulary.decode, (x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])))
            flat, sizes = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            texts = pa.array(back, pa.string()) if decoded else pa.nulls(len(batch), pa.string())
            yield pa.StructArray.from_arrays([lists_of(flat, sizes), texts], names=["ids", "decoded"])

    done = docs.withColumn(out, run(F.col(quoted(text))))
    if decoded:
        done = done.withColumn(decoded, F.col(quoted(out))["decoded"])
    return done.withColumn(out, F.col(quoted(out))["ids"])


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): the text of the tokens.

    Null and empty arrays give the empty text; null tokens and numbers that are no token are left out.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            yield pa.array([vocabulary.decode(x or ()) for x in batch.to_pylist()], pa.string())

    return docs.withColumn(out, run(F.col(quoted(ids))))


def op11_bpe_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, public_path("byte_bpe_50k.json"), decoded="decoded")
    return done.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
