"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the lattice of pieces.

The lattice of a text has an edge for every piece that matches at a place, and one of byte tokens for every character
that no piece is. Forward, the weights of all paths to each place are added up; backward from the end, an edge is drawn
by its share of that sum, so a segmentation comes with exactly its probability. No piece holds a space after another
character, so the lattice falls apart into words, whose sums are kept for when they come again. The random numbers come
from a generator seeded by the row's key, so a row is segmented alike in every run, wherever it is worked on.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import GOLDEN, mixed, quoted, table
from tabulens.llm.tokens import SPACE, public_path

#: How sharp the choice is: weights are probabilities to this power; 0 makes all segmentations alike.
THETA = 1.0
SEED = 29
#: Places that a task remembers before it starts anew, and the characters of the longest words among them.
REMEMBERED, LONG = 400_000, 32
#: Characters that are worked on together.
TOGETHER = 1_000_000
FEW = 24
TINY = 1e-200
MASK = 0xFFFFFFFFFFFFFFFF



class PieceTexts:
    """What the tokens of a model file stand for, to decode them; the file is read through the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())

    def decode(self, ids: Sequence[int]) -> str:
        """The text, without the leading space: the very text that was encoded."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


class PieceLattice(PieceTexts):
    """The pieces of a model with their weights, for encoding by sampling.

    A unigram model's scores are log probabilities. A BPE model's scores only order its merges, so a piece's probability
    is taken by its rank there, as one over rank and ``FEW``: common pieces come early. Nothing is trained.
    """

    def __init__(self, path: str, theta: float = THETA) -> None:
        super().__init__(path)
        scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        if len(self.bytes) != 256 or any(SPACE in p.lstrip(SPACE) or " " in p for p in self.ids):
            raise ValueError("the model lacks byte tokens or has spaces inside pieces")
        ranked = sorted(self.ids, key=lambda p: -scores[p])
        total = sum(1 / (FEW + r) for r in range(len(ranked) + 1))
        # Pieces and their ends, as they stand in a text; an end that is no piece has no id.
        self.table: dict[str, tuple[int, float]] = {}
        for rank, piece in enumerate(ranked):
            written = piece.replace(SPACE, " ")
            for start in range(1, len(written)):
                self.table.setdefault(written[start:], (-1, 0.0))
            self.table[written] = (self.ids[piece], (1 / ((FEW + rank) * total)) ** theta)
        self.longest = max(map(len, self.ids))
        self.forget()
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids if len(p) > 1))
        # A space that the text itself holds as the space's sign is not a space: it stands apart, as bytes.
        apart = re.escape(alone) + "\0" + SPACE
        self.words = re.compile(f"[{apart}]| *[^ {apart}]+| +", re.S)

    def forget(self) -> None:
        """Places are numbers; 0 is a word's start. ``first[i]:first[i + 1]`` are the edges that end at place i."""
        self.known: dict[str, int] = {"": 0}
        self.mass, self.first = array("d", [1.0]), array("q", [0, 0])
        # Of each edge: running share of the weight at its end, the place it comes from, its token.
        self.share, self.source, self.token = array("d"), array("q"), array("i")

    def grow(self, word: str, places: list[int]) -> None:
        """Adds the places of a word after those given, each from the places before it."""
        table, masses, longest = self.table.get, self.mass, self.longest
        add_source, add_share, add_token = self.source.append, self.share.append, self.token.append
        for end in range(len(places), len(word) + 1):
            start, least, mass, found = end, max(0, end - longest), 0.0, []
            while start > least:
                start -= 1
                entry = table(word[start:end])
                if entry is None:
                    break
                token, weight = entry
                if token >= 0:
                    source = places[start]
                    add_source(source)
                    add_token(token)
                    mass += masses[source] * weight
                    found.append(mass)
            if not found:
                # Of no piece, so all paths come by here: a place for each of its bytes, at no cost.
                at = places[-1]
                for b in word[end - 1].encode("utf-8", "surrogatepass"):
                    add_source(at)
                    add_token(self.bytes[b])
                    add_share(1.0)
                    masses.append(masses[places[-1]])
                    self.first.append(len(self.token))
                    at = len(masses) - 1
            else:
                for so_far in found:
                    add_share(so_far / mass)
                masses.append(mass)
                self.first.append(len(self.token))
                at = len(masses) - 1
            places.append(at)
            if masses[at] < TINY:  # only shares count: copies of what is still open go on in a smaller unit
                for i in range(max(0, end - longest), end + 1):
                    places[i] = self.scaled(places[i])

    def scaled(self, place: int) -> int:
        for edge in range(self.first[place], self.first[place + 1]):
            self.source.append(self.source[edge])
            self.share.append(self.share[edge])
            self.token.append(self.token[edge])
        self.mass.append(self.mass[place] / TINY)
        self.first.append(len(self.token))
        return len(self.mass) - 1

    def word(self, word: str) -> int:
        """The last place of a word. What depends on a beginning alone is shared by the words that begin so."""
        known, end = self.known, len(word) - 1
        if end >= LONG:
            places = [0]
            self.grow(word, places)
            return places[-1]
        while word[:end] not in known:
            end -= 1
        places = [known[word[:i]] for i in range(end + 1)]
        self.grow(word, places)
        for i in range(end + 1, len(word) + 1):
            known[word[:i]] = places[i]
        return places[-1]

    def sample(self, texts: Sequence[str | None], keys: Sequence[object], seed: int = SEED) -> list[np.ndarray]:
        """For each text, the token ids of one segmentation of it after a leading space, drawn by ``seed`` and its key."""
        if len(self.mass) >= REMEMBERED:
            self.forget()
        words = [self.words.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = [self.known.get(w) for w in flat]
        for i, at in enumerate(last):
            if at is None:
                last[i] = self.known.get(flat[i]) or self.word(flat[i])
        seeds = [int.from_bytes(hashlib.blake2b(repr((seed, k)).encode(), digest_size=8).digest(), "little") for k in keys]
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        number = (np.arange(len(flat)) - starts).astype(np.uint64)
        luck = mixed(np.repeat(np.array(seeds, np.uint64), lengths) + number * GOLDEN)
        rounds = self.drawn(np.array(last, np.int64), luck)
        sizes = np.zeros(len(flat), np.int64)
        for which, _ in rounds:
            sizes[which] += 1
        ends = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), np.int32)
        for n, (which, tokens) in enumerate(rounds):
            out[ends[which] - 1 - n] = tokens
        cuts = np.concatenate([[0], ends])[np.cumsum(lengths)]
        return np.split(out, cuts[:-1]) if len(cuts) else []

    def drawn(self, at: np.ndarray, luck: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Backward from the last place of every word, one edge a round: (words not yet at their start, their tokens)."""
        first, share = np.frombuffer(self.first, np.int64), np.frombuffer(self.share, np.float64)
        source, token = np.frombuffer(self.source, np.int64), np.frombuffer(self.token, np.int32)
        rounds, which = [], np.arange(len(at))
        while len(which):
            edge, end = first[at], first[at + 1] - 1
            draws = (mixed(luck[which] + np.uint64((len(rounds) + 1) * int(GOLDEN) & MASK)) >> np.uint64(11)) * 2.0**-53
            more = np.flatnonzero(edge < end)
            while len(more):
                more = more[share[edge[more]] <= draws[more]]
                edge[more] += 1
                more = more[edge[more] < end[more]]
            rounds.append((which, token[edge]))
            at = source[edge]
            which, at = which[at != 0], at[at != 0]
        return rounds


@lru_cache(maxsize=4)
def lattice_of(path: str, theta: float = THETA) -> PieceLattice:
    return PieceLattice(path, theta)


@lru_cache(maxsize=4)
def texts_of(path: str) -> PieceTexts:
    return PieceTexts(path)


def encode_sampled(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = SEED, out: str = "token_ids",
    check: str | None = None,
) -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): array<int>, a segmentation drawn by the row's key.

    Null and empty texts have no tokens. Rows of equal key and text get equal tokens; rows without a key share one seed.
    With ``check``, a boolean column of that name tells whether the tokens were decoded and gave the very text.
    """

    @F.arrow_udf("ids array<int>, same boolean")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lattice = lattice_of(path, theta)
        for keys, texts in batches:
            ids, sizes, same = [np.empty(0, np.int32)], [0], []
            # Texts become Python's a part at a time; only tokens are gathered, in one array.
            lot = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // TOGETHER
            cuts = np.flatnonzero(np.diff(lot, prepend=-1, append=-1)) if len(lot) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                some = texts.slice(low, high - low).to_pylist()
                found = lattice.sample(some, keys.slice(low, high - low).to_pylist(), seed)
                same += [lattice.decode(x.tolist()) == (t or "") for x, t in zip(found, some)] if check else [True] * len(some)
                ids += found
                sizes += map(len, found)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "same"])

    name = F.coalesce(F.to_json(F.struct(F.col(quoted(key)).alias("key"))), F.lit(""))
    done = docs.withColumn(out, encode(name, F.col(quoted(text))))
    if check:
        done = done.withColumn(check, F.col(quoted(out))["same"])
    return done.withColumn(out, F.col(quoted(out))["ids"])


def decode_pieces(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): the text of the tokens; null and no tokens are empty."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        texts = texts_of(path)
        for column in batches:
            yield pd.Series([texts.decode(x.tolist()) if x is not None and len(x) else "" for x in column])

    return docs.withColumn(out, decode(F.col(quoted(ids))))


def op8_sampled_pieces(spark, sf_dir):
    """Per document: n_chars, n_tokens, the digest of the sampled tokens, and whether decoding them gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = encode_sampled(docs, public_path(), check="lossless")
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("tokens_sha256"), "lossless",
    )
