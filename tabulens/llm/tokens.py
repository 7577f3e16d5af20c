"""Token counts by a finite-state transducer compiled from a BPE vocabulary of pieces.

The last piece of the encoding of every prefix of a text tells the whole encoding: take it away, and what is left is the
encoding of the shorter prefix. A piece is the last one exactly if it can stand alone and the pair with the last piece
before it does not merge across their border. So the transducer's state holds, for every start from which a piece could
still grow over the next character, how far it has grown (a node of the vocabulary's trie), the last piece before it, and
how many tokens ago that was. States are made when they are first met; a transition carries the change in the number of
tokens that it emits (less than nothing where pieces merge). Where a character never follows another in any piece, the
state starts afresh: nothing before matters.

A stretch of text is a map from the state before it to the state after it and a count. A stretch without a fresh start
is kept as its text until the state before it is known; from the first fresh start on, a stretch is a number and a state.
These maps compose associatively, so a text's chunks can be counted apart and scanned in any grouping.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table

SPACE = "▁"
CHUNK = 65_536
#: Distinct stretches remembered by a task before it starts anew.
REMEMBERED = 400_000
#: States that a task keeps compiled.
STATES = 200_000
LIMIT = 4096


class Vocabulary(NamedTuple):
    """Pieces that text can become, with the score by which merges are ordered, and what stands before every text."""

    scores: dict[str, float]
    prefix: str


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """Of a BPE model with identity normalisation and byte fallback; others are refused, not counted wrongly."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    for probe in ("a b  ", "ﬁ ", "\u0000"):
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalises texts or has no byte fallback")
    pieces = model.encode("a", out_type=str)
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in plain}, SPACE if pieces[0].startswith(SPACE) else "")


class Transducer:
    """Deterministic over characters; built for a vocabulary, grows as states are met."""

    FREE = ""  # no piece before that could merge

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.scores, self.prefix = vocabulary
        self.trie: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.follows: set[str] = set()
        for piece in self.scores:
            node = 0
            for c in piece:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][c]
            self.ends[node] = piece
            self.follows.update(piece[i : i + 2] for i in range(len(piece) - 1))
        self.opens = {pair[0] for pair in self.follows}
        self.forget()
        # Stretches that start afresh: from a space after another character on, and single characters of no longer piece.
        # That no piece holds a space after another character is read from the vocabulary.
        inside = any(pair[1] == SPACE != pair[0] for pair in self.follows)
        alone = "".join(c for c in "\n\t\r\v\f" if not any(c in pair for pair in self.follows))
        apart = f"[{re.escape(alone)}]" if alone else "(?!)"
        grown = f"(?:(?!{apart}).)+" if inside else rf"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+"
        self.stretches = re.compile(f"{apart}|{grown}", re.S)

    def forget(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.start = self.state(((0, self.FREE, 0),))
        self.known: dict[str, int] = {}

    def bound(self, states: int = STATES) -> None:
        """Between texts: what has been compiled so far is dropped when it has grown too large; it comes again when met."""
        if len(self.keys) > states or len(self.pairs) > 2 * states:
            self.forget()

    def state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return self.states[key]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the rule itself: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can follow ``before`` in an encoding."""
        if before and before[-1] + piece[0] not in self.follows:
            before = self.FREE
        pair = (before, piece)
        if pair not in self.pairs:
            self.pairs[pair] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return self.pairs[pair]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The transition that is met for the first time."""
        entries = self.keys[state]
        if c not in self.trie[0] or self.trie[0][c] not in self.ends:
            # Of no piece: its bytes, after the last piece, whose distance is the root's.
            found = (self.start, len(c.encode("utf-8", "surrogatepass")))
        else:
            grown = [(self.trie[node].get(c), last, ago) for node, last, ago in entries]
            grown = [x for x in grown if x[0] is not None]
            ends = [(self.ends[node], ago) for node, last, ago in grown if node in self.ends and self.fits(last, self.ends[node])]
            (piece, ago), more = ends[0], ends[1:]
            assert not more, "two encodings of one prefix"
            emitted = 1 - ago
            free = piece if piece[-1] in self.opens else self.FREE
            kept = [(node, last, ago + emitted) for node, last, ago in grown if self.trie[node]]
            found = (self.state((*kept, (0, free, 0))), emitted)
        self.steps[state][c] = found
        return found

    def run(self, text: str, state: int) -> tuple[int, int]:
        """(state after, tokens emitted); ``text`` in pieces' characters."""
        count, steps = 0, self.steps
        for c in text:
            found = steps[state].get(c) or self.step(state, c)
            state = found[0]
            count += found[1]
        return state, count

    def stretch(self, text: str) -> int:
        if text not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = self.run(text, self.start)[1]
        return self.known[text]


class ChunkMap(NamedTuple):
    """What a chunk does to a state: ``head`` waits for the state before it; the rest is ``count`` tokens and ``state``.

    Without a fresh start inside, ``state`` is None and the chunk is all head.
    """

    head: str
    last: str
    count: int
    state: int | None


def chunk_map(machine: Transducer, text: str) -> ChunkMap:
    """Of text in pieces' characters that follows an unknown one."""
    for i in range(1, len(text)):
        if text[i - 1] + text[i] not in machine.follows:
            # Whole stretches by memory, the last one character by character as its state goes on.
            parts = machine.stretches.findall(text, i)
            count = sum(map(machine.stretch, parts[:-1]))
            state, more = machine.run(parts[-1], machine.start)
            return ChunkMap(text[:i], text[-1:], count + more, state)
    return ChunkMap(text, text[-1:], 0, None)


def composed(machine: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    if a.state is None:
        joint = ChunkMap(a.head + b.head, b.last or a.last, b.count, b.state)
        # The seam may itself be a fresh start; then what follows it need not wait.
        if a.head and b.head and a.last + b.head[0] not in machine.follows:
            state, count = machine.run(b.head, machine.start)
            return ChunkMap(a.head, joint.last, count + b.count, state if b.state is None else b.state)
        return joint
    start = a.state if a.last + b.head[:1] in machine.follows else machine.start
    state, count = machine.run(b.head, start)
    return ChunkMap(a.head, b.last or a.last, a.count + count + b.count, state if b.state is None else b.state)


def scanned(machine: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """All maps composed, in pairs of neighbours, round by round."""
    while len(maps) > 1:
        maps = [composed(machine, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def tokens_of(machine: Transducer, chunks: Iterable[str]) -> int:
    """Tokens of a text that comes in chunks."""
    texts = [c.replace(" ", SPACE) for c in chunks if c]
    if not texts:
        return 0
    machine.bound()
    first = ChunkMap("", "", 0, machine.start)
    whole = scanned(machine, [first, *(chunk_map(machine, c) for c in [machine.prefix + texts[0], *texts[1:]])])
    return whole.count


@lru_cache(maxsize=4)
def machine_of(path: str, load: Callable[[str], Vocabulary] = sentencepiece_vocabulary) -> Transducer:
    return Transducer(load(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, load: Callable[[str], Vocabulary] = sentencepiece_vocabulary) -> Column:
    """The number of tokens of a text, null and empty ones 0, whole texts however long, as a column.

    ``path`` names the vocabulary on every worker; each worker process compiles it once.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = machine_of(path, load)
        for texts in batches:
            yield pd.Series([tokens_of(machine, (x[i : i + chunk] for i in range(0, len(x), chunk))) if x else 0 for x in texts], dtype="int64")

    return count(F.col(quoted(text)))


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """One row per row: ``key``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null texts count as empty; keys may be null or repeat; other columns are not looked at. No rows give no rows.
    """
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    counted = rows.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counts(rows, path, "text", chunk).alias("n_tokens"))
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def public_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path())
