"""Encoding of a corpus with a public byte-level BPE tokenizer.

The merges are compiled into a deterministic automaton over tokens whose accepted paths are exactly the right token
sequences. It starts with one state and an arc for each byte. Each merge u v -> w, in order of rank, adds one gadget:
an arc w wherever the arc u may be taken and v may follow, leading to a new state that copies the state after v; and v
may no longer follow u. (If u = v, w may not follow u either: runs merge from the left.) The copies are kept as links
with the rank at which they were made, so the automaton for all merges holds one state per token; its transitions are
tabulated when first taken. Every prefix of a word has one accepted path, so a word is encoded in one pass from left to
right, in time linear in its length. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers lie; a parameter of every operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 400_000
#: Transitions that a worker keeps tabulated; beyond that the table starts afresh.
CACHE_STEPS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a list of merges; ids maps each token's bytes to its id."""

    def __init__(self, merges: Iterable[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.label = {i: t for t, i in ids.items()}
        self.born: dict[int, int] = {ids[bytes([b])]: -1 for b in range(256) if bytes([b]) in ids}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.barred: dict[tuple[int, int], int] = {}
        self._step: dict[tuple[int, int], bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, ids[u], ids[v], ids[u + v])
        self.prefix: dict[bytes, int] = {}
        for i in self.born:
            t = self.label[i]
            for k in range(1, len(t)):
                self.prefix.setdefault(t[:k], -1)
            self.prefix[t] = i

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u not in self.born or v not in self.born or self._bars(u, v, rank):
            return  # v never follows u by now, so that no arc w comes into being
        if w not in self.born:
            self.born[w], self.left[w], self.right[w] = rank, u, v
        self.barred[u, v] = rank

    def follows(self, p: int, t: int) -> bool:
        """Whether the arc t leaves the state after p."""
        key = (p, t)
        known = self._step.get(key)
        if known is None:
            if len(self._step) >= CACHE_STEPS:
                self._step.clear()
            known = self._step[key] = not self._bars(p, t)
        return known

    def _bars(self, p: int, t: int, when: int = 1 << 62) -> bool:
        """Whether t may not follow p in the automaton before the gadget of that rank."""
        born = self.born
        while True:
            rank = self.barred.get((p, t))
            if rank is not None and rank < when:
                return True
            if born[p] < born[t]:
                if p == self.left[t] == self.right[t]:
                    return True
                when, t = born[t], self.left[t]
            elif born[p] > born[t]:
                when, p = born[p], self.right[p]
            elif p in self.left:  # p is t: its new state and its new arc come from the same gadget
                when, p, t = born[p], self.right[p], self.left[t]
            else:
                return False

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word: the single accepted path that spells it."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        prefix = self.prefix
        for j in range(n):
            p = last[j]
            for k in range(j + 1, n + 1):
                t = prefix.get(word[j:k])
                if t is None:
                    break
                if t >= 0 and last[k] < 0 and (j == 0 or self.follows(p, t)):
                    last[k], back[k] = t, j
        out, k = [], n
        while k:
            out.append(last[k])
            k = back[k]
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


class Encoder:
    """Texts to ids; words that were seen before are looked up."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                ids = self._learn(w)
            out += ids
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, n = self.known, 0
        for w in self.words(text):
            ids = known.get(w)
            n += len(self._learn(w) if ids is None else ids)
        return n

    def _learn(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids


def load_merges(content: str) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Merges and ids of a byte-level vocabulary file; special tokens are left out."""
    model = json.loads(content)
    letters = byte_letters()
    special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
    raw = lambda s: bytes(letters[c] for c in s)
    ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
    return [(raw(a), raw(b)) for a, b in pairs], ids


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(MergeAutomaton(*load_merges(content)))


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent to each executor once; its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids) of every row, in one narrow pass; null and empty texts give an empty list.

    Strings of special tokens in a text are ordinary text. A key that comes several times, or null, is kept as it is.
    """
    shared = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    chosen = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = chosen.schema["k"].dataType.simpleString()
    return chosen.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """keep and n_tokens of every row; null and empty texts have 0."""
    shared = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            n = [enc.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    chosen = df.select(*[F.col(k) for k in keep], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, n_tokens long")


def decode(df: DataFrame, ids: str = "ids", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the text that its ids spell."""
    shared = _vocabulary(df, tokenizer)

    @F.pandas_udf("string")
    def spell(rows: pd.Series) -> pd.Series:
        automaton = _encoder(shared.value).automaton
        return rows.map(lambda x: None if x is None else automaton.decode(x))

    return df.withColumn(text, spell(ids))
