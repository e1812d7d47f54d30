"""Token counts by a linear longest-match automaton.

Greedy longest match over a vocabulary normally goes back after each piece.
Here every trie node has a failure link and the number of tokens that
following it closes, both worked out beforehand; each symbol of a word is then
read once, and lengths come out without building any piece.

The vocabulary file holds byte-level tokens of which some end a word. A
word's symbols are its bytes, the last one told apart as final; every single
symbol is a token, so every word has a segmentation.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
#: Fixed value: how the vocabulary's own tokenizer splits lower-cased text into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 1 << 19, 48


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next free code from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The tokens of a vocabulary file as symbols: bytes, and bytes plus 256 at a word's end."""
    letters, out = byte_letters(), []
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    for name in names:
        final = name.endswith(END)
        try:
            s = [letters[c] for c in (name[: -len(END)] if final else name)]
        except KeyError:
            continue  # special tokens
        if s:
            out.append(tuple(s[:-1] + [s[-1] + 256 * final]))
    return out


class LongestMatch:
    """The automaton: ``to`` by node and symbol, failure links and the tokens that they close."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        self.to: list[dict[int, int]] = [{}]
        ends = set()
        for t in [*tokens, *((s,) for s in range(512))]:
            node = 0
            for s in t:
                after = self.to[node].get(s)
                if after is None:
                    after = self.to[node][s] = len(self.to)
                    self.to.append({})
                node = after
            ends.add(node)
        self.fail, self.closes = [0] * len(self.to), [0] * len(self.to)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for s, u in self.to[v].items():
                if u in ends:
                    self.closes[u] = 1
                else:  # the tokens of v's text close until the symbol fits on
                    n, z = self.closes[v], self.fail[v]
                    while s not in self.to[z]:
                        n += self.closes[z]
                        z = self.fail[z]
                    self.fail[u], self.closes[u] = self.to[z][s], n
                queue.append(u)

    def count(self, word: str) -> int:
        """The number of tokens of a word."""
        to, fail, closes = self.to, self.fail, self.closes
        data = word.encode()
        node = n = 0
        for s in (*data[:-1], data[-1] + 256):
            while s not in to[node]:
                n += closes[node]
                node = fail[node]
            node = to[node][s]
        while node:
            n += closes[node]
            node = fail[node]
        return n


class Counted(dict):
    """Words with their counts; short ones are remembered."""

    def __init__(self, machine: LongestMatch):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def words(text: str) -> list[str]:
    """The words of a text in normal form and lower case."""
    return SPLIT.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each row's whole text.

    Null, empty and blank texts have none; repeated rows get equal results;
    other columns of ``docs`` aren't read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(LongestMatch(load(vocabulary)))  # as large as the vocabulary

    def run(batches):
        known = Counted(sent.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                own = words(text.as_py() or "")
                n_words.append(len(own))
                n_tokens.append(sum(map(known.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over the whole texts of ``documents``."""
    return counted(table(spark, sf_dir, "documents"))
