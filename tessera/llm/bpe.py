"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the
vocabulary finds all tokens that end at a place. The encoder takes the longest
token at each place and backtracks where it can't follow the token before it:
two tokens may stand side by side if merging their bytes gives them back. That
is memoised for each pair, and each place is given up at most once, so the
time is linear in the length. The result equals the one that applying the
merges by rank would give.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memory, id_and_text, session, table, with_number

#: Splits text before the merges (the pattern that comes with the rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space, as the pattern means it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2000))) + "-" + chr(0x200A)
#: Runs of white space with what follows up to the next: no match of the pattern crosses their ends.
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Runs whose ids are remembered (twice as many at most), and the longest such run.
REMEMBERED, LONGEST = 300_000, 64
#: Marks that may follow a word's letters.
TAIL = ".,;:!?|"
#: Pairs of tokens whose compatibility is remembered.
FITS = 500_000


class BytePairEncoder:
    """Encodes and decodes by a table of ranks (bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.usual = pattern == PATTERN
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(self.size.values(), default=0)
        self.fits: dict[int, bool] = {}
        self.runs, self.pieces = Memory(REMEMBERED), Memory(REMEMBERED)
        self.trie = ahocorasick.Automaton()
        for token in ranks:
            self.trie.add_word(token.decode("latin-1"), token)
        self.trie.make_automaton()
        self.shorter: dict[int, int] = {}
        #: Tokens that merges make.
        self.whole = {i for t, i in ranks.items() if len(t) == 1 or self.split(i) is not None}

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> BytePairEncoder:
        """From a file with a base64 token and its rank on each line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for what no merge makes."""
        if token not in self.parts:
            whole, found = self.tokens[token], None
            if len(whole) > 1:
                pieces = [whole[i : i + 1] for i in range(len(whole))]
                while len(pieces) > 2:
                    best = min(range(len(pieces) - 1), key=lambda i: self.ranks.get(pieces[i] + pieces[i + 1], 1 << 60))
                    if self.ranks.get(pieces[best] + pieces[best + 1], 1 << 60) >= token:
                        break
                    pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
                if len(pieces) == 2 and all(p in self.ranks for p in pieces):
                    found = (self.ranks[pieces[0]], self.ranks[pieces[1]])
            self.parts[token] = found
        return self.parts[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of both gives just these two tokens."""
        # Walks back through the merges that made both: at no time may a merge
        # across the border come before the one that is undone.
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                return False
            if a > b:
                limit, parts = a, self.split(a)
                if parts is None:
                    limit, parts = b, self.split(b)
                    if parts is None:
                        return True
                    limit += 1
                    b = parts[0]
                else:
                    a = parts[1]
            else:
                limit, parts = b, self.split(b)
                if parts is None:
                    limit, parts = a, self.split(a)
                    if parts is None:
                        return True
                    a = parts[1]
                else:
                    limit += 1
                    b = parts[0]

    def longest_at(self, text: str, piece: bytes, at: int) -> int:
        """The longest token that starts at a place (-1: none)."""
        n = self.trie.longest_prefix(text[at : at + self.longest])
        while n:
            token = self.ranks.get(piece[at : at + n])
            if token is not None:
                return token
            n -= 1
        return -1

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one (-1: none)."""
        if token not in self.shorter:
            whole, found = self.tokens[token], -1
            for n in range(len(whole) - 1, 0, -1):
                if whole[:n] in self.ranks:
                    found = self.ranks[whole[:n]]
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        text, n = piece.decode("latin-1"), len(piece)
        size, fits = self.size, self.fits
        given_up = bytearray(n + 1)
        out: list[int] = []
        at, last = 0, -1
        token = self.longest_at(text, piece, 0)
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not given_up[end] and token in self.whole:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if fit is None:
                        fit = fits[last << 32 | token] = self.compatible(last, token)
                    if fit:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = self.longest_at(text, piece, at)
            else:
                if last < 0:
                    raise ValueError("the ranks lack a byte of the text")
                given_up[at] = 1
                at -= size[last]
                out.pop()
                token = self.next_shorter(last)
                last = out[-1] if out else -1
        return out

    def encode_piece_of(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
            if len(piece) <= LONGEST:
                self.pieces.put(piece, ids)
        return ids

    def encode_run(self, run: str) -> bytes:
        core = run.rstrip(TAIL) if self.usual else ""
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):  # letters, then marks: what the pattern makes of it is plain
            ids = self.encode_piece_of(core)
            if len(core) < len(run):
                ids += self.encode_piece_of(run[len(core) :])
        else:
            ids = b"".join(map(self.encode_piece_of, self.pattern.findall(run)))
        if len(run) <= LONGEST:
            self.runs.put(run, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, without special tokens, as little-endian unsigned 32-bit integers."""
        if len(self.fits) > FITS:
            self.fits.clear()
        runs = RUNS.findall(text)
        found = list(map(self.runs.recent.get, runs))
        if None in found:
            new = {r: self.runs.get(r) for r, ids in zip(runs, found, strict=True) if ids is None}
            new = {r: self.encode_run(r) if ids is None else ids for r, ids in new.items()}
            found = [new[r] if ids is None else ids for r, ids in zip(runs, found, strict=True)]
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder.load(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids)``; a null text has no ids.

    Every row gives one, repeated rows too; a null doc_id stays null; other
    columns are ignored. ``path``: the file of ranks, on every executor.
    """
    session(docs)
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [coder.encode(t or "").astype(np.int32) for t in pdf["text"]]})

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, ids array<int>"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, bytes)``: the exact bytes of each document; null ids have none."""
    session(encoded)
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bytes": [coder.decode(np.zeros(0, np.int32) if ids is None else ids) for ids in pdf["ids"]]})

    return with_number(encoded.select(F.col("doc_id").cast("string"), "ids").mapInPandas(run, "doc_id string, bytes binary"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Round trip of every text in one pass: number and hash of its ids, hash of the decoded bytes."""
    session(docs)
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                ids = coder.encode(t or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
