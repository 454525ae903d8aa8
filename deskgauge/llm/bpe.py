"""BPE encoding and decoding, exact to a tokenizer file, by dynamic programming over prefixes.

The encoding of every prefix of a word ends in one token, and that token is the only match ending there that fits the last
token of the prefix before it. An automaton of all tokens (trie with suffix links) gives the matches at each position, a
pair test tells whether two neighbouring tokens would survive the merges, and back-pointers give the ids. No merge loop
runs over the word, so a word of any length takes linear time.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a worker keeps for words and for token pairs; on overflow it starts anew.
CACHE = 200_000
END = 0x1000  # added to the last character of a word: it is another symbol there


class WordBpe:
    """A tokenizer file with word-end suffix, lower-casing normaliser and byte symbols.

    Special tokens in a text become their ids, as the file's library does; padding and truncation are not applied.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.decimals = {i: str(i) for i in self.names}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.byte_symbol = dict(enumerate(self._byte_symbols()))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge: dict[tuple[int, int], int] = {}  # ranks
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        self.known_stable: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})  # one entry per token
        for rank, (a, b) in enumerate(pairs):
            token = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            self.parts.setdefault(token, (rank, vocab[a], vocab[b]))
        self.match = ahocorasick.Automaton()
        for name, token in vocab.items():
            if name in special or not self._stable(token):
                continue
            body = name[: -len(suffix) - 1] + chr(ord(name[-len(suffix) - 1]) + END) if name.endswith(suffix) and len(name) > len(suffix) else name
            self.match.add_word(body, (token, len(body)))
        self.match.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _byte_symbols() -> list[str]:
        """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that border this side while ``token`` is built, each with the rank of the merge that ends it."""
        known = self.spines[side - 1]
        if token not in known:
            out, at, until = [], token, float("inf")
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][0], self.parts[at][side]
            known[token] = out
        return known[token]

    def _fits(self, left: int, right: int, but: int = -1) -> bool:
        """Whether no merge across the border (``but`` one of this rank) comes before the merges that build the two tokens.

        Of equal ranks the leftmost is merged first: a merge inside ``left`` goes before one across, that before one inside
        ``right``.
        """
        rights, merge = self._spine(right, 1), self.merge
        for a, a_until in self._spine(left, 2):
            for b, b_until in rights:
                rank = merge.get((a, b))
                if rank is not None and rank != but and rank < a_until and rank <= b_until:
                    return False
        return True

    def _stable(self, token: int) -> bool:
        """Whether merging the symbols of a token gives that token (then it can be in an encoding)."""
        if token not in self.parts:
            return True
        if token not in self.known_stable:
            rank, left, right = self.parts[token]
            self.known_stable[token] = self._stable(left) and self._stable(right) and self._fits(left, right, rank)
        return self.known_stable[token]

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of text between splits."""
        text = piece.encode().decode("latin-1").translate(self.byte_symbol)
        text = text[:-1] + chr(ord(text[-1]) + END)
        tokens, sizes, pairs = [-1] * len(text), [0] * len(text), self.pairs
        for end, (token, size) in self.match.iter(text):
            if sizes[end]:
                continue  # the one that fits is found
            if size <= end:
                before = tokens[end - size]
                if before < 0:
                    continue
                pair = before << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= CACHE:
                        pairs.clear()
                    fits = pairs[pair] = self._fits(before, token)
                if not fits:
                    continue
            tokens[end], sizes[end] = token, size
        at, ids = len(text) - 1, []
        while at >= 0:
            if not sizes[at]:
                raise ValueError(f"no encoding for {piece!r}")
            ids.append(tokens[at])
            at -= sizes[at]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            # letter by letter, as the file's library does: no final form of sigma
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.pieces(plain):
                ids = words.get(piece)
                if ids is None:
                    if len(words) >= CACHE:
                        words.clear()
                    ids = self.word(piece)
                    if len(piece) < 100:
                        words[piece] = ids
                out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: token strings joined by blanks. Unknown ids are left out."""
        return " ".join([x for x in map(self.names.get, ids) if x is not None])


@functools.lru_cache(4)
def load(path: str) -> WordBpe:
    """One tokenizer per worker and file."""
    return WordBpe(path)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids in decimal, joined by blanks), decoded_sha256.

    Ids are encoded, decoded and hashed in one pass, document by document, so a task holds the ids of one text at a time. Null
    texts count as empty; repeated rows get equal rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            sizes, encoded, decoded = [], [], []
            for x in batch.column(1):
                ids = tokenizer.encode(x.as_py() or "")
                sizes.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(tokenizer.decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(text, path: str):
    """array<int> of token ids; null counts as empty. ``path`` must be readable on every executor."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for batch in texts:
            ids = [np.array(tokenizer.encode(x.as_py() or ""), np.int32) for x in batch]  # 4 bytes a token are kept
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    return encode(text)


def decode_column(ids, path: str):
    """The text of an array<int> of token ids; null stays null."""

    @F.arrow_udf("string")
    def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for batch in arrays:
            yield pa.array((None if not x.is_valid else tokenizer.decode(x.values.to_numpy().tolist()) for x in batch), pa.string())

    return decode(ids)
