"""Byte-level BPE encoding and decoding by backtracking from longest matches.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the reversed tokens finds the longest token that begins at
every byte in one pass. A pre-token is then walked from its left end: the longest token that agrees with the one before it is
taken, a shorter one if it does not, and the one before is given up if none does. Places that were given up are never tried
again, so a pre-token costs time in proportion to its length. Two adjacent tokens agree if merging their bytes gives just these two;
that is told from the order of merges along the border, and remembered. An encoding whose neighbours all agree is the one that the merges give.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship_package, table, text_slices

#: Characters of text that are encoded at once; pre-tokens and pairs of tokens that a worker remembers, and the longest such pre-token.
SLICE_CHARS, HELD_WORDS, HELD_PAIRS, HELD_WORD_CHARS = 2_000_000, 400_000, 1_000_000, 64
#: Not in Latin-1: no token crosses it.
_BORDER = "Ā"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, a line each in base 64."""
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in content.splitlines() if line.strip())}


class Splitter:
    """Pre-tokens as the library splits them. Letters and digits that only this regex module's newer Unicode tables know are read as
    other characters, as the library reads them."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        ours = "".join(regex.findall(r"[\p{L}\p{N}]+", every))
        library = tiktoken.Encoding("bytes", pat_str=r"[\p{L}\p{N}]+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        newer = set(ours).difference(library.decode_bytes(library.encode_ordinary(ours)).decode())
        self.plain = dict.fromkeys(map(ord, newer), "\ue000")  # for private use: no letter, digit or space
        self.newer = frozenset(newer)

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.plain))]


class Vocabulary:
    """The merges behind a rank file. ``parts`` holds what each token was merged from last; tokens that merges do not reach are only
    used where a whole pre-token equals them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.split = Splitter(pattern).split
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.bytes = [b""] * self.size
        for word, rank in ranks.items():
            self.bytes[rank] = word
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        reached = {}
        for word, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = self._last_merge(word)
            if parts is None:
                continue
            reached[word] = rank
            if len(word) > 1:
                if max(parts) >= rank:
                    raise ValueError("a token ranks before the tokens it is merged from")
                self.parts[rank] = parts
                self.merged[parts[0] * self.size + parts[1]] = rank
        self.shorter = [-1] * self.size
        self.starts = ahocorasick.Automaton()
        for word, rank in reached.items():
            self.starts.add_word(word[::-1].decode("latin-1"), rank)
            self.shorter[rank] = next((reached[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in reached), -1)
        self.starts.make_automaton()
        self.length = [len(b) for b in self.bytes]
        self.agreed: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _last_merge(self, word: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge completes ``word``, or None if merges end in more than one."""
        parts, last = [word[i : i + 1] for i in range(len(word))], (0, 0)
        while len(parts) > 1:
            found = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return None
            _, i = min(found)
            last = self.ranks[parts[i]], self.ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last if parts[0] in self.ranks else None

    def agree(self, left: int, right: int) -> bool:
        """If the merges of the two tokens' bytes end in just these two."""
        key = left * self.size + right
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= HELD_PAIRS:
                self.agreed.clear()
            known = self.agreed[key] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        # Undo merges from the last on, the right one of two equals first; what touches must not have merged before the one undone.
        before = self.size
        while True:
            if self.merged.get(left * self.size + right, self.size) < before:
                return False
            if left in self.parts and (left > right or right not in self.parts):
                before, left = left, self.parts[left][1]
            elif right in self.parts:
                before, right = right + 1, self.parts[right][0]
            else:
                return True

    def _longest(self, joined: str) -> list[int]:
        """The longest token that begins at each place of the joined pre-tokens, -1 where none does."""
        out = [-1] * len(joined)
        length, last = self.length, len(joined) - 1
        for end, token in self.starts.iter(joined[::-1]):
            at = last - end
            if out[at] < 0 or length[token] > length[out[at]]:
                out[at] = token
        return out

    def _walk(self, longest: list[int], start: int, end: int) -> list[int]:
        taken: list[int] = []
        dead = set()
        at, token = start, longest[start]
        while at < end:
            while token >= 0:
                after = at + self.length[token]
                if after not in dead and (not taken or self.agree(taken[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at = after
                token = longest[at] if at < end else -1
            elif not taken:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead.add(at)
                token = taken.pop()
                at -= self.length[token]
        return taken

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens, packed."""
        out, left = {}, []
        for word in words:
            whole = self.ranks.get(word.encode())
            if whole is None:
                left.append(word)
            else:
                out[word] = whole.to_bytes(4, "little")
        mapped = [w.encode().decode("latin-1") for w in left]
        longest, at = self._longest(_BORDER.join(mapped)), 0
        for word, m in zip(left, mapped, strict=True):
            ids = self._walk(longest, at, at + len(m))
            out[word] = struct.pack(f"<{len(ids)}I", *ids)
            at += len(m) + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.words})
        known = self.words | self._learn(new) if new else self.words
        if len(known) > HELD_WORDS:  # what is common comes again with the next texts
            held = {w: known[w] for words in cut for w in words if len(w) <= HELD_WORD_CHARS}
            self.words = held if len(held) <= HELD_WORDS else {}
        else:
            self.words.update((w, known[w]) for w in new if len(w) <= HELD_WORD_CHARS)
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join([self.bytes[i] for i in memoryview(packed).cast("I")])


_loaded: dict[int, Vocabulary] = {}


def _coder(spec):
    def run(batches):
        content, pattern = spec.value
        key = hash((content, pattern))
        if key not in _loaded:
            _loaded[key] = Vocabulary(read_ranks(content), pattern)
        words = _loaded[key]
        for batch in batches:
            for part, texts in text_slices(batch, SLICE_CHARS):
                packed = words.encode(texts)
                columns = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([words.decode(p) for p in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "packed_ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, packed_ids, decoded.

    ``packed_ids`` are the ids that the tiktoken library gives for a rank file and ``pattern`` without special tokens, as
    little-endian unsigned 32-bit integers (``unpacked`` makes an array of them); ``decoded`` holds the bytes they stand for, which are
    the text's. A null text is empty and has no ids. Only doc_id and text are read, whatever other columns are called; whole texts
    of any length, one after the other (a pre-token of n bytes takes time in proportion to n); repeated rows are coded one by one;
    there are no ties, an encoding being unique; an empty table gives an empty result. No shuffle.
    """
    ship_package(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))  # a vocabulary file, a MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_coder(spec), "doc_id long, n_tokens long, packed_ids binary, decoded binary")


def unpacked(packed: Column) -> Column:
    """The ids in ``packed`` as an array of longs."""
    digits = F.regexp_extract_all(F.hex(packed), F.lit("(.{8})"))
    in_order = lambda d: F.concat(*[F.substring(d, at, 2) for at in (7, 5, 3, 1)])
    return F.transform(digits, lambda d: F.conv(in_order(d), 16, 10).cast("long"))


def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers

    found = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
