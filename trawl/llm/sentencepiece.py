"""SentencePiece BPE encoding and decoding by suffix-array matching.

The texts of a batch are normalised and cut where a space follows something else (no piece reaches over
such a place); each different word is listed once, if the worker does not know it from batches before (it remembers
a bounded number). A suffix array over the concatenated words is
binary-searched for every piece of the vocabulary, which gives all its occurrences as a range; the ranges are
edges of a lattice, sorted by where they end, and then relaxed from left to right: an edge survives if
its piece may follow the piece that the encoding up to its start ends with. A sequence of pieces is the
encoding of its text exactly when each adjacent pair is the encoding of its own, so one edge survives at
each place that an encoding can reach, and walking back from the ends gives the pieces. Characters
that are no piece fall back to bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship_package, table

SPACE = "▁"
BYTE_TYPE, NORMAL_TYPE = 6, 1
BATCH_CHARS = 1_500_000
#: Words whose pieces a worker remembers; beyond, it begins anew.
KNOWN_WORDS = 300_000
_UNKNOWN = 1 << 20  # a character that is no piece stands as this plus its code point


class Pieces:
    """A BPE model with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.scores = {self.names[i]: sp.get_score(i) for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece reaches over a word's end")
        order = sorted(self.ids, key=len)
        self.texts, self.numbers = order, np.array([self.ids[t] for t in order])
        self.longest = max(map(len, order))
        self.follows: dict[int, bool] = {}
        self._forget()
        surfaces = []
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                surfaces.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                surfaces.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                surfaces.append(name.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_size = np.array([len(s) for s in surfaces])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.width = np.zeros(0, np.int32), np.zeros(0, int)

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best-scored merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max((self.scores.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
            if best[0] == -np.inf:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, piece: int) -> bool:
        """If the pieces stand side by side in the encoding of their text; before < 0: at a word's start."""
        key = (before + 1) << 32 | piece
        found = self.follows.get(key)
        if found is None:
            name = self.names[piece]
            if before < 0 or before >= _UNKNOWN:
                found = self.merge(name) == [name]
            else:
                found = self.merge(self.names[before] + name) == [self.names[before], name]
            if len(self.follows) > 4_000_000:
                self.follows.clear()
            self.follows[key] = found
        return found

    # -- matching ----------------------------------------------------------------------------------
    def _edges(self, chars: np.ndarray, ends: np.ndarray):
        """All occurrences of all pieces: start, end, piece. ``ends`` has the end of the word of each character."""
        n = len(chars)
        alphabet = np.unique(chars)
        bits = max(1, int(len(alphabet)).bit_length())
        per = 63 // bits
        columns = -(-self.longest // per)
        code = np.searchsorted(alphabet, chars).astype(np.uint64) + np.uint64(1)
        padded = np.concatenate([code, np.zeros(columns * per, np.uint64)])
        at = np.arange(n)
        keys = []
        for c in range(columns):
            key = np.zeros(n, np.uint64)
            for k in range(c * per, (c + 1) * per):
                inside = at + k < ends
                key = key << np.uint64(bits) | np.where(inside, padded[k : k + n], np.uint64(0))
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        # pieces whose characters all occur, as the same keys
        known = {int(c): i + 1 for i, c in enumerate(alphabet)}
        rows, low = [], []
        for row, text in enumerate(self.texts):
            codes = [known.get(ord(ch)) for ch in text]
            if None not in codes:
                rows.append(row)
                low.append(codes + [0] * (columns * per - len(codes)))
        rows = np.array(rows, int)
        sizes = np.array([len(self.texts[r]) for r in rows], int)
        low = np.array(low, np.uint64).reshape(len(rows), columns * per)
        high = np.where(np.arange(columns * per) < sizes[:, None], low, np.uint64((1 << bits) - 1))

        def pack(grid):
            out = []
            for c in range(columns):
                key = np.zeros(len(grid), np.uint64)
                for k in range(c * per, (c + 1) * per):
                    key = key << np.uint64(bits) | grid[:, k]
                out.append(key)
            return out

        def search(wanted, after: bool):
            lo, hi = np.zeros(len(rows), int), np.full(len(rows), n)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
                for key, want in zip(keys, wanted, strict=True):
                    less |= same & (key[mid] < want)
                    same &= key[mid] == want
                go = (less | (same if after else False)) & (lo < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
            return lo

        first, last = search(pack(low), False), search(pack(high), True)
        count = last - first
        offset = np.repeat(np.cumsum(count) - count, count)
        start = suffixes[np.repeat(first, count) + np.arange(int(count.sum())) - offset]
        return start, start + np.repeat(sizes, count), np.repeat(self.numbers[rows], count)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words, one after the other, and how many each has. No word is empty."""
        sizes = np.fromiter(map(len, words), int, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word_end = np.cumsum(sizes)
        word_start = word_end - sizes
        ends = np.repeat(word_end, sizes)
        begins = np.repeat(word_start, sizes)
        start, end, piece = self._edges(chars, ends)
        single = np.zeros(len(chars), bool)
        single[start[end - start == 1]] = True
        lone = np.flatnonzero(~single)
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, _UNKNOWN + chars[lone].astype(np.int64)])
        depth = end - begins[start]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        fence = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        last, back = np.full(len(chars) + 1, -1), np.zeros(len(chars) + 1, int)
        at_start = start == begins[start]
        by_size = np.sort(sizes)
        side_by_side = int(by_size[-FEW_WORDS - 1]) if len(sizes) > FEW_WORDS else 0
        for k in range(min(side_by_side, len(fence) - 1)):  # all edges that end k + 1 characters into their word
            s, e, p = (x[fence[k] : fence[k + 1]] for x in (start, end, piece))
            before = np.where(at_start[fence[k] : fence[k + 1]], -1, last[s - 1])
            ok = (p >= _UNKNOWN) | (before == -2)
            pairs, where = np.unique((before[~ok] + 1) << 32 | p[~ok], return_inverse=True)
            fits = np.fromiter((self.may_follow((x >> 32) - 1, x & 0xFFFFFFFF) for x in pairs.tolist()), bool, len(pairs))
            ok[~ok] = fits[where]
            last[e[ok] - 1], back[e[ok] - 1] = p[ok], s[ok]
        long = np.flatnonzero(depth > side_by_side)  # the rest of the few longest words, edge by edge
        long = long[np.argsort(end[long], kind="stable")]
        for s, e, p, at_first in zip(*(x[long].tolist() for x in (start, end, piece, at_start)), strict=True):
            if p >= _UNKNOWN or self.may_follow(-1 if at_first else int(last[s - 1]), p):
                last[e - 1], back[e - 1] = p, s
        place, word = word_end.copy(), np.arange(len(words))
        found = []
        while len(place) > FEW_WORDS:
            found.append((word, last[place - 1], np.full(len(place), len(found))))
            place = back[place - 1]
            more = place > word_start[word]
            place, word = place[more], word[more]
        turns = len(found)
        for at, own in zip(place.tolist(), word.tolist(), strict=True):
            steps = []
            while at > word_start[own]:
                steps.append(last[at - 1])
                at = int(back[at - 1])
            found.append((np.full(len(steps), own), np.array(steps, last.dtype), turns + np.arange(len(steps))))
        words_, ids, turn = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-turn, words_))
        words_, ids = words_[order], ids[order]
        unknown = np.flatnonzero(ids >= _UNKNOWN)
        if len(unknown):
            spelt = [[self.bytes[b] for b in chr(c - _UNKNOWN).encode("utf-8", "surrogatepass")] for c in ids[unknown].tolist()]
            width = np.ones(len(ids), int)
            width[unknown] = [len(x) for x in spelt]
            ids, words_ = np.repeat(ids, width), np.repeat(words_, width)
            ids[ids >= _UNKNOWN] = [b for x in spelt for b in x]
        return ids, np.bincount(words_, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and how many each has."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known, fresh, codes, sizes = self.known, [], [], []
        for text in texts:
            own = _WORD.findall(f"{SPACE}{text}".replace(" ", SPACE)) if text else []
            sizes.append(len(own))
            numbers = [known.get(w, -1) for w in own]
            if -1 in numbers:
                for i, w in enumerate(own):
                    if numbers[i] < 0:
                        number = known.setdefault(w, len(known))
                        if number == len(self.width) + len(fresh):
                            fresh.append(w)
                        numbers[i] = number
            codes.append(np.array(numbers, np.int32))
        if fresh:
            flat, width = self.encode_words(fresh)
            self.flat, self.width = np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.width, width])
        word = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        if not len(word):
            return np.zeros(0, np.int32), np.zeros(len(texts), int)
        first = np.cumsum(self.width) - self.width
        count = self.width[word]
        offset = np.cumsum(count) - count
        ids = self.flat[np.repeat(first[word] - offset, count) + np.arange(int(count.sum()))]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: what normalisation put in front goes, bytes that are no text become U+FFFD."""
        width = self.surface_size[ids]
        offset = np.cumsum(width) - width
        raw = self.surface[np.repeat(self.surface_start[ids] - offset, width) + np.arange(int(width.sum()))].tobytes()
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text.removeprefix(" "))
        return out


#: So many words or fewer are relaxed one after the other.
FEW_WORDS = 64
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded: dict[int, Pieces] = {}


def _pieces(model) -> Pieces:
    key = hash(model.value)
    if key not in _loaded:
        _loaded[key] = Pieces(model.value)
    return _loaded[key]


def _coder(model):
    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end]) < BATCH_CHARS):
                    held += len(texts[end])
                    end += 1
                ids, counts = pieces.encode(texts[start:end])
                decoded = pieces.decode(ids, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), lists, pa.array(counts, pa.int64()), pa.array(decoded, pa.string())],
                    ["doc_id", "piece_ids", "n_pieces", "decoded"],
                )
                start = end

    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, piece_ids, n_pieces, decoded.

    ``piece_ids`` are those of the sentencepiece library without begin and end, ``decoded`` is the text that
    the ids give back: the text itself, but that U+2581 comes back as a space. A null text is empty and has no
    pieces. Whole texts of any length are read; repeated rows are coded one by one; other columns are ignored; an
    empty table gives an empty result. No shuffle.
    """
    ship_package(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, under a MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_coder(model), "doc_id long, piece_ids array<int>, n_pieces long, decoded string")


def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
