"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers in a row count the tokens of a byte-level BPE vocabulary.

The first reads character classes and marks where pre-tokens begin. It has few states, so a chunk of text is
a map from every start state to an end state; the maps of all chunks compose by a parallel prefix
scan, and then every chunk runs from its true start state, all chunks side by side.

The second reads bytes. Each transition is annotated with the number of tokens it adds to the
encoding of the pre-token read so far (which may be below zero when a longer token takes over). Its
states are what the future of an encoding depends on: for each suffix that may yet grow into a token,
the last token before it and the tokens spent. A pre-token resets it, so chunks cut at pre-tokens
have constant state maps and run side by side. States are made on first use and kept by each worker up to
a bound; past it the table is emptied and states in use are made again.

That a token may end at a place is decided by pairs: a sequence of tokens is the encoding of its
text exactly when each adjacent pair is the encoding of its own text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship_package, table

# Character classes. STMD, R, V, L, E are the letters that contractions need.
END, SPACE, WHITE, LETTER, NUMBER, OTHER, APOS, STMD, R, V, L, E = range(12)
# States of the first transducer; the runs of white space keep their last character's kind and if they are longer than one.
START, WORD, DIGITS, SIGNS, SPACE1, WHITE1, SPACES, WHITES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(13)
CLASSES, STATES = 12, 13
HERE, BEFORE = 1, 2  # a pre-token begins at this character, at the one before it
DOC_END, SPECIAL = 0xFF, 0xFE  # bytes that no text has: end of a text, a special token's place
MAX_STATES = 60_000
FEW_TOKENS = 64
FEW_LANES = 64
BATCH_BYTES = 3_000_000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state * CLASSES + class."""
    letters = {LETTER, STMD, R, V, L, E}
    fresh = {END: START, SPACE: SPACE1, WHITE: WHITE1, NUMBER: DIGITS, OTHER: SIGNS, APOS: QUOTE} | dict.fromkeys(letters, WORD)

    def run(c):
        return WORD if c in letters else DIGITS if c == NUMBER else SIGNS if c in (OTHER, APOS) else None

    def step(s, c):
        if c == END:
            return START, HERE | (BEFORE if s in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
        if s == WORD and c in letters or s == DIGITS and c == NUMBER or s == SIGNS and c in (OTHER, APOS):
            return s, 0
        if s in (SPACE1, WHITE1, SPACES, WHITES):
            if c in (SPACE, WHITE):
                return (SPACES if c == SPACE else WHITES), 0
            before = BEFORE if s in (SPACES, WHITES) else 0
            return (run(c), before) if s in (SPACE1, SPACES) else (fresh[c], before | HERE)
        if s == QUOTE:
            if c == STMD:
                return CONTRACTED, 0
            if c in (R, V, L):
                return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            if c in (OTHER, APOS):
                return SIGNS, 0
        if s in (QUOTE_R, QUOTE_V, QUOTE_L):
            if c == (L if s == QUOTE_L else E):
                return CONTRACTED, 0
            return (WORD, BEFORE) if c in letters else (fresh[c], BEFORE | HERE)
        return fresh[c], HERE

    pairs = [step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return np.array([p[0] for p in pairs], np.uint8), np.array([p[1] for p in pairs], np.uint8)


def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table_ = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                table_[a : b + 1] = kind
            else:  # the run goes over the surrogates' gap
                table_[[ord(c) for c in m[0]]] = kind
    for chars, kind in ((" ", SPACE), ("'", APOS), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            table_[ord(c)] = kind
    return table_


class Tokenizer:
    """A compiled byte-level BPE vocabulary; ``count`` gives the tokens of each text of a batch."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = lambda token: bytes(byte_of[c] for c in token)
        special = {t["content"] for t in model["added_tokens"]}
        self.special = [s.encode() for s in sorted(special, key=len, reverse=True)]
        self.vocab = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.ranks, self.made = {}, {}  # made: by which merge a token is made, and of what
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[raw(a), raw(b)] = rank
            self.made[raw(a) + raw(b)] = (rank, raw(a), raw(b))
        self.longer: dict[bytes, list[bytes]] = {}  # tokens that a text may yet grow into
        for t in self.vocab:
            for n in range(1, len(t)):
                self.longer.setdefault(t[:n], []).append(t)
        self.alone: dict[bytes, bool] = {}
        self.next, self.marks = _splitter()
        self.classes = _classes()
        self._empty()

    # -- the byte transducer ------------------------------------------------------------------------
    def _empty(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.hopes: dict[tuple[bytes, bytes], tuple[bytes, ...]] = {}
        self.table = np.full((1024, 256), -1, np.int32)
        self._state((b"", ((0, b"", 0),)))
        self.table[0, DOC_END], self.table[0, SPECIAL] = 512, 512 + 1

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return found

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding of a short text by its definition."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """If no merge crosses from left to right: the merges inside both are undone, latest first, and at each
        point the one across must come later than the one that has just been undone (of equal ones, the left comes first)."""
        before = 1 << 60
        while True:
            across = self.ranks.get((left, right))
            if across is not None and across < before:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_right and (not made_left or made_right[0] >= made_left[0]):
                before, right = made_right[0] + 1, made_right[1]
            elif made_left:
                before, left = made_left[0], made_left[2]
            else:
                return True

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        if before:
            return self.stays(before, token)
        if token not in self.alone:
            self.alone[token] = self.merge(token) == [token]
        return self.alone[token]

    def _hope(self, last: bytes | tuple, grown: bytes) -> bytes | tuple:
        """What a place's future depends on: the tokens that may still follow ``last`` there, or ``last`` itself
        while those are many. Places with the same hopes share states; places without any are dropped."""
        if isinstance(last, tuple):
            return tuple(t for t in last if len(t) > len(grown) and t.startswith(grown))
        longer = self.longer.get(grown, ())
        if len(longer) > FEW_TOKENS:
            return last
        if (last, grown) not in self.hopes:
            self.hopes[last, grown] = tuple(t for t in longer if self._may_follow(last, t))
        return self.hopes[last, grown]

    def _step(self, state: int, byte: int) -> int:
        """Fills one transition: next state * 1024 + 512 + tokens added."""
        suffix, open_ = self.keys[state]
        text = suffix + bytes([byte])
        live, spent = [], None
        for back, last, used in open_:  # back: bytes since the place; last: its last token or hopes; used: tokens up to it
            grown = text[len(text) - back - 1 :]
            if spent is None and grown in self.vocab and (grown in last if isinstance(last, tuple) else self._may_follow(last, grown)):
                spent, token = used + 1, grown
            hope = self._hope(last, grown)
            if hope != ():
                live.append((back + 1, hope, used))
        live.append((0, token, spent))
        longest = live[0][0]
        key = (text[len(text) - longest :] if longest else b"", tuple((b, t, u - spent) for b, t, u in live))
        value = self._state(key) * 1024 + 512 + spent
        self.table[state, byte] = value
        return value

    def _token_deltas(self, raw: np.ndarray, begins: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Tokens added by each byte; begins: true where a pre-token begins."""
        heads = np.flatnonzero(begins)
        cuts = heads[np.unique(np.searchsorted(heads, np.arange(0, len(raw), chunk)).clip(max=len(heads) - 1))]
        sizes = np.diff(np.append(cuts, len(raw)))
        order = np.argsort(-sizes, kind="stable")
        cuts, sizes = cuts[order], sizes[order]
        deltas = np.zeros(len(raw), np.int16)
        state = np.zeros(len(cuts), np.int64)
        running = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for t in range(int(sizes[0])):
            k = running[t]
            if k <= FEW_LANES:  # the rest of very long pre-tokens, one after the other
                keys = [self.keys[s] for s in state[:k].tolist()]
                for key, cut, size in zip(keys, cuts[:k].tolist(), sizes[:k].tolist(), strict=True):
                    self._run_alone(raw[cut + t : cut + size], begins[cut + t : cut + size], key, deltas[cut + t : cut + size])
                break
            at = cuts[:k] + t
            byte = raw[at]
            now = np.where(begins[at], 0, state[:k])
            flat = now * 256 + byte
            value = self.table.reshape(-1)[flat]
            if (value < 0).any():
                for pair in np.unique(flat[value < 0]).tolist():
                    self._step(pair >> 8, pair & 255)
                value = self.table.reshape(-1)[flat]
            state[:k] = value >> 10
            deltas[at] = (value & 1023) - 512
            if len(self.keys) > MAX_STATES:
                held, where = np.unique(state[:k], return_inverse=True)
                keys = [self.keys[s] for s in held]
                self._empty()
                state[:k] = np.array([self._state(key) for key in keys])[where]
        return deltas

    def _run_alone(self, raw: np.ndarray, begins: np.ndarray, key: tuple, deltas: np.ndarray) -> None:
        """The same for one chunk from a given state, transition by transition."""
        state, known, out = self._state(key), {}, []
        for byte, fresh in zip(raw.tobytes(), begins.tolist(), strict=True):
            if fresh:
                state = 0
            value = known.get(state << 8 | byte)
            if value is None:
                value = int(self.table[state, byte])
                value = known[state << 8 | byte] = value if value >= 0 else self._step(state, byte)
            state = value >> 10
            out.append((value & 1023) - 512)
            if len(self.keys) > MAX_STATES:
                key = self.keys[state]
                self._empty()
                state, known = self._state(key), {}
        deltas[:] = out

    # -- the class transducer -----------------------------------------------------------------------
    def _char_classes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where characters begin, and their classes."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[at].astype(np.int32)
        code = lead.copy()
        padded = np.append(raw, [0, 0, 0]).astype(np.int32)
        for low, high, length in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            some = np.flatnonzero((lead >= low) & (lead < high))
            if len(some):
                value = lead[some] & (0x7F >> length)
                for k in range(1, length):
                    value = value << 6 | padded[at[some] + k] & 0x3F
                code[some] = value
        kinds = self.classes[code]
        kinds[lead >= SPECIAL] = END
        return at, kinds

    def _begins(self, raw: np.ndarray, chunk: int = 128, look: int = 8) -> np.ndarray:
        at, kinds = self._char_classes(raw)
        n = len(kinds)
        lanes = -(-n // chunk)
        padded = np.full(lanes * chunk, END, np.uint8)
        padded[:n] = kinds
        grid = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
        # every chunk as a map of states: all start states run until they have met
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
        open_ = np.arange(lanes)
        single = np.zeros(lanes, np.uint8)
        met_at = np.full(lanes, chunk)
        for t in range(chunk):
            maps[open_] = self.next[maps[open_].astype(np.int16) * CLASSES + grid[t, open_, None]]
            if t % look == look - 1:
                met = (maps[open_] == maps[open_, :1]).all(axis=1)
                done = open_[met]
                met_at[done], single[done] = t + 1, maps[done, 0]
                open_ = open_[~met]
                if not len(open_):
                    break
        for t in range(int(met_at.min()), chunk):
            on = met_at <= t
            single[on] = self.next[single[on].astype(np.int16) * CLASSES + grid[t, on]]
        maps[met_at < chunk] = single[met_at < chunk, None]
        # parallel prefix scan: after round k, a map covers 2**k chunks
        shift = 1
        while shift < lanes:
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
            shift *= 2
        state = np.empty(lanes, np.uint8)
        state[0], state[1:] = START, maps[:-1, START]
        marks = np.empty_like(grid)
        for t in range(chunk):
            flat = state.astype(np.int16) * CLASSES + grid[t]
            marks[t] = self.marks[flat]
            state = self.next[flat]
        marks = marks.T.reshape(-1)[:n]
        begins = np.zeros(len(raw), bool)
        begins[at[(marks & HERE) > 0]] = True
        begins[at[np.flatnonzero(marks & BEFORE) - 1]] = True
        begins[0] = True
        return begins

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each UTF-8 text."""
        out = np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) < BATCH_BYTES):
                held += len(texts[end]) + 1
                end += 1
            joined = b"\xff".join(texts[start:end]) + b"\xff"
            for s in self.special:
                joined = joined.replace(s, b"\xfe")
            raw = np.frombuffer(joined, np.uint8)
            deltas = self._token_deltas(raw, self._begins(raw))
            ends = np.cumsum(deltas, dtype=np.int64)[raw == DOC_END]
            out[start:end] = np.diff(ends, prepend=0)
            start = end
        return out


_compiled: dict[int, Tokenizer] = {}


def _counter(spec):
    def run(batches):
        key = hash(spec.value)
        if key not in _compiled:
            _compiled[key] = Tokenizer(spec.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(_compiled[key].count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for a byte-level BPE file without added begin or end
    tokens; its special tokens' strings inside a text are one token each. A null text is empty and has no
    tokens. Whole texts are read, of any length; repeated rows are counted one by one; other columns are
    ignored; an empty table gives an empty result. No shuffle.
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_counter(spec), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
