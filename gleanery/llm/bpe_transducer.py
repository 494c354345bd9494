"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Byte-pair merges give every prefix of a piece exactly one encoding, and a row of tokens is
an encoding if and only if each two neighbours stay apart, that is, no merge across their
border ever has its turn. So a transducer can guess token borders from left to right: a
guess is a place in the trie of tokens and the tokens before it. Its determinised form
holds all guesses alive, as few as the longest token has bytes, and emits the tokens on
which they agree, after a look-ahead of less than the longest token. States and moves are made when
a text first needs them, and are forgotten together once there are too many.

The decoder joins the bytes of tokens and keeps a UTF-8 machine: text is handed on up to
the last whole character, the rest waits for the next ids. Tokens that lead from one
character border to another, nearly all, are stepped over at once.

Equal pieces of a batch pass the transducer once.

Defined cases: null texts are empty and have no ids; a text with an invalid byte sequence
after decoding (possible for ids that no text gave) shows U+FFFD there, and its bytes are
as they are; ids and nulls of doc_id pass unchanged and repeated rows stay; an empty table
gives an empty result. Columns that are added replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.wordhash import batches

#: States and remembered pairs of a worker before it forgets them.
MOST_STATES = 250_000
MOST_PAIRS = 500_000
#: Pieces whose ids a worker remembers, and the longest one.
MOST_PIECES = 400_000
LONGEST_PIECE = 64
#: Characters from which on a text is split step by step, and pieces in a step.
LONG_TEXT = 4_000_000
STEP = 200_000
#: Ids decoded at once.
DECODED = 1 << 16

_NEVER = 1 << 62


class Merges:
    """Ranks compiled to the trie of tokens and the merge that makes each token."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing}")
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        #: When a token comes to be: bytes are there from the start.
        self.born = {rank: rank if len(token) > 1 else -1 for token, rank in ranks.items()}
        #: Merge of two tokens -> the token it makes.
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that merges never give; a piece that is one has its id alone.
        self.whole: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                continue
            parts = self._merged(token, rank)
            # A later merge must never come before an earlier one.
            if len(parts) == 2 and max(map(self.born.__getitem__, parts)) < rank:
                self.made[parts[0], parts[1]] = rank
                self.halves[rank] = parts[0], parts[1]
            else:
                self.whole[token] = rank
        #: Per place in the trie: byte -> (next place, token that ends there or -1, whether
        #: longer tokens go on from there).
        self.steps: list[dict[int, tuple[int, int, bool]]] = [{}]
        for token, rank in ranks.items():
            if token not in self.whole:
                self._plant(token, rank)

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The parts of a token after all merges of lower rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while True:
            found = [self.ranks.get(a + b, below) for a, b in itertools.pairwise(parts)]
            least = min(found, default=below)
            if least >= below:
                return [self.ranks[p] for p in parts]
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _plant(self, token: bytes, rank: int) -> None:
        place, last = 0, len(token) - 1
        for i, byte in enumerate(token):
            fresh = (len(self.steps), -1, False)
            after, end, on = self.steps[place].get(byte, fresh)
            self.steps[place][byte] = after, rank if i == last else end, on or i < last
            if after == len(self.steps):
                self.steps.append({})
            place = after

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are.

        Goes back in time through the parts that touch the border. A merge across it
        happens if both its parts are there at its turn; of two merges of the same rank
        the one further left comes first.
        """
        made, halves, born = self.made, self.halves, self.born
        left_end = right_end = _NEVER
        while True:
            across = made.get((left, right))
            if across is not None and across < left_end and across <= right_end:
                return False
            left_born, right_born = born[left], born[right]
            if left_born < 0 and right_born < 0:
                return True
            if left_born > right_born:
                left_end, left = left, halves[left][1]
            else:
                right_end, right = right, halves[right][0]


class Transducer:
    """Bytes to token ids; states are numbers, 0 before the first byte."""

    def __init__(self, merges: Merges, most_states: int = MOST_STATES):
        self.merges = merges
        self.most_states = most_states
        #: Per state: byte -> (next state, tokens emitted).
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        #: Per state: tokens still owed if the piece ends here.
        self.owed: list[tuple[int, ...]] = []
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.moves.clear()
        self.owed.clear()
        self.guesses: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self._number((-1, ((0, ()),)))

    def _number(self, state: tuple) -> int:
        """The number of a state: the last token emitted, and all guesses as (place in
        the trie, tokens not yet emitted before it), the longest unfinished token first."""
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.moves)
            self.guesses.append(state)
            self.moves.append({})
            self.owed.append(state[1][-1][1])
        return number

    def _apart(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merges.apart(left, right)
        return known

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, guesses = self.guesses[number]
        steps = self.merges.steps
        alive, finished = [], None
        for place, waiting in guesses:
            step = steps[place].get(byte)
            if step is None:
                continue
            place, token, goes_on = step
            if goes_on:
                alive.append((place, waiting))
            if token >= 0 and finished is None:
                last = waiting[-1] if waiting else before
                if last < 0 or self._apart(last, token):
                    finished = (*waiting, token)
        shared = len(finished)
        for _, waiting in alive:
            most, shared = min(shared, len(waiting)), 0
            while shared < most and waiting[shared] == finished[shared]:
                shared += 1
            if not shared:
                break
        emitted = finished[:shared]
        if shared:
            alive = [(place, waiting[shared:]) for place, waiting in alive]
            # The last token emitted counts only while a token may follow it directly.
            before = emitted[-1]
        alive.append((0, finished[shared:]))
        # Older guesses wait for fewer tokens, but not always for the fewest.
        if before >= 0 and all(waiting for _, waiting in alive):
            before = -1
        if len(self.moves) >= self.most_states:
            self._clear()
            return self._number((before, tuple(alive))), emitted
        move = self._number((before, tuple(alive))), emitted
        self.moves[number][byte] = move
        return move

    def feed(self, data: bytes, state: int, ids: list[int]) -> int:
        """Append the tokens that are certain after ``data``; returns the state."""
        moves = self.moves
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                ids += emitted
        return state

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if data in self.merges.whole:
            return [self.merges.whole[data]]
        ids: list[int] = []
        state = self.feed(data, 0, ids)
        ids += self.owed[state]
        return ids


def _char_class(characters: set[str]) -> str:
    """A class of the pattern language, as ranges; without characters it never matches."""
    codes = np.array(sorted(map(ord, characters)), np.int64)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    spans = [f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs if len(run)]
    return f"[{''.join(spans)}]" if spans else "(?!)"


def _splitter(pattern: str):
    """Text -> pieces, with the character classes of the tokenizer's own library.

    Its tables of letters and numbers are of another Unicode version than those of the
    pattern library here. A character of which they differ is split by a stand-in.
    """
    import regex
    import tiktoken

    rule = regex.compile(pattern)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    alone = {bytes([b]): b for b in range(256)}
    there, here = [], []
    for letters in (r"\p{L}", r"\p{N}"):
        found = tiktoken.Encoding(
            "class", pat_str=f"{letters}+", mergeable_ranks=alone, special_tokens={}
        ).encode_ordinary(every)
        there.append(set(bytes(found).decode()))
        here.append(set(regex.findall(letters, every)))
    odd = (there[0] ^ here[0]) | (there[1] ^ here[1])
    stand_in = {
        ord(c): "a" if c in there[0] else "0" if c in there[1] else "�" for c in odd
    }
    search = re.compile(_char_class(odd)).search
    wide = min(map(ord, odd), default=0) > 0xFF

    def plain(text: str) -> bool:
        """Whether both libraries split a text alike."""
        if wide:
            try:  # by far the fastest test
                text.encode("latin-1")
                return True
            except UnicodeEncodeError:
                pass
        return search(text) is None

    def pieces(text: str) -> Iterator[list[str]]:
        if not plain(text):
            marks = rule.finditer(text.translate(stand_in))
            found = (text[m.start() : m.end()] for m in marks)
        elif len(text) < LONG_TEXT:
            yield rule.findall(text)
            return
        else:
            found = (m.group() for m in rule.finditer(text))
        while part := list(itertools.islice(found, STEP)):
            yield part

    return pieces


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: Merges, pattern: str):
        self.transducer = Transducer(merges)
        self.pieces = _splitter(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of all these pieces; short ones are remembered."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, once = self.known, {}
        encode = self.transducer.piece
        for piece in pieces.difference(known):
            ids = array("I", encode(piece.encode())).tobytes()
            (known if len(piece) <= LONGEST_PIECE else once)[piece] = ids
        return once | known if once else known

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            found = []
            for pieces in self.pieces(text or ""):
                ids = self._learn(set(pieces))
                found.append(b"".join(map(ids.__getitem__, pieces)))
            yield found[0] if len(found) == 1 else b"".join(found)


#: Fixed values of UTF-8: first bytes, the range of the next byte, and how many continue.
_FIRST_BYTES = [
    (0x00, 0x7F, None, 0),
    (0xC2, 0xDF, (0x80, 0xBF), 1),
    (0xE0, 0xE0, (0xA0, 0xBF), 2),
    (0xE1, 0xEC, (0x80, 0xBF), 2),
    (0xED, 0xED, (0x80, 0x9F), 2),
    (0xEE, 0xEF, (0x80, 0xBF), 2),
    (0xF0, 0xF0, (0x90, 0xBF), 3),
    (0xF1, 0xF3, (0x80, 0xBF), 3),
    (0xF4, 0xF4, (0x80, 0x8F), 3),
]


def _utf8_machine() -> list[list[int]]:
    """Next state by state and byte; 0 is the border of a character. A byte that cannot
    follow ends the character, and counts as the first of the next one."""
    states: dict[tuple, int] = {(): 0}
    table: list[list[int]] = []
    start = [0] * 256
    wanted = [()]
    for low, high, span, more in _FIRST_BYTES:
        state = (*span, more) if span else ()
        if state not in states:
            states[state] = len(states)
            wanted.append(state)
        start[low : high + 1] = [states[state]] * (high + 1 - low)
    for state in wanted:  # grows
        row = list(start)
        if state:
            low, high, more = state
            after = (0x80, 0xBF, more - 1) if more > 1 else ()
            if after not in states:
                states[after] = len(states)
                wanted.append(after)
            row[low : high + 1] = [states[after]] * (high + 1 - low)
        table.append(row)
    return table


_UTF8 = _utf8_machine()


class Decoder:
    """Token bytes with the machine's moves over whole tokens."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.after = [self._across(state) for state in range(len(_UTF8))]
        self.open = np.ones(max(tokens) + 1, bool)
        for token in tokens:
            self.open[token] = self._state(0, token) != 0

    def _across(self, state: int) -> dict[int, int]:
        return {}

    def _state(self, state: int, token: int) -> int:
        """The state after a token, computed when first needed."""
        moves = self.after[state]
        if token not in moves:
            for byte in self.tokens[token]:
                state = _UTF8[state][byte]
            moves[token] = state
        return moves[token]

    def border(self, ids: np.ndarray, state: int) -> tuple[int, int]:
        """Number of ids up to the last border of a character, and the state after all;
        -1 if no border is reached."""
        last = len(ids) if state == 0 else -1
        marks = np.flatnonzero(self.open[ids])
        at = 0
        while True:
            if state == 0:
                next_mark = int(np.searchsorted(marks, at))
                if next_mark == len(marks):
                    return len(ids), 0
                at = last = int(marks[next_mark])
            if at == len(ids):
                return last, state
            state = self._state(state, int(ids[at]))
            at += 1

    def stream(self, parts: Iterable[np.ndarray]) -> Iterator[tuple[bytes, str]]:
        """Bytes of each part of a row of ids, and the text up to the last whole
        character; what is left over comes with the last pair."""
        state, held = 0, b""
        tokens = self.tokens
        for ids in parts:
            whole, state = self.border(ids, state)
            data = b"".join(map(tokens.__getitem__, ids.tolist()))
            if whole < 0:
                held += data
                yield data, ""
                continue
            rest = sum(len(tokens[i]) for i in ids[whole:].tolist())
            cut = len(data) - rest
            text = (held + data[:cut]).decode("utf-8", errors="replace")
            held = data[cut:]
            yield data, text
        if held:
            yield b"", held.decode("utf-8", errors="replace")


def read_ranks(path: str) -> bytes:
    """A rank file as it is, read here and sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in raw.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


#: Encoders and decoders of a worker, by digest of the rank file and pattern.
_READY: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _codec(raw: bytes, name: str, pattern: str) -> tuple[Encoder, Decoder]:
    if (name, pattern) not in _READY:
        _READY.clear()
        merges = Merges(parse_ranks(raw))
        _READY[name, pattern] = Encoder(merges, pattern), Decoder(merges.bytes)
    return _READY[name, pattern]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _over_batches(frame: DataFrame, column: str, work, schema: str, ranks, pattern) -> DataFrame:
    """``work(batch, encoder, decoder)`` over slices of a few megabytes."""
    raw = read_ranks(ranks or default_ranks())
    name, rule = hashlib.sha256(raw).hexdigest(), pattern or default_pattern()
    sent = frame.sparkSession.sparkContext.broadcast(raw)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(sent.value, name, rule)
        for part in parts:
            for batch in batches(part, column):
                yield work(batch, encoder, decoder)

    return frame.mapInArrow(run, schema)


def _added(frame: DataFrame, name: str, kind: str, source: str) -> tuple[DataFrame, str]:
    """The columns carried as one struct beside the input of a task, and its schema."""
    carried = [c for c in frame.columns if c.lower() != name]
    row = F.struct(*carried).alias("row") if carried else F.lit(None).cast("string").alias("row")
    thin = frame.select(row, F.col(source).alias("input"))
    return thin, f"row {thin.schema['row'].dataType.simpleString()}, {name} {kind}"


def _spread(found: DataFrame, name: str, carried: list[str]) -> DataFrame:
    return found.select(*[F.col("row")[c].alias(c) for c in carried], name)


def encode(
    documents: DataFrame, text_column: str = "text", ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """All columns plus ``ids`` (array of int), in the order of the text."""
    thin, schema = _added(documents, "ids", "array<int>", text_column)

    def work(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder) -> pa.RecordBatch:
        ids = [np.frombuffer(i, "<u4") for i in encoder.texts(batch.column("input").to_pylist())]
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "ids"])

    found = _over_batches(thin, "input", work, schema, ranks, pattern)
    return _spread(found, "ids", [c for c in documents.columns if c.lower() != "ids"])


def decode(
    encoded: DataFrame, ids_column: str = "ids", ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """All columns plus ``text``, decoded from the ids; null ids give an empty text."""
    thin, schema = _added(encoded, "text", "string", ids_column)
    raw = read_ranks(ranks or default_ranks())
    name, rule = hashlib.sha256(raw).hexdigest(), pattern or default_pattern()
    sent = encoded.sparkSession.sparkContext.broadcast(raw)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _codec(sent.value, name, rule)[1]
        for batch in parts:
            texts = []
            for ids in batch.column("input"):
                flat = np.asarray(ids.values) if ids.is_valid else np.empty(0, np.int32)
                texts.append("".join(text for _, text in decoder.stream(_parts(flat))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string())], ["row", "text"]
            )

    found = thin.mapInArrow(run, schema)
    return _spread(found, "text", [c for c in encoded.columns if c.lower() != "text"])


def _parts(ids: np.ndarray) -> Iterator[np.ndarray]:
    return (ids[at : at + DECODED] for at in range(0, len(ids), DECODED))


def _digests(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder) -> pa.RecordBatch:
    counts, ids_names, text_names, characters = [], [], [], []
    for raw in encoder.texts(batch.column("text").to_pylist()):
        digest, length = hashlib.sha256(), 0
        for data, text in decoder.stream(_parts(np.frombuffer(raw, "<u4"))):
            digest.update(data)
            length += len(text)
        counts.append(len(raw) // 4)
        ids_names.append(hashlib.sha256(raw).hexdigest())
        text_names.append(digest.hexdigest())
        characters.append(length)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_names, pa.string()),
            pa.array(text_names, pa.string()), pa.array(characters, pa.int64()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_characters"],
    )


def op12_bpe_transducer(
    documents: DataFrame, ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """All documents encoded, and decoded again from their ids."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
        "n_characters bigint"
    )
    thin = documents.select("doc_id", "text")
    return _over_batches(thin, "text", _digests, schema, ranks, pattern)
