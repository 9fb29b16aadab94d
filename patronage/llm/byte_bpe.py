"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding.  A token sequence is the BPE encoding of its bytes exactly if each
pair of neighbours is (that is, if encoding the pair's bytes gives the pair
back), so an encoder needs to remember one token only.  The nondeterministic
transducer guesses where the next token ends: it walks the vocabulary's trie
and may accept a token that is compatible with the one before.  ``Transducer``
determinises it lazily: a state is the set of open guesses with the tokens each
still owes, states and transitions are made when a byte first asks for them,
and a token is emitted as soon as all open guesses agree on it.  As a guess
cannot be longer than the longest token, the lookahead is bounded.

Decoding.  Ids become bytes; an incremental UTF-8 state machine turns chunks of
them into text whose boundaries may fall within a character.

What a task remembers (states, transitions, pairs of tokens, encoded matches) is
bounded by bytes and begun anew when it is full, also in the midst of a match.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import give_back, small_batches, table, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
# Bytes, as estimated (it takes about six tenths of them), of all that a worker remembers; of these the shares
# of the transducer, of pairs of tokens and of encoded matches.  A full table is begun anew.
MEMORY = 640 << 20
MACHINE_SHARE, PAIR_SHARE, WORD_SHARE = 1 / 2, 1 / 8, 3 / 8
# Estimated bytes of an entry: a pair or end, a transition, what it emits, a state, each of its numbers, a match (without its content).
PAIR, STEP, EMITTED, STATE, NUMBER, WORD = 110, 115, 110, 190, 10, 200
CHUNK = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """The encoding by definition: merge the pair of lowest rank, leftmost first, until none is left (``below`` a rank)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Deterministic states over bytes, made on demand.

    A state is a tuple of numbers: the token emitted last (-1 at first), and for
    each open guess, the oldest first, its node in the vocabulary's trie, how
    many tokens it owes, and these.
    """

    START = (-1, 0, 0)

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.ranks = ranks
        self.most, self.most_pairs = int(memory * MACHINE_SHARE), int(memory * PAIR_SHARE)
        self.token_bytes = {i: b for b, i in ranks.items()}
        # The trie: (node, byte) to the node of a longer prefix, and to the token that ends there.
        numbers, self.walk, self.accept = {b"": 0}, {}, {}
        for data, token in ranks.items():
            for n in range(1, len(data)):
                if data[:n] not in numbers:
                    self.walk[numbers[data[: n - 1]] << 8 | data[n - 1]] = numbers[data[:n]] = len(numbers)
            self.accept[numbers[data[:-1]] << 8 | data[-1]] = token
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.alone: dict[int, bool] = {}
        self.follows: dict[int, bool] = {}
        self.clear()

    def clear(self, state: int = 0) -> int:
        """Forget all states but the first and the given one, whose new number is returned."""
        kept = self.states[state] if state else self.START
        self.numbers, self.states, self.size = {}, [], 0
        # A transition is the number of the next state, with the tokens that it emits if there are any.
        self.steps: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.number(self.START)
        return self.number(kept)

    def number(self, guesses: tuple) -> int:
        known = self.numbers.get(guesses)
        if known is None:
            known = self.numbers[guesses] = len(self.states)
            self.states.append(guesses)
            self.size += STATE + NUMBER * len(guesses)
        return known

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            data = self.token_bytes[token]
            parts = merged(data, self.ranks, token) if len(data) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = merged(self.token_bytes[token], self.ranks) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of both is just the two.

        It is, unless at some time in their making a merge across the border
        comes first.  The tokens on either side of the border are followed back
        to the single bytes, undoing the later merge first; of equal ranks the
        left one is the earlier.
        """
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) * PAIR > self.most_pairs:
                self.follows.clear()
            known = self.follows[key] = self.stands(right) if left < 0 else self.stands(left) and self.stands(right) and self.border(left, right)
        return known

    def border(self, left: int, right: int) -> bool:
        ranks, token_bytes = self.ranks, self.token_bytes
        # A merge across counts if it comes before the merge that was undone last.
        before, undone_left = 1 << 60, False
        while True:
            across = ranks.get(token_bytes[left] + token_bytes[right])
            if across is not None and (across < before or across == before and not undone_left):
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, undone_left, left = left, True, a[1]
            else:
                before, undone_left, right = right, False, b[0]

    def step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """The next state, and the tokens that are now certain."""
        guesses, walk, accept, follows = [], self.walk.get, self.accept.get, self.follows.get
        held = self.states[state]
        before, at, end = held[0], 1, len(held)
        while at < end:
            edge, owed = held[at] << 8 | byte, held[at + 2 : at + 2 + held[at + 1]]
            at += 2 + len(owed)
            longer = walk(edge)
            if longer is not None:
                guesses.append((longer, owed))
            token = accept(edge)
            if token is not None:
                last = owed[-1] if owed else before
                fits = follows(last << 32 | token)
                if fits or fits is None and self.compatible(last, token):
                    guesses.append((0, (*owed, token)))
        first, agreed = guesses[0][1], 0
        for token in first:
            for _, owed in guesses:
                if len(owed) <= agreed or owed[agreed] != token:
                    break
            else:
                agreed += 1
                continue
            break
        target = [first[agreed - 1] if agreed else before]
        for node, owed in guesses:
            target += (node, len(owed) - agreed, *owed[agreed:])
        found = self.number(tuple(target))
        self.size += STEP
        if agreed:
            self.size += EMITTED
            found = found, first[:agreed]
        self.steps[state << 8 | byte] = found
        return found

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens owed by the one guess that ends here."""
        known = self.ends.get(state)
        if known is None:
            held, at = self.states[state], 1
            while held[at]:
                at += 2 + held[at + 1]
            self.size += PAIR
            known = self.ends[state] = held[at + 2 : at + 2 + held[at + 1]]
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is a token stands for itself
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, known = 0, self.steps.get
        for byte in piece:
            found = known(state << 8 | byte)
            if found is None:
                if self.size > self.most:
                    state, known = self.clear(state), self.steps.get
                found = self.step(state, byte)
            if found.__class__ is int:
                state = found
            else:
                state, emitted = found
                out += emitted
        out += self.end(state)
        return out


class Words(dict):
    """Encodings of the pattern's matches, as ids joined by spaces, made when first asked for."""

    def __init__(self, transducer: Transducer, memory: int = MEMORY):
        self.transducer, self.most, self.size = transducer, int(memory * WORD_SHARE), 0

    def __missing__(self, word: str) -> str:
        known = " ".join(map(str, self.transducer.encode(word.encode("utf-8", "surrogatepass"))))
        if len(word) <= 64:
            if self.size > self.most:
                self.clear()
                self.size = 0
            self.size += WORD + len(word) + len(known)
            self[word] = known
        return known


def encoder_of(path: str, pattern: str, memory: int = MEMORY) -> Encoder:
    """An encoder that lasts as long as the worker process, whose tasks share what it has made."""
    held = sys.modules.setdefault("patronage_encoders", types.ModuleType("patronage_encoders"))
    key = f"{path}\n{pattern}\n{memory}"
    if not hasattr(held, key):
        give_back()
        setattr(held, key, Encoder(path, pattern, memory))
    return getattr(held, key)


class Encoder:
    """Splits text by the pattern and encodes each match; remembers the matches it has seen."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        import regex

        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks, memory)
        self.matches = regex.compile(pattern).findall
        self.known = Words(self.transducer, memory)

    def close(self) -> None:
        self.known.clear()
        self.transducer.clear()
        self.transducer.follows.clear()

    def rendered(self, text: str) -> Iterator[str]:
        """The ids of successive parts of the text, joined by spaces."""
        for piece in pieces(text):
            found = self.matches(piece)
            if found:
                yield " ".join(map(self.known.__getitem__, found))

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of successive parts of the text."""
        for ids in self.rendered(text):
            yield [int(i) for i in ids.split(" ")]


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a long text, cut before a single space between two characters that are not white.

    There the pattern always begins a match, so the parts encode like the whole.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


class Utf8Machine:
    """Bytes to text in chunks.  The state is the beginning of a character whose other bytes are still to come.

    Bytes that are no UTF-8 become U+FFFD, as if all chunks were decoded at once.
    """

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        # The last first byte of a character is among the last three, or the character is complete.
        for back in range(1, min(3, cut) + 1):
            first = data[-back]
            if first & 0xC0 != 0x80:
                size = 4 if first >= 0xF0 else 3 if first >= 0xE0 else 2 if first >= 0xC2 else 1
                if size > back:
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes and text in chunks; ``token_bytes`` has the bytes of each id, or of its decimal form."""

    def __init__(self, token_bytes: dict):
        self.token_bytes, self.machine = token_bytes, Utf8Machine()

    def feed(self, ids: Iterable) -> tuple[bytes, str]:
        data = b"".join(map(self.token_bytes.__getitem__, ids))
        return data, self.machine.feed(data)

    def end(self) -> str:
        return self.machine.end()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"


def token_ids(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a text column as an array; null and empty texts have none."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(path, pattern)
        for column in columns:
            yield pa.array([[i for part in encoder.encode(t.as_py() or "") for i in part] for t in column], pa.list_(pa.int32()))

    return ids(text)


def decoded_text(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null and empty arrays give the empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token_bytes = {i: b for b, i in read_ranks(path).items()}
        for column in columns:
            out = []
            for row in column:
                decoder, known = Decoder(token_bytes), row.as_py() or []
                parts = [decoder.feed(known[i : i + CHUNK])[1] for i in range(0, len(known), CHUNK)]
                out.append("".join(parts) + decoder.end())
            yield pa.array(out, pa.string())

    return text(ids)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, memory: int = MEMORY, lasting: bool = True) -> DataFrame:
    """One row per row: id, number of tokens, digests of the ids and of the decoded bytes, whether the text came back.

    A null text counts as empty: no tokens, digests of nothing.  Repeated rows
    give repeated results; other columns are ignored.  Texts are worked on in
    parts, so that a very long one needs little more than itself.  ``memory``
    bounds what a worker remembers between them.  Unless ``lasting``, it is
    given back when a task ends: an executor may keep more idle workers than it
    has cores, each with its own.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not lasting:
            give_back()
        encoder = encoder_of(path, pattern, memory) if lasting else Encoder(path, pattern, memory)
        token_bytes = {str(i): b for i, b in encoder.transducer.token_bytes.items()}
        for batch in batches:
            rows = []
            for scalar in batch.column(1):
                text = scalar.as_py()
                decoder, of_ids, of_bytes = Decoder(token_bytes), hashlib.sha256(), hashlib.sha256()
                n, same, at = 0, True, 0
                for ids in encoder.rendered(text):
                    of_ids.update((" " + ids if n else ids).encode())
                    each = ids.split(" ")
                    n += len(each)
                    data, part = decoder.feed(each)
                    of_bytes.update(data)
                    same = same and text.startswith(part, at)
                    at += len(part)
                same = same and not decoder.end() and at == len(text)
                rows.append((n, of_ids.hexdigest(), of_bytes.hexdigest(), same))
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"],
            )
        if not lasting:
            encoder.close()
            del encoder
            give_back()

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), whole_text(text_col).alias("text")).mapInArrow(digest, f"`{id_col}` {kind}, {DIGEST}")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
