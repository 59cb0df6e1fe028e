"""Token counts by a deterministic finite-state transducer over symbols, and by state maps of chunks that compose.

Transducer: what a continuation of a pre-token needs to know of its beginning is only which of its suffixes some token starts with, and
for each of these the last token of the encoding before the suffix and the count there relative to now. That is a state; there are
finitely many, and different words share them. A transition reads one symbol and emits the change of the token count, so the sum along a
path is the count of the text read. States and transitions are compiled when first met and kept; the table starts anew when it is full,
which changes no count.

Chunks: a chunk maps the state at its entry to the state at its exit and a count. A state is the transducer's within a run of one class of
characters, or the few characters since the last place where pre-tokens part for certain. Wherever another character meets white space
the machine is back in its start state, whatever came before, so most chunks' maps are one exit state, a count, and the head that the
entry state still has to read. Maps compose associatively. Neighbours are composed in rounds, which is a prefix scan of which only the
last prefix is asked for; each character is read once, and a map holds no text but heads of chunks that aren't composed yet.
"""

from __future__ import annotations

from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from .bpe import SHOWN, Codec, codec
from .text import SEGMENT, WHITE, Memo, at_hand, per_text, texts

CHUNK = 1 << 16
#: Shorter text since the last certain place is kept as it is.
SHORT = 64
#: A run of this length can't be the beginning of a contraction.
LONG_RUN = 8
#: Runs of one class: letters, numbers, white space, others.
RUNS = regex.compile(rf"(?P<L>\p{{L}}+)|(?P<N>\p{{N}}+)|(?P<W>[{WHITE}]+)|(?P<O>[^\p{{L}}\p{{N}}{WHITE}]+)")
#: Where a run of the first class meets one of the second, pre-tokens part whatever stands around.
PARTS = {("L", "N"), ("N", "L"), ("L", "O"), ("N", "O"), ("O", "N"), ("L", "W"), ("N", "W"), ("O", "W")}


#: Of a suffix that begins a token: its length, the last token before it (-1: none), the count there less the present one.
Open = tuple[int, int, int]


class Transducer:
    def __init__(self, c: Codec, limit: int = 200_000):
        self.v, self.limit = c.v, limit
        self.begins = {s[:i] for s in self.v.ids for i in range(1, len(s))}
        self.reset()

    def reset(self) -> None:
        start = ("", ((0, -1, 0),))
        self.states: list[tuple[str, tuple[Open, ...]]] = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition from a state by a symbol: the next state and the emitted change of the count."""
        v = self.v
        suffix, opened = self.states[state]
        word = suffix + symbol
        kept, token, emitted = [], -1, 0
        for length, before, count in opened:  # the longest first
            own = word[len(suffix) - length :]
            if own in self.begins:
                kept.append((length + 1, before, count))
            if token < 0 and (found := v.ids.get(own)) is not None and (v.itself(found) if before < 0 else v.compatible(before, found)):
                token, emitted = found, count + 1
        if token < 0:
            raise ValueError(f"the vocabulary lacks the symbol {symbol!r}")
        to = (word[len(word) - kept[0][0] :] if kept else "", (*((n, before, count - emitted) for n, before, count in kept), (0, token, 0)))
        number = self.numbers.get(to)
        if number is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
            self.steps.append({})
        self.steps[state][symbol] = number, emitted
        return number, emitted

    def count(self, word: str) -> int:
        return self.run(None, word)[1]

    def run(self, entry: tuple | None, word: str) -> tuple[tuple, int]:
        """The state after a word and the change of the count, from a state's value or from the start."""
        if len(self.states) > self.limit:
            self.reset()
        state, n, steps = 0, 0, self.steps
        if entry is not None:
            state = self.numbers.get(entry, -1)
            if state < 0:
                state = self.numbers[entry] = len(self.states)
                self.states.append(entry)
                self.steps.append({})
        for symbol in word:
            state, emitted = steps[state].get(symbol) or self.compile(state, symbol)
            n += emitted
        return self.states[state], n


class State(NamedTuple):
    """Text since the last certain place; or, in a run of one class, the transducer's state. In white space the last character waits."""

    text: str = ""
    run: str = ""
    inner: tuple | None = None


class StateMap(NamedTuple):
    """From an entry state: read the head's parts; then, if the chunk resets, count what is emitted and be in the exit state."""

    head: tuple[str, ...]
    resets: bool = False
    emitted: int = 0
    exit: State = State()


class Counter:
    def __init__(self, path: str):
        c = codec(path)
        if not c.keeps_white:
            raise ValueError("only byte-level pre-tokenizers are supported")
        self.codec, self.transducer = c, Transducer(c)
        self.segments = Memo(self.segment, 250_000)

    def segment(self, text: str) -> int:
        """From the start state to the next place of reset."""
        return sum(1 if isinstance(p, int) else self.transducer.count(self.codec.v.word(p)) for p in self.codec.pieces(text))

    def counted(self, text: str) -> int:
        """Of text that ends where pre-tokens part."""
        return sum(map(self.segments.__getitem__, SEGMENT.findall(text)))

    def feed(self, inner: tuple | None, text: str) -> tuple[tuple, int]:
        shown = text if text.isascii() and " " < text[:1] and text.isalnum() else text.encode("utf-8", "surrogatepass").decode("latin-1").translate(SHOWN)
        return self.transducer.run(inner, self.codec.v.word(shown)) if text else (inner, 0)

    def settle(self, text: str) -> tuple[State, int]:
        """The state after text from the start state: all up to the last certain place is counted, a long run is in the transducer."""
        if len(text) <= SHORT:
            return State(text), 0
        found = [(m.lastgroup, m.start()) for m in RUNS.finditer(text)]
        last = next((at for (kind, at), (before, _) in zip(found[:0:-1], found[-2::-1]) if (before, kind) in PARTS), 0)
        n, text = self.counted(text[:last]), text[last:]
        (kind, at) = found[-1]
        if kind == "W":  # all that is left
            if len(text) <= SHORT:
                return State(text), n
            inner, more = self.feed(None, text[:-1])
            return State(text[-1], "W", inner), n + more
        if len(text) + last - at < LONG_RUN or len(text) <= SHORT:
            return State(text), n
        *closed, rest = self.codec.pieces(text)
        inner, more = self.transducer.run(None, self.codec.v.word(rest))
        return State("", kind, inner), n + more + sum(1 if isinstance(p, int) else self.transducer.count(self.codec.v.word(p)) for p in closed)

    def step(self, state: State, text: str) -> tuple[State, int]:
        """The state after more text, and the count."""
        if not state.run:
            return self.settle(state.text + text)
        m = RUNS.match(text)
        end = m.end() if m and m.lastgroup == state.run else 0
        own = state.text + text[:end]
        if state.run == "W":
            inner, n = self.feed(state.inner, own[:-1])
            if end == len(text):
                return State(own[-1], "W", inner), n
            after, more = self.settle(own[-1] + text[end:])
            return after, n + more
        inner, n = self.feed(state.inner, own)
        if end == len(text):
            return State("", state.run, inner), n
        after, more = self.settle(text[end:])
        return after, n + more

    def close(self, state: State) -> int:
        """The count of what a state still holds, where pre-tokens part or the text ends."""
        if not state.run:
            return self.counted(state.text)
        return self.feed(state.inner, state.text)[1] if state.text else 0

    def map(self, chunk: str) -> StateMap:
        found = SEGMENT.findall(chunk)
        if len(found) < 2:
            return StateMap((chunk,))
        exit_, n = self.settle(found[-1])
        return StateMap((found[0],), True, sum(map(self.segments.__getitem__, found[1:-1])) + n, exit_)

    def after(self, state: State, b: StateMap) -> tuple[State, int]:
        """What a map makes of an entry state."""
        n = 0
        for part in b.head:
            state, more = self.step(state, part)
            n += more
        return (b.exit, n + self.close(state) + b.emitted) if b.resets else (state, n)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.resets:
            return StateMap(a.head + b.head, b.resets, b.emitted, b.exit)
        exit_, n = self.after(a.exit, b)
        return StateMap(a.head, True, a.emitted + n, exit_)

    def reduced(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, neighbours in rounds."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, text: str, chunk: int = CHUNK) -> int:
        split = self.codec.v.special_split
        if split and any(s in text for s in self.codec.v.special):  # special strings part pre-tokens on both sides
            return sum(1 if x in self.codec.v.special else self.total(x, chunk) for x in split.split(text) if x)
        if not text:
            return 0
        exit_, n = self.after(State(), self.reduced([self.map(text[i : i + chunk]) for i in range(0, len(text), chunk)]))
        return n + self.close(exit_)


def counter(path: str) -> Counter:
    return at_hand("tokens", ("counter", path), lambda k: Counter(k[1]))


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row, without a shuffle.

    A null or empty text has no bytes and no tokens; repeated rows repeat; a null doc_id stays null; very long texts, unbroken ones too, go
    chunk by chunk in memory of a few times their size; other columns aren't read; an empty table gives no rows.
    """

    def rows(text):
        n = counter(path).total(text, chunk) if text else 0
        return len((text or "").encode("utf-8", "surrogatepass")), n, n > limit

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return texts(docs, id_col, text_col).mapInArrow(per_text(schema, rows, ["n_bytes", "n_tokens", "over_limit"], "tokens"), schema)
