"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model becomes three machines: a normaliser (the model's character map as a transducer that takes the longest rule at
each place, then white space), the pieces as a trie transducer from characters to piece ids, and byte fallback for
characters that no piece has. An input, a chain of characters, is
composed with them; the tropical-semiring shortest path of the lattice gives the ids.

A unigram model weighs an arc with the piece's negative score. A byte-pair model merges greedily; its encoding is the
one sequence in which every two neighbouring pieces stay apart when they are encoded alone. So its machine has a
state for each last piece, an arc of weight 0 where two pieces may follow each other, and no arc (infinite weight)
elsewhere; the shortest path is then the only path of finite weight.

No piece has white space behind another character, so paths of different words don't touch: words are encoded once and
kept in a bounded table of the worker. New words of a batch are composed and searched together, place by place, with
the trie as a transition table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import HELD, release, slices, text_bytes

SPACE = "▁"
#: Words that a task remembers; the table is emptied when it is full.
REMEMBERED = 250_000
#: Types of pieces and kinds of models in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters with a column of their own in the transition table; words up to this length are searched together.
COLUMNS, TOGETHER = 192, 48
#: Slots of the table of piece pairs, and words that are searched at a time.
PAIRS, BATCH = 1 << 21, 8192
#: Bytes of text that are encoded together.
TEXT = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


def _transducer(outputs: dict) -> dict:
    trie: dict = {}
    for key, output in outputs.items():
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[""] = output
    return trie


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a model's precompiled character map: a double-array trie of keys, then the texts they become.

    All keys are listed by following every live arc from the root, level by level.
    """
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64), blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    labels, rules = np.arange(1, 256), {}
    states, keys = np.array([offset(units[0])]), [b""]
    while len(states):
        to = states[:, None] ^ labels
        unit = units[np.minimum(to, len(units) - 1)]
        which, label = np.nonzero((to < len(units)) & ((unit & 0x800000FF) == labels))
        unit, to = unit[which, label], to[which, label]
        keys = [keys[w] + bytes([x + 1]) for w, x in zip(which.tolist(), label.tolist(), strict=True)]
        states = to ^ offset(unit)
        for k in np.flatnonzero(unit & 256).tolist():
            value = int(units[states[k]]) & 0x7FFFFFFF
            rules[keys[k].decode()] = texts[value : texts.index(b"\0", value)].decode()
    return rules


def normaliser_options(spec: bytes) -> dict:
    """Options of a Machine from a model's normaliser message."""
    part = dict(_fields(spec))
    options = {name: bool(part.get(k, 1)) for name, k in (("dummy_prefix", 3), ("squeeze", 4), ("escape", 5))}
    return options | ({"rules": character_map(part[2])} if part.get(2) else {})


@dataclass
class Machine:
    """A compiled model."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    rules: dict = field(default_factory=dict)
    trie: dict = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        # Arcs of the transducers: state -> character -> state; key "" holds the output, a piece or a text, that ends there.
        self.trie = _transducer(self.ids)
        self.normaliser = _transducer(self.rules)
        # Words end before a space only if no piece goes on over such a place.
        self.cut = not any(a != SPACE == b for p in self.ids for a, b in zip(p, p[1:]))
        self.lines = bool(self.bytes) and not any("\n" in p for p in self.ids)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self._edges: dict[str, list[tuple[float, str, str]]] = {}
        self._grid: Grid | None = None

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def mapped(self, text: str) -> str:
        """The text through the normaliser's transducer: at each place the longest rule, else the character itself."""
        first, out, at, copied = self.normaliser, [], 0, 0
        while at < len(text):
            node, end, best = first.get(text[at]), at + 1, None
            while node is not None:
                if "" in node:
                    best = (end, node[""])
                node, end = (node.get(text[end]) if end < len(text) else None), end + 1
            if best is None:
                at += 1
                continue
            out += [text[copied:at], best[1]]
            at = copied = best[0]
        return "".join([*out, text[copied:]])

    def normalise(self, text: str) -> str:
        if self.normaliser:
            text = self.mapped(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def apart(self, left: str, right: str) -> bool:
        """Whether a byte-pair model keeps the pieces apart when it encodes left + right.

        Replays the merges inside both, best score first, with an eye on the two symbols at the border: they must
        never be the best pair.
        """
        ids, scores, never = self.ids, self.scores, float("-inf")
        lefts, rights = self.edges(left), self.edges(right)
        i = j = 0
        a, b = left[-1], right[0]
        while True:
            across = ids.get(a + b)
            next_left = lefts[i][0] if i < len(lefts) else never
            next_right = rights[j][0] if j < len(rights) else never
            if across is not None and scores[across] > next_left and scores[across] >= next_right:
                return False
            if next_left == next_right == never:
                return True
            if next_left >= next_right:
                a, i = lefts[i][2], i + 1
            else:
                b, j = rights[j][1], j + 1

    def edges(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges inside a piece in order: score, and the first and last symbol afterwards."""
        known = self._edges.get(piece)
        if known is None:
            parts, known = list(piece), []
            while True:
                best = None
                for k in range(len(parts) - 1):
                    i = self.ids.get(parts[k] + parts[k + 1])
                    if i is not None and (best is None or self.scores[i] > best[0]):
                        best = (self.scores[i], k)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                known.append((best[0], parts[0], parts[-1]))
            self._edges[piece] = known
        return known

    def alone(self, piece: str) -> bool:
        """Whether a byte-pair model encodes the piece's text as the piece."""
        edges = self.edges(piece)
        return len(piece) == 1 or bool(edges) and edges[-1][1] == piece

    def lattice(self, text: str) -> list[list[tuple[int, int]]]:
        """Composition of the text's chain with the pieces: arcs (end, piece id) by start; -1 is a fallback arc."""
        arcs: list[list[tuple[int, int]]] = []
        for start in range(len(text)):
            node, out = self.trie, []
            for end in range(start, len(text)):
                node = node.get(text[end])
                if node is None:
                    break
                if "" in node:
                    out.append((end + 1, node[""]))
            if not any(end == start + 1 for end, _ in out):
                out.append((start + 1, -1))
            arcs.append(out)
        return arcs

    def shortest(self, text: str) -> list[int]:
        """Piece ids (-1 for a fallback arc) of the tropical shortest path through the lattice."""
        arcs = self.lattice(text)
        n = len(text)
        if self.kind == UNIGRAM:
            floor = min((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0) - 10.0
            cost = [0.0] + [np.inf] * n
            back: list = [None] * (n + 1)
            for start in range(n):
                for end, i in arcs[start]:
                    weight = cost[start] - (floor if i < 0 else self.scores[i])
                    if weight < cost[end]:
                        cost[end], back[end] = weight, (start, i)
        else:
            # One state is alive at each place: a prefix has one encoding, so one last piece.
            alive: list = [None] * (n + 1)
            back = [None] * (n + 1)
            alive[0] = ""
            for start in range(n):
                last = alive[start]
                if last is None:
                    continue
                for end, i in arcs[start]:
                    piece = text[start:end]
                    if alive[end] is None and (self.apart(last, piece) if last else self.alone(piece)):
                        alive[end], back[end] = piece, (start, i)
        out, at = [], n
        while at:
            at, i = back[at]
            out.append(i)
        return out[::-1]

    def encode_word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out, at = [], 0
        for i in self.shortest(word):
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in word[at].encode()]
            elif not out or out[-1] != self.unknown:  # unknown characters side by side are one piece
                out.append(self.unknown)
            at += 1
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; null and empty texts have none."""
        texts = [self.normalise(t or "") for t in texts]
        if not self.cut or not self.escape:
            return [self.encode_word(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words = self.words
        split = [self._words(t) for t in texts]
        fresh = list({w for part in split for w in part if w not in words})
        if self.kind == BPE:
            self._grid = self._grid or Grid(self)
            short = sorted((w for w in fresh if len(w) <= TOGETHER), key=len)
            for at in range(0, len(short), BATCH):
                self._grid.encode(short[at : at + BATCH], words)
        for word in fresh:
            if word not in words:
                words[word] = self.encode_word(word)
        return [b"".join([words[w] for w in part]) for part in split]

    def _words(self, text: str) -> list[str]:
        """Parts of the text that no piece reaches over: a line end that no piece has stands alone."""
        if "\n" not in text or not self.lines:
            return self._split(text)
        out = []
        for line in text.split("\n"):
            out += self._split(line)
            out.append("\n")
        return out[:-1]

    @staticmethod
    def _split(text: str) -> list[str]:
        """Words, each with the spaces before it: "a▁b▁▁c"."""
        if not text:
            return []
        parts = text.split(SPACE)
        if SPACE * 2 not in text and parts[-1]:
            words = [SPACE + x for x in parts[1:]]
            return [parts[0], *words] if parts[0] else words
        out, spaces = [], 0
        for k, part in enumerate(parts):
            spaces += k > 0
            if part:
                out.append(SPACE * spaces + part)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transduction; bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()])
        if self.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


class Grid:
    """The piece transducer as arrays, and the shortest path of many short words at once (byte-pair models)."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        edges: dict[str, int] = {}
        trie, ends, queue = [{}], [-1], [(machine.trie, 0)]
        while queue:
            node, state = queue.pop()
            for c, below in node.items():
                if c == "":
                    ends[state] = below
                    continue
                edges[c] = edges.get(c, 0) + 1
                trie[state][c] = len(trie)
                queue.append((below, len(trie)))
                trie.append({})
                ends.append(-1)
        single = {p for p in machine.ids if len(p) == 1}
        ranked = sorted((c for c in edges if c in single), key=lambda c: (c != SPACE, ord(c) >= 0x100, -edges[c], c))[:COLUMNS]
        self.column = np.full(0x110000, -1, np.int16)  # other characters: the word is searched alone
        for k, c in enumerate(ranked):
            self.column[ord(c)] = k
        at = {c: k for k, c in enumerate(ranked)}
        self.next = np.full((len(trie), COLUMNS), -1, np.int32)
        for state, row in enumerate(trie):
            for c, below in row.items():
                if c in at:
                    self.next[state, at[c]] = below
        self.ends = np.array(ends, np.int32)
        self.first = len(machine.pieces)  # stands for the start of a word
        self.keys = np.full(PAIRS, -1, np.int64)
        self.follows = np.zeros(PAIRS, bool)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 21)).astype(np.int64)
        go = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(go):
            slot[go] = (slot[go] + 1) & (PAIRS - 1)
            go = go[(self.keys[slot[go]] != keys[go]) & (self.keys[slot[go]] != -1)]
        return slot

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The weight of the arc between two pieces: True for 0, False for infinity."""
        keys = left.astype(np.int64) * (self.first + 1) + right
        slot = self._slots(keys)
        missing = self.keys[slot] == -1
        if missing.any():
            if self.used > PAIRS // 2:
                self.keys[:] = -1
                self.used = 0
                return self.may_follow(left, right)
            pieces, new = self.machine.pieces, np.unique(keys[missing])
            for key in new.tolist():
                a, b = divmod(key, self.first + 1)
                at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - 21
                while self.keys[at] != -1:
                    at = at + 1 & PAIRS - 1
                self.keys[at] = key
                self.follows[at] = self.machine.apart(pieces[a], pieces[b]) if a != self.first else self.machine.alone(pieces[b])
            self.used += len(new)
            slot = self._slots(keys)
        return self.follows[slot]

    def encode(self, words: list[str], into: dict[str, bytes]) -> None:
        """Adds the ids of the words, sorted by length, that have only characters with a column."""
        code = self.column[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        plain = np.minimum.reduceat(code, begin) >= 0
        words = [w for w, ok in zip(words, plain.tolist(), strict=True) if ok]
        size, begin = size[plain], begin[plain]
        if not words:
            return
        n, longest = len(words), int(size[-1])
        last = np.full((longest + 1, n), -1, np.int32)  # the last piece of the path to each place
        back = np.zeros((longest + 1, n), np.int8)
        last[0] = self.first
        for start in range(longest):
            word = np.arange(np.searchsorted(size, start, side="right"), n)
            state = np.zeros(len(word), np.int32)
            for end in range(start + 1, longest + 1):
                state = self.next[state, code[begin[word] + end - 1]]
                going = state >= 0
                word, state = word[going], state[going]
                if not len(word):
                    break
                piece = self.ends[state]
                open_ = np.flatnonzero((piece >= 0) & (last[end, word] < 0))
                if len(open_):
                    ok = open_[self.may_follow(last[start, word[open_]], piece[open_])]
                    last[end, word[ok]] = piece[ok]
                    back[end, word[ok]] = start
                inside = size[word] > end
                word, state = word[inside], state[inside]
                if not len(word):
                    break
        place, word, column = size.copy(), np.arange(n), 0
        out = np.full((n, longest), -1, np.int32)
        while len(word):
            column += 1
            out[word, longest - column] = last[place[word], word]
            place[word] = back[place[word], word]
            word = word[place[word] > 0]
        used = out >= 0
        flat, bounds = out[used].tobytes(), (4 * np.r_[0, np.cumsum(used.sum(1))]).tolist()
        into.update((w, flat[a:b]) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True))


#: Compiled models of this worker by digest; their tables of words and pairs serve all its tasks.
_machines: dict[str, Machine] = {}
HELD.append(_machines)


def machine_of(data: bytes) -> Machine:
    digest = hashlib.sha256(data).hexdigest()
    if digest not in _machines:
        _machines.clear()
        _machines[digest] = compile_model(data)
    return _machines[digest]


def _release() -> None:
    """A function of the module, which tasks get by its name: what they close over are copies."""
    release(_machines)


def compile_model(data: bytes) -> Machine:
    """Compiles a SentencePiece model file; user-defined pieces aren't supported."""
    pieces, scores, types = [], [], []
    options = {"kind": UNIGRAM, "dummy_prefix": True, "squeeze": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            pieces.append(part.get(1, b"").decode())
            scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            types.append(part.get(3, NORMAL))
        elif number == 2:
            options["kind"] = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            options |= normaliser_options(value)
    if options["kind"] not in (UNIGRAM, BPE) or USER in types:
        raise ValueError("only unigram and byte-pair models without user-defined pieces are supported")
    return Machine(pieces, scores, types, **options)


def _tokenised(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared.value)
        for batch in batches:
            _, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for at, end in slices(offsets, TEXT):
                part = batch.slice(at, end - at)
                texts = part.column(part.num_columns - 1).to_pylist()
                rows = []
                for text, ids in zip(texts, machine.encode(texts), strict=True):
                    decoded = machine.decode(np.frombuffer(ids, "<i4"))
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded == (text or ""), ids, decoded))
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())]
                names = ["n_tokens", "ids_sha256", "round_trip"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(r[3] for r in rows), "<i4"))
                    new += [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([r[0] for r in rows])].astype(np.int32)), flat), pa.array([r[4] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *names])
        _release()

    return run


def tokenised(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip
    and, if with_ids, ids (array<int>) and decoded (text).

    model is the path of a SentencePiece model on the driver; its content (a bounded file) is broadcast. A null text
    has no tokens and decodes to "". A model that squeezes white space, maps characters, or has no byte fallback, may not
    round-trip. Rows that repeat an id each get their row; texts and words are encoded whole, whatever their length, and
    merges of equal score go from left to right. Other columns are not read.
    """
    with open(model, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    out = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_tokenised(shared, with_ids), out)
