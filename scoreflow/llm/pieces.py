"""SentencePiece encoding by a max-plus parallel scan, and decoding.

A text is a path of pieces. Its state at a cut is the piece that reaches or crosses the cut and how
far it reaches; a chunk is a max-plus matrix from entry states to exit states. Giant texts are cut
in chunks of fixed length (anywhere, also inside words); every chunk yields its matrix, the
matrices of a text are combined associatively into the states at all cuts, and every chunk is
traced back on its own from the states at its two ends. No task ever holds more than one chunk of
text while encoding.

Unigram models weigh a piece by its score. BPE models are exact in the same form: a sequence of
pieces is the BPE encoding of its text if and only if each adjacent pair is the encoding of the
text of the pair (merges never cross the pair's border, and greedy merging of independent parts
does not interact), so a pair weighs 0 or minus infinity and exactly one path is finite. The ids
are those of the model's own library.

Where no piece holds a space mark after another character, a space mark after another character
is a border of every path: words between such borders are encoded once and remembered, and a chunk
with such a border inside has a matrix of rank one. The new words of some texts are scanned together:
one step of the max-plus recurrence is taken for all of them at once, place by place and piece length
by piece length, along a trie held in arrays (BPE models with byte pieces; others word by word).

States at the cuts of a giant text come from a tree of products across tasks (``scan``). Null text
gives null ids, empty text none; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.llm.common import parts_of
from scoreflow.llm.scan import borders

SPACE = "▁"
CHUNK = 1 << 16
REMEMBERED = 60_000  # words of each of two generations, and a third of the pairs
ROWS_AT_ONCE = 512
CHARS_AT_ONCE = 1 << 21
WORDS_AT_ONCE = 1 << 14
LONGEST_WORD = 64  # of those that are scanned together and remembered
CHAR_BITS = 21
UNSEEN, START = -1, -2
CODE_BITS = 22
MINUS = float("-inf")
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
State = tuple[str, int]  # the last piece, and how many characters it reaches past the cut


class Vocabulary:
    """Pieces, scores and byte ids of a model file; only the identity normalizer is accepted."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.name not in ("", "identity") or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep the text as it is can be used")
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]  # 1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, kinds)) if k in (1, 4)}
        self.scores = {n: proto.pieces[i].score for n, i in self.ids.items()}
        self.bytes = {int(n[3:-1], 16): i for i, (n, k) in enumerate(zip(self.names, kinds)) if k == 6}
        self.unknown = kinds.index(2)
        # What each id decodes to.
        self.raw = [bytes([int(n[3:-1], 16)]) if k == 6 else " \u2047 ".encode() if k == 2
                    else b"" if k == 3 else n.encode() for n, k in zip(self.names, kinds)]
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.scores.values(), default=0.0) - 10.0
        self.borders = not any(SPACE in n.lstrip(SPACE) for n in self.ids)
        # A code for each piece and each character; -1 for a text that only starts a piece.
        self.codes = {n[:i]: -1 for n in self.ids for i in range(2, len(n))}
        self.texts: list[str] = []
        self.packs: list[bytes] = []  # the ids of each code
        for n in [*self.ids, *dict.fromkeys(n[0] for n in self.ids if n[0] not in self.ids)]:
            self.code(n)
        self.pairs: dict[int, bool] = {}
        self.fitted = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs looked up by whole arrays
        self._trie()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def code(self, text: str) -> int:
        found = self.codes.get(text, -1)
        if found < 0:
            found = self.codes[text] = len(self.texts)
            self.texts.append(text)
            self.packs.append(np.array(self.numbers([text]), np.int32).tobytes())
        return found

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = MINUS, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1], MINUS)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: int, piece: int) -> bool:
        """Whether the encoding of the pair's text is the pair (codes)."""
        if len(self.pairs) > 3 * REMEMBERED:
            self.pairs.clear()
        pair = [self.texts[last], self.texts[piece]]
        known = self.pairs[last << CODE_BITS | piece] = self.merged(pair[0] + pair[1]) == pair
        return known

    def forward(self, s: str, start: int, stop: int, last: str | None) -> tuple[list[float], list[int]]:
        """Best weight and start of the last piece at each place from ``start`` on.

        Pieces start before ``stop`` and may reach beyond it. ``last`` is the piece before ``start``.
        """
        codes, n, longest = self.codes, len(s), self.longest
        weight, back = [MINUS] * (n + 1), [-1] * (n + 1)
        weight[start] = 0.0
        if self.bpe:
            pairs, held = self.pairs, [-1] * (n + 1)
            held[start] = -1 if last is None else self.code(last)
            for i in range(start, min(stop, n)):
                if weight[i] == MINUS:
                    continue
                before = held[i]
                for j in range(i + 1, min(i + longest, n) + 1):
                    c = codes.get(s[i:j])
                    if c is None:
                        if j > i + 1:
                            break
                        c = self.code(s[i])
                    # A place is reached by one path at most, so the first piece that fits is it.
                    if c >= 0 and held[j] < 0:
                        if before >= 0:
                            fit = pairs.get(before << CODE_BITS | c)
                            if fit is None:
                                fit = self.fits(before, c)
                            if not fit:
                                continue
                        held[j], weight[j], back[j] = c, 0.0, i
            return weight, back
        scores, least = self.scores, self.least
        for i in range(start, min(stop, n)):
            here = weight[i]
            for j in range(i + 1, min(i + longest, n) + 1):
                piece = s[i:j]
                score = scores.get(piece, least if j == i + 1 else MINUS)
                if here + score > weight[j]:
                    weight[j], back[j] = here + score, i
                if piece not in codes:
                    break
        return weight, back

    def trace(self, s: str, back: list[int], start: int, end: int) -> list[str]:
        """Pieces of the best path from ``start`` to ``end``."""
        out = []
        while end > start:
            out.append(s[back[end]:end])
            end = back[end]
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character outside the vocabulary becomes its bytes or the unknown id."""
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def best(self, word: str) -> bytes:
        """Ids of the best path of a word."""
        _, back = self.forward(word, 0, len(word), None)
        return np.array(self.numbers(self.trace(word, back, 0, len(word))), np.int32).tobytes()

    def _trie(self) -> None:
        """The pieces as a trie: sorted (node, character) keys, the node each leads to, its code."""
        nodes, steps, codes = {"": 0}, {}, [UNSEEN]
        for piece in self.ids:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    steps[nodes[piece[:end - 1]] << CHAR_BITS | ord(piece[end - 1])] = nodes[piece[:end]] = len(nodes)
                    codes.append(self.codes.get(piece[:end], UNSEEN))
        self.trie_keys = np.array(sorted(steps), np.int64)
        self.trie_next = np.array([steps[k] for k in self.trie_keys.tolist()], np.int64)
        self.trie_codes = np.array(codes, np.int64)

    def _walk(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after one more character; UNSEEN where no piece goes on."""
        if not len(self.trie_keys):
            return np.full(len(node), UNSEEN)
        key = node << CHAR_BITS | char
        at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
        return np.where(self.trie_keys[at] == key, self.trie_next[at], UNSEEN)

    def _fit(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``fits`` for arrays of codes."""
        out = last == START
        at = np.flatnonzero(~out)
        key, place = np.unique(last[at] << CODE_BITS | piece[at], return_inverse=True)
        known, fit = self.fitted
        found = np.searchsorted(known, key)
        seen = found < len(known)
        seen[seen] = known[found[seen]] == key[seen]
        value = np.zeros(len(key), bool)
        value[seen] = fit[found[seen]]
        for i in np.flatnonzero(~seen).tolist():
            k = int(key[i])
            got = self.pairs.get(k)
            value[i] = self.fits(k >> CODE_BITS, k & (1 << CODE_BITS) - 1) if got is None else got
        out[at] = value[place]
        return out

    def _settle(self) -> None:
        """Pairs learned one by one join the arrays; all are forgotten beyond the bound."""
        known, fit = self.fitted
        if len(known) > 3 * REMEMBERED:
            self.fitted = np.zeros(0, np.int64), np.zeros(0, bool)
        elif len(self.pairs) > 64:
            known = np.concatenate([known, np.fromiter(self.pairs.keys(), np.int64)])
            fit = np.concatenate([fit, np.fromiter(self.pairs.values(), bool)])
            known, first = np.unique(known, return_index=True)
            self.fitted = known, fit[first]
            self.pairs.clear()

    def scan(self, words: list[str]) -> list[bytes]:
        """Ids of words of a BPE model, all scanned in step: the recurrence of ``forward``, for arrays."""
        size = np.array([len(w) for w in words])
        wide, n = int(size.max()), len(words)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chars, single = np.zeros((n, wide), np.int64), np.zeros((n, wide), np.int64)
        chars[row, column] = flat
        kinds, of = np.unique(flat, return_inverse=True)
        single[row, column] = np.array([self.code(chr(c)) for c in kinds.tolist()], np.int64)[of]
        held, back = np.full((n, wide + 1), UNSEEN), np.zeros((n, wide + 1), np.int64)
        held[:, 0] = START
        for i in range(wide):
            rows = np.flatnonzero((held[:, i] != UNSEEN) & (size > i))
            node, codes = np.zeros(len(rows), np.int64), single[rows, i]
            for j in range(i + 1, wide + 1):
                node = self._walk(node, chars[rows, j - 1])
                if j > i + 1:
                    rows, node = rows[node >= 0], node[node >= 0]
                    codes = self.trie_codes[node]
                if not len(rows):
                    break
                new = np.flatnonzero((codes >= 0) & (held[rows, j] == UNSEEN))
                if len(new):
                    at = rows[new]
                    good = self._fit(held[at, i], codes[new])
                    held[at[good], j], back[at[good], j] = codes[new[good]], i
                on = (node >= 0) & (size[rows] > j)
                rows, node = rows[on], node[on]
        self._settle()
        # Back along all paths at once; then the pieces of each word lie together in order.
        steps: list[tuple[np.ndarray, ...]] = []
        rows, place = np.arange(n), size.copy()
        while len(rows):
            steps.append((rows * (wide + 1) + place, held[rows, place]))
            place = back[rows, place]
            rows, place = rows[place > 0], place[place > 0]
        where, codes = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(where)
        codes, kinds = codes[order], np.unique(codes)
        packs = [np.frombuffer(self.packs[c], np.int32) for c in kinds.tolist()]
        lengths = np.array([len(x) for x in packs])
        of = np.searchsorted(kinds, codes)
        first, count = np.cumsum(lengths)[of] - lengths[of], lengths[of]
        ends = np.cumsum(count)
        flat = np.concatenate(packs)[np.repeat(first - ends + count, count) + np.arange(int(ends[-1]))].tobytes()
        last = np.searchsorted(where[order] // (wide + 1), np.arange(n), "right")
        cuts = [0, *(4 * ends[last - 1]).tolist()]
        return [flat[x:y] for x, y in zip(cuts, cuts[1:])]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """What is remembered, the given words among it.

        Words are remembered in two generations; the older one goes when the newer is full.
        """
        known, older = self.words, self.older
        if len(known) > REMEMBERED:
            self.older, older, self.words = known, known, {}
            known = self.words
        new = words - known.keys()
        for w in new & older.keys():
            known[w] = older[w]
        new -= older.keys()
        together = self.bpe and bool(self.bytes)
        short = sorted((w for w in new if len(w) <= LONGEST_WORD), key=len) if together else []
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at:at + WORDS_AT_ONCE]
            known.update(zip(part, self.scan(part)))
        if len(short) == len(new):
            return known
        rare = {w: self.best(w) for w in new if w not in known}
        known.update((w, ids) for w, ids in rare.items() if len(w) <= LONGEST_WORD)
        return known | rare

    def split(self, s: str) -> list[str]:
        """The words between the borders of a text."""
        return WORDS.findall(s) if self.borders else [s] if s else []

    def encode_words(self, s: str, out: bytearray) -> None:
        """Append the ids (32-bit) of a stretch between two borders."""
        words = self.split(s)
        ids = self.learn(set(words))
        out += b"".join([ids[w] for w in words])

    def packed(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of some texts as arrays."""
        made = [self.split(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids = self.learn(set().union(*made)).__getitem__
        return [np.frombuffer(b"".join(map(ids, words)), np.int32) for words in made]

    def encode(self, text: str) -> list[int]:
        return self.packed([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")

    # Chunks: a window is the chunk with up to ``longest`` characters on both sides.
    def entries(self, window: str, cut: int) -> list[State]:
        """All states that can hold at a cut; unigram states are the reach alone."""
        if cut <= 0:
            return [("", 0)]
        out = []
        for reach in range(min(self.longest, len(window) - cut + 1)):
            end, ok = cut + reach, False
            for begin in range(max(0, end - self.longest), cut):
                piece = window[begin:end]
                if piece in self.ids or len(piece) == 1:
                    ok = True
                    if self.bpe:
                        out.append((piece, reach))
            if ok and not self.bpe:
                out.append(("", reach))
        return out

    def border(self, window: str, lo: int, hi: int, last: bool = False) -> int:
        """The first (last) border in [lo, hi), or -1."""
        if self.borders:
            places = range(hi - 1, lo - 1, -1) if last else range(lo, hi)
            for p in places:
                if p > 0 and window[p] == SPACE and window[p - 1] != SPACE:
                    return p
        return -1

    def _exits(self, window: str, weight: list[float], back: list[int], stop: int) -> Iterator[tuple[State, float]]:
        for p in range(stop, len(window) + 1):
            if weight[p] > MINUS and (back[p] < stop or p == stop):
                piece = window[back[p]:p] if self.bpe and back[p] >= 0 else ""
                yield (piece, p - stop), weight[p]

    def matrix(self, window: str, lo: int, hi: int) -> list[tuple[State, State, float]]:
        """The finite entries of a chunk [lo, hi) of the window."""
        out = []
        first = self.border(window, lo + self.longest, hi)
        tail = None
        if first >= 0:
            last = self.border(window, first, hi, last=True)
            between = 0.0 if self.bpe else self.weigh(window[first:last])
            weight, back = self.forward(window, last, hi, None)
            tail = [(s, w + between) for s, w in self._exits(window, weight, back, hi)]
        for state in self.entries(window, lo):
            start = lo + state[1]
            if start >= hi:
                out.append((state, (state[0], start - hi), 0.0))
                continue
            stop = first if first >= 0 else hi
            weight, back = self.forward(window, start, stop, state[0] or None)
            if tail is None:
                out += [(state, s, w) for s, w in self._exits(window, weight, back, hi)]
            elif weight[first] > MINUS:
                out += [(state, s, weight[first] + w) for s, w in tail]
        return out

    def weigh(self, s: str) -> float:
        """Weight of the best path between two borders."""
        total = 0.0
        for word in WORDS.findall(s):
            total += self.forward(word, 0, len(word), None)[0][len(word)]
        return total

    def traced(self, window: str, lo: int, hi: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that start in the chunk, given the states at its ends."""
        start, end = lo + entry[1], hi + leave[1]
        if start >= hi:
            return []
        before = entry[0] or None
        first = self.border(window, start + self.longest, hi)
        if first < 0:
            _, back = self.forward(window, start, hi, before)
            return self.numbers(self.trace(window, back, start, end))
        last = self.border(window, first, hi, last=True)
        _, back = self.forward(window, start, first, before)
        out = self.numbers(self.trace(window, back, start, first))
        middle = bytearray()
        self.encode_words(window[first:last], middle)
        _, back = self.forward(window, last, hi, None)
        return [*out, *np.frombuffer(middle, np.int32).tolist(), *self.numbers(self.trace(window, back, last, end))]


def combined(a: dict, b: dict) -> dict:
    """Max-plus product of two sparse matrices {(entry, exit): weight}; it is associative."""
    by: dict[State, list] = {}
    for (entry, leave), w in b.items():
        by.setdefault(entry, []).append((leave, w))
    out: dict = {}
    for (entry, middle), w in a.items():
        for leave, v in by.get(middle, ()):
            if w + v > out.get((entry, leave), MINUS):
                out[entry, leave] = w + v
    return out


def route(matrices: Sequence[dict], entry: State, leave: State) -> list[State]:
    """States at all cuts of the best path between two states, both included."""
    upto: list[dict] = [{entry: 0.0}]
    for m in matrices:
        vector: dict = {}
        for (e, s), w in m.items():
            if e in upto[-1] and upto[-1][e] + w > vector.get(s, MINUS):
                vector[s] = upto[-1][e] + w
        upto.append(vector)
    states = [leave]
    for m, before in zip(reversed(matrices), upto[-2::-1]):
        states.append(max((before[e] + w, e) for (e, s), w in m.items() if s == states[-1] and e in before)[1])
    return states[::-1]


def best_end(whole: dict) -> State:
    """The exit state of the best path of a whole text."""
    return max((w, s) for (e, s), w in whole.items() if e == ("", 0) and s[1] == 0)[1]


def _product(matrices: Sequence[bytes]) -> bytes:
    out = pickle.loads(matrices[0])
    for m in matrices[1:]:
        out = combined(out, pickle.loads(m))
    return pickle.dumps(out)


def _ends(whole: bytes) -> tuple[bytes, bytes]:
    return pickle.dumps(("", 0)), pickle.dumps(best_end(pickle.loads(whole)))


def _route(matrices: Sequence[bytes], entry: bytes, leave: bytes) -> list[bytes]:
    return [pickle.dumps(s) for s in route([pickle.loads(m) for m in matrices], pickle.loads(entry), pickle.loads(leave))]


@lru_cache(maxsize=4)
def vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary per Python worker, with what it remembers."""
    return Vocabulary(model)


def read_model(path: str) -> bytes:
    """The bytes of a model file; they travel to the tasks by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def _few(cells: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column in groups of bounded length."""
    group, size = [], 0
    for cell in cells:
        text = cell.as_py()
        group.append(text)
        size += len(text or "")
        if size > CHARS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _whole(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in parts_of(rows, ROWS_AT_ONCE):
            nulls, values = [], []
            for group in _few(batch["text"]):
                values += v.packed([t or "" for t in group])
                nulls += [t is None for t in group]
            offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *values]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(nulls, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch["key"], lists], names=["key", "ids"])
    return batches


WINDOWS = "uid string, chunk long, window string, lo int, hi int"


def _windows(prefix: str, chunk: int, side: int):
    """The chunks of every text, each with ``side`` characters more on both sides."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for uid, text in zip(batch["uid"], batch["text"]):
                s = prefix + text.as_py().replace(" ", SPACE)
                for i, at in enumerate(range(0, len(s), chunk)):
                    begin = max(0, at - side)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid.as_py()]), pa.array([i], pa.int64()), pa.array([s[begin:at + chunk + side]]),
                         pa.array([at - begin], pa.int32()), pa.array([min(len(s), at + chunk) - begin], pa.int32())],
                        names=["uid", "chunk", "window", "lo", "hi"])
    return batches


def _matrices(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in rows:
            made = []
            for window, lo, hi in zip(batch["window"], batch["lo"].to_pylist(), batch["hi"].to_pylist()):
                made.append(pickle.dumps({(e, s): w for e, s, w in v.matrix(window.as_py(), lo, hi)}))
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["chunk"], pa.array(made, pa.binary())],
                                             names=["uid", "chunk", "matrix"])
    return batches


def _traces(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in rows:
            made = [v.traced(r["window"], r["lo"], r["hi"], pickle.loads(r["entry"]), pickle.loads(r["leave"]))
                    for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["chunk"], pa.array(made, pa.list_(pa.int32()))],
                                             names=["uid", "chunk", "ids"])
    return batches


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """Columns ``key, ids`` for every row, repeated rows included."""
    v = vocabulary(model)
    if chunk < 4 * v.longest:
        raise ValueError("chunks must be longer than four pieces")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    small = rows.where(~long).mapInArrow(_whole(shared), f"key {kind}, ids array<int>")
    uid = F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("-")), F.md5("text")))
    large = rows.where(long).select(uid.alias("uid"), "key", "text")
    cut = checkpointed(large.dropDuplicates(["uid"]).select("uid", "text").mapInArrow(
        _windows(v.prefix, chunk, v.longest), WINDOWS).repartition("uid", "chunk"))
    found = checkpointed(cut.mapInArrow(_matrices(shared), "uid string, chunk long, matrix binary"))
    routes = borders(found, _product, _ends, _route)
    traced = cut.join(routes, ["uid", "chunk"]).mapInArrow(_traces(shared), "uid string, chunk long, ids array<int>")
    whole = traced.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("uid", F.flatten("parts.ids").alias("ids"))
    return small.unionAll(large.select("uid", "key").join(whole, "uid").select("key", "ids"))


def decode(encoded: DataFrame, model: bytes, key: str = "key", ids: str = "ids") -> DataFrame:
    """Columns ``key, ids, text`` for every row of ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in parts_of(rows, ROWS_AT_ONCE):
            made = [v.decode(cell.values.to_numpy().tolist()) if cell.is_valid else None for cell in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["ids"], pa.array(made, pa.string())],
                                             names=["key", "ids", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(batches, f"key {kind}, ids array<int>, text string")
