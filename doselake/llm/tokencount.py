"""Token counts by a finite-state transducer compiled from a piece vocabulary."""

from __future__ import annotations

import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from doselake.llm.common import arrow_map, text_or_empty

SPACE = "▁"
#: Words remembered, states compiled and pairs judged per worker; each table is emptied when it is full.
MEMO, STATES, PAIRS = 250_000, 120_000, 300_000
#: Code points of a chunk whose state map is computed on its own.
CHUNK = 65_536
#: Below every score: what a part waits for that no merge changes any more.
NEVER = float("-inf")


class Pieces:
    """The vocabulary: scores of pieces, and the reference merge of a short string."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        }
        self.longest = max(map(len, self.score), default=1)
        long = [p for p in self.score if len(p) > 1]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in long):
            raise ValueError("a piece goes on after the end of a word")
        joined = {c for p in long for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def cost(self, part: str) -> int:
        """Tokens of a final part: an unknown character falls back to its bytes."""
        return 1 if part in self.score else len(part.encode())

    def ends(self, token: str) -> tuple[tuple, tuple] | None:
        """The outer parts of a token while it is merged alone: ``(first parts, last parts)``.

        Each holds ``(part, score)``: the part stays until a merge of that score
        changes it; merges that leave it only lower the score it waits for.
        None if the characters do not merge to the token.
        """
        parts, first, last = list(token), [], []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            for side, part in ((first, parts[0]), (last, parts[-1])):
                if side and side[-1][0] == part:
                    side[-1] = part, min(side[-1][1], best)
                else:
                    side.append((part, best))
            if at < 0:
                return (tuple(first), tuple(last)) if len(parts) == 1 else None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """Reads characters and emits changes of the token count.

    The tokens of a prefix of a word end in one certain token, which fits the
    token before it: the two, merged alone, stay two. A piece still to come can
    only begin where the text read since then begins some piece. So a state is,
    for each such place: the text read since, the last token there, and the count
    there less the count here. A last token is forgotten if no part of its end can
    merge across the place before the token is whole: states that differ in nothing
    else are one. Finitely many states exist; those that texts reach are compiled
    when they are reached, and then a transition is one lookup.
    """

    START = (("", "", 0),)  # the beginning of a word: no token yet

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.begins = {p[:n] for p in pieces.score for n in range(1, len(p))}
        self.best: dict[str, float] = {}  # the best score of the pieces that begin so
        for p, score in pieces.score.items():
            for n in range(1, len(p) + 1):
                self.best[p[:n]] = max(score, self.best.get(p[:n], NEVER))
        self._fits: dict[tuple[str, str], bool] = {}
        self._ends: dict[str, tuple[tuple, tuple] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.known: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []

    def state(self, what: tuple) -> int:
        got = self.index.get(what)
        if got is None:
            if len(self.known) >= STATES:
                self.clear()
            got = self.index[what] = len(self.known)
            self.known.append(what)
            self.moves.append({})
        return got

    def ends(self, token: str) -> tuple[tuple, tuple] | None:
        if len(token) < 2:  # any character, so these are not remembered
            return ((token, NEVER),), ((token, NEVER),)
        if token not in self._ends:
            self._ends[token] = self.pieces.ends(token)
        return self._ends[token]

    def fits(self, a: str, b: str) -> bool:
        """Whether ``a + b``, merged, is ``a`` and ``b``; without ``a``, whether it is ``b``."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            got = self._fits[a, b] = self._judge(a, b)
        return got

    def _judge(self, a: str, b: str) -> bool:
        """Both merge side by side, best score first, until a merge across comes first or none is left."""
        left, right = self.ends(a), self.ends(b)
        if left is None or right is None:
            return False
        if not a:
            return True
        lefts, rights, score = iter(left[1]), iter(right[0]), self.pieces.score.get
        (last, s), (first, t) = next(lefts), next(rights)
        while True:
            across = score(last + first)
            if across is not None and across > s and across >= t:  # the leftmost of equals comes first
                return False
            if t > s:
                first, t = next(rights)
            elif s > NEVER:
                last, s = next(lefts)
            else:
                return True

    def binds(self, token: str, c: str) -> bool:
        """Whether any piece that goes on with ``c`` could take a part off the end of ``token``."""
        best = self.best.get
        return any(best(part + c, NEVER) > waits for part, waits in self.ends(token)[1])

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        token, open_ = None, []
        for read, last, before in self.known[state]:  # the farthest first
            if not read and last and not self.binds(last, c):
                last = ""
            grown = read + c
            if token is None and (not read or grown in self.pieces.score) and self.fits(last, grown):
                token, emitted = grown, before + self.pieces.cost(grown)
            if grown in self.begins:
                open_.append((grown, last, before))
        if token is None:
            raise AssertionError(f"no token fits before {c!r}")
        moves = self.moves[state]
        to = self.state((*[(grown, last, before - emitted) for grown, last, before in open_], ("", token, 0)))
        moves[c] = move = (to, emitted)
        return move

    def run(self, what: tuple, text: str) -> tuple[tuple, int]:
        """The state after ``text``, and the sum of what was emitted."""
        state, total, moves = self.state(what), 0, self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                move = self._compile(state, c)
                moves = self.moves
            state = move[0]
            total += move[1]
        return self.known[state], total


class Counter:
    """Token counts of texts by composition of chunk maps."""

    def __init__(self, path: str):
        pieces = Pieces(path)
        self.machine = Transducer(pieces)
        alone = re.escape(pieces.alone)
        self.words = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall
        self.head = re.compile(f"{SPACE}*[^{SPACE}{alone}]*").match
        run, start = self.machine.run, Transducer.START

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                n = run(start, word)[1]
                if len(word) <= 64:  # long words hardly come again
                    if len(self) >= MEMO:
                        self.clear()
                    self[word] = n
                return n

        self.memo = Memo()

    def chunk_map(self, chunk: str) -> tuple[str, int, tuple | None]:
        """What a chunk does to the state it is entered in: ``(head, body, state)``.

        ``head`` goes on with a word begun before; from there on a word begins
        anew, whatever came before, so the rest emits ``body`` and leaves
        ``state`` for every entry state. ``state`` is None if all is head.
        """
        head = self.head(chunk).group()
        words = self.words(chunk[len(head):])
        if not words:
            return head, 0, None
        state, last = self.machine.run(Transducer.START, words.pop())
        return head, sum(map(self.memo.__getitem__, words)) + last, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, emitted = self.machine.run(a[2], b[0])
        return a[0], a[1] + emitted + b[1], b[2] or state

    def count(self, text: str) -> int:
        """Tokens of a whole text as the library encodes it, without added tokens."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= CHUNK:
            return sum(map(self.memo.__getitem__, self.words(text)))
        maps = [("", 0, Transducer.START)]
        maps += [self.chunk_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours first, then neighbours of those
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a model file, compiled once per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text: id, ``n_bytes, n_tokens, over_limit``.

    ``path`` names a piece model that the executors can read. Null text is
    empty: no bytes, no tokens. Rows are kept one for one; ids may be null or
    repeated; no other column is read. A map-only job without a shuffle.
    """
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()),
    ])

    def run(batch: pa.RecordBatch) -> dict:
        c = counter(path)
        texts = batch.column(1).to_pylist()
        n = [c.count(t) for t in texts]
        return {"id": batch.column(0), "b": [len(t.encode()) for t in texts], "n": n, "o": [x > limit for x in n]}

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, run, schema, rows=256)
