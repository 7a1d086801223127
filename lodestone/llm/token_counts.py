"""Operator 8: token counts by a compiled finite-state tokenizer.

The BPE vocabulary with word ends is compiled, lazily, to one deterministic transducer over characters. A state holds
what the future can still depend on: the pre-tokenizer's mode, the last character (it may yet end the word), and for
each position within the longest suffix that can still grow into a vocabulary entry the token that ends there and the
count of tokens up to it. A transition is annotated with the change of the token count that it emits, so counts of a
text are sums along its path.

A text is cut into chunks of CHUNK characters and all chunks run in lockstep as lanes of numpy gathers. White space
resets the transducer, so the map of a chunk (state before -> state after, tokens emitted) is constant but for its
head, the characters before its first white space. Composing two such maps gives the right one's end, so the prefix scan
over them is done after one step: every head runs, all in lockstep, from the end of the chunk before.

Stretches of over LONG characters without white space (and texts that would grow the table beyond MOST_STATES states)
don't go through the table, so that it stays bounded. Their words are walked: the state is the token that ends at each
of the last places, and a place's token follows from those before it, with no numbering of states. A word of over PIECE
symbols is cut into pieces; each piece's map is taken from the state that a walk over the WARM symbols before it ends in,
and the maps are composed by a parallel prefix scan, doubling the reach in each round; a piece whose true state before
differs from the one assumed is walked again from the true one, which adds that state to its map.

Null counts as the empty text: 0 tokens. Texts of any length are read whole. Special strings inside a text count as one
token each, as the library has it by default. Equal texts get equal counts and repeated rows a row each; an empty table
gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import marshal
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import slices, table

CHUNK = 256
COLUMNS = 96  # symbols with a dense column; the last stands for all others
LISTED = 64
MOST_STATES = 100_000  # rows of the table; it grows no further
MOST_KNOWN, MOST_MEMO = 250_000, 40_000  # pairs of tokens and steps that are remembered; forgotten together beyond
LONG, PIECE, WARM, SLICE = 96, 1 << 14, 256, 1 << 18
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
UNSYNC, START, LOST = 0, 1, 2


def _byte_letters() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table of a BPE model with word ends. Symbols: byte b is chr(b), byte b that ends a word chr(256 + b)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in model["added_tokens"]]
        letters, suffix = _byte_letters(), model["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            bs = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, bs[:-1])) + chr(bs[-1] + 256 * ends)

        self.id = {chr(i): i for i in range(512)}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(512)]
        for a, b in model["model"]["merges"]:
            x, y = symbols(a), symbols(b)
            n = len(self.parts)
            self.pair[self.id[x], self.id[y]] = self.id.setdefault(x + y, n)
            self.parts.append((self.id[x], self.id[y]))
        self.known: dict[int, bool] = {}
        self.id = {t: i for t, i in self.id.items() if i < 512 or self.fits(*self.parts[i], product=i)}
        self.grown: dict[str, list[int] | None] = {}  # prefix -> the tokens it can grow into, None where they are too many to list
        for t, i in self.id.items():
            for k in range(1, len(t)):
                into = self.grown.setdefault(t[:k], [])
                if into is not None:
                    self.grown[t[:k]] = [*into, i] if len(into) < LISTED else None
        self.longest = max(map(len, self.id))

    @cached_property
    def ends(self) -> set[str]:
        """All ends of tokens; only walks need them."""
        return {t[k:] for t in self.id for k in range(len(t))}

    def fits(self, a: int, b: int, product: int | None = None) -> bool:
        """Whether tokens a and b stay apart when they stand side by side; with a product, whether no earlier merge precedes theirs."""
        if product is not None:
            return self._apart(a, b, product)
        out = self.known.get(a << 20 | b)
        if out is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            out = self.known[a << 20 | b] = self._apart(a, b, 1 << 40)
        return out

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """No merge across the border of a and b happens before the merges that build them: the later-built side is undone step by step."""
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and a >= 512:
                limit, a = a, self.parts[a][1]
            elif b >= 512:
                limit, b = b + 1, self.parts[b][0]
            elif a >= 512:
                limit, a = a, self.parts[a][1]
            else:
                return True


class Walk:
    """Tokens of one word, place by place: the token of the whole word so far that ends there, which tokens it can follow being known."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def run(self, symbols: str, before: tuple = ()) -> tuple[tuple, int]:
        """The word goes on with these symbols. State before and after: of each of the last places, nearest last, its symbol, its token and the count there less that at the end. Returns the tokens counted too."""
        v, get, ends, known = self.v, self.v.id.get, self.v.ends, self.v.known
        head = "".join(x for x, _, _ in before)
        text, size = head + symbols, len(head)
        last, count = [-1, *(t for _, t, _ in before)], [0, *(n for _, _, n in before)]
        start = size < v.longest  # the word's beginning is still in reach
        for e in range(size + 1, len(text) + 1):
            for at in range(e - 1, max(-1, e - v.longest - 1), -1):
                part = text[at:e]
                if part not in ends:
                    break
                token = get(part)
                if token is None:
                    continue
                if at == 0:
                    if not start:
                        continue
                else:
                    fit = known.get(last[at] << 20 | token)
                    if not (v.fits(last[at], token) if fit is None else fit):
                        continue
                last.append(token)
                count.append(count[at] + 1)
                break
        n = count[-1]
        keep = min(v.longest, len(text))
        at = len(text) - keep
        return tuple(zip(text[at:], last[at + 1 :], (c - n for c in count[at + 1 :]), strict=True)), n

    def word(self, symbols: str) -> int:
        if len(symbols) <= PIECE:
            return self.run(symbols)[1]
        cuts = [*range(0, len(symbols), PIECE), len(symbols)]
        pieces = [symbols[a:b] for a, b in zip(cuts, cuts[1:])]
        guess = [(), *(self.run(symbols[c - WARM : c])[0] for c in cuts[1:-1])]
        maps = [{g: self.run(p, g)} for g, p in zip(guess, pieces, strict=True)]
        reach = 1
        while reach < len(maps):  # maps[i] goes from the piece reach - 1 before to the end of piece i
            maps = [m if i < reach else self.then(maps[i - reach], m, pieces[i - reach + 1 : i + 1]) for i, m in enumerate(maps)]
            reach *= 2
        return maps[-1][()][1]

    def then(self, first: dict, second: dict, pieces: list[str]) -> dict:
        """The map of two stretches after each other; the second's pieces are walked again for a state it doesn't hold."""
        out = {}
        for before, (middle, n) in first.items():
            if middle not in second:
                at, more = middle, 0
                for p in pieces:
                    at, k = self.run(p, at)
                    more += k
                second[middle] = at, more
            after, k = second[middle]
            out[before] = after, n + k
        return out


#: Word so far: the suffix that may still grow into a token; then for each place in it where a token can still start: the place,
#: what came before it (the token that ends there, -1 for none, or all tokens that fit there), and the count there less that at its end.
EMPTY = ("", ((0, -1, 0),))


class Transducer:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.special = re.compile("|".join(map(re.escape, self.v.specials))) if self.v.specials else None
        self.memo: dict[tuple, tuple] = {}
        self.walk, self.words, self.start = Walk(self.v), {}, ("S", "", EMPTY)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.column = np.zeros(0x110000, np.uint8)
        self.column[SPACES] = 1
        self.columns = 2  # column 0: not met yet; 1: white space
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = [b"", marshal.dumps(self.start, 2), b""]  # packed, a tenth of their size as objects
        self.number = {self.states[START]: START}
        self.to = np.empty((MOST_STATES, COLUMNS), np.int32)  # pages are touched as states are made
        self.to[: LOST + 1] = -1
        self.to[UNSYNC] = UNSYNC << 5 | 16
        self.to[UNSYNC, 1] = START << 5 | 16
        self.to[LOST] = LOST << 5 | 16  # the state has no row: what lies between white space is walked
        self.to[LOST, 1] = START << 5 | 16
        self.to[START, COLUMNS - 1] = -2
        self.memo.clear()

    # one symbol, one character, one word end
    def _feed(self, word: tuple, symbol: str) -> tuple[tuple, int]:
        key = (word, symbol)
        if key in self.memo:
            return self.memo[key]
        text, v = word[0] + symbol, self.v
        for at, before, count in word[1]:
            token = v.id.get(text[at:])
            if token is not None and (token in before if isinstance(before, tuple) else before < 0 or v.fits(before, token)):
                break
        more, places = count + 1, []
        for at, before, count in word[1]:
            if text[at:] in v.grown:
                into = v.grown[text[at:]]
                if into is not None:
                    before = tuple(t for t in into if (t in before if isinstance(before, tuple) else before < 0 or v.fits(before, t)))
                    if not before:
                        continue
                places.append((at, before, count - more))
        cut = places[0][0] if places else len(text)
        out = (text[cut:], (*((at - cut, before, count) for at, before, count in places), (len(text) - cut, token, 0))), more
        if len(self.memo) >= MOST_MEMO:
            self.memo.clear()
        self.memo[key] = out
        return out

    def _add(self, word: tuple, char: str) -> tuple[tuple, int]:
        n = 0
        for b in char.encode("utf-8", "surrogatepass"):
            word, d = self._feed(word, chr(b))
            n += d
        return word, n

    def _end(self, word: tuple, char: str) -> int:
        bs, n = char.encode("utf-8", "surrogatepass"), 0
        for b in bs[:-1]:
            word, d = self._feed(word, chr(b))
            n += d
        return n + self._feed(word, chr(256 + bs[-1]))[1]

    def _whole(self, text: str) -> int:
        """Tokens of one word."""
        n = self.words.get(text)
        if n is None:
            bs = text.encode("utf-8", "surrogatepass")
            n = self.walk.word("".join(map(chr, bs[:-1])) + chr(256 + bs[-1]))
            if len(text) <= LONG and len(self.words) < MOST_STATES:
                self.words[text] = n
        return n

    def walked(self, text: str) -> int:
        """Tokens of a prepared text without the table."""
        return sum(map(self._whole, self.split.findall(text)))

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The published split pattern: contractions, runs of letters, single digits, runs of other characters."""
        mode, last, word = state
        kind = "S" if ord(char) in _SPACE_SET else {"L": "L", "N": "N"}.get(unicodedata.category(char)[0], "O")
        if mode == "A":
            if last + char in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                return self.start, self._whole(last + char)
            if last == "'" and char in "rvl":
                return ("A", last + char, EMPTY), 0
            if last == "'":
                return self.step(("O", "'", EMPTY), char)
            after, n = self.step(("L", last[1], EMPTY), char)
            return after, n + self._whole("'")
        if mode == kind and kind in "LO":
            word, n = self._add(word, last)
            return (mode, char, word), n
        n = self._end(word, last) if mode in "LO" else 0
        if kind == "N":
            return self.start, n + self._whole(char)
        if char == "'":
            return ("A", "'", EMPTY), n
        return (self.start if kind == "S" else (kind, char, EMPTY)), n

    def _entry(self, state: int, code: int, column: int) -> int:
        if state in (UNSYNC, LOST):  # white space has an entry
            return state << 5 | 16
        after, n = self.step(marshal.loads(self.states[state]), chr(code))
        after = marshal.dumps(after, 2)
        k = self.number.get(after)
        if k is None:
            if len(self.states) >= len(self.to):
                return LOST << 5 | 16
            k = self.number[after] = len(self.states)
            self.states.append(after)
            self.to[k] = -1
            self.to[k, COLUMNS - 1] = -2
        assert -16 <= n < 16
        entry = k << 5 | n + 16
        if column < COLUMNS - 1:
            self.to[state, column] = entry
        return entry

    def _advance(self, state: np.ndarray, column: np.ndarray, code: np.ndarray) -> np.ndarray:
        x = self.to.ravel().take(state * COLUMNS + column)
        if x.size and x.min() < 0:
            done: dict[tuple[int, int], int] = {}
            for i in np.nonzero(x < 0)[0]:
                key = int(state[i]), int(code[i])
                if key not in done:
                    done[key] = self._entry(*key, int(column[i]))
                x[i] = done[key]
        return x

    def prepare(self, text: str | None) -> tuple[str, int]:
        """The library's normalization; special strings are counted and leave a space."""
        if not text:
            return "", 0
        n = 0
        if self.special and any(s in text for s in self.v.specials):
            text, n = self.special.subn(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower(), n

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out, i = np.zeros(len(texts), np.int64), 0
        while i < len(texts):  # some at a time, so that the table's bound is looked at often
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k] or "") <= SLICE):
                size += len(texts[k] or "")
                k += 1
            out[i:k] = self._counts(texts[i:k])
            i = k
        return out

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        ready = [self.prepare(t) for t in texts]
        out = np.array([n for _, n in ready], np.int64)
        lanes = np.array([len(t) // CHUNK + 1 for t, _ in ready], np.int64)
        code = np.frombuffer("".join(t + " " * (int(k) * CHUNK - len(t)) for (t, _), k in zip(ready, lanes, strict=True)).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = self.column.take(code)
        if not column.all():
            for c in np.unique(code[column == 0]):
                self.column[c] = min(self.columns, COLUMNS - 1)
                self.columns += self.columns < COLUMNS - 1
            column = self.column.take(code)
        ends = np.cumsum(lanes) * CHUNK
        space = np.nonzero(column == 1)[0]  # every text ends in one
        far = np.nonzero(np.diff(np.concatenate([[-1], space])) > LONG + 1)[0]
        if far.size:  # long stretches are walked and leave white space
            column = column.copy()
            for k in far:
                a, b = int(space[k - 1]) + 1 if k else 0, int(space[k])
                out[np.searchsorted(ends, a, "right")] += self.walked(code[a:b].tobytes().decode("utf-32-le", "surrogatepass"))
                column[a:b] = 1
            code = np.where(column == 1, np.uint32(32), code)
        total, lost = self._lanes(code, column, lanes)
        if lost.size:
            column = column.copy() if not far.size else column
            code = code.copy()
        while lost.size:  # what met a state without a row is walked too, and its texts run again without it
            after = np.unique(np.searchsorted(space, lost))
            texts_ = set()
            for k in after:
                a, b = int(space[k - 1]) + 1 if k else 0, int(space[k])
                own = int(np.searchsorted(ends, a, "right"))
                out[own] += self.walked(code[a:b].tobytes().decode("utf-32-le", "surrogatepass"))
                column[a:b], code[a:b] = 1, 32
                texts_.add(own)
            some = np.array(sorted(texts_))
            at = np.concatenate([np.arange(ends[i] - lanes[i] * CHUNK, ends[i]) for i in some])
            total[some], more = self._lanes(code[at], column[at], lanes[some])
            lost = at[more] if more.size else more
        return out + total

    def _lanes(self, code: np.ndarray, column: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts of so many chunks each, and the places at which a state had no row."""
        code, column = code.reshape(-1, CHUNK), column.reshape(-1, CHUNK)
        starts, lost = np.cumsum(lanes) - lanes, []
        first = np.zeros(len(code), bool)
        first[starts] = True
        # maps of all chunks: from START in a text's first, else constant from the first white space on
        codes, columns = np.ascontiguousarray(code.T), np.ascontiguousarray(column.T)
        state, n = np.where(first, START, UNSYNC).astype(np.int32), np.full(len(code), -16 * CHUNK, np.int64)
        full = len(self.states) > 0.9 * len(self.to)
        for j in range(CHUNK):
            x = self._advance(state, columns[j], codes[j])
            state = x >> 5
            n += x & 31
            if full or len(self.states) == len(self.to):
                lost.append(np.nonzero(state == LOST)[0] * CHUNK + j)
        # composition: heads run from the end of the chunk before; each has white space, so that end is known
        head = (column == 1).argmax(1) + 1
        now = np.nonzero(~first)[0]
        now = now[np.argsort(-head[now], kind="stable")]
        if now.size:
            s, length = state[now - 1], head[now]
            for j in range(int(length[0])):
                k = int(np.searchsorted(-length, -j, "left"))
                x = self._advance(s[:k], columns[j, now[:k]], codes[j, now[:k]])
                s[:k] = x >> 5
                n[now[:k]] += (x & 31) - 16
                if full or len(self.states) == len(self.to):
                    lost.append(now[:k][s[:k] == LOST] * CHUNK + j)
        return np.add.reduceat(n, starts), np.unique(np.concatenate(lost)) if lost else np.zeros(0, np.int64)


_SPACE_SET = frozenset(SPACES)
_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process and vocabulary; what it has compiled is used again."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit. vocabulary: path of a .json BPE model with word ends, there on every executor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for b in slices(batches, "text", 2 << 20):
            n = machine.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.binary_length(b.column(1)).fill_null(0).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
