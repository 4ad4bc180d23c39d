"""Token counts of whole texts by a compiled finite-state transducer.

A byte-level BPE tokenizer is compiled into two deterministic machines with transition tables.

The splitter reads a symbol for each character (its class, and what of the next characters the
splitting pattern looks at) and has nine states; a transition says whether a piece begins before
the character. Whatever state it starts in, four symbols lead it to the same one, so the states
of all characters at once are found by composing every symbol's map with the three before it.

The counter reads a piece's bytes. Of BPE it is known that each prefix of a piece has one last
token, and that a token may follow another just if the two, merged by themselves, stay two. So a
state holds the places in the vocabulary's trie where a token may be under way, each with the last
token before it and how many tokens began since; reading a byte settles the prefix's last token,
and the transition is annotated with the tokens that the prefix has more than the one before
(0 or less where tokens merge). A piece's count is the sum along its path. States and transitions
are compiled when first met and kept in a hash table of (state, byte) -> (state, tokens).

Texts are cut into chunks, and all chunks of a batch take their steps together, as array look-ups.
At the start of a piece every state is left for the first one, so the map of a chunk that begins
there is a constant. Chunks inside a very long piece have a map with an entry for each state that
can be alive at their start; maps of neighbours compose pairwise in rounds of a prefix scan, and
a chunk's tokens are summed. Nothing is shuffled: a text is one row's value throughout.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import string_slices

#: Bytes of a chunk, of a chunk inside a very long piece, and of the text before such a chunk that suggests its state.
CHUNK, LONG_CHUNK, LEAD = 256, 1024, 64
#: Bytes of texts whose chunks step together.
SLICE = 1 << 21
#: Bytes of a long text that are read at once, if it has a place to part it.
WINDOW = 1 << 22
#: States that a worker keeps; beyond that it compiles anew, with the same results.
KEPT_STATES = 250_000
#: What stands for no tokens more where a number of 16 bits is packed.
EVEN = 1 << 15
#: A rank that no merge has.
NEVER = 1 << 60
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

# The splitter's symbols: letter, digit, blank before a visible character, other white space before
# one, white space before more of it or the end, other, apostrophe of a contraction of one or of two letters.
LETTER, NUMBER, BLANK, SPACE, SPACES, OTHER, SHORT, LONG = range(8)
# Its states, by what was read last: nothing; a letter; a digit; a blank that belongs to what comes;
# white space; other; a contraction with one or two letters to come; a whole contraction.
BEGIN, IN_LETTERS, IN_DIGITS, AFTER_BLANK, IN_SPACES, IN_OTHERS, ONE_LEFT, TWO_LEFT, CONTRACTED = range(9)
MAP_LENGTH = 4


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by state * 8 + symbol, of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    after, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    after[:] = (IN_LETTERS, IN_DIGITS, AFTER_BLANK, IN_SPACES, IN_SPACES, IN_OTHERS, ONE_LEFT, TWO_LEFT)
    for joined, symbol in ((IN_LETTERS, LETTER), (IN_DIGITS, NUMBER), (IN_OTHERS, OTHER), (IN_SPACES, SPACES)):
        begins[joined, symbol] = False
    for symbol in (LETTER, NUMBER, OTHER, SHORT, LONG):
        begins[AFTER_BLANK, symbol] = False
    for state in (IN_OTHERS, AFTER_BLANK):  # an apostrophe within such a run begins no contraction
        for symbol in (SHORT, LONG):
            after[state, symbol], begins[state, symbol] = IN_OTHERS, False
    after[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = CONTRACTED, False
    after[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, False
    return after.ravel(), begins.ravel()


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    import regex

    valid = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = valid.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, text):
            out[valid[m.start() : m.end()]] = kind
    return out


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, others for 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def checked_merges(spec: dict) -> list[tuple[str, str]]:
    """The merges of a byte-level BPE ``tokenizer.json``; raises for settings that the machines don't have."""
    model, parts = spec["model"], spec.get("pre_tokenizer") or {}
    off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(name) for name in off) or spec.get("normalizer"):
        raise ValueError("token counts need a plain BPE model without a normalizer")
    if parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
        raise ValueError("token counts need the ByteLevel splitting pattern without a prefix space")
    if any(t.get(name) for t in spec.get("added_tokens", []) for name in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("token counts take added tokens as they are written only")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {a + b: i for i, (a, b) in enumerate(merges)}
    if len(rank) < len(merges) or any(rank.get(part, -1) >= i for i, pair in enumerate(merges) for part in pair):
        raise ValueError("merges must make different tokens, each after those of its parts")
    return merges


class Transducer:
    """Counts tokens of texts; compiled from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = checked_merges(spec)
        letters = byte_alphabet()
        number = {letters[b]: b for b in range(256)}
        for a, b in merges:
            number[a + b] = len(number)
        #: (left token, right token) -> (rank, token), and each token's bytes as tokens
        self.merge = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(merges)}
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [[back[c] for c in token] for token in number]
        self.children: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, spelled in enumerate(self.bytes_of):
            node = 0
            for byte in spelled:
                self.inner[node] = True
                if (child := self.children.get(node << 8 | byte)) is None:
                    child = self.children[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = child
            self.token_at[node] = token
        self.after, self.begins = splitter()
        specials = sorted((t["content"].encode() for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, specials))) if specials else None
        self.parts_at_blanks = not any(b" " in s for s in specials)
        #: each merged token's rank and parts
        self.made = {token: (rank, pair) for pair, (rank, token) in self.merge.items()}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.follows: dict[int, bool] = {}
        self.forget()

    # the counter's states and transitions

    def forget(self) -> None:
        """Begin anew with the state in which a piece begins."""
        self.states, self.numbers = [(self.entry(0, -1, 0),)], {}
        self.numbers[self.states[0]] = 0
        self.known, self.bits = 0, 16
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    @staticmethod
    def entry(node: int, last: int, began: int) -> int:
        """A place of the trie, the last token before it (-1: the piece began) and the tokens more since, in one number."""
        return node << 40 | (last + 1) << 16 | began + EVEN

    def proper(self, token: int) -> bool:
        """Whether the token's own bytes, merged by rank from the left, end as the token."""
        if token not in self.whole:
            parts, never = list(self.bytes_of[token]), (len(self.merge), -1)
            while len(parts) > 1:
                best = min((*self.merge.get(pair, never), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if best[1] < 0:
                    break
                parts[best[2] : best[2] + 2] = [best[1]]
            self.whole[token] = parts == [token]
        return self.whole[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        if (found := self.edges[side].get(token)) is None:
            found, end = [], NEVER
            while token >= 0:
                found.append((token, end))
                end, pair = self.made.get(token, (NEVER, (-1, -1)))
                token = pair[side]
            self.edges[side][found[0][0]] = found = found[::-1]
        return found

    def may_follow(self, last: int, token: int) -> bool:
        """Whether two tokens' bytes, merged by rank from the left, end as these two: nothing merges across.

        At the seam the right edge of the one and the left edge of the other grow in the order of
        ranks; they merge if some two of them stand there while their rank is the least.
        """
        if not self.proper(token) or last < 0:
            return self.proper(token)
        if (known := self.follows.get(last << 32 | token)) is not None:
            return known
        lefts, rights = self.edge(last, 1), self.edge(token, 0)
        i = j = 0
        apart = True
        while True:
            (a, end_a), (b, end_b) = lefts[i], rights[j]
            if (crossing := self.merge.get((a, b))) is not None and crossing[0] < end_a and crossing[0] <= end_b:
                apart = False
                break
            if end_a == end_b == NEVER:
                break
            if end_a <= end_b:
                i += 1
            else:
                j += 1
        if len(self.follows) > 4 * KEPT_STATES:
            self.follows.clear()
        self.follows[last << 32 | token] = apart
        return apart

    def compile(self, key: int) -> int:
        """The transition of (state << 8 | byte): next state << 8 | its tokens + 128."""
        byte, last, more, moved = key & 255, -1, 0, []
        for packed in self.states[key >> 8]:
            child = self.children.get((packed >> 40) << 8 | byte)
            if child is None:
                continue
            before, began = (packed >> 16 & 0xFFFFFF) - 1, (packed & 0xFFFF) - EVEN
            token = self.token_at[child]
            if token >= 0 and last < 0 and self.may_follow(before, token):
                last, more = token, 1 - began
            if self.inner[child]:
                moved.append((child, before, began))
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        state = (self.entry(0, last, 0), *(self.entry(n, b, c + more) for n, b, c in moved))
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number << 8 | more + 128

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * GOLDEN >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add transitions; the table stays three quarters empty."""
        self.known += len(keys)
        if self.known << 2 > len(self.keys):
            there = self.keys >= 0
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.bits = int(self.known << 3).bit_length()
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at = self.slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def transitions(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of keys (state << 8 | byte), compiling those that aren't known."""
        at = self.slots(keys)
        found = self.keys[at]
        out = self.values[at]
        other = np.flatnonzero(found != keys)
        while len(other):
            absent = found[other] < 0
            if absent.any():
                new = np.unique(keys[other[absent]])
                self.put(new, np.array([self.compile(k) for k in new.tolist()], np.int64))
                at[other] = self.slots(keys[other])
            else:
                at[other] = (at[other] + 1) & (len(self.keys) - 1)
            found[other] = self.keys[at[other]]
            out[other] = self.values[at[other]]
            other = other[found[other] != keys[other]]
        return out

    def walk(self, data: np.ndarray, inside: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, tokens) of chunks of ``data``, all taking their steps together from their states."""
        order = np.argsort(-size, kind="stable")
        at, left, now = start[order], -size[order], state[order].copy()
        total = np.zeros(len(order), np.int64)
        for step in range(int(-left[0]) if len(left) else 0):
            m = int(np.searchsorted(left, -step))
            place = at[:m] + step
            moved = self.transitions((now[:m] * inside[place]) << 8 | data[place])
            now[:m] = moved >> 8
            total[:m] += (moved & 255) - 128
        end, tokens = np.empty_like(now), np.empty_like(total)
        end[order], tokens[order] = now, total
        return end, tokens

    # chunk maps inside very long pieces

    def chunk_maps(self, data: np.ndarray, inside: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """For neighbouring chunks, {start state: (end state, tokens)} of each state that can be alive there.

        The text just before a chunk suggests a state; each end state that the next map lacks is added to it.
        """
        lead = np.minimum(start - start[0], LEAD)
        guess, _ = self.walk(data, inside, start - lead, lead, np.zeros(len(start), np.int64))
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in start]
        waiting = [(i, int(s)) for i, s in enumerate(guess)]
        while waiting:
            which = np.array([w[0] for w in waiting])
            end, tokens = self.walk(data, inside, start[which], size[which], np.array([w[1] for w in waiting]))
            for (i, s), e, n in zip(waiting, end.tolist(), tokens.tolist(), strict=True):
                maps[i][s] = e, n
            ahead = {(i + 1, maps[i][s][0]) for i, s in waiting if i + 1 < len(maps)}
            waiting = sorted((i, s) for i, s in ahead if s not in maps[i])
        return maps

    @staticmethod
    def compose(maps: list[dict[int, tuple[int, int]]]) -> dict[int, tuple[int, int]]:
        """The map of neighbouring chunks together, by rounds of pairs."""
        while len(maps) > 1:
            pairs = [{s: (b[e][0], n + b[e][1]) for s, (e, n) in a.items()} for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    # texts

    def symbols(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, place of its first byte, whether a text begins) of each character of UTF-8 ``data``."""
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        place = np.flatnonzero((data & 0xC0) != 0x80)
        begins = first[place]
        symbol = character_classes()[code]
        space = symbol == SPACE
        ends = np.append(begins[1:], True)  # no character of the same text follows
        visible_next = np.append(~space[1:], False) & ~ends
        symbol[space & ~visible_next] = SPACES
        symbol[(code == 32) & visible_next] = BLANK
        quote = np.flatnonzero((code == 39) & ~ends)
        if len(quote):
            padded = np.append(code, [0, 0])
            one, two = padded[quote + 1], np.where(np.append(ends, True)[quote + 1], 0, padded[quote + 2])
            symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
            pairs = np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            symbol[quote[pairs]] = LONG
        return symbol, place, begins

    def piece_starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places in ``data`` where pieces begin; ``first`` marks those where texts do."""
        symbol, place, begins = self.symbols(data, first)
        state = self.after[IN_LETTERS * 8 + symbol]
        for _ in range(MAP_LENGTH):  # each round composes every symbol's map with one more before it
            before = np.concatenate([[BEGIN], state[:-1]]).astype(np.uint8)
            before[begins] = BEGIN
            at = before * np.uint8(8) + symbol
            state = self.after[at]
        return place[self.begins[at] | begins]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts whose UTF-8 bytes follow each other in ``data``."""
        if len(self.states) > KEPT_STATES:
            self.forget()
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return out
        first, plain = np.zeros(len(data) + 1, bool), np.ones(len(data), bool)
        first[offsets] = True
        raw, at = data.tobytes(), 0
        while self.special is not None and (m := self.special.search(raw, at)):
            at = m.end()
            text = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            if m.end() > offsets[text + 1]:  # across two texts
                at = m.start() + 1
                continue
            first[m.start()] = first[m.end()] = True
            plain[m.start() : m.end()] = False
            out[text] += 1
        first = first[:-1]
        pieces = self.piece_starts(data, first)
        inside = np.ones(len(data), np.uint8)
        inside[pieces] = 0
        # chunks begin at pieces: the first of each stretch of CHUNK bytes, and each text's first
        chosen = first[pieces]
        chosen[1:] |= pieces[1:] // CHUNK != pieces[:-1] // CHUNK
        start = pieces[chosen]
        size = np.diff(np.append(start, len(data)))
        kept = plain[start]
        start, size = start[kept], size[kept]
        text = np.searchsorted(offsets, start, side="right") - 1
        long = size > 2 * LONG_CHUNK
        _, tokens = self.walk(data, inside, start[~long], size[~long], np.zeros(int((~long).sum()), np.int64))
        np.add.at(out, text[~long], tokens)
        for a, n, t in zip(start[long].tolist(), size[long].tolist(), text[long].tolist(), strict=True):
            cuts = np.arange(a, a + n, LONG_CHUNK)
            maps = self.chunk_maps(data, inside, cuts, np.diff(np.append(cuts, a + n)))
            out[t] += self.compose(maps)[0][1]
        return out

    def windows(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A text in parts of about WINDOW bytes, parted before a blank between a visible and a Latin letter."""
        raw, at = data.tobytes(), 0
        while self.parts_at_blanks and len(raw) - at > 2 * WINDOW:
            cut = at + WINDOW
            while (cut := raw.find(b" ", cut)) > 0 and not (raw[cut + 1 : cut + 2].isalpha() and raw[cut - 1 : cut].isalnum()):
                cut += 1
            if cut < 0:
                break
            yield data[at:cut]
            at = cut
        yield data[at:]


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _count(path: str, names: list[str]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        t = transducer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, offsets in string_slices(texts, SLICE):
                sizes.append(np.diff(offsets))
                if len(offsets) == 2 and len(data) > 2 * WINDOW:
                    tokens.append(np.array([sum(int(t.count(part, np.array([0, len(part)]))[0]) for part in t.windows(data))]))
                else:
                    tokens.append(t.count(data, offsets))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], names=names)

    return run


def token_counts(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """``docs``'s columns but the text, and ``n_bytes`` (UTF-8) and ``n_tokens`` long.

    ``tokenizer`` is the path of a byte-level BPE ``tokenizer.json`` that every executor can
    open; other kinds and settings raise. Counts are what the tokenizers library gives without
    begin or end tokens: an added token's string inside a text is one token. Null and empty texts
    have 0 bytes and tokens, however long a text is it is counted whole, repeated rows are counted
    each, an empty table gives an empty one. Columns of ``docs`` named ``n_bytes`` or ``n_tokens``
    (in any case) are replaced by the results.
    """
    results = ("n_bytes", "n_tokens")
    others = [c for c in docs.columns if c != text_column and c.lower() not in results]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(c, T.LongType()) for c in results])
    given = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_column).cast("string"))
    return given.mapInArrow(_count(tokenizer, [*others, *results]), schema)
