"""BPE encoding by speculation and verification, and decoding.

Every word that a task has not met is first split greedily: the longest vocabulary
entry at each place, found for all places of a batch together by walking the trie of the
vocabulary (numpy).  The proposals of a batch are verified together: a split is the
BPE encoding exactly when every token is its own encoding and every two neighbours
are compatible, that is, no merge across their border would have come before the
merges that built them.  Borders of all proposals are checked at once over the
distinct pairs, by stepping both sides back through the merge tree (numpy).  Only
words with a failing border or token are merged exactly: short ones together, one
merge of each word at a time (numpy), long ones with a heap.

Texts are cut at white space, across which neither normalisation nor words reach; only
pieces that a task has not met are normalised and cut into words.

The vocabulary is a ``tokenizers`` JSON file with a BPE model, an optional
end-of-word suffix, NFC, white-space and lower-case normalisation, a word pattern and
byte-level symbols.  The driver reads it and broadcasts its tables (a file of fixed
size, ``MAX_VOCABULARY`` entries at most).

Pieces and words already encoded are remembered per task, up to about ``MEMO_WORDS`` of
both together; when it is full, what was not met in its last half is forgotten.  Results
never depend on it.

Defined results
* Null and empty texts have no tokens and decode to the empty text.
* Special tokens' strings in a text become those tokens, as in the library.
* Repeated rows come back as often as given; an empty table gives no rows; extra
  columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableguard.llm.common import batches_by_bytes, map_batches

MAX_VOCABULARY = 1_000_000
MEMO_WORDS = 250_000
MEMO_PAIRS = 1 << 21
MEMO_LENGTH = 64
SCAN_LENGTH = 48
WORDS_TOGETHER = 1 << 13   # words that are proposed and verified together
BLOCK_SYMBOLS = 1 << 14    # symbols of the words that are merged together
DECODE_TOKENS = 1 << 15    # tokens that are written out as text together
PART_BYTES = 1 << 20    # text that is cut into words at once

# --- fixed values: where the library's Unicode tables differ from those used here
# White space of the library's expressions.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Ranges that are letters here and are not (yet) in the library.
NEWER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
# Ranges that are numbers here and are not (yet) in the library.
NEWER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
# Lower case that the library knows and Python does not: one by one, then by range and distance.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
               0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The byte-level symbol of each byte, and back.
SYMBOLS = dict(zip(_PRINTABLE, map(chr, _PRINTABLE))) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BYTES = {s: b for b, s in SYMBOLS.items()}


class Vocabulary:
    """Token strings, merges and the merge tree, as plain tables."""

    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or len(model["vocab"]) > MAX_VOCABULARY:
            raise ValueError("not a BPE vocabulary within the size bound")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = text
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            if (i, j) in self.merges or self.rank[made] >= 0 or max(self.rank[i], self.rank[j]) >= r:
                raise ValueError("merges do not form a tree in rank order")
            self.merges[i, j] = r, made
            self.left[made], self.right[made], self.rank[made] = i, j, r
        keys = sorted((i * size + j, r) for (i, j), (r, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_ranks = np.array([r for _, r in keys], np.int64)
        self.made = np.full(len(self.merges) + 1, -1, np.int64)
        self.made[self.rank[self.rank >= 0]] = np.flatnonzero(self.rank >= 0)
        self.size = size
        self.base_ids = np.array([[self.ids.get(SYMBOLS[b] + end, -1) for b in range(256)] for end in ("", self.suffix)], np.int32)
        self._plant()
        shown = [t.encode("utf-8", "replace") + b" " for t in self.tokens]
        self.shown_sizes = np.array([len(t) for t in shown], np.int32)
        self.shown_starts = (np.cumsum(self.shown_sizes) - self.shown_sizes).astype(np.int32)
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _plant(self) -> None:
        """The trie of the tokens' bytes: nodes by depth, then by their bytes, so that a node's
        children follow one another.  Of each node: 256 bits for its children (four words), the
        first child of each word, and the tokens that end there, within a word and at its end."""
        coded, ids, at_end = [], [], []
        for token, i in self.ids.items():
            symbols = self._symbols(token)
            if symbols and all(c in BYTES for c in symbols):
                coded.append(bytes([BYTES[c] for c in symbols]))
                ids.append(i)
                at_end.append(symbols != token)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        text, starts = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(sizes) - sizes
        node, nodes, edges = np.zeros(len(coded), np.int64), 1, [np.empty(0, np.int64)]
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            made, back = np.unique(256 * node[live] + text[starts[live] + depth], return_inverse=True)
            node[live] = nodes + back
            nodes += len(made)
            edges.append(made)
        edge = np.concatenate(edges)    # parent and byte of every node but the root
        self.children = np.zeros(4 * nodes, np.uint64)
        np.bitwise_or.at(self.children, edge >> 6, np.uint64(1) << (edge & 63).astype(np.uint64))
        count = np.bincount(edge >> 6, minlength=4 * nodes)
        self.first_child = (1 + np.cumsum(count) - count).astype(np.int32)
        self.token_at = np.full((2, nodes), -1, np.int32)
        self.token_at[np.array(at_end, np.int64), node] = ids
        if not self.suffix:
            self.token_at[1] = self.token_at[0]

    def _symbols(self, token: str) -> str:
        return token[:-len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    # ------------------------------------------------------------ one word, exactly

    def base(self, word: str) -> list[int]:
        """Ids of the word's byte symbols, the last with the end-of-word suffix."""
        symbols = [*word[:-1], word[-1] + self.suffix]
        return [self.ids[s] for s in symbols if s in self.ids]

    def merge_exactly(self, ids: list[int]) -> list[int]:
        """Apply merges in rank order, the leftmost first."""
        return self._merge_scan(ids) if len(ids) <= SCAN_LENGTH else self._merge_heap(ids)

    def merge_together(self, words: list[list[int]]) -> list[list[int]]:
        """:meth:`merge_exactly` of many words."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat, sizes = self.merge_flat(np.fromiter(itertools.chain.from_iterable(words), np.int32, int(sizes.sum())), sizes)
        ends = np.cumsum(sizes).tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_flat(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge_exactly` of words that lie one behind the other; the short ones together, in blocks of like length."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        by_size = sizes[order]
        out, made = flat.copy(), sizes.copy()       # every word stays at its place, and gets no longer
        at, short = int(np.searchsorted(by_size, 0, side="right")), int(np.searchsorted(by_size, SCAN_LENGTH, side="right"))
        while at < short:
            # words up to the length that the block's last one has
            stop = min(short, at + max(1, BLOCK_SYMBOLS // int(by_size[at])))
            while stop > at + 1 and (stop - at) * int(by_size[stop - 1]) > BLOCK_SYMBOLS:
                stop = at + max(1, BLOCK_SYMBOLS // int(by_size[stop - 1]))
            block = order[at:stop]
            column = np.arange(int(by_size[stop - 1]) + 1)
            inside = column < sizes[block][:, None]
            ids = np.full(inside.shape, -1, np.int32)
            spots = (starts[block][:, None] + column)
            ids[inside] = flat[spots[inside]]
            ids, made[block] = self._merge_block(ids, sizes[block])
            inside = column < made[block][:, None]
            out[spots[inside]] = ids[inside]
            at = stop
        for k in order[short:].tolist():
            merged = self._merge_heap(flat[starts[k]:starts[k] + sizes[k]].tolist())
            out[starts[k]:starts[k] + len(merged)], made[k] = merged, len(merged)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return out[np.arange(len(flat)) - starts[owner] < made[owner]], made

    def _merge_block(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row for each word, -1 after its end; every step makes each row's first merge of the lowest rank."""
        width = ids.shape[1] - 1
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        done, live, never = ids.copy(), np.arange(len(ids)), len(self.merges)
        column = np.arange(width + 1)
        while len(live):
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(live)), best]
            on = rank < never
            if not on.all():
                done[live[~on]] = ids[~on]
                live, ids, ranks, best, rank = live[on], ids[on], ranks[on], best[on], rank[on]
            sizes[live] -= 1
            row = np.arange(len(live))
            # symbols behind the merged pair move up by one place, and so do their borders
            behind = column > best[:, None]
            ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind[:, 1:-1], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, never
            ids[row, best] = self.made[rank]
            ranks[row, best] = self.pair_rank(ids[row, best], ids[row, best + 1])
            left = np.maximum(best - 1, 0)
            ranks[row, left] = self.pair_rank(ids[row, left], ids[row, left + 1])
        return done, sizes

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of neighbours, the number of merges if there is none (-1: no symbol)."""
        if not len(self.pair_keys):
            return np.zeros(a.shape, np.int32)
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.size + b)
        spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[spot] == key, self.pair_ranks[spot], len(self.merges)).astype(np.int32)

    def _merge_scan(self, ids: list[int]) -> list[int]:
        """Short words: look for the lowest rank each time."""
        ids, merges, never = list(ids), self.merges, (len(self.merges), -1)
        found = [merges.get(p, never) for p in itertools.pairwise(ids)]
        while found:
            best = min(found)
            if best is never:
                break
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = merges.get((best[1], ids[i + 1]), never)
            if i:
                found[i - 1] = merges.get((ids[i - 1], best[1]), never)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        """Long words: heap over a linked list."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merges[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merges[pair][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], a, p))
        return [i for i in ids if i >= 0]

    # ----------------------------------------------------------------- speculation

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match from the left; None if a symbol is unknown."""
        text = bytes([BYTES[c] for c in word])
        tokens, _ = self.propose_all(text, np.array([len(text)]))
        return None if (tokens < 0).any() else tokens.tolist()

    def propose_all(self, text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of words that lie one behind the other, of the given numbers of
        bytes: tokens (-1: none begins there), and the word that each belongs to."""
        token, length = self.longest(np.frombuffer(text, np.uint8), sizes)
        after, spots, at, n = (np.arange(len(text)) + length).tolist(), [], 0, len(text)
        while at < n:       # a match ends with its word at the latest, where the next one begins
            spots.append(at)
            at = after[at]
        spots = np.array(spots, np.int64)
        return token[spots], np.repeat(np.arange(len(sizes)), sizes)[spots]

    def longest(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at every place within its word, and its bytes (-1 and one if there is none)."""
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        token, length = np.full(len(text), -1, np.int32), np.ones(len(text), np.int32)
        live, node, depth = np.arange(len(text)), np.zeros(len(text), np.int32), 0
        while len(live):
            byte = text[live + depth]
            word, bit = 4 * node + (byte >> 6), (byte & 63).astype(np.uint64)
            children = self.children[word]
            on = (children >> bit) & np.uint64(1) != 0
            live, word, bit, children = live[on], word[on], bit[on], children[on]
            node = self.first_child[word] + np.bitwise_count(children & ((np.uint64(1) << bit) - np.uint64(1)))
            depth += 1
            ends = left[live] == depth
            found = np.where(ends, self.token_at[1][node], self.token_at[0][node])
            hit = found >= 0
            token[live[hit]], length[live[hit]] = found[hit], depth
            live, node = live[~ends], node[~ends]
        return token, length

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of neighbouring tokens: would BPE leave the border between them alone?

        Walk back in time: undo whichever side's merge came last (of equal ranks the
        right one, since merges run from the left).  The border breaks if at some
        moment the two sides standing there have a merge that comes before the next
        merge of either side.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        never = np.int64(len(self.merges) + 1)
        limit_x, limit_y = np.full(len(x), never), np.full(len(x), never)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            key = x[live] * self.size + y[live]
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1) if len(self.pair_keys) else key * 0
            rank = np.where(self.pair_keys[spot] == key, self.pair_ranks[spot], never) if len(self.pair_keys) else key * 0 + never
            broken = (rank < limit_x[live]) & (rank <= limit_y[live]) & (rank < never)
            good[live[broken]] = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            on = ~broken & ((rx >= 0) | (ry >= 0))
            live, rx, ry = live[on], rx[on], ry[on]
            undo_x = rx > ry
            i, j = live[undo_x], live[~undo_x]
            limit_x[i], x[i] = rx[undo_x], self.right[x[i]]
            limit_y[j], y[j] = ry[~undo_x], self.left[y[j]]
        return good


class Encoder:
    """Encodes texts word by word, with the words' results kept for reuse."""

    def __init__(self, vocabulary: Vocabulary, memo_words: int = MEMO_WORDS):
        self.v, self.memo_words = vocabulary, memo_words
        self.memo: dict[str, bytes] = {}    # by piece of a text, and special token
        self.words_memo: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}      # both, before they last were full
        self.pairs, self.fine = np.empty(0, np.int64), np.empty(0, bool)  # checked borders, sorted
        self.whole: dict[int, bool] = {}
        self.exact = self.seen = 0
        letter, number = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
        words = rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[[^{SPACE}]--{letter}--{number}]+"
        self.words = regex.compile(words, regex.V1)
        self.words_and_blanks = regex.compile(f"{words}| ", regex.V1)
        self.ascii_words_and_blanks = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+| ")     # the same in lower-case ASCII
        self.newer = regex.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def normalise(self, text: str) -> str:
        """NFC, one space for each run of white space, lower case letter by letter (no final sigma)."""
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        if not text.isascii():
            text = text.replace("\u03A3", "\u03C3")
            if self.newer.search(text):
                text = text.translate(NEWER_LOWER)
        return text.lower()

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        return self.words.findall(self.normalise(text))

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space and around special tokens."""
        if self.specials and self.specials.search(text):
            return [p for k, part in enumerate(self.specials.split(text)) for p in ([part] if k % 2 else self._blocks(part))]
        return self._blocks(text)

    def _blocks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):    # white space for Python only
            return [p for p in self.spaces.split(text) if p]
        return text.split()

    def learn(self, fresh: set[str]) -> None:
        """Encode the distinct pieces ``fresh`` (no special tokens) by their words."""
        self._recall(fresh, self.memo, self.older[0])
        plain = [p for p in fresh if p.isascii()]
        for pieces, pattern in ((plain, self.ascii_words_and_blanks), (list(fresh.difference(plain)), self.words_and_blanks)):
            if pieces:
                self._learn_pieces(pieces, pattern.findall(self.normalise(" ".join(pieces))))

    @staticmethod
    def _recall(fresh: set[str], memo: dict[str, bytes], older: dict[str, bytes]) -> None:
        """Take from ``fresh`` what ``older`` knows."""
        again = [x for x in fresh if x in older]
        memo.update((x, older[x]) for x in again)
        fresh.difference_update(again)

    def _learn_pieces(self, pieces: list[str], found: list[str]) -> None:
        """``found``: the words of all pieces, a blank between two pieces."""
        known = self.words_memo
        words = set(found).difference(known, " ")
        self._recall(words, known, self.older[1])
        for some in itertools.batched(words, WORDS_TOGETHER):
            self.learn_words(some)
        known[" "] = b" "       # not an encoding (those have four bytes for each token): marks where a piece ends
        ids = list(map(known.__getitem__, found))
        del known[" "]
        ends = [*np.flatnonzero(np.fromiter(map(len, ids), np.int64, len(ids)) == 1).tolist(), len(ids)]
        starts = [0, *(k + 1 for k in ends)]
        self.memo.update(zip(pieces, [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip(starts, ends)], strict=True))
        for w in words:
            if len(w) > MEMO_LENGTH:
                del known[w]

    def learn_words(self, words: Sequence[str]) -> None:
        """Encode the distinct ``words`` together: propose, verify, merge what fails."""
        coded = [w.encode("utf-8", "replace") for w in words]
        text, sizes = b"".join(coded), np.fromiter(map(len, coded), np.int64, len(coded))
        flat, owner = self.v.propose_all(text, sizes)
        wrong = np.zeros(len(words), bool)
        wrong[owner[flat < 0]] = True
        distinct, back = np.unique(flat, return_inverse=True)
        own = np.array([t < 0 or self._is_whole(t) for t in distinct.tolist()])
        wrong[owner[~own[back]]] = True
        border = (owner[1:] == owner[:-1]) & ~wrong[owner[1:]]
        pairs, back = np.unique(flat[:-1][border].astype(np.int64) * self.v.size + flat[1:][border], return_inverse=True)
        wrong[owner[1:][border][~self._check(pairs)[back]]] = True
        self.seen += len(words)
        self.exact += int(wrong.sum())
        right = ~wrong[owner]
        self._keep(itertools.compress(words, ~wrong), flat[right], np.bincount(owner[right], minlength=len(words))[~wrong])
        if wrong.any():
            of = np.repeat(wrong, sizes)
            last = np.zeros(len(text), np.int64)
            last[np.cumsum(sizes) - 1] = 1
            base = self.v.base_ids[last[of], np.frombuffer(text, np.uint8)[of]]
            owner = np.repeat(np.arange(int(wrong.sum())), sizes[wrong])[base >= 0]
            self._keep(itertools.compress(words, wrong), *self.v.merge_flat(base[base >= 0], np.bincount(owner, minlength=int(wrong.sum()))))

    def _keep(self, words: Iterator[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the encodings of words, given one behind the other."""
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.words_memo.update(zip(words, [ids[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def _is_whole(self, token: int) -> bool:
        """Is the token the encoding of its own string?"""
        if token not in self.whole:
            text = self.v.tokens[token]
            ended = bool(self.v.suffix) and text.endswith(self.v.suffix)
            symbols = self.v._symbols(text)
            base = [*symbols[:-1], symbols[-1] + (self.v.suffix if ended else "")] if symbols else []
            self.whole[token] = self.v.merge_exactly([self.v.ids[s] for s in base]) == [token]
        return self.whole[token]

    def _check(self, pairs: np.ndarray) -> np.ndarray:
        """Are the borders of these distinct, sorted pairs fine?  Checked ones are kept."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs, self.fine = self.pairs[:0], self.fine[:0]
        at = np.searchsorted(self.pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == pairs[inside]
        new = pairs[~known]
        self.fine = np.insert(self.fine, at[~known], self.v.compatible(new // self.v.size, new % self.v.size))
        self.pairs = np.insert(self.pairs, at[~known], new)
        return self.fine[np.searchsorted(self.pairs, pairs)]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        for ids, shown in self.encode_bytes(texts):
            yield ids, shown.decode("utf-8")

    def encode_bytes(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """:meth:`encode` with the decoded texts in UTF-8."""
        memo = self.memo
        if 2 * (len(memo) + len(self.words_memo)) > self.memo_words:
            self.older = memo, self.words_memo
            self.memo, self.words_memo = memo, _ = {}, {}
        memo.update({t: i.to_bytes(4, "little") for t, i in self.v.special.items()})
        cut = [self.pieces(text) for text in texts]
        fresh = set(itertools.chain.from_iterable(cut)).difference(memo)
        long = [p for p in fresh if len(p) > MEMO_LENGTH]
        if fresh:
            self.learn(fresh)
        waiting, tokens = [], 0
        for pieces in cut:
            ids = b"".join(map(memo.__getitem__, pieces))
            waiting.append(ids)
            tokens += len(ids) // 4
            if tokens >= DECODE_TOKENS:
                yield from zip(waiting, self.shown(waiting), strict=True)
                waiting, tokens = [], 0
        yield from zip(waiting, self.shown(waiting), strict=True)
        for p in long:
            del memo[p]

    def shown(self, encoded: list[bytes]) -> list[bytes]:
        """The tokens of each encoding, a blank between two tokens."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        sizes = self.v.shown_sizes[ids]
        ends = np.cumsum(sizes)
        spots = np.repeat(self.v.shown_starts[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())
        text = self.v.shown[spots].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([len(e) // 4 for e in encoded], dtype=np.int64)].tolist()
        return [text[a:max(a, b - 1)] for a, b in zip([0, *stops], stops)]

    def text_of(self, ids: list[int]) -> str:
        """The normalised words that the ids stand for, one space after each word."""
        out = []
        for i in ids:
            token = self.v.tokens[i]
            if token in self.v.special:
                out.append(token.encode())
                continue
            ended = bool(self.v.suffix) and token.endswith(self.v.suffix)
            out.append(bytes(BYTES[c] for c in self.v._symbols(token)) + (b" " if ended else b""))
        return b"".join(out).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(data: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(data))
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array, if ``with_ids``), ids_sha256, decoded_sha256."""
    with open(vocabulary_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()   # what this worker kept from earlier stages
        encoder = _encoder(sent.value)
        for batch in batches:
            for part in batches_by_bytes(batch, "text", PART_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = [(len(i) // 4, i, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in encoder.encode_bytes(texts)]
                n, ids, h, d = zip(*rows)
                out = [part.column("id"), pa.array(n, pa.int64()), pa.array(h), pa.array(d)]
                if with_ids:
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(rows, run, shape).withColumnRenamed("id", id_col)


def decode_ids(frame: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``frame`` with the normalised text that each row's ids stand for."""
    with open(vocabulary_path, encoding="utf-8") as file:
        sent = frame.sparkSession.sparkContext.broadcast(file.read())

    @F.udf("string", useArrow=True)
    def text(ids):
        return None if ids is None else _encoder(sent.value).text_of(list(ids))

    return frame.withColumn(out_col, text(ids_col))
