"""Byte-level BPE by speculation: greedy longest matches, checked pair by pair, merged exactly only where a check fails.

A split of a word into tokens is the one that the merges give if every two neighbours are compatible: merging the two
tokens' bytes alone leaves the border between them. So a word is first cut greedily into its longest known tokens, all
borders of a batch are checked together, and only words with a failing border go through the merges.

Each step works on arrays of a whole slice of texts: stretches between spaces, their words and those words' tokens are
each handled once a slice, and none of them costs a call of its own. Nothing is kept from one slice to the next.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from stockflow.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: the split of text into words that the vocabulary is made for (fixed value)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: kinds of characters in WORDS
OTHER, LETTER, NUMBER, BLANK = range(4)
#: where letters and numbers lie that Unicode has only since version 17; the tokenizers library, by version 16, knows none
#: of them (fixed value; between them lie only free places and signs)
NEWER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10eee
11b0a 11db0-11df1 1246f-1247f 12550-12686 16ea0-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1dfff 1e6c0-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-3fc3f"""
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def kinds() -> np.ndarray:
    """The kind of every character, by code point, as of Unicode 16."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    for newer in NEWER.split():
        start, _, end = newer.partition("-")
        out[int(start, 16) : int(end or start, 16) + 1] = OTHER
    return out


class Table:
    """Values of integer keys for whole arrays of keys, in slots of which at most half are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        """keys: different ones, none below 0. missing: the value of every other key."""
        bits = max(4, (2 * len(keys)).bit_length())
        self.last, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several keys the last stays, the others go on to the next slot
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        far = np.flatnonzero((found != keys) & (found >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & self.last
            found, out[far] = self.keys[slot[far]], self.values[slot[far]]
            far = far[(found != keys[far]) & (found >= 0)]
        return out


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The stretches of data between each offset and the next."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of large binaries or strings without nulls."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if offsets else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)


def sums(counts: np.ndarray) -> np.ndarray:
    """The sums of the counts before each place, and of all."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each start as many places from there on as its count says, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - sums(counts)[:-1], counts)


def replaced(tokens: np.ndarray, counts: np.ndarray, at: np.ndarray, new: np.ndarray, new_counts: np.ndarray):
    """Tokens one after the other and their counts, with new ones at some places."""
    keep = np.ones(len(counts), bool)
    keep[at] = False
    old, counts = tokens[np.repeat(keep, counts)], counts.copy()
    counts[at] = new_counts
    start = sums(counts)[:-1]
    out = np.empty(len(old) + len(new), np.int64)
    out[places(start[keep], counts[keep])] = old
    out[places(start[at], new_counts)] = new
    return out, counts


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, vocabulary: str):
        """vocabulary: the JSON text of a tokenizer file of the byte-level BPE kind."""
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: as_bytes(t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        own = {t: i for t, i in ids.items() if t not in self.added}
        n = max(self.bytes_of) + 1
        # by token: its halves, and the place of its merge (-1 for single bytes)
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        self.merges = {}
        for place, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            t, pair = own[a + b], (own[a], own[b])
            self.merges[pair] = (place, t)
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = *pair, place
        self.n = n
        self.made = np.array([t for _, t in self.merges.values()], np.int64)  # by place
        self._pair_rank = Table(np.array([a * n + b for a, b in self.merges], np.int64), np.arange(len(self.merges)), NEVER)
        self.single = np.array([own[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        # the greedy cut uses only tokens that the merges make of their own bytes
        made = np.flatnonzero(self.rank >= 0)
        sound = made[self.compatible(self.left[made], self.right[made], joined=True)]
        greedy = {self.bytes_of[i]: i for i in [*self.single.tolist(), *sound.tolist()]}
        node = {b"": 0}  # by beginning of a token
        for token in greedy:
            for end in range(1, len(token) + 1):
                node.setdefault(token[:end], len(node))
        steps = [node[start[:-1]] * 257 + start[-1] for start in node if start]
        self.first = np.array([node[bytes([b])] for b in range(256)])
        self.step = Table(np.array(steps, np.int64), np.arange(1, len(node)), -1)
        self.token_at = np.full(len(node), -1)
        self.token_at[[node[t] for t in greedy]] = list(greedy.values())
        self.raw = pa.array([self.bytes_of.get(i, b"") for i in range(n)], pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.added_bytes = {t.encode(): i for t, i in self.added.items()}
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added_bytes, key=len, reverse=True))))
        self.kinds = kinds()

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether no merge crosses the border while the two tokens are made; with `joined` not before the last merge.

        Goes back in time from the finished tokens x | y that touch the border: the later of the two is undone to its
        half at the border, until both are single bytes. While x and y stand side by side, they merge if their pair
        comes before the merge that takes x away (on a tie the left one goes first) and not after the one that takes y.
        """
        ok = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_goes, y_goes = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live, first = np.arange(len(a)), True
        while len(live):
            meets = self._pair_rank(x[live] * self.n + y[live])
            crosses = (meets < x_goes[live]) & (meets <= y_goes[live]) & (meets < NEVER)
            if not (first and joined):
                ok[live[crosses]] = False
                live = live[~crosses]
            first = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            undo_x = rx > ry
            left, right = live[undo_x], live[~undo_x]
            x_goes[left], y_goes[right] = rx[undo_x], ry[~undo_x]
            x[left], y[right] = self.right[x[left]], self.left[y[right]]
        return ok

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The tokens that the merges give, by word."""
        tokens, counts = self.merge_words(pa.array(words, pa.large_binary()))
        ends = np.cumsum(counts).tolist()
        return [tokens[end - n : end].tolist() for n, end in zip(counts.tolist(), ends)]

    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The merges themselves, for many words side by side: per round each word's first pair in their order goes,
        wherever it stands, from left to right. Words without a pair to merge leave the round. All words' tokens one
        after the other, and how many each word has.
        """
        done = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        offsets, data = parts(words)
        owner = np.repeat(np.arange(len(words)), np.diff(offsets))
        token = self.single[data]

        def ranks(at):
            """Of the pairs that start at these places; NEVER at the end of a word."""
            got = np.full(len(at), NEVER)
            inner = np.flatnonzero(at + 1 < len(token))
            inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
            got[inner] = self._pair_rank(token[at[inner]] * self.n + token[at[inner] + 1])
            return got

        pair = ranks(np.arange(len(token)))
        while len(token):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(owner))
            least = np.minimum.reduceat(pair, starts)
            live = np.repeat(least < NEVER, sizes)
            done.append((owner[~live], token[~live]))
            least = np.repeat(least, sizes)[live]
            token, owner, pair = token[live], owner[live], pair[live]
            if not len(token):
                break
            hit = np.flatnonzero(pair == least)
            # in a row of overlapping hits every second one goes, from the left
            fresh = np.diff(hit, prepend=-2) != 1
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            token[hit] = self.made[pair[hit]]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            token, owner, pair = token[keep], owner[keep], pair[keep]
            now = place[hit]
            before = now[now > 0] - 1
            pair[now] = ranks(now)
            pair[before] = ranks(before)
        owner, token = map(np.concatenate, zip(*done))
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def propose(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The greedy cut: all words' tokens one after the other, and how many each word has.

        First the longest token from every place on, for all places together, then the places that a cut comes by.
        """
        offsets, data = parts(words)
        letters = np.full(len(data) + len(words), 256)  # a 256 after each word
        letters[places(offsets[:-1] + np.arange(len(words)), np.diff(offsets))] = data
        token, size = np.full(len(letters), -1), np.ones(len(letters), np.int64)
        at = np.flatnonzero(letters < 256)
        node, depth = self.first[data], 1
        token[at] = self.single[data]
        while len(at):
            node = self.step(node * 257 + letters[at + depth])
            known = np.flatnonzero(node >= 0)
            at, node, depth = at[known], node[known], depth + 1
            found = self.token_at[node]
            whole = np.flatnonzero(found >= 0)
            token[at[whole]], size[at[whole]] = found[whole], depth
        seen = letters == 256
        ends = np.flatnonzero(seen)
        at = offsets[:-1] + np.arange(len(words))
        at = at[~seen[at]]
        while len(at) > 50:
            seen[at] = True
            at = at + size[at]
            at = at[~seen[at]]
        for place in at.tolist():  # the few long words that are left
            while not seen[place]:
                seen[place] = True
                place += int(size[place])
        seen[ends] = False
        return token[seen], np.diff(np.cumsum(seen)[ends], prepend=0)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All words' tokens one after the other, and how many each word has."""
        tokens, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[:-1] == owner[1:])  # all but the last token of a word have a border to their right
        codes, back = np.unique(tokens[inner] * self.n + tokens[inner + 1], return_inverse=True)
        good = self.compatible(codes // self.n, codes % self.n)
        failing = np.zeros(len(words), bool)
        failing[owner[inner[~good[back]]]] = True
        again = np.flatnonzero(failing)
        return replaced(tokens, counts, again, *self.merge_words(words.take(pa.array(again))))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretches of the texts begin that encode on their own, and the end; the first stretch of each text,
        and the end. Added tokens are stretches.

        A border of words lies before every space after a character that is no white space. The character is known by
        its last two bytes; some others than white space share those of white space, and are not cut behind.
        """
        offsets, data = parts(texts)
        border = np.zeros(len(data) + 1, bool)
        at = np.flatnonzero(data[2:] == 0x20) + 2
        before = data[at - 1]
        many = (before >= 0x80) & ~np.isin(data[at - 2], (0xC2, 0x9A, 0x80, 0x81))
        border[at[((before > 0x20) & (before < 0x7F)) | many]] = True
        border[offsets] = True
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(holds).tolist():
            for found in self.any_added.finditer(texts[i].as_buffer()):
                start, end = offsets[i] + found.start(), offsets[i] + found.end()
                border[start:end], border[[start, end]] = False, True
        starts = np.flatnonzero(border)
        return starts, np.searchsorted(starts, offsets)

    def split(self, stretches: pa.Array) -> np.ndarray:
        """Where in the bytes of the stretches their words begin, as WORDS cuts them, and the end. No stretch is empty."""
        offsets, data = parts(stretches)
        if not len(data):
            return np.zeros(1, np.int64)
        at = np.flatnonzero(data & 0xC0 != 0x80)  # where each character begins
        letter, sizes = data[at].astype(np.int32), np.diff(at, append=len(data))
        for size in (2, 3, 4):
            long = np.flatnonzero(sizes == size)
            code = letter[long] & (0x7F >> size)
            for k in range(1, size):
                code = code << 6 | data[at[long] + k] & 0x3F
            letter[long] = code
        kind, space = self.kinds[letter], letter == 0x20
        first = np.zeros(len(at) + 3, bool)
        first[np.searchsorted(at, offsets[:-1])] = first[len(at) :] = True
        # a word begins where the kind changes, but a space goes with what follows it, and so the last of several blanks
        # parts from the others if something follows
        start = first.copy()
        start[1 : len(at)] |= (kind[1:] != kind[:-1]) & ~space[:-1]
        start[1 : len(at) - 1] |= (kind[1:-1] == BLANK) & (kind[:-2] == BLANK) & (kind[2:] != BLANK) & ~first[2 : len(at)]
        # the endings 's 't 'm 'd 're 've 'll
        quote = np.flatnonzero(start[: len(at)] & (letter == ord("'")))
        one, two = np.append(letter, [0, 0])[quote + 1], np.append(letter, [0, 0])[quote + 2]
        short = ~first[quote + 1] & np.isin(one, [*b"stmd"])
        long = (two == ord("e")) & np.isin(one, [*b"rv"]) | (one == ord("l")) & (two == ord("l"))
        long &= ~first[quote + 1] & ~first[quote + 2]
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = start[quote[long] + 3] = True
        return np.append(at[start[: len(at)]], len(data))

    def encode_stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All stretches' tokens one after the other, and how many each stretch has."""
        offsets, data = parts(stretches)
        starts = self.split(stretches)
        words = binaries(starts, data).dictionary_encode()
        which = words.indices.to_numpy()
        tokens, counts = self.encode_words(words.dictionary)
        counted = counts[which]
        tokens, counts = tokens[places(sums(counts)[which], counted)], np.diff(sums(counted)[np.searchsorted(starts, offsets)])
        added = np.flatnonzero(pc.is_in(stretches, pa.array(list(self.added_bytes), pa.large_binary())))
        ids = [self.added_bytes[t] for t in stretches.take(pa.array(added)).to_pylist()]
        return replaced(tokens, counts, added, np.array(ids, np.int64), np.ones(len(ids), np.int64))

    def encode(self, texts: list[str] | pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """By text: the number of tokens, the decimal ids joined by commas, and the bytes that these ids stand for."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts.validate(full=True)
        starts, bounds = self.cut(texts)
        stretches = binaries(starts, parts(texts)[1]).dictionary_encode()
        tokens, counts = self.encode_stretches(stretches.dictionary)
        views = []
        for spelled in (self.digits, self.raw):
            offsets, data = parts(spelled.take(pa.array(tokens)))
            offsets, data = parts(binaries(offsets[sums(counts)], data).take(stretches.indices))
            views += [offsets[bounds].tolist(), memoryview(data)]
        comma, ids, end, raw = views
        for i, n in enumerate(np.diff(sums(counts[stretches.indices])[bounds]).tolist()):
            yield n, ids[comma[i] : comma[i + 1] - (n > 0)], raw[end[i] : end[i + 1]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def codec_of(vocabulary: str) -> Codec:
    """The codec of this worker process; made once for tasks that follow one another in it."""
    kept = sys.modules.setdefault("_bpe_codecs", types.ModuleType("_bpe_codecs")).__dict__
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in kept:
        kept[key] = Codec(vocabulary)
    return kept[key]


def encode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    vocabulary: path of the tokenizer file on the driver; its text travels with the function. Returns id, n_tokens and
    ids (array<int>), decoded (string); with `digests` their SHA-256 in place of both: ids_sha256 over the decimal ids
    joined by commas, decoded_sha256 over the UTF-8 bytes. A null text counts as empty and has no tokens. Rows come
    back one by one, repeated rows too; other columns are left out. Strings of added tokens in a text become those
    tokens, as in the tokenizers library.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # the vocabulary file, 1.6 MB
    kind = docs.schema[id].dataType.simpleString()
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        codec = codec_of(spec.value)
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            counts, first, second = [], [], []
            for n, ids, raw in codec.encode(texts):
                counts.append(n)
                decoded = str(raw, "utf-8", "replace")
                if digests:
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(np.array(str(ids, "ascii").split(",") if n else [], np.int32))
                    second.append(decoded)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])],
                names=[id, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
            )

    return docs.selectExpr(f"`{id}` as id", f"`{text}` as text").mapInArrow(run, f"`{id}` {kind}, n_tokens bigint, {out}")
