"""Byte-pair encoding by speculation, and decoding.

Distinct words are encoded once per worker. Greedy longest match proposes tokens for a word; the
proposal is the exact encoding if every token is the encoding of its own string and every adjacent
pair is compatible, that is, no merge ever crosses the border between the two. Both tests walk the
border's two merge chains and run over arrays of all proposed pairs; only words with a failing
pair are merged exactly.

A tokenizer file in the `tokenizers` format is read: normalisation to NFC and lower case, words
cut by letters, single digits and other signs, byte symbols, an end-of-word suffix, no decoder, so
decoding joins token strings with blanks. Its special tokens are cut out of the raw text.

A null or empty text has no tokens and decodes to an empty text. Repeated rows are encoded one by
one; other columns are not read.
"""

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, documents, map_texts

TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 400_000
#: Words up to so many symbols are merged over a plain list of ranks, longer ones over a heap.
SHORT = 64
#: White space as Unicode has it (the regex module's own class also takes U+001C to U+001F).
_SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Text outside these long-settled blocks is cut by the tokenizer's own normaliser and splitter.
_SETTLED = ((0x00, 0x52F), (0x1E00, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x23FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_RARE = regex.compile("[^" + "".join(rf"\x{a:02x}-\u{b:04x}" if a < 256 else rf"\u{a:04x}-\u{b:04x}" for a, b in _SETTLED) + "]")
_NEVER = np.iinfo(np.int64).max


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(0x100 + k)
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file's tokens and merges, with the merge chains at each token's two borders."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.path, self.ids, self.suffix = path, model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = _byte_symbols()
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings: list = [None] * size
        for text, k in {**self.ids, **self.special}.items():
            self.strings[k] = text
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        parts = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.ranks = {(a, b): k for k, (a, b, _) in enumerate(parts.tolist())}
        self.merged = parts[:, 2].tolist()
        self._borders(parts, size)
        self._trie()
        self._merged = parts[:, 2]
        self._named = np.array([text is not None for text in self.strings])
        self._texts = pa.array(self.strings, pa.string())
        self.known = {text: np.array([k], "<u4").tobytes() for text, k in self.special.items()}
        self.library = None

    def _borders(self, parts, size):
        self.size, count = size, len(parts)
        keys = parts[:, 0] * size + parts[:, 1]
        order = np.argsort(keys)
        self._keys, self._key_ranks = keys[order], order
        rank, left, right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        rank[parts[:, 2]], left[parts[:, 2]], right[parts[:, 2]] = np.arange(count), parts[:, 0], parts[:, 1]
        chains = []
        for side in (right, left):
            levels, at = [np.arange(size)], np.arange(size)
            while (side[at] >= 0).any():
                at = np.where(side[at] >= 0, side[at], at)
                levels.append(at)
            # bottom first; shorter chains are padded at the top with the token itself
            chain = np.stack(levels[::-1], axis=1)
            steps = (chain[:, 1:] != chain[:, :-1]).sum(axis=1)
            pushed = np.minimum(np.arange(chain.shape[1])[None, :] + (chain.shape[1] - 1 - steps)[:, None], chain.shape[1] - 1)
            chains.append((np.take_along_axis(chain, pushed, axis=1), steps))
        (self._right, self._right_steps), (self._left, self._left_steps) = chains
        self._rank = rank
        made = np.bincount(parts[:, 2], minlength=size)
        merged = rank >= 0
        sound = np.ones(size, bool)
        sound[merged] = (made[merged] == 1) & (rank[left[merged]] < rank[merged]) & (rank[right[merged]] < rank[merged])
        tokens = np.flatnonzero(merged)
        sound[tokens] &= self._compatible(left[tokens], right[tokens], within=rank[tokens])
        for k in tokens[np.argsort(rank[tokens])].tolist():
            sound[k] = sound[k] and sound[left[k]] and sound[right[k]]
        self.sound = sound

    def _pair_ranks(self, a, b):
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._key_ranks[at], _NEVER)

    def _compatible(self, a, b, within=None):
        """Whether no merge crosses the border between tokens a and b, in time order of their merges.

        The border's neighbours are followed from single symbols to whole tokens. A neighbour lives
        until the merge that takes it up; a merge across the border comes if its rank is lower than
        the left one's end and not higher than the right one's. `within`: only crossings of lower rank.
        """
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        good, rows = np.ones(len(a), bool), np.arange(len(a))
        while len(rows):
            p, q = a[rows], b[rows]
            x, y = self._right[p, i[rows]], self._left[q, j[rows]]
            more_left, more_right = i[rows] < self._right_steps[p], j[rows] < self._left_steps[q]
            end_x = np.where(more_left, self._rank[self._right[p, np.minimum(i[rows] + 1, self._right.shape[1] - 1)]], _NEVER)
            end_y = np.where(more_right, self._rank[self._left[q, np.minimum(j[rows] + 1, self._left.shape[1] - 1)]], _NEVER)
            crossing = self._pair_ranks(x, y)
            met = (crossing < end_x) & (crossing <= end_y) & (crossing < _NEVER)
            if within is not None:
                met &= crossing < within[rows]
            good[rows[met]] = False
            step_left = more_left & (end_x <= end_y)
            i[rows[step_left]] += 1
            step_right = more_right & ~step_left
            j[rows[step_right]] += 1
            rows = rows[~met & (more_left | more_right)]
        return good

    def _trie(self):
        """The tokens' strings as one automaton over bytes: sorted (state, byte) keys, and each state's tokens."""
        back = {c: b for b, c in enumerate(self.symbols)}
        steps: dict = {}
        inner, final = [-1], [-1]  # the token that ends at a state, within a word and at its end
        for text, token in self.ids.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            state = 0
            if not body or any(c not in back for c in body):
                continue
            for c in body:
                key = state << 8 | back[c]
                state = steps.setdefault(key, len(inner))
                if state == len(inner):
                    inner.append(-1)
                    final.append(-1)
            (final if ends or not self.suffix else inner)[state] = token
            if not self.suffix:
                inner[state] = token
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self._steps, self._states = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self._inner, self._final = np.array(inner), np.array(final)
        single = np.full((2, 256), -1)
        for b, c in enumerate(self.symbols):
            single[0, b], single[1, b] = self.ids.get(c, -1), self.ids.get(c + self.suffix, -1)
        self._single = single

    def _propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Longest matches from the left, of all words at once: tokens, their words, and which words came through."""
        at, rows, good, rounds = starts.copy(), np.arange(len(starts)), np.ones(len(starts), bool), []
        while len(rows):
            best, length = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
            live, state, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
            while len(live):
                place = at[rows[live]] + depth
                keys = state << 8 | data[place]
                found = np.minimum(np.searchsorted(self._steps, keys), len(self._steps) - 1)
                went = self._steps[found] == keys
                live, place, state = live[went], place[went], self._states[found[went]]
                depth += 1
                last = place + 1 == ends[rows[live]]
                token = np.where(last, self._final[state], self._inner[state])
                hit = token >= 0
                best[live[hit]], length[live[hit]] = token[hit], depth
                live, state = live[~last], state[~last]
            through = best >= 0
            good[rows[~through]] = False
            rows, best, length = rows[through], best[through], length[through]
            rounds.append((rows, best))
            at[rows] += length
            rows = rows[at[rows] < ends[rows]]
        owner = np.concatenate([r for r, _ in rounds]) if rounds else np.zeros(0, np.int64)
        tokens = np.concatenate([t for _, t in rounds]) if rounds else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order], good

    def _merge_rows(self, tokens: np.ndarray) -> np.ndarray:
        """Exact merging of many words at once: each row's pair of lowest rank, leftmost first, until none is left.

        `tokens` has a word per row, padded with -1 on the right; so has the result.
        """
        n, width = tokens.shape
        ranks = np.full((n, width), _NEVER)
        pairs = tokens[:, 1:] >= 0
        ranks[:, :-1][pairs] = self._pair_ranks(tokens[:, :-1][pairs], tokens[:, 1:][pairs])
        out, rows, places = tokens.copy(), np.arange(n), np.arange(width)
        while len(rows):
            k = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), k]
            more = rank < _NEVER
            out[rows[~more]] = tokens[~more]
            rows, tokens, ranks, k, rank = rows[more], tokens[more], ranks[more], k[more], rank[more]
            if not len(rows):
                break
            line = np.arange(len(rows))
            tokens[line, k] = self._merged[rank]
            # the token behind and the merged pair give way to what follows
            moved = np.minimum(places + (places > k[:, None]), width - 1)
            tokens = np.take_along_axis(tokens, moved, axis=1)
            tokens[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= k[:, None]), width - 1), axis=1)
            ranks[:, -1] = _NEVER
            new = tokens[line, k]
            behind = tokens[line, np.minimum(k + 1, width - 1)]
            has = (k + 1 < width) & (behind >= 0)
            ranks[line, k] = np.where(has, self._pair_ranks(new, np.maximum(behind, 0)), _NEVER)
            first = k > 0
            ranks[line[first], k[first] - 1] = self._pair_ranks(tokens[line[first], k[first] - 1], new[first])
        return out

    def _merge(self, word: str) -> list[int]:
        """Exact merging: always the pair of lowest rank, leftmost first. A heap holds rank and place of each pair."""
        ids, ranks, merged = self.ids, self.ranks, self.merged
        tokens = [k for t in (*word[:-1], word[-1] + self.suffix) if (k := ids.get(t)) is not None]
        n = len(tokens)
        if n <= SHORT:
            line = [ranks.get(pair, _NEVER) for pair in zip(tokens, tokens[1:])]
            while line and (rank := min(line)) < _NEVER:
                k = line.index(rank)
                tokens[k : k + 2] = [merged[rank]]
                del line[k]
                if k:
                    line[k - 1] = ranks.get((tokens[k - 1], tokens[k]), _NEVER)
                if k < len(line):
                    line[k] = ranks.get((tokens[k], tokens[k + 1]), _NEVER)
            return tokens
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for k in range(n - 1):
            rank = ranks.get((tokens[k], tokens[k + 1]))
            if rank is not None:
                heap.append(rank << 32 | k)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, k = entry >> 32, entry & 0xFFFFFFFF
            gone = after[k]
            if tokens[k] < 0 or gone >= n or ranks.get((tokens[k], tokens[gone])) != rank:
                continue
            tokens[k], tokens[gone], after[k] = merged[rank], -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (rank := ranks.get((tokens[k], tokens[after[k]]))) is not None:
                    heapq.heappush(heap, rank << 32 | k)
            left = before[k]
            if left >= 0 and (rank := ranks.get((tokens[left], tokens[k]))) is not None:
                heapq.heappush(heap, rank << 32 | left)
        return [t for t in tokens if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words not known yet."""
        new = list(words - self.known.keys())
        if not new:
            return
        coded = [w.encode("utf-8", "replace") for w in new]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        flat, owner, good = self._propose(data, starts, ends)
        good &= sizes > 0
        good[owner[~self.sound[flat]]] = False
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        inside = inside[good[owner[inside]]]
        crossed = ~self._compatible(flat[inside], flat[inside + 1])
        good[owner[inside[crossed]]] = False
        self.speculated, self.failed = len(new), int((~good).sum())
        counts = np.bincount(owner, minlength=len(new))
        raw, at = flat.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts) * 4]).tolist()
        known = self.known
        for k in np.flatnonzero(good).tolist():
            known[new[k]] = raw[at[k] : at[k + 1]]
        self._learn_exactly(new, data, starts, sizes, np.flatnonzero(~good))

    def _learn_exactly(self, new, data, starts, sizes, failed) -> None:
        """Merge the failed words: those of like length together, long ones and odd symbols one by one."""
        symbols, single = self.symbols, self._single
        odd = (single < 0).any(axis=0)
        longest = sizes[failed]
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 32), (32, SHORT)):
            mine = failed[(longest > low) & (longest <= high)]
            if not len(mine):
                continue
            places = np.arange(high)
            held = places < sizes[mine][:, None]
            letters = data[np.minimum(starts[mine][:, None] + places, len(data) - 1)]
            tokens = np.where(held, single[(places == sizes[mine][:, None] - 1).astype(np.int64), letters], -1)
            plain = ~(odd[letters] & held).any(axis=1)
            merged = self._merge_rows(tokens[plain])
            for k, line, n in zip(mine[plain].tolist(), merged.astype("<u4"), (merged >= 0).sum(axis=1).tolist()):
                self.known[new[k]] = line[:n].tobytes()
        for k in failed.tolist():
            if new[k] not in self.known:
                word = "".join([symbols[b] for b in new[k].encode("utf-8", "replace")])
                self.known[new[k]] = np.array(self._merge(word), "<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        if _RARE.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            back = {c: b for b, c in enumerate(self.symbols)}
            return [bytes(back[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _WORD.findall(text.lower())

    def words(self, text: str) -> list[str]:
        """A text's words in order, special tokens among them."""
        if self.splitter is None or "<" not in text:
            return self._cut(text)
        found = []
        for part in self.splitter.split(text):
            found += [part] if part in self.special else self._cut(part)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {text: self.known[text] for text in self.special}
        self.learn(set().union(*cut))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of many id sequences that lie one behind the other, by where each ends; unknown ids have no text."""
        held = ids < len(self.strings)
        held[held] = self._named[ids[held]]
        kept = np.concatenate([[0], np.cumsum(held)])
        offsets = kept[np.concatenate([[0], ends])].astype(np.int64)
        parts = self._texts.take(pa.array(ids[held].astype(np.int64)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), parts), " ").cast(pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(np.asarray(ids), np.array([len(ids)]))[0].as_py()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, keep=("doc_id",), column="text", path: str | None = None) -> DataFrame:
    """Columns `keep`, n_tokens, and `ids` as little-endian unsigned 32-bit integers."""
    path = path or tokenizer_path()

    def run(data, offsets):
        raw = data.tobytes()
        ids = vocabulary(path).encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])])
        return [np.array([len(i) // 4 for i in ids], np.int64), pa.array(ids, pa.binary())]

    return map_texts(docs, run, "n_tokens bigint, ids binary", keep, column)


def decode(encoded: DataFrame, keep=("doc_id", "n_tokens", "ids"), path: str | None = None) -> DataFrame:
    """Columns `keep` beside `decoded`, the text of the ids."""
    path = path or tokenizer_path()
    bound_batches(encoded.sparkSession)
    kept = ", ".join(f"`{name}` {kind}" for name, kind in encoded.select(*keep).dtypes)

    def run(batches):
        known = vocabulary(path)
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("ids")).fill_null(b"")
            ends = np.cumsum(pc.binary_length(held).to_numpy()) // 4
            texts = known.decode_all(np.frombuffer(b"".join(held.to_pylist()), "<u4"), ends)
            rows = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            yield pa.RecordBatch.from_arrays([*rows, texts], [*keep, "decoded"])

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, f"{kept}, decoded string")


def digests(docs: DataFrame, keep=("doc_id",), path: str | None = None) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded text."""
    decoded = decode(encode(docs, keep, path=path), (*keep, "n_tokens", "ids"), path)
    return decoded.select(
        *keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_bpe(spark, sf_dir) -> DataFrame:
    return digests(documents(spark, sf_dir))
