"""Exact BPE encoding by backtracking over longest token matches, and decoding by an offset table.

Texts are cut into chunks at white space, and the chunks that a worker has not met yet are encoded together, a batch at a
time: one scan of an Aho-Corasick automaton over the vocabulary gives the leftmost longest tokens of all their words. They
stand if byte-pair merging would keep the border between every two neighbours (a memoised table of pairs, looked up for the
different pairs of the batch). In the words where it would not, the encoder goes on from the first such border: the longest
token at a place is kept if it fits its left neighbour, else the next shorter token is tried, and if none is left, the
encoder steps back one token. Each place fails once at most, so the work is linear in the word. All such words of a batch
take their steps side by side, as array operations.

Defined cases: null text is encoded as empty; the strings of special tokens inside a text are special tokens; very long
chunks are encoded whole but not remembered; rows keep their number, so repeated rows give repeated results; only the id and
text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cartolake.llm.common import bounded_batches, slices, texts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END = "</w>"
MARK = "\ue000"
#: In place of a token: there is none, or it has not been looked up.
NONE, UNKNOWN = -1, -2
PAIR_BITS = 20
#: Characters whose case, class and normal form have not changed between Unicode versions in use.
STABLE = regex.compile(r"[\x00-\u024f\u2010-\u2027\u20ac]*+\Z")
#: The word pattern of the vocabulary file, with Unicode white space written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Codes(dict):
    """Chunk to its ids as little-endian 32-bit bytes.

    Two generations: a full one becomes the old one, and what is asked for again moves back, so frequent chunks stay.
    """

    def __init__(self, most: int, longest: int = 48):
        super().__init__()
        self.most, self.longest, self.old = most, longest, {}

    def add(self, found: dict[str, bytes]) -> None:
        if len(self) + len(found) > self.most:
            self.old = dict(self)
            self.clear()
        self.update((c, code) for c, code in found.items() if len(c) <= self.longest)


class BacktrackingBpe:
    def __init__(self, path: str = WORD_BPE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = c
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), rank
        for token in vocab.values():
            self.rank.setdefault(token, -1)
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.tokens = {t[: -len(END)] + MARK if t.endswith(END) else t: i for t, i in vocab.items()}
        self.longest = max(map(len, self.tokens))
        self.machine = ahocorasick.Automaton()
        for key, i in self.tokens.items():
            self.machine.add_word(key, i)
        #: Stands for a mark that no token of the scan has taken; it fits no token.
        self.bare = max(self.names) + 1
        self.machine.add_word(MARK, self.bare)
        self.machine.make_automaton()
        #: Letters of each token, the mark included.
        self.size = np.zeros(self.bare + 1, np.int64)
        self.size[list(self.tokens.values())] = [len(key) for key in self.tokens]
        self.size[self.bare] = 1
        #: For each token the longest shorter token that begins it, NONE if there is none.
        self.shorter = np.full(self.bare + 1, NONE, np.int64)
        #: For each string that begins a token, the longest token that begins it.
        self.leads: dict[str, int] = {}
        for key, i in self.tokens.items():
            size = len(key) - 1
            while size and key[:size] not in self.tokens:
                size -= 1
            if size:
                self.shorter[i] = self.tokens[key[:size]]
            for end in range(len(key), 0, -1):
                if key[:end] in self.leads:
                    break
                while end < size:
                    size -= 1
                    while size and key[:size] not in self.tokens:
                        size -= 1
                best = i if end == len(key) else self.tokens.get(key[:size], NONE)
                self.leads[key[:end]] = best
        #: Code point of each byte's letter; a line feed ends a word.
        self.letters = np.array([ord(x) for x in byte_letters()], "<u4")
        self.letters[ord("\n")] = ord(MARK)
        #: Pairs whose compatibility is known, each in the one slot that its key has; a later pair takes the slot over.
        self.pair_key, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.chunks = Codes(400_000)
        self.letter_words = Codes(50_000)
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        names = [(self.names.get(i, "") + " ").encode() for i in range(max(self.names) + 1)]
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether byte-pair merging leaves a border between two neighbouring tokens.

        Both tokens are undone merge by merge, the later merge first; a merge across the border that comes before the one
        just undone would have been taken instead.
        """
        a, b, limit, answer = left, right, float("inf"), True
        while True:
            across = self.joined.get((a, b))
            if across is not None and self.rank[across] < limit:
                answer = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # On equal ranks merging goes from the left, so the right token's merge is the later one.
            if ra > rb:
                a, limit = self.parts[a][1], ra
            else:
                b, limit = self.parts[b][0], rb + 0.5
        return answer

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, by the table."""
        key = left << 20 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[slot]
        fresh = np.nonzero(self.pair_key[slot] != key)[0]
        if len(fresh):
            new, at = np.unique(key[fresh], return_inverse=True)
            fits = np.array([k & 0xFFFFF != self.bare and self.compatible(k >> 20, k & 0xFFFFF) for k in new.tolist()], bool)
            out[fresh] = fits[at]
            # Of new pairs with one slot, the last one named stays, key and answer together.
            taken = slot[fresh]
            self.pair_key[taken], self.pair_fits[taken] = key[fresh], out[fresh]
        return out

    def longest_at(self, letters: str, at: int) -> int:
        """The longest token at a place, NONE at a bare mark."""
        probe = letters[at : at + self.longest]
        return self.leads.get(probe[: self.machine.longest_prefix(probe)], NONE)

    def backtrack(self, letters: str, token: np.ndarray, before: np.ndarray, base: np.ndarray, end: np.ndarray, at: np.ndarray) -> None:
        """Goes on in each word (from base to end) from a place whose scanned token does not fit its left neighbour.

        token: by place, the token that the word's present path has there; before: by place, the start of the token to its
        left on that path. Both are changed. Places from which no token leads on are dead.
        """
        longest = np.where(token == self.bare, NONE, token)
        longest[token < 0] = UNKNOWN
        dead = np.zeros(len(letters) + 1, bool)
        try_ = longest[at]
        while len(at):
            stuck = try_ == NONE
            if stuck.any():
                if (at[stuck] == base[stuck]).any():
                    raise ValueError("no encoding")
                dead[at[stuck]] = True
                at[stuck] = before[at[stuck]]
                try_[stuck] = self.shorter[token[at[stuck]]]
            go = np.nonzero(try_ != NONE)[0]
            here, mine = at[go], try_[go]
            to = here + self.size[mine]
            fits = ~dead[to]
            inner = np.nonzero(fits & (here != base[go]))[0]
            fits[inner] = self.fit(token[before[here[inner]]], mine[inner])
            try_[go[~fits]] = self.shorter[mine[~fits]]
            on = go[fits]
            here, to = here[fits], to[fits]
            token[here] = mine[fits]
            before[to] = here
            at[on] = to
            live = np.ones(len(at), bool)
            live[on[to == end[on]]] = False
            on, to = on[live[on]], to[live[on]]
            new = np.unique(to[longest[to] == UNKNOWN])
            if len(new):
                longest[new] = [self.longest_at(letters, p) for p in new.tolist()]
            try_[on] = longest[to]
            if not live.all():
                at, try_, base, end = at[live], try_[live], base[live], end[live]

    def word_codes(self, letters: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in byte letters, laid end to end with a mark after each, and the number of ids up to each word's end."""
        found = np.fromiter(chain.from_iterable(self.machine.iter_long(letters)), np.int64).reshape(-1, 2)
        ids = found[:, 1]
        size = self.size[ids]
        stop = np.cumsum(size)
        if len(stop) and (int(stop[-1]) != len(letters) or (found[:, 0] + 1 != stop).any()):
            raise ValueError("letters without a token")
        closes = np.frombuffer(letters.encode("utf-32-le"), "<u4")[stop - 1] == ord(MARK)
        ends = np.nonzero(closes)[0] + 1
        inner = np.nonzero(~closes)[0]
        apart = inner[~self.fit(ids[inner], ids[inner + 1])]
        if not len(apart):
            return ids, ends
        words, first = np.unique(np.searchsorted(ends, apart, side="right"), return_index=True)
        start = stop - size
        token, before = np.full(len(letters) + 1, -1, np.int64), np.zeros(len(letters) + 1, np.int64)
        token[start] = ids
        before[start[1:]] = start[:-1]
        ahead = np.concatenate([[0], ends[:-1]])
        base, end = start[ahead[words]], stop[ends[words] - 1]
        self.backtrack(letters, token, before, base, end, start[apart[first] + 1].copy())
        # Places on the words' new paths, found by walking all of them side by side.
        path = np.zeros(len(letters) + 1, bool)
        path[start] = True
        for_word = np.zeros(len(ends), bool)
        for_word[words] = True
        path[start[np.repeat(for_word, np.diff(ends, prepend=0))]] = False
        while len(base):
            path[base] = True
            base = base + self.size[token[base]]
            on = base < end
            base, end = base[on], end[on]
        places = np.nonzero(path)[0]
        return token[places], np.searchsorted(places, stop[ends - 1])

    def learn(self, missing: set[str], table: Codes, in_letters: bool = False) -> dict[str, bytes]:
        """Codes of chunks that the table lacks, which it keeps unless they are very long."""
        found = {c: table.old.get(c) for c in missing}
        fresh = [c for c, code in found.items() if code is None]
        if fresh:
            if in_letters:
                words, letters = fresh, MARK.join(fresh) + MARK
            else:
                words = WORDS.findall("\n".join(fresh))
                letters = self.letters[np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids, ends = self.word_codes(letters)
            # Words leave no letter of a chunk out, so lengths tell which words a chunk is made of.
            upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            of = ends[np.searchsorted(upto, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh))))]
            raw, a = ids.astype("<u4").tobytes(), 0
            for c, b in zip(fresh, (4 * of).tolist(), strict=True):
                found[c] = raw[a:b]
                a = b
        table.add(found)
        return found

    def looked_up(self, chunks: list[list[str]], table: Codes, in_letters: bool = False) -> list[bytes]:
        """Codes of texts given as lists of chunks."""
        flat = list(chain.from_iterable(chunks))
        codes = list(map(table.get, flat))
        gaps = [n for n, code in enumerate(codes) if code is None]
        if gaps:
            found = self.learn({flat[n] for n in gaps}, table, in_letters)
            for n in gaps:
                codes[n] = found[flat[n]]
        each = iter(codes)
        return [b"".join(islice(each, len(part))) for part in chunks]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        chunks, odd = [], {}
        for n, text in enumerate(texts):
            if text.isascii():
                text = text.lower()
            elif STABLE.match(text):
                text = unicodedata.normalize("NFC", text).lower()
            else:
                odd[n] = [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(self.tool.normalizer.normalize_str(text))]
                text = ""
            # Some separators are white space for str.split(), but not for the vocabulary.
            chunks.append(WORDS.findall(text) if SEPARATORS.search(text) else text.split())
        out = self.looked_up(chunks, self.chunks)
        for n, code in zip(odd, self.looked_up(list(odd.values()), self.letter_words, True), strict=True):
            out[n] = code
        return out

    def encode_all(self, texts: list[str], most: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; about `most` characters are worked on at once."""
        for a, b in slices(np.array([len(t) for t in texts], np.int64), most):
            parts, counts = [], []
            for text in texts[a:b]:
                of_text = self.split.split(text) if "<|" in text else [text]
                parts += of_text
                counts.append(len(of_text))
            codes = iter(self.encode_plain(["" if p in self.special else p for p in parts]))
            names = iter(parts)
            for n in counts:
                yield b"".join(code or (self.special[p].to_bytes(4, "little") if p in self.special else b"") for p, code in islice(zip(names, codes), n))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode_parts(self, code: bytes, most: int = 1 << 18) -> Iterator[bytes]:
        """UTF-8 of the decoded text in parts: token strings joined by a space, copied through the offset table."""
        ids = np.frombuffer(code, "<u4").astype(np.int64)
        for a in range(0, len(ids), most):
            part = ids[a : a + most]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            at = np.cumsum(size) - size
            out = self.blob[np.repeat(start - at, size) + np.arange(int(size.sum()))].tobytes()
            yield out[:-1] if a + most >= len(ids) else out


_LOADED: dict[str, BacktrackingBpe] = {}


def coder(path: str = WORD_BPE) -> BacktrackingBpe:
    """One coder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (little-endian unsigned 32-bit, binary)."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(bpe.encode_all(texts(batch.column(1)))), pa.binary())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, digest of the ids, digest of the decoded text."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            counts, codes, decoded = [], [], []
            for code in bpe.encode_all(texts(batch.column(1))):
                back = hashlib.sha256()
                for part in bpe.decode_parts(code):
                    back.update(part)
                counts.append(len(code) // 4)
                codes.append(hashlib.sha256(code).hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
