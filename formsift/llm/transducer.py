"""Byte-pair encoding and decoding as streaming transducers.

Encoding goes through a text once. The tokens of every prefix are known by its last token: the one
that ends there and may follow the last token of the prefix before it. How far a later byte can
still change earlier tokens follows from the merge list; tokens further back than this lookahead
are written out, and the rest is kept. Decoding turns token bytes into characters as soon as these
are whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

#: Memos hold this many entries at most; longer words are not remembered.
MOST_WORDS, MOST_PAIRS, LONGEST_WORD = 300_000, 600_000, 64
#: Bytes a word's encoder works on at once, beyond the lookahead; characters of text handled at once.
BLOCK, WINDOW = 4096, 1 << 20
#: Fixed pattern of this kind of vocabulary: contractions, letters, numbers, other marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a single space between two other characters a word always ends.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes: themselves, or the next free letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def newer_characters() -> list[str]:
    """Letters and numbers of the pattern's Unicode version that the tokenizers library does not know yet."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    everything = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
    kinds = [(regex.compile(r"\p{L}"), "a"), (regex.compile(r"\p{N}"), "1")]
    return [c for kind, other in kinds for c in kind.findall(everything)
            if unicodedata.category(c) == "Cn" and len(split(other + c)) > 1]


def ranges(characters: list[str]) -> str:
    """Characters as ranges of a pattern's class."""
    codes = np.unique(np.array([ord(c) for c in characters]))
    first = np.append(True, np.diff(codes) > 1)
    ends = zip(codes[first].tolist(), codes[np.append(first[1:], True)].tolist())
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends)


class WordEncoder:
    """Tokens of single words under an ordered list of merges, as pieces of bytes."""

    def __init__(self, merges: Iterable[tuple[bytes, bytes]]):
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(merges)))}
        self.lookahead = self.sufficient_lookahead(sorted(self.ranks, key=self.ranks.get))
        self.tokens = {a + b for a, b in self.ranks} | {bytes([b]) for b in range(256)}
        self.ends = {t[n:]: False for t in self.tokens for n in range(1, len(t))}
        self.ends |= dict.fromkeys(self.tokens, True)
        self.follows: dict[bytes, dict[bytes, bool]] = {}
        self.pairs = 0

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes after a token that settle it.

        A later byte first changes what a merge ``(u, v)`` does whose ``v`` reaches it: ``u``, the
        token before, is merged or left. Each change moves the earliest token that differs back
        by ``u``, and a later merge in the list can go on only if its own right part begins with
        that ``u``. So the reach is the largest sum of left parts along such a chain of merges.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for u, v in merges:
            far = len(u) + max(reach.get(v[:k], 0) for k in range(1, len(v) + 1))
            if far > reach.get(u, 0):
                reach[u] = far
            most = max(most, far)
        return most

    def merged(self, data: bytes) -> list[bytes]:
        """The definition, for short strings: the first merge of the list that applies, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(p, len(self.ranks)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.ranks):
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: bytes, token: bytes) -> bool:
        """Whether ``token`` can come after ``last`` (empty: at the start of a word)."""
        known = self.follows.setdefault(last, {})
        fits = known.get(token)
        if fits is None:
            fits = known[token] = self.merged(last + token) == ([last, token] if last else [token])
            self.pairs += 1
        return fits

    def last_tokens(self, data: bytes, last: list[bytes | None], done: int) -> None:
        """Go on from prefix ``done``: ``last[n]`` becomes the last token of ``data[:n]``.

        None where no token ends: close behind tokens written out before, a prefix can have a
        token that goes across them; longer prefixes have not.
        """
        ends, follows = self.ends, self.follows
        for end in range(done + 1, len(data) + 1):
            found = None
            for start in range(end - 1, -1, -1):
                token = data[start:end]
                whole = ends.get(token)
                if whole is None:
                    break
                before = last[start]
                if whole and before is not None:
                    known = follows.get(before)
                    fits = known.get(token) if known else None
                    if fits is None:
                        fits = self.may_follow(before, token)
                    if fits:
                        found = token
                        break
            last.append(found)

    @staticmethod
    def path(last: list[bytes]) -> list[bytes]:
        """The tokens of the whole prefix, from its last token back."""
        at, out = len(last) - 1, []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def forget(self) -> None:
        if self.pairs > MOST_PAIRS:
            self.follows, self.pairs = {}, 0

    def stream(self, parts: Iterable[bytes], block: int = BLOCK) -> Iterator[bytes]:
        """Tokens of one word that comes in parts; keeps the lookahead and one block."""
        held, context = b"", b""
        for part in parts:
            held += part
            while len(held) >= self.lookahead + block:
                now, last = held[:self.lookahead + block], [context]
                self.last_tokens(now, last, 0)
                used = 0
                for token in self.path(last):
                    if used + len(token) > block:
                        break
                    used += len(token)
                    context = token
                    yield token
                if not used:  # a token longer than the block
                    block *= 2
                held = held[used:]
                self.forget()
        last = [context]
        self.last_tokens(held, last, 0)
        yield from self.path(last)
        self.forget()

    def several(self, words: list[bytes]) -> dict[bytes, list[bytes]]:
        """Tokens of some sorted words; each goes on where it parts from the one before."""
        out, before, last = {}, b"", [b""]
        for word in words:
            done, most = 0, min(len(word), len(before))
            while done < most and word[done] == before[done]:
                done += 1
            del last[done + 1:]
            self.last_tokens(word, last, done)
            out[word] = self.path(last)
            before = word
        self.forget()
        return out


class TextDecoder:
    """Characters from token bytes; keeps the bytes of a character that is not whole yet."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.held = pieces, b""

    @staticmethod
    def whole(data: bytes) -> int:
        """How many of the bytes end with a whole character, or cannot become one."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            length = 4 if byte >> 3 == 0x1E else 3 if byte >> 4 == 0xE else 2 if byte >> 5 == 6 else 1
            return len(data) - back if length > back else len(data)
        return len(data)

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.pieces.__getitem__, ids))
        cut = self.whole(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Tokenizer:
    """A byte-level byte-pair vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or odd:
            raise ValueError("not a plain byte-level vocabulary")
        letters = byte_letters()
        bytes_of = lambda text: bytes([letters[c] for c in text])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordEncoder([(bytes_of(a), bytes_of(b)) for a, b in pairs])
        number = {bytes_of(t): i for t, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.pieces = [b""] * (1 + max([*number.values(), *added.values()]))
        for piece, i in [*number.items(), *((t.encode(), i) for t, i in added.items())]:
            self.pieces[i] = piece
        self.codes = {piece: np.array([i], "<u4").tobytes() for piece, i in number.items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        longest_first = sorted(map(regex.escape, added), key=len, reverse=True)
        self.special = regex.compile("|".join(longest_first)) if added else None
        self.pattern = regex.compile(PATTERN)
        newer = newer_characters()
        outside = f"--[{ranges(newer)}]" if newer else ""
        letters, numbers = (f"[\\p{{{c}}}{outside}]" for c in "LN")
        other = f"[^\\s{letters}{numbers}]"
        careful = PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r" ?\p{L}+", f" ?{letters}+").replace(r" ?\p{N}+", f" ?{numbers}+")
        self.careful = regex.compile("(?V1)" + careful)
        self.maybe_newer = re.compile(f"[{min(newer)}-\U0010ffff]" if newer else r"(?!)")
        self.memo: dict[str, bytes] = {}

    def split(self, text: str) -> Iterator[list[str] | str]:
        """Words between added tokens, a window at a time, and the added tokens between them."""
        at = 0
        for found in (self.special.finditer(text) if self.special else ()):
            yield from self.windows(text, at, found.start())
            yield found.group()
            at = found.end()
        yield from self.windows(text, at, len(text))

    def windows(self, text: str, at: int, end: int) -> Iterator[list[str]]:
        while end - at > WINDOW and (cut := SAFE_CUT.search(text, at + WINDOW, end)):
            yield self.words_in(text[at:cut.start()])
            at = cut.start()
        if at < end:
            yield self.words_in(text[at:end])

    def words_in(self, text: str) -> list[str]:
        careful = not text.isascii() and self.maybe_newer.search(text)
        return (self.careful if careful else self.pattern).findall(text)

    def parts(self, word: str) -> Iterator[bytes]:
        for at in range(0, len(word), BLOCK):
            yield word[at:at + BLOCK].encode()

    def learn(self, words: set[str]) -> None:
        """Remember the identifiers of some words, however many; long words are left out."""
        if len(self.memo) > MOST_WORDS:
            self.memo.clear()
        new = sorted(w.encode() for w in words - self.memo.keys() if len(w) <= LONGEST_WORD)
        codes = self.codes
        self.memo.update((w.decode(), b"".join([codes[t] for t in tokens])) for w, tokens in self.words.several(new).items())

    def codes_of(self, words: list[str] | str) -> Iterator[bytes]:
        """Identifiers in order, as little-endian unsigned 32-bit integers."""
        if isinstance(words, str):
            yield self.added[words]
            return
        try:
            yield b"".join(map(self.memo.__getitem__, words))
            return
        except KeyError:
            self.learn(set(words))
        run: list[bytes] = []
        for word in words:
            known = self.memo.get(word)
            if known is not None:
                run.append(known)
                continue
            for token in self.words.stream(self.parts(word)):
                run.append(self.codes[token])
                if len(run) >= BLOCK:
                    yield b"".join(run)
                    run = []
        yield b"".join(run)

    def encode(self, text: str) -> Iterator[bytes]:
        for words in self.split(text):
            yield from self.codes_of(words)

    def encode_several(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Texts whose new words are learned together; long texts one by one."""
        group: list[list[list[str] | str]] = []
        chars = 0

        def learned() -> Iterator[Iterator[bytes]]:
            self.learn({w for text in group for words in text if not isinstance(words, str) for w in words})
            for text in group:
                yield (ids for words in text for ids in self.codes_of(words))

        for text in texts:
            if len(text) >= WINDOW or chars >= WINDOW:
                yield from learned()
                group, chars = [], 0
            if len(text) >= WINDOW:
                yield self.encode(text)
            else:
                group.append(list(self.split(text)))
                chars += len(text)
        yield from learned()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Every text encoded, and its identifiers decoded again: token count and digests of both.

    ``keep`` adds the identifiers (``ids``, little-endian unsigned 32-bit) and the ``decoded``
    text. Strings of added tokens inside a text are those tokens. Null text counts as empty: no
    tokens, the digests of nothing. Texts of any length go through in windows. Repeated rows and null
    identifiers are kept as they are; columns other than ``doc_id`` and ``text`` are not looked
    at; an empty table gives an empty one. The path must exist on every executor.
    """
    schema = ROUND_TRIP + ", ids binary, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(path)
        for batch in batches:
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), codec.encode_several(texts)):
                ids_hash, text_hash, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                decoder = TextDecoder(codec.pieces)
                for ids in encoded:
                    ids_hash.update(ids)
                    count += len(ids) // 4
                    decoded = decoder.feed(np.frombuffer(ids, "<u4").tolist())
                    text_hash.update(decoded.encode())
                    if keep:
                        kept.append((ids, decoded))
                decoded = decoder.end()
                text_hash.update(decoded.encode())
                row = [doc_id, count, ids_hash.hexdigest(), text_hash.hexdigest()]
                rows.append(row + [b"".join(i for i, _ in kept), "".join(t for _, t in kept) + decoded] * keep)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][:len(names)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
