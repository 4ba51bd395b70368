"""Periodic runs, the byte-level transducer and collocations against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formsift.llm import catalog, collocations, periodic_runs, transducer
from tests.conftest import SF_DIR
from tests.llm.test_operators import SPLIT, odd_rows, table_of

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# Periodic runs

def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, q, n) for (s, n), q in out.items())


def brute_report(doc_id, text):
    words = SPLIT.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def solved(words, tile_words):
    """The solver's fragments, stitched by hand."""
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    tiles = [dict(ids=ids[a:b], low=low, high=high, start=a, size=b - a, n=len(ids)) for low, high, a, b in periodic_runs.tile_plan(len(ids), tile_words)]
    out = {}
    if tiles:
        found = periodic_runs.solve(tiles)
        reached = {}
        for q, low, high in sorted(zip(found["period"], found["low"], found["high"])):
            if q in reached and low <= reached[q][-1][1]:
                reached[q][-1][1] = max(high, reached[q][-1][1])
            else:
                reached.setdefault(q, []).append([low, high])
        for q, stretches in sorted(reached.items()):
            for low, high in stretches:
                if high - low >= max(3 * q, 6 - q):
                    out.setdefault((low, high - low + q), q)
    return sorted((s, q, n) for (s, n), q in out.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 11)), max_size=12),
       st.sampled_from([16, 50, 1 << 14]))
def test_tiles_of_any_size_find_the_same_runs(blocks, tile_words):
    words = [w for unit, times, cut in blocks for w in (unit * times)[:len(unit) * times - cut]]
    assert solved(words, tile_words) == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_z_function(text):
    same = lambda i: next((k for k in range(len(text) - i) if text[k] != text[i + k]), len(text) - i)
    assert periodic_runs.z_function(text) == [same(i) for i in range(len(text))]


def repeating_rows():
    rng = random.Random(11)
    rows = [(100 + i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(300))), "s") for i in range(40)]
    rows += [(200 + i, "  ".join((["x", "y", str(i)] * 40)[:rng.randrange(120)]) + "\tend", "s") for i in range(10)]
    rows += [(300, "same " * 3000, "s"), (300, "same " * 10, "s"), (300, "same " * 10, "s"), (301, "a b\x0bc\x1fd" * 9, None)]
    return odd_rows() + rows


@pytest.mark.parametrize("tile_words", [40, 1 << 14])
def test_runs_as_by_brute_force(spark, tile_words):
    rows = [r for r in repeating_rows() if tile_words > 40 or r[0] != 4]
    docs = table_of(spark, rows).withColumns({"start": F.lit("clash"), "period": F.lit("clash"), "digest": F.lit(1)})
    got = [tuple(r) for r in periodic_runs.periodic_runs(docs, tile_words).collect()]
    assert sorted(got, key=repr) == sorted((brute_report(d, t) for d, t, _ in rows), key=repr)
    kept = periodic_runs.periodic_runs(docs, tile_words, keep_text=True).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.collapsed_sha256 for r in kept)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_registered_runs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = [tuple(r) for r in catalog.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(brute_report(r.doc_id, r.text) for r in rows)


# Byte-level encoding

MERGES = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=25)


@settings(max_examples=300, deadline=None)
@given(MERGES, st.lists(st.sampled_from(b"abc"), max_size=90).map(bytes), st.integers(1, 5))
def test_streams_equal_the_definition(choices, word, block):
    """Any merge list that builds tokens out of earlier ones; the lookahead lets nothing go too early."""
    tokens, merges = [b"a", b"b", b"c"], []
    for a, b in choices:
        pair = tokens[a % len(tokens)], tokens[b % len(tokens)]
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    coder = transducer.WordEncoder(merges)
    want = coder.merged(word)
    assert coder.several([word])[word] == want
    assert list(coder.stream((word[i:i + 2] for i in range(0, len(word), 2)), block)) == want


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=20))
def test_decoder_gives_characters_as_soon_as_they_are_whole(data, sizes):
    decoder, out, at = transducer.TextDecoder([bytes([b]) for b in range(256)]), [], 0
    for n in [*sizes, len(data)]:
        out.append(decoder.feed(data[at:at + n]))
        at += n
        assert len(decoder.held) < 4
    assert "".join(out) + decoder.end() == data.decode("utf-8", "replace")


ALPHABET = [*"abc 'sXY1²½٣ \n\t\r\x0b\x1c\x85\xa0éß日本한Ǆ😀👩‍́ ", "\U0001d7d8", "՘", "࢏", "\U000323b0", "<|endoftext|>", "'ll", " the", "   "]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)))
def test_ids_equal_the_library(text):
    codec, library = transducer.tokenizer(BYTES), Tokenizer.from_file(BYTES)
    ids = np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    decoder = transducer.TextDecoder(codec.pieces)
    assert decoder.feed(ids) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def library_round_trip(rows):
    library, out = Tokenizer.from_file(BYTES), []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trips_of_odd_rows(spark, monkeypatch):
    rows = odd_rows() + [(50, "a<|endoftext|><|endoftext|> b <|endoftext", None), (51, "x" * 5000 + " " * 3000 + "y", "a"), (52, "ab" * 9000, "b")]
    docs = table_of(spark, rows).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit("clash")})
    got = transducer.round_trips(docs, BYTES, keep=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == library_round_trip([(d, t) for d, t, _ in rows])
    assert Counter(r.decoded for r in got) == Counter(t or "" for _, t, _ in rows)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)
    assert transducer.round_trips(docs.limit(0), BYTES).count() == 0


def test_windows_and_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(transducer, "WINDOW", 50)
    monkeypatch.setattr(transducer, "MOST_WORDS", 40)
    monkeypatch.setattr(transducer, "MOST_PAIRS", 100)
    monkeypatch.setattr(transducer, "BLOCK", 16)
    codec, library = transducer.Tokenizer(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET + ["word"] * 9) for _ in range(rng.randrange(400))) for _ in range(60)] + ["q" * 3000]
    got = [np.frombuffer(b"".join(ids), "<u4").tolist() for ids in codec.encode_several(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_registered_round_trips(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = [tuple(r) for r in catalog.QUERIES["op12_byte_bpe"](spark, SF_DIR).collect()]
    assert sorted(got, key=repr) == library_round_trip([(r.doc_id, r.text) for r in rows])


# Collocations

def brute_collocations(rows, least, top):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, phrase), a in found.items():
        if any(len(x) == 3 and phrase in (x[:2], x[1:]) and g == lang and 100 * f >= 50 * a for (g, x), f in found.items() if len(phrase) == 2):
            continue
        score, k = min((1000000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return sorted((lang, n, p.decode(), -a, left, right, sizes[lang], -s) for lang, some in out.items()
                  for n, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.sampled_from([2, 3, 4, 5]))
def test_index_counts_all_phrases(ids, depth):
    """Extension to the left and to the right, in any order, against counting."""
    text = np.array([*ids, 0], np.int32)
    index = collocations.PhraseIndex.of(text, 5, depth)
    want = lambda k: Counter(tuple(ids[i:i + k]) for i in range(len(ids) - k + 1) if 0 not in ids[i:i + k])
    table = lambda level: {tuple(w): n for w, n in zip(level.words.tolist(), level.count.tolist()) if n}
    for sides in ("l" * depth, "r" * depth, "lr" * depth, "rl" * depth):
        level = index.words()
        assert table(level) == want(1)
        for k, side in enumerate(sides[:depth - 1], 2):
            level = index.extend_left(level) if side == "l" else index.extend_right(level)
            assert table(level) == want(k)


@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_collocations_as_by_brute_force(spark, shard_words, monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 200)
    rng = random.Random(4)
    vocabulary = ["of", "the", "The", "new york", "new york city", "a\x1fb", "é", "x", "y", "in. the", "\x0b", "\t"]
    rows = [(rng.choice([None, "und", "en", "e n", "l\nf"]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " . "), ("zz", "one two"), ("", "q r " * 30)] + [("en", "same words here")] * 12
    docs = spark.createDataFrame([(g, t, 1, "clash") for g, t in rows], "lang string, text string, rank int, phrase string")
    got = [tuple(r) for r in collocations.collocations(docs, top=6, shard_words=shard_words).collect()]
    assert sorted(got) == brute_collocations(rows, 10, 6)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    """A phrase whose products pass 64 bits; counts come from the operator's own table."""
    a, left, right = 3_000_000_017, 5_000_000_029, 4_000_000_007
    counts = spark.createDataFrame([("en", "", 0, 10**13), ("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)], "lang string, phrase string, size int, f long")
    got = collocations.ranked(counts, 2000).collect()
    assert [tuple(r) for r in got] == [("en", 1, "p q", a, left, right, 10**13, 1000000 * a * a // (left * right))]
