"""The training-data operators: odd rows, brute force, round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formsift.llm import (
    common, fingerprint, line_dedup, mixing, neighbours, ngram_join, packing, quality, suffix_dedup, token_prefix, url_filter,
)
from formsift.llm.components import components
from formsift.llm.suffix_array import suffix_array
from tests.conftest import SF_DIR

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def table_of(spark, rows):
    """Documents from (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "naïve", "日本"]) + str(rng.randrange(900)) for _ in range(30_000))
    body = " ".join(f"word{i}" for i in range(60))
    return [
        (None, body, "a"), (1, None, None), (2, "", "a"), (3, " \t\n ", None), (4, long, "b"), (5, body, "a"),
        (6, body, "b"), (6, body, "b"), (7, "one two", "c"), (8, "ONE  two", "a"), (9, body + " more", "b"), (10, "x" * 3000, "c"),
    ]


# URL filter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_urls_are_parsed_and_ruled(spark):
    urls = [
        (1, None, "", "", None), (2, "nothing", "", "", None), (3, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/"),
        (4, "https://x.net", "x.net", "", None), (5, "https://x.net/#a", "x.net", "/", "net/"), (6, "u://example.com/de/1#z", "example.com", "/de/1", "example.com/de/"),
        (7, "u://notexample.com/de/", "notexample.com", "/de/", None), (8, "u://É.org/fr/", "É.org", "/fr/", "org/fr/"), (None, "u://h?x", "h", "", None),
        (9, "a://b://c/d", "b:", "//c/d", None),
    ]
    pages = spark.createDataFrame([(i, u, "html", "w") for i, u, *_ in urls], "page_id long, url string, host string, n string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels, RULES).collect()}
    assert len(got) == len(urls)
    for i, _, host, path, rule in urls:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert [got[i].verdict for i in (3, 5, 6, 8)] == ["allow", "block", "block", "allow"]
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0), RULES).count() == 0


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows = [("good.site.com", 1)] * 80 + [("bad.other.com", 0)] * 60 + [("bad2.other.com", 0)] * 20 + [("new.other.com", None), ("new.site.com", None)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    got = {r.host: r for r in url_filter.host_reputation(outcomes, 1.645).collect()}
    assert got["good.site.com"].lower_bound > 0.9 > 0.1 > got["bad.other.com"].posterior_mean
    assert got["new.site.com"].posterior_mean > 0.6 > 0.4 > got["new.other.com"].posterior_mean
    assert got["new.site.com"].lower_bound < got["good.site.com"].lower_bound


# Mixing

def test_targets_fill_up_without_going_over(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 3, 1.0).collect()}
    # a is capped at 30, then the null source (weight 5) at 270; b and c share the rest two to one.
    assert got["a"] == 30 and got[None] == 270
    assert math.isclose(got["b"], 1300 * 2 / 3) and math.isclose(got["c"], 1300 / 3)


def test_mix_keeps_targets_rows_and_order(spark):
    docs = table_of(spark, odd_rows() + [(100 + i, "w " * (i % 37), "abc"[i % 3]) for i in range(400)])
    mix = mixing.mixture(docs)
    ordered = mixing.in_order(mix).collect()
    assert [r.mix_start for r in ordered] == list(np.cumsum([0] + [r.taken for r in ordered])[:-1])
    taken = mixing.taken_words(mix, mixing.in_order(mix)).collect()
    by = {}
    for r in taken:
        assert r.taken <= 3 * r.size * (2 if r.doc_id == 6 else 1)
        total, target = by.get(r.source, (0, r.target))
        by[r.source] = (total + r.taken, target)
    assert all(abs(t - g) <= 1 for t, g in by.values())
    assert {r.doc_id for r in taken} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert mixing.in_order(mixing.mixture(docs.limit(0))).count() == 0


def test_running_totals_over_many_buckets(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise(F.lit(None)).alias("g"), common.even_place(F.col("id")).alias("p"), "id")
    got = common.running_totals(rows, ["g"], "p", ["id"], "id", "before", rows=4).collect()
    for group in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.g == group), key=lambda r: (r.p, r.id)):
            assert r.before == total
            total += r.id


# Line deduplication

def brute_lines(rows, least):
    sites, first = {}, {}
    for d, t, s in rows:
        for x in set((t or "").split("\n")):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(s)
                first.setdefault(x.strip(" "), []).append(d)
    out = []
    for d, t, s in rows:
        if t is None:
            out.append((d, None))
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            key = x.strip(" ")
            if not key or len(sites[key]) < least or (d == min(first[key], key=lambda v: (v is not None, v)) and key not in seen):
                kept.append(x)
            seen.add(key)
        out.append((d, "\n".join(kept)))
    return out


def test_lines_that_spread_go(spark):
    rng = random.Random(2)
    lines = ["share this", " share this ", "rights reserved", "", "common a", "common b"] + [f"own line {i}" for i in range(200)]
    rows = odd_rows() + [(20 + i, "\n".join(rng.choice(lines[:8] if i % 2 else lines) for _ in range(9)), rng.choice(["a", "b", "c", "d", "e", None])) for i in range(120)]
    got = line_dedup.drop_boilerplate(table_of(spark, rows).withColumn("n_lines", F.lit("clash")), min_sites=4).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(brute_lines(rows, 4), key=repr)
    assert all(r.n_removed == (r.n_lines - len(r.text.split("\n")) if r.text else r.n_removed) for r in got)
    assert line_dedup.drop_boilerplate(table_of(spark, rows).limit(0)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i * 1000 + s, f"line {i}", f"s{s}") for i in range(40) for s in range(60 + i)]
    got = line_dedup.drop_boilerplate(table_of(spark, rows), min_sites=80, lg_k=5).filter("n_removed > 0")
    assert {r.text0 for r in got.select((F.col("doc_id") / 1000).cast("int").alias("text0")).distinct().collect()} == set(range(20, 40))


# Quality

def test_rules_follow_tree_paths():
    dump = "Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 0.0\n     Else (feature 1 <= 2.0)\n      Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 1.0\n"
    a, b = quality.NAMES[:2]
    assert quality.tree_rules(dump) == {
        ((a, True, 0.5),), ((a, False, 0.5),), ((a, True, 0.5), (b, False, 2.0)), ((a, True, 0.5), (b, True, 2.0))}


def test_quality_is_learned_without_the_held_out_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2]
    # Wrong labels in the held-out part change nothing.
    spoilt = labels.select("doc_id", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    scored = quality.score_quality(docs.select("doc_id", "text"), spoilt)
    rows = scored.join(labels, "doc_id").select("held_out", "quality", "predicted", "doc_id").collect()
    assert all(r.held_out == (r.doc_id in held) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.quality == r.predicted for r in test) / len(test) >= 0.95


def test_quality_of_odd_rows(spark):
    docs = table_of(spark, odd_rows()).withColumn("score", F.lit("clash"))
    empty = spark.createDataFrame([], "doc_id long, label int")
    got = quality.score_quality(docs, empty).collect()
    assert len(got) == 12 and all(abs(r.score - 0.5) < 1e-9 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, labels).collect())
    assert quality.score_quality(docs.limit(0), labels).count() == 0


# Token counts

def odd_texts():
    return [t or "" for _, t, _ in odd_rows()] + [
        "  Hello\n\tworld  ﬁ  <s> x</s>▁a  ", "日本語 mit 🎉🎉 unḱ " + "a" * 90, " ", "\n", "a", "Zażółć\x00\x01jaźń", "ab" * 300 + "   " + "." * 77,
        "it's I'LL 'S foo<|endoftext|>bar <|ENDOFTEXT|>", "a.b(c) e,f;g:h!i?j'k\"l_m-n+o=p*q&r%s$t#u@v/w\\x|y~z 1.5 3,000 ×÷ ªº ÀÉ x\u0085y\x1cź ́"]


def test_every_prefix_has_its_exact_count():
    import sentencepiece

    sp, counts = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_prefix.counter(PIECES)
    rng = random.Random(1)
    for text in odd_texts():
        steps = np.cumsum(counts.differences(text), dtype=np.int64)
        ends = range(1, len(text) + 1) if len(text) < 60 else [rng.randrange(1, min(len(text), 3000)) for _ in range(25)] + [len(text)]
        assert all(steps[i - 1] == len(sp.encode(text[:i])) for i in ends)


def test_prefix_table_answers_budgets(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_rows()
    got = token_prefix.prefix_table(table_of(spark, rows), PIECES, 50).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(sp.encode(text)))
        assert r.over_limit == (r.n_tokens > 50) and len(r.steps) == len(text)
        assert len(sp.encode(text[:r.limit_chars])) <= 50
        if r.limit_chars < len(text):
            assert len(sp.encode(text[:r.limit_chars + 1])) > 50
    assert token_prefix.prefix_table(table_of(spark, rows).limit(0), PIECES, 50).count() == 0


# Packing

def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(WORDS), packing.encoder(WORDS)
    for text, ids in zip(odd_texts(), words.many(odd_texts())):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_fullest_combination_is_the_best_one(seed):
    rng = random.Random(seed)
    stock = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(5, 120)
    sums = {0}
    for n, c in stock.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    chosen = packing.fullest(stock, sorted(stock, reverse=True), room)
    assert all(c <= stock[n] for n, c in chosen.items()) and sum(n * c for n, c in chosen.items()) == max(sums)


def test_packing_is_gapless_and_complete(spark):
    rows = odd_rows() + [(100 + i, "tok " * (i % 90), "a") for i in range(300)]
    got = packing.pack(table_of(spark, rows).withColumn("rank", F.lit("clash")), WORDS, capacity=128).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by_sequence) <= math.ceil(sum(r.length for r in got) / 128) + 2
    texts = {d: t or "" for d, t, _ in rows}
    for d, pieces in by_doc.items():
        ids = [np.frombuffer(b"".join(p.ids for p in sorted(pieces, key=lambda p: p.piece)), "<u4")]
        if d != 6:  # two equal rows
            assert ids[0].tobytes() == packing.encoder(WORDS).many([texts[d]])[0] + np.array([1], "<u4").tobytes()
            assert [p.start for p in sorted(pieces, key=lambda p: p.piece)] == [128 * k for k in range(len(pieces))]
    assert len(by_doc[6]) == 2 * len(by_doc[5]) and len(by_doc) == len({d for d, _, _ in rows})
    assert packing.pack(table_of(spark, rows).limit(0), WORDS).count() == 0


# Fingerprints

def test_spans_and_common_extensions():
    rng = random.Random(4)
    a = "".join(rng.choice("ab🎉é") for _ in range(400))
    b = a[:130] + "#" + a[131:]
    pa_, pb = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(390), rng.randrange(390), rng.randrange(1, 10)
        assert pa_.equal(i, pb, j, n) == (a[i:i + n] == b[j:j + n])
        want = next((k for k in range(400) if a[i + k:i + k + 1] != b[j + k:j + k + 1] or i + k >= 400 or j + k >= 400), 0)
        assert pa_.common_extension(i, pb, j) == want


def test_fingerprints_of_neighbours(spark):
    rows = odd_rows()
    got = fingerprint.fingerprints(table_of(spark, rows).repartition(5)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(rows)
    for k, (d, t, _) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        own = [r for r in got if r.doc_id == d]
        assert hashlib.sha256(changed.encode()).hexdigest() in {r.edited_sha256 for r in own}
        assert all(r.n_chars == len(t) and 0 <= r.near_next <= 1 and (r.near_edited == 1) == (changed == t or r.fingerprint == r.edited_fingerprint) for r in own if d != 6)
    same = {r.fingerprint for r in got if r.doc_id in (None, 5, 6)}
    assert len(same) == 1
    assert fingerprint.fingerprints(table_of(spark, rows[:1]).limit(0)).count() == 0
    assert fingerprint.fingerprints(table_of(spark, rows[4:5])).count() == 1


def test_likeness_estimates_the_share_of_common_spans():
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    for share in (0.9, 0.5, 0.2):
        b = a[:int(6000 * share)] + "".join(rng.choice("abcdefgh ") for _ in range(6000 - int(6000 * share)))
        x, y = ({t[i:i + fingerprint.SPAN] for i in range(len(t) - fingerprint.SPAN + 1)} for t in (a, b))
        got = fingerprint.likeness(*(fingerprint.fingerprint(fingerprint.PrefixHash(t)) for t in (a, b)))
        assert abs(got - len(x & y) / len(x | y)) < 0.2


# N-gram Jaccard join

def brute_components(rows):
    lower = str.maketrans(common.UPPER, common.LOWER)
    sets = {}
    for d, t, _ in rows:
        w = SPLIT.findall((t or "").translate(lower))
        sets.setdefault(d, []).append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((d, len(s), root(d) if d is not None else None) for d, group in sets.items() for s in group), key=repr)


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies_are_linked_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))] for _ in range(6)]
    rows = odd_rows()
    for i in range(130):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
        if i % 9 == 0:
            words = words[:rng.randrange(1, len(words))]
        rows.append((50 + i, " ".join(words), "a"))
    got = ngram_join.similar_components(table_of(spark, rows).withColumn("key", F.lit("clash"))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_join_has_one_tile_of_the_same_members(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    rows = [(i, " ".join(words("common", 30) + words(f"own{i // 2}x", 60)), "a") for i in range(40)]
    rows = [(i, f"{text} last{i}", s) for i, text, s in rows]
    sized = ngram_join.set_table(table_of(spark, rows), ngram_join.Threshold())
    found = ngram_join.tiles(sized, sized.select("doc_id", F.col("doc_id").alias("id")), ngram_join.Threshold())
    tiles = [tuple(sorted(r.ids)) for r in found.groupBy("element", "band").agg(F.collect_list("id").alias("ids")).collect()]
    assert len(set(tiles)) == len(tiles) and {(2 * k, 2 * k + 1) for k in range(20)} <= set(tiles)


def test_flat_links_take_no_round(spark, monkeypatch):
    monkeypatch.setattr("formsift.llm.components.star", None)
    links = spark.createDataFrame([(2, 1), (1, 3), (9, 8), (9, 8)], "a long, b long")
    assert sorted(map(tuple, components(links, "test").collect())) == [(2, 1), (3, 1), (9, 8)]
    assert components(links.limit(0), "test").count() == 0


def test_join_leaves_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    ngram_join.similar_components(table_of(spark, odd_rows()))
    assert spark.conf.get(key) == before


def test_join_of_nothing(spark):
    assert ngram_join.similar_components(table_of(spark, odd_rows()).limit(0)).count() == 0


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(0)
    for _ in range(50):
        pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 250))) for _ in range(2))
        x, y = (ngram_join.bitmap(v, ngram_join.bitmap_bits(len(v))) for v in (a, b))
        size = min(len(x), len(y))
        exact = ngram_join.overlap(a, b)
        assert exact == len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(ngram_join.folded(x, size), len(a), ngram_join.folded(y, size), len(b)) >= exact


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 9)] + [(300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + k] == 100 for k in range(1, 9)) and got[300] == 299


# Suffix-array dedup

@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array_is_sorted(letters):
    rng = random.Random(letters)
    for _ in range(300):
        text = bytes(rng.randrange(letters) for _ in range(rng.randrange(60)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows, length):
    seen, out = set(), []
    for d, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k:k + length] in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(raw[k:k + length])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_repeats_go_as_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 5000)
    rng = random.Random(most)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(60, 300))) for _ in range(12)]
    rows = [r for r in odd_rows() if r[0] != 6]
    rows += [(50 + i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdeé ") for _ in range(90)) for _ in range(rng.randrange(1, 7))), "a") for i in range(60)]
    got = suffix_dedup.drop_repeats(table_of(spark, rows).withColumn("start", F.lit("clash"))).collect()
    want = brute_repeats(rows, 100)
    whole = next(t for d, t, _ in rows if d is None)
    assert [tuple(r)[:5] for r in got if r.doc_id is None] == [(None, len(whole), 0, 0, hashlib.sha256(whole.encode()).hexdigest())]
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_odd_tables(spark):
    assert suffix_dedup.drop_repeats(table_of(spark, odd_rows()).limit(0)).count() == 0
    twice = suffix_dedup.drop_repeats(table_of(spark, [(1, "ab" * 90, "a"), (1, "ab" * 90, "a")])).collect()
    assert [(r.n_bytes, r.n_removed) for r in twice] == [(180, 178), (180, 178)]


# Nearest neighbours

def brute_nearest(rows, asked, k):
    valid = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in asked:
        if q in valid:
            scores = sorted(((-float(valid[q] @ v), i) for i, v in valid.items() if i != q))
            out[q] = [i for _, i in scores[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    same = unit(rng.normal(size=8))
    rows = [(i, unit(rng.normal(size=8))) for i in range(300)] + [(400 + i, same) for i in range(60)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [None] * 8), (1060, [float("nan")] * 8), (1080, [1.0] * 5), (None, same), (20, rows[20][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = neighbours.nearest(table, table.filter("vec_id % 20 = 0"), neighbours.Plan(block=60, tree_sample=200)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(found[r.query_id])
    want = brute_nearest(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    assert found[400] == [400 + i for i in range(1, 21)]


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], schema)
    got = neighbours.nearest(few, few.filter("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert neighbours.nearest(one, one).count() == 0
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_recall_on_the_test_table(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    matrix, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = matrix @ matrix[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_only_shared_bytes_enter_a_suffix_array():
    rng = random.Random(8)
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    both = some(120)
    block = suffix_dedup.Block(100)
    block.add([(some(30) + both, 5, 0), (both + some(30), 3, 700), (some(150), 4, 9)])
    assert block.contexts == [(both, 5, 30), (both, 3, 700)]
    assert block.repeats() == [(5, 30, 150)] and not block.contexts
    block.add([(b"\0" * 130, 1, 0), (b"\0" * 130, 1, 10)])
    assert block.repeats() == [(1, 1, 140)]
