"""Token counts, cross-tokenizer alignment and hard negatives against brute force and their libraries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarry.llm import (
    alignment,
    bpe,
    hard_negatives,
    html_text,
    mixing,
    quality,
    simhash,
    token_counts,
    token_files,
    toxicity,
)

DOCS = "doc_id long, text string, n_bytes long, n long, key string, block string, n_a long"
LONG = " ".join(f"Wörd{k % 977} the," for k in range(60_000))
TEXTS = [(1, "The quick brown fox's jumpéd over 12 dogs.\n\n  Ende 你好! I'll've"), (2, None), (3, ""),
         (None, "no id here"), (5, LONG), (6, "same same"), (6, "same same"), (7, "same same"), (8, " \t\n "),
         (9, "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <s></s> <unk> <0x41>"), (10, "İstanbul ΣΑΣ ﬁ é Ⅻ ½"),
         (11, "x" * 30_000), (12, "tab\x1cfile\x1dgroup \x00 nul \x7f \x0b vt"), (13, "lower▁line ▁ A▁"),
         (14, "a​b c　d\xa0e f᠎g\x85h﻿i"), (15, "😀👍🏽 \U0001d54f"), (16, "e ́ x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, 8, "k", "b", 9) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def multiset(rows):
    return Counter(map(tuple, rows))


def test_token_counts_equal_the_library(docs, none, spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    more = [(100 + k, f"a{chr(c)}b 'S{chr(c)}x9{chr(c)}{chr(c)}") for k, c in enumerate(
        [*range(1, 0x300), *range(0x1FF0, 0x2070), 0x1680, 0x3000, 0xFEFF, 0x130, 0x3A3, 0xAC00, 0x1E9E])]
    extra = spark.createDataFrame([(i, t, 7, 8, "k", "b", 9) for i, t in more], DOCS)
    got = token_counts.token_counts(docs.union(extra), path, limit=10).collect()
    want = []
    for i, t in TEXTS + more:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert multiset(got) == multiset(want)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_of_many_small_blocks(spark):
    """Blocks of a few documents, words shared by all of them: sums are the same."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(3)
    texts = [(k, " ".join(rng.choice(["the", "Fragment", "x%d" % k, "naïve", "it's"]) for _ in range(k % 50)))
             for k in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    split = token_counts.PreTokens(path)
    assert split.counts("it's a<|endoftext|>b") == (Counter({"it": 1, "'s": 1, "a": 1, "b": 1}), 1)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, block_bytes=2000).collect()}
    assert got == {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in texts}


def brute_alignment(texts):
    """The contract, token by token."""
    from tokenizers import Tokenizer
    lib_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib_a.encode_special_tokens = True
    a = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    own = {}
    for t in {t for _, t in texts if t}:
        ids_a = lib_a.encode(f" {t}", add_special_tokens=False).ids
        ids_b = a.lib_b.encode(t)
        if any(b"".join(s.tokens[i] for i in ids) != f" {t}".encode() for s, ids in ((a.a, ids_a), (a.b, ids_b))):
            continue
        spans = []
        for side, ids in ((a.a, ids_a), (a.b, ids_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(side.tokens[i]), i))
                at += len(side.tokens[i])
            spans.append(found)
        links, lo = [], 0
        for s, e, i in spans[0]:
            while spans[1][lo][1] <= s:
                lo += 1
            j = lo
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, k, m = [], 0, 0
        for end in both:
            ga, gb = [], []
            while k < len(spans[0]) and spans[0][k][1] <= end:
                ga.append(str(spans[0][k][2]))
                k += 1
            while m < len(spans[1]) and spans[1][m][1] <= end:
                gb.append(str(spans[1][m][2]))
                m += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        own[t] = (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for _, t in texts if t in own for p in set(own[t][3]))
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    for i, t in texts:
        if t not in own:
            yield (i, 0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, digest = own[t]
            yield (i, n_a, n_b, n_groups, len(links), sum(count[p] == highest[p[0]] for p in links),
                   sum(count[p] for p in links), digest)


def test_alignment_equals_brute_force(spark, docs, none):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    words = ["the", "Unglaublich", "naïve", "x9", "réseau", "don't", "  ", "\n", "12.5", "España", "straße"]
    more = [(200 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for k in range(300)]
    more += [(600 + k, more[0][1]) for k in range(150)]      # a third of the rows have one text
    extra = spark.createDataFrame([(i, t, 7, 8, "k", "b", 9) for i, t in more], DOCS).repartition(4)
    got = alignment.alignment(docs.union(extra), *paths, block_bytes=3000)
    assert got.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert multiset(got.collect()) == multiset(brute_alignment(TEXTS + more))
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[2].n_a == by_id[3].n_a == by_id[13].n_links == 0 and by_id[13].groups_sha256 == ""
    assert by_id[5].n_groups > 60_000 and by_id[9].n_a > 10
    assert alignment.alignment(none, *paths).count() == 0


def test_alignment_of_one_batch():
    aligner = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    measures, digests, of, pairs, links = aligner.align(["ab", "", "the the"])
    assert measures.shape == (4, 3) and digests[1] == "" and measures[:, 1].tolist() == [0] * 4
    assert links.sum() == measures[3].sum() and set(of.tolist()) == {0, 2} and len(pairs) == len(links)


VECTORS = "vec_id long, label int, embedding array<float>, score double, copy long, block int"


def brute_negatives(rows, every):
    valid = []
    for n, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    for _, i, label, v in valid:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), (j is None, j or 0), same == label, j) for _, j, same, w in valid
                         if j != i and len(w) == len(v)), key=lambda s: (s[0], s[1], not s[2]))
        for p in [s for s in scored if s[2]][:5]:
            rank = 0
            for s in scored:
                if not s[2] and rank < 10 and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]:
                    rank += 1
                    yield i, p[3], rank, s[3], -p[0], -s[0]


@pytest.mark.parametrize("rows_a_block", [16_384, 40])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(3, rows_a_block // 10))
    rng = random.Random(7)
    rows = [(i, rng.randrange(10), [float(rng.randrange(-8, 20)) / 16 for _ in range(4)]) for i in range(600)]
    rows += [(None, 3, [1.0, 1.0, 1.0, 1.0]), (700, None, [1.0] * 4), (701, 2, None), (702, 2, [1.0, None, 0.0, 0.0]),
             (703, 2, [float("nan"), 0.0, 0.0, 0.0]), (704, 2, [float("inf"), 0.0, 0.0, 0.0]), (800, 4, [0.0] * 4),
             (900, 5, [1.0, 2.0]), (901, 5, [1.0, 2.0]), (902, 6, [0.25, 1.0]), (1000, 5, []), (1001, 5, []), (1002, 6, []),
             rows[3], rows[3], rows[200], rows[200]]
    frame = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(frame, every=20).collect()
    want = Counter(brute_negatives(rows, 20))
    assert sum(want.values()) > 500 and multiset(got) == want
    assert any(r.positive_score == 0 for r in got)


def test_hard_negatives_of_ties_and_empty(spark):
    same = [(i, i % 3, [1.0, 1.0]) for i in range(300)]      # one vector in all rows: every score is a tie
    half = [(1000 + i, 7, [0.5, 0.5]) for i in range(30)]
    frame = spark.createDataFrame([(*r, 0.5, 1, 2) for r in same + half], VECTORS)
    assert multiset(hard_negatives.hard_negatives(frame).collect()) == Counter(brute_negatives(same + half, 100))
    assert hard_negatives.hard_negatives(frame.limit(0)).count() == 0


def test_hard_negatives_beyond_doubles(spark):
    """Products beyond 2**53 are whole numbers still."""
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.random() * 1e6, rng.random() * 1e6]) for i in range(60)]
    frame = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], VECTORS.replace("float", "double"))
    assert multiset(hard_negatives.hard_negatives(frame, every=20).collect()) == Counter(brute_negatives(rows, 20))
    assert hard_negatives.unpacked(hard_negatives.packed(3, -5, True, None)) == (3, -5, True, None)
    assert hard_negatives.packed(3, 9, False, 5) < hard_negatives.packed(3, 9, True, 1) < hard_negatives.packed(3, 8, False, 1)


def test_token_file_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    lib, own = Tokenizer.from_file(path), token_files.WordEncoder(path)
    pool = [*"abzAZÀÖéÿßÞø'sStTlLdDrReEvVmM<|>!?.,#%5 ½Ⅻ", "<|endoftext|>", "<|STARTOFTEXT|>", "́", "̇",
            "̸", "İ", "İ", "H̱", "ſ", "K", "\x1c", "\x85", "​", "　", "'s", "'RE", "中", "😀",
            "\n", "\t", "é", "ΑΣ", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(8000)] + ["", LONG]
    ids, sizes = own(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_sample_is_bounded_where_one_row_repeats(spark):
    from pyspark.sql import functions as F

    from quarry.llm.common import sample
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id")).withColumn(
        "draw", F.xxhash64("id"))
    got = sample(rows, "draw", 60_000, 1000)
    assert 600 < got.count() == got.distinct().count() <= 1000
    assert sorted(got.collect()) == sorted(sample(rows.repartition(5), "draw", 60_000, 1000).collect())


def test_quality_training_rows_are_bounded_and_unbroken_texts_are_whole(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(quality, "TRAIN_ROWS", 200)
    texts = [(k, "one copied text for a third of all rows" if k % 3 == 0 else f"text number {k} of many") for k in range(9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert 100 < quality.training_rows(docs, 9000, {}).count() <= 200
    same = spark.createDataFrame([(1, "the same row")] * 3000 + texts[:600], "doc_id long, text string")
    assert quality.training_rows(same, 3600, {}).count() <= 200
    a, b = "x" * 40 + "y" * 100_000 + "end", "x" * 40 + "%&" * 50_000 + "end"
    assert quality.pieces("ab " + a)[:2] == ["ab", "x" * 24] and "".join(quality.pieces(a)) == a
    weights = np.zeros(quality.DIMENSIONS, np.float32)
    weights[quality.hashed("%&" * 12)[0]] = -5.0
    scorer = quality.Scorer(weights, 1.0)
    assert scorer.score(a) > 0.7 and scorer.score(b) < 0.1


def test_toxicity_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 300)
    ids = [(k if k % 3 else 1, f"text {k}") for k in range(6000)]
    docs = spark.createDataFrame(ids, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(250)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "toxic").count() <= 300


PAGE = "<html><body><div class='x1'><p>{0} notice of the site</p></div><section><ul><li>{1}</li><li>two</li></ul></section></body></html>"


@pytest.mark.parametrize("copies", [2, 10, 1000])
def test_mirrored_pages_keep_their_text(spark, copies):
    pages = [(k, f"https://host.example/m{k}", PAGE.format("Some", "mirror")) for k in range(copies)]
    pages += [(5000 + k, f"https://other.example/{k}", PAGE.format("Same", f"page {k}")) for k in range(12)]
    got = {r.page_id: r.text for r in html_text.main_texts(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(copies)} == {"Some notice of the site\nmirror\ntwo"}
    assert got[5003] == "page 3"     # what 12 different pages share is template


def test_pages_without_host_share_no_template(spark):
    pages = [(k, [None, "/relative", ""][k % 3], PAGE.format("Same", f"page {k // 10}")) for k in range(60)]
    got = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Same notice of the site\npage {k}\ntwo" for k in range(6)}


def test_quotas_in_ranges_keep_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 3)
    rows = [("a", k, 5 + k % 4, 11) for k in range(20)] + [("b", 0, 9, 2)]
    some = spark.createDataFrame(rows, "key string, shard long, size long, blocks long")
    got = mixing._quotas(some).collect()
    assert len(got) == 21 and sum(r.won for r in got if r.key == "a") == 11 and sum(r.won for r in got if r.key == "b") == 2
    assert all(r.won <= 2 for r in got if r.key == "a")


def test_kept_row_of_repeated_ids_does_not_depend_on_order(spark):
    rows = [(1, "a text of some words", lang) for lang in ("en", "de", "fr", None)] * 3
    kind = "doc_id long, text string, lang string"
    kept = {simhash.kept(spark.createDataFrame(rows[s:] + rows[:s], kind).repartition(4)).collect()[0].lang for s in range(4)}
    assert len(kept) == 1


def test_spaced_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    lib, own = Tokenizer.from_file(path), alignment.SpacedEncoder(path)
    lib.encode_special_tokens = True
    pool = [*"abzAÖéß's!?.,#%5 ½Ⅻ    ", "<|endoftext|>", "\u0301", "\x1c", "\x85", "\u200b", "\u3000", " \n", "\n ", "\t", "  ",
            " \n ", "'s", " '", "中", "😀", "\xa0", "the", " word", "12", "\r\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(30_000)] + ["", " ", "  ", LONG]
    ids, sizes = own(pa.array(texts))
    want = [e.ids for e in lib.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_digests_of_pieces_laid_out_in_steps(monkeypatch, step):
    """Empty documents, documents longer than a step, and a step that ends inside one."""
    monkeypatch.setattr(bpe, "STEP", step)
    ids, starts = np.array([0, 12, 3, 3, 7, 11, 5, 0]), np.array([0, 0, 5, 5, 6, 8])
    pieces = pa.array([b"%d," % k for k in range(13)], pa.large_binary())
    parts = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert bpe.joined_sha256(ids, starts, pieces, 1) == [
        hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in parts]
    assert bpe.joined_sha256(ids, starts, pieces, 0) == [
        hashlib.sha256("".join(f"{k}," for k in p).encode()).hexdigest() for p in parts]


def test_license_places_beyond_a_block(spark):
    from pyspark.sql import functions as F

    from quarry.llm import licenses
    texts = [" " + "水 mit  mit license ñ " * n for n in (0, 1, 3, licenses.BLOCK, licenses.BLOCK * 3 + 1)] + [" mit" * 700 + " "]
    df = spark.createDataFrame([(i, " " + " ".join(t.split()) + " ") for i, t in enumerate(texts)], "id long, w string")
    pattern = " (?:mit(?: license)?)(?= )"
    got = df.select("id", "w", licenses.places(F.col("w"), F.lit(pattern), F.regexp_extract_all("w", F.lit(pattern), F.lit(0))).alias("p"))
    for r in got.collect():
        assert [(x.s, x.n) for x in r.p] == [(m.start() + 1, len(m.group())) for m in re.finditer(pattern, r.w)]
